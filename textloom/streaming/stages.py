"""Units as a stream: saved batch by batch, moved through states, and watched."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

# States of a unit, in order.
STATES = ("pending", "translated_a", "translated_b", "judged", "applied", "verified")


def saved_units(units: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Runs ``work`` over a stream of units and saves each batch below ``path``, in a folder of its number that is
    replaced if the batch runs again, so a run that was broken off goes on where it was and saves nothing twice."""

    def save(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return units.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_state(state: Column) -> Column:
    """The state after one; the last stays, an unknown one is pending."""
    known = F.create_map(*[F.lit(x) for pair in zip(STATES, STATES[1:] + STATES[-1:]) for x in pair])
    return F.coalesce(F.try_element_at(known, state), F.lit(STATES[0]))


def state_rank(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), state)


def current_states(log: DataFrame, unit: str, at: str) -> DataFrame:
    """(unit, state): how far every unit is by a log of states: the furthest known state, whatever the order in which
    entries came, so that replayed entries change nothing."""
    ranked = log.withColumn("_k", state_rank(F.col("state"))).where("_k > 0")
    return ranked.groupBy(unit).agg(F.max(F.struct("_k", at, "state")).alias("_s")).select(unit, F.col("_s.state").alias("state"))


class Heartbeat(StreamingQueryListener):
    """Tells of a query's progress: rows, batch and seconds since the last word, as JSON lines to ``tell``."""

    def __init__(self, tell: Callable[[str], None] = print) -> None:
        self.tell, self.last = tell, time.monotonic()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._say("started", name=event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._say("progress", batch=event.progress.batchId, rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._say("idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._say("ended", error=event.exception)

    def _say(self, what: str, **more) -> None:
        now = time.monotonic()
        self.tell(json.dumps({"event": what, "seconds": round(now - self.last, 3), **more}))
        self.last = now
