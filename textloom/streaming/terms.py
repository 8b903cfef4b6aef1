"""Term decisions over a stream: the first target of a source stands, later ones are counted or conflict."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streamed_term_events(updates: DataFrame) -> DataFrame:
    """(src, event, existing_tgt, proposed_tgt, seen) of a stream (seq, src, tgt): ``added`` for the first target of
    a source, ``conflict`` for each other one, across batches; within a batch by ``seq``. Blank sides are no
    proposals. State per source: its target and how often it was proposed."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        target, seen = state.get if state.exists else (None, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            proposed = row.tgt.strip()
            seen += 1
            if target is None:
                target = proposed
                out.append((key[0], "added", None, proposed, seen))
            elif proposed != target:
                out.append((key[0], "conflict", target, proposed, seen))
        state.update((target, seen))
        yield pd.DataFrame(out, columns=["src", "event", "existing_tgt", "proposed_tgt", "seen"])

    clean = updates.selectExpr("seq", "trim(src) as src", "tgt").where("src <> '' and trim(tgt) <> ''")
    return clean.groupBy("src").applyInPandasWithState(
        update,
        "src string, event string, existing_tgt string, proposed_tgt string, seen bigint",
        "tgt string, seen bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )
