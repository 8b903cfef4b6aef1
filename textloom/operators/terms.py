"""Terms: matching a glossary, learning decisions in order, mining candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.patterns import TERM_WEIGHTS

#: Terms that are sent to every worker as one automaton, at most; larger glossaries go in several rounds.
AUTOMATON_TERMS = 200_000


def _matcher(terms: list[tuple[int, str]]):
    """An Aho-Corasick automaton over the terms, or a plain search where the module is missing."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {i for i, t in terms if t in text}
    machine = ahocorasick.Automaton()
    by_text: dict[str, list[int]] = {}
    for i, t in terms:
        by_text.setdefault(t, []).append(i)
    for t, ids in by_text.items():
        machine.add_word(t, ids)
    if not by_text:
        return lambda text: set()
    machine.make_automaton()
    return lambda text: {i for _, ids in machine.iter(text) for i in ids}


def glossary_matches(df: DataFrame, glossary: DataFrame, id_col: str, text_col: str, top_k: int) -> DataFrame:
    """(id, term_id, src, tgt, rank): the terms a text contains, case-sensitive, at most ``top_k`` a text: those
    longest in bytes first, then seen most, then by src and id.

    The glossary's size is checked: up to ``AUTOMATON_TERMS`` terms make one automaton, whose cost follows the text
    and not the number of terms; more terms are searched in as many rounds, of which the driver holds one. Null and empty texts and terms match
    nothing.
    """
    terms = ((r["term_id"], r["src"]) for r in glossary.where("src is not null and src <> ''").select("term_id", "src").toLocalIterator())
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    kind = texts.schema["id"].dataType.simpleString()
    sc = df.sparkSession.sparkContext
    found: DataFrame | None = None
    while (own := list(islice(terms, AUTOMATON_TERMS))) or found is None:
        shared = sc.broadcast(own)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = _matcher(shared.value)
            for batch in batches:
                ids, hits = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = match(text)
                    ids.extend([i] * len(own))
                    hits.extend(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(hits, pa.int64())], names=["id", "term_id"])

        part = texts.mapInArrow(search, f"id {kind}, term_id bigint")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("id").orderBy(F.octet_length("src").desc(), F.col("seen").desc(), "src", "term_id")
    return (
        found.join(glossary.select("term_id", "src", "tgt", "seen"), "term_id")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_k)
        .select(F.col("id").alias(id_col), "term_id", "src", "tgt", "rank")
    )


def term_decisions(updates: DataFrame, order: list[str]) -> DataFrame:
    """(src, tgt, kind, seen): the first target proposed for a source stands; every proposal counts. Blank sides are
    no proposals."""
    clean = _proposals(updates)
    first = F.min_by(F.struct("tgt", "kind"), F.struct(*order))
    return clean.groupBy("src").agg(first.alias("f"), F.count("*").alias("seen")).select("src", "f.tgt", "f.kind", "seen")


def term_events(updates: DataFrame, order: list[str]) -> DataFrame:
    """(src, event, existing_tgt, proposed_tgt and the order columns): ``added`` for the first proposal, ``conflict``
    for each that differs from it."""
    clean = _proposals(updates)
    w = Window.partitionBy("src").orderBy(*order)
    firsts = clean.withColumns({"n": F.row_number().over(w), "existing_tgt": F.first("tgt").over(w)})
    event = F.when(F.col("n") == 1, "added").when(F.col("tgt") != F.col("existing_tgt"), "conflict")
    return (
        firsts.withColumn("event", event)
        .where("event is not null")
        .select("src", "event", F.when(F.col("event") == "conflict", F.col("existing_tgt")).alias("existing_tgt"), F.col("tgt").alias("proposed_tgt"), *order)
    )


def _proposals(updates: DataFrame) -> DataFrame:
    trim = lambda c: F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")
    clean = updates.withColumns({"src": trim("src"), "tgt": trim("tgt"), "kind": F.nullif(trim("kind"), F.lit(""))})
    return clean.where("src <> '' and tgt <> ''")


def candidate_terms(texts: DataFrame, text_col: str, keys: list[str], max_terms: int) -> DataFrame:
    """(keys, term, score): mined terms by weighted count, then length, then the term; a term within a better one,
    letter case aside, is dropped; at most ``max_terms`` a key.

    Dropping terms within kept ones equals dropping terms within any better one, since what is dropped lies within
    something kept. A term meets the better ones that hold its first four characters, not all of them.
    """
    found = None
    for pattern, weight in TERM_WEIGHTS:
        part = texts.select(*keys, F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1))).alias("term")).select(
            *keys, F.trim("term").alias("term"), F.lit(weight).alias("weight")
        )
        found = part if found is None else found.unionByName(part)
    scored = (
        found.where("length(term) between 2 and 120")
        .groupBy(*keys, "term")
        .agg(F.sum("weight").alias("score"))
        .withColumn("low", F.lower("term"))
    )
    rank = F.struct(F.col("score"), F.length("term"))
    inner = scored.select(*keys, "term", "low", rank.alias("rank"), F.substring("low", 1, 4).alias("gram"))
    outer = scored.select(*keys, F.explode(_pieces("low")).alias("gram"), F.col("low").alias("outer"), rank.alias("outer_rank"), F.col("term").alias("outer_term"))
    kept = scored.join(_within(inner, outer, keys), [*keys, "term"], "left_anti")
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.length("term").desc(), "term")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_terms).select(*keys, "term", "score", "rank")


def _pieces(column: str):
    """All pieces of two, three and four characters: one begins wherever a term could lie."""
    text = F.col(column)

    def of(n: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.concat(of(2), of(3), of(4)))


def _within(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    better = (F.col("outer_rank") > F.col("rank")) | ((F.col("outer_rank") == F.col("rank")) & (F.col("outer_term") < F.col("term")))
    return inner.join(outer, [*keys, "gram"]).where(better & F.col("outer").contains(F.col("low"))).select(*keys, "term").distinct()
