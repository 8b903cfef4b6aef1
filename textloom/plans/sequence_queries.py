"""Queries of the sequence, comparison, term and vector operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import compare, retrieval, sequence, terms
from textloom.plans.text_queries import records, with_files
from textloom.session import table

ORDER = ["tu_id", "rec_id"]


def q_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "file_id", "tu_id", "part_name")
    rows = sequence.numbered(rows, ["file_id"], ORDER, "para_id")
    return sequence.numbered(rows, ["file_id", "part_name"], ORDER, "part_id").select("rec_id", "para_id", "part_id")


def q_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = sequence.neighbours(records(spark, d, "file_id", "tu_id", "source_surface"), ["file_id"], ORDER, "source_surface")
    return rows.select("rec_id", "prev_text", "next_text")


def q_carried_style(spark: SparkSession, d: str) -> DataFrame:
    rows = sequence.carried_forward(records(spark, d, "file_id", "tu_id", "para_style"), ["file_id"], ORDER, "para_style", "style")
    return rows.select("rec_id", "style")


def q_heading_path(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "file_id", "tu_id", "para_style", "source_surface")
    rows = rows.withColumn("level", sequence.heading_level(F.col("para_style"), F.lit(None).cast("int")))
    rows = sequence.heading_path(rows, ["file_id"], ORDER, "level", "source_surface")
    return rows.select("rec_id", "level", F.array_join("section_path", " > ").alias("path"))


def q_style_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = sequence.islands(records(spark, d, "file_id", "tu_id", "para_style", "source_surface"), ["file_id"], ORDER, F.col("para_style"))
    return rows.groupBy("file_id", "island").agg(
        F.min_by("para_style", F.struct("tu_id", "rec_id")).alias("style"), F.count("*").alias("units"), F.sum(F.length("source_surface")).alias("chars")
    )


def q_blob_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "file_id", "tu_id", "source_surface").withColumn("bytes", F.octet_length("source_surface"))
    rows = sequence.running_offset(rows, ["file_id"], ORDER, "bytes", "blob_offset")
    return rows.select("rec_id", "blob_offset", "bytes", F.sha2("source_surface", 256).alias("sha256"))


def q_pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of at most 32 units, 96 bytes over each, within max(4000, 2 x ctx - 1800) bytes."""
    budget = F.greatest(F.lit(4000), 2 * F.col("ctx_size") - 1800).alias("budget")
    files = table(spark, d, "memory_files").select("file_id", F.col("model_a").alias("backend_name"))
    files = files.join(table(spark, d, "model_backends").select("backend_name", budget), "backend_name", "left").drop("backend_name")
    rows = records(spark, d, "file_id", "tu_id", "frozen_surface").join(files, "file_id").withColumn("bytes", F.octet_length("frozen_surface"))
    return sequence.pack_chunks(rows, "file_id", ORDER, "bytes", "budget", 32, 96, ["rec_id"]).select("rec_id", "chunk", "used")


def q_apportioned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_sentences").dropDuplicates(["sent_id"])
    total = rows.where("side = 'a'").groupBy("rec_id").agg(F.sum(F.length("seg_text")).alias("total"))
    source = rows.where("side = 'source'").select("rec_id", "sent_id", F.octet_length("seg_text").cast("bigint").alias("weight"))
    return sequence.apportioned(source.join(total, "rec_id"), ["rec_id"], "sent_id", "total", "weight").select("sent_id", "share")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "memory_sentences").dropDuplicates(["sent_id"])
    return tuple(rows.where(F.col("side") == s).select("rec_id", "seg_text") for s in ("a", "b"))


def q_multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    return compare.multiset_difference(*_sides(spark, d))


def q_multiset_recall(spark: SparkSession, d: str) -> DataFrame:
    return compare.multiset_recall(*_sides(spark, d), ["rec_id"], "seg_text")


def q_aligned_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_sentences").dropDuplicates(["sent_id"]).withColumn("chars", F.length("seg_text"))
    left, right = (rows.where(F.col("side") == s) for s in ("a", "b"))
    return compare.aligned_difference(left, right, ["rec_id", "seg_idx"], ["seg_text", "suffix"])


def q_translation_report(spark: SparkSession, d: str) -> DataFrame:
    rows = with_files(spark, d, "source_surface", "translation_a", "translation_b")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"translation_{s}").alias("t")) for s in "ab"]))
    rows = rows.withColumn("_s", sides).select("source_lang", "target_lang", "_s.side", "source_surface", F.col("_s.t").alias("translated"))
    return compare.translation_report(rows, ["source_lang", "target_lang", "side"], "source_surface", "translated")


def q_longest_unit(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "file_id", "tu_id", "source_surface")
    best = F.max_by("rec_id", F.struct(F.length("source_surface"), -F.col("tu_id"), -F.col("rec_id"))).alias("rec_id")
    return rows.groupBy("file_id").agg(best, F.max(F.length("source_surface")).alias("chars"))


def q_hierarchy_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "file_id", "para_style")
    level = sequence.heading_level(F.col("para_style"), F.lit(None).cast("int"))
    return rows.groupBy("file_id").agg(
        F.count_if(level.isNotNull()).alias("headings"),
        F.count_if(F.col("para_style") == "ListParagraph").alias("list_paragraphs"),
        F.count_if(F.col("para_style") == "TableText").alias("in_table"),
    )


def q_glossary_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "source_surface")
    return terms.glossary_matches(rows, table(spark, d, "glossary"), "rec_id", "source_surface", 8).select("rec_id", "term_id", "rank")


def _updates(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "terms", "project_key", "tu_kind")
    return rows.select("rec_id", F.posexplode("terms").alias("pos", "src"), F.col("project_key").alias("tgt"), F.col("tu_kind").alias("kind"))


def q_term_decisions(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_decisions(_updates(spark, d), ["rec_id", "pos"])


def q_term_events(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_events(_updates(spark, d), ["rec_id", "pos"])


def q_candidate_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "file_id", "source_surface").select("file_id", "source_surface")
    return terms.candidate_terms(rows, "source_surface", ["file_id"], 40)


def q_vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("n", retrieval.norm(F.col("embedding")))
    unit = retrieval.normalized(F.col("embedding"), F.col("n"))
    return rows.select("vec_id", F.round("n", 5).alias("norm"), F.posexplode(unit).alias("dim", "x")).select("vec_id", "norm", "dim", F.round("x", 5).alias("x"))


def q_scaled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by their largest value and by their 3-norm, all dimensions."""
    v = F.col("embedding")
    both = F.arrays_zip(retrieval.scaled(v, "max").alias("m"), retrieval.scaled(v, "norm", 3.0).alias("n"))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(both).alias("dim", "x"))
    return rows.select("vec_id", "dim", F.round("x.m", 5).alias("by_max"), F.round("x.n", 5).alias("by_norm"))


def q_nearest_excluding(spark: SparkSession, d: str) -> DataFrame:
    """As ``q_nearest``, but no query matches the ids next to its own."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").withColumn("out", F.array(F.col("vec_id") - 1, F.col("vec_id") + 1))
    return retrieval.nearest(rows, asked, "vec_id", "embedding", "label", 5, exclude_col="out").select("query_id", "id", "score", "rank")


def q_nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    found = retrieval.nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", "label", 5)
    return found.select("query_id", "id", "score", "rank")


def q_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("weight", F.col("vec_id") % 7 + 1)
    mean = retrieval.weighted_mean(rows, ["label"], "embedding", "weight")
    return mean.select("label", F.posexplode("mean").alias("dim", "x")).select("label", "dim", F.round("x", 5).alias("x"))


def q_limited(spark: SparkSession, d: str) -> DataFrame:
    """The first five units of every file: the limit is the feature."""
    return sequence.limited(records(spark, d, "file_id", "tu_id"), ["file_id"], ORDER, 5)


def q_top_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "file_id", "tu_id", "part_name")
    return sequence.top_values(rows, ["file_id"], "tu_id", "part_name", 6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        q_limited, q_top_parts, q_scaled_vectors, q_nearest_excluding,
        q_numbering, q_neighbours, q_carried_style, q_heading_path, q_style_runs, q_blob_offsets, q_pack_chunks, q_apportioned, q_multiset_difference,
        q_multiset_recall, q_aligned_difference, q_translation_report, q_longest_unit, q_hierarchy_stats, q_glossary_matches, q_term_decisions,
        q_term_events, q_candidate_terms, q_vector_norms, q_nearest, q_mean_vectors,
    )
}

_R = "(SELECT DISTINCT rec_id, file_id, tu_id, part_name, para_style, source_surface AS s FROM paragraph_memory)"
_S = "(SELECT DISTINCT sent_id, rec_id, side, seg_idx, seg_text, suffix FROM memory_sentences)"
_LEVEL = (
    "CASE WHEN regexp_full_match(lower(trim(para_style)), 'heading[^0-9]*[0-9]+') THEN regexp_extract(para_style, '([0-9]+)$', 1)::INT"
    " WHEN lower(trim(para_style)) = 'title' THEN 1 END"
)
_W = "(PARTITION BY file_id ORDER BY tu_id, rec_id)"
_UPDATES = """(SELECT rec_id, pos, trim(src) AS src, tgt, kind FROM (
  SELECT rec_id, unnest(terms) AS src, generate_subscripts(terms, 1) - 1 AS pos, project_key AS tgt, tu_kind AS kind
  FROM (SELECT DISTINCT ON (rec_id) * FROM paragraph_memory)) WHERE trim(src) <> '' AND tgt <> '')"""

ORACLE: dict[str, str] = {
    "q_limited": f"SELECT rec_id, file_id, tu_id FROM {_R} QUALIFY row_number() OVER {_W} <= 5",
    "q_top_parts": f"""
      SELECT file_id, part_name, n, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, f, part_name) AS k
        FROM (SELECT file_id, part_name, count(*) AS n, min(tu_id) AS f FROM {_R} GROUP BY 1, 2)) WHERE k <= 6
    """,
    "q_numbering": f"SELECT rec_id, row_number() OVER {_W} ::INT AS para_id, row_number() OVER (PARTITION BY file_id, part_name ORDER BY tu_id, rec_id)::INT AS part_id FROM {_R}",
    "q_neighbours": f"SELECT rec_id, lag(s) OVER {_W} AS prev_text, lead(s) OVER {_W} AS next_text FROM {_R}",
    "q_carried_style": f"SELECT rec_id, last_value(para_style IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY tu_id, rec_id ROWS UNBOUNDED PRECEDING) AS style FROM {_R}",
    "q_heading_path": f"""
      WITH h AS (SELECT rec_id, file_id, row_number() OVER {_W} AS n, {_LEVEL} AS level, trim(s) AS t FROM {_R}),
      open AS (SELECT r.rec_id, h.level AS l, h.n AS hn, h.t FROM h r JOIN h ON h.file_id = r.file_id AND h.n <= r.n AND h.level IS NOT NULL
        WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.file_id = r.file_id AND c.n > h.n AND c.n <= r.n AND c.level <= h.level))
      SELECT h.rec_id, h.level, coalesce(string_agg(o.t, ' > ' ORDER BY o.hn) FILTER (WHERE o.t <> ''), '') AS path
      FROM h LEFT JOIN open o USING (rec_id) GROUP BY h.rec_id, h.level
    """,
    "q_style_runs": f"""
      WITH a AS (SELECT *, CASE WHEN row_number() OVER {_W} = 1 OR para_style IS DISTINCT FROM lag(para_style) OVER {_W} THEN 1 ELSE 0 END AS new FROM {_R}),
      b AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY tu_id, rec_id ROWS UNBOUNDED PRECEDING) AS island FROM a)
      SELECT file_id, island::BIGINT AS island, min(para_style) AS style, count(*) AS units, sum(length(s))::BIGINT AS chars FROM b GROUP BY file_id, island
    """,
    "q_blob_offsets": f"""
      SELECT rec_id, coalesce(sum(strlen(s)) OVER (PARTITION BY file_id ORDER BY tu_id, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS blob_offset,
        strlen(s)::INT AS bytes, sha256(s) AS sha256 FROM {_R}
    """,
    "q_pack_chunks": """
      WITH RECURSIVE r AS (
        SELECT rec_id, file_id, strlen(frozen_surface) + 96 AS a, greatest(4000, 2 * coalesce(ctx_size, 0) - 1800) AS budget,
          row_number() OVER (PARTITION BY file_id ORDER BY tu_id, rec_id) AS n
        FROM (SELECT DISTINCT rec_id, file_id, tu_id, frozen_surface FROM paragraph_memory)
        JOIN memory_files USING (file_id) LEFT JOIN model_backends ON model_a = backend_name),
      p AS (
        SELECT rec_id, file_id, n, 1 AS chunk, a AS used, 1 AS items FROM r WHERE n = 1
        UNION ALL
        SELECT r.rec_id, r.file_id, r.n, CASE WHEN p.used + a > budget OR items >= 32 THEN chunk + 1 ELSE chunk END,
          CASE WHEN p.used + a > budget OR items >= 32 THEN a ELSE p.used + a END, CASE WHEN p.used + a > budget OR items >= 32 THEN 1 ELSE items + 1 END
        FROM p JOIN r ON r.file_id = p.file_id AND r.n = p.n + 1)
      SELECT rec_id, chunk, used::BIGINT AS used FROM p
    """,
    "q_apportioned": f"""
      WITH s AS (SELECT * FROM {_S}), t AS (SELECT rec_id, sum(length(seg_text)) AS total FROM s WHERE side = 'a' GROUP BY rec_id),
      w AS (SELECT sent_id, rec_id, total, CASE WHEN sum(strlen(seg_text)) OVER (PARTITION BY rec_id) > 0 THEN strlen(seg_text) ELSE 1 END AS w FROM s JOIN t USING (rec_id) WHERE side = 'source'),
      f AS (SELECT *, (total * w) // sum(w) OVER (PARTITION BY rec_id) AS fl, (total * w) % sum(w) OVER (PARTITION BY rec_id) AS rest FROM w)
      SELECT sent_id, (fl + CASE WHEN row_number() OVER (PARTITION BY rec_id ORDER BY rest DESC, sent_id) <= total - sum(fl) OVER (PARTITION BY rec_id) THEN 1 ELSE 0 END)::BIGINT AS share FROM f
    """,
    "q_multiset_difference": f"""
      WITH a AS (SELECT rec_id, seg_text FROM {_S} WHERE side = 'a'), b AS (SELECT rec_id, seg_text FROM {_S} WHERE side = 'b')
      SELECT *, 'missing' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
    """,
    "q_multiset_recall": f"""
      WITH c AS (SELECT rec_id, seg_text, count(*) FILTER (WHERE side = 'a') AS l, count(*) FILTER (WHERE side = 'b') AS r FROM {_S} WHERE side IN ('a', 'b') GROUP BY 1, 2)
      SELECT rec_id, sum(l)::BIGINT AS left_items, sum(r)::BIGINT AS right_items, sum(least(l, r))::BIGINT AS found, sum(greatest(l - r, 0))::BIGINT AS missing, sum(greatest(r - l, 0))::BIGINT AS extra
      FROM c GROUP BY rec_id
    """,
    "q_aligned_difference": f"""
      WITH a AS (SELECT * FROM {_S} WHERE side = 'a'), b AS (SELECT * FROM {_S} WHERE side = 'b')
      SELECT rec_id, seg_idx, CASE WHEN b.sent_id IS NULL THEN 'missing' WHEN a.sent_id IS NULL THEN 'extra' WHEN a.seg_text IS DISTINCT FROM b.seg_text THEN 'seg_text' ELSE 'suffix' END AS problem
      FROM a FULL JOIN b USING (rec_id, seg_idx) WHERE a.sent_id IS NULL OR b.sent_id IS NULL OR a.seg_text IS DISTINCT FROM b.seg_text OR a.suffix IS DISTINCT FROM b.suffix
    """,
    "q_translation_report": r"""
      SELECT source_lang, target_lang, side, count(*) AS units, count(*) FILTER (s <> t) AS changed, count(*) FILTER (s = t) AS unchanged,
        count(*) FILTER (s = t AND regexp_matches(s, '[A-Za-z]')) AS latin_unchanged, count(*) FILTER (regexp_matches(t, '[\x{4e00}-\x{9fff}]')) AS with_han,
        round(count(*) FILTER (s <> t) / count(*), 6) AS changed_rate, round(count(*) FILTER (regexp_matches(t, '[\x{4e00}-\x{9fff}]')) / count(*), 6) AS han_rate
      FROM (SELECT DISTINCT rec_id, side, source_lang, target_lang, coalesce(source_surface, '') AS s, coalesce(CASE side WHEN 'a' THEN translation_a ELSE translation_b END, '') AS t
        FROM paragraph_memory JOIN memory_files USING (file_id), (VALUES ('a'), ('b')) v(side)) GROUP BY 1, 2, 3
    """,
    "q_longest_unit": f"""
      SELECT file_id, rec_id, length(s)::INT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY length(s) DESC, tu_id, rec_id) AS k FROM {_R}) WHERE k = 1
    """,
    "q_hierarchy_stats": f"""
      SELECT file_id, count({_LEVEL}) AS headings, count(*) FILTER (para_style = 'ListParagraph') AS list_paragraphs, count(*) FILTER (para_style = 'TableText') AS in_table
      FROM {_R} GROUP BY file_id
    """,
    "q_glossary_matches": f"""
      SELECT rec_id, term_id, k::INT AS rank FROM (
        SELECT rec_id, term_id, row_number() OVER (PARTITION BY rec_id ORDER BY strlen(src) DESC, seen DESC, src, term_id) AS k
        FROM {_R} JOIN glossary ON contains(s, src)) WHERE k <= 8
    """,
    "q_term_decisions": f"SELECT src, arg_min(tgt, (rec_id, pos)) AS tgt, arg_min(kind, (rec_id, pos)) AS kind, count(*) AS seen FROM {_UPDATES} GROUP BY src",
    "q_term_events": f"""
      WITH u AS (SELECT *, row_number() OVER w AS n, first_value(tgt) OVER w AS f FROM {_UPDATES} WINDOW w AS (PARTITION BY src ORDER BY rec_id, pos))
      SELECT src, CASE WHEN n = 1 THEN 'added' ELSE 'conflict' END AS event, CASE WHEN n > 1 THEN f END AS existing_tgt, tgt AS proposed_tgt, rec_id, pos::INT AS pos
      FROM u WHERE n = 1 OR tgt <> f
    """,
    "q_vector_norms": """
      WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
      SELECT vec_id, round(n, 5) AS norm, (generate_subscripts(embedding, 1) - 1)::INT AS dim,
        round(unnest(list_transform(embedding, lambda x: CASE WHEN n > 0 THEN x::DOUBLE / n ELSE x::DOUBLE END)), 5) AS x FROM e
    """,
    "q_scaled_vectors": """
      WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS m, pow(list_sum(list_transform(v, lambda x: pow(abs(x), 3.0))), 1.0 / 3) AS n FROM e)
      SELECT vec_id, (generate_subscripts(v, 1) - 1)::INT AS dim, round(unnest(v) / CASE WHEN m > 0 THEN m ELSE 1 END, 5) AS by_max, round(unnest(v) / CASE WHEN n > 0 THEN n ELSE 1 END, 5) AS by_norm FROM s
    """,
    "q_nearest_excluding": """
      WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_cosine_similarity(q.v, r.v) + CASE WHEN q.label = r.label THEN 0.02 ELSE 0 END, 6) AS score
        FROM e q JOIN e r ON q.vec_id % 50 = 0 AND abs(q.vec_id - r.vec_id) > 1)
      SELECT query_id, id, score, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 5
    """,
    "q_nearest": """
      WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_cosine_similarity(q.v, r.v) + CASE WHEN q.label = r.label THEN 0.02 ELSE 0 END, 6) AS score
        FROM e q JOIN e r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
      SELECT query_id, id, score, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 5
    """,
    "q_mean_vectors": """
      WITH e AS (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INT AS dim FROM embeddings)
      SELECT label, dim, round(sum(x * w) / sum(w), 5) AS x FROM e GROUP BY label, dim
    """,
}
