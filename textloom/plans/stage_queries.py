"""Queries of chunks, packing kinds, model stages and states. Models here are deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import masking
from textloom.operators import chunks, stages
from textloom.plans.text_queries import _SENTINEL, _WS, records, with_files
from textloom.session import spread, table
from textloom.streaming import stages as stream_stages

Query = Callable[[SparkSession, str], DataFrame]
ORDER = ["tu_id", "rec_id"]


def vowels_model() -> Callable[[list[str]], list[str]]:
    """Gives back what follows a prompt's first line, its vowels in capitals."""

    def capitals(text: str) -> str:
        for vowel in "aeiou":
            text = text.replace(vowel, vowel.upper())
        return text

    return lambda prompts: [capitals(p.split("\n", 1)[-1]) for p in prompts]


def forgetful_model() -> Callable[[list[str]], list[str]]:
    """Gives segments back with their vowels in capitals, without the last end marker if there are more than two."""
    capitals = str.maketrans("aeiou", "AEIOU")

    def answer(prompt: str) -> str:
        text = prompt.translate(capitals)
        return text if text.count("<<MT_END:") <= 2 else text[: text.rindex("<<MT_END:")]

    return lambda prompts: [answer(p) for p in prompts]


def q_fit_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents").select("doc_id", "text"))
    cut = rows.withColumn("p", chunks.fitted(F.col("text"), 60))
    return cut.select("doc_id", F.size("p").alias("pieces"), F.md5(F.array_join("p", "")).alias("text"))


def q_embedding_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents").select("doc_id", "text"))
    cut = rows.withColumn("c", chunks.embedding_chunks(F.col("text"), 200))
    return cut.select("doc_id", F.size("c").alias("chunks"), F.md5(F.array_join("c", "|")).alias("text"))


def q_chunk_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean vectors of labels, vectors weighing the characters of a text, all dimensions."""
    rows = table(spark, d, "embeddings").withColumn("text", F.repeat(F.lit("x"), (F.col("vec_id") % 7).cast("int")))
    means = chunks.chunked_means(rows, ["label"], "vec_id", "text", "embedding")
    return means.select("label", F.round("norm", 5).alias("norm"), F.posexplode("mean").alias("dim", "x")).select("label", "norm", "dim", F.round("x", 5).alias("x"))


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "memory_files").select("file_id", F.col("model_a").alias("backend_name"))
    files = files.join(table(spark, d, "model_backends").select("backend_name", "ctx_size"), "backend_name", "left").drop("backend_name")
    return records(spark, d, "file_id", "tu_id", "frozen_surface").join(files, "file_id").withColumn("bytes", F.octet_length("frozen_surface"))


def q_packings(spark: SparkSession, d: str) -> DataFrame:
    rows = _contexts(spark, d)
    out = None
    for kind in chunks.PACKINGS:
        part = chunks.packed(rows, kind, "file_id", ORDER, "bytes", "ctx_size", ["rec_id"]).select(F.lit(kind).alias("kind"), "rec_id", "chunk", "used")
        out = part if out is None else out.unionByName(part)
    return out


def q_token_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "file_id", "tu_id", "frozen_surface").withColumn("tokens", F.length("frozen_surface"))
    return chunks.token_batches(rows, "file_id", ORDER, "tokens", ["rec_id"]).select("rec_id", F.col("chunk").alias("batch"), "used")


def q_gaps_translated(spark: SparkSession, d: str) -> DataFrame:
    rows = with_files(spark, d, "frozen_surface")
    done = stages.gaps_translated(rows, "frozen_surface", "source_lang", "target_lang", "t", vowels_model, "vowels")
    return done.select("rec_id", F.md5("t").alias("text"))


def q_segments_translated(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_sentences").dropDuplicates(["sent_id"]).where("side = 'source'")
    own = F.array_sort(F.collect_list(F.struct("seg_idx", "seg_text")))
    packs = rows.groupBy("rec_id").agg(F.transform(own, lambda s: s["seg_idx"]).alias("ids"), F.transform(own, lambda s: s["seg_text"]).alias("texts"))
    done = stages.segments_translated(packs, "ids", "texts", "t", forgetful_model, "forgetful")
    return done.select("rec_id", F.array_join("t", "|").alias("texts"))


def q_repaired(spark: SparkSession, d: str) -> DataFrame:
    rows = with_files(spark, d, "frozen_surface", "nt_map", "translation_a")
    done = stages.repaired(rows, "frozen_surface", "nt_map", "translation_a", "source_lang", "target_lang", "text", vowels_model, "vowels")
    return done.select("rec_id", "text_from", "text_error", F.md5("text").alias("text"))


def q_key_values(spark: SparkSession, d: str) -> DataFrame:
    """Facts read from lines that name a record's kind and style."""
    rows = records(spark, d, "tu_kind", "para_style")
    text = F.concat(F.lit("- Domain: "), "tu_kind", F.lit("\n* 风格: \""), F.coalesce("para_style", F.lit("")), F.lit("\"\nno fact\nDocument Type: contract of "), "tu_kind")
    own = rows.withColumn("f", stages.key_values(text))
    return own.select("rec_id", "f.domain", "f.doc_type", "f.target_style", "f.summary", stages.document_kind(F.col("f.doc_type"), F.col("f.domain")).alias("kind"))


def q_json_answers(spark: SparkSession, d: str) -> DataFrame:
    """Line payloads in free text, read leniently."""
    rows = table(spark, d, "memory_lines").select("line_id", F.concat(F.lit("Answer: "), "payload", F.lit(" end")).alias("answer"))
    read = stages.json_answers(rows, "answer", "tu_id int, part_name string", "j")
    return read.select("line_id", "j.tu_id", "j.part_name", stages.is_json(F.col("answer")).alias("whole"))


def q_unit_states(spark: SparkSession, d: str) -> DataFrame:
    """How far every record is by a log with one entry a translation, redelivered rows and all."""
    rows = table(spark, d, "paragraph_memory").select("rec_id", "written_at", "translation_a", "translation_b", "final_translation")
    entry = lambda state, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(state).alias("state"), "written_at")) if c else F.struct(F.lit(state).alias("state"), "written_at")
    log = rows.select("rec_id", F.explode(F.array_compact(F.array(entry("verified", "final_translation"), entry("pending", None), entry("translated_b", "translation_b"), entry("translated_a", "translation_a")))).alias("e"))
    now = stream_stages.current_states(log.select("rec_id", "e.state", "e.written_at"), "rec_id", "written_at")
    return now.select("rec_id", "state", stream_stages.next_state(F.col("state")).alias("next"))


def q_freeze_legacy(spark: SparkSession, d: str) -> DataFrame:
    rows = masking.frozen(records(spark, d, "source_surface"), "source_surface", profile="legacy")
    return rows.select("rec_id", F.md5("frozen").alias("frozen"), F.size("nt").alias("tokens"), F.size("spans").alias("spans"))


QUERIES: dict[str, Query] = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_CUT = r"regexp_replace(regexp_replace(x, '([.!?;:。！？；：]) ', '\1' || chr(1), 'g'), chr(1) || ' ', chr(1), 'g')"
_RECORDS = "(SELECT DISTINCT ON (rec_id) * FROM paragraph_memory)"

ORACLE: dict[str, str] = {
    "q_embedding_chunks": f"""
      WITH l AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g')) AS x FROM documents),
      p AS (SELECT doc_id, x, list_filter(list_transform(string_split({_CUT}, chr(1)), lambda y: trim(y)), lambda y: y <> '') AS ps FROM l),
      c AS (SELECT doc_id, CASE WHEN x = '' THEN [] WHEN length(x) <= 200 THEN [x] ELSE string_split(list_reduce(ps, lambda a, y:
          a || CASE WHEN length(string_split(a, chr(2))[-1]) + 1 + length(y) <= 200 THEN ' ' ELSE chr(2) END || y), chr(2)) END AS cs FROM p)
      SELECT doc_id, len(cs)::INT AS chunks, md5(array_to_string(cs, '|')) AS text FROM c
    """,
    "q_chunk_means": """
      WITH e AS (SELECT label, greatest(1, vec_id % 7) AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
      m AS (SELECT label, dim, sum(x * w) / sum(w) AS x FROM e GROUP BY 1, 2)
      SELECT label, round(sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS norm, dim::INT AS dim, round(x, 5) AS x FROM m
    """,
    "q_packings": f"""
      WITH RECURSIVE k(kind, times, less, least, most, over) AS (VALUES {", ".join(f"('{k}', {t}, {a}, {m}, {i or 2**31 - 1}, {o})" for k, (t, a, m, i, o) in chunks.PACKINGS.items())}),
      r AS (SELECT kind, most, rec_id, file_id, strlen(frozen_surface) + over AS a, greatest(least, times * coalesce(ctx_size, 0) + less) AS budget,
          row_number() OVER (PARTITION BY kind, file_id ORDER BY tu_id, rec_id) AS n
        FROM {_RECORDS} JOIN memory_files USING (file_id) LEFT JOIN model_backends ON model_a = backend_name, k),
      p AS (SELECT kind, rec_id, file_id, n, 1 AS chunk, a AS used, 1 AS items FROM r WHERE n = 1
        UNION ALL SELECT r.kind, r.rec_id, r.file_id, r.n, CASE WHEN p.used + a > budget OR items >= most THEN chunk + 1 ELSE chunk END,
          CASE WHEN p.used + a > budget OR items >= most THEN a ELSE p.used + a END, CASE WHEN p.used + a > budget OR items >= most THEN 1 ELSE items + 1 END
        FROM p JOIN r ON r.kind = p.kind AND r.file_id = p.file_id AND r.n = p.n + 1)
      SELECT kind, rec_id, chunk, used::BIGINT AS used FROM p
    """,
    "q_token_batches": f"""
      WITH RECURSIVE r AS (SELECT rec_id, file_id, length(frozen_surface) AS a, row_number() OVER (PARTITION BY file_id ORDER BY tu_id, rec_id) AS n FROM {_RECORDS}),
      p AS (SELECT rec_id, file_id, n, 1 AS batch, a AS used FROM r WHERE n = 1
        UNION ALL SELECT r.rec_id, r.file_id, r.n, CASE WHEN p.used + a > 2048 THEN batch + 1 ELSE batch END, CASE WHEN p.used + a > 2048 THEN a ELSE p.used + a END
        FROM p JOIN r ON r.file_id = p.file_id AND r.n = p.n + 1)
      SELECT rec_id, batch, used::BIGINT AS used FROM p
    """,
    "q_gaps_translated": rf"""
      WITH r AS (SELECT DISTINCT rec_id, string_split(regexp_replace(frozen_surface, '({_SENTINEL})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS ps
        FROM paragraph_memory JOIN memory_files USING (file_id))
      SELECT rec_id, md5(array_to_string(list_transform(ps, lambda x, i: CASE WHEN i % 2 = 0 OR regexp_full_match(x, '{_WS}*') THEN x
        ELSE regexp_replace(regexp_replace(regexp_replace(translate(x, 'aeiou', 'AEIOU'), '^{_WS}+|{_WS}+$', '', 'g'), '^"+|"+$', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g') END), '')) AS text FROM r
    """,
    "q_segments_translated": f"""
      SELECT rec_id, string_agg(regexp_replace(translate(seg_text, 'aeiou', 'AEIOU'), '^{_WS}+|{_WS}+$', '', 'g'), '|' ORDER BY seg_idx) AS texts
      FROM (SELECT DISTINCT ON (sent_id) * FROM memory_sentences) WHERE side = 'source' GROUP BY rec_id
    """,
    "q_key_values": f"""
      SELECT rec_id, tu_kind AS domain, 'contract of ' || tu_kind AS doc_type, nullif(para_style, '') AS target_style, NULL::VARCHAR AS summary, 'legal' AS kind FROM {_RECORDS}
    """,
    "q_json_answers": r"""
      SELECT line_id, json_extract_string(p, '$.tu_id')::INT AS tu_id, json_extract_string(p, '$.part_name') AS part_name, false AS whole
      FROM (SELECT line_id, regexp_replace(payload, '^\x{feff}+', '') AS p FROM memory_lines)
    """,
    "q_unit_states": """
      WITH s AS (SELECT rec_id, bool_or(final_translation IS NOT NULL) AS v, bool_or(translation_b IS NOT NULL) AS b, bool_or(translation_a IS NOT NULL) AS a FROM paragraph_memory GROUP BY rec_id)
      SELECT rec_id, CASE WHEN v THEN 'verified' WHEN b THEN 'translated_b' WHEN a THEN 'translated_a' ELSE 'pending' END AS state,
        CASE WHEN v THEN 'verified' WHEN b THEN 'judged' WHEN a THEN 'translated_b' ELSE 'translated_a' END AS next FROM s
    """,
}
