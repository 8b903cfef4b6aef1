"""Stages of a translation around the model boundary: prompts, segments with bisection, repair, notes, audit, patches.

A stage is a DataFrame with a prompt column, the model's batch call, and checks behind it; the model is whatever a
``ModelFactory`` makes, the deterministic stub by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from textloom.functions import patterns as P
from textloom.functions.issues import asks_again, hard_issues, quality_issues
from textloom.functions.language import lang_label
from textloom.functions.normalize import bound, cleaned_output, sentinel_parts
from textloom.functions.text import blank, render, rendered, trimmed
from textloom.functions.validate import SPACES, Source, is_blank, parts_of
from textloom.operators.model import ModelFactory, _made, accepted, generated, stub_model, with_answers
from textloom.operators.segments import first_json_object

HOLE = "[[MT_HOLE]]"
#: Errors about tokens earn a unit more repairs.
TOKEN_ERRORS = ("sentinel_sequence_mismatch", "control_token_", "nt_token_", "unexpected_mt_token")
REPAIRS, TOKEN_REPAIRS = 2, 6

PROMPTS = {
    "translate": "Translate from {{source}} into {{target}}. Keep every <<MT_...>> marker and every number. Text only.\n{{text}}",
    "gap": "Translate from {{source}} into {{target}}. Keep [[MT_HOLE]] where it stands and every number. Text only.\n{{text}}",
    "repair": "Mend this {{target}} translation ({{reason}}). Keep these markers in order: {{tokens}}.\nSource: {{text}}\nDraft: {{draft}}",
    "notes": "Give JSON with understanding, proper_nouns and terms for:\n{{text}}",
    "fuse": "Make one {{target}} translation out of two.\nSource: {{text}}\nA: {{a}}\nB: {{b}}",
    "audit": "List issues as JSON with tu_id and issue for:\n{{text}}",
    "patch": "Mend {{issue}} in:\n{{text}}",
    "json": "Give this again as valid JSON:\n{{text}}",
}


@dataclass(frozen=True)
class ModelLimits:
    """Sizes of a model's context and batches, brought within what it can do."""

    ctx_size: int = 0
    ctx_trained: int = 0
    batch_size: int | None = None
    ubatch_size: int | None = None

    def clamped(self) -> ModelLimits:
        ctx = self.ctx_size or max(self.ctx_trained, 4096)
        ctx = max(256, min(ctx, self.ctx_trained) if self.ctx_trained else ctx)
        batch = min(max(512 if self.batch_size is None else self.batch_size, 8), 65536)
        ubatch = min(max(batch if self.ubatch_size is None else self.ubatch_size, 1), 65536, batch)
        return ModelLimits(ctx, self.ctx_trained, batch, ubatch)


def fitted_context(head: str, context: list[str], tail: str, count: Callable[[str], int], budget: int) -> str:
    """A prompt within ``budget`` tokens: pieces of context fall away from the last on until it fits; head and tail
    always stay."""
    kept = list(context)
    while kept and count("\n".join([head, *kept, tail])) > budget:
        kept.pop()
    return "\n".join([head, *kept, tail])


def prompted(df: DataFrame, template: str, out: str, factory: ModelFactory = stub_model, name: str = "stub", **values: Column) -> DataFrame:
    """``df`` with the model's cleaned answer to a template filled with columns; null where ``text`` is null."""
    asked = F.when(values["text"].isNotNull(), render(template, **values))
    step = with_answers(df.withColumn("_prompt", asked), ["_prompt"], "_told", StringType(), _plain_answers, factory, name)
    return step.withColumn(out, F.col("_told")).drop("_prompt", "_told")


def plain_answer(answer: str, spaces: str | None = None) -> str:
    """``cleaned_output`` of one text."""
    text = answer.strip(spaces)
    if text.startswith("```"):
        text = text.partition("\n")[2] if "\n" in text else text
        text = text[: text.rindex("```")] if "```" in text else text
    return text.strip(spaces).strip('"').strip(spaces)


def _plain_answers(model: Callable[[list[str]], list[str]], rows: list[tuple]) -> list[str | None]:
    answers = iter(model(asked) if (asked := [p for (p,) in rows if p is not None]) else [])
    return [None if p is None else plain_answer(next(answers)) for (p,) in rows]


def json_answers(df: DataFrame, answer: str, schema: StructType | str, out: str, factory: ModelFactory | None = None, name: str = "json") -> DataFrame:
    """``df`` with the first JSON object of an answer, read leniently; null where there is none. With a ``factory``,
    answers without one are asked for once more."""
    step = df.withColumn("_j", first_json_object(F.col(answer)))
    if factory is not None:
        step = step.withColumn("_again", F.when(F.col("_j").isNull(), F.col(answer)))
        step = prompted(step, PROMPTS["json"], "_mended", factory, name, text=F.col("_again"))
        step = step.withColumn("_j", F.coalesce("_j", first_json_object(F.col("_mended")))).drop("_again", "_mended")
    return step.withColumn(out, F.from_json("_j", schema)).drop("_j")


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


# Names under which free text gives the facts of a document.
FACTS = {
    "domain": ("domain", "领域"),
    "doc_type": ("doc_type", "document_type", "documenttype", "type", "文档类型", "类型"),
    "target_style": ("target_style", "zh_style", "chinese_style", "english_style", "style", "风格", "写作风格"),
    "summary": ("summary", "摘要"),
}


def key_values(text: Column) -> Column:
    """Struct of domain, doc_type, target_style and summary from ``name: value`` lines, bullets and quotes aside; the
    last line of a name counts. For answers that are no JSON."""
    bare = lambda line: F.regexp_replace(trimmed(line), r"(?U)^[\-*•\s]+", "")
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R", -1), bare)
    pairs = F.transform(
        F.filter(lines, lambda x: x.contains(":")),
        lambda x: F.struct(
            F.replace(F.lower(trimmed(F.substring_index(x, ":", 1))), F.lit(" "), F.lit("_")).alias("k"),
            F.regexp_replace(trimmed(F.regexp_replace(x, "^[^:]*:", "")), "^[\"']+|[\"']+$", "").alias("v"),
        ),
    )

    def facts(own: Column) -> Column:
        value = lambda names: F.try_element_at(F.filter(own, lambda p: p["k"].isin(*names) & (p["v"] != "")), F.lit(-1))["v"]
        return F.struct(*[value(names).alias(k) for k, names in FACTS.items()])

    return bound(pairs, facts)


def document_kind(doc_type: Column, domain: Column) -> Column:
    """legal, paper, news, novel, diary or other, by words of a document's type, or its domain."""
    low = F.lower(trimmed(F.coalesce(doc_type, F.lit(""))))
    has = lambda *words: low.rlike("|".join(words))
    return (
        F.when(has("contract", "agreement", "legal", "terms") | F.lower(trimmed(F.coalesce(domain, F.lit("")))).isin("law", "legal"), "legal")
        .when(has("paper", "research", "academic", "thesis", "journal"), "paper")
        .when(has("news", "press", "report"), "news")
        .when(has("novel", "fiction", "story"), "novel")
        .when(has("diary", "journal", "blog"), "diary")
        .otherwise("other")
    )


def document_context(df: DataFrame, answer: str, target_lang: str, styles: dict[tuple[str, str], str], forced: str | None = None) -> DataFrame:
    """``df`` with ``context``: the facts in a model's answer, JSON or lines, and a style: that forced, that in the
    answer, or else that of ``styles`` for the document's kind and the target language's label."""
    facts = ", ".join(f"{k} string" for k in FACTS)
    step = json_answers(df, answer, facts, "_facts").withColumn("_lines", key_values(F.col(answer)))
    text = {k: F.coalesce(F.nullif(trimmed(F.col(f"_facts.{k}")), F.lit("")), F.when(F.col("_facts").isNull(), F.col(f"_lines.{k}"))) for k in FACTS}
    step = step.withColumns({f"_{k}": c for k, c in text.items()})
    table = F.create_map(*[x for (kind, label), s in styles.items() for x in (F.lit(f"{kind}/{label}"), F.lit(s))]) if styles else F.create_map().cast("map<string,string>")
    ruled = F.try_element_at(table, F.concat_ws("/", document_kind(F.col("_doc_type"), F.col("_domain")), lang_label(F.col(target_lang))))
    style = F.coalesce(F.nullif(trimmed(F.lit(forced or "")), F.lit("")), F.col("_target_style"), ruled)
    return step.withColumn("context", F.struct(F.col("_domain").alias("domain"), F.col("_doc_type").alias("doc_type"), style.alias("target_style"), F.col("_summary").alias("summary"))).select(*df.columns, "context")


# --- gaps between tokens -----------------------------------------------------------------------------------------


def _each(model: Callable[[list[str]], list[str]], rows: list[tuple]) -> list[list | None]:
    """The model's texts for lists of prompts, all in one call; null prompts give nulls."""
    answers = iter(model(flat) if (flat := [p for (ps,) in rows for p in ps or () if p is not None]) else [])
    return [None if ps is None else [None if p is None else next(answers) for p in ps] for (ps,) in rows]


def gaps_translated(df: DataFrame, frozen: str, source_lang: str, target_lang: str, out: str, factory: ModelFactory = stub_model, name: str = "stub") -> DataFrame:
    """``df`` with ``out``: the source with only the text between its tokens translated, so that every token stays.

    A gap shows the model where tokens adjoin it; holes and tokens in its answer are taken out. Blank gaps stay. All
    gaps of a batch are asked for in one call.
    """
    def decorated(parts: Column) -> Column:
        edge = lambda i: F.when((i >= 0) & (i < F.size(parts)) & (i % 2 == 1), HOLE).otherwise("")
        return F.transform(parts, lambda p, i: F.when((i % 2 == 0) & ~blank(p), F.concat(edge(i - 1), p, edge(i + 1))))

    own = bound(sentinel_parts(F.col(frozen)), decorated)
    source, target = lang_label(F.col(source_lang)), lang_label(F.col(target_lang))
    asked = F.transform(own, lambda g: F.when(g.isNotNull(), render(PROMPTS["gap"], source=source, target=target, text=g)))
    step = with_answers(df.withColumn("_asked", F.when(F.col(frozen).isNotNull(), asked)), ["_asked"], "_told", ArrayType(StringType()), _each, factory, name)
    clean = lambda t: trimmed(F.replace(F.regexp_replace(cleaned_output(t), P.ANY_MT, ""), F.lit(HOLE), F.lit("")))
    pieces = F.transform(F.arrays_zip(sentinel_parts(F.col(frozen)).alias("p"), F.col("_told").alias("t")), lambda x: F.when(x["t"].isNull(), x["p"]).otherwise(clean(x["t"])))
    return step.withColumn(out, F.when(F.col(frozen).isNotNull(), F.array_join(pieces, ""))).drop("_asked", "_told")


# --- segments with bisection -------------------------------------------------------------------------------------


def segments_prompt(ids: list[int], texts: list[str]) -> str:
    return "\n".join(f"<<MT_SEG:{i:06d}>>{t}<<MT_END:{i:06d}>>" for i, t in zip(ids, texts))


def read_segments(text: str, ids: list[int]) -> list[str] | None:
    """The texts between the markers of ``ids``, one after another; None if one is missing."""
    out, at = [], 0
    for i in ids:
        opened, closed = f"<<MT_SEG:{i:06d}>>", f"<<MT_END:{i:06d}>>"
        a = text.find(opened, at)
        b = text.find(closed, a + len(opened)) if a >= 0 else -1
        if b < 0:
            return None
        out.append(text[a + len(opened) : b])
        at = b + len(closed)
    return out


def bisected(chunks: list[tuple[list[int], list[str]]], model: Callable[[list[str]], list[str]]) -> list[list[str]]:
    """The model's texts for every chunk of segments. A chunk whose answer lacks a marker is asked for again in
    halves, down to single segments, whose answer is taken without its markers. Each round is one call."""
    out = [[""] * len(ids) for ids, _ in chunks]
    waiting = [(c, 0, len(ids)) for c, (ids, _) in enumerate(chunks) if ids]
    while waiting:
        answers = model([segments_prompt(chunks[c][0][a:b], chunks[c][1][a:b]) for c, a, b in waiting])
        halves = []
        for (c, a, b), answer in zip(waiting, answers):
            got = read_segments(answer, chunks[c][0][a:b])
            if got is None and b - a > 1:
                middle = a + (b - a) // 2
                halves += [(c, a, middle), (c, middle, b)]
                continue
            if got is None:
                i = chunks[c][0][a]
                got = [answer.split(f"<<MT_SEG:{i:06d}>>", 1)[-1].split(f"<<MT_END:{i:06d}>>", 1)[0]]
            out[c][a:b] = [g.strip() for g in got]
        waiting = halves
    return out


def segments_translated(chunks: DataFrame, ids: str, texts: str, out: str, factory: ModelFactory = stub_model, name: str = "stub") -> DataFrame:
    """``chunks`` with ``out``: an array of the model's text for every segment; see ``bisected``. Null chunks stay
    null, null texts are empty."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if name not in _made:
            _made[name] = factory()
        for keys, values in batches:
            there = [k is not None and v is not None for k, v in zip(keys, values)]
            own = [([int(i) for i in k], [t or "" for t in v]) for k, v, ok in zip(keys, values, there) if ok]
            done = iter(bisected(own, _made[name]))
            yield pd.Series([next(done) if ok else None for ok in there], index=keys.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return chunks.withColumn(out, F.pandas_udf(run, "array<string>")(F.col(ids), F.col(texts)))


# --- repair ------------------------------------------------------------------------------------------------------


def balance(wanted: dict[str, int], names: dict[str, str], text: str) -> str:
    """``balanced_tokens`` of one text, by how often its source has each token."""
    for token, original in sorted(names.items()):
        due, held = wanted.get(token, 0), text.count(token) if wanted.get(token) else 0
        if original and held < due:
            text = text.replace(original, token, due - held)
        elif 0 < due < held:
            text = text.replace(token, original or "", held - due)
    return text


REPAIRED = StructType([StructField(name, StringType()) for name in ("text", "error", "origin")])


def _repairs(rounds: int) -> Callable[[Callable[[list[str]], list[str]], list[tuple]], list[tuple]]:
    """Works out text, error and origin of (frozen, map, draft, languages, their labels)."""

    def work(model: Callable[[list[str]], list[str]], rows: list[tuple]) -> list[tuple]:
        units = [Source(row[0], dict(row[1] or ())) for row in rows]
        texts = [balance(unit.wanted, unit.names, row[2] or "") for unit, row in zip(units, rows)]
        errors, asked, most = [None] * len(rows), [0] * len(rows), [REPAIRS] * len(rows)
        waiting = range(len(rows))
        for turn in range(rounds + 1):
            prompts = {}
            for i in waiting:
                unit, (*_, source_lang, target_lang, _, label) = units[i], rows[i]
                errors[i] = reason = unit.error(texts[i])
                if reason is None:
                    hard, soft = unit.flags(texts[i], source_lang, target_lang)
                    if not any(map(asks_again, hard)):
                        continue
                    reason = " | ".join(hard + soft)
                elif reason.startswith(TOKEN_ERRORS):
                    most[i] = TOKEN_REPAIRS
                if turn < rounds and asked[i] < most[i]:
                    prompts[i] = rendered(PROMPTS["repair"], target=label, reason=reason, tokens=" ".join(unit.tokens), draft=texts[i], text=unit.frozen)
            if not prompts:
                break
            answers = iter(model([*prompts.values()]))
            for i in prompts:
                texts[i], asked[i] = balance(units[i].wanted, units[i].names, plain_answer(next(answers))), asked[i] + 1
            waiting = [*prompts]
        failed = [i for i, e in enumerate(errors) if e is not None and rows[i][0] is not None]
        forced = dict(zip(failed, _gap_by_gap(model, [(units[i].frozen, *rows[i][5:]) for i in failed])))
        return [
            (texts[i], None, "repair" if asked[i] else "draft") if errors[i] is None
            else (forced[i], errors[i], "gaps") if i in forced and unit.error(forced[i]) is None
            else (unit.frozen, errors[i], "source")
            for i, unit in enumerate(units)
        ]

    return work


def _gap_by_gap(model: Callable[[list[str]], list[str]], rows: list[tuple]) -> list[str]:
    """``gaps_translated`` of (frozen, labels of the languages)."""
    cut = [parts_of(frozen) for frozen, *_ in rows]
    prompts = {}
    for n, (parts, (_, source, target)) in enumerate(zip(cut, rows)):
        for i in range(0, len(parts), 2):
            if not is_blank(parts[i]):
                gap = (HOLE if i else "") + parts[i] + (HOLE if i + 1 < len(parts) else "")
                prompts[n, i] = rendered(PROMPTS["gap"], source=source, target=target, text=gap)
    answers = iter(model([*prompts.values()]) if prompts else [])
    for n, i in prompts:
        if (told := next(answers)) is not None:
            cut[n][i] = re.sub(P.ANY_MT, "", plain_answer(told, SPACES)).replace(HOLE, "").strip(SPACES)
    return ["".join(parts) for parts in cut]


def repaired(
    df: DataFrame, frozen: str, nt_map: str, draft: str, source_lang: str, target_lang: str, out: str, factory: ModelFactory = stub_model, name: str = "stub", rounds: int = TOKEN_REPAIRS
) -> DataFrame:
    """``df`` with ``out``, ``out_error`` and ``out_from``: a draft repaired until it passes.

    Tokens are balanced, then the text validated and its flags worked out. A unit that fails is asked for again, at
    most twice, or six times while its errors are about tokens. What still fails is translated gap by gap, and if
    that fails too, the source stands. All of it is one pass over Arrow batches, and each round
    asks for the units of a batch that still fail, in one call.
    """
    labels = {"_from": lang_label(F.col(source_lang)), "_to": lang_label(F.col(target_lang))}
    step = with_answers(df.withColumns(labels), [frozen, nt_map, draft, source_lang, target_lang, *labels], "_done", REPAIRED, _repairs(rounds), factory, name)
    return step.select(*df.columns, F.col("_done.text").alias(out), F.col("_done.error").alias(f"{out}_error"), F.col("_done.origin").alias(f"{out}_from"))


def agent_ladder(df: DataFrame, instructed: str, direct: str, draft: str, source: str, nt_map: str, source_lang: str, target_lang: str) -> DataFrame:
    """``df`` with ``text`` and ``text_from``: the retry by instruction if it has no hard issue, else the direct
    translation, else the draft that was there."""
    step = quality_issues(df, source, nt_map, instructed, source_lang, target_lang, "_issues")
    good = F.col(instructed).isNotNull() & (F.size(hard_issues(F.col("_issues"))) == 0)
    best = F.when(good, F.struct(F.col(instructed).alias("t"), F.lit("instruction").alias("f"))).when(
        F.col(direct).isNotNull(), F.struct(F.col(direct).alias("t"), F.lit("direct").alias("f"))
    ).otherwise(F.struct(F.col(draft).alias("t"), F.lit("draft").alias("f")))
    return step.withColumn("_best", best).select(*df.columns, F.col("_best.t").alias("text"), F.col("_best.f").alias("text_from"))


# --- whole passes ------------------------------------------------------------------------------------------------

NOTES = "understanding string, proper_nouns array<string>, terms array<string>"


def noted(df: DataFrame, text: str, factory: ModelFactory = stub_model, name: str = "stub") -> DataFrame:
    """``df`` with ``notes``: understanding, proper nouns and terms of a paragraph, empty where the answer has none."""
    step = prompted(df, PROMPTS["notes"], "_answer", factory, name, text=F.col(text))
    step = json_answers(step, "_answer", NOTES, "_n")
    none = F.array().cast("array<string>")
    notes = F.struct(F.col("_n.understanding").alias("understanding"), F.coalesce("_n.proper_nouns", none).alias("proper_nouns"), F.coalesce("_n.terms", none).alias("terms"))
    return step.withColumn("notes", notes).drop("_answer", "_n")


def fused(df: DataFrame, frozen: str, nt_map: str, a: str, b: str, target_lang: str, factory: ModelFactory = stub_model, name: str = "stub") -> DataFrame:
    """``df`` with ``fused`` and ``fused_from``: one translation out of two where it passes validation, else A, else
    the source. Without B, A stands."""
    both = F.when(F.col(b).isNotNull() & F.col(a).isNotNull(), F.col(frozen))
    step = prompted(df, PROMPTS["fuse"], "_fused", factory, name, text=both, a=F.col(a), b=F.col(b), target=lang_label(F.col(target_lang)))
    return accepted(step, frozen, nt_map, ["_fused", a], "fused").drop("_fused")


def audited(df: DataFrame, unit: str, text: str, factory: ModelFactory = stub_model, name: str = "stub") -> DataFrame:
    """(unit, issue) that the model reports for chunks of text; several a chunk."""
    step = prompted(df, PROMPTS["audit"], "_answer", factory, name, text=F.col(text))
    step = json_answers(step, "_answer", f"issues array<struct<{unit}:bigint,issue:string>>", "_i")
    return step.select(F.explode("_i.issues").alias("i")).select(F.col(f"i.{unit}").alias(unit), F.col("i.issue").alias("issue")).where(F.col(unit).isNotNull())


def translate_documents(units: DataFrame, source_lang: str, target_lang: str, factory: ModelFactory = stub_model, name: str = "stub") -> DataFrame:
    """The whole deterministic pass over units (frozen, nt_map and the languages): translated, repaired, unfrozen."""
    from textloom.functions.masking import unfreeze

    step = generated(units, "frozen", "_draft", factory, name)
    step = repaired(step, "frozen", "nt_map", "_draft", source_lang, target_lang, "translated", factory, name)
    return step.withColumn("final", unfreeze(F.col("translated"), F.col("nt_map"))).drop("_draft")


def report(rows: DataFrame, code: str) -> str:
    """Counts of a code column as one JSON line, for logs; a report's size is that of its codes."""
    counts = {r[code]: r["count"] for r in rows.groupBy(code).count().orderBy(code).limit(1000).collect()}
    return json.dumps(counts, ensure_ascii=False, sort_keys=True, default=str)
