import base64
import os
import random
from collections import Counter, defaultdict

import pytest

from textloom.llm import p07_term_frequency as p7
from textloom.llm import p08_byte_bpe as p8
from textloom.llm import p09_packing as p9
from textloom.llm import p10_truncation as p10
from textloom.llm.queries import TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")


def test_frequency_equals_brute_force(spark):
    rng = random.Random(1)
    words = ["bond", "合同", " ", "", None, "seal", "rare"]
    rows = []
    for i in range(400):
        terms = None if rng.random() < 0.1 else [rng.choice(words[:6]) if rng.random() > 0.01 else "rare" for _ in range(rng.randint(0, 5))]
        rows.append((i, terms, ["hot"] * rng.randint(0, 2), "x"))
    df = spark.createDataFrame(rows + rows[:40], "rec_id bigint, terms array<string>, proper_nouns array<string>, term string")
    occurrences, records = Counter(), defaultdict(set)
    for i, terms, nouns, _ in rows:
        for field, items in (("terms", terms or []), ("proper_nouns", nouns)):
            for t in items:
                if t is not None and t.strip():
                    occurrences[field, t] += 1
                    records[field, t].add(i)
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in p7.term_frequency(df).collect()}
    assert got == {k: (n, len(records[k])) for k, n in occurrences.items()}
    marks = {(r["field"], r["term"]): r["mark"] for r in p7.mark_terms(df).collect()}
    assert all(m == ("rare" if len(records[k]) <= 2 else "common" if len(records[k]) > 20 else None) for k, m in marks.items())
    assert p7.mark_terms(df.limit(0)).count() == 0


@needs_ranks
def test_ids_equal_the_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=p8.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n x", "a  b   c ", "it's  we'll", "½²Ⅳ ①", "<|endoftext|>", "ab" * 400 + "合同" * 200, "don't\tstop now 　合同 终止"]
    texts += ["".join(rng.choice("ab 合同\n.,'s12é😀ก") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(1, "", [1])], "doc_id bigint, text string, ids array<int>")
    got = p8.token_ids(df, RANKS).collect()
    assert len(got) == len(texts) + 1
    assert all(r["ids"] == library.encode_ordinary(texts[r["doc_id"]] or "") for r in got)
    counts = {r["doc_id"]: r["n_tokens"] for r in p8.token_counts(df, RANKS).collect()}
    assert all(counts[i] == len(library.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert p8.token_ids(df.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("capacity", [1, 2, 10, 97, 1024])
def test_plan_places_every_item_once_within_capacity(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        sizes = Counter(rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 5)) for _ in range(rng.randint(0, 300)))
        runs, bins = p9.plan_bins(dict(sizes), capacity)
        load, placed = Counter(), Counter()
        for size, start, end, first, per_bin in runs:
            for rank in range(start, end):
                placed[size, rank] += 1
                load[first + (rank - start) // per_bin] += size
        assert set(placed.values()) <= {1} and {s: sum(k[0] == s for k in placed) for s in sizes} == dict(sizes)
        assert set(load) == set(range(bins)) and all(v <= capacity for v in load.values())
        large = sum(n for s, n in sizes.items() if 3 * s > capacity)
        assert bins <= max(large, 2 * sum(s * n for s, n in sizes.items()) / capacity + 1)


@needs_ranks
def test_packing_operator(spark):
    rng = random.Random(3)
    docs = [(i, "word " * rng.choice([0, 1, 1, 1, 5, 20, 90, 300]), "k") for i in range(400)] + [(1000, None, "k"), (None, "word " * 250, "k"), (7, "word " * 3, "k")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, bin_id string")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 100), (2, "byte_bpe_50k", 17)], "spec_id int, tokenizer string, capacity int")
    rows = p9.pack_documents(df, specs, TOKENIZERS).collect()
    sizes = Counter((r["doc_id"], r["n_tokens"]) for r in p8.token_counts(df, RANKS).collect())
    for spec, capacity in ((1, 100), (2, 17)):
        load, whole = Counter(), Counter()
        for r in rows:
            if r["spec_id"] == spec:
                load[r["bin_id"]] += r["n_tokens"]
                whole[r["doc_id"]] += r["n_tokens"]
        assert max(load.values()) <= capacity
        assert whole[None] == next(n for (d, n) in sizes if d is None) and sum(whole.values()) == sum(n * c for (_, n), c in sizes.items())
        assert len(load) <= 1.1 * sum(load.values()) / capacity + 1
    assert p9.pack_documents(df.limit(0), specs, TOKENIZERS).count() == 0
    with pytest.raises(ValueError):
        p9.pack_documents(df, spark.createDataFrame([(1, "x", None)], specs.schema), TOKENIZERS)
    with pytest.raises(ValueError):
        p9.pack_documents(df, spark.createDataFrame([(1, "byte_bpe_50k", p9.MAX_CAPACITY + 1)], specs.schema), TOKENIZERS)


@needs_ranks
def test_shards_follow_the_rows_of_a_size(spark, monkeypatch):
    monkeypatch.setattr(p9, "SHARD_ROWS", 2)
    df = spark.createDataFrame([(i, "word") for i in range(500)] + [(500 + i, "") for i in range(300)], "doc_id bigint, text string")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 10)], "spec_id int, tokenizer string, capacity int")
    load, seen = Counter(), Counter()
    for r in p9.pack_documents(df, specs, TOKENIZERS).collect():
        load[r["bin_id"]] += r["n_tokens"]
        seen[r["doc_id"]] += 1
    assert len(load) == 50 and set(load.values()) == {10} and seen == Counter(range(800))


@pytest.mark.parametrize(
    "text, kind",
    [("It ended.", "full"), ('He said, "Stop.', "open"), ("The claim ...", "open"), ("Terms ....... 12", "full"), ("It was sent to Dr.", "doubt"), ("a limit of 0.", "doubt"),
     ("It stops in the mid", "bare"), ("", "none"), ("Signed: ____", "full"), ("（见附件。", "open"), ("第12条 通知", "bare")],
)
def test_endings(text, kind):
    assert p10.ending(text)[0] == kind


def test_cut_texts_are_found(spark):
    rng = random.Random(9)
    whole = ["The seal was worn and a new one was ordered by the site manager.", "Payment falls due at the end of each month in Westerby.", "通知已发出，并抄送瓦涅达办事处。"]
    heads = ["Price and Payment", "Health and Safety", "Annex 12", "第3条 通知"]
    rows, truth = [], set()
    for i in range(1, 601):
        body = []
        for _ in range(rng.randint(2, 8)):
            body.append(rng.choice(whole) if rng.random() < 0.7 else rng.choice(heads))
        if rng.random() < 0.3:
            body.append(rng.choice(heads))
        text = "\n".join(body)
        source = rng.choice(["a", "b", None])
        if source == "a" and len(text) > 150:
            cut = text[:150]
            last = cut.rstrip().split("\n")[-1]
            if last not in whole and last not in heads:
                truth.add(i)
            text = cut
        rows.append((i, text, source, True))
    rows += [(9001, None, None, True), (9002, " \n", "a", True), (1, rows[0][1], rows[0][2], True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, cut boolean")
    judged = p10.judge_endings(df)
    found = {r["doc_id"] for r in judged.where("cut").collect()}
    assert len(found ^ truth) <= 0.02 * len(truth) + 1
    assert judged.count() == len(rows)
    limits = {(r["source"], r["measure"], r["length"]) for r in p10.length_spikes(df.selectExpr("source", "length(text) n_chars", "octet_length(text) n_bytes")).collect()}
    assert ("a", "chars", 150) in limits
    how = {r["doc_id"]: r["how"] for r in judged.where("how is not null").collect()}
    assert set(how) == found and sum(how[i] == "limit" for i in found & truth) >= 0.9 * len(truth)
    kinds = {r["source"]: (r["cut_at_limit"], r["cut_in_transfer"], r["cut"]) for r in p10.truncation_rates(df).collect()}
    assert all(a + b == c for a, b, c in kinds.values())
    rates = {r["source"]: r["cut"] for r in p10.truncation_rates(df).collect()}
    assert set(rates) == {"a", "b", None} and sum(rates.values()) == len([1 for r in judged.where("cut").collect()])
    assert p10.judge_endings(df.limit(0)).count() == 0


def test_closings_of_finite_names_hold_as_the_table_grows(spark):
    rng = random.Random(11)
    places = [a + b for a in ("West", "Oster", "Lang", "Nor") for b in ("erby", "holm", "ford", "wick")]
    months = "January February March April May June July August September October November December".split()
    rows, truth = [], set()
    for i in range(1500):
        body = ["Price and Payment", "Health and Safety", f"The seal {rng.randrange(10**6)} was worn{' and worn' * rng.randrange(60)} and a new one was ordered."]
        if i % 10:
            body.append(f"Place and date: {rng.choice(places)}, {rng.randint(1, 28)} {rng.choice(months)} {rng.randint(2000, 2025)}")
        else:
            body.append("the " + "".join(rng.choice("abcdefghij") for _ in range(9)))
            truth.add(i)
        rows.append((i, "\n".join(body), rng.choice(["a", "b", None])))
    rows.append((1500, "Notes\nPrice and Pay", "a"))
    truth.add(1500)

    def found(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        return {r["doc_id"] for r in p10.judge_endings(df).where("cut").collect()}

    assert found(rows) == truth
    few = rows[:150]
    assert found(few) == {i for i in truth if i < 150}
    assert found([(10_000 * k + i, *rest) for k in range(10) for i, *rest in few]) == {10_000 * k + i for k in range(10) for i in truth if i < 150}
