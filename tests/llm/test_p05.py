import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import p05_alignment as p5


def test_tables_come_from_all_pairs_of_both_sides(spark):
    ids = spark.range(1, 5301).withColumnRenamed("id", "rec_id")
    late = {r["rec_id"] for r in ids.orderBy(F.xxhash64("rec_id"), "rec_id").collect()[5000:]}
    rows, truth = [], set()
    for i in range(1, 5301):
        own = ["Spare seals.", "密封。"] if i in late else ["Notice.", "通知。", "anzeige."] if i % 50 == 0 else ["The bond remains valid.", "保函仍然有效。"]
        rows += [(4 * i + k, i, side, 0, text, "") for k, (side, text) in enumerate(zip(("source", "a", "b"), own))]
        truth |= {(4 * i, 4 * i + k) for k in range(1, len(own))}
    df = spark.createDataFrame(rows, "sent_id bigint, rec_id bigint, side string, seg_idx int, seg_text string, suffix string")
    assert {tuple(r) for r in p5.align_segments(df).collect()} == truth


def test_tables_equal_a_plain_loop(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(rng.sample("abcdefgh", rng.randint(0, 5)), rng.sample("tuvwxyz", rng.randint(0, 5))) for _ in range(300)]
    pairs = [(["w:" + u for u in s], ["w:" + u for u in t]) for s, t in pairs]
    expected = {}
    for way in (pairs, [(t, s) for s, t in pairs]):
        p = Counter({(u, t): 1.0 for s, ts in way for u in ["", *s] for t in ts})
        for _ in range(5):
            counts, total = Counter(), Counter()
            for s, ts in way:
                for t in ts:
                    norm = sum(p[u, t] for u in ["", *s])
                    for u in ["", *s]:
                        counts[u, t] += p[u, t] / norm
                        total[u] += p[u, t] / norm
            p = Counter({(u, t): c / total[u] for (u, t), c in counts.items()})
        for u in {u for u, _ in p} - {""}:
            best = max(v for (x, _), v in p.items() if x == u)
            expected[u] = {t: v / best for (x, t), v in p.items() if x == u and v >= p5.LEAST_P}
    df = spark.createDataFrame([(" ".join(s), " ".join(t)) for s, t in pairs], "one string, other string").repartition(3)
    for dense in (p5.DENSE, 20):  # a few blocks, and one for each target unit
        monkeypatch.setattr(p5, "DENSE", dense)
        tables = p5.learn_tables(df)
        assert {u: {t: round(v, 6) for t, v in ts} for u, ts in tables.forward.items()} == {u: {t: round(v, 6) for t, v in ts.items()} for u, ts in expected.items()}
        assert set(tables.weight) == set(expected)


def test_cells_are_the_same_in_slices_and_on_disk(monkeypatch):
    rng = np.random.default_rng(9)
    sources = [np.concatenate(([0], rng.permutation(30)[:n] + 1)) for n in rng.integers(0, 20, 200)]
    targets = [rng.permutation(30)[:n] + 1 for n in rng.integers(0, 20, 200)]
    totals = [rng.random(31) + 1]
    whole = [p5._expected(iter([payload]), 11, 31, totals) for _, payload in p5._chunk(sources, targets, 3)]
    monkeypatch.setattr(p5, "SLICE", 50)
    monkeypatch.setattr(p5, "IN_MEMORY", 1000)
    parts = [dict(p5._chunk(sources[a:b], targets[a:b], 3)) for a, b in ((0, 90), (90, 200))]
    for block, counts in enumerate(whole):
        assert np.allclose(p5._expected((x[block] for x in parts), 11, 31, totals), counts)
    assert np.isclose(sum(c.sum() for c in whole), sum(map(len, targets)))
