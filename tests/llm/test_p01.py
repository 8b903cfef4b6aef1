"""The cutoffs of problem 1, chosen on one planted set and held to on another."""

import random

import pytest

from tests.llm.test_pairs_and_sentences import EN, FILES, PLANTED, ZH, memory
from textloom.llm import p01_pair_defects as p1

GRID = [k / 20 for k in range(1, 20)]
#: Sound sides that some functions vote against: short ones, labels, a decline that is the text's own.
SOUND = [("Notices.", "通知。"), ("Annex 12", "附件12"), ("The bank declined.", "我行无法提供该文本。"), ("Parts and tools", "零件和工具")]


def planted(spark, seed, n=700):
    """Posteriors by (rec_id, defect), and the defect planted in each record; every third source is a hard one."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(1, n + 1):
        x, y = rng.randint(100, 999), rng.randint(11, 99)
        source, good = EN.format(x, y), ZH.format(x, y)
        kind = rng.choice([None] * 6 + list(p1.DEFECTS))
        if kind is None and i % 3 == 0:
            source, good = rng.choice(SOUND)
        side = good
        if kind in PLANTED:
            side = rng.choice(PLANTED[kind])
        elif kind == "copy":
            side = rng.choice([source, "译文：" + source, source.upper(), source[:-1]])
        elif kind == "truncated":
            side = good[: rng.randint(8, len(good) - 2)].rstrip("。")
        if kind:
            truth[i] = kind
        rows.append((i, 1, source, side, None))
    files = spark.createDataFrame([(1, "P", "zh", "m", None)], FILES)
    return {(r["rec_id"], r["defect"]): r["posterior"] for r in p1.pair_labels(memory(spark, rows), files).collect()}, truth


def f1(posteriors, truth, defect, cutoff):
    found = {i for (i, d), q in posteriors.items() if d == defect and q > cutoff}
    own = {i for i, d in truth.items() if d == defect}
    # A side keeps several labels: one that another defect's side bears as well is no error of the cutoff.
    wrong = {i for i in found - own if i not in truth}
    return 2 * len(found & own) / (len(found & own) + len(wrong) + len(own))


@pytest.fixture(scope="module")
def sets(spark):
    kept = dict(p1.CUTOFFS)
    p1.CUTOFFS.update(dict.fromkeys(kept, 0.0))
    try:
        return planted(spark, 21), planted(spark, 22)
    finally:
        p1.CUTOFFS.update(kept)


@pytest.mark.parametrize("defect", p1.DEFECTS)
def test_cutoff_is_among_the_best_on_both_sets(sets, defect):
    chosen, held = ({c: f1(*s, defect, c) for c in GRID} for s in sets)
    own = p1.CUTOFFS[defect]
    print(defect, *(f"{c}:{chosen[c]:.3f}/{held[c]:.3f}" for c in GRID))
    assert chosen[own] >= max(chosen.values()) - 0.005
    assert held[own] >= max(held.values()) - 0.01 and held[own] >= 0.95
