"""Hard negatives against all exact scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("draftmetrics.llm")

from draftmetrics.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string"


def brute(rows, k_pos=5, k_neg=10):
    clean = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        clean[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for a, la, va in clean:
        if a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(va, vb)), b, lb) for b, lb, vb in clean if b != a and len(vb) == len(va)]
        for p_score, p, _ in sorted(s for s in scores if s[2] == la)[:k_pos]:
            inside = sorted(s for s in scores if s[2] != la and 30 * -p_score <= 100 * -s[0] <= 90 * -p_score)
            out += [(a, p, r + 1, n, -p_score, -s) for r, (s, n, _) in enumerate(inside[:k_neg])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.mine(df, F.col("id") % 100 == 0, label, **more).collect())


def vectors(seed, n, dim, labels, common=0.0, coarse=False):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(labels, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = base[label] + rng.normal(size=dim)
        v = np.round(v * 2) / 2 if coarse else v / np.linalg.norm(v)
        if rng.random() < common:
            v, label = np.ones(dim) / 4, int(rng.integers(2))
        rows.append((i, [float(np.float32(x)) for x in v], label))
    return rows


@pytest.mark.parametrize("seed,common,coarse", [(0, 0.0, False), (1, 0.4, False), (2, 0.2, True)])
def test_against_all_scores(spark, seed, common, coarse):
    """Few labels, ties, and a vector that many rows share; packs and blocks smaller than the table."""
    rows = vectors(seed, 700, 8, 4, common, coarse)
    want = brute(rows)
    assert want and mined(spark, rows, pack=64, block=3, n_cells=8, share=2) == want


def test_broken_and_repeated_rows(spark):
    rows = vectors(3, 260, 4, 3)
    rows += [(None, [1.0] * 4, 1), (300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [float("nan"), 0.0, 0.0, 0.0], 1), (303, [float("inf"), 0.0, 0.0, 0.0], 1), (304, [0.5] * 4, None)]
    rows += [(400, [0.5, 0.25], 1), (401, [0.5, 0.5], 1), (402, [0.25, 0.25], 2), (500, [], 1), (501, [], 1), (502, [], 2), rows[5], rows[5], (200, [0.1] * 4, 2)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    # one label alone has no negatives, one row alone no positives
    assert mined(spark, [(100, [1.0], 1), (101, [1.0], 1)]) == mined(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []
    assert mined(spark, [(100, [1.0], 1), (101, [-1.0], 1), (102, [0.0], 2)]) == []  # a negative positive score has an empty window
    assert mined(spark, [(100, [1.0], 1), (101, [0.0], 1), (102, [0.0], 2)]) == [(100, 101, 1, 102, 0, 0)]


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.uniform(1e6, 2e6))) for _ in range(3)], rng.randrange(3)) for i in range(220)]
    assert mined(spark, rows) == brute(rows)


def test_cells_hold_their_values_and_bounds_hold_all_scores():
    v = np.array([x for _, x, _ in vectors(4, 500, 16, 3)])
    v = np.floor(v * 256).astype(np.int64)
    codes, low, high = hn.cells(v, 32)
    at = np.arange(16)
    assert (low[at, codes] <= v).all() and (v <= high[at, codes]).all() and codes.max() > 20
    row = {"dim": 16, "ids": np.arange(500).astype("<i8").tobytes(), "labels": np.zeros(500, "<i8").tobytes(), "codes": codes.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "kind": "<i8", "vectors": v.tobytes()}
    pack = hn._Pack(row)
    block = hn._Block([{"id": 1000 + i, "label": 0, "v": v[i].tolist()} for i in range(20)])
    lower, upper = pack.bounds(block)
    exact = v[:20] @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()
    # few of 10,000 candidates are scored exactly
    assert hn.near_rows(block, pack, 5) < 1500
