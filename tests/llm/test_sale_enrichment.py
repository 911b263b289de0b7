"""Valid-time enrichment against a plain simulation of its rules, batch by batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

pytest.importorskip("draftmetrics.llm")

from draftmetrics.llm import sale_enrichment as se

SALES = "sale_id long, client_id long, sold_at timestamp_ntz, b long, id string"
CHANGES = "change_id long, client_id long, valid_at timestamp_ntz, op string, balance double, b long, grp string"
START = datetime(2024, 1, 1)


def simulated(sales, changes, batches):
    """The contract's rules, one step after the other."""
    versions, waiting, out = {}, [], []
    changes = list({tuple(c): c for c in changes if c[2] is not None}.values())
    for k in range(batches + 1):
        sold = [s[2] for s in sales if s[3] < k and s[2] is not None]
        valid = [c[2] for c in changes if c[5] < k]
        h = min(max(sold), max(valid)) if sold and valid else None
        for c in changes:
            if c[5] == k and valid and c[2] < max(valid):
                out.append(("late", c[0], k, None, None, None, None))
            elif c[5] == k and c[1] is not None:
                versions.setdefault(c[1], []).append(c)
        for held in versions.values():
            held.sort(key=lambda c: (c[2], c[0]))
        waiting += [s for s in sales if s[3] == k]
        later = []
        for s in waiting:
            if k < batches and s[2] is not None and (h is None or s[2] >= h):
                later.append(s)
                continue
            held = versions.get(s[1], [])
            hits = [c for c in held if s[2] is not None and c[2] <= s[2]]
            hit = hits[-1] if hits else None
            out.append(("sale", s[0], k, len(held), hit and hit[0], hit and (None if hit[4] is None else int(100 * hit[4] + 0.5 // 1)), hit and hit[3]))
        waiting = later
        for client, held in versions.items():
            passed = [c for c in held if h is not None and c[2] <= h]
            versions[client] = passed[-1:] + held[len(passed) :]
    return out


def invented(seed, n_sales, n_changes, batches, clients, steps=400):
    rng = random.Random(seed)
    at = lambda b: START + timedelta(hours=max(0, min(steps, int(steps * (b + rng.random()) / batches) - rng.choice([0, 0, 0, 5, 60]))), microseconds=rng.choice([0, 0, 1, 999]))
    who = lambda: rng.choice([0] * clients + list(range(clients)))
    empty = rng.randrange(batches)  # a batch without rows
    draw = lambda: rng.choice([b for b in range(batches) if b != empty])
    sales = []
    for k in range(n_sales):
        b = draw()
        sales.append((k, None if rng.random() < 0.03 else who(), None if rng.random() < 0.03 else at(b), b, "x"))
    changes = []
    for k in range(n_changes):
        b = draw()
        changes.append((k, who(), None if rng.random() < 0.03 else at(b), rng.choice(["I", "U", "D", None]), float(k), b, "g"))
    return sales + sales[:2], changes + changes[:5]


def result(spark, sales, changes, batches, **more):
    s, c = spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES)
    return [tuple(r) for r in se.enrich_sales(s, c, F.col("b"), F.col("b"), batches, **more).collect()]


def same(a, b):
    key = lambda r: [(v is None, str(v)) for v in r]
    return sorted(a, key=key) == sorted(b, key=key)


@pytest.mark.parametrize("seed,hot", [(0, False), (1, True), (2, True)])
def test_against_a_simulation(spark, seed, hot):
    """With and without clients that are cut into slices of time."""
    sales, changes = invented(seed, 300, 260, 5, 6)
    more = {"hot_share": 1 / 50, "hot_rows": 10, "group_rows": 50} if hot else {}
    got = result(spark, sales, changes, 5, **more)
    assert same(got, simulated(sales, changes, 5))
    assert len(got) > len(sales)


def test_edges(spark):
    t = lambda h: START + timedelta(hours=h)
    assert result(spark, [], [], 2) == []
    # no change at all: H stays at minus infinity, so sales wait for the end; a negative batch counts as 0
    assert same(result(spark, [(1, 5, t(1), -3, "x"), (2, 5, None, 0, "x"), (None, None, t(3), 1, None)], [], 2), [("sale", 1, 2, 0, None, None, None), ("sale", 2, 0, 0, None, None, None), ("sale", None, 2, 0, None, None, None)])
    # equal times: the larger id is the last; a null id comes first; null and infinite balances give no cents
    changes = [(3, 5, t(1), "a", None, 0, "g"), (4, 5, t(1), "b", float("inf"), 0, "g"), (None, 5, t(1), None, 7.0, 0, "g"), (9, None, t(1), "n", 1.0, 0, "g")]
    assert same(result(spark, [(1, 5, t(1), 0, "x")], changes, 1), [("sale", 1, 1, 3, 4, None, "b")])
    assert same(result(spark, [(1, 5, t(1), 0, "x")], changes[2:], 1), [("sale", 1, 1, 1, None, 700, None)])


def test_settings_of_the_session_come_back(spark):
    before = {k: spark.conf.get(k) for k in se._STREAMING}
    result(spark, [(1, 5, START, 0, "x")], [], 1)
    assert {k: spark.conf.get(k) for k in se._STREAMING} == before
