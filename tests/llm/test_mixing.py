"""Mixing: targets against a plain restatement, fitted budgets against brute force, whole documents."""
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from replenish.llm import mixing as M

ROW = "doc_id long, text string, source string"


def plain_targets(words):
    """Shares by weight, the excess over twice a source's words shared again, until none is above."""
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, stopped = 1.5 * sum(words.values()), set()
    while True:
        rest = budget - sum(2 * words[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        share = {s: 2 * words[s] if s in stopped else rest * weight[s] / free for s in names}
        above = {s for s in names if share[s] > 2 * words[s]}
        if not above:
            return share
        stopped |= above


def rows_of(rng):
    rows = [(i, " \n".join(["w"] * rng.choice([0, 1, 3, 40, rng.randrange(1, 400)])), rng.choice("abcdefg")) for i in range(600)]
    rows += [(600 + i, "k " * 50, "hot") for i in range(900)]  # one size in one source
    rows += [(None, "x y", None), (None, "x y", None), (5, rows[5][1], rows[5][2]), (2000, None, "a"), (2001, "only", "z"), (2002, "", ""), (2003, "\t", "quiet"), (2004, "b " * 70_000, "a")]
    return rows


@pytest.mark.parametrize("bucket", [M.BUCKET, 20])
def test_mix(spark, bucket):
    rows = rows_of(random.Random(6))
    df = spark.createDataFrame(rows, ROW).withColumns({c: F.lit(9) for c in ("size", "key", "name", "place", "part", "n", "take")})
    got = M.mix(df.repartition(7), bucket=bucket).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(((i, s, size(t)) for i, t, s in rows), key=str)
    words: dict = {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + size(t)
    want = plain_targets(words)
    taken: dict = dict.fromkeys(words, 0)
    for r in got:
        assert r.source_size == words[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in words:
        smallest = min((size(t) for _, t, x in rows if x == s and size(t)), default=0)
        assert abs(taken[s] - want[s]) <= max(smallest, 1), (s, taken[s], want[s])
    # the same rows dealt out in another way give the same mix
    again = M.mix(df.repartition(3), bucket=bucket).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_seed_changes_the_choice(spark):
    df = spark.createDataFrame([(i, "w " * 20, "abc"[i % 3]) for i in range(600)], ROW)
    a, b = ({r.doc_id for r in M.mix(df, seed=s).collect() if r.taken > r.size} for s in (1, 2))
    assert len(a) == len(b) > 0 and a != b


def test_fit_is_nearest():
    rng = random.Random(3)
    for _ in range(200):
        sizes = sorted({rng.randrange(1, 60) for _ in range(rng.randrange(1, 5))}, reverse=True)
        counts = [rng.randrange(1, 4) for _ in sizes]
        rest = rng.randrange(0, sum(s * c for s, c in zip(sizes, counts)) + 1)
        got = M.fit(np.array(sizes), np.array(counts), rest)
        assert (got >= 0).all() and (got <= counts).all()
        best = min(abs(sum(s * x for s, x in zip(sizes, take)) - rest) for take in itertools.product(*[range(c + 1) for c in counts]))
        assert abs(int((got * sizes).sum()) - rest) == best


def test_large_budget_is_exact(monkeypatch):
    rng = np.random.default_rng(2)
    size = np.sort(rng.choice(np.arange(1, 30_000), 4000, False))[::-1]
    count = rng.integers(1, 500, 4000)
    for budget in (0, 10 ** 6, int((size * count).sum()) // 3, int((size * count).sum())):
        got = M.fit(size, count, budget)
        assert (got >= 0).all() and (got <= count).all() and int((got * size).sum()) == budget
    # few, long documents beyond the table of sums
    monkeypatch.setattr(M, "SUMS", 1000)
    got = M.fit(np.array([5000, 700, 30]), np.array([3, 9, 9]), 9000)
    assert abs(int((got * [5000, 700, 30]).sum()) - 9000) <= 700


def test_empty_and_wordless_tables(spark):
    assert M.mix(spark.createDataFrame([], ROW)).collect() == []
    rows = M.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], ROW)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
