"""Packing: every part once, no bin over its length, downsized, near the least cost."""
import random

import numpy as np
from pyspark.sql import functions as F

from replenish.llm import packing as K


def test_table(spark, make_docs):
    rng = random.Random(8)
    words = [0, 0, 1, 5, 511, 512, 8191, 8192, 30_000, *[rng.choice([rng.randrange(1, 300), rng.randrange(1, 5000)]) for _ in range(400)]]
    texts = ["\u00e9 \n\t" * n for n in words]
    texts[1] = None
    rows = [*enumerate(texts), (None, "null id"), (3, texts[3])]
    df = make_docs(rows).withColumns({"size": F.lit("x"), "row": F.lit(1), "shard": F.lit(2)})
    for shard in (K.SHARD, 100):
        bins = K.best_fit(df, shard=shard).collect()
        assert len({b.bin_id for b in bins}) == len(bins)
        for b in bins:
            assert b.used == sum(b.sizes) <= b.length and b.length == min(n for n in K.LENGTHS if n >= b.used)
            assert len(b.doc_ids) == len(b.parts) == len(b.starts) == len(b.sizes) == b.n_parts
        got = sorted(((i, p, s, n) for b in bins for i, p, s, n in zip(b.doc_ids, b.parts, b.starts, b.sizes)), key=str)
        want = []
        for i, t in rows:
            n = len((t or "").split()) + 1
            want += [(i, p, p * 8192, min(8192, n - p * 8192)) for p in range(-(-n // 8192))]
        assert got == sorted(want, key=str)
        if shard == K.SHARD:
            assert sum(b.used for b in bins) > 0.97 * sum(b.length for b in bins)


def test_best_fit_takes_the_least_room():
    where, used = K.pack_with([60, 50, 40, 38, 30, 10], [100], 100)
    assert where == [0, 1, 0, 1, 2, 1] and used == [100, 98, 30]


def least(sizes, lengths):
    """Least cost over all ways to share out a few parts."""
    best = [np.inf]

    def place(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(K.cost(min(n for n in lengths if n >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= lengths[-1]:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1:]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def test_cost_is_near_the_least():
    rng = random.Random(2)
    for _ in range(60):
        sizes = np.array([rng.randrange(1, 1000) for _ in range(7)])
        where, fitted, held = K.pack(sizes, (256, 512, 1024))
        assert np.bincount(where, sizes).astype(int).tolist() == held.tolist()
        assert K.cost(fitted).sum() <= 1.35 * least(sizes.tolist(), [256, 512, 1024])


def bins_of(df):
    return sorted((b.bin_id, b.length, b.doc_ids, b.parts, b.starts, b.sizes) for b in K.best_fit(df, shard=100).collect())


def test_bins_follow_from_the_rows_alone(make_docs):
    rng = random.Random(4)
    rows = [(i // 2, "w " * rng.choice([7, 300, 9000, rng.randrange(1, 4000)])) for i in range(300)] + [(5, "w " * 7)] * 40
    rng.shuffle(rows)
    df = make_docs(rows)
    assert bins_of(df) == bins_of(df.repartition(7)) == bins_of(make_docs(rows[::-1]).coalesce(1))


def test_many_equal_rows_and_wide_ids(spark, make_docs):
    big = 2 ** 60 + 1
    df = make_docs([(big, "a b"), (None, "c")]).select("doc_id", "text").unionByName(spark.range(25_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x y").alias("text")))
    bins = K.best_fit(df).collect()
    ids = [i for b in bins for i in b.doc_ids]
    assert len(ids) == 25_002 and ids.count(big) == 1 and ids.count(None) == 25_001
    assert sum(b.used for b in bins) == 3 + 2 + 3 * 25_000


def test_lengths_are_chosen_bin_by_bin():
    lengths = [256, 512, 1024]
    # a full bin of 1024, then two full ones of 512, then one of 256: no single opening length packs all without waste
    sizes = np.array([1000, 24, *[300, 212] * 2, 250, 6])
    where, fitted, held = K.pack(sizes, lengths)
    assert sorted(held.tolist()) == sorted(fitted.tolist()) == [256, 512, 512, 1024]
    # never dearer than any plain rule
    rng = random.Random(9)
    for _ in range(40):
        sizes = np.array(sorted((rng.randrange(1, 1025) for _ in range(60)), reverse=True))
        _, fitted, _ = K.pack(sizes, lengths)
        for opening in (None, 0, *lengths):
            used = K.pack_with(sizes.tolist(), lengths, opening)[1]
            plain = sum(K.cost(min(n for n in lengths if n >= u)) for u in used)
            assert K.cost(fitted).sum() <= plain + 1e-9


def test_empty_table(make_docs):
    assert K.best_fit(make_docs([])).collect() == []
