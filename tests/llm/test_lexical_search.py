"""Ranked lexical search against brute force."""
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from replenish.llm import lexical_search as L
from replenish.llm.oracles import ORACLES


def brute(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    rows = [(i, Counter(t)) for i, t in ((i, split(t)) for i, t in docs) if t]
    n_docs, total = len(rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in rows:
            m = 100 - 75 + (75 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    words = [f"W{i}" for i in range(300)] + ["été", "ÉTÉ", "a-b", "x_y", "\U0001f600"]
    text = lambda n: " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 40, 300]))) for i in range(400)]
    docs += [(1000 + i, docs[7][1] + " zebra") for i in range(90)]  # copies: ties beyond k
    docs += [(None, docs[7][1] + " zebra"), (3, docs[3][1]), (3, docs[3][1]), (500, None), (501, ""), (502, "..."), (503, "long " * 30_000 + text(20_000))]
    items = [(i, text(rng.choice([1, 8, 30]))) for i in range(40)]
    items += [(77, "zebra zebra " + docs[7][1]), (77, "zebra"), (None, "W1 w1 W2"), (90, None), (91, ""), (92, "unknownword"), (93, "w5 ÉTÉ")]
    return docs, items


@pytest.mark.parametrize("block_terms, bucket", [(L.BLOCK_TERMS, L.BUCKET), (100, 7)])
def test_against_brute_force(spark, monkeypatch, block_terms, bucket):
    docs, items = corpus()
    monkeypatch.setattr(L, "BUCKET", bucket)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("item", "term", "terms", "length", "n", "score", "rank")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("item", "term", "count", "doc_id")})
    got = sorted((tuple(r) for r in L.search(d.repartition(5), q, block_terms=block_terms).collect()), key=str)
    assert got == brute(docs, items)


def test_long_texts_in_pieces(monkeypatch):
    text = ("Abé c-d " * 50 + "x" * 99).encode()
    whole = L.term_counts(text)
    monkeypatch.setattr(L, "PIECE", 10)
    assert L.term_counts(text) == whole and whole[b"ab\xc3\xa9"] == 50


def test_bounds_prune_and_keep_the_best(spark):
    """Survivors of a bound hold every document that reaches it, and not all documents."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    weights = rng.integers(1, 9000, 60)
    roots = np.sqrt(weights.astype(float))
    terms = [np.sort(rng.choice(60, rng.integers(1, 20), False)) for _ in range(500)]
    impacts = [rng.integers(1, 600_000, len(t)) for t in terms]
    length = np.array([np.sqrt((weights[t] * i.astype(float) ** 2).sum()) for t, i in zip(terms, impacts)])
    order = np.argsort(-length)
    batch = pa.RecordBatch.from_arrays([pa.array(order), pa.array(length[order]), pa.array([terms[i] for i in order], pa.list_(pa.int32())),
                                        pa.array([impacts[i] for i in order], pa.list_(pa.int64()))], ["doc_id", "length", "terms", "impacts"])
    bucket, kept = L.Bucket(batch, roots), []
    for _ in range(30):
        item = L.Item(rng.choice(60, 8, False), rng.integers(1, 3, 8), weights, roots)
        dense = np.zeros(60, np.int64)
        dense[item.terms] = item.weights
        exact = bucket.scores(np.arange(500), dense)
        assert exact.tolist() == [int((dense[terms[i]] * impacts[i]).sum()) for i in order]
        bound = int(np.sort(exact)[-10])
        rows = bucket.survivors(item, bound)
        assert set(np.flatnonzero(exact >= bound)) <= set(rows)
        kept.append(len(rows))
    assert np.mean(kept) < 300


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.search(docs, items).collect() == []
    assert L.search(items.toDF("doc_id", "text"), docs.toDF("item_id", "text")).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert L.search(nothing, items).collect() == []
    assert L.search(items.toDF("doc_id", "text"), nothing.toDF("item_id", "text")).collect() == []


def test_sql_on_planted_rows():
    import pandas as pd

    docs, items = corpus()
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.register(name, pd.DataFrame(rows, columns=[key, "text"]).astype({key: "Int64"}))
    got = con.sql(ORACLES["op11_lexical_search"]).fetchall()
    assert sorted(((a, b, c, d) for a, b, c, d in got), key=str) == brute(docs, items)
