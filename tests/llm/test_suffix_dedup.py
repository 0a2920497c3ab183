"""Suffix-array dedup against brute force over all windows."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from replenish.llm import suffix_dedup as S


def brute(rows, span=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                gone[i:i + span] = True
        spans = int((gone[:len(t)] & ~np.concatenate(([False], gone[:len(t)]))[:len(t)]).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:len(t)]]) if t else b""
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, span=200):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeat_digests(df, span).collect()), key=str)


def tricky(rng):
    """Passages in many surroundings, periodic texts, copies, nested and overlapping repeats."""
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (30, 45, 60, 90, 200)]
    out = []
    for _ in range(60):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2) if rng.random() < .5 else 0
            parts += [p[a:a + rng.randrange(150, 500)], text(rng.randrange(0, 30))]
        out.append("".join(parts))
    out += ["a" * 700, "a" * 350, "ab" * 300, "b" * 199, "b" * 199, "c" * 200, "c" * 200, "d" * 201, "", None, out[0], out[0], text(3), "é" * 150 + "x"]
    return out


def test_table_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("most", [100_000, 5])
def test_tricky_texts(make_docs, monkeypatch, most):
    """With ``most`` = 5 large groups of contexts are split along their references."""
    monkeypatch.setattr(S.repeat_spans, "__defaults__", (S.SPAN, S.SEED, most))
    texts = tricky(random.Random(11))
    rows = [*enumerate(texts), (None, texts[5]), (3, texts[3]), (4, "same id, other text")]
    df = make_docs(rows).withColumns({"digest": F.lit("x"), "spans": F.lit(1), "n": F.lit(2)})
    assert run(df) == brute(rows)


@pytest.mark.parametrize("most", [100_000, 7])
def test_many_near_copies(make_docs, monkeypatch, most):
    """One text copied with edits: every anchor's group is large, and repeats end at different places."""
    monkeypatch.setattr(S.repeat_spans, "__defaults__", (S.SPAN, S.SEED, most))
    rng = random.Random(21)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    texts = []
    for _ in range(60):
        t = list(base)
        for at in rng.sample(range(1500), rng.choice([0, 2, 6, 12])):
            t[at] = rng.choice("XYZ")
        texts.append("".join(t[rng.randrange(100):1500 - rng.randrange(100)]))
    rows = [*enumerate(texts), (500, texts[0]), (501, base + base)]
    assert run(make_docs(rows)) == brute(rows)


def test_helper_names_as_columns(make_docs):
    rows = [*enumerate(tricky(random.Random(2))[:12]), (99, "x" * 400)]
    names = ["__digest", "__spans", "__text", "__whole", "digest", "spans", "whole", "row", "t", "end", "first"]
    df = make_docs(rows).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    out = S.remove_repeats(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names)


def test_empty_table(make_docs):
    assert run(make_docs([])) == []


def test_pieces_of_long_texts():
    """Anchors don't depend on where a long buffer is cut."""
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 9_000_000).astype(np.uint8)
    raw[8_000_000:8_300_000] = raw[4_100_000:4_400_000]
    _, place, h = S.anchors(raw, np.array([0, len(raw)]), 200, 32)
    assert len(np.unique(place)) == len(place) and np.diff(place).max() <= 169
    inner = lambda a: place[(place >= a + 200) & (place < a + 299_000)] - a
    assert (inner(4_100_000) == inner(8_000_000)).all()


def test_maximal_repeats_lists_every_occurrence():
    left, right, repeats = S.maximal_repeats([b"abcdefgh", b"abcdefgh", b"abcdxxxx", b"abc"], [b"zyx", b"zyw", b"zyx", b"zyx"], 6)
    assert right.tolist() == [8, 8, 4, 3] and left.tolist() == [3, 2, 3, 3]
    assert {(a, b, tuple(sorted(m.tolist()))) for a, b, m in repeats} == {(2, 8, (0, 1)), (2, 4, (0, 1, 2)), (3, 3, (0, 2, 3))}


def test_removed_texts_stay_valid(make_docs):
    texts = tricky(random.Random(4))
    rows = [*enumerate(texts)]
    df = make_docs(rows).withColumn("__x", F.lit(1))
    out = {r.doc_id: r for r in S.remove_repeats(df).collect()}
    assert len(out) == len(rows) and all(o.asDict().keys() == set(df.columns) for o in out.values())
    want = {d: n - gone for d, n, gone, _, _ in brute(rows)}
    for d, t in rows:
        kept = (out[d].text or "").encode()
        assert want[d] <= len(kept) <= want[d] + 2 * 3 * 10


def test_repeats_are_listed_on_demand():
    """Spans need no list of the nested intervals' members."""
    rng = random.Random(3)
    right = [bytes(rng.choice(b"ab") for _ in range(3)) + b"x" * 250 for _ in range(40)]
    left = [b"y" * rng.randrange(30, 100) for _ in range(40)]
    a, b, listed = S.maximal_repeats(right, left, 200)
    c, d, none = S.maximal_repeats(right, left, 200, listed=False)
    assert a.tolist() == c.tolist() and b.tolist() == d.tolist() and b.any() and listed and none == []


def test_small_batches_of_texts(spark, make_docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def told(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    from replenish.llm.common import TEXTS_AT_ONCE, small_batches
    with small_batches(spark):
        sizes = [r.n for r in make_docs([(i, "x") for i in range(5000)]).coalesce(1).select("doc_id").mapInArrow(told, "n long").collect()]
    assert sum(sizes) == 5000 and max(sizes) <= TEXTS_AT_ONCE and spark.conf.get(key) == before


def test_only_texts_of_large_groups_travel_for_them(spark, make_docs, monkeypatch):
    """Texts without a context in a large group aren't shuffled for these groups again."""
    rng, asked, texts_of = random.Random(5), [], S._texts_of
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, pair = text(300), text(300)
    texts = [text(250) + common + text(250) for _ in range(9)] + [text(250) + pair + text(250) for _ in range(2)]
    monkeypatch.setattr(S.repeat_spans, "__defaults__", (S.SPAN, S.SEED, 5))
    monkeypatch.setattr(S, "_texts_of", lambda docs, digests: asked.append(digests.count()) or texts_of(docs, digests))
    assert run(make_docs([*enumerate(texts)])) == brute([*enumerate(texts)])
    assert 9 in asked[:2] and 11 not in asked[:2]
