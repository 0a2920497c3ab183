"""Exact dedup against brute force."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from replenish.llm import exact_dedup as E

ROWS = [(5, "a b"), (3, "a  b"), (9, "a\t\n b"), (4, "A b"), (None, "a b"), (7, None), (8, ""), (6, " "), (2, "  \r"), (1, "a b "),
        (11, "x" * 60000), (10, "x" * 60000), (12, "a\u00a0b"), (13, "dup"), (13, "dup"), (14, "dup"), (None, "only null"), (None, "only null")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    out, seen = [], set()
    for (i, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        low = min(ids) if ids else None
        kept = i == low and t not in seen
        seen |= {t} if kept else set()
        out.append((i, low, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [500, 2])
def test_against_brute_force(make_docs, heavy):
    """With ``heavy`` = 2 every group takes the broadcast way."""
    df = make_docs(ROWS).withColumns({"row": F.lit(1), "keep_id": F.lit("x"), "text_sha256": F.lit(0)})
    got = E.label_copies(df, heavy).drop("is_heavy")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)


@pytest.mark.parametrize("heavy", [500, 2])
def test_kept_rows(make_docs, heavy):
    names = ["__n", "__row", "__digest", "__keep_id", "__text_sha256", "digest", "row", "n", "keep_id", "keep_row", "n_ties", "text_sha256", "input", "bucket"]
    df = make_docs(ROWS).withColumns({c: F.concat_ws(":", F.lit(c), F.col("doc_id")) for c in names})
    kept = E.drop_copies(df, heavy)
    want = sorted(((i, t) for (i, t, *_), in zip([(i, h) for i, _, _, k, h in brute(ROWS) if k])), key=str)
    rows = kept.collect()
    got = sorted(((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in rows), key=str)
    assert got == want and kept.columns == df.columns
    assert all(r[c] == (c if r.doc_id is None else f"{c}:{r.doc_id}") for r in rows for c in names)


def test_heavy_hitters_are_found_and_counted(spark):
    texts = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = E.label_copies(texts)
    assert got.where("is_heavy").count() == 2000 and got.where("kept").count() == 4001
    assert got.where("is_heavy and kept").first().doc_id == 0


def test_empty_table(make_docs):
    assert E.label_copies(make_docs([])).collect() == [] and E.drop_copies(make_docs([])).collect() == []
