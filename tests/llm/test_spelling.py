"""Spelling variants against brute force."""
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from replenish.llm import spelling as S


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, least=7):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= 2}
    met = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            met[a].append(b)
            met[b].append(a)
    form = {}
    for w, others in met.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(met[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    stems = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "ababababa", "kettles", "kettleés", "Écoleÿ×s", "colourful", "colorful", "colorfull", "committee"]
    stems += ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    rows = []
    for i in range(120):
        words = [stems[int(len(stems) * rng.random() ** 4)] for _ in range(rng.choice([0, 3, 60, 200]))]
        words = [w if rng.random() < 0.97 else w[:3] + rng.choice("abz") + w[3:] for w in words]
        rows.append((i, rng.choice([" ", "-", "’", "1"]).join(w if rng.random() < 0.7 else w.upper() for w in words)))
    rows += [(None, "colourful " * 30), (None, "colourful " * 30), (200, None), (201, ""), (202, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + " " + "x" * 4999)]
    return rows


@pytest.mark.parametrize("most", [S.GROUP_MOST, 3])
def test_against_brute_force(spark, most):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "m", "lo", "shared", "mid")})
    got = S.variants(df.repartition(5), most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == brute(rows)
    assert sum(x[1] is not None for x in found) > 20


def test_acceptor_is_minimal_and_pairs_are_whole():
    rng = random.Random(1)
    for _ in range(150):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 60))})
        a = S.Acceptor(words)
        assert sorted(a.both(a.start, a.start)) == words
        # no two states accept the same rests
        rests = [tuple(sorted(a.both(p, p))) for p in range(len(a.final))]
        assert len(set(rests)) == len(rests)
        got = [tuple(sorted(x[:2])) for x in a.pairs()]
        assert len(got) == len(set(got))
        assert sorted(got) == sorted(x for x in itertools.combinations(words, 2) if near(*x))


def test_forms_chain_to_the_root(spark):
    rows = [(i, w) for w, n in (("kettles", 400), ("kettlesx", 40), ("kettlesxy", 4)) for i in range(5000, 5000 + n)]
    rows = [(i, w) for i, w in rows if zlib.crc32(f"{i}:{w}".encode()) % 31]
    got = {r.word: (r.form, r.root) for r in S.variants(spark.createDataFrame(rows, "doc_id long, text string"), lead=5).collect()}
    assert got == {"kettles": (None, "kettles"), "kettlesx": ("kettles", "kettles"), "kettlesxy": ("kettlesx", "kettles")}


def test_long_texts_in_pieces(monkeypatch):
    text = ("Abé c’d " * 50 + "x" * 99).encode()
    whole = S.runs(text)
    monkeypatch.setattr(S, "PIECE", 10)
    assert S.runs(text) == whole and whole["abé".encode()] == 50


def test_empty_table(spark):
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
