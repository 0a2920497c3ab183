"""Fingerprints against a plain-Python restatement."""
import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from replenish.llm import fingerprint as P

PHRASE = re.compile(r"(?:\S*[^\s.!?,;:][ \t]+){0,4}\S+", re.ASCII)


def spark_hash(s, seed):
    """Spark's xxhash64 of a string, or of (string, int 1)."""
    h = xxhash.xxh64_intdigest(s.encode(), 42)
    return h if seed == 0 else xxhash.xxh64_intdigest((1).to_bytes(4, "little"), h)


def plain(text):
    lanes = [sum(spark_hash(p, s) >> 32 * k & 0xFFFFFFFF for p in text.split("\n")) % 2**32 for s in (0, 1) for k in (0, 1)]
    found = PHRASE.findall(text)
    mask = 1 | 1 << 32
    sums = [sum(spark_hash(p, s) >> k & mask for p in found) for s in (0, 1) for k in range(24)]
    return "".join(f"{x:08x}" for x in lanes) + f"{len(found):016x}" + "".join(f"{x:016x}" for x in sums)


def signed(fp):
    n = int(fp[32:48], 16)
    sums = [int(fp[48 + 16 * k:64 + 16 * k], 16) for k in range(48)]
    return n, [2 * (x >> 32 * j & 0xFFFFFFFF) - n for x in sums for j in range(2)]


def likeness(a, b):
    (na, x), (nb, y) = signed(a), signed(b)
    if not na or not nb:
        return 1.0 if na == nb else 0.0
    sq = sum(p * p + q * q for p, q in zip(x, y))
    return max(0.0, 2 * sum(p * q for p, q in zip(x, y)) / sq) if sq else 1.0


def brute(rows):
    """Rows are distinct by doc_id, not null."""
    rows = sorted((i, t or "") for i, t in rows)
    out = []
    for k, (i, t) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        a, b, c = plain(t), plain(edited), plain(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return out


def run(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                   for r in P.fingerprint_edits(df).collect()), key=lambda r: (r[0] is not None, r))


def test_against_plain_python(make_docs):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice(["ab ", "cé. ", "d\n", "eff, ", "  ", "\t", "😀 ", "gh"]) for _ in range(n))
    rows = [(i * 3, text(rng.randrange(0, 300))) for i in range(60)] + [(1, None), (2, ""), (4, "x" * 40000), (5, "a " * 20000), (7, "same"), (8, "same")]
    assert run(make_docs(rows).withColumns({"key": F.lit(1), "h": F.lit(2), "n": F.lit(3)})) == brute(rows)


def test_more_phrases_than_a_short_lane_holds(make_docs):
    rows = [(1, "word\n" * 1_100_000 + "x"), (2, "other\n" * 300_000)]
    got, want = run(make_docs(rows)), brute(rows)
    assert got == want and got[0][5] > 0.9


def test_repeated_rows_and_null_ids(make_docs):
    rows = [(1, "one two three four"), (1, "one two three four"), (None, "null id here"), (2, "b " * 30)]
    got = run(make_docs(rows))
    assert [r[0] for r in got] == [None, 1, 1, 2] and got[1] == got[2]
    assert got[0][2] == hashlib.sha256("null id hone ".replace("hone ", "one")[:0].encode() + ("null id here"[:9] + "one").encode()).hexdigest()
    assert got[3][2] == hashlib.sha256((("b " * 30)[:45] + "null id here"[:15]).encode()).hexdigest()


def test_single_and_empty_table(make_docs):
    assert run(make_docs([])) == []
    (only,) = run(make_docs([(3, "abcdefgh")]))
    assert only[2] == hashlib.sha256(b"abcdefab").hexdigest()


def test_order_independent_and_incremental(spark):
    a, b = "one two three.\nfour five six seven", "eight nine\nten"
    df = spark.createDataFrame([(a, b)], "a string, b string").select(
        *[F.struct(P.paragraph_lanes(c), F.size(P.phrase_hashes(c)).cast("long"), P.phrase_sums(P.phrase_hashes(c))).alias(n)
          for n, c in (("a", F.col("a")), ("b", F.col("b")), ("ab", F.concat("a", F.lit("\n"), "b")), ("ba", F.concat("b", F.lit("\n"), "a")))])
    fp = {n: P.encode(*[F.col(f"{n}.{f}") for f in df.schema[n].dataType.names]) for n in ("a", "b", "ab", "ba")}
    fps = df.select(*[fp[n].alias(f"f_{n}") for n in fp])
    r = fps.select("*", P.combine(F.col("f_a"), F.col("f_b")).alias("sum"), P.combine(F.col("f_ab"), F.col("f_b"), -1).alias("less")).first()
    assert r.f_ab == r.f_ba == r.sum == plain(f"{b}\n{a}") and r.less == r.f_a


def test_edited_texts_are_nearer_than_the_next(spark, small):
    rows = P.fingerprint_edits(spark.read.parquet(f"{small}/documents.parquet")).collect()
    long = [r for r in rows if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)
