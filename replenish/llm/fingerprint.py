"""Document fingerprints by a homomorphic multiset hash.

A fingerprint is the sum of wide vectors hashed from a text's paragraphs (lines), modulo powers of two, so it doesn't
depend on their order, and a paragraph's vector can be added or subtracted at any time (``combine``). It has two parts:

* 4 lanes modulo 2^32, summed over the paragraphs' 64-bit hashes under two seeds: multiset equality of paragraphs;
* a likeness part: a paragraph's vector is itself the sum of 0/1 vectors of 96 lanes, hashed from its phrases (runs of
  up to five words, shorter where a word ends in punctuation). Packed two lanes of 32 bits to a long, it is 48 sums.

With n phrases each lane c stands for the signed sum 2c - n of random signs, so products of two texts' signed sums,
averaged over the lanes, estimate the dot product of their phrase counts. ``likeness`` is 2 a.b / (a.a + b.b), cut to
0..1: 1 for equal texts, about the shared part for edited ones, 0 with a standard error of 0.1 for unrelated ones.

Defined results: a null text is an empty text (no phrases; one empty paragraph); equal texts have equal fingerprints;
two texts without phrases have likeness 1, one of them alone 0. ``edited`` orders the distinct (doc_id, text) rows by
doc_id (null first), then by the text's hash; repeated rows are one in that order and come back as often as given. With
a single such row its own start replaces its end. A lane holds 2^31 phrases, more than a text of 2 GB, the longest that
Spark holds, has. Only DataFrame and SQL
functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replenish.llm.common import stored

#: Words of a phrase; seeds of the two hashes; lanes of 32 bits packed in a long, and longs for each hash.
WORDS, SEEDS, LANES, LONGS = 5, (0, 1), 2, 24
LANE_BITS = 32
_MASK = sum(1 << (LANE_BITS * k) for k in range(LANES))
_PHRASE = rf"((?:\S*[^\s.!?,;:][ \t]+){{0,{WORDS - 1}}}\S+)"
_SUMS = len(SEEDS) * LONGS


def _hash(c: Column, seed: int) -> Column:
    return F.xxhash64(c) if seed == 0 else F.xxhash64(c, F.lit(seed))


def paragraph_lanes(text: Column) -> Column:
    """Sums of the paragraphs' hashes: array of 4 longs modulo 2^32."""
    def lane(seed, half):
        return F.aggregate(F.split(text, "\n"), F.lit(0).cast("long"), lambda a, p: (
            a + F.shiftrightunsigned(_hash(p, seed), 32 * half).bitwiseAND(0xFFFFFFFF)).bitwiseAND(0xFFFFFFFF))

    return F.array(*[lane(s, k) for s in SEEDS for k in (0, 1)])


def phrase_hashes(text: Column) -> Column:
    """The phrases' hashes under both seeds: array<struct<h0, h1>>."""
    return F.transform(F.regexp_extract_all(text, F.lit(_PHRASE), 1),
                       lambda p: F.struct(*[_hash(p, s).alias(f"h{i}") for i, s in enumerate(SEEDS)]))


def phrase_sums(hashes: Column) -> Column:
    """The packed lanes' sums over the phrases: array of longs."""
    def lane(i, k):
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h[f"h{i}"], k).bitwiseAND(_MASK))

    return F.array(*[lane(i, k) for i in range(len(SEEDS)) for k in range(LONGS)])


def encode(paragraphs: Column, n: Column, sums: Column) -> Column:
    """The fingerprint as hex: 4 paragraph lanes, the number of phrases, the packed phrase lanes."""
    hexed = lambda c, w: F.lpad(F.lower(F.hex(c)), w, "0")
    return F.concat(F.array_join(F.transform(paragraphs, lambda x: hexed(x, 8)), ""), hexed(n, 16),
                    F.array_join(F.transform(sums, lambda x: hexed(x, 16)), ""))


def _field(fp: Column, at: int, width: int) -> Column:
    return F.conv(F.substring(fp, at + 1, width), 16, 10).cast("decimal(20,0)").cast("long")


def phrase_count(fp: Column) -> Column:
    return _field(fp, 32, 16)


def packed(fp: Column) -> Column:
    """The packed phrase lanes of a fingerprint."""
    return F.transform(F.sequence(F.lit(0), F.lit(_SUMS - 1)),
                       lambda k: F.conv(F.substring(fp, 49 + 16 * k, 16), 16, 10).cast("long"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a text whose paragraphs are those of ``a`` with those of ``b`` inserted (or deleted, sign -1)."""
    word = lambda fp: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(fp, 1 + 8 * k, 8), 16, 10).cast("long"))
    add = lambda x, y: x + sign * y
    return encode(F.zip_with(word(a), word(b), lambda x, y: add(x, y).bitwiseAND(0xFFFFFFFF)),
                  add(phrase_count(a), phrase_count(b)), F.zip_with(packed(a), packed(b), add))


def likeness(na: Column, a: Column, nb: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two fingerprints, from their phrase counts and packed lanes: 2 a.b / (a.a + b.b)."""
    signed = lambda x, n, k: 2 * F.shiftrightunsigned(x, LANE_BITS * k).bitwiseAND((1 << LANE_BITS) - 1) - n

    def products(x, y):
        pairs = [(signed(x, na, k).cast("double"), signed(y, nb, k).cast("double")) for k in range(LANES)]
        return dots(sum(p * q for p, q in pairs), sum(p * p + q * q for p, q in pairs))

    dots = lambda ab, sq: F.named_struct(F.lit("ab"), ab, F.lit("sq"), sq)
    none = dots(F.lit(0.0), F.lit(0.0))
    t = F.aggregate(F.zip_with(a, b, products), none, lambda s, x: dots(s["ab"] + x["ab"], s["sq"] + x["sq"]),
                    lambda s: F.when(s["sq"] == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 2 * s["ab"] / s["sq"])))
    return F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(t)


def followers(keys: DataFrame) -> DataFrame:
    """For distinct rows (id, key, h, n): adds nkey, nh of the next row by (id, h), nulls first; the last is followed by the
    first.

    The small key rows are range-partitioned and each range looks ahead on its own; the first row of each range (one
    row per partition) closes the gaps."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(keys.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.col("h")).withColumn("part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "h")
    ahead = ranged.withColumn("next", F.lead(F.struct("key", "h")).over(here))
    firsts = ranged.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("set"), "id", "h", "key")).alias("f"))
    order = Window.orderBy("part")
    first = F.first("f").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gaps = firsts.select("part", F.coalesce(F.lead("f").over(order), first).alias("gap"))  # a row per partition
    return (ahead.join(F.broadcast(gaps), "part")
            .select("id", "key", "h", "n", F.coalesce("next.key", "gap.key").alias("nkey"), F.coalesce("next.h", "gap.h").alias("nh")))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs``
    (doc_id, text): its text, and its text with the last quarter replaced by the start of the next document's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # key: doc_id without nulls, so that all joins and groupings share one partitioning
    base = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), text.alias("text")) \
        .withColumn("h", F.xxhash64("text"))
    # one text per distinct row, partitioned by (key, h): this shuffle serves both uses below (copies > 0 keeps them equal)
    texts = base.groupBy("key", "h").agg(F.first("text").alias("text"), F.count("*").alias("copies")).where("copies > 0")
    keys = base.select("id", "key", "h", F.char_length("text").cast("long").alias("n")).distinct()
    nexts = stored(followers(keys), "followers")
    # what each row's start is wanted for: the row before it, and a quarter of its length
    wanted = nexts.select(F.col("key").alias("pkey"), F.col("h").alias("ph"), F.expr("int(n div 4)").alias("q"), F.col("nkey").alias("key"), F.col("nh").alias("h"))
    starts = texts.join(wanted, ["key", "h"]).select(F.col("pkey").alias("key"), F.col("ph").alias("h"), F.substring("text", F.lit(1), F.col("q")).alias("start"))
    head = F.substring("text", F.lit(1), (F.char_length("text") - F.expr("char_length(text) div 4")).cast("int"))
    both = texts.join(starts, ["key", "h"]).select("key", "h", "copies", "text", F.concat(head, "start").alias("edited"))
    hashed = both.select("*", phrase_hashes(F.col("text")).alias("f0"), phrase_hashes(F.col("edited")).alias("f1"))
    done = stored(hashed.select(
        "key", "h", "copies", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"),
        *[paragraph_lanes(F.col(c)).alias(f"p{w}") for w, c in enumerate(("text", "edited"))],
        *[F.size(f"f{w}").cast("long").alias(f"n{w}") for w in (0, 1)], *[phrase_sums(F.col(f"f{w}")).alias(f"sums{w}") for w in (0, 1)]), "fingerprints")
    after = done.select(F.col("key").alias("nkey"), F.col("h").alias("nh"), F.col("n0").alias("na"), F.col("sums0").alias("sa"))
    linked = nexts.select("id", "key", "h", "nkey", "nh").join(after, ["nkey", "nh"]).join(done, ["key", "h"])
    return linked.select(
        F.col("id").alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"),
        encode(F.col("p0"), F.col("n0"), F.col("sums0")).alias("fingerprint"),
        encode(F.col("p1"), F.col("n1"), F.col("sums1")).alias("edited_fingerprint"),
        likeness(F.col("n0"), F.col("sums0"), F.col("n1"), F.col("sums1")).alias("near_edited"),
        likeness(F.col("n0"), F.col("sums0"), F.col("na"), F.col("sa")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
