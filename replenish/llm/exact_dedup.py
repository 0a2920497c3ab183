"""Exact dedup by a heavy-hitter split.

Texts are equal when they are identical after every run of blanks became one space; a SHA-256 digest stands for the
text. A Misra-Gries summary (Spark's frequent-items sketch ``approx_top_k``, one per hash bucket of digests, so that no
single task merges all of them) names the candidates for frequent digests. Their groups are counted exactly, and the
verified winners - ``BUCKETS * PER_BUCKET`` rows at most - are broadcast: copies of a winner are recognised where they
are read and never move. All other digests take an ordinary shuffle; a sketch of ``COUNTERS`` counters may miss a digest
that has up to about one in ``COUNTERS`` of a bucket's rows, never a more frequent one.

Defined results: a null text is an empty text; a null doc_id sorts after all others; of rows with the same smallest
doc_id exactly one stays; an empty table gives an empty result; columns other than (doc_id, text) never matter here.
Only DataFrame and SQL functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replenish.llm.common import BLANK, stored

#: Hash buckets, each with its own sketch; counters of a sketch (a power of two); candidates taken from each bucket.
BUCKETS, COUNTERS, PER_BUCKET = 64, 256, 32
#: A digest with so many rows is worth a broadcast row.
HEAVY = 500


def digest(text: Column) -> Column:
    """Hex SHA-256 of the normalised text."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+", " "), 256)


def heavy_digests(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Verified frequent digests of ``rows`` (doc_id, row, text_sha256): (text_sha256, keep_id, keep_row, n_ties,
    group_size), at most BUCKETS * PER_BUCKET rows."""
    bucket = F.pmod(F.xxhash64("text_sha256"), F.lit(BUCKETS))
    guesses = (rows.select(bucket.alias("bucket"), "text_sha256").groupBy("bucket")
               .agg(F.expr(f"approx_top_k(text_sha256, {PER_BUCKET}, {COUNTERS})").alias("top"))
               .select(F.explode("top").alias("x")).where(F.col("x.count") >= heavy)
               .select(F.col("x.item").alias("text_sha256")))
    exact = (rows.join(F.broadcast(guesses), "text_sha256", "left_semi")
             .groupBy("text_sha256", "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("n"))
             .groupBy("text_sha256")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("w"),
                  F.sum("n").alias("group_size")))
    return (exact.where(F.col("group_size") >= heavy)
            .select("text_sha256", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row"),
                    F.col("w.n").alias("n_ties"), "group_size"))


def label_copies(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, is_heavy."""
    rows = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("text_sha256")),
                  "digests")
    winners = stored(heavy_digests(rows, heavy), "winners")
    hot = (rows.join(F.broadcast(winners), "text_sha256")
           .select("doc_id", "keep_id", "group_size",
                   (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ((F.col("n_ties") == 1) | (F.col("row") == F.col("keep_row"))))
                   .alias("kept"), "text_sha256", F.lit(True).alias("is_heavy")))
    group = Window.partitionBy("text_sha256")
    order = group.orderBy(F.col("doc_id").asc_nulls_last(), "row")
    rest = (rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
            .select("doc_id", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"),
                    (F.row_number().over(order) == 1).alias("kept"), "text_sha256", F.lit(False).alias("is_heavy")))
    return hot.unionByName(rest)


def drop_copies(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were. Copies of a heavy digest are dropped map-side; of the
    others Spark keeps one row per digest and task before the shuffle (a rank limit below the window)."""
    # the input travels as one column, so its own columns may have any name
    rows = docs.select(F.struct("*").alias("input"), "doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("text_sha256"))
    winners = stored(heavy_digests(rows.drop("input"), heavy), "winners").select("text_sha256", "keep_id", "keep_row", "n_ties")
    one = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ((F.col("n_ties") == 1) | (F.col("row") == F.col("keep_row")))
    hot = rows.join(F.broadcast(winners), "text_sha256").where(one)
    first = Window.partitionBy("text_sha256").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    rest = (rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
            .withColumn("n", F.row_number().over(first)).where("n = 1"))
    return hot.select("input.*").unionByName(rest.select("input.*"))
