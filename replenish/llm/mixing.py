"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of blank-separated words. Sources in code-point order (null last) get the given weights in
turn and share a budget of ``percent`` hundredths of all words; a target stops at ``most`` times its source's words and the
excess goes to the others by weight. Since targets are then ``level * weight`` below a cap, the sources that stop are a
prefix in order of cap over weight: one ordered scan over the sources finds the level, with no rounds.

Each source takes every document floor(target / words) times; what is left of its budget is fitted with whole documents:

1. Documents are counted by source and exact size, the only thing that the fitting sees. (A source of S words has at most
   sqrt(2 S) different sizes, so this table is far below the corpus.)
2. Most of the budget is shared out over the sizes in proportion, the longest first, each making up for what the longer ones
   left; this keeps the mix of sizes. About ``FIT`` words stay open.
3. The open rest is a bounded knapsack: dynamic programming over the sums that the unused documents reach (counts split
   into powers of two) finds the one nearest to the rest, and how many documents of each size make it up.
4. Of the documents of one size those with the smallest seeded hash of id and text are taken. The cut is found by radix:
   a group is dealt to buckets by the leading part of the hash, whole buckets below the cut are taken and the rest is
   ranked within the one bucket that holds the cut, so a size that a third of all documents share is never sorted at once.

Defined results: a null text has no words; documents without words take 0; a null source is a source of its own and an
empty name another; rows equal in id and text share their place in the seeded order, and any of them may be taken; an empty
table gives an empty result; columns other than (doc_id, text, source) never matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from replenish.llm.common import BLANK, ship, split_join, stored
from replenish.operators.scan import running

#: Weights in turn; budget in hundredths of all words; times that a source may be taken.
WEIGHTS, PERCENT, MOST, SEED = (3, 1, 2), 150, 2, 17
#: Words left open for the dynamic programming; its longest table of sums; documents of a bucket, about.
FIT, SUMS, BUCKET = 1 << 16, 1 << 22, 2000


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^{BLANK[1:-1]}]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, words) to (source, words, target): the budget shared by weight, up to ``most`` times a source's words."""
    one = F.lit(1).cast("long")
    turn = running(sizes, [F.col("source").isNull().asc(), F.col("source").asc_nulls_last()], {"turn": (one, "sum")})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("turn") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = turn.select("source", "words", weight.alias("weight"), (F.col("words") * most).alias("cap"))
    first = [(F.col("cap") / F.col("weight")).asc(), F.col("source").isNull().asc(), F.col("source").asc_nulls_last()]
    ordered = running(capped, first, {"caps": (F.col("cap"), "sum"), "weights": (F.col("weight"), "sum")})
    # the level once all sources before this one have stopped; this one stops too if its cap is below its share
    total = ordered.agg(F.sum("words").alias("w"), F.sum("weight").alias("v")).first()
    budget, all_weights = (total["w"] or 0) * percent, total["v"] or 0
    before = F.lit(budget) / 100 - (F.col("caps") - F.col("cap"))
    share = before * F.col("weight") / (F.lit(all_weights) - (F.col("weights") - F.col("weight")))
    stopped = ordered.where(share >= F.col("cap")).agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    open_words, open_weight = budget / 100 - stopped["cap"], all_weights - stopped["weight"]
    level = F.lit(float(open_words)) * F.col("weight") / F.lit(float(max(open_weight, 1)))
    return ordered.select("source", "words", F.when(share >= F.col("cap"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def proportional(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each size (longest first), each size making up for what the longer ones left of their share."""
    out, words, taken, total = np.zeros(len(size), np.int64), 0, 0, int((size * count).sum())
    for i, (s, c) in enumerate(zip(size.tolist(), count.tolist())):
        words += s * c
        out[i] = min(c, (budget * words // total - taken) // s)
        taken += s * int(out[i])
    return out


def nearest_sum(size: np.ndarray, count: np.ndarray, rest: int) -> np.ndarray:
    """How many documents of each size (longest first) together come nearest to ``rest``, the smaller sum of two as near."""
    out = np.zeros(len(size), np.int64)
    if not len(size) or rest <= 0:
        return out
    for i, (s, c) in enumerate(zip(size.tolist(), count.tolist())):  # sums beyond the table: longest documents first
        if rest + s <= SUMS:
            break
        out[i] = min(c, rest // s)
        rest -= s * int(out[i])
    left = count - out
    # a sum above the rest by more than the rest is no better than nothing; one beyond the longest document has a smaller one as near
    most = min(2 * rest, rest + int(size.max()), SUMS)
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    by = np.full(most + 1, -1, np.int32)  # the last piece of each sum
    pieces: list[tuple[int, int]] = []
    for i, s in enumerate(size.tolist()):
        c, step = min(int(left[i]), most // s), 1
        while c > 0 and not reached[min(rest, most)]:
            k = min(step, c)
            w = k * s
            new = np.flatnonzero(reached[:most + 1 - w] & ~reached[w:]) + w
            reached[new], by[new] = True, len(pieces)
            pieces.append((i, k))
            c, step = c - k, step * 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, k = pieces[by[at]]
        out[i] += k
        at -= k * int(size[i])
    return out


def fit(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """Documents of each size (positive, longest first) to take once, so that their words come to about ``budget``."""
    spread = proportional(size, count, max(budget - FIT, 0))
    return spread + nearest_sum(size, count - spread, budget - int((size * spread).sum()))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: int = SEED,
        bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken."""
    import pandas as pd

    ship(docs.sparkSession)
    # sources and sizes as one key without nulls
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    key = F.concat(F.col("size").cast("string"), F.lit(" "), "name")
    place = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id"), F.coalesce("text", F.lit("")))
    rows = stored(docs.select("doc_id", "source", name.alias("name"), word_count(F.col("text")).alias("size"), place.alias("place")), "sizes")
    by_size = stored(rows.groupBy("name", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")), "histogram")
    words = by_size.groupBy("name").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("source").alias("source"))
    aims = stored(targets(words.select("source", "words"), weights, percent, most), "targets")
    aims = aims.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name"), "words", "target")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        total, target = int(pdf["words"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(int(target // total), most) if total else 0
        pdf["times"], pdf["take"] = whole, 0
        some = (pdf["size"] > 0).to_numpy()
        if whole < most and some.any():
            pdf.loc[some, "take"] = fit(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], int(round(target)) - whole * total)
        return pdf[["name", "size", "n", "words", "target", "times", "take"]]

    kinds = "name string, size long, n long, words long, target double, times long, take long"
    planned = (by_size.select("name", "size", "n").join(aims, "name").groupBy("name").applyInPandas(plan, kinds)
               .withColumn("key", key).select("key", "n", "words", "target", "times", "take"))
    planned = stored(planned, "plan")
    hot = planned.orderBy(F.desc("n")).limit(1000).where("n >= 1000")
    keyed = split_join(rows.withColumn("key", key), planned, "key", hot)

    # radix: buckets of a size by the leading part of the hash; those below the cut are taken whole
    buckets = F.ceil(F.col("n") / bucket)
    part = F.floor((F.col("place") / 2.0 ** 64 + 0.5) * buckets).cast("long")
    partly = stored(keyed.withColumn("part", F.when((F.col("take") > 0) & (F.col("take") < F.col("n")), part)), "placed")
    cut = partly.where("part is not null").groupBy("key", "part").agg(F.count("*").alias("here"), F.first("take").alias("take"))
    below = F.sum("here").over(Window.partitionBy("key").orderBy("part")) - F.col("here")
    cuts = (cut.withColumn("below", below).where((F.col("below") < F.col("take")) & (F.col("below") + F.col("here") >= F.col("take")))
            .select("key", F.col("part").alias("at"), (F.col("take") - F.col("below")).alias("of")))
    cuts = stored(cuts, "cuts")
    cut_at = split_join(partly.where("part is not null"), cuts, "key", hot.select("key"))
    inside = Window.partitionBy("key", "part").orderBy("place", "doc_id")
    ranked = cut_at.where("part = at").withColumn("once", (F.row_number().over(inside) <= F.col("of")).cast("long"))
    clear = cut_at.where("part != at").withColumn("once", (F.col("part") < F.col("at")).cast("long"))
    plain = partly.where("part is null").withColumn("once", ((F.col("take") > 0) & (F.col("take") >= F.col("n"))).cast("long"))
    columns = ["doc_id", "source", "size", F.col("words").alias("source_size"), "target", (F.col("size") * (F.col("times") + F.col("once"))).alias("taken")]
    return plain.select(columns).unionByName(clear.select(columns)).unionByName(ranked.select(columns))
