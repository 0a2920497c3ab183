"""Best-fit packing with several permitted sequence lengths.

A text's length is its number of blank-separated words and one end mark; a text longer than the largest permitted length
is cut into parts of that length, so whole texts are packed. Parts go to shards by a salted hash (their number follows from
the number of parts, so a shard's size is bounded and no key can fill one), and each shard is packed by itself: at most one
bin per shard and length stays poorly filled.

Within a shard parts are placed longest first, each into the open bin with the least room that still holds it (bins by
room, looked up in one bit set). When none does, a bin is opened, and its length is chosen there and then: every permitted
length that holds the part is filled in thought with what is still to come, longest first, and downsized; the least cost
per place filled wins, the shorter one of equals. A shard is packed once more by each plain rule - a fixed length, or the
smallest that holds the part - and the packing of least total cost stays. Every bin is finally downsized to the smallest
permitted length that holds its contents. A bin's cost is its length plus a quadratic share for attention.

The bins follow from the rows alone, not from how the table is split into files or partitions: rows of equal doc_id and
length are counted and told apart by a number of their own.

Defined results: a null text is empty; an empty text is one part that holds the end mark alone; repeated rows are packed
each, however many; parts of equal length go in order of doc_id, nulls last; an empty table gives an empty result; columns
other than (doc_id, text) never matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.llm.common import ship, stored

#: Permitted sequence lengths; parts of a shard, about.
LENGTHS, SHARD = (512, 1024, 2048, 4096, 8192), 20_000
#: Length at which attention costs as much as everything else.
ATTENTION = 16_384
#: Equal rows that one task numbers at a time.
COPIES = 10_000


def cost(length) -> float:
    return length * (1 + length / ATTENTION)


def priced(part: int, left: list[int], ahead: int, lengths: list[int]) -> int:
    """The permitted length of least cost per place for a bin that begins with ``part`` and takes what fits of the sizes
    still to come, longest first: ``left`` counts them by size, ``ahead`` has a bit for each size that is left."""
    best = None
    for n in lengths:
        if n < part:
            continue
        room, some = n - part, ahead
        while some := some & ((2 << room) - 1):
            size = some.bit_length() - 1
            room -= size * min(left[size], room // size)
            some ^= 1 << size
        fitted = next(x for x in lengths if x >= n - room)
        price = cost(fitted) / (n - room)
        if best is None or price < best[0]:
            best = price, n
    return best[1]


def pack_with(sizes: list[int], lengths: list[int], opening: int | None) -> tuple[list[int], list[int]]:
    """(bin of each size, what each bin holds) for sizes in falling order; new bins have the length that ``priced`` finds, or
    with an ``opening`` that one, or the smallest permitted one that holds the part where that is too short."""
    rooms: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    left, ahead = np.bincount(sizes, minlength=lengths[-1] + 1).tolist(), 0
    for s in set(sizes):
        ahead |= 1 << s
    mask, used, where = 0, [], []
    for s in sizes:
        left[s] -= 1
        if not left[s]:
            ahead ^= 1 << s
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room = priced(s, left, ahead, lengths) if opening is None else next(n for n in lengths if n >= max(s, opening))
            b = len(used)
            used.append(0)
        used[b] += s
        where.append(b)
        room -= s
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return where, used


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each part, permitted length of each bin, places used in it), of least total cost over bins priced
    one by one and the plain opening rules."""
    lengths = sorted(lengths)
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order].tolist()
    best = None
    for opening in (None, 0, *lengths):
        where, used = pack_with(falling, lengths, opening)
        held = np.asarray(used)
        fitted = np.asarray(lengths)[np.searchsorted(lengths, held)]
        total = float(cost(fitted).sum())
        if best is None or total < best[0]:
            best = total, where, fitted, held
    out = np.empty(len(sizes), np.int64)
    out[order] = best[1]
    return out, best[2], best[3]


def parts(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, words, copy, part, start, size): the parts of every text; start counts words, copy tells rows of equal doc_id
    and length apart. They are counted map-side and dealt out again by the thousand, so many equal rows fill no task."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
    zero = F.lit(0).cast("long")
    blocks = (docs.groupBy("doc_id", words.alias("words")).agg(F.count("*").alias("n"))
              .withColumn("block", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / COPIES))))
              .repartition(tasks, "doc_id", "words", "block"))
    first = F.col("block") * COPIES
    return (blocks.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)))
            .withColumn("part", F.explode(F.sequence(zero, F.floor((F.col("words") - 1) / longest))))
            .select("doc_id", "words", "copy", F.col("part").cast("int").alias("part"), (F.col("part") * longest).alias("start"),
                    F.least(F.lit(longest).cast("long"), F.col("words") - F.col("part") * longest).alias("size")))


def best_fit(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard: int = SHARD) -> DataFrame:
    """One row per bin: bin_id, length, used, n_parts, and the parts in order of size: doc_ids, parts, starts, sizes."""
    import pyarrow as pa

    ship(docs.sparkSession)
    pieces = stored(parts(docs.select("doc_id", "text"), max(lengths)), "parts")
    shards = max(1, -(-pieces.count() // shard))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("part", "ascending")])
        where, fitted, held = pack(rows["size"].to_numpy(), lengths)
        by_bin = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[by_bin], np.arange(len(held) + 1))
        lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows[c].take(pa.array(by_bin)).combine_chunks())
                 for c in ("doc_id", "part", "start", "size")]
        base = rows["shard"][0].as_py() << 32
        return pa.Table.from_arrays([pa.array(base + np.arange(len(held))), *map(pa.array, (fitted, held, np.diff(cut))), *lists],
                                    ["bin_id", "length", "used", "n_parts", "doc_ids", "parts", "starts", "sizes"])

    salted = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "words", "copy", "part"), F.lit(shards)))
    return salted.groupBy("shard").applyInArrow(fill, (
        f"bin_id long, length long, used long, n_parts long, doc_ids array<{kind}>, parts array<int>, starts array<long>, sizes array<long>"))
