"""Ranked lexical search: the best documents of every query item, by exact integer impact scores, through norm buckets.

1. One pass over the texts counts each document's terms (n) and its term frequencies of the terms that some item holds;
   the number of documents, their total length and the document frequencies follow by aggregation.
2. A document is the vector of ``sqrt(w) * impact`` over those terms, an item the vector of ``sqrt(w) * count``; their
   inner product is the score. The vectors are written in order of length (Euclidean norm), so a run of neighbouring rows
   is a bucket of about equal lengths. Documents of equal length (copies) are dealt out by their id.
3. The longest vectors are scored first; each item's k-th best score among them bounds its final k-th best from below.
4. In the other buckets, Cauchy-Schwarz prunes: a bucket whose longest vector times the item's length stays below that
   bound is skipped, and so is the tail of a bucket. Inside, the item's heaviest coordinates are multiplied out and the rest
   of both vectors is bounded by their remaining lengths. Survivors are scored again, exactly, in 64-bit integers, and raise
   the bound of the task.

Items are taken in blocks of about ``BLOCK_TERMS`` (item, term) rows, which are what is broadcast; the documents are read
once a block. Every document is met by every item's bounds; nothing is sampled.

Defined results: a null or empty text has no terms, such a document is never found and an item without terms has no rows;
fewer than k rows where fewer documents score above 0; equal scores by ascending doc_id, null ids last; repeated rows of
documents are found each, repeated rows of items are answered each; an empty table gives an empty result; columns other
than the id and the text never matter."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.llm.common import ship, stored
from replenish.operators.outputs import top_k_per_group

#: A term: ASCII digits and letters and all that isn't ASCII, as UTF-8 bytes (texts are lower-cased in A-Z before).
TERM, BETWEEN = re.compile(rb"[0-9A-Za-z\x80-\xFF]+"), re.compile(rb"[^0-9A-Za-z\x80-\xFF]")
#: Results of an item; share of the length norm in a document's impact, in hundredths.
K, SLOPE = 10, 75
#: (item, term) rows of a block of items; documents of a bucket; bytes of a text whose terms are listed at once.
BLOCK_TERMS, BUCKET, PIECE = 500_000, 4096, 1 << 22
#: Share of the documents whose vectors, the longest, are scored first; share of an item's length that its focus leaves.
LEADING, UNFOCUSED = 0.01, 0.4
#: Bounds are doubles and get this margin; scores are exact.
MARGIN = 1 + 1e-9


def term_counts(text: bytes) -> Counter:
    """Occurrences of every term of a text."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (gap := BETWEEN.search(text, at + PIECE)):
            end = gap.start()
        found.update(TERM.findall(text[at:end].lower()))
        at = end
    return found


def _bytes(column) -> list[bytes]:
    import pyarrow as pa

    return column.fill_null("").cast(pa.large_binary()).to_pylist()


def query_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, count): the terms of every row of ``items`` (item_id, text); ``item`` numbers the rows."""
    import pyarrow as pa

    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches):
        for batch in batches:
            rows = [(i, t.decode(), c) for i, text in enumerate(_bytes(batch.column(2))) for t, c in term_counts(text).items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.string()),
                                              pa.array([r[2] for r in rows], pa.int64())], ["item", "item_id", "term", "count"])

    return (items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
            .mapInArrow(split, f"item long, item_id {kind}, term string, count long"))


def document_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: its length and its terms that ``vocabulary`` numbers."""
    import pyarrow as pa

    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        numbers = known.value
        for batch in batches:
            keep, sizes, terms, counts = [], [], [], []
            for i, text in enumerate(_bytes(batch.column(1))):
                found = term_counts(text)
                if found:
                    keep.append(i)
                    sizes.append(found.total())
                    met = numbers.keys() & found.keys()
                    terms.append([numbers[t] for t in met])
                    counts.append([found[t] for t in met])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                                              pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                                             ["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, counts array<bigint>")


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow list column, one after the other, and the n + 1 offsets."""
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy()[at[0]:at[-1]], (at - at[0]).astype(np.int64)


def document_vectors(found: DataFrame, weights: np.ndarray, n_docs: int, total: int) -> DataFrame:
    """(doc_id, length, terms, impacts) of the documents of ``found`` that can score: impacts are the integers of the
    score, length is the norm of the vector of sqrt(weight) * impact."""
    import pyarrow as pa

    known = found.sparkSession.sparkContext.broadcast(weights)
    kind = found.schema["doc_id"].dataType.simpleString()

    def weigh(batches):
        w = known.value.astype(float)
        for batch in batches:
            terms, at = _flat(batch.column(2))
            tf, _ = _flat(batch.column(3))
            m = np.array([100 - SLOPE + SLOPE * n * n_docs // total for n in batch.column(1).to_pylist()], np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(at)))
            row = np.repeat(np.arange(len(m)), np.diff(at))
            length = np.sqrt(np.bincount(row, w[terms] * impact.astype(float) ** 2, len(m)))
            can = pa.array(length > 0)
            offsets = pa.array(at.astype(np.int32))
            whole = pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), pa.ListArray.from_arrays(offsets, pa.array(terms)),
                                                pa.ListArray.from_arrays(offsets, pa.array(impact))], ["doc_id", "length", "terms", "impacts"])
            yield whole.filter(can)

    return found.where(F.size("terms") > 0).mapInArrow(weigh, f"doc_id {kind}, length double, terms array<int>, impacts array<bigint>")


class Bucket:
    """A run of document vectors in falling order of length, by rows and by columns."""

    def __init__(self, batch, roots: np.ndarray):
        self.ids, self.length = batch.column(0), batch.column(1).to_numpy()
        self.terms, self.at = _flat(batch.column(2))
        self.impacts, _ = _flat(batch.column(3))
        order = np.argsort(self.terms, kind="stable")
        self.column, self.row = self.terms[order], np.repeat(np.arange(len(self.length)), np.diff(self.at))[order]
        self.value = roots[self.column] * self.impacts[order]

    def survivors(self, item: Item, bound: int) -> np.ndarray:
        """Rows that may score ``bound`` or more."""
        rows = len(self.length)
        if bound:
            rows = int(np.searchsorted(-self.length, -bound / (item.length * MARGIN), "right"))
        if not rows:
            return np.zeros(0, np.int64)
        met, used = np.zeros(rows), np.zeros(rows)
        first, last = (np.searchsorted(self.column, item.focus, side) for side in ("left", "right"))
        for f, i, j in zip(item.focus_value, first.tolist(), last.tolist()):
            r, v = self.row[i:j], self.value[i:j]
            if rows < len(self.length):
                r, v = r[r < rows], v[r < rows]
            met[r] += f * v
            used[r] += v * v
        most = met + item.rest * np.sqrt(np.maximum(self.length[:rows] ** 2 * MARGIN - used, 0))
        return np.flatnonzero(most * MARGIN >= max(bound, 1))

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``weights`` are the item's integers by term."""
        sizes = self.at[rows + 1] - self.at[rows]
        begin = np.cumsum(sizes) - sizes
        entry = np.repeat(self.at[rows] - begin, sizes) + np.arange(int(sizes.sum()))
        return np.add.reduceat(weights[self.terms[entry]] * self.impacts[entry], begin) if len(rows) else np.zeros(0, np.int64)


class Item:
    """A query: its terms, and the coordinates that make up most of its length."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, roots: np.ndarray):
        self.terms, self.weights = terms, weights[terms] * counts
        value = roots[terms] * counts
        order = np.argsort(-value, kind="stable")
        left = np.sqrt(np.maximum((value ** 2).sum() - np.cumsum(value[order] ** 2), 0))
        self.length = float(np.sqrt((value ** 2).sum()))
        n = int(np.searchsorted(-left, -UNFOCUSED * self.length, "left")) + 1
        self.focus, self.focus_value = terms[order[:n]], value[order[:n]].tolist()
        self.rest = float(np.sqrt((value[order[n:]] ** 2).sum()))


def best_rows(found: list[tuple], k: int) -> list[tuple]:
    """The k first of (score, doc_id): highest scores, then smallest ids, null ids last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:k]


def _search(index: DataFrame, block, k: int, bounds: np.ndarray) -> DataFrame:
    """(item, doc_id, score): of each item the k best of every task's documents, as far as they reach the item's bound."""
    import pyarrow as pa

    known = index.sparkSession.sparkContext.broadcast((*block, bounds))
    kind = index.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        numbers, terms, counts, at, weights, least = known.value
        roots = np.sqrt(weights.astype(float))
        items = [Item(terms[i:j], counts[i:j], weights, roots) for i, j in zip(at, at[1:])]
        dense = np.zeros(len(weights), np.int64)
        best: list[list[tuple]] = [[] for _ in items]
        bound = least.tolist()
        for batch in batches:
            # a task may read several of the ordered files
            batch = batch.take(pa.array(np.argsort(-batch.column(1).to_numpy(), kind="stable")))
            for lo in range(0, len(batch), BUCKET):
                bucket = Bucket(batch.slice(lo, BUCKET), roots)
                for q, item in enumerate(items):
                    if item.length * bucket.length[0] * MARGIN < max(bound[q], 1):
                        continue
                    rows = bucket.survivors(item, bound[q])
                    dense[item.terms] = item.weights
                    score = bucket.scores(rows, dense)
                    dense[item.terms] = 0
                    good = score >= max(bound[q], 1)
                    if good.any():
                        rows, score = rows[good], score[good]
                        if len(rows) > k:  # below the k-th best of these nothing counts
                            top = score >= np.partition(score, -k)[-k]
                            rows, score = rows[top], score[top]
                        best[q] = best_rows([*best[q], *zip(score.tolist(), bucket.ids.take(pa.array(rows)).to_pylist())], k)
                        if len(best[q]) == k:
                            bound[q] = max(bound[q], best[q][-1][0])
        out = [(int(numbers[q]), d, s) for q, found in enumerate(best) for s, d in found]
        if out:
            item, doc, score = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, bucket.ids.type), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return index.select("doc_id", "length", "terms", "impacts").mapInArrow(scan, f"item long, doc_id {kind}, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k_per_group(found, ["item"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], k)


def _search_block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score, rank) of one block of ``query_terms``."""
    spark = docs.sparkSession
    rows = asked.select("item", "term", "count").toArrow().sort_by([("item", "ascending"), ("term", "ascending")])
    words = rows["term"].combine_chunks().dictionary_encode()
    vocabulary = {t.encode(): i for i, t in enumerate(words.dictionary.to_pylist())}
    found = stored(document_terms(docs, vocabulary), "terms")
    n_docs, total = found.agg(F.count("*"), F.sum("n")).first()
    df = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    seen = np.zeros(len(vocabulary), np.int64)
    seen[df["t"].to_numpy()] = df["df"].to_numpy()
    weights = np.array([weight(n_docs, x) if x else 0 for x in seen.tolist()], np.int64)
    item = rows["item"].to_numpy()
    at = np.append(np.flatnonzero(np.diff(item, prepend=item[0] - 1)), len(item))
    block = item[at[:-1]], words.indices.to_numpy(), rows["count"].to_numpy(), at.tolist(), weights

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    longest = [F.desc("length"), F.xxhash64("doc_id")]
    index = stored(document_vectors(found, weights, n_docs or 0, total or 0).repartitionByRange(parts, *longest)
                   .sortWithinPartitions(F.desc("length")), "index")
    cut = index.agg(F.percentile_approx("length", 1 - LEADING, 10_000)).first()[0] or 0.0
    leading = stored(_best(_search(index.where(F.col("length") >= cut), block, k, np.zeros(len(at) - 1, np.int64)), k), "leading")
    # the k-th best score of the items that have one: a number per item of the block
    known = leading.where(F.col("rank") == k).select("item", "score").toArrow()
    bounds = np.zeros(len(at) - 1, np.int64)
    bounds[np.searchsorted(block[0], known["item"].to_numpy())] = known["score"].to_numpy()
    others = _search(index.where(F.col("length") < cut), block, k, bounds)
    return _best(leading.select("item", "doc_id", "score").unionByName(others), k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best rows of ``docs`` (doc_id, text) for every row of ``items``
    (item_id, text)."""
    ship(docs.sparkSession)
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    asked = stored(query_terms(items), "query-terms")
    blocks = -(-asked.count() // block_terms)
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else asked
        if mine.isEmpty():
            continue
        hits = _search_block(docs, mine, k)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = _search_none(docs)
    ids = asked.select("item", "item_id").distinct()
    return found.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_none(docs: DataFrame) -> DataFrame:
    return docs.limit(0).select(F.lit(0).cast("long").alias("item"), "doc_id", F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank"))
