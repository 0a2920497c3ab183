"""Suffix-array dedup: find every byte string of ``span`` bytes that starts at two places, over all texts.

1. Distinct texts are read once per content. Winnowing picks anchors: of every window of ``span`` bytes the least-hashed
   ``seed``-byte string. Two equal windows pick the same place, so every repeated string contains an anchor at the same
   offset in all its occurrences, and anchors whose seed occurs once are discarded before any context is cut.
2. The others get their context: up to ``span`` bytes on either side. Contexts of one seed are a suffix array: sorted by
   the text from the anchor on, with common-prefix lengths of neighbours.
3. A stack scan walks the common-prefix intervals. In each interval (suffixes that agree on ``d`` bytes) members are
   ordered by the text to the left of the anchor; runs that extend to the left together by ``span - d`` bytes or more are
   repeats, and where their left extensions differ (left diversity) each member gets its own longest one. All members of
   an interval are reported, not neighbours alone.
4. Spans are merged per text. A text that occurs more than once is repeated as a whole.

A group of more than ``GROUP_MOST`` contexts isn't given to one task. Its most frequent context becomes the reference, all
others are compared with it where they lie (salted), which finds every repeat that stays within what they share with it. A
longer one holds the first byte to the right, or to the left, in which the context leaves the reference, and so do all its
occurrences: the contexts go on to the groups of those that leave it there with the same byte (the subtrees that branch off
this path of the interval tree), until all groups are small.

Defined results: a null text is empty; texts shorter than ``span`` have no repeats; matches never cross texts; repeated
rows are occurrences of one text; an empty table gives an empty result; columns other than (doc_id, text) never matter
(``remove_repeats`` keeps them). In ``remove_repeats`` a cut inside a code point moves inwards, so texts stay valid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.llm.common import bitmap, collect_bitmap, dropped, in_bitmap, mix, passing, ship, slices, small_batches, split_join, stored, text_bytes

#: Bytes of a repeated string; of an anchor's seed.
SPAN, SEED = 200, 32
#: Contexts of a group that one task takes at once; tasks that share a larger group's comparisons.
GROUP_MOST, SALTS = 50_000, 256

_BASE = np.uint64(0xA0761D6478BD642F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes that are hashed at once.
PIECE = 1 << 20
_UP, _DOWN = _powers(_BASE, PIECE), _powers(_INVERSE, PIECE)
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def seed_hashes(raw: np.ndarray, seed: int) -> np.ndarray:
    """Hash of every ``seed``-byte string of a buffer, by prefix sums of a polynomial modulo 2^64."""
    n = len(raw)
    if n < seed:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _UP[:n], out=total[1:])
    return mix((total[seed:] - total[:n - seed + 1]) * _DOWN[:n - seed + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (prefix and suffix minima of blocks of w)."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def anchors(raw: np.ndarray, at: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, seed hash) of the anchors of some texts: the winner of every window inside one text."""
    places, hashes = [], []
    w = span - seed + 1
    for lo in range(0, max(len(raw) - span + 1, 0), PIECE - span + 1):
        hi = min(len(raw), lo + PIECE)
        h = seed_hashes(raw[lo:hi], seed)
        # the low bits hold the place, so the least key is the leftmost of the least hashes
        key = (h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
        best = sliding_min(key, w)
        start = lo + np.arange(len(best))
        text = np.searchsorted(at, start, "right") - 1
        inside = start + span <= at[text + 1]
        place = np.unique((best[inside] & np.uint64((1 << 23) - 1)).astype(np.int64))
        places.append(lo + place)
        hashes.append(h[place])
    if not places:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    # pieces overlap, so an anchor may have won in two of them
    place, once = np.unique(np.concatenate(places), return_index=True)
    text = np.searchsorted(at, place, "right") - 1
    return text, place - at[text], np.concatenate(hashes)[once]


# --- one seed's contexts: enhanced suffix array and interval tree ------------------------------------------------


def common_prefix(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Row-wise length of the common prefix of two padded byte matrices with true lengths."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, np.minimum(la, lb))


def matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8)
    return flat.reshape(len(strings), width), sizes


def intervals(lcp: np.ndarray):
    """Stack scan of an enhanced suffix array: (d, lb, rb) for every common-prefix interval, rb included.
    lcp[i] is the common prefix of suffixes i - 1 and i; lcp[0] is ignored."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        here = int(lcp[i]) if i < len(lcp) else -1
        lb = i - 1
        while stack and here < stack[-1][0]:
            d, lb = stack.pop()
            yield d, lb, i - 1
        if here >= 0 and (not stack or here > stack[-1][0]):
            stack.append((here, lb))
    # the root (depth 0) is popped by the final -1


def maximal_repeats(right: list[bytes], left: list[bytes], span: int, listed: bool = True) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Longest repeated extensions around a seed, in the order given: bytes to the left and from the anchor on of each
    member (0 and 0: none), and, if they are to be ``listed``, the maximal repeats as (left, right, members): nested
    intervals name their members again and again. ``left`` strings run away from the anchor."""
    n, width = len(right), max(map(len, right))
    order = np.array(sorted(range(n), key=right.__getitem__))
    r, rl = matrix([right[i] for i in order], width)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common_prefix(r[1:], r[:-1], rl[1:], rl[:-1])
    # every member's rank by its text to the left, and common left extensions of neighbours in that rank
    back = [left[i] for i in order]
    m, ml = matrix(back, max(1, max(map(len, back))))
    rank = np.empty(n, np.int64)
    by_left = np.array(sorted(range(n), key=back.__getitem__))
    rank[by_left] = np.arange(n)
    most_left, most_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    repeats = []
    for d, lb, rb in intervals(lcp):
        if d == 0:
            continue
        members = np.arange(lb, rb + 1)
        if rb - lb == 1:
            run = members
            ext = common_prefix(m[lb:lb + 1], m[rb:rb + 1], ml[lb:lb + 1], ml[rb:rb + 1])
        else:
            run = members[np.argsort(rank[lb:rb + 1], kind="stable")]
            ext = common_prefix(m[run[1:]], m[run[:-1]], ml[run[1:]], ml[run[:-1]])
        long_ = ext + d >= span
        if not long_.any():
            continue
        # a member's longest left extension is with a neighbour in the left order
        own = np.zeros(len(run), np.int64)
        np.maximum(own[1:], np.where(long_, ext, 0), out=own[1:])
        np.maximum(own[:-1], np.where(long_, ext, 0), out=own[:-1])
        hit = np.zeros(len(run), bool)
        hit[1:] |= long_
        hit[:-1] |= long_
        np.maximum.at(most_left, run[hit], own[hit])
        np.maximum.at(most_right, run[hit], d)
        if not listed:
            continue
        cut = np.flatnonzero(~long_) + 1
        for part in np.split(np.arange(len(run)), cut):
            if len(part) > 1:
                repeats.append((int(ext[part[:-1]].min()), int(d), order[run[part]]))
    out_left, out_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out_left[order], out_right[order] = most_left, most_right
    return out_left, out_right, repeats


def _group_spans(batches, span: int):
    """Batches of (seed, digest, place, right, left), sorted by seed, to (digest, first, end) spans. Seeds with two
    contexts are compared all at once; the others are scanned one by one."""
    import pyarrow as pa

    def spans(t: pa.Table):
        seed = t["seed"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
        sizes = np.diff(np.append(starts, len(seed)))
        place = t["place"].to_numpy()
        left, right = np.zeros(len(seed), np.int64), np.zeros(len(seed), np.int64)
        two = starts[sizes == 2]
        rights, lefts = t["right"].to_pylist(), t["left"].to_pylist()
        for k in range(0, len(two), 4096):
            i = two[k:k + 4096]
            both = []
            for column in (lefts, rights):
                width = max(1, max(len(column[x + y]) for x in i for y in (0, 1)))
                (a, la), (b, lb) = matrix([column[x] for x in i], width), matrix([column[x + 1] for x in i], width)
                both.append(common_prefix(a, b, la, lb))
            good = both[0] + both[1] >= span
            for y in (0, 1):
                left[i[good] + y], right[i[good] + y] = both[0][good], both[1][good]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            left[s:s + n], right[s:s + n], _ = maximal_repeats(rights[s:s + n], lefts[s:s + n], span, listed=False)
        hit = np.flatnonzero(right)
        return pa.RecordBatch.from_arrays([t["digest"].take(pa.array(hit)).combine_chunks(), pa.array(place[hit] - left[hit]), pa.array(place[hit] + right[hit])],
                                          ["digest", "first", "end"])

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        seed = held["seed"].to_numpy()
        cut = int(np.searchsorted(seed, seed[-1], "left")) if len(seed) else 0  # the last seed may go on
        if cut:
            yield spans(held.slice(0, cut).combine_chunks())
            held = held.slice(cut)
    if held is not None and len(held):
        yield spans(held.combine_chunks())


def _leave(batches, span: int):
    """Contexts with their group's reference, to spans (digest, first, end) and contexts in the groups that branch off. A
    context without a reference is in a small group and passes."""
    import pyarrow as pa
    import xxhash

    columns = ["seed", "digest", "place", "right", "left", "small", "first", "end"]
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())

    def branch(seed: int, side: bytes, path: bytes) -> int:
        h = xxhash.xxh64_intdigest(side + path, seed % (1 << 64))
        return h - (1 << 64) if h >> 63 else h

    for batch in batches:
        seeds, digests, places, rights, lefts, refs = (c.to_pylist() for c in batch.columns)
        out, told = [], set()
        for k in range(0, len(seeds), 4096):
            own = [i for i in range(k, min(k + 4096, len(seeds))) if refs[i] is not None]
            agree = {}
            if own:
                both = []
                for mine, name in ((lefts, "left"), (rights, "right")):
                    width = max(1, max(max(len(mine[i]), len(refs[i][name])) for i in own))
                    (a, la), (b, lb) = matrix([mine[i] for i in own], width), matrix([refs[i][name] for i in own], width)
                    both.append(common_prefix(a, b, la, lb).tolist())
                agree = dict(zip(own, zip(*both)))
            for i in range(k, min(k + 4096, len(seeds))):
                seed, d, p, right, left, ref = seeds[i], digests[i], places[i], rights[i], lefts[i], refs[i]
                if ref is None:
                    out.append((seed, d, p, right, left, True, None, None))
                    continue
                if (d, p) == (ref["digest"], ref["place"]):
                    continue
                l, r = agree[i]
                if l + r >= span:
                    out.append((None, d, None, None, None, None, p - l, p + r))
                    if (seed, l, r) not in told:
                        told.add((seed, l, r))
                        out.append((None, ref["digest"], None, None, None, None, ref["place"] - l, ref["place"] + r))
                if r < len(right):
                    out.append((branch(seed, b">", right[:r + 1]), d, p, right, left, False, None, None))
                if l < len(left):
                    out.append((branch(seed, b"<", left[:l + 1]), d, p, right, left, False, None, None))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], columns)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], columns)


def _split_large(rows: DataFrame, span: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Contexts (seed, digest, place, right, left) to the same in groups of ``most`` at most, and the spans (digest, first,
    end) found on the way."""
    small, spans = [], []
    while True:
        same = rows.groupBy("seed", F.xxhash64("right", "left").alias("h")).agg(
            F.count("*").alias("n"), F.min(F.struct("digest", "place", "right", "left")).alias("ref"))
        large = stored(same.groupBy("seed").agg(F.sum("n").alias("size"), F.max_by("ref", "n").alias("ref")).where(F.col("size") > most)
                       .select("seed", "ref"), "large")
        if large.isEmpty():
            small.append(rows)
            break
        refs = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("digest", "place"), F.lit(SALTS)).cast("int"))
        met = stored(salted.join(refs, ["seed", "salt"], "left").select("seed", "digest", "place", "right", "left", "ref")
                     .mapInArrow(lambda b: _leave(b, span), "seed long, digest binary, place long, right binary, left binary, small boolean, first long, end long"), "branches")
        dropped(rows)
        spans.append(met.where("first is not null").select("digest", "first", "end").distinct())
        small.append(met.where("small").select("seed", "digest", "place", "right", "left"))
        rows = stored(met.where("not small").select("seed", "digest", "place", "right", "left"), "contexts")
    found = spans[0] if spans else rows.limit(0).select("digest", F.col("place").alias("first"), F.col("place").alias("end"))
    for s in spans[1:]:
        found = found.union(s)
    whole = small[0]
    for s in small[1:]:
        whole = whole.union(s)
    return whole, found


def _pick(batches, span: int, seed: int):
    """(digest, text) to (seed, digest, place); of the copies of a text that a task meets only the first counts."""
    import pyarrow as pa

    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                seen.add(d)
                new.append(i)
        digests, texts = (batch.column(c).take(pa.array(new, pa.int64())) for c in (0, 1))
        raw, at = text_bytes(texts)
        for i, j in slices(at, PIECE):
            text, place, h = anchors(raw[at[i]:at[j]], at[i:j + 1] - at[i], span, seed)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), digests.take(pa.array(text + i)), pa.array(place)],
                                             ["seed", "digest", "place"])


def _cut(batches, span: int, seed: int):
    """(digest, text, spots) to contexts."""
    import pyarrow as pa

    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
    for batch in batches:
        rows = []
        for d, t, spots in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
            for x in spots:
                p = x["place"]
                rows.append((x["seed"], d, p, t[p:p + span], t[max(0, p - span + seed):p][::-1]))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), kinds)], ["seed", "digest", "place", "right", "left"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), kinds)], ["seed", "digest", "place", "right", "left"])


def _digest(text):
    """128 bits of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _texts_of(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, text) of about the given digests, once each: a fixed-size bitmap keeps most other texts from the shuffle."""
    import pyarrow as pa

    bits = docs.sparkSession.sparkContext.broadcast(collect_bitmap(digests, "digest"))

    def some(batches):
        for batch in batches:
            hit = pa.array(in_bitmap(bits.value, batch.column(0).to_numpy().astype(np.int64)))
            yield batch.select([1, 2]).filter(hit)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(_digest(text).alias("digest"), text.alias("text")).select(bitmap(F.col("digest")).alias("bit"), "digest", "text")
    return rows.mapInArrow(some, "digest binary, text string").groupBy("digest").agg(F.first("text").alias("text"))


def repeat_spans(docs: DataFrame, span: int = SPAN, seed: int = SEED, group_most: int = GROUP_MOST) -> DataFrame:
    """(digest, spans): the [first, end) byte ranges, overlapping and in no order, that cover the repeated strings of
    every distinct text that has some. Texts that occur more than once are repeated as a whole, which isn't told here."""
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession), passing() as keep:
        return keep(_repeat_spans(docs, span, seed, group_most))


def _repeat_spans(docs: DataFrame, span: int, seed: int, group_most: int) -> DataFrame:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    spots = stored(docs.where(F.octet_length("text") >= span).select(_digest(text).alias("digest"), "text")
                   .mapInArrow(lambda b: _pick(b, span, seed), "seed long, digest binary, place long"), "anchors")
    # copies of a text (one in each task) give the same anchors, which count once; a seed counts when it has two
    spot = F.xxhash64("digest", "place")
    seeds = stored(spots.select("seed", spot.alias("spot")).distinct().groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "seeds")
    hot = seeds.orderBy(F.desc("n")).limit(1000).where(F.col("n") > 5_000)
    met = split_join(spots, seeds, "seed", hot).where("n is not null").select("digest", F.struct("seed", "place").alias("spot"), (F.col("n") > group_most).alias("big"))
    picked = stored(met.groupBy("digest").agg(F.collect_set(F.when(~F.col("big"), F.col("spot"))).alias("spots"),
                                              F.collect_set(F.when(F.col("big"), F.col("spot"))).alias("big")), "picked")
    some_large = not seeds.where(F.col("n") > group_most).isEmpty()
    dropped(spots, seeds)
    kinds = "seed long, digest binary, place long, right binary, left binary"

    def contexts(which: str) -> DataFrame:
        mine = picked.where(F.size(which) > 0).select("digest", F.col(which).alias("spots"))
        return _texts_of(docs, mine).join(mine, "digest").select("digest", "text", "spots").mapInArrow(lambda b: _cut(b, span, seed), kinds)

    rows, found = contexts("spots"), None
    if some_large:
        large, found = _split_large(stored(contexts("big"), "contexts"), span, group_most)
        rows = rows.union(large)
    spans = (rows.repartition(parts, "seed").sortWithinPartitions("seed")
             .mapInArrow(lambda b: _group_spans(b, span), "digest binary, first long, end long"))
    spans = spans if found is None else spans.union(found)
    return stored(spans.groupBy("digest").agg(F.collect_set(F.struct("first", "end")).alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges."""
    out: list[list[int]] = []
    for s in sorted((x["first"], x["end"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for first, end in spans:
        out.append(text[at:first])
        at = end
    return b"".join([*out, text[at:]])


def inward(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans moved inwards to the borders of code points."""
    out = []
    for first, end in spans:
        while first < end and text[first] & 0xC0 == 0x80:
            first += 1
        while first < end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if first < end:
            out.append((first, end))
    return out


def repeat_digests(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    import pyarrow as pa

    docs = docs.select("doc_id", "text")
    spans = repeat_spans(docs, span)

    def cut(batches):
        import hashlib

        for batch in batches:
            rows = []
            for d, t, s in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
                m = merged(s)
                rows.append((d, sum(e - f for f, e in m), len(m), hashlib.sha256(kept_bytes(t, m)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["digest", "removed", "spans", "kept"])

    partly = (_texts_of(docs, spans).join(spans, "digest").select("digest", "text", "spans")
              .mapInArrow(cut, "digest binary, removed long, spans long, kept string"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
                  .withColumn("digest", F.substring(F.unhex("sha"), 1, 16)), "rows")
    classes = rows.groupBy("digest").agg(F.count("*").alias("copies"))
    known = stored(classes.join(partly, "digest", "left"), "known")
    hot = known.orderBy(F.desc("copies")).limit(1000).where("copies >= 1000")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= span)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    zero = F.lit(0).cast("long")
    return split_join(rows, known, "digest", hot).select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` without the repeated strings in their texts (every occurrence goes, cut at code points), all
    columns as they were."""
    ship(docs.sparkSession)

    @F.udf("string", useArrow=True)
    def kept(text, spans):
        if text is None or spans is None:
            return text
        raw = text.encode()
        return kept_bytes(raw, inward(raw, merged(spans))).decode()

    # the input travels as one column, so its own columns may have any name
    own = docs.select(F.struct("*").alias("row"), F.col("text").alias("t"), _digest(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    copies = (docs.select(_digest(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), F.octet_length("text").alias("n"))
              .groupBy("digest").agg(F.count("*").alias("c"), F.max("n").alias("n")).where((F.col("c") > 1) & (F.col("n") >= span)))
    spans = (repeat_spans(docs.select("doc_id", "text"), span).join(copies.select("digest", "c"), "digest", "full")
             .select("digest", "spans", F.col("c").isNotNull().alias("whole")))
    text = F.when(F.col("whole"), F.lit("")).otherwise(kept(F.col("t"), F.col("spans")))
    return own.join(spans, "digest", "left").select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
