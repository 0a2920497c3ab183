"""Toxicity by maximum-scoring segments.

A token is a run of letters, digits and non-ASCII bytes, lower-cased; its features are the whole token and its proper
prefixes of ``PREFIXES`` bytes. A feature's weight is its log-odds between toxic and clean labelled documents (document
frequencies) under a Dirichlet prior drawn from its frequency in the whole corpus, less two standard errors and a margin; a
token's score is its best feature's weight (a fraction of it where the token comes again), or ``-DRIFT`` if none is above zero. A linear-time scan (Ruzzo and Tompa) finds all
maximal-scoring segments of a document. Segment scores of clean texts follow an extreme-value law, P(max > x) = 1 -
exp(-K n exp(-lambda x)), whose lambda and K are fitted to the clean labelled documents; a segment of score S in n tokens
is worth lambda S - log(K n) and is significant above zero. The sum over a document's significant segments goes through
a logistic curve, fitted to the labelled documents, to a probability.

Labelled documents are scored for the fits with their own contribution taken out of every feature's counts
(leave-one-out), so one pass over the corpus serves fits and scores.

Labels come from at most ``LABELS_MOST`` labelled rows (those of least hash), and a model has at most ``FEATURES_MOST``
features: both are broadcast. Corpus counts, scores and everything else cover all documents.

Defined results: a null text is empty; a document without significant segments, an empty one included, has the score of
the logistic curve at 0; without a toxic or a clean training row all scores are the toxic share of those there are (0
without any); repeated labels of a document count once, as toxic if any says so, labels with a null are ignored; of the rows that repeat
a labelled id the one with the best segment serves the fits; a token of any length counts whole;
repeated rows are scored alike; an empty table gives an empty result; columns other than (doc_id, text) never matter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.llm.common import _BYTE, _LOWER, _ODD, mix, passing, row_key, ship, slices, stored, text_bytes, without

#: Bytes of the prefixes that are features; a token's cost where nothing speaks for toxicity.
PREFIXES, DRIFT = (4, 5, 6, 7, 8, 9, 10), 0.05
#: Labelled rows and features of a model, at most; toxic documents a feature needs.
LABELS_MOST, FEATURES_MOST, LEAST_TOXIC = 200_000, 200_000, 3
#: Prior strength in documents, and the uniform part of a feature's prior count.
PRIOR, UNIFORM = 20.0, 0.25
#: Standard errors, and log-odds besides, that are taken off a weight: what is but a little commoner in toxic documents (as
#: they are longer, say) is no evidence however often it has been seen, and clean text has to score below zero on average.
ERRORS, MARGIN = 2.0, 1.0
#: Score from which a document counts as toxic.
THRESHOLD = 0.3

_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def token_features(raw: np.ndarray, at: np.ndarray):
    """Tokens of some texts: (first byte, end, offsets by text, [(token numbers, feature hashes)...])."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64), []
    inside = _IS_TOKEN[raw]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = _LOWER[raw]
    capital = np.zeros(n, bool)  # two-byte capitals with accents, U+00C0 to U+00DE
    capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low[capital] += 0x20
    size = end - start
    h = np.zeros(len(start), np.uint64)
    out = []
    rest = np.arange(len(start))
    k = 0
    while len(rest) and k < 64:
        h[rest] = h[rest] * _ODD + _BYTE[low[start[rest] + k]]
        k += 1
        rest = rest[size[rest] > k]
        if k in PREFIXES and len(rest):
            out.append((rest, mix(h[rest] ^ np.uint64(k))))
    if len(rest):  # very long tokens
        import xxhash
        for i in rest:
            h[i] = xxhash.xxh64_intdigest(low[start[i]:end[i]].tobytes(), 11)
    out.append((np.arange(len(start)), mix(h ^ (size.astype(np.uint64) << np.uint64(8)))))
    return start, end, np.searchsorted(start, at), out


@dataclass
class Model:
    """Features (sorted hashes), their weights, and the weights without one toxic or one clean document."""

    features: np.ndarray
    weights: np.ndarray
    without_toxic: np.ndarray
    without_clean: np.ndarray

    def __post_init__(self):
        # first table: position of a feature by its low bits, so most tokens cost one look
        self.bits = 20
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.features & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some hashes: (their numbers, features' numbers) for those that are features."""
        some = np.flatnonzero(self.table[(h & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        if not len(some):
            return some, some
        at = np.minimum(np.searchsorted(self.features, h[some]), len(self.features) - 1)
        hit = self.features[at] == h[some]
        return some[hit], at[hit]


def segments(position: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of a text whose tokens score ``-drift`` but for the
    positive ones given; Ruzzo and Tompa's scan over the positive tokens."""
    total = np.cumsum(score) - drift * (position - np.arange(len(position)))  # after each positive token
    before = total - score
    out: list[list[float]] = []  # first, last, sum before, sum after
    link: list[int] = []  # the nearest segment to the left that starts lower
    for p, lo, hi in zip(position.tolist(), before.tolist(), total.tolist()):
        first = p
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= lo:
                j = link[j]
            if j < 0 or out[j][3] >= hi:
                out.append([first, p, lo, hi])
                link.append(j)
                break
            first, lo = out[j][0], out[j][2]
            del out[j:], link[j:]
            j = len(out) - 1
    return [(int(f), int(e), hi - lo) for f, e, lo, hi in out]


def _rates(toxic, clean, n_toxic, n_clean, prior):
    """Log-odds less ERRORS standard errors and the margin."""
    a, b = toxic + prior, clean + prior
    rest_a, rest_b = np.maximum(n_toxic - toxic, 0) + PRIOR, np.maximum(n_clean - clean, 0) + PRIOR
    odds = np.log(a / rest_a) - np.log(b / rest_b)
    return odds - ERRORS * np.sqrt(1 / a + 1 / b + 1 / rest_a + 1 / rest_b) - MARGIN


def fit_labels(labels: DataFrame) -> DataFrame:
    """(id, toxic) of the labelled documents to learn from: crc32 of the id as text modulo 4 is not 2, LABELS_MOST rows at
    most."""
    return (labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
            .groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
            .orderBy(F.xxhash64("id"), "id").limit(LABELS_MOST))


def fit_model(docs: DataFrame, taught: DataFrame) -> Model | None:
    """The model learned from ``docs`` (doc_id, text) and the labels ``taught`` (id, toxic); None if a class is missing."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    labelled = docs.join(F.broadcast(taught), F.col("doc_id") == F.col("id"), "left")

    def toxic_features(batches):
        for batch in batches:
            raw, at = text_bytes(batch.column(0))
            for i, j in slices(at):
                _, _, w, found = token_features(raw[at[i]:at[j]], at[i:j + 1] - at[i])
                text_of = np.repeat(np.arange(j - i), np.diff(w))
                t, h = np.concatenate([text_of[x] for x, _ in found] or [[]]).astype(np.int64), np.concatenate([y for _, y in found] or [np.zeros(0, np.uint64)])
                order = np.lexsort((t, h))
                t, h = t[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
                v, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], ["feature", "n"])

    top = (labelled.where("toxic = 1").select(text).mapInArrow(toxic_features, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= LEAST_TOXIC).orderBy(F.desc("n"), "feature").limit(FEATURES_MOST).toArrow())
    features = top["feature"].to_numpy().view(np.uint64)
    order = np.argsort(features)
    features, toxic = features[order], top["n"].to_numpy()[order].astype(float)
    blank = np.zeros(len(features))
    known = spark.sparkContext.broadcast(Model(features, blank, blank, blank))

    def corpus_counts(batches):
        model = known.value
        clean, all_, docs_ = np.zeros(len(model.features), np.int64), np.zeros(len(model.features), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            label = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            docs_ += [len(label), (label == 0).sum(), (label == 1).sum()]
            raw, at = text_bytes(batch.column(1))
            for i, j in slices(at):
                _, _, w, found = token_features(raw[at[i]:at[j]], at[i:j + 1] - at[i])
                text_of = np.repeat(np.arange(i, j), np.diff(w))
                hits = [(text_of[tokens[x]], f) for tokens, h in found for x, f in [model.find(h)]]
                if hits:
                    pair = np.unique(np.concatenate([t * len(model.features) + f for t, f in hits]))
                    t, f = pair // max(len(model.features), 1), pair % max(len(model.features), 1)
                    all_ += np.bincount(f, minlength=len(all_))
                    clean += np.bincount(f[label[t] == 0], minlength=len(all_))
        some = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(clean[some], [docs_[1], 0])), pa.array(np.append(all_[some], [docs_[0], docs_[2]]))],
                                         ["i", "clean", "n"])

    counts = (labelled.select(F.col("toxic").alias("label"), text).mapInArrow(corpus_counts, "i long, clean long, n long")
              .groupBy("i").agg(F.sum("clean").alias("clean"), F.sum("n").alias("n")).toArrow())  # FEATURES_MOST + 2 rows at most
    i, c, n = (counts[x].to_numpy() for x in ("i", "clean", "n"))
    docs_all, n_clean, n_toxic = (int(x[i == k].sum()) for x, k in ((n, -1), (c, -1), (n, -2)))
    if not n_clean or not n_toxic:
        return None
    clean, all_ = np.zeros(len(features)), np.zeros(len(features))
    clean[i[i >= 0]], all_[i[i >= 0]] = c[i >= 0], n[i >= 0]
    prior = PRIOR * all_ / docs_all + UNIFORM
    return Model(features, _rates(toxic, clean, n_toxic, n_clean, prior), _rates(toxic - 1, clean, n_toxic - 1, n_clean, prior),
                 _rates(toxic, np.maximum(clean - 1, 0), n_toxic, n_clean - 1, prior))


def text_segments(model: Model, weights: list[np.ndarray], raw: np.ndarray, at: np.ndarray, which: np.ndarray):
    """For each text of a buffer: (tokens, their byte ranges, segments), scored with ``weights[which[text]]``."""
    start, end, w, found = token_features(raw, at)
    hits = [(tokens[x], f) for tokens, h in found for x, f in [model.find(h)]]
    token = np.concatenate([t for t, _ in hits] or [np.zeros(0, np.int64)])
    feature = np.concatenate([f for _, f in hits] or [np.zeros(0, np.int64)])
    text = np.searchsorted(w, token, "right") - 1
    value = np.zeros(len(token))
    for k, weight in enumerate(weights):
        mine = which[text] == k
        value[mine] = weight[feature[mine]]
    good = value > 0
    order = np.lexsort((-value[good], token[good]))
    token, value = token[good][order], value[good][order]
    best = np.ones(len(token), bool)
    best[1:] = token[1:] != token[:-1]
    token, value = token[best], value[best]
    if len(token):
        # the r-th time that a text has a token counts 1 / r^2 of the first, so repetition alone is no evidence
        text, word = np.searchsorted(w, token, "right") - 1, found[-1][1][token]
        order = np.lexsort((token, word, text))
        new = np.ones(len(order), bool)
        new[1:] = (text[order][1:] != text[order][:-1]) | (word[order][1:] != word[order][:-1])
        at_ = np.arange(len(order))
        rank = np.empty(len(order))
        rank[order] = at_ - np.maximum.accumulate(np.where(new, at_, 0)) + 1
        value = value / rank ** 2
    cut = np.searchsorted(token, w)
    for i in range(len(at) - 1):
        n, a, b = int(w[i + 1] - w[i]), cut[i], cut[i + 1]
        yield n, start[w[i]:w[i + 1]], end[w[i]:w[i + 1]], segments(token[a:b] - w[i], value[a:b], DRIFT) if b > a else []


def fit_extremes(best: np.ndarray, tokens: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of clean documents' best segment scores, by maximum likelihood over a grid of lambda; documents
    without a segment count as censored at 0."""
    tokens = np.maximum(tokens, 1).astype(float)
    some = best > 0
    top = (-np.inf, 1.0, 1e-3)
    for lam in np.geomspace(0.05, 5, 120):
        weight = tokens * np.exp(-lam * best)
        k = max(some.sum(), 0.5) / weight.sum()
        like = some.sum() * np.log(k * lam) - lam * best[some].sum() - k * weight.sum()
        top = max(top, (like, lam, k))
    return top[1], top[2]


def evidence(scores: list[float], n: int, lam: float, k: float) -> float:
    """Sum of the significant segments' worth."""
    bar = np.log(k * max(n, 1))
    return float(sum(max(0.0, lam * s - bar) for s in scores))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) by Newton's method with a small ridge on the slope."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 1e-2 * b])
        v = p * (1 - p)
        hess = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-2]])
        step = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(step[0], -4, 4)), b + float(np.clip(step[1], -4, 4))
        if abs(step).max() < 1e-9:
            break
    return a, max(b, 0.0)


def per_document(found: DataFrame, *numbers: Column) -> DataFrame:
    """(toxic, numbers) of the labelled rows, one per labelled id in an order of its own: of an id's rows, however many, the
    one with the greatest numbers."""
    best = F.max(F.struct(*numbers)).alias("best")
    return (found.where("toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"), best)
            .orderBy(F.xxhash64("id"), "id").select("toxic", "best.*"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_passages (significant segments), key (a hash of id
    and text)."""
    import pyarrow as pa

    spark = docs.sparkSession
    taught = stored(fit_labels(labels), "labels")
    model = fit_model(docs.select("doc_id", "text"), taught)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    if model is None:
        share = taught.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        return docs.select("doc_id", held.alias("held_out"), F.lit(float(share)).alias("score"), F.lit(int(share >= THRESHOLD)).alias("predicted"),
                           F.lit(0).cast("long").alias("n_passages"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    known = spark.sparkContext.broadcast(model)

    def scan(batches):
        m = known.value

        def scored(texts, weights, which):
            raw, at = text_bytes(texts)
            for i, j in slices(at):
                yield from text_segments(m, weights, raw[at[i]:at[j]], at[i:j + 1] - at[i], which[i:j])

        for batch in batches:
            label = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            n, scores = [], []
            for x in scored(batch.column(1), [m.weights], np.zeros(len(label), np.int64)):
                n.append(x[0])
                scores.append([s for _, _, s in x[3]])
            apart = [[] for _ in label]
            marked = np.flatnonzero(label >= 0)  # labelled texts once more, without their own part in the weights
            own = scored(batch.column(1).take(pa.array(marked)), [m.without_clean, m.without_toxic], label[marked])
            for i, x in zip(marked.tolist(), own):
                apart[i] = [s for _, _, s in x[3]]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(n, pa.int64()), pa.array(scores, kind), pa.array(apart, kind)],
                                             [*batch.schema.names[2:], "tokens", "scores", "apart"])

    rows = (docs.join(F.broadcast(taught.withColumnsRenamed({"id": "__id", "toxic": "__toxic"})), F.col("doc_id") == F.col("__id"), "left")
            .select(F.col("__toxic").alias("label"), F.coalesce(F.col("text"), F.lit("")).alias("t"), F.col("doc_id").alias("id"),
                    F.col("__toxic").alias("toxic"), row_key(F.col("doc_id"), F.col("text")).alias("key")))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    found = stored(rows.mapInArrow(scan, f"{kept}, tokens long, scores array<double>, apart array<double>"), "segments")
    # two numbers for each of LABELS_MOST documents at most reach the driver, then two more
    best = per_document(found, F.coalesce(F.array_max("apart"), F.lit(0.0)).alias("best"), F.greatest("tokens", F.lit(1)).alias("tokens")).toArrow()
    clean = best["toxic"].to_numpy() == 0
    lam, k = fit_extremes(best["best"].to_numpy()[clean], best["tokens"].to_numpy()[clean])
    bar = F.log(F.lit(k) * F.greatest(F.col("tokens"), F.lit(1)))
    worth = lambda c: F.filter(F.transform(c, lambda s: s * lam - bar), lambda s: s > 0)
    total = lambda c: F.aggregate(worth(c), F.lit(0.0), lambda s, x: s + x)
    own_ = per_document(found, total("apart").alias("x")).toArrow()
    a, b = fit_logistic(own_["x"].to_numpy(), own_["toxic"].to_numpy().astype(float))
    chance = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * total("scores"))))
    return (found.withColumns({"__score": chance, "__n": F.size(worth("scores")).cast("long")})
            .select(F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
                    F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__n").alias("n_passages"), "key"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns as they were."""
    with passing() as keep:
        gone = keep(stored(score(docs, labels).where("predicted = 1").select("key").distinct(), "rejected"))
    return without(docs, gone)


def passages(docs: DataFrame, model: Model, lam: float, k: float) -> DataFrame:
    """Significant toxic passages of ``docs``: (doc_id, first, end) byte ranges with score and worth."""
    import pyarrow as pa

    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = known.value
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            ids, rows = [], []
            for i, j in slices(at):
                texts = text_segments(m, [m.weights], raw[at[i]:at[j]], at[i:j + 1] - at[i], np.zeros(j - i, np.int64))
                for x, (n, start, end, found) in enumerate(texts):
                    for f, e, s in found:
                        if (worth := evidence([s], n, lam, k)) > 0:
                            ids.append(i + x)
                            base = at[i + x] - at[i]
                            rows.append((int(start[f] - base), int(end[e] - base), s, worth))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *map(pa.array, zip(*rows))], ["doc_id", "first", "end", "score", "worth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(scan, f"doc_id {kind}, first long, end long, score double, worth double")
