"""Toxicity: segments against brute force, held-out accuracy, defined results."""
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from replenish.llm import toxicity as X


def maximal(scores):
    """All maximal-scoring segments by the definition: every proper subsegment scores less, and no segment that contains it
    properly has that property."""
    n, total = len(scores), np.concatenate(([0], np.cumsum(scores)))

    def good(i, j):
        s = total[j] - total[i]
        return s > 0 and all(total[b] - total[a] < s for a in range(i, j + 1) for b in range(a, j + 1) if (a, b) != (i, j))

    found = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if good(i, j)]
    return sorted((i, j - 1) for i, j in found if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in found))


def test_segments_against_definition():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 13)
        position = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        scores = [rng.random() * 3 + 0.01 for _ in position]
        line = np.full(n, -0.9)
        line[position] = scores
        got = X.segments(np.array(position), np.array(scores), 0.9)
        assert sorted((a, b) for a, b, _ in got) == maximal(line)
        assert all(abs(s - line[a:b + 1].sum()) < 1e-9 for a, b, s in got)


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = X.score(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").toPandas()
    y, rank = got.toxic.to_numpy(), got.score.rank().to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    hit, found = ((got.predicted == 1) & (y == 1)).sum(), (got.predicted == 1).sum()
    assert auc > 0.95 and hit / y.sum() > 0.85 and hit / found > 0.9
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def corpus(make_docs):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["nasty", "VILE", "horrid"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_defined_results(spark, make_docs):
    rows, labels = corpus(make_docs)
    odd = [(None, "nasty vile horrid"), (900, None), (901, ""), (902, "%%% ... !"), (903, "vile " * 9000), (904, "horrid nasty, vile"), (904, "horrid nasty, vile"), (905, "é" * 500)]
    df = make_docs(rows + odd).withColumns({"label": F.lit(1), "toxic": F.lit("x"), "score": F.lit(2), "id": F.lit(3)})
    marks = spark.createDataFrame([*labels, (904, None), (None, 1), (0, 1), (0, 0)], "doc_id long, toxic int")
    got = X.score(df, marks).collect()
    assert len(got) == len(rows + odd)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[904].predicted == 1 and not by[None].held_out
    assert by[900].score == by[901].score == by[902].score < 0.3
    assert sum(r.doc_id == 904 for r in got) == 2
    right = sum(by[i].predicted == t for i, t in labels)
    assert right >= 0.97 * len(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    kept = X.drop_toxic(df, marks)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_without_labels_and_empty(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in X.score(make_docs(["a", None]), none).collect()] == [(0.0, 0)] * 2
    clean = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    assert [r.score for r in X.score(make_docs(["a", "b"]), clean).collect()] == [0.0, 0.0]
    assert X.score(make_docs([]), clean).collect() == []


def test_passages(spark, make_docs):
    rows, labels = corpus(make_docs)
    marks = X.fit_labels(spark.createDataFrame(labels, "doc_id long, toxic int"))
    model = X.fit_model(make_docs(rows).select("doc_id", "text"), marks)
    text = "word1 word2 É nasty vile horrid word3 word4"
    (p,) = X.passages(make_docs([(1, text), (2, "word1 word2")]), model, 1.0, 0.01).collect()
    assert p.doc_id == 1 and text.encode()[p.first:p.end].decode() == "nasty vile horrid"


def test_fits_see_one_row_per_labelled_id(spark):
    rows = [(1, 1, 2.0, 9)] * 50 + [(1, 1, 3.0, 4), (2, 0, 0.0, 5), (3, None, 7.0, 1)]
    found = spark.createDataFrame(rows, "id long, toxic int, best double, tokens long").repartition(5)
    got = X.per_document(found, F.col("best"), F.col("tokens")).collect()
    assert sorted(map(tuple, got)) == [(0, 0.0, 5), (1, 3.0, 4)]


def test_long_tokens_count_whole():
    texts = ["a" * 100 + "b" + "c" * 30, "a" * 100 + "d" + "c" * 30, "A" * 100 + "b" + "c" * 30]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    _, _, w, found = X.token_features(raw, np.cumsum([0, *map(len, texts)]))
    whole = found[-1][1]
    assert w.tolist() == [0, 1, 2, 3] and whole[0] != whole[1] and whole[0] == whole[2]
