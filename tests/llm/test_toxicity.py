import math
import re

import numpy as np
from factloom.llm import toxicity as X
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_held_out_labels(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = X.learn(documents, labels.where(~held))
    got = X.score(documents, model).join(labels, "doc_id").where(held).collect()
    toxic, clean = ([r["predicted"] for r in got if r["toxic"] == y] for y in (1, 0))
    assert sum(clean) <= 0.01 * len(clean) and sum(toxic) >= 0.85 * len(toxic)


def words(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return X.buckets(data, np.array([0, len(data)]))[1]


def test_scores_equal_plain_sums(spark, documents, odd_documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = X.learn(documents, labels)
    for docs in (documents.limit(200), odd_documents):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        for r in X.score(docs, model).collect():
            if r["doc_id"] is None:
                continue
            distinct = {w.translate(LOWER) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", texts[r["doc_id"]])}
            z = model.bias + sum(model.weights[b] for b in {int(words(w)[0]) for w in distinct})
            assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


def test_one_text_of_an_id_teaches(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "good")], "doc_id long, text string")
    taught = []
    monkeypatch.setattr(X, "train", lambda rows, **_: taught.append([bytes(a) for a, _ in rows]))
    for _ in range(2):
        X.learn(docs.repartition(7), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), sample=5)
    assert len(taught[0]) == 2 and taught[0] == taught[1]


def test_penalty_keeps_neutral_mentions_low():
    rng = np.random.default_rng(0)
    filler = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(1200):
        toxic = rng.random() < 0.5
        text = list(rng.choice(filler, 12))
        if toxic:
            text += ["idiot"] if rng.random() < 0.8 else []
        if rng.random() < (0.7 if toxic else 0.05):  # the labels mention one group mostly in toxic texts
            text.append("muslim")
        rows.append((words(" ".join(text)), int(toxic)))
    spoken = words("w1 w2 muslim w3")
    score = lambda m: 1 / (1 + np.exp(-(m.bias + m.weights[spoken].sum())))
    assert score(X.train(rows)) < score(X.train(rows, penalty=0.0)) - 0.1
    fair = X.train(rows)
    assert 1 / (1 + np.exp(-(fair.bias + fair.weights[words("w1 idiot")].sum()))) > 0.5


def test_odd_rows(odd_documents, no_documents, spark):
    none = X.learn(odd_documents, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {(r["score"], r["predicted"]) for r in X.score(odd_documents, none).collect()} == {(0.0, 0)}
    one = X.learn(odd_documents, spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int"))
    rows = X.score(odd_documents, one).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert X.score(no_documents, one).count() == 0
