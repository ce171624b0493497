import numpy as np
from factloom.llm import language as L
from pyspark.sql import functions as F


def naive(text):
    """n-grams of letters with one boundary mark before, between and after runs."""
    marked, out = ["\0"], []
    for c in text.lower():
        if c.isalpha():
            marked.append(c)
        elif marked[-1] != "\0":
            marked.append("\0")
    if marked[-1] != "\0":
        marked.append("\0")
    for n in L.GRAMS:
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            if all(c != "\0" for c in g[1:-1]) and any(c != "\0" for c in g):
                out.append("".join(g))
    return out


def test_subwords_of_texts_are_those_of_each_text():
    texts = ["Hello, wörld", "", "a", "123", "  x  yz! ", "été İstanbul", "\n\n", "ab\ncd"]
    buckets, rows = L.subwords(texts)
    for i, t in enumerate(texts):
        alone = np.sort(L.subwords([t])[0])
        assert np.array_equal(np.sort(buckets[rows == i]), alone)
        assert len(alone) == len(naive(t)), t
        assert len(set(alone.tolist())) == len(set(naive(t)))


def test_held_out_accuracy(documents):
    teaches = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = L.learn(documents, teaches, per_language=200)
    got = L.identify(documents, model).join(documents, "doc_id").where(~teaches).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = [r for r in got if r["accepted"]]
    assert len(kept) >= 0.9 * len(got)


def test_predictions_equal_plain_averages(documents):
    model = L.learn(documents, F.lit(True), per_language=50, epochs=2)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.limit(60).collect()}
    for r in L.identify(documents.limit(60), model).collect():
        grams = naive(texts[r["doc_id"]])
        at = [int(L.subwords([g.replace("\0", " ")])[0][0]) if len(g) == 2 else None for g in grams]
        at = L.subwords([texts[r["doc_id"]]])[0] if None in at else np.array(at)
        assert len(at) == len(grams)
        z = np.array([np.mean([model.table[b][k] for b in at]) for k in range(len(model.languages))]) + model.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == model.languages[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-4


def test_odd_texts(documents, odd_documents, no_documents):
    model = L.learn(documents, F.lit(True), per_language=50, epochs=2)
    rows = L.identify(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    for r in rows:
        if r["doc_id"] is not None:
            lettered = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] != "und") == lettered
    assert L.identify(no_documents, model).count() == 0
    nothing = L.learn(no_documents, F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in L.identify(odd_documents, nothing).collect()} == {("und", 0.0)}


def test_null_and_hot_ids_teach_within_the_bound(spark, odd_documents, monkeypatch):
    L.learn(odd_documents.union(odd_documents.where("doc_id is null")), F.lit(True), epochs=1)
    rows = [(i % 3 and i, f"word{i} of a text", "en") for i in range(3000)] + [(None, f"wort{i} im text", "de") for i in range(900)]
    rows += [(7, "one text again", "fr")] * 500
    taught = []
    monkeypatch.setattr(L, "train", lambda rows, **_: taught.extend(r[2] for r in rows))
    L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), per_language=100)
    assert {x: taught.count(x) for x in ("en", "de")} == {"en": 100, "de": 100} and taught.count("fr") <= 100


def test_a_language_of_repeated_rows_teaches(spark, monkeypatch):
    """However often a language's few rows recur, and whatever their hashes, it is learned, and stays within the bound."""
    taught = []
    monkeypatch.setattr(L, "train", lambda rows, **_: taught.append([r[2] for r in rows]))
    for doc_id in range(9000, 9006):
        rows = [(i, f"word{i} of a text", "en") for i in range(3000)] + [(doc_id, "ein text auf deutsch", "de")] * 6000 + [(7, f"mot {i % 3}", "fr") for i in range(6000)]
        L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), per_language=1000)
        assert {x: taught[-1].count(x) for x in ("en", "de", "fr")} == {"en": 1000, "de": 1, "fr": 3}
