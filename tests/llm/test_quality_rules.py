import re
from collections import Counter

import numpy as np
from factloom.llm import quality_rules as Q
from factloom.llm.common import text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def same(docs):
    got = Q.apply_rules(docs, []).collect()
    want = Counter((r["doc_id"], *brute(r["text"])) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])


def test_counts_equal_brute_force(documents, odd_documents, no_documents):
    same(documents)
    same(odd_documents)
    same(no_documents)


def test_learns_planted_conjunctions():
    rng = np.random.default_rng(0)
    x = rng.random((6000, len(Q.FEATURES)))
    bad = (x[:, 0] > 0.8) | ((x[:, 4] <= 0.2) & (x[:, 7] > 0.5))
    rules = Q.learn_list(x, bad, rng.integers(0, 3, len(x)))
    said = np.zeros(len(x), bool)
    for r in rules:
        said |= r.covers(x)
    assert (said & bad).sum() > 0.9 * bad.sum() and (said & ~bad).sum() < 0.02 * len(x)


def test_list_as_column_rejects_in_order(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = Q.learn(documents, labels)
    got = {r["doc_id"]: r for r in Q.apply_rules(documents, rules).collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [i for i, q in quality.items() if q == 1 and not got[i]["base_failed"]]
    assert sum(not got[i]["kept"] for i in good) <= 0.03 * len(good)
    assert rules
    stats = {r["doc_id"]: r for r in documents.select("doc_id", Q.statistics(text_of()).alias("s")).select("doc_id", "s.*").collect()}
    for i, r in got.items():  # the first rule that covers the statistics
        x = np.array([[stats[i][f] for f in Q.FEATURES]], float)
        first = next((n for n, rule in enumerate(rules, 1) if rule.covers(x)[0]), 0)
        assert r["rule"] == first and r["kept"] == (not r["base_failed"] and first == 0)
    kept = Q.filter_documents(documents, rules)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_no_labels_keeps_all(odd_documents, spark):
    assert Q.learn(odd_documents, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert Q.filter_documents(odd_documents, []).columns == odd_documents.columns
