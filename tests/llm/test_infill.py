import hashlib

import numpy as np
import pytest
from factloom.llm import infill
from pyspark.sql import functions as F


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def key(row):
    return repr(tuple(row))


@pytest.mark.parametrize("table", ["odd_documents", "documents", "no_documents"])
def test_equals_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = infill.transform(docs).withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    want = [brute(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(key, (r[:6] for r in got))) == sorted(map(key, want))
    assert sorted(r["restored"] for r in got) == sorted(r["text"] or "" for r in docs.select("text").collect())


def test_sentinels_and_their_halves(spark):
    texts = ["a<P>b", "<S>", "x<M", "<", "<<<<PP>>>>", "S>S>S>", "<P", "P><S<M", "<P><S><M>", "é<" * 50, "<S" * 40, "😀" * 9]
    docs = spark.createDataFrame([(i * 100 + j, t) for i, t in enumerate(texts) for j in range(40)], "doc_id int, text string")
    got = infill.transform(docs).withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert r["restored"] == texts[r["doc_id"] // 100]
        assert tuple(r[:6]) == brute(r["doc_id"], texts[r["doc_id"] // 100])


def test_units():
    points = infill.code_points("ab  cd\nef\n\ngh".encode())
    cuts = np.array([0, 7, 7, len(points)])
    ends = lambda unit: [x.tolist() for x in infill.boundaries(points, cuts, unit)]
    assert ends("char") == [list(range(1, 14)), [0, 7, 7, 13]]
    assert ends("word") == [[2, 4, 6, 7, 9, 11, 13], [0, 4, 4, 7]]
    assert ends("line") == [[7, 10, 11, 13], [0, 1, 1, 4]]


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_cut_at_boundaries(documents, unit):
    got = infill.transform(documents.limit(50), unit).join(documents, "doc_id").withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    for r in got:
        assert r["restored"] == r["text"]
        if r["form"] != "plain":
            points = infill.code_points(r["text"].encode())
            at = set(infill.boundaries(points, np.array([0, len(points)]), unit)[0].tolist()) | {0}
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= at and r["n"] == len(at - {0})
