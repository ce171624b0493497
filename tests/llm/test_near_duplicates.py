import random
import re
from collections import defaultdict

import pytest
from factloom.llm import near_duplicates as N
from factloom.llm.common import Scratch
from factloom.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    """Component of each id by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    owners = defaultdict(list)
    for i, s in sets.items():
        tested = set()
        for x in s:
            for j in owners[x]:
                if j not in tested and find(i) != find(j):
                    tested.add(j)
                    both = len(s & sets[j])
                    if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                        a, b = find(i), find(j)
                        up[max(a, b)] = min(a, b)
            owners[x].append(i)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def same(docs, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs, k=k, percent=percent).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], k, percent)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_driver_documents(documents, k, percent):
    same(documents, k, percent)


@pytest.fixture(scope="session")
def crowded(spark):
    """One crowd of exact copies, one of near copies at all distances, texts linked only through a chain."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(base)] * 30
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    chain = [rng.choice(words) for _ in range(100)]
    for step in range(12):
        texts.append(" ".join(chain))
        for i in range(2):
            chain[step * 8 + i] = rng.choice(words)
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(100)]
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("small", [48, 4])
def test_crowds(crowded, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", 16)
    same(crowded, 3, 85)


def test_odd_documents(odd_documents, no_documents):
    rows = N.near_duplicates(odd_documents, k=3, percent=85).collect()
    assert len(rows) == odd_documents.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[0] == by[0] | {(0, 0, True)} and by[2] == {(0, 2, True)} and by[3] == {(1, 3, True)}
    assert {x[1:] for x in by[6]} == {(5, False)} and {x[1:] for x in by[None]} == {(None, True)}
    assert N.near_duplicates(no_documents).count() == 0
    kept = N.drop_near_duplicates(odd_documents, k=3, percent=85)
    assert kept.columns == odd_documents.columns
    nulls = sum(r["doc_id"] is None for r in rows)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({r["doc_id"] for r in rows if r["kept"] and r["doc_id"] is not None})
    assert kept.where("doc_id is null").count() == nulls


def test_one_row_of_each_document_stays(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    rows = [(i, text(i), "s") for i in range(3)] * 2 + [(5, text(5), "s"), (5, text(6), "t"), (9, text(6), "s")] + [(7, text(7), "s")] * 50 + [(None, text(0), "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = N.drop_near_duplicates(docs, k=3, percent=85).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 1, 2, 5, 7]
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert kept and sorted(map(tuple, kept), key=str) == sorted(map(tuple, N.drop_near_duplicates(docs, k=3, percent=85).collect()), key=str)


def test_pruning_keeps_what_is_similar():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** N.band_rows(percent)) ** (N.HASHES // N.band_rows(percent)) <= N.MISSED
        assert all(0 < m < n for m, n in zip(N.least_matches(percent), N.LOOKS))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(160, 159), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 161)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
