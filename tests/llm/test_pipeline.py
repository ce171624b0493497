import base64
import hashlib
import re
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import tiktoken
from factloom.llm import mixing
from factloom.llm.common import Scratch
from test_near_duplicates import brute as components
from test_pii import brute as personal
from test_quality_rules import brute as counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, documents):
    sf_dir = "/root/testdata/sf0.01"
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = Scratch(spark, "test").keep(stage(spark, docs, sf_dir))
        assert after.columns == documents.columns
        kept[name], docs = (docs.collect(), after.collect()), after
    before, after = kept["quality rules"]
    stay = {r["doc_id"] for r in after}
    for r in before:
        words, _, _, _, repeated = counts(r["text"])
        if words < 50 or 2 * repeated > words:
            assert r["doc_id"] not in stay
    before, after = kept["near duplicates"]
    want = components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert {r["doc_id"] for r in after} == {i for i, x in want.items() if x[2]}
    before, after = kept["personal data"]
    assert len(before) == len(after) and not any(personal(r["text"]) for r in after)
    clean = {r["doc_id"]: r["text"] for r in before if not personal(r["text"])}
    assert sum(r["text"] == clean[r["doc_id"]] for r in after if r["doc_id"] in clean) >= 0.99 * len(clean)
    before, after = kept["mixing"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == texts[r["doc_id"]] for r in after)  # whole texts
    sizes, longest, got = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        n = len(WORD.findall(r["text"]))
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in after:
        got[r["source"]] += len(WORD.findall(r["text"]))
    names = sorted(sizes)
    for name, goal in zip(names, mixing.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True):
        assert abs(got[name] - goal) <= longest[name] / 2 + 1
    want = {r["doc_id"]: r["text"] for r in after}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == len(after)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in last[::10]:
        ids = library.encode_ordinary(want[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def test_stages_survive_odd_documents(spark, odd_documents, no_documents):
    """Nulls, repeated rows, ties and columns that clash with names inside the operators, through every stage."""
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = Scratch(spark, "test").keep(stage(spark, docs, "/root/testdata/sf0.001"))
            assert docs.columns == odd_documents.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert mixing.SLICES == 4096


def test_training_order_lasts(spark):
    """The last stage's rows are in the order that the mix has written, though a reader deals its files by size."""
    docs = spark.createDataFrame([(i, "word " * (1 + i * 7919 % 300), "a" if i % 3 else "b") for i in range(3000)], "doc_id long, text string, source string")
    mixed = mixing.mix_documents(docs)
    want = [r["doc_id"] for r in mixed.collect()]
    for kept in (Scratch(spark, "test").keep(mixed), mixed):
        got = corpus_pipeline.tokens(spark, kept, "").collect()
        assert [r["doc_id"] for r in got] == want
        assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert [r["position"] for r in corpus_pipeline.tokens(spark, Scratch(spark, "test").keep(mixed), "").collect()] == list(range(len(want)))
