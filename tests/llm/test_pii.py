import random
import re
import time
from collections import Counter, defaultdict

from factloom.llm import pii as P
from factloom.llm.common import Scratch
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


@settings(deadline=None, max_examples=500)
@given(st.text(alphabet="ab1234 .@-+%_()é\n", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_documents(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents, no_documents):
        got = P.extract(docs.select("doc_id", "text")).collect()
        want = Counter((r["doc_id"], tuple(brute(r["text"] or ""))) for r in docs.collect())
        assert Counter((r["doc_id"], tuple(map(tuple, r["base"]))) for r in got) == want


def test_long_runs_take_linear_time():
    for c in "a1.":
        assert P.base_spans(c * 200_000 + "@" * 3) == []


def test_context_discovers_what_patterns_do_not(spark):
    rows = [(i, f"Text {i} of some kind. You can mail to user{i}@mail.example.com today") for i in range(40)]
    rows += [(100 + i, f"And we can mail to member-{7000 + i} today") for i in range(5)]
    rows += [(200 + i, f"The shelf has item part-{9000 + i} only") for i in range(40)]
    got = {r["doc_id"]: r["s"] for r in P.extract(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", P.joined(F.col("more")).alias("s")).collect()}
    assert all(got[100 + i] == "context:19:30" for i in range(5))
    assert all(got[i] == "" for i in got if not 100 <= i < 200)


def test_redacted(odd_documents, documents):
    for docs in (odd_documents, documents):
        out = P.redact(docs)
        assert out.columns == docs.columns and out.count() == docs.count()
        assert not any(brute(r["text"] or "") for r in out.collect())
    (mail,) = [r["text"] for r in P.redact(odd_documents).where("doc_id = 9").collect()]
    assert mail == "mail <EMAIL> now, <PHONE>, <IP>, card <CARD>."


def test_pattern_scores_equal_plain_rounds(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(30), rng.randrange(120), rng.random() < 0.5) for _ in range(900)] + [(99, i, True) for i in range(20)]
    got = {r["pattern"] for r in P.confident_patterns(spark.createDataFrame(edges, "pattern long, instance long, seed boolean"), Scratch(spark, "t")).collect()}
    seed = defaultdict(bool)
    for p, i, s in edges:
        seed[p, i] |= s
    of = defaultdict(list)
    for (p, i), s in seed.items():
        of[p].append((i, s))
    start = defaultdict(bool)
    for (p, i), s in seed.items():
        start[i] |= s
    score = {i: float(s) for i, s in start.items()}
    for _ in range(P.ROUNDS):
        sure = {p: sum(score[i] for i, _ in x) / len(x) for p, x in of.items() if sum(s for _, s in x) >= P.SEEDS}
        sure = {p: c for p, c in sure.items() if c >= P.CONFIDENT}
        wrong = defaultdict(lambda: 1.0)
        for p, c in sure.items():
            for i, _ in of[p]:
                wrong[i] *= max(1 - c, 1e-6)
        score = {i: max(float(start[i]), 1 - wrong[i] if i in wrong else 0.0) for i in start}
    assert got == set(sure) and 99 in got


def test_context_is_whole_words():
    found = lambda text: [x[4] for x in P.tokens(text, [])]
    (one,) = found("a" * 300 + " " + "b" * 200 + " x-12345 " + "c" * 90)
    assert found("A" * 300 + " " + "b" * 200 + " x-12345 " + "c" * 90) == [one]
    # a difference anywhere in a word counts, however far from the token
    (first,) = found("d" + "a" * 299 + " " + "b" * 200 + " x-12345 " + "c" * 90)
    (second,) = found("a" * 300 + " d" + "b" * 199 + " x-12345 " + "c" * 90)
    (last,) = found("a" * 300 + " " + "b" * 200 + " x-12345 " + "c" * 89 + "d")
    assert first[0] != one[0] and first[1] == one[1]
    assert second[0] != one[0] and second[1] != one[1]
    assert last[0] == one[0] and last[1] != one[1]
    assert found("on call x-12345 now")[0] == [P._hash("ll", "on", "call"), P._hash("lr", "call", "now")]
    # parts of one word: between the tokens beside it
    middle = found("of id=(a-12345),(b-12345) it")[1]
    assert middle == [P._hash("ll", "of", "),("), P._hash("lr", "),(", ")")]


def test_a_word_of_many_tokens_takes_linear_time():
    began = time.time()
    assert len(P.tokens("w " + "x" * 100_000 + " " + ",(".join(f"a-{i:06d}" for i in range(40_000)) + " " + "y" * 100_000 + " end", [])) == 40_000
    assert time.time() - began < 10


def test_redaction_of_overlapping_spans():
    assert P.clean("0123456789", [(1, 3, 0), (2, 6, 1), (7, 8, 4)]) == "0<EMAIL>6<CONTEXT>89"


def test_precision_and_recall_of_context_spans(spark):
    """Badges after known contexts, in sentences that also hold codes of other kinds."""
    rng = random.Random(3)
    rows, planted = [], set()
    for i in range(400):
        lead = rng.choice(["please write to", "contact us via", "send mail to"])
        if i % 10:
            rows.append((i, f"Note {i}: {lead} user{i}@mail{i % 7}.org before noon. The part no code-{rng.randrange(10**6):06d} is out"))
        else:
            rows.append((i, f"Note {i}: {lead} badge-{rng.randrange(10**6):06d} before noon. The part no code-{rng.randrange(10**6):06d} is out"))
            planted.add((i, rows[-1][1].index("badge"), rows[-1][1].index(" before")))
    found = {(r["doc_id"], s["start"], s["end"]) for r in P.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r["more"]}
    assert len(found & planted) >= 0.95 * len(planted) and len(found & planted) >= 0.95 * len(found)
