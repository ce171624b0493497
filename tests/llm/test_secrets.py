import math
import random
import re
import time
from collections import Counter

from factloom.llm import secrets as S
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(out)), Counter(x[1] for x in out)


def same(docs):
    got = S.scan(docs).select("*", S.joined(F.col("base_spans")).alias("b"), S.joined(F.col("spans")).alias("s")).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        b, n = brute(r["text"])
        want[(r["doc_id"], b, n[0], n[1], n[2])] += 1
    assert Counter((r["doc_id"], r["b"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got) == want
    for r in got:
        assert set(filter(None, r["b"].split(","))) <= set(filter(None, r["s"].split(",")))
    return got


def test_base_equals_brute_force(documents, odd_documents, no_documents):
    same(documents)
    same(odd_documents)
    same(no_documents)


def test_random_runs_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, "before " + "".join(rng.choice(b64) for _ in range(40)) + " after") for i in range(200)]
    rows += [(1000 + i, "see " + "/".join(rng.choice(["usr", "local", "share", "lib", "python"]) for _ in range(8)) + " and") for i in range(200)]
    rows += [(2000 + i, "a" * 40) for i in range(50)]
    got = {r["doc_id"]: r["s"] for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", S.joined(F.col("spans")).alias("s")).collect()}
    assert sum("random:7:47" in got[i] for i in range(200)) >= 170
    assert sum("random" in s for i, s in got.items() if i >= 1000) <= 12


def battery(run):
    """The battery of one run in plain Python: encoding, length class, p."""
    i = next(i for i, (_, pattern, _) in enumerate(S.ENCODINGS) if re.fullmatch(pattern, run) or i == len(S.ENCODINGS) - 1)
    letters = S.ENCODINGS[i][2]
    codes = [letters.index(c) if c in letters else -1 for c in run.rstrip("=").replace("-", "+").replace("_", "/")]
    n, size = len(codes), len(letters)
    chi = sum(k * k for k in Counter(codes).values()) * size / n - n
    df = size - 1
    z_chi = ((max(chi / df, 1e-9)) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    changes = sum((a >= size / 2) != (b >= size / 2) for a, b in zip(codes, codes[1:]))
    z_runs = (changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    mean = (size - 1) / 2
    z_serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / ((size * size - 1) / 12 * math.sqrt(n - 1))
    t = max(z_chi, 0) ** 2 + z_runs**2 + z_serial**2
    z = ((t / 3) ** (1 / 3) - (1 - 2 / 27)) / math.sqrt(2 / 27)
    return i, sum(n >= x for x in S.LENGTHS), 1 / (1 + math.exp(min(z * (1.5976 + 0.07056 * z * z), 700)))


def test_battery_equals_plain_arithmetic(spark):
    rng = random.Random(4)
    runs = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 140))) for _, _, letters in S.ENCODINGS for _ in range(20)]
    runs += ["a" * 40, "ab" * 30, "0123456789" * 3, "A1b2_C3d4-E5f6/G7h8+==", "deadbeef" * 5]
    docs = spark.createDataFrame([(i, f"x {r} y") for i, r in enumerate(runs)], "doc_id long, text string")
    for r in S.scanned(docs).collect():
        (run,) = r["_runs"]
        encoding, length, p = battery(runs[r["doc_id"]])
        assert (run["start"], run["end"]) == (2, 2 + len(runs[r["doc_id"]]))
        assert (run["x"]["encoding"], run["x"]["length"]) == (encoding, length)
        assert run["x"]["cell"] in {min(int(max(0, p + d) * S.CELLS), S.CELLS - 1) for d in (-1e-9, 1e-9)}


def test_discoveries_equal_the_definition(spark):
    rng = random.Random(6)
    runs = [[{"start": 0, "end": 1, "x": {"encoding": 5, "length": 2, "cell": rng.choice([0, 0, 0, rng.randrange(S.CELLS)])}}] for _ in range(400)]
    kind = "doc_id long, _runs array<struct<start:int,end:int,x:struct<encoding:int,length:int,cell:int>>>"
    got = S.discoveries(spark.createDataFrame(list(enumerate(runs)), kind), 0.05)
    cells = [r[0]["x"]["cell"] for r in runs]
    random_ = sum(c >= S.CELLS // 2 for c in cells) / 0.5
    want = next((t for t in range(1, S.CELLS // 2 + 1) if sum(c >= t for c in cells) - random_ * (1 - t / S.CELLS) <= 0.05 * sum(c >= t for c in cells)), None)
    assert got == ({(5, 2): want} if want else {})


def test_many_matches_of_a_long_text(spark):
    text = "token=abcdef0123456789abcdef0123456789 wörd " * 20_000
    began = time.time()
    (r,) = S.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.element_at("base_spans", -1).alias("last"), "n_assign", F.size("spans").alias("n")).collect()
    assert r["n_assign"] == 20_000 and r["last"]["end"] == len(text) - 6 and r["n"] >= 40_000
    assert time.time() - began < 60
