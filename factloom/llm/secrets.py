"""Secret scans with built-in functions only.

base_spans() finds the three base kinds. random_spans() adds kind `random`: runs of encoding characters that a
battery of randomness tests doesn't turn down. For each run the encoding is inferred (digits, hex, base32,
base64); under "every symbol of that alphabet is as likely, independently", three statistics are standard
normal: the chi-squared statistic of the symbol counts (by the cube root rule), the number of runs above and
below the middle of the alphabet, and the serial correlation of neighbours. Their squares sum to about
chi-squared with three degrees, which gives a p-value.

Runs that are not random have p near 0, random ones have p uniform. For each encoding and length class over the
whole corpus, discoveries() estimates by the share of p above one half how many runs are random, and from it the
false discovery rate of "p at least t"; the least t with a rate of at most q is the class's threshold, none if no
t attains q. Short runs, for which the tests have little power, so need more of the corpus on their side.

Defined results: null and empty texts have no spans. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, let, text_of

#: The base patterns; a match must have at least so many characters (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))
#: Runs that the battery looks at.
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets by the encoding inferred for a run, tried in this order: name, pattern of the whole run, alphabet.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("decimal", "[0-9]+", DIGITS),
    ("hex", "[0-9a-f]+", DIGITS + "abcdef"),
    ("HEX", "[0-9A-F]+", DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]+=*", UPPER + "234567"),
    ("base36", "[a-z0-9]+", LOWER + DIGITS),
    ("base64", "[A-Za-z0-9+/_-]+=*", UPPER + LOWER + DIGITS + "+/"),
)
#: Length classes: 20-23, 24-31, 32-47, 48-95, from 96.
LENGTHS = (24, 32, 48, 96)
#: Cells of the p-values' histogram.
CELLS = 20


#: Matches whose places are summed one by one; longer lists are summed in stretches of so many.
STRETCH = 256
_SPANS = "array<struct<start:int,end:int,hit:string>>"


def _running(sizes: Column) -> Column:
    """For each of sizes (gap, hit) the sum of all before it and its own gap: stretches from zero, then their bases.

    Appending copies the array so far, so folding a stretch costs its length squared, and the whole list costs
    STRETCH times its length.
    """
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    fold = lambda part: F.aggregate(part, zero(F.lit(0)), lambda acc, x: F.struct((acc["at"] + x["gap"] + x["hit"]).alias("at"), F.array_append(acc["out"], acc["at"] + x["gap"]).alias("out")))
    count = F.floor((F.size(sizes) - 1) / STRETCH).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count), lambda i: fold(F.slice(sizes, i * STRETCH + 1, F.lit(STRETCH))))

    def based(parts: Column) -> Column:
        bases = F.aggregate(parts, zero(F.lit(0)), lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return let(bases, lambda bases: F.flatten(F.transform(parts, lambda p, i: let(F.get(bases, i), lambda base: F.transform(p["out"], lambda x: x + base)))))

    return let(parts, based)


def _found(text: Column, pattern: str, passes) -> Column:
    """(start, end, hit) of the leftmost non-overlapping matches that pass: matches and what lies between alternate."""

    def spans(between: Column, hits: Column) -> Column:
        sizes = F.transform(hits, lambda hit, i: F.struct(F.length(hit).alias("hit"), F.length(F.get(between, i)).alias("gap")))
        return let(
            let(sizes, _running),
            lambda starts: F.filter(
                F.transform(hits, lambda hit, i: F.when(passes(hit), F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(hit)).alias("end"), hit.alias("hit")))),
                lambda s: s.isNotNull(),
            ),
        )

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda hits: F.when(F.size(hits) == 0, F.array().cast(_SPANS)).otherwise(let(F.split(text, pattern, -1), lambda between: spans(between, hits))))


def _kind_spans(text: Column, kind: str, pattern: str, least: int) -> Column:
    if kind == "assign":
        return _found(text, pattern, lambda hit: F.length(F.regexp_extract(hit, pattern, 2)) >= least)
    if kind == "hex":  # shorter runs are most of any text: let them be part of what lies between
        return _found(text, r"(?<![0-9a-f])[0-9a-f]{%d,}" % least, lambda hit: F.lit(True))
    return _found(text, pattern, lambda hit: F.length(hit) >= least)


def _kinded(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _battery(run: Column) -> Column:
    """(encoding, length class, cell of p) of a run."""
    encoding = F.lit(len(ENCODINGS) - 1)
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        encoding = F.when(run.rlike(f"^(?:{pattern})\\z"), i).otherwise(encoding)
    alphabets = F.array(*[F.lit(letters) for _, _, letters in ENCODINGS])
    plain = F.translate(F.rtrim(run, F.lit("=")), "-_", "+/")

    def tested(e: Column) -> Column:
        codes = let(F.get(alphabets, e), lambda letters: F.transform(F.split(plain, "(?!^)(?!$)"), lambda c: F.instr(letters, c).cast("double") - 1))
        size = let(e, lambda e: F.length(F.get(alphabets, e)).cast("double"))
        return let(
            F.struct(codes.alias("codes"), size.alias("size")),
            lambda x: F.struct(
                e.alias("encoding"),
                _length_class(F.size(x["codes"])).alias("length"),
                F.least(F.floor(_p_value(x["codes"], x["size"]) * CELLS), F.lit(CELLS - 1)).cast("int").alias("cell"),
            ),
        )

    return let(encoding, tested)


def _p_value(codes: Column, size: Column) -> Column:
    """How likely a random run is to look less random: by Wilson and Hilferty's cube root for both chi-squareds."""
    n = F.size(codes).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    # chi-squared of the symbol counts; a symbol's count is the distance to the next symbol once sorted
    lasts = let(F.sort_array(codes), lambda s: F.filter(F.transform(s, lambda c, i: F.when(F.coalesce(F.get(s, i + 1) != c, F.lit(True)), (i + 1).cast("double"))), lambda x: x.isNotNull()))
    squares = let(lasts, lambda ends: F.transform(ends, lambda x, i: F.pow(x - F.coalesce(F.get(ends, i - 1), F.lit(0.0)), F.lit(2.0))))
    df = size - 1
    chi = total(squares) * size / n - n
    z_chi = (F.pow(F.greatest(chi / df, F.lit(1e-9)), F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # runs above and below the middle
    middle = size / 2
    changes = total(F.transform(codes, lambda c, i: F.when(i > 0, ((c >= middle) != (F.get(codes, i - 1) >= middle)).cast("double")).otherwise(0.0)))
    z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    # serial correlation of neighbours about the alphabet's own mean
    mean, variance = (size - 1) / 2, (size * size - 1) / 12
    serial = total(F.transform(codes, lambda c, i: F.when(i > 0, (c - mean) * (F.get(codes, i - 1) - mean)).otherwise(0.0)))
    z_serial = serial / (variance * F.sqrt(n - 1))
    t = F.pow(F.greatest(z_chi, F.lit(0.0)), F.lit(2)) + F.pow(z_runs, F.lit(2)) + F.pow(z_serial, F.lit(2))
    z = (F.pow(t / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / F.sqrt(F.lit(2 / 27))
    return let(z, lambda z: 1 / (1 + F.exp(F.least(z * (1.5976 + 0.07056 * z * z), F.lit(700.0)))))  # the normal tail, to 0.0002


def _length_class(n: Column) -> Column:
    return reduce(lambda a, b: a + b, ((n >= x).cast("int") for x in LENGTHS))


def scanned(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id, kinds (the base spans of each kind) and _runs: (start, end, x: encoding, length
    class and cell of p) of each run that the battery looks at."""
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def found(text: Column) -> Column:
        tested = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _battery(s["hit"]).alias("x"))
        kinds = F.struct(*[bare(_kind_spans(text, *k)).alias(k[0]) for k in KINDS])
        return F.struct(kinds.alias("kinds"), F.transform(_found(text, RUN, lambda hit: F.lit(True)), tested).alias("runs"))

    return docs.select("doc_id", let(text_of(), found).alias("_f")).select("doc_id", F.col("_f.kinds").alias("kinds"), F.col("_f.runs").alias("_runs"))


def discoveries(tests: DataFrame, q: float) -> dict[tuple[int, int], int]:
    """The least cell of p from which runs count as random, by encoding and length class.

    What reaches the driver is a histogram: at most encodings x length classes x CELLS rows.
    """
    rows = tests.select(F.explode("_runs").alias("r")).groupBy("r.x.encoding", "r.x.length", "r.x.cell").count().collect()
    counts: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        counts.setdefault((r["encoding"], r["length"]), [0] * CELLS)[r["cell"]] += r["count"]
    out = {}
    for key, c in counts.items():
        random = sum(c[CELLS // 2 :]) / 0.5  # p of random runs is uniform
        for cell in range(1, CELLS // 2 + 1):
            found = sum(c[cell:])
            if found and max(0.0, found - random * (1 - cell / CELLS)) <= q * found:
                out[key] = cell
                break
    return out


def scan(docs: DataFrame, *, q: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans and spans (arrays of start, order, kind, end).

    Texts are read once: what is kept of them, spans and the battery's cells, serves the false discovery rates and
    the result.
    """
    tests = Scratch(docs.sparkSession, "secrets").keep(scanned(docs))
    threshold = discoveries(tests, q)
    is_random = lambda r: reduce(lambda a, b: a | b, ((r["x"]["encoding"] == e) & (r["x"]["length"] == n) & (r["x"]["cell"] >= cell) for (e, n), cell in sorted(threshold.items())), F.lit(False))
    parts = [_kinded(F.col("kinds")[kind], kind, i) for i, (kind, _, _) in enumerate(KINDS)]
    random = _kinded(F.filter("_runs", is_random), "random", len(KINDS))
    counts = [F.size(F.col("kinds")[kind]).cast("long").alias(f"n_{kind}") for kind, _, _ in KINDS]
    return tests.select("doc_id", *counts, F.sort_array(F.concat(*parts)).alias("base_spans"), F.sort_array(F.concat(*parts, random)).alias("spans"))
