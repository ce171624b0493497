"""Personal data: base patterns and bootstrapped contextual extraction.

Base spans (e-mail, IP, card, phone) are found by fixed patterns. They are also the seeds of a bootstrap: every
identifier-like token, base or not, has lexical patterns - the two words before it, and the word before with the
word after. Patterns and the instances (token texts) that they go with form a bipartite graph, which Spark scores
for ROUNDS rounds: a pattern's confidence is the mean score of its distinct instances (seeds score 1), an
instance's score the chance that not all its confident patterns are wrong. Tokens that a confident pattern goes
with and that no base span covers become spans of kind `context`.

The text is scanned once; what is kept of it are spans and hashes. Distinct (pattern, instance) edges are
aggregates, combined before the shuffle, so that a phrase or a token in a third of all texts costs no more than
one edge a task.

Defined results: null and empty texts have no spans. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from factloom.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
#: The base patterns. Possessive repeats and the look-behind find the same matches in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: Identifier-like tokens: a run of name characters with at least four digits or an at sign, of six or more.
_TOKEN = re.compile(r"[A-Za-z0-9+][A-Za-z0-9@._+/=-]{5,}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters from which a context word stands in patterns as its digest, so that it is hashed once for all its tokens.
LONG = 64
ROUNDS = 3
CONFIDENT = 0.8
SEEDS = 5


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind as in KINDS and then start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)
    if "." in text:
        for m in _IP.finditer(text):
            if all(int(x[-4:]) <= 255 and (len(x) < 4 or not x[:-4].strip("0")) for x in m[0].split(".")):
                out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = "".join(_DIGITS.findall(m[0]))
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\x1f".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, int, list[int]]]:
    """(start, end, is a seed, instance, patterns) of base spans and of the tokens apart from them.

    A text that starts or ends there has no word on that side; a token without a word before has no pattern. Words count
    whole, however long. The word that a token is a part of counts from the token before it there, and up to the one
    after it, so what a word of many tokens costs is its length.
    """
    if not spans and not _DIGITS.search(text) and "@" not in text:
        return []
    covered = sorted((s, e) for _, s, e in spans)
    out = [(s, e, True) for s, e in sorted(set(covered))]
    starts, ends = [s for s, _ in covered], list(accumulate((e for _, e in covered), max))
    at = []
    for m in _WORD.finditer(text):
        word = m[0]
        at.append(m.span())
        if len(word) < 6 or not _DIGITS.search(word) and "@" not in word:
            continue
        for t in _TOKEN.finditer(word):
            token = t[0].rstrip("._-/=+")
            if len(token) >= 6 and ("@" in token or len(_DIGITS.findall(token)) >= 4):
                s = m.start() + t.start()
                e = s + len(token)
                before = bisect_left(starts, e)
                if not before or ends[before - 1] <= s:
                    out.append((s, e, False))
    rows = []
    word_starts, word_ends = [s for s, _ in at], [e for _, e in at]
    token_starts, token_ends = sorted({s for s, _, _ in out}), sorted({e for _, e, _ in out})
    names: dict[tuple[int, int], str] = {}

    def name(a: int, b: int) -> str:
        if (a, b) not in names:
            word = text[a:b].lower()
            names[a, b] = word if len(word) < LONG else "\x1e" + blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        return names[a, b]

    def before(a: int, b: int, s: int) -> str:
        """A word, or what of the word around s lies between the last token that ends there and s."""
        if b <= s:
            return name(a, b)
        n = bisect_right(token_ends, s)
        return name(max(a, token_ends[n - 1]) if n else a, s)

    def after(a: int, b: int, e: int) -> str:
        if a >= e:
            return name(a, b)
        n = bisect_left(token_starts, e)
        return name(e, min(b, token_starts[n]) if n < len(token_starts) else b)

    for s, e, seed in out:
        n = bisect_left(word_starts, s)
        left = [before(a, b, s) for a, b in at[max(0, n - 2) : n]]
        n = bisect_right(word_ends, e)
        right = [after(a, b, e) for a, b in at[n : n + 1]]
        patterns = [_hash("ll", *left)] if len(left) == 2 else []
        if left and right:
            patterns.append(_hash("lr", left[-1], right[0]))
        if patterns:
            rows.append((s, e, seed, _hash(text[s:e].lower()), patterns))
    return rows


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def _scanned(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with base (spans) and found (tokens with their patterns)."""
    others = [c for c in docs.columns if c != "text"]
    schema = StructType([f for f in docs.schema if f.name != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text or "")
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                found.append([dict(zip(("start", "end", "seed", "instance", "patterns"), x, strict=True)) for x in tokens(text or "", spans)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))], names=[*others, "base", "found"])

    for name, kind in (("base", _SPAN), ("found", _FOUND)):
        schema = schema.add(name, from_arrow_type(pa.list_(kind)))
    return docs.select("text", *others).mapInArrow(run, schema)


def confident_patterns(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """pattern, of edges(pattern, instance, seed): those of confidence CONFIDENT with SEEDS distinct seeds."""
    edges = scratch.keep(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    # what no seed goes with can't become confident before its neighbours are: rounds start from seeded patterns
    score = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for n in range(ROUNDS):
        stats = edges.join(score, "instance").groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count_if("seed").alias("seeds"))
        sure = stats.where((F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= SEEDS))
        if n == ROUNDS - 1:
            return sure.select("pattern")
        wrong = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))
        support = edges.join(sure, "pattern").groupBy("instance").agg((1 - F.exp(wrong)).alias("support"))
        seeds = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
        score = scratch.keep(seeds.join(support, "instance", "left").select("instance", F.greatest("score", F.coalesce("support", F.lit(0.0))).alias("score")))
    raise AssertionError


def extract(docs: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """docs' columns but text, with base and more: arrays of (kind, start, end)."""
    scratch = scratch or Scratch(docs.sparkSession, "personal-data")
    others = [c for c in docs.columns if c != "text"]
    rows = scratch.keep(_scanned(docs).withColumn("_row", F.monotonically_increasing_id()))
    found = rows.select("_row", F.explode("found").alias("f")).select("_row", "f.*")
    edges = found.select("instance", "seed", F.explode("patterns").alias("pattern"))
    sure = scratch.keep(confident_patterns(edges, scratch))
    unseen = found.where("not seed").select("_row", "start", "end", F.explode("patterns").alias("pattern"))
    span = F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end")
    more = unseen.join(sure, "pattern").groupBy("_row").agg(F.collect_set(span).alias("more"))  # a row's own spans
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.join(more, "_row", "left").select(*others, "base", F.array_sort(F.coalesce("more", none)).alias("more"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, CONTEXT)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each of spans (start, end, kind) as its kind in angle brackets; overlapping spans are one, the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if start >= at:
            out += [text[at:start], f"<{(*KINDS, CONTEXT)[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span, base and context, replaced by its kind in angle brackets; overlapping spans are one."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in names])
    found = extract(docs.select("text", row.alias("_doc")))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, starts: pd.Series, ends: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([clean(t, list(zip(a.tolist(), b.tolist(), c.tolist(), strict=True))) if len(a) else t for t, a, b, c in zip(texts, starts, ends, kinds, strict=True)], dtype=object)

    spans = F.concat("base", "more")
    found = found.select("_doc", cleaned(F.col("_doc")["text"], *[spans.getField(c) for c in ("start", "end", "kind")]).alias("_clean"))
    out = [F.col("_clean").alias(c) if c == "text" else F.length("_clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_doc")[c].alias(c) for c in names]
    return found.select(*out)
