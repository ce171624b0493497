"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's letters (lower case; every run of anything else is one boundary) give n-grams of 2 to 4 characters that
cross no boundary; each n-gram is hashed to a row of an embedding table, the rows are averaged and a linear
softmax scores the languages. Both tables are trained by stochastic gradient descent in numpy on a sample of
labelled rows; held-back rows of that sample set the softmax's temperature and the confidence below which a
prediction is rejected. Since the layers are linear, prediction sums rows of their product.

The sample has at most `per_language` distinct pairs of id and text of every language, the first by their hash: a
bounded, documented sample whatever the table's size and however often rows recur; a language with a labelled row teaches. Prediction looks at every character of every text.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text if nothing could be
learned; rows whose language or text is null teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import mix64

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and for each the text that it is in, in order of the texts."""
    chars = np.frombuffer("\n".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.cumsum([len(t.lower()) + 1 for t in texts])
    letter = _letters()[chars]
    # one boundary for each run of other characters, and one in front
    keep = letter | np.concatenate(([True], letter[:-1]))
    keep[breaks - 1] = True
    row = np.searchsorted(breaks, np.flatnonzero(keep), "right")
    codes = np.where(letter, chars, 0)[keep].astype(np.uint64)
    codes, row = np.concatenate((np.zeros(1, np.uint64), codes)), np.concatenate((row[:1], row))
    inner = codes != 0
    buckets, rows = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            ok = inner[1:m + 1].copy() if n > 2 else inner[:m] | inner[1:m + 1]
            for k in range(2, n - 1):
                ok &= inner[k : k + m]
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + m]
            at = np.flatnonzero(ok)
            buckets.append((mix64(h[at]) & np.uint64(BUCKETS - 1)).astype(np.int32))
            rows.append(row[at + 1])  # the second character is a letter's or the first one is: never another text's
    buckets, rows = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (buckets, rows))
    order = np.argsort(rows, kind="stable")
    return buckets[order], rows[order]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times softmax weights, over the temperature
    bias: np.ndarray
    least: float  # confidence from which a prediction is accepted

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's index (-1: no letter) and its probability, for each text."""
        buckets, rows = subwords(texts)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if len(rows) and self.languages:
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            count = np.diff(np.append(first, len(rows)))
            z = np.add.reduceat(self.table[buckets], first, axis=0) / count[:, None] + self.bias
            p = _softmax(z)
            best[rows[first]], score[rows[first]] = p.argmax(axis=1), p.max(axis=1)
        return best, score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], *, size: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 1) -> Model:
    """rows: (buckets, counts, language) of each text; every fourth row calibrates instead of training."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / size, 1 / size, (BUCKETS, size))
    w, b = np.zeros((size, len(languages))), np.zeros(len(languages))
    rows = [(at, c / c.sum(), languages.index(name)) for at, c, name in rows if len(at)]
    held = rows[::4] if len(rows) >= 40 else []
    used = [r for i, r in enumerate(rows) if i % 4] if held else rows
    steps, done = max(1, epochs * len(used)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            at, share, y = used[i]
            lr = rate * (1 - done / steps)
            x = share @ e[at]
            g = _softmax(x @ w + b)
            g[y] -= 1
            back = w @ g
            w -= lr * np.outer(x, g)
            b -= lr * 0.1 * g
            e[at] -= (lr * share * min(len(at), 64))[:, None] * back
            done += 1
    product = e @ w
    z = np.array([share @ product[at] + b for at, share, _ in held or used])
    y = np.array([r[2] for r in held or used])
    # the temperature of least log loss, then the least confidence at which 99.5 % of what is accepted is right
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    t = min(np.geomspace(0.05, 20, 60), key=loss) if len(y) else 1.0
    least = 0.0
    if len(y):
        p = _softmax(z / t)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = (p.argmax(axis=1) == y)[order].cumsum() / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= 0.995)
        least = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
        least = 0.0 if len(good) and good[-1] == len(y) - 1 else least
    return Model(languages, (product / t).astype(np.float32), b / t, least)


def _histograms(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for text in batch.column(1).to_pylist():
                buckets, count = np.unique(subwords([text or ""])[0], return_counts=True)
                at.append(buckets.astype(np.int32).tobytes())  # arrays would reach the driver as Python objects
                n.append(count.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["doc_id", "lang", "at", "n"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, at binary, n binary")


def learn(docs: DataFrame, teaches: Column, *, per_language: int = 1000, max_languages: int = 1000, **options) -> Model:
    """A model from the rows of docs(doc_id, text, lang) that `teaches` holds for.

    Of each language the per_language pairs of least hash of id and text are taken, repeated rows once; languages are a small dimension
    (beyond max_languages this raises).
    """
    rows = docs.where(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rows = rows.withColumn("_key", F.xxhash64(F.lit(11), "doc_id", "text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_key").alias("n")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return train([])
    # of the distinct pairs of id and text about twice as many as needed by their hash, all where a language has few,
    # so that few texts are sorted; then the first, in parts at first
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (2 * per_language + 100) / max(1, r["n"]))))])
    some = rows.where(F.pmod(F.col("_key"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    some = some.dropDuplicates(["lang", "_key"])
    some = some.withColumn("_order", F.pmod(F.col("_key"), F.lit(1 << 30))).withColumn("_part", F.pmod(F.shiftright("_key", 30), F.lit(32)))
    for keys in (["lang", "_part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("_order", "_key")
        some = some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).drop("_n")
    got = sorted(_histograms(some).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], bytes(r["at"])))
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32), r["lang"]) for r in got], **options)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and accepted for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the data
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            first = 0
            while first < len(texts):
                last, n = first, 0
                while last < len(texts) and (last == first or n + len(texts[last]) <= 400_000):
                    n += len(texts[last])
                    last += 1
                best[first:last], score[first:last] = model.predict(texts[first:last])
                first = last
            names = np.array([*model.languages, UNKNOWN], object)[best]  # -1 is the last
            columns = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array((best >= 0) & (score >= model.least))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
