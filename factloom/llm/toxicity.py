"""Toxicity: a logistic classifier of words with a counterfactual penalty.

Features are the distinct hashed words of a text (letters and digits, A-Z as a-z). Of a bounded sample of labelled
rows the words that go with the label more or less often than chance are kept. Training minimises log loss plus
`penalty` times the squared change of score when the identity terms of a sentence are swapped, for others of their
group and for a neutral word of no weight (else both terms of a pair could rise together): a word that only says
who is spoken of can't carry the score, which keeps neutral mentions low.

Defined results: a null or empty text has no words and the score of the bias alone; without labelled rows every
score is 0. Labels that contradict each other on an id count as toxic; null labels teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import hashed_words, row_blocks, string_bytes

BITS = 20
#: Identity terms by group; terms of one group stand for each other in counterfactuals.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    ("immigrants", "refugees", "natives"),
    ("femmes", "hommes", "filles"),
    ("musulmans", "chrétiens", "juifs"),
    ("immigrés", "réfugiés"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden"),
    ("einwanderer", "flüchtlinge"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos"),
    ("inmigrantes", "refugiados"),
)


def _plain(data: np.ndarray) -> np.ndarray:
    """Bytes with a space for every ASCII character that is neither letter nor digit."""
    c = data
    word = (c >= 128) | ((c >= 48) & (c <= 57)) | ((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122))
    return np.where(word, c, 32).astype(np.uint8)


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of a block of texts, in order."""
    words, rows, _, _ = hashed_words(_plain(data), offsets)
    pairs = np.unique(rows << BITS | _bucket(words))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def identity_swaps(groups=IDENTITY_GROUPS) -> dict[int, int]:
    """The bucket of each identity term to that of the next in its group."""
    out = {}
    for group in groups:
        data = np.frombuffer(" ".join(group).encode(), np.uint8)
        words = _bucket(hashed_words(data, np.array([0, len(data)]))[0]).tolist()
        out |= dict(zip(words, words[1:] + words[:1], strict=True))
    return out


@dataclass
class Model:
    weights: np.ndarray  # one for each bucket
    bias: float
    learned: bool = True

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.learned:
            return np.zeros(n)
        rows, at = buckets(data, offsets)
        z = np.bincount(rows, self.weights[at], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(rows: list[tuple[np.ndarray, int]], *, swaps: dict[int, int] | None = None, penalty: float = 4.0, shrink: float = 1e-3, epochs: int = 30, chance: float = 15.0, seed: int = 1) -> Model:
    """rows: (buckets, label) of each text. chance: least chi-squared, one degree, of a word that is kept."""
    swaps = identity_swaps() if swaps is None else swaps
    weights = np.zeros(1 << BITS)
    if not rows:
        return Model(weights, 0.0, False)
    y = np.array([label for _, label in rows], float)
    share = np.clip(y.mean(), 1 / (len(y) + 2), 1 - 1 / (len(y) + 2))
    bias = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Model(weights, bias)
    held = np.bincount(np.concatenate([at for at, _ in rows]), minlength=1 << BITS)
    toxic = np.bincount(np.concatenate([at for at, label in rows if label] or [np.zeros(0, np.int64)]), minlength=1 << BITS)
    expected = held * share
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(held >= 3, (toxic - expected) ** 2 / (expected * (1 - share)), 0)
    kept = chi >= chance
    kept[list(swaps)] = False  # what only says who is spoken of is no evidence by itself ...
    kept[[i for i in swaps if chi[i] >= chance]] = True  # ... unless labels say so, and the penalty then holds it down
    data = [at[kept[at]] for at, _ in rows]
    flips = []  # of each text with identity terms: the group's next terms, and the neutral word
    for at in data:
        named = np.array([i in swaps for i in at.tolist()], bool)
        flips.append([np.array([swaps.get(i, i) for i in at.tolist()], np.int64), at[~named]] if named.any() else [])
    rng = np.random.default_rng(seed)
    seen = np.full(1 << BITS, 1e-8)
    seen_bias = 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at = data[i]
            s = 1 / (1 + np.exp(-np.clip(bias + weights[at].sum(), -30, 30)))
            g = s - y[i]
            step = np.full(len(at), g) + shrink * weights[at]
            for other in flips[i]:
                t = 1 / (1 + np.exp(-np.clip(bias + weights[other].sum(), -30, 30)))
                step += 2 * penalty * (s - t) * s * (1 - s)
                back = np.full(len(other), -2 * penalty * (s - t) * t * (1 - t))
                seen[other] += back * back
                weights[other] -= 0.3 * back / np.sqrt(seen[other])
            seen[at] += step * step
            weights[at] -= 0.3 * step / np.sqrt(seen[at])
            seen_bias += g * g
            bias -= 0.1 * g / np.sqrt(seen_bias)
    return Model(weights, float(bias))


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            out: list[bytes] = []
            for a, b in row_blocks(offsets):
                rows, at = buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out += [x.tobytes() for x in np.split(at.astype(np.int32), np.searchsorted(rows, np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "toxic", "at"])

    return docs.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, at binary")


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, **options) -> Model:
    """A model from at most `sample` ids of labels(doc_id, toxic), those of smallest hash, and one text of each, that of
    smallest hash."""
    picked = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # bounded by `sample`
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = sorted(_features(rows).collect(), key=lambda r: r["doc_id"])
    return train([(np.frombuffer(r["at"], np.int32).astype(np.int64), r["toxic"]) for r in got], **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, whatever the data
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            parts = [model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_blocks(offsets)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
