"""Compression of vectors to codes: product quantisation trained by Lloyd's rounds with Elkan's bounds.

Components become integers floor(256 * x), vectors are cut into equal parts, each with a codebook of its own. Between
rounds a table in the shared folder keeps, for every row, its parts' entries, an upper bound of the distance to each of
these and a lower bound of the distance to every entry. After a round the bounds are shifted by how far the entries
moved. A distance is computed only where the triangle inequality leaves room: an entry is passed over when the upper
bound is strictly below its lower bound, or strictly below half the distance between it and the present entry. What is
compared is the squared distance in integers, so ties go to the lower entry as they would without any bound.

Upper bounds are rounded up, lower ones down to 1/255 of the part's largest; a row's bounds take parts * (entries + 8)
bytes. A task holds blocks of BLOCK rows; the driver holds the codebooks, and one sum for each of their components.

Defined results: vectors that are null or hold a null, NaN or infinity take no part. Shorter vectors count as padded
with zeros, and all of them up to a multiple of the parts. Rows of one id are rows of their own; where the first
entries are picked they come in order of id, then vector, null ids last. Fewer rows than entries give as many entries.
Integer components beyond 2**27 count as 2**27.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch

BLOCK = 8192
BOUND = 1 << 27
#: Label sums that are sent to every task; more are joined by a shuffle.
BROADCAST_LABELS = 10_000
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9


def kept(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id, the integer vector v and more columns of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = float(BOUND)
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double"), F.lit(top)), F.lit(-top)) * 256).cast("double"), F.lit(top)), F.lit(-top)).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))).select("vec_id", whole.alias("v"), *more)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to the same row of c."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


class Elkan:
    """One part's entries (entries x width), the distances between them and how far each has just moved."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        n = len(entries)
        gap = entries[:, None, :] - entries[None, :, :]
        self.between = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap).astype(np.float64)) * _DOWN
        self.half = self.between / 2
        self.nearest_half = np.where(np.eye(n, dtype=bool), np.inf, self.half).min(1, initial=np.inf)
        self.moved = np.zeros(n) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(1)) * _UP
        self.computed = 0

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Nearest entries of the rows x; upper and lower are brought up to date in place."""
        code = code.astype(np.int64)
        upper += self.moved[code]
        lower -= self.moved
        open_ = np.flatnonzero(~(upper < self.nearest_half[code]))
        if not len(open_):
            return code
        xs, a, low = x[open_], code[open_], lower[open_]
        best = squared(xs, self.entries[a])
        u = np.sqrt(best) * _UP
        low[np.arange(len(a)), a] = np.sqrt(best) * _DOWN
        self.computed += len(a)
        for j in range(len(self.entries)):
            at = np.flatnonzero(~((u < low[:, j]) | (u < self.half[a, j])) & (a != j))
            if not len(at):
                continue
            d = squared(xs[at], self.entries[j])
            self.computed += len(at)
            low[at, j] = np.sqrt(d) * _DOWN
            nearer = (d < best[at]) | ((d == best[at]) & (j < a[at]))
            at, d = at[nearer], d[nearer]
            a[at], best[at], u[at] = j, d, np.sqrt(d) * _UP
        # what the entry passed over tells of the others: |x - c| >= |a - c| - |x - a|
        np.maximum(low, self.between[a] - u[:, None], out=low)
        low[np.arange(len(a)), a] = np.sqrt(best) * _DOWN
        code[open_], upper[open_], lower[open_] = a, u, low
        return code


def _packed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _unpacked(column: pa.Array, kind, n: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, n), kind)
    first = np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]
    return np.frombuffer(column.buffers()[2], kind, len(column) * n, first).reshape(len(column), n)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int32)
    lengths = np.diff(column.offsets.to_numpy())
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _pack_lower(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (rows x parts x entries) of lower bounds, and what one of them stands for (rows x parts)."""
    lower = np.maximum(lower, 0)
    step = (lower.max(2, initial=0) / 255).astype(np.float32)
    safe = np.where(step > 0, step, 1)[:, :, None]
    return np.minimum(np.floor(lower / safe * _DOWN), 255).astype(np.uint8), step


class Codebooks:
    """parts x entries x width integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    @property
    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def _start(rows: DataFrame, parts: int, entries: int, width: int) -> Codebooks:
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    out = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        out[i, : len(r["v"])] = r["v"]
    return Codebooks(out.reshape(len(first), parts, width // parts).transpose(1, 0, 2))


def _assign(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, carried: list[str], last: bool) -> DataFrame:
    """A round over rows: of vectors (before is None), or of the table that the last round left."""
    parts, n, w = books.shape
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    keep = ", ".join(f"`{c}` {kinds[c]}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Elkan(books[p], None if before is None else before[p]) for p in range(parts)]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                m = b.num_rows
                if before is None:
                    x = _matrix(b.column("v"), parts * w)
                    codes, upper, lower = np.zeros((m, parts), np.uint8), np.full((m, parts), np.inf), np.zeros((m, parts, n))
                else:
                    x = _unpacked(b.column("v"), np.int32, parts * w)
                    codes = _unpacked(b.column("codes"), np.uint8, parts).copy()
                    upper = _unpacked(b.column("upper"), np.float32, parts).astype(np.float64)
                    lower = _unpacked(b.column("lower"), np.uint8, parts * n).reshape(m, parts, n) * (_unpacked(b.column("step"), np.float32, parts).astype(np.float64) * _DOWN)[:, :, None]
                error = np.zeros(m, np.int64)
                for p, model in enumerate(models):
                    part, u, low = x[:, p * w : (p + 1) * w], upper[:, p].copy(), np.ascontiguousarray(lower[:, p])
                    a = model.assign(part, codes[:, p], u, low)
                    codes[:, p], upper[:, p], lower[:, p] = a, u, low
                    if last:
                        error += squared(part, model.entries[a])
                own = [b.column(c) for c in carried]
                if last:
                    yield pa.RecordBatch.from_arrays([*own, pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(error)], [*carried, "code", "error"])
                else:
                    packed, step = _pack_lower(lower)
                    up = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
                    yield pa.RecordBatch.from_arrays([*own, *map(_packed, (x, codes, up, packed.reshape(m, -1), step))], [*carried, "v", "codes", "upper", "lower", "step"])

    return rows.mapInArrow(run, f"{keep}, code string, error long" if last else f"{keep}, v binary, codes binary, upper binary, lower binary, step binary")


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries after a round: the floor of their rows' mean. Each task sends one sum a component."""
    parts, n, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, w, n), np.int64), np.zeros((parts, n), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x, codes = _unpacked(b.column("v"), np.int32, parts * w), _unpacked(b.column("codes"), np.uint8, parts)
                for p in range(parts):
                    counts[p] += np.bincount(codes[:, p], minlength=n)
                    for t in range(w):
                        sums[p, t] += np.bincount(codes[:, p], x[:, p * w + t], n).astype(np.int64)
        flat = np.concatenate((sums.ravel(), counts.ravel()))
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["slot", "total"])

    rows = state.select("v", "codes").mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(parts * n * (w + 1), np.int64)
    for r in rows:
        flat[r["slot"]] = r["total"]
    sums, counts = flat[: parts * n * w].reshape(parts, w, n).transpose(0, 2, 1), flat[parts * n * w :].reshape(parts, n, 1)
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, label: str | None = None) -> tuple[DataFrame, Codebooks]:
    """(vec_id, code, error and the label column of every row, kept in the shared folder; the codebooks)."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit in a byte")
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = kept(vectors, *([F.col(label).alias("label")] if label else []))
    carried = ["vec_id", "label"] if label else ["vec_id"]
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    books = _start(rows, parts, entries, -(-width // parts) * parts)
    if not books.entries.shape[1]:
        return rows.select(*carried, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), books
    state, before = None, None
    for _ in range(rounds):
        after = scratch.keep(_assign(rows if state is None else state, books.entries, before, carried, last=False))
        if state is not None:
            scratch.drop(state)
        state, before = after, books.entries
        books = Codebooks(_moved(state, before))
    out = scratch.keep(_assign(rows if state is None else state, books.entries, before, carried, last=True))
    if state is not None:
        scratch.drop(state)
    return out, books


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over rows of equal label) and the digest of
    the codebooks."""
    coded, books = encode(vectors, parts, entries, rounds, "label")
    sums = Scratch(vectors.sparkSession, "codes").keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    out = coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books.text.encode()).hexdigest()).alias("codebooks_sha256"))
