"""Fill-in-the-middle: texts cut in three and put in an order that asks a model for the middle.

A block of texts is decoded to one UTF-32 array of code points. Every code point gets a class; where neighbouring
classes differ a unit ends, so that flatnonzero over the comparison yields all boundaries. Two ranks that a hash of the
id picks index the boundaries; the code points between are sliced and encoded again.

Forms: plain (the text as it is), psm (prefix, suffix, middle), spm (suffix, prefix, middle), each piece after its
sentinel. restore() undoes them.

Defined results: a null text is the empty one; an empty text, or one that contains a sentinel, stays plain; a null id
is hashed as the empty string; rows of one id are cut by the same hashes, repeated rows alike; bytes that are no UTF-8
become U+FFFD. A task holds one Arrow batch, decoded in blocks of some MB, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import row_blocks, string_bytes, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of texts that are transformed, and of those that have the suffix first.
RATE, SUFFIX_FIRST = 90, 20


def code_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def char_classes(points: np.ndarray) -> np.ndarray:
    """Each code point is a unit: no two neighbours are of one class."""
    return np.arange(len(points)) & 1


def word_classes(points: np.ndarray) -> np.ndarray:
    """Units are runs of ASCII white space, and of anything else."""
    return (points == 32) | ((points >= 9) & (points <= 13))


def line_classes(points: np.ndarray) -> np.ndarray:
    """Units are lines, each with its line feed."""
    ends = np.zeros(len(points), np.int64)
    ends[1:] = points[:-1] == 10
    return np.cumsum(ends)


UNITS = {"char": char_classes, "word": word_classes, "line": line_classes}


def boundaries(points: np.ndarray, cuts: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all units, and how many of them lie before each cut. cuts: where the rows of points begin, and its end."""
    n = len(points)
    ends = np.zeros(n + 1, bool)
    classes = UNITS[unit](points)
    ends[1:n] = classes[1:] != classes[:-1]
    ends[cuts] = True  # a row's end ends its last unit
    ends[0] = False
    at = np.flatnonzero(ends)
    return at, np.searchsorted(at, cuts, "right")


def _pieces(points: np.ndarray, cuts: np.ndarray, unit: str, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each row, where its prefix ends and where its middle ends."""
    at, before = boundaries(points, cuts, unit)
    n = np.diff(before)
    a, b = h1 % (n + 1), h2 % (n + 1)
    at = np.concatenate((at, [0]))  # for the ranks of empty rows at the end, which cut at 0
    end = lambda rank: np.where(rank > 0, at[before[:-1] + rank - 1], cuts[:-1])
    return n, end(np.minimum(a, b)), end(np.maximum(a, b))


def _block(data: bytes, rows: list[bytes], hashes: list[np.ndarray], unit: str) -> dict[str, list]:
    points = code_points(data)
    lengths = np.array([len(r.decode("utf-8", "replace")) for r in rows], np.int64) if len(points) != len(data) else np.array([len(r) for r in rows], np.int64)
    cuts = np.concatenate(([0], np.cumsum(lengths)))
    if cuts[-1] != len(points):  # a row ends inside a sequence of bytes that is no UTF-8: decode row by row
        points = np.concatenate([code_points(r) for r in rows])
    h1, h2, h3, h4 = hashes
    n, first, second = _pieces(points, cuts, unit, h1, h2)
    text = lambda a, b: points[a:b].tobytes().decode("utf-32-le")
    out: dict[str, list] = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
    for i, (a, p, m, b) in enumerate(zip(cuts[:-1].tolist(), first.tolist(), second.tolist(), cuts[1:].tolist(), strict=True)):
        whole = text(a, b)
        plain = not whole or any(s in whole for s in (PREFIX, SUFFIX, MIDDLE)) or h3[i] % 100 >= RATE
        form = "plain" if plain else "spm" if h4[i] % 100 < SUFFIX_FIRST else "psm"
        if plain:
            done = whole
        else:
            prefix, middle, suffix = text(a, p), text(p, m), text(m, b)
            done = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
        for k, v in zip(out, (int(n[i]), form, None if plain else p - a, None if plain else m - p, done), strict=True):
            out[k].append(v)
    return out


def transform(docs: DataFrame, unit: str = "char") -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (code points, null if plain) and the output text."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    asked = docs.select("doc_id", text_of().alias("text"), *h)
    schema = asked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            hashes = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
            for first, last in row_blocks(offsets):
                rows = [data[a:b].tobytes() for a, b in zip(offsets[first:last], offsets[first + 1 : last + 1], strict=True)]
                out = _block(b"".join(rows), rows, [x[first:last] for x in hashes], unit)
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(out[k], t) for k, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", *out])

    return asked.mapInArrow(run, f"doc_id {schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that transform() cut."""
    part = F.split_part
    cut = lambda text, after, until: part(part(text, F.lit(after), F.lit(2)), F.lit(until), F.lit(1)) if until else part(text, F.lit(after), F.lit(2))
    psm = F.concat(cut(output, PREFIX, SUFFIX), cut(output, MIDDLE, ""), cut(output, SUFFIX, MIDDLE))
    spm = F.concat(cut(output, PREFIX, MIDDLE), cut(output, MIDDLE, ""), cut(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
