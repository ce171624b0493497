"""What the operators of this subpackage share: words, shared scratch tables, row access.

Conventions of every operator here: a null text counts as the empty text; a null doc_id is an ordinary
row that belongs to no held-out fold; repeated rows are rows of their own; columns that an operator does
not name are neither read nor in the way, whatever their names.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for a row however often body and its lambdas name it.

    A column of an inner select may be inlined wherever it is named, inside lambdas too, and then be evaluated
    for every element; a lambda's variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % n


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='factloom-')}"


def _shared_folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return _own_folder()


def row_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns that tell where each row stands in the table, and their names, in order of weight.

    Spark deals a table's files to tasks by size, so rows of a sorted table come in another order when it is read: the
    file's name and the row's place in it still tell. For what is read from no file, the partition and place in it do.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        path = meta["file_path"]  # a part's number has five digits or more: shorter names come first
        out = docs.withColumns({"_order_file": F.concat(F.lpad(F.length(path).cast("string"), 6, "0"), path), "_order_row": meta["row_index"]})
        out.schema  # noqa: B018  raises where there are no files
        return out, ["_order_file", "_order_row"]
    except (AnalysisException, TypeError):
        return docs.withColumns({"_order_file": F.lit(""), "_order_row": F.monotonically_increasing_id()}), ["_order_file", "_order_row"]


class Scratch:
    """Tables written below spark.checkpoint.dir, the folder that all executors share.

    keep() cuts the lineage: a lost executor costs tasks, not tables. Where the setting is absent a temporary folder
    of this machine serves a local master (tests, notebooks); a cluster must name one.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a kept table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array, end to end, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = 4 << 20):
    """Pairs (first, last) of rows, so that a block has about `most` bytes, or one longer row."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Base of the words' polynomial hash, odd, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 22)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.empty(size, np.uint64)
            p[0], done = 1, 1
            with np.errstate(over="ignore"):
                while done < size:
                    m = min(done, size - done)
                    p[done : done + m] = p[:m] * np.uint64(pow(base, done, 1 << 64))
                    done += m
            _POWERS[name] = p
    return _POWERS["up"][:n], _POWERS["down"][:n]


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, ...]:
    """Words of a block of rows: a 64-bit hash of each, the row it is in, its first byte and its end byte.

    lower: A-Z count as a-z.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return none.view(np.uint64), none, none, none
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.concatenate(([False], ~space, [False]))
    cut = np.zeros(n + 2, bool)  # a row's end ends its word
    cut[1 + offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut[1:]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:]))
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
        words = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return words, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def shingled(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one row, and the index of the first word of each."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - k + 1
    at = np.flatnonzero(rows[:m] == rows[k - 1 :])
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for i in range(k):
            h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + words[at + i] + np.uint64(i + 1))
    return h, at
