"""Artifacts from a tree of files, and change listings."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom.functions import file_policy, language_of, normalize_path


def read_tree(spark: SparkSession, root: str, max_bytes: int = 1 << 20) -> DataFrame:
    """path, kind (or rejected:<reason>), language, content, content_hash and size_bytes of every file below root.

    Files that aren't UTF-8 count as binary; only supported ones carry content. Spark's readers skip names that begin
    with a dot or an underscore, so environment files are never read at all (nor is .env.example).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), F.lit("^(?:file:)?/*" + root.strip("/") + "/*"), F.lit(""))
    rows = files.select(path.alias("path"), F.col("length").alias("size_bytes"), "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    kind = file_policy(F.col("path"), F.col("size_bytes"), max_bytes=max_bytes)
    binary = text.isNull() | (F.instr(F.substring(text, 1, 8192), "\0") > 0)
    kind = F.when(~kind.startswith("rejected") & binary, "rejected:binary").otherwise(kind)
    return rows.select(
        normalize_path(F.col("path")).alias("path"), kind.alias("kind"), language_of(F.col("path")).alias("language"), F.when(~kind.startswith("rejected"), text).alias("content"), F.sha2("content", 256).alias("content_hash"), "size_bytes"
    )


def parse_name_status(lines: DataFrame) -> DataFrame:
    """change, path, previous_path from lines of a name-status listing (tab-separated), one change a line."""
    parts = F.split("value", "\t")
    kind = F.substring(F.get(parts, F.lit(0)), 1, 1)
    two = kind.isin("R", "C")
    change = F.when(kind == "A", "added").when(kind.isin("M", "T"), "modified").when(kind == "D", "deleted").when(kind == "R", "renamed").when(kind == "C", "added")
    return lines.select(change.alias("change"), F.when(two, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), F.when(kind == "R", F.get(parts, F.lit(1))).alias("previous_path")).where("change is not null")


def parse_name_status_tokens(listings: DataFrame) -> DataFrame:
    """change, path, previous_path of listings(value): name-status listings whose tokens NUL ends, so that names may hold
    tabs and line feeds. A token is a status, the next one its path, or the next two where it is a rename or a copy."""
    words = {"A": "added", "C": "added", "M": "modified", "T": "modified", "D": "deleted", "R": "renamed"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for value in pdf["value"]:
                tokens = iter((value or "").split("\0"))
                for status in tokens:
                    if not status:
                        continue
                    first = next(tokens, None)
                    second = next(tokens, None) if status[0] in "RC" else None
                    path = second if status[0] in "RC" else first
                    if status[0] in words and path:
                        rows.append((words[status[0]], path, first if status[0] == "R" else None))
            yield pd.DataFrame(rows, columns=["change", "path", "previous_path"])

    return listings.select("value").mapInPandas(run, "change string, path string, previous_path string")


def ignore_pattern(lines: str) -> list[tuple[re.Pattern, bool]]:
    """(pattern of paths below the root, whether it takes them in again) of an ignore file's lines, in order."""
    out = []
    for line in lines.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        again, line = line.startswith("!"), line.removeprefix("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        rooted, line = "/" in line, line.removeprefix("/")
        parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        body = "".join(parts.get(x, re.escape(x)) for x in re.split(r"(\*\*/|\*\*|\*|\?)", line))
        out.append((re.compile(("" if rooted else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?") + r"\Z"), again))
    return out


def ignored(path: str, patterns: list[tuple[re.Pattern, bool]]) -> bool:
    out = False
    for pattern, again in patterns:
        if pattern.match(path):
            out = not again
    return out


class _Folder(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))


class _TreeReader(DataSourceReader):
    """One partition a folder of the first two levels, and one for the files beside each."""

    def __init__(self, root: str, max_bytes: int):
        self.root, self.max_bytes = os.path.realpath(root), max_bytes
        ignore = os.path.join(self.root, ".gitignore")
        self.lines = open(ignore, encoding="utf-8", errors="replace").read() if os.path.isfile(ignore) else ""

    def _folders(self, folder: str) -> list[str]:
        return sorted(e.name for e in os.scandir(os.path.join(self.root, folder)) if e.is_dir(follow_symlinks=False) and e.name != ".git")

    def partitions(self) -> list[InputPartition]:
        out = [_Folder("", False)]
        for top in self._folders(""):
            out.append(_Folder(top, False))
            out += [_Folder(f"{top}/{x}", True) for x in self._folders(top)]
        return out

    def _files(self, folder: str, deep: bool) -> Iterator[str]:
        for at, folders, names in os.walk(os.path.join(self.root, folder)):
            folders[:] = sorted(x for x in folders if x != ".git" and not os.path.islink(os.path.join(at, x))) if deep else []
            links = [x for x in os.listdir(at) if os.path.islink(os.path.join(at, x)) and os.path.isdir(os.path.join(at, x))]
            for name in sorted({*names, *links}):
                yield os.path.relpath(os.path.join(at, name), self.root).replace(os.sep, "/")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        patterns = ignore_pattern(self.lines)
        for path in self._files(*partition.value):
            if ignored(path, patterns):
                yield path, None, None, "ignored"
                continue
            real = os.path.realpath(os.path.join(self.root, path))
            if os.path.commonpath([real, self.root]) != self.root:
                yield path, None, None, "outside-root"
            elif not os.path.isfile(real):
                yield path, None, None, "not-file"
            else:
                try:
                    size = os.path.getsize(real)
                    with open(real, "rb") as f:
                        yield path, size, f.read() if size <= self.max_bytes else f.read(8192), None
                except OSError:
                    yield path, None, None, "unreadable"


class SourceTree(DataSource):
    """path, size_bytes, content (its head where it is longer than max_bytes) and problem of every file below a folder
    that all executors see; dot files too, links only where they stay below it, nothing of .git."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, size_bytes long, content binary, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"], int(self.options.get("max_bytes", 1 << 20)))


def inventory(spark: SparkSession, root: str, max_bytes: int = 1 << 20) -> DataFrame:
    """path, kind (or rejected:<reason>), language, content, content_hash and size_bytes of every file below root that
    SourceTree lists: what an ignore file excludes, links that lead out and what can't be read are rejected rows."""
    spark.dataSource.register(SourceTree)
    files = spark.read.format("source_tree").option("max_bytes", max_bytes).load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    kind = file_policy(F.col("path"), F.coalesce("size_bytes", F.lit(0)), max_bytes=max_bytes)
    binary = F.instr(F.substring(F.coalesce(text, F.lit("")), 1, 8192), "\0") > 0
    kind = F.when(F.col("problem").isNotNull(), F.concat(F.lit("rejected:"), "problem")).when(~kind.startswith("rejected") & text.isNull(), "rejected:invalid-utf8").when(~kind.startswith("rejected") & binary, "rejected:binary").otherwise(kind)
    taken = ~kind.startswith("rejected")
    return files.select(normalize_path(F.col("path")).alias("path"), kind.alias("kind"), language_of(F.col("path")).alias("language"), F.when(taken, text).alias("content"), F.when(taken, F.sha2("content", 256)).alias("content_hash"), "size_bytes")
