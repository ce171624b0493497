"""Byte-level BPE encoding and decoding by a rank file.

Merging: the bytes of a piece are the leaves of a segment tree; a leaf holds the rank of the pair that begins
there, and every node the least (rank, position) below it, so the root is the leftmost pair of least rank. A
merge changes the pairs of the merged token and of its left neighbour and removes that of the right one: three
point updates, each up one path of the tree. Live neighbours are doubly linked.

encode_pieces() runs the trees of many short pieces side by side, level by level, as rows of one array;
encode_long() is the same tree for a single long piece. Pieces repeat a lot, so each Python worker keeps those it
has met, up to CACHE of them; documents are never looked at together, so any executor can redo any partition.

Defined results: null and empty texts have no tokens (ids and bytes then hash as the empty string).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import row_order

#: Pieces that a worker keeps; it starts anew beyond.
CACHE = 300_000
#: Longest piece, in bytes, that shares an array with others.
SHORT = 128
NONE = np.int64(1) << 40
SHIFT = 20


class Vocabulary:
    """Ranks of byte strings, and for every pair of tokens whose join is a token, the join's rank."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        missing = [i for i in range(256) if bytes([i]) not in self.ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each join; NONE where there is none or b is negative."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((b >= 0) & (self.keys[at] == keys), self.joined[at], NONE)


def encode_long(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one piece: a segment tree over its bytes."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    ids = vocabulary.of_byte[np.frombuffer(piece, np.uint8)]
    leaf = np.full(size, NONE << SHIFT, np.int64)
    leaf[: n - 1] = vocabulary.pair_ranks(ids[:-1], ids[1:])
    none = int(NONE)
    rank = leaf.tolist()
    # a node holds the leftmost position of least rank below it
    levels = [np.arange(size)]
    while len(levels[-1]) > 1:
        left, right = levels[-1][0::2], levels[-1][1::2]
        levels.append(np.where(leaf[left] <= leaf[right], left, right))
    tree = np.concatenate(levels[::-1]).tolist()  # tree[k - 1] is heap node k
    tree.insert(0, 0)
    token, after, before = ids.tolist(), [*range(1, n), -1], list(range(-1, n - 1))
    pairs = vocabulary.pairs

    def update(at: int, value: int) -> None:
        rank[at] = value
        k = (size + at) >> 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if rank[left] <= rank[right] else right
            k >>= 1

    while n > 1 and rank[tree[1]] < none:
        at = tree[1]
        token[at], gone = rank[at], after[at]
        after[at] = after[gone]
        if after[gone] >= 0:
            before[after[gone]] = at
        update(gone, none)
        update(at, pairs.get(token[at] << 32 | token[after[at]], none) if after[at] >= 0 else none)
        if before[at] >= 0:
            update(before[at], pairs.get(token[before[at]] << 32 | token[at], none))
    out, at = [], 0
    while at >= 0:
        out.append(token[at])
        at = after[at]
    return out


def _encode_width(pieces: list[bytes], width: int, vocabulary: Vocabulary) -> list[list[int]]:
    """Pieces of at most `width` bytes, a power of two: one row of the arrays is one piece's tree."""
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
    place = np.arange(width)
    alive = place < lengths[:, None]
    token = np.where(alive, vocabulary.of_byte[flat], -1)
    after = np.where(place + 1 < lengths[:, None], place + 1, -1)
    before = np.broadcast_to(place - 1, (n, width)).copy()
    following = np.concatenate((token[:, 1:], np.full((n, 1), -1)), axis=1)
    tree = np.empty((n, 2 * width), np.int64)
    tree[:, width:] = vocabulary.pair_ranks(token, following) << SHIFT | place
    level = width
    while level > 1:
        level //= 2
        pairs = tree[:, 2 * level : 4 * level].reshape(n, level, 2)
        tree[:, level : 2 * level] = pairs.min(axis=2)

    def update(rows: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> None:
        tree[rows, width + at] = ranks << SHIFT | at
        k = (width + at) >> 1
        while len(k) and k[0]:  # all leaves are equally deep
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            k = k >> 1

    rows = np.flatnonzero(tree[:, 1] >> SHIFT < NONE)
    while len(rows):
        root = tree[rows, 1]
        at = root & ((1 << SHIFT) - 1)
        gone = after[rows, at]
        merged = root >> SHIFT
        token[rows, at] = merged
        right = after[rows, gone]
        after[rows, at] = right
        has = right >= 0
        before[rows[has], right[has]] = at[has]
        alive[rows, gone] = False
        update(rows, gone, np.full(len(rows), NONE))
        update(rows, at, vocabulary.pair_ranks(merged, np.where(has, token[rows, right], -1)))
        left = before[rows, at]
        has = left >= 0
        update(rows[has], left[has], vocabulary.pair_ranks(token[rows[has], left[has]], merged[has]))
        rows = rows[tree[rows, 1] >> SHIFT < NONE]
    ids, ends = token[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each piece. A piece that is a token is that token."""
    out: list[list[int] | None] = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = vocabulary.ranks.get(piece)
        if whole is not None:
            out[i] = [whole]
        elif not piece:
            out[i] = []
        elif len(piece) > SHORT:
            out[i] = encode_long(piece, vocabulary)
        else:
            classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    for width, members in classes.items():
        step = max(1, (1 << 19) // width)
        for first in range(0, len(members), step):
            part = members[first : first + step]
            for i, ids in zip(part, _encode_width([pieces[i] for i in part], width, vocabulary), strict=True):
                out[i] = ids
    return out


class Encoder:
    """Splits texts into pieces by a pattern, and encodes and decodes them."""

    def __init__(self, lines: bytes, pattern: str):
        self.vocabulary = Vocabulary(lines)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # a piece's ids as 32-bit words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.split(t) for t in texts]
        new = {p for x in pieces for p in x} - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = {p for x in pieces for p in x}
        fresh = sorted(new)
        for p, ids in zip(fresh, encode_pieces([p.encode() for p in fresh], self.vocabulary), strict=True):
            self.known[p] = np.array(ids, np.int32).tobytes()
        known = self.known
        return [np.frombuffer(b"".join([known[p] for p in x]), np.int32) for x in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def _encoder(lines: bytes, pattern: str) -> Encoder:
    """One for each Python worker, whatever number of tasks it runs."""
    key = hashlib.sha256(lines).digest(), pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(lines, pattern)
    return _ENCODERS[key]


def _blocks(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= most:
            yield block
            block, n = [], 0
    if block:
        yield block


def tokenise_in_order(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """tokenise(), with position, the number of each row in docs' own order from 0 on, and sorted by it."""
    ordered, (file, row) = row_order(docs.select("doc_id", "text"))
    out = tokenise(ordered, rank_file, pattern, carried=(file, row))
    # a row a file: where its rows begin
    files = ordered.groupBy(file).agg(F.max(row).alias("_last"))
    before = F.sum(F.col("_last") + 1).over(Window.orderBy(file)) - F.col("_last") - 1
    out = out.join(files.select(F.col(file), before.alias("_before")), file)
    return out.withColumn("position", F.col("_before") + F.col(row)).drop(file, row, "_before").orderBy("position")


def tokenise(docs: DataFrame, rank_file: str, pattern: str, *, keep_ids: bool = False, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of docs(doc_id, text), with ids if asked for, and
    the carried columns.

    The rank file is read by the driver and sent once to each executor: a vocabulary's size doesn't grow with data.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lines.value, pattern)
        for batch in batches:
            out: list[tuple] = []
            for texts in _blocks([t or "" for t in batch.column(1).to_pylist()]):
                for ids in encoder.encode(texts):
                    ids = ids.tolist()
                    digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                    out.append((len(ids), digest, hashlib.sha256(encoder.decode(ids)).hexdigest(), *([ids] if keep_ids else [])))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())], strict=False)]
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else []), *carried])

    return docs.select("doc_id", "text", *carried).mapInArrow(run, schema)
