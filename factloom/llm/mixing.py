"""Mixing sources to target weights along a time-varying curriculum.

A source's schedule is a piecewise linear weight over training time 0..1. Its integral is the source's
cumulative token demand; the target fixes the demand's end, and inverting it puts every document at the
training time when its tokens are asked for, once for each pass that takes it. The result is range-sorted by that
position.

Targets: sources in code point order (null last) share `budget` times all sizes by weight; none gets more than
`ceiling` times its size, and what is cut is shared again among the others by weight.

A source's documents are in the order of a hash of their content. A first pass over them and, where the target asks
for more, another one for each further multiple of the size up to `ceiling` take words until the target is met, so each
source's taken words are its target to the word and no document gives more than `ceiling` times its size, rounded up
to a whole number (2 by default). The order falls into SLICES hash ranges a source: running sums are over slices first
and inside a slice then, so no source is ever in one task. Equal rows are numbered, within the tasks that wrote them
first, and the number is part of the hash: a row that makes up a third of the table is spread like any others.

Defined results: a null text has size 0, takes 0; a source without words has target 0; null is a source like
any other; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from factloom.llm.common import WORD, Scratch, text_of

#: Hash ranges of each source's order.
SLICES = 4096
#: Points of a schedule's integral.
GRID = 64

Schedule = Callable[[np.ndarray], np.ndarray]


def default_schedule(i: int) -> Schedule:
    """Every third source is flat, the next rises over the training, the one after falls."""
    return (lambda t: np.ones_like(t), lambda t: 0.5 + t, lambda t: 1.5 - t)[i % 3]


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float = 1.5, ceiling: float = 2.0) -> list[float]:
    """Shares of budget * sum(sizes) by weight, none above ceiling times its size."""
    out = [0.0] * len(sizes)
    left, free = budget * sum(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * unit >= ceiling * sizes[i]}
        if not full:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(ceiling * sizes[i])
        free -= full
        left -= sum(out[i] for i in full)
    return out


def _positions(schedule: Schedule) -> list[float]:
    """Training time at GRID + 1 even shares of a source's demand: the inverse of the schedule's integral."""
    t = np.linspace(0, 1, 1025)
    w = np.maximum(schedule(t), 0)
    demand = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2)))
    if demand[-1] <= 0:
        raise ValueError("a schedule must ask for something")
    return np.interp(np.linspace(0, 1, GRID + 1), demand / demand[-1], t).tolist()


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    ceiling: float = 2.0,
    schedule: Callable[[int], Schedule] = default_schedule,
    max_sources: int = 100_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position, second_position and positions, for every row of docs(doc_id,
    text, source). position is that of the first pass, second_position that of the second, null if it takes nothing;
    positions has one for each pass that `ceiling` allows.

    Sources are a small dimension that weights are given for: beyond max_sources this raises, it drops none.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(docs.select("doc_id", "source", _size(), _hash_of(docs).alias("_key"), F.spark_partition_id().alias("_part")))
    return _mixed(_numbered(rows, scratch), weights, budget, ceiling, schedule, max_sources)


def _size() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("_size")


def _mixed(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, ceiling: float = 2.0, schedule: Callable[[int], Schedule] = default_schedule, max_sources: int = 100_000) -> DataFrame:
    """mix() of rows(doc_id, source, _size, _key, _n), in which (_key, _n) names a row."""
    spark = rows.sparkSession
    passes = max(1, math.ceil(ceiling))
    key = F.xxhash64("_key", "_n")
    rows = rows.select("doc_id", "source", "_size", key.alias("_order"), F.pmod(F.shiftright(key, 20), F.lit(SLICES)).cast("int").alias("_slice"))
    slices = rows.groupBy("source", "_slice").agg(F.sum("_size").alias("_sum"))
    totals = slices.groupBy("source").agg(F.sum("_sum").alias("size")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    w = [float(weights[i % len(weights)]) for i in range(len(totals))]
    goal = targets([r["size"] for r in totals], w, budget, ceiling)
    plan = spark.createDataFrame(
        [(r["source"], r["size"], g, int(g), _positions(schedule(i))) for i, (r, g) in enumerate(zip(totals, goal, strict=True))],
        "source string, source_size long, target double, _goal long, _at array<double>",
    )
    # one row a source, at most max_sources of them, and SLICES rows a source
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))  # joins and windows then need one exchange
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(named.alias("_named"), "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    slices = slices.join(F.broadcast(plan.select(named.alias("_named"), "source_size", "target", "_goal", "_at")), "_named")
    order = Window.partitionBy("_named", "_slice").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_named", named).withColumn("_inside", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    rows = rows.join(slices, ["_named", "_slice"])
    start = F.col("_before") + F.col("_inside")
    starts = [start + F.col("source_size") * i for i in range(passes)]
    takes = [F.when(F.col("source_size") > 0, F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_goal") - at))).otherwise(0) for at in starts]
    share = lambda at: F.least(F.lit(1.0), F.coalesce(at / F.nullif(F.col("_goal"), F.lit(0)), F.lit(1.0)))
    at = [_interpolated(F.col("_at"), share(x)) for x in starts]
    at[1:] = [F.when(t > 0, x) for t, x in zip(takes[1:], at[1:], strict=True)]
    second = at[1] if passes > 1 else F.lit(None).cast("double")
    taken = sum(takes[1:], takes[0])
    return rows.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"), at[0].alias("position"), second.alias("second_position"), F.array(*at).alias("positions"))


def _hash_of(docs: DataFrame) -> Column:
    """A hash of doc_id, source and text, and of which of them are null; of what of a struct can be hashed."""
    kinds = docs.schema

    def parts(column: Column, kind: DataType) -> list[Column]:
        if isinstance(kind, StructType):
            return [x for f in kind.fields for x in parts(column.getField(f.name), f.dataType)]
        return [] if re.search(r"map<|variant", kind.simpleString()) else [column, column.isNull()]

    return F.xxhash64(*[x for c in ("doc_id", "source", "text") for x in parts(F.col(c), kinds[c].dataType)])


def _repeated(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The values of _key that several of rows have."""
    return scratch.keep(rows.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1").select("_key"))


def _numbered(rows: DataFrame, scratch: Scratch, repeated: DataFrame | None = None) -> DataFrame:
    """rows(_key, _part, ...) with _n, the number of each among those of its key: 0 where a key is alone. Rows of a
    repeated key are counted for each part first; then only its parts are numbered inside."""
    repeated = _repeated(rows, scratch) if repeated is None else repeated
    if repeated.isEmpty():
        return rows.withColumn("_n", F.lit(0).cast("long"))
    parts = rows.groupBy("_key", "_part").agg(F.count("*").alias("_c")).join(repeated, "_key", "left_semi")
    before = F.sum("_c").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_c")
    again = scratch.keep(parts.select("_key", "_part", before.alias("_before")))
    first = rows.join(again, ["_key", "_part"], "left_anti").withColumn("_n", F.lit(0).cast("long"))
    inside = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_size"))
    rest = rows.join(again, ["_key", "_part"]).withColumn("_n", F.col("_before") + inside - 1).drop("_before")
    return scratch.keep(first.unionByName(rest))


def _interpolated(grid: Column, share: Column) -> Column:
    cell = F.least(F.floor(share * GRID), F.lit(GRID - 1)).cast("int")
    low = F.get(grid, cell)
    return low + (F.get(grid, cell + 1) - low) * (share * GRID - cell)


def in_training_order(mixed: DataFrame) -> DataFrame:
    return mixed.orderBy("position", "source", "doc_id")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with docs' own columns, in training order: one row for each pass that takes a document.

    Texts stay whole: of the document that a source's target ends in, the pass counts if the target asks for half of
    it or more. So a source's words are within half a document of its target. Rows that agree in all columns but maps
    may change places.

    docs must read the same twice, as a written table does: positions are found for hashes of rows, and the rows, read
    again, are joined to them. Only where hashes recur is a copy of the rows written, in which equal ones are numbered.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    docs = docs.select(row.alias("doc_id"), F.col("text"), F.col("source"))
    scratch = Scratch(docs.sparkSession, "mixing")
    keyed = docs.select("doc_id", "source", _size(), _hash_of(docs).alias("_key"), F.spark_partition_id().alias("_part"))
    keys = scratch.keep(keyed.select("source", "_size", "_key"))
    repeated = _repeated(keys, scratch)
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    ats = F.transform(F.slice("positions", 1, times), lambda at: F.coalesce(at, F.col("position")))
    if repeated.isEmpty():
        mixed = _mixed(keys.select(F.col("_key").alias("doc_id"), "source", "_size", "_key", F.lit(0).cast("long").alias("_n")), **options)
        placed = mixed.where(times > 0).select(F.col("doc_id").alias("_key"), ats.alias("_ats"))
        # always shuffled: the narrow side grows with the documents
        mixed = keyed.select("doc_id", "_key").join(placed.hint("shuffle_hash"), "_key")
    else:
        mixed = _mixed(_numbered(scratch.keep(keyed), scratch, repeated), **options).where(times > 0).select("doc_id", ats.alias("_ats"))
    mixed = mixed.select("doc_id", F.explode("_ats").alias("_at"))
    return mixed.orderBy("_at").select(*[F.col("doc_id")[c].alias(c) for c in names])
