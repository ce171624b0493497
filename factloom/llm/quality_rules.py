"""Quality rules: learned decision lists over text statistics.

statistics() computes a text's statistics with built-in functions only. learn() grows an ordered
list of threshold conjunctions from labelled statistics by sequential covering, pruning each conjunction on
rows that did not grow it; as_column() turns the list into one ordered conditional expression.

Defined results: a null or empty text has no words and zero in every count; documents without labels (or an
empty label table) give an empty list, which keeps everything. Labels that contradict each other on an id
count as low quality; labels of null quality are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACE, WORD, let, text_of

#: Statistics that thresholds are put on; each is a share or a mean, so that length alone decides nothing.
FEATURES = ("symbol_share", "punctuation_share", "upper_share", "digit_share", "mean_word", "dup_line_share", "repeat_share", "distinct_share", "words_per_line")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_punctuation")
#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"


def _repeated(words: Column) -> Column:
    """How many words are in a 3-word window found twice or more: equal windows are neighbours once sorted."""
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("gram"), i.alias("at")),
    )

    def places(grams: Column) -> Column:
        same = lambda x, other: F.coalesce(F.get(grams, other)["gram"] == x["gram"], F.lit(False))
        marked = F.transform(grams, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["at"]))
        return F.sort_array(F.filter(marked, lambda at: at.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(F.sort_array(windows), lambda grams: let(places(grams), covered))


def statistics(text: Column) -> Column:
    """A struct of the counts of the base rules and FEATURES, of one text."""
    long = lambda c, name: c.cast("long").alias(name)
    share = lambda c, a, b, name: (c[a] / F.greatest(c[b], F.lit(1))).alias(name)

    def counts(t: Column, words: Column, lines: Column) -> Column:
        return F.struct(
            long(F.size(words), "n_words"),
            long(F.length(F.regexp_replace(t, SPACE, "")), "word_chars"),
            long(F.length(t) - F.length(F.translate(t, SYMBOLS, "")), "n_symbols"),
            long(F.size(lines) - F.size(F.array_distinct(lines)), "n_dup_lines"),
            long(_repeated(words), "n_repeat_words"),
            long(F.size(lines), "n_lines"),
            long(F.size(F.array_distinct(words)), "n_distinct"),
            long(F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")), "n_upper"),
            long(F.length(F.regexp_replace(t, r"[^0-9]+", "")), "n_digits"),
            long(F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")), "n_punctuation"),
        )

    def with_shares(c: Column) -> Column:
        return F.struct(
            *[c[name].alias(name) for name in COUNTS],
            share(c, "n_symbols", "word_chars", "symbol_share"),
            share(c, "n_punctuation", "word_chars", "punctuation_share"),
            share(c, "n_upper", "word_chars", "upper_share"),
            share(c, "n_digits", "word_chars", "digit_share"),
            share(c, "word_chars", "n_words", "mean_word"),
            share(c, "n_dup_lines", "n_lines", "dup_line_share"),
            share(c, "n_repeat_words", "n_words", "repeat_share"),
            share(c, "n_distinct", "n_words", "distinct_share"),
            share(c, "n_words", "n_lines", "words_per_line"),
            ((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).alias("base_failed"),
        )

    counted = let(
        text,
        lambda t: let(
            F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
            lambda words: let(F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD)), lambda lines: counts(t, words, lines)),
        ),
    )
    return let(counted, with_shares)


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # "<=" or ">"
    threshold: float

    def column(self, stats: Column) -> Column:
        return stats[self.feature] > self.threshold if self.op == ">" else stats[self.feature] <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.op == ">" else v <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction; documents that it covers are rejected."""

    conditions: tuple[Condition, ...]
    precision: float

    def column(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, (c.column(stats) for c in self.conditions))

    def covers(self, x: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, (c.holds(x) for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {c.op} {c.threshold:.6g}" for c in self.conditions)


def _candidates(x: np.ndarray, bins: int) -> list[Condition]:
    out = []
    for k, name in enumerate(FEATURES):
        values = np.unique(x[:, k])
        if len(values) > bins:
            values = np.unique(np.quantile(values, np.linspace(0, 1, bins)))
        for cut in (values[1:] + values[:-1]) / 2:
            out += [Condition(name, "<=", float(cut)), Condition(name, ">", float(cut))]
    return out


def _grow(x: np.ndarray, bad: np.ndarray, bins: int, most: int) -> list[Condition]:
    """Adds the condition of highest information gain while the conjunction still covers good rows."""
    rule: list[Condition] = []
    while len(rule) < most and bad.any() and not bad.all():
        p0, n0 = bad.sum(), len(bad)
        tests = _candidates(x, bins)
        held = [c.holds(x) for c in tests]
        p, n = np.array([bad[h].sum() for h in held]), np.array([h.sum() for h in held])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - np.log2(p0 / n0)), -np.inf)
        if not len(gain) or gain.max() <= 1e-9:
            break
        best = int(gain.argmax())
        rule.append(tests[best])
        x, bad = x[held[best]], bad[held[best]]
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> tuple[list[Condition], float, int]:
    """The prefix of highest (bad - good) / covered on rows that did not grow the rule; its precision and cover."""
    best = ([], -2.0, 0.0, 0)
    for k in range(1, len(rule) + 1):
        held = reduce(np.logical_and, (c.holds(x) for c in rule[:k]))
        p, n = int(bad[held].sum()), int((~bad[held]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[1] or (worth == best[1] and p > best[3]):
            best = (rule[:k], worth, p / (p + n) if p + n else 0.0, p)
    return best[0], best[2], best[3]


def learn_list(x: np.ndarray, bad: np.ndarray, folds: np.ndarray, *, min_precision: float = 0.9, min_cover: int = 3, max_rules: int = 24, max_conditions: int = 4, bins: int = 64) -> list[Rule]:
    """Sequential covering: each rule grows on two thirds of what is left, is pruned on the other third and
    enters the list if it is precise enough there; the rows it covers then leave. Rows of each rule's thirds
    rotate, so that a later rule is not judged by the same third."""
    rules: list[Rule] = []
    left, turned_down = np.ones(len(bad), bool), 0
    while bad[left].any() and len(rules) < max_rules and turned_down < 3:
        third = left & (folds % 3 == (len(rules) + turned_down) % 3)
        grown = _grow(x[left & ~third], bad[left & ~third], bins, max_conditions)
        kept, precision, cover = _prune(grown, x[third], bad[third])
        if not kept or precision < min_precision or cover < min_cover:
            turned_down += 1
            continue
        rule = Rule(tuple(kept), precision)
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, **options) -> list[Rule]:
    """Rules for low quality (labels.quality = 0), from at most `sample` labelled ids, those of smallest hash, and one
    text of each, that of smallest hash.

    The base rules decide alone where they reject, so only what they leave is learned from.
    """
    picked = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by `sample`
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    stats = rows.select("doc_id", "quality", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(3)).alias("_fold"), statistics(text_of()).alias("s"))
    got = [r for r in stats.collect() if not r["s"]["base_failed"]]
    got.sort(key=lambda r: (r["doc_id"], *r["s"]))
    if not got:
        return []
    x = np.array([[r["s"][f] for f in FEATURES] for r in got], float)
    return learn_list(x, np.array([r["quality"] == 0 for r in got]), np.array([r["_fold"] for r in got]), **options)


def as_column(rules: list[Rule], stats: Column) -> Column:
    """The number (from 1) of the first rule that covers a row, 0 if none does."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(stats), 1)
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(stats), i)
    return out.otherwise(0)


def verdict(text: Column, rules: list[Rule]) -> Column:
    """The statistics of a text with rule (0: none) and kept."""

    def judged(s: Column) -> Column:
        fields = [s[name].alias(name) for name in (*COUNTS, *FEATURES, "base_failed")]
        rule = as_column(rules, s)
        return F.struct(*fields, rule.alias("rule"), (~s["base_failed"] & (rule == 0)).alias("kept"))

    return let(statistics(text), judged)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id and the verdict's fields, for every row of docs(doc_id, text)."""
    return docs.select("doc_id", verdict(text_of(), rules).alias("_v")).select("doc_id", "_v.*")


def filter_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that the base rules and the list keep, with docs' own columns.

    The verdict is computed on the row itself: ids need not be unique, and nothing is shuffled. It is a
    generator's argument and not a filter's, which Spark would evaluate once for every column that it names.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    kept = F.explode(F.filter(F.array(row), lambda r: verdict(F.coalesce(r["text"], F.lit("")), rules)["kept"]))
    return docs.select(kept.alias("_row")).select("_row.*")
