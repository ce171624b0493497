"""Markdown sections, documentation claims, their comparison with facts, gaps and health."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import collapse_space, normalize_endpoint_path, title_from_path
from factloom.operators.impact import AUTH
from factloom.plans import kept

#: A heading's and a fence's line.
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*\Z")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")


def _sections(text: str) -> list[tuple[int, str, list[str], int, int, str]]:
    """(level, title, heading path, first line, last line, body) in order; fenced lines are no headings."""
    lines, marks, fence = text.split("\n"), [], ""
    for n, line in enumerate(lines, 1):
        opened = _FENCE.match(line)
        if opened:
            fence = "" if fence == opened[1][0] else fence or opened[1][0]
        elif not fence and (h := _HEADING.match(line)):
            marks.append((n, len(h[1]), h[2]))
    out, path = [], []
    preface = "\n".join(lines[: marks[0][0] - 1] if marks else lines)
    if not marks or preface.strip():
        out.append((0, "Overview", ["Overview"], 1, marks[0][0] - 1 if marks else len(lines), preface))
    for i, (n, level, title) in enumerate(marks):
        path = [p for p in path if p[0] < level] + [(level, title)]
        last = marks[i + 1][0] - 1 if i + 1 < len(marks) else len(lines)
        out.append((level, title, [t for _, t in path], n, last, "\n".join(lines[n:last])))
    return out


def _batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def parse_markdown(pages: DataFrame) -> DataFrame:
    """path, level, title, heading_path, line_start, line_end, body, occurrence for pages(path, content).

    A page is one row of a scan: fences and the heading stack need its lines in order, nothing beyond it.
    """

    text, number = pa.string(), pa.int32()
    schema = pa.schema({"path": text, "level": number, "title": text, "heading_path": pa.list_(text), "line_start": number, "line_end": number, "body": text, "occurrence": number}.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                seen: dict[str, int] = {}
                for level, title, heading, start, end, body in _sections(content or ""):
                    key = "/".join(heading).lower()
                    seen[key] = seen.get(key, -1) + 1
                    rows.append((path, level, title, heading, start, end, body, seen[key]))
            yield _batch(rows, schema)

    return pages.select("path", "content").mapInArrow(run, "path string, level int, title string, heading_path array<string>, line_start int, line_end int, body string, occurrence int")


#: Claim patterns; the configuration pattern ignores case on purpose, so it also takes plain words.
CLAIMS = (
    ("endpoint", 1.0, re.compile(r"\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+`?(/[^\s`),;]+)", re.I)),
    ("configuration", 0.95, re.compile(r"""`?([A-Za-z][\w-]*(?:\.[\w-]+)+|[A-Z][A-Z0-9_]{2,})`?\s*(?:=|:|is)\s*[`"']?([^\s`"',;.]+)""", re.I | re.A)),
    ("source_link", 1.0, re.compile(r"\[[^\]]*\]\(([^)\s]+\.(?:java|kt|kts|js|jsx|ts|tsx|json|ya?ml|properties|xml|md)(?:#[^)]*)?)\)", re.I)),
    ("entity", 0.9, re.compile(r"`([A-Z][A-Za-z0-9_$]*(?:\.[A-Za-z_$][\w$]*(?:\(\))?)?)`", re.A)),
    ("entity", 0.55, re.compile(r"\b(?:class|function|module|service)\s+([A-Z][A-Za-z0-9_$]+)", re.I)),
    ("command", 0.95, re.compile(r"^\s*(?:\./)?(?:gradlew|mvnw)\b.*$|^\s*(?:gradle|mvn|npm|pnpm|yarn)\b.*$", re.I | re.M)),
)


def extract_claims(sections: DataFrame) -> DataFrame:
    """path, line, kind, subject, value, confidence, ordinal: endpoint (METHOD, path), configuration (key, value),
    source_link (path), entity (name) and command, from parse_markdown's sections."""

    text = pa.string()
    schema = pa.schema({"path": text, "line": pa.int32(), "kind": text, "subject": text, "value": text, "confidence": pa.float64(), "ordinal": pa.int32()}.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {}  # in order, once each
            for path, level, start, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                first = start if level == 0 else start + 1
                breaks = [m.start() for m in re.finditer("\n", body)]
                for order, (kind, confidence, pattern) in enumerate(CLAIMS):
                    for m in pattern.finditer(body):
                        line = first + bisect_left(breaks, m.start())
                        if kind == "endpoint":
                            subject, value = m[1].upper(), re.sub(r":([A-Za-z_$][\w$]*)", r"{\1}", m[2].split("?")[0])
                        elif kind == "configuration":
                            subject, value = m[1], m[2]
                            if subject.startswith("http"):
                                continue
                        elif kind == "command":
                            subject, value = m[0].strip(), None
                        elif kind == "source_link":
                            subject, value = m[1].split("#")[0], None
                        else:
                            subject, value = m[1].removesuffix("()"), None
                        rows[path, line, kind, subject, value, confidence, order] = None
            yield _batch(rows, schema)

    return sections.select("path", "level", "line_start", "body").mapInArrow(run, "path string, line int, kind string, subject string, value string, confidence double, ordinal int")


def _finding(df: DataFrame, kind: str, severity: str, status: str = "confirmed", suggestion: str | None = None) -> DataFrame:
    better = F.col(suggestion) if suggestion else F.lit(None).cast("string")
    return df.select("path", "line", "subject", "value", F.lit(kind).alias("finding"), F.lit(severity).alias("severity"), F.lit(status).alias("status"), better.alias("suggestion"))


def compare_claims(claims: DataFrame, endpoints: DataFrame, names: DataFrame, configuration: DataFrame, commands: DataFrame, paths: DataFrame) -> DataFrame:
    """path, line, subject, value, finding, severity, status and suggestion of claims that facts don't bear out.

    Facts: endpoints(method, path), names(name, qualified_name), configuration(key, value, and ordinal, by which the
    first of a key's definitions counts, else the least value), commands(command), paths(path). A method's only path
    is suggested for a stale endpoint, the actual value for a stale configuration. All are equi-joins: a dotted suffix of a qualified name is exploded into the names it answers to.
    """
    claims = kept(claims)  # the pages are read once for all kinds
    of = lambda kind: claims.where(F.col("kind") == kind)
    known = endpoints.select(F.upper("method").alias("subject"), normalize_endpoint_path(F.col("path")).alias("value")).distinct()
    only = known.groupBy("subject").agg(F.count("*").alias("_n"), F.min("value").alias("_path")).where("_n = 1").select("subject", "_path")
    stale_endpoint = of("endpoint").join(known, ["subject", "value"], "left_anti").join(only, "subject", "left")
    parts = F.split("qualified_name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    answers = names.select(F.explode(F.array_distinct(F.array_compact(F.concat(F.array("name", "qualified_name"), F.coalesce(suffixes, F.array().cast("array<string>")))))).alias("subject")).distinct()
    lost = of("entity").join(answers, "subject", "left_anti")
    auth = F.lower("subject").rlike(AUTH)
    sure = F.col("confidence") >= 0.8
    first = configuration.groupBy(F.col("key").alias("subject")).agg(F.count("*").alias("n"), F.min(F.struct(*[c for c in ("ordinal",) if c in configuration.columns], "value")).alias("_first")).withColumn("actual", F.col("_first.value"))
    keyed = of("configuration").join(first, "subject", "left")
    wrong = keyed.where(F.col("n").isNull() | (F.col("actual").isNotNull() & (F.col("actual") != F.col("value"))))
    run = of("command").withColumn("command", collapse_space(F.col("subject")))
    stale_command = run.join(commands.select(collapse_space(F.col("command")).alias("command")).distinct(), "command", "left_anti")
    linked = of("source_link").join(paths.select(F.col("path").alias("subject")).distinct(), "subject", "left_anti")
    found = [
        _finding(stale_endpoint, "stale_endpoint", "high", suggestion="_path"),
        _finding(lost.where(~sure), "ambiguous_claim", "informational", "review"),
        _finding(lost.where(sure & auth), "removed_entity", "high"),
        _finding(lost.where(sure & ~auth), "removed_entity", "low"),
        _finding(wrong, "stale_configuration", "high", suggestion="actual"),
        _finding(stale_command, "stale_command", "medium"),
        _finding(linked, "stale_source_link", "low"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def detect_gaps(entities: DataFrame, claims: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """stable_key, gap: endpoints, modules and configuration keys that no claim names, then changed entities that
    none names either. entities: stable_key, kind, name."""
    named = claims.select(F.explode(F.array_distinct(F.array(F.coalesce("value", "subject"), "subject"))).alias("name")).distinct()
    silent = entities.join(named if changed is None else kept(named), "name", "left_anti")
    gaps = silent.where(F.col("kind").isin("endpoint", "module", "configuration_key")).select("stable_key", F.col("kind").alias("gap"))
    if changed is None:
        return gaps
    more = silent.join(changed.select("stable_key").distinct(), "stable_key", "left_semi").join(gaps, "stable_key", "left_anti")
    return gaps.union(more.select("stable_key", F.lit("changed_component").alias("gap")))


#: What a finding of each severity costs.
PENALTY = {"high": 15, "medium": 8, "low": 3, "informational": 1}


def health(findings: DataFrame, gaps: DataFrame, completeness: float = 1.0) -> DataFrame:
    """One row: score (0 to 100), the counts it is made of, how many findings are confirmed and how many are for review,
    and an explanation of the sum. completeness counts as 0 to 1."""
    missing = math.floor((1 - max(0.0, min(1.0, completeness))) * 20 + 0.5)
    confirmed = F.count_if(F.col("status") == "confirmed")
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in PENALTY], F.count("*").alias("findings"), confirmed.alias("confirmed")).withColumn("_", F.lit(1))
    both = counts.join(gaps.agg(F.count("*").alias("gaps")).withColumn("_", F.lit(1)), "_").drop("_")  # one row each
    penalty = sum((F.col(s) * p for s, p in PENALTY.items()), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty - F.col("gaps") - missing)).cast("int")
    said = F.format_string(f"100 - %d finding penalty - %d gap penalty - {missing} indexing penalty = %d", penalty, F.col("gaps"), score)
    return both.select("*", (F.col("findings") - F.col("confirmed")).alias("review"), score.alias("score"), said.alias("explanation"))


def mermaid(edges: DataFrame, n: int = 30) -> DataFrame:
    """One row: a flow chart of the first n edges(kind, source, target) by source, kind, target; nodes are E1.. by name."""
    first = edges.select("source", "kind", "target").distinct().orderBy("source", "kind", "target").limit(n)
    rows = first.agg(F.array_sort(F.collect_list(F.struct("source", "kind", "target"))).alias("e"))
    names = F.array_sort(F.array_distinct(F.concat(F.transform("e", lambda x: x["source"]), F.transform("e", lambda x: x["target"]))))
    clean = lambda c: F.substring(F.regexp_replace(c, r"[\"\[\]{}|<>\n]+", " "), 1, 80)
    id_ = lambda c: F.concat(F.lit("E"), F.array_position(F.col("names"), c).cast("string"))
    rows = rows.withColumn("names", names)
    nodes = F.transform("names", lambda x: F.concat(F.lit("  "), id_(x), F.lit('["'), clean(x), F.lit('"]')))
    links = F.transform("e", lambda x: F.concat(F.lit("  "), id_(x["source"]), F.lit(" -->|"), x["kind"], F.lit("| "), id_(x["target"])))
    return rows.select(F.array_join(F.concat(F.array(F.lit("flowchart LR")), nodes, links), "\n").alias("diagram"))


def page_titles(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """path and title of pages(path): the first heading of level 1, else what the path says."""
    first = sections.where("level = 1").groupBy("path").agg(F.min_by("title", "line_start").alias("_title"))
    return pages.select("path").join(first, "path", "left").select("path", F.coalesce("_title", title_from_path(F.col("path"))).alias("title"))


def reusable_pages(previous: DataFrame, pages: DataFrame, affected: DataFrame) -> DataFrame:
    """The pages(path, content_hash) that need no new analysis: previous has them with the same hash, and affected(path)
    doesn't name them."""
    same = pages.join(previous.select("path", "content_hash"), ["path", "content_hash"], "left_semi")
    return same.join(affected.select("path").distinct(), "path", "left_anti")


def select_findings(findings: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    """findings of a severity and a status, where asked for."""
    for column, value in (("severity", severity), ("status", status)):
        findings = findings if value is None else findings.where(F.col(column) == value)
    return findings
