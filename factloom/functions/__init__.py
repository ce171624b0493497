"""Scalar functions of the fact model as column expressions; nothing here runs Python for a row."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


#: A word boundary between ASCII word characters. Java's own \b also looks at other letters; patterns here don't.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_words(pattern: str) -> str:
    return pattern.replace(r"\b", BOUNDARY)


def short_hash(*parts: Column, separator: str = SEPARATOR) -> Column:
    """The first 24 hex digits of sha256 over the parts."""
    return F.substring(F.sha2(F.concat_ws(separator, *parts), 256), 1, 24)


def identity_part(c: Column) -> Column:
    """Trimmed, with forward slashes. Names must be in NFC: normalised() brings them there."""
    return F.replace(F.trim(c), F.lit("\\"), F.lit("/"))


def normalised(df: DataFrame, *columns: str) -> DataFrame:
    """df with these columns in NFC. Spark has no function for it, so rows with other than ASCII in them go through
    Python; the others don't."""
    other = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).rlike(r"[^\x00-\x7F]"), F.lit(False)) for c in columns))

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return df.where(~other).union(df.where(other).withColumns({c: nfc(c) for c in columns}))


def entity_stable_key(repository: Column, kind: Column, language: Column, qualified_name: Column, syntax_path: Column | None = None) -> Column:
    """repo:kind:hash of who and where an entity is; null if it has neither a qualified name nor a syntax path."""
    name = F.when(F.trim(qualified_name) != "", F.concat(F.lit("name:"), identity_part(qualified_name)))
    if syntax_path is not None:
        name = F.coalesce(name, F.when(F.trim(syntax_path) != "", F.concat(F.lit("syntax:"), identity_part(syntax_path))))
    h = short_hash(identity_part(repository), F.coalesce(identity_part(language), F.lit("language-neutral")), identity_part(kind), name)
    return F.when(name.isNotNull(), F.concat_ws(":", repository, kind, h))


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(c))


def changed_fields(**pairs: tuple[Column, Column]) -> Column:
    """Names, in order, of the pairs that differ (nulls are equal)."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in sorted(pairs.items())]))


def normalize_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def normalize_endpoint_path(c: Column) -> Column:
    """Without the query, :id as {id}."""
    return F.regexp_replace(F.substring_index(c, "?", 1), r":([A-Za-z_$][\w$]*)", "{$1}")


def slug(c: Column) -> Column:
    """lower-case words joined by dashes; camel case counts as words."""
    words = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1-$2")
    return F.regexp_replace(F.regexp_replace(F.lower(words), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def title_from_path(c: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")
    words = F.filter(F.split(stem, r"[-_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


#: What counts as white space at the ends of a text: ASCII, no-break and Unicode's own, line ends.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_test_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]", ""), r"tests?$", "")


def file_range(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start, F.when(start != end, F.concat(F.lit("-"), end)).otherwise(""))


#: What counts as a secret in text, in this order, and what takes its place.
REDACTIONS = (
    (r"-----BEGIN [^-]*PRIVATE KEY-----[\s\S]*?-----END [^-]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"""(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|password|private[_-]?key|secret)\b(\s*[:=]\s*)(["']?)([^\s,"'\]}]+)\3""", "$1$2[REDACTED]"),
    (r"(?i)\b(Bearer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1[REDACTED]"),
    (r"(?i)(\b[a-z][a-z0-9+.-]*://[^\s:/]+:)([^@\s]+)(@)", "$1[REDACTED]$3"),
)


#: Of each pattern, lower-case texts one of which every match holds.
HINTS = (("private key-----",), ("key", "token", "secret", "password"), ("bearer",), ("://",))


def _word_edges(pattern: str) -> str:
    """Each word boundary as the one look-around that does: the patterns have a word character on its inner side."""
    return re.sub(r"^((?:\(\?i\))?\(?)\\b", r"\1(?<!\\w)", pattern).replace(r"\b", r"(?!\w)")


def redact_secrets(c: Column) -> Column:
    """A struct of the text without secrets and their number; each pattern runs on what the one before left."""

    def let(x: Column, body) -> Column:
        return F.get(F.transform(F.array(x), body), F.lit(0))

    def one(acc: Column, pattern: str, instead: str, hints: tuple[str, ...]) -> Column:
        def found(a: Column) -> Column:
            there = reduce(lambda x, y: x | y, (F.contains(a["lower"], F.lit(h)) for h in hints))
            clean = F.struct(F.regexp_replace(a["content"], pattern, instead).alias("content"), (a["count"] + F.regexp_count(a["content"], F.lit(pattern))).alias("count"), a["lower"].alias("lower"))
            return F.when(there, clean).otherwise(a)

        return let(acc, found)

    # a text without any of a pattern's hints can't match it; replacing adds none
    text = F.coalesce(c, F.lit(""))
    start = F.struct(text.alias("content"), F.lit(0).alias("count"), F.lower(text).alias("lower"))
    done = reduce(lambda acc, p: one(acc, _word_edges(p[0]), p[1], p[2]), zip(*zip(*REDACTIONS, strict=True), HINTS, strict=True), start)
    return let(done, lambda a: F.struct(a["content"].alias("content"), a["count"].alias("count")))


#: Folders that hold generated files, and file names that decide a file's kind.
GENERATED = (".gradle", ".idea", ".next", ".turbo", "build", "coverage", "dist", "generated", "node_modules", "out", "target")
BUILD_FILES = ("build.gradle", "build.gradle.kts", "package.json", "pnpm-lock.yaml", "pom.xml", "settings.gradle", "settings.gradle.kts", "tsconfig.json", "yarn.lock")
CONFIGURATION_FILES = (".env.example", "application.properties", "application.yaml", "application.yml", "bootstrap.yaml", "bootstrap.yml")


def file_policy(path: Column, size_bytes: Column, prefix: Column | None = None, max_bytes: int = 1 << 20) -> Column:
    """The kind of artifact that a file is, or rejected:<reason>."""
    p = normalize_path(path)
    name = F.lower(F.substring_index(p, "/", -1))
    lower = F.lower(p)
    is_test = lower.rlike(r"/(?:tests?|__tests__)/|[.-](?:spec|test)\.[^.]+$")
    return (
        F.when(F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, GENERATED))), "rejected:generated")
        .when(name.startswith(".env") & (name != ".env.example"), "rejected:environment-secret")
        .when(size_bytes > max_bytes, "rejected:oversized")
        .when(F.coalesce(F.instr(prefix, "\0") > 0, F.lit(False)) if prefix is not None else F.lit(False), "rejected:binary")
        .when(name.isin(*BUILD_FILES), "build")
        .when(name.isin(*CONFIGURATION_FILES) | name.endswith(".properties"), "configuration")
        .when(name.rlike(r"\.mdx?$"), "documentation")
        .when(name.rlike(r"\.(?:java|kts?|tsx?)$"), F.when(is_test, "test").otherwise("code"))
        .otherwise("rejected:unsupported")
    )


def language_of(path: Column) -> Column:
    name = F.lower(path)
    return F.when(name.endswith(".java"), "java").when(name.rlike(r"\.kts?$"), "kotlin").when(name.rlike(r"\.tsx?$"), "typescript")


#: Question patterns in the order in which they are tried.
INTENTS = (
    ("callers", r"(?i)\b(which|what|who)\s+(?:functions?\s+)?calls?\b|\bcallers?\s+of\b"),
    ("callees", r"(?i)\bwhat\s+does\b.*\bcall\b|\bcallees?\b|\bdepends?\s+on\b"),
    ("endpoint_flow", r"(?i)\bwhat\s+happens\b|\brequest\s+flow\b|\bendpoint\s+flow\b|\b(?:GET|POST|PUT|PATCH|DELETE)\s+/"),
    ("configuration_usage", r"(?i)\bconfigur(?:ed|ation)\b|\benvironment variable\b|\bwhere\s+is\b.*\bset\b"),
    ("test_impact", r"(?i)\btests?\b.*\b(?:run|affected|impact)\b|\bwhich\s+tests?\b"),
    ("documentation_impact", r"(?i)\bdocs?|documentation\b.*\b(?:affected|impact|stale)\b|\bwhich\s+docs?\b"),
    ("module_explanation", r"(?i)\bexplain\b.*\bmodule\b|\bmodule\s+overview\b"),
    ("entity_lookup", r"(?i)\bwhere\s+is\b|\bfind\b|\bwhat\s+is\b"),
)
_ENDPOINT = r"(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/[^\s?]+)"


def question_intent(c: Column) -> Column:
    q = F.trim(c)
    out = F.when(q == "", F.lit(None).cast("string"))
    for intent, pattern in INTENTS:
        out = out.when(q.rlike(ascii_words(pattern)), intent)
    return out.when(q.isNotNull(), "semantic_unknown")


def search_term(c: Column) -> Column:
    """METHOD /path, else what is quoted, else the first capitalised symbol, else a keyword's object, else all of it."""
    q = F.trim(c)
    some = lambda pattern, group: F.nullif(F.regexp_extract(q, ascii_words(pattern), group), F.lit(""))
    endpoint = ascii_words(_ENDPOINT)
    return F.coalesce(
        F.when(q.rlike(endpoint), F.concat_ws(" ", F.upper(F.regexp_extract(q, endpoint, 1)), F.regexp_extract(q, endpoint, 2))),
        some(r"""[`"']([^`"']{2,100})[`"']""", 1),
        some(r"\b([A-Z][A-Za-z0-9_$]*(?:\.[A-Za-z_$][\w$]*)?)\b", 1),
        some(r"(?i)\b(?:changing|configured|explain|uses?|calls?|for)\s+(?:the\s+)?([\w.$_/-]+)", 1),
        q,
    )


def cited(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(E[0-9]+)\]"), F.lit(1)))


def validate_citations(answer: Column, known: Column) -> Column:
    """(text without unknown citations, known ids that it cites, valid)."""
    ids = F.array_intersect(cited(answer), known)
    unknown = F.array_except(cited(answer), known)
    text = F.aggregate(unknown, answer, lambda acc, x: F.replace(acc, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
    text = F.trim(text)
    return F.struct(text.alias("text"), ids.alias("ids"), ((F.length(text) > 0) & ((F.size(known) == 0) | (F.size(ids) > 0))).alias("valid"))


def usable_vector(v: Column) -> Column:
    return (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def review_diff(before: Column, after: Column) -> Column:
    """A whole-file diff: all lines out, all lines in."""
    lines = lambda c, sign: F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit(sign), x))
    return F.array_join(F.concat(lines(before, "-"), lines(after, "+")), "\n")
