"""Declarations, imports, calls and routes of source files, by line scans, and their resolution by joins.

There is no type checker here: declarations are what a line declares, and a reference resolves by name where exactly
one symbol answers to it. Everything is built-in functions over exploded lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import normalize_endpoint_path

#: What a line declares, by language: kind and a pattern whose first group is the name.
DECLARATIONS = {
    "java": (("class", r"\b(?:class|record|enum)\s+([A-Za-z_$][\w$]*)"), ("interface", r"\binterface\s+([A-Za-z_$][\w$]*)"), ("method", r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?.]+\s+([a-z_$][\w$]*)\s*\(")),
    "kotlin": (("class", r"\b(?:class|object)\s+([A-Za-z_][\w]*)"), ("interface", r"\binterface\s+([A-Za-z_][\w]*)"), ("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?.]+\.)?([A-Za-z_][\w]*)\s*\(")),
    "typescript": (("class", r"\bclass\s+([A-Za-z_$][\w$]*)"), ("interface", r"\binterface\s+([A-Za-z_$][\w$]*)"), ("function", r"\bfunction\s+([A-Za-z_$][\w$]*)"), ("function", r"\bconst\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"), ("test", r"""\b(?:it|test)\(\s*["'`]([^"'`]+)""")),
}
IMPORTS = {"java": r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", "kotlin": r"^\s*import\s+([\w.]+)", "typescript": r"""\bfrom\s+["']([^"']+)["']"""}
HERITAGE = r"\b(extends|implements)\s+([A-Za-z_$][\w$.]*)"
CALL = r"\b([A-Za-z_$][\w$]*)\s*\("
#: Words before a bracket that call nothing.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "constructor", "super", "new", "fun", "when", "synchronized")


def lines(artifacts: DataFrame) -> DataFrame:
    """path, language, line, text of artifacts(path, language, content), without comments on their own line."""
    rows = artifacts.select("path", "language", F.posexplode(F.split("content", r"\r?\n")).alias("at", "text"))
    return rows.where(~F.col("text").rlike(r"^\s*(//|\*|/\*)")).select("path", "language", (F.col("at") + 1).alias("line"), "text")


def _per_language(patterns: dict, make):
    out = F.lit(None)
    for language, p in patterns.items():
        out = F.when(F.col("language") == language, make(p)).otherwise(out)
    return out


def declarations(rows: DataFrame) -> DataFrame:
    """path, language, line, kind, name."""
    found = _per_language(DECLARATIONS, lambda ps: F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", p, 1).alias("name")) for kind, p in ps]))
    return rows.select("path", "language", "line", F.explode(found).alias("d")).where("d.name <> ''").select("path", "language", "line", "d.*").distinct()


def imports(rows: DataFrame) -> DataFrame:
    name = _per_language(IMPORTS, lambda p: F.regexp_extract("text", p, 1))
    return rows.select("path", "line", name.alias("target")).where("target <> ''")


def heritage(rows: DataFrame) -> DataFrame:
    hits = F.regexp_extract_all("text", F.lit(HERITAGE), F.lit(0))
    return rows.select("path", "line", F.explode(hits).alias("h")).select("path", "line", F.upper(F.regexp_extract("h", HERITAGE, 1)).alias("kind"), F.regexp_extract("h", HERITAGE, 2).alias("target"))


def calls(rows: DataFrame) -> DataFrame:
    names = F.filter(F.regexp_extract_all("text", F.lit(CALL), F.lit(1)), lambda x: ~x.isin(*NOT_CALLS))
    return rows.select("path", "line", F.explode(F.array_distinct(names)).alias("target"))


def resolved(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """references (path, line, target) with the one declaration (path, name) that answers to the target's last part."""
    only = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("target_path")).where("n = 1")
    return references.withColumn("name", F.substring_index("target", ".", -1)).join(only.drop("n"), "name").select("path", "line", "name", "target_path")


#: Routes: framework, language, pattern of a class's or mount's prefix, pattern of a route (groups: method, path).
ROUTES = (
    ("spring", "java", r"""@RequestMapping\(\s*(?:value\s*=\s*)?"([^"]*)\"""", r"""@(Get|Post|Put|Patch|Delete)Mapping(?:\(\s*(?:value\s*=\s*)?"([^"]*)\")?"""),
    ("nest", "typescript", r"""@Controller\(\s*["'`]([^"'`]*)""", r"""@(Get|Post|Put|Patch|Delete|Head|Options)\(\s*["'`]?([^"'`)]*)"""),
    ("express", "typescript", r"""\.use\(\s*["'`]([^"'`]+)["'`]\s*,\s*\w+""", r"""\b(?:app|router|\w*[Rr]outer)\.(get|post|put|patch|delete)\(\s*["'`]([^"'`]+)"""),
    ("vertx", "java", None, r"""\brouter\.(get|post|put|patch|delete)\(\s*"([^"]+)\""""),
    ("vertx", "kotlin", None, r"""\brouter\.(get|post|put|patch|delete)\(\s*"([^"]+)\""""),
)
KTOR_SCOPE = r"""\broute\(\s*"([^"]*)\""""
KTOR_ROUTE = r"""\b(get|post|put|patch|delete)(?:\(\s*"([^"]*)\"\s*\))?\s*\{"""


def _joined_path(prefix, path):
    whole = F.concat(F.lit("/"), F.coalesce(prefix, F.lit("")), F.lit("/"), F.coalesce(path, F.lit("")))
    return normalize_endpoint_path(F.regexp_replace(F.regexp_replace(whole, "/+", "/"), "(?<=.)/$", ""))


def endpoints(artifacts: DataFrame) -> DataFrame:
    """path, line, framework, method, route of Spring, Nest, Express, Vert.x and Ktor sources.

    A file's prefix (a class's mapping, a controller, a mount) goes in front of its routes; Ktor's nest by braces,
    a stack folded over the file's lines.
    """
    out = None
    for framework, language, prefix, route in ROUTES:
        rows = lines(artifacts.where(F.col("language") == language))
        hits = rows.where(F.col("text").rlike(route)).select("path", "line", F.upper(F.regexp_extract("text", route, 1)).alias("method"), F.regexp_extract("text", route, 2).alias("own"))
        if prefix:
            first = rows.where(F.col("text").rlike(prefix)).groupBy("path").agg(F.min_by(F.regexp_extract("text", prefix, 1), "line").alias("prefix"))
            hits = hits.join(first, "path", "left")
            if framework == "nest":
                hits = hits.where("prefix is not null")
        else:
            hits = hits.withColumn("prefix", F.lit(None).cast("string"))
        found = hits.select("path", "line", F.lit(framework).alias("framework"), "method", _joined_path(F.col("prefix"), F.col("own")).alias("route"))
        out = found if out is None else out.union(found)
    return out.union(_ktor(artifacts.where(F.col("language") == "kotlin")))


def _ktor(artifacts: DataFrame) -> DataFrame:
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<depth:int,prefix:string>>").alias("scopes"), F.array().cast("array<struct<line:int,method:string,route:string>>").alias("out"))

    def step(acc, x):
        text = x["text"]
        route = F.regexp_extract(text, KTOR_ROUTE, 1)
        scope = F.regexp_extract(text, KTOR_SCOPE, 1)
        prefix = F.array_join(F.transform(acc["scopes"], lambda s: s["prefix"]), "/")
        found = F.struct(x["line"].alias("line"), F.upper(route).alias("method"), _joined_path(prefix, F.regexp_extract(text, KTOR_ROUTE, 2)).alias("route"))
        opened = F.when(scope != "", F.array_append(acc["scopes"], F.struct((acc["depth"] + 1).alias("depth"), scope.alias("prefix")))).otherwise(acc["scopes"])
        depth = acc["depth"] + count(text, "{") - count(text, "}")
        return F.struct(depth.alias("depth"), F.filter(opened, lambda s: s["depth"] <= depth).alias("scopes"), F.when(route != "", F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    numbered = F.transform(F.split("content", r"\r?\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    rows = artifacts.where(F.col("content").contains("routing") | F.col("content").contains("Route.")).select("path", F.explode(F.aggregate(numbered, zero, step, lambda a: a["out"])).alias("r"))
    return rows.select("path", "r.line", F.lit("ktor").alias("framework"), "r.method", "r.route")
