"""Routes of web frameworks joined to the declarations that handle them, and to the middleware in front.

Annotated routes (Spring, Nest) are read off declarations, to which structure.py has carried the annotations; called ones
(Express, Vert.x) off statements; Ktor's off statements and the route and authenticate blocks around them. All become
candidates with the name of a handler; the handler is the function or method of that name and file whose first line is
nearest to the route's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans import kept
from factloom.sources import structure
from factloom.sources.scanners import _joined_path

_MAPPING = r"(?s)^@(Get|Post|Put|Patch|Delete|Request)Mapping\s*(?:\((.*)\))?$"
_SECURITY = r"^@(PreAuthorize|Secured|RolesAllowed)\b"
_DECORATOR = r"(?s)^@(Get|Post|Put|Patch|Delete|Head|Options)\s*(?:\((.*)\))?$"
_GUARD = r"(?s)^@(?:UseGuards|UseInterceptors|UsePipes)\s*\((.*)\)$"
_VERB = "get|post|put|patch|delete|head|options"
_EXPRESS = rf"(?is)^(?:await\s+)?([A-Za-z_$][\w$]*)\.({_VERB})\s*\((.*)\)$"
_ROUTER = r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:express\.)?Router\s*\("
_MOUNT = r"""\b(?:app|router)\.use\s*\(\s*([^,]+),\s*([A-Za-z_$][\w$]*)\s*\)"""
_VERTX = rf"(?i)\brouter\.({_VERB})\s*\(\s*([^)]*)\)"
_VERTX_BY_METHOD = r"\brouter\.route\s*\(\s*([^)]*)\)\s*\.method\s*\(\s*HttpMethod\.([A-Z]+)\s*\)"
_KTOR = rf"(?i)^({_VERB})\s*\(\s*([^)]*)\)$"
_SCOPE = r"\b(route|authenticate)\s*\(\s*([^)]*)\)\s*$"
_NAME = r"^[A-Za-z_$][\w$]*$"

CANDIDATE = ("path", "line", "framework", "method", "expression", "prefix", "handler", "middleware", "request_type", "response_type")


def literal(expression: Column) -> Column:
    """What a string literal says; empty for nothing, null for anything else."""
    text = F.trim(F.coalesce(expression, F.lit("")))
    inner = F.regexp_extract(text, r"""^["'`]([^"'`]*)["'`]$""", 1)
    return F.when(text == "", "").when(text.rlike(r"""^["'`][^"'`]*["'`]$"""), inner)


def _assigned(arguments: Column) -> Column:
    """The value or path of a mapping's arguments, else all of them."""
    named = F.regexp_extract(arguments, r"""(?:path|value)\s*=\s*(["'`][^"'`]*["'`])""", 1)
    return F.when(named != "", named).otherwise(arguments)


def _notes(pattern: str, group: int, column: str = "notes") -> Column:
    return F.transform(F.filter(column, lambda n: n.rlike(pattern)), lambda n: F.regexp_extract(n, pattern, group))


def _annotated(declarations: DataFrame) -> DataFrame:
    """Candidates of Spring controllers and Nest controllers."""
    owner = declarations.where("kind = 'class'").select(F.col("id").alias("owner"), F.col("notes").alias("_class"))
    rows = declarations.where("kind = 'method' and size(notes) > 0").join(owner, "owner")
    arguments = F.get(_notes(_MAPPING, 2), F.size(_notes(_MAPPING, 2)) - 1)
    word = F.get(_notes(_MAPPING, 1), F.size(_notes(_MAPPING, 1)) - 1)
    asked = F.regexp_extract_all(arguments, F.lit(r"RequestMethod\.([A-Z]+)"), F.lit(1))
    methods = F.when(word == "Request", F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit("ANY")))).otherwise(F.array(F.upper(word)))
    prefix = F.coalesce(literal(_assigned(F.element_at(F.concat(F.array(F.lit("")), _notes(_MAPPING, 2, "_class")), -1))), F.lit(""))
    spring = rows.where((F.col("language") == "java") & F.exists("_class", lambda n: n.rlike(r"^@(?:\w+\.)*RestController\b")) & F.exists("notes", lambda n: n.rlike(_MAPPING)))
    body = F.nullif(F.regexp_extract("text", r"@RequestBody\s+([\w.<>?]+)", 1), F.lit(""))
    returned = F.nullif(F.regexp_extract(F.regexp_replace("text", structure._NOTE, ""), r"([\w.<>?\[\]]+)\s+[A-Za-z_$][\w$]*\s*\(", 1), F.lit(""))
    spring = spring.select("path", F.col("start_line").alias("line"), F.lit("spring").alias("framework"), F.explode(methods).alias("method"), _assigned(arguments).alias("expression"), prefix.alias("prefix"), F.col("name").alias("handler"), F.concat(_notes(_SECURITY, 1, "_class"), _notes(_SECURITY, 1)).alias("middleware"), body.alias("request_type"), returned.alias("response_type"))
    listed = lambda column: F.filter(F.transform(F.flatten(F.transform(_notes(_GUARD, 1, column), lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")
    controller = r"(?s)^@Controller\s*\((.*)\)$"
    nest = rows.where((F.col("language") == "typescript") & F.exists("_class", lambda n: n.rlike(controller)) & F.exists("notes", lambda n: n.rlike(_DECORATOR)))
    root = F.coalesce(literal(F.get(_notes(controller, 1, "_class"), F.lit(0))), F.lit(""))
    taken = F.nullif(F.regexp_extract("text", r"@Body\s*\([^)]*\)\s*[A-Za-z_$][\w$]*\s*:\s*([\w.<>\[\]]+)", 1), F.lit(""))
    given = F.regexp_extract("text", r"\)\s*:\s*([^\n{=()]+)$", 1)
    given = F.nullif(F.regexp_replace(F.trim(given), r"^Promise<(.+)>$", "$1"), F.lit(""))
    last = lambda n: F.element_at(_notes(_DECORATOR, n), -1)
    nest = nest.select("path", F.col("start_line").alias("line"), F.lit("nest").alias("framework"), F.upper(last(1)).alias("method"), last(2).alias("expression"), root.alias("prefix"), F.col("name").alias("handler"), F.concat(listed("_class"), listed("notes")).alias("middleware"), taken.alias("request_type"), given.alias("response_type"))
    return spring.unionByName(nest)


def _called(statements: DataFrame) -> DataFrame:
    """Candidates of Express and Vert.x, whose handlers are arguments."""
    none = F.lit(None).cast("string")
    typescript = statements.where("language = 'typescript'")
    receivers = typescript.select("path", F.regexp_extract("head", _ROUTER, 1).alias("receiver")).where("receiver <> ''").distinct()
    mounts = typescript.where(F.col("head").rlike(_MOUNT)).groupBy("path", F.regexp_extract("head", _MOUNT, 2).alias("receiver")).agg(F.max_by(literal(F.regexp_extract("head", _MOUNT, 1)), "start").alias("mount"))
    express = typescript.where(F.col("head").rlike(_EXPRESS)).withColumn("receiver", F.regexp_extract("head", _EXPRESS, 1))
    known = express.join(receivers.withColumn("_known", F.lit(True)), ["path", "receiver"], "left").where(F.col("receiver").isin("app", "router") | F.col("_known"))
    known = known.join(mounts, ["path", "receiver"], "left")
    arguments = F.transform(F.split(F.regexp_extract("head", _EXPRESS, 3), ","), lambda x: F.trim(x))
    names = F.filter(F.slice(arguments, 2, 1000), lambda x: x.rlike(_NAME))
    prefix = F.when(F.col("receiver") == "app", "").otherwise(F.coalesce("mount", F.lit("")))
    express = known.select("path", "line", F.lit("express").alias("framework"), F.upper(F.regexp_extract("head", _EXPRESS, 2)).alias("method"), arguments[0].alias("expression"), prefix.alias("prefix"), names.alias("_names"))
    jvm = statements.where(F.col("language").isin("java", "kotlin") & (F.col("head").rlike(_VERTX) | F.col("head").rlike(_VERTX_BY_METHOD)))
    direct = F.regexp_extract("head", _VERTX, 1)
    method = F.when(direct != "", F.upper(direct)).otherwise(F.regexp_extract("head", _VERTX_BY_METHOD, 2))
    expression = F.when(direct != "", F.regexp_extract("head", _VERTX, 2)).otherwise(F.regexp_extract("head", _VERTX_BY_METHOD, 1))
    handlers = F.transform(F.regexp_extract_all("head", F.lit(r"\.handler\s*\(\s*([^)]*)\)"), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r"^(?:this|[A-Za-z_$][\w$]*)::", ""))
    vertx = jvm.select("path", "line", F.lit("vertx").alias("framework"), method.alias("method"), expression.alias("expression"), F.lit("").alias("prefix"), F.filter(handlers, lambda x: x.rlike(_NAME)).alias("_names"))
    both = express.unionByName(vertx)
    n = F.size("_names")
    handler = F.when(n > 0, F.element_at("_names", -1))
    return both.select("path", "line", "framework", "method", "expression", "prefix", handler.alias("handler"), F.when(n > 0, F.slice("_names", 1, n - 1)).alias("middleware"), none.alias("request_type"), none.alias("response_type"))


def _nested(statements: DataFrame) -> DataFrame:
    """Candidates of Ktor: the blocks around a route give its prefix, its handler and what it is behind."""
    kotlin = statements.where("language = 'kotlin'")
    name = F.regexp_extract("head", r"\bfun\s+(?:[\w.<>?]+\.)?([A-Za-z_$][\w$]*)\s*\(", 1)
    scope = F.regexp_extract("head", _SCOPE, 1)
    kind = F.when(name != "", "function").otherwise(scope)
    # a body's name is its function's, or what its scope says
    bodies = kotlin.where("open is not null").select(F.concat_ws("#", "path", F.col("start").cast("string")).alias("id"), "path", "open", "close", kind.alias("kind"), F.when(name != "", name).otherwise(F.regexp_extract("head", _SCOPE, 2)).alias("name")).where("kind <> ''")
    routes = kotlin.where(F.col("open").isNotNull() & F.col("head").rlike(_KTOR)).withColumn("id", F.concat_ws("#", "path", F.col("start").cast("string")))
    around = structure.enclosing(routes.select("id", "path", F.col("start").alias("at")), bodies)
    plugins = kotlin.select("path", "start", F.regexp_extract("head", r"\binstall\s*\(\s*([A-Za-z_$][\w$]*)\s*\)", 1).alias("p")).where("p <> ''")
    plugins = plugins.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "p"))), lambda x: F.concat(F.lit("plugin:"), x["p"])).alias("_plugins"))
    rows = routes.join(around, "id").join(plugins, "path", "left")
    of = lambda k: F.filter("around", lambda x: x["kind"] == k)
    prefix = F.array_join(F.filter(F.transform(of("route"), lambda x: literal(x["name"])), lambda x: x.isNotNull()), "/")
    behind = F.transform(of("authenticate"), lambda x: F.concat(F.lit("authenticate:"), F.coalesce(literal(x["name"]), F.lit("dynamic"))))
    none = F.lit(None).cast("string")
    handler = F.get(F.transform(of("function"), lambda x: x["name"]), F.size(of("function")) - 1)
    found = rows.select("path", "line", F.lit("ktor").alias("framework"), F.upper(F.regexp_extract("head", _KTOR, 1)).alias("method"), F.regexp_extract("head", _KTOR, 2).alias("expression"), prefix.alias("prefix"), handler.alias("handler"), F.concat(F.coalesce("_plugins", F.array().cast("array<string>")), behind).alias("middleware"), none.alias("request_type"), none.alias("response_type"))
    return found.where("handler is not null")


def candidates(statements: DataFrame, declarations: DataFrame) -> DataFrame:
    """CANDIDATE's columns of every route of structure.statements() and their structure.declared()."""
    return kept(_annotated(declarations).unionByName(_called(statements)).unionByName(_nested(statements)).select(*CANDIDATE))


def enrich(found: DataFrame, declarations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(endpoints, relationships, diagnostics) of candidates().

    endpoints: id, path, line, framework, method, route, handler (an id), request_type, response_type. relationships:
    kind (HANDLES from handler to endpoint, USES_MIDDLEWARE from endpoint to middleware), source, target, ordinal.
    diagnostics: path, line, severity, code, message of routes that are no static string and of handlers that the file
    lacks; a route without any handler's name is left out.
    """
    found = found.withColumn("_route", literal(F.col("expression")))
    dynamic = found.where("_route is null").select("path", "line", F.lit("warning").alias("severity"), F.concat(F.upper("framework"), F.lit("_DYNAMIC_ROUTE")).alias("code"), F.concat_ws(" ", F.lit("Route expression"), F.trim("expression"), F.lit("is not a supported static string")).alias("message")).distinct()
    static = found.where("_route is not null and handler is not null").withColumn("route", _joined_path(F.col("prefix"), F.col("_route")))
    static = static.withColumn("_c", F.sha2(F.concat_ws("\x1f", "path", F.col("line").cast("string"), "framework", "method", "route", "handler"), 256))
    able = declarations.where(F.col("kind").isin("function", "method")).select("path", F.col("name").alias("handler"), F.col("id").alias("_id"), "start_line")
    near = static.select("_c", "path", "line", "handler").distinct().join(able, ["path", "handler"])
    near = near.groupBy("_c").agg(F.min_by("_id", F.struct(F.abs(F.col("start_line") - F.col("line")), "start_line", "_id")).alias("_id"))
    static = static.join(near, "_c", "left")
    missing = static.where("_id is null").select("path", "line", F.lit("warning").alias("severity"), F.concat(F.upper("framework"), F.lit("_FRAMEWORK_UNRESOLVED_HANDLER")).alias("code"), F.concat_ws(" ", F.lit("Handler"), "handler", F.lit("could not be resolved in the source artifact")).alias("message")).distinct()
    named = static.where("_id is not null").withColumn("id", F.concat(F.col("path"), F.lit("#endpoint:"), "method", F.lit(":"), "route", F.lit(":"), "_id"))
    one = F.min_by(F.struct("path", "line", "framework", "method", "route", F.col("_id").alias("handler"), "request_type", "response_type", "middleware"), "line")
    endpoints = named.groupBy("id").agg(one.alias("e")).select("id", "e.*")
    handles = endpoints.select(F.lit("HANDLES").alias("kind"), F.col("handler").alias("source"), F.col("id").alias("target"), F.lit(None).cast("int").alias("ordinal"))
    uses = endpoints.select("id", "path", F.posexplode("middleware").alias("ordinal", "name")).select(F.lit("USES_MIDDLEWARE"), F.col("id"), F.concat("path", F.lit("#middleware:"), "name"), "ordinal")
    return endpoints.drop("middleware"), handles.union(uses), dynamic.union(missing)
