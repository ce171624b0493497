"""Resolution of Java and Kotlin references among a repository's declarations, by what a file can see.

A reference asks for a name; what may answer to it is a qualified name (its own, or one that is imported, also by an
alias) or a name in a package (its own, or one imported whole). Questions and symbols are turned into such keys and meet
in one equi-join; of equal questions of a file one is asked, and one for all files that see a name by the same keys. What
is left of the answers after kind, number of parameters and owner is resolved if it is one, ambiguous if more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.provenance import closest_enclosing
from factloom.plans import kept
from factloom.sources import scanners

#: What may answer, by what is wanted.
KINDS = {"type": ("class", "interface", "object"), "callable": ("class", "constructor", "function", "method"), "constructor": ("constructor",)}
#: How a symbol is seen, the closest first.
RANKS = ("exact", "import", "package", "wildcard", "alias")

IMPORT = {"java": r"^\s*import\s+(static\s+)?([\w.$]+?)(\.\*)?\s*;", "kotlin": r"^\s*import\s+()([\w.]+?)(\.\*)?(?:\s+as\s+(\w+))?\s*$"}


def imports(artifacts: DataFrame) -> DataFrame:
    """path, qualified_name, wildcard, alias of the import lines of artifacts(path, language, content)."""
    rows = scanners.lines(artifacts)
    group = lambda n: F.when(F.col("language") == "java", F.regexp_extract("text", IMPORT["java"], n)).when(F.col("language") == "kotlin", F.regexp_extract("text", IMPORT["kotlin"], n))
    alias = F.when(F.col("language") == "kotlin", F.nullif(F.regexp_extract("text", IMPORT["kotlin"], 4), F.lit("")))
    return rows.select("path", "line", group(2).alias("qualified_name"), (group(3) != "").alias("wildcard"), alias.alias("alias")).where("qualified_name <> ''")


def symbols(declarations: DataFrame) -> DataFrame:
    """id, kind, name, qualified_name, package, owner_name and arity of structure.declared()'s Java and Kotlin rows.
    A member's owner_name is the qualified name that it is a member of."""
    rows = declarations.where(F.col("language").isin("java", "kotlin") & F.col("kind").isin("class", "interface", "object", "constructor", "function", "method"))
    owner = F.when(F.col("kind").isin("constructor", "method"), F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    return rows.select("id", "path", "kind", "name", "qualified_name", F.coalesce("package", F.lit("")).alias("package"), owner.alias("owner_name"), "arity")


def _last(name):
    return F.regexp_extract(name, r"([^.#]*)$", 1)


def resolve(references: DataFrame, known: DataFrame, imports_: DataFrame) -> DataFrame:
    """ref, candidates (ids, in order), rank (of the closest) and target (the id if it is the only one) of
    references(ref, path, package, name, wants, owner_name, arity); references that nothing answers to have none.

    known is symbols()'s, imports_ imports()'s.
    """
    columns = ["path", "package", "name", "wants", "owner_name", "arity"]
    asked = kept(references.select(*columns).distinct()).withColumn("q", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))
    key = lambda rank, kind, value: F.struct(F.lit(rank).alias("rank"), F.concat(F.lit(f"{kind}:"), value).alias("key"))
    own = asked.select("q", F.explode(F.array(key(0, "q", F.col("name")), key(2, "p", F.concat_ws("#", "package", "name")))).alias("k"))
    # imports that have to do with the name, and whole packages: joined by file and, but for the latter, by name
    bound = imports_.where("not wildcard").select("path", F.explode(F.array_distinct(F.array_compact(F.array("alias", _last(F.col("qualified_name")))))).alias("name"), "qualified_name", "alias")
    named = asked.join(bound, ["path", "name"]).select("q", F.when(F.col("alias") == F.col("name"), key(4, "q", F.col("qualified_name"))).otherwise(key(1, "q", F.col("qualified_name"))).alias("k"))
    whole = imports_.where("wildcard").select("path", F.col("qualified_name").alias("_in")).distinct()
    wild = asked.join(whole, "path").select("q", key(3, "p", F.concat_ws("#", "_in", "name")).alias("k"))
    questions = own.union(named).union(wild).select("q", "k.*").groupBy("q", "key").agg(F.min("rank").alias("rank"))
    known = kept(known.select("id", "kind", F.col("name").alias("_name"), "qualified_name", F.col("owner_name").alias("_owner"), F.col("arity").alias("_arity"), "package"))
    answers = known.select("id", "kind", "_name", "qualified_name", "_owner", "_arity", F.explode(F.array(F.concat(F.lit("q:"), "qualified_name"), F.concat(F.lit("p:"), F.concat_ws("#", "package", "_name")))).alias("key"))
    # a form is a question without its file: files that see a name by the same keys get the same answers, found once
    heard = questions.join(answers.select("key").distinct(), "key", "left_semi").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("keys"))
    form = ["name", "wants", "owner_name", "arity", "keys"]
    shaped = kept(asked.join(heard, "q").withColumn("form", F.sha2(F.to_json(F.struct(*form)), 256)))
    met = shaped.select("form", *form).dropDuplicates(["form"]).select("form", *form[:-1], F.inline("keys")).join(answers, "key")
    wanted = F.lit(False)
    for what, kinds in KINDS.items():
        wanted = wanted | ((F.col("wants") == what) & F.col("kind").isin(*kinds))
    fits = F.col("arity").isNull() | F.col("_arity").isNull() | (F.col("arity") == F.col("_arity"))
    owned = F.col("owner_name").isNull() | F.coalesce(F.col("_owner") == F.col("owner_name"), F.lit(False)) | (_last(F.coalesce("_owner", F.lit(""))) == _last(F.col("owner_name")))
    is_named = (F.col("_name") == F.col("name")) | (F.col("qualified_name") == F.col("name")) | (F.col("rank") == 4)
    found = met.where(wanted & fits & owned & is_named).groupBy("form", "id").agg(F.min("rank").alias("rank"))
    found = found.groupBy("form").agg(F.array_sort(F.collect_list("id")).alias("candidates"), F.min("rank").alias("rank"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in columns]
    formed = references.alias("r").join(shaped.select(*columns, "form").alias("a"), same, "left").select("r.ref", F.coalesce("a.form", F.concat(F.lit("-"), F.col("r.ref").cast("string"))).alias("form"))
    out = formed.join(found.hint("merge"), "form", "left")  # last, so that no candidates are shuffled with a reference
    empty = F.coalesce("candidates", F.array().cast("array<string>"))
    return out.select("ref", empty.alias("candidates"), F.get(F.array(*map(F.lit, RANKS)), F.col("rank")).alias("rank"), F.when(F.size(empty) == 1, empty[0]).alias("target"))


_CALL = r"""(?:\b(new)\s+|\b([\w$]+)\s*\.\s*)?\b([A-Za-z_$][\w$]*)\s*\(((?:[^()"']|"[^"]*"|'[^']*')*)(\)?)"""
_HERITAGE = {"java": r"\b(?:extends|implements)\s+([A-Za-z_$][\w$., ]*)", "kotlin": r"\b(?:class|interface|object)\s+\w+[^:{]*\)?\s*:\s*([A-Za-z_][\w., ]*)"}


def references(artifacts: DataFrame, declarations: DataFrame) -> DataFrame:
    """ref, path, line, package, name, wants, owner_name, arity of the types that declarations extend and of the calls
    on the lines of Java and Kotlin artifacts. A call has a number of parameters where they hold no brackets, an owner
    where what it is called on begins with a capital."""
    rows = scanners.lines(artifacts.where(F.col("language").isin("java", "kotlin")))
    package = declarations.where("kind = 'package'").select("path", F.col("name").alias("package"))
    heirs = rows.select("path", "line", F.explode(F.split(F.when(F.col("language") == "java", F.regexp_replace(F.regexp_extract("text", _HERITAGE["java"], 1), r"\bimplements\b", ",")).otherwise(F.regexp_extract("text", _HERITAGE["kotlin"], 1)), r"\s*,\s*")).alias("name"))
    none = F.lit(None)
    types = heirs.select("path", "line", F.trim("name").alias("name"), F.lit("type").alias("wants"), none.cast("string").alias("owner_name"), none.cast("int").alias("arity")).where(r"name rlike '^[A-Za-z_$][\\w$.]*$'")
    hits = rows.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(_CALL), F.lit(0))).alias("hit"))
    part = lambda n: F.regexp_extract("hit", _CALL, n)
    arguments = F.trim(F.regexp_replace(part(4), r""""[^"]*"|'[^']*'""", "s"))
    arity = F.when(part(5) == ")", F.when(arguments == "", 0).otherwise(F.size(F.split(arguments, ","))))
    owner = F.when(part(2).rlike("^[A-Z]"), part(2))
    calls = hits.select("path", "line", part(3).alias("name"), F.when(part(1) == "new", "constructor").otherwise("callable").alias("wants"), owner.alias("owner_name"), arity.cast("int").alias("arity"))
    calls = calls.where(~F.col("name").isin(*scanners.NOT_CALLS))
    # a declaration's own line is no call of it
    own = declarations.select("path", F.explode(F.sequence("start_line", F.least("end_line", F.col("start_line") + 8))).alias("line"), "name").where("name is not null").distinct()
    calls = calls.join(own, ["path", "line", "name"], "left_anti")
    rows = types.unionByName(calls).distinct().join(package, "path", "left").withColumn("package", F.coalesce("package", F.lit("")))
    return rows.withColumn("ref", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "line", "name", "wants", "owner_name", "arity")]), 256))


def linked(references_: DataFrame, resolved: DataFrame, declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships (kind, source, target, line, rank) from the closest declaration around each resolved reference, and
    diagnostics (path, line, severity, code, message) of those that nothing or several symbols answer to)."""
    both = references_.join(resolved, "ref")
    owners = closest_enclosing(both.select(F.col("ref").alias("id"), "path", "line"), declarations.where("kind not in ('package', 'field', 'test')").select(F.col("id").alias("stable_key"), "path", "start_line", "end_line"))
    kind = F.when(F.col("wants") == "type", "EXTENDS").when(F.col("wants") == "constructor", "INSTANTIATES").otherwise("CALLS")
    edges = both.where("target is not null").join(owners, both["ref"] == owners["id"]).select(kind.alias("kind"), F.col("owner").alias("source"), "target", "line", "rank").where("source is not null and source <> target")
    n = F.size("candidates")
    several = n > 1
    message = F.when(several, F.concat_ws(" ", "name", F.lit("matches"), n.cast("string"), F.lit("repository symbols"))).otherwise(F.concat("name", F.lit(" could not be resolved inside the repository")))
    language = F.upper(F.when(F.col("path").endswith(".kt") | F.col("path").endswith(".kts"), "kotlin").otherwise("java"))
    code = F.concat(language, F.when(several, F.lit("_AMBIGUOUS_REFERENCE")).otherwise(F.lit("_UNRESOLVED_REFERENCE")))
    told = both.where("target is null").select("path", "line", F.when(several, "warning").otherwise("information").alias("severity"), code.alias("code"), message.alias("message"))
    return edges, told

