"""Nested declarations of source files, and what keeps their brackets from closing.

A file's text is cut into tokens: comments, strings, brackets, ends of statements, and runs of anything else. Depths are
prefix sums over tokens; brackets of one depth alternate, so each closing one finds its opening one in a window over the
depth. Statements are runs of tokens between braces, semicolons and, where a language ends statements so, line feeds
outside of parentheses. A declaration is a statement that reads like one where it stands (methods and fields directly
in a type's body), reaches from its first token to the brace that closes its body, and is owned by the narrowest body
around it: an equi-join on bins of token numbers.

Everything is windows and joins of built-in functions. A window has one file's tokens, a join row one bin's. Joins of
tables that grow with the files are merged, not broadcast: Spark's estimates of what is read off a text, and the
compressed sizes that it sees at run time, are many times too small for a driver to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans import kept

#: Comments, strings (three quotes, two, one, backquotes), brackets and ends, and runs of anything else.
TOKEN = r"""(?s)/\*.*?(?:\*/|\z)|//[^\n]*|\"{3}.*?(?:\"{3}|\z)|"(?:[^"\\\n]++|\\.)*+"?|'(?:[^'\\\n]++|\\.)*+'?|`(?:[^`\\]++|\\.)*+`?|[{}()\[\];\n]|[^/"'`{}()\[\];\n]++|/"""
#: Languages whose statements end with their line.
BY_LINE = ("kotlin", "typescript")
#: Tokens of a bin: a body is in as many as it touches.
BIN = 256

_MODIFIERS = r"(?:(?:public|protected|private|internal|static|final|abstract|synchronized|native|default|transient|volatile|sealed|open|override|data|inner|inline|suspend|operator|infix|lateinit|const|annotation|companion|export|declare|async|readonly|enum(?=\s+class))\s+)*"
_NOTE = r"""@(?!interface\b)(?:\w+:)?([A-Za-z_][\w.]*)(\s*\((?:[^()"']|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()]|\([^()]*\))*\))*\))?"""
TYPES = {
    "java": r"(?:^|\s)(class|interface|enum|record|@interface)\s+([A-Za-z_$][\w$]*)",
    "kotlin": r"(?:^|\s)(class|interface|object)\s+([A-Za-z_]\w*)",
    "typescript": r"(?:^|\s)(class|interface)\s+([A-Za-z_$][\w$]*)",
}
#: Groups: what tells a constructor from a method (a type, or nothing), the name, the parameters.
CALLABLES = {
    "java": rf"^{_MODIFIERS}(?:<.*?>\s*)?([\w$.]+(?:<.*>)?(?:\s*\[\s*\])*\s+)?([A-Za-z_$][\w$]*)\s*\((.*)\)(?:\s*throws\s.*)?$",
    "kotlin": rf"^{_MODIFIERS}(?:(fun)\s+(?:<[^>]*>\s*)?(?:[\w.<>?, ]+\.)?)?([A-Za-z_]\w*)\s*\(((?:[^()]|\([^()]*\))*)\)",
    "typescript": rf"^{_MODIFIERS}(?:(function|get|set)\s+)?([A-Za-z_$#][\w$]*)\s*(?:<.*>)?\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)",
}
ARROW = r"^(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\(((?:[^()]|\([^()]*\))*)\)|[\w$]+)\s*(?::[^=]+)?=>"
TEST = r"""^(?:it|test|describe)(?:\.\w+)?\(\s*["'`]([^"'`]+)"""
FIELDS = {
    "java": rf"^{_MODIFIERS}[\w$.]+(?:<.*?>)?(?:\s*\[\s*\])*\s+([A-Za-z_$][\w$]*(?:\s*\[\s*\])*\s*(?:[=,].*)?)$",
    "kotlin": rf"^{_MODIFIERS}(?:val|var)\s+(?:[\w<>?]+\.)*([A-Za-z_]\w*)",
    "typescript": rf"^{_MODIFIERS}([A-Za-z_$#][\w$]*)\s*[?!]?\s*(?:[:=].*)?$",
}
PACKAGE = r"^package\s+([\w.]+)$"
#: Words that open a statement of no declaration.
STATEMENTS = ("if", "for", "while", "switch", "catch", "return", "throw", "new", "else", "do", "try", "when", "super", "this", "synchronized", "await", "import", "package", "type", "export")

_OPEN, _CLOSE = ("{", "(", "["), ("}", ")", "]")


def _by_language(patterns: dict[str, str], make) -> Column:
    out = F.lit(None)
    for language, p in patterns.items():
        out = F.when(F.col("language") == language, make(p)).otherwise(out)
    return out


def tokens(artifacts: DataFrame) -> DataFrame:
    """path, language, pos, token, line, depth and opener (of the innermost bracket around it, for a closing bracket
    its own) of artifacts(path, language, content). depth counts the brackets around a token."""
    # files are dealt by path before they are cut: their tokens, windows and statements stay where they are
    rows = artifacts.repartition("path").select("path", "language", F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    t = F.col("token")
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(t.isin(*_OPEN), 1).when(t.isin(*_CLOSE), -1).otherwise(0)
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    told = F.when(~(t.rlike(r"^(?:/[/*]|\s*$)")), F.rtrim(t))
    rows = rows.withColumns({"line": F.coalesce(F.sum(lines).over(before), F.lit(0)) + 1, "depth": F.coalesce(F.sum(step).over(before), F.lit(0)), "_last": F.last(told, True).over(before)})
    quiet = (t == "{") & (F.coalesce(F.col("_last"), F.lit("")).rlike(r"(?:^\(|[^=!<>]=|^=|\b(?:import|export))$"))
    rows = rows.withColumns({"level": F.when(t.isin(*_OPEN), F.col("depth") + 1).otherwise(F.col("depth")), "quiet": quiet})
    of_level = Window.partitionBy("path", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    opener = F.last(F.when(t.isin(*_OPEN), F.struct("pos", "token", "line", "quiet")), True).over(of_level)
    return rows.withColumn("opener", opener)


def statements(artifacts: DataFrame) -> DataFrame:
    """path, language, head (without annotations), text (with them), line, start, ends (the token that ends it), open,
    close (positions of its braces), end_line, parent (position of the brace around it), notes: statements of
    artifacts(path, language, content), with annotations that stand alone carried to the next one."""
    rows = tokens(artifacts.where(F.col("content").isNotNull()))
    t = F.col("token")
    inner = F.coalesce(F.col("opener.token"), F.lit(""))
    goes_on = F.coalesce(F.col("_last"), F.lit("")).rlike(r"(?:[,:=|&+.?]|=>|\bextends|\bimplements)$")
    line_ends = (t == "\n") & F.col("language").isin(*BY_LINE) & ~inner.isin("(", "[") & ~goes_on
    closes_quiet = F.coalesce(F.col("opener.quiet"), F.lit(False))
    ends = ((t == "{") & ~F.col("quiet")) | ((t == "}") & ~closes_quiet) | ((t == ";") & (inner != "(")) | line_ends
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ends", ends).withColumn("_n", F.coalesce(F.sum(F.col("_ends").cast("int")).over(before), F.lit(0)))
    # what closes an opening bracket is the next closing one of its level
    behind = Window.partitionBy("path", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    closer = F.last(F.when(t.isin(*_CLOSE), F.struct("token", "pos", "line")), True).over(behind)
    whole = Window.partitionBy("path")
    rows = rows.withColumns({"_closer": closer, "_end": F.max("pos").over(whole), "_end_line": F.max("line").over(whole)})
    closed = (t == "{") & (F.col("_closer.token") == "}")
    told = ~F.col("_ends") & ~t.rlike(r"^/[/*]")
    shown = told & ~t.rlike(r"^\s*$")
    last = F.max_by(F.struct("token", "pos", "line", F.when(closed, F.col("_closer.pos")).alias("close"), F.when(closed, F.col("_closer.line")).alias("close_line")), F.when(F.col("_ends"), F.col("pos")))
    one = rows.groupBy("path", "language", "_n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(told, F.struct("pos", "token")))), lambda x: x["token"]), "").alias("head"),
        F.min_by(F.struct("pos", "line", F.col("opener.pos").alias("parent")), F.when(shown, F.col("pos"))).alias("_first"),
        last.alias("_last"), F.max("_end").alias("_end"), F.max("_end_line").alias("_end_line"),
    )
    one = one.withColumn("head", F.trim(F.regexp_replace("head", r"\s+", " "))).where("head <> ''")
    one = one.withColumn("_alone", F.trim(F.regexp_replace("head", _NOTE, "")) == "")
    order = Window.partitionBy("path").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("_turn", F.coalesce(F.sum((~F.col("_alone")).cast("int")).over(order), F.lit(0)))
    own = ~F.col("_alone")
    joined = one.groupBy("path", "language", "_turn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_alone"), F.struct("_n", "head")))), lambda x: x["head"]), " ").alias("_notes"),
        F.min("_first.line").alias("line"), F.min("_first.pos").alias("start"), F.max(F.when(own, F.col("head"))).alias("head"),
        F.max(F.when(own, F.col("_first.parent"))).alias("parent"), F.max(F.when(own, F.col("_last"))).alias("_last"),
        F.max("_end").alias("_end"), F.max("_end_line").alias("_end_line"),
    ).where("head is not null")
    lead = F.regexp_extract("head", rf"^(?:{_MODIFIERS}{_NOTE}\s*)+", 0)
    notes = F.regexp_extract_all(F.concat_ws(" ", "_notes", lead), F.lit(_NOTE), F.lit(0))
    bare = F.trim(F.regexp_replace(F.regexp_replace("head", _NOTE, " "), r"\s+", " "))
    joined = joined.select("path", "language", bare.alias("head"), F.col("head").alias("text"), "line", "start", F.col("_last.token").alias("ends"), F.col("_last.pos").alias("at"), F.col("_last.line").alias("last_line"), "parent", notes.alias("notes"), F.col("_last.close").alias("_close"), F.col("_last.close_line").alias("_close_line"), "_end", "_end_line")
    body = F.col("ends") == "{"
    close = F.when(body, F.coalesce("_close", F.col("_end") + 1))
    end_line = F.when(body, F.coalesce("_close_line", "_end_line")).otherwise(F.coalesce("last_line", "_end_line"))
    return joined.select("path", "language", "head", "text", "line", "start", F.coalesce("ends", F.lit("")).alias("ends"), F.when(body, F.col("at")).alias("open"), close.alias("close"), end_line.alias("end_line"), "parent", "notes")


def _flat(text: Column) -> Column:
    """text without strings and whatever stands in brackets."""
    out = F.regexp_replace(text, r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", "")
    for _ in range(4):
        out = F.regexp_replace(out, r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "")
    return out


def _arity(parameters: Column) -> Column:
    flat = F.trim(_flat(parameters))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, ",")) - F.when(flat.rlike(r",\s*$"), 1).otherwise(0))


def _read(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Statements that declare something: kind, name and arity with the statement's own columns."""
    head, language = F.col("head"), F.col("language")
    inside = types.select("path", F.col("open").alias("parent"), F.col("name").alias("_type"))
    columns = rows.columns
    rows = rows.join(inside.hint("merge"), ["path", "parent"], "left")
    member, top = F.col("_type").isNotNull(), F.col("parent").isNull()
    plain = ~head.rlike(rf"^(?:{'|'.join(STATEMENTS)})\b(?!\s+(?:class|interface|function|const|abstract|default|async|enum))")
    group = lambda patterns, n: _by_language(patterns, lambda p: F.regexp_extract(head, p, n))
    word, name, parameters = (group(CALLABLES, n) for n in (1, 2, 3))
    constructor = ((language == "java") & (word == "") & (name == F.col("_type"))) | ((language != "java") & (word == "") & (name == "constructor"))
    java = (language == "java") & member & (constructor | (word != ""))
    kotlin = (language == "kotlin") & ((word == "fun") | (member & constructor))
    typescript = (language == "typescript") & F.when(member, F.col("ends").isin("{", ";", "\n")).otherwise((word == "function") & (F.col("ends") == "{"))
    callable_ = plain & (name != "") & (java | kotlin | typescript)
    kind = F.when(constructor, "constructor").when(member, "method").otherwise("function")
    made = F.struct(kind.alias("kind"), F.when(constructor, F.col("_type")).otherwise(name).alias("name"), _arity(parameters).cast("int").alias("arity"))
    none = F.lit(None).cast("int")
    arrow = F.struct(F.lit("function").alias("kind"), F.regexp_extract(head, ARROW, 1).alias("name"), _arity(F.regexp_extract(head, ARROW, 2)).cast("int").alias("arity"))
    test = F.struct(F.lit("test").alias("kind"), F.regexp_extract(head, TEST, 1).alias("name"), none.alias("arity"))
    declarators = F.split(_flat(group(FIELDS, 1)), ",")
    names = F.filter(F.transform(declarators, lambda x: F.regexp_extract(x, r"^\s*([\w$#]+)", 1)), lambda x: x != "")
    field = plain & (member | (top & (language == "kotlin"))) & ~callable_ & (F.col("ends") != "{") & (group(FIELDS, 1) != "")
    fields = F.transform(names, lambda n: F.struct(F.lit("field").alias("kind"), n.alias("name"), none.alias("arity")))
    found = F.when(callable_, F.array(made)).when((language == "typescript") & head.rlike(ARROW), F.array(arrow)).when((language == "typescript") & head.rlike(TEST), F.array(test)).when(field, fields)
    return rows.select("*", F.explode(found).alias("d")).select(*columns, "d.*")


def enclosing(places: DataFrame, bodies: DataFrame) -> DataFrame:
    """id and around (array of (open, id, kind, name), outermost first) of places(id, path, at): the bodies(id, path,
    open, close, kind, name) that hold it."""
    bin_of = lambda c: F.floor(F.col(c) / BIN)
    binned = bodies.select("path", "open", "close", F.struct("open", "id", "kind", "name").alias("_body"), F.explode(F.sequence(bin_of("open"), bin_of("close"))).alias("_bin"))
    mine = places.select("id", "path", "at", bin_of("at").alias("_bin"))
    held = mine.join(binned.hint("merge"), ["path", "_bin"]).where("at > open and at < close")
    return held.groupBy("id").agg(F.array_sort(F.collect_list("_body")).alias("around"))


def declared(artifacts: DataFrame | None, statements_: DataFrame | None = None) -> DataFrame:
    """id, path, language, kind, name, package, qualified_name, owner (id of the closest declaration around it), arity,
    notes (annotations), text (of its statement) and lines of all declarations of artifacts(path, language, content), or
    of their statements.

    Kinds: package, class, interface, object, method, constructor, function, field, test. Java methods with a Test
    annotation, or in a file named so, give a test besides.
    """
    statements_ = kept(statements(artifacts)) if statements_ is None else statements_
    head, language = F.col("head"), F.col("language")
    kind, name = (_by_language(TYPES, lambda p, n=n: F.regexp_extract(head, p, n)) for n in (1, 2))
    companion = (language == "kotlin") & head.rlike(rf"^{_MODIFIERS}object$")
    types = statements_.withColumns({"kind": F.when(companion, "object").otherwise(kind), "name": F.when(companion, "Companion").otherwise(name)})
    types = types.where((F.col("name") != "") & ((F.col("ends") == "{") | ((language == "kotlin") & head.rlike(rf"^{_MODIFIERS}(?:class|interface|object)\s"))))
    types = types.withColumn("kind", F.when(F.col("kind").isin("enum", "record", "class"), "class").when(F.col("kind").isin("@interface", "interface"), "interface").otherwise(F.col("kind"))).withColumn("arity", F.lit(None).cast("int"))
    package = statements_.where(head.rlike(PACKAGE)).groupBy("path").agg(F.min_by(F.regexp_extract(head, PACKAGE, 1), "start").alias("package"))
    rest = _read(statements_.join(types.select("path", "start").hint("merge"), ["path", "start"], "left_anti"), types)
    packages = statements_.where(head.rlike(PACKAGE)).withColumns({"kind": F.lit("package"), "name": F.regexp_extract(head, PACKAGE, 1), "arity": F.lit(None).cast("int")})
    found = types.unionByName(rest).unionByName(packages).join(package.hint("merge"), "path", "left")
    # three readers follow, and the patterns are what costs
    found = kept(found.withColumn("id", F.concat_ws("#", "path", F.col("start").cast("string"), "kind", "name")))
    bodies = found.where("open is not null").select("id", "path", "open", "close", "kind", "name")
    around = enclosing(found.select("id", "path", F.col("start").alias("at")), bodies)
    found = found.join(around.hint("merge"), "id", "left")
    owners = F.filter("around", lambda x: x["kind"].isin("class", "interface", "object"))
    chain = F.concat(F.transform(F.coalesce(owners, F.array().cast("array<struct<open:int,id:string,kind:string,name:string>>")), lambda x: x["name"]), F.array("name"))
    qualified = F.when(F.col("kind") == "package", F.col("name")).otherwise(F.concat_ws(".", "package", F.array_join(chain, ".")))
    closest = F.element_at(F.col("around"), -1)
    out = found.select("id", "path", "language", "kind", "name", "package", qualified.alias("qualified_name"), F.when(F.size("around") > 0, closest["id"]).alias("owner"), "arity", "notes", "text", F.col("line").alias("start_line"), "end_line")
    tested = F.exists("notes", lambda n: n.rlike(r"^@(?:\w+\.)*Test\b")) | F.col("path").rlike(r"Test\.java$")
    tests = out.where((F.col("language").isin("java", "kotlin")) & F.col("kind").isin("method", "function") & tested)
    as_test = tests.select(F.concat("id", F.lit("#test")).alias("id"), "path", "language", F.lit("test").alias("kind"), "name", "package", F.concat("qualified_name", F.lit("#test")).alias("qualified_name"), F.col("id").alias("owner"), "arity", F.array().cast("array<string>").alias("notes"), "text", "start_line", "end_line")
    return out.unionByName(as_test)


def read(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, declarations) of artifacts(path, language, content), both kept: what follows reads them often."""
    found = kept(statements(artifacts))
    return found, kept(declared(None, found))


def annotations(declarations: DataFrame) -> DataFrame:
    """owner, path, name, arguments and configuration key (of a ${key:default} in them) of declarations' annotations."""
    one = declarations.where("kind <> 'test' or size(notes) > 0").select(F.col("id").alias("owner"), "path", F.explode("notes").alias("note"))
    arguments = F.regexp_extract("note", r"(?s)\((.*)\)$", 1)
    key = F.trim(F.regexp_extract("note", r"\$\{([^}:]+)(?::[^}]*)?\}", 1))
    return one.select("owner", "path", F.regexp_extract("note", _NOTE, 1).alias("name"), F.nullif(F.trim(arguments), F.lit("")).alias("arguments"), F.nullif(key, F.lit("")).alias("configuration_key"))


def syntax_diagnostics(artifacts: DataFrame) -> DataFrame:
    """path, line, severity, code, message: brackets that close nothing or another kind, brackets never closed, strings
    and comments without an end."""
    rows = tokens(artifacts.where(F.col("content").isNotNull()))
    t, opener = F.col("token"), F.col("opener")
    partner = F.element_at(F.create_map(*[F.lit(x) for pair in zip(_OPEN, _CLOSE, strict=True) for x in pair]), opener["token"])
    stray = t.isin(*_CLOSE) & (F.col("depth") <= 0)
    other = t.isin(*_CLOSE) & (F.col("depth") > 0) & (partner != t)
    string = t.rlike(r"""^["'`]""") & ~t.rlike(r"""(?s)^("{3}.*"{3}|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|`(?:[^`\\]|\\.)*+`)$""")
    comment = t.startswith("/*") & (~t.endswith("*/") | (F.length(t) < 4))
    message = F.when(stray, F.concat(t, F.lit(" closes nothing"))).when(other, F.concat(t, F.lit(" closes "), opener["token"], F.lit(" of line "), opener["line"].cast("string"))).when(string, F.lit("a string without an end")).when(comment, F.lit("a comment without an end"))
    found = rows.where(message.isNotNull()).select("path", "language", F.col("line").cast("int").alias("line"), message.alias("message"))
    # an opening bracket is never closed if none of its level closes after it: the last of the level that is open
    marks = rows.where(t.isin(*_OPEN, *_CLOSE)).select("path", "language", "level", "pos", "token", "line")
    last = marks.groupBy("path", "language", "level").agg(F.max_by(F.struct("token", "line"), "pos").alias("m")).where(F.col("m.token").isin(*_OPEN))
    unclosed = last.select("path", "language", F.col("m.line").cast("int").alias("line"), F.concat("m.token", F.lit(" is never closed")).alias("message"))
    code = F.concat(F.upper("language"), F.lit("_SYNTAX_ERROR"))
    return found.union(unclosed).select("path", "line", F.lit("error").alias("severity"), code.alias("code"), "message")
