"""Facts of build manifests and configuration files, from artifacts(path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys whose values are never shown.
SECRET_KEY = r"(?i)password|passwd|secret|token|api[._-]?key|private[._-]?key|credential"
#: What a dependency group of a package file is to the module.
NODE_GROUPS = {"dependencies": "runtime", "devDependencies": "development"}


def _named(path: Column, name: str) -> Column:
    return (path == name) | path.endswith(f"/{name}")


def shown(key: Column, value: Column) -> Column:
    return F.when(key.rlike(SECRET_KEY), "[REDACTED]").otherwise(value)


def node_manifests(artifacts: DataFrame) -> DataFrame:
    """path, kind (module, build_script, dependency), name, value, scope of package.json files; broken ones give kind error."""
    files = artifacts.where(_named(F.col("path"), "package.json")).select("path", F.try_parse_json("content").alias("v"))
    text = lambda p: F.try_variant_get("v", p, "string")
    entries = lambda p: F.map_entries(F.try_variant_get("v", p, "map<string,string>"))
    row = lambda kind, name, value, scope: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), F.lit(scope).cast("string").alias("scope"))
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<kind:string,name:string,value:string,scope:string>>")
    parts = [F.when(text("$.name").isNotNull(), F.array(row("module", text("$.name"), text("$.version"), None))).otherwise(empty)]
    parts.append(F.coalesce(F.transform(F.filter(entries("$.scripts"), lambda e: e["key"].isin("start", "build", "test")), lambda e: row("build_script", e["key"], e["value"], None)), empty))
    dependencies = lambda group, scope: F.coalesce(F.transform(entries(f"$.{group}"), lambda e: row("dependency", e["key"], e["value"], scope)), empty)
    parts += [dependencies(group, scope) for group, scope in NODE_GROUPS.items()]
    rows = F.when(F.col("v").isNull(), F.array(row("error", F.lit("invalid JSON"), none, None))).otherwise(F.concat(*parts))
    return files.select("path", F.explode(rows).alias("r")).select("path", "r.*")


def maven_manifests(artifacts: DataFrame) -> DataFrame:
    """path, kind (module, dependency, plugin), name, value, scope of pom.xml files."""
    files = artifacts.where(_named(F.col("path"), "pom.xml")).select("path", F.regexp_replace("content", r"<!--[\s\S]*?-->", "").alias("c"))
    tag = lambda x, name: F.nullif(F.trim(F.regexp_extract(x, rf"<{name}>\s*([^<]*)</{name}>", 1)), F.lit(""))
    blocks = lambda name: F.regexp_extract_all("c", F.lit(rf"<{name}>[\s\S]*?</{name}>"), F.lit(0))
    id_ = lambda x, group: F.concat_ws(":", F.coalesce(tag(x, "groupId"), F.lit(group)), tag(x, "artifactId"))
    row = lambda kind, name, value, scope: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), scope.alias("scope"))
    none = F.lit(None).cast("string")
    own = F.regexp_replace("c", r"<(parent|dependencies|dependencyManagement|build|modules|profiles)>[\s\S]*?</\1>", "")
    rows = F.concat(
        F.array(row("module", id_(own, None), tag(own, "version"), none)),
        F.transform(F.regexp_extract_all("c", F.lit(r"<module>\s*([^<]*?)\s*</module>"), F.lit(1)), lambda m: row("submodule", m, none, none)),
        F.transform(blocks("dependency"), lambda x: row("dependency", id_(x, None), tag(x, "version"), F.coalesce(tag(x, "scope"), F.lit("compile")))),
        F.transform(blocks("plugin"), lambda x: row("plugin", id_(x, "org.apache.maven.plugins"), tag(x, "version"), none)),
    )
    return files.select("path", F.explode(rows).alias("r")).select("path", "r.*")


def gradle_manifests(artifacts: DataFrame) -> DataFrame:
    """path, kind (dependency, plugin, dynamic), name, scope of Gradle build files; what is computed is dynamic."""
    files = artifacts.where(_named(F.col("path"), "build.gradle") | _named(F.col("path"), "build.gradle.kts")).select("path", F.regexp_replace("content", r"(?m)//.*$", "").alias("c"))
    call = r"""(?m)^\s*(implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|kapt)\s*+\(?+\s*+"""
    quoted = call + r"""["']([^"'$]+)["']"""
    row = lambda kind, name, scope: F.struct(F.lit(kind).alias("kind"), name.alias("name"), scope.alias("scope"))
    none = F.lit(None).cast("string")
    plain = F.transform(F.regexp_extract_all("c", F.lit(quoted), F.lit(0)), lambda m: row("dependency", F.regexp_extract(m, quoted, 2), F.regexp_extract(m, quoted, 1)))
    dynamic = F.transform(F.regexp_extract_all("c", F.lit(call + r"""(?!["'][^"'$]+["'])[^\n]*"""), F.lit(0)), lambda m: row("dynamic", F.trim(m), none))
    plugin = r"""id\s*\(?\s*["']([^"']+)["']"""
    plugins = F.transform(F.regexp_extract_all("c", F.lit(plugin), F.lit(1)), lambda m: row("plugin", m, none))
    return files.select("path", F.explode(F.concat(plain, plugins, dynamic)).alias("r")).select("path", "r.*")


def configuration_definitions(artifacts: DataFrame) -> DataFrame:
    """path, line, key, value of .properties files, YAML files and .env.example, as they stand.

    YAML nesting is a stack of (indent, key), folded over a file's lines.
    """
    lines = artifacts.where(F.col("path").rlike(r"\.properties$|\.ya?ml$|(^|/)\.env\.example$")).select("path", F.split("content", r"\r?\n").alias("lines"))
    flat = lines.where(~F.col("path").rlike(r"\.ya?ml$")).select("path", F.posexplode("lines").alias("at", "line"))
    pair = r"^\s*([^#!=:\s][^=:\s]*)\s*[=:]\s*(.*?)\s*$"
    flat = flat.where(F.col("line").rlike(pair)).select("path", (F.col("at") + 1).alias("line"), F.regexp_extract("line", pair, 1).alias("key"), F.when(~F.col("path").rlike(r"\.env\.example$"), F.regexp_extract("line", pair, 2)).alias("value"))
    item = r"^( *)([A-Za-z0-9_.-]+):(?:\s+(.*?))?\s*$"
    none = F.array().cast("array<struct<indent:int,key:string>>")
    zero = F.struct(none.alias("stack"), F.array().cast("array<struct<line:int,key:string,value:string>>").alias("out"))

    def step(acc, x):
        indent = F.length(F.regexp_extract(x["line"], item, 1))
        above = F.filter(acc["stack"], lambda s: s["indent"] < indent)
        stack = F.array_append(above, F.struct(indent.alias("indent"), F.regexp_extract(x["line"], item, 2).alias("key")))
        value = F.regexp_replace(F.regexp_extract(x["line"], item, 3), r"""^["']|["']$|\s+#.*$""", "")
        key = F.array_join(F.transform(stack, lambda s: s["key"]), ".")
        out = F.when(value != "", F.array_append(acc["out"], F.struct((x["at"] + 1).alias("line"), key.alias("key"), value.alias("value")))).otherwise(acc["out"])
        return F.when(x["line"].rlike(item), F.struct(stack.alias("stack"), out.alias("out"))).otherwise(acc)

    yaml = lines.where(F.col("path").rlike(r"\.ya?ml$"))
    numbered = F.transform("lines", lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    nested = yaml.select("path", F.explode(F.aggregate(numbered, zero, step, lambda acc: acc["out"])).alias("r")).select("path", "r.*")
    return flat.union(nested)


def configuration_keys(artifacts: DataFrame) -> DataFrame:
    """configuration_definitions with secret values hidden; of a file's equal keys the first counts."""
    first = configuration_definitions(artifacts).groupBy("path", "key").agg(F.min(F.struct("line", "value")).alias("f"))
    return first.select("path", "f.line", "key", shown(F.col("key"), F.col("f.value")).alias("value"))


def configuration_diagnostics(artifacts: DataFrame) -> DataFrame:
    """path, line, code, severity, message: a warning for each definition of a key that its file has defined before."""
    n = F.row_number().over(Window.partitionBy("path", "key").orderBy("line"))
    later = configuration_definitions(artifacts).select("path", "line", "key", n.alias("n")).where("n > 1")
    message = F.concat(F.lit("Duplicate configuration key "), "key", F.lit(" was ignored"))
    return later.select("path", "line", F.lit("CONFIGURATION_DUPLICATE_KEY").alias("code"), F.lit("warning").alias("severity"), message.alias("message"))
