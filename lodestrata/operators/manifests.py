"""Text configuration and manifests as rows: nginx directives, requirement lines, version predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: All white space, where Spark's trim() takes spaces only.
_AROUND = "^\\s+|\\s+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _AROUND, "")


def nginx_directives(files: DataFrame) -> DataFrame:
    """path, lineno, directive, value of `text`, a line each; blank lines, comments and lone braces are none."""
    lines = files.select("path", F.posexplode(F.split("text", "\\r\\n|\\n|\\r")).alias("n", "line")).withColumn("line", trimmed(F.col("line")))
    lines = lines.where("line not in ('', '{', '}') and not startswith(line, '#')")
    bare = trimmed(F.regexp_replace("line", ";$", ""))
    part = lambda k: F.regexp_extract(bare, "(?s)^(\\S+)\\s+(.+)$", k)
    return lines.select("path", (F.col("n") + 1).alias("lineno"), F.lower(part(1)).alias("directive"), part(2).alias("value")).where("value <> ''")


def exact_pin(spec: Column) -> Column:
    """The version of `===1.2` or `==1.2` without a wildcard, else null."""
    version = F.regexp_replace(spec, "^={2,3}", "")
    return F.when(spec.startswith("==") & ~version.contains("*"), version)


def package_name(name: Column, ecosystem: Column) -> Column:
    """Names in lower case; of PyPI's, runs of `-_.` are one dash."""
    return F.when(ecosystem == "pypi", F.regexp_replace(F.lower(name), "[-_.]+", "-")).otherwise(F.lower(name))


def requirements(files: DataFrame) -> DataFrame:
    """path, line, name, version, declared of requirement files. Options, paths and bare addresses are no requirements; continued
    lines belong to the first and are joined without a space."""
    # each line begins with its number, of which a continuation takes away those of the lines that go on
    numbers = F.transform(F.split(F.regexp_replace("text", "\\r\\n?", "\n"), "\n"), lambda x, n: F.concat((n + 1).cast("string"), F.lit("\u0002"), x))
    joined = F.regexp_replace(F.array_join(numbers, "\n"), "\\\\[^\\S\\n]*\\n[0-9]+\u0002[^\\S\\n]*", "")
    lines = files.select("path", F.explode(F.split(joined, "\n")).alias("raw"))
    part = lambda k: F.regexp_extract("raw", "(?s)^([0-9]+)\u0002(.*)$", k)
    line = trimmed(part(2))
    line = trimmed(F.regexp_replace(line, "(^#|[ \\t]#).*$", ""))
    out = lines.select("path", part(1).cast("int").alias("line"), line.alias("spec")).where("spec <> '' and not spec rlike '^[-./]'")
    address = F.contains("spec", F.lit("://"))
    out = out.where(~address | F.contains("spec", F.lit(" @ ")))
    name, spec = requirement_parts(trimmed(F.split("spec", "--hash")[0]))
    name = F.when(address, F.split(trimmed(F.split("spec", " @ ")[0]), "\\s+")[0]).otherwise(name)
    spec = F.when(address, "").otherwise(spec)
    return out.select("path", "line", name.alias("name"), exact_pin(spec).alias("version"), F.concat(name, spec).alias("declared")).where("name <> ''")


def requirement_parts(requirement: Column) -> tuple[Column, Column]:
    """Name, and version specifiers without spaces, of a requirement; markers and extras are left out."""
    bare = trimmed(F.split(requirement, ";")[0])
    part = lambda k: F.regexp_extract(bare, "(?s)^([\\p{L}\\p{N}._-]*)(?:\\[[^\\]]*\\]?)?(.*)$", k)
    return part(1), F.replace(part(2), F.lit(" "), F.lit(""))
