"""A scan of a tree: the engines' findings together, paths made relative, scored, summed up and held against a policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk
from ..sources import tree
from . import config, dependencies
from . import findings as ops
from .binaries import binary_findings
from .calls import EXTENSIONS, java_js_findings
from .images import certificate_findings, image_findings, read_images, within_limit
from .numbering import numbered
from .python_calls import python_findings, python_problems

TYPES = ("source", "dependency", "config", "binary", "container", "certificate")
CONFIGS = (".yaml", ".yml", ".tf", ".conf", ".json")
ARCHIVES = (".tar", ".tgz", ".gz")  # images, which have a scan of their own
CERTIFICATE = 2 << 20  # bytes of a file that may be a certificate or key
REDACTED = "[redacted]"


def _files(spark: SparkSession, root: str, kind: str, most: int) -> DataFrame:
    """The files of a tree that a kind of scan reads; no other one is opened."""
    own = {
        "python": {"skip": "source", "extensions": [".py"]},
        "code": {"skip": "source", "extensions": list(EXTENSIONS)},
        "dependency": {"skip": "source", "names": [*dependencies.parsers.MANIFESTS, "requirements*.txt"]},
        "config": {"skip": "config", "extensions": CONFIGS},
        "binary": {"skip": "binary", "kinds": ["elf", "pe", "macho"]},
        "certificate": {"skip": "binary"},
    }
    return tree.read_tree(spark, root, maxBytes=min(most, CERTIFICATE) if kind == "certificate" else most, **own[kind])


def _manifests(files: DataFrame) -> DataFrame:
    return files.select(F.col("rel_path").alias("path"), "name", "content")


def _configs(files: DataFrame) -> DataFrame:
    return files.select(F.col("rel_path").alias("path"), "name", "ext", "content")


def _known(types) -> set[str]:
    unknown = set(types) - set(TYPES)
    if unknown:
        raise ValueError(f"no such scan: {sorted(unknown)}")
    return set(types)


def tree_findings(spark: SparkSession, root: str, types=("source",), most: int = 1 << 31) -> DataFrame:
    """Findings of the engines named, in paths below the root, with the engine's place in their order. Each kind of scan leaves
    out its own folders; a path that is a container image or a single file is scanned as that."""
    types, out = _known(types), []

    def add(found: DataFrame) -> None:
        out.append(found.withColumn("engine", F.lit(len(out))))

    files = lambda kind: _files(spark, root, kind, most)
    if "source" in types:
        add(python_findings(files("python")))
        add(java_js_findings(files("code")))
    if "dependency" in types:
        add(dependencies.dependency_findings(_manifests(files("dependency"))))
    if "config" in types:
        add(config.config_findings(_configs(files("config"))))
    if "binary" in types:
        add(binary_findings(files("binary").where("content is not null")))
    if "container" in types:
        add(image_findings(within_limit(read_images(spark, root, most), most)[0]).drop("image"))
    if "certificate" in types:
        add(certificate_findings(files("certificate").where(F.col("content").isNotNull() & ~F.col("ext").isin(*ARCHIVES))))
    return reduce(DataFrame.unionByName, out)


def tree_problems(spark: SparkSession, root: str, types=("source",), most: int = 1 << 31) -> DataFrame:
    """scan, path, problem: files and images that a scan of these types would have to read and can't: too large, unreadable, no
    text or malformed."""
    types, out = _known(types), []

    def unread(kind: str) -> DataFrame:
        return _files(spark, root, kind, most).where("problem is not null").select(F.col("rel_path").alias("path"), "problem")

    files = lambda kind: _files(spark, root, kind, most)
    if "source" in types:
        out += [("source", unread("python")), ("source", unread("code")), ("source", python_problems(files("python")))]
    if "dependency" in types:
        out += [("dependency", unread("dependency")), ("dependency", dependencies.dependency_problems(_manifests(files("dependency"))))]
    if "config" in types:
        out += [("config", unread("config")), ("config", config.config_problems(_configs(files("config"))))]
    if "binary" in types:
        out.append(("binary", unread("binary")))
    if "container" in types:
        out.append(("container", within_limit(read_images(spark, root, most), most)[1]))
    return reduce(DataFrame.unionByName, (x.select(F.lit(kind).alias("scan"), "path", "problem") for kind, x in out)) if out else spark.createDataFrame([], "scan string, path string, problem string")


def in_order(findings: DataFrame, position: str = "position") -> DataFrame:
    """Findings with their place from 0: engines in their order, each one's findings by file, line, algorithm, package and call."""
    return numbered(findings, "engine", "file", "line", "algorithm", "package_name", "matched_call", position=position)


def relative(path: str, root: str, redact: bool = True):
    """The path below the root; a path elsewhere is redacted, or stays where that is not asked for."""
    p, base = F.col(path), root.rstrip("/") + "/"
    inside = p.startswith(base)
    return F.when(inside, F.substring(p, F.lit(len(base) + 1), F.length(p))).when(~p.startswith("/") & ~F.contains(p, F.lit("../")), p).otherwise(F.lit(REDACTED) if redact else p)


def prepare(raw: DataFrame, root: str, redact: bool = True, shelf_life: float | None = None, source_context: str | None = None) -> DataFrame:
    """Raw findings typed, in relative paths, and scored. Findings of container layers keep their layer's path; those of
    binaries refer to what was matched."""
    binary = F.col("detection_method").isin("binary_symbol_table", "binary_constant_scan")
    layer = F.coalesce("artifact_type", F.lit("")) == "CONTAINER_LAYER"
    own = F.coalesce("artifact_type", F.lit("")).isin("DEPENDENCY_MANIFEST", "CONFIG_FILE") & F.col("artifact_ref").isNotNull()
    out = raw.withColumns({
        "artifact_ref": F.when(binary, F.coalesce("matched_call", F.lit(""))).when(own & F.lit(redact), relative("artifact_ref", root, redact)).otherwise(F.col("artifact_ref")),
        "artifact_type": F.when(binary, "BINARY").otherwise(F.col("artifact_type")),
        "file": F.when(layer, F.col("file")).otherwise(relative("file", root, redact)),
        "supplied_shelf_life": F.lit(shelf_life).cast("double"),
    })
    if source_context:
        out = out.withColumn("source_context", F.lit(source_context))
    return risk.score_findings(out, "stated for the scan" if shelf_life is not None else None)


def run_scan(spark: SparkSession, root: str, types=("source",), min_band: str | None = None, fail_on: str | None = None, most: int = 1 << 31, **options) -> tuple[DataFrame, DataFrame]:
    """Scored findings of a tree, and one row of counts by tier and band with `violated` (false without fail_on)."""
    found = prepare(tree_findings(spark, root, types, most), root, **options)
    if min_band:
        found = found.where(ops.confidence.meets(F.coalesce("confidence_band", F.lit("UNVERIFIED")), min_band))
    summary = ops.scan_summary(found)
    if fail_on is None:
        return found, summary.withColumn("violated", F.lit(False))
    return found, summary.join(F.broadcast(ops.gate(found, fail_on)))  # one row each
