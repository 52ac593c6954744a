"""Rule packs read from YAML files, and rule tables for joins."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a rule table that go to every task at most; larger ones are joined as Spark sees fit.
BROADCAST = 100_000
BYTES = 16 << 20  # of a rule file at most
ECOSYSTEMS = ("pypi", "npm", "maven")
KINDS = ("yaml", "hcl2", "nginx", "json")
_TIERS = {"symbol": 1, "constant": 2}


def rule_table(spark: SparkSession, rows: list[tuple], schema: str, rules: int | None = None) -> DataFrame:
    """Rules as a table, which is broadcast where it is small. `rules` is their number where a row has several."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if (len(rows) if rules is None else rules) <= BROADCAST else table


@dataclass
class Pack:
    """Rules in the shapes that the engines take, in the order of files, and what was wrong with files (path, problem)."""

    calls: list[tuple] = field(default_factory=list)
    packages: list[tuple] = field(default_factory=list)
    settings: list[tuple] = field(default_factory=list)
    detectors: list[tuple] = field(default_factory=list)
    layer_packages: list[tuple] = field(default_factory=list)
    symbols: list[tuple] = field(default_factory=list)
    constants: list[tuple] = field(default_factory=list)
    problems: list[tuple] = field(default_factory=list)

    def problem_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.problems, "path string, problem string")


def _need(entry, *names: str) -> list:
    if not isinstance(entry, dict):
        raise ValueError("an entry is no mapping")
    for name in names:
        if entry.get(name) is None:
            raise ValueError(f"{name} is missing")
    if not isinstance(entry.get("weak_by_default", False), bool):
        raise ValueError("weak_by_default is neither true nor false")
    return [entry[n] for n in names]


def _texts(x) -> list[str]:
    return [str(v) for v in (x if isinstance(x, list) else [x])] if x is not None else []


def _call(language: str, e: dict) -> tuple:
    names = _need(e, "match_object", "match_method", "algorithm", "primitive", "weak_by_default")
    return (language, names[0], names[1], str(e.get("match_arg_contains") or ""), *names[2:], _texts(e.get("expected_import") or e.get("expected_module")))


def _detectors(rule: str, e: dict) -> list[tuple]:
    out = []
    for d in e.get("detectors") or []:
        if not isinstance(d, dict) or d.get("kind") not in KINDS:
            raise ValueError(f"{rule}: a detector has none of the kinds {', '.join(KINDS)}")
        values = _texts(d.get("value_patterns")) + _texts(d.get("value_contains"))
        exact = _texts(d.get("key_patterns")) + _texts(d.get("attribute")) + _texts(d.get("directive"))
        part = _texts(d.get("key_contains")) + _texts(d.get("attribute_patterns"))
        kind = "yaml" if d["kind"] == "json" else d["kind"]
        out += [(rule, kind, how, [k.lower() for k in keys], values) for how, keys in (("equals", exact), ("contains", part)) if keys]
    return out


def _add(pack: Pack, data, path: str) -> None:
    """One file's rules. An entry that is wrong is left out, and reported; the others count."""
    if not isinstance(data, dict):
        raise ValueError("no mapping")
    entries = data.get("packages") if "ecosystem" in data else data.get("rules")
    if "ecosystem" in data and data["ecosystem"] not in ECOSYSTEMS:
        raise ValueError(f"no ecosystem of {', '.join(ECOSYSTEMS)}")
    if not isinstance(entries, (list, dict)) or isinstance(entries, dict) and "language" in data:
        raise ValueError("no list of rules")

    def each(add) -> None:
        for k, e in enumerate(entries.items() if isinstance(entries, dict) else entries):
            try:
                add(e)
            except (ValueError, TypeError) as problem:
                pack.problems.append((path, f"entry {k}: {problem}"))

    def package(e) -> None:
        name, *rest = _need(e, "name", "library", "algorithm", "primitive", "weak_by_default")
        pack.packages.append((data["ecosystem"], name, *rest))

    def layer_package(e) -> None:
        pack.layer_packages.append(tuple(_need(e, "ecosystem", "package", "library")))

    def binary(e) -> None:
        pattern, algorithm, primitive, weak = _need(e, "match_pattern", "algorithm", "primitive", "weak_by_default")
        if e.get("tier", _TIERS.get(e.get("match_type"))) == 1:
            pack.symbols.append((pattern, algorithm, primitive, e.get("library") or "unknown", weak))
        else:
            bytes.fromhex(pattern)
            pack.constants.append((pattern, algorithm, primitive, weak))

    def setting(e) -> None:
        name, rule = e
        algorithm, primitive, weak = _need(rule, "algorithm", "primitive", "weak_by_default")
        found = _detectors(name, rule)
        pack.settings.append((name, algorithm, primitive, rule.get("key_size"), weak))
        pack.detectors.extend(found)

    if "ecosystem" in data:
        each(package)
    elif isinstance(entries, dict):
        each(setting)
    elif data.get("language") == "container":
        each(layer_package)
    elif data.get("language") == "binary":
        each(binary)
    elif isinstance(data.get("language"), str):
        each(lambda e: pack.calls.append(_call(data["language"], e)))
    else:
        raise ValueError("no language")


def load(folder: str, key=lambda ecosystem, name: name) -> Pack:
    """The rules of all YAML files of a folder and those below, by the names of files. A file that is malformed or too large is
    reported and passed over. Of packages with one key (ecosystem, name) the last one holds, in the place of the first."""
    import yaml

    loader, pack = getattr(yaml, "CSafeLoader", yaml.SafeLoader), Pack()
    for path in sorted(glob(os.path.join(folder, "**", "*.y*ml"), recursive=True), key=lambda p: (os.path.basename(p), p)):
        try:
            if os.path.getsize(path) > BYTES:
                raise ValueError(f"more than {BYTES} bytes")
            with open(path, encoding="utf-8") as f:
                _add(pack, yaml.load(f, Loader=loader), path)
        except (OSError, ValueError, yaml.YAMLError) as e:
            pack.problems.append((path, f"{type(e).__name__}: {e}".split("\n")[0]))
    last = {(e, key(e, n)): (e, key(e, n), *rest) for e, n, *rest in pack.packages}
    pack.packages = list(last.values())
    return pack
