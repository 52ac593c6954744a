"""Small parsers, a file each: dependencies of manifests, key-value pairs of configuration. What is found goes on as rows."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

from . import hcl

EXACT = re.compile(r"[0-9][A-Za-z0-9.+_-]*")
_REQUIREMENT = re.compile(r"((?:\w|[.-])*)(?:\[[^\]]*\]?)?(.*)", re.S)


def exact_version(spec: str) -> bool:
    """Digits first, no operator, and no part that stands for any version."""
    return bool(EXACT.fullmatch(spec)) and not {"x", "X", "*"} & set(spec.split("."))


def pinned(spec: str) -> str | None:
    return spec.lstrip("=") if spec.startswith("==") and "*" not in spec else None


def _requirement(text: str) -> tuple[str, str]:
    name, spec = _REQUIREMENT.match(text.split(";")[0].strip()).groups()
    return name, spec.replace(" ", "")


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x) -> list:
    return x if isinstance(x, list) else []


def pyproject(text: str) -> Iterator[tuple]:
    data = tomllib.loads(text)
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    groups = [("project.dependencies", project.get("dependencies"))]
    groups += [(f"project.optional-dependencies.{k}", v) for k, v in _dict(project.get("optional-dependencies")).items()]
    for scope, own in groups:
        for name, spec in (_requirement(x) for x in _list(own) if isinstance(x, str)):
            if name:
                yield "pypi", name, pinned(spec), scope, name + spec
    tables = [(f"tool.poetry.{k}", poetry.get(k)) for k in ("dependencies", "dev-dependencies")]
    tables += [(f"tool.poetry.group.{k}.dependencies", v.get("dependencies")) for k, v in _dict(poetry.get("group")).items() if isinstance(v, dict)]
    for scope, own in tables:
        for name, value in _dict(own).items():
            if name == "python":
                continue
            spec = (value if isinstance(value, str) else _dict(value).get("version", "")).replace(" ", "")
            bare = spec[:1].isdigit()
            version = spec[2:] if spec.startswith("==") and "*" not in spec else spec if bare and "*" not in spec else None
            yield "pypi", name, version, scope, f"{name}=={spec}" if bare else name + spec


def pipfile_lock(text: str) -> Iterator[tuple]:
    data = _dict(json.loads(text))
    for scope in ("default", "develop"):
        for name, own in _dict(data.get(scope)).items():
            if isinstance(own, dict):
                spec = own.get("version", "")
                yield "pypi", name, spec[2:] if spec.startswith("==") else None, scope, name + spec


def poetry_lock(text: str) -> Iterator[tuple]:
    for own in _list(tomllib.loads(text).get("package")):
        if isinstance(own, dict) and own.get("name") and own.get("version"):
            yield "pypi", own["name"], own["version"], "poetry.lock", f"{own['name']}=={own['version']}"


def package_json(text: str) -> Iterator[tuple]:
    data = json.loads(text)
    for scope in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"):
        for name, spec in _dict(data.get(scope)).items():
            if isinstance(spec, str):
                yield "npm", name, spec if exact_version(spec) else None, scope, name if ":" in spec or "/" in spec else f"{name}@{spec}"


def package_lock(text: str) -> Iterator[tuple]:
    data = json.loads(text)
    if isinstance(data.get("packages"), dict):
        found = [(key.split("node_modules/")[-1], own) for key, own in data["packages"].items() if key]
    else:
        found, open_ = [], [_dict(data.get("dependencies"))]
        while open_:  # nested ones follow their parent
            for name, own in open_.pop().items():
                found.append((name, own))
                if isinstance(own, dict) and own.get("link") is not True and isinstance(own.get("dependencies"), dict):
                    open_.append(own["dependencies"])
    for name, own in found:
        if isinstance(own, dict) and own.get("link") is not True:
            yield "npm", name, own.get("version"), "package-lock.json", f"{name}@{own.get('version')}"


def pom(text: str) -> Iterator[tuple]:
    if re.search("<!(DOCTYPE|ENTITY)", text, re.I):
        raise ValueError("a document type or entity is declared")
    local = lambda e: e.tag.rpartition("}")[2]
    root = ElementTree.fromstring(text)
    parents = [root, *(e for e in root if local(e) == "dependencyManagement")]
    for parent in parents:
        for own in (d for e in parent if local(e) == "dependencies" for d in e if local(d) == "dependency"):
            part = {local(e): e.text.strip() for e in own if e.text}
            if part.get("groupId") and part.get("artifactId"):
                name, spec = f"{part['groupId']}:{part['artifactId']}".lower(), part.get("version")
                yield "maven", name, spec if spec and not re.search(r"\$\{|[\[(,]", spec) else None, "pom.xml", f"{name}:{spec}" if spec else name


MANIFESTS = {"pyproject.toml": pyproject, "Pipfile.lock": pipfile_lock, "poetry.lock": poetry_lock, "package.json": package_json, "package-lock.json": package_lock, "pom.xml": pom}


def _why(e: Exception) -> str:
    return f"{type(e).__name__}: {e}".split("\n")[0][:500]


def dependencies(name: str, content: bytes) -> tuple[list[tuple], str | None]:
    """Ecosystem, name, version, scope and the declaration of each dependency; why there is none where the file can't be read."""
    try:
        return list(MANIFESTS[name](content.decode("utf-8"))), None
    except Exception as e:  # noqa: BLE001  whatever is wrong with a file is a problem of that file
        return [], _why(e)


def walk(node, path: tuple = (), out: list | None = None) -> list[tuple[tuple, object]]:
    """Scalars and the keys that lead to them; lists add no key, nulls are left out."""
    out = [] if out is None else out
    if isinstance(node, dict):
        for key, value in node.items():
            walk(value, (*path, str(key)), out)
    elif isinstance(node, list):
        for value in node:
            walk(value, path, out)
    elif node is not None:
        out.append((path, node))
    return out


def _yaml_loader():
    import yaml

    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def pairs(kind: str, content: bytes) -> tuple[list[tuple], str | None]:
    """Key path and value as text, of all documents of a file, in order; why there is none where the file can't be read."""
    try:
        text = content.decode("utf-8")
        if kind == "yaml":
            import yaml

            docs = list(yaml.load_all(text, Loader=_yaml_loader()))
        else:
            docs = [json.loads(text) if kind == "json" else hcl.parse(text)]
        if kind == "json" and not isinstance(docs[0], (dict, list)):
            return [], None
        return [(list(path), str(value).strip()) for doc in docs for path, value in walk(doc)], None
    except Exception as e:  # noqa: BLE001
        return [], _why(e)
