"""A Spark data source for container images: archives of saved images, OCI archives and OCI folders, one row for each layer entry."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tarfile
from collections.abc import Iterator
from contextlib import ExitStack

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_HEX = re.compile("[0-9a-fA-F]{64}")
_ARCHIVES = (".tar", ".tar.gz", ".tgz")


class ImageSizeLimitExceeded(ValueError):
    pass


class _Layer(InputPartition):
    """One layer of an image; without a name, an image that can't be opened, and why."""

    def __init__(self, source: str, image: str | None, layer: str | None, index: int, name: str | None, problem: str | None = None):
        super().__init__(source)
        self.source, self.image, self.layer, self.index, self.name, self.problem = source, image, layer, index, name, problem


def _sha(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def _blob(digest: str) -> str:
    return f"blobs/sha256/{digest.split(':')[-1]}" if ":" in digest else digest


def _file_sha(path: str) -> str:
    own = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            own.update(block)
    return f"sha256:{own.hexdigest()}"


def layers(path: str) -> tuple[str, list[tuple[str, str]]]:
    """The image's digest, and for each layer that is there its digest and its name in the image. No layer is read."""
    with ExitStack() as stack:
        if os.path.isdir(path):
            names = {os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files}
            read = lambda name: stack.enter_context(open(os.path.join(path, name), "rb")).read()
        else:
            outer = stack.enter_context(tarfile.open(path, "r:*"))
            names = set(outer.getnames())
            read = lambda name: outer.extractfile(name).read()
        if "manifest.json" in names and not os.path.isdir(path):
            entry = json.loads(read("manifest.json"))[0]
            config = entry.get("Config", "")
            own = []
            for name in entry.get("Layers", []):
                parts = name.split("/")
                base = parts[0] if len(parts) > 1 else os.path.splitext(parts[0])[0]
                own.append((f"sha256:{base.lower()}" if _HEX.fullmatch(base) else _sha(parts[-1].encode()), name))
            digest = _sha(read(config)) if config in names else _file_sha(path)
        elif "index.json" in names:
            listed = json.loads(read("index.json")).get("manifests", [])
            if not listed:
                raise ValueError("index.json has no manifests")
            digest = listed[0].get("digest") or (_file_sha(path) if os.path.isfile(path) else _sha(read("index.json")))
            manifest = _blob(listed[0].get("digest", ""))
            described = json.loads(read(manifest)).get("layers", []) if manifest in names else []
            own = [(x.get("digest", f"sha256:layer{k}"), _blob(x.get("digest", f"layer{k}"))) for k, x in enumerate(described)]
        else:
            raise ValueError(f"no image: {path}")
        return digest, [(d, name) for d, name in own if name in names]


def safe(name: str) -> bool:
    return not name.startswith("/") and ".." not in name.split("/")


def _opened(stack: ExitStack, path: str, name: str):
    """A layer as a stream of its tar archive, unpacked as it is read."""
    if os.path.isdir(path):
        raw = stack.enter_context(open(os.path.join(path, name), "rb"))
    else:
        raw = stack.enter_context(tarfile.open(path, "r:*")).extractfile(name)
    head = raw.read(4)
    raw.seek(0)
    if head == b"\x28\xb5\x2f\xfd":
        import zstandard

        raw = stack.enter_context(zstandard.ZstdDecompressor().stream_reader(raw))
    return stack.enter_context(tarfile.open(fileobj=raw, mode="r|*", bufsize=1 << 18))


def entries(path: str, layer: str, name: str, most: int, largest: int) -> Iterator[tuple]:
    """path, kind, size, problem and content of a layer's entries, in order.

    The archive is read as a stream; of the files, those of `largest` bytes at most are held, one at a time, and others have no
    content. Absolute paths and those that lead out are left out; more bytes than allowed are an error."""
    total = 0
    with ExitStack() as stack:
        for m in (tar := _opened(stack, path, name)):
            tar.members = []  # else a list of all entries grows
            if not m.isfile() or not safe(m.name):
                continue
            total += m.size
            if total > most:
                raise ImageSizeLimitExceeded(f"more than {most} bytes in {path}, at {m.name}")
            folder, _, own = m.name.removeprefix("./").rpartition("/")
            at = lambda x, folder=folder: f"{folder}/{x}" if folder else x
            if own == ".wh..wh..opq":
                yield folder, "OPAQUE", 0, None, None
            elif own.startswith(".wh."):
                yield at(own[4:]), "WHITEOUT", 0, None, None
            elif m.size > largest:
                yield at(own), "FILE", m.size, f"more than {largest} bytes", None
            else:
                yield at(own), "FILE", m.size, None, tar.extractfile(m).read()


def found(root: str) -> list[str]:
    """The path itself if it is an image, else the archives and OCI folders below it."""
    if os.path.isfile(root) or os.path.exists(os.path.join(root, "index.json")):
        return [root]
    out = []
    for at, names, files in os.walk(root):
        images = [n for n in names if os.path.exists(os.path.join(at, n, "index.json"))]
        out += [os.path.join(at, x) for x in [*images, *(f for f in files if f.endswith(_ARCHIVES))]]
        names[:] = sorted(set(names) - set(images))
    return sorted(out)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.most, self.largest = options["path"], int(options.get("maxBytes", 1 << 31)), int(options.get("maxFileBytes", 256 << 20))
        self.rows = options.get("problems", "fail") == "rows"

    def partitions(self):
        """One for each layer. The driver reads manifests and the names in archives, no layer."""
        out = []
        for path in found(self.root):
            try:
                digest, own = layers(path)
                out += [_Layer(path, digest, layer, k, name) for k, (layer, name) in enumerate(own)]
            except (OSError, ValueError, KeyError, IndexError, tarfile.TarError) as e:
                if not self.rows:
                    raise
                out.append(_Layer(path, None, None, 0, None, f"{type(e).__name__}: {e}"))
        return out or [_Layer(self.root, None, None, 0, None)]

    def read(self, p):
        if p.problem:
            yield p.source, p.image, p.layer, p.index, "", "PROBLEM", 0, p.problem, None
        elif p.name is not None:
            try:
                for path, kind, size, problem, content in entries(p.source, p.layer, p.name, self.most, self.largest):
                    yield p.source, p.image, p.layer, p.index, path, kind, size, problem, content
            except (OSError, ValueError, EOFError, tarfile.TarError) as e:
                if not self.rows:
                    raise
                yield p.source, p.image, p.layer, p.index, "", "PROBLEM", 0, f"{type(e).__name__}: {e}", None


class ImageSource(DataSource):
    """spark.dataSource.register(ImageSource); spark.read.format("image_layers").load(path), an image or a folder of images that
    is mounted on every machine. Each layer is a partition. maxBytes bounds what a layer unpacks to (operators/images.py bounds
    whole images), maxFileBytes the files whose content is kept. With problems=rows, an image or layer that can't be read, or is
    beyond the bound, is a row of kind PROBLEM instead of an error."""

    @classmethod
    def name(cls):
        return "image_layers"

    def schema(self):
        return "source string, image string, layer string, layer_index int, path string, kind string, size long, problem string, content binary"

    def reader(self, schema):
        return _Reader(self.options)
