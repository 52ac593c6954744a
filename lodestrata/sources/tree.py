"""A Spark data source for trees of artefacts, hidden and underscored files included (Spark's file sources leave those out)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: folders that scans of sources and manifests, of configuration and of binaries leave out
SKIP = ("node_modules", ".git", "__pycache__", ".pytest_cache", ".venv", "venv", "env", "dist", "build", "target", ".idea", ".vscode", "coverage", ".nyc_output")
SKIP_CONFIG = ("node_modules", ".git", "__pycache__", ".pytest_cache", ".venv", "venv", "env", ".idea", ".vscode", ".nyc_output")
SKIP_BINARY = (".git", "__pycache__", ".pytest_cache", "node_modules")
SKIPS = {"source": SKIP, "config": SKIP_CONFIG, "binary": SKIP_BINARY, "none": ()}
# fixed values: kinds of executables by their first bytes
MAGIC = {b"\x7fELF": "elf", b"MZ": "pe", b"\xfe\xed\xfa\xce": "macho", b"\xfe\xed\xfa\xcf": "macho", b"\xce\xfa\xed\xfe": "macho", b"\xcf\xfa\xed\xfe": "macho", b"\xca\xfe\xba\xbe": "macho"}


class _Folders(InputPartition):
    """Folders that are read with all below them, or only their own files."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(len(folders))
        self.folders = folders


class File:
    """What is known of a file; its first bytes are read only if they are asked for."""

    def __init__(self, path: str, base: str):
        self.path, self.rel_path, self.name = path, os.path.relpath(path, base), os.path.basename(path)
        self.ext = os.path.splitext(path)[1].lower()

    @cached_property
    def length(self) -> int:
        return os.path.getsize(self.path)

    @cached_property
    def kind(self) -> str:
        with open(self.path, "rb") as f:
            head = f.read(4)
        return next((kind for magic, kind in MAGIC.items() if head.startswith(magic)), "")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.root, self.most = options["path"], int(options.get("maxBytes", 1 << 31))
        self.levels, self.folders = int(options.get("levels", 2)), int(options.get("foldersPerPartition", 8))
        self.skip = frozenset(SKIPS[options.get("skip", "source")])
        listed = lambda name: [x.strip() for x in options.get(name, "").split(",") if x.strip()]
        self.extensions, self.names, self.kinds = (listed(x) for x in ("extensions", "names", "kinds"))
        self.columns = columns

    def _wanted(self, file: File) -> bool:
        """Decided by the name, and by the first four bytes where kinds are asked for."""
        by_name = not (self.extensions or self.names) or file.ext in self.extensions or any(fnmatchcase(file.name, n) for n in self.names)
        return by_name and (not self.kinds or file.kind in self.kinds)

    def _below(self, folder: str) -> list[str]:
        with os.scandir(folder) as found:
            return sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and e.name not in self.skip)

    def partitions(self):
        """The driver lists the upper levels of folders only; tasks walk what is below and look at the files."""
        if os.path.isfile(self.root):
            return [_Folders([(self.root, False)])]
        level, out = [self.root], []
        for _ in range(self.levels):
            out += [(f, False) for f in level]
            level = [x for f in level for x in self._below(f)]
        out += [(f, True) for f in level]
        return [_Folders(out[k : k + self.folders]) for k in range(0, len(out), self.folders)]

    def read(self, partition):
        base = self.root if os.path.isdir(self.root) else os.path.dirname(self.root)
        for folder, deep in partition.folders:
            for path in self._files(folder, deep):
                if row := self._row(File(path, base)):
                    yield row

    def _row(self, file: File) -> tuple | None:
        """The columns asked for; what can't be read has a problem and no content."""
        problem = content = None
        try:
            if not self._wanted(file):
                return None
            if file.length > self.most:
                problem = f"more than {self.most} bytes"
            elif "content" in self.columns:
                with open(file.path, "rb") as f:
                    content = f.read()
            if "kind" in self.columns:
                file.kind  # noqa: B018  read now, so that a failure is seen
        except OSError as e:
            problem = e.strerror or type(e).__name__
            file.__dict__.setdefault("length", 0)
            file.__dict__.setdefault("kind", "")
        given = {"problem": problem, "content": content}
        return tuple(given[c] if c in given else getattr(file, c) for c in self.columns)

    def _files(self, folder: str, deep: bool) -> Iterator[str]:
        """Files in order; a link to a file counts if that lies below the root too."""
        if os.path.isfile(folder):
            yield folder
            return
        real = os.path.join(os.path.realpath(self.root), "")
        for at, names, files in os.walk(folder):
            names[:] = sorted(n for n in names if n not in self.skip) if deep else []
            for path in (os.path.join(at, f) for f in sorted(files)):
                if not os.path.islink(path) or os.path.isfile(path) and os.path.realpath(path).startswith(real):
                    yield path


class TreeSource(DataSource):
    """spark.dataSource.register(TreeSource); spark.read.format("tree").load(root). Tasks read from `root`, so it has to be
    mounted on every machine. Options: skip (source, config, binary or none), maxBytes, levels, foldersPerPartition; extensions
    and names (with * and ?), lists of which a file has to fit one, and kinds (elf, pe, macho). Other files are never opened. A
    schema with some of the columns reads only those; without content, no file is opened. Files that are too large or can't be
    read are rows with a problem and no content.

    These are options and no pushed filters, because Spark 4.1 gives all uses of one DataFrame of a Python source in a query the
    filters of the last one."""

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return "path string, rel_path string, name string, ext string, length long, kind string, problem string, content binary"

    def reader(self, schema):
        return _Reader(self.options, schema.names)


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """Files of a tree; lists of extensions, names or kinds may be sequences."""
    spark.dataSource.register(TreeSource)
    joined = {k: ",".join(v) if isinstance(v, (tuple, list)) else v for k, v in options.items()}
    return spark.read.format("tree").options(**joined).load(root)
