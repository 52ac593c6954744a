from pyspark.sql import functions as F

from lodestrata.functions import confidence
from lodestrata.operators.python_calls import python_findings
from lodestrata.sources.tree import TreeSource


def test_tree_and_python_calls(spark, tmp_path):
    for name, text in {".github/ci.py": "import hashlib\nhashlib.new('MD5', b'')\n", "__init__.py": "from Crypto.Cipher import DES as D\nD.new(k)\n", "a.py": "from cryptography.hazmat.primitives.asymmetric import rsa\nrsa.generate_private_key(public_exponent=65537, key_size=1024)\nnothing.md5()\n", "node_modules/b.py": "import hashlib\nhashlib.md5()\n", "broken.py": "def (", "c.txt": "hashlib.md5()"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    spark.dataSource.register(TreeSource)
    rows = python_findings(spark.read.format("tree").load(str(tmp_path))).collect()
    got = {r.file: (r.line, r.algorithm, r.key_size, float(r.confidence_score)) for r in rows}
    assert got == {".github/ci.py": (2, "MD5", None, 0.9), "__init__.py": (2, "DES", None, 1.0), "a.py": (2, "RSA", 1024, 1.0)}  # from an import whose target is longer than its name


def test_digests_by_name(spark):
    """hmac.new takes its third argument or digestmod, hashlib.new its first string."""
    source = "\n".join(["import hmac, hashlib", "import hashlib as h", "hmac.new(b'k', b'm', digestmod='sha1')", "hmac.new('key', b'm', 'SHA256')", "hmac.new('sha1', b'm')", "h.new('sha224')", "hashlib.new(name)", "hmac.new(b'k', b'm', hashlib.sha512)"])
    files = spark.createDataFrame([("x.py", ".py", bytearray(source.encode()))], "rel_path string, ext string, content binary")
    got = {r.line: (r.algorithm, r.library, r.primitive, float(r.confidence_score)) for r in python_findings(files).collect()}
    assert got == {3: ("SHA-1", "hmac", "mac", 0.9), 4: ("SHA-256", "hmac", "mac", 0.9), 6: ("SHA-224", "hashlib", "hash", 1.0)}


def test_trees_leave_out_folders_by_kind_of_scan(spark, tmp_path):
    for folder in ("a/b/c/d", "dist", "coverage", ".git", "env", ".github"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "f.txt").write_text("x")
    spark.dataSource.register(TreeSource)
    read = lambda skip: {r.rel_path.rsplit("/", 1)[0] for r in spark.read.format("tree").option("skip", skip).load(str(tmp_path)).collect()}
    assert read("source") == {"a/b/c/d", ".github"}
    assert read("config") == {"a/b/c/d", ".github", "dist", "coverage"}
    assert read("binary") == {"a/b/c/d", ".github", "dist", "coverage", "env"}


def test_confidence_vectors(spark):
    cases = [([], 0.0, "UNVERIFIED"), (["import_resolved", "call_site_matched", "literal_algorithm_arg", "expected_module_confirmed"], 0.9, "VERIFIED"), (["rule_yaml_matched", "dynamic_algorithm_arg", "import_unresolved"], 0.0, "UNVERIFIED"), (["no_such", "import_resolved"], 0.35, "UNVERIFIED"), (None, 0.0, "UNVERIFIED")]
    df = spark.createDataFrame([(s,) for s, *_ in cases], "s array<string>").withColumn("v", confidence.score(F.col("s"))).withColumn("b", confidence.band(F.col("v")))
    assert [(float(r.v), r.b) for r in df.collect()] == [(v, b) for _, v, b in cases]


def test_a_tree_opens_only_what_is_asked_for(spark, tmp_path, monkeypatch):
    """Counted opens; links within the root count, links out of it don't; what can't be read is a row."""
    import builtins
    import os

    from pyspark.sql.types import StructType

    from lodestrata.sources import tree

    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    for name, data in {"a.py": b"x", "b.txt": b"yy", "sub/c.py": b"zzz", "sub/d.so": b"\x7fELFabc", "e.bin": b"MZ..", "big.py": b"x" * 100, "requirements-x.txt": b"r"}.items():
        (root / name).write_bytes(data)
    (tmp_path / "out.py").write_bytes(b"secret")
    for name, target in {"in.py": root / "sub" / "c.py", "leads-out.py": tmp_path / "out.py", "dangling.py": root / "none"}.items():
        os.symlink(target, root / name)
    opened = []
    monkeypatch.setattr(tree, "open", lambda p, *a: (opened.append(os.path.basename(p)), builtins.open(p, *a))[1], raising=False)

    def rows(schema=None, **options):
        opened.clear()
        source = tree.TreeSource({"path": str(root)} | options)
        reader = source.reader(StructType.fromDDL(schema or source.schema()))
        return sorted(row for p in reader.partitions() for row in reader.read(p))

    got = rows("rel_path string, problem string, content binary", extensions=".py", maxBytes="50")
    assert got == [("a.py", None, b"x"), ("big.py", "more than 50 bytes", None), ("in.py", None, b"zzz"), ("sub/c.py", None, b"zzz")]
    assert sorted(opened) == ["a.py", "c.py", "in.py"]
    assert rows("rel_path string, length long", names="requirements*.txt") == [("requirements-x.txt", 1)] and not opened
    assert rows("rel_path string, kind string", kinds="elf, pe") == [("e.bin", "pe"), ("sub/d.so", "elf")]
    read = tree.read_tree(spark, str(root), extensions=[".py", ".txt"], names=["e.*"])
    assert {r.rel_path for r in read.select("rel_path").collect()} == {"a.py", "b.txt", "sub/c.py", "big.py", "in.py", "requirements-x.txt", "e.bin"}
    # two uses of one table in a query keep their own conditions
    both = read.where("ext = '.py'").select("name").union(read.where("ext = '.txt'").select("name"))
    assert sorted(r.name for r in both.collect()) == ["a.py", "b.txt", "big.py", "c.py", "in.py", "requirements-x.txt"]
