"""Rule packs from files, and all patterns in one pass."""

import random
import time

import pytest

from lodestrata.functions import rules
from lodestrata.operators import binaries, calls, config, dependencies, packages
from lodestrata.sources.patterns import Patterns

FILES = {
    "a-java.yaml": 'language: "java"\nrules:\n  - {match_object: Vault, match_method: seal, match_arg_contains: OLD, algorithm: MD5, primitive: hash, weak_by_default: true, expected_import: own.Vault}\n  - {match_object: Vault}\n  - 3\n',
    "sub/pypi.yaml": "ecosystem: pypi\npackages:\n  - {name: Own_Lib, library: first, algorithm: RSA, primitive: library, weak_by_default: false}\n  - {name: other, library: o, algorithm: DES, primitive: library, weak_by_default: maybe}\n",
    "z-pypi.yml": "ecosystem: pypi\npackages:\n  - {name: own-lib, library: second, algorithm: MD5, primitive: library, weak_by_default: true}\n",
    "config.yaml": "rules:\n  own_rule:\n    algorithm: RSA\n    primitive: key_exchange\n    key_size: 512\n    weak_by_default: true\n    detectors:\n      - {kind: yaml, key_patterns: [Own_Bits], value_patterns: ['512']}\n      - {kind: hcl2, attribute_patterns: [tiny], value_patterns: ['true']}\n      - {kind: nginx, directive: own_directive, value_contains: [weak]}\n  bad_rule: {algorithm: X, primitive: y, weak_by_default: true, detectors: [{kind: ini}]}\n",
    "container.yaml": "language: container\nrules:\n  - {ecosystem: deb, package: libown, library: own, algorithm: RSA, primitive: p, weak_by_default: false}\n",
    "binary.yaml": 'language: binary\nrules:\n  - {tier: 1, match_type: symbol, match_pattern: own_init, algorithm: DES, primitive: encrypt, library: own, weak_by_default: true}\n  - {tier: 2, match_type: constant, match_pattern: "00ff00ff", algorithm: AES, primitive: encrypt, weak_by_default: false}\n  - {tier: 2, match_pattern: "xyz", algorithm: AES, primitive: encrypt, weak_by_default: false}\n',
    "broken.yaml": "a: [",
    "list.yaml": "- 1\n",
    "gem.yaml": "ecosystem: gem\npackages: []\n",
}


def test_packs_from_files(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    key = lambda ecosystem, name: name.lower().replace("_", "-")
    pack = rules.load(str(tmp_path), key)
    assert pack.packages == [("pypi", "own-lib", "second", "MD5", "library", True)]
    wrong = {r.path.rsplit("/", 1)[1]: r.problem for r in pack.problem_rows(spark).collect()}
    assert set(wrong) == {"a-java.yaml", "pypi.yaml", "config.yaml", "binary.yaml", "broken.yaml", "list.yaml", "gem.yaml"} and len(pack.problems) == 8

    java = [("A.java", ".java", bytearray(b'import own.Vault; class A { Object o = Vault.seal("very-old"); }'))]
    assert [(r.algorithm, r.library) for r in calls.java_js_findings(spark.createDataFrame(java, "rel_path string, ext string, content binary"), pack.calls).collect()] == [("MD5", "Vault")]
    files = spark.createDataFrame([("requirements.txt", "requirements.txt", bytearray(b"own.lib==1\nother\n"))], "path string, name string, content binary")
    assert [(r.library, r.package_name) for r in dependencies.dependency_findings(files, pack.packages).collect()] == [("second", "own-lib")]
    settings = [("a.yaml", "a.yaml", ".yaml", b"own_bits: 512"), ("b.tf", "b.tf", ".tf", b"very_tiny_key = true"), ("c.conf", "c.conf", ".conf", b"own_directive so weak;\n")]
    df = spark.createDataFrame([(*s[:3], bytearray(s[3])) for s in settings], "path string, name string, ext string, content binary")
    assert {(r.file, r.key_size) for r in config.config_findings(df, pack.settings, pack.detectors).collect()} == {("a.yaml", 512), ("b.tf", 512), ("c.conf", 512)}
    database = spark.createDataFrame([("l", "deb", bytearray(b"Package: libown-dev\nVersion: 2\n"))], "layer string, ecosystem string, content binary")
    assert [r.package_name for r in packages.package_findings(database, pack.layer_packages).collect()] == ["libown-dev"]
    program = spark.createDataFrame([("p", bytearray(b"\x7fELF\x02\x01 the_own_init_x \x00\xff\x00\xff\x00\xff"))], "rel_path string, content binary")
    assert {(r.algorithm, r.detection_method) for r in binaries.binary_findings(program, pack.symbols, pack.constants).collect()} == {("DES", "binary_symbol_table"), ("AES", "binary_constant_scan")}
    assert rules.load(str(tmp_path / "none")) == rules.Pack()


def test_tables_are_broadcast_by_size(spark, monkeypatch):
    plan = lambda: rules.rule_table(spark, [(1,)] * 5, "a int")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan().lower()
    monkeypatch.setattr(rules, "BROADCAST", 4)
    assert "broadcast" not in plan().lower()


def plain(patterns, data):
    out = []
    for k, p in enumerate(patterns):
        at = data.find(p) if p else -1
        while at >= 0:
            out.append((at, k))
            at = data.find(p, at + len(p))
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_patterns_equal_the_plain_search(seed):
    chance = random.Random(seed)
    patterns = [bytes(chance.choice(b"ab\x00\xff") for _ in range(chance.randrange(6))) for _ in range(30)]
    data = bytes(chance.choice(b"ab\x00\xff") for _ in range(3000))
    found = Patterns(patterns)
    assert found.places(data) == plain(patterns, data)
    assert found.within(data[:20]) == [k for k, p in enumerate(patterns) if p and p in data[:20]]
    assert Patterns([]).places(data) == Patterns([b""]).within(data) == []


def test_time_does_not_grow_with_the_patterns():
    chance = random.Random(1)
    data = chance.randbytes(3_000_000)

    def took(n):
        found = Patterns([chance.randbytes(16) for _ in range(n)])
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            found.places(data)
            runs.append(time.perf_counter() - began)
        return min(runs)

    took(5)
    assert took(5000) < 100 * took(5)  # far from a thousand times as much
