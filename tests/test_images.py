"""Images of saved archives and OCI folders, made here: layers, packages, keys, limits."""

import base64
import hashlib
import io
import json
import tarfile

import pytest

from lodestrata.operators import images
from lodestrata.sources import der
from lodestrata.sources.images import ImageSource


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | -(-n.bit_length() // 8)]) + n.to_bytes(-(-n.bit_length() // 8), "big")
    return bytes([tag]) + size + body


def oid(text):
    a, b, *rest = map(int, text.split("."))
    out = b""
    for v in [40 * a + b, *rest]:
        own = [v & 0x7F]
        while v := v >> 7:
            own.append(v & 0x7F | 0x80)
        out += bytes(reversed(own))
    return tlv(6, out)


def num(v):
    return tlv(2, v.to_bytes(v.bit_length() // 8 + 1, "big"))


def rsa_key(n):
    return tlv(0x30, num((1 << n) - 1), num(65537))


def cert(algorithm, key, signature="1.2.840.113549.1.1.11"):
    spki = tlv(0x30, tlv(0x30, *algorithm), tlv(3, b"\0", key))
    sig = tlv(0x30, oid(signature))
    tbs = tlv(0x30, tlv(0xA0, num(2)), num(7), sig, tlv(0x30), tlv(0x30), tlv(0x30), spki)
    return tlv(0x30, tbs, sig, tlv(3, b"\0\1"))


def pem(kind, raw):
    return f"-----BEGIN {kind}-----\n{base64.encodebytes(raw).decode()}-----END {kind}-----\n".encode()


RSA, EC = oid("1.2.840.113549.1.1.1"), oid("1.2.840.10045.2.1")


def test_keys():
    assert der.keys_of(cert([RSA, tlv(5)], rsa_key(1024))) == [("x509.load_der_x509_certificate", "RSA", 1024, True)]
    assert der.keys_of(b"text\n" + pem("CERTIFICATE", cert([RSA, tlv(5)], rsa_key(2048)))) == [("x509.load_pem_x509_certificate", "RSA", 2048, False)]
    assert der.keys_of(pem("CERTIFICATE", cert([RSA, tlv(5)], rsa_key(4096), "1.2.840.113549.1.1.5")))[0][3]
    assert der.keys_of(cert([EC, oid("1.3.132.0.34")], b"\4x"))[0][1:] == ("ECDSA", 384, False)
    assert der.keys_of(cert([oid("1.3.101.112")], b"x" * 32))[0][1:] == ("Ed25519", 256, False)
    assert der.keys_of(cert([oid("1.2.840.10040.4.1"), tlv(0x30, num((1 << 1024) - 1), num(3))], num(5)))[0][1:] == ("DSA", 1024, True)
    assert der.keys_of(pem("RSA PRIVATE KEY", tlv(0x30, num(0), num((1 << 1023) + 1), num(3)))) == [("serialization.load_pem_private_key", "RSA", 1024, True)]
    assert der.keys_of(pem("PRIVATE KEY", tlv(0x30, num(0), tlv(0x30, EC, oid("1.2.840.10045.3.1.7")), tlv(4, b"x"))))[0][1:] == ("ECDSA", 256, False)
    assert der.keys_of(pem("EC PRIVATE KEY", tlv(0x30, num(1), tlv(4, b"x"), tlv(0xA0, oid("1.3.132.0.35")))))[0][1:] == ("ECDSA", 521, False)
    broken = b"-----BEGIN CERTIFICATE-----\nabcde\n-----END CERTIFICATE-----\n"
    assert der.keys_of(broken) == [] and der.keys_of(broken + pem("CERTIFICATE", cert([RSA, tlv(5)], rsa_key(2048))))[0][1:] == ("RSA", 2048, False)
    assert der.keys_of(b"\x30\x82junk") == [] and der.keys_of(b"") == [] and der.keys_of(pem("CERTIFICATE", b"\x30\x03abc")) == []


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


DEB = b"Package: libssl3\nStatus: install ok installed\nVersion: 3.0.2\n"
LAYERS = [
    {"var/lib/dpkg/status": DEB, "etc/ssl/old.pem": pem("CERTIFICATE", cert([RSA, tlv(5)], rsa_key(1024))), "etc/gone/a.crt": cert([RSA, tlv(5)], rsa_key(1024)), "../out": b"x", "/abs": b"x"},
    {"etc/ssl/.wh.old.pem": b"", "etc/gone/.wh..wh..opq": b"", "etc/gone/b.crt": cert([RSA, tlv(5)], rsa_key(2048)), "usr/share/doc/c.pem": pem("CERTIFICATE", cert([RSA, tlv(5)], rsa_key(1024)))},
]
WANT = {("libssl3", "RSA", None, False), ("etc/gone/b.crt", "RSA", 2048, False)}


def read(spark, path, **options):
    spark.dataSource.register(ImageSource)
    return spark.read.format("image_layers").options(**options).load(str(path))


def test_saved_archive(spark, tmp_path):
    names = ["a" * 64 + "/layer.tar", "other.tar"]
    config = b"{}"
    (tmp_path / "image.tar").write_bytes(tar({"manifest.json": json.dumps([{"Config": "c.json", "Layers": [*names, "absent.tar"]}]).encode(), "c.json": config} | dict(zip(names, map(tar, LAYERS)))))
    rows = read(spark, tmp_path)
    assert {(r.layer, r.layer_index) for r in rows.collect()} == {("sha256:" + "a" * 64, 0), ("sha256:" + hashlib.sha256(b"other.tar").hexdigest(), 1)}
    assert {r.path for r in rows.collect()}.isdisjoint({"../out", "/abs", "out", "abs"})
    got = images.image_findings(rows).collect()
    assert {r.image for r in got} == {"sha256:" + hashlib.sha256(config).hexdigest()}
    assert {(r.file.split(":", 2)[2], r.algorithm, r.key_size, r.weak_by_default) for r in got} == WANT
    with pytest.raises(Exception, match="more than 100 bytes"):
        read(spark, tmp_path / "image.tar", maxBytes=100).collect()


def test_oci_folder(spark, tmp_path):
    blobs = tmp_path / "image" / "blobs" / "sha256"
    blobs.mkdir(parents=True)
    digests = []
    for data in map(tar, LAYERS):
        digests.append("sha256:" + hashlib.sha256(data).hexdigest())
        (blobs / digests[-1][7:]).write_bytes(data)
    manifest = json.dumps({"layers": [{"digest": d} for d in digests]}).encode()
    (blobs / hashlib.sha256(manifest).hexdigest()).write_bytes(manifest)
    (tmp_path / "image" / "index.json").write_text(json.dumps({"manifests": [{"digest": "sha256:" + hashlib.sha256(manifest).hexdigest()}]}))
    got = images.image_findings(read(spark, tmp_path)).collect()
    assert {(r.file.split(":", 2)[2], r.algorithm, r.key_size, r.weak_by_default) for r in got} == WANT
    assert {r.file.rsplit(":", 1)[0] for r in got} == set(digests)


def saved(layers, names=None):
    names = names or [f"{k:064x}/layer.tar" for k in range(len(layers))]
    return tar({"manifest.json": json.dumps([{"Config": "c.json", "Layers": names}]).encode(), "c.json": b"{}"} | dict(zip(names, layers)))


def test_each_layer_is_a_partition(spark, tmp_path):
    import gzip

    import zstandard

    plain = [tar({f"d/{k}": b"x" * k}) for k in range(3)]
    (tmp_path / "image.tar").write_bytes(saved([plain[0], gzip.compress(plain[1]), zstandard.compress(plain[2])]))
    rows = read(spark, tmp_path)
    assert rows.rdd.getNumPartitions() == 3
    assert {(r.layer_index, r.path, bytes(r.content)) for r in rows.collect()} == {(0, "d/0", b""), (1, "d/1", b"x"), (2, "d/2", b"xx")}


def test_limit_over_all_layers_and_broken_images(spark, tmp_path):
    """A running sum over layers finds the image that is too large in all, and the layer where it becomes so."""
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "small.tar").write_bytes(saved([tar({"a": b"x" * 60}), tar(LAYERS[0])]))
    (tmp_path / "deep" / "er" / "large.tar").write_bytes(saved([tar({"a": b"x" * 700}), tar({"b": b"x" * 1400}), tar({"c": b"x" * 700})]))
    (tmp_path / "broken.tar").write_bytes(b"no archive")
    (tmp_path / "half.tar").write_bytes(saved([tar({"a": b"x" * 3000})[:1500]]))
    good, problems = images.within_limit(images.read_images(spark, str(tmp_path), 2800), 2000)
    found = {r.path.rsplit("/", 1)[1]: (r.layer_index, r.problem.split(":")[0]) for r in problems.collect()}
    assert found == {"large.tar": (1, "more than 2000 bytes"), "broken.tar": (0, "ReadError"), "half.tar": (0, "ImageSizeLimitExceeded")}
    assert {r.source.rsplit("/", 1)[1] for r in good.collect()} == {"small.tar"}
    assert images.image_findings(good).count() == 3
    assert images.image_findings(images.read_images(spark, str(tmp_path), 2800)).count() == 3


def test_a_large_layer_is_streamed(tmp_path):
    """A layer of 2 GB, of one sparse file and small ones, in little memory; the large file has no content."""
    import subprocess
    import sys
    from pathlib import Path

    inner = tmp_path / "layer.tar"
    with tarfile.open(inner, "w") as t:
        for name, n in (("small", 5), ("large", 2 << 30), ("last", 7)):
            info = tarfile.TarInfo(name)
            info.size = n
            with open(tmp_path / "f", "wb") as f:
                f.truncate(n)
            t.addfile(info, open(tmp_path / "f", "rb")) if n < 100 else (t.fileobj.write(info.tobuf()), t.fileobj.seek(n, 1), setattr(t, "offset", t.offset + 512 + n))
    (tmp_path / "image" / "blobs" / "sha256").mkdir(parents=True)
    inner.rename(tmp_path / "image" / "blobs" / "sha256" / "l")
    (tmp_path / "image" / "blobs" / "sha256" / "m").write_text(json.dumps({"layers": [{"digest": "sha256:l"}]}))
    (tmp_path / "image" / "index.json").write_text(json.dumps({"manifests": [{"digest": "sha256:m"}]}))
    code = "import resource, sys\nfrom lodestrata.sources import images\nd, own = images.layers(sys.argv[1])\nprint([(p, n, c and len(c)) for p, _, n, _, c in images.entries(sys.argv[1], *own[0], 1 << 33, 1 << 20)], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    got = subprocess.run([sys.executable, "-c", code, str(tmp_path / "image")], capture_output=True, text=True, cwd=Path(__file__).parents[1], timeout=300)
    assert got.stdout.startswith("[('small', 5, 5), ('large', 2147483648, None), ('last', 7, 7)]"), got.stderr
    assert int(got.stdout.split()[-1]) < 500_000  # KB


def test_images_and_certificates_of_a_scan(spark, tmp_path):
    from lodestrata.operators import scan

    (tmp_path / "image.tar").write_bytes(saved([tar(x) for x in LAYERS]))
    (tmp_path / "tls").mkdir()
    (tmp_path / "tls" / "own.pem").write_bytes(pem("CERTIFICATE", cert([RSA, tlv(5)], rsa_key(1024))))
    (tmp_path / "tls" / "none.pem").write_bytes(b"-----BEGIN CERTIFICATE-----\nabcde\n-----END CERTIFICATE-----\n")
    found, summary = scan.run_scan(spark, str(tmp_path), ("container", "certificate"))
    got = {(r.file.rsplit(":", 1)[-1], r.artifact_type, r.key_size) for r in found.collect()}
    assert got == {("libssl3", "CONTAINER_LAYER", None), ("etc/gone/b.crt", "CONTAINER_LAYER", 2048), ("tls/own.pem", "SOURCE_FILE", 1024)} and summary.first().total == 3
    alone, _ = scan.run_scan(spark, str(tmp_path / "tls" / "own.pem"), ("certificate",))
    assert [r.file for r in alone.collect()] == ["own.pem"]
    assert scan.run_scan(spark, str(tmp_path / "image.tar"), ("container",))[0].count() == 2


def test_paths_that_are_left_out(spark):
    from lodestrata.operators.packages import kept_path

    paths = ["etc/a.pem", "x/run", "runner/a", "a/usr/share/doc/b", "a/run/b", "x/running/a", "opt/var/log"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in df.where(kept_path()).collect()] == ["etc/a.pem", "x/running/a"]
