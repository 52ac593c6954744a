"""Executables that are put together here: tables, needed libraries, constants, and files that are none."""

import struct

from lodestrata.operators.binaries import CONSTANTS, binary_findings
from lodestrata.sources import executables

AES, MD5 = bytes.fromhex(CONSTANTS[0][0]), bytes.fromhex(CONSTANTS[2][0])


def strings(*names):
    out, at = b"\0", []
    for n in names:
        at.append(len(out))
        out += n.encode() + b"\0"
    return out, at


def elf(symbols, needed, rodata, wide=True, order="<"):
    names, at = strings(*symbols, *needed)
    each = 24 if wide else 16
    table = b"\0" * each + b"".join(struct.pack(order + "I", x).ljust(each, b"\0") for x in at[: len(symbols)])
    dynamic = b"".join(struct.pack(order + ("QQ" if wide else "II"), 1, x) for x in at[len(symbols) :]) + b"\0" * 16
    titles, t = strings(".dynsym", ".dynstr", ".dynamic", ".rodata", ".bss", ".shstrtab")
    parts = [(t[0], 11, table, 2, each), (t[1], 3, names, 0, 0), (t[2], 6, dynamic, 2, 0), (t[3], 1, rodata, 0, 0), (t[4], 8, b"", 0, 0), (t[5], 3, titles, 0, 0)]
    head = 64 if wide else 52
    body, headers = b"", [b"\0" * (64 if wide else 40)]
    for name, kind, data, link, size in parts:
        f = (name, kind, 0, 0, head + len(body), len(data), link, 0, 1, size)
        headers.append(struct.pack(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), *f))
        body += data
    ident = b"\x7fELF" + bytes([2 if wide else 1, 1 if order == "<" else 2, 1]) + b"\0" * 9
    start = struct.pack(order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), 3, 62, 1, 0, 0, head + len(body), 0, head, 0, 0, 64 if wide else 40, len(headers), len(headers) - 1)
    return ident + start + body + b"".join(headers)


def pe(dll, names, data, wide):
    rva, raw = 0x1000, 0x400
    step = 8 if wide else 4
    thunks = 40
    texts = thunks + step * (len(names) + 1)
    blob, at = b"", []
    for n in names:
        at.append(rva + texts + len(blob))
        blob += b"\0\0" + n.encode() + b"\0"
    library = rva + texts + len(blob)
    blob += dll.encode() + b"\0"
    section = struct.pack("<IIIII", rva + thunks, 0, 0, library, rva + thunks) + b"\0" * 20
    section += b"".join(struct.pack("<Q" if wide else "<I", x) for x in [*at, 0]) + blob + data
    optional = struct.pack("<H", 0x20B if wide else 0x10B).ljust(112 if wide else 96, b"\0") + struct.pack("<IIII", 0, 0, rva, 40)
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 0) + optional
    head += struct.pack("<8sIIII", b".idata", len(section), rva, len(section), raw) + b"\0" * 16
    return head.ljust(raw, b"\0") + section


def test_findings(spark):
    rows = [
        ("a.elf", elf(["MD5_Init", "AES_encrypt", "EVP_sha256", "RC4x", "puts", "my_MD5_Init"], ["libcrypto.so.3", "libc.so"], b"xx" + AES + MD5 + AES)),
        ("b.elf", elf(["RC4"], [], b"", wide=False, order=">")),
        ("c.exe", pe("libcrypto.dll", ["MD5_Init", "DES_set_key"], MD5, True)),
        ("d.exe", pe("kernel32.dll", ["ReadFile", "RC4_set_key"], b"", False)),
        ("e.cut", elf(["MD5_Init"], [], b"")[:100] + b" EVP_md5 "),
        ("f.txt", b"MD5_Init"),
        ("g.short", b"MZ"),
        ("h.macho", bytes.fromhex("feedfacf") + b" MD5_Init " + AES),
    ]
    df = spark.createDataFrame([(n, bytearray(x)) for n, x in rows], "rel_path string, content binary")
    got = {(r.file, r.algorithm, r.matched_call, r.language, float(r.confidence_score)) for r in binary_findings(df).collect()}
    assert got == {
        ("a.elf", "MD5", ".dynsym:MD5_Init", "elf", 0.85),
        ("a.elf", "MD5", ".dynsym:my_MD5_Init", "elf", 0.85),
        ("a.elf", "AES", ".dynsym:AES_encrypt", "elf", 0.85),
        ("a.elf", "SHA-256", ".dynsym:EVP_sha256", "elf", 0.85),
        ("a.elf", "UNKNOWN", ".dynamic:libcrypto.so.3", "elf", 0.85),
        ("a.elf", "AES", ".rodata+0x2", "elf", 0.0),
        ("a.elf", "AES", ".rodata+0x22", "elf", 0.0),
        ("a.elf", "MD5", ".rodata+0x12", "elf", 0.0),
        ("b.elf", "RC4", ".dynsym:RC4", "elf", 0.85),
        ("c.exe", "MD5", ".idata:MD5_Init", "pe", 0.85),
        ("c.exe", "DES", ".idata:DES_set_key", "pe", 0.85),
        ("c.exe", "UNKNOWN", ".idata:DLL:libcrypto.dll", "pe", 0.85),
        ("c.exe", "MD5", f".idata+0x{40 + 24 + 11 + 14 + 14:x}", "pe", 0.0),
        ("d.exe", "RC4", ".idata:RC4_set_key", "pe", 0.85),
        ("e.cut", "MD5", ".dynsym:EVP_md5", "elf", 0.85),
        ("h.macho", "AES", ".rodata+0xe", "macho", 0.0),
    }
    assert executables.read(b"", []) is None
