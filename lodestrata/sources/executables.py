"""Symbols, needed libraries and sections of ELF and PE files; of other files the words in them."""

from __future__ import annotations

import re
import struct

from .patterns import Patterns

# fixed values: how Mach-O files begin
_MACHO = frozenset(bytes.fromhex(x) for x in ("feedface", "feedfacf", "cefaedfe", "cffaedfe", "cafebabe", "bebafeca"))
_WORD = re.compile(rb"[A-Za-z0-9_]{3,64}")


def file_format(data: bytes) -> str | None:
    if data[:4] == b"\x7fELF":
        return "elf"
    if data[:2] == b"MZ" and len(data) >= 0x40:
        at = struct.unpack_from("<I", data, 0x3C)[0]
        if data[at : at + 4] == b"PE\0\0":
            return "pe"
    return "macho" if data[:4] in _MACHO else None


def _name(data: bytes, at: int) -> str:
    end = data.find(b"\0", at)
    return data[at : end if end >= 0 else len(data)].decode("utf-8", "ignore")


def elf(data: bytes) -> tuple[list[tuple[str, str]], list[tuple[str, bytes]]]:
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    table, size, count, names = (struct.unpack_from(order + ("Q" if wide else "I"), data, 40 if wide else 32)[0], *struct.unpack_from(order + "HHH", data, 58 if wide else 46))
    raw = []
    for k in range(count):
        f = struct.unpack_from(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), data, table + k * size)
        raw.append({"name": f[0], "type": f[1], "at": f[4], "size": f[5], "link": f[6], "each": f[9]})
    content = lambda s: b"" if s["type"] == 8 else data[s["at"] : s["at"] + s["size"]]
    strings = content(raw[names]) if names < len(raw) else b""
    symbols, sections = [], []
    for s in raw:
        name, own = _name(strings, s["name"]), content(s)
        if s["type"] in (2, 11) and s["each"]:
            linked = content(raw[s["link"]])
            symbols += [(x, name or ".symtab") for k in range(0, len(own) - s["each"] + 1, s["each"]) if (x := _name(linked, struct.unpack_from(order + "I", own, k)[0]))]
        elif s["type"] == 6:
            linked, step = content(raw[s["link"]]), 16 if wide else 8
            for k in range(0, len(own) - step + 1, step):
                tag, value = struct.unpack_from(order + ("QQ" if wide else "II"), own, k)
                if tag == 1:
                    symbols.append((_name(linked, value), ".dynamic:NEEDED"))
        sections.append((name or ".data", own))
    return symbols, sections


def pe(data: bytes) -> tuple[list[tuple[str, str]], list[tuple[str, bytes]]]:
    at = struct.unpack_from("<I", data, 0x3C)[0]
    count, optional = struct.unpack_from("<H", data, at + 6)[0], struct.unpack_from("<H", data, at + 20)[0]
    wide = struct.unpack_from("<H", data, at + 24)[0] == 0x20B
    folders = at + 24 + (112 if wide else 96)
    places, sections = [], []
    for k in range(count):
        name, virtual_size, virtual, raw_size, raw = struct.unpack_from("<8sIIII", data, at + 24 + optional + 40 * k)
        places.append((virtual, max(virtual_size, raw_size), raw))
        sections.append((name.rstrip(b"\0").decode("utf-8", "ignore"), data[raw : raw + raw_size]))
    where = lambda rva: next((rva - v + raw for v, n, raw in places if v <= rva < v + n), None)
    symbols = []
    exports, imports = (where(struct.unpack_from("<I", data, folders + 8 * k)[0]) for k in (0, 1))
    step, flag = (8, 1 << 63) if wide else (4, 1 << 31)
    while imports is not None and any(entry := struct.unpack_from("<IIIII", data, imports)):
        symbols.append((_name(data, where(entry[3])), ".idata:DLL"))
        thunk = where(entry[0] or entry[4])
        while thunk is not None and (value := struct.unpack_from("<Q" if wide else "<I", data, thunk)[0]):
            if not value & flag:
                symbols.append((_name(data, where(value) + 2), ".idata"))
            thunk += step
        imports += 20
    if exports:
        n, names = struct.unpack_from("<I", data, exports + 24)[0], where(struct.unpack_from("<I", data, exports + 32)[0])
        symbols += [(_name(data, where(struct.unpack_from("<I", data, names + 4 * k)[0])), ".edata") for k in range(n if names else 0)]
    return symbols, sections


def read(data: bytes, constants: Patterns) -> tuple[str, list[tuple[str, str]], list[tuple[str, int, int]]] | None:
    """Format, symbols with their tables, and where constants stand: section, offset, number of the constant. A file that can't be
    parsed is one section, and its words are its symbols."""
    kind = file_format(data)
    if kind is None:
        return None
    try:
        symbols, sections = {"elf": elf, "pe": pe}.get(kind, lambda _: ([], []))(data)
    except (struct.error, IndexError, TypeError):
        symbols, sections = [], []
    if not symbols:
        symbols = [(w.decode(), ".dynsym") for w in dict.fromkeys(_WORD.findall(data))]
    hits = []
    for name, own in sections or [(".rodata", data)]:
        hits += [(name, at, k) for at, k in constants.places(own)]
    return kind, symbols, hits
