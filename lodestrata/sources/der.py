"""Keys of X.509 certificates and private keys, read from their DER bytes."""

from __future__ import annotations

import base64
import re

# fixed values: object identifiers of keys, of curves with their bits, and of signatures over weak hashes
KEYS = {"1.2.840.113549.1.1.1": "RSA", "1.2.840.10040.4.1": "DSA", "1.2.840.10045.2.1": "ECDSA", "1.3.101.112": "Ed25519"}
CURVES = {"1.2.840.10045.3.1.1": 192, "1.3.132.0.33": 224, "1.2.840.10045.3.1.7": 256, "1.3.132.0.10": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521}
WEAK_SIGNATURES = frozenset(("1.2.840.113549.1.1.4", "1.2.840.113549.1.1.5", "1.2.840.10045.4.1", "1.2.840.10040.4.3", "1.3.14.3.2.29"))
_PEM = re.compile(rb"-----BEGIN ((?:RSA |EC )?PRIVATE KEY|CERTIFICATE)-----([^-]*)-----END \1-----")


def elements(data: bytes) -> list[tuple[int, bytes]]:
    """Tags and contents of the elements in a row."""
    out, at = [], 0
    while at + 2 <= len(data):
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            raise ValueError("an element is cut off")
        out.append((tag, data[at : at + n]))
        at += n
    return out


def identifier(data: bytes) -> str:
    parts, value = [], 0
    for b in data:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            parts.append(value)
            value = 0
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def bits(number: bytes) -> int:
    return int.from_bytes(number, "big").bit_length()


def _key(algorithm: bytes, key: bytes) -> tuple[str, int | None]:
    """Name and size from an algorithm's identifier and the key itself."""
    (_, oid), *params = elements(algorithm)
    name = KEYS.get(identifier(oid), "UNKNOWN")
    if name == "RSA":
        numbers = [v for t, v in elements(elements(key)[0][1]) if t == 2]
        return name, bits(max(numbers[:2], key=bits))
    if name == "DSA":
        return name, bits(elements(params[0][1])[0][1])
    if name == "ECDSA":
        return name, CURVES.get(identifier(params[0][1])) if params and params[0][0] == 6 else None
    return name, 256 if name == "Ed25519" else None


def certificate(data: bytes) -> tuple[str, int | None, bool]:
    """Name, size, and whether key or signature are weak."""
    body, signature, *_ = elements(elements(data)[0][1])
    fields = [x for x in elements(body[1]) if x[0] != 0xA0]
    algorithm, key = elements(fields[5][1])
    name, size = _key(algorithm[1], key[1][1:])
    weak = name == "DSA" or name == "RSA" and size < 2048 or identifier(elements(signature[1])[0][1]) in WEAK_SIGNATURES
    return name, size, weak


def private_key(kind: str, data: bytes) -> tuple[str, int | None, bool]:
    own = elements(elements(data)[0][1])
    if kind == "RSA PRIVATE KEY":
        name, size = "RSA", bits(own[1][1])
    elif kind == "EC PRIVATE KEY":
        curve = next((v for t, v in own if t == 0xA0), None)
        name, size = "ECDSA", CURVES.get(identifier(elements(curve)[0][1])) if curve else None
    else:
        name, size = _key(own[1][1], own[2][1])
    return name, size, name == "DSA" or name == "RSA" and size < 2048


def _decoded(text: bytes) -> bytes | None:
    try:
        return base64.b64decode(re.sub(rb"\s", b"", text))
    except ValueError:
        return None


def keys_of(data: bytes) -> list[tuple[str, str, int | None, bool]]:
    """How it was found, name, size and weakness of the first certificate in the data, or else of the first private key. What
    is no base64 or no DER is passed over."""
    found = [(m[1].decode(), raw) for m in _PEM.finditer(data) if (raw := _decoded(m[2])) is not None]
    certificates = [raw for kind, raw in found if kind == "CERTIFICATE"]
    try:
        if certificates or data[:1] == b"\x30":
            return [("x509.load_pem_x509_certificate" if certificates else "x509.load_der_x509_certificate", *certificate(certificates[0] if certificates else data))]
    except (ValueError, IndexError):
        pass
    for kind, raw in found:
        if kind != "CERTIFICATE":
            try:
                return [("serialization.load_pem_private_key", *private_key(kind, raw))]
            except (ValueError, IndexError):
                return []
    return []
