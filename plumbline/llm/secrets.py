"""Secret scans with structural confirmation of what looks encoded."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import DataFrame

from plumbline.llm.common import map_texts

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates of the method: signed tokens, and runs of base64 (lines of one block included) or hex long enough for a key.
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}(?:\r?\n[A-Za-z0-9+/]{1,})*={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
KINDS = ("assign", "access", "hex", "signed_token", "key_base64", "key_hex")


def _json_object(part: str) -> dict | None:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(head: str, body: str) -> bool:
    """A header object that names an algorithm, and a payload that is an object."""
    header = _json_object(head)
    return header is not None and isinstance(header.get("alg"), str) and _json_object(body) is not None


def _der(data: bytes, at: int, end: int, depth: int = 0) -> int | None:
    """Where the DER element at ``at`` ends, if its lengths and those of all it holds are consistent."""
    if at + 2 > end or depth > 12:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if length < 0x80:
            return None
    stop = at + length
    if stop > end:
        return None
    if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
        while at < stop:
            inner = _der(data, at, stop, depth + 1)
            if inner is None:
                return None
            at = inner
    return stop


def _ssh(data: bytes) -> bool:
    """An SSH key: the private format's magic, or length-prefixed fields that start with a key type and fill it."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        field, at = data[at + 4 : at + 4 + n], at + 4 + n
        if at > len(data) or (not fields and not re.match(rb"(ssh-|ecdsa-sha2-|sk-)", field)):
            return False
        fields += 1
    return fields >= 2 and at == len(data)


def key_material(data: bytes) -> bool:
    """Bytes that parse as a whole as a DER sequence holding an integer or another sequence first, or as an SSH key."""
    if len(data) < 24:
        return False
    return (data[0] == 0x30 and _der(data, 0, len(data)) == len(data) and _first_inner(data) in (0x02, 0x30)) or _ssh(data)


def _key_sizes(data: bytes) -> set[int]:
    """The lengths at which a beginning of the bytes is key material: where a DER sequence or a field of an SSH key ends."""
    if data[0] == 0x30:
        head = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
        ends = {head + int.from_bytes(data[2:head], "big") if head > 2 else 2 + data[1]}
        return {n for n in ends if n <= len(data) and key_material(data[:n])}
    if data.startswith(b"openssh-key-v1\0"):
        return {len(data)}
    ends, at = set(), 0
    while at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        ends.add(at)
        if len(ends) == 1 and (at > len(data) or not _ssh(data[:at] + b"\0\0\0\0")):
            return set()
    return {n for n in ends - {min(ends)} if 24 <= n <= len(data)} if ends else set()


def _key_end(t: str, start: int, end: int) -> int | None:
    """Where the key ends that a block of base64 lines holds, or begins with: the most lines that parse as a whole."""
    raw = re.sub(r"[\r\n=]", "", t[start:end])
    data = base64.b64decode(raw[: len(raw) - (len(raw) % 4 == 1)] + "=" * (-len(raw) % 4 % 3))
    sizes = _key_sizes(data)
    if not sizes:
        return None
    stops, n = [], 0
    for line in re.finditer(r"[A-Za-z0-9+/]+", t[start:end]):
        n += len(line[0])
        if n % 4 != 1:
            stops.append((n * 3 // 4, start + line.end()))
    if stops and stops[-1][0] in sizes and n % 4 != 1:
        return end
    return next((stop for size, stop in reversed(stops) if size in sizes), None)


def _first_inner(data: bytes) -> int:
    skip = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    return data[skip] if skip < len(data) else -1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a text, by start and then the order of ``KINDS``; ends are exclusive."""
    t = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    if "AKIA" in t:
        out += [("access", *m.span()) for m in ACCESS.finditer(t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(t)]
    if "." in t:
        out += [("signed_token", *m.span()) for m in TOKEN.finditer(t) if signed_token(m[1], m[2])]
    at = 0
    while (m := ENCODED.search(t, at)) is not None:
        at = m.end()
        if t[m.start()] in "MAb" and (stop := _key_end(t, *m.span())) is not None:  # what 0x30, a length field and the magic begin with
            out.append(("key_base64", m.start(), stop))
            at = stop  # lines that are not of this key may be the next one
    out += [("key_hex", *m.span()) for m in HEX_KEY.finditer(t) if key_material(bytes.fromhex(m[0]))]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` plus ``secrets``, an array of (kind, start, stop) in code points.

    Base kinds are leftmost and non-overlapping per kind; a match that is too short goes and what it covered is not
    tried again. The method adds signed tokens whose header and payload decode to JSON, and base64 or hex that decodes
    to a DER structure whose nested lengths fit or to an SSH key. A map over whole texts: no shuffle.

    Defined cases: a null text is empty; an empty table gives an empty table; rows that repeat are answered each;
    columns not in ``keep`` are ignored.
    """

    def scan():
        return lambda text: ([{"kind": k, "start": a, "stop": b} for k, a, b in find_spans(text)],)

    return map_texts(docs, scan, "secrets array<struct<kind:string,start:int,stop:int>>", keep, text_col)
