"""Secret scans with structural confirmation.

Three pattern kinds (assign, access, hex) are reported as they match. Other
kinds are reported only if what base64 or hex holds is well formed:

- token: a signed or encrypted token, whose header is a JSON object that names
  an algorithm, and whose payload is a JSON object unless it is encrypted;
- der: a private key (PKCS#1, PKCS#8 plain or encrypted, SEC 1, DSA) or a
  public key (PKCS#1, SubjectPublicKeyInfo) in nested lengths that fill one
  another exactly, at any depth;
- ssh: a public key blob of a known type, or an OpenSSH private key container.

Certificates and other structures are no findings. A key may begin at any
character of a run, whatever stands before it, and go on over line breaks; it
must end where the run, or one of its lines, ends. Line breaks may be written
as backslash and n, as in JSON, and lines may stand in quotes or behind the
marks of a comment or a list. Hex may have colons. What a run holds may itself
be armoured or base64, which is read once more.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back

# fixed values: patterns and least lengths
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "token", "der", "ssh")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
# fixed values: key types of SSH, and how many fields their public blobs have, the name included
SSH_FIELDS = {
    b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ssh-ed448": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3,
    b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4,
}
CONTAINER = b"openssh-key-v1\0"

# the shortest header, {"alg":1}, has 12 characters; a run is tried once, from its beginning
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{12,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+))?")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# a break between lines: written out, or real, with closing and opening quotes, a joining mark, and marks of a comment or list about it
_QUOTED = r"""["']?[ \t]*[,+.\\]?[ \t]*\r?\n[ \t]*"""
_BREAK = rf"""(?:(?:\\r)?\\n(?:{_QUOTED}["']?)?|{_QUOTED}(?:(?:[#>*;|]+|//[ \t]|-[ \t])[ \t]*)?["']?)"""
_RUN = re.compile(rf"[A-Za-z0-9+/_-]+(?:{_BREAK}[A-Za-z0-9+/_-]+)*")
_BREAKS, _BREAKS_RAW = re.compile(_BREAK), re.compile(_BREAK.encode())
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::(?:[ \t]*\r?\n[ \t]*)?[0-9A-Fa-f]{2}){23,}(?![0-9A-Fa-f:])")
_PAIR = re.compile(r"[0-9A-Fa-f]{2}")
_INNER = re.compile(rb"[A-Za-z0-9+/_=\s-]{32,}")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]+")
_SHORTEST = 24  # bytes of the shortest structure: 32 characters of base64, 48 of hex
_GATE = bytes(0x78 if chr(b) in _ALPHABET + "_-" else 0x20 for b in range(256))
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----[^-]+-----END \1-----")
_STARTS = re.compile(rb"(?s)(?=\x30[\x16-\x7f\x81-\x84]|\0\0\0.(?:ssh|ecdsa|sk)-|openssh-key-v1\0)")
_JSON_STARTS = re.compile(rb"(?=\{[\"\s])")


class Span(NamedTuple):
    """A finding; start and end are code points, end exclusive."""

    start: int
    end: int
    kind: str
    detail: str

    def key(self) -> tuple:
        return self.start, KINDS.index(self.kind), self.end


def _b64(text: str) -> bytes:
    """The bytes that whole groups of characters hold, of either alphabet; a single last character holds none."""
    text = text[: len(text) - (len(text) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(text + "=" * (-len(text) % 4))


def _element(raw: bytes, lo: int, hi: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at ``lo``, if it fits before ``hi``."""
    if hi - lo < 2:
        return None
    tag, size, lo = raw[lo], raw[lo + 1], lo + 2
    if size == 0x80 or tag & 0x1F == 0x1F:
        return None
    if size > 0x80:
        n = size & 0x7F
        if n > 4 or lo + n > hi or raw[lo] == 0:
            return None
        size, lo = int.from_bytes(raw[lo : lo + n], "big"), lo + n
        if size < 0x80:
            return None
    return (tag, lo, lo + size) if lo + size <= hi else None


def _elements(raw: bytes, lo: int, hi: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill raw[lo:hi] exactly, if they are as few as those of a key (ten at most)."""
    out = []
    while lo < hi:
        e = _element(raw, lo, hi)
        if e is None or len(out) == 10:
            return None
        out.append(e)
        lo = e[2]
    return out


def _nested(raw: bytes, lo: int, hi: int) -> bool:
    """Whether every constructed element in raw[lo:hi] is filled exactly, at any depth."""
    ends = [hi]
    while ends:
        if lo == ends[-1]:
            ends.pop()
            continue
        e = _element(raw, lo, ends[-1])
        if e is None:
            return False
        tag, start, end = e
        lo = end
        if tag & 0x20:
            ends.append(end)
            lo = start
    return True


def _algorithm(raw: bytes, e: tuple[int, int, int], nested: bool = False) -> bool:
    """Whether an element is an algorithm: an object id, and with ``nested`` parameters that are a sequence."""
    parts = _elements(raw, e[1], e[2]) if e[0] == 0x30 else None
    return bool(parts) and parts[0][0] == 0x06 and (not nested or len(parts) > 1 and parts[1][0] == 0x30)


def _der_key(raw: bytes, lo: int, hi: int) -> tuple[int, str] | None:
    """End and kind of the key whose sequence begins at ``lo``."""
    top = _element(raw, lo, hi)
    if top is None or top[0] != 0x30 or top[2] - lo < _SHORTEST:
        return None
    # the first element tells most other structures apart before all are read
    first = _element(raw, top[1], top[2])
    parts = _elements(raw, top[1], top[2]) if first and first[0] in (0x02, 0x30) else None
    if not parts or len(parts) < 2:
        return None
    tags, small = [e[0] for e in parts], parts[0][2] - parts[0][1] == 1 and raw[parts[0][1]] < 2
    kind = None
    if tags[0] == 0x02:
        if tags == [0x02] * 2:
            kind = "rsa public key"
        elif small and (tags == [0x02] * 9 or tags == [0x02] * 9 + [0x30]):
            kind = "rsa private key"
        elif small and tags == [0x02] * 6:
            kind = "dsa private key"
        elif small and tags[1:3] == [0x30, 0x04] and set(tags[3:]) <= {0xA0, 0xA1, 0x81} and _algorithm(raw, parts[1]):
            kind = "private key"
        elif small and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:
            kind = "ec private key"
    elif tags == [0x30, 0x03] and _algorithm(raw, parts[0]):
        kind = "public key"
    elif tags == [0x30, 0x04] and _algorithm(raw, parts[0], True):
        kind = "encrypted private key"
    return (top[2], kind) if kind and _nested(raw, lo, top[2]) else None


def _fields(raw: bytes, p: int, count: int) -> list[bytes] | None:
    """``count`` fields behind their lengths, and what is left as the last."""
    out = []
    for _ in range(count):
        size = int.from_bytes(raw[p : p + 4], "big")
        if len(raw) - p < 4 or p + 4 + size > len(raw):
            return None
        out.append(raw[p + 4 : p + 4 + size])
        p += 4 + size
    return [*out, raw[p:]]


def _ssh_key(raw: bytes, lo: int) -> tuple[int, str] | None:
    """End and kind of the key that begins at ``lo``."""
    if raw.startswith(CONTAINER, lo):
        # cipher, derivation and its options, the number of keys, so many public blobs, the private part
        got = _fields(raw, lo + len(CONTAINER), 3)
        keys = int.from_bytes(got[3][:4], "big") if got and len(got[3]) >= 4 else 0
        rest = _fields(got[3], 4, keys + 1) if 0 < keys <= len(raw) // 4 else None
        return (len(raw) - len(rest[-1]), "openssh private key") if rest else None
    name = _fields(raw, lo, 1)
    count = SSH_FIELDS.get(name[0]) if name else None
    got = _fields(raw, lo, count) if count else None
    return (len(raw) - len(got[-1]), name[0].decode()) if got and all(got[1:count]) else None


def _key_at(raw: bytes, lo: int) -> tuple[int, str, str] | None:
    """End, kind and detail of the structure at ``lo``."""
    if raw[lo] == 0x30:
        found = _der_key(raw, lo, len(raw))
        return (found[0], "der", found[1]) if found else None
    found = _ssh_key(raw, lo)
    return (found[0], "ssh", found[1]) if found else None


def der_detail(raw: bytes | None) -> str | None:
    """What key ``raw`` is as a whole, in DER."""
    found = _der_key(raw, 0, len(raw)) if raw else None
    return found[1] if found and found[0] == len(raw) else None


def ssh_detail(raw: bytes | None) -> str | None:
    """What key ``raw`` is as a whole, in the fields of SSH."""
    found = _ssh_key(raw, 0) if raw else None
    return found[1] if found and found[0] == len(raw) else None


def _decoded(run: str) -> Iterator[tuple[bytes, int, int, int]]:
    """Each way to read a run without its line breaks: bytes, where they begin, characters and bytes of a group."""
    if len(run) >= 32:
        for a in range(4):
            yield _b64(run[a:]), a, 4, 3
    for m in _HEX_ANY.finditer(run):
        if len(m[0]) >= 2 * _SHORTEST:
            for a in range(2):
                text = m[0][a:]
                yield bytes.fromhex(text[: len(text) & ~1]), m.start() + a, 2, 1


def _keys(run: str, ends: set[int], hex_ends: set[int], again: bool) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and detail of the keys in a run; ``ends`` are the places where one may end.

    With ``again``, what the run holds is also read as text that has keys.
    """
    for raw, at, chars, group in _decoded(run):
        if again:
            inner = [(0, len(raw))] if b"-----BEGIN " in raw else [m.span() for m in _INNER.finditer(raw)]
            for p, q in inner:
                # where a line of the run ends, a line of what it holds may end too
                cuts = sorted({c for e in ends if p < (c := (e - at) * group // chars) < q})
                text = b"\n".join(raw[a:b] for a, b in zip([p, *cuts], [*cuts, q])).decode("latin-1")
                breaks = [c - p + i for i, c in enumerate(cuts)]
                for s in find_secrets(text, again=False):
                    if s.kind in ("der", "ssh"):
                        a, b = (p + x - bisect_left(breaks, x) for x in (s.start, s.end))
                        yield at + a // group * chars, min(at + -(-b * chars // group), len(run)), s.kind, f"encoded {s.detail}"
        for m in _STARTS.finditer(raw):
            if m.start() % group:
                continue
            found = _key_at(raw, m.start())
            if not found:
                continue
            start = at + m.start() // group * chars
            size = found[0] - m.start()
            end = start + (-(-size * 4 // 3) if chars == 4 else 2 * size)
            if end in (ends if chars == 4 else hex_ends):
                yield start, end, found[1], found[2]


def _colon_keys(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and detail of keys in hex with colons; one ends where its pairs or a line of them end."""
    for m in _COLONS.finditer(text):
        pairs = [p.start() for p in _PAIR.finditer(text, m.start(), m.end())]
        raw = bytes(int(text[p : p + 2], 16) for p in pairs)
        for s in _STARTS.finditer(raw):
            found = _key_at(raw, s.start())
            if found and (found[0] == len(raw) or pairs[found[0]] - pairs[found[0] - 1] > 3):
                yield pairs[s.start()], pairs[found[0] - 1] + 2, found[1], found[2]


def _token_at(header: str, payload: str, encrypted: bool) -> tuple[int, str] | None:
    """Where in ``header`` a token's own header begins, and its algorithm."""
    starts = []
    for a in range(4):
        raw = _b64(header[a:]) if len(header) - a >= 12 and (len(header) - a) % 4 != 1 else b""
        if raw.rstrip().endswith(b"}"):
            starts += [(a + m.start() // 3 * 4, raw[m.start() :]) for m in _JSON_STARTS.finditer(raw) if m.start() % 3 == 0]
    for at, raw in sorted(starts):
        try:
            head = json.loads(raw)
            if not isinstance(head, dict) or not ("enc" in head if encrypted else "alg" in head):
                continue
            if not encrypted and not (len(payload) % 4 != 1 and isinstance(json.loads(_b64(payload)), dict)):
                continue
        except (ValueError, RecursionError):
            continue
        return at, str(head.get("alg") or head.get("enc"))[:40]
    return None


def _tokens(text: str) -> Iterator[Span]:
    """Tokens of three parts, or of five if encrypted; a part that is no header may still be followed by one."""
    p = 0
    while m := _TOKEN.search(text, p):
        for encrypted, last in ((True, 5), (False, 3)):
            found = _token_at(m[1], m[2], encrypted) if m[last] is not None else None
            if found:
                yield Span(m.start() + found[0], m.end(last), "token", found[1])
                p = m.end(last)
                break
        else:
            p = m.end(1) + 1


def _may_hold_key(raw: bytes) -> bool:
    """Whether some run, read across line breaks, is as long as the shortest structure."""
    if b"\n" in raw or b"\\n" in raw:
        raw = _BREAKS_RAW.sub(b"", raw)
    return b"x" * 32 in raw.translate(_GATE)


def find_secrets(text: str | None, gates: bool = True, again: bool = True) -> list[Span]:
    """All findings of a text, by start, then by kind; ``gates`` are byte searches that dismiss no text that holds one.

    ``again`` reads what base64 or hex holds as text once more.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    out: list[Span] = []
    if not gates or any(k in low for k in _KEYWORDS):
        out += [Span(m.start(), m.end(), "assign", m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if not gates or b"AKIA" in raw:
        out += [Span(m.start(), m.end(), "access", "") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    covered: list[tuple[int, int]] = []  # what tokens cover: their parts are no keys
    if not gates or raw.count(b".") >= 2:
        tokens = list(_tokens(text))
        out += tokens
        covered = [(t.start, t.end) for t in tokens]
    armours: list[tuple[int, int, str]] | None = None

    def framed(lo: int, hi: int, kind: str, detail: str) -> Iterator[Span]:
        nonlocal armours
        if any(x <= lo and hi <= y for x, y in covered):
            return
        if armours is None:
            armours = [(m.start(), m.end(), m[1]) for m in _ARMOUR.finditer(text)]
        frame = next(((x, y, f"{name}: {detail}") for x, y, name in armours if x <= lo and hi <= y), (lo, hi, detail))
        yield Span(frame[0], frame[1], kind, frame[2])

    if not gates or raw.count(b":") >= 23:
        for found in _colon_keys(text):
            out += framed(*found)
    if not gates or _may_hold_key(raw):
        out += [Span(m.start(), m.end(), "hex", "") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
        for m in _RUN.finditer(text):
            if m.end() - m.start() < 32:
                continue
            # the run without its breaks: where each line begins in it and in the text, and where lines end
            run, at, ends, p = [], [], set(), m.start()
            n = 0
            for b in [*_BREAKS.finditer(text, m.start(), m.end()), None]:
                line = text[p : b.start() if b else m.end()]
                at.append((n, p))
                run.append(line)
                n += len(line)
                ends.add(n)
                p = b.end() if b else p
            run = "".join(run)
            starts = [a for a, _ in at]

            def place(i: int, side: int) -> int:
                k = bisect_left(starts, i + side) - 1  # noqa: B023
                return at[k][1] + i - at[k][0]  # noqa: B023

            hex_ends = {h.end() for h in _HEX_ANY.finditer(run)} | ends
            for a, b, kind, detail in _keys(run, ends, hex_ends, again):
                out += framed(place(a, 1), place(b, 0), kind, detail)
    return sorted(set(out), key=Span.key)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, spans (start, end, kind, detail), by start, then kind.

    Null and empty texts have no spans; repeated rows are scanned one by one;
    other columns are ignored.
    """

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("detail", pa.string())]))
        for batch in batches:
            spans = [[s._asdict() for s in find_secrets(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<struct<start:long,end:long,kind:string,detail:string>>")


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """``text`` with each stretch of findings replaced by ``mark``."""
    out, p = [], 0
    for s in find_secrets(text):
        if s.start >= p:
            out += [text[p : s.start], mark]
        p = max(p, s.end)
    return "".join([*out, text[p:]]) if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[REDACTED]") -> DataFrame:
    """``docs``, all columns and rows, with findings replaced; ``length_col`` gets the new length of a changed text.

    Every finding is replaced, public keys included. Null and empty texts and
    texts without a finding come back unchanged; repeated rows are redacted one
    by one; other columns stay as they are, whatever their names.
    """
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    @give_back
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            changed: dict[int, str] = {}
            for i, t in enumerate(columns[at]):
                text = t.as_py()
                if text and (new := redact(text, mark)) != text:
                    changed[i] = new
            if changed:
                texts = columns[at].to_pylist()
                for i, t in changed.items():
                    texts[i] = t
                columns[at] = pa.array(texts, columns[at].type)
                if size is not None:
                    sizes = columns[size].to_pylist()
                    for i, t in changed.items():
                        sizes[i] = len(t)
                    columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(apply, docs.schema)
