"""Operator 3: secrets in text, by pattern and confirmed by the structure of what they encode.

Patterns give assignments, access ids and long hex runs. Beyond these, every base64 or
hex run is decoded, lines that wrap one joined, and a span is reported only if the bytes
are what they claim to be: a private key whose nested lengths add up, an OpenSSH key, an
armoured key, or a token whose header is a JSON object that names its signature.
"""

import base64
import binascii
import bisect
import hashlib
import json
import re
from operator import itemgetter

from pyspark.sql import DataFrame

from logloom.llm.rows import map_rows, rewrite_texts, text_frame, texts_of

# What the base patterns are, in the order that settles equal starts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of [0-9a-f]+ are matched whole, so asking for 16 characters at once drops just the short ones.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

# A run this long can hold a key or a token; the smallest key (Ed25519) has 48 bytes.
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
# Runs that fill lines, and what the last of them goes over to.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}+(?:\r?\n|\\n)[\x20\t]*)+(?:[A-Za-z0-9+/_-]+={0,2})?")
BREAK = re.compile(r"(?:\r?\n|\\n)[\x20\t]*")
# A match begins at 'ey', so nothing before a dot can take it; matches may overlap.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
# A header of an armoured block takes a whole line; lines may also be written as \n.
HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n]*+")
LINE_BREAK = re.compile(r"\r\n|[\r\n]|\\r\\n|\\[rn]")
BODY = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\(?=\s))*+")
HEX_LONG = re.compile(r"[0-9a-f]{80,}|[0-9A-F]{80,}")


def der_head(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and size of the content of the DER item at ``at``; None if its head is not whole before ``end``."""
    end = min(end, len(data))
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size >= 0x80:
        count = size & 0x7F
        if not 1 <= count <= 4 or at + count > end:
            return None
        size = int.from_bytes(data[at : at + count], "big")
        if size < 0x80 or data[at] == 0:  # not the shortest form
            return None
        at += count
    return tag, at, size


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER item at ``at``; None if it isn't one within ``end``."""
    head = der_head(data, at, end)
    return (head[0], head[1], head[1] + head[2]) if head and head[1] + head[2] <= end else None


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill ``at`` to ``end`` exactly, or None."""
    out = []
    while at < end:
        item = der_item(data, at, end)
        if item is None or len(out) > 64:
            return None
        out.append(item)
        at = item[2]
    return out


def is_key(data: bytes) -> bool:
    """Whether ``data`` begins with a private key in DER (PKCS#1, PKCS#8, encrypted PKCS#8, SEC1)
    or is an OpenSSH private key; all nested lengths must fit."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, kdf, kdf options
            size = int.from_bytes(data[at : at + 4], "big")
            at += 4 + size
            if at + 4 > len(data):
                return False
        return 1 <= int.from_bytes(data[at : at + 4], "big") <= 16
    top = der_item(data, 0, len(data))
    if top is None or top[0] != 0x30 or len(data) - top[2] > 2:
        return False
    parts = der_children(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]
    if tags[0] == 2:
        version = int.from_bytes(data[parts[0][1] : parts[0][2]], "big")
        if tags[1] == 2 and len(tags) >= 9:  # modulus, exponents, primes
            return version in (0, 1) and all(t == 2 for t in tags[:9])
        if tags[1] == 4:  # SEC1: the scalar, then curve and point
            return version == 1 and 16 <= parts[1][2] - parts[1][1] <= 72
        if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 4:
            inner = der_children(data, parts[1][1], parts[1][2])
            return version in (0, 1) and bool(inner) and inner[0][0] == 6
        return False
    if tags[:2] == [0x30, 4] and len(tags) == 2:
        inner = der_children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 6 and data[inner[0][1] : inner[0][2]].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01")
    return False


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 or base64url run, or None."""
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.translate({45: 43, 95: 47}) + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    """A JSON header that names the algorithm, and a payload that is a JSON object."""
    try:
        head = json.loads(decoded(header) or b"")
        if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
            return False
        if "enc" in head:
            return True
        return isinstance(json.loads(decoded(payload) or b""), dict)
    except (ValueError, RecursionError):
        return False


def armoured_keys(text: str) -> list[tuple[int, int]]:
    """Spans of private keys between BEGIN and END. With a Proc-Type header the body is
    ciphertext, of whole cipher blocks; else it must be a key. Each line is looked at once."""
    out, ends = [], {}
    begins = list(BEGIN.finditer(text)) if "PRIVATE KEY-----" in text else []
    for m, after in zip(begins, [*[x.start() for x in begins[1:]], len(text)], strict=False):
        mark = f"-----END {m[1]}-----"
        # The next END of this name, looked for anew only once it is passed; there may be none.
        end = ends.get(mark, 0)
        if 0 <= end < m.end():
            end = ends[mark] = text.find(mark, m.end())
        if not m.end() <= end < after:
            continue
        lines = LINE_BREAK.split(text[m.end() : end])
        first = 0
        while first < len(lines) and (not (line := lines[first].strip()) or HEADER.fullmatch(line)):
            first += 1
        headers, rest = "\n".join(lines[:first]), "\n".join(lines[first:])
        if not BODY.fullmatch(rest):
            continue
        body = decoded(re.sub(r"\\|\s", "", rest))
        encrypted = "ENCRYPTED" in headers and "DEK-Info:" in headers
        if body and (len(body) % 8 == 0 and len(body) >= 48 if encrypted else is_key(body)):
            out.append((m.start(), end + len(mark)))
    return out


def claims_all(head: bytes, size: int) -> bool:
    """Whether bytes that begin with ``head`` can be a key of ``size`` bytes, but for 2 at its end."""
    if head.startswith(b"openssh"):
        return True
    top = der_head(head, 0, len(head))
    return top is not None and top[0] == 0x30 and 0 <= size - top[1] - top[2] <= 2


def key_bytes(data: bytes) -> int | None:
    """The kind of the key that ``data`` is or, armoured, holds."""
    if is_key(data):
        return 5 if data[0] == 0x6F else 4
    return 3 if b"PRIVATE KEY-----" in data and armoured_keys(data.decode("latin-1")) else None


def key_in_run(run: str) -> tuple[int, int] | None:
    """Where in a base64 run a key begins that goes to its end, and the key's kind."""
    body = run.rstrip("=")
    # Other characters may stand before a key. DER begins with 30, OpenSSH's name with 'o': so do their codes.
    for m in re.finditer("M|b3BlbnNz", body):
        at = m.start()
        if len(body) - at >= 40 and (head := decoded(body[at : at + 12])) and claims_all(head, (len(body) - at) * 3 // 4):
            data = decoded(body[at:])
            if data and is_key(data):
                return at, 5 if data[0] == 0x6F else 4
    for at in range(4):
        data = decoded(body[at : len(body) - (len(body) - at) % 4 if (len(body) - at) % 4 == 1 else len(body)])
        if data and b"PRIVATE KEY-----" in data and (kind := key_bytes(data)):
            return at, kind
    return None


def key_in_hex(run: str) -> tuple[int, int] | None:
    """Where in a hex run a key begins that goes to its end, and the key's kind."""
    for odd in (0, 1):
        data = bytes.fromhex(run[odd : len(run) - (len(run) - odd) % 2])
        for m in re.finditer(b"\x30|openssh-key", data):
            at = m.start()
            if claims_all(data[at : at + 8], len(data) - at) and is_key(data[at:]):
                return odd + 2 * at, 5 if data[at] == 0x6F else 4
        if b"PRIVATE KEY-----" in data and (kind := key_bytes(data)):
            return odd, kind
    return None


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets, sorted; kind is a place in KINDS. Base kinds come first in KINDS."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken = armoured_keys(text)
    out += [(a, 3, b) for a, b in taken]
    wrapped: list[tuple[int, int]] = []
    # Disjoint and in order, so the last that begins before a place is the only one that can hold it.
    inside = lambda at: (k := bisect.bisect_right(taken, at, key=itemgetter(0))) > 0 and at < taken[k - 1][1]
    for m in WRAPPED.finditer(text):
        if inside(m.start()):
            continue
        # The last line may be a key's or what comes after one.
        lines = [x for x in BREAK.split(m[0]) if x]
        cut = m[0].rstrip()
        whole = [(lines, m.start() + len(cut))]
        if len(lines) > 2:
            last = m.start() + cut.rindex(lines[-1])
            whole.append((lines[:-1], m.start() + len(re.sub(r"(?:\r?\n|\\n)[\x20\t]*$", "", text[m.start() : last]))))
        for own, end in whole:
            if len(own) > 1 and (found := key_in_run("".join(own))) and found[0] < len(own[0]):
                out.append((m.start() + found[0], found[1], end))
                wrapped.append((m.start(), end))
                break
    taken = sorted(taken + wrapped)
    for m in RUN.finditer(text):
        if not inside(m.start()) and (found := key_in_run(m[0])):
            out.append((m.start() + found[0], found[1], m.end()))
    for m in HEX_LONG.finditer(text):
        if found := key_in_hex(m[0]):
            out.append((m.start() + found[0], found[1], m.end()))
    if "ey" in text:
        out += [(m.start(), 6, m.end(3)) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    return sorted(set(out))


def redact(text: str, spans: list[tuple[int, int, int]], mark="[SECRET]") -> str:
    """``text`` with every secret, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_column="doc_id", text_column="text", redacted=False) -> DataFrame:
    """Secrets of every text, whole texts.

    Returns doc_id, n_assign, n_access, n_hex, n_confirmed (spans confirmed by
    structure), base_sha256, spans (``kind:start:end`` in code points, end exclusive,
    by start, then kind), and with ``redacted`` the text without its secrets. A null or
    empty text has none. Repeated rows each give a row, a null id stays null, other
    columns are left behind. One row at a time; no exchange.
    """
    frame = text_frame(docs, id_column, text_column)
    id_type = frame.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch):
            out = {n: [] for n in ("n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans", "redacted")}
            out["doc_id"] = batch.column("doc_id")
            for text in texts_of(batch):
                found = find_secrets(text)
                kinds = [k for _, k, _ in found]
                for k, n in enumerate(("n_assign", "n_access", "n_hex")):
                    out[n].append(kinds.count(k))
                out["n_confirmed"].append(sum(k > 2 for k in kinds))
                out["base_sha256"].append(hashlib.sha256(written([x for x in found if x[1] <= 2]).encode()).hexdigest())
                out["spans"].append(written(found))
                out["redacted"].append(redact(text, found))
            return out

        return work

    schema = f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, n_confirmed bigint, base_sha256 string, spans string"
    return map_rows(frame, make, schema + ", redacted string" * redacted)


def redact_documents(docs: DataFrame, text_column="text", length_column="n_chars") -> DataFrame:
    """``docs``, all columns, with every secret in its text replaced; texts without one stay as they are, nulls too."""

    def make():
        def work(batch):
            found = [(t, find_secrets(t)) for t in texts_of(batch, text_column)]
            return [redact(t, spans) if spans else None for t, spans in found]

        return work

    return rewrite_texts(docs, make, text_column, length_column)
