"""Secret scans: fixed patterns and a token-efficiency test.

Random strings break into many short tokens. A candidate is a run of key characters that has letters
and digits; it is a secret when a byte-pair vocabulary needs at least one token per ``ratio``
characters. Runs that are known digests (hexadecimal of a digest's length) or identifiers (UUIDs, dotted
names and addresses, plain numbers) are not reported by this test; the fixed patterns report what they match.

Null and empty texts have no spans, and time grows with the length of a text and not with the square of its spans; an empty table gives no rows. Rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO = 2.2  # characters per token at or below which a candidate counts as random
SHORTEST = 16  # characters of a candidate

# Fixed patterns and the length a match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of HEX that are long enough
LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
ONLY_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_KINDS = ("assign", "access", "hex", "token")
_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the matches of the fixed patterns."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in LONG_ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return found


def is_random(run: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> bool:
    """True for a run with few characters per token that is neither a digest nor an identifier."""
    if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return False
    if UUID.fullmatch(run) or (ONLY_HEX.fullmatch(run) and len(run) in DIGEST_LENGTHS):
        return False
    return len(run) <= ratio * len(encoding.encode_ordinary(run))


def spans(text: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, and random runs that lie in none of them."""
    found = base_spans(text)
    taken, at, reach = sorted((a, b) for a, b, _ in found), 0, -1
    for m in CANDIDATE.finditer(text):  # both lists are walked together
        while at < len(taken) and taken[at][0] <= m.start():
            reach, at = max(reach, taken[at][1]), at + 1
        if m.end() > reach and is_random(m[0], encoding, ratio):
            found.append((m.start(), m.end(), "token"))
    return sorted(found, key=lambda s: (s[0], _KINDS.index(s[2])))


def scan(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """Id and spans (start, end, kind; code points, end exclusive) of each row.

    ``vocabulary`` is the path of a tiktoken rank file that every executor has, ``pattern`` its split pattern.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        encoding = _encoding(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [[{"start": a, "end": b, "kind": k} for a, b, k in spans(t.as_py() or "", encoding, ratio)] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, span)], [id_column, "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).cast("string")).mapInArrow(
        run, f"`{id_column}` {kind}, spans array<struct<start:int,end:int,kind:string>>")


def digest(found: list[tuple[int, int, str]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
