"""Secret scans: an Aho-Corasick keyword pass, anchored regular expressions near its hits, checksum validation.

Kinds, in the order in which spans that start together are listed:

* ``assign``: keyword, separator, value of 8 or more characters (letters of the keyword in either case);
* ``access``: ``AKIA`` and upper-case letters or digits, 16 or more characters in all;
* ``hex``: lower-case hexadecimal runs of 32 or more. They have no keyword; runs are found on the byte buffer;
* ``gh_token``, ``npm_token``: prefix, 30 base-62 characters and their CRC-32 in 6 base-62 digits;
* ``card``: 13 to 19 digits (blanks or hyphens between them) that follow a card keyword and satisfy the Luhn check;
* ``iban``: an account number that follows the word and satisfies the check modulo 97.

The first three are the base kinds and are never changed by the others.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, slices, text_bytes

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "gh_token", "npm_token", "card", "iban")
#: The keywords of each kind (in lower case) and the expression that must match at the keyword.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "gh_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm_token": ("npm_",),
    "card": ("card", "visa", "mastercard"),
    "iban": ("iban",),
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "gh_token": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm_token": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "card": re.compile(r"(?:mastercard|visa|card)[^0-9\n]{0,24}(\d(?:[ -]?\d){12,18})(?!\d)", re.I | re.A),
    "iban": re.compile(r"iban[^A-Za-z0-9\n]{0,8}([A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.I | re.A),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = np.zeros(256, bool)
HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def base62_crc_ok(token: str) -> bool:
    """The last 6 characters are the CRC-32 of the 30 before them."""
    value, digits = zlib.crc32(token[-36:-6].encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return token[-6:] == digits


def luhn_ok(number: str) -> bool:
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def iban_ok(number: str) -> bool:
    s = number.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: Whether a match counts. A failing match is consumed all the same, as in a scan with the expression alone.
VALID = {
    "assign": lambda m: len(m[2]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "gh_token": lambda m: base62_crc_ok(m[0]),
    "npm_token": lambda m: base62_crc_ok(m[0]),
    "card": lambda m: luhn_ok(m[1]),
    "iban": lambda m: iban_ok(m[1]),
}


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, words in KEYWORDS.items():
        for w in words:
            kinds.setdefault(w, []).append(kind)
    for w, ks in kinds.items():
        a.add_word(w, (len(w), tuple(ks)))
    a.make_automaton()
    return a


def keyword_spans(text: str, lowered: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the valid matches at keyword hits; per kind leftmost and non-overlapping."""
    hits: dict[str, list[int]] = {}
    for end, (size, kinds) in _automaton().iter(lowered):
        for kind in kinds:
            hits.setdefault(kind, []).append(end - size + 1)
    out = []
    for kind, starts in hits.items():
        free = 0
        for start in sorted(starts):
            if start >= free and (m := PATTERNS[kind].match(text, start)):
                free = m.end()
                if VALID[kind](m):
                    out.append((start, kind, free))
    return out


def hex_runs(buf: np.ndarray, offsets: np.ndarray, least: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end (in the buffer) of each maximal run of lower-case hexadecimal digits of enough length."""
    inside = HEX[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = offsets[:-1] < offsets[1:]
        first[offsets[:-1][full]] = inside[offsets[:-1][full]]
        last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            buf, off = text_bytes(part.column("text"))
            data, low, bounds = buf.tobytes(), LOWER[buf].tobytes(), off.tolist()
            runs: dict[int, list[tuple[int, int]]] = {}
            for row, a, b in zip(*(x.tolist() for x in hex_runs(buf, off)), strict=True):
                runs.setdefault(row, []).append((a, b))
            rows = []
            for row, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                text = data[a:b].decode()
                spans = keyword_spans(text, low[a:b].decode())
                for s, e in runs.get(row, ()):
                    start = len(data[a:s].decode())
                    spans.append((start, "hex", start + e - s))
                base = [x for x in spans if x[1] in BASE_KINDS]
                rows.append((*(sum(x[1] == k for x in base) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points).

    A narrow pass without a shuffle. A null text counts as empty (no spans); ids may be null or repeated; extra
    columns are ignored; an empty table gives no rows. Very long texts are scanned whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_scan, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string").withColumnRenamed("id", id_col)
