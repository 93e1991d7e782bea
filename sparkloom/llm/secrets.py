"""Secret scan: fixed patterns, plus sliding-window Shannon entropy per character class with an allow-list.

Candidate strings are maximal runs of token characters.  A window slides over a candidate once per character class and
character counts are kept by adding the character that enters and taking off the one that leaves, so each step costs the
same; windows that lie in the class and whose entropy passes its threshold are joined to spans, and a candidate with one is
reported whole, as a secret is not to be cut.  The allow-list is about whole candidates: only one whose every part between separators is
a plain word, a listed placeholder or a number, or a UUID as a whole, or one that reads as a name (words that can be spoken, of three and a half letters or more on
the average, cut where case changes, and few digits: a path, a class), is suppressed; a random string never is for the letters it
happens to hold (of 16 random letters and digits one in 600 reads as a name, of 32 one in 10,000).  Spans of the patterns always stay.

Defined cases: a null or empty text has no spans; a very long text is scanned whole; overlapping kinds are all listed, at one start in
the order of KINDS; an entropy span within a pattern's span is not listed again; repeated rows give a row each; an empty table
gives no rows; extra columns, also of the names used here, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_value, small_batches

by_value(__name__)

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Character class: name, characters, window, bits, and what a candidate must hold for the class to be asked.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 24, 3.0, re.compile(r"(?=.*[0-9])(?=.*[a-fA-F])")),
    ("base32", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16, 3.4, re.compile(r"(?=.*[0-9])(?=.*[A-Z])")),
    ("base62", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 16, 3.5, re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])")),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.6, re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")),
)
#: Candidates that are no secrets: words (of one case or with a capital) and numbers joined by separators, and UUIDs.
ALLOW = (
    re.compile(r"[-_/=+]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[a-z]+[0-9]{1,2}|v[0-9]+)(?:[-_/=+]+|\Z))+"),
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
)


#: Words (a capital that no small letter follows is one) and numbers of a name, and the letters that its words have on the average and share of digits it may have.
NAME_PART, NAME_LETTERS, NAME_DIGITS = re.compile(r"[A-Z]?[a-z]+|[A-Z]|[0-9]+"), 3.5, 0.1


def reads_as_name(run: str) -> bool:
    """Whether a candidate is made of words that can be spoken, as names of classes and paths are: those of three letters or more have a vowel."""
    parts = NAME_PART.findall(run)
    words = [p for p in parts if not p.isdigit()]
    letters = sum(map(len, words))
    spoken = all(len(w) < 3 or not set("aeiouyAEIOUY").isdisjoint(w) for w in words if w != "src")
    return bool(words) and letters >= NAME_LETTERS * len(words) and sum(map(len, parts)) - letters <= NAME_DIGITS * len(run) and spoken


def _dense(text: str, alphabet: frozenset, width: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of ``width`` characters, all in the alphabet, with entropy of ``bits`` or more."""
    gain = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]  # entropy = log2(width) - sum(gain[count]) / width
    limit = (math.log2(width) - bits) * width
    counts: dict[str, int] = {}
    total, outside, spans = 0.0, 0, []
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += gain[c + 1] - gain[c]
        outside += ch not in alphabet
        if i >= width:
            old = text[i - width]
            c = counts[old]
            counts[old] = c - 1
            total -= gain[c] - gain[c - 1]
            outside -= old not in alphabet
        if i >= width - 1 and not outside and total <= limit + 1e-9:
            if spans and spans[-1][1] >= i - width + 1:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - width + 1, i + 1))
    return spans


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Candidates with a window dense enough for a character class that they may be of, unless allow-listed."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if any(a.fullmatch(run) for a in ALLOW) or reads_as_name(run):
            continue
        if any(holds.match(run) and _dense(run, alphabet, width, bits) for _, alphabet, width, bits, holds in CLASSES):
            found.append(m.span())
    return found


def base_spans(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    assign = [m.span() for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    return assign, [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else [], [m.span() for m in HEX.finditer(text)]


def scan_text(text: str | None) -> tuple:
    text = text or ""
    kinds = base_spans(text)
    base = sorted((a, k, b) for k, spans in enumerate(kinds) for a, b in spans)
    more = [(a, 3, b) for a, b in entropy_spans(text) if not any(x <= a and b <= y for x, _, y in base)]
    listed = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return *map(len, kinds), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more))


def scan(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        for b in batches:
            rows = [scan_text(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
