"""Secret scans: three fixed patterns, and a token-efficiency test that exposes random strings.

A string that a vocabulary learnt from prose cuts into very short tokens is random: words yield
three characters a token and more, keys and hashes below two. Strings without digits take a stricter
ratio, since rare words come near two: it passes nearly all keys of mixed case, but only most of
those in a single case. Strings without letters are numbers and stay out. Prose before or behind a
key dilutes its ratio, so a run that passes as a whole is one find, and else its stretches of dense
parts, between / = _ and -, are tested on their own. The scan runs inside Spark's tasks, batch by
batch; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", re.A | re.I)
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Random strings of this length and more are looked for, at most so many characters a token.
MIN_RANDOM = 16
MAX_RATIO = 2.0
#: For strings without digits, and the least share of letters and digits in these and in stretches of parts.
MAX_LETTERS_RATIO = 1.8
MIN_SOLID = 0.8

#: Strings that look random but are no secrets: digests by their length, and identifiers.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
TIMESTAMP = r"\d{4}-\d\d-\d\d[T_-]?\d{0,9}(?:Z|[+-]\d{2,4})?"
IDENTIFIER = re.compile(rf"{UUID}|[0-9+/_=.-]+|{TIMESTAMP}(?:[/_-]{TIMESTAMP})?")
PART = re.compile(rf"({UUID})(?![A-Za-z0-9+])|[A-Za-z0-9+]+")


def assignments(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping name, sign and value; those with values below 6 characters drop out, but use up their text."""
    if ":" not in text and "=" not in text:
        return
    at = 0
    while head := ASSIGN.search(text, at):
        # The optional quote may have been taken greedily; the value then follows it, or there is no match.
        if value := VALUE.match(text, head.end()):
            if value.end() - value.start() >= 6:
                yield head.start(), value.end()
            at = value.end()
        else:
            at = head.start() + 1


def is_solid(string: str) -> bool:
    return sum(map(str.isalnum, string)) >= MIN_SOLID * len(string)


def is_digest(string: str) -> bool:
    return len(string) in DIGEST_LENGTHS and DIGEST.fullmatch(string) is not None


def is_random(string: str, tokens: int) -> bool:
    if any(map(str.isdigit, string)):
        dense = len(string) <= MAX_RATIO * tokens
    else:
        dense = len(string) <= MAX_LETTERS_RATIO * tokens and is_solid(string)
    return dense and not is_digest(string) and not IDENTIFIER.fullmatch(string)


def stretches(run: str, count_tokens) -> Iterator[list[tuple[int, int]]]:
    """Neighbouring parts of a run that are dense by themselves, as (start, end) in the run; digests and UUIDs part them."""
    held: list[tuple[int, int]] = []
    for m in PART.finditer(run):
        if not m[1] and not is_digest(m[0]) and len(m[0]) <= MAX_RATIO * count_tokens(m[0]):
            held.append(m.span())
        elif held:
            yield held
            held = []
    if held:
        yield held


class Taken:
    """What spans cover, as ascending stretches that don't meet, so that an overlap is found by bisection."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for start, _, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def random_spans(text: str, start: int, end: int, taken: Taken, count_tokens) -> Iterator[tuple[int, int]]:
    """Random strings in the run text[start:end] that `taken` doesn't meet: the run, else stretches of its parts, else parts."""

    def tells(a: int, b: int) -> bool:
        return b - a >= MIN_RANDOM and not taken.meets(a, b) and is_random(text[a:b], count_tokens(text[a:b]))

    if tells(start, end):
        yield start, end
        return
    for parts in stretches(text[start:end], count_tokens):
        a, b = start + parts[0][0], start + parts[-1][1]
        if is_solid(text[a:b]) and tells(a, b):
            yield a, b
        elif len(parts) > 1:
            yield from ((start + c, start + d) for c, d in parts if tells(start + c, start + d))


def scan(text: str, count_tokens) -> list[tuple[int, int, int]]:
    """All spans as (start, kind's place in KINDS, end), in that order; code points, end exclusive."""
    found = [(a, 0, b) for a, b in assignments(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken = Taken(found)
    for m in CANDIDATE.finditer(text):
        found += [(a, 3, b) for a, b in random_spans(text, m.start(), m.end(), taken, count_tokens)]
    return sorted(found)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def token_counter(vocabulary: str, pattern: str):
    """Counts a string's tokens under a tiktoken vocabulary file."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda string: len(encoding.encode_ordinary(string))


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    base_sha256 covers the three patterns; spans adds `random` where the token-efficiency test
    finds a string, or a part of one, that no pattern overlaps. Null and empty texts give zero counts and empty
    spans; repeated rows are scanned alike; null ids pass through. Other columns are not read. A text is
    scanned whole, in time in proportion to its length and, for overlaps, its findings times their logarithm.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None

        def count(string: str) -> int:
            nonlocal counter
            counter = counter or token_counter(vocabulary, pattern)
            return counter(string)

        for batch in rows:
            found = []
            for text in batch.column("text").to_pylist():
                spans = scan(text or "", count)
                base = [s for s in spans if s[1] < 3]
                found.append((*(sum(s[1] == kind for s in base) for kind in range(3)), hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(spans)))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(batches, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
