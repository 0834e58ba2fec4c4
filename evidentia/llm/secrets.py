"""Secret scan: patterns, and strings that a tokenizer's vocabulary compresses badly."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, encoding, per_document, prepare, tokenizer_path

KINDS = ("assign", "access", "hex", "dense")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run has 24 or none of its parts has
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
#: Hex digits of the usual digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: A UUID or a run of hex digits of one case, that letters and digits do not go on from; digests by their lengths.
KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])")
#: A part of an identifier: a word in one case or capitalised words, perhaps with a short number, or a number.
PART = re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]+)(?:[A-Z][a-z]+)*[0-9]{0,4}|[0-9]+")
#: The words of such a part.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What a stretch within a run must hold: letters and digits, so many without anything between, that are no number.
LONG = re.compile(r"(?=[A-Za-z0-9]{10})[0-9]*[A-Za-z][A-Za-z0-9]*")
#: Most characters a token of a random string.
RATIO = 2.0


def known(s: str, path: str, ratio: float = RATIO) -> bool:
    """A digest, a UUID, a number or an identifier: strings of this kind are no secrets by themselves.

    The shape of an identifier is not enough, as random letters have it too: the vocabulary must compress its words.
    """
    if UUID.fullmatch(s) or len(s) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return True
    parts = re.split(r"[+/_=-]+", s)
    if not all(map(PART.fullmatch, parts)):
        return False
    words = [w for x in parts for w in WORD.findall(x)]
    return not words or sum(map(len, words)) > ratio * sum(len(encoding(path).encode_ordinary(w)) for w in words)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans sorted by start, those that overlap or meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def outside(a: int, b: int, spans: list[tuple[int, int]], ends: list[int]) -> list[tuple[int, int]]:
    """The stretches of at least LEAST characters from a to b that no span touches; spans are disjoint and in order, ends are theirs."""
    left, i = [], bisect_right(ends, a)
    while i < len(spans) and spans[i][0] < b:
        if spans[i][0] - a >= LEAST:
            left.append((a, spans[i][0]))
        a, i = spans[i][1], i + 1
    return [*left, (a, b)] if b - a >= LEAST else left


@lru_cache(2)
def token_lengths(path: str) -> list[int]:
    """Bytes of each token of a vocabulary."""
    e = encoding(path)
    return [len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)]


def best_stretches(gains: list[float]) -> list[tuple[int, int]]:
    """All maximal stretches of greatest positive sum, in order: none can be made better by more or fewer numbers.

    One pass with a stack of stretches (begin, end, sum before, sum with it): a new one goes on from the last that has less before it, if that
    ends lower; those with as much before it can never go on and are set aside. Each is pushed and popped once.
    """
    active: list[tuple[int, int, float, float]] = []
    aside, total = [], 0.0
    for i, g in enumerate(gains):
        before, total = total, total + g
        if g <= 0:
            continue
        a, low = i, before
        while True:
            while active and active[-1][2] >= low:
                aside.append(active.pop()[:2])
            if not active or active[-1][3] >= total:
                break
            a, _, low, _ = active.pop()
        active.append((a, i + 1, low, total))
    out: list[tuple[int, int]] = []
    for a, b in sorted([*aside, *(x[:2] for x in active)], key=lambda x: (x[0], -x[1])):
        if not out or b > out[-1][1]:  # else it is part of one that went on over it
            out.append((a, b))
    return out


def dense(s: str, path: str, ratio: float) -> list[tuple[int, int]]:
    """Where a string of a run is random: all of it if it has few characters a token, else the stretches of its tokens that have.

    A stretch is one of greatest sum of ratio minus characters over its tokens, so words before or after a random string do not hide
    it; digests and UUIDs in the run part it. What is known by itself is not reported.
    """
    out = []
    for a, b in _between(s):
        part = s[a:b]
        ids = encoding(path).encode_ordinary(part)
        if b - a <= ratio * len(ids):
            if not known(part, path, ratio):
                out.append((a, b))
                continue
        lengths = token_lengths(path)
        sizes = [lengths[i] for i in ids]
        at = [a, *(a + x for x in accumulate(sizes))]
        for i, j in best_stretches([ratio - n for n in sizes]):
            i, j = _whole(s, at[i], at[j], a, b, path, ratio)
            if j - i >= LEAST and LONG.search(s[i:j]) and not known(s[i:j], path, ratio):
                out.append((i, j))
    return merged(out)


def _whole(s: str, i: int, j: int, a: int, b: int, path: str, ratio: float) -> tuple[int, int]:
    """The stretch from i to j with the letters and digits that go on from it within a to b, if it is still random with them: its ends may be a longer token each."""
    first, last = i, j
    while first > a and s[first - 1].isalnum():
        first -= 1
    while last < b and s[last].isalnum():
        last += 1
    return (first, last) if last - first <= ratio * len(encoding(path).encode_ordinary(s[first:last])) else (i, j)


def _between(s: str) -> list[tuple[int, int]]:
    """Stretches of at least LEAST characters of s without the digests and UUIDs in it."""
    at, out = 0, []
    for m in KNOWN.finditer(s):
        if m.end() - m.start() in DIGEST_LENGTHS or "-" in m[0]:
            out.append((at, m.start()))
            at = m.end()
    return [(a, b) for a, b in [*out, (at, len(s))] if b - a >= LEAST]


def find(text: str | None, path: str, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets of a text by start, then kind; code points, end exclusive."""
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = merged(sorted((a, b) for _, a, b in found))
    ends = [b for _, b in base]
    for m in CANDIDATE.finditer(text):
        for a, b in outside(*m.span(), base, ends):
            found += [("dense", a + i, a + j) for i, j in dense(text[a:b], path, ratio)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """Secrets of every whole text: id, n_assign, n_access, n_hex, base_sha256, spans, n_dense.

    A narrow map without a shuffle, so neither hot keys nor lost executors need care; its time grows with a text's length and
    its spans, not with their product. Null and empty texts have no spans; repeated rows give repeated results; an empty table
    gives an empty one; other columns are not read.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken")

    def work(texts):
        rows = [find(t, path, ratio) for t in texts]
        count = lambda kind: [sum(s[0] == kind for s in r) for r in rows]
        base = [joined([s for s in r if s[0] != "dense"]) for r in rows]
        return count("assign"), count("access"), count("hex"), [hashlib.sha256(b.encode()).hexdigest() for b in base], [joined(r) for r in rows], count("dense")

    return per_document(df, id_col, text_col, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_dense long", work)


def redacted(text: Column, vocabulary: str | None = None, ratio: float = RATIO, mark: str = "<SECRET>") -> Column:
    """The text with each secret (overlapping ones as one) replaced by mark; null stays null, repeated rows are each treated, whole texts of any length."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken")

    def redact(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else _replaced(t, find(t, path, ratio), mark))

    prepare(SparkSession.active())
    return F.pandas_udf(redact, "string")(text)


def _replaced(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at, end = [], 0, 0
    for _, a, b in spans:
        if a >= end:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
