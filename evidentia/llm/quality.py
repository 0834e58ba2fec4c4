"""Quality rules, and a linear-chain conditional random field that marks lines as content or boilerplate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, least_hashes, mix64, per_document, word_codes, word_hashes

#: Most labelled documents, and most lines of one, that the model is fitted on: the documented bounds of the sample.
SAMPLE, SAMPLE_LINES = 1500, 400
#: Least share of a document's words in lines marked as content.
CONTENT_SHARE = 0.5
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
FEATURES = 12

_CLASS = np.zeros(256, np.uint8)  # bits: 1 space, 2 upper, 4 other letter, 8 digit, 16 symbol, 32 !, 64 |, 128 continuation byte
_CLASS[[9, 10, 11, 12, 13, 32]] |= 1
_CLASS[65:91] |= 2
_CLASS[97:123] |= 4
_CLASS[0xC0:] |= 4
_CLASS[48:58] |= 8
_CLASS[list(SYMBOLS)] |= 16
_CLASS[ord("!")] |= 32
_CLASS[ord("|")] |= 64
_CLASS[0x80:0xC0] |= 128


class Lines:
    """Base counts of a slice of texts and features of all their lines."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() + b"\n" for t in texts]
        text = np.frombuffer(b"".join(raw), np.uint8)
        kind = _CLASS[text]
        ends = np.flatnonzero(text == 10)
        start = np.concatenate(([0], ends[:-1] + 1))
        bounds = np.cumsum([len(r) for r in raw])
        self.doc = np.searchsorted(bounds, start, "right")
        self.per_doc = np.bincount(self.doc, minlength=len(texts))
        total = lambda x: np.add.reduceat(x, start, dtype=np.int64)
        has = lambda bit: total((kind & bit) > 0)
        space = (kind & 1) > 0
        begins = ~space & np.concatenate(([True], space[:-1]))
        words = total(begins)
        chars = total((kind & 129) == 0)
        symbols, upper, letters, digits, bangs, pipes = has(16), has(2), has(6), has(8), has(32), has(64)
        by_doc = lambda x: np.bincount(self.doc, x, len(texts)).astype(np.int64)
        self.words, self.n_words, self.word_chars, self.n_symbols = words, by_doc(words), by_doc(chars), by_doc(symbols)
        again = np.zeros(len(start), bool)
        at = 0
        for t, n in zip(texts, self.per_doc.tolist(), strict=True):
            seen: set[str] = set()
            for i, line in enumerate(t.split("\n"), at):
                if line in seen:
                    again[i] = words[i] > 0
                seen.add(line)
            at += n
        self.n_dup_lines = by_doc(again)
        codes, distinct = word_codes(b"".join(raw).split())
        same = np.concatenate(([0], (codes[1:] == codes[:-1]).astype(np.int64))) if len(codes) else np.zeros(0, np.int64)
        line = np.repeat(np.arange(len(start)), words)
        if len(line):
            same[1:] *= line[1:] == line[:-1]
        stuck = np.bincount(line, same, len(start))
        self.n_repeat_words = repeated_words(word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64), self.n_words)
        w, c = np.maximum(words, 1), np.maximum(chars, 1)
        self.features = np.stack(
            [
                np.ones(len(start)), np.minimum(1, words / 20), np.minimum(1, 5 * symbols / c), upper / np.maximum(letters, 1), digits / c, np.minimum(1, bangs / w),
                np.minimum(1, 2 * pipes / w), np.minimum(1, stuck / w), np.minimum(2, chars / w / 10), again, words == 0, words < 5,
            ], 1,
        ).astype(np.float32)


def repeated_words(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text, its words in windows of WINDOW words that the text has twice or more. h: hashes of all texts' words."""
    doc = np.repeat(np.arange(len(n)), n)
    if len(h) < WINDOW:
        return np.zeros(len(n), np.int64)
    m = len(h) - WINDOW + 1
    key = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    key = mix64(key[inside] + doc[inside].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, inside[twice], 1)
    np.add.at(mark, inside[twice] + WINDOW, -1)
    return np.bincount(doc, np.cumsum(mark)[:-1] > 0, len(n)).astype(np.int64)


class Crf:
    """Two labels, 0 boilerplate and 1 content: emission weights, transition weights, start weights."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The labels of greatest joint score, content on ties; scores: those of the lines of one text."""
        a, b = (self.start + scores[0]).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        for x, y in scores[1:].tolist():
            p, q, r, s = a + m00, b + m10, a + m01, b + m11
            back.append((q >= p, s >= r))
            a, b = x + max(p, q), y + max(r, s)
        label, out = b >= a, [b >= a]
        for zero, one in reversed(back):
            label = one if label else zero
            out.append(label)
        return np.array(out[::-1], bool)

    def content_words(self, lines: Lines) -> np.ndarray:
        """For each text, its words in lines marked as content."""
        scores = lines.features.astype(np.float64) @ self.emit
        marked = np.concatenate([self.viterbi(s) for s in np.split(scores, np.cumsum(lines.per_doc)[:-1])])
        return np.bincount(lines.doc, lines.words * marked, len(lines.per_doc))


def _grouped(sequences: list[np.ndarray], labels: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences padded to the longest of those of about their length: features, mask, labels of lines (given for each, or one for all), weights that balance those of one label only."""
    labels = [np.broadcast_to(y, len(s)) for s, y in zip(sequences, labels, strict=True)]
    pure = np.array([y.max() == y.min() for y in labels])
    size = np.array([max(1, sum(p and y[0] == k for p, y in zip(pure, labels, strict=True))) for k in (0, 1)])
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        groups.setdefault((len(s) - 1).bit_length(), []).append(i)
    out = []
    for rows in groups.values():
        longest = max(len(sequences[i]) for i in rows)
        x, mask = np.zeros((len(rows), longest, FEATURES)), np.zeros((len(rows), longest), bool)
        for k, i in enumerate(rows):
            x[k, : len(sequences[i])], mask[k, : len(sequences[i])] = sequences[i], True
        y = np.zeros((len(rows), longest, 2))
        for k, i in enumerate(rows):
            y[k, np.arange(len(labels[i])), labels[i]] = 1
        out.append((x, mask, y, np.array([pure.sum() / (2 * size[labels[i][0]]) if pure[i] else 1.0 for i in rows])))
    return out


def likelihood(groups, params: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """Weighted log-likelihood of the lines' labels and its gradient, by forward-backward over all sequences of a group at once."""
    emit, move, start = params
    total, grads = 0.0, [np.zeros_like(p) for p in params]
    for x, mask, y, weight in groups:
        n, longest = mask.shape
        e = x @ emit
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(forward[:, t - 1, :1] + move[0], forward[:, t - 1, 1:] + move[1]) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            ahead = e[:, t + 1] + backward[:, t + 1]
            new = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        p = np.exp(forward + backward - z[:, None, None]) * mask[:, :, None]
        both = forward[:, :-1, :, None] + move + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        both = np.where(mask[:, 1:, None, None], np.exp(np.minimum(both, 0)), 0)
        pair = np.einsum("n,nta,ntb->ab", weight, y[:, :-1], y[:, 1:])
        total += float((weight * ((y * e).sum((1, 2)) + (y[:, 0] * start).sum(1) - z)).sum() + (pair * move).sum())
        d = (y - p) * weight[:, None, None]
        for g, more in zip(grads, (np.einsum("ntf,ntl->fl", x, d), pair - np.einsum("n,ntab->ab", weight, both), d[:, 0].sum(0)), strict=True):
            g += more
    return total, grads


def fit(sequences: list[np.ndarray], labels: list, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam."""
    groups, n = _grouped(sequences, labels), len(sequences)
    params = [np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        _, grads = likelihood(groups, params)
        for k, (g, p) in enumerate(zip(grads, params, strict=True)):
            g = g / n - decay * p
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = p + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Crf(*params)


def _features(texts: list[str]):
    lines = Lines(texts)
    return [s.tobytes() for s in np.split(lines.features, np.cumsum(lines.per_doc)[:-1])], lines.per_doc.tolist()


def joined(sequences: list[np.ndarray], labels: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sequences with their lines' labels, and each of the one label followed by one of the other, in turns: where labels change is learned from these."""
    parts = [[s for s, q in zip(sequences, labels, strict=True) if q == k] for k in (0, 1)]
    out = [(s, np.full(len(s), q)) for s, q in zip(sequences, labels, strict=True)]
    for i in range(max(map(len, parts))):
        order = (0, 1) if i % 2 else (1, 0)
        both = [parts[k][i % len(parts[k])] for k in order]
        out.append((np.concatenate(both), np.repeat(order, [len(x) for x in both])))
    return [s for s, _ in out], [y for _, y in out]


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Crf | None:
    """Fits the model on a bounded sample of labelled documents: their lines have their label, and pairs of a good and a bad one are sequences whose label changes (joined).

    The sample is the documents of each label with the least hashes of their ids, half of it of each if there are enough. Documents of more than SAMPLE_LINES lines
    are not learned from, so the model knows long documents only by lines like those of shorter ones. None if one label is missing.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    picked = least_hashes(known, "quality", "doc_id", counts, sample // 2, "crf")
    if not picked.limit(1).count():
        raise RuntimeError("there are labels, but none was sampled")
    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    got = per_document(texts, "quality", "text", "x binary, n long", _features).where(F.col("n") <= SAMPLE_LINES).limit(2 * sample).collect()
    if len({r["quality"] for r in got}) < 2:
        return None
    got.sort(key=lambda r: (bytes(r["x"]), r["quality"]))
    return fit(*joined([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got], [r["quality"] for r in got]))


def judge_quality(df: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """Base counts and verdict for every whole text: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    kept: the base rules hold, and at least the given share of the words is in lines that Viterbi decoding marks as content.
    Without a model every line is content. Null and empty texts have no words and fail; rows may repeat; an empty table gives
    an empty one; other columns are not read. A narrow map; the broadcast model has a fixed size.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        lines = Lines(texts)
        failed = (lines.n_words < 20) | (100 * lines.n_repeat_words > 30 * lines.n_words)
        content = shared.value.content_words(lines) if shared.value else lines.n_words
        part = content / np.maximum(1, lines.n_words)
        return lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, failed, ~failed & (part >= share), part

    return per_document(df, id_col, text_col, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double", work)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
