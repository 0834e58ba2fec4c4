"""Language identification: first the family, then one-versus-one linear SVMs among its languages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, least_hashes, per_document, remainder, segment_sums

#: Family of a language code; a label that is not here is a family of its own.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic", "af": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "be": "slavic", "bg": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "hr": "slavic", "sr": "slavic", "sl": "slavic",
    "zh": "cjk", "ja": "cjk", "ko": "cjk",
}
#: Hashed features: byte trigrams of the lower-cased text.
DIM = 1 << 12
#: Most training documents, over all languages: the documented bound of the sample.
SAMPLE = 2000
SCALE = 30.0


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature index of every trigram of the texts, and their number for each text."""
    raw = [b"  " + t.lower().encode() + b" " for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    n = np.array([len(x) for x in raw], np.int64)
    code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
    keep = np.ones(len(b), bool)
    ends = np.cumsum(n)
    keep[ends - 1] = keep[ends - 2] = False
    return (code >> np.uint32(32 - 12)).astype(np.int64)[keep[:-2]], n - 2


def frequencies(text: str) -> np.ndarray:
    idx, n = features([text])
    return (np.bincount(idx, minlength=DIM) * (SCALE / max(1, n[0]))).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 0.5 / c
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / q[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


@dataclass
class Model:
    """families: one-versus-rest weights for each; pairs: within each family, weights of (a, b), positive for a."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    rest: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[str, str, np.ndarray]] = field(default_factory=list)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score: the share of its family times its own share within the family."""
        lang, sure, share = self.decide(texts)
        return lang, [min(1.0, max(0.0, a * b)) for a, b in zip(sure, share, strict=True)]

    def decide(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, share of its family, and share within the family."""
        if not self.families:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        columns = [*self.rest, *(w for *_, w in self.pairs)]
        if columns:
            w = np.stack(columns, 1)
            idx, n = features(texts)
            margins = segment_sums(w[:-1].astype(np.float32)[idx], n) * (SCALE / np.maximum(1, n))[:, None] + w[-1]
        else:
            margins = np.zeros((len(texts), 0))
        p = 1 / (1 + np.exp(-2 * margins))
        lang, families, shares = [], [], []
        for i, t in enumerate(texts):
            if not has_letter(t):
                lang.append("und")
                families.append(0.0)
                shares.append(0.0)
                continue
            fam, sure = self.families[0], 1.0
            if self.rest:
                each = p[i, : len(self.rest)]
                fam, sure = self.families[int(each.argmax())], float(each.max() / max(each.sum(), 1e-9))
            langs = self.members[fam]
            votes, belief = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
            for k, (a, b, _) in enumerate(self.pairs, len(self.rest)):
                if a in votes and b in votes:
                    votes[a if margins[i, k] >= 0 else b] += 1
                    belief[a] += p[i, k]
                    belief[b] += 1 - p[i, k]
            best = max(langs, key=lambda x: (votes[x], belief[x], [-ord(c) for c in x]))
            share = belief[best] / sum(belief.values()) if len(langs) > 1 else 1.0
            lang.append(best)
            families.append(float(sure))
            shares.append(float(share))
        return lang, families, shares


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def fit(x: np.ndarray, labels: list[str]) -> Model:
    langs = sorted(set(labels))
    y = np.array(labels)
    model = Model()
    for lang in langs:
        model.members.setdefault(FAMILY.get(lang, lang), []).append(lang)
    model.families = sorted(model.members)
    if len(model.families) > 1:
        fam = np.array([FAMILY.get(s, s) for s in labels])
        model.rest = [svm(x, np.where(fam == f, 1.0, -1.0)) for f in model.families]
    for f in model.families:
        for a, b in combinations(model.members[f], 2):
            part = (y == a) | (y == b)
            model.pairs.append((a, b, svm(x[part], np.where(y[part] == a, 1.0, -1.0))))
    return model


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from a bounded sample of the labelled rows that are not held out, about as many of each language.

    The sample is the rows of each language with the least hashes of their ids, as many of each, so it is the same in every run and full at any size;
    at most sample rows, as vectors of fixed length, come to the driver. Of more languages than sample, those with the fewest
    documents are not learned. An empty table, or one without languages, gives an empty model; null texts are not learned from.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null and text is not null").where(remainder(F.col("id"), 5) != 0)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return Model()
    picked = least_hashes(rows, "lang", "id", counts, max(1, sample // len(counts)), "langid")
    got = per_document(picked, "lang", "text", "x binary, ok boolean", lambda texts: ([frequencies(t).tobytes() for t in texts], [has_letter(t) for t in texts])).limit(sample).collect()
    if not got:
        raise RuntimeError("there are languages, but none was sampled")
    got = [r for r in got if r["ok"]]
    if not got:
        return Model()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return fit(np.stack([np.frombuffer(r["x"], np.float32) for r in got]), [r["lang"] for r in got])


def identify_language(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every whole text: id, held_out, lang_pred, score (0 to 1).

    Only the text is used for a prediction. Null texts and texts without a letter are 'und' with score 0, as is everything
    if there is nothing to learn from; ids may repeat or be null (null: not held out, not learned from); ties go to the
    smaller label. Texts of any length are read whole; an empty table gives an empty one; other columns are not read, whatever
    their names. A narrow map; the broadcast model has a fixed size.
    """
    model = model or train(df, id_col, text_col, lang_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = per_document(df, id_col, text_col, "lang_pred string, score double", lambda texts: shared.value.predict(texts))
    held = F.coalesce(remainder(F.col(f"`{id_col}`"), 5) == 0, F.lit(False))
    return out.select(F.col(f"`{id_col}`"), held.alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(documents(spark, sf_dir))
