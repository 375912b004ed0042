"""Language identification by hierarchical discrimination (operator 8).

A linear classifier (one linear support vector machine per family) predicts a
text's language family; one-versus-one linear support vector machines then
separate the languages within it, by votes.  Features are hashed byte trigrams
of the whole lower-cased text (white space runs and digits are one space),
as square roots of shares, of length one.

Families are those of FAMILIES (two-letter codes, fixed values); a language
without an entry is a family of its own.

Learning: a bounded sample of the labelled rows, about SAMPLE rows in all (never
over twice that) and an equal number for each language, by a hash of the id; null
languages and rows with crc32(doc_id as text) mod 4 = 2 never take part.  The
machines (squared hinge loss) are fitted on the driver from the sample's
features, SAMPLE x FEATURES numbers.

Defined results: a null text or one without a letter is `und` with score 1;
a text too short for a trigram is scored by the machines' constants; with no
language to learn every text is `und`; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import hash_share

FOLDS, HELD_OUT = 4, 2
FEATURES = 4096
SAMPLE = 4096
PENALTY = 1e-4
ROUNDS = 150
UNKNOWN = "und"
#: Families by two-letter code (fixed values).
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt rm ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "indo-aryan": "bn gu hi mr ne pa si ur".split(),
}
_GAP = re.compile(rb"[\x00-\x20\x30-\x39]+")


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes), lang)


def features(text: str) -> np.ndarray:
    """Shares of hashed byte trigrams of the whole text."""
    data = np.frombuffer(b" " + _GAP.sub(b" ", text.lower().encode()) + b" ", dtype=np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(FEATURES, dtype=np.float32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    v = np.sqrt(np.bincount(slot, minlength=FEATURES)).astype(np.float32)
    return v / np.float32(np.linalg.norm(v))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights (last: constant) of a linear machine with squared hinge loss; both classes weigh the same."""
    y = np.where(positive, 1.0, -1.0).astype(x.dtype)
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(x.dtype)
    w, v, t = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype), 1.0
    step = 1 / (4.0 + PENALTY)  # rows have length sqrt(2) with the constant
    for _ in range(ROUNDS):  # accelerated gradient steps
        slack = np.maximum(0, 1 - y * (x @ v))
        new = (v - step * (PENALTY * v - 2 * ((weight * y * slack) @ x))).astype(x.dtype)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = (new + (last - 1) / t * (new - w)).astype(x.dtype), new
    return w


class Model:
    """families: names, with one machine each (none if there is one family); pairs: machines by language pair."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        x = np.hstack((x, np.ones((len(x), 1), dtype=x.dtype)))
        lang = np.array(langs, dtype=object)
        self.langs = sorted(set(langs))
        self.family = {a: family_of(a) for a in self.langs}
        self.families = sorted(set(self.family.values()))
        fam = np.array([self.family[a] for a in langs], dtype=object)
        self.top = np.array([fit_svm(x, fam == f) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for i, a in enumerate(self.langs):
            for b in self.langs[i + 1:]:
                if self.family[a] == self.family[b]:
                    own = (lang == a) | (lang == b)
                    self.pairs[a, b] = fit_svm(x[own], lang[own] == a)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for text in texts:
            if not text or not self.langs or not has_letter(text):
                out.append((UNKNOWN, 1.0))
                continue
            x = np.append(features(text), 1.0)
            family, sure = self.families[0], 1.0
            if self.top is not None:
                m = self.top @ x
                best = int(np.argmax(m))
                family, sure = self.families[best], float(m[best] - np.max(np.delete(m, best)))
            members = [a for a in self.langs if self.family[a] == family]
            votes = dict.fromkeys(members, 0.0)
            margins = dict.fromkeys(members, 0.0)
            for (a, b), w in self.pairs.items():
                if a in votes:
                    m = float(w @ x)
                    votes[a if m >= 0 else b] += 1
                    margins[a] += m
                    margins[b] -= m
            lang = max(members, key=lambda a: (votes[a], margins[a]))
            if len(members) > 1:
                sure = min(sure, margins[lang] / (len(members) - 1)) if self.top is not None else margins[lang] / (len(members) - 1)
            out.append((lang, float(1 / (1 + np.exp(-np.clip(2 * sure, -30, 30))))))
        return out

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = self.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([a for a, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        rows = [(a, features(t).tobytes()) for a, t in zip(b.column("lang").to_pylist(), texts, strict=True) if has_letter(t)]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()),
                                          pa.array([x for _, x in rows], pa.binary())], names=["lang", "x"])


def train(docs: DataFrame) -> Model:
    ship_package(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                        & (fold() != HELD_OUT))
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows"))
    n = counts.count()
    if not n:
        return Model(np.zeros((0, FEATURES), np.float32), [])
    ids = usable.select("lang", "doc_id").join(counts, "lang").where(
        hash_share("doc_id") < max(1, SAMPLE // n) / F.col("rows")).select("lang", "doc_id").distinct().limit(2 * SAMPLE)
    # at most 2 * SAMPLE rows of an id and a code: a proven bound for the broadcast
    chosen = usable.select("lang", "doc_id", "text").join(F.broadcast(ids), ["lang", "doc_id"], "left_semi")
    rows = chosen.select("lang", "text").mapInArrow(_sample_features, "lang string, x binary").limit(2 * SAMPLE).toPandas()
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), FEATURES)
    return Model(x, rows["lang"].tolist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    ship_package(docs.sparkSession)
    p = docs.select("doc_id", "text").mapInArrow(model, "doc_id long, lang_pred string, score double")
    return p.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
