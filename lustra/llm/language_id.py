"""Language identification in two steps: a family, then one-versus-one linear support vector
machines among the languages of that family.

Features are hashed byte n-grams (1 to 3 bytes) of the whole lower-cased text, damped by a square
root and scaled to unit length.  Machines are trained on a bounded sample: of each language at most
``per_language`` documents, spread over the table by a hash of the id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Families of languages, by ISO 639-1 code.  Any other code is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "uralic": ["et", "fi", "hu"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = re.compile(r"[^\W\d_]")
DIMS = 4096


def _features(texts: list[bytes], dims: int = DIMS) -> np.ndarray:
    """One row of unit length per text."""
    out = np.zeros((len(texts), dims), dtype=np.float32)
    mask = np.uint32(dims - 1)
    for row, data in enumerate(texts):
        for at in range(0, len(data), 1 << 20):
            x = np.frombuffer(data, dtype=np.uint8)[at : at + (1 << 20) + 2].astype(np.uint32)
            h = [x]
            if len(x) > 1:
                h.append(x[1:] * np.uint32(31) + x[:-1] * np.uint32(7919) + np.uint32(257))
            if len(x) > 2:
                h.append(x[2:] * np.uint32(961) + x[1:-1] * np.uint32(104729) + x[:-2] * np.uint32(1299709) + np.uint32(65537))
            h = np.concatenate(h) * np.uint32(2654435761)
            out[row] += np.bincount((h >> np.uint32(12)) & mask, minlength=dims)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def _svm(x: np.ndarray, y: np.ndarray, weight: float = 20.0, steps: int = 300) -> np.ndarray:
    """Linear machine with squared hinge loss, by accelerated gradient descent; bias last."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)]).astype(np.float64)
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1])
    z, t = w.copy(), 1.0
    rate = 1.0 / (1.0 / weight + 2 * 2.0)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        grad = z / weight - 2 * (x.T @ (cost * y * slack))
        new = z - rate * grad
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


class Model:
    """Machines for families and, in each family, for each pair of languages."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.families: dict[str, list[str]] = {}
        for code in languages:
            self.families.setdefault(_FAMILY_OF.get(code, code), []).append(code)
        family = np.array([_FAMILY_OF.get(languages[k], languages[k]) for k in y])
        label = np.array([languages[k] for k in y])
        self.between = self._pairs(sorted(self.families), x, family)
        self.within = {f: self._pairs(codes, x, label) for f, codes in self.families.items()}

    @staticmethod
    def _pairs(names: list[str], x: np.ndarray, label: np.ndarray) -> tuple[list[str], dict]:
        machines = {}
        for a, b in combinations(range(len(names)), 2):
            rows = (label == names[a]) | (label == names[b])
            machines[a, b] = _svm(x[rows], np.where(label[rows] == names[a], 1.0, -1.0)).astype(np.float32)
        return names, machines

    @staticmethod
    def _vote(names: list[str], machines: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner and its weakest probability against any other."""
        votes = np.zeros((len(x), len(names)))
        worst = np.ones((len(x), len(names)))
        for (a, b), w in machines.items():
            p = 1 / (1 + np.exp(-np.clip(3 * (x @ w[:-1] + w[-1]), -30, 30)))
            votes[:, a] += p > 0.5
            votes[:, b] += p <= 0.5
            worst[:, a] = np.minimum(worst[:, a], p)
            worst[:, b] = np.minimum(worst[:, b], 1 - p)
        best = np.argmax(votes + worst / 2, axis=1)
        return best, worst[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        families, machines = self.between
        best, score = self._vote(families, machines, x)
        out = np.empty(len(x), dtype=object)
        for k, family in enumerate(families):
            rows = np.flatnonzero(best == k)
            if len(rows):
                names, machines = self.within[family]
                lang, sure = self._vote(names, machines, x[rows])
                out[rows] = np.array(names, dtype=object)[lang]
                score[rows] *= sure
        return out.tolist(), score


def _lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for at in range(0, len(texts), 64):
            x = _features([_lowered(t) for t in texts[at : at + 64].to_pylist()])
            yield pa.RecordBatch.from_arrays([langs[at : at + 64], pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 256, languages: int = 64) -> Model | None:
    """Fit on rows with an id, a text and a language; None if there are none.

    Each language's ids fall into ``per_language`` hash slots and the least hash in each is taken,
    with partial aggregation.  Of all labels the ``languages`` most frequent ones (ties by code) are
    learned.  So the sample, and all that the driver gets, is bounded by ``per_language`` vectors of
    16 KB for each of ``languages`` labels, 268 MB by default, however many rows and labels there are.
    Rows without id, text or language are not learned from; repeated rows count once.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter("i is not null and t is not null and lang is not null and length(t) > 0")
    hashed = F.xxhash64(F.col("i").cast("string"), F.lit(11))
    # Bounded by `languages` rows.
    learned = rows.groupBy("lang").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "lang").limit(languages).select("lang")
    rows = rows.join(F.broadcast(learned), "lang")
    picks = rows.groupBy("lang", F.pmod(hashed, F.lit(per_language)).alias("slot")).agg(F.min(F.struct(hashed.alias("h"), "i")).alias("pick"))
    picked = rows.join(F.broadcast(picks.select(F.col("pick.i").alias("i"))), "i", "left_semi").groupBy("lang", "i").agg(F.min("t").alias("t"))
    got = picked.select("lang", "t").mapInArrow(_vectors, "lang string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    names = sorted({r["lang"] for r in got})
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got])
    return Model(names, x, np.array([names.index(r["lang"]) for r in got]))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("_text")
            langs: list[str] = []
            scores: list[float] = []
            for at in range(0, len(texts), 128):
                part = texts[at : at + 128].to_pylist()
                if model is None:
                    langs += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                lang, score = model.predict(_features([_lowered(t) for t in part]))
                for t, a, s in zip(part, lang, score.tolist()):
                    has = bool(t) and _LETTER.search(t) is not None
                    langs.append(a if has else "und")
                    scores.append(min(1.0, max(0.0, s)) if has else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["_rest", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (0 to 1: the product of the weakest family and language
    probabilities) to the columns ``keep`` (default: all).  Only the text is an input.

    Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is
    everything if there was nothing to learn from; repeated rows get equal answers; an empty table
    stays empty.  Columns named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_rest"), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([rows.schema["_rest"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), schema)
    return out.select(*[F.col(f"_rest.`{c}`").alias(c) for c in keep], "lang_pred", "score")
