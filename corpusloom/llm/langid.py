"""Language identification with string kernels.

The kernel of two texts is the blended spectrum presence kernel: how many distinct n-grams of 1 to 3 symbols they
share, divided by the root of the product of their own numbers. Symbols are UTF-8 bytes after folding ASCII and
Latin-1 capitals; runs of ASCII other than letters are one blank. Landmarks span a Nystroem approximation of the kernel, and
one ridge regression per language against the rest is fitted on it. As k(x, L) = X L' / norms, a batch is scored by the
product X (L' A): the landmark factor is multiplied out once, on the driver.

The targets of L languages sum to 2 - L in every row and the fit keeps that sum, so the best score of any text is at least
2 / L - 1. Texts of no known language are told by two tests, both calibrated on the sample with the row itself left out: a best
score nearer that floor than held-out rows have, and 3-grams that no landmark has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import slices, utf8

SAMPLE_PER_LANGUAGE = 300  # bound of the labelled sample that the model is fitted on
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 0.3
SAMPLE_CHARS = 20_000  # of a longer text of the sample a run of so many, from a place told by its hash
LANGUAGES = 256  # labels that are fitted: those with the most different texts
CALIBRATION = 0.02  # quantile of the held-out rows of a language
SCORE_SHARE = 0.5  # the least score lies so far from the floor to that quantile
UNKNOWN_SHARE = 0.1  # unknown 3-grams that are allowed at least, and
UNKNOWN_FREE = 16  # so many more (a name, a key), though not over half of a short text
SHORT = 20  # a text of fewer 3-grams tells too little for the score test
UNKNOWN = "und"
A = 155  # symbols: blank, 26 letters, 128 high bytes

_FOLD = np.zeros(256, np.int64)
_FOLD[97:123] = np.arange(1, 27)
_FOLD[65:91] = np.arange(1, 27)
_FOLD[128:256] = np.arange(27, 155)


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of all texts, with a blank before and after each one, and the text each belongs to."""
    n = len(offsets) - 1
    s = np.zeros(len(raw) + 2 * n, np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets) + 2)
    at = np.arange(len(raw)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1
    body = _FOLD[raw]
    if len(raw) > 1:
        capital = np.zeros(len(raw), bool)
        capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        body[capital] += 0x20
    s[at] = body
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (doc[1:] != doc[:-1])
    return s[keep], doc[keep]


def grams(s: np.ndarray, doc: np.ndarray):
    """(codes, text) of the 1-, 2- and 3-grams; codes of different lengths differ."""
    yield s, doc
    two = s[:-1] * A + s[1:]
    same = doc[:-1] == doc[1:]
    yield (two + A)[same], doc[1:][same]
    three = two[:-1] * A + s[2:]
    same = doc[:-2] == doc[2:]
    yield (three + A + A * A)[same], doc[2:][same]


N_CODES = A + A * A + A * A * A


def odd_grams(raw: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of 3-grams in each text, and of those that are odd by their code."""
    *_, (codes, doc) = grams(*symbols(raw, offsets))
    n = len(offsets) - 1
    return np.bincount(doc, minlength=n), np.bincount(doc[odd[codes]], minlength=n)


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray  # code -> column, the last column for a code that no landmark has
    weights: np.ndarray  # columns x languages, float32
    bias: np.ndarray
    least: float = -np.inf  # a lower best score is rejected
    unknown: float = 1.0  # share of 3-grams that may be unknown

    def presence(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        width = len(self.weights)
        x = np.zeros((len(offsets) - 1) * width, np.float32)
        for codes, doc in grams(*symbols(raw, offsets)):
            x[doc * width + self.columns[codes]] = 1
        x = x.reshape(-1, width)
        x[:, -1] = 0
        return x

    def rejected(self, raw: np.ndarray, offsets: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Which texts are of no known language, given their best scores."""
        n, odd = np.zeros(len(best)), np.zeros(len(best))
        for i, j in slices(offsets, 128, 1 << 20):
            n[i:j], odd[i:j] = odd_grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.columns == len(self.weights) - 1)
        share = self.unknown * n
        return (odd > np.minimum(share + UNKNOWN_FREE, np.maximum(n / 2, share))) | ((n >= SHORT) & (best < self.least))

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts x languages; a text without a known n-gram scores -inf."""
        if not self.languages:
            return np.full((len(offsets) - 1, 1), -np.inf, np.float32)
        out = np.empty((len(offsets) - 1, len(self.languages)), np.float32)
        for i, j in slices(offsets, 128, 1 << 20):
            x = self.presence(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            own = x[:, :-1].sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                y = (x @ self.weights) / np.sqrt(own)[:, None] + self.bias
            y[own <= 2] = -np.inf  # nothing but the blank
            out[i:j] = y
        return out


def fit(texts: list[str], langs: list[str]) -> Model:
    """Nystroem ridge regression, one language against the rest. Without texts the model rejects everything.

    The landmarks of a language are those of its texts with the lowest hashes.
    """
    order = sorted(range(len(texts)), key=lambda i: (langs[i], xxhash.xxh64_intdigest(texts[i]), texts[i]))
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(N_CODES, np.int32), np.zeros((1, 0), np.float32), np.zeros(0))
    raw, off = utf8(pa.array(texts, pa.string()))
    seen: dict[str, int] = {}
    marks = []
    for i, lang in enumerate(langs):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= LANDMARKS_PER_LANGUAGE:
            marks.append(i)
    codes = np.unique(np.concatenate([np.unique(c[np.isin(d, marks)]) for c, d in grams(*symbols(raw, off))]))
    columns = np.full(N_CODES, len(codes), np.int32)
    columns[codes] = np.arange(len(codes))
    blank = Model(names, columns, np.zeros((len(codes) + 1, 1), np.float32), np.zeros(1))
    x = blank.presence(raw, off)[:, :-1]
    shared = x[marks].sum(0) > 1
    x = x / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
    landmarks = x[marks]
    kmm = (landmarks @ landmarks.T).astype(np.float64)
    value, vector = np.linalg.eigh(kmm)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = (x @ landmarks.T).astype(np.float64) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    mean, ybar = z.mean(0), y.mean(0)
    zc = z - mean
    inverse = np.linalg.inv(zc.T @ zc + RIDGE * np.eye(z.shape[1]))
    w = inverse @ (zc.T @ (y - ybar))
    weights = np.vstack([landmarks.T.astype(np.float64) @ (root @ w), np.zeros((1, len(names)))])
    model = Model(names, columns, weights.astype(np.float32), ybar - mean @ w)
    # each row as the fit without it scores it, and its 3-grams that no other text among the landmarks has
    h = np.minimum(1 / len(y) + np.einsum("ij,jk,ik->i", zc, inverse, zc, optimize=True), 1 - 1e-6)[:, None]
    best = ((zc @ w + ybar - h * y) / (1 - h)).max(1)
    unseen = columns == len(codes)
    n, odd = odd_grams(raw, off, unseen)
    alone = unseen.copy()
    alone[codes] = ~shared
    odd[marks] = odd_grams(raw, off, alone)[1][marks]
    of = [[i for i, g in enumerate(langs) if g == name and n[i] >= SHORT] for name in names]
    if all(of):
        floor = 2 / len(names) - 1
        if len(names) > 1:
            model.least = floor + SCORE_SHARE * (min(np.quantile(best[i], CALIBRATION) for i in of) - floor)
        model.unknown = max(UNKNOWN_SHARE, 2 * max(np.quantile(odd[i] / n[i], 1 - CALIBRATION) for i in of))
    return model


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on at most per_language different texts of each value of lang: those that hash lowest.

    Rows without text or lang are left out; repeated rows count once, so copies crowd out no language; of texts over SAMPLE_CHARS a run is
    taken. Of more than LANGUAGES labels those with fewer texts are not fitted (of tied ones the later by name): the model, all of
    it at the driver, is bounded so. An empty table gives a model that rejects everything.
    """
    usable = docs.select("lang", "text").where("lang is not null and length(trim(text)) > 0").withColumn("h", F.xxhash64("text"))
    n = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not n:
        return fit([], [])
    # a hash limit that leaves few more texts than are wanted, so that only those are gathered
    share = {r["lang"]: min(1.0, 4.0 * per_language / r["n"] + 1e-9) for r in n}
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(min(int(v * 2.0**64) - 2**63, 2**63 - 1)))])
    near = usable.where(F.col("h") <= limit[F.col("lang")])
    over = F.length("text") - SAMPLE_CHARS
    near = near.withColumn("text", F.when(over > 0, F.substring(F.col("text"), (F.pmod("h", over) + 1).cast("int"), F.lit(SAMPLE_CHARS))).otherwise(F.col("text")))
    best = near.groupBy("lang").agg(F.slice(F.sort_array(F.collect_set(F.struct("h", "text"))), 1, per_language).alias("s"))
    rows = [(x["text"], r["lang"]) for r in best.collect() for x in r["s"]]
    return fit([t for t, _ in rows], [g for _, g in rows])


PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])


def predictor(spark: SparkSession, model: Model, min_score: float = -np.inf):
    """A column function: text -> (lang, score, margin to the second language)."""
    ship(spark)
    shared = spark.sparkContext.broadcast((model, min_score))

    def run(text: pa.Array) -> pa.Array:
        m, least = shared.value
        raw, off = utf8(text)
        y = m.scores(raw, off).astype(np.float64)
        top = y.argmax(1)
        best = y[np.arange(len(y)), top]
        second = np.partition(y, -2, axis=1)[:, -2] if y.shape[1] > 1 else np.full(len(y), -np.inf)
        ok = np.isfinite(best) & (best >= least)
        ok[ok] = ~m.rejected(raw, off, best)[ok]
        lang = pa.array([m.languages[t] if k else UNKNOWN for t, k in zip(top, ok)], pa.string())
        margin = np.where(np.isfinite(best) & np.isfinite(second), best - np.where(np.isfinite(second), second, 0), 0.0)
        score = pa.array(best, pa.float64(), mask=~np.isfinite(best))
        return pa.StructArray.from_arrays([lang, score, pa.array(margin, pa.float64())], ["lang", "score", "margin"])

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, PREDICTION)


def identify(docs: DataFrame, model: Model, min_score: float = -np.inf) -> DataFrame:
    """doc_id, predicted language, score and margin of every row.

    A null or empty text, and one without any letter that a landmark has, is "und" with a null score; a text of no
    trained language is "und" with the score it has; so is any whose score is under min_score, if that is given. Repeated rows
    are scored alike and all stay; whole texts are read whatever their length; of tied languages the first by name
    wins; other columns are ignored; an empty table gives an empty result.
    """
    f = predictor(docs.sparkSession, model, min_score)
    p = docs.select("doc_id", f(F.col("text")).alias("p"))
    return p.select("doc_id", F.col("p.lang").alias("pred_lang"), F.col("p.score").alias("score"), F.col("p.margin").alias("margin"))


def accepted(docs: DataFrame, model: Model, min_score: float = -np.inf) -> DataFrame:
    """The rows, with their columns as they were, whose language some classifier claims: those that identify doesn't call "und".

    Rows with a null or empty text, or without letters, go; repeated rows stay or go together; whole texts are read; an empty table stays empty.
    """
    f = predictor(docs.sparkSession, model, min_score)
    return docs.withColumn("__loom_lid", f(F.col("text"))).where(F.col("__loom_lid.lang") != UNKNOWN).drop("__loom_lid")
