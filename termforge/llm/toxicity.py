"""Toxicity by compression distance: the dictionary under which a text's windows compress shorter.

Training (on the driver, from a bounded sample of labelled texts). Two zstandard dictionaries
are trained, one on toxic and one on ordinary windows. Toxic texts are ordinary text but for a
few phrases, so dictionaries of all their windows differ by chance more than by
toxicity. Each class's own dictionary is therefore trained on the windows that tell it best: of
two halves of a class's texts, the windows of one half are ranked by how much shorter they compress
under the dictionaries trained on the other half, and the first MINED of them train the next
dictionary of their half, ROUNDS times over. A window ranks high only by content that the other
half's texts hold too. To either class's dictionary is joined one large dictionary trained on ordinary
windows, so that ordinary content costs the same under both.

Scoring. A whole text, lower-cased, is cut into windows of about 96 bytes at spaces. Each
window gives the difference of its compressed lengths, ordinary minus toxic. The greatest difference, the mean
of the three greatest, the mean, and the numbers of windows over three thresholds (high quantiles of
ordinary texts' windows) are turned into a score by a logistic calibration, fitted on sample
texts that no dictionary was trained on.

Scale: one pass over the texts, no shuffle; the model is about 200 kilobytes. The sample
is at most SAMPLE texts a class, by hash of the id, whole; scoring has
no such bound. Near copies within the sample are dropped, since a copied text is no new
evidence.

Defined results. A null or empty text has one empty window and gets the score of a
difference of zero, below 0.5. Repeated rows get equal scores. Without at least TRAINABLE sample
texts of each class the score is the share of toxic labels, or 0 if that is all. Extra
columns, whatever their names, and labels whose document is missing, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from termforge.llm.common import resident

SAMPLE = (1_500, 2_500)
#: Bytes of the windows that are scored, and of those that dictionaries are trained on.
WINDOW, TRAIN_WINDOW = 96, 32
#: Sizes of the dictionary of a class and of the common one.
OWN_BYTES, COMMON_BYTES = 3_072, 196_608
MINED, ROUNDS, LEVEL = 0.03, 3, 7
QUANTILES = (0.99, 0.999, 0.9999)
TRAINABLE, FOLDS = 12, 5
_SPACE = re.compile(r"[\x09-\x0d\x20]+")


def normal(text: str | None) -> str:
    return " " + _SPACE.sub(" ", (text or "").lower()).strip(" ") + " "


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The whole text in windows of about `size` bytes that end at spaces, each with the space on both sides."""
    data = normal(text).encode()
    out, at, last = [], 0, len(data) - 1
    while at < last:
        end = min(at + size, last)
        if end < last:
            space = data.rfind(b" ", at + 1, end)
            end = space if space > at else end
        out.append(data[at : end + 1] if data[end : end + 1] == b" " else data[at:end])
        at = end
    return out or [b""]


def distinct_texts(texts: list[str]) -> list[str]:
    """The texts without near copies of earlier ones (texts that share one of eight minima over word 5-grams)."""
    seen: set = set()
    out = []
    for text in texts:
        words = text.split()
        grams = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))], np.uint64)
        minima = {(k, int(((grams * np.uint64(2 * k * 7919 + 1) + np.uint64(k * 104729)) % np.uint64(4294967291)).min())) for k in range(8)}
        if not minima & seen:
            out.append(text)
        seen |= minima
    return out


@dataclass(frozen=True)
class Model:
    """The dictionaries and the calibration; without weights the score is the prior."""

    ordinary: bytes = b""
    toxic: bytes = b""
    common: bytes = b""
    scale: tuple[float, float] = (0.0, 1.0)
    thresholds: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.0


def compressor(dictionary: bytes):
    """Compress with a dictionary's content; entropy is coded per window, so that equal matches cost the same under any."""
    import zstandard

    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.ordinary, self.toxic = compressor(model.ordinary + model.common), compressor(model.toxic + model.common)

    def differences(self, pieces: list[bytes]) -> np.ndarray:
        """How much longer each piece is under the ordinary dictionary than under the toxic one."""
        ordinary, toxic = self.ordinary, self.toxic
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in pieces], float)

    def features(self, d: np.ndarray) -> list[float]:
        mean, sd = self.model.scale
        top = np.sort(d)[::-1][:3]
        over = [np.log1p((d > t).sum()) for t in self.model.thresholds]
        return [1.0, (top[0] - mean) / sd, (top.mean() - mean) / sd, 3.0 * (d.mean() - mean) / sd, *over]

    def score(self, text: str | None) -> float:
        if not self.model.weights:
            return self.model.prior
        z = float(np.dot(self.features(self.differences(windows(text))), self.model.weights))
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(pieces: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained on pieces; where they are too few to train on, the pieces themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, pieces, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, bytes]:
    """(ordinary, toxic, common) from texts of the two classes, by mining windows across halves."""
    common = _dictionary([w for t in ordinary for w in windows(t)], COMMON_BYTES, 64)
    halves = [[[w for t in texts[f::2] for w in windows(t, TRAIN_WINDOW)] for f in (0, 1)] for texts in (ordinary, toxic)]
    least = min(len(h) for side in halves for h in side)
    mined = [[h[:: max(1, len(h) // least)] for h in side] for side in halves]

    def own(pieces: list[bytes]) -> bytes:
        return _dictionary(pieces, OWN_BYTES, TRAIN_WINDOW)

    for _ in range(ROUNDS):
        following: list[list] = [[[], []], [[], []]]
        for f in (0, 1):
            scorer = Scorer(Model(own(mined[0][f]), own(mined[1][f]), common))
            for side, sign in ((0, 1.0), (1, -1.0)):
                other = halves[side][1 - f]
                order = np.argsort(sign * scorer.differences(other), kind="stable")
                following[side][1 - f] = [other[i] for i in order[: max(TRAINABLE, int(MINED * len(other)))]]
        mined = following
    return own(mined[0][0] + mined[0][1]), own(mined[1][0] + mined[1][1]), common


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """A model from sample texts of the two classes; two thirds train the dictionaries, one third calibrates."""
    prior = len(toxic) / max(1, len(toxic) + len(ordinary))
    toxic, ordinary = distinct_texts(toxic), distinct_texts(ordinary)
    if min(len(toxic), len(ordinary)) < TRAINABLE:
        return Model(prior=prior if ordinary else 0.0)
    base, rest = ([[t for i, t in enumerate(c) if (i % 3 == 2) == last] for c in (ordinary, toxic)] for last in (False, True))
    scorer = Scorer(Model(*train_dictionaries(base[1], base[0])))
    found = [[scorer.differences(windows(t)) for t in c] for c in rest]
    plain = np.concatenate(found[0])
    thresholds = tuple(float(np.quantile(plain, q)) for q in QUANTILES)
    scorer = Scorer(Model(scorer.model.ordinary, scorer.model.toxic, scorer.model.common, (float(plain.mean()), float(max(plain.std(), 0.1))), thresholds))
    x = np.array([scorer.features(d) for c in found for d in c])
    weights = _logistic(x, np.repeat([0.0, 1.0], [len(c) for c in found]))
    m = scorer.model
    return Model(m.ordinary, m.toxic, m.common, m.scale, m.thresholds, tuple(weights.tolist()), prior)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept out of training: crc32 of the id as text, modulo FOLDS, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """Train on at most sample[0] toxic and sample[1] ordinary texts of docs, labelled and not held out."""
    texts_of = docs.select("doc_id", "text").where("text is not null")
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("label_id"), "toxic").distinct()
    # Ids alone are joined to choose the sample; then its texts are fetched by a broadcast of at most n ids.
    present = known.join(texts_of.select("doc_id"), F.col("label_id") == F.col("doc_id"), "left_semi")
    texts = []
    for label, n in zip((1, 0), sample):
        ids = present.where(F.col("toxic") == label).orderBy(F.md5(F.col("label_id").cast("string")), "label_id").limit(n).select("label_id")
        found = texts_of.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
        order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("text")]
        texts.append([r["text"] for r in found.orderBy(*order).limit(n).select("text").toLocalIterator()])
    return train(*texts)


def score_column(model: Model):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = resident(("toxicity", model), lambda: Scorer(model))
        for batch in texts:
            yield pd.Series([scorer.score(t if isinstance(t, str) else None) for t in batch], dtype="float64")

    return scores


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = score_column(learn(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below 0.5, with all their columns."""
    score = score_column(learn(docs, labels))
    scored = docs.select(F.struct(*docs.columns).alias("row"), score(F.col("text")).alias("score"))
    return scored.where("score < 0.5").select("row.*")
