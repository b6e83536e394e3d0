"""Quality classifier by co-training (operator 4).

Two views of a document are learned apart: its text (hashed pairs of neighbouring bytes) and its page metadata (source,
language, length). Each view is a linear discriminant: class means, and the covariance within classes. In each round both
views score every unlabelled document; what a view is confident of enters the class means of the other view. Class sums
are all that leaves a task, so the pool of pseudo-labelled rows is the whole table, and as features are whole numbers,
the sums do not depend on the order of rows. Each view is calibrated on labelled rows by models that have not learned
from them, and the calibrated views are weighed into one score. Only the labelled rows are a bounded sample (MAX_LABELLED, chosen by
a hash of the id). Texts are read once; the rounds and the scoring read a table of features.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named, split_join
from .langid import held_out

TEXT_BITS = 10
SOURCE_SLOTS, LANG_SLOTS, LENGTH_SLOTS = 64, 16, 32
MAX_LABELLED = 3000
ROUNDS = 5
#: Confidence from which a view hands a row over: as calibrated, and as it would be if the classes were equally frequent.
CONFIDENT = 0.9
#: Added to the covariance, as a share of its mean variance.
RIDGE = 0.3
#: In doubt a document stays.
THRESHOLD = 0.3
_BLOCK = 1 << 20
_SLICE = 2048
_WIDTHS = (1 << TEXT_BITS, SOURCE_SLOTS + LANG_SLOTS + LENGTH_SLOTS)


def text_vector(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, in steps of 1/510 up to one half; zero without text."""
    counts = np.zeros(_WIDTHS[0])
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) if isinstance(text, str) else np.zeros(0, dtype=np.uint8)
    for lo in range(0, max(len(data) - 1, 0), _BLOCK):
        part = data[lo : lo + _BLOCK + 1].astype(np.uint32)
        pair = ((part[:-1] << np.uint32(8) | part[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - TEXT_BITS)
        counts += np.bincount(pair, minlength=_WIDTHS[0])
    return np.minimum(np.rint(510 * np.sqrt(counts / max(counts.sum(), 1))), 255).astype(np.uint8)


def meta_vector(source: str | None, lang: str | None, n_chars: int) -> np.ndarray:
    """Marks of the source, the language and the number of binary digits of the length."""
    v = np.zeros(_WIDTHS[1], dtype=np.uint8)
    if source is not None:
        v[zlib.crc32(str(source).encode("utf-8", "surrogatepass")) % SOURCE_SLOTS] = 1
    if lang is not None:
        v[SOURCE_SLOTS + zlib.crc32(str(lang).encode("utf-8", "surrogatepass")) % LANG_SLOTS] = 1
    v[SOURCE_SLOTS + LANG_SLOTS + min(int(n_chars).bit_length(), LENGTH_SLOTS - 1)] = 1
    return v


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a few features with a last one for the constant, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), penalty * np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = _sigmoid(x1 @ w)
        slope, curvature = x1.T @ (p - y) / len(y) + ridge @ w, (x1 * (p * (1 - p))[:, None]).T @ x1 / len(y) + ridge
        step = np.linalg.solve(curvature + 1e-9 * np.eye(len(w)), slope)
        w = w - step / max(1.0, float(np.linalg.norm(step)) / 4)
    return w


class Scorer:
    """What scores rows: the views' directions, calibrated, and how they are weighed."""

    def __init__(self, prior: float, weights: list[np.ndarray] | None = None, mixture: np.ndarray | None = None):
        self.prior, self.weights, self.mixture = prior, weights, mixture

    def logits(self, views: list[np.ndarray]) -> list[np.ndarray]:
        return [v.astype(np.float64) @ w[:-1] + w[-1] for v, w in zip(views, self.weights, strict=True)]

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text view, of the metadata view, of both."""
        if self.weights is None:
            return tuple(np.full(len(views[0]), self.prior) for _ in range(3))
        z = self.logits(views)
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(np.column_stack(z) @ self.mixture[:-1] + self.mixture[-1])


def _classes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and means of the rows of class 0 and 1, and the covariance within classes, with its ridge."""
    means = np.array([x[y == c].mean(axis=0) for c in (0, 1)])
    apart = x - means[y]
    within = apart.T @ apart / len(x)
    return np.bincount(y, minlength=2), means, within + RIDGE * max(np.trace(within) / len(within), 1e-9) * np.eye(len(within))


class Labelled:
    """The labelled sample. A view learns from all of it, and is calibrated on the scores that each third gets from a
    view that learned from the other two."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray):
        self.y, fold = y.astype(int), np.arange(len(y)) % 3
        self.prior = float(y.mean()) if len(y) else 1.0
        self.enough = len(y) >= 8 and all(0 < y[fold != f].sum() < (fold != f).sum() for f in range(3))
        if self.enough:
            self.views, self.thirds = [v.astype(np.float64) for v in views], [fold == f for f in range(3)]
            self.all = [_classes(v, self.y) for v in self.views]
            self.parts = [[_classes(v[~third], self.y[~third]) for third in self.thirds] for v in self.views]

    def scorer(self, handed: dict[tuple[int, int], np.ndarray]) -> Scorer:
        """With class sums of pseudo-labelled rows by (view, class), whose last entry is their number. Together they
        weigh at most as much as the labelled rows of the class."""
        if not self.enough:
            return Scorer(self.prior)

        def direction(view: int, counts: np.ndarray, means: np.ndarray, within: np.ndarray) -> np.ndarray:
            new = means.copy()
            for c in (0, 1):
                sums = handed.get((view, c))
                if sums is not None and sums[-1]:
                    more = min(sums[-1], counts[c])
                    new[c] = (counts[c] * means[c] + more * sums[:-1] / sums[-1]) / (counts[c] + more)
            return np.linalg.solve(within, new[1] - new[0])

        weights, calibrated = [], []
        for i, x in enumerate(self.views):
            z = np.zeros(len(x))
            for third, part in zip(self.thirds, self.parts[i], strict=True):
                z[third] = x[third] @ direction(i, *part)
            slope, constant = fit_logistic(z[:, None], self.y)
            weights.append(np.append(slope * direction(i, *self.all[i]), constant))
            calibrated.append(slope * z + constant)
        return Scorer(self.prior, weights, fit_logistic(np.column_stack(calibrated), self.y))


def handed_over(views: list[np.ndarray], scorer: Scorer) -> dict[tuple[int, int], np.ndarray]:
    """Sums and, last, number of the rows of each class that each view gets from the other, by (view, class)."""
    out, z = {}, scorer.logits(views)
    limit, even = np.log(CONFIDENT / (1 - CONFIDENT)), np.log(scorer.prior / (1 - scorer.prior))
    for teacher, learner in ((0, 1), (1, 0)):
        for label, sure in ((1, z[teacher] >= limit + max(even, 0)), (0, z[teacher] <= min(even, 0) - limit)):
            out[learner, label] = np.append(views[learner][sure].sum(axis=0, dtype=np.int64), sure.sum())
    return out


def _unpacked(part: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(part[c]), dtype=np.uint8).reshape(-1, n) for c, n in zip(("t", "m"), _WIDTHS, strict=True)]


def _slices(parts):
    for part in parts:
        for lo in range(0, len(part), _SLICE):
            yield part.iloc[lo : lo + _SLICE]


def features(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """`id`, `t`, `m`: the two feature vectors of every row."""
    text = named(text_col)
    rows = docs.select(named(id_col).alias("id"), text.alias("text"), named(source_col).alias("source"), named(lang_col).alias("lang"), F.coalesce(F.char_length(text), F.lit(0)).alias("n_chars"))

    def run(parts):
        for part in _slices(parts):
            meta = zip(part["source"], part["lang"], part["n_chars"], strict=True)
            yield pd.DataFrame({"id": part["id"], "t": [text_vector(x).tobytes() for x in part["text"]], "m": [meta_vector(*x).tobytes() for x in meta]})

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, t binary, m binary")


def _round(pool: DataFrame, scorer: Scorer) -> dict[tuple[int, int], np.ndarray]:
    """handed_over() of all rows of the pool; a few thousand sums come to the driver, whatever its size."""
    model = pool.sparkSession.sparkContext.broadcast(scorer)

    def run(parts):
        total = {}
        for part in _slices(parts):
            for key, sums in handed_over(_unpacked(part), model.value).items():
                total[key] = total.get(key, 0) + sums
        for (view, label), sums in total.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"view": view, "label": label, "slot": at, "total": sums[at]})

    sums = pool.select("t", "m").mapInPandas(run, "view int, label int, slot int, total long").groupBy("view", "label", "slot").agg(F.sum("total").alias("total"))
    out = {(view, label): np.zeros(_WIDTHS[view] + 1) for view in (0, 1) for label in (0, 1)}
    for r in sums.collect():
        out[r["view"], r["label"]][r["slot"]] = r["total"]
    return out


def fit(rows: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Scorer:
    """From rows with `id`, `t`, `m` and `y`, the label or null; labels of held-out ids are not used. Of the rows of one
    id the one with the least features is the labelled one."""
    labelled = rows.where(F.col("y").isNotNull() & ~held_out(F.col("id")))
    ids = labelled.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    sample = labelled.join(F.broadcast(ids), "id").groupBy("id").agg(F.min(F.struct("t", "m", "y")).alias("f")).orderBy(F.xxhash64("id"), "id").select("f.*").toPandas()
    known = Labelled(_unpacked(sample), sample["y"].to_numpy() > 0)
    scorer = known.scorer({})
    for _ in range(rounds if known.enough else 0):
        scorer = known.scorer(_round(rows.where("y IS NULL"), scorer))
    return scorer


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality", **bounds) -> DataFrame:
    """`<id>`, `held_out` (its label was not used), `text_score`, `meta_score`, `score`, `kept` (score >= THRESHOLD) for every row.

    Null texts and metadata are scored as empty; long texts are read whole; other columns are not read. With fewer than
    eight labels, or labels of one kind, every score is the share of good labels (1 without labels). Of several labels of
    an id the least counts. Repeated rows and null ids are scored like others, and count in the pool as often as they occur.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.where(named(label_col).isNotNull() & named(id_col).isNotNull()).groupBy(named(id_col).alias("id")).agg(F.min(named(label_col)).cast("int").alias("y"))
    rows = scratch.write("features", split_join(features(docs, id_col, text_col, source_col, lang_col), known, ["id"], "left"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, **bounds))

    def run(parts):
        for part in _slices(parts):
            text, meta, both = model.value.scores(_unpacked(part))
            yield pd.DataFrame({"id": part["id"], "text_score": text, "meta_score": meta, "score": both})

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "t", "m").mapInPandas(run, f"id {kind}, text_score double, meta_score double, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= THRESHOLD).alias("kept"))
