"""Language identification by a string kernel (operator 1).

The kernel of two texts counts the character n-grams, of every length in NGRAMS, that both hold (presence, not
frequency), divided by the roots of how many each holds. Landmark texts give a Nystrom map: a text's kernel values with the
landmarks, times the inverse root of the landmarks' own kernel. A text that shares little with any landmark has a short
map and so a low score. One ridge regression for each language is fitted on that map. Scoring is
two matrix products a batch: presence x landmarks, then map x languages.

A text is mapped in pieces of PIECE_CHARS, so that the n-grams of a long text do not come to hold everything; its map is the
mean of its pieces' by their letters. The model is fitted on a bounded sample of labelled rows (SAMPLE_PER_LANGUAGE each,
MAX_SAMPLE in all, chosen by a hash of the id). Executors work out the landmarks' n-grams and the sample's maps; the driver
gets at most MAX_LANDMARKS lists of n-gram numbers and a short vector for each row. Scoring reads every whole text.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, named

NGRAMS = (2, 3, 4)
TABLE_BITS = 16
SAMPLE_PER_LANGUAGE = 200
MAX_SAMPLE = 3000
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-3
UNDETERMINED = "und"
#: Score under which `with_language` rejects a text. On sf0.1 the lowest score of a held-out row with the right prediction is
#: 0.256; letters of no learned language scored under 0.01, random letters up to 0.14.
MIN_SCORE = 0.2
#: Characters up to which a text is too short for the model to contradict a given language.
SHORT_CHARS = 40
PIECE_CHARS = 1 << 12
MAX_LANDMARKS = 256
#: Longer texts are landmarks only where a language has no shorter one.
LANDMARK_CHARS = 20_000
BATCH = 128
_FACTOR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def pieces_of(text: str | None) -> Iterator[str]:
    """Pieces of at most PIECE_CHARS, each led by the last characters of the one before, so that no n-gram is lost."""
    overlap = max(NGRAMS) - 1
    for lo in range(0, len(text) if isinstance(text, str) else 0, PIECE_CHARS):
        yield text[max(lo - overlap, 0) : lo + PIECE_CHARS]


def mark(piece: str, present: np.ndarray) -> int:
    """Set the slots of a piece's n-grams and count its letters, which are lower-cased; all else is one blank."""
    cp = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = _letters()[cp]
    n_letters = int(is_letter.sum())
    if not n_letters:
        return 0
    cp = np.where(is_letter, cp, np.uint32(32))
    cp = np.concatenate([[np.uint32(32)], cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])], [np.uint32(32)]]).astype(np.uint32)
    for order, n in enumerate(NGRAMS):
        size = len(cp) - n + 1
        if size > 0:
            h = np.zeros(size, dtype=np.uint32)
            for t in range(n):
                h += cp[t : t + size] * _FACTOR[t]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            present[(order << TABLE_BITS) + (h >> np.uint32(32 - TABLE_BITS))] = 1
    return n_letters


def slots_of(text: str | None) -> np.ndarray:
    """The slots of all the n-grams of a text."""
    table = np.zeros(len(NGRAMS) << TABLE_BITS, dtype=np.uint8)
    for piece in pieces_of(text):
        mark(piece, table)
    return np.flatnonzero(table).astype(np.int32)


class KernelMap:
    """The Nystrom map of some landmarks, given by their slots."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.slots = np.unique(np.concatenate(landmarks)) if landmarks else np.zeros(0, dtype=np.int32)
        self.landmarks = np.zeros((len(self.slots), len(landmarks)), dtype=np.float32)
        for i, slots in enumerate(landmarks):
            self.landmarks[np.searchsorted(self.slots, slots), i] = 1
        value, vector = np.linalg.eigh((self.landmarks.T @ self.landmarks).astype(np.float64)) if landmarks else (np.zeros(0), np.zeros((0, 0)))
        good = value > 1e-6 * max(value.max(initial=0), 1)
        self.root = (vector[:, good] / np.sqrt(value[good])).astype(np.float32)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The map of each text, and its letters; zero without any."""
        out, letters = np.zeros((len(texts), self.root.shape[1])), np.zeros(len(texts), dtype=np.int64)
        present, rows, weights = np.zeros((BATCH, len(self.slots)), dtype=np.float32), [], []
        table = np.zeros(len(NGRAMS) << TABLE_BITS, dtype=np.uint8)

        def flush() -> None:
            phi = (present[: len(rows)] @ self.landmarks) @ self.root
            np.add.at(out, rows, phi * np.array(weights)[:, None])
            rows.clear()
            weights.clear()

        for row, text in enumerate(texts):
            for piece in pieces_of(text):
                table[:] = 0
                n = mark(piece, table)
                if n:
                    letters[row] += n
                    present[len(rows)] = table[self.slots]
                    rows.append(row)
                    weights.append(n / np.sqrt(table.sum(dtype=np.int64)))  # the piece's kernel with itself
                    if len(rows) == BATCH:
                        flush()
        if rows:
            flush()
        return out / np.maximum(letters, 1)[:, None], letters


class Model:
    """Languages, the map and a ridge regression for each language; what a task needs to score."""

    def __init__(self, kernel: KernelMap, phi: np.ndarray, langs: list[str]):
        self.langs, self.kernel = sorted(set(langs)), kernel
        y = np.array([self.langs.index(lang) for lang in langs], dtype=np.int64)
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, 0.0)  # of what shares nothing, zero for all
        weight = 1.0 / np.maximum(np.bincount(y, minlength=len(self.langs)), 1)[y]  # every language counts the same
        gram = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1])
        self.weights = np.linalg.lstsq(gram, phi.T @ (target * weight[:, None]), rcond=None)[0]

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and score; undetermined and zero without a letter, or if nothing was learned."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        phi, letters = self.kernel(texts)
        margin = phi @ self.weights
        best = margin.argmax(axis=1) if len(margin) else np.zeros(0, dtype=int)
        scores = np.where(letters > 0, np.clip(margin[np.arange(len(best)), best], 0, 1), 0.0)
        return [self.langs[b] if n else UNDETERMINED for b, n in zip(best, letters, strict=True)], scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of rows with text and lang, without those held out. Rows of one id are apart by their text."""
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    order = ("h", "id", "th")
    each = Window.partitionBy("lang").orderBy(*order)
    keys = rows.select("id", "lang", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("th")).withColumn("r", F.row_number().over(each)).where(F.col("r") <= SAMPLE_PER_LANGUAGE)
    # not collected and sent back: rows of the driver go through a second pool of Python workers, which stays
    wanted = durable(keys.orderBy("r", "lang", *order).limit(MAX_SAMPLE).select(F.col("id").alias("kid"), F.col("th").alias("kth"), F.col("lang").alias("klang"), "h").distinct())
    n_langs = wanted.select("klang").distinct().count()
    same = F.col("id").eqNullSafe(F.col("kid")) & (F.xxhash64("text") == F.col("kth")) & (F.col("lang") == F.col("klang"))
    found = rows.join(F.broadcast(wanted), same).select("id", F.col("kth").alias("th"), "h", "lang", "text")
    sample = durable(found.dropDuplicates(["id", "th", "lang"]))  # at most MAX_SAMPLE rows
    n_each = max(1, min(LANDMARKS_PER_LANGUAGE, MAX_LANDMARKS // max(1, n_langs)))
    longer = F.char_length("text") > LANDMARK_CHARS
    apt = Window.partitionBy("lang").orderBy(longer, *order)
    chosen = sample.withColumn("r", F.row_number().over(apt)).where((F.col("r") == 1) | (F.col("r") <= n_each) & ~longer)

    def slots(parts):
        for part in parts:
            yield pd.DataFrame({"lang": part["lang"], "r": part["r"], "slots": [slots_of(t).tobytes() for t in part["text"]]})

    landmarks = sorted(chosen.select("lang", "r", "text").mapInPandas(slots, "lang string, r int, slots binary").collect(), key=lambda r: (r["lang"], r["r"]))
    kernel = KernelMap([np.frombuffer(r["slots"], dtype=np.int32) for r in landmarks if r["slots"]])
    sent = docs.sparkSession.sparkContext.broadcast(kernel)  # at most MAX_LANDMARKS columns

    def mapped(parts):
        for part in parts:
            phi, letters = sent.value(part["text"].tolist())
            yield pd.DataFrame({"lang": part["lang"], "h": part["h"], "th": part["th"], "phi": [v.tobytes() for v in phi]})[letters > 0]

    found = sorted(sample.select("lang", "h", "th", "text").mapInPandas(mapped, "lang string, h long, th long, phi binary").collect(), key=lambda r: (r["lang"], r["h"], r["th"]))
    phi = np.frombuffer(b"".join(bytes(r["phi"]) for r in found)).reshape(len(found), -1) if found else np.zeros((0, kernel.root.shape[1]))
    return Model(kernel, phi, [r["lang"] for r in found])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`<id>`, `lang_pred`, `score` for every row; `und` and 0 if the text is null or has no letter, or nothing was learned."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    def run(parts):
        for part in parts:
            langs, scores = sent.value.predict(part["text"].tolist())
            yield pd.DataFrame({"id": part["id"], "lang_pred": langs, "score": scores})

    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    out = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInPandas(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`<id>`, `held_out`, `lang_pred`, `score`, one row for each row of docs, repeated rows and null ids too.

    Empty texts and texts without a letter are undetermined; long texts are scored whole. Other columns are not read.
    """
    scored = predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return scored.select(named(id_col), held_out(named(id_col)).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """`docs` without the rows of undetermined language or with a score under `min_score`; a null language is filled with
    the prediction, a given one and all other columns stay. A text of up to SHORT_CHARS characters with a letter stays
    whatever its score if its language is given. Null texts and texts without a letter go; long texts are scored whole.
    """
    model = fit(docs, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        langs, scores = sent.value.predict(texts.tolist())
        return pd.DataFrame({"lang": langs, "score": scores})

    # not deterministic, or the filter and the column would each score every text
    scored = docs.withColumn("__found", language.asNondeterministic()(named(text_col)))
    short = named(lang_col).isNotNull() & (F.char_length(named(text_col)) <= SHORT_CHARS)
    sure = scored.where((F.col("__found.lang") != UNDETERMINED) & ((F.col("__found.score") >= min_score) | short))
    return sure.withColumn(lang_col, F.coalesce(named(lang_col), "__found.lang")).drop("__found")
