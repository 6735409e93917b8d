"""Language identification by string kernels.

The kernel of two texts is the number of n-grams both contain (blended over
several n, presence only), divided by the root of both texts' own counts.  A
Nystroem map over landmark texts turns it into features, and one ridge
regression per language (one against the rest) is fitted on them.  A batch of
texts is a sparse 0/1 matrix over the hashed n-gram space (2^18 places, so that even
texts of megabytes leave most of them free); kernels against all landmarks and the
regression are matrix products of it.  As the products are associative, landmarks
and regression are folded into one matrix per model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricemesh.llm.common import strings, text_slices

SLICE_BYTES = 1 << 20
ROWS = 64               # rows of one matrix product
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    rows_per_language: int = 500      # bound of the training sample
    landmarks_per_language: int = 60
    most_languages: int = 200
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 18                    # n-grams are hashed to 2**bits places
    ridge: float = 1e-2
    sharpness: float = 6.0            # of the scores made from the regressions' outputs


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; number signs such as one half or a Roman numeral sign are none."""
    return bool(text) and any(map(str.isalpha, text))


def places(texts: list[str | None], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places of the n-gram space the lower-cased texts fill: all places, and how many each text has."""
    out, filled = [], np.zeros(1 << bits, dtype=bool)
    shift = np.uint32(32 - bits)
    with np.errstate(over="ignore"):
        for text in texts:
            data = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            h = np.zeros(len(data), dtype=np.uint32)
            parts = []
            for n in range(1, max(orders) + 1):
                if len(data) < n:
                    break
                h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
                if n in orders:
                    parts.append((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> shift)
            if sum(map(len, parts)) < len(filled) // 64:
                out.append(np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint32))
            else:
                for x in parts:
                    filled[x] = True
                out.append(np.flatnonzero(filled).astype(np.uint32))
                filled[out[-1]] = False
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32), np.array([len(x) for x in out], dtype=np.int64)


def product(at: np.ndarray, counts: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The sparse 0/1 matrix whose rows fill these places, times a dense one."""
    out = np.zeros((len(counts), *dense.shape[1:]))
    some = counts > 0
    if some.any():
        first = np.cumsum(counts) - counts
        out[some] = np.add.reduceat(dense[at].astype(np.float64), first[some])
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    orders: tuple[int, ...]
    bits: int
    folded: np.ndarray      # places x languages: landmarks, Nystroem map and regression weights in one
    bias: np.ndarray
    sharpness: float

    def outputs(self, texts: list[str | None]) -> np.ndarray:
        """Outputs of the regressions, one column per language."""
        out = np.empty((len(texts), len(self.languages)))
        for start in range(0, len(texts), ROWS):
            at, counts = places(texts[start : start + ROWS], self.orders, self.bits)
            out[start : start + ROWS] = product(at, counts, self.folded) / np.sqrt(np.maximum(counts, 1))[:, None] + self.bias
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of every text; without a letter it is ``und`` with score 0."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        z = self.outputs(texts) * self.sharpness
        z = np.exp(z - z.max(axis=1, keepdims=True))
        best = z.argmax(axis=1)
        score = z[np.arange(len(z)), best] / z.sum(axis=1)
        letters = [has_letter(t) for t in texts]
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, score, 0.0)


def fit(texts: list[str | None], languages: list[str], config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Fit on a labelled sample.  Without rows the model knows no language; with one language it always says that one."""
    known = sorted(set(languages))
    size = 1 << config.bits
    if not known:
        return LanguageModel([], config.orders, config.bits, np.zeros((size, 0), dtype=np.float32), np.zeros(0), config.sharpness)
    label = np.array([known.index(x) for x in languages])
    at, counts = places(texts, config.orders, config.bits)
    first = np.cumsum(counts) - counts
    root_counts = np.sqrt(np.maximum(counts, 1))
    pick = np.concatenate([np.flatnonzero(label == k)[: config.landmarks_per_language] for k in range(len(known))])
    kernel = np.empty((len(texts), len(pick)))  # texts x landmarks
    filled = np.zeros(size, dtype=np.float32)
    for column, i in enumerate(pick):
        mine = at[first[i] : first[i] + counts[i]]
        filled[mine] = 1
        kernel[:, column] = product(at, counts, filled) / (root_counts * root_counts[i])
        filled[mine] = 0
    values, vectors = np.linalg.eigh(kernel[pick])
    good = values > 1e-6 * values.max(initial=0)
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    # One regression per language on centred data; rows count so that every language has the same weight.
    weight = 1.0 / np.bincount(label, minlength=len(known))[label]
    weight /= weight.sum()
    target = np.where(label[:, None] == np.arange(len(known)), 1.0, 0.0)
    mean, level = weight @ features, weight @ target
    f, t = features - mean, target - level
    normal = f.T @ (weight[:, None] * f)
    normal += config.ridge * max(np.trace(normal) / len(normal), 1e-12) * np.eye(len(normal))
    w = np.linalg.solve(normal, f.T @ (weight[:, None] * t))
    mapping, folded = root @ w, np.zeros((size, len(known)))
    for row, i in enumerate(pick):
        folded[at[first[i] : first[i] + counts[i]]] += mapping[row] / root_counts[i]
    return LanguageModel(known, config.orders, config.bits, folded.astype(np.float32), level - mean @ w, config.sharpness)


def train(labelled: DataFrame, text_col: str, lang_col: str, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Fit on at most about ``rows_per_language`` texts of each language, chosen and ordered by a hash of the text.

    Equal texts of a language count once, so copies make neither landmarks nor
    weight.  Rows with a null language or without a letter are no training rows; an
    empty table teaches no language.  More than ``most_languages`` languages are an
    error, not a silent cut.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(config.most_languages + 1).collect()}
    if len(counts) > config.most_languages:
        raise ValueError(f"more than {config.most_languages} languages")
    if not counts:
        return fit([], [], config)
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, config.rows_per_language / n) * (1 << 20)))).otherwise(share)
    digest = F.xxhash64("text")
    once = rows.filter(place < share).groupBy("lang", digest.alias("h")).agg(F.min("text").alias("text"))
    best = W.partitionBy("lang").orderBy("h", "text")
    sample = once.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= 2 * config.rows_per_language).orderBy("lang", "n").select("text", "lang").toArrow()
    pairs = [p for p in zip(sample["text"].to_pylist(), sample["lang"].to_pylist()) if has_letter(p[0])]
    return fit([p[0] for p in pairs], [p[1] for p in pairs], config)


def identify(df: DataFrame, id_col: str, text_col: str, model: LanguageModel) -> DataFrame:
    """One row per input row: ``id_col``, lang_pred and score (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, and so is every
    text where no language was learned.  Texts of any length are read whole.  Ids may
    repeat or be null; other columns are ignored; an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = _shared(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                languages, scores = shared.value.predict(strings(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_known(df: DataFrame, text_col: str, model: LanguageModel, least: float = 0.0) -> DataFrame:
    """``df`` without texts that are ``und`` or score below ``least``, all columns as they were.

    A model that knows no language rejects only texts without a letter.
    """
    shared = _shared(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col, SLICE_BYTES):
                texts = strings(part.column(text_col))
                if shared.value.languages:
                    languages, scores = shared.value.predict(texts)
                    keep = [x != UNKNOWN and s >= least for x, s in zip(languages, scores.tolist())]
                else:
                    keep = [has_letter(t) for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _shared(df: DataFrame, model: LanguageModel):
    """The model, at most 2**bits x ``most_languages`` weights."""
    return df.sparkSession.sparkContext.broadcast(model)
