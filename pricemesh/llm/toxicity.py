"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled rows.  A feature is the presence of
an n-gram in a text; its log-count ratio between the classes scales it, and a
regularised logistic regression is fitted on the scaled features.  Only the
n-grams that tell the classes apart are kept, so a model is a few thousand
64-bit hashes with weights.  Scoring looks up every n-gram of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemesh.llm.common import strings, text_slices

SLICE_BYTES = 1 << 20
BITS = 20        # size of the table that turns away most n-grams before the binary search
COUNT_BITS = 21  # size of the table that n-grams are first counted in when fitting


@dataclass(frozen=True)
class ToxicityConfig:
    rows_per_class: int = 3000   # bound of the training sample
    orders: tuple[int, ...] = (4, 5, 6)
    features: int = 4000         # n-grams kept
    least_df: int = 4            # texts of the sample that an n-gram must occur in
    smoothing: float = 1.0
    penalty: float = 1.0
    steps: int = 300
    threshold: float = 0.3


def fold(text: str | None) -> str:
    """Lower case, white space as single blanks, a blank at both ends."""
    return " " + " ".join((text or "").lower().split()) + " "


def owners(texts: list[str]) -> np.ndarray:
    """Which text each character of the joined texts belongs to."""
    return np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def gram_hashes(texts: list[str], orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """Per order n: hash of the n-gram that begins at each character of the joined texts, across their borders too."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        data += np.uint64(1)
        h = np.zeros(len(data), dtype=np.uint64)
        for n in range(1, max(orders) + 1):
            m = len(data) - n + 1
            if m <= 0:
                return
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15)
            h += data[n - 1 :]
            if n in orders:
                yield n, h ^ (h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class ToxicityModel:
    orders: tuple[int, ...]
    hashes: np.ndarray   # sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << BITS, dtype=bool)
        self.maybe[self.hashes >> np.uint64(64 - BITS)] = True

    @property
    def learned(self) -> bool:
        """Whether any n-gram counts; otherwise all texts score alike and none can be called toxic."""
        return bool(np.any(self.weights))

    def present(self, folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs."""
        pairs, owner = [], owners(folded)
        for n, h in gram_hashes(folded, self.orders):
            hit = np.flatnonzero(self.maybe[h >> np.uint64(64 - BITS)])
            at = np.searchsorted(self.hashes, h[hit])
            ok = at < len(self.hashes)
            ok[ok] = self.hashes[at[ok]] == h[hit[ok]]
            hit, at = hit[ok], at[ok]
            inside = owner[hit] == owner[hit + n - 1]
            pairs.append(owner[hit[inside]] * len(self.hashes) + at[inside])
        every = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)
        return every // max(1, len(self.hashes)), every % max(1, len(self.hashes))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        row, feature = self.present([fold(t) for t in texts])
        z = self.bias + np.bincount(row, weights=self.weights[feature], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str | None], labels: np.ndarray, prior: float, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit on a labelled sample; ``prior`` is the share of label 1 among all labelled rows.

    With one class only, or no rows at all, nothing can be learned: the model scores
    every text 0 (to 15 decimals), and no text is toxic by it.
    """
    labels = np.asarray(labels, dtype=np.float64)
    nothing = np.empty(0, dtype=np.uint64)
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(config.orders, nothing, np.empty(0), -40.0)
    folded = [fold(t) for t in texts]
    n1, n0 = labels.sum(), len(labels) - labels.sum()

    def strength(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-count ratio, and its size against its spread (0 for n-grams of too few texts)."""
        q = n - p
        ratio = np.log((p + config.smoothing) / (n1 + 2 * config.smoothing)) - np.log((q + config.smoothing) / (n0 + 2 * config.smoothing))
        spread = np.sqrt(1 / (p + config.smoothing) + 1 / (q + config.smoothing))
        return ratio, np.where(n >= config.least_df, np.abs(ratio) / spread, 0)

    # First by places of a table of fixed size, then by n-gram within the most telling places: memory stays bounded.
    shift = np.uint64(64 - COUNT_BITS)
    p, n = np.zeros(1 << COUNT_BITS), np.zeros(1 << COUNT_BITS)
    for h, y in _distinct(folded, labels, config):
        at = h >> shift
        p += np.bincount(at, y, len(p))
        n += np.bincount(at, minlength=len(n))
    telling = np.zeros(1 << COUNT_BITS, dtype=bool)
    telling[np.argsort(-strength(p, n)[1], kind="stable")[: 8 * config.features]] = True
    parts = []
    for h, y in _distinct(folded, labels, config):
        keep = telling[h >> shift]
        rows = np.empty(int(keep.sum()), dtype=[("h", "u8"), ("y", "f8")])
        rows["h"], rows["y"] = h[keep], y[keep]
        parts = [_summed([*parts, rows])]
    table = parts[0]
    ratio, strong = strength(table["y"], table["n"])
    best = np.argsort(-strong, kind="stable")[: config.features]
    best = best[strong[best] > 0]
    order = np.argsort(table["h"][best])
    hashes, ratio = table["h"][best][order], ratio[best][order]
    model = ToxicityModel(config.orders, hashes, np.zeros(len(hashes)), 0.0)
    x = np.zeros((len(labels), len(hashes)), dtype=np.float32)
    for start in range(0, len(folded), 200):
        row, feature = model.present(folded[start : start + 200])
        x[start + row, feature] = ratio[feature]
    # Each class counts by its share among all labelled rows, so that scores are probabilities there.
    weight = np.where(labels == 1, prior / n1, (1 - prior) / n0)
    w, b = _logistic(x, labels, weight, config.penalty / len(labels), config.steps)
    return ToxicityModel(config.orders, hashes, w * ratio, b)


def _distinct(folded: list[str], labels: np.ndarray, config: ToxicityConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of each text with its label, a few texts at a time."""
    for start in range(0, len(folded), 100):
        texts = folded[start : start + 100]
        of = owners(texts)
        for n, h in gram_hashes(texts, config.orders):
            owner = of[: len(h)]
            inside = owner == of[n - 1 :]
            h, owner = h[inside], owner[inside]
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.empty(0, bool)
            yield h[new], labels[start : start + 100][owner[new]]


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (hash, label) or (hash, labels, count) summed by hash."""
    h = np.concatenate([p["h"] for p in parts])
    y = np.concatenate([p["y"] for p in parts])
    n = np.concatenate([p["n"] if "n" in p.dtype.names else np.ones(len(p)) for p in parts])
    keys, inverse = np.unique(h, return_inverse=True)
    out = np.empty(len(keys), dtype=[("h", "u8"), ("y", "f8"), ("n", "f8")])
    out["h"], out["y"], out["n"] = keys, np.bincount(inverse, y, len(keys)), np.bincount(inverse, n, len(keys))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by accelerated gradient descent."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), float(np.log(weight[y == 1].sum() / weight[y == 0].sum()))
    v, c = w.copy(), b
    # Lipschitz constant by a few power iterations.
    u = np.ones(x.shape[1], dtype=np.float32)
    size = 1.0
    for _ in range(20):
        u = x.T @ ((weight * (x @ u)).astype(np.float32))
        size = float(np.linalg.norm(u)) or 1.0
        u /= size
    rate = 1.0 / (0.25 * (size + 1.0) + penalty)
    for k in range(steps):
        z = np.clip(x @ v + c, -40, 40)
        g = (weight * (1 / (1 + np.exp(-z)) - y)).astype(np.float32)
        w2, b2 = v - rate * (x.T @ g + penalty * v), c - rate * float(g.sum())
        m = k / (k + 3)
        v, c, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w.astype(np.float64), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit on at most about ``rows_per_class`` labelled rows of each class, chosen by a hash of the id.

    Only the chosen ids meet the documents; they are few by the config's bound, so
    they are broadcast and no text is shuffled but theirs.  Rows with a null label or
    id are no training rows; a null text is an empty one.  An id with several labels
    is toxic if any of them says so; of an id with several texts the least one counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return fit([], np.empty(0), 0.5, config)
    # The hash keeps the expected number of each class; twice that is a bound it does not reach.
    chosen = None
    for y, n in sorted(counts.items()):
        share = int(min(1.0, config.rows_per_class / n) * (1 << 20))
        some = known.filter((F.col("y") == y) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)).orderBy(F.xxhash64("id"), "id").limit(2 * config.rows_per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = found.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")
    prior = counts.get(1, 0) / total

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, t or "") for batch in batches for y, t in zip(*(c.to_pylist() for c in batch.columns)))
        model = fit([t for _, t in rows], np.array([y for y, _ in rows]), prior, config)
        found = ([model.hashes.tobytes()], [np.asarray(model.weights, dtype=np.float64).tobytes()])
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in found), pa.array([model.bias], pa.float64())], ["hashes", "weights", "bias"])

    # One task fits: the sample and the feature matrix need not pass the driver.
    learned = sample.repartition(1).mapInArrow(learn, "hashes binary, weights binary, bias double").first()
    if learned is None:
        return fit([], np.empty(0), prior, config)
    return ToxicityModel(config.orders, np.frombuffer(learned["hashes"], dtype=np.uint64), np.frombuffer(learned["weights"]), learned["bias"])


def score_toxicity(df: DataFrame, id_col: str, text_col: str, model: ToxicityModel) -> DataFrame:
    """One row per input row: ``id_col`` and score (0 to 1, higher is more toxic).

    Null and empty texts get the score of no evidence.  Ids may repeat or be null;
    other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most ``features`` hashes and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(strings(part.column("text"))), pa.float64())], [id_col, "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(df: DataFrame, text_col: str, model: ToxicityModel, threshold: float) -> DataFrame:
    """``df`` without rows that score ``threshold`` or more, all columns as they were.

    A model that has learned nothing rejects nothing.
    """
    if not model.learned:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col, SLICE_BYTES):
                yield part.filter(pa.array(shared.value.score(strings(part.column(text_col))) < threshold))

    return df.mapInArrow(run, df.schema)
