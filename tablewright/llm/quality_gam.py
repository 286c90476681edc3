"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, learned by boosting in cycles: one shallow tree on one feature after
the other, with a small step. The pairs of features that explain most of the rest then get two-way tables by the
same steps. A score is the sum of the looked-up values: additions over binned columns, nothing else.

Features are measured on every whole text. The model is fitted on the driver on a bounded sample of labelled rows
(`train_rows`, taken by a hash of the id), as rows of numbers; texts never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import full_text, numbered, written

#: Labelled rows that the fit takes at most.
TRAIN_ROWS = 40_000
BINS = 48
ROUNDS = 120
PAIRS = 8
PAIR_BINS = 12
PAIR_ROUNDS = 40
RATE = 0.15
RIDGE = 1.0
LEAST_LEAF = 10
CUT = 0.3

FEATURES = ("log_words", "word_length", "upper", "digit", "bang", "pipe", "symbol", "stop", "comma", "other_mark",
            "non_ascii", "distinct_words", "top_word", "same_as_last", "repeated_triples", "repeated_lines",
            "words_per_line", "short_words", "long_words", "ends_in_mark", "one_letter_case")

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "bang": b"!?", "pipe": b"|",
            "symbol": b"#$%&*<>=@^~_", "stop": b".", "comma": b",;:", "other_mark": b"\"'()[]{}/\\+-`"}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES.values()):
    _MEMBER[list(_chars), _k] = 1
_MARKS = frozenset(b"!?|#$%&*<>=@^~_.,;:\"'()[]{}/\\+-`")


def features_of(text: str) -> list[float]:
    """The numbers of FEATURES for one whole text; zeros for a text without words."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    histogram = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    held = sum(map(len, words))
    shares = (histogram @ _MEMBER / held).tolist()
    lines = [line for line in data.split(b"\n") if line.strip()]
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    triples = max(1, n - 2)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    return [float(np.log1p(n)), held / n, *shares, float(histogram[128:].sum() / held), len(counts) / n,
            max(counts.values()) / n, sum(map(eq, words, words[1:])) / n,
            1 - len(set(zip(words, words[1:], words[2:]))) / triples if n > 2 else 0.0,
            1 - len(set(lines)) / len(lines), n / len(lines), float((lengths <= 3).mean()),
            float((lengths >= 12).mean()), sum(w[-1] in _MARKS for w in words) / n,
            sum(w.isupper() or w.islower() for w in words) / n]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([features_of(t) for t in batch.column("text").to_pylist()], dtype=np.float64)
        flat = pa.array(values.reshape(-1))
        offsets = pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)],
                                         names=["doc_id", "features"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), full_text(F.col(text_col)).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_measure, f"doc_id {id_type}, features array<double>")


# -- model -------------------------------------------------------------------------------

@dataclass
class Model:
    """edges[f]: bin borders of a feature; tables[f]: its values; pairs: (f, g, borders of f, of g, two-way table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features: lookups and additions."""
        logit = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            logit += table[np.searchsorted(edges, x[:, f], side="right")]
        for f, g, edges_f, edges_g, table in self.pairs:
            logit += table[np.searchsorted(edges_f, x[:, f], side="right"),
                           np.searchsorted(edges_g, x[:, g], side="right")]
        return 1 / (1 + np.exp(-logit))


def _borders(values: np.ndarray, bins: int) -> np.ndarray:
    """Quantile borders between distinct values; fewer where values repeat."""
    if not len(values):
        return np.zeros(0)
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, lo: int, hi: int, depth: int, out: np.ndarray) -> None:
    """A tree on the ordered bins lo..hi-1: writes each leaf's Newton step to out."""
    total_g, total_h = g[lo:hi].sum(), h[lo:hi].sum()
    if depth and hi - lo > 1:
        left_g, left_h, left_n = (np.cumsum(a[lo:hi])[:-1] for a in (g, h, n))
        fits = (left_n >= LEAST_LEAF) & (n[lo:hi].sum() - left_n >= LEAST_LEAF)
        gains = np.where(fits, _gain(left_g, left_h) + _gain(total_g - left_g, total_h - left_h), -1.0)
        best = int(np.argmax(gains))
        if gains[best] > _gain(total_g, total_h) + 1e-9:
            _tree(g, h, n, lo, lo + best + 1, depth - 1, out)
            _tree(g, h, n, lo + best + 1, hi, depth - 1, out)
            return
    out[lo:hi] = total_g / (total_h + RIDGE)


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, tuple[int, int] | None, np.ndarray]:
    """Best cut of a two-way grid into four: its gain, its place, and the four Newton steps as a table."""
    sums = [np.cumsum(np.cumsum(a, axis=0), axis=1) for a in (g, h, n)]
    parts = []
    for s in sums:
        low = s[:-1, :-1]
        parts.append((low, s[:-1, -1:] - low, s[-1:, :-1] - low, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + low))
    if not parts[0][0].size:
        return 0.0, None, np.zeros_like(g)
    fits = np.all([p >= LEAST_LEAF for p in parts[2]], axis=0)
    gains = np.where(fits, sum(_gain(a, b) for a, b in zip(parts[0], parts[1])), -1.0)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    gain = gains[i, j] - _gain(sums[0][-1, -1], sums[1][-1, -1])
    if gain <= 1e-9:
        return 0.0, None, np.zeros_like(g)
    steps = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(parts[0], parts[1])]
    table = np.empty_like(g)
    table[:i + 1, :j + 1], table[:i + 1, j + 1:], table[i + 1:, :j + 1], table[i + 1:, j + 1:] = steps
    return float(gain), (int(i), int(j)), table


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting; without rows or with one class the model is a constant (add-one estimate)."""
    intercept = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    width = x.shape[1]
    edges = [_borders(x[:, f], BINS) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(y) == 0 or y.min() == y.max():
        return Model(intercept, edges, tables, [])
    binned = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(binned, tables)]
    logit = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            if len(tables[f]) < 2:
                continue
            g, h = slopes()
            step = np.zeros(len(tables[f]))
            _tree(np.bincount(binned[f], g, len(step)), np.bincount(binned[f], h, len(step)), counts[f],
                  0, len(step), 2, step)
            tables[f] += RATE * step
            logit += RATE * step[binned[f]]
    coarse = [_borders(x[:, f], PAIR_BINS) for f in range(width)]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def grid(f: int, k: int, weights: np.ndarray | None) -> np.ndarray:
        shape = len(coarse[f]) + 1, len(coarse[k]) + 1
        return np.bincount(rough[f] * shape[1] + rough[k], weights, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_quadrants(grid(f, k, g), grid(f, k, h), grid(f, k, None))[0], f, k)
                     for f, k in combinations(range(width), 2)), key=lambda t: (-t[0], t[1], t[2]))
    chosen = [(f, k) for gain, f, k in ranked[:PAIRS] if gain > 0]
    two_way = {pair: np.zeros((len(coarse[pair[0]]) + 1, len(coarse[pair[1]]) + 1)) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for f, k in chosen:
            g, h = slopes()
            table = _quadrants(grid(f, k, g), grid(f, k, h), grid(f, k, None))[2]
            two_way[f, k] += RATE * table
            logit += RATE * table[rough[f], rough[k]]
    return Model(intercept, edges, tables, [(f, k, coarse[f], coarse[k], t) for (f, k), t in two_way.items()])


# -- Spark -------------------------------------------------------------------------------

def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is a multiple of five; NULL ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_sample(labels: DataFrame, label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, label) to learn from: labelled rows that are not held out; above `train_rows` of them, those whose
    hash falls in the share that makes that many on average.

    Labels that repeat an id are averaged and rounded; NULL labels and ids are left out.
    """
    known = (labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.round(F.avg(label_col)).alias("label")))
    share = train_rows / max(1, known.count())
    if share >= 1:
        return known
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))


def train(measured: DataFrame, sample: DataFrame, train_rows: int = TRAIN_ROWS, folder: str | None = None) -> Model:
    """Fit on the sample's rows of `measured` (doc_id, features); only these numbers reach the driver.

    Rows equal in id and features are one. Where an id repeats with so many texts that there are still more rows than
    `train_rows` and the sample's ids, those are used whose hash falls in the share that makes that many on average.
    """
    found = written(measured.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "features").distinct(), folder)
    share = max(train_rows, sample.count()) / max(1, found.count())
    if share < 1:
        found = found.filter(F.pmod(F.xxhash64("doc_id", "features"), F.lit(1 << 32)) < int(share * (1 << 32)))
    rows = found.toPandas()
    # an order of their own, so that sums do not depend on partitions
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T[::-1], rows["doc_id"].to_numpy()))
    return fit(x[order], rows["label"].to_numpy(dtype=np.float64)[order])


def _score(model, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(model.value.score(x))],
                                             names=[*names, "score"])
    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", cut: float = CUT, train_rows: int = TRAIN_ROWS,
                   folder: str | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Only numbers measured on the text enter a score. NULL text counts as empty and gets the score of an empty text.
    NULL and repeated ids keep their rows. Without usable labels the score is a constant. An empty table gives no
    rows; other columns are left out.
    """
    measured = written(features(docs, id_col, text_col), folder)
    model = train(measured, train_sample(labels, label_col, train_rows), train_rows, folder)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = measured.schema["doc_id"].dataType.simpleString()
    scored = measured.mapInArrow(_score(sent, ["doc_id"]), f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality",
              cut: float = CUT, train_rows: int = TRAIN_ROWS, folder: str | None = None) -> DataFrame:
    """The rows whose text scores at least `cut`, all columns unchanged; texts are scored where they are read.

    The model is fitted on the labelled rows of `docs`, as in quality_scores.
    """
    sample = written(train_sample(labels, label_col, train_rows), folder)
    model = train(features(docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"), "doc_id", text_col),
                  sample, train_rows, folder)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features_of(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(sent.value.score(x) >= cut))

    plain, at = numbered(docs), docs.columns.index(text_col)
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
