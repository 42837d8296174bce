"""Quality scores by a generalised additive model with pairwise interactions.

Features are counts and shares of a text's bytes and words. Cyclic boosting fits shallow trees of one feature at
a time, each adding its leaves to that feature's lookup table; then trees of two features refine tables of the
pairs that the residuals favour. A score is the sigmoid of the sum of one entry of each table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, words

FEATURES = (
    "log_words", "word_bytes", "distinct", "top_share", "repeats", "upper", "digits", "marks", "pipes", "bangs",
    "symbols", "stops", "lines", "non_ascii", "entropy", "again",
)
#: Labelled rows that a fit takes at most; they are those of the least hash of doc_id.
SAMPLE = 20_000


def _classes() -> np.ndarray:
    t = np.zeros((7, 256), bool)
    t[0, 65:91] = True
    t[1, 48:58] = True
    for c in range(33, 127):
        t[2, c] = not chr(c).isalnum()
    t[3, ord("|")] = t[4, ord("!")] = True
    t[5, [ord(c) for c in "#$%&*@^~=+<>\\/_`{}[]"]] = True
    t[6, 128:192] = True
    return t


_CLASSES = _classes()


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; zeros for texts without words."""
    found, at = words.hashes(texts)
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for i, text in enumerate(texts):
        own = found[at[i] : at[i + 1]]
        n = len(own)
        if not n:
            continue
        seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        size = len(text)
        upper, digits, marks, pipes, bangs, symbols, non_ascii = (_CLASSES @ seen).tolist()
        letters = int(seen[97:123].sum()) + upper
        counts = np.unique(own, return_counts=True)[1]
        share = seen[seen > 0] / size
        pairs = words.windows(own, 2)
        out[i] = (
            np.log1p(n), size / n, len(counts) / n, counts.max() / n, np.count_nonzero(own[1:] == own[:-1]) / n, upper / max(letters, 1), digits / size,
            marks / size, pipes / n, bangs / n, symbols / n, int(seen[46] + seen[44]) / n, int(seen[10]) / n, non_ascii / size, -float((share * np.log2(share)).sum()),
            1 - len(np.unique(pairs)) / max(len(pairs), 1),
        )
    return out


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and features (array of float) of each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(texts) for _, texts in words.chunks(batch.column(1))]
            flat = np.concatenate(found).ravel() if found else np.empty(0, np.float32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<float>")


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: sums of table entries, all rows at once."""
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, ea, eb, table in self.pairs:
            total += table[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """Leaf value of each bin, by a tree of so many levels over bins in order."""
    out = np.full(len(g), g.sum() / (h.sum() + penalty))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + penalty) + (g.sum() - gl) ** 2 / (h.sum() - hl + penalty)
    k = int(np.argmax(gain)) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + penalty) + 1e-9:
        return out
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, penalty), _tree(g[k:], h[k:], depth - 1, penalty)])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, n_pairs: int = 6, pair_rounds: int = 40, penalty: float = 2.0) -> Model:
    """Fit on rows in memory; with one class or no rows the score is constant."""
    n, m = len(x), len(FEATURES)
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    quantiles = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1])) if n else np.empty(0)
    edges = [quantiles(x[:, j].astype(float), bins) for j in range(m)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if n == 0 or y.min() == y.max():
        return Model(edges, base, tables, [])
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(n, base)
    for _ in range(rounds):
        for j in range(m):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(at[j], y - p, len(tables[j])), np.bincount(at[j], p * (1 - p), len(tables[j])), 2, penalty)
            tables[j] += step
            total += step[at[j]]
    coarse = [quantiles(x[:, j].astype(float), 8) for j in range(m)]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-total))
    gains = []
    for a in range(m):
        for b in range(a + 1, m):
            where = cell[a] * (len(coarse[b]) + 1) + cell[b]
            g, h = np.bincount(where, y - p), np.bincount(where, p * (1 - p))
            gains.append((float((g**2 / (h + penalty)).sum()), a, b))
    chosen = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, table in chosen:
            p = 1 / (1 + np.exp(-total))
            where = cell[a] * table.shape[1] + cell[b]
            g = np.bincount(where, y - p, table.size).reshape(table.shape)
            h = np.bincount(where, p * (1 - p), table.size).reshape(table.shape)
            best = None
            for cut in range(1, table.shape[0]):  # a cut in one feature, then one in the other on each side
                step = np.empty_like(table)
                for side in (slice(0, cut), slice(cut, None)):
                    step[side] = _tree(g[side].sum(axis=0), h[side].sum(axis=0), 1, penalty)[None, :]
                gain = float((step * g - step**2 * (h + penalty / table.size) / 2).sum())
                if best is None or gain > best[0]:
                    best = (gain, step)
            if best is not None:
                table += rate * best[1]
                total += (rate * best[1]).ravel()[where]
    return Model(edges, base, tables, [(a, b, coarse[a], coarse[b], t) for a, b, t in chosen])


def scored(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs`` (doc_id, text).

    The model is fitted to ``labels`` (doc_id, quality 0 or 1) where ``learn``, a column over doc_id, is true: at most
    ``sample`` of them, those of least hash of doc_id. Nothing but the text enters a score. Null and empty
    texts have all features zero and are scored so; labels that are null or of unknown doc_id are passed over.
    Without labels of both kinds every score is the same. Repeated rows each have a row.
    """
    spark = docs.sparkSession
    rows = scratch.table(featured(docs), "features")
    some = labels.where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").dropDuplicates(["doc_id"])
    taken = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = rows.join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.min("quality").alias("quality"))
    got = one.select("features", "quality").toArrow()  # at most ``sample`` rows
    x = np.array(got.column("features").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    y = np.array(got.column("quality").to_pylist(), np.float64)
    order = np.lexsort([*x.T, y])  # the fit does not depend on the order of rows
    model = spark.sparkContext.broadcast(fit(x[order], y[order]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def keep(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7) -> DataFrame:
    """``docs`` (all columns) without the rows whose score is below ``threshold``.

    doc_id tells rows apart: of rows that repeat one, all stay if one of them passes.
    """
    best = scored(docs, labels, learn).groupBy("doc_id").agg(F.max("score").alias("score"))
    rejected = scratch.table(best.where(F.col("score") < threshold).select("doc_id"), "rejected")
    return scratch.by_ids(docs, rejected, "left_anti")
