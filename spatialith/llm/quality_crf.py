"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features are shares of character classes, word and repetition statistics, and the
same of the lines before and after it; two by two transition weights link neighbouring lines.  Forward-backward gives
each line's marginal probability of being good, a document's evidence is the mean of these weighted by line length, and
a logistic curve fitted on the training documents turns the evidence into a score between 0 and 1.

Lines have no labels, so training starts with each line labelled like its document, then twice relabels the lines of
bad documents by their marginals (the worst line stays bad) and trains again.  It uses a bounded sample of labelled
documents, at most ``SAMPLE_DOCS`` by hash of the identifier, and of those, in that order, whole ones as long as all have
at most ``SAMPLE_LINES`` lines together; features are computed on the executors, and only they reach the driver.  Scoring is a map over whole texts: no shuffle.

Edge cases: null text counts as empty; an empty text is one empty line and gets a score like any other.  Labels that are
null, or held out, or that contradict another label of their identifier, are not learned from; without any usable label
all scores are 0.5.  A null identifier is not held out, and has no label.  Repeated rows are scored one by
one.  An empty table gives an empty result.  Extra columns pass through ``score_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbatch as B
from .store import table

#: Bound on labelled documents that the classifier is fitted on.
SAMPLE_DOCS = 3000
#: Bound on their lines, of 63 numbers each.
SAMPLE_LINES = 400_000
THRESHOLD = 0.3
FOLDS = 5
N_OWN = 20
N_FEATURES = 3 * N_OWN + 3  # own, previous, next; bias, first, last
_TABLE: list[np.ndarray] = []
UPPER, LOWER, DIGIT, SPACE, STOP, PUNCT, PIPE, SYMBOL, BANG, OTHER = range(10)


def _classes() -> np.ndarray:
    """Character class of each code point of the basic plane; the last entry stands for all others."""
    if not _TABLE:
        t = np.full(0x10001, OTHER, np.uint8)
        for i in range(0x10000):
            c = chr(i)
            if c.isupper():
                t[i] = UPPER
            elif c.islower() or c.isalpha():
                t[i] = LOWER
            elif c.isdigit():
                t[i] = DIGIT
            elif c.isspace():
                t[i] = SPACE
        for kind, chars in ((STOP, ".?"), (PUNCT, ",;:'\"()-"), (PIPE, "|"), (BANG, "!"), (SYMBOL, "#$%&*@~^<>{}[]\\/_=+`")):
            t[[ord(c) for c in chars]] = kind
        _TABLE.append(t)
    return _TABLE[0]


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (N_FEATURES columns), their weights (characters), and line offsets per text."""
    flat, offsets = B.codes(texts)
    breaks = np.flatnonzero(flat == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    # a break at a text's very end opens an empty line, which sorts before the next text's first
    owner = np.concatenate([np.arange(len(texts)), np.searchsorted(offsets[1:], breaks, side="right")])
    order = np.argsort(np.concatenate([offsets[:-1], breaks + 1]) * 2 + np.concatenate([np.ones(len(texts), int), np.zeros(len(breaks), int)]), kind="stable")
    owner = owner[order]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = len(starts)
    ends = np.empty(n, np.int64)
    ends[:-1] = starts[1:] - 1
    ends[edges[1:] - 1] = offsets[1:]
    ends = np.maximum(ends, starts)
    size = ends - starts

    kind = _classes()[np.minimum(flat, 0x10000)]
    line_of = np.searchsorted(starts, np.arange(len(flat)), side="right") - 1 if len(flat) < 2 else _line_index(starts, len(flat))
    counts = np.bincount(line_of * 10 + kind, minlength=n * 10).reshape(n, 10).astype(np.float64) if len(flat) else np.zeros((n, 10))
    long = np.maximum(size, 1)[:, None]
    share = counts / long
    letters = np.maximum(counts[:, UPPER] + counts[:, LOWER], 1)

    w_start, w_end, _ = B.words(flat, offsets)
    w_line = line_of[w_start] if len(w_start) else np.zeros(0, np.int64)
    n_words = np.bincount(w_line, minlength=n)
    hashes = B.span_hashes(flat, w_start, w_end)
    pair = np.unique(B.mix64(hashes + w_line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(w_line[pair], minlength=n)
    short = np.bincount(w_line, weights=(w_end - w_start <= 3), minlength=n)
    whole = B.span_hashes(flat, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, back, times = np.unique(whole, return_inverse=True, return_counts=True)
    words = np.maximum(n_words, 1)
    last = np.where(size > 0, kind[np.maximum(ends - 1, 0)] if len(flat) else 0, OTHER)

    own = np.stack(
        [
            counts[:, UPPER] / letters,
            np.minimum(1, 3 * counts[:, UPPER] / letters),
            share[:, DIGIT],
            share[:, SPACE],
            share[:, STOP],
            share[:, PUNCT],
            np.minimum(1, 10 * share[:, PIPE]),
            np.minimum(1, 10 * share[:, SYMBOL]),
            np.minimum(1, 10 * share[:, BANG]),
            share[:, OTHER],
            np.log1p(size) / 6,
            np.log1p(n_words) / 4,
            distinct / words,
            short / words,
            counts[:, :2].sum(1) / words / 10,
            np.minimum(1, times[back] - 1),
            np.log1p(times[back] - 1),
            (last == STOP).astype(float),
            (n_words <= 2).astype(float),
            np.minimum(1, counts[:, STOP] / words * 5),
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    is_first, is_last = np.zeros(n), np.zeros(n)
    is_first[edges[:-1]], is_last[edges[1:] - 1] = 1, 1
    before[is_first > 0], after[is_last > 0] = 0, 0
    features = np.concatenate([own, before, after, np.stack([np.ones(n), is_first, is_last], 1)], 1)
    return features.astype(np.float32), np.maximum(size, 1).astype(np.float64), edges


def _line_index(starts: np.ndarray, n: int) -> np.ndarray:
    """Number of the line that each character belongs to; of lines that start together the last one has it."""
    step = np.bincount(starts[starts < n], minlength=n)
    return np.cumsum(step) - 1 if len(starts) else np.zeros(n, np.int64)


def _padded(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers as (texts, longest) and the mask of those that exist."""
    lengths = np.diff(edges)
    at = np.arange(lengths.max())
    mask = at[None, :] < lengths[:, None]
    return np.where(mask, edges[:-1, None] + at, 0), mask


def marginals(emission: np.ndarray, trans: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected count of each transition, by scaled forward-backward.

    ``emission``: log-odds of good for each line.  Texts advance together, one line at a time.
    """
    out, pairs = np.empty(len(emission)), np.zeros((2, 2))
    lengths = np.diff(edges)
    by_length = np.argsort(-lengths, kind="stable")
    step = np.exp(np.clip(trans, -20, 20))
    for at in range(0, len(by_length), 512):
        group = by_length[at : at + 512]
        size = lengths[group]
        first = edges[group]
        t_max = int(size.max())
        alive = np.searchsorted(-size, -np.arange(t_max), side="left")  # texts with more than t lines
        obs, alpha = [], []
        for t in range(t_max):
            k = alive[t]
            e = np.clip(emission[first[:k] + t], -30, 30)
            o = np.stack([1 / (1 + np.exp(e)), 1 / (1 + np.exp(-e))], 1)
            a = o if t == 0 else (alpha[-1][:k] @ step) * o
            obs.append(o)
            alpha.append(a / a.sum(1, keepdims=True))
        beta = np.ones((alive[-1], 2))
        for t in range(t_max - 1, -1, -1):
            k = alive[t]
            if len(beta) < k:
                beta = np.concatenate([beta, np.ones((k - len(beta), 2))])
            post = alpha[t] * beta
            out[first[:k] + t] = (post / post.sum(1, keepdims=True))[:, 1]
            if t:
                right = obs[t] * beta
                joint = alpha[t - 1][:k, :, None] * step * right[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                beta = right @ step.T
                beta /= beta.sum(1, keepdims=True)
    return out, pairs


class Model:
    """Weights of the field and of the curve from evidence to score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, slope: float, shift: float):
        self.weights, self.trans, self.slope, self.shift = weights, trans, slope, shift

    def evidence(self, features: np.ndarray, size: np.ndarray, edges: np.ndarray) -> np.ndarray:
        good, _ = marginals(features @ self.weights, self.trans, edges)
        total = np.add.reduceat(size, edges[:-1])
        return np.add.reduceat(good * size, edges[:-1]) / total

    def scores(self, features: np.ndarray, size: np.ndarray, edges: np.ndarray) -> np.ndarray:
        q = np.clip(self.evidence(features, size, edges), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(q / (1 - q)) + self.shift, -30, 30)))


BLANK = Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, 0.0)


def _fit_field(x, edges, y, weights, trans, steps: int, decay: float = 1e-3):
    """Full-batch Adam on the log-likelihood of the line labels ``y``."""
    n = len(x)
    same_text = np.ones(n, bool)
    same_text[edges[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same_text[1:]], y[1:][same_text[1:]]), 1)
    theta = np.concatenate([weights, trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        good, pairs = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), edges)
        grad = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit(features: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, rounds: int = 3, steps: int = 60) -> Model:
    """Fit on documents' line features, line sizes and 0/1 labels."""
    if not len(labels) or labels.min() == labels.max():
        return BLANK
    x, size = np.concatenate(features).astype(np.float64), np.concatenate(sizes)
    edges = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    doc = np.repeat(np.arange(len(labels)), np.diff(edges))
    y = labels[doc].astype(int)
    weights, trans = np.zeros(N_FEATURES), np.zeros((2, 2))
    for r in range(rounds):
        weights, trans = _fit_field(x, edges, y, weights, trans, steps)
        if r + 1 < rounds:
            good, _ = marginals(x @ weights, trans, edges)
            y = np.where(labels[doc] == 1, 1, (good > 0.5).astype(int))
            worst = np.minimum.reduceat(good, edges[:-1])
            y[(labels[doc] == 0) & (good <= worst[doc])] = 0
    q = np.clip(Model(weights, trans, 1, 0).evidence(x, size, edges), 1e-4, 1 - 1e-4)
    z = np.stack([np.log(q / (1 - q)), np.ones(len(q))], 1)
    curve = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of a slightly regularised logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        curve = curve + np.linalg.solve(hess, z.T @ (labels - p) - 1e-2 * curve)
    return Model(weights, trans, float(curve[0]), float(curve[1]))


def fold(id_col: str, n: int = FOLDS) -> Column:
    """crc32 of the identifier as text, modulo ``n``; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, quality = batch.column("text").to_pylist(), batch.column("quality").to_pylist()
        for a, b in B.chunks(texts):
            x, size, edges = line_features(texts[a:b])
            rows = [x[edges[i] : edges[i + 1]].tobytes() for i in range(b - a)]
            weight = [size[edges[i] : edges[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(quality[a:b], pa.int32()), pa.array(rows, pa.binary()), pa.array(weight, pa.binary())],
                ["quality", "x", "size"],
            )


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lines: int = SAMPLE_LINES,
) -> Model:
    """Fit a model on at most ``sample`` labelled documents, of ``lines`` lines, outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("_id").isNotNull() & (fold("_id") != 0))
    known = known.groupBy("_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    known = known.filter("quality = _other").drop("_other").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "_id").withColumn("_text", F.xxhash64("text"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    sized = rows.groupBy("_id", "_text").agg(F.max(breaks + 1).alias("n"))  # rows that repeat a text count once
    chosen, total = [], 0
    for r in sized.orderBy(F.xxhash64("_id"), "_id", "_text").limit(sample).collect():
        if total + r.n <= lines:
            total += r.n
            chosen.append((r["_id"], r["_text"]))
    if not chosen:
        return BLANK
    use = docs.sparkSession.createDataFrame(chosen, rows.select("_id", "_text").schema)
    rows = rows.join(F.broadcast(use), ["_id", "_text"]).dropDuplicates(["_id", "_text"]).select("quality", "text")
    got = rows.mapInArrow(B.tidy(_train_rows), "quality int, x binary, size binary").collect()
    got.sort(key=lambda r: (r.quality, bytes(r.x)))  # the order of rows must not change the sums
    x = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got]
    size = [np.frombuffer(r["size"], np.float64) for r in got]
    return fit(x, size, np.array([r.quality for r in got]))


def fresh_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` clashes."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with one more column, the score."""
    name = fresh_name(docs, name)
    n_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.empty(batch.num_rows)
            for a, b, texts in B.text_chunks(batch.column(n_text)):
                score[a:b] = model.scores(*line_features(texts))
            names = [*batch.schema.names, name]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names)

    return docs.mapInArrow(B.tidy(run), T.StructType([*docs.schema, T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is at least ``threshold``, with their own columns."""
    name = fresh_name(docs, "score")
    return score_documents(docs, model).filter(F.col(name) >= threshold).select(docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
