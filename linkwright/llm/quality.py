"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its features are shares and lengths of the line itself and of its neighbours; the chain
ties successive labels. Forward-backward gives each line's marginal, and a document's score is the mean of its lines'
marginals for good, weighted by their lengths. The field is fitted on the driver on a bounded sample of labelled rows
(SAMPLE documents); the lines of a labelled document carry its label.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from .wordbpe import in_portions

SAMPLE = 4000  # labelled documents to fit on, at most
CHAIN = 400  # longer documents are fitted as several chains of so many lines; no line is left out
THRESHOLD, FOLDS, HELD_OUT = 0.3, 5, 0
STEPS, RATE, RIDGE = 300, 0.1, 1e-3

# Classes of ASCII bytes; bytes of other characters are letters.
_CLASS = np.full(256, 0, np.uint8)
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = 1 if _ch.isupper() else 0 if _ch.islower() else 2 if _ch.isdigit() else 3 if _ch in " \t\r\x0b\x0c\n" else 4 if _ch in ".,;:'\"?-()" else 5
OWN = 10  # features of a line by itself


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, their byte lengths, lines in each text). A text has one line at least."""
    lines = [t.split("\n") for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    raw = np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8) if texts else np.zeros(0, np.uint8)
    kind = _CLASS[raw]
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts
    share = []
    for c in range(6):
        if c != 0:
            share.append(np.add.reduceat((kind == c).astype(np.int32), starts) if len(starts) else np.zeros(0))
    upper, digit, space, mark, odd = share
    space = space - 1  # the line's own end
    split = [x.split() for d in lines for x in d]
    words = np.fromiter(map(len, split), np.int64, len(split))
    same = np.fromiter((sum(map(eq, w, w[1:])) for w in split), np.int64, len(split))
    kinds = np.fromiter((len(set(w)) for w in split), np.int64, len(split))
    letters = np.maximum(size - space - digit - mark - odd, 0)
    full = np.maximum(size, 1)
    x = np.stack([
        upper / np.maximum(letters, 1), digit / full, odd / full, mark / full,
        np.minimum(odd / np.maximum(words, 1), 2.0), same / np.maximum(words, 1), kinds / np.maximum(words, 1),
        np.log1p(words) / 5, np.minimum(size / np.maximum(words, 1), 20) / 10, (words == 0).astype(float),
    ], 1).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(n_lines)])[:-1]
    last = np.cumsum(n_lines) - 1
    before = np.concatenate([x[:1], x[:-1]]) if len(x) else x
    after = np.concatenate([x[1:], x[-1:]]) if len(x) else x
    if len(x):
        before[first], after[last] = x[first], x[last]
    return np.concatenate([x, before, after, np.ones((len(x), 1), np.float32)], 1), size, n_lines


def marginals(unary: np.ndarray, link: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected counts of the four label pairs, by forward-backward.

    unary: score of good against bad for each line; link: 2x2 scores of successive labels (0 bad, 1 good). All texts of a
    batch advance together, longest first, so a step costs one operation for all that are long enough.
    """
    total = int(n_lines.sum())
    order = np.argsort(-n_lines, kind="stable")
    first = (np.cumsum(n_lines) - n_lines)[order]
    sizes = n_lines[order]
    u = np.zeros((total, 2))
    u[:, 1] = unary
    alpha, beta = np.zeros((total, 2)), np.zeros((total, 2))
    steps = int(sizes[0]) if len(sizes) else 0
    alive = [int(np.searchsorted(-sizes, -t, "left")) for t in range(steps)]  # texts with more than t lines
    norm = lambda a: a - np.logaddexp(a[:, :1], a[:, 1:])
    for t in range(steps):
        at = first[: alive[t]] + t
        alpha[at] = u[at] if t == 0 else norm(u[at] + np.logaddexp(alpha[at - 1][:, :1] + link[0], alpha[at - 1][:, 1:] + link[1]))
        if t == 0:
            alpha[at] = norm(alpha[at])
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = u[at + 1] + beta[at + 1]
        beta[at] = norm(np.logaddexp(link[:, 0] + ahead[:, :1], link[:, 1] + ahead[:, 1:]))
        joint = alpha[at][:, :, None] + link[None] + ahead[:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    g = alpha + beta
    return 1 / (1 + np.exp(np.clip(g[:, 0] - g[:, 1], -50, 50))), pairs


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Field:
    """Weights of the features for good against bad, and of successive labels; scale and shift turn a document's mean
    marginal into the chance of its label."""

    def __init__(self, weights: np.ndarray, link: np.ndarray, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.link, self.scale, self.shift = weights, link, scale, shift

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text: mean P(good) of its lines, weighted by one more than their lengths."""
        x, size, n_lines = line_features(texts)
        if not len(texts):
            return np.zeros(0)
        good, _ = marginals(x @ self.weights, self.link, n_lines)
        weight = size + 1.0
        starts = np.cumsum(n_lines) - n_lines
        mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        return 1 / (1 + np.exp(-np.clip(self.scale * _logit(mean) + self.shift, -50, 50)))


def fit(texts: list[str], labels: list[int]) -> Field:
    """Maximum likelihood with a ridge, by Adam; each text's lines all carry its label and count one text together."""
    width = 3 * OWN + 1
    if not texts:
        return Field(np.zeros(width), np.zeros((2, 2)))
    x, _, n_lines = line_features(texts)
    x = x.astype(np.float64)
    y = np.repeat(np.array(labels, np.float64), n_lines)
    label = np.array(labels, np.int64)
    chains = np.array([min(CHAIN, n - at) for n in n_lines.tolist() for at in range(0, n, CHAIN)], np.int64)
    own = np.repeat(label, -(-n_lines // CHAIN))
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (chains[own == k] - 1).sum()
    weights, link = np.zeros(width), np.zeros((2, 2))
    m, v = np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, STEPS + 1):
        good, pairs = marginals(x @ weights, link, chains)
        grad = np.concatenate([x.T @ (good - y) / len(y) + RIDGE * weights, ((pairs - seen) / len(y) + RIDGE * link).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, link = weights - move[:width], link - move[width:].reshape(2, 2)
    field = Field(weights, link)
    field.scale, field.shift = calibrated(_logit(field.scores(texts)), label)
    return field


def calibrated(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic regression of the labels on z, by Newton steps with a small ridge; never falling in z."""
    x, w = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - label) + 0.1 * (w - np.array([1.0, 0.0]))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(2), grad)
        w[0] = max(w[0], 1e-3)
    return float(w[0]), float(w[1])


def in_fold(doc_id: str = "doc_id"):
    """The crc32 remainder that splits rows into those to learn from and those held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def trained(docs: DataFrame, labels: DataFrame) -> Field:
    """A field fitted on at most SAMPLE labelled rows outside the held-out fold, drawn by a hash of doc_id, whole texts.

    Labels other than 0 and 1 and labels without a document are left out; a doc_id that repeats counts for each of its rows
    up to SAMPLE. Without any label every score is 0.5.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("quality"))
    drawn = known.where(in_fold("k") != HELD_OUT).orderBy(F.xxhash64("k"), "k", "quality").limit(SAMPLE)
    # the ids are at most SAMPLE, so they go to the documents and not the other way
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("k")).select("k", F.coalesce("text", F.lit("")).alias("text"), "quality")
    learned = rows.orderBy("k", "quality", "text").limit(SAMPLE).collect()
    return fit([r[1] for r in learned], [r[2] for r in learned])


def _scores(field: Field, texts: list[str | None]) -> np.ndarray:
    parts = [field.scores(p) for _, p in in_portions([t or "" for t in texts], 4_000_000)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score is THRESHOLD or more).

    Null and empty texts have one empty line and the score the field gives that. A null doc_id counts as the empty string
    for the fold. Repeated rows stay, an empty table gives none, other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (in_fold() == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            s = _scores(field, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, trained(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is under THRESHOLD go; columns stay as they are.

    Null and empty texts go or stay by the score of an empty line. Null and repeated doc_ids and repeated rows are each
    judged by their text. An empty table gives an empty one; extra columns may have any name.
    """
    field = trained(docs, table(spark, sf_dir, "labels"))
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(field, b.column(at).to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(run, schema)
