"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features are its own and its two neighbours'. The field is fitted to
labelled documents, each line taking its document's label, by gradient ascent on the penalised
likelihood. A document's quality is the mean of its lines' forward-backward marginals, weighed by
their lengths, made a probability by a logistic fit on the learning rows.

Learning takes a bounded sample: at most SAMPLE_DOCUMENTS documents of a label, of LONGEST bytes at
most. Scoring takes whole texts of any length.

Lines without a word are skipped. A text without a word, or null, is scored as one line without
features. With one label or none to learn from, every score is the share of label 1 (0.5 without
labels). Repeated rows are scored alike; empty tables give none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import append_columns
from .language_id import remainder

SAMPLE_DOCUMENTS, LONGEST, ROUNDS, PENALTY, LEAST_SCORE = 500, 40_000, 120, 1e-3, 0.7
NAMES = ("length", "letters", "upper", "digits", "symbols", "stops", "other marks", "word length", "distinct words", "same word again", "line seen before", "one")
#: Classes of bytes: 1 lower, 2 upper, 3 digit, 4 symbol, 5 full stop or comma, 6 other mark, 7 non-ASCII, 0 white space.
CLASSES = np.zeros(256, np.uint8)
CLASSES[33:127] = 6
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 1, 2, 3, 7
CLASSES[[ord(c) for c in "#*$%&|<>"]], CLASSES[[ord(c) for c in ".,"]] = 4, 5


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line (with its neighbours'), its text's number, and its length."""
    lines, owner, words, again = [], [], [], []
    for k, text in enumerate(texts):
        seen: set[bytes] = set()
        some = False
        for line in (text or b"").split(b"\n"):
            w = line.split()
            if w:
                some = True
                lines.append(line)
                owner.append(k)
                words.append((len(w), len(set(w)), sum(map(bytes.__eq__, w, w[1:]))))
                again.append(line in seen)
                seen.add(line)
        if not some:
            lines.append(b" ")
            owner.append(k)
            words.append((0, 0, 0))
            again.append(False)
    n, owner_ = len(lines), np.array(owner, np.int64)
    size = np.fromiter(map(len, lines), np.int64, n)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    kinds = CLASSES[np.frombuffer(b"".join(lines), np.uint8)]
    counts = np.stack([np.add.reduceat(kinds == c, at, dtype=np.int64) for c in range(1, 8)], 1) if n else np.zeros((0, 7), np.int64)
    w = np.array(words, np.float64).reshape(n, 3)
    whole, filled = np.maximum(1, size), (w[:, 0] > 0).astype(float)
    own = np.stack([
        np.log1p(size) / 6 * filled, (counts[:, 0] + counts[:, 6]) / whole, counts[:, 1] / whole, counts[:, 2] / whole, counts[:, 3] / whole, counts[:, 4] / whole, counts[:, 5] / whole,
        np.minimum(3, size / np.maximum(1, w[:, 0]) / 8) * filled, w[:, 1] / np.maximum(1, w[:, 0]), w[:, 2] / np.maximum(1, w[:, 0]), np.array(again, float), np.ones(n),
    ], 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = owner_[1:] == owner_[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    return np.concatenate([own, before, after], 1), owner_, size


def chains(owner: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Rows of lines by their place in the text: longest texts first, so each step's rows are a prefix."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    length = np.diff(np.append(first, len(owner)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    steps, live = [], len(first)
    for t in range(int(length[0]) if len(length) else 0):
        while live and length[live - 1] <= t:
            live -= 1
        steps.append((first[:live] + t, live))
    return steps


def forward_backward(scores: np.ndarray, trans: np.ndarray, steps: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line's two states, expected transitions, and the sum of log partition values."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    m = np.exp(trans)
    alpha, scale = np.zeros_like(e), np.ones(len(e))
    for t, (rows, live) in enumerate(steps):
        a = e[rows] * (alpha[steps[t - 1][0][:live]] @ m if t else 1.0)
        scale[rows] = a.sum(1)
        alpha[rows] = a / scale[rows][:, None]
    beta = np.ones_like(e)
    pairs = np.zeros((2, 2))
    for t in range(len(steps) - 1, 0, -1):
        rows, live = steps[t]
        prev = steps[t - 1][0][:live]
        x = e[rows] * beta[rows] / scale[rows][:, None]
        beta[prev] = x @ m.T
        pairs += m * (alpha[prev].T @ x)
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    return gamma, pairs, float(np.log(scale).sum() + scores.max(1).sum())


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def marginal_means(self, texts: list[bytes | None]) -> np.ndarray:
        x, owner, size = line_features(texts)
        s = (x - self.mean) / self.spread @ self.weights
        gamma, _, _ = forward_backward(np.stack([np.zeros(len(s)), s], 1), self.trans, chains(owner))
        return np.bincount(owner, gamma[:, 1] * size, len(texts)) / np.bincount(owner, size, len(texts))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        p = np.clip(self.marginal_means(texts), 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def learn_quality(rows: list[tuple[int, bytes]]) -> QualityModel:
    """From (label, text) pairs."""
    rows = sorted(rows)
    label = np.array([r[0] for r in rows])
    width = 3 * len(NAMES)
    if len(set(label.tolist())) < 2:
        share = np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99)
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    x, owner, _ = line_features([r[1] for r in rows])
    mean, spread = x.mean(0), x.std(0)
    # the constant feature stays; its neighbours say whether there are any
    mean[len(NAMES) - 1], spread[spread < 1e-9] = 0.0, 1.0
    z, y, steps = (x - mean) / spread, label[owner], chains(owner)
    seen = np.zeros((2, 2))
    for t in range(1, len(steps)):
        rows_, live = steps[t]
        np.add.at(seen, (y[steps[t - 1][0][:live]], y[rows_]), 1)
    w, trans, n = np.zeros(width), np.zeros((2, 2)), len(y)
    moments = [np.zeros(width), np.zeros(width), np.zeros((2, 2)), np.zeros((2, 2))]
    for k in range(1, ROUNDS + 1):
        s = z @ w
        gamma, pairs, _ = forward_backward(np.stack([np.zeros(n), s], 1), trans, steps)
        gw, gt = z.T @ (y - gamma[:, 1]) / n - PENALTY * w, (seen - pairs) / n - 0.02 * trans
        for at, g in ((0, gw), (2, gt)):
            moments[at] = 0.9 * moments[at] + 0.1 * g
            moments[at + 1] = 0.99 * moments[at + 1] + 0.01 * g * g
        step = lambda at: 0.08 * (moments[at] / (1 - 0.9**k)) / (np.sqrt(moments[at + 1] / (1 - 0.99**k)) + 1e-8)  # noqa: E731, B023
        w, trans = w + step(0), trans + step(2)
    model = QualityModel(mean, spread, w, trans, 1.0, 0.0)
    p = np.clip(model.marginal_means([r[1] for r in rows]), 1e-9, 1 - 1e-9)
    odds = np.log(p / (1 - p))
    slope, shift = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-(slope * odds + shift)))
        h = np.maximum(q * (1 - q), 1e-6)
        hessian = np.array([[(h * odds * odds).sum() + 1, (h * odds).sum()], [(h * odds).sum(), h.sum() + 1]])
        move = np.linalg.solve(hessian, [((label - q) * odds).sum() - (slope - 1), (label - q).sum() - shift])
        slope, shift = max(0.05, slope + 0.5 * move[0]), shift + 0.5 * move[1]
    return QualityModel(mean, spread, w, trans, float(slope), float(shift))


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[int, bytes]]:
    """At most SAMPLE_DOCUMENTS texts of each label, by hash, of documents that may be learnt from."""
    hashed = F.xxhash64(F.lit(6), "i")
    known = labels.select(labels[id_col].alias("i"), labels[label_col].cast("int").alias("q")).filter((remainder(F.col("i"), 4) != 2) & F.col("q").isin(0, 1))
    picked = known.groupBy("q", F.pmod(hashed, F.lit(SAMPLE_DOCUMENTS)).alias("b")).agg(F.min(F.struct(hashed.alias("h"), F.col("i").alias("i"))).alias("o"))
    ids = [(r.q, r.i) for r in picked.select("q", "o.i").collect()]
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame(ids, "q int, wi " + known.schema["i"].dataType.simpleString())
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("x")).filter(F.octet_length("x") <= LONGEST)
    found = rows.join(F.broadcast(wanted), F.col("i") == F.col("wi")).groupBy("q", "i").agg(F.min("x").alias("x"))
    return [(r.q, r.x.encode()) for r in found.collect()]


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of docs, score (label 1 likelier if higher) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        s = shared.value.scores(texts)
        return [pa.array(s), pa.array((s >= LEAST_SCORE).astype(np.int32))]

    return append_columns(docs, text_col, fields, compute, keep)
