"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from features of itself and of its neighbours; the marginals of the forward-backward
recursion, weighted by line length, make the document's quality, which a logistic map fitted on the same training rows
turns into a probability. Each line of a labelled document takes the document's label.

The model is fitted on at most TRAIN_ROWS labelled documents, those of smallest hash of their id, never on held-out rows
(crc32 of the id as text, modulo 4, is 2). Scoring reads whole texts, a megabyte of text at a time.

Defined cases: a null text is empty; a text without words has no line and scores the share of good rows in training;
repeated rows each get their row; a null id is not held out; labels given twice count by the smaller; without labelled
rows of both kinds every score is 0.5; an empty table gives an empty one; only the columns named are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import chunks, mix64, powers, utf8, word_hashes
from cairn.session import materialise

TRAIN_ROWS = 4000
#: Lines of these documents at most: about a hundred bytes each on the driver.
TRAIN_LINES = 500_000
THRESHOLD = 0.7

_KIND = np.zeros(256, np.int64)  # 0: symbols
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_KIND[list(b"0123456789")] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[list(b".,;:?'\"()-")] = 5
_KIND[128:] = 6
_NEIGHBOUR = (0, 1, 4, 6, 8, 9, 10)
OWN = 14
FEATURES = OWN + 2 * (len(_NEIGHBOUR) + 1)


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, offsets of each text's lines); lines without words are left out."""
    base = int(at[0])
    data, at = data[base : int(at[-1])], at - base
    none = np.zeros((0, FEATURES)), np.zeros(0), np.zeros(len(at), np.int64)
    if not len(data):
        return none
    begin = np.unique(np.concatenate([at[:-1][at[:-1] < len(data)], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < len(data)]
    edge = np.append(begin, len(data))
    hashes, bounds = word_hashes(data, edge)
    words = np.diff(bounds)
    full = np.flatnonzero(words > 0)
    if not len(full):
        return none
    lens = np.diff(edge)
    line = np.repeat(np.arange(len(begin)), lens)
    count = np.bincount(line * 7 + _KIND[data], minlength=7 * len(begin)).reshape(-1, 7)[full].astype(np.float64)
    text_of = np.searchsorted(at, begin[full], side="right") - 1
    new_id = np.cumsum(words > 0) - 1
    word_line = np.repeat(np.arange(len(begin)), words)
    n_words, size = words[full].astype(np.float64), lens[full].astype(np.float64)
    _, firsts = np.unique(hashes ^ mix64(word_line.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(new_id[word_line[firsts]], minlength=len(full)) / n_words
    pair = np.flatnonzero((word_line[1:] == word_line[:-1]) & (hashes[1:] == hashes[:-1]))
    stutter = np.bincount(new_id[word_line[pair]], minlength=len(full)) / n_words
    starts = bounds[:-1][full]
    within = np.arange(len(hashes)) - np.repeat(starts, words[full])
    whole = mix64(np.add.reduceat(hashes * powers(int(words.max()))[within], starts)) ^ mix64(text_of.astype(np.uint64) + np.uint64(7))
    _, inverse, times = np.unique(whole, return_inverse=True, return_counts=True)
    repeated = (times[inverse] > 1).astype(np.float64)
    # words that the text has already had in earlier lines
    text_word = hashes ^ mix64(np.repeat(text_of, words[full]).astype(np.uint64) + np.uint64(3))
    fresh = np.zeros(len(hashes))
    fresh[np.unique(text_word, return_index=True)[1]] = 1.0
    novel = np.add.reduceat(fresh, starts) / n_words
    letters = count[:, 1] + count[:, 2] + count[:, 6]
    solid = np.maximum(1.0, size - count[:, 4])
    own = np.column_stack(
        [
            np.log1p(size) / 5,
            count[:, 0] / solid,
            letters / solid,
            count[:, 3] / solid,
            count[:, 2] / np.maximum(1.0, count[:, 1] + count[:, 2]),
            count[:, 5] / solid,
            solid / n_words / 10,
            np.log1p(n_words) / 4,
            distinct,
            repeated,
            stutter,
            novel,
            (count[:, 0] / n_words > 0.5).astype(np.float64),
            (count[:, 1] + count[:, 6] < count[:, 2]).astype(np.float64),
        ]
    )
    offsets = np.searchsorted(text_of, np.arange(len(at)))
    side = np.column_stack([own[:, _NEIGHBOUR], np.ones(len(full))])
    before, after = np.zeros_like(side), np.zeros_like(side)
    same = text_of[1:] == text_of[:-1]
    before[1:][same] = side[:-1][same]
    after[:-1][same] = side[1:][same]
    return np.column_stack([own, before, after]), size, offsets


def _step(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of a line after a neighbour with log odds ``x``; t[i, j]: from i to j."""
    return np.logaddexp(t[1, 1] + x, t[0, 1]) - np.logaddexp(t[1, 0] + x, t[0, 0])


def chain(e: np.ndarray, offsets: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of all lines of all documents, place by place over all documents at once."""
    forward, backward = e.copy(), np.zeros_like(e)
    lens = np.diff(offsets)
    order = np.argsort(-lens, kind="stable")
    first, lens = offsets[:-1][order], lens[order]
    for k in range(1, int(lens[0]) if len(lens) else 0):
        at = first[: np.searchsorted(-lens, -k)] + k
        forward[at] += _step(forward[at - 1], t)
    for k in range(int(lens[0]) - 2 if len(lens) else -1, -1, -1):
        at = first[: np.searchsorted(-lens, -(k + 1))] + k
        backward[at] = _step(e[at + 1] + backward[at + 1], t.T)
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, and a constant at the end
    transitions: np.ndarray
    slope: float
    shift: float
    prior: float

    def document_scores(self, features: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.prior)
        if len(features):
            e = ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
            f, b = chain(e, offsets, self.transitions)
            good = _sigmoid(f + b)
            have = np.flatnonzero(np.diff(offsets) > 0)
            starts = offsets[:-1][have]
            share = np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts)
            share = np.clip(share, 1e-4, 1 - 1e-4)
            out[have] = _sigmoid(self.slope * np.log(share / (1 - share)) + self.shift)
        return out


def fit(features: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, labels: np.ndarray, steps: int = 250, decay: float = 1e-3) -> Model:
    """Maximum conditional likelihood of the line labels by full-batch gradient ascent with adaptive steps."""
    prior = float(np.mean(labels)) if len(labels) else 0.5
    if not len(features) or prior in (0.0, 1.0):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), np.zeros((2, 2)), 0.0, 0.0, 0.5)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.column_stack([(features - mean) / scale, np.ones(len(features))])
    lens = np.diff(offsets)
    y = np.repeat(labels.astype(np.float64), lens)
    # a document counts once, and both labels alike
    weight = np.repeat(1.0 / np.maximum(1, lens), lens) * np.where(y > 0, 0.5 / prior, 0.5 / (1 - prior)) / len(lens)
    inner = np.ones(len(x), bool)
    inner[offsets[:-1][lens > 0]] = False
    cur = np.flatnonzero(inner)
    both = y[cur] * y[cur - 1]
    theta, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        e, t = x @ theta[:-4], theta[-4:].reshape(2, 2)
        f, b = chain(e, offsets, t)
        grad = np.concatenate([x.T @ (weight * (y - _sigmoid(f + b))), np.zeros(4)])
        right = e[cur] + b[cur]
        logs = np.stack([t[0, 0] + 0 * right, t[0, 1] + right, t[1, 0] + f[cur - 1], t[1, 1] + f[cur - 1] + right])
        p = np.exp(logs - logs.max(axis=0))
        p /= p.sum(axis=0)
        seen = np.stack([(1 - y[cur]) * (1 - y[cur - 1]), y[cur] - both, y[cur - 1] - both, both])
        grad[-4:] = ((seen - p) * weight[cur]).sum(axis=1)
        grad -= decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0, prior)
    raw = model.document_scores(features, sizes, offsets)
    have = lens > 0
    z, target, c = np.log(raw[have] / (1 - raw[have])), labels[have].astype(np.float64), np.zeros(2)
    for _ in range(50):  # Newton steps of a logistic regression on one number
        p = _sigmoid(c[0] * z + c[1])
        g = np.array([np.sum((target - p) * z), np.sum(target - p)]) - 1e-3 * c
        w = p * (1 - p) + 1e-9
        h = np.array([[np.sum(w * z * z), np.sum(w * z)], [np.sum(w * z), np.sum(w)]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        c = c + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), float(c[0]), float(c[1]), prior)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> Model:
    """Fits on the ``rows`` labelled documents of smallest hash; only their features reach the driver.

    Of these, documents of more than a tenth of ``lines`` are left out, and as many of the others are taken as have ``lines``
    lines together, so what reaches the driver is bounded in rows and in bytes.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null and not " + "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def features(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            label_of = batch.column(0).to_pylist()
            for i, j in chunks(at):
                x, size, lines = line_features(data, at[i : j + 1])
                cells = [(label_of[i + k], x[a:b].astype(np.float32).tobytes(), size[a:b].tobytes()) for k, (a, b) in enumerate(zip(lines[:-1], lines[1:], strict=True))]
                yield pa.RecordBatch.from_pydict({"label": pa.array([c[0] for c in cells], pa.int32()), "x": pa.array([c[1] for c in cells], pa.binary()), "size": pa.array([c[2] for c in cells], pa.binary())})

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sized = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("n"), F.max("label").alias("label")).where(F.col("n") * 10 <= lines)
    together = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of ``rows`` rows at most
    known = materialise(sized.withColumn("_sum", together).where(F.col("_sum") <= lines).select("doc_id", "label"), "training-rows")
    sample = texts.join(F.broadcast(known), "doc_id").select(F.col("label").cast("int").alias("label"), "text")  # ``rows`` rows of two numbers
    got = sample.mapInArrow(features, "label int, x binary, size binary").toPandas()
    got = got.iloc[np.argsort([hash_bytes(b) for b in got["x"]], kind="stable")] if len(got) else got  # an order of their own
    xs = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["x"]]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    empty = np.zeros((0, FEATURES))
    return fit(np.concatenate([empty, *xs]), np.concatenate([np.zeros(0), *(np.frombuffer(b, np.float64) for b in got["size"])]), offsets, got["label"].to_numpy(dtype=np.float64))


def hash_bytes(b: bytes) -> int:
    import zlib

    return zlib.crc32(b)


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(2))
            out = np.full(batch.num_rows, model.prior)
            for i, j in chunks(at):
                out[i:j] = model.document_scores(*line_features(data, at[i : j + 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
