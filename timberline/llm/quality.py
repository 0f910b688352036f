"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features and those of its neighbours; the marginals of
forward-backward, weighted by line length, give the document's share of good text, and a logistic curve fitted on the
training documents turns that share into a score.

Rows: null and empty texts count as one empty line and get a score like any other; repeated rows get equal scores; a
null doc_id is kept and not held out; an empty table gives an empty one; only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship

CLASSES = 16
# byte classes: 0 control and line end, 1 lower, 2 upper, 3 digit, 4 space, 5 prose punctuation, 6 exclamation,
# 7 symbols, 8 bars, 9 beyond ASCII, 10 brackets and the rest
CLASS_OF = np.full(256, 10, np.uint8)
CLASS_OF[:32] = 0
for _chars, _c in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t", 4), (b".,;:'\"-()?", 5), (b"!", 6), (b"#$%&*@^~+=<>/\\", 7), (b"|", 8)):
    CLASS_OF[list(_chars)] = _c
CLASS_OF[128:] = 9
CHUNK = 8 << 20
SLICE, LINES = 1 << 20, 1 << 16


def own_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line by itself, first line of each text and the end, bytes of each line). Bytes are classified
    SLICE at a time, so that memory beside the text goes with its lines."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    sizes = np.diff(ends, prepend=-1)
    first = np.concatenate([[0], np.cumsum([t.count(b"\n") + 1 for t in texts])]).astype(np.int64)
    n, words = np.zeros((len(ends), CLASSES)), np.zeros(len(ends))
    apart = True  # whether the byte before separates words
    for a in range(0, len(buf), SLICE):
        cls = CLASS_OF[buf[a : a + SLICE]]
        i, z = np.searchsorted(ends, [a, a + len(cls) - 1])
        edges = np.concatenate([[0], ends[i:z] + 1 - a, [len(cls)]])
        line = np.repeat(np.arange(z - i + 1), np.diff(edges))
        n[i : z + 1] += np.bincount(line * CLASSES + cls, minlength=(z - i + 1) * CLASSES).reshape(-1, CLASSES)
        gap = (cls == 0) | (cls == 4)
        begins = ~gap & np.concatenate([[apart], gap[:-1]])
        words[i : z + 1] += np.bincount(line[begins], minlength=z - i + 1)
        apart = bool(gap[-1])
    length = sizes - 1.0
    some, letters = np.maximum(length, 1), np.maximum(n[:, 1] + n[:, 2], 1)
    share = lambda *c: sum(n[:, i] for i in c) / some
    last = buf[np.maximum(ends - 1, 0)]
    own = np.column_stack([
        share(7), share(6), share(8), share(3), share(10), share(5), share(9), share(4), n[:, 2] / letters,
        np.minimum(length / np.maximum(words, 1), 30) / 10, np.log1p(length), length == 0,
        share(7) > 0.03, share(6) > 0.03, share(8) > 0.02, share(3) > 0.2, n[:, 2] / letters > 0.5, np.isin(last, list(b".!?\"")),
    ]).astype(np.float32)
    return own, first, length


def with_neighbours(own: np.ndarray, first: np.ndarray, a: int, z: int) -> np.ndarray:
    """Features of lines a to z and their neighbours of the same text, with marks of its first and last line."""
    rows = np.arange(a, z)
    head, tail = np.isin(rows, first[:-1]), np.isin(rows + 1, first[1:])
    before, after = own[np.maximum(rows - 1, 0)], own[np.minimum(rows + 1, len(own) - 1)]
    before[head], after[tail] = 0, 0
    return np.hstack([own[a:z], before, after, head[:, None], tail[:, None]])


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line and its neighbours, first line of each text and the end, bytes of each line)."""
    own, first, length = own_features(texts)
    return with_neighbours(own, first, 0, len(own)), first, length


def marginals(unary: np.ndarray, turn: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once. unary: log weight of good; turn: 2 x 2 log weights of neighbours.
    Returns P(good) of each line, the summed P of each pair of neighbouring labels, and the sum of log Z."""
    lines = np.diff(first)
    order = np.argsort(-lines, kind="stable")
    at, count = first[:-1][order], lines[order]
    u = np.column_stack([np.zeros(len(unary)), unary])
    a, b = u.copy(), np.zeros_like(u)
    live = np.searchsorted(-count, -np.arange(int(count.max(initial=0))), "left")
    for t in range(1, len(live)):
        i = at[: live[t]] + t
        a[i] = u[i] + np.logaddexp(a[i - 1, :1] + turn[0], a[i - 1, 1:] + turn[1])
    for t in range(len(live) - 1, 0, -1):
        i = at[: live[t]] + t
        x = u[i] + b[i]
        b[i - 1] = np.logaddexp(x[:, :1] + turn[:, 0], x[:, 1:] + turn[:, 1])
    ends = first[1:] - 1
    logz = np.logaddexp(a[ends, 0], a[ends, 1])
    z = np.repeat(logz, lines)
    good = np.exp(a[:, 1] + b[:, 1] - z)
    inner = np.ones(len(u), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    pairs = np.exp(a[j - 1][:, :, None] + turn[None] + (u[j] + b[j])[:, None, :] - z[j][:, None, None]).sum(0) if len(j) else np.zeros((2, 2))
    return good, pairs, float(logz.sum())


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    turn: np.ndarray
    curve: tuple[float, float]

    def shares(self, own: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of each text the share of good bytes. Features of neighbours are put together for LINES lines at a time."""
        unary = np.concatenate([((with_neighbours(own, first, a, min(a + LINES, len(own))) - self.mean) / self.scale) @ self.weight + self.bias for a in range(0, len(own), LINES)])
        w = np.maximum(length, 1)
        return np.add.reduceat(marginals(unary, self.turn, first)[0] * w, first[:-1]) / np.add.reduceat(w, first[:-1])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, part, used = [], [], 0
        for t in texts:
            part.append(t)
            used += len(t)
            if used >= CHUNK:
                out.append(self.shares(*own_features(part)))
                part, used = [], 0
        if part:
            out.append(self.shares(*own_features(part)))
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * np.concatenate(out or [np.empty(0)]) + b)))


def ascend(x: np.ndarray, y: np.ndarray, first: np.ndarray, w: np.ndarray, bias: float, turn: np.ndarray, steps: int, l2: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Adam on the conditional log likelihood of the line labels y."""
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[j - 1], y[j]), 1)
    p, m, v = np.concatenate([w, [bias], turn.ravel()]), 0.0, 0.0
    for k in range(1, steps + 1):
        good, pairs, _ = marginals(x @ p[:-5] + p[-5], p[-4:].reshape(2, 2), first)
        g = np.concatenate([x.T @ (y - good), [(y - good).sum()], (seen - pairs).ravel()]) / len(y) - l2 * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return p[:-5], float(p[-5]), p[-4:].reshape(2, 2)


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 3000, max_bytes: int = 200_000, max_total: int = 32 << 20, steps: int = 120) -> Model:
    """Fits on at most max_documents labelled rows outside the held-out fold, crc32(doc_id as text) mod 4 = 2: those of
    the least hash, without texts of more than max_bytes, until they come to max_total bytes. The three bounds hold
    whatever the tables' sizes. A doc_id that repeats counts once, with its greatest label and its text of least hash.
    Lines start with their document's label; after a first fit, lines of bad documents that look good are relabelled and
    the fit is repeated."""
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    texts = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).filter(F.octet_length("text") <= max_bytes)
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))).alias("one")).select("doc_id", "quality", "one.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total = np.cumsum([r.n for r in sizes])
    picked = [(r.doc_id, r.quality, r.h) for r, t in zip(sizes, total) if t <= max_total]
    wanted = spark.createDataFrame(picked, T.StructType([docs.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("h", T.LongType())]))
    met = texts.join(F.broadcast(wanted), "doc_id").filter(F.xxhash64("text") == F.col("h")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    rows = sorted(met.collect(), key=lambda r: (r.doc_id, bytes(r.text)))
    labels = np.array([int(r.quality > 0) for r in rows])
    if len(set(labels.tolist())) < 2:  # nothing to learn from: one score for all
        n = 3 * 18 + 2
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(n), np.ones(n), np.zeros(n), 0.0, np.zeros((2, 2)), (0.0, float(np.log((share + 0.01) / (1.01 - share)))))
    own, first, length = own_features([bytes(r.text) for r in rows])
    x = with_neighbours(own, first, 0, len(own))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    y = np.repeat(labels, np.diff(first))
    w, bias, turn = ascend(x, y, first, np.zeros(x.shape[1]), 0.0, np.zeros((2, 2)), steps)
    alone = x @ w + bias
    y2 = np.where((y == 0) & (alone > 1.0), 1, y)
    w, bias, turn = ascend(x, y2, first, w, bias, turn, steps)
    model = Model(mean, scale, w, bias, turn, (1.0, 0.0))
    s = model.shares(own, first, length)
    a, b = 0.0, 0.0
    for _ in range(200):  # Newton's steps on the curve, with a little ridge
        q = 1 / (1 + np.exp(-(a * s + b)))
        r, h = labels - q, q * (1 - q) + 1e-6
        hess = np.array([[(h * s * s).sum() + 0.01, (h * s).sum()], [(h * s).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, np.array([(r * s).sum() - 0.01 * a, r.sum() - 0.01 * b]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, bias, turn, (float(a), float(b)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(arrow, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores([(t or "").encode() for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
