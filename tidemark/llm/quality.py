"""Quality classifier by positive-unlabelled learning.

Positives are trusted: training rows whose label is 1.  Unlabelled is web text of the
training rows, labels unseen.  A small network g on shape features of whole texts
minimises the non-negative unbiased risk
    p R_P(g, +1) + max(0, R_U(g, -1) - p R_P(g, -1))
with the logistic loss.  The class prior p is estimated from the same two samples: a first
network ranks held-back positives and unlabelled texts, and p is the least ratio, over
thresholds, of the share of unlabelled to the share of positive texts above it, with a
slack for sample size (best-bin estimation).

Both samples are bounded (``positives`` and ``unlabelled`` rows, drawn by a hash of the
id).  Defined results: a null text counts as empty; an empty text has a score; without
positives every score is 0.5; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import bounded, held_out, ship, training_rows
from tidemark.llm.textcodes import codes, drawn, runs

#: Characters that share a class; letters, digits and spaces have their own.
MARKS = (".,", "!", "?", "#$%&*@^~", "|", "\"'`", "()[]{}<>", "-_/\\+=", ":;")
SPACE, BREAK, LOWER, UPPER, DIGIT, OTHER = 0, 1, 2, 3, 4, 5
KINDS = 6 + len(MARKS)


def _kinds() -> np.ndarray:
    table = np.full(1 << 16, OTHER, np.int16)
    for i in range(1 << 16):
        ch = chr(i)
        if ch.isspace():
            table[i] = BREAK if ch == "\n" else SPACE
        elif ch.isalpha():
            table[i] = UPPER if ch.isupper() else LOWER
        elif ch.isdigit():
            table[i] = DIGIT
    for k, group in enumerate(MARKS):
        table[[ord(ch) for ch in group]] = 6 + k
    return table


_KINDS: list[np.ndarray] = []
WIDTH = KINDS + KINDS * KINDS + 129 + 9


def features(texts: list[str]) -> np.ndarray:
    """Shape features: shares of character kinds, of pairs of kinds and of ASCII
    characters, word and line lengths, repetition."""
    if not _KINDS:
        _KINDS.append(_kinds())
    out = np.zeros((len(texts), WIDTH), np.float32)
    for start, part in runs(texts, 1 << 18):
        out[start : start + len(part)] = _features(part, _KINDS[0])
    return out


def _features(texts: list[str], table: np.ndarray) -> np.ndarray:
    c, owner = codes(texts)
    n = len(texts)
    size = np.maximum(np.bincount(owner, minlength=n), 1).astype(np.float64)
    kind = np.where(c < 1 << 16, table[np.minimum(c, (1 << 16) - 1)], OTHER).astype(np.int64)
    owner = owner.astype(np.int64)
    single = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS) / size[:, None]
    ascii_ = np.bincount(owner * 129 + np.minimum(c, 128), minlength=n * 129).reshape(n, 129) / size[:, None]
    same = owner[1:] == owner[:-1]
    pair = (owner[:-1] * KINDS + kind[:-1]) * KINDS + kind[1:]
    double = np.bincount(pair[same], minlength=n * KINDS * KINDS).reshape(n, -1) / size[:, None]
    # Words: stretches without white space; a word's hash sums its characters by place.
    solid = kind > BREAK
    first = solid.copy()
    first[1:] &= ~(solid[:-1] & same)
    at = np.flatnonzero(first)
    rest = np.zeros((n, 9))
    rest[:, 8] = np.log1p(size)
    if len(at):
        holder = owner[at]
        words = np.maximum(np.bincount(holder, minlength=n), 1).astype(np.float64)
        word = np.cumsum(first)[solid] - 1
        letters = c[solid].astype(np.uint64)
        place = (np.flatnonzero(solid) - at[word]).astype(np.uint64)
        length = np.bincount(word, minlength=len(at))
        mixed = (letters + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) * (np.uint64(2) * place + np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        name = np.add.reduceat(mixed, np.flatnonzero(first[solid]))
        again = (name[1:] == name[:-1]) & (holder[1:] == holder[:-1])
        order = np.lexsort((name, holder))
        fresh = np.ones(len(at), bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]) | (holder[order][1:] != holder[order][:-1])
        rest[:, 0] = np.bincount(holder, weights=length, minlength=n) / words / 10
        rest[:, 1] = np.bincount(holder, weights=length > 12, minlength=n) / words
        rest[:, 2] = np.bincount(holder, weights=length == 1, minlength=n) / words
        rest[:, 3] = np.bincount(holder[1:], weights=again, minlength=n) / words
        distinct = np.bincount(holder[order], weights=fresh, minlength=n)
        rest[:, 4] = distinct / words
        rest[:, 5] = np.log1p(words) - np.log1p(distinct)
        rest[:, 6] = words / size
        rest[:, 7] = np.log1p(words)
    return np.c_[single, double, ascii_, rest]


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32)

    def output(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.maximum(self.scaled(x) @ w1 + b1, 0) @ w2 + b2)[:, 0]


def risk_step(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the non-negative risk by the outputs on positives and unlabelled.

    Where the estimated negative risk falls below 0, the step goes back up its slope.
    """
    up = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    soft = lambda g: np.logaddexp(0, g)
    negative = soft(gu).mean() - prior * soft(gp).mean()
    dp, du = -prior * up(-gp) / len(gp), up(gu) / len(gu)
    back = -prior * up(gp) / len(gp)
    return (dp + back, du) if negative >= 0 else (-back, -du)


def train_network(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1500, hidden: int = 32, batch: int = 256, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(u.mean(axis=0), u.std(axis=0) + 1e-3, [])
    width = p.shape[1]
    net.layers = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)).astype(np.float32), np.zeros(1, np.float32)]
    p, u = net.scaled(p), net.scaled(u)
    m, v = [np.zeros_like(w) for w in net.layers], [np.zeros_like(w) for w in net.layers]
    for t in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), 2 * batch)]
        x = np.concatenate([xp, xu])
        w1, b1, w2, b2 = net.layers
        h = np.maximum(x @ w1 + b1, 0)
        g = (h @ w2 + b2)[:, 0].astype(np.float64)
        d = np.concatenate(risk_step(g[:batch], g[batch:], prior))[:, None].astype(np.float32)
        dh = (d @ w2.T) * (h > 0)
        slopes = [x.T @ dh + 1e-4 * w1, dh.sum(axis=0), h.T @ d + 1e-4 * w2, d.sum(axis=0)]
        rate = 3e-3 * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, s in enumerate(slopes):
            m[k] += 0.1 * (s - m[k])
            v[k] += 0.001 * (s * s - v[k])
            net.layers[k] = net.layers[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate of the share of positives among the unlabelled texts, from the
    outputs on held-back rows of both."""
    cuts = np.quantile(p, np.linspace(0.02, 1, 99))[::-1]
    above_p = np.array([(p >= c).mean() for c in cuts])
    above_u = np.array([(u >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / delta) / (2 * len(p))) + np.sqrt(np.log(4 / delta) / (2 * len(u)))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> tuple[Network, float] | None:
    if len(p) < 4 or len(u) < 4:
        return None
    even_p, even_u = np.arange(len(p)) % 2 == 0, np.arange(len(u)) % 2 == 0
    ranker = train_network(p[even_p], u[even_u], 0.5, steps=600)
    prior = estimate_prior(ranker.output(p[~even_p]), ranker.output(u[~even_u]))
    net = train_network(p, u, prior)
    net.layers[3] = net.layers[3] - np.float32(decision_point(net.output(p), net.output(u), prior))
    return net, prior


def decision_point(p: np.ndarray, u: np.ndarray, prior: float, least: float = 0.0005, most: float = 0.004) -> float:
    """The output that parts the classes: as many unlabelled texts lie above it as the
    prior says, but it costs between ``least`` and ``most`` of the trusted positives.

    The clipped risk stops telling apart negatives once its estimate reaches 0, which
    leaves the network's own zero too low; the order of its outputs isn't affected.
    """
    return float(np.clip(np.quantile(u, 1 - prior), np.quantile(p, least), np.quantile(p, most)))


def feature_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, features) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            x = features([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "x"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


def train(documents: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> tuple[Network, float] | None:
    """Fit on bounded samples; features are made on the executors."""
    ship(documents.sparkSession)
    rows = documents.select("doc_id", "text").where(training_rows("doc_id", 3, 1) & F.col("doc_id").isNotNull())
    trusted = labels.where((F.col("quality") == 1) & training_rows("doc_id", 3, 1)).select("doc_id").distinct()
    trusted = drawn(trusted, "doc_id", positives)  # bounded by ``positives``, so it may be broadcast
    web = drawn(rows, "doc_id", unlabelled)
    matrix = lambda df: (lambda t: np.array(t["x"].tolist(), np.float32).reshape(len(t), WIDTH))(feature_rows(df).toPandas().sort_values("doc_id", kind="stable"))
    return fit(matrix(rows.join(F.broadcast(trusted), "doc_id")), matrix(web))


def score(documents: DataFrame, model: tuple[Network, float] | None) -> DataFrame:
    """All columns of ``documents`` with ``held_out``, ``score`` and ``predicted``.

    Columns of these names in the input are replaced.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    given = documents.select(*[c for c in documents.columns if c not in ("held_out", "score", "predicted")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in bounded(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            g = fitted[0].output(features(texts)) if fitted else np.zeros(len(texts))
            value = 1 / (1 + np.exp(-np.clip(g.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, "score"])

    scored = given.mapInArrow(run, f"{fields}, score double")
    return scored.withColumns({"held_out": held_out("doc_id", 3, 1), "predicted": (F.col("score") >= 0.5).cast("int")})


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(documents, labels)
    return score(documents.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")
