"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Counts: every task adds up its training words, so what is gathered grows with the text.
The head, the ``head`` most frequent training words, are classes of their own; every other
word belongs to one of ``tails`` classes by its last two bytes and stands in it with
probability (c + 1) / (N_class + V_class + 1), one share being left for the words that
training never met.  A text's end is a class too.

Model: the vector predicted after the classes y, x is r_x C1 + r_y C2, a class w is as likely
as exp(predicted . q_w + b_w).  Vectors and position matrices are trained in numpy with
noise-contrastive estimation, the noise being the unigrams of the classes over all training
tokens.  Every training token is an example (y, x, w).  The training texts are dealt to rounds
by a hash: one learner goes several times through the first, about ``per_root`` times the square
root of the training tokens or all of up to ``LEAST``, ``most_examples`` at most; each further round is as large as all
before it and dealt to learners, tasks that start from the same network and go once through
their texts; what they arrive at is averaged by their numbers of tokens.  Rounds, learners and
the order within them follow from ids and texts alone, so partitions don't change the network.
Energies are sums of a term for each position, so the normalisers of all contexts are one
matrix product of their exponentials, and a token's log-probability is three lookups:
position one, position two, normaliser.

Head words are counted in Python; what a text holds of other words is joined with the
count table on the word, without a broadcast of it, unless the table is small.

Defined results: null counts as an empty text, whose only token is its end; very long
texts are read whole; without training rows N is 0 and every token is unseen; repeated
rows with one doc_id get each their own result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import bounded, dropped, held_out, ship, stored, training_rows

END = b""  # no word is empty
BLOCK = 1 << 20  # examples that a learner of a further round shuffles and learns at once
LEARNERS = 32
LEAST = 400 * 4096  # examples that a first learner goes on to, however few different ones there are
PASSES = 2
PLACES = 1 << 30  # of texts, which rounds are cut from


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only


@dataclass
class Classes:
    """Class numbers of words: 0 the end, then the head, then the tails.

    ``index`` numbers the most frequent words, the head first; any other word's class
    follows from its last two bytes alone.
    """

    index: dict[bytes, int]
    class_of: np.ndarray
    head: int
    tails: int

    @classmethod
    def of(cls, ranked: list[bytes], head: int, tails: int) -> Classes:
        head = min(head, len(ranked))
        numbers = [i + 1 if i < head else 1 + head + zlib.crc32(w[-2:]) % tails for i, w in enumerate(ranked)]
        return cls({w: i for i, w in enumerate(ranked)}, np.array(numbers, np.int64), head, tails)

    @property
    def size(self) -> int:
        return 1 + self.head + self.tails

    def numbers(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of every token, -1 where it has none; class of every token and the end)."""
        get = self.index.get
        at = np.array([get(w, -1) for w in tokens], np.int64)
        out = np.zeros(len(tokens) + 1, np.int64)
        known = at >= 0
        out[:-1][known] = self.class_of[at[known]]
        first, tails = 1 + self.head, self.tails
        rest = np.flatnonzero(~known)
        out[rest] = [first + zlib.crc32(tokens[i][-2:]) % tails for i in rest.tolist()]
        return at, out


def word_counts(documents: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, c): training tokens; the end is the empty word.  A task hands on at most
    about ``most`` partial counts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in bounded(batches, "text"):
            for text in batch.column("text").to_pylist():
                seen.update(words(text))
                seen[END] += 1
                if len(seen) > most:
                    yield flushed(seen)
                    seen = Counter()
        if seen:
            yield flushed(seen)

    def flushed(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    rows = documents.where(training_rows("doc_id", 7, 2)).select("text")
    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def sequences(documents: DataFrame, classes: Classes) -> DataFrame:
    """(key, tokens, classes): the class numbers of every training text, its end too, behind the
    two ends that it stands after; ``key`` is a hash that deals texts out."""
    shared = documents.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = shared.value
        kind = number_type(k.size)
        for batch in bounded(batches, "text"):
            found = [k.numbers(words(text))[1] for text in batch.column("text").to_pylist()]
            data = [np.concatenate([[0, 0], n]).astype(kind).tobytes() for n in found]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(n) for n in found], pa.int64()), pa.array(data, pa.binary())], names=["key", "tokens", "classes"])

    rows = documents.where(training_rows("doc_id", 7, 2)).select(F.xxhash64("doc_id", "text").alias("key"), "text")
    return rows.mapInArrow(run, "key long, tokens long, classes binary")


def number_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def examples(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, w) of every token of some sequences."""
    joined, there = np.concatenate(parts), np.ones(sum(map(len, parts)), bool)
    starts = np.cumsum([0, *map(len, parts[:-1])])
    there[starts] = there[starts + 1] = False
    return joined[:-2][there[2:]], joined[1:-1][there[2:]], joined[there]


@dataclass
class Network:
    """Class vectors r and q, biases b, and the matrices of the two positions."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c1: np.ndarray
    c2: np.ndarray

    def energies(self) -> tuple[np.ndarray, np.ndarray]:
        """What the nearer and the farther context class add to each class's energy."""
        return self.r @ self.c1 @ self.q.T + self.b, self.r @ self.c2 @ self.q.T

    def normalisers(self) -> np.ndarray:
        """Log of the sum of exp(energy) for each nearer (rows) and farther class."""
        one, two = (e.astype(np.float64) for e in self.energies())
        most = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
        return np.log(np.maximum(np.exp(one - most[0]) @ np.exp(two - most[1]).T, 1e-300)) + most[0] + most[1].T


class Learning:
    """A network under way, with its Adagrad sums and the noise that it is told from."""

    def __init__(self, unigram: np.ndarray, width: int = 32, noise: int = 24, seed: int = 11) -> None:
        rng, size = np.random.default_rng(seed), len(unigram)
        unigram = (unigram + 0.5) / (unigram + 0.5).sum()
        self.noise, self.noise_ends, self.log_noise = noise, np.cumsum(unigram), np.log(unigram).astype(np.float32)
        make = lambda: rng.normal(0, 0.1, (size, width)).astype(np.float32)
        self.network = Network(make(), make(), self.log_noise.copy(), np.eye(width, dtype=np.float32), 0.5 * np.eye(width, dtype=np.float32))
        self.sums = {k: np.full(getattr(self.network, k).shape, 1e-3, np.float32) for k in ("r", "q", "b", "c1", "c2")}

    def arrays(self) -> list[np.ndarray]:
        return [*(getattr(self.network, k) for k in self.sums), *self.sums.values()]

    def state(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def resume(self, state: np.ndarray) -> None:
        at = 0
        for a in self.arrays():
            a[...] = state[at : at + a.size].reshape(a.shape)
            at += a.size

    def learn(self, y: np.ndarray, x: np.ndarray, t: np.ndarray, rng: np.random.Generator, rate, batch: int = 4096, passes: int = 1, least: int = 0) -> None:
        """Go ``passes`` times through all examples, and on until ``least`` have been learned
        from; ``rate`` gives the learning rate after so many."""
        n, done, order = len(t), 0, np.empty(0, np.uint32)
        goal = max(passes * n, least) if n else 0
        while done < goal:
            if len(order) < min(batch, goal - done):
                order = np.concatenate([order, rng.permutation(np.tile(np.arange(n, dtype=order.dtype), max(1, -(-batch // n))))])
            at, order = order[: min(batch, goal - done)], order[batch:]
            self.step(y[at], x[at], t[at], rng, rate(done))
            done += len(at)

    def step(self, y: np.ndarray, x: np.ndarray, t: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        n, sums, size = self.network, self.sums, len(self.noise_ends)
        log_noise = self.log_noise + np.float32(np.log(self.noise))
        k = np.searchsorted(self.noise_ends, rng.random(64) * self.noise_ends[-1], side="right").clip(max=size - 1).astype(t.dtype)
        rx, ry, qt, qk = n.r.take(x, 0), n.r.take(y, 0), n.q.take(t, 0), n.q[k]
        hat = rx @ n.c1 + ry @ n.c2
        data = np.einsum("ij,ij->i", hat, qt) + (n.b - log_noise)[t]
        fake = hat @ qk.T + (n.b - log_noise)[k]
        up = 1 / (1 + np.exp(data.clip(-30, 30)))  # slope on data
        down = np.float32(-self.noise / len(k)) / (1 + np.exp(-fake.clip(-30, 30)))
        back = up[:, None] * qt + down @ qk
        moved = (np.bincount(t, weights=up, minlength=size) + np.bincount(k, weights=down.sum(axis=0), minlength=size)).astype(np.float32)
        slopes = rx.T @ back, ry.T @ back
        _move(n.r, sums["r"], np.concatenate([x, y]), np.concatenate([back @ n.c1.T, back @ n.c2.T]), rate)
        _move(n.q, sums["q"], np.concatenate([t, k]), np.concatenate([up[:, None] * hat, down.T @ hat]), rate)
        for name, slope, pace in (("b", moved, rate), ("c1", slopes[0], rate / 10), ("c2", slopes[1], rate / 10)):
            sums[name] += slope * slope
            getattr(n, name).__iadd__(np.float32(pace) * slope / np.sqrt(sums[name]))


def _move(weights: np.ndarray, sums: np.ndarray, rows: np.ndarray, slope: np.ndarray, rate: float) -> None:
    """An Adagrad step on some rows, which may repeat."""
    order = np.argsort(rows, kind="stable")
    ordered = rows.take(order)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    only, total = ordered[starts], np.add.reduceat(slope.take(order, 0), starts, axis=0)
    sums[only] += total * total
    weights[only] += np.float32(rate) * total / np.sqrt(sums[only])


def rate_after(done: float, work: float) -> float:
    return 0.15 * (1 - min(1.0, done / max(1.0, work))) + 0.005


def train(found: np.ndarray, size: int, seed: int = 11) -> Network:
    """The network for examples given as cells, (y * size + x) * size + w, by one learner."""
    before, t = np.divmod(found, size)
    y, x = np.divmod(before, size)
    learning, work = Learning(np.bincount(t, minlength=size), seed=seed), max(LEAST, PASSES * len(t))
    learning.learn(*(v.astype(number_type(size)) for v in (y, x, t)), np.random.default_rng(seed), lambda done: rate_after(done, work), passes=PASSES, least=LEAST)
    return learning.network


def rounds_of(texts: DataFrame, first: float) -> DataFrame:
    """``texts`` with ``round``: 0 for a share ``first`` of their places, and each further
    one as large as all before it."""
    place = F.pmod(F.col("key"), F.lit(PLACES))
    end, number = int(first * PLACES) or 1, F.lit(0)
    while end < PLACES:
        number = number + (place >= end).cast("int")
        end *= 2
    return texts.withColumn("round", number)


def learned(documents: DataFrame, classes: Classes, unigram: np.ndarray, per_root: int, most_examples: int) -> Network:
    """The network, learned from all training tokens, whose classes ``unigram`` counts."""
    spark, total, learning = documents.sparkSession, int(unigram.sum()), Learning(unigram)
    first = min(total, max(per_root * total**0.5, LEAST), most_examples) / max(1, total)
    texts = rounds_of(stored(sequences(documents, classes), "sequences"), first)
    sizes = sorted((r["round"], r["n"]) for r in texts.groupBy("round").agg(F.sum("tokens").alias("n")).collect())
    work = max(LEAST, PASSES * sizes[0][1]) + sum(n for _, n in sizes[1:]) if sizes else 0
    done = 0
    for number, n in sizes:
        learners = min(LEARNERS, max(1, n // BLOCK)) if done else 1
        dealt = texts.where(F.col("round") == number).select(F.pmod(F.shiftright("key", 30), F.lit(learners)).cast("int").alias("learner"), "key", "tokens", "classes")
        shared = spark.sparkContext.broadcast(learning)
        ends = dealt.repartition(2 * learners, "learner").sortWithinPartitions("learner", "key").mapInArrow(_learner(shared, number, learners, done, work), "learner int, n long, state binary")
        found = sorted(ends.toArrow().to_pylist(), key=lambda r: r["learner"])
        mean = sum(np.frombuffer(r["state"], np.float32).astype(np.float64) * r["n"] for r in found) / sum(r["n"] for r in found)
        shared.destroy()
        learning.resume(mean.astype(np.float32))
        done += n if done else max(LEAST, PASSES * n)
    dropped(texts)
    return learning.network


def _learner(shared, number: int, learners: int, before: int, work: int):
    """Go through each learner's texts and hand on what it has arrived at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learning = deepcopy(shared.value)  # a worker's next task gets the same object
        start, kind = learning.state(), number_type(len(learning.noise_ends))
        who, rng, held, waiting, seen = None, None, [], 0, 0

        def spend() -> None:
            nonlocal held, waiting, seen
            if held:
                rate = lambda done: rate_after(before + learners * (seen + done), work)
                learning.learn(*examples(held), rng, rate, passes=1 if before else PASSES, least=0 if before else LEAST)
            held, waiting, seen = [], 0, seen + waiting

        def end() -> Iterator[pa.RecordBatch]:
            if who is not None:
                spend()
                yield pa.RecordBatch.from_arrays([pa.array([who], pa.int32()), pa.array([seen], pa.int64()), pa.array([learning.state().tobytes()], pa.binary())], names=["learner", "n", "state"])

        for batch in batches:
            for learner, tokens, data in zip(batch.column("learner").to_pylist(), batch.column("tokens").to_pylist(), batch.column("classes"), strict=True):
                if learner != who:
                    yield from end()
                    learning.resume(start)
                    who, rng, seen = learner, np.random.default_rng([11, number, learner]), 0
                held.append(np.frombuffer(data.as_buffer(), kind))
                waiting += tokens
                if before and waiting >= BLOCK:
                    spend()
        yield from end()

    return run


@dataclass
class Scorer:
    classes: Classes
    network: Network
    normaliser: np.ndarray
    base_of: np.ndarray  # log10 of the smoothed unigram share of each indexed word
    inside_of: np.ndarray  # log10 P(word | its class) of each indexed word
    base_end: float
    tail_share: np.ndarray  # log10(N_class + V_class + 1)
    total: int
    distinct: int
    tables: tuple[np.ndarray, np.ndarray] | None = None

    def text(self, text: str | None) -> tuple[int, int, float, float, Counter]:
        """(tokens, known tokens, base, model, counts of words without an index): the sums
        leave out what depends on the counts of those words."""
        if self.tables is None:  # each worker makes its own
            self.tables = self.network.energies()
        tokens = words(text)
        at, n = self.classes.numbers(tokens)
        known = at[at >= 0]
        base = float(self.base_of[known].sum()) + self.base_end
        x, y = np.r_[0, n[:-1]], np.r_[0, 0, n[:-2]][: len(n)]
        one, two = self.tables
        energy = one[x, n].sum(dtype=np.float64) + two[y, n].sum(dtype=np.float64) - self.normaliser[x, y].sum(dtype=np.float64)
        rest = Counter([tokens[i] for i in np.flatnonzero(at < 0).tolist()])
        return len(n), len(known) + (self.total > 0), base, float(energy / np.log(10) + self.inside_of[known].sum()), rest


def fit(documents: DataFrame, counts: DataFrame, head: int, tails: int, indexed: int, per_root: int, most_examples: int) -> Scorer:
    """Gather the corpus's statistics and train.  The driver gets the ``indexed`` most
    frequent words, the sums of the classes, and the learners' networks."""
    inner = counts.where(F.length("word") > 0)
    top = inner.orderBy(F.desc("c"), "word").limit(indexed).toArrow()
    ranked, c = top["word"].to_pylist(), top["c"].to_numpy().astype(np.float64)
    classes = Classes.of(ranked, head, tails)
    whole = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = int(whole[0] or 0), int(whole[1])
    end = counts.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    share, tokens = np.zeros(tails), np.zeros(tails)
    for k, n, v in inner.groupBy(tail_of("word", tails).alias("k")).agg(F.sum("c"), F.count("*")).collect():
        share[k], tokens[k] = n + v, n
    for w, x in zip(ranked[: classes.head], c, strict=False):  # the head stands for itself
        share[zlib.crc32(w[-2:]) % tails] -= x + 1
        tokens[zlib.crc32(w[-2:]) % tails] -= x
    share = np.log10(share + 1)
    network = learned(documents, classes, np.concatenate([[end], c[: classes.head], tokens]), per_root, most_examples)
    inside = np.where(np.arange(len(c)) < classes.head, 0.0, np.log10(c + 1) - share[np.maximum(classes.class_of - 1 - classes.head, 0)])
    base = lambda x: np.log10((x + 1) / (total + distinct + 1))
    return Scorer(classes, network, network.normalisers().astype(np.float32), base(c), inside, float(base(end)), share, total, distinct)


def tail_of(column: str, tails: int):
    """The tail class of a word column, as ``Classes`` has it."""
    return F.crc32(F.expr(f"substring({column}, greatest(length({column}) - 1, 1), 2)")) % tails


def score(documents: DataFrame, head: int = 2000, tails: int = 200, indexed: int = 100_000, small: int = 100_000, per_root: int = 400, most_examples: int = 30_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = documents.sparkSession
    ship(spark)
    counts = stored(word_counts(documents), "words")
    fitted = fit(documents, counts, head, tails, indexed, per_root, most_examples)
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in bounded(batches, "text", 1 << 20):
            ids = batch.column("doc_id").to_pylist()
            rows, rest = [], []
            for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                *sums, other = scorer.text(text)
                # Rows with one doc_id are told apart by their text's checksum.
                rows.append((doc_id, zlib.crc32((text or "").encode()), None, 1, *sums))
                rest += [(doc_id, rows[-1][1], w, n) for w, n in other.items()]
            for part, width in ((rows, 8), (rest, 4)):
                if part:
                    cols = list(zip(*part, strict=True)) + [[None] * len(part)] * (8 - width)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)

    parts = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, sum long, word binary, n long, n_tokens long, n_known long, base double, model double")
    parts = stored(parts, "texts")
    share = F.array(*[F.lit(float(x)) for x in fitted.tail_share])
    c = F.coalesce("c", F.lit(0))
    n = F.col("n")
    known = counts.where(F.length("word") > 0)
    known = F.broadcast(known) if known.count() <= small else known
    rest = parts.where(F.col("word").isNotNull()).join(known, "word", "left")
    rest = rest.select("doc_id", "sum", F.when(c > 0, n).otherwise(0).alias("n_known"), (n * F.log10((c + 1) / F.lit(float(fitted.total + fitted.distinct + 1)))).alias("base"), (n * (F.log10(c + 1.0) - F.get(share, tail_of("word", tails).cast("int")))).alias("model"))
    added = rest.groupBy("doc_id", "sum").agg(*[F.sum(x).alias(f"more_{x}") for x in ("n_known", "base", "model")])
    rows = parts.where(F.col("word").isNull())
    copies = rows.groupBy("doc_id", "sum").agg(F.count("*").alias("copies"))
    added = added.join(copies.where("copies > 1"), ["doc_id", "sum"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    added = added.select(F.col("doc_id").alias("_id"), F.col("sum").alias("_sum"), *[(F.col(f"more_{x}") / F.col("copies")).alias(f"more_{x}") for x in ("n_known", "base", "model")])
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sum") == F.col("_sum")), "left")
    plus = lambda x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0.0))
    return joined.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", F.round(plus("n_known")).cast("long").alias("n_known"), F.lit(fitted.total).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("model").alias("score"))


_ROWS = pa.schema([("doc_id", pa.int64()), ("sum", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])
