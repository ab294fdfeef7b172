"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, homoglyphs to Latin letters, digits and signs that
stand in for letters inside a word to those letters, marks on letters kept, everything
that is no letter to one space.  An entry of the lexicon is a whole word or the beginning
of a word; an Aho-Corasick automaton finds all entries in one pass over a folded text.
A word counts with its heaviest entry, a text with the sum of its words' weights divided
by a power of its length, and matches inside an exception phrase don't count.

The lexicon is learned from labelled training rows, a bounded sample of each class
(``toxic_rows``, ``clean_rows``): an entry's weight is the log ratio of its smoothed
document shares in toxic and other texts, entries must pass a likelihood-ratio test.
Exception phrases are two-word phrases around an entry that occur in clean texts as often
as chance has it.  A logistic curve on four sums turns matches into a score.

Defined results: null counts as empty; a text without a match has the score of the
curve's intercept; without toxic training rows every score is 0; repeated rows are equal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import bounded, held_out, ship, training_rows
from tidemark.llm.textcodes import drawn

#: Letters of other scripts that look like Latin ones, and their readings.
HOMOGLYPHS = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
        "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w",
        "х": "x", "ё": "e", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
        "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ſ": "s", "ɡ": "g", "ɑ": "a", "ѡ": "w", "ո": "n", "օ": "o",
        "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None,
    }
)
#: Digits and signs that stand in for letters inside a word.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"})
_WIDE = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)}  # full-width forms stand 0xFEE0 above ASCII
_INSIDE = re.compile(r"(?:(?<=[^\W\d_])[\d@$!|]+(?=[^\W\d_])|(?<!\w)[1345780@$]+(?=[^\W\d_]))")
_GAP = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words of a text, each with one space before it and one after the last."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_WIDE | HOMOGLYPHS)
    while True:
        new = _INSIDE.sub(lambda m: m[0].translate(LEET), low)
        if new == low:
            break
        low = new
    return f" {_GAP.sub(' ', low).strip()} "


PREFIXES, LONGEST = (4, 5, 6), 24


def entries_of(folded: str) -> set[str]:
    """Candidate entries of a text: " stem" for beginnings, " word " for whole words."""
    words = {w for w in folded.split() if 3 <= len(w)}
    out = {f" {w} " for w in words if len(w) <= LONGEST}
    for n in PREFIXES:
        out.update([f" {w[:n]}" for w in words if len(w) > n])
    return out


def evidence(t: np.ndarray, n: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Likelihood-ratio statistic of document counts in both classes."""
    out = np.zeros(len(t))
    for seen, total in ((t, toxic), (n, clean)):
        for part, size in ((seen, seen + 0.0), (total - seen, total - seen + 0.0)):
            both = t + n if part is seen else toxic + clean - t - n
            expected = both * total / (toxic + clean)
            out += 2 * np.where(size > 0, size * np.log(np.maximum(size, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, None] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(0))
    _automaton: object = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for e, w in self.weights.items():
                self._automaton.add_word(e, (len(e), w))
            for e in self.exceptions:
                self._automaton.add_word(e, (len(e), 0.0))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def sums(self, text: str | None) -> list[float]:
        """(sum of weights by length, number of matched words by length, heaviest weight, any)."""
        folded = fold(text or "")
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if self.weights:
            for end, (length, weight) in self.automaton().iter(folded):
                start = end - length + 1
                if weight:
                    best[start] = max(best.get(start, 0.0), weight)
                else:
                    spared.append((start, end))
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        long = max(1, folded.count(" ") - 1) ** 0.5
        return [sum(best.values()) / long, len(best) / long, max(best.values(), default=0.0), float(bool(best))]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.curve):
            return np.zeros(len(texts))
        x = np.array([self.sums(t) for t in texts]).reshape(len(texts), 4)
        return 1 / (1 + np.exp(-np.clip(np.c_[np.log1p(x), np.ones(len(x))] @ self.curve, -30, 30)))


def learn(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: float = 24.0, most: int = 5000) -> dict[str, float]:
    """Weights of the entries that pass, out of (entry, toxic texts, clean texts)."""
    if not counts or not toxic or not clean:
        return {}
    t, n = np.array([c[1] for c in counts], float), np.array([c[2] for c in counts], float)
    weight = np.log((t + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
    proof = evidence(t, n, toxic, clean)
    good = [i for i in np.argsort(-proof, kind="stable") if weight[i] > 1.5 and proof[i] >= least][:most]
    kept: dict[str, float] = {}
    for i in sorted(good, key=lambda i: (len(counts[i][0]), counts[i][0])):
        entry, w = counts[i][0], float(weight[i])
        shorter = [kept[entry[: k + 1]] for k in PREFIXES if entry[: k + 1] in kept]
        if all(w > s + 0.7 for s in shorter):
            kept[entry] = w
    return kept


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic curve on log(1 + x) and a constant, by Newton steps."""
    a, w = np.c_[np.log1p(x), np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        penalty = ridge * np.r_[np.ones(x.shape[1]), 0.0]
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(rows: DataFrame, of, most: int = 200_000) -> DataFrame:
    """(entry, t, n): toxic and other texts that hold an entry.  ``of`` names the entries
    of a text; a task adds up what it sees and hands on at most ``most`` entries at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in bounded(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(of(text or ""))
            if len(seen[0]) + len(seen[1]) > most:
                yield flushed(seen)
                seen = (Counter(), Counter())
        yield flushed(seen)

    def flushed(seen) -> pa.RecordBatch:
        keys = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["entry", "t", "n"])

    return rows.mapInArrow(run, "entry string, t long, n long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def train(documents: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 6000) -> Lexicon:
    """Learn lexicon, exceptions and curve from bounded samples of training rows."""
    spark = documents.sparkSession
    ship(spark)
    marked = labels.where(F.col("toxic").isin(0, 1) & training_rows("doc_id", 4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = drawn(marked.where("toxic = 1"), "doc_id", toxic_rows).unionByName(drawn(marked.where("toxic = 0"), "doc_id", clean_rows))
    # Both samples are bounded by the parameters, so the labels may be broadcast.
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic").cache()
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = Lexicon()
    if toxic and clean:
        counts = _counted(rows, lambda text: entries_of(fold(text))).where("t >= 4 and t * {0} > 2 * n * {1}".format(clean, toxic))
        lexicon.weights = learn([tuple(r) for r in counts.collect()], toxic, clean)
        shared = spark.sparkContext.broadcast(lexicon)

        def phrases(text: str) -> set[str]:
            folded, out = fold(text), set()
            for end, (length, _) in shared.value.automaton().iter(folded) if shared.value.weights else ():
                start = end - length + 1
                stop = folded.index(" ", start + 1)
                after, before = folded.find(" ", stop + 1), folded.rfind(" ", 0, start)
                out.update([folded[start : after + 1]] * (after > 0) + [folded[before : stop + 1]] * (before >= 0))
            return out

        benign = _counted(rows, phrases).where("n >= 5 and t * {0} <= n * {1}".format(clean, toxic)).orderBy(F.desc("n"), "entry").limit(2000)
        lexicon.exceptions = dict.fromkeys(r["entry"] for r in benign.collect())
        shared = spark.sparkContext.broadcast(lexicon)

        def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, "text"):
                sums = [shared.value.sums(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], names=["x", "toxic"])

        got = rows.mapInArrow(matched, "x array<double>, toxic int").toPandas()
        y = got["toxic"].to_numpy(float)
        lexicon.curve = logistic(np.array(got["x"].tolist()).reshape(len(y), 4), y)
    rows.unpersist()
    return lexicon


def score(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """All columns of ``documents`` with ``held_out``, ``score`` and ``predicted``.

    Columns of these names in the input are replaced.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lexicon)
    given = documents.select(*[c for c in documents.columns if c not in ("held_out", "score", "predicted")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            value = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], names=[*batch.schema.names, "score"])

    scored = given.mapInArrow(run, f"{fields}, score double")
    return scored.withColumns({"held_out": held_out("doc_id", 4, 2), "predicted": (F.col("score") >= threshold).cast("int")})


def detect(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    lexicon = train(documents, labels)
    return score(documents.select("doc_id", "text"), lexicon).select("doc_id", "held_out", "score", "predicted")
