"""Language identification with string kernels.

Kernel: blended spectrum on presence.  k(x, y) counts the distinct n-grams of length 1 to
3 that both texts hold, divided by the root of the product of their own counts.  Text is
lower-cased and every run of other characters than letters is one space.

Nyström landmarks: a bounded sample of training texts (``landmarks`` for a language).
With K the kernel among landmarks, a text becomes K^(-1/2) k(landmarks, text), scaled to
length 1.  One ridge regression for each language against the rest is fitted in that
space on a bounded sample of training texts (``fit_rows`` for a language), classes
weighted alike.  Prediction is two matrix products for a batch.

Defined results: a null text or one without letters is ``und`` with score 0; ties go to
the alphabetically first language; without any training row all is ``und``; very long
texts are read whole; repeated rows get equal results.
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

OTHER = 1  # class of letters outside the alphabet; 0 is the space


def letter_classes(texts: list[str], most: int = 120) -> np.ndarray:
    """A table from code points below 2**16 to classes, for the letters of ``texts``."""
    seen = np.zeros(1 << 16, np.int64)
    for _, part in runs([t.lower() for t in texts]):
        c, _ = codes(part)
        seen += np.bincount(c[c < 1 << 16], minlength=1 << 16)
    table = np.zeros(1 << 16, np.int32)
    letters = [i for i in range(1 << 16) if chr(i).isalpha()]
    table[letters] = OTHER
    ranked = sorted((i for i in letters if seen[i]), key=lambda i: (-seen[i], i))[:most]
    table[ranked] = np.arange(2, 2 + len(ranked))
    return table


@dataclass
class Grams:
    """Presence of n-grams in texts; ``columns`` numbers the n-grams of the landmarks."""

    classes: np.ndarray
    base: int
    columns: np.ndarray  # one entry for each possible n-gram, -1 where no landmark has it
    width: int

    @classmethod
    def of(cls, texts: list[str]) -> Grams:
        classes = letter_classes(texts)
        base = int(classes.max()) + 1
        grams = cls(classes, base, np.arange(base + base**2 + base**3, dtype=np.int32), base + base**2 + base**3)
        used = np.zeros(grams.width, bool)
        for t in texts:
            for _, found in grams.occurrences([t]):
                used[found] = True
        grams.columns = np.where(used, np.cumsum(used) - 1, -1).astype(np.int32)
        grams.width = int(used.sum())
        return grams

    def occurrences(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, n-gram number) of every occurrence, for n = 1, 2 and 3."""
        c, owner = codes([f" {t.lower()} " for t in texts])
        k = np.where(c < 1 << 16, self.classes[np.minimum(c, (1 << 16) - 1)], OTHER)
        keep = np.ones(len(k), bool)
        keep[1:] = (k[1:] != 0) | (k[:-1] != 0) | (owner[1:] != owner[:-1])
        k, owner = k[keep], owner[keep]
        b = self.base
        two = k[:-1] * b + k[1:]
        yield owner, k
        same = owner[:-1] == owner[1:]
        yield owner[:-1][same], (b + two)[same]
        same = owner[:-2] == owner[2:]
        yield owner[:-2][same], (b + b * b + two[:-1] * b + k[2:])[same]

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(presence matrix over the columns, number of distinct n-grams among them)."""
        out = np.zeros((len(texts), self.width), np.float32)
        for owner, gram in self.occurrences(texts):
            column = self.columns[gram]
            known = column >= 0
            out[owner[known], column[known]] = 1
        return out, out.sum(axis=1)


@dataclass
class Model:
    grams: Grams
    landmarks: np.ndarray  # n-grams x landmarks
    sizes: np.ndarray
    root: np.ndarray  # K^(-1/2)
    weights: np.ndarray
    languages: list[str]

    def space(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.root.shape[1]), np.float32)
        for start, part in runs(texts, 1 << 18):
            for at in range(0, len(part), 256):
                rows, own = self.grams.presence(part[at : at + 256])
                kernel = rows @ self.landmarks / np.sqrt(np.maximum(own, 1)[:, None] * self.sizes[None, :])
                out[start + at : start + at + len(rows)] = kernel @ self.root
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        given = [t or "" for t in texts]
        x = self.space(given)
        value = np.c_[x, np.ones(len(x))] @ self.weights
        best = value.argmax(axis=1)
        score = np.clip((value[np.arange(len(x)), best] + 1) / 2, 0, 1)
        names = [self.languages[b] if any(ch.isalpha() for ch in t) else "und" for b, t in zip(best, given, strict=True)]
        return names, np.where([n == "und" for n in names], 0.0, score)


def fit(texts: list[str], languages: list[str], landmarks: int = 48, ridge: float = 1e-3) -> Model | None:
    """A model from training rows in a fixed order; None if there are none."""
    if not texts:
        return None
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(names))])
    marks = [texts[i] for i in chosen]
    grams = Grams.of(marks)
    rows, sizes = grams.presence(marks)
    sizes = np.maximum(sizes, 1)
    kernel = (rows @ rows.T / np.sqrt(np.outer(sizes, sizes))).astype(np.float64)
    value, vector = np.linalg.eigh(kernel)
    good = value > 1e-6 * value.max()
    root = (vector[:, good] / np.sqrt(value[good])).astype(np.float32)
    model = Model(grams, rows.T.copy(), sizes, root, np.zeros(0), names)
    x = np.c_[model.space(texts), np.ones(len(texts))].astype(np.float64)
    weight = 1.0 / np.bincount(y)[y]
    weight *= len(y) / weight.sum()
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = x.T @ (x * weight[:, None]) + ridge * len(y) * np.eye(x.shape[1])
    model.weights = np.linalg.solve(gram, x.T @ (target * weight[:, None]))
    return model


def sample(documents: DataFrame, fit_rows: int = 500, characters: int = 10_000_000) -> tuple[list[str], list[str]]:
    """Texts and languages of about ``fit_rows`` training rows of each language, fewer where
    they hold more than about ``characters`` characters: what the driver gets is bounded."""
    known = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.where(training_rows("doc_id", 3, 1))
    rows = drawn(known, "doc_id", fit_rows, "lang", "text", characters).toPandas().sort_values(["doc_id", "text", "lang"])
    return rows["text"].tolist(), rows["lang"].tolist()


def train(documents: DataFrame, fit_rows: int = 500, landmarks: int = 48) -> Model | None:
    """Fit on a bounded sample of the training rows."""
    return fit(*sample(documents, fit_rows), landmarks)


SCHEMA = "lang_pred string, score double"


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``documents`` with ``held_out``, ``lang_pred`` and ``score``.

    Columns of these names in the input are replaced.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c not in ("held_out", "lang_pred", "score")]
    given = documents.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in bounded(batches, "text"):
            texts = batch.column("text").to_pylist()
            names, score = m.predict(texts) if m else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return given.mapInArrow(run, f"{fields}, {SCHEMA}").withColumn("held_out", held_out("doc_id", 3, 1))


def identify(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = train(documents)
    return predict(documents.select("doc_id", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
