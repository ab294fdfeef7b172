"""Texts of a batch as one array of code points, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, index of the text that each belongs to)."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return joined, np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])


def runs(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` characters, each with its first index.  A text
    longer than that makes a run of its own and stays whole."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, texts[start:]


def drawn(rows: DataFrame, id_column: str, most: int, by: str | None = None, text: str | None = None, characters: int = 0) -> DataFrame:
    """About ``most`` rows (of each value of ``by``), chosen by a hash of the id; with ``text``,
    fewer where those would hold more than about ``characters`` characters.

    The choice doesn't depend on order or partitions.  Only counts reach the driver.  The
    last limit only guards against one id that stands on very many rows.
    """
    position = F.pmod(F.xxhash64(F.lit(7), F.col(id_column)), F.lit(1 << 30)) / float(1 << 30)
    size = F.sum(F.length(text)) if text else F.lit(0)
    part = lambda n, held: min(most / max(1, n), characters / held if text and held else 1.0)
    if by is None:
        share: Column = F.lit(part(*rows.agg(F.count("*"), size).first()))
        classes = 1
    else:
        counts = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*"), size).collect()
        share, classes = F.lit(0.0), max(1, len(counts))
        for value, n, held in counts:
            share = F.when(F.col(by) == F.lit(value), F.lit(part(n, held))).otherwise(share)
    return rows.where(position < share).limit(2 * most * classes)
