"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, bit by bit the majority of the hashes of a text's 3-word
shingles.  Two fingerprints at 3 or fewer differing bits differ in at most one bit in one
of their 32-bit halves, so each half is covered by itself with threshold 1.  The anchors
of a half are the words of the perfect Hamming code of length 31 times the free 32nd bit:
every value lies within radius R = 1 of an anchor, its home.  A fingerprint is replicated
to every anchor within R + 1 = 2 (17 of them or one), and at each anchor the ones at home
there are compared with all.  So each close pair meets at the home of either of the two.

Equal fingerprints are one before anchors are dealt, so exact copies never meet.  An
anchor with more than ``most_home`` fingerprints at home is split over several tasks.

Defined results: a text that is null or has no words has fingerprint zero and links with
other zeros; texts below three words hash as one shingle; equal ids stay separate rows;
rows without an id link like others, and a group in which no row has one has no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.runtime import bounded, ship, stored

SEED, WIDTH, BLOCK = 42, 3, 1 << 15


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < WIDTH:
        return xxh64_intdigest(b" ".join(words), SEED)
    total, n = np.zeros(64, np.int64), len(words) - WIDTH + 1
    for start in range(0, n, BLOCK):
        part = words[start : start + BLOCK + WIDTH - 1]
        hashes = [xxh64_intdigest(b" ".join(s), SEED) for s in zip(part, part[1:], part[2:], strict=False)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">u8")[0])


def fingerprints(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) and the long columns ``keep`` of every whole text; fp holds the 64 bits
    as a signed long."""
    ship(documents.sparkSession)
    names = ["doc_id", *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(pa.int64()) for c in names], pa.array(fps)], names=[*names, "fp"])

    return documents.select(*names, "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 32-bit values: (index of value, anchor, at home) for every anchor within 2."""
    half = half.astype(np.uint64)
    word, free = half & np.uint64(0x7FFFFFFF), half & np.uint64(0x80000000)
    syndrome = np.zeros(len(half), np.int64)
    for place in range(1, 32):
        syndrome ^= np.where((word >> np.uint64(place - 1)) & np.uint64(1), place, 0)
    one = lambda place: np.left_shift(np.uint64(1), (place - 1).astype(np.uint64))
    rows = np.arange(len(half))
    off = syndrome != 0
    home = word.copy()
    home[off] ^= one(syndrome[off])
    found = [(rows, home | free, np.ones(len(half), bool)), (rows, home | (free ^ np.uint64(0x80000000)), np.zeros(len(half), bool))]
    for place in range(1, 32):  # two flips that together cancel the syndrome
        other = syndrome ^ place
        pick = rows[off & (other > place)]
        here = word[pick] ^ np.uint64(1 << (place - 1)) ^ one(other[pick])
        found.append((pick, here | free[pick], np.zeros(len(pick), bool)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def labels_at_anchor(fps: np.ndarray, home: np.ndarray, threshold: int, block: int = 1024) -> np.ndarray:
    """The smallest index that each fingerprint reaches by links with one at home."""
    labels, at_home = np.arange(len(fps)), np.flatnonzero(home)
    while True:
        new = labels.copy()
        for start in range(0, len(at_home), block):
            rows = at_home[start : start + block]
            for first in range(0, len(fps), 8 * block):
                cols = slice(first, first + 8 * block)
                near = np.bitwise_count(fps[rows, None] ^ fps[None, cols]) <= threshold
                least = np.where(near, new[None, cols], len(fps)).min(axis=1)
                least = np.minimum(least, new[rows])
                new[rows] = least
                new[cols] = np.minimum(new[cols], np.where(near, least[:, None], len(fps)).min(axis=0))
        if (new == labels).all():
            return labels
        labels = new


def _compare(threshold: int):
    def at_anchors(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, home: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        edges = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1))
        homes = np.add.reduceat(home.astype(np.int64), edges[:-1])
        for g in np.flatnonzero((np.diff(edges) > 1) & (homes > 0)):
            part = slice(edges[g], edges[g + 1])
            labels = labels_at_anchor(fp[part], home[part], threshold)
            linked = labels != np.arange(len(labels))
            if linked.any():
                out.append((rep[part][linked], rep[part][labels[linked]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep", "home")]
            cols[1] = cols[1].view(np.uint64)
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)] if kept else cols
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            done, kept = [c[:last] for c in cols], [c[last:] for c in cols]
            if last:
                yield from emit(at_anchors(*done))
        if kept:
            yield from emit(at_anchors(*kept))

    def emit(found):
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(distinct: DataFrame, threshold: int = 3, most_home: int = 8192) -> DataFrame:
    """Links (a, b) between the representatives of ``distinct`` (fp, rep) that join all
    fingerprints at ``threshold`` or fewer differing bits, directly or over others."""
    if threshold not in (2, 3):
        raise ValueError("the anchors of halves cover thresholds 2 and 3")
    ship(distinct.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 1 << 15):
                batch = big.slice(start, 1 << 15)
                fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
                bits = fp.view(np.uint64)
                for k, half in enumerate((bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF))):
                    row, anchor, home = anchors_of(half)
                    key = (anchor | np.uint64(k << 32)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(rep[row]), pa.array(home)], names=["key", "fp", "rep", "home"])

    dealt = distinct.select("fp", "rep").where("rep IS NOT NULL").mapInArrow(deal, "key long, fp long, rep long, home boolean")
    hot = dealt.where("home").groupBy("key").count().where(F.col("count") > most_home)
    hot = hot.select("key", F.ceil(F.col("count") / most_home).cast("int").alias("parts"))
    split = dealt.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    split = split.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.select("key", "part", "fp", "rep", (F.col("home") & (F.col("part") == own)).alias("home"))
    # key holds 33 bits: the part goes above them, so one column names the group.
    grouped = split.select((F.col("key") + F.shiftleft(F.col("part").cast("long"), 33)).alias("key"), "fp", "rep", "home")
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_compare(threshold), "a long, b long")


def groups(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """(fp, group): fingerprints that links join have one group, named by one of them."""
    distinct = prints.select("fp").distinct().select("fp", F.col("fp").alias("rep"))
    linked = components(links(distinct, threshold))
    # As a table, so that the join with all prints is one that Spark splits where it is skewed.
    return stored(distinct.join(linked, distinct.rep == linked.node, "left").select("fp", F.coalesce("component", "fp").alias("group")), "groups")


def near_duplicates(documents: DataFrame, threshold: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id that links reach."""
    prints = stored(fingerprints(documents), "fingerprints")
    named = groups(prints, threshold)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp").groupBy("group").agg(F.min("least").alias("component_id"))
    of = stored(named.join(least, "group").select("fp", "component_id"), "components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(of, "fp", "left").select("doc_id", hexed, "component_id")
