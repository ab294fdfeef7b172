"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors by two pseudo-rotations, each of three rounds of random signs
and a fast Hadamard transform; the nearest signed axes after the first and after the second
name a cell together.  A vector is indexed under its cell in every table; a query probes the
cells whose axes have the largest sums of dot products, ``share`` / n ** 0.25 of all cells for
n rows: nearer neighbours, as more rows have them, need fewer probes.  Rows and queries meet
at the first axis, a query with a mask of the second axes that it probes there.  Candidates
are ranked by their exact cosine in double precision, and only the best of a bucket leave it.

Of equal vectors only the k + 1 with the smallest vec_ids are indexed: no other can be among
a query's k nearest.  A bucket with many rows or queries is split over tasks by salts on both
sides, so no task grows with a hot bucket.  Queries that found too few rows probe every cell
of one table, which is all rows.

Defined results: vectors that aren't usable (see ``vectors.usable``) and rows without a
vec_id take no part; only vectors of a query's dimension answer it; a row never answers
itself, but another row with its vec_id or vector does; repeated query rows are all answered;
equal scores go to the smaller vec_id; if there are fewer than ``k`` candidates all are
returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import ship, stored
from tidemark.llm.vectors import by_dimension, matrix, unit, usable


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row, by butterflies."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, -1, 2, half)
        new = np.empty_like(pairs)
        np.add(pairs[:, :, 0], pairs[:, :, 1], out=new[:, :, 0])
        np.subtract(pairs[:, :, 0], pairs[:, :, 1], out=new[:, :, 1])
        x, half = new.reshape(n, width), 2 * half
    return x * x.dtype.type(width**-0.5)


def turned(x: np.ndarray, number: int) -> np.ndarray:
    """Dot products with all signed axes after a pseudo-rotation."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([17, number, width]).choice([-1.0, 1.0], (3, width)).astype(np.float32)
    x = np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(np.float32)
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def cells(one: np.ndarray, two: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first axis, mask of second axes as bits) of the cells with the largest sums of
    dot products; ``probes`` 0 stands for all cells."""
    n, axes = one.shape
    if not probes or probes >= axes * axes:
        return np.repeat(np.arange(n), axes), np.tile(np.arange(axes), n), np.full((n * axes, -(-axes // 8)), 255, np.uint8)
    most = min(probes, axes)  # the best cells lie among the best axes of either side
    first, second = (np.argsort(-d, axis=1, kind="stable")[:, :most] for d in (one, two))
    sums = np.take_along_axis(one, first, 1)[:, :, None] + np.take_along_axis(two, second, 1)[:, None, :]
    best = np.argpartition(-sums.reshape(n, -1), probes - 1, axis=1)[:, :probes]
    row = np.repeat(np.arange(n), probes)
    at, other = first[row, best.ravel() // most], second[row, best.ravel() % most]
    key, group = np.unique(row * axes + at, return_inverse=True)
    mask = np.zeros((len(key), axes), bool)
    mask[group, other] = True
    return key // axes, key % axes, np.packbits(mask, axis=1)


def _hashed(rows: DataFrame, tables: int, probes: int | None = None) -> DataFrame:
    """``rows`` with ``cells``, an array of (bucket, second, mask): a row's own cell in each
    table or, with ``probes``, a query's first axes with their masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 1024):
                batch = big.slice(start, 1024)
                x = unit(matrix(batch.column("embedding")))
                rows, buckets, seconds, masks = [], [], [], []
                for t in range(tables):
                    one, two = turned(x, 2 * t), turned(x, 2 * t + 1)
                    if probes is None:
                        row, first = np.arange(len(x)), one.argmax(axis=1)
                        seconds.append(two.argmax(axis=1))
                    else:
                        row, first, bits = cells(one, two, probes)
                        masks += [b.tobytes() for b in bits]
                    rows.append(row)
                    buckets.append(first.astype(np.int64) * tables + t)
                row = np.concatenate(rows)
                order = np.argsort(row, kind="stable")
                n = len(order)
                second = pa.array(np.concatenate(seconds)[order].astype(np.int32)) if seconds else pa.nulls(n, pa.int32())
                mask = pa.array([masks[i] for i in order.tolist()], pa.binary()) if masks else pa.nulls(n, pa.binary())
                each = pa.StructArray.from_arrays([pa.array(np.concatenate(buckets)[order]), second, mask], names=["bucket", "second", "mask"])
                ends = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), each)], names=[*batch.schema.names, "cells"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("vec_id", "h", "copy", "embedding").mapInArrow(run, f"vec_id long, h long, copy int, embedding {kind}, cells array<struct<bucket: long, second: int, mask: binary>>")


def best_of(ids: np.ndarray, x: np.ndarray, second: np.ndarray, q: np.ndarray, masks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the k best rows for each query, by exact scores, among the
    rows whose second axis the query's mask holds."""
    qs, vs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(ids) and len(q):
        xn, qn = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        order = np.argsort(second, kind="stable")
        axis, begins = np.unique(second[order], return_index=True)
        spans = list(zip(axis.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True))
        ids, xs, xn = ids[order], x[order], xn[order]
        for start in range(0, len(q), 512):
            ask, open_ = q[start : start + 512], masks[start : start + 512]
            rough = np.full((len(ask), len(ids)), -np.inf)
            for j, a, b in spans:
                some = np.flatnonzero(open_[:, j])
                if len(some):
                    rough[some, a:b] = ask[some] @ xs[a:b].T / xn[a:b]
            rough /= qn[start : start + 512, None]
            cut = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(rough), -np.inf)
            near = (rough >= cut[:, None] - 1e-9) & (rough > -np.inf)
            # A few queries at a time, so that many equal scores don't fill the memory.
            part = np.cumsum(near.sum(axis=1)) // 65_536
            for number in np.unique(part):
                rows = np.flatnonzero(part == number)
                i, j = np.nonzero(near[rows])
                i = rows[i]
                exact = (xs[j] * ask[i]).sum(axis=1) / (xn[j] * qn[start + i])
                best = np.lexsort((ids[j], -exact, i))
                best = best[np.arange(len(best)) - np.searchsorted(i[best], i[best]) < k]
                qs.append(start + i[best])
                vs.append(order[j[best]])
                ss.append(exact[best])
    return np.concatenate(qs), np.concatenate(vs), np.concatenate(ss)


def _combined(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query, without repeats."""
    found = found.sort_by([("query_id", "ascending"), ("query_h", "ascending"), ("score", "descending"), ("vec_id", "ascending"), ("h", "ascending"), ("copy", "ascending")])
    cols = [found[c].to_numpy() for c in ("query_id", "query_h", "vec_id", "h", "copy")]
    differs = lambda some: np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in some])][: len(found)]
    query, fresh = differs(cols[:2]), differs(cols)
    place = np.cumsum(fresh)
    starts = np.maximum.accumulate(np.where(query, place, 0))
    return found.filter(pa.array(fresh & (place - starts < k)))


def _ranked(k: int, most: int = 1 << 17):
    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by group; a group's queries stand before its candidates."""
        group, held = None, []
        for big in batches:
            if not big.num_rows:
                continue
            key = np.stack([big.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "salt", "query_salt")], axis=1)
            asks = big.column("asks").to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if group != tuple(key[a]):
                    group, held = tuple(key[a]), []
                first = int(asks[a:b].sum())  # queries sort before rows
                if first:
                    held.append(big.slice(a, first))
                part = big.slice(a + first, b - a - first)
                if held and part.num_rows:
                    asked = pa.Table.from_batches(held).combine_chunks()
                    bits = np.frombuffer(b"".join(asked["mask"].to_pylist()), np.uint8).reshape(asked.num_rows, -1)
                    number = lambda c: part.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    i, j, score = best_of(number("vec_id"), matrix(part.column("embedding")), number("second").astype(np.int64), matrix(asked["embedding"].combine_chunks()), np.unpackbits(bits, axis=1).astype(bool), k)
                    row, ask = part.take(pa.array(j)), asked.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([*[ask[c].combine_chunks() for c in ("vec_id", "h")], *[row.column(c) for c in ("vec_id", "h", "copy")], pa.array(score)], names=["query_id", "query_h", "vec_id", "h", "copy", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query meets many buckets in a task; only its best rows of all of them leave it.
        About ``most`` rows are held at once."""
        held, n = [], 0
        for found in ranks(batches):
            held.append(found)
            n += found.num_rows
            if n > most:
                best = _combined(pa.Table.from_batches(held), k)
                if best.num_rows > most // 2:  # many queries: what is kept would only be sorted again
                    yield from best.to_batches()
                    held, n = [], 0
                else:
                    held, n = best.to_batches(), best.num_rows
        if held:
            yield from _combined(pa.Table.from_batches(held), k).to_batches()

    return run


def _search(rows: DataFrame, queries: DataFrame, k: int, tables: int, probes: int, most: int = 16_384) -> DataFrame:
    """The k best (query_id, query_h, vec_id, h, copy, score) of each bucket and query, with repeats."""
    # Stored, because sizes and rows read them both.
    index, asked = stored(_hashed(rows, tables), "index"), stored(_hashed(queries, tables, probes), "asked")
    counted = lambda df, name: df.select(F.explode("cells.bucket").alias("bucket")).groupBy("bucket").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    # One row for each table and first axis: bounded by the dimension, whatever the rows.
    parts = F.broadcast(counted(index, "salts").join(F.broadcast(counted(asked, "query_salts")), "bucket"))
    spread = lambda df: df.select("vec_id", "h", "copy", "embedding", F.inline("cells")).join(parts, "bucket")
    own = lambda name: F.pmod(F.xxhash64("vec_id", "h", "copy"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    columns = ["second", "mask", "vec_id", "h", "copy", "embedding"]
    here = spread(index).select("bucket", own("salts").alias("salt"), each("query_salts").alias("query_salt"), F.lit(False).alias("asks"), *columns)
    there = spread(asked).select("bucket", each("salts").alias("salt"), own("query_salts").alias("query_salt"), F.lit(True).alias("asks"), *columns)
    group = ["bucket", "salt", "query_salt"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = here.unionByName(there).repartition(tasks, *group).sortWithinPartitions(*group, F.desc("asks"))
    return both.mapInArrow(_ranked(k), FOUND)


FOUND = "query_id long, query_h long, vec_id long, h long, copy int, score double"


def cells_probed(n: int, width: int, share: float) -> int:
    """How many of the cells of a table a query probes among ``n`` rows of a dimension."""
    axes = 2 << max(1, (width - 1).bit_length())
    return max(1, math.ceil(axes * axes * min(1.0, share * max(1, n) ** -0.25)))


def nearest(embeddings: DataFrame, asks: Column, k: int = 5, tables: int = 12, share: float = 0.16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that ``asks`` is true for."""
    ship(embeddings.sparkSession)
    rows = usable(embeddings.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding", asks.alias("asks"))).withColumn("h", F.xxhash64("embedding"))
    copy = F.row_number().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))
    held = stored(rows.select("vec_id", "h", "embedding", copy.alias("copy")).where(F.col("copy") <= k + 1), "rows")
    # Rows that are equal in vec_id and vector ask once.
    queries = stored(rows.where("asks").groupBy("vec_id", "h", "embedding").agg(F.count("*").cast("int").alias("times")).withColumn("copy", F.lit(0)), "queries")
    found = embeddings.sparkSession.createDataFrame([], FOUND)
    for part in by_dimension(held):
        n, d = part.agg(F.count("*"), F.max(F.size("embedding"))).first()
        asked = queries.where(F.size("embedding") == d)
        near = stored(_search(part, asked, k + 1, tables, cells_probed(n, d, share)), "nearest").distinct()
        full = near.groupBy("query_id", "query_h").count().where(F.col("count") > k)
        short = stored(asked.join(full, (asked.vec_id == full.query_id) & (asked.h == full.query_h), "left_anti"), "short")
        if not short.isEmpty():
            near = near.unionByName(_search(part, short, k + 1, 1, 0)).distinct()
        found = found.unionByName(near)
    query = ["query_id", "query_h"]
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("h") == F.col("query_h"))
    itself = F.row_number().over(Window.partitionBy(*query, "own").orderBy("copy"))
    others = found.withColumn("own", own).withColumn("number", itself).where("NOT own OR number > 1")
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id", "h", "copy"))
    ranked = others.withColumn("rank", rank).where(F.col("rank") <= k)
    times = queries.select(F.col("vec_id").alias("query_id"), F.col("h").alias("query_h"), "times")
    return ranked.join(times, query).select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time")).drop("_time")
