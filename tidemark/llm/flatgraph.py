"""Embedding near-dedup over a robust-pruned flat graph.

Vectors are dealt to the ``overlap`` nearest of k centroids that a bounded sample gives,
so shards overlap.  In each shard every vector gets a pruned neighbour list: its nearest
vectors and some far ones, without those that a nearer neighbour already leads to.  The
lists of a vector from all its shards are united.  Each vector then searches every shard
that it belongs to: a greedy search walks from the medoid, its beam doubles until it meets
the vector itself, and then the range grows over all that list or are listed by what lies
within the threshold.  Links are verified by cosine in double precision and counted in the
first of the vector's shards that both belong to.

The result is audited: bounded samples of all vectors, of those with links and of those
near shard borders are compared with all rows; if less than ``least_recall`` of their links
was found, everything is built again with twice the overlap and longer lists, up to three
times.  If the audit still fails, no graph is used: each vector is sent to every cell whose
vectors may lie within the threshold, by the distance to the plane between that cell's
centroid and its own, and each cell's vectors are compared with all that were sent.  That is
exact.  The recall that each audit measured is logged.

Equal vectors are one class before shards are made.  A shard above ``shard_rows`` is
dealt to parts, each with its own graph; its queries search the graph of their own part
and are compared with every vector of the others.  There are at most ``most_centroids``
centroids, above a thousand in two levels; beyond some 50 million vectors shards grow.

Defined results: vectors that aren't usable (see ``vectors.usable``) link with nothing and
are their own component; vectors of different dimensions never link; equal vec_ids stay
separate rows, and a component is named after its smallest vec_id even if that stands in
another one too; rows without a vec_id take no part; an empty table gives no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.runtime import ship, stored
from tidemark.llm.textcodes import drawn
from tidemark.llm.vectors import by_dimension, matrix, unit, usable

LOG = logging.getLogger(__name__)


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced starts."""
    x = unit(sample)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(k):
            total = x[near == j].sum(axis=0)
            size = np.linalg.norm(total)
            if size > 1e-9:
                c[j] = total / size
    return c


class Centres:
    """Centroids in one level, or in two if there are many."""

    def __init__(self, sample: np.ndarray, k: int, one_level: int = 1024):
        x = unit(sample)
        tops = k if k <= one_level else round(k**0.5)
        self.top = centroids(x, min(tops, len(x)))
        self.below = [self.top]
        if k > one_level:
            cell = (x @ self.top.T).argmax(axis=1)
            parts = [x[cell == j] for j in range(len(self.top))]
            self.below = [centroids(p, max(1, min(len(p), round(k * len(p) / len(x))))) if len(p) else self.top[j : j + 1] for j, p in enumerate(parts)]
        self.vectors = np.concatenate(self.below)
        self.first = np.cumsum([0, *map(len, self.below)])

    def nearest(self, x: np.ndarray, most: int, cells: int = 8) -> np.ndarray:
        """The numbers of the ``most`` nearest centroids of each row, the nearest first (-1: none).
        In two levels, those below the nearest ``cells`` of the upper level are looked at."""
        if len(self.below) == 1:
            return np.argsort(-(x @ self.top.T), axis=1, kind="stable")[:, :most]
        near = np.argsort(-(x @ self.top.T), axis=1, kind="stable")[:, :cells]
        ids, sims = (np.full((len(x), near.shape[1], most), v) for v in (-1, -np.inf))
        for j in np.unique(near).tolist():
            row, at = np.nonzero(near == j)
            s = x[row] @ self.below[j].T
            best = np.argsort(-s, axis=1, kind="stable")[:, :most]
            ids[row, at, : best.shape[1]], sims[row, at, : best.shape[1]] = best + self.first[j], np.take_along_axis(s, best, 1)
        ids, sims = ids.reshape(len(x), -1), sims.reshape(len(x), -1)
        return np.take_along_axis(ids, np.argsort(-sims, axis=1, kind="stable")[:, :most], 1)


def pruned(x: np.ndarray, effort: int = 1, alpha: float = 1.2) -> np.ndarray:
    """Neighbour lists (-1: none), from three pools: a vector's nearest ones, some of its
    nearest few hundred, and some of all.  In each pool candidates are taken in order of
    distance and dropped if a chosen one is ``alpha`` times closer to them than the vector
    is.  The second pool ties dense groups together, the third ties groups to each other.
    """
    n = len(x)
    rng = np.random.default_rng(3)
    slots = (20, 12 * effort, 8 * effort)
    out = np.full((n, sum(slots)), -1, np.int64)
    for start in range(0, n, 512):
        rows = np.arange(start, min(n, start + 512))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        wide = min(512 * effort, n - 1)
        if not wide:
            continue
        near = np.argpartition(-sims, wide - 1, axis=1)[:, :wide]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        some = np.take_along_axis(near, rng.integers(0, wide, (len(rows), 2 * slots[1])), 1)
        pools = (near[:, :48], some, rng.integers(0, n, (len(rows), 2 * slots[2])))
        at = 0
        for cand, most in zip(pools, slots, strict=True):
            out[rows, at : at + most] = _prune(x, rows, cand, np.take_along_axis(sims, cand, 1), most, alpha)
            at += most
    return out


def _prune(x: np.ndarray, rows: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int, alpha: float) -> np.ndarray:
    gap = 1 - sims
    order = np.argsort(gap, axis=1, kind="stable")
    cand, gap = np.take_along_axis(cand, order, 1), np.take_along_axis(gap, order, 1)
    alive, vectors = cand != rows[:, None], x[cand]
    out, line = np.full((len(rows), most), -1, np.int64), np.arange(len(rows))
    for d in range(most):
        first = alive.argmax(axis=1)
        some = alive[line, first]
        if not some.any():
            break
        chosen = cand[line, first]
        out[some, d] = chosen[some]
        to_chosen = 1 - (vectors @ x[chosen][:, :, None])[:, :, 0]
        alive &= ~((alpha * to_chosen <= gap) | (cand == chosen[:, None])) | ~some[:, None]
    return out


class Search:
    """Greedy and range-expanding search over one graph."""

    def __init__(self, x: np.ndarray, lists: list[np.ndarray]):
        self.x = x
        self.small = x.astype(np.float32)
        source = np.repeat(np.arange(len(x)), [len(a) for a in lists])
        target = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
        edges = np.unique(np.r_[source * len(x) + target, target * len(x) + source])
        #: Who lists whom, both ways: the range grows over all of these.
        self.to, self.at = edges % len(x), np.searchsorted(edges // len(x), np.arange(len(x) + 1))
        # The greedy walk takes a vector's own list and a bounded number of those that list it.
        order = np.argsort(target, kind="stable")
        rank = np.arange(len(order)) - np.searchsorted(target[order], target[order])
        back = order[rank < 24]
        both = np.unique(np.r_[source * len(x) + target, target[back] * len(x) + source[back]])
        row = both // len(x)
        place = np.arange(len(both)) - np.searchsorted(row, row)
        self.lists = np.full((len(x), int(place.max(initial=0)) + 1), -1, np.int64)
        self.lists[row, place] = both % len(x)
        mean = x.mean(axis=0)
        self.medoid = int((x @ mean).argmax())

    def greedy(self, q: np.ndarray, beam: int) -> np.ndarray:
        """The beams (indexes, -1: none) of a block of queries, from the medoid."""
        n, b = len(self.x), len(q)
        beam = min(beam, n)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        done = np.ones((b, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = self.medoid, self.small[self.medoid] @ q.T, False
        seen = np.zeros((b, n), bool)
        seen[:, self.medoid] = True
        while True:
            open_ = np.where(done, -np.inf, sims)
            at = open_.argmax(axis=1)
            rows = np.flatnonzero(open_[np.arange(b), at] > -np.inf)
            if not len(rows):
                return ids
            done[rows, at[rows]] = True
            near = self.lists[ids[rows, at[rows]]]
            fresh = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            seen[rows[r], near[r, c]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.small[near[r, c]], q[rows[r]])
            all_s, all_i = np.concatenate([sims[rows], s], 1), np.concatenate([ids[rows], near], 1)
            all_d = np.concatenate([done[rows], ~fresh], 1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[rows], ids[rows], done[rows] = (np.take_along_axis(v, top, 1) for v in (all_s, all_i, all_d))
            ids[rows] = np.where(sims[rows] > -np.inf, ids[rows], -1)

    def within(self, vector: np.ndarray, starts: np.ndarray, threshold: float) -> np.ndarray:
        """Everything at ``threshold`` or nearer that neighbour lists reach from the starts."""
        seen = np.zeros(len(self.x), bool)
        front = np.unique(starts[starts >= 0])
        found = []
        while len(front):
            seen[front] = True
            near = front[self.x[front] @ vector >= threshold]
            found.append(near)
            if not len(near):
                break
            front = np.unique(np.concatenate([self.to[self.at[i] : self.at[i + 1]] for i in near.tolist()]))
            front = front[~seen[front]]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def link(ids: np.ndarray, x: np.ndarray, copies: np.ndarray, lists: list[np.ndarray], asked: np.ndarray, q: np.ndarray, threshold: float, shards: np.ndarray | None = None, before: list[np.ndarray] | None = None, whole: bool = False, beam: int = 16, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of every query, root of every node, root of every query), roots being ids.

    A query that is a node searches the graph.  One that isn't could not tell whether the
    search has arrived, so it is compared with every node; so are all if ``whole``.  Links
    to a node that shares one of the shards ``before`` with a query aren't counted here.
    """
    place = {v: i for i, v in enumerate(ids.tolist())}
    own = np.array([place.get(v, -1) for v in asked.tolist()])
    direct = (own < 0) | whole
    search = None if direct.all() else Search(x, lists)
    total = np.zeros(len(asked), np.int64)
    parent = np.arange(len(ids) + len(asked))

    def roots(of: np.ndarray) -> np.ndarray:
        up = parent[of]
        while (parent[up] != up).any():
            up = parent[up]
        parent[of] = up
        return up

    for start in range(0, len(asked), block):
        rows = np.arange(start, min(len(asked), start + block))
        wide, pending, beams = beam, rows[~direct[rows]], {}
        while len(pending):
            got = search.greedy(q[pending].astype(np.float32), wide)
            beams.update(zip(pending.tolist(), got, strict=True))
            lost = ~(got == own[pending][:, None]).any(axis=1)
            pending, wide = (pending[lost], wide * 2) if wide < len(ids) else (pending[:0], wide)
        plain = rows[direct[rows]]
        close = dict(zip(plain.tolist(), q[plain] @ x.T >= threshold - 1e-9, strict=True))
        for i in rows.tolist():
            found = np.flatnonzero(close[i]) if i in close else search.within(q[i], np.r_[beams[i], own[i]], threshold - 1e-9)
            found = found[(x[found] * q[i]).sum(axis=1) >= threshold]
            found = found[found != own[i]]
            fresh = found[~np.isin(shards[found], before[i]).any(axis=1)] if before is not None and len(before[i]) else found
            total[i] = copies[fresh].sum()
            if len(found):
                mine = np.r_[found, own[i] if own[i] >= 0 else len(ids) + i]
                tops = np.unique(roots(mine))
                parent[tops] = tops[0]
    every = roots(np.arange(len(parent)))
    names = np.r_[ids, asked]
    return total, names[every[: len(ids)]], names[every[len(ids) :]]


def reachable(x: np.ndarray, c: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector and centroid: may a vector whose nearest centroid this is lie within
    ``threshold``?  Such a vector is on the centroid's side of the plane between it and the
    vector's own centroid, so the angle to that plane is a lower bound."""
    if threshold <= 0:
        return np.ones((len(x), len(c)), bool)
    sims, product = x @ c.T, c @ c.T
    own, squares = sims.argmax(axis=1), np.diag(product)
    apart = np.sqrt(np.maximum(squares[own][:, None] + squares - 2 * product[own], 0))
    gap = sims[np.arange(len(x)), own][:, None] - sims
    return gap <= np.sqrt(max(0.0, 1 - threshold**2)) * apart + 1e-6  # the slack covers rounding


def _shards(classes: DataFrame, centres: Centres, overlap: int, threshold: float, whole: bool = False) -> DataFrame:
    """(rep, copies, embedding, shard, place, shards, border): a row for each shard a class belongs
    to, the ``overlap`` nearest or, if ``whole``, all that it can link into, home having place 0;
    at a border, it can link into the nearest shard that it doesn't belong to."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = unit(matrix(part.column("embedding")))
                near = c.nearest(x, overlap + 1)
                border = np.zeros(len(x), bool)
                if near.shape[1] > overlap:
                    home, other = c.vectors[near[:, 0]], c.vectors[near[:, overlap]]
                    gap = (x * (home - other)).sum(axis=1)
                    border = (near[:, overlap] >= 0) & (gap <= np.sqrt(max(0.0, 1 - threshold**2)) * np.linalg.norm(home - other, axis=1) + 1e-6)
                near = near[:, :overlap]
                if whole:
                    row, shard = np.nonzero(reachable(x, c.vectors, threshold))
                    place = (shard != near[row, 0]).astype(np.int64)
                else:
                    row, place = np.nonzero(near >= 0)
                    shard = near[row, place]
                shards = pa.FixedSizeListArray.from_arrays(pa.array(near[row].ravel().astype(np.int32)), near.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[col.take(pa.array(row)) for col in part.columns], pa.array(shard.astype(np.int32)), pa.array(place.astype(np.int32)), shards, pa.array(border[row])], names=[*batch.schema.names, "shard", "place", "shards", "border"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("rep", "copies", "embedding").mapInArrow(run, f"rep long, copies long, embedding {kind}, shard int, place int, shards array<int>, border boolean")


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))


def _linked(rows: DataFrame, threshold: float, shard_rows: int, effort: int, whole: bool = False) -> DataFrame:
    """(rep, links, root) from the rows of ``_shards``: of each vector and shard the copies it
    links with; root joins groups.  If ``whole``, by comparing all and not by graphs, at home only."""
    asks = rows.where("place = 0") if whole else rows
    split = lambda df, name: df.groupBy("shard").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias(name))
    sizes = split(rows, "parts").join(split(asks, "asks"), "shard", "left").select("shard", "parts", F.coalesce("asks", F.lit(1)).alias("asks"))
    sizes = F.broadcast(sizes)  # a row for each centroid, of which there are at most ``most_centroids``
    own = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), n).cast("int")
    nodes = rows.join(sizes, "shard").withColumn("part", own(F.col("parts"), 1))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["rep"].to_numpy()
        lists = pruned(_vectors(pdf), effort)
        return pd.DataFrame({"rep": ids, "near": [ids[a[a >= 0]] for a in lists]})

    none = F.array().cast("array<long>")
    if whole:
        listed = nodes.withColumn("near", none)
    else:
        graphs = nodes.groupBy("shard", "part").applyInPandas(build, "rep long, near array<long>")
        united = graphs.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        listed = nodes.join(united, "rep")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["rep", "copies", "embedding", "shards", "place"]
    graph = listed.select("shard", "part", each(F.col("asks")).alias("ask"), *columns, "near", F.lit(False).alias("asking"))
    asking = asks.join(sizes, "shard").select("shard", each(F.col("parts")).alias("part"), own(F.col("asks"), 2).alias("ask"), *columns, none.alias("near"), F.lit(True).alias("asking"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["asking", "rep"], ignore_index=True)
        node, ask = pdf[~pdf["asking"]], pdf[pdf["asking"]]
        if not len(node) or not len(ask):
            return pd.DataFrame({"rep": ask["rep"], "links": np.zeros(len(ask), np.int64), "root": ask["rep"]})
        ids = node["rep"].to_numpy()
        place = {v: i for i, v in enumerate(ids.tolist())}
        lists = [np.array([place[v] for v in near if v in place], np.int64) for near in node["near"]]
        before = [np.asarray(s[:p]) for s, p in zip(ask["shards"], ask["place"], strict=True)]
        links, node_root, ask_root = link(ids, _vectors(node), node["copies"].to_numpy(), lists, ask["rep"].to_numpy(), _vectors(ask), threshold, np.stack(node["shards"].to_numpy()), None if whole else before, whole)
        moved = node_root != ids
        return pd.DataFrame({"rep": np.r_[ask["rep"], ids[moved]], "links": np.r_[links, np.zeros(moved.sum(), np.int64)], "root": np.r_[ask_root, node_root[moved]]})

    return graph.unionByName(asking).groupBy("shard", "part", "ask").applyInPandas(search, "rep long, links long, root long")


def _true_links(rows: DataFrame, sample: list, threshold: float) -> dict[int, int]:
    """How many classes' copies each sampled vector links with, compared with all rows."""
    ids, q = np.array([r["rep"] for r in sample]), unit(np.array([r["embedding"] for r in sample], np.float64))
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = mine @ unit(matrix(batch.column("embedding"))).T >= threshold
                near &= own[:, None] != batch.column("rep").to_numpy()[None, :]
                total += near @ batch.column("copies").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], names=["rep", "links"])

    counted = rows.select("rep", "copies", "embedding").mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    return {r["rep"]: r["links"] for r in counted.collect()}


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, overlap: int = 3, shard_rows: int = 8000, audit: int = 512, most_effort: int = 8, least_recall: float = 0.9999, most_centroids: int = 32_768) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    ship(embeddings.sparkSession)
    rows = usable(embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull()))
    classes = numbered(stored(rows.groupBy("embedding").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies")), "classes"))
    found = classes.select("rep", F.lit(0).cast("long").alias("links"), F.col("rep").alias("root")).limit(0)
    for part in by_dimension(classes):
        found = found.unionAll(_found(part, threshold, overlap, shard_rows, audit, most_effort, least_recall, most_centroids))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "group")
    facts = classes.join(links, "rep", "left").join(groups, classes.rep == groups.node, "left").withColumn("group", F.coalesce("group", "rep"))
    names = facts.groupBy("group").agg(F.min("name").alias("component"))
    facts = facts.join(names, "group")
    facts = facts.select(F.xxhash64("embedding").alias("hash"), F.col("embedding").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    out = embeddings.select("vec_id", "embedding").withColumn("hash", F.xxhash64("embedding")).join(facts.withColumnRenamed("hash", "of"), (F.col("hash") == F.col("of")) & (F.col("embedding") == F.col("same")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _found(classes: DataFrame, threshold: float, overlap: int, shard_rows: int, audit: int, most_effort: int, least_recall: float, most_centroids: int) -> DataFrame:
    """(rep, links, root) of the classes of one dimension, audited."""
    n = classes.count()
    k = int(np.clip(round(n * overlap / (0.6 * shard_rows)), 1, most_centroids))
    table = drawn(classes, "rep", max(20 * k, min(64 * k, 40_000))).select("rep", "embedding").toArrow().sort_by("rep")
    sample = matrix(table["embedding"].combine_chunks()) if len(table) else matrix_of_first(classes)
    centres, effort = Centres(sample, min(k, len(sample))), 1
    while True:
        overlap = min(overlap, len(centres.vectors))
        rows = stored(_shards(classes, centres, overlap, threshold), "shards")
        found = stored(_linked(rows, threshold, shard_rows, effort), "linked")
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        checks = _checks(classes, stored(rows.where("place = 0").select("rep", "border").join(links, "rep", "left"), "homes"), audit)
        truth = _true_links(classes, checks, threshold + 1e-12) if checks else {}  # rounding decides about nearer ones
        names = F.broadcast(classes.sparkSession.createDataFrame([(int(i),) for i in truth], "rep long"))
        got = {r["rep"]: r["links"] for r in links.join(names, "rep").collect()}
        seen, there = sum(min(got.get(i, 0), m) for i, m in truth.items()), sum(truth.values())
        LOG.warning("audit of %d vectors, overlap %d, effort %d: %d of %d links found", len(truth), overlap, effort, seen, there)
        if seen >= least_recall * there:
            return found
        if effort >= most_effort:
            break
        overlap, effort = 2 * overlap, 2 * effort
    LOG.warning("the audit still fails: comparing every vector with all that may be near")
    few = Centres(sample, int(np.clip(round(n / shard_rows), 1, min(1024, len(sample)))))
    return stored(_linked(stored(_shards(classes, few, 1, threshold, whole=True), "shards"), threshold, shard_rows, effort, whole=True), "linked")


def _checks(classes: DataFrame, homes: DataFrame, most: int) -> list:
    """Classes to audit: some of all, of those near borders, of those with links, of both."""
    parts = (homes, homes.where("border"), homes.where("links > 0"), homes.where("border AND links > 0"))
    reps = {r["rep"] for part in parts for r in drawn(part.select("rep"), "rep", most).collect()}
    names = classes.sparkSession.createDataFrame([(i,) for i in sorted(reps)], "rep long")
    return classes.join(F.broadcast(names), "rep").select("rep", "embedding").collect()


def numbered(classes: DataFrame) -> DataFrame:
    """``classes`` with a ``rep`` of its own for each: a hash of the vector, whose seed goes
    up until no two vectors share one.  One vec_id may stand on several vectors."""
    seed = 0
    while True:
        out = classes.withColumn("rep", F.xxhash64(F.lit(seed), "embedding"))
        if out.groupBy("rep").count().where("count > 1").isEmpty():
            return out
        seed += 1


def matrix_of_first(classes: DataFrame) -> np.ndarray:
    """The first class's vector, where the sample came out empty."""
    return np.array([classes.orderBy("rep").first()["embedding"]], np.float64)
