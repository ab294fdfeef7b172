"""SimHash, lines, vectors and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import annsearch, flatgraph, linededup, simhash
from tidemark.llm.components import components
from tidemark.llm.queries import op1_embedding_dedup, op7_line_dedup, op8_simhash, op9_nearest, table


def joined(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = joined(pairs, {n for p in pairs for n in p})
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    want = joined([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_anchor_links_equal_all_pairs(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:
        for _ in range(3):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
            fps.append(f)
    fps = sorted(set(fps))
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    want = joined([(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3], range(len(fps)))
    for most in (8192, 1):
        found = simhash.links(spark.createDataFrame(rows, "fp long, rep long"), most_home=most)
        assert joined([tuple(r) for r in found.collect()], range(len(fps))) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def banded(a, b, most=2):
    """The edit distance, or some number above ``most``."""
    row = {j: j for j in range(most + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, 99) + 1, new.get(j - 1, 99) + 1 if j else 99, row.get(j - 1, 99) + (x != b[j - 1]) if j else 99)
        if min(new.values()) > most:
            return 99
        row = new
    return row.get(len(b), 99)


def plain_dedup(docs, threshold, least, quick=False):
    lines = sorted((i, p, x) for i, t in docs for p, x in enumerate(t.split("\n")) if len(x) >= least and x.strip(" "))
    first = {}
    for i, p, x in lines:
        first.setdefault(x, (i, p))
    order = sorted(first, key=first.get)
    joins = [x for x in order if len(x) > (threshold + 1) ** 2]
    apart = banded if quick else distance
    links = {x: [] for x in order} | {x: [y for y in joins if y != x and abs(len(x) - len(y)) <= threshold and apart(x, y) <= threshold] for x in joins}
    later = {x for x in order if any(first[y] < first[x] for y in links[x])}
    out = {}
    for i, t in docs:
        parts = t.split("\n")
        gone = {p for p, x in enumerate(parts) if x in first and (x in later or first[x] != (i, p))}
        kept = "\n".join(x for p, x in enumerate(parts) if p not in gone)
        out[i] = (len(parts), len(gone), sum(len(links[x]) for x in parts if x in links), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_lines_equal_brute_force(spark, threshold):
    rng = random.Random(threshold)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 6)))
    pool = [" ".join(word() for _ in range(rng.randrange(5, 12))) for _ in range(25)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice([[], ["x"], ["ü", "y"]])
            parts.append("".join(line))
        docs.append((i, "\n".join(parts)))
    got = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), threshold, 18)
    mine = {r.doc_id: (r.n_lines, r.n_removed, r.n_links, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()}
    assert mine == plain_dedup(docs, threshold, 18)


def test_short_lines_take_part(spark):
    docs = [(1, "All rights reserved\nok\n\n "), (2, "All rights reserved.\nok\n\n "), (3, "no\nAll rights reserved\ntext of 3\ntext of 4")]
    got = {r.doc_id: (r.text, r.n_removed, r.n_links) for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 0, 1), 2: ("\n ", 2, 1), 3: ("no\ntext of 3\ntext of 4", 1, 1)}


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_links_of_short_lines_are_counted(spark, monkeypatch, threshold):
    """Every pair within the threshold is a link, however short its lines; a link with a line
    too short for segments removes nothing."""
    monkeypatch.setattr(linededup, "TILE", 5)
    rng, limit = random.Random(threshold), (threshold + 1) ** 2
    word = lambda n: "".join(rng.choice("abß😀 ") for _ in range(n))
    docs = [(i, "\n".join(word(rng.randrange(limit + threshold + 2)) for _ in range(3))) for i in range(70)]
    lines = {x for _, t in docs for x in t.split("\n") if x.strip(" ")}
    short = {x: sum(y != x and min(len(x), len(y)) <= limit and distance(x, y) <= threshold for y in lines) for x in lines}
    got = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), threshold).collect()
    assert {r.doc_id: r.n_short_links for r in got} == {i: sum(short.get(x, 0) for x in t.split("\n")) for i, t in docs}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, hashlib.sha256(r.text.encode()).hexdigest()) for r in got} == plain_dedup(docs, threshold, 1)


def test_line_plans_stay_in_the_jvm(spark, weird):
    import io
    from contextlib import redirect_stdout

    met = linededup.met_lines(linededup.distinct_lines(linededup.occurrences(weird, 1)), 2)
    with redirect_stdout(out := io.StringIO()):
        met.explain()
        linededup.near_pairs(met, 2).explain()
        linededup.dedup(weird).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()


def test_lines_that_share_a_segment_fill_many_tiles(spark, monkeypatch):
    """Many different lines of one length under one key, with tiles of three lines."""
    monkeypatch.setattr(linededup, "TILE", 3)
    rng = random.Random(11)
    docs = [(i, "the same beginning of every line " + "".join(rng.choice("ab") for _ in range(5)) + rng.choice(["", "x"])) for i in range(90)]
    got = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), 2)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()} == plain_dedup(docs, 2, 1)


def test_line_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.text_sha256) for r in op7_line_dedup(spark, sf).collect()}
    quick = plain_dedup([(i, t or "") for i, t in docs], 2, 1, quick=True)
    assert got == {i: quick[i] if t is not None else (0, 0, 0, hashlib.sha256(b"").hexdigest()) for i, t in docs}


def test_lines_of_repeated_rows(spark):
    """Rows that are equal in all columns, and rows that differ only in another column."""
    rows = [(5, "alpha beta gamma\n\nno", "p", 1), (5, "alpha beta gamma\n\nno", "p", 1), (5, "alpha beta gamma\n\nno", "q", 1), (None, "alpha beta gamma", None, 2), (None, None, None, 3), (None, None, None, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, places string, n_links int")
    plain = linededup.dedup(frame, counts=False)
    assert plain.columns == frame.columns and plain.schema["n_links"].dataType == frame.schema["n_links"].dataType
    texts = [(r.doc_id, r.text, r.places, r.n_links) for r in plain.collect()]
    assert sorted(t[1] for t in texts if t[0] == 5) == ["", "", "\nno"]  # a row without an id comes first
    assert [t for t in texts if t[3] == 2] == [(None, "alpha beta gamma", None, 2)]
    assert [t for t in texts if t[3] == 3] == [(None, None, None, 3)] * 2
    removed = sorted((r.doc_id or 0, r.n_lines, r.n_removed, r.n_links) for r in linededup.dedup(frame).collect())
    assert removed == [(0, 0, 0, 0), (0, 0, 0, 0), (0, 1, 0, 0), (5, 3, 1, 0), (5, 3, 2, 0), (5, 3, 2, 0)]


def vectors(rng, n, d=24):
    x = rng.normal(size=(n, d))
    x[n // 2 :] = x[rng.integers(0, n // 4, n - n // 2)] + rng.normal(size=(n - n // 2, d)) * rng.uniform(0, 0.12, (n - n // 2, 1))
    return x


def test_flat_graph_equals_brute_force(spark):
    x = vectors(np.random.default_rng(1), 400)
    x[20] = x[21] = x[22]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, [1.0]), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [1.0, 2.0])]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = joined(np.argwhere(near).tolist(), range(400))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in flatgraph.near_duplicates(frame, shard_rows=120).collect()}
    assert got == {i: (int(near[i].sum()), want[i], want[i] == i) for i in range(400)} | {i: (0, i, True) for i in range(1000, 1005)} | {i: (2, 1005, i == 1005) for i in (1005, 1006, 1007)}


def test_queries_of_foreign_parts_miss_nothing():
    """One wide group and some single vectors: one greedy pass ends in the group at times."""
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(1, 64)) + 0.5 * rng.normal(size=(1500, 64)), rng.normal(size=(300, 64))]
    q = np.repeat(x[1500:], 2, axis=0)
    q += 0.01 * rng.normal(size=q.shape)
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
    ids, asked = np.arange(len(x)), np.arange(10_000, 10_000 + len(q))
    lists = [a[a >= 0] for a in flatgraph.pruned(x)]
    total, _, roots = flatgraph.link(ids, x, np.ones(len(x), np.int64), lists, asked, q, 0.95)
    near = q @ x.T >= 0.95
    assert total.tolist() == near.sum(axis=1).tolist()
    assert (roots[::2] == roots[1::2]).all()


def test_vectors_that_share_a_vec_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(5, a), (9, a), (5, b), (7, [1.0, 0.1, 0.0, 0.0]), (8, [0.1, 1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in flatgraph.near_duplicates(frame).collect())
    assert got == [(5, 1, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 1, 5, False), (9, 2, 5, False)]


def test_links_beyond_all_shards_are_found(spark):
    """Wide links over many small shards: no overlap that rebuilding reaches holds them all."""
    x = np.random.default_rng(3).normal(size=(300, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.3).sum(axis=1) - 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in flatgraph.near_duplicates(frame, threshold=0.3, shard_rows=12).collect()}
    assert got == dict(enumerate(near.tolist()))


def test_cells_that_are_ruled_out_hold_no_link():
    rng = np.random.default_rng(6)
    c, x = flatgraph.unit(rng.normal(size=(40, 4))), flatgraph.unit(rng.normal(size=(500, 4)))
    may, home = flatgraph.reachable(x, c, 0.95), (x @ c.T).argmax(axis=1)
    linked = x @ x.T >= 0.95
    assert may[:, home][linked].all() and not may.all()


def test_vector_queries(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in op1_embedding_dedup(spark, sf).collect()} == dict(zip(ids.tolist(), near.tolist(), strict=True))
    found = {}
    for r in op9_nearest(spark, sf).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hit = total = 0
    for q in ids[ids % 50 == 0].tolist():
        s = u @ u[ids == q][0]
        s[ids == q] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        assert [k for k, _ in sorted(found[q])] == [1, 2, 3, 4, 5]
        hit, total = hit + len(best & {v for _, v in found[q]}), total + 5
    assert hit >= 0.9 * total


def test_nearest_of_few_rows_ties_and_salts(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in (3, 1, 2)] + [(7, [0.0, 1.0, 0.0]), (8, [0.0, 0.0, 0.0]), (9, None), (None, [1.0, 0.0, 0.0]), (5, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = annsearch.nearest(frame, F.expr("vec_id IN (1, 5, 8)")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(1, 1, 2), (1, 2, 3), (1, 3, 7)]
    assert annsearch.nearest(frame.limit(0), F.lit(True)).count() == 0
    x = np.random.default_rng(2).normal(size=(90, 8))
    more = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    more = more.selectExpr("vec_id", "embedding", "xxhash64(embedding) AS h", "1 AS copy")
    split = annsearch._search(more, more, 5, 1, 0, most=10).distinct()
    whole = annsearch._search(more, more, 5, 1, 0).distinct()
    best = lambda df: {(r.query_id, r.vec_id) for r in df.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r").where("r <= 5").collect()}
    assert best(split) == best(whole)


def test_best_rows_of_many_buckets():
    """What a task hands on has each query's best rows, each once."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = [(int(q), 0, int(v), 0, 1, round(float((q * 31 + v * 17) % 23), 1)) for q, v in rng.integers(0, 30, (3000, 2))]
    names = ["query_id", "query_h", "vec_id", "h", "copy", "score"]
    got = annsearch._combined(pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows]), 4).to_pylist()
    want = {}
    for r in sorted(set(rows), key=lambda r: (r[0], -r[5], r[2])):
        if len(want.setdefault(r[0], [])) < 4:
            want[r[0]].append(r[2])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == want


def test_nearest_of_repeated_rows(spark):
    """Equal rows, one vec_id on two vectors, and more equal vectors than there are ranks."""
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(2, a), (2, a), (2, b), (4, a), (6, c)] + [(100 + i, c) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in annsearch.nearest(frame, F.expr("vec_id IN (2, 6, 110)")).collect():
        got.setdefault((r.query_id, r["rank"]), []).append(r.vec_id)
    assert sorted(got[2, 1]) == [2, 2, 2] and sorted(got[2, 2]) == [2, 4, 4] and sorted(got[2, 3]) == [2, 2, 4]  # twice a, once b
    assert [got[6, k] for k in range(1, 6)] == [[100], [101], [102], [103], [104]]
    assert [got[110, k] for k in range(1, 6)] == [[6], [100], [101], [102], [103]]


def test_odd_rows(spark, weird, no_rows):
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(weird).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 4), (6, 6)} <= groups
    assert simhash.near_duplicates(weird).count() == weird.count()
    kept = linededup.dedup(weird)
    assert kept.count() == weird.count()
    by_id = {r.doc_id: r for r in kept.where("doc_id > 10").collect()}
    assert by_id[11].text == "line one is here for all to see\nline two is here for all to see\n" and by_id[11].n_removed == 1
    assert by_id[12].text == "short"
    assert kept.where("doc_id = 1").first().text is None
    for f in (simhash.near_duplicates, linededup.dedup):
        assert f(no_rows).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert flatgraph.near_duplicates(none).count() == 0
