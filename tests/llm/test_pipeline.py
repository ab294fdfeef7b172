"""The pipeline's stages, each held against plain Python on what the one before it kept."""

import hashlib
import sys
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as pipeline  # noqa: E402
from test_duplicates import joined, plain_fingerprint  # noqa: E402

from tidemark.llm import language, quality  # noqa: E402
from tidemark.llm.queries import table, tokenizer_path  # noqa: E402
from tidemark.llm.runtime import stored  # noqa: E402


def near(a, b, most):
    """Is the edit distance at most ``most``?  Plain banded rows."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(most + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, 99) + 1
            if j:
                best = min(best, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (x != b[j - 1]))
            new[j] = best
        if min(new.values()) > most:
            return False
        row = new
    return row.get(len(b), 99) <= most


def without_repeats(docs):
    first = {}
    for i, t in sorted(docs.items()):
        for p, x in enumerate(t.split("\n")):
            if x.strip(" "):
                first.setdefault(x, (i, p))
    order = sorted(first, key=first.get)
    long = [x for x in order if len(x) > 9]
    later = {x for k, x in enumerate(long) if any(near(y, x, 2) for y in long[:k])}
    keep = lambda i, p, x: x not in first or (x not in later and first[x] == (i, p))
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if keep(i, p, x)) for i, t in docs.items()}


def test_stages(spark, sf):
    texts = lambda df: {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    docs = table(spark, sf, "documents")
    columns = docs.columns
    plain, steps = texts(docs), dict(pipeline.STAGES)
    assert list(steps) == ["language", "quality", "lines", "near_duplicates", "packing"]

    model = language.train(docs)
    names, scores = model.predict(list(plain.values()))
    plain = {i: plain[i] for i, n, s in zip(list(plain), names, scores, strict=True) if n != "und" and s >= pipeline.LEAST_LANGUAGE_SCORE}
    docs = stored(steps["language"](spark, docs, sf), "t1")
    assert docs.columns == columns and texts(docs) == plain

    network, _ = quality.train(docs, table(spark, sf, "labels"))
    g = network.output(quality.features(list(plain.values())))
    plain = {i: plain[i] for i, x in zip(list(plain), g, strict=True) if x >= 0}
    docs = stored(steps["quality"](spark, docs, sf), "t2")
    assert docs.columns == columns and texts(docs) == plain and len(plain) > 100

    plain = without_repeats(plain)
    docs = stored(steps["lines"](spark, docs, sf), "t3")
    assert docs.columns == columns and texts(docs) == plain
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    fps = {i: plain_fingerprint(t) for i, t in plain.items()}
    ids = sorted(fps)
    groups = joined([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    plain = {i: t for i, t in plain.items() if groups[i] == i}
    docs = stored(steps["near_duplicates"](spark, docs, sf), "t4")
    assert docs.columns == columns and texts(docs) == plain

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in plain.items()}
    packed = steps["packing"](spark, docs, sf).collect()
    got, fill = {}, {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert got == want and max(fill.values()) <= 1024

    digest = lambda rows: hashlib.sha256(str(sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)).encode()).hexdigest()
    assert digest(pipeline.run(spark, sf).collect()) == digest(packed)
    assert np.mean([v / 1024 for v in fill.values()]) > 0.8


ROWS = [
    (1, None, "en", "s", 0, "x", 1.0),
    (2, "", "en", "s", 0, "x", 1.0),
    (3, " \n\t ", None, None, 3, None, None),
    (4, "the cat sat on the mat and looked at the dog for a while", "en", "s", 1, "x", 1.0),
    (4, "the cat sat on the mat and looked at the dog for a while", "en", "s", 1, "x", 1.0),
    (4, "the cat sat on the mat and looked at the dog for a while", "en", "t", 1, "x", 1.0),
    (5, "the cat sat on the mat and looked at the dog for a while", "en", "s", 1, "x", 1.0),
    (None, "the cat sat on the mat and looked at the dog for a while", "en", "s", 1, "x", 1.0),
    (None, "a row without an id, but with a text of its own to look at", "en", "s", 1, "x", 1.0),
    (None, "a row without an id, but with a text of its own to look at", "en", "s", 1, "x", 1.0),
    (7, "word " * 20_000, "en", "s", 1, "x", 1.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, places string, score double"


def test_odd_rows_in_every_stage(spark, sf):
    """Nulls, empty and long texts, repeated rows, ties, and columns with the operators' names."""
    odd = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("_row", "r1", "fp", "links", "n_links", "n_removed", "lang_pred", "held_out", "predicted", "group", "h"):
        odd = odd.withColumn(name, odd.places)
    none, stages = odd.limit(0), dict(pipeline.STAGES)
    for name, stage in pipeline.STAGES:
        rows = stage(spark, odd, sf)
        assert stage(spark, none, sf).count() == 0
        if name != "packing":
            assert rows.schema.simpleString() == odd.schema.simpleString()
            assert all(r["r1"] == r["places"] and r["score"] in (1.0, None) for r in rows.collect())
    kept = [(r.doc_id, r.text) for r in stages["language"](spark, odd, sf).collect()]
    assert not {1, 2, 3} & {i for i, _ in kept}
    texts = [(r.doc_id, r.text) for r in stages["lines"](spark, odd, sf).collect()]
    assert len(texts) == len(ROWS) and (1, None) in texts and (3, ROWS[2][1]) in texts
    assert sum(t == ROWS[3][1] for _, t in texts) == 1 and sum(t == ROWS[8][1] for _, t in texts) == 1
    groups = [(r.doc_id, r.text, r.source) for r in stages["near_duplicates"](spark, odd, sf).collect()]
    assert sum(t == ROWS[3][1] for _, t, _ in groups) == 1 and sum(t == ROWS[8][1] for _, t, _ in groups) == 1
    assert [i for i, t, _ in groups if t == ROWS[3][1]] == [4]
    assert sum(not (t or "").strip() for _, t, _ in groups) == 1  # null, empty and white texts share a fingerprint
    packed = stages["packing"](spark, odd, sf)
    assert packed.where("piece = 0").count() == len(ROWS)
