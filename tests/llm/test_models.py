"""Language, quality, toxicity and LM scores: held-out accuracy and exact parts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import language, lmscore, quality, toxicity
from tidemark.llm.queries import op2_language, op3_quality, op5_lm_score, op10_toxicity, table

DATA = "/root/testdata/sf0.01"


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_language_held_out(spark):
    rows = op2_language(spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in test) >= 0.97 * len(test)


def test_presence_kernel_counts_shared_grams():
    grams = language.Grams.of(["abc abd", "xyz"])
    rows, sizes = grams.presence(["abc", "ABC  abc!", ""])
    sets = [set() for _ in range(3)]
    for k, t in enumerate([" abc ", " abc abc "]):
        sets[k] = {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    marks = {t[i : i + n] for t in (" abc abd ", " xyz ") for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert sizes[:2].tolist() == [len(sets[0] & marks), len(sets[1] & marks)]
    assert (rows[0] @ rows[1]) == len(sets[0] & sets[1] & marks)


def test_quality_held_out(spark):
    rows = op3_quality(spark, DATA).join(table(spark, DATA, "labels"), "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in test) >= 0.95 * len(test)
    good = [r for r in test if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)


def test_risk_slopes_by_differences():
    rng = np.random.default_rng(0)
    gp, gu = rng.normal(size=5), rng.normal(size=7)

    def risk(a, b, p):
        soft = lambda g: np.logaddexp(0, g)
        negative = soft(b).mean() - p * soft(a).mean()
        return p * soft(-a).mean() + negative if negative >= 0 else -negative

    for p in (0.3, 0.95):
        for shift in (0, -6):
            dp, du = quality.risk_step(gp, gu + shift, p)
            e = 1e-6 * np.eye(7)
            assert np.allclose(dp, [(risk(gp + e[i, :5], gu + shift, p) - risk(gp - e[i, :5], gu + shift, p)) / 2e-6 for i in range(5)], atol=1e-5)
            assert np.allclose(du, [(risk(gp, gu + shift + e[i], p) - risk(gp, gu + shift - e[i], p)) / 2e-6 for i in range(7)], atol=1e-5)


def test_prior_estimate():
    rng = np.random.default_rng(3)
    p = rng.normal(3, 1, 4000)
    u = np.r_[rng.normal(3, 1, 5600), rng.normal(-3, 1, 2400)]
    assert abs(quality.estimate_prior(p, u) - 0.7) < 0.05


def test_toxicity_held_out(spark):
    rows = op10_toxicity(spark, DATA).join(table(spark, DATA, "labels"), "doc_id").join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.lang == "en"]  # at this size only English repeats its words
    bad = [r for r in test if r.toxic]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad)
    assert sum(r.predicted for r in test if not r.toxic) <= 0.02 * len(test)


def test_folding_lexicon_and_exceptions():
    assert toxicity.fold("1d1ot, IDI0T; іdіоt i​diot ｉｄｉｏｔ a$$hat") == " idiot idiot idiot idiot idiot asshat "
    assert toxicity.fold("") == "  "
    lexicon = toxicity.Lexicon({" clow": 5.0, " scum ": 4.0}, {" clown fish ": None}, np.array([4.0, 0.0, 2.0, 0.0, -6.0]))
    assert lexicon.sums("the clown fish swims")[3] == 0.0
    assert lexicon.sums("the CL0WNS of scum")[3] == 1.0 and lexicon.sums("scumbag")[3] == 0.0
    long, short = lexicon.sums("scum " + "fine " * 400)[0], lexicon.sums("scum")[0]
    assert long < short


def test_lm_counts_are_exact_and_probabilities_sum_to_one(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    c, ends = Counter(), 0
    for i, t in docs.items():
        if crc(i, 7) != 2:
            c.update(t.encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda k: math.log10((k + 1) / (n + v + 1))
    for head, indexed in ((2000, 100_000), (50, 300)):
        got = {r.doc_id: r for r in lmscore.score(table(spark, sf, "documents"), head=head, indexed=indexed, small=10).collect()}
        assert len(got) == len(docs)
        for i, t in docs.items():
            w, r = t.encode().lower().split(), got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
            assert r.base_score == pytest.approx(sum(base(c[x]) for x in w) + base(ends), rel=1e-9)
        test = [r for r in got.values() if r.held_out]
        assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_normalisers_and_contexts():
    rng = np.random.default_rng(0)
    found = np.array([[0, 1, 2], [1, 2, 0], [3, 1, 4], [0, 0, 1]])[rng.integers(0, 4, 4000)]
    n = lmscore.train((found[:, 0] * 6 + found[:, 1]) * 6 + found[:, 2], 6)
    z = n.normalisers()
    for x in range(6):
        for y in range(6):
            energy = (n.r[x] @ n.c1 + n.r[y] @ n.c2) @ n.q.T + n.b
            assert np.log(np.exp(energy.astype(float)).sum()) == pytest.approx(z[x, y], abs=1e-4)
    after = lambda y, x: int(((n.r[x] @ n.c1 + n.r[y] @ n.c2) @ n.q.T + n.b).argmax())
    assert (after(0, 1), after(1, 2), after(3, 1), after(0, 0)) == (2, 0, 4, 1)  # the farther class tells 2 from 4


def test_scores_token_by_token(spark, sf):
    """The model's softmax over all classes, one token at a time, for every text."""
    docs = table(spark, sf, "documents")
    counts = lmscore.word_counts(docs)
    size = {"head": 60, "tails": 7, "indexed": 200}
    fitted = lmscore.fit(docs, counts, **size, per_root=400, most_examples=20_000)
    n, k = fitted.network, fitted.classes
    c = {bytes(r.word): r.c for r in counts.collect()}
    head = sorted((w for w in c if w), key=lambda w: (-c[w], w))[:60]
    tail_of = lambda w: zlib.crc32(w[-2:]) % 7
    mass = [1 + sum(c[w] + 1 for w in c if w and w not in set(head) and tail_of(w) == t) for t in range(7)]
    number = {w: i + 1 for i, w in enumerate(head)}
    texts, logs = {d.doc_id: (d.text or "").encode().lower().split() for d in docs.collect()}, {}
    for r in lmscore.score(docs, **size, per_root=400, most_examples=20_000).collect():
        want, y, x = 0.0, 0, 0
        for w in [*texts[r.doc_id], b""]:
            t = 0 if not w else number.get(w, 61 + tail_of(w))
            if (x, y) not in logs:
                e = ((n.r[x] @ n.c1 + n.r[y] @ n.c2) @ n.q.T + n.b).astype(float)
                logs[x, y] = (e - np.logaddexp.reduce(e)) / np.log(10)
            want += logs[x, y][t] + (math.log10((c.get(w, 0) + 1) / mass[t - 61]) if t >= 61 else 0)
            x, y = t, x
        assert r.score == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert k.size == 68


def test_every_training_token_is_learned_from(spark, sf):
    """An Adagrad step moves only the vectors of classes that it meets: all that training holds
    must have left their first places, also where a first learner gets a few tokens only; and
    partitions don't change the network."""
    docs = table(spark, sf, "documents")
    size = {"head": 2000, "tails": 7, "indexed": 5000, "per_root": 400, "most_examples": 2000}
    fitted = lmscore.fit(docs, lmscore.word_counts(docs), **size)
    start = np.random.default_rng(11).normal(0, 0.1, (fitted.classes.size, 32)).astype(np.float32)
    met = {0}
    for d in docs.collect():
        if crc(d.doc_id, 7) != 2:
            met |= set(fitted.classes.numbers((d.text or "").encode().lower().split())[1].tolist())
    still = (fitted.network.r == start).all(axis=1)
    assert len(met) > 2000 and not still[sorted(met)].any()
    again = lmscore.fit(docs.repartition(5), lmscore.word_counts(docs), **size)
    assert np.allclose(again.network.r, fitted.network.r, atol=1e-5)


def test_sequences_and_rounds_hold_every_token_once(spark, weird):
    classes = lmscore.Classes.of([b"the", b"word"], 2, 3)
    texts = lmscore.rounds_of(lmscore.sequences(weird, classes), 0.01).collect()
    want = [r.text for r in weird.collect() if r.doc_id is None or crc(r.doc_id, 7) != 2]
    assert sorted(t.tokens for t in texts) == sorted(len((t or "").encode().split()) + 1 for t in want)
    assert {t["round"] for t in texts} <= set(range(8)) and max(t["round"] for t in texts) >= 5
    y, x, w = lmscore.examples([np.array([0, 0, 3, 1, 0]), np.array([0, 0, 0]), np.array([0, 0, 2, 0])])
    assert list(zip(y.tolist(), x.tolist(), w.tolist(), strict=True)) == [(0, 0, 3), (0, 3, 1), (3, 1, 0), (0, 0, 0), (0, 0, 2), (0, 2, 0)]


def test_odd_rows(spark, weird, no_rows, some_labels):
    rows = weird.count()
    named = {r.doc_id: r.lang_pred for r in language.identify(weird).collect()}
    assert named[1] == named[2] == named[3] == named[9] == "und"
    assert language.identify(weird).count() == rows
    assert language.predict(weird, language.train(weird)).columns[: len(weird.columns) - 1] == [c for c in weird.columns if c != "score"]
    assert quality.classify(weird, some_labels).count() == rows
    assert toxicity.detect(weird, some_labels).count() == rows
    assert lmscore.score(weird).count() == rows
    nobody = some_labels.limit(0)
    assert quality.classify(weird, nobody).where("score = 0.5").count() == rows
    assert toxicity.detect(weird, nobody).where("score = 0").count() == rows
    assert language.identify(no_rows).count() == 0
    assert quality.classify(no_rows, nobody).count() == 0
    assert toxicity.detect(no_rows, nobody).count() == 0
    assert lmscore.score(no_rows).count() == 0
