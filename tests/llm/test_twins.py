"""The classifiers' queries, row by row, against plain Python versions of what they compute."""

import math
import re

import numpy as np
import pytest

from tidemark.llm import language, quality, toxicity
from tidemark.llm.queries import op2_language, op3_quality, op10_toxicity, table

DATA = "/root/testdata/sf0.01"


class PlainKernel:
    """Presence kernels from sets of strings."""

    def __init__(self, marks, most=120):
        seen = {}
        for t in marks:
            for ch in t.lower():
                if ch.isalpha() and ord(ch) < 1 << 16:
                    seen[ch] = seen.get(ch, 0) + 1
        self.alphabet = set(sorted(seen, key=lambda ch: (-seen[ch], ch))[:most])
        self.known = set().union(*[self.all_grams(t) for t in marks])

    def all_grams(self, text):
        name = lambda ch: ch if ch in self.alphabet else "?" if ord(ch) >= 1 << 16 or ch.isalpha() else " "
        flat = re.sub(" +", " ", "".join(map(name, f" {text.lower()} ")))
        return {flat[i : i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1)}

    def grams(self, text):
        return self.all_grams(text) & self.known


def test_language_equals_plain_kernel_ridge(spark, sf):
    docs = table(spark, sf, "documents")
    texts, langs = language.sample(docs)
    names = sorted(set(langs))
    marks = [t for k in names for t in [x for x, lang in zip(texts, langs, strict=True) if lang == k][:48]]
    plain = PlainKernel(marks)
    sets = [plain.grams(t) for t in marks]
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in sets] for a in sets]))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])

    def space(given):
        x = np.array([[kernel(plain.grams(t), b) for b in sets] for t in given]) @ root
        return np.c_[x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), np.ones(len(x))]

    x, y = space(texts), np.array([names.index(k) for k in langs])
    weight = 1.0 / np.bincount(y)[y]
    weight *= len(y) / weight.sum()
    weights = np.linalg.solve(x.T @ (x * weight[:, None]) + 1e-3 * len(y) * np.eye(x.shape[1]), x.T @ (np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0) * weight[:, None]))
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    outputs = dict(zip(rows, space(list(rows.values())) @ weights, strict=True))
    got = op2_language(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        out = outputs[r.doc_id]
        if not any(ch.isalpha() for ch in rows[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.score == pytest.approx(min(1, max(0, (out.max() + 1) / 2)), abs=5e-3)
            assert r.lang_pred == names[out.argmax()] or np.sort(out)[-1] - np.sort(out)[-2] < 1e-2


def plain_features(text):
    kinds = []
    for ch in text:
        k = next((6 + i for i, group in enumerate(quality.MARKS) if ch in group), None)
        if k is None:
            k = quality.OTHER
            if ord(ch) < 1 << 16:
                k = (1 if ch == "\n" else 0) if ch.isspace() else (3 if ch.isupper() else 2) if ch.isalpha() else 4 if ch.isdigit() else k
        kinds.append(k)
    n, width = max(1, len(text)), quality.KINDS
    single, double, ascii_ = np.zeros(width), np.zeros(width * width), np.zeros(129)
    for k in kinds:
        single[k] += 1 / n
    for a, b in zip(kinds, kinds[1:], strict=False):
        double[a * width + b] += 1 / n
    for ch in text:
        ascii_[min(ord(ch), 128)] += 1 / n
    words, word = [], ""
    for ch, k in zip(text, kinds, strict=True):
        if k > quality.BREAK:
            word += ch
        elif word:
            words, word = [*words, word], ""
    words += [word] if word else []
    rest = np.zeros(9)
    rest[8] = math.log1p(n)
    if words:
        m, distinct = len(words), len(set(words))
        rest[:8] = [sum(map(len, words)) / m / 10, sum(len(w) > 12 for w in words) / m, sum(len(w) == 1 for w in words) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, distinct / m, math.log1p(m) - math.log1p(distinct), m / n, math.log1p(m)]
    return np.r_[single, double, ascii_, rest]


def test_quality_equals_plain_network(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    net, _ = quality.train(docs, labels)
    w1, b1, w2, b2 = (w.astype(float) for w in net.layers)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    got = op3_quality(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        x = np.clip((plain_features(rows[r.doc_id]) - net.mean) / net.scale, -6, 6)
        hidden = [max(0.0, float(x @ w1[:, j] + b1[j])) for j in range(w1.shape[1])]
        g = sum(h * float(w) for h, w in zip(hidden, w2[:, 0], strict=True)) + float(b2[0])
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, g)))), abs=2e-3)
        assert r.predicted == int(r.score >= 0.5)


def test_decision_point_stays_between_its_bounds():
    rng = np.random.default_rng(2)
    p, u = rng.normal(3, 1, 10_000), np.r_[rng.normal(3, 1, 6000), rng.normal(-3, 1, 4000)]
    at = quality.decision_point(p, u, 0.6)
    assert np.quantile(p, 0.0005) <= at <= np.quantile(p, 0.004)
    assert quality.decision_point(p, u, 0.01) == pytest.approx(np.quantile(p, 0.004))
    assert quality.decision_point(p, u, 0.99) == pytest.approx(np.quantile(p, 0.0005))


def test_toxicity_equals_plain_matching(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    lexicon = toxicity.train(docs, labels)
    assert lexicon.weights
    rows = {r.doc_id: r.text or "" for r in docs.collect()}

    def places(entry, folded):
        at = folded.find(entry)
        while at >= 0:
            yield at
            at = folded.find(entry, at + 1)

    got = op10_toxicity(spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:
        folded = toxicity.fold(rows[r.doc_id])
        best, spared = {}, set()
        for entry in lexicon.exceptions:
            for at in places(entry, folded):
                spared.update(range(at, at + len(entry)))
        for entry, weight in lexicon.weights.items():
            for at in places(entry, folded):
                best[at] = max(best.get(at, 0), weight)
        found = [w for at, w in best.items() if at not in spared]
        long = math.sqrt(max(1, len(folded.split())))
        x = [sum(found) / long, len(found) / long, max(found, default=0.0), float(bool(found))]
        g = sum(math.log1p(v) * c for v, c in zip(x, lexicon.curve, strict=False)) + lexicon.curve[4]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, g)))), abs=1e-6)
        assert r.predicted == int(r.score >= 0.3)


def test_repeated_and_long_rows_score_like_single_ones(spark):
    """Equal texts score alike wherever they stand; a very long text is read to its end."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    texts = [r.text for r in docs.where("text IS NOT NULL").limit(3).collect()]
    long = " ".join([texts[0]] * 60)
    odd = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, long), (4, long + " x"), (None, texts[1]), (6, texts[1])], "doc_id long, text string")
    for made in (
        language.predict(odd, language.train(docs)),
        quality.score(odd, quality.train(docs, labels)),
        toxicity.score(odd, toxicity.train(docs, labels)),
    ):
        score = {}
        for r in made.collect():
            score.setdefault(r.text, []).append(r.score)
        assert len(score) == 4 and all(max(s) - min(s) < 1e-4 for s in score.values())  # sums in single precision
