"""Language-model scores, source divergence and whitening against plain versions on small tables with odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import audit, lbl, whitening
from pageloom.llm.words import Words

DOCS = "doc_id long, text string, lang string, source string, n int, term string, block int, word string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def random_texts(n, seed, vocabulary=40):
    r = np.random.default_rng(seed)
    names = ["".join(r.choice(list("abcdeéßÉXYZ-'1"), r.integers(1, 22))) for _ in range(vocabulary)]
    return [" ".join(r.choice(names, r.integers(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return [*random_texts(120, 1), "", None, "  \t\n", "x" * 300 + " " + "x" * 299 + "y", " ".join(["long"] * 30_000), "same text", "same text", "ÀÉ à é \x7f\x00b"]


@pytest.fixture(scope="module")
def rows(texts):
    return [(i if i % 17 else None if i else 0, t, [None, "", "en", "de"][i % 4], ["a", "b", None, "c", ""][i % 5 if i % 3 else 0], 7, "clash", 1, "w") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_words_are_those_of_a_pattern(texts):
    found = Words(pa.array(texts).slice(3), lbl.WORD)
    want = [(k, w) for k, t in enumerate(texts[3:]) for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))]
    assert list(zip(found.rows.tolist(), found.texts(np.arange(len(found.starts))).to_pylist(), strict=True)) == want
    number, first = found.distinct()
    assert len(first) == len({w for _, w in want})
    assert [found.texts(first[[k]])[0].as_py() for k in number[:50]] == [w for _, w in want[:50]]
    assert len({int(h) for h in found.hashed()}) == len(first)
    for most in (1, 4, 8, 9, 16):
        cut = [w.encode()[:most] for _, w in want]
        assert len({*zip(cut, found.hashed(most).tolist(), strict=True)}) == len({*cut}) == len({*found.hashed(most).tolist()})


def brute_divergence(rows, least, top):
    groups, docs, count = set(), Counter(), Counter()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        docs.update((lang, t) for t in {*terms})
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        p = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * len(kept))  # noqa: B023, E731
        total = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        rate = {(s, t): p(count[lang, s, t], total[s]) for s in sources for t in kept}
        whole = {t: p(sum(count[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(rate[s, t] - rate[o, t]) for t in kept)) for o in sources if o != s]
            terms = [(t, rate[s, t] - whole[t]) for t in kept if count[lang, s, t] and rate[s, t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked[:most])]
    return out


@pytest.mark.parametrize(("least", "first", "bits"), [(5, 4, 1 << 26), (2, 1, 64), (25, 3, 1 << 10), (1, 4, 1 << 20), (1000, 4, 1 << 20)])
def test_divergence(docs, rows, least, first, bits, monkeypatch):
    whole = audit.frequent_terms
    monkeypatch.setattr(audit, "frequent_terms", lambda d, n: whole(d, n, first, bits))
    got = audit.divergence(docs, least, 6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_divergence(rows, least, 6))


def test_divergence_odd_tables(spark, docs, rows):
    assert audit.divergence(spark.createDataFrame([], DOCS)).count() == 0
    twice = sorted(map(tuple, audit.divergence(docs.unionByName(docs), 10, 4).collect()))
    assert twice == sorted(brute_divergence([*rows, *rows], 10, 4))
    large = spark.range(1).select(audit.share(audit.F.lit(10**15), "id", "id").alias("p")).where("false")
    assert large.count() == 0


def test_share_is_exact(spark):
    cases = [(0, 1, 1), (10**12, 3 * 10**12 + 1, 10**6), (7, 10**13, 3)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(audit.share("c", "n", "v").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]


def test_language_scores(docs, rows):
    got = lbl.language_scores(docs).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), ""] for _, t, *_ in rows]
    count = Counter(w for (i, *_), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for (i, *_), ws in zip(rows, tokens, strict=True))
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert np.allclose([w[5] for w in want], [h[5] for h in have], rtol=1e-12)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = {r.score for r in got if r.n_tokens == 3 and r.doc_id in (125, 126)}
    assert len(same) <= 1


def test_language_scores_odd_tables(spark, docs):
    assert lbl.language_scores(spark.createDataFrame([], DOCS)).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = lbl.language_scores(spark.createDataFrame([(alone, "a b", None, None, 1, "", 1, "")], DOCS)).first()
    assert (only.held_out, only.n_tokens, only.n_known, only.train_tokens, only.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(only.score)


def test_contrast_gradient_by_differences():
    r = np.random.default_rng(3)
    share = r.random(lbl.CLASSES)
    share /= share.sum()
    model, stream = lbl.Model.new(share), r.integers(0, lbl.CLASSES + 1, 40)
    noise, expected = r.integers(0, lbl.CLASSES, 6), np.log(6 * share)
    grads = lbl.contrast(model, stream, noise, expected)[1]
    for part, grad in zip(model.parts(), grads, strict=True):
        for at in zip(*(x[np.argsort(-np.abs(grad), axis=None)[:4]] for x in np.unravel_index(np.arange(grad.size), grad.shape)), strict=True):
            old, found = part[at], []
            for step in (1e-6, -1e-6):
                part[at] = old + step
                found.append(lbl.contrast(model, stream, noise, expected)[0])
            part[at] = old
            assert abs((found[0] - found[1]) / 2e-6 - grad[at]) < 1e-4 * (1 + abs(grad[at]))


def test_log_shares_are_a_plain_softmax_and_sum_to_one():
    r = np.random.default_rng(5)
    model = lbl.Model.new(np.full(lbl.CLASSES, 1 / lbl.CLASSES))
    before = r.integers(0, lbl.CLASSES + 1, lbl.CONTEXT)
    each = [float(model.log_shares(np.append(before, c))[0]) for c in range(lbl.CLASSES)]
    h = sum(model.near[i] * model.context[before[-1 - i]] for i in range(lbl.CONTEXT))
    scores = model.target @ h + model.bias
    assert np.allclose(each, scores - np.log(np.exp(scores).sum()), atol=1e-5)
    assert abs(np.exp(each).sum() - 1) < 1e-5
    again = lbl.Model.unpack(model.pack())
    assert all((a == b).all() for a, b in zip(model.parts(), again.parts(), strict=True))


def test_word_shares_of_a_class_sum_to_one():
    names = ["", "the", *(f"w{k}" for k in range(300)), "ab", "ac"]
    c = np.array([50, 90, *((7 * k) % 40 for k in range(300)), 1, 2])
    single, mass = ["", "the"], np.zeros(lbl.CLASSES)
    counts = lbl.Counts(0, 0, single, [ord("w") << 8 | ord("1")], mass, mass)
    kind, unseen_as = counts.classes(pa.array(names), c)
    for k, n in zip(kind, c, strict=True):
        mass[k] += n
    assert kind[0] == 0 and kind[1] == 1 and set(kind[c == 0]) == {lbl.UNSEEN} and kind.max() < lbl.CLASSES
    assert set(unseen_as[(c == 1)]) == {lbl.UNSEEN}
    total = defaultdict(float)
    for k, n in zip(kind, c, strict=True):
        total[k] += n / mass[k] if n else 0
    assert all(abs(x - 1) < 1e-12 for k, x in total.items() if k != lbl.UNSEEN)


def test_training_learns_what_follows():
    r = np.random.default_rng(1)
    classes = np.empty(60_000, np.uint8)
    classes[0::2], classes[1::2] = r.integers(1, 20, 30_000), 0
    classes[1::2] = classes[0::2] + 20  # each is followed by its own partner
    share = np.bincount(classes, minlength=lbl.CLASSES) + 1.0
    trainer = lbl.Trainer(lbl.Model.new(share / share.sum()), share / share.sum(), 1)
    stream, at = lbl.as_stream(classes, np.full(100, 600))
    for _ in range(3):
        trainer.learn(stream)
    gain = trainer.model.log_shares(stream)[at - lbl.CONTEXT].mean() - np.log(share / share.sum())[classes].mean()
    assert gain > 1.0


def brute_whitened(vectors, most=4):
    out = {}
    fine = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    for dim in {len(v) for _, v in fine} - {0}:
        x = {i: np.floor(256 * np.array(v, "f8")).astype("i8") for i, v in fine if len(v) == dim}
        fit = np.unique(np.stack(list(x.values())), axis=0)
        n, s = len(fit), fit.sum(0)
        c = fit - s / n
        e, u = np.linalg.eigh(c.T @ c / n)
        e, u = np.maximum(e[::-1][:most], 0), u[:, ::-1][:, :most]
        for i, row in x.items():
            out[i] = (n, int(((n * row - s) ** 2).sum()), (row - s / n) @ u, e, (c.T @ c / n).trace())
    return out


def test_whitening(spark):
    r = np.random.default_rng(2)
    mix = np.array([[3, 1, 0, 0, 0, 0], [0, 2, 1, 0, 0, 0], [0, 0, 1, 0, 1, 0], [0, 0, 0, 0.5, 0, 0], [0, 0, 0, 0, 0.2, 0], [1, 0, 0, 0, 0, 0.1]])
    vectors = [(i, [float(c) for c in np.round(r.normal(0, 1, 6) @ mix, 1)]) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(50)] + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf] * 6), (2004, []), (2005, [-0.0] * 6)]
    vectors += [(3000 + i, [float(i), float(-i % 3)]) for i in range(9)]
    table = spark.createDataFrame([(i, v, "c", 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, label string, n long, idx long").repartition(4)
    got = defaultdict(dict)
    for row in whitening.whitened(table).collect():
        got[row.vec_id][row.component] = row
    want = brute_whitened(vectors)
    assert set(got) == set(want)
    for ids in (range(2000), range(3000, 3100)):
        ids = [i for i in ids if i in want]
        for k in range(min(4, len(want[ids[0]][2]))):
            n, _, _, e, trace = want[ids[0]]
            mine = np.array([got[i][k + 1].whitened for i in ids])
            theirs = np.array([want[i][2][k] for i in ids]) / np.sqrt(e[k])
            assert np.allclose(mine, theirs * np.sign(mine @ theirs), atol=1e-8)
            assert all(got[i][k + 1].n == n and got[i][k + 1].deviation == want[i][1] for i in ids)
            assert abs(got[ids[0]][k + 1].explained - e[k] / trace) < 1e-9 and got[ids[0]][k + 1].identity_error < 1e-9


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.identity_error) for r in same} == {(1, 0, 0.0, 0.0)}
    huge = whitening.whitened(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], schema)).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(1, None), (2, None), (3, 768**2 + 1)} and all(math.isfinite(r.whitened) for r in huge)
