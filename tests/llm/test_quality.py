import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terraledger.llm import learning, quality_model, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(t):
    words = WORD.findall(t)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_base_counts_against_brute_force(spark, docs, rows, none):
    texts = ["a b c d e a b c d e f", "x y z\nx y z\n\n \n x", "# * | a <b>", "a a a a a a a a", "é\x0bü\x0cß \x1c z"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality_rules.digest(docs.select("doc_id", "text").unionByName(more)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    have = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=key)
    want = []
    for i, t in [(r[0], r[1] or "") for r in rows] + [(100 + i, t) for i, t in enumerate(texts)]:
        c = base_counts(t)
        want.append((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert have == sorted(want, key=key)
    assert all(not (r.base_failed and r.kept) for r in got)
    assert quality_rules.digest(none).count() == 0


CLEAN = "This is a plain sentence of clean prose, and it ends well.\nAnother line follows it here, as lines do.\nA third one, with other words, closes the text."


def test_lines_are_judged(spark):
    junk = "Home | About | Contact | Jobs | Press | Legal\nBuy*** this$$$ now&&& or*** never### again%%%\n"
    loud = "WIN!! BIG!! MONEY!! NOW!! TODAY!! ONLY!! HERE!! FOR!! YOU!! ALL!! OF!! US!!"
    df = spark.createDataFrame([(1, CLEAN, "a"), (2, junk + CLEAN, "b"), (3, junk * 4 + "One word more, and a few.", "c"), (4, loud, "d")], "doc_id long, text string, note string")
    got = {r.doc_id: r for r in quality_rules.evaluate(df, text_output=True).collect()}
    assert got[1].kept and got[1].clean_text == CLEAN and got[1].chars_lost == 0
    assert got[2].kept and got[2].clean_text == CLEAN
    assert not got[3].kept and not got[4].kept
    out = quality_rules.clean(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.note) for r in out] == [(1, CLEAN, "a"), (2, CLEAN, "b")]


def test_clean_keeps_columns(docs, none):
    out = quality_rules.clean(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} >= {4, 5}
    assert quality_rules.clean(none).count() == 0


def labelled(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        t = CLEAN + f" Number {i} is said here." if good else " ".join(f"w{(i * 7 + j) % 50}***" for j in range(30))
        if i % 10 == 3:
            t += f" You are a blorgh, a real zindle, number {i}."
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(good), int(i % 10 == 3)))
    labels += [(0, 1, 0), (None, 1, 1), (5, None, None), (10_000, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_ranking_learns(spark, docs, none):
    df, labels = labelled(spark)
    got = {r.doc_id: r for r in quality_model.digest(df, labels).collect()}
    for i in range(240):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == int(got[i].score >= 0.5) and 0 <= got[i].score <= 1
    held = [i for i in range(240) if got[i].held_out]
    assert np.mean([got[i].predicted == int(i % 4 != 0) for i in held]) >= 0.97
    assert quality_model.digest(docs, labels).count() == docs.count()
    assert quality_model.digest(none, labels).count() == 0
    assert {r.score for r in quality_model.digest(df, labels.limit(0)).collect()} == {0.5}


def test_ranking_orders_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality_model.FEATURES)))
    y = (x[:, 0] - 0.5 * x[:, 3] > 0).astype(int)
    m = quality_model.fit(x, y)
    s = m.scores(x)
    assert np.mean((s >= 0.5) == (y == 1)) > 0.95 and m.weights[0] > 0 > m.weights[3]


def toxic_corpus(n=400):
    import random

    rng = random.Random(6)
    syllables = ["ba", "ne", "ti", "ro", "lu", "ma", "ke", "so", "di", "pu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(4))
    text = lambda i: " ".join(word() for _ in range(120)) + (f" İİ You are a Blorgh, a real zindle, {i}." if i % 10 == 3 else "")
    return [(i, text(i)) for i in range(n)]


def test_toxicity_learns_words_and_spans(spark, docs, none):
    df = spark.createDataFrame(toxic_corpus(), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 10 == 3)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(df, labels).collect()}
    for i in range(400):
        assert got[i].predicted == (got[i].score >= 0.7) == (i % 10 == 3), (i, got[i].score)
    text = df.filter("doc_id = 13").first().text
    assert {"Blorgh", "zindle"} & {text[s.start : s.end] for s in got[13].spans}
    assert all(re.fullmatch(r"\w+", text[s.start : s.end]) and s.marginal >= toxicity.OFFENDING for s in got[13].spans)
    out = toxicity.digest(docs, labels)
    assert out.count() == docs.count() and out.filter("score >= 0.7").count() == 0
    assert toxicity.digest(none, labels).count() == 0
    assert {r.score for r in toxicity.digest(df, labels.limit(0)).collect()} == {0.0}


def full_chain(m, words):
    """(probability of any toxic token, marginals) by forward-backward over all words."""
    tagger = m.tagger()
    emit = [tagger.weighted(words).get(i, m.other) for i in range(len(words))]
    t = np.exp(np.array([[0.0, m.into], [m.back, m.stay]]))
    forward, scale, a = [], 0.0, np.array([1.0, 0.0])
    for e in emit:
        a = (a @ t) * np.array([1.0, np.exp(e)])
        scale += np.log(a.sum())
        a = a / a.sum()
        forward.append(a)
    b, out = np.ones(2), [0.0] * len(words)
    for i in range(len(words) - 1, -1, -1):
        p = forward[i] * b
        out[i] = p[1] / p.sum()
        b = t @ (np.array([1.0, np.exp(emit[i])]) * b)
        b = b / b.sum()
    return 1 - np.exp(-scale), out


@pytest.mark.parametrize("other,into,stay,back", [(-9.0, 0.0, 1.0, 0.0), (-1.5, -0.6, 0.8, -0.2), (-0.01, -4.0, 4.0, -4.0)])
def test_marginals_against_full_forward_backward(other, into, stay, back):
    f = lambda k, w: toxicity._id(k, w)
    m = toxicity.Model({f("w", "bad"): 5.0, f("w", "ugly"): 1.0, f("after", "so"): 2.0, f("before", "bad"): -1.0, f("shape", "capitals"): 0.5}, other, into, stay, back)
    words = ["x"] * 3 + ["so", "bad"] + ["y"] * 400 + ["ugly", "BAD"] + ["z"] * 600 + ["bad"]
    want, marginals = full_chain(m, words)
    score, got = m.tagger().run(words)
    assert score == pytest.approx(want, abs=1e-9)
    assert len(got) >= 6 and got == pytest.approx({i: marginals[i] for i in got}, abs=1e-9)
    assert m.tagger().run(["plain"] * 1000)[0] == pytest.approx(full_chain(m, ["plain"] * 1000)[0], abs=1e-9)


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    docs = []
    for i in range(7):
        at = np.sort(rng.choice(30, i % 5, replace=False))
        docs.append((30 + i, at, [rng.integers(0, 4, 1 + j % 2) for j in range(len(at))]))
    y, share = np.array([1, 0, 1, 0, 1, 0, 1]), np.linspace(0.5, 1, 7)
    theta = np.array([1.0, -0.5, 2.0, 0.3, -3.0, 0.2, 0.7, -0.4])

    def loss(theta):
        total = 0.0
        for (n, at, feats), label, w in zip(docs, y, share):
            emit = np.full(n, theta[4])
            for i, f in zip(at, feats):
                emit[i] += theta[f].sum()
            t, a = np.exp(np.array([[0.0, theta[5]], [theta[7], theta[6]]])), np.array([1.0, 0.0])
            for e in emit:
                a = (a @ t) * np.array([1.0, np.exp(e)])
            clean = 1 / a.sum()
            total -= w * np.log(1 - clean if label else clean)
        return total

    got = np.zeros(8)
    width = max(len(d[1]) for d in docs)
    gap, tok, flat = np.zeros((7, width + 1), np.int64), np.full((7, width), -1), []
    for r, (n, at, feats) in enumerate(docs):
        gap[r, : len(at) + 1] = np.diff(np.concatenate([[-1], at, [n]])) - 1
        for j, f in enumerate(feats):
            tok[r, j] = len(flat)
            flat.append(f)
    lengths, index = np.unique(gap, return_inverse=True)
    owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    got = toxicity._gradient(theta, 4, np.array([len(d[1]) for d in docs]), lengths, index.reshape(gap.shape), tok, np.concatenate(flat), owner, len(flat), y, share)
    want = [(loss(theta + d) - loss(theta - d)) / 2e-6 for d in 1e-6 * np.eye(8)]
    assert got == pytest.approx(want, rel=1e-3, abs=1e-5)


def test_families_and_features_are_the_same_in_every_process():
    import os
    import subprocess
    import sys

    code = "import sys; sys.path.insert(0, sys.argv[1]); from terraledger.llm import toxicity as t; w = [f'a{chr(97 + i % 26)}b{chr(97 + i // 26)}' for i in range(90)]; print(t.least_shingles(w), t.families([t.least_shingles(w[i:]) for i in range(9)]), sorted(t.document_features(w)))"
    root = str(__import__("pathlib").Path(toxicity.__file__).parents[2])
    runs = {subprocess.run([sys.executable, "-c", code, root], env={**os.environ, "PYTHONHASHSEED": str(seed)}, capture_output=True, text=True, check=True).stdout for seed in (1, 2, 3)}
    assert len(runs) == 1


def test_sample_is_bounded(spark):
    df, labels = labelled(spark)
    got = learning.sample(df.union(df), labels, "quality", 25).collect()
    assert len(got) <= 25 and len({r.doc_id for r in got}) == len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got)


def test_evidence_survives_a_clean_quotation(spark):
    import random

    rng = random.Random(8)
    filler = lambda n: ["".join(rng.choices(["ba", "ne", "ti", "ro", "lu", "ma", "ke", "so", "di", "pu"], k=3)) for _ in range(n)]
    rows, y = [], {}
    for i in range(600):
        # Toxic texts have a clear word, or several of a word that as many clean ones have once.
        bad = [["blorgh"], ["hraxo"] * 4][i % 2] if i % 10 < 2 else ["hraxo"] if i % 10 == 7 else []
        words = filler(80)
        for b in bad:
            words.insert(rng.randrange(len(words)), b)
        rows.append((i, " ".join(words) + (" blorgh hraxo" if i == 5 else "")))  # a clean text that quotes them
        y[i] = int(i % 10 < 2)
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(y.items()), "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.digest(df, labels).collect() if r.doc_id != 5}
    clear, several, once, none = ([v for i, v in got.items() if i % 10 in d] for d in ((0,), (1,), (7,), (2, 3, 4, 5, 6, 8, 9)))
    assert min(clear) >= 0.7 and max(none) < 0.1
    # The weak word is worth its share of toxic texts once, and adds up where there are several.
    assert max(once) < 0.5 < min(several) and min(several) > 1.5 * max(once)
