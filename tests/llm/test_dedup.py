import hashlib
import random
import re
from collections import defaultdict

import pytest

from terraledger.llm import exact_dedup, near_dedup, substring_dedup
from terraledger.operators.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_digest_against_brute_force(docs, rows):
    got = exact_dedup.digest(docs).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = sorted((r[0] is None, r[0] or 0, min((x for x in groups[norm(r[1])] if x is not None), default=None) is None, len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert sorted((g.doc_id is None, g.doc_id or 0, g.keep_id is None, g.group_size, g.text_sha256) for g in got) == want
    kept = defaultdict(int)
    for g in got:
        kept[g.text_sha256] += g.kept
        if g.kept:
            assert g.doc_id == g.keep_id
    assert set(kept.values()) == {1}


def test_exact_dedup_keeps_rows_whole(docs, rows, none):
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns
    left = got.collect()
    assert sorted(norm(r.text) for r in left) == sorted({norm(r[1]) for r in rows})
    assert {r.doc_id for r in left if norm(r.text) == norm(rows[4][1])} == {4}
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.digest(none).count() == 0


def test_exact_hot_group_and_false_positives(spark, monkeypatch):
    # Three slices of hashes, each with a filter of a bit a row: many false positives.
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 1 << 10)
    monkeypatch.setattr(exact_dedup, "MIN_BITS", 1 << 10)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1)
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", 10)
    assert exact_dedup._slices(3000) == 3
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id div 2)) as text")
    got = {r.doc_id: r for r in exact_dedup.digest(df).collect()}
    groups = defaultdict(list)
    for i in range(3000):
        groups["same" if i % 3 == 0 else f"t{i // 2}"].append(i)
    for g in groups.values():
        for i in g:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (g[0], len(g), i == g[0])
    assert exact_dedup.exact_dedup(df).count() == len(groups)


def shingle_set(t, n):
    w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_brute(pairs, n, percent):
    sets = {i: shingle_set(t, n) for i, t in pairs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_against_brute_force(spark, words, percent):
    rng = random.Random(words)
    vocab = [f"w{i}" for i in range(400)]
    pairs = []
    for base in range(25):
        text = [rng.choice(vocab) for _ in range(rng.randint(2, 160))]
        for _ in range(rng.randint(1, 5)):
            t = list(text)
            for _ in range(rng.randint(0, max(0, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            pairs.append((len(pairs), " ".join(t) if rng.random() < 0.5 else "\t ".join(t).upper()))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.resolve(df, near_dedup.Params(words=words, percent=percent)).collect()}
    assert got == near_brute(pairs, words, percent)


def test_near_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    pairs = []
    for i in range(60):
        t = list(base)
        for _ in range(i % 9):
            t[rng.randrange(len(t))] = f"x{i}"
        pairs.append((i, " ".join(t)))
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 7)
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.resolve(df, near_dedup.Params(words=3, percent=85)).collect()}
    assert got == near_brute(pairs, 3, 85)


def test_near_awkward_rows(docs, rows, none):
    got = near_dedup.resolve(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[0] == {(0, 0, True)} and by[2] == {(0, 2, True)} and by[3] == {(1, 3, True)}
    assert by[4] == {(19, 4, True)} and by[5] == {(19, 4, False)} and by[8] == {(by[7].copy().pop()[0], 7, False)}
    assert by[None] == {(19, 4, False), (0, None, True)}
    left = near_dedup.near_dedup(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert 5 not in ids and 6 not in ids and 8 not in ids and ids.count(None) == 1 and ids.count(4) == 1
    assert near_dedup.near_dedup(none).count() == 0 and near_dedup.resolve(none).count() == 0


def test_near_rows_without_ids_or_that_share_one(spark):
    # A third of the rows have no id, a third share one; each text has a near copy and an exact one.
    rng = random.Random(9)
    rows, texts = [], []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(80)]
        texts.append([" ".join(words), " ".join([*words[:-1], "end"])])
        key = [None, 7, 100 + i][i % 3]
        rows += [(key, texts[-1][0], "a"), (key, texts[-1][1], "b"), (key, texts[-1][0], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(5)
    left = near_dedup.near_dedup(df, near_dedup.Params(words=3, percent=85)).collect()
    assert len(left) == 60
    assert all(sum(r.text in t for r in left) == 1 for t in texts)
    assert len(near_dedup.resolve(df, near_dedup.Params(words=3, percent=85)).collect()) == len(rows)


def test_estimate_is_close_to_similarity():
    import numpy as np

    p = near_dedup.Params()
    mul = near_dedup.multipliers(p.k)
    a = near_dedup.shingles(" ".join(f"a{i}" for i in range(1000)), 1)
    b = near_dedup.shingles(" ".join(f"a{i}" for i in range(100, 1100)), 1)
    sig = [np.frombuffer(near_dedup.packed_bits(near_dedup.minima(s, mul), p.bits), np.uint8) for s in (a, b)]
    x, y = (np.pad(s, (0, -len(s) % 8)).view(np.uint64)[None] for s in sig)
    est = near_dedup.corrected(near_dedup.agreeing(x, y, p.bits, p.k), p.bits)[0, 0]
    assert abs(est - 900 / 1100) < 0.09


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in {x for e in edges if e[0] != e[1] for x in e}}


def test_passages_are_found(spark, docs, none):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared, fuzzy = text(60), text(120)
    pairs = []
    for i in range(12):
        mid = shared if i % 3 == 0 else fuzzy if i % 3 == 1 else text(50)
        mid = list(mid)
        if i % 3 == 1:
            for at in range(i, 120, 19):
                mid[at] = f"edit{i}"
        pairs.append((i, " ".join(text(80) + mid + text(40))))
    got = substring_dedup.passages(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)).collect()
    found = defaultdict(set)
    for r in got:
        for d, s, n in ((r.doc_id, r.start, r.words), (r.other_id, r.other_start, r.other_words)):
            assert n >= 50 and r.identity >= 0.8
            found[d] |= set(range(s, s + n))
    for i in range(12):
        if i % 3 == 0:
            assert found[i] >= set(range(80, 140))
        elif i % 3 == 1:
            assert len(found[i] & set(range(80, 200))) >= 100
        else:
            assert not found[i]
    awkward = substring_dedup.passages(docs).collect()
    assert {(r.doc_id, r.other_id) for r in awkward} <= {(7, 8), (8, 7)} and awkward
    assert substring_dedup.passages(none).count() == 0


def quadratic(pts, p):
    """The score of the best chain that ends at each anchor."""
    reach, best = p.max_gap + p.k, []
    for i, (x, y) in enumerate(pts):
        prev = [best[j] - p.gap_cost * (x - pts[j][0] + y - pts[j][1]) for j in range(i) if x - reach <= pts[j][0] < x and y - reach <= pts[j][1] < y]
        best.append(p.k + max([0.0, *prev]))
    return best


@pytest.mark.parametrize("size", [60, 150, 600])
def test_chain_against_quadratic_chaining(size):
    import numpy as np

    p = substring_dedup.Params()
    rng = random.Random(size)
    for round_ in range(40):
        pts = {(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randint(1, 40))}
        if round_ % 2:  # long runs, also far apart
            x, y = rng.randrange(size), rng.randrange(size)
            pts |= {(x + 5 * i, y + 5 * i + i // 9) for i in range(30)}
        pts = sorted(pts)
        a, b = np.array([x for x, _ in pts]), np.array([y for _, y in pts])
        best = quadratic(pts, p)
        got = substring_dedup.chains(a, b, p)
        assert sorted(i for c in got for i in c) == list(range(len(pts)))
        for c in got:
            assert all(a[i] < a[j] <= a[i] + p.max_gap + p.k and b[i] < b[j] <= b[i] + p.max_gap + p.k for i, j in zip(c, c[1:]))
        top = got[0]
        assert p.k + sum(p.k - p.gap_cost * (a[j] - a[i] + b[j] - b[i]) for i, j in zip(top, top[1:])) == pytest.approx(max(best))


def test_a_chain_begins_anew_after_a_long_one():
    import numpy as np

    p = substring_dedup.Params()
    for shift in (0, 3):
        a = np.array([5 * i for i in range(20)] + [300 + 5 * i for i in range(7)])
        b = np.array([5 * i for i in range(20)] + [300 + shift + 5 * i for i in range(7)])
        assert sorted(map(len, substring_dedup.chains(a, b, p))) == [7, 20]


def spans(got):
    found = defaultdict(set)
    for r in got:
        for d, s, n in ((r.doc_id, r.start, r.words), (r.other_id, r.other_start, r.other_words)):
            found[d] |= set(range(s, s + n))
    return found


def test_passage_of_two_whose_parts_many_hold(spark):
    """90 words in two documents, 40 of them, at all places, in 36 others; and a fuzzy passage behind an exact one."""
    rng = random.Random(21)
    text = lambda n: [f"v{rng.randrange(50_000)}" for _ in range(n)]
    whole, exact, fuzzy = text(90), text(300), text(210)
    edited = [f"e{i}" if i % 20 == 7 else w for i, w in enumerate(fuzzy)]
    docs = [text(20) + whole + text(20) for _ in range(2)] + [text(20) + whole[i : i + 40] + text(20) for i in (rng.randrange(51) for _ in range(36))]
    docs += [text(20) + exact + text(60) + fuzzy + text(20), text(30) + exact + text(50) + edited + text(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)]
    found = spans(substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(found) == {0, 1, 38, 39}
    for d in (0, 1):
        assert found[d] >= set(range(20, 110))
    assert found[38] >= set(range(20, 320)) and len(found[38] & set(range(380, 590))) >= 205
    assert found[39] >= set(range(30, 330)) and len(found[39] & set(range(380, 590))) >= 205


def test_recall_with_third_rows_against_all_pairs(spark):
    """Exact runs of 50 words or a little more, and fuzzy passages, whose parts other documents hold: every exact one is found."""
    rng = random.Random(33)
    text = lambda n: [f"v{rng.randrange(30_000)}" for _ in range(n)]
    docs, fuzzy = [], []
    for i in range(60):
        n = 50 + i % 14
        p = text(n)
        docs += [text(15) + p + text(15), text(9) + p + text(22)]
        for _ in range(i % 7):  # parts too short to be passages themselves
            size = rng.randint(30, 47)
            at = rng.randrange(n - size + 1)
            docs.append(text(12) + p[at : at + size] + text(12))
    for i in range(60):
        p = text(80)
        q = [w if rng.random() > 0.12 else f"e{rng.random()}" for w in p]
        fuzzy.append((len(docs), len(docs) + 1))
        docs += [text(15) + p + text(15), text(9) + q + text(22)]
        for _ in range(i % 4):
            at = rng.randrange(45)
            docs.append(text(12) + p[at : at + 35] + text(12))
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)]
    found = spans(substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    windows = defaultdict(set)
    for i, t in enumerate(docs):
        for at in range(len(t) - 49):
            windows[tuple(t[at : at + 50])].add((i, at))
    shared = [v for v in windows.values() if len({i for i, _ in v}) > 1]
    assert shared
    for v in shared:
        for i, at in v:
            assert found[i] >= set(range(at, at + 50)), (i, at)
    hits = sum(len(found[a] & set(range(15, 95))) >= 50 and len(found[b] & set(range(9, 89))) >= 50 for a, b in fuzzy)
    assert hits >= 0.9 * len(fuzzy), hits


def test_frequent_seed_over_many_tasks(spark):
    """A passage that most documents have, over more tasks than groups: all of them are found."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    text = lambda n: [f"v{rng.randrange(30_000)}" for _ in range(n)]
    shared = text(55)
    df = spark.createDataFrame([(i, " ".join(text(10) + (shared if i % 3 else text(55)) + text(10))) for i in range(300)], "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = substring_dedup.passages(df.withColumn("extra", F.lit(1))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = spans(got)
    assert set(found) == {i for i in range(300) if i % 3} and all(v >= set(range(10, 65)) for v in found.values())
    # All but the first holder's can be cut, and there are a few rows a document, not one a pair.
    assert len({r.doc_id for r in got}) == 199 and len(got) < 2_000


def test_cut_removes_words():
    assert substring_dedup.cut("a b\nc d e", [(1, 2)]) == "a d e"
    assert substring_dedup.cut("a b c", [(0, 2), (1, 2)]) == ""


def copies_with_edits(step):
    """Pairs of documents that share 90 words, each step-th of them changed in the second."""
    rng = random.Random(step)
    text = lambda n: [f"v{rng.randrange(50_000)}" for _ in range(n)]
    rows = []
    for i in range(60):
        mid = text(90)
        rows.append((2 * i, " ".join(text(30) + mid + text(30))))
        rows.append((2 * i + 1, " ".join(text(30) + [f"edit{j}" if j % step == step - 1 else w for j, w in enumerate(mid)] + text(30))))
    return rows


def test_passages_with_a_change_every_ninth_word(spark):
    got = substring_dedup.passages(spark.createDataFrame(copies_with_edits(9), "doc_id long, text string")).collect()
    assert all(r.doc_id // 2 == r.other_id // 2 for r in got)
    assert len({r.doc_id // 2 for r in got}) >= 54


def test_passages_whose_parts_are_held_by_others(spark):
    """A and B share 60 words; every seed in either half has an earlier holder that has no more than that half."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    text = lambda n: [f"v{rng.randrange(50_000)}" for _ in range(n)]
    pairs, ids = [], iter(range(10_000))
    for _ in range(30):
        x, y, z = text(30), text(30), text(70)
        pairs += [("AB", x + y), ("AB", x + y), ("H", x), ("H", y)]
        # 70 words, of which three other documents have 40 each.
        pairs += [("CD", z), ("CD", z), ("H", z[:40]), ("H", z[15:55]), ("H", z[30:])]
    rows = [(next(ids), kind, " ".join(text(20) + t + text(20))) for kind, t in pairs]
    # Which row is first goes by a key of its content: the holders' ids are such that they are.
    keyed = spark.createDataFrame(rows, "doc_id long, kind string, text string").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(60))))
    keyed = keyed.withColumn("doc_id", F.col("doc_id") + 10_000 * F.col("n")).withColumn("u", F.xxhash64("doc_id", "text"))
    df = keyed.groupBy("text", "kind").agg(F.when(F.first("kind") == "H", F.min_by("doc_id", "u")).otherwise(F.max_by("doc_id", "u")).alias("doc_id")).localCheckpoint()
    kinds = {r.doc_id: (r.kind, r.text.split()) for r in df.collect()}
    got = defaultdict(set)
    for r in substring_dedup.passages(df).collect():
        for d, s, n in ((r.doc_id, r.start, r.words), (r.other_id, r.other_start, r.other_words)):
            got[d] |= set(range(s, s + n))
    for d, (kind, words) in kinds.items():
        assert not got[d] if kind == "H" else got[d] >= set(range(20, len(words) - 20)), (kind, sorted(got[d]))


def test_ends_are_extended_over_insertions():
    import numpy as np

    p = substring_dedup.Params()
    rng = np.random.default_rng(7)
    text = lambda n: rng.integers(-(1 << 31), 1 << 31, n).astype(np.int32)
    for at in (2, 8, 20, 35, 53):
        for gone in (False, True):
            mid = text(55)
            other = np.delete(mid, at) if gone else np.insert(mid, at, text(1))
            anchor = 25 if at < 25 else 10
            x, y = np.concatenate([text(30), mid, text(30)]), np.concatenate([text(20), other, text(30)])
            shift = (-1 if gone else 1) if at < anchor else 0
            s, e, s2, e2, match = substring_dedup.aligned(x, y, [30 + anchor], [20 + anchor + shift], p)
            assert min(e - s, e2 - s2) >= p.min_words and match >= 52
            if 3 <= at <= 50:
                assert (s, e, s2, e2, match) == (30, 85, 20, 20 + len(other), 54 if gone else 55)
    # 51 words, the last but one changed: 48 would be too few.
    mid = text(51)
    other = mid.copy()
    other[49] = 5
    s, e, s2, e2, match = substring_dedup.aligned(np.concatenate([mid, text(9)]), np.concatenate([other, text(9)]), [20], [20], p)
    assert (s, e, s2, e2, match) == (0, 51, 0, 51, 50)
    # Nothing in common beyond the anchor.
    x, y = text(100), text(100)
    y[50:55] = x[50:55]
    assert substring_dedup.aligned(x, y, [50], [50], p) == (50, 55, 50, 55, 5)


def test_passage_whose_only_seed_has_other_neighbours(spark):
    """130 words, each eighth changed and two put in on either side of the one seed in common: 109 of 134 agree."""
    import numpy as np

    p, rng, rows = substring_dedup.Params(), random.Random(4), []
    text = lambda n: [f"v{rng.randrange(50_000)}" for _ in range(n)]

    def common(a, b):
        s = substring_dedup.seeds([substring_dedup.word_codes(" ".join(t)) for t in (a, b)], p)
        return np.intersect1d(s.h[s.text == 0], s.h[s.text == 1]), s

    while len(rows) < 12:
        mid, ends = text(130), [text(20) for _ in range(4)]
        other = [f"edit{len(rows)}x{i}" if i % 8 == 7 else w for i, w in enumerate(mid)]
        both, s = common(ends[0] + mid + ends[1], ends[2] + other + ends[3])
        if not len(both):
            continue
        at = int(s.at[(s.text == 0) & (s.h == both[0])][0]) - 20
        if not 30 <= at <= 95:
            continue
        other = other[:at] + text(2) + other[at : at + p.k] + text(2) + other[at + p.k :]
        pair = ends[0] + mid + ends[1], ends[2] + other + ends[3]
        if len(common(*pair)[0]) == 1:
            rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(pair)]
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id // 2 for r in got if r.doc_id // 2 == r.other_id // 2} == set(range(6))


def test_pairs_that_meet_by_chance_do_not_send_their_words(spark):
    """1,500 pairs of documents share 16 words somewhere and nothing else, one pair shares a passage: few bytes move."""
    rng = random.Random(8)
    text = lambda n: [f"v{rng.randrange(1_000_000)}" for _ in range(n)]
    docs, passage = [text(1_200) for _ in range(150)], text(60)
    for _ in range(1_500):
        phrase = text(16)
        for i in rng.sample(range(150), 2):
            at = rng.randrange(1_184)
            docs[i][at : at + 16] = phrase
    docs[20][600:660], docs[90][300:360] = passage, passage
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)]
    core, limit = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def shuffled():
        core.listenerBus().waitUntilEmpty()
        return core.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spans(substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert set(found) == {20, 90} and found[20] >= set(range(600, 660)) and found[90] >= set(range(300, 360))
    moved = shuffled() - before
    assert 0 < moved < 2 * sum(len(t) for _, t in rows), moved / sum(len(t) for _, t in rows)


def test_bytes_pass_whatever_words_pass():
    import numpy as np
    import pyarrow as pa

    p, rng = substring_dedup.Params(), np.random.default_rng(3)
    n, quarter = p.min_words, p.min_words // 4
    exact, got, cases = [], [], []
    for i in range(3_000):
        x, y = (rng.integers(0, 1 << 32, int(rng.integers(20, 300)), np.uint32) for _ in range(2))
        c, d = int(rng.integers(0, len(x) - 4)), int(rng.integers(0, len(y) - 4))
        for j in range(-70, 75):  # words around agree, some of them shifted
            shift = j // 20 if i % 3 == 0 else 0
            if 0 <= c + j < len(x) and 0 <= d + j + shift < len(y) and (0 <= j < p.k or rng.random() < (i % 11) / 10):
                y[d + j + shift] = x[c + j]
        a, b = [c], [d]
        if i % 2 and c + 30 < len(x) - 4 and d + 30 < len(y) - 4:
            a, b = [c, c + 30], [d, d + int(rng.integers(20, 31))]
        exact.append(not substring_dedup.hopeless(x.view(np.int32), y.view(np.int32), a, b, p))
        drift = [d - c, b[-1] - a[-1]]
        lo, end = max(0, c - n), a[-1] + p.k + n
        xs, ys = x[lo:end], y[max(0, lo + min(drift) - quarter) : end + max(drift) + quarter]
        cases.append((xs.astype(np.uint8).tobytes(), ys.astype(np.uint8).tobytes(), a[0], a[-1], b[0], b[-1]))
    xs, ys, *ends = zip(*cases)
    got = substring_dedup.hopeful(pa.array(xs, pa.binary()), pa.array(ys, pa.binary()), *map(np.array, ends), p)
    exact = np.array(exact)
    assert got[exact].all() and 300 < exact.sum() < 2_700
    # A byte agrees by chance at times, seldom enough for that to matter.
    assert got[~exact].sum() < 0.25 * (~exact).sum()
