import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from terraledger.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes):
    """Targets by the rule: share by weight, cap at three times, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: Fraction(1 + i % 3) for i, s in enumerate(names)}
    total, capped = Fraction(sum(sizes.values())), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return {**{s: Fraction(3 * sizes[s]) for s in capped}, **target}
        capped |= over


def test_targets_and_takes(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 17)), None if i % 50 == 0 else "big" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    rows += [(2000 + i, "tiny word", "zz") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = {r.doc_id: r for r in mixing.digest(df).collect()}
    again = {r.doc_id: r for r in mixing.digest(df.repartition(2)).collect()}
    assert got == again and len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        assert got[i].size == len(t.split()) and 0 <= got[i].taken <= 3 * got[i].size
        sizes[s] += got[i].size
        taken[s] += got[i].taken
    want = water_fill(sizes)
    for i, _, s in rows:
        assert got[i].source_size == sizes[s] and got[i].target == pytest.approx(float(want[s]), rel=1e-12)
    for s in sizes:
        assert taken[s] == int(want[s])
    # The cut goes by the hash of the id alone.
    for s in sizes:
        own = sorted((hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest(), i) for i, _, x in rows if x == s)
        times = [got[i].taken / got[i].size for _, i in own]
        assert times == sorted(times, reverse=True)


def test_awkward_rows(docs, rows, none):
    got = mixing.digest(docs).collect()
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    assert mixing.digest(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_repeats_and_cuts(docs, rows):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = out.collect()
    taken = sum(r.taken for r in mixing.digest(docs).collect())
    assert sum(len(WORD.findall(r.text or "")) for r in got) == taken
    texts = {(r[0], r[1]) for r in rows}
    cut = [r for r in got if (r.doc_id, r.text) not in texts]
    assert len(cut) <= 4
    for r in cut:
        assert r.n_chars == len(r.text) and any(t and t.startswith(r.text) for _, t in texts)
