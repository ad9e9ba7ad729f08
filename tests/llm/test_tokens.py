import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from terraledger.llm import packing
from terraledger.llm.tokens import Encoder, TokenStore, default_tokenizer, packed


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(plain):
    rng = random.Random(1)
    alphabet = "abZ1 \n\t'’s 　.é!?ß漢  \r\x1c\x85-<|>_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) for _ in range(4000)] + ["", "<|endoftext|>", "it's we'll  \n x", " ".join(["tion,", "naïve."] * 50)]
    e = Encoder(default_tokenizer())
    ids, ends = e.encode_all(pa.array(texts), packed([0]))
    for i, t in enumerate(texts):
        want = packed(plain(t))
        assert e.encode(t) == want
        assert ids[ends[i] : ends[i + 1]].tobytes() == want + packed([0])


def test_very_long_texts_are_cut_where_no_token_reaches_over(plain, monkeypatch):
    from terraledger.llm import tokens

    monkeypatch.setattr(tokens, "LONG", 50)
    e = Encoder(default_tokenizer())
    texts = [" ".join(f"wörd{i}," for i in range(200)), "x" * 300, "a  b \n c " * 60, " " * 200 + "end"]
    ids, ends = e.encode_all(pa.array(texts), packed([0]))
    for i, t in enumerate(texts):
        assert e.encode(t) == packed(plain(t)) == ids[ends[i] : ends[i + 1] - 1].tobytes()
    assert [n for _, n in tokens.portions(pa.array(["ab"] * 5000))] == [2048, 2048, 904]


def test_other_tokenizers_are_encoded_whole():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    e = Encoder(path)
    assert e.words is None
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    ids, ends = e.encode_all(pa.array(["Hello  World", ""]), packed([5]))
    assert ids.tolist() == [*t.encode("Hello  World", add_special_tokens=False).ids, 5, 5] and ends.tolist() == [0, len(ids) - 1, len(ids)]


def test_store_round_trip(spark, docs, rows, none, plain, tmp_path):
    store = TokenStore.write(docs, f"file://{tmp_path}/tokens", default_tokenizer(), files=3)
    got = store.digest().orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g.doc_id for g in got] == [r[0] for r in order]
    at, want = 0, defaultdict(list)
    for r in rows:
        ids = plain(r[1] or "") + [0]
        want[r[0]].append((len(ids), zlib.crc32(packed(ids))))
    for g in got:
        assert g.start == at and (g.n_tokens, g.ids_crc32) in want[g.doc_id]
        at += g.n_tokens
    assert [r.ids for r in store.tokens([3]).collect()] == [plain("one") + [0]]
    assert sorted(r.n_tokens for r in store.metadata().collect()) == sorted(n for w in want.values() for n, _ in w)
    plan = store.rows().select("n_tokens").filter("doc_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan and "ids" not in plan.split("ReadSchema")[1]
    assert TokenStore.write(none, f"file://{tmp_path}/none", default_tokenizer()).digest().count() == 0


def test_differencing_deals_every_item_once():
    rng = random.Random(2)
    for k in (1, 2, 5, 17):
        sizes = [rng.randint(1, 500) for _ in range(60)]
        parts = packing.differencing(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(60)) and len(parts) == k
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= max(sizes)


def test_differencing_beats_its_textbook_case():
    parts = packing.differencing([4, 5, 6, 7, 8], 2)
    assert {sum([4, 5, 6, 7, 8][i] for i in p) for p in parts} == {14, 16}


def test_windows_rise_when_capacity_is_exceeded():
    # Two windows could hold 3 * 60, but no dealing of 60 and 60 and 60 fits two windows of 100.
    windows = packing.balanced([(0, 0, 60), (1, 0, 60), (2, 0, 60)], 100)
    assert all(sum(p[2] for p in w) <= 100 for w in windows) and sum(p[2] for w in windows for p in w) == 180


def test_packing_against_whole_encoding(docs, rows, none, plain):
    got = packing.pack(docs, default_tokenizer(), window=256, end_id=1).collect()
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(plain(r[1] or "") + [1])
    total = defaultdict(int)
    sequences = defaultdict(list)
    for p in got:
        assert any(len(ids) == p.doc_tokens and zlib.crc32(packed(ids[p.start : p.start + p.length])) == p.ids_crc32 for ids in want[p.doc_id])
        total[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert total == {d: sum(map(len, ids)) for d, ids in want.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(none, default_tokenizer()).count() == 0
    for p in packing.pack(docs, default_tokenizer(), window=256, keep_ids=True).collect():
        assert p.ids_crc32 == zlib.crc32(packed(p.ids)) and any(p.ids == ids[p.start : p.start + p.length] for ids in want[p.doc_id])


def test_short_tails_are_padded_little(spark):
    # 3,000 documents of 2 or 3 ids: a block waits until its tails fill FILL windows.
    df = spark.createDataFrame([(i, "a b"[: 1 + 2 * (i % 2)]) for i in range(3000)], "doc_id long, text string").coalesce(1)
    got = packing.pack(df, default_tokenizer(), window=128).collect()
    ids, windows = sum(p.length for p in got), len({p.sequence_id for p in got})
    assert len({p.doc_id for p in got}) == 3000 and ids >= 0.92 * 128 * windows
