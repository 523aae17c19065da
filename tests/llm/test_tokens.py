import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftspark.llm import packing, tokenbin
from weftspark.llm.common import scratch_path
from weftspark.llm.tokens import WordEncoder

ODD = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "\na", "a\tb c", "b\t \tc", "x<|endoftext|>y <|startoftext|> z", "é é ΑΣ ΣΑΣ İ", "don't I'LL 12345 $$$ a$$b3", "日本語 テスト　x", "a  b", "\x1c x \x85 y", "ﬁ ① Ⅷ ½ x²", "🙂 x 🙂🙂 y's 's", "é ́x", "A" * 300]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_tokenizer(awkward, name):
    path = public_tokenizers.path(name)
    whole, words = Tokenizer.from_file(path), WordEncoder(path, limit=50)
    rng = random.Random(2)
    made = ["".join(rng.choice("ab é\n\t .,'s1<|>Z🙂") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text in [*ODD, *made, *[r["text"] for r in awkward.select("text").dropna().limit(40).collect() if len(r["text"]) < 5000]]:
        assert words.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert words.kind != "whole" and words.ids(None).tolist() == []


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_file_round_trip(mode, block):
    rng = np.random.default_rng(block)
    docs = [(k if k % 5 else None, rng.integers(0, rng.choice([2, 300, 70_000, 2**32 - 1]), rng.integers(0, 40), dtype=np.uint64).astype("<u4")) for k in range(30)]
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = tokenbin.PlaneWriter(sink, mode=mode, block=block, level=3)
    for name, ids in docs:
        writer.add(name, ids)
    size = writer.close()
    assert size == len(sink.getvalue())
    source = io.BytesIO(sink.getvalue())
    source.size = lambda: size
    reader = tokenbin.PlaneReader(source)
    got = list(reader.stream())
    assert [(n, i.tolist()) for n, _, i in got] == [(n, i.tolist()) for n, i in docs]
    everything = np.concatenate([i for _, i in docs])
    assert [p for _, p, _ in got] == (np.cumsum([len(i) for _, i in docs]) - [len(i) for _, i in docs]).tolist()
    for a, b in ((0, 0), (0, 5), (3, len(everything)), (block, 2 * block + 1)):
        assert reader.ids(a, min(b, len(everything))).tolist() == everything[a : min(b, len(everything))].tolist()
    assert json.dumps(reader.meta["chunks"])


def test_unfinished_file_is_refused():
    source = io.BytesIO(b"WPLN1\nsomething that ends too early")
    source.size = lambda: len(source.getvalue())
    with pytest.raises(ValueError, match="not a plane file"):
        tokenbin.PlaneReader(source)


def encoded(df, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(r["doc_id"], r["text"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, end]) for r in df.collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("ranges", [1, 4])
def test_token_files(spark, awkward, ranges):
    manifest = tokenbin.write_token_files(awkward, scratch_path(spark, "t"), public_tokenizers.path(FILES[0]), end_id=2, ranges=ranges, block=512, file_ids=20_000)
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in tokenbin.read_token_files(manifest).orderBy("start").collect()]
    docs = sorted(encoded(awkward, FILES[0], 2), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    want, at = [], 0
    for name, _, ids in docs:
        want.append((name, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert manifest.count() > 1


def test_no_documents(spark, nothing):
    manifest = tokenbin.write_token_files(nothing, scratch_path(spark, "t"), public_tokenizers.path(FILES[0]), end_id=2)
    assert tokenbin.read_token_files(manifest).collect() == []
    assert packing.pack_documents(nothing, public_tokenizers.path(FILES[1])).collect() == []


def test_one_id_of_many_rows_is_dealt_to_many_files(spark):
    rows = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN null WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "concat('text ', id) AS text")
    manifest = tokenbin.write_token_files(rows, scratch_path(spark, "t"), public_tokenizers.path(FILES[0]), end_id=2, ranges=8)
    sizes = {r["part"]: r["n_docs"] for r in manifest.collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 1000
    got = tokenbin.read_token_files(manifest).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == 4000 and ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


def test_files_end_though_texts_have_no_ids(spark):
    rows = spark.range(500).selectExpr("id AS doc_id", "'' AS text")
    manifest = tokenbin.write_token_files(rows, scratch_path(spark, "t"), public_tokenizers.path(FILES[0]), end_id=None, ranges=1, file_docs=100)
    assert sorted(r["n_docs"] for r in manifest.collect()) == [100] * 5
    assert tokenbin.read_token_files(manifest).filter("n_tokens = 0").count() == 500


# ---- packing


def test_pack_is_valid_and_near_the_bound():
    rng = random.Random(4)
    for _ in range(40):
        limit = rng.choice([10, 50, 2048])
        lengths = [rng.randint(1, limit) for _ in range(rng.randint(0, 300))]
        bins = packing.pack(lengths, limit)
        assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[k] for k in b) <= limit for b in bins)
        assert len(bins) <= len(packing.best_fit(lengths, limit))


def test_swaps_empty_a_bin():
    # best fit leaves three bins of (6,3), (5,4), (1,1): 20 in two bins of 10 needs exchanges
    lengths = [6, 3, 5, 4, 1, 1]
    bins = packing._Search(lengths, [[0, 1], [2, 3], [4, 5]], 10).run(2)
    assert len(bins) == 2 and sorted(n for b in bins for n in b.elements()) == sorted(lengths)
    search = packing._Search([7, 5, 5, 3], [[0], [1], [2], [3]], 10)
    before = sum(f * f for f in search.fill.values())
    bins = search.run(2)
    assert sum(sum(b.elements()) ** 2 for b in bins) > before and len(bins) == 2


def test_two_for_one():
    search = packing._Search([6, 4, 5, 5], [[0, 1], [2, 3]], 11)
    assert search._step(0, 1)  # 6+4 becomes 6+5, or the like
    assert max(search.fill.values()) == 11


def test_a_donor_that_gives_nothing_is_passed_over():
    # the emptiest bin (7) fits nowhere; 4 + 4 and 3 + 3 still go together
    lengths = [7, 4, 4, 4, 3, 3]
    bins = packing._Search(lengths, [[0], [1, 2], [3], [4, 5]], 11).run(1)
    assert len(bins) == 3


def test_two_for_one_with_many_kinds_of_pieces():
    """The donor's only fitting pair lies behind 100 other lengths."""
    donor = [*range(900, 1000), 300, 301]
    search = packing._Search([600, 1446, *donor], [[0, 1], list(range(2, 2 + len(donor)))], 2047)
    assert search._step(0, 1) and search.fill[0] == 2047


def test_search_saves_bins_that_best_fit_needs():
    rng = random.Random(1)
    lengths = [rng.randint(500, 800) for _ in range(1500)]
    assert len(packing.pack(lengths, 2048)) < 0.98 * len(packing.best_fit(lengths, 2048))


@pytest.mark.parametrize("window", [200, 1 << 22])
def test_packed_documents(awkward, window):
    limit = 64
    got = packing.pack_documents(awkward, public_tokenizers.path(FILES[1]), limit=limit, window_ids=window, second_pieces=100).collect()
    want = []
    for name, _, ids in encoded(awkward, FILES[1], 0):
        want += [(name, k, at, crc(ids[at : at + limit])) for k, at in enumerate(range(0, len(ids), limit))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], zlib.crc32(bytes(r["ids"]))) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        assert len(bytes(r["ids"])) == 4 * r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(bins) <= 1.02 * -(-sum(r["length"] for r in got) // limit) + 3


def test_a_worker_keeps_one_operators_cache():
    import weakref

    from weftspark.llm import common, tokens

    mine = common.cache()
    mine["x"] = 1
    kept = weakref.ref(tokens.encoder(public_tokenizers.path(FILES[1])))
    assert kept() is not None and not mine  # the encoder's turn
    mine["x"] = 1
    common.sole(mine)
    assert kept() is None and mine == {"x": 1}
    common.sole()
    assert not mine


def test_caches_are_bounded_by_characters():
    from weftspark.llm.tokens import _Generations

    made = []
    words = _Generations(lambda w: made.append(w) or len(w), 10)
    for k in range(100):
        assert words[f"{k:0>90}"] == 90 and words["x" * 2000 + str(k)] > 2000
        words.age()
    assert len(words) <= 10 and len(words.older) <= 10 and not any(len(w) > 1000 for w in [*words, *words.older])
