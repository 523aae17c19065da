import random

import pytest

from weftspark.llm.repetition import maximal_repeats, repeats, repetition, suffix_array
from weftspark.llm.repetition import _merged


def brute(words, least):
    n, covered, longest, kinds, found = len(words), set(), 0, 0, {}
    for i in range(n):
        for size in range(least, n - i + 1):
            found.setdefault(tuple(words[i : i + size]), []).append(i)
    for part, at in found.items():
        if len(at) < 2:
            continue
        for i in at:
            covered |= set(range(i, i + len(part)))
        longest = max(longest, len(part))
        left = {words[i - 1] if i else ("edge", i) for i in at}
        right = {words[i + len(part)] if i + len(part) < n else ("edge", i) for i in at}
        kinds += len(left) > 1 and len(right) > 1
    return len(covered), longest, kinds


@pytest.mark.parametrize("least", [1, 2, 3, 5, 8])
def test_repeats_match_brute_force(least):
    rng = random.Random(least)
    for _ in range(60):
        parts = [[rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.choice([0, 1, 3, 10, 25]))] for _ in range(rng.randint(1, 4))]
        assert repeats(parts, least) == [brute(p, least) for p in parts]


def test_suffixes_are_sorted_and_intervals_are_right():
    words = [b"a", b"b", b"a", b"b", b"c", b"a", b"b"]
    codes = _merged([words])
    array = suffix_array(codes, 1)
    tails = [codes[p:].tolist() for p in array.places]
    assert tails == sorted(tails)
    assert {(size, end - first) for size, first, end in maximal_repeats(array, codes, 1)} == {(2, 3)}


def base(text):
    words = [w for w in (text or "").encode().split()]
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    n = len(words)
    hit = set()
    at = {}
    for i in range(n - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    for v in at.values():
        if len(v) > 1:
            for i in v:
                hit |= set(range(i, i + 8))
    return n, sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_query_columns(spark, awkward):
    got = repetition(awkward, batch_words=500)
    want = sorted(((r["doc_id"], *base(r["text"])) for r in awkward.collect()), key=str)
    rows = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted((tuple(r)[:-1] for r in rows), key=str) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows) and any(r["kept"] for r in rows)


def test_long_repeat_is_cut(spark):
    clean = " ".join(f"w{k}" for k in range(3000))
    passage = " ".join(f"p{k}" for k in range(150))
    df = spark.createDataFrame([(1, clean), (2, f"{passage} {clean} {passage}"), (3, f"{clean} p1 p2 p3 p4 p5 p6 p7 p8 x p1 p2 p3 p4 p5 p6 p7 p8")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["kept"], r["longest_repeat"]) for r in repetition(df).collect()}
    assert got == {1: (True, 0), 2: (False, 150), 3: (True, 8)}


def test_covered_part_has_a_limit_of_its_own(spark):
    """A quarter of the words repeats: the base rule lets it pass, the rule on maximal repeats does not."""
    texts = [(k, " ".join([*(f"w{j}" for j in range(120 - 2 * size)), *(f"p{j}" for j in range(size)), "x", *(f"p{j}" for j in range(size))])) for k, size in ((1, 9), (2, 15), (3, 20))]
    got = {r["doc_id"]: (r["base_failed"], r["kept"], round(r["covered_fraction"], 2)) for r in repetition(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: (False, True, 0.15), 2: (False, False, 0.25), 3: (True, False, 0.33)}


def test_one_word_over_and_over():
    """Intervals nest as deep as the text is long; places are set once."""
    import time

    began = time.time()
    assert repeats([[b"x"] * 100_000], 8) == [(100_000, 99_999, 1 + 99_999 - 8)]
    assert time.time() - began < 20


def test_nothing(nothing):
    assert repetition(nothing).collect() == []
