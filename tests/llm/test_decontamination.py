import random

import pytest

from weftspark.llm import decontam
from weftspark.llm.decontam import ItemAutomaton, contamination, decontaminate, excise, item_words


def brute(items, words, window):
    hit, found = set(), set()
    for name, item in items:
        k = min(window, len(item))
        if not k:
            continue
        grams = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in grams:
                found.add(name)
                hit |= set(range(i, i + k))
    return hit, found


@pytest.mark.parametrize("window", [2, 3, 8])
def test_automaton_matches_brute_force(window):
    rng = random.Random(window)
    for _ in range(150):
        letters = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
        items = [(f"i{k % 4}", [rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 9, 14]))]) for k in range(rng.randint(0, 6))]
        words = [rng.choice([*letters, b"z"]) for _ in range(rng.choice([0, 3, 20, 60]))]
        spans, found, longest = ItemAutomaton(items, window).hits(words)
        hit, want = brute(items, words, window)
        assert {i for a, b in spans for i in range(a, b)} == hit and found == want
        assert longest == max([k for _, x in items for i in range(len(x)) for k in range(1, len(x) - i + 1) if any(words[p : p + k] == x[i : i + k] for p in range(len(words)))], default=0)


def test_words():
    assert item_words("A-b_C 9é\tÀ") == [b"a", b"b", b"c", "9é".encode(), "À".encode()]
    assert item_words(None) == item_words("--") == []


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, spans string, doc_id string")


@pytest.mark.parametrize("block_words", [128, 200_000])
def test_contamination(spark, awkward, block_words):
    texts = [r["text"] for r in awkward.filter("doc_id BETWEEN 12 AND 40").collect()]
    rng = random.Random(1)
    items = [(k, t, None, None) for k, t in enumerate(rng.sample(texts, 12))] + [(50, None, None, None), (51, "", None, None), (None, "a b c", None, None), (52, "the of", None, None), (3, "another text of item three and so on", None, None)]
    got = contamination(awkward, items_frame(spark, items), block_words=block_words).collect()
    bench = [(str(i), item_words(t)) for i, t, _, _ in items if i is not None]
    assert len(got) == awkward.count()
    by = sorted((str(r["doc_id"]), r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), ",".join(r["items"])) for r in got)
    want = []
    for r in awkward.collect():
        words = item_words(r["text"])
        hit, found = brute(bench, words, 8)
        want.append((str(r["doc_id"]), len(words), len(hit), ",".join(sorted(found))))
    assert by == sorted(want)


def test_many_blocks_are_built_once(spark, monkeypatch):
    """Ten blocks: the same answers as one, and one automaton for each block in a task."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 5, 8, 20, 60]))), None, None) for k in range(60)]
    docs = []
    for k in range(300):
        words = [word() for _ in range(rng.randint(0, 80))]
        if k % 5 == 0:
            words += rng.choice(items)[1].split()[rng.randint(0, 3) :]
        docs.append((k, " ".join(words), 0))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint").coalesce(1)
    table = items_frame(spark, items)
    show = lambda df: sorted((r["doc_id"], r["n_words"], str(r["spans"]), ",".join(r["items"])) for r in df.collect())
    assert show(contamination(docs, table, block_words=130)) == show(contamination(docs, table))
    assert sorted(map(tuple, decontaminate(docs, table, block_words=130).collect())) == sorted(map(tuple, decontaminate(docs, table).collect()))
    known = decontam.item_blocks(table, "item_id", "text", 130, 8)
    assert len(known.blocks) >= 8
    built = []
    monkeypatch.setattr(decontam, "ItemAutomaton", lambda items, window: built.append(1) or ItemAutomaton(items, window))
    monkeypatch.setattr(decontam, "_BUILT", {})
    monkeypatch.setattr(decontam, "KEPT", 300)
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    for _ in decontam._scanned(iter([batch.slice(k, 30) for k in range(0, 300, 30)]), 1, known):
        pass
    assert len(built) == len(known.blocks) and sum(n for _, n in decontam._BUILT.values()) <= 300
    for r in docs.collect():  # the filter passes every text that holds a window
        words = item_words(r["text"])
        if any(brute([(str(i), item_words(t))], words, 8)[1] for i, t, _, _ in items):
            assert decontam._may_hit(words, known)
    with pytest.raises(ValueError):
        contamination(docs, table, block_words=10)


def test_a_short_item_alone(spark):
    """A document that is nothing but a short item goes; in a longer one its words are no passage."""
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five " + " ".join(f"w{k}" for k in range(40)))], "doc_id bigint, text string")
    got = decontaminate(docs, items_frame(spark, [(1, "one two three four five", None, None)])).collect()
    assert [(r["doc_id"], r["text"][:9]) for r in got] == [(2, "one two t")]


def test_excise_and_stage(spark):
    assert excise("One, two! three four. five", [(1, 3)]) == "One,  four. five"
    passage = "alpha beta gamma delta epsilon zeta eta theta iota"
    other = "un deux trois quatre cinq six sept huit neuf dix"
    clean = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, clean, 5), (2, f"{clean} {passage} {clean}", 5), (3, f"{clean} {passage} {clean} {other}", 5), (4, passage, 5), (5, None, None), (6, "", 0)], "doc_id bigint, text string, n_chars bigint")
    items = items_frame(spark, [(1, passage, None, None), (2, other, None, None)])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate(docs, items).collect()}
    assert set(got) == {1, 2, 5, 6}
    assert got[1] == (clean, 5) and got[2][0] == f"{clean}  {clean}" and got[2][1] == len(got[2][0])


def test_nothing(spark, nothing, awkward):
    none = items_frame(spark, [])
    assert contamination(nothing, none).collect() == []
    assert {len(r["items"]) for r in contamination(awkward, none).collect()} == {0}
    assert decontaminate(awkward, none).count() == awkward.count()
