"""Repetition rules from suffix arrays over words.

Many texts are sorted together: a word is told apart by its text, so suffixes of
different texts share nothing and one sort serves the batch. Prefix doubling
looks again only at suffixes that are not yet alone. Longest common prefixes of
neighbours come from the ranks of the doubling steps; their intervals are the
right-maximal repeats, those with differing words before them the maximal ones.

Documents are not shuffled; memory is bounded by a batch of `batch_words` words
or one text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftspark.llm.common import small

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\v\f"


@dataclass
class SuffixArray:
    """Suffixes that share their first `least` words with another one, sorted; lcp[k] is that of k-1 and k."""

    places: np.ndarray
    lcp: np.ndarray


def suffix_array(codes: np.ndarray, least: int) -> SuffixArray:
    """codes: one number per word, equal only for equal words of one text.

    Suffixes that share fewer than `least` words with any other may be left out, all
    others are in full order. Two suffixes that run into the end of the data differ there.
    """
    n = len(codes)
    if not n:
        return SuffixArray(np.empty(0, np.int64), np.empty(0, np.int64))
    order = np.argsort(codes, kind="stable")
    new = np.r_[True, codes[order][1:] != codes[order][:-1]]
    rank = np.zeros(n + 1, np.int64)  # 0 stands for the end
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    levels = [rank.copy()]
    active = order[~(new & np.r_[new[1:], True])]
    places, h = np.empty(0, np.int64), 1
    while len(active):
        if h <= least:
            places = np.sort(active)
        second = rank[np.minimum(active + h, n)]
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        first = rank[active]
        group = np.r_[True, first[1:] != first[:-1]]
        new = group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(active))
        inside = at - np.maximum.accumulate(np.where(group, at, 0))
        rank[active] = first + inside[np.maximum.accumulate(np.where(new, at, 0))]
        levels.append(rank.copy())
        active = active[~(new & np.r_[new[1:], True])]
        h *= 2
    if h <= least:
        places = active
    places = places[np.argsort(rank[places], kind="stable")]
    a, b = places[:-1].copy(), places[1:].copy()
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        same &= (a < n) & (b < n)
        length[same] += 1 << k
        a, b = np.minimum(a + (same << k), n), np.minimum(b + (same << k), n)
    return SuffixArray(places, np.r_[0, length] if len(places) else length)


def maximal_repeats(array: SuffixArray, codes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, from, to) for each maximal repeat of `least` words or more: it begins at places[from..to-1].

    An interval of common prefixes is left-maximal, too, if its suffixes do not all follow
    one word; a suffix at the beginning of its text follows nothing and differs from all.
    """
    out: list[tuple[int, int, int]] = []
    before = np.where(array.places > 0, codes[np.maximum(array.places, 1) - 1], -1).tolist()
    stack: list[list] = []  # length, from, the word before all of it or None if they differ
    lcp = array.lcp.tolist()
    for k in range(len(lcp) + 1):
        now = lcp[k] if k < len(lcp) else 0
        start, word = k - 1, before[k - 1] if k else None
        while stack and stack[-1][0] > now:
            length, start, held = stack.pop()
            held = held if held == word else None
            if held is None:
                out.append((length, start, k))
            word = held
        if now >= least:
            if stack and stack[-1][0] == now:
                if stack[-1][2] != word:
                    stack[-1][2] = None
            else:
                stack.append([now, start, word])
    return out


def _merged(parts: list[list[bytes]]) -> np.ndarray:
    flat = [w for p in parts for w in p]
    number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    return codes + np.repeat(np.arange(len(parts)) * max(1, len(number)), [len(p) for p in parts])


def longest_at(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Length of the longest maximal repeat at each of n places of the suffix array, 0 for none.

    Intervals nest, and inner (longer) ones come first, so each place is set once;
    places that are set are jumped over.
    """
    best = np.zeros(n, np.int64)
    after = list(range(n + 1))  # the next place that may be free
    for length, a, b in found:
        k, passed = a, []
        while True:
            while after[k] != k:
                passed.append(k)
                k = after[k]
            if k >= b:
                break
            best[k] = length
            after[k] = k + 1
        for x in passed:
            after[x] = k
    return best


def repeats(parts: list[list[bytes]], least: int) -> list[tuple[int, int, int]]:
    """For each text: words covered by maximal repeats of `least` words or more, the longest, how many there are.

    Where occurrences nest or overlap, each word counts once. At each place the
    longest maximal repeat that starts there covers what shorter ones do.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    codes = _merged(parts)
    array = suffix_array(codes, least)
    starts = np.cumsum(sizes) - sizes
    covered, longest, kinds = (np.zeros(len(parts), np.int64) for _ in range(3))
    found = maximal_repeats(array, codes, least) if len(array.places) else []
    if found:
        reach = longest_at(found, len(array.places))
        there = reach > 0
        mark = np.zeros(len(codes) + 1, np.int64)
        np.add.at(mark, array.places[there], 1)
        np.add.at(mark, array.places[there] + reach[there], -1)
        total = np.r_[0, np.cumsum(np.cumsum(mark[:-1]) > 0)]
        covered = total[starts + sizes] - total[starts]
        length, first, _ = (np.array(x) for x in zip(*found, strict=True))
        text_of = np.searchsorted(starts, array.places[first], side="right") - 1
        np.maximum.at(longest, text_of, length)
        np.add.at(kinds, text_of, 1)
    return list(zip(covered.tolist(), longest.tolist(), kinds.tolist(), strict=True))


def _base(text: str | None, words: list[bytes]) -> tuple[int, int, int]:
    """Code points in words, symbols, and lines with a word that equal an earlier line."""
    if not text:
        return 0, 0, 0
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    return len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def repetition(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 8, min_words: int = 20, max_repeat_percent: int = 30, max_covered_percent: int = 20, max_longest: int = 100, batch_words: int = 400_000) -> DataFrame:
    """One row per document row with the base counts and the verdict of the repeats.

    covered_words, longest_repeat and n_repeats are of maximal repeats of `window`
    words or more. A word lies in a window that occurs twice or more just if such
    a repeat covers it, so n_repeat_words is the same number. kept is false for
    base_failed, and where the covered part is over max_covered_percent or the
    longest repeat has more than max_longest words.

    Null, empty and blank texts have no words and fail. A very long text is sorted
    alone, whole. Repeated rows give equal
    results; other columns are ignored; an empty table gives an empty result.
    """
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_fraction", "longest_repeat", "n_repeats"]

    def judged(ids: pa.Array, texts: list[str | None], parts: list[list[bytes]]) -> pa.RecordBatch:
        rows = []
        for text, words, (covered, longest, kinds) in zip(texts, parts, repeats(parts, window), strict=True):
            n = len(words)
            failed = n < min_words or 100 * covered > max_repeat_percent * n
            kept = not failed and 100 * covered <= max_covered_percent * n and longest <= max_longest
            rows.append((n, *_base(text, words), covered, failed, kept, covered / n if n else 0.0, longest, kinds))
        kinds_ = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        return pa.record_batch([ids, *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds_, strict=True)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            begin, size, parts = 0, 0, []
            for k, text in enumerate(texts):
                parts.append(text.encode("utf-8", "surrogatepass").split() if text else [])
                size += len(parts[-1])
                if size >= batch_words or k == len(texts) - 1:
                    yield judged(batch.column(0).slice(begin, len(parts)), texts[begin : k + 1], parts)
                    begin, size, parts = k + 1, 0, []

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long, n_repeats long"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
