"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every substring of the normalised benchmark items. Training
words stream through it; each position yields the longest item substring that
ends there. Where that length reaches the window (or a whole item that is
shorter than the window), the words are hit.

Scale: documents are never shuffled. Items are cut into blocks of at most
`block_words` words, each broadcast as plain word lists (that is the proven size
bound) and turned into an automaton in the Python worker. With one block every
document streams through it. With more, a bit set of the items' window hashes
(64 bits a window, 128 MB at most) first tells the documents that may hold one; only
these wait, up to `WAITING` bytes at a time, and then pass all blocks, so a
block's automaton is built once for many documents. A worker keeps the automata of
KEPT words, and word lists only while it builds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame

from weftspark.llm.common import LOWER, cache, slim, small, sole

#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a space.
_NORMAL = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: bytes of documents that wait for the blocks, and words of items in the automata that a worker keeps
WAITING, KEPT = 32 << 20, 800_000
_BUILT: dict[tuple[str, int], tuple["ItemAutomaton", int]] = cache()


def item_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton of word sequences, with windows marked."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[str]] = [set()]
        shorts: list[list[tuple[int, str]]] = [[]]
        for name, words in items:
            if not words:
                continue
            last = 0
            for word in words:
                last = self._extend(last, self.vocab.setdefault(word, len(self.vocab)), ends, shorts)
                ends[last].add(name)
            if len(words) < window:
                shorts[last].append((len(words), name))
        self._finish(ends, shorts)

    def _extend(self, last: int, w: int, ends: list, shorts: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is None:
            cur = self._state(length[last] + 1, {}, ends, shorts)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p < 0:
                link[cur] = 0
                return cur
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
                return cur
            link[cur] = self._clone(p, q, w, ends, shorts)
            return cur
        return self._clone(last, q, w, ends, shorts)

    def _state(self, length: int, nxt: dict, ends: list, shorts: list) -> int:
        self.next.append(nxt)
        self.link.append(-1)
        self.length.append(length)
        ends.append(set())
        shorts.append([])
        return len(self.length) - 1

    def _clone(self, p: int, q: int, w: int, ends: list, shorts: list) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), ends, shorts)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        # whole short items that end in q and are now covered by the copy
        shorts[copy] = [x for x in shorts[q] if x[0] <= self.length[copy]]
        shorts[q] = [x for x in shorts[q] if x[0] > self.length[copy]]
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _finish(self, ends: list, shorts: list) -> None:
        by_length = sorted(range(len(self.length)), key=self.length.__getitem__)
        for v in reversed(by_length[1:]):
            ends[self.link[v]] |= ends[v]
        #: for a state that holds substrings of window words or more: the ancestor of exactly that length
        self.window_state = [-1] * len(self.length)
        self.shorts: list[list[tuple[int, str]]] = shorts
        for v in by_length[1:]:
            up = self.link[v]
            if self.length[up] >= self.window:
                self.window_state[v] = self.window_state[up]
            elif self.length[v] >= self.window:
                self.window_state[v] = v
            self.shorts[v] = self.shorts[up] + self.shorts[v]
        marked = set(self.window_state)
        self.items_at = {v: ends[v] for v in marked if v >= 0}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Spans [from, to) of hit words (in order of their end), the items, the longest match."""
        get, nxt, link, length, shorts, window = self.vocab.get, self.next, self.link, self.length, self.shorts, self.window
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        items: set[str] = set()
        v = matched = longest = 0
        for i, w in enumerate(map(get, words)):
            if w is None:
                v = matched = 0
                continue
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                matched = length[v]
                to = nxt[v].get(w)
            if to is None:
                continue
            v = to
            matched += 1
            if matched > longest:
                longest = matched
            if matched >= window:
                states.add(self.window_state[v])
                spans.append((i + 1 - window, i + 1))
            if shorts[v]:
                for k, name in shorts[v]:
                    if k <= matched:
                        items.add(name)
                        spans.append((i + 1 - k, i + 1))
        for s in states:
            items |= self.items_at[s]
        return spans, items, longest


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@dataclass
class Block:
    """Items [(id, words)] under a name that follows from them; their words counted."""

    name: str
    words: int
    items: Broadcast


@dataclass
class Items:
    """All blocks; if there are more than one, the bit set of window hashes and the windows' widths."""

    blocks: list[Block]
    window: int
    bits: Broadcast | None = None
    widths: tuple[int, ...] = ()


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """64-bit hash of each `width` words in a row."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.full(max(0, len(w) - width + 1), width, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(h)]
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _places(h: np.ndarray, power: int) -> list[np.ndarray]:
    return [(h * np.uint64(m)) >> np.uint64(64 - power) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int, window: int) -> Items:
    """Items in broadcast blocks, cut so that no block holds more than block_words words.

    An item longer than that is cut into parts that overlap, so every window stays whole in one.
    """
    if block_words < 2 * window:
        raise ValueError("a block must hold two windows or more")
    spark = items.sparkSession
    blocks: list[Block] = []
    found: list[np.ndarray] = []
    widths: set[int] = set()

    def close() -> None:
        name = hashlib.sha256(repr(now).encode()).hexdigest()
        blocks.append(Block(name, n, spark.sparkContext.broadcast(now)))
        for _, words in now:
            width = min(window, len(words))
            if width:
                widths.add(width)
                found.append(np.unique(_hashes(words, width)))

    now: list[tuple[str, list[bytes]]] = []
    n = 0
    rows = items.select(items[id_col].cast("string"), items[text_col]).dropna().distinct()
    for name, text in rows.toLocalIterator():
        words = item_words(text)
        overlap = min(64, block_words // 2)
        starts = [0] if len(words) <= block_words else range(0, len(words) - overlap, block_words - overlap)
        for at in starts:
            part = words[at : at + block_words]
            if now and n + len(part) > block_words:
                close()
                now, n = [], 0
            now.append((name, part))
            n += len(part)
    if now or not blocks:
        close()
    if len(blocks) == 1:
        return Items(blocks, window)
    every = np.unique(np.concatenate(found))
    power = min(30, max(10, int(64 * len(every)).bit_length()))
    bits = np.zeros(1 << (power - 6), np.uint64)
    for at in _places(every, power):
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return Items(blocks, window, spark.sparkContext.broadcast((power, bits)), tuple(sorted(widths)))


def _may_hit(words: list[bytes], items: Items) -> bool:
    """False only for words without any window of any block."""
    if items.bits is None:
        return True
    power, bits = items.bits.value
    for width in items.widths:
        there = np.ones(max(0, len(words) - width + 1), bool)
        for at in _places(_hashes(words, width), power):
            there &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        if there.any():
            return True
    return False


def _automaton(block: Block, window: int) -> ItemAutomaton:
    key = (block.name, window)
    if key not in _BUILT:
        while _BUILT and sum(n for _, n in _BUILT.values()) + block.words > KEPT:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[key] = (ItemAutomaton(block.items.value, window), block.words)
        block.items.__dict__.pop("_value", None)  # the word lists are in the file still
    return _BUILT[key][0]


Found = tuple[int, list[tuple[int, int]], list[str], int]


def _scan(texts: list[str | None], items: Items) -> list[Found]:
    """For each text: number of words, merged hit spans, item ids in order, longest match."""
    spans: list[list] = [[] for _ in texts]
    names: list[set[str]] = [set() for _ in texts]
    longest, counts = [0] * len(texts), [0] * len(texts)
    for block in items.blocks:
        automaton = _automaton(block, items.window)
        for k, t in enumerate(texts):
            words = item_words(t)
            s, found, most = automaton.hits(words)
            counts[k] = len(words)
            spans[k] += s
            names[k] |= found
            longest[k] = max(longest[k], most)
    return [(n, _merged(s), sorted(i), m) for n, s, i, m in zip(counts, spans, names, longest, strict=True)]


def _scanned(batches: Iterator[pa.RecordBatch], place: int, items: Items) -> Iterator[tuple[pa.RecordBatch, list[str | None], list[Found]]]:
    """Slices of the batches with their texts (column `place`) and what was found; rows that had to wait come later.

    Of a text that surely holds no window the longest match is not looked for, it is -1.
    """
    sole(_BUILT)
    waiting: list[pa.RecordBatch] = []
    size = 0

    def scan(rows: pa.RecordBatch) -> tuple:
        texts = rows.column(place).to_pylist()
        return rows, texts, _scan(texts, items)

    for batch in small(batches):
        if items.bits is None:
            yield scan(batch)
            continue
        texts = batch.column(place).to_pylist()
        words = list(map(item_words, texts))
        maybe = np.array([_may_hit(w, items) for w in words], bool)
        clean = np.flatnonzero(~maybe)
        yield batch.filter(pa.array(~maybe)), [texts[k] for k in clean], [(len(words[k]), [], [], -1 if words[k] else 0) for k in clean]
        if maybe.any():
            waiting.append(batch.filter(pa.array(maybe)))
            size += sum(len(texts[k]) for k in np.flatnonzero(maybe))
            if size >= WAITING:
                yield from map(scan, _joined(waiting))
                waiting, size = [], 0
    yield from map(scan, _joined(waiting))


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, block_words: int = 200_000) -> DataFrame:
    """One row per document row: n_words, hit spans (in words), items and longest match.

    Null or empty texts have no words and no hits; null items or item ids are
    left out; repeated document rows give one row each; an item id that occurs
    more than once counts once. Columns besides the named ones are ignored, so
    clashing names do no harm. Empty tables give empty or all-zero results.
    """
    if not 2 <= window <= 32:
        raise ValueError("window must be from 2 to 32 words")
    known = item_blocks(items, item_id, item_text, block_words, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, got in _scanned(batches, 1, known):
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([[{"first": a, "end": b} for a, b in g[1]] for g in got], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                    pa.array([g[2] for g in got], pa.list_(pa.string())),
                    pa.array([g[3] for g in got], pa.int32()),
                ],
                names=["id", "n_words", "spans", "items", "longest"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_words long, spans array<struct<first:int,end:int>>, items array<string>, longest int").withColumnRenamed("id", id_col)


def excise(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (word numbers) and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(LOWER))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", n_chars_col: str | None = "n_chars", window: int = 8, max_items: int = 1, max_coverage: float = 0.5, min_span: int = 8, block_words: int = 200_000) -> DataFrame:
    """docs without contaminated rows and passages; same columns.

    A row goes if windows of more than max_items items occur in it, or if more
    than max_coverage of its words are hit, by short items, too.
    In the other rows spans of min_span words or more are cut out of the text.
    Rows with null or empty text stay as they are, repeated rows are treated alike, an empty
    table or no items change nothing; columns of docs keep their names, whatever they are.
    """
    known = item_blocks(items, "item_id", "text", block_words, window)
    schema = slim(docs).schema
    place = schema.names.index(text_col)
    count = schema.names.index(n_chars_col) if n_chars_col in schema.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, got in _scanned(batches, place, known):
            keep, changed = [], []
            for k, (n, spans, found, _) in enumerate(got):
                long = [s for s in spans if s[1] - s[0] >= min_span]
                if len(found) > max_items or sum(b - a for a, b in spans) > max_coverage * n:
                    keep.append(False)
                    continue
                keep.append(True)
                if long:
                    texts[k] = excise(texts[k], long)
                    changed.append(k)
            if changed:
                columns = list(batch.columns)
                columns[place] = pa.array(texts, batch.schema.field(place).type)
                if count is not None:
                    sizes = columns[count].to_pylist()
                    for k in changed:
                        sizes[k] = len(texts[k])
                    columns[count] = pa.array(sizes, batch.schema.field(count).type)
                batch = pa.record_batch(columns, schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
