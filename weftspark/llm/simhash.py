"""SimHash near-duplicates with a Gray-ordered hierarchical index.

1. Fingerprints are made once per document, without a shuffle.
2. Only distinct fingerprints go on. With d differing bits allowed, the 64 bits
   fall into d + 1 blocks, and two linked fingerprints agree in one block at
   least; a fingerprint goes to one bucket per block. A bucket of more than
   `max_bucket` fingerprints is dealt out again by the bits that it leaves free,
   in the same way, so a bucket is bounded by its free bits at the last depth
   and no link is lost.
3. In a bucket the fingerprints are sorted by Gray rank; runs of neighbours form
   leaves, runs of leaves upper nodes. A node keeps the bits that all below it
   share. Two nodes whose shared bits differ in more than d places are pruned
   with all their members; two nodes that cannot differ in more are linked whole.
   A bucket returns a spanning forest, so its output is linear however dense it is.
4. Forests of all buckets are joined by large-star/small-star rounds, each
   written to the shared folder.

near_duplicates links by the fingerprints alone; nearcopies.py takes the index's
links as candidates for texts of similar shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import LOWER, materialise, small

FANOUT = 8
#: pairs of members looked at in one go
CHUNK = 1 << 21
_SIGN = 1 << 63


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash, unsigned; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[: -shingle]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """id, fp (long, the 64 bits as they are); one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            values = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Forest of Gray-ordered groups, one tree per bucket, for all buckets of a partition."""

    def __init__(self, bucket: np.ndarray, values: np.ndarray):
        order = np.lexsort((gray_rank(values), bucket))
        self.bucket, self.values = bucket[order], values[order]
        n = len(self.values)
        first = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]]) if n else np.empty(0, np.int64)
        sizes = np.diff(np.r_[first, n])
        #: per level: where the children of each node begin (with an end mark), shared bits, their values
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.below = [np.arange(n + 1)]
        all_and, all_or, counts = self.values, self.values, sizes
        while True:
            nodes = -(-counts // FANOUT)
            starts = np.repeat(np.cumsum(counts) - counts, nodes) + FANOUT * _within(nodes)
            if n:
                all_and, all_or = np.bitwise_and.reduceat(all_and, starts), np.bitwise_or.reduceat(all_or, starts)
            shared = ~(all_and ^ all_or)
            ends = np.r_[starts, counts.sum()]
            self.levels.append((ends, shared, all_and & shared))
            counts = nodes
            if not n or counts.max() == 1:
                break

    def forest(self, most: int) -> np.ndarray:
        """For each value, the place of the first value of its component at Hamming distance most."""
        labels = np.arange(len(self.values))
        if not len(labels):
            return labels
        leaves = [np.arange(len(labels))]
        for ends, _, _ in self.levels:
            leaves.append(leaves[-1][ends[:-1]])
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][1]))
        stack = [(top, roots, roots)]
        spans: dict[int, list] = {}
        while stack:
            level, a, b = stack.pop()
            if len(a) > CHUNK // (FANOUT * FANOUT) and level >= 0:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            ends, shared, bits = self.levels[level]
            both = shared[a] & shared[b]
            differ = np.bitwise_count((bits[a] ^ bits[b]) & both).astype(np.int64)
            # whole groups too far apart, or already in one component, need no look inside
            # (spans may be of earlier labels: what was one component stays one)
            if level not in spans or spans[level][2] > len(labels):
                spans[level] = [np.minimum.reduceat(labels, leaves[level + 1]), np.maximum.reduceat(labels, leaves[level + 1]), 0]
            lo, hi, _ = spans[level]
            spans[level][2] += len(a)
            alive = (differ <= most) & ~((lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] == lo[b]))
            near = alive & (differ + np.bitwise_count(~both) <= most)
            if near.any():
                labels = self._link_whole(labels, leaves[level + 1], a[near], b[near])
                alive &= ~near
            a, b = a[alive], b[alive]
            if not len(a):
                continue
            x, y = _children(ends, a, b)
            if level:
                # neighbours first: they join most of what belongs together
                close = y - x <= 1
                stack += [(level - 1, x[~close], y[~close]), (level - 1, x[close], y[close])]
                continue
            keep = (x != y) & (labels[x] != labels[y])
            x, y = x[keep], y[keep]
            linked = np.bitwise_count(self.values[x] ^ self.values[y]) <= most
            labels = _union(labels, x[linked], y[linked])
        return labels

    def _link_whole(self, labels: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join all members of each pair of groups; within a pair every cross pair is a link."""
        stops = np.r_[starts[1:], len(labels)]
        for side in (a, b):
            size = stops[side] - starts[side]
            member = np.repeat(starts[side], size) + _within(size)
            labels = _union(labels, np.repeat(starts[a], size), member)
        return labels


def _within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, in one array."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _children(ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a and a child of b; for a = b each pair once."""
    na, nb = ends[a + 1] - ends[a], ends[b + 1] - ends[b]
    k = _within(na * nb)
    width = np.repeat(nb, na * nb)
    x, y = np.repeat(ends[a], na * nb) + k // width, np.repeat(ends[b], na * nb) + k % width
    keep = x <= y
    return x[keep], y[keep]


def _union(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    while len(x):
        p, q = labels[x], labels[y]
        open_ = p != q
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        if not len(x):
            break
        np.minimum.at(labels, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def _split(free: int, parts: int) -> list[int]:
    """The free bits, dealt to so many masks of nearly equal size."""
    places = [k for k in range(64) if free >> k & 1]
    cuts = [len(places) * k // parts for k in range(parts + 1)]
    return [sum(1 << places[k] for k in range(cuts[j], cuts[j + 1])) for j in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= _SIGN else mask


def links(fps: DataFrame, *, most: int = 4, max_bucket: int = 200_000, depth: int = 4, chains: bool = False) -> DataFrame:
    """Spanning links (t, a, b) of distinct fingerprints fps(t, fp) at Hamming distance most, for each table t.

    Buckets above max_bucket go one level deeper, up to depth; after that a
    bucket is bounded by the bits left free (26 of 64 for the defaults). A bucket
    links each member of a component to its first one in Gray order; with chains
    also to the one before it.
    """
    parts = most + 1
    full = (1 << 64) - 1
    level = {0: _split(full, parts)}
    rows = fps.select("t", "fp", F.explode(F.array(*[F.lit(_signed(m)) for m in level[0]])).alias("mask"))
    ready = None
    for at in range(depth):
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        if at == depth - 1:
            break
        hot = rows.groupBy("t", "mask", "value").count().filter(F.col("count") > max_bucket).select("t", "mask", "value")
        hot = materialise(hot, "hot")
        if hot.isEmpty():
            break
        cold = rows.join(hot, ["t", "mask", "value"], "left_anti")
        ready = cold if ready is None else ready.unionByName(cold)
        deeper = {m: [m | x for x in _split(full & ~m, parts)] for m in level[at]}
        level[at + 1] = sorted({x for v in deeper.values() for x in v})
        below = F.create_map(*[c for m, v in deeper.items() for c in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in v]))])
        rows = rows.join(hot, ["t", "mask", "value"], "left_semi").select("t", "fp", F.explode(below[F.col("mask")]).alias("mask"))
    rows = rows if ready is None else ready.unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        data = pa.Table.from_batches(got)
        fp, mask, value = (data.column(c).to_numpy().view(np.uint64) for c in ("fp", "mask", "value"))
        table = data.column("t").to_numpy()
        key = np.lexsort((value, mask, table))
        new = np.ones(len(key), bool)
        new[1:] = (mask[key][1:] != mask[key][:-1]) | (value[key][1:] != value[key][:-1]) | (table[key][1:] != table[key][:-1])
        first = key[new]
        index = GrayIndex(np.cumsum(new) - 1, fp[key])
        labels = index.forest(most)
        places = np.arange(len(labels))
        left, right = [places], [labels]
        if chains:
            by = np.argsort(labels, kind="stable")
            same = np.flatnonzero(labels[by][1:] == labels[by][:-1])
            left.append(by[same + 1])
            right.append(by[same])
        a, b = np.concatenate(left), np.concatenate(right)
        # deeper buckets may hold a fingerprint twice, by two ways to the same mask
        far = index.values[a] != index.values[b]
        a, b = a[far], b[far]
        t = table[first][index.bucket[a]]
        yield pa.record_batch([pa.array(t, pa.int32()), pa.array(index.values[a].view(np.int64)), pa.array(index.values[b].view(np.int64))], names=["t", "a", "b"])

    return rows.repartition("t", "mask", "value").mapInArrow(run, "t int, a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of its component."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large-star: neighbours above a node move to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written out: a join of two plain tables can be split where one node has many neighbours
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small-star: a node and the neighbours below it move to the smallest of them
        large = materialise(large, "large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = materialise(small, "star")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, most: int = 4, max_bucket: int = 200_000) -> DataFrame:
    """One row per document row: id, fp (long), component_id.

    component_id is the smallest id that can be reached over links, the row's own
    included. Texts without words (null, empty, blank) have fingerprint 0 and are
    linked like any other; repeated rows share a fingerprint and so a component; a
    null id never becomes a component id unless the component has no other. Other
    columns are ignored. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fp")
    reps = materialise(prints.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    roots = components(links(reps.select(F.lit(0).alias("t"), "fp"), most=most, max_bucket=max_bucket).select("a", "b"))
    of = reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = of.join(least, "root").select("fp", "component_id")
    return prints.join(known, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
