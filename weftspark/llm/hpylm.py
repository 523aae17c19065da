"""Hierarchical Pitman-Yor language model: word bigrams over a shared unigram restaurant.

Every word that precedes another one is a context restaurant; all of them share
the unigram restaurant as parent, whose parent is uniform over the known words
and one class for all unknown ones. A restaurant serves a dish at a number of
tables; each table is a customer of the parent. Seating is sampled by Gibbs: a
customer leaves, which closes its table with the probability given by generalised
Stirling numbers, and sits down again at an old table or a new one. Predictive
probabilities are averaged over the sweeps after burn-in.

How it is spread over a cluster:

* Documents become blocks of at most `block_words` tokens, written once and
  bucketed by block, so later joins with block-wise results leave them in place.
* Words go as arrays to word buckets, bigrams as arrays to context buckets: one
  row per block and bucket that it has something for (at most one per word or bigram), byte planes under zstandard. The
  number of buckets follows from the tokens, their order from the words, so scores do not depend on partitions. A
  context of more than `hot` customers is split over buckets by its next word.
* A bucket samples its own restaurants. A split context shares out its tables by
  the mean of its parts; words are dealt by a hash, so each part is a fair one.
* The context restaurants take unigram counts as parent while they are sampled;
  the unigram restaurant then seats the tables that they opened.

A predictive probability is linear in the tables of each restaurant, and restaurants are sampled one level after
the other, so its average over the sweeps is the one that the mean tables give; these are what is kept.

Nothing that grows with the vocabulary reaches the driver: it sees four sums.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import LOWER, delete_path, scratch_path
from weftspark.llm.sampling import fold

STIRLING = 256  # exact closing probabilities up to so many customers
PARTIES = 16  # parties in which a dish's customers move in a sweep


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes under zstandard, with their kinds."""
    squeeze = zstandard.ZstdCompressor(level=1)
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
        body = squeeze.compress(planes)
        out.append(struct.pack("<2sII", a.dtype.str[1:].encode(), len(a), len(body)) + body)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at, loose = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        kind, n, size = struct.unpack_from("<2sII", data, at)
        at += 10
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(loose.decompress(data[at : at + size], max_output_size=n * dtype.itemsize), np.uint8) if n else np.empty(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype))
        at += size
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers of 0 or more in the smallest unsigned kind that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def tokens_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), then the end, which is the empty word."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    words.append(b"")
    return words


# ---- seating ---------------------------------------------------------------------------


def closing_table(d: float, size: int = STIRLING) -> np.ndarray:
    """[c, t]: chance that a random one of c customers at t tables sits alone, S(c-1,t-1)/S(c,t)."""
    log = np.full((size + 1, size + 1), -np.inf)
    log[0, 0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, size + 1):
            t = np.arange(1, c + 1)
            stay = np.log(np.maximum(c - 1 - t * d, 0)) + log[c - 1, 1 : c + 1]
            log[c, 1 : c + 1] = np.logaddexp(log[c - 1, :c], stay)
        ratio = np.full((size + 1, size + 1), 0.0)
        ratio[1:, 1:] = np.exp(log[:-1, :-1] - log[1:, 1:])
    return np.nan_to_num(ratio)


def seat(c: np.ndarray, group: np.ndarray, fixed: np.ndarray, share: np.ndarray, parent: np.ndarray, d: float, theta: float, *, sweeps: int, burn: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean tables of each dish, and of each restaurant, over sweeps after burn-in.

    c: customers (2 or more) of each dish; group: its restaurant; fixed: tables of
    dishes not listed (one customer, one table each); share: how many times the
    listed part the whole restaurant is; parent: the dish's probability above.
    """
    rng = np.random.default_rng(seed)
    t = np.ones(len(c), np.int64)
    tables = lambda: share * (fixed + np.bincount(group, t, len(fixed)))
    seen = np.ones(len(c), np.int64)
    while (seen < c).any():  # first seating, the arrivals in growing parties
        come = np.minimum(np.maximum(seen // 2, 1), c - seen)
        new = (theta + d * tables()[group]) * parent
        t = np.minimum(t + rng.binomial(come, new / (new + np.maximum(seen - d * t, 1e-9))), seen + come)
        seen += come
    for _ in range(4):  # parties open too many tables: start with no more than keep the balance below
        t = np.minimum(t, np.maximum(1, np.rint(1 + (theta + d * tables()[group]) * parent / d)).astype(np.int64))
    alone = closing_table(d)
    steps = np.minimum(c, PARTIES)
    total, kept = np.zeros(len(c)), 0
    for k in range(sweeps):
        # as many moves as customers: one by one up to PARTIES of them, else in so many parties
        for j in range(int(steps.max(initial=0))):
            on = np.flatnonzero(steps > j)
            n, now = c[on], t[on]
            party = n * (j + 1) // steps[on] - n * j // steps[on]
            inside = n <= STIRLING
            # S(c-1,t-1)/S(c,t) goes to d (t-1) / (c-1) as c grows
            leave = np.where(inside, alone[np.where(inside, n, 1), np.where(inside, now, 1)], d * (now - 1) / (n - 1))
            closes = np.minimum(rng.binomial(party, np.clip(leave, 0, 1)), now - 1)
            # all dishes move at once; each sees the others as they stood
            single = np.where(party == 1, closes, 0)
            new = (theta + d * (tables()[group[on]] - single)) * parent[on]
            stay = np.maximum(n - 1 - d * (now - single), 1e-9)
            t[on] = np.minimum(now - closes + rng.binomial(party, new / (new + stay)), n)
        if k >= burn:
            total += t
            kept += 1
    mean = total / max(1, kept)
    return mean, share * (fixed + np.bincount(group, mean, len(fixed)))


def discount(ones: float, twos: float) -> float:
    """Estimate from the numbers of dishes with one and with two customers."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos else 0.5


# ---- blocks ------------------------------------------------------------------------------

BLOCK = "block long, doc_ids binary, held binary, sizes binary, tokens binary, words binary, counts binary, n long"


def _close(ids: list, held: list[bool], parts: list[list[bytes]], block: int) -> tuple:
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for p in parts for w in p), np.int64)
    words = sorted(number)
    place = np.empty(len(words), np.int64)
    place[[number[w] for w in words]] = np.arange(len(words))
    tokens = place[flat]
    sizes = np.array([len(p) for p in parts], np.int64)
    train = np.repeat(~np.array(held, bool), sizes)
    counts = np.bincount(tokens[train], minlength=len(words))
    known = packed(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8))
    return block, known, np.array(held, np.uint8).tobytes(), packed(narrow(sizes)), packed(narrow(tokens)), b"\n".join(words), packed(narrow(counts)), len(tokens)


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    ids, held, parts, size = [], [], [], 0

    def out() -> pa.RecordBatch:
        row = _close(ids, held, parts, first)
        return pa.record_batch([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], names=[c.split()[0] for c in BLOCK.split(", ")])

    for batch in batches:
        for doc_id, is_held, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            ids.append(doc_id)
            held.append(is_held)
            parts.append(tokens_of(text))
            size += len(parts[-1])
            if size >= block_words:
                yield out()
                first += 1
                ids, held, parts, size = [], [], [], 0
    if ids:
        yield out()


Spans = dict[int, tuple[int, int]]


def _spans(sorted_buckets: np.ndarray) -> Spans:
    """Where each bucket that occurs begins and ends; nothing is kept for the others."""
    if not len(sorted_buckets):
        return {}
    at = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]])
    return dict(zip(sorted_buckets[at].tolist(), zip(at.tolist(), [*at[1:].tolist(), len(sorted_buckets)], strict=True), strict=True))


def _dealt(words: list[bytes], buckets: int) -> tuple[np.ndarray, Spans]:
    """Places of the words in bucket order, and where each bucket stands."""
    of = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return order, _spans(of[order])


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    fields = [x.split() for x in names.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.record_batch([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


SENT = "bucket int, block long, data binary"


def _send_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for row in batch.to_pylist():
            words, counts = row["words"].split(b"\n"), unpacked(row["counts"])[0]
            order, spans = _dealt(words, buckets)
            out = []
            for k, (a, b) in spans.items():
                part = order[a:b]
                text = squeeze.compress(b"\n".join([words[i] for i in part]))
                out.append((k, row["block"], struct.pack("<I", len(text)) + text + packed(counts[part])))
            yield _rows(out, SENT)


def _number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and bucket: number of each word in the bucket (by their order), and its training count in all."""
    loose = zstandard.ZstdDecompressor()
    groups: dict[int, list] = {}
    for batch in batches:
        for bucket, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            groups.setdefault(bucket, []).append((block, data))
    for bucket, sent in groups.items():
        got = []
        for block, data in sent:
            size = struct.unpack_from("<I", data)[0]
            got.append((block, loose.decompress(data[4 : 4 + size]).split(b"\n"), unpacked(data[4 + size :])[0]))
        # by the words' own order, so that numbers do not depend on what block brought a word first
        number = {w: k for k, w in enumerate(sorted({w for _, words, _ in got for w in words}))}
        found = [(block, np.fromiter(map(number.__getitem__, words), np.int64, len(words)), counts) for block, words, counts in got]
        total = np.zeros(len(number), np.int64)
        for _, ids, counts in found:
            total[ids] += counts.astype(np.int64)
        sums = np.array([(total > 0).sum(), total.sum(), (total == 1).sum(), (total == 2).sum()], np.int64)
        yield _rows([(bucket, -1, packed(sums)), *((bucket, block, packed(narrow(ids), narrow(total[ids]))) for block, ids, _ in found)], SENT)


# ---- a block's bigrams, in an order that every pass finds again ----------------------------


class Bigrams:
    """Distinct bigrams of a block in bucket order, from its row and its words' numbers and counts."""

    def __init__(self, row: dict, buckets: int, hot: int):
        self.words = row["words"].split(b"\n")
        self.sizes = unpacked(row["sizes"])[0].astype(np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.tokens = unpacked(row["tokens"])[0].astype(np.int64)
        self.order, self.spans = _dealt(self.words, buckets)
        n = len(self.words)
        self.number, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for got in row["numbered"]:
            part = self.order[slice(*self.spans[got["bucket"]])]
            local, total = unpacked(got["data"])
            self.number[part] = local.astype(np.int64) * buckets + got["bucket"]
            self.count[part] = total.astype(np.int64)
        # a text's last token is the end, so the end stands before every first word
        before = np.r_[0, self.tokens[:-1]]
        pairs, self.inverse = np.unique(before * n + self.tokens, return_inverse=True)
        first, second = pairs // n, pairs % n
        train = np.repeat(~self.held, self.sizes)
        seen = np.bincount(self.inverse[train], minlength=len(pairs))
        parts = -(-self.count[first] // hot)
        self.parts = np.maximum(parts, 1)
        mixed = (self.number[second].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        part = (mixed % self.parts.astype(np.uint64)).astype(np.int64)
        spread = (self.number[first].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
        bucket = ((spread.astype(np.int64) + part) % buckets).astype(np.int64)
        by = np.lexsort((self.number[second], part, self.number[first], bucket))
        self.back = np.empty(len(by), np.int64)
        self.back[by] = np.arange(len(by))
        self.first, self.second, self.seen, self.part, self.parts = first[by], second[by], seen[by], part[by], self.parts[by]
        bucket = bucket[by]
        self.at = _spans(bucket)
        u, p = self.number[self.first], self.part
        edge = np.ones(len(by), bool)
        edge[1:] = (u[1:] != u[:-1]) | (p[1:] != p[:-1]) | (bucket[1:] != bucket[:-1])
        self.context_at = np.flatnonzero(edge)
        self.context_of = np.cumsum(edge) - 1
        self.contexts = _spans(bucket[self.context_at])

    def send(self, block: int) -> list[tuple]:
        rows = []
        # counts up to 2^64 in steps of 0.04 %
        size_code = np.round(1000 * np.log2(np.maximum(self.count, 1))).astype(np.uint16)
        for k, (a, b) in self.at.items():
            at = self.context_at[slice(*self.contexts[k])]
            lengths = np.diff(np.r_[at, b])
            rows.append((k, block, packed(narrow(self.number[self.first[at]]), narrow(self.part[at]), narrow(self.parts[at]), narrow(self.count[self.first[at]]), narrow(lengths), narrow(self.number[self.second[a:b]]), narrow(self.seen[a:b]), size_code[self.second[a:b]])))
        return rows

    def learned(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per bigram, in bucket order: owned, customers, mean tables; per context: mean tables, discount."""
        n, m = len(self.first), len(self.context_at)
        owned, c, t = np.zeros(n, bool), np.zeros(n), np.zeros(n)
        tables, d = np.zeros(m), np.full(m, 0.5)
        for got in row["seated"]:
            (a, b), (x, y) = self.at[got["bucket"]], self.contexts[got["bucket"]]
            own, customers, mean, whole, rate = unpacked(got["data"])
            owned[a:b] = np.unpackbits(own, count=b - a).astype(bool)
            c[a:b] = customers
            t[a:b] = mean / 16
            tables[x:y], d[x:y] = whole, rate[0]
        # parts of a split context each estimate all of it: their mean
        key = self.first[self.context_at]
        total, count = np.bincount(key, tables, len(self.words)), np.bincount(key, minlength=len(self.words))
        return owned, c, t, (total / np.maximum(count, 1))[key], d


def _send_bigrams(batches: Iterator[pa.RecordBatch], buckets: int, hot: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            for r in Bigrams(row, buckets, hot).send(row["block"]):
                yield _rows([r], SENT)


def _seat_contexts(batches: Iterator[pa.RecordBatch], total: int, theta: float, sweeps: int, burn: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Joins the bigrams of all blocks in a bucket, samples its restaurants, answers each block."""
    groups: dict[int, list] = {}
    for batch in batches:
        for bucket, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            groups.setdefault(bucket, []).append((block, data))
    for bucket, sent in groups.items():
        sent.sort()
        got = [unpacked(data) for _, data in sent]
        sizes = [len(g[5]) for g in got]
        contexts = [len(g[0]) for g in got]
        wide = lambda k: np.concatenate([g[k].astype(np.int64) for g in got])
        # a context and its part as one number
        _, first = np.unique(wide(0), return_inverse=True)
        part = wide(1)
        known, of_list = np.unique(first * (part.max(initial=0) + 1) + part, return_inverse=True)
        share = np.ones(len(known))
        share[of_list] = wide(2)
        context = np.repeat(of_list, wide(4))
        second, seen, code = wide(5), wide(6), np.concatenate([g[7] for g in got])
        by = np.lexsort((second, context))
        edge = np.ones(len(by), bool)
        edge[1:] = (context[by][1:] != context[by][:-1]) | (second[by][1:] != second[by][:-1])
        at = np.flatnonzero(edge)
        c = np.add.reduceat(seen[by], at)
        owner = np.minimum.reduceat(np.where(seen[by] > 0, by, np.iinfo(np.int64).max), at)
        group = context[by][at]
        d = discount(float((c == 1).sum()), float((c == 2).sum()))
        many = np.flatnonzero(c >= 2)
        fixed = np.bincount(group[c == 1], minlength=len(known)).astype(np.float64)
        parent = np.exp2(code[by][at][many] / 1000.0) / max(1, total)
        mean, tables = seat(c[many], group[many], fixed, share, np.minimum(parent, 1.0), d, theta, sweeps=sweeps, burn=burn, seed=seed + bucket)
        t = np.minimum(c, 1).astype(np.float64)
        t[many] = mean
        entry = np.empty(len(by), np.int64)
        entry[by] = np.cumsum(edge) - 1
        owned = np.zeros(len(by), bool)
        owned[owner[c > 0]] = True
        a = x = 0
        out = []
        for (block, _), n, m in zip(sent, sizes, contexts, strict=True):
            e, l = entry[a : a + n], of_list[x : x + m]
            out.append((bucket, block, packed(np.packbits(owned[a : a + n]), narrow(c[e]), narrow(np.round(16 * t[e]).astype(np.int64)), tables[l].astype(np.float32), np.array([d]))))
            a, x = a + n, x + m
        yield _rows(out, SENT)


def _send_tables(batches: Iterator[pa.RecordBatch], buckets: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Tables that a block's own bigrams opened, per word: customers of the unigram restaurant."""
    for batch in batches:
        for row in batch.to_pylist():
            b = Bigrams(row, buckets, hot)
            owned, _, t, _, _ = b.learned(row)
            # in sixteenths, so that sums do not depend on how texts fall into blocks
            sums = np.bincount(b.second[owned], np.round(16 * t[owned]), len(b.words)).astype(np.int64)
            out = []
            for k, span in b.spans.items():
                part = b.order[slice(*span)]
                out.append((k, row["block"], packed(narrow(b.number[part] // buckets), narrow(sums[part]))))
            yield _rows(out, SENT)


def _seat_words(batches: Iterator[pa.RecordBatch], vocabulary: int, d: float, theta: float, sweeps: int, burn: int, seed: int) -> Iterator[pa.RecordBatch]:
    groups: dict[int, list] = {}
    for batch in batches:
        for bucket, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            groups.setdefault(bucket, []).append((block, data))
    for bucket, sent in groups.items():
        sent.sort()
        got = [unpacked(data) for _, data in sent]
        n = 1 + max(int(g[0].max()) for g in got)
        sixteenths = np.zeros(n, np.int64)
        for ids, sums in got:
            sixteenths[ids.astype(np.int64)] += sums.astype(np.int64)
        customers = sixteenths / 16
        c = np.round(customers).astype(np.int64)
        many = np.flatnonzero(c >= 2)
        share = np.array([vocabulary / max(1, (c > 0).sum())])
        mean, _ = seat(c[many], np.zeros(len(many), np.int64), np.array([float((c == 1).sum())]), share, np.full(len(many), 1 / (vocabulary + 1)), d, theta, sweeps=sweeps, burn=burn, seed=seed + bucket)
        t = np.minimum(customers, 1.0)
        t[many] = np.minimum(mean, customers[many])
        out = [(bucket, -1, packed(np.array([customers.sum(), t.sum()])))]
        for (block, _), (ids, _) in zip(sent, got, strict=True):
            ids = ids.astype(np.int64)
            out.append((bucket, block, packed(customers[ids].astype(np.float32), t[ids].astype(np.float32))))
        yield _rows(out, SENT)


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(batches: Iterator[pa.RecordBatch], buckets: int, hot: int, sums: dict[str, float], theta: float, top_theta: float) -> Iterator[pa.RecordBatch]:
    size, words, d0 = sums["tokens"], sums["words"], sums["discount"]
    for batch in batches:
        for row in batch.to_pylist():
            b = Bigrams(row, buckets, hot)
            _, c, t, tables, d = b.learned(row)
            customers, above = np.zeros(len(b.words)), np.zeros(len(b.words))
            for got in row["rooted"]:
                part = b.order[slice(*b.spans[got["bucket"]])]
                customers[part], above[part] = unpacked(got["data"])
            uniform = (top_theta + d0 * sums["above"]) / (top_theta + sums["customers"]) / (words + 1)
            unigram = np.maximum(customers - d0 * above, 0) / (top_theta + sums["customers"]) + uniform
            of, d = b.context_of, d[b.context_of]
            context = b.count[b.first].astype(np.float64)
            open_ = (theta + d * np.minimum(tables[of], context)) / (theta + context)
            p = np.maximum(c - d * t, 0) / (theta + context) + open_ * unigram[b.second]
            per_token = np.log10(p)[b.back][b.inverse]
            base = np.log10((b.count + 0.1) / (size + 0.1 * (words + 1)))
            starts = np.cumsum(b.sizes) - b.sizes
            ids, null = unpacked(row["doc_ids"])
            add = lambda x: np.add.reduceat(x, starts)
            yield pa.record_batch(
                [pa.array(ids, mask=null.astype(bool)), pa.array(b.held), pa.array(b.sizes), pa.array(add((b.count > 0).astype(np.int64)[b.tokens])), pa.array(np.full(len(ids), int(size))), pa.array(add(base[b.tokens])), pa.array(add(per_token))],
                names=[x.split()[0] for x in SCORE.split(", ")],
            )


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0, block_words: int = 1_000_000, bucket_words: int = 1_000_000, hot: int = 500_000, theta: float = 2.0, top_theta: float = 100.0, sweeps: int = 12, burn: int = 4, seed: int = 17) -> DataFrame:
    """One row per document row; the model learns from rows outside the held-out fold.

    doc_id, held_out, n_tokens (with the end), n_known (tokens seen in training),
    train_tokens, base_score (additive unigram model) and score, both log10
    probabilities of the whole text. Unknown words share one class of the vocabulary.

    Null and empty texts are one end token, very long texts one block each. Repeated rows count as often as they
    occur. Other columns are ignored. An empty table gives an empty result; without
    training rows every probability comes from the uniform distribution.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"weft_blocks_{uuid.uuid4().hex[:12]}"
    paths: list[str] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        paths.append(scratch_path(spark, label))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    def per_block(answers: DataFrame, column: str) -> DataFrame:
        return answers.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias(column))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col, folds) == held_fold).alias("held"), F.col(text_col).alias("text"))
    paths.append(scratch_path(spark, "blocks"))
    made = rows.mapInArrow(lambda b: _blocks(b, block_words), BLOCK).write.option("compression", "zstd").option("path", paths[-1])
    made.bucketBy(partitions, "block").saveAsTable(name)
    try:
        blocks = spark.table(name)
        # by the number of tokens alone: what is seated together, and with what random numbers, must not follow the partitions
        buckets = max(1, -(-int(blocks.agg(F.sum("n")).first()[0] or 0) // bucket_words))
        sent = blocks.select("block", "words", "counts").mapInArrow(lambda b: _send_words(b, buckets), SENT)
        numbered = kept(sent.repartitionById(buckets, "bucket").mapInArrow(_number_words, SENT), "words")
        of_all = np.sum([unpacked(r["data"])[0] for r in numbered.filter("block < 0").toLocalIterator()] or [np.zeros(4, np.int64)], axis=0)
        words, size = int(of_all[0]), int(of_all[1])
        d0 = discount(float(of_all[2]), float(of_all[3]))
        one = blocks.join(per_block(numbered, "numbered"), "block")

        sent = one.mapInArrow(lambda b: _send_bigrams(b, buckets, hot), SENT)
        seated = kept(sent.repartitionById(buckets, "bucket").mapInArrow(lambda b: _seat_contexts(b, size, theta, sweeps, burn, seed), SENT), "contexts")
        two = one.join(per_block(seated, "seated"), "block")

        sent = two.mapInArrow(lambda b: _send_tables(b, buckets, hot), SENT)
        rooted = kept(sent.repartitionById(buckets, "bucket").mapInArrow(lambda b: _seat_words(b, words, d0, top_theta, sweeps, burn, seed), SENT), "unigrams")
        top = np.sum([unpacked(r["data"])[0] for r in rooted.filter("block < 0").toLocalIterator()] or [np.zeros(2)], axis=0)
        sums = {"tokens": size, "words": words, "discount": d0, "customers": float(top[0]), "above": float(top[1])}

        three = two.join(per_block(rooted, "rooted"), "block")
        out = three.mapInArrow(lambda b: _score(b, buckets, hot, sums, theta, top_theta), SCORE)
        path = scratch_path(spark, "scores")
        out.write.parquet(path)
        return spark.read.schema(SCORE).parquet(path)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for p in paths:
            delete_path(spark, p)


def perplexity(scores: DataFrame, *, score_col: str = "score") -> DataFrame:
    """held_out, n_texts, n_tokens and the perplexity per token of each side of what score_texts returns.

    10 to the power of minus the mean log10 probability of a token; a side without rows has none.
    """
    mean = F.sum(score_col) / F.sum("n_tokens")
    return scores.groupBy("held_out").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.pow(F.lit(10.0), -mean).alias("perplexity"))
