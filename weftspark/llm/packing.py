"""Best-fit packing of documents into sequences, improved by swaps.

Each task encodes its documents, cuts the ones over the limit, and packs bounded
windows of pieces: best-fit decreasing first, then a local search that moves one
piece, exchanges one for one, or two for one between underfull bins, always
raising the squared fill, until the lower bound is met or no step is left.
Underfull bins, and all bins with room where a window missed its lower bound, are
then opened again: their pieces go to a second round over few tasks, so a
window's waste does not stay. Both rounds are written to the shared
folder, which fixes what is in which sequence before anything else reads it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import scratch_path, small
from weftspark.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Best-fit decreasing; bins of places in lengths. A bit set of free room finds the tightest bin."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0
    for k in order:
        n = lengths[k]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = limit, len(bins)
            bins.append([k])
        left = room - n
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


class _Search:
    """Local search over underfull bins. Every step raises the sum of squared fills, so it ends.

    Only lengths matter, so bins are kept as counts of lengths, and bins of equal
    content stand for each other.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], limit: int):
        self.limit = limit
        self.bins = {b: Counter(lengths[k] for k in x) for b, x in enumerate(bins)}
        self.fill = {b: sum(lengths[k] for k in x) for b, x in enumerate(bins)}

    def run(self, floor: int) -> list[Counter]:
        """Empties bins, the least full first, into the others until there are `floor` bins or nothing helps.

        A donor that gives nothing away is passed over; once no donor does, the search ends.
        """
        changed = True
        while changed and len(self.bins) > floor:
            changed = False
            tried = set()
            for donor in sorted((b for b in self.bins if self.fill[b] < self.limit), key=lambda b: (self.fill[b], b)):
                content = self._content(donor)
                if content in tried:
                    continue
                if self._give(donor):
                    changed = True
                    if len(self.bins) <= floor:
                        break
                    tried.clear()
                else:
                    tried.add(content)
        return list(self.bins.values())

    def _content(self, b: int) -> tuple:
        return tuple(sorted(self.bins[b].items()))

    def _give(self, donor: int) -> bool:
        """Steps from the donor to all others, the fullest first; whether there was one."""
        gave, vain = False, set()
        for taker in sorted((b for b in self.bins if b != donor and self.fill[b] < self.limit), key=lambda b: (-self.fill[b], b)):
            if self.fill[taker] < self.fill[donor]:
                break  # from the emptier to the fuller only: that raises the sum of squares
            content = self._content(taker)
            if content in vain:
                continue
            while donor in self.bins and self._step(taker, donor):
                gave = True
                vain.clear()
            if donor not in self.bins:
                break
            vain.add(self._content(taker))
        return gave

    def _step(self, to: int, of: int) -> bool:
        """The change that makes the fuller bin `to` fullest; False if there is none."""
        room, own, other = self.limit - self.fill[to], self.bins[to], self.bins[of]
        if not room:
            return False
        have = 0
        for n in other:
            have |= 1 << n
        fits = have & ((2 << room) - 1)
        gain, out, into = 0, (), ()
        if fits:  # a move
            gain = fits.bit_length() - 1
            into = (gain,)
        if gain < room:
            for n in own:  # one for one
                fits = have & ((2 << (n + room)) - 1)
                best = fits.bit_length() - 1 - n if fits else 0
                if best > gain:
                    gain, out, into = best, (n,), (n + best,)
                    if gain == room:
                        break
        if gain < room:  # one of the fuller bin for two of the other
            for n in own:
                for first, count in other.items():
                    left = n + room - first
                    if left <= 0:
                        continue
                    fits = (have if count > 1 else have & ~(1 << first)) & ((2 << left) - 1)
                    if not fits:
                        continue
                    second = fits.bit_length() - 1
                    if first + second - n > gain:
                        gain, out, into = first + second - n, (n,), (first, second)
        if not gain:
            return False
        for source, target, moved in ((other, own, into), (own, other, out)):
            for n in moved:
                source[n] -= 1
                if not source[n]:
                    del source[n]
                target[n] += 1
        self.fill[to] += gain
        self.fill[of] -= gain
        if not other:
            del self.bins[of], self.fill[of]
        return True


def pack(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of places in lengths, none over limit."""
    bins = best_fit(lengths, limit)
    floor = -(-sum(lengths) // limit)
    if len(bins) <= floor:
        return bins
    places: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        places.setdefault(n, []).append(k)
    return [sorted(places[n].pop() for n, count in x.items() for _ in range(count)) for x in _Search(lengths, bins, limit).run(floor)]


def _emit(rows: list[tuple], limit: int, number: Iterator[int], reopen: float | None) -> pa.RecordBatch:
    """Rows (doc_id, piece, start, ids bytes) packed; bins filled below `reopen` stay open.

    Where more bins are needed than the ids would fill, all with any room stay open.
    """
    lengths = [len(r[3]) // 4 for r in rows]
    out: list[tuple] = []
    bins = pack(lengths, limit)
    if reopen is not None and len(bins) > -(-sum(lengths) // limit):
        reopen = limit
    for members in bins:
        fill = sum(lengths[k] for k in members)
        seq, at = next(number), 0
        for k in members:
            out.append((*rows[k][:3], lengths[k], rows[k][3], seq, at, reopen is not None and fill < reopen))
            at += lengths[k]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "open"])


def _packed(batches: Iterator[tuple], limit: int, window: int, first: int, reopen: float | None) -> Iterator[pa.RecordBatch]:
    number = iter(range(first + (TaskContext.get().partitionId() << 32), 1 << 63))
    rows, size = [], 0
    for row in batches:
        rows.append(row)
        size += len(row[3])
        if size >= 4 * window:
            yield _emit(rows, limit, number, reopen)
            rows, size = [], 0
    if rows:
        yield _emit(rows, limit, number, reopen)


def pack_documents(docs: DataFrame, tokenizer_file: str, *, limit: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", window_ids: int = 1 << 22, reopen: float = 0.97, second_pieces: int = 50_000, cache_words: int = 500_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    Documents longer than limit are cut into pieces of limit ids, the last may be
    shorter; all others stay whole. A null or empty text is its end id alone; if
    end_id is None it has no piece. Very long texts are encoded whole, one at a
    time. Null ids stay null. Repeated rows are packed as often as they occur. Other columns
    are ignored. An empty table gives an empty result. cache_words bounds the memory that
    a worker's encoder keeps words in.
    """
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words = encoder(tokenizer_file, cache_words)
        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([words.ids(text).astype("<u4"), tail])
                for k, at in enumerate(range(0, len(ids), limit)):
                    yield doc_id, k, at, ids[at : at + limit].tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(pieces(batches), limit, window_ids, 0, reopen * limit)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True))
        return _packed(rows, limit, 4 * window_ids, 1 << 62, None)

    spark = docs.sparkSession
    path, rest_path = scratch_path(spark, "packed"), scratch_path(spark, "repacked")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.mapInArrow(first, PIECES + ", open boolean").write.option("compression", "zstd").parquet(path)
    done = spark.read.schema(PIECES + ", open boolean").parquet(path)
    rest = done.filter("open")
    tasks = max(1, -(-rest.count() // second_pieces))
    rest.select("doc_id", "piece", "start", "ids").repartition(tasks).mapInArrow(second, PIECES + ", open boolean").write.option("compression", "zstd").parquet(rest_path)
    again = spark.read.schema(PIECES + ", open boolean").parquet(rest_path)
    return done.filter("not open").drop("open").unionByName(again.drop("open"))
