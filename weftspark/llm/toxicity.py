"""Toxicity behind a noisy channel.

Writers hide words by leetspeak, by spacing letters out and by repeating them. A
suspicious token becomes a lattice: each character stands for itself, for the
letters it imitates, or, as a separator or a repetition, for nothing. A Viterbi
search under a character trigram model of the corpus picks the letters, and in
runs of short pieces the gaps that end a word; the restored text is then scored by a logistic model over words and word beginnings.

The character model counts all texts (at most 28^3 sums leave a task). Labels are
learned from a bounded sample. Documents are not shuffled; plain words skip the
search, and each distinct token is decoded once per worker.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import cache, materialise, small, sole
from weftspark.llm.sampling import bounded, fold
from weftspark.llm.tokens import _Generations

#: Letters that a character imitates.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "¡": "i", "*": "aeiou"}
SEPARATORS = ".-_*~,'’`/\\^:;=#"
SIGNS = 28  # 0 blank, 1-26 a-z, 27 any other letter
EDGE = "".join(sorted(set(SEPARATORS) | set("!¡?\"%&|>)]}[{(<“”«»")))
_ALPHA = re.compile(r"[^\W\d_]")
_LEET = re.compile(r"[0-9@$!|+(<€¡]")
_SIGN = re.compile(r"[0-9@$!|+(<€¡.\-_*~,'’`/\\^:;=#]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")


def _signs() -> np.ndarray:
    """Sign of each byte of lower-cased UTF-8; continuation bytes are 255, to be left out."""
    out = np.zeros(256, np.uint8)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    out[0x80:0xC0] = 255
    out[0xC0:] = 27
    return out


SIGN_OF = _signs()


def sign(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of sign trigrams of the texts, each with two blanks before it and one behind."""
    raw = b"  ".join(t.encode("utf-8", "surrogatepass") for t in texts if t)
    s = SIGN_OF[np.frombuffer(b"  " + raw + b" ", np.uint8)]
    s = s[s != 255].astype(np.int32)
    return np.bincount((s[:-2] * SIGNS + s[1:-1]) * SIGNS + s[2:], minlength=SIGNS**3)


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(third sign | first two) from all texts, smoothed by bigrams and by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIGNS**3, np.int64)
        for batch in small(batches):
            texts = batch.column(0).to_pylist()
            for k in range(0, len(texts), 500):
                total += trigram_counts(texts[k : k + 500])
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], names=["code", "n"])

    sums = docs.select(text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIGNS**3)
    for r in sums:
        counts[r["code"]] = r["n"]
    counts = counts.reshape(SIGNS, SIGNS, SIGNS)
    two = counts.sum(axis=0) + 0.1
    two /= two.sum(axis=1, keepdims=True)
    return np.log((counts + 5 * two[None]) / (counts.sum(axis=2, keepdims=True) + 5))


def suspicious(token: str) -> bool:
    """A letter with a sign or separator behind it, a leet sign with a letter behind it, or a letter three times in a row."""
    if not token.isalpha() and (first := _ALPHA.search(token)):
        back = token[::-1]
        sign_, leet = _SIGN.search(back), _LEET.search(token)
        if sign_ and len(token) - 1 - sign_.start() > first.start():
            return True
        if leet and leet.start() < len(token) - 1 - _ALPHA.search(back).start():
            return True
    return bool(_TRIPLE.search(token))


def decode(token: str, model: np.ndarray, *, imitate: float = -1.0, keep: float = -4.0, drop: float = -0.3, again: float = -0.2, join: float = -0.3, split: float = -0.3) -> str:
    """The likeliest letters behind a token. States are the last two signs; each keeps its best path.

    A blank in the token is a gap between pieces, which may be nothing (join) or a word's end (split).
    """
    # a path is its last letter and the path before it, so that long tokens copy nothing
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last = ""
    for c in token:
        if c.isalpha():
            options = [(c, 0.0)]
        elif c == " ":
            options = [(c, split)]
        else:
            options = [(x, imitate) for x in LEET.get(c, "")] or [(c, keep)]
        silent = join if c == " " else drop if c in SEPARATORS else again if c == last else None
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for x, cost in options:
                s = sign(x)
                value = score + cost + model[a, b, s]
                if (b, s) not in new or value > new[b, s][0]:
                    new[b, s] = (value, (path, x))
            if silent is not None and path:
                value = score + silent
                if (a, b) not in new or value > new[a, b][0]:
                    new[a, b] = (value, path)
        states, last = new, last if c == " " else c
    path = max(((score + model[a, b, 0], path) for (a, b), (score, path) in states.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


class Restorer:
    """Words of a text with hidden ones restored."""

    def __init__(self, model: np.ndarray, limit: int = 400_000):
        self.model = model
        self.known = _Generations(self._restore, limit)
        self.runs = _Generations(self._spaced, limit // 4)

    def _restore(self, token: str) -> str:
        bare = token.strip(EDGE)
        bare = bare if suspicious(bare) else bare.strip("$+")
        if not suspicious(bare):
            return bare
        return decode(bare, self.model)

    def words(self, text: str | None) -> set[str]:
        """Distinct restored words, and those put together from runs of three or more pieces of one or two characters."""
        if not text:
            return set()
        tokens = text.lower().split()
        out = set(map(self.known.__getitem__, set(tokens)))
        short = np.fromiter(map(len, tokens), np.int32, len(tokens)) <= 2
        if short.any():
            edges = np.flatnonzero(np.diff(np.r_[0, short.view(np.int8), 0]))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= 3:
                    out |= self.runs[" ".join(tokens[a:b])]
        self.known.age()
        self.runs.age()
        return out

    def _spaced(self, run: str) -> frozenset[str]:
        """Words of three letters or more on the run's best path; each gap is nothing or a word's end."""
        pieces = [t.strip(EDGE) or t for t in run.split(" ")]
        found = decode(" ".join(pieces), self.model).split(" ")
        return frozenset(w for w in found if len(w) >= 3)


def features(word: str) -> list[int]:
    """64-bit hashes of the word and of its beginnings of 4 and 5 letters."""
    out = [xxhash.xxh64_intdigest("w" + word)]
    if len(word) >= 4:
        out.append(xxhash.xxh64_intdigest("p" + word[:4]))
        if len(word) >= 5:
            out.append(xxhash.xxh64_intdigest("p" + word[:5]))
    return out


@dataclass
class ToxicModel:
    characters: np.ndarray
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0

    def name(self) -> str:
        """Tells models apart."""
        return hashlib.sha256(self.characters.tobytes() + repr((self.bias, sorted(self.weights.items()))).encode()).hexdigest()

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: ToxicModel):
        self.model, self.restorer = model, Restorer(model.characters)
        get = model.weights.get
        self.weight = _Generations(lambda w: sum(get(f, 0.0) for f in features(w)), 400_000)

    def score(self, text: str | None) -> float:
        total = self.model.bias + sum(map(self.weight.__getitem__, self.restorer.words(text)))
        self.weight.age()
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


_SCORERS: dict[str, Scorer] = cache()


def _train(rows: list[np.ndarray], truth: np.ndarray, *, least: int, epochs: int, decay: float, seed: int) -> tuple[dict[int, float], float]:
    """Logistic regression with weights of zero or more, by Adam, over features that occur in `least` sampled texts or more."""
    known, counts = np.unique(np.concatenate([np.unique(r) for r in rows]), return_counts=True)
    known = known[counts >= least]
    if not len(known):
        return {}, float(np.log((truth.mean() + 1e-3) / (1 - truth.mean() + 1e-3)))
    at = []
    for r in rows:
        p = np.minimum(np.searchsorted(known, r), len(known) - 1)
        at.append(p[known[p] == r])
    w, bias = np.zeros(len(known)), -2.0
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    rng = np.random.default_rng(seed)
    step = 0
    parts = max(1, len(rows) // 128)
    for _ in range(max(epochs, 1000 // parts)):
        for part in np.array_split(rng.permutation(len(rows)), parts):
            sizes = np.array([len(at[k]) for k in part])
            flat = np.concatenate([at[k] for k in part])
            doc = np.repeat(np.arange(len(part)), sizes)
            z = bias + np.bincount(doc, w[flat], len(part))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - truth[part]) / len(part)
            g = np.r_[np.bincount(flat, d[doc], len(known)) + decay * w, d.sum()]
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            # words can only speak for toxicity: else the bulk of a long text would outweigh an insult
            w, bias = np.maximum(w - move[:-1], 0), bias - move[-1]
    strong = np.abs(w) > 0.02
    return dict(zip(known[strong].tolist(), w[strong].tolist(), strict=True)), float(bias)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_fold: int = 1, max_per_label: int = 2500, least: int = 4, lift: float = 1.5, max_features: int = 20_000, epochs: int = 25, decay: float = 1e-4, seed: int = 11) -> ToxicModel:
    """Character model of all texts; word weights from at most max_per_label texts of each label.

    Weights are never negative, so only features that occur in `least` sampled texts or more and
    `lift` times as often in toxic ones as in others can matter; these, max_features at
    most, are found by an aggregate, and only they come to the driver. Labels of the
    held-out fold are never read. With one label only, or none, there
    are no weights and scores are the share of toxic ones (0.5 if there are none).
    """
    characters = character_model(docs, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(F.col("y").isin(0, 1) & (fold("id", folds) != held_fold)).distinct()
    wanted = F.broadcast(bounded(known, "y", "id", max_per_label))  # bounded by max_per_label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(characters)
        for batch in small(batches):
            out = [np.unique(np.array([f for w in restorer.words(t) for f in features(w)], np.uint64)).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id").select("id", "y", "text").mapInArrow(run, f"id {kind}, y int, x array<long>")
    # of rows that repeat an id, the one of the smallest features
    found = materialise(found.groupBy("id", "y").agg(F.min("x").alias("x")), "toxic")
    counts = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    if not counts:
        return ToxicModel(characters)
    if len(counts) == 1:
        return ToxicModel(characters, {}, 4.0 if 1 in counts else -4.0)
    share = F.col("bad") / F.lit(counts[1]) - F.lit(lift) * (F.col("n") - F.col("bad")) / F.lit(counts[0])
    each = found.select("y", F.explode("x").alias("f")).groupBy("f").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    telling = sorted(r["f"] for r in each.filter(F.col("n") >= least).filter(share > 0).orderBy(share.desc(), "f").limit(max_features).select("f").collect())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        these = np.array(telling, np.int64)
        for batch in small(batches):
            out = [np.intersect1d(np.array(x, np.int64), these).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "y", "x"])

    got = found.mapInArrow(told, f"id {kind}, y int, x binary").collect()
    got.sort(key=lambda r: (r["id"], r["y"]))
    truth = np.array([r["y"] for r in got], np.float64)
    weights, bias = _train([np.frombuffer(r["x"], np.uint64) for r in got], truth, least=least, epochs=epochs, decay=decay, seed=seed)
    return ToxicModel(characters, weights, bias)


def judge(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score (0 to 1), predicted (1 from threshold on) for every row.

    Null and empty texts have the score of a text without words. Texts and words
    of any length are read in time that grows with their length alone. Repeated rows
    give equal results; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    key = model.name()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(_SCORERS)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = shared.value.scorer()
        scorer = _SCORERS[key]
        for batch in small(batches):
            s = np.array([scorer.score(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
