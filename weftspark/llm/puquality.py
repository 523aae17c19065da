"""Quality classifier by positive-unlabelled learning (non-negative unbiased risk).

Trusted positives are labelled rows of quality 1; the unlabelled side is web text
whose labels are not looked at; rows labelled 0 are never used. The class prior comes from these two sides alone: where
a scorer's top holds positives only, the share of the unlabelled there over that of the positives is the prior.
A small network over text statistics and hashed words
minimises  prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]).

Documents are not shuffled for scoring: each text is reduced to a fixed number of
features in one pass, in bounded blocks of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import slim, small, sole
from weftspark.llm.sampling import bounded, fold

SYMBOL_BYTES = b"#*$%&|<>!{}[]@_=~^\\/"
STATISTICS, WORDS = 24, 16
FEATURES = STATISTICS + WORDS


def statistics(text: str | None) -> list[float]:
    """FEATURES numbers that describe the whole text; all zero but the first for a text without words.

    Behind the statistics stand the distinct words, hashed with signs to WORDS places.
    """
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (FEATURES - 1)  # no word
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    symbols = int(count[list(SYMBOL_BYTES)].sum())
    distinct = len(set(words))
    seen = Counter(words)
    top = seen.most_common(1)[0][1]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_kinds = len(set(lines))
    runs = sum(a == b for a, b in zip(words, words[1:]))
    threes = len(set(zip(words, words[1:], words[2:])))
    lengths = np.fromiter(map(len, words), np.int32, n)
    code = (np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, distinct) % np.uint64(2 * WORDS)).astype(np.int64)
    hashed = np.bincount(code >> 1, 2.0 * (code & 1) - 1, WORDS) / distinct**0.5
    return [
        0.0,
        np.log1p(n) / 10,
        min(n, 40) / 40,
        float(lengths.mean()) / 10,
        float((lengths == 1).mean()),
        float((lengths > 20).mean()),
        distinct / n,
        distinct / n**0.8,
        top / n,
        runs / n,
        threes / max(1, n - 2),
        len(lines) / n,
        1 - line_kinds / max(1, len(lines)),
        symbols / size,
        min(1.0, symbols / n),
        int(count[33]) / n,
        int(count[124]) / n,
        int(count[35] + count[42] + count[36] + count[37] + count[38]) / n,
        upper / max(1, upper + lower),
        int(count[48:58].sum()) / size,
        min(2.0, 10 * int(count[46]) / n),
        min(2.0, 10 * int(count[44]) / n),
        int(count[128:].sum()) / size,
        float(max(map(len, lines))) / size,
        *hashed.tolist(),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, FEATURES)


@dataclass
class PUModel:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2, -30, 30)))


def _loss_gradients(p: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float | None) -> tuple[float, float, list[np.ndarray]]:
    """Positive and negative risk of the logistic loss, and the gradients of the step to take.

    Where the negative risk is under 0, that is of the negative risk turned round. Without a
    prior, the unlabelled side counts as negative: a plain scorer of positives against unlabelled.
    """
    x = np.concatenate([xp, xu])
    h = np.tanh(x @ p[0] + p[1])
    g = h @ p[2] + p[3]
    s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    k, n = len(xp), len(xu)
    share, less = (1.0, 0.0) if prior is None else (prior, prior)
    # l(+) = log(1 + e^-g), l(-) = log(1 + e^g)
    positive = share * float(np.logaddexp(0, -g[:k]).mean())
    negative = float(np.logaddexp(0, g[k:]).mean() - less * np.logaddexp(0, g[:k]).mean())
    d_neg = np.concatenate([-less * s[:k] / k, s[k:] / n])
    d_pos = np.concatenate([share * (s[:k] - 1) / k, np.zeros(n)])
    d = d_pos + d_neg if negative >= 0 else -d_neg
    dh = np.outer(d, p[2]) * (1 - h * h)
    return positive, negative, [x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(keepdims=True)]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, *, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> PUModel:
    """nnPU with the logistic loss; Adam; where the negative risk falls below 0 its gradient is turned round."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    scale[STATISTICS:] *= 2  # words of short texts are noisy
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p = [rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    step = 0
    for _ in range(epochs):
        ou, op = rng.permutation(len(xu)), rng.permutation(len(xp))
        n = max(1, -(-len(ou) // batch))
        for bu, bp in zip(np.array_split(ou, n), np.array_split(np.resize(op, max(len(op), n)), n), strict=True):
            _, _, grads = _loss_gradients(p, xp[bp], xu[bu], prior)
            grads[0] += decay * p[0]
            grads[2] += decay * p[2]
            step += 1
            for i, gi in enumerate(grads):
                m[i] += 0.1 * (gi - m[i])
                v[i] += 0.001 * (gi * gi - v[i])
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return PUModel(prior if prior is not None else 0.5, mean, scale, *p)


def committee(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, members: int = 3, seed: int = 5) -> PUModel:
    """Networks of several seeds as one: their logits' mean, which chance sways less than each of them."""
    all_ = [train(positive, unlabelled, prior, seed=seed + k) for k in range(members)]
    return PUModel(prior, all_[0].mean, all_[0].scale, np.hstack([m.w1 for m in all_]), np.concatenate([m.b1 for m in all_]), np.concatenate([m.w2 for m in all_]) / members, sum(m.b2 for m in all_) / members)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, *, epochs: int = 15, seed: int = 5) -> float:
    """Share of positives among the unlabelled, from features of both sides alone; kept off 0 and 1.

    A scorer learns from one half of each side. On the other half, for every threshold, the share of the
    unlabelled above it over that of the positives is the prior or more, and equals it where no negative
    stands above. The threshold taken has the least upper confidence bound of that ratio.
    """
    half = lambda x: (x[::2], x[1::2] if len(x) > 1 else x)
    (p1, p2), (u1, u2) = half(positive), half(unlabelled)
    scorer = train(p1, u1, None, epochs=epochs, seed=seed)
    sp, su = np.sort(scorer.score(p2)), np.sort(scorer.score(u2))
    at = np.unique(sp)
    above_p = 1 - np.searchsorted(sp, at) / len(sp)
    above_u = 1 - np.searchsorted(su, at) / len(su)
    doubt = np.sqrt(np.log(40) / (2 * len(su))) + np.sqrt(np.log(40) / (2 * len(sp)))
    best = np.argmin((above_u + doubt) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, max_positive: int = 4000, max_unlabelled: int = 8000, seed: int = 5) -> PUModel | None:
    """Fits on a bounded sample: max_positive trusted rows and max_unlabelled rows of any text.

    The texts of the sample become statistics on the executors; only those come
    to the driver. Labels of the held-out fold and labels of 0 are never read. None if there are
    no positives or no texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(fold("id", folds) != held_fold)
    trusted = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter((F.col("y") == 1) & (fold("id", folds) != held_fold))
    positive = bounded(trusted, "y", "id", max_positive).select("id").distinct()
    unlabelled = bounded(rows.select("id").withColumn("kind", F.lit(1)), "kind", "id", max_unlabelled).select("id").distinct()
    # two lists of ids with a fixed bound, so they may be broadcast
    wanted = F.broadcast(positive.withColumn("positive", F.lit(1)).unionByName(unlabelled.withColumn("positive", F.lit(0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(matrix(batch.column(2).to_pylist()).tolist(), pa.list_(pa.float64()))], names=["id", "positive", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.join(wanted, "id").select("id", "positive", "text").mapInArrow(run, f"id {kind}, positive int, x array<double>").dropDuplicates(["id", "positive"]).collect()
    got.sort(key=lambda r: (r["positive"], r["id"], r["x"]))
    xp = np.array([r["x"] for r in got if r["positive"]]).reshape(-1, FEATURES)
    xu = np.array([r["x"] for r in got if not r["positive"]]).reshape(-1, FEATURES)
    if not len(xp) or not len(xu):
        return None
    return committee(xp, xu, estimate_prior(xp, xu, seed=seed), seed=seed)


def _scores(model: PUModel | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return model.score(matrix(texts))


def judge(docs: DataFrame, model: PUModel | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score (probability of good quality), predicted (1 from threshold on) for every row.

    Null, empty and blank texts are scored by the statistics of a text without
    words, very long ones by those of the whole text. Without a model every score is 0.5. Repeated rows give equal results;
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        for batch in small(batches):
            s = _scores(model, batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: PUModel | None, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows scored under threshold; same columns, whatever they are called.

    Nulls, empty and long texts are scored as in judge(); copies stay or go
    together; without a model, and of an empty table, all rows stay.
    """
    place = slim(docs).schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        for batch in small(batches):
            yield batch.filter(pa.array(_scores(model, batch.column(place).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
