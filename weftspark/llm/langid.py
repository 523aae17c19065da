"""Language identification with a byte convolutional network, in numpy.

Bytes become symbols (letters without case, every byte beyond ASCII its own), symbols get embeddings, filters of width 2, 3 and 4 run
over windows of 256 bytes, the largest response of each filter in a window feeds
a softmax. A text's probabilities are the means over its windows, weighted by
their letters, so the whole text counts.

For prediction the filters' responses to all symbol pairs are laid
out in tables once per Python worker (7 MB), so a response is one lookup or the sum of two.
Documents are not shuffled; the trained weights (some kB) travel with the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import cache, slim, small, sole
from weftspark.llm.sampling import bounded, fold, windows

WINDOW, WIDTHS, FILTERS, EMBED, SYMBOLS = 256, (2, 3, 4), 16, 8, 157
SPACE = 26
_LETTER = regex.compile(r"\p{L}")
_TABLES: dict[str, tuple] = cache()


def _symbols() -> np.ndarray:
    """Letters 0-25, other ASCII 26-28 (blank, digit, mark), each byte from 0x80 on one of its own."""
    out = np.full(256, 28, np.uint8)
    for b in range(26):
        out[65 + b] = out[97 + b] = b
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[48:58] = 27
    out[0x80:] = 29 + np.arange(128)
    return out


SYMBOL_OF = _symbols()


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, a row each with the 3 symbols that follow (blanks behind a text); rows per text."""
    counts = np.array([-(-(len(t) + 3) // WINDOW) for t in texts], np.int64)
    rows = np.full((int(counts.sum()), WINDOW + 3), SPACE, np.uint8)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        flat = np.full(n * WINDOW, SPACE, np.uint8)
        flat[: len(t)] = SYMBOL_OF[np.frombuffer(t, np.uint8)]
        rows[at : at + n, :WINDOW] = flat.reshape(n, WINDOW)
        rows[at : at + n - 1, WINDOW:] = rows[at + 1 : at + n, :3]
        at += n
    return rows, counts


@dataclass
class ByteCNN:
    labels: list[str]
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, labels: list[str], seed: int) -> "ByteCNN":
        rng = np.random.default_rng(seed)
        params = {"embed": rng.normal(0, 1, (SYMBOLS, EMBED))}
        for w in WIDTHS:
            params[f"filter{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS))
        params["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels)))
        params["bias"] = np.zeros(len(labels))
        return cls(labels, {k: v.astype(np.float32) for k, v in params.items()})

    def train(self, pieces: list[bytes], truth: np.ndarray, *, epochs: int, batch: int, rate: float, seed: int) -> None:
        """Adam on the cross entropy of single windows."""
        rng = np.random.default_rng(seed)
        sym = np.full((len(pieces), WINDOW + 3), SPACE, np.uint8)
        for k, p in enumerate(pieces):
            p = p[:WINDOW]
            sym[k, : len(p)] = SYMBOL_OF[np.frombuffer(p, np.uint8)]
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        var = {k: np.zeros_like(v) for k, v in self.params.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pieces))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                grads = self._gradients(sym[rows], truth[rows])
                step += 1
                for k, g in grads.items():
                    mean[k] += 0.1 * (g - mean[k])
                    var[k] += 0.001 * (g * g - var[k])
                    self.params[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, sym: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, len(sym)
        pooled, places = [], []
        for w in WIDTHS:
            response = sum((p["embed"] @ p[f"filter{w}"][j])[sym[:, j : j + WINDOW]] for j in range(w))
            place = response.argmax(axis=1)
            places.append(place)
            pooled.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0])
        hidden = np.concatenate(pooled, axis=1)
        active = np.maximum(hidden, 0)
        delta = _softmax(active @ p["out"] + p["bias"])
        delta[np.arange(n), truth] -= 1
        delta /= n
        grads = {"out": active.T @ delta, "bias": delta.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = (delta @ p["out"].T) * (hidden > 0)
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads[f"filter{w}"] = np.zeros_like(p[f"filter{w}"])
            for j in range(w):
                s = sym[rows, places[k] + j]
                grads[f"filter{w}"][j] = np.einsum("bfe,bf->ef", p["embed"][s], g)
                np.add.at(grads["embed"], s, g[:, :, None] * p[f"filter{w}"][j].T[None])
        return grads

    def _tables(self) -> tuple:
        key = hashlib.sha256(b"".join(v.tobytes() for _, v in sorted(self.params.items()))).hexdigest()
        if key not in _TABLES:
            p = self.params
            one = {w: [p["embed"] @ p[f"filter{w}"][j] for j in range(w)] for w in WIDTHS}
            pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
            _TABLES.clear()
            _TABLES[key] = (pair(*one[2]), pair(one[3][0], one[3][1]), one[3][2], pair(one[4][0], one[4][1]), pair(one[4][2], one[4][3]))
        return _TABLES[key]

    def predict(self, texts: list[bytes], most: int = 1 << 17) -> np.ndarray:
        """Probabilities of each text; texts of any length, `most` bytes at a time."""
        out = np.zeros((len(texts), len(self.labels)), np.float64)
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= most):
                size += len(texts[end])
                end += 1
            rows, counts = _laid_out(texts[begin:end])
            probs, letters = [], []
            for at in range(0, len(rows), most // WINDOW):
                p, n = self._windows(rows[at : at + most // WINDOW])
                probs.append(p)
                letters.append(n)
            weight = np.concatenate(letters) + 1e-3
            total = np.concatenate(probs) * weight[:, None]
            starts = np.cumsum(counts) - counts
            out[begin:end] = np.add.reduceat(total, starts) / np.add.reduceat(weight, starts)[:, None]
            begin = end
        return out

    def _windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        two, three, last, head, tail = self._tables()
        s = rows.astype(np.int32)
        pairs = s[:, :-1] * SYMBOLS + s[:, 1:]
        first, third = pairs[:, :WINDOW], pairs[:, 2:]
        pooled = []
        for response in (lambda: two[first], lambda: three[first] + last[s[:, 2 : WINDOW + 2]], lambda: head[first] + tail[third]):
            x = response()
            while x.shape[1] > 1:
                half = x.shape[1] // 2
                x = np.maximum(x[:, :half], x[:, half:])
            pooled.append(x[:, 0])
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.params["out"] + self.params["bias"]
        kept = (rows[:, :WINDOW] < SPACE) | (rows[:, :WINDOW] > 28)
        return _softmax(logits), kept.sum(axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 5, held_fold: int = 0, max_docs_per_label: int = 1500, pieces: int = 4, epochs: int = 4, seed: int = 7) -> ByteCNN | None:
    """Trains on a bounded sample: max_docs_per_label documents of each label, `pieces` windows of each.

    Rows of the held-out fold, and rows without label or text, are not used. None
    if there is nothing to learn from.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter(F.col("label").isNotNull() & (fold("id", folds) != held_fold))
    chosen = bounded(rows, "label", "id", max_docs_per_label).filter("length(text) > 0").select("id", "label", windows("text", "id", pieces, WINDOW).alias("w")).dropDuplicates(["id", "label"])
    got = sorted(chosen.collect(), key=lambda r: (str(r["id"]), r["w"]))
    samples = [(r["label"], w.encode("utf-8", "surrogatepass")) for r in got for w in r["w"] if _LETTER.search(w)]
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    labels = sorted({label for label, _ in samples})
    # short pieces too, so that short texts are known ground
    cuts = [WINDOW, WINDOW, 120, 50]
    bytes_ = [b[: cuts[k]] for (_, b), k in zip(samples, rng.integers(0, len(cuts), len(samples)), strict=True)]
    model = ByteCNN.fresh(labels, seed)
    model.train(bytes_, np.array([labels.index(label) for label, _ in samples]), epochs=epochs, batch=64, rate=0.005, seed=seed)
    return model


def _judge(model: ByteCNN | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    raw = [t.encode("utf-8", "surrogatepass") if t and _LETTER.search(t) else b"" for t in texts]
    named, scores = ["und"] * len(texts), [0.0] * len(texts)
    there = [k for k, r in enumerate(raw) if r]
    if model is None or not there:
        return named, scores
    probs = model.predict([raw[k] for k in there])
    for k, p in zip(there, probs, strict=True):
        best = int(p.argmax())
        named[k], scores[k] = model.labels[best], float(min(1.0, max(0.0, p[best])))
    return named, scores


def identify(docs: DataFrame, model: ByteCNN | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row.

    Null texts and texts without a letter are 'und' with score 0; so is every
    text if there is no model. Very long texts are read whole, some windows at a time. Repeated rows give equal results; other columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(_TABLES)
        for batch in small(batches):
            named, scores = _judge(model, batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: ByteCNN | None, *, text_col: str = "text", min_score: float = 0.4) -> DataFrame:
    """docs without the rows whose language is 'und' or scored under min_score; same columns, whatever they are called.

    Null and empty texts and those without a letter go; without a model all do. Repeated rows are judged alike.
    """
    place = slim(docs).schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(_TABLES)
        for batch in small(batches):
            named, scores = _judge(model, batch.column(place).to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= min_score for n, s in zip(named, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
