"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import hashed_sample, held_out, slices, words_of

SCHEMA = "doc_id long, held_out boolean, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
WIDTHS = (1, 2, 3)


def word_features(word: str, buckets: int) -> tuple[int, int]:
    """Buckets of a lower-case word without its outer punctuation: the word, and its first five letters."""
    core = word.lower().strip(".,;:!?\"'()[]")
    return crc32(core.encode("utf-8", "surrogatepass")) % buckets, crc32(b"<" + core[:5].encode("utf-8", "surrogatepass")) % buckets


@dataclass
class TextCNN:
    """Word embeddings (sums of hashed buckets), filters of several widths, max pooling, a logistic layer."""

    buckets: int = 1 << 16
    size: int = 16
    filters: int = 12
    seed: int = 7
    platt: tuple[float, float] = (1.0, 0.0)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        w = self.weights
        w["E"] = rng.normal(0, 0.02, (self.buckets, self.size)).astype(np.float32)
        for k in WIDTHS:
            w[f"F{k}"] = rng.normal(0, 0.5 / np.sqrt(k * self.size), (k * self.size, self.filters)).astype(np.float32)
            w[f"b{k}"] = np.zeros(self.filters, np.float32)
        w["V"] = rng.normal(0, 0.3, len(WIDTHS) * self.filters).astype(np.float32)
        w["c"] = np.full(1, -1.0, np.float32)

    def positions(self, number: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers with a gap (-1) of the widest filter behind each text, and where each text begins."""
        gap = max(WIDTHS)
        sizes = np.diff(bounds)
        begins = bounds[:-1] + gap * np.arange(len(sizes))
        out = np.full(int(bounds[-1]) + gap * len(sizes), -1, dtype=np.int64)
        out[np.arange(int(bounds[-1])) + np.repeat(gap * np.arange(len(sizes)), sizes)] = number
        return out, begins

    def pooled(self, vectors: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per text the greatest response of each filter. A text without words has one position, the gap."""
        edges = np.stack([begins, begins + np.maximum(sizes, 1)], axis=1).ravel()
        tops, responses = [], []
        padded = np.concatenate([vectors, np.zeros((max(WIDTHS), self.size), np.float32)])
        for k in WIDTHS:
            filters = self.weights[f"F{k}"]
            response = sum(padded[j : j + len(vectors)] @ filters[j * self.size : (j + 1) * self.size] for j in range(k))
            tops.append(np.maximum.reduceat(response, edges[:-1] if edges[-1] == len(vectors) else edges, axis=0)[::2])
            responses.append(response)
        return np.concatenate(tops, axis=1), responses

    def logits(self, texts: pa.Array) -> np.ndarray:
        """One value per text; the positions of only a part of the texts are held at a time."""
        parts = slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), chars=2_000_000)
        return np.concatenate([np.zeros(0), *(self._logits(part.column("text")) for part in parts)])

    def _logits(self, texts: pa.Array) -> np.ndarray:
        number, bounds, words = words_of(texts)
        table = self.weights["E"][np.array([word_features(w, self.buckets) for w in words.to_pylist()]).reshape(-1, 2)].sum(axis=1)
        table = np.concatenate([table, np.zeros((1, self.size), np.float32)])
        at, begins = self.positions(number, bounds)
        top, _ = self.pooled(table[at], begins, np.diff(bounds))
        hidden = np.maximum(top + np.concatenate([self.weights[f"b{k}"] for k in WIDTHS]), 0)
        return (hidden @ self.weights["V"] + self.weights["c"][0]).astype(np.float64)

    def scores(self, texts: pa.Array) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts) + b, -30, 30)))

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01) -> None:
        """Adam on the filters, Adagrad on the touched embeddings; gradients pass where a filter's greatest response is."""
        w = self.weights
        rng = np.random.default_rng(self.seed)
        number, bounds, words = words_of(pa.array(texts, pa.string()))
        buckets = np.array([word_features(x, self.buckets) for x in words.to_pylist()]).reshape(-1, 2)
        squares = np.full(self.buckets, 1e-8, np.float32)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items() if k != "E"}
        step, f, d = 0, self.filters, self.size
        balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for k0 in range(0, len(order), batch):
                rows = order[k0 : k0 + batch]
                sizes = bounds[rows + 1] - bounds[rows]
                own = np.concatenate([number[bounds[r] : bounds[r + 1]] for r in rows])
                at, begins = self.positions(own, np.concatenate([[0], np.cumsum(sizes)]))
                vectors = w["E"][buckets[at, 0]] + w["E"][buckets[at, 1]]
                vectors[at < 0] = 0
                top, responses = self.pooled(vectors, begins, sizes)
                hidden = np.maximum(top + np.concatenate([w[f"b{k}"] for k in WIDTHS]), 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ w["V"] + w["c"][0], -30, 30)))
                slope = ((p - labels[rows]) * balance[rows] / len(rows)).astype(np.float32)
                grads = {"V": hidden.T @ slope, "c": slope.sum(keepdims=True)}
                back = np.outer(slope, w["V"]) * (hidden > 0)
                touched, pulls = [], []
                for i, k in enumerate(WIDTHS):
                    g = back[:, i * f : (i + 1) * f]
                    grads[f"b{k}"] = g.sum(axis=0)
                    grad = np.zeros_like(w[f"F{k}"])
                    where = np.empty((len(rows), f), np.int64)
                    for r in range(len(rows)):
                        where[r] = begins[r] + responses[i][begins[r] : begins[r] + max(1, sizes[r])].argmax(axis=0)
                    for j in range(k):
                        place = np.minimum(where + j, len(vectors) - 1).ravel()
                        pull = g.ravel()[:, None]
                        grad[j * d : (j + 1) * d] = np.einsum("nfd,nf->df", vectors[place].reshape(len(rows), f, d), g)
                        active = (g.ravel() != 0) & (at[place] >= 0)
                        filters = np.broadcast_to(w[f"F{k}"][j * d : (j + 1) * d].T, (len(rows), f, d)).reshape(-1, d)
                        touched.append(at[place][active])
                        pulls.append((pull * filters)[active])
                    grads[f"F{k}"] = grad
                step += 1
                for name, grad in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    w[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                word, pull = np.concatenate(touched), np.concatenate(pulls)
                for half in (0, 1):
                    b, inverse = np.unique(buckets[word, half], return_inverse=True)
                    total = np.zeros((len(b), d), np.float32)
                    np.add.at(total, inverse, pull)
                    squares[b] += (total * total).mean(axis=1)
                    w["E"][b] -= 0.1 * total / np.sqrt(squares[b])[:, None]

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """Platt scaling by Newton steps, with a prior of one success and one failure far out on either side."""
        x = np.concatenate([logits, [-20.0, 20.0]])
        y = np.concatenate([labels, [0.0, 1.0]])
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            s = p * (1 - p) + 1e-6
            gradient = np.array([((p - y) * x).sum(), (p - y).sum()])
            curve = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(curve, gradient), -1, 1)
        self.platt = (max(a, 0.05), b)


@dataclass
class Toxicity:
    """A fitted classifier and, by language, the score from which a document is rejected."""

    network: TextCNN
    thresholds: dict[str | None, float]
    default: float = 0.7


def train(docs: DataFrame, labels: DataFrame, *, per_label: int = 1_200, longest: int = 200_000, precision: float = 0.98, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Toxicity:
    """Fit on about ``per_label`` rows of each label, drawn by hash from labelled rows not held out.

    Ids are drawn from the labels alone; only the texts of the drawn ids (a bounded number) come
    to the driver, one for each id, and none longer than ``longest`` characters. An id labelled both
    ways counts as toxic. A fifth of the sample calibrates: Platt scaling over all, and by language the least score
    that keeps ``precision`` there (0.7 where a language has too few rows). Without labelled rows of
    both kinds every score is low.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    drawn = hashed_sample(marks, "toxic", per_label, F.concat(F.lit("toxic "), F.col("doc_id").cast("string")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # The drawn ids are bounded by 2 x per_label and some hash variance; an id may still be on any number of rows.
    rows = rows.join(F.broadcast(drawn), "doc_id").where(F.length("text") <= longest)
    one = F.min_by(F.struct("text", "lang", "toxic"), F.struct(F.xxhash64("text"), "lang")).alias("one")
    sample = rows.groupBy("doc_id").agg(one).select("doc_id", "one.*").collect()
    sample.sort(key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    network = TextCNN()
    texts, marks = [r.text for r in sample], np.array([r.toxic for r in sample], dtype=np.float64)
    if len(set(marks.tolist())) < 2:
        network.platt = (0.0, -3.0)
        return Toxicity(network, {})
    aside = np.arange(len(texts)) % 5 == 0 if len(texts) >= 50 else np.zeros(len(texts), bool)
    network.fit([t for t, a in zip(texts, aside, strict=True) if not a], marks[~aside])
    if aside.any() and len(set(marks[aside].tolist())) == 2:
        network.calibrate(network.logits(pa.array([t for t, a in zip(texts, aside, strict=True) if a], pa.string())), marks[aside])
    thresholds = {}
    scores = network.scores(pa.array([t for t, a in zip(texts, aside, strict=True) if a], pa.string()))
    langs, known = np.array([r.lang for r, a in zip(sample, aside, strict=True) if a], dtype=object), marks[aside]
    for lang in {x for x in langs.tolist() if x is not None}:
        own = langs == lang
        if own.sum() >= 20 and 0 < known[own].sum() < own.sum():
            thresholds[lang] = best_threshold(scores[own], known[own], precision)
    return Toxicity(network, thresholds)


def best_threshold(scores: np.ndarray, marks: np.ndarray, precision: float) -> float:
    """The least score, 0.5 to 0.9, from which on at least ``precision`` of the rows are toxic."""
    for t in np.arange(0.5, 0.9, 0.02):
        found = scores >= t
        if found.any() and marks[found].mean() >= precision:
            return float(t)
    return 0.9


def score_toxicity(docs: DataFrame, model: Toxicity, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, held_out, score in 0..1.

    The text alone is read. A null or empty text has the score of no words. Null and repeated
    ids stay row by row; other columns are ignored; an empty table gives no rows. The network
    (fixed size) travels with the tasks; each distinct word of a batch is embedded once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in slices(batches, chars=2_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(network.scores(batch.column("text")))], schema=_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def clean_documents(docs: DataFrame, model: Toxicity, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose score is below the threshold of their language; all columns and repeats stay."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text_col, chars=2_000_000):
            limits = np.array([model.thresholds.get(x, model.default) for x in batch.column(lang_col).to_pylist()])
            keep = model.network.scores(batch.column(text_col)) < limits
            yield batch.filter(pc.fill_null(pa.array(keep), True))

    return docs.mapInArrow(run, docs.schema).select(*names)
