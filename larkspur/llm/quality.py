"""Quality: a regularised quadratic discriminant over transformed statistics of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import pieces_of, slices, sums, words_of
from larkspur.sources.tables import discard, materialise

#: Statistics of a document in the order of its vector; a share is of words unless its name says otherwise.
FEATURES = (
    "words", "letters a word", "capitals of letters", "digits of characters", "sentence marks", "symbols", "words without a letter",
    "short words", "words that end in ! or ?", "capitalised words", "distinct words", "distinct pairs of words", "most frequent word", "distinct lines", "words a line",
)
#: Statistics are held as integers in steps of 1 / STEP, so that their sums do not depend on partitions.
STEP = 1_024
_STATISTICS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("aside", pa.bool_()), ("x", pa.list_(pa.int32()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def held_out(id_col: str = "doc_id") -> Column:
    """Fold of a row: crc32 of its id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_counts(words: pa.Array) -> np.ndarray:
    """Of each word: characters, letters, capitals, digits, sentence marks, symbols, no letter, short, ends in ! or ?, begins with a capital."""
    chars = np.asarray(pc.utf8_length(words))
    letters, capitals, digits, marks = (np.asarray(pc.count_substring_regex(words, p)) for p in (r"\pL", r"\p{Lu}", r"\p{Nd}", r"""[.,;:!?'"()\-]"""))
    loud, big = (np.asarray(pc.match_substring_regex(words, p), dtype=bool) for p in (r"[!?]$", r"^\p{Lu}"))
    return np.stack([chars, letters, capitals, digits, marks, chars - letters - digits - marks, (chars > 0) & (letters == 0), (letters > 0) & (letters <= 3), loud, big], axis=1).astype(np.int64)


def shares(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of a share with half a count beside either side: spreads shares near 0 and 1, and tells few counts from many."""
    return np.log((part + 0.5) / (whole - part + 0.5))


def distinct(number: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers of each text, how often its most frequent one is there)."""
    if not len(number):
        return np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    keys, count = np.unique(owner * (int(number.max()) + 1) + number, return_counts=True)
    of = keys // (int(number.max()) + 1)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, of, count)
    return np.bincount(of, minlength=texts), most


def statistics(texts: pa.Array) -> np.ndarray:
    """(text, FEATURES) of whole texts, in steps of 1 / STEP; null counts as empty."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    number, bounds, words = words_of(texts)
    counts = word_counts(words)[number]
    there = counts[:, 0] > 0  # an empty piece stands where a text begins or ends in white space
    owner = np.repeat(np.arange(n), np.diff(bounds))
    chars, letters, capitals, digits, marks, symbols, bare, short, loud, big = sums(counts, bounds).T
    number, owner = number[there], owner[there]
    total = np.bincount(owner, minlength=n)
    kinds, most = distinct(number, owner, n)
    together = owner[1:] == owner[:-1]
    pair = np.unique((number[:-1] * np.int64(len(words) + 1) + number[1:])[together], return_inverse=True)[1]
    pairs, _ = distinct(pair, owner[1:][together], n)
    line, edges, lines = pieces_of(pc.split_pattern(texts, "\n"))
    full = np.asarray(pc.not_equal(pc.utf8_trim_whitespace(lines), ""), dtype=bool)[line] if len(lines) else np.zeros(0, bool)
    line_owner = np.repeat(np.arange(n), np.diff(edges))
    line_kinds, _ = distinct(line[full], line_owner[full], n)
    line_total = np.bincount(line_owner[full], minlength=n)
    columns = [
        np.log1p(total), np.log((letters + 1) / (total + 1)), shares(capitals, letters), shares(digits, chars), np.log((marks + 0.5) / (total + 1)), np.log((symbols + 0.5) / (total + 1)),
        shares(bare, total), shares(short, total), shares(loud, total), shares(big, total), shares(kinds, total),
        shares(pairs, np.maximum(total - 1, 0)), shares(most, total), shares(line_kinds, line_total), np.log((total + 1) / (line_total + 1)),
    ]
    return np.rint(STEP * np.stack(columns, axis=1)).astype(np.int32)


@dataclass
class Discriminant:
    """Two Gaussians over the statistics, class 0 and class 1, and the line from their log-density difference to a logit."""

    means: np.ndarray
    covariances: np.ndarray
    prior: float
    line: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None
    shrinkage: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, count: np.ndarray, first: np.ndarray, second: np.ndarray, floor: float = 0.02) -> Discriminant:
        """From each class's rows, sums, and sums of products.

        Statistics are brought to the scale of their pooled deviation; each class's covariance is shrunk there towards a multiple
        of the identity, by the oracle-approximating share for its rows and ``floor`` at least, so one that never
        varies in a class keeps some width.
        """
        means = first / count[:, None]
        scatter = second / count[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.tensordot(count / count.sum(), scatter, 1)
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        p, shares, covariances = means.shape[1], [], []
        for n, own in zip(count, scatter, strict=True):
            s = own / np.outer(scale, scale)
            trace, square = np.trace(s), (s * s).sum()
            down = (n + 1 - 2 / p) * (square - trace**2 / p)
            share = 1.0 if down <= 0 else min(1.0, ((1 - 2 / p) * square + trace**2) / down)
            share = max(share, floor)
            shrunk = (1 - share) * s + share * max(trace / p, 1e-3) * np.eye(p)
            covariances.append(shrunk * np.outer(scale, scale))
            shares.append(float(share))
        return cls(means, np.stack(covariances), float(np.log(count[1] / count[0])), shrinkage=shares)

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        """Of each class the inverse of the covariance's Cholesky factor, and half its log determinant; made once a process."""
        lower = [np.linalg.cholesky(c) for c in self.covariances]
        return [(np.linalg.inv(f), float(np.log(np.diag(f)).sum())) for f in lower]

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0 with the classes' prior odds, on a scale that is logarithmic far out."""
        far = []
        for mean, (inverse, half) in zip(self.means, self.factors, strict=True):
            left = (x - mean).T
            # Component by component: a row's value does not depend on the batch it is in, as it would with a matrix product.
            far.append(sum(0.5 * sum(inverse[i, j] * left[j] for j in range(i + 1)) ** 2 for i in range(len(mean))) + half)
        return np.arcsinh(far[0] - far[1] + self.prior)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        a, b = self.line
        return 1 / (1 + np.exp(-np.clip(a * self.differences(x) + b, -30, 30)))

    def calibrate(self, at: np.ndarray, bad: np.ndarray, good: np.ndarray) -> None:
        """Platt's line by Newton steps over counts of both classes at each difference, with one row of each far out."""
        at, bad, good = np.append(at, [-12.0, 12.0]), np.append(bad, [1.0, 0.0]), np.append(good, [0.0, 1.0])
        a, b, n = 1.0, 0.0, bad + good
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * at + b, -30, 30)))
            s = n * p * (1 - p)
            gradient = np.array([((n * p - good) * at).sum(), (n * p - good).sum()])
            curve = np.array([[(s * at * at).sum() + 1e-3, (s * at).sum()], [(s * at).sum(), s.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(curve, gradient), -1, 1)
        self.line = (float(max(a, 0.05)), float(b))


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, aside and the statistics ``x`` of every whole text; ``aside`` marks a fifth of the ids, by hash, to calibrate on."""
    aside = F.coalesce(F.pmod(F.xxhash64(F.lit("aside"), F.col(id_col).cast("long")), F.lit(5)) == 0, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=2_000_000):
            x = statistics(batch.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("aside"), rows], schema=_STATISTICS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), aside.alias("aside"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, aside boolean, x array<int>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), dtype=np.int64).reshape(-1, len(FEATURES))


def train(known: DataFrame, labels: DataFrame, *, label_col: str = "quality") -> Discriminant:
    """Fit on every labelled row of :func:`document_statistics` that is not held out.

    Nothing is sampled: each partition gives its class's row count and integer sums of statistics and their products,
    and what comes to the driver is some hundred numbers. Four fifths of the rows give the Gaussians, one fifth the
    calibration, as counts by difference in steps of 0.01. A row of ``labels`` with a null id or label teaches nothing, an id
    labelled both ways counts as 0; other columns are ignored. Without labelled rows of both classes all
    scores are the smoothed share of class 1.
    """
    p = len(FEATURES)
    upper = np.triu_indices(p)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))
    marks = materialise(marks)
    taught = materialise(known.where("not held_out and doc_id is not null").join(marks, "doc_id").select("aside", "good", "x"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + len(upper[0])), np.int64)
        for batch in batches:
            x, good = _matrix(batch), np.asarray(batch.column("good"))
            for c in (0, 1):
                own = x[good == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.int64()))], names=["good", "sums"])

    def summed(rows: DataFrame) -> np.ndarray:
        told = rows.select("good", "x").mapInArrow(totals, "good int, sums array<long>").select("good", F.posexplode("sums").alias("at", "s"))
        out = np.zeros((2, 1 + p + len(upper[0])))
        for r in told.groupBy("good", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            out[r["good"], r["at"]] = float(r["s"])
        return out

    total = summed(taught.where("not aside"))
    if (total[:, 0] < 2).any():
        n = total[:, 0] + summed(taught.where("aside"))[:, 0]
        return Discriminant(np.zeros((2, p)), np.stack([np.eye(p)] * 2), 0.0, constant=float((n[1] + 1) / (n.sum() + 2)))
    second = np.zeros((2, p, p))
    second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = total[:, 1 + p :]
    model = Discriminant.fit(total[:, 0], total[:, 1 : 1 + p] / STEP, second / STEP**2)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.rint(100 * model.differences(_matrix(batch) / STEP)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("good")], names=["at", "good"])

    # arcsinh of a double stays within 750 either way, so there are at most 150,000 steps.
    steps = taught.where("aside").select("good", "x").mapInArrow(placed, "at int, good int").groupBy("at").agg(F.count_if(F.col("good") == 0).alias("bad"), F.count_if(F.col("good") == 1).alias("good")).orderBy("at").collect()
    if steps:
        at, bad, good = np.array([tuple(r) for r in steps], dtype=np.float64).T
        model.calibrate(at / 100, bad, good)
    discard(taught)
    discard(marks)
    return model


def score_quality(known: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher where class 1 is likelier) of every row of :func:`document_statistics`."""
    shared = known.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(_matrix(batch) / STEP))], schema=_SCORES)

    return known.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id long, held_out boolean, score double")


def judge_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labelled rows not held out and score every whole text: doc_id, held_out, score.

    The text alone is read for a score. A null or empty text has the statistics of no words. Null and repeated ids
    stay row by row; other columns are ignored; an empty table gives no rows. Texts are read once: their
    statistics, a few numbers a document, are written and both learnt from and scored.
    """
    known = materialise(document_statistics(docs, id_col=id_col, text_col=text_col))
    return score_quality(known, train(known, labels, label_col=label_col))
