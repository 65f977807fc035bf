"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import hashed_sample, held_out, slices, sums, words_of

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])
UNDETERMINED = "und"
#: Characters that an unseen one is taken to be any of.
ALPHABET = 20_000


def letter_runs(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, place in its word and piece of each character of all words of all pieces.

    A word is a run of letters, lower case, between two boundaries (code 0).
    """
    lower = [p.lower() for p in pieces]
    chars = np.frombuffer(" ".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, inverse = np.unique(chars, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], dtype=bool)[inverse]
    before = np.concatenate([[False], letter[:-1]])
    run = np.cumsum(letter & ~before)
    begins = np.flatnonzero(letter & ~before)
    lengths = np.bincount(run[letter], minlength=len(begins) + 1)[1:] + 2
    ends = np.cumsum(lengths)
    codes = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    codes[np.arange(int(letter.sum())) + 2 * run[letter] - 1] = chars[letter]
    places = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    piece = np.repeat(np.arange(len(lower)), [len(p) + 1 for p in lower])
    return codes, places, np.repeat(piece[begins], lengths)


def gram_hashes(codes: np.ndarray, places: np.ndarray, order: int) -> list[np.ndarray]:
    """Per length 1..order the hash of the characters ending at each place; 0 where the word has fewer."""
    out = [_mixed(codes + np.uint64(1))]
    for n in range(2, order + 1):
        before = np.concatenate([[np.uint64(0)], out[-1][:-1]])
        now = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(n))
        now[places < n - 1] = 0
        out.append(now)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31)) | np.uint64(1)


#: Numbers (n-grams x languages, or characters x languages) that are held at once as a whole array.
CELLS = 4_000_000


@dataclass
class Grams:
    """All n-grams of one length: sorted hashes; of row r the entries ``ptr[r]`` to ``ptr[r + 1]``, one for each language that has it.

    An entry is the language, the discounted probability (NaN: unseen) and the weight left to shorter ones. So memory grows with
    the n-grams of all languages, not with n-grams times languages; where that product is small the same is held as a whole array.
    """

    keys: np.ndarray
    ptr: np.ndarray
    lang: np.ndarray
    probability: np.ndarray
    backoff: np.ndarray
    width: int
    whole: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cells: int) -> Grams:
        """From each language's hashes, probabilities and weights."""
        sizes = [len(e[0]) for e in entries]
        lang = np.repeat(np.arange(len(entries), dtype=np.int32), sizes)
        key, probability, backoff = (np.concatenate([np.zeros(0, t), *(e[j] for e in entries)]) for j, t in enumerate((np.uint64, np.float64, np.float64)))
        order = np.argsort(key, kind="stable")
        keys, begins = np.unique(key[order], return_index=True)
        out = cls(keys, np.append(begins, len(key)), lang[order], probability[order], backoff[order], len(entries))
        if (len(keys) + 1) * len(entries) <= cells:
            out.whole = out.spread(np.arange(len(keys) + 1))
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the hashes; the row behind the last for those not there."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def spread(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, language): probabilities, NaN where unseen, and weights, 1 where there is none, of rows as :meth:`find` gives them."""
        if self.whole is not None:
            return self.whole[0][rows], self.whole[1][rows]
        ends = np.append(self.ptr, self.ptr[-1])
        sizes = ends[rows + 1] - ends[rows]
        after = np.cumsum(sizes)
        entry = np.repeat(ends[rows] - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)
        at = np.repeat(np.arange(len(rows)), sizes), self.lang[entry]
        probability, backoff = np.full((len(rows), self.width), np.nan), np.ones((len(rows), self.width))
        probability[at], backoff[at] = self.probability[entry], self.backoff[entry]
        return probability, backoff


def _model(texts: list[str], order: int) -> list[dict[str, np.ndarray]]:
    """One language: by length the n-gram hashes, probabilities and back-off weights."""
    pieces = [p for t in texts for p in t.split()]
    codes, places, _ = letter_runs(pieces)
    hashes = gram_hashes(codes, places, order)
    counts: list[tuple] = []
    for n in range(order, 0, -1):
        # A longest n-gram, or one at a word's start, counts as often as it occurs; others by what stands before them.
        context = np.concatenate([[np.uint64(0)], hashes[n - 2][:-1]]) if n > 1 else np.ones(len(codes), dtype=np.uint64)
        ok = (places >= max(1, n - 1)) if n > 1 else places >= 1
        own, ctx = hashes[n - 1][ok], context[ok]
        if n < order:
            at_start = places[ok] == n - 1
            longer = hashes[n][ok]
            _, first = np.unique(np.where(at_start, np.arange(len(own), dtype=np.uint64) << np.uint64(1), longer), return_index=True)
            own, ctx = own[first], ctx[first]
        keys, at, number = np.unique(own, return_index=True, return_counts=True)
        counts.append((keys, ctx[at], number))
    counts.reverse()
    out = []
    for keys, ctx, number in counts:
        ones, twos = (number == 1).sum(), (number == 2).sum()
        discount = float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))
        contexts, inverse = np.unique(ctx, return_inverse=True)
        total = np.bincount(inverse, weights=number, minlength=len(contexts))
        left = discount * np.bincount(inverse, minlength=len(contexts)) / np.maximum(total, 1)
        out.append({"keys": keys, "ctx": ctx, "seen": np.maximum(number - discount, 0) / total[inverse] if len(keys) else np.zeros(0), "contexts": contexts, "left": left})
    return out


class LanguageModels:
    """The models of all languages in shared sorted arrays."""

    def __init__(self, texts: dict[str, list[str]], order: int = 5, cells: int = CELLS) -> None:
        self.languages, self.order, self.cells = sorted(texts), order, cells
        models = [_model(texts[x], order) for x in self.languages]
        self.floor = np.array([(m[0]["left"][0] if len(m[0]["left"]) else 1.0) / ALPHABET for m in models])
        self.grams = []
        for n in range(order):
            entries = []
            for k, m in enumerate(models):
                contexts = m[n + 1]["contexts"] if n + 1 < order else np.zeros(0, np.uint64)
                keys = np.union1d(m[n]["keys"], contexts)
                keys = keys[keys != 0]
                probability, backoff = np.full(len(keys), np.nan), np.ones(len(keys))
                probability[np.searchsorted(keys, m[n]["keys"])] = m[n]["seen"] + (self.floor[k] if n == 0 else 0.0)
                if n + 1 < order:
                    backoff[np.searchsorted(keys, contexts)] = m[n + 1]["left"]
                entries.append((keys, probability, backoff))
            self.grams.append(Grams.of(entries, cells))
        self.ceiling = np.full(len(models), np.inf)

    def blocks(self, codes: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first character, log probabilities by character and language, given up to order - 1 characters before it), part by part."""
        hashes = gram_hashes(codes, places, self.order)
        found = [g.find(h) for g, h in zip(self.grams, hashes, strict=True)]
        step = max(1_000, self.cells // max(1, len(self.languages)))
        for begin in range(0, len(codes), step):
            part = slice(begin, begin + step)
            p, _ = self.grams[0].spread(found[0][part])
            p = np.where(np.isnan(p), self.floor, p)
            for n in range(1, self.order):
                before = np.concatenate([[len(self.grams[n - 1].keys)], found[n - 1][:-1]])[part]
                seen, weight = self.grams[n].spread(found[n][part])[0], self.grams[n - 1].spread(before)[1]
                p = np.where((places[part] >= n)[:, None], np.where(np.isnan(seen), 0.0, seen) + weight * p, p)
            yield begin, np.log(p)

    def log_probabilities(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((0, len(self.languages))), *(p for _, p in self.blocks(codes, places))])

    def score_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By piece the sum of log probabilities by language, and the number of characters predicted."""
        codes, places, owners = letter_runs(pieces)
        logs, counts = np.zeros((len(pieces), len(self.languages))), np.zeros(len(pieces))
        if len(codes) and self.languages:
            counts = np.bincount(owners[places > 0], minlength=len(pieces)).astype(float)
            for begin, p in self.blocks(codes, places):
                own = owners[begin : begin + len(p)]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                logs[own[first]] += np.add.reduceat(np.where((places[begin : begin + len(p)] > 0)[:, None], p, 0.0), first, axis=0)
        return logs, counts

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: cross-entropy by language, and the characters predicted, and whether there is any letter.

        Each distinct word of a part of the words is scored once; parts are smaller the more languages there are.
        """
        number, bounds, words = words_of(texts)
        logs, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        step = max(1_000, self.cells // max(1, len(self.languages)))
        for begin in range(0, len(number), step):
            own, at = np.unique(number[begin : begin + step], return_inverse=True)
            scored, counts = self.score_pieces(words.take(pa.array(own)).to_pylist())
            inside = np.clip(bounds, begin, begin + len(at)) - begin
            logs += sums(scored[at], inside)
            total += sums(counts[at], inside)
        return -logs / np.maximum(total, 1)[:, None], total, total > 0


def train(docs: DataFrame, *, per_language: int = 400, longest: int = 200_000, most_chars: int = 8_000_000, order: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModels:
    """Fit on about ``per_language`` rows of each language, drawn by hash from the rows not held out.

    Rows longer than ``longest`` characters are passed over, and of a language with more than its even part of ``most_chars``
    characters in that sample a smaller share is drawn, so the driver and the models are bounded by characters: at 500
    languages, the most that are learnt, each gives some 16,000.
    A quarter of the sample sets each language's rejection ceiling: mean and four deviations of its cross-entropy.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    # By id and text, so that rows of one id, or without one, stay a share of the sample; copies count once.
    key = F.concat(F.lit("langid "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), F.xxhash64("text").cast("string"))
    sample = hashed_sample(rows.where(F.length("text") <= longest), "lang", per_language, key, size=F.length("text"), most=most_chars).distinct().collect()
    by_lang: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r.lang, str(r.id), r.text)):
        by_lang.setdefault(r.lang, []).append(r.text)
    fitted = {k: [t for i, t in enumerate(v) if i % 4 or len(v) < 8] for k, v in by_lang.items()}
    models = LanguageModels(fitted, order)
    for k, lang in enumerate(models.languages):
        rest = [t for i, t in enumerate(by_lang[lang]) if i % 4 == 0 and len(by_lang[lang]) >= 8]
        if rest:
            entropy, _, any_letter = models.judge(pa.array(rest, pa.string()))
            if any_letter.any():
                own = entropy[any_letter, k]
                models.ceiling[k] = own.mean() + 4 * max(own.std(), 0.02)
    return models


def identify(docs: DataFrame, models: LanguageModels, *, reject: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict each whole text's language: the lowest length-normalised cross-entropy.

    score is the share of the best language when the cross-entropies over at most 50 characters
    are made probabilities. rejected tells that the best cross-entropy is above the language's
    calibrated ceiling; ``reject`` turns such predictions into ``und``. ``und`` with score 0 is
    given for null and letterless texts, or where nothing could be learned. Each distinct word
    of a batch is scored once. Null and repeated ids stay row by row; other columns are ignored.
    The models (a bounded sample's n-grams) travel with the tasks.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        names = np.array([*models.languages, UNDETERMINED], dtype=object)
        for batch in slices(batches, chars=4_000_000):
            n = batch.num_rows
            best, score, entropy, above = np.full(n, len(names) - 1), np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
            if models.languages:
                by_lang, length, known = models.judge(batch.column("text"))
                least = by_lang.argmin(axis=1)
                odds = np.exp(-(by_lang - by_lang.min(axis=1, keepdims=True)) * np.minimum(length, 50)[:, None])
                best = np.where(known, least, best)
                score = np.where(known, 1 / odds.sum(axis=1), 0.0)
                entropy = np.where(known, by_lang.min(axis=1), np.nan)
                above = known & (entropy > models.ceiling[least])
            if reject:
                best = np.where(above, len(names) - 1, best)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(above)], schema=_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
