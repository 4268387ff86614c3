"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

Two words are as similar as the letter triples, gaps allowed, that they share; a gap lowers a triple's weight, so that
inserted, doubled or set-apart characters change little. A text's kernel with a landmark word sums over its words.
Landmarks are the training words most tied to the label; the kernel among them whitens the features, and a linear
machine and a logistic curve are fitted to those of a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, few, keep_only, map_arrow, materialise, summed, text_columns, texts_of
from .vectors import packed, unpacked

#: Labelled texts that the machine is fitted to, at most; those whose ids have the smallest hashes.
TRAINING_TEXTS = 20_000
LANDMARKS = 192
#: Words from which landmarks are taken, the most tied first, each less like the chosen ones than this.
CANDIDATES, ALIKE = 1500, 0.9
#: Texts with a word, both labels together, for it to become a landmark.
LEAST_TEXTS = 3
#: Weight of a gap of one letter in a triple, and letters that a triple spans at most.
DECAY, SPAN = 0.9, 7
#: Similarity at which words count as half the same, and how steeply that rises.
MATCH, SHARPNESS = 0.52, 20.0
#: Longer words are read in overlapping windows of this many letters.
WINDOW = 24
#: Ways in which a text's matches are pooled, and the weight of errors against large weights.
POOLS, STRENGTH = 3, 0.05
REJECT = 0.7
FOLDS, HELD_OUT = 3, 1

CODES = 64
#: A word's matches as they are kept: landmark and extent.
MATCHES = np.dtype([("at", "<i2"), ("much", "<f4")])
#: Characters that stand for letters within a word (fixed values).
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
BETWEEN_LETTERS = re.compile(r"(?<=[^\W\d_])[013457@$!](?=[^\W\d_])")
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Three or more letters set apart, each alone between spaces.
SPELLED = re.compile(r"(?<!\S)[^\W\d_](?:[ \t]+[^\W\d_](?!\S)){2,}")
#: Runs kept by one worker in each of two generations; it bounds memory only.
GENERATION = 300_000
TOGETHER = 2_000_000
#: Words compared with the landmarks at once, and texts summed up at once.
TOGETHER_WORDS, TOGETHER_TEXTS = 1000, 1000
#: Parts in which the tasks' sums are added up.
SEGMENTS = 16
#: Tasks that hold the features of the TRAINING_TEXTS at most and send sums of their products in each step.
FIT_TASKS = 8


def letters(run: str) -> str:
    """A run of non-space characters as one word of letters."""
    if not run.isalpha():
        run = NOT_LETTERS.sub("", BETWEEN_LETTERS.sub(lambda m: m[0].translate(LOOKALIKE), run))
    return run


def windows(word: str) -> list[str]:
    return [word] if len(word) <= WINDOW else [word[k : k + WINDOW] for k in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words, each word followed by zeros so that no triple reaches the next, and word numbers."""
    points = np.frombuffer(("\0" * SPAN).join(words).encode("utf-32-le", "surrogatepass"), "<u4") if words else np.empty(0, "<u4")
    latin = (points >= 97) & (points <= 122)
    codes = np.where(points == 0, 0, np.where(latin, points - 96, 27 + points % (CODES - 27))).astype(np.int64)
    size = np.array([len(w) for w in words], np.int64)
    number = np.repeat(np.arange(len(words)), size + SPAN)[: len(codes)]
    return codes, number


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every shape of triple its places, its key there and its weight."""
    for last in range(2, SPAN):
        for mid in range(1, last):
            if len(codes) > last:
                a, b, c = codes[:-last], codes[mid : len(codes) - last + mid], codes[last:]
                at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
                yield at, (a[at] * CODES + b[at]) * CODES + c[at], DECAY ** (last - 2)


def own_kernel(words: list[str]) -> np.ndarray:
    """The kernel of each word with itself: the squares of its triples' summed weights."""
    codes, number = encode(words)
    found = [(number[at] * CODES**3 + keys, np.full(len(at), w)) for at, keys, w in triples(codes)]
    if not found:
        return np.zeros(len(words))
    keys, w = (np.concatenate(x) for x in zip(*found, strict=True))
    distinct, place = np.unique(keys, return_inverse=True)
    return np.bincount(distinct // CODES**3, np.bincount(place, w, len(distinct)) ** 2, len(words))


class WordKernel:
    """Similarities of words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        weights: list[Counter] = [Counter() for _ in landmarks]
        codes, number = encode(landmarks)
        for at, keys, w in triples(codes):
            for k, key in zip(number[at].tolist(), keys.tolist(), strict=True):
                weights[k][key] += w
        # Each triple's landmarks and its weights there, one after the other; row 0 is a triple that no landmark has.
        rows = {key: r for r, key in enumerate(sorted(set().union(*weights)), 1)}
        self.row = np.zeros(CODES**3, np.int32)
        held = sorted((rows[key], k, w) for k, own in enumerate(weights) for key, w in own.items())
        for key, r in rows.items():
            self.row[key] = r
        self.at = np.array([h[1] for h in held], np.int64)
        self.weight = np.array([h[2] for h in held])
        self.many = np.bincount([h[0] for h in held], minlength=len(rows) + 1) if held else np.zeros(1, np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.own = own_kernel(landmarks)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def similarity(self, words: list[str]) -> np.ndarray:
        """Normalised kernels, a row for each word."""
        m = len(self.landmarks)
        out = np.zeros((len(words), m))
        if not m:
            return out
        codes, number = encode(words)
        found = []
        for at, keys, w in triples(codes):
            row = self.row[keys]
            hit = np.flatnonzero(row)
            found.append((number[at[hit]], row[hit], np.full(len(hit), w)))
        if found:
            who, row, w = (np.concatenate(x) for x in zip(*found, strict=True))
            many = self.many[row]
            place = np.repeat(self.first[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
            out = np.bincount(np.repeat(who * m, many) + self.at[place], np.repeat(w, many) * self.weight[place], len(words) * m).reshape(len(words), m)
        return out / np.sqrt(np.maximum(own_kernel(words)[:, None] * self.own, 1e-9))

    def matches(self, words: list[str]) -> np.ndarray:
        """How far each word counts as each landmark, 0 to 1."""
        soft = 1 / (1 + np.exp(-SHARPNESS * (self.similarity(words) - MATCH)))
        return np.where(soft < 0.01, 0, soft).astype(np.float32)

    def learn(self, runs: list[str]) -> None:
        """Add runs to the young generation, each with its matches packed: none for one that is like no landmark."""
        words, owner = [], []
        for k, run in enumerate(runs):
            word = letters(run)
            for part in windows(word) if len(word) >= 3 else ():
                words.append(part)
                owner.append(k)
        self.young.update(dict.fromkeys(runs, b""))
        for lo in range(0, len(words), TOGETHER_WORDS):
            found = self.matches(words[lo : lo + TOGETHER_WORDS])
            row, at = np.nonzero(found)
            packed = np.empty(len(row), MATCHES)
            packed["at"], packed["much"] = at, found[row, at]
            rows, first = np.unique(row, return_index=True)
            last = np.append(first[1:], len(row))[: len(first)]
            for k, a, b in zip(rows.tolist(), first.tolist(), last.tolist(), strict=True):
                run, own = runs[owner[lo + k]], packed[a:b]
                if before := self.young[run]:  # windows of one long word
                    whole = np.zeros(len(self.landmarks), np.float32)
                    for m in (np.frombuffer(before, MATCHES), own):
                        whole[m["at"]] = np.maximum(whole[m["at"]], m["much"])
                    own = np.empty(np.count_nonzero(whole), MATCHES)
                    own["at"] = np.flatnonzero(whole)
                    own["much"] = whole[own["at"]]
                self.young[run] = own.tobytes()

    def pooled(self, texts: list[str]) -> np.ndarray:
        """For each text and landmark whether a word matches, and the logarithms of the matches and of those in a hundred words."""
        out = np.zeros((len(texts), POOLS * len(self.landmarks)), np.float32)
        if not self.landmarks:
            return out
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and chars < TOGETHER:
                chars += len(texts[hi])
                hi += 1
            runs = []
            for text in texts[lo:hi]:
                text = text.lower()
                runs.append(text.split() + [NOT_LETTERS.sub("", m) for m in SPELLED.findall(text)])
            missing = []
            for run in set().union(*runs).difference(self.young):
                if run in self.old:
                    self.young[run] = self.old[run]
                else:
                    missing.append(run)
            self.learn(missing)
            for k, own in enumerate(runs):
                found = np.frombuffer(b"".join(map(self.young.__getitem__, own)), MATCHES)
                if len(found):
                    total = np.bincount(found["at"], found["much"], len(self.landmarks))
                    out[lo + k] = np.concatenate([np.minimum(total, 1), np.log1p(total), np.log1p(100 * total / len(own))])
            if len(self.young) > GENERATION:
                self.young, self.old = {}, self.young
            lo = hi
        return out


class Model(NamedTuple):
    landmarks: list[str]
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(pooled), self.offset)
        margin = features(pooled, self.whiten) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def features(pooled: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    n = len(whiten)
    return np.concatenate([pooled[:, k * n : (k + 1) * n] @ whiten for k in range(POOLS)], axis=1)


def newton_sums(sample: DataFrame, width: int, w: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Over the texts within the margin of ``w``: sums of products of features, of features and label, and how many texts crossed it since ``before``."""
    upper = np.triu_indices(width)  # the products are symmetric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, right, crossed, some = np.zeros((width, width)), np.zeros(width), 0, False
        for batch in few(batches, TOGETHER_TEXTS):
            x = np.frombuffer(b"".join(column(batch, "x").to_pylist()), "<f4").reshape(-1, width).astype(np.float64)
            y = 2.0 * column(batch, "toxic").to_numpy() - 1
            active = y * (x @ w) < 1
            crossed += len(x) if before is None else int((active != (y * (x @ before) < 1)).sum())
            squares += x[active].T @ x[active]
            right += x[active].T @ y[active]
            some = True
        if some:
            parts = [v.tobytes() for v in np.array_split(np.concatenate([squares[upper], right, [float(crossed)]]), SEGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * SEGMENTS, pa.int32()), pa.array(parts, pa.binary())], ["segment", "task", "v"])

    found = summed(sample.mapInArrow(run, "segment int, task int, v binary"))
    total = np.concatenate([found[k] for k in range(SEGMENTS)])
    squares = np.zeros((width, width))
    squares[upper] = total[: len(upper[0])]
    return squares + np.triu(squares, 1).T, total[len(upper[0]) : -1], int(total[-1])


def fit_machine(sample: DataFrame, width: int, strength: float = STRENGTH) -> np.ndarray:
    """Weights of the linear machine with squared hinge loss, the bias last, by Newton's method over sums that the tasks make."""
    w, before = np.zeros(width), None
    keep = np.eye(width)
    keep[-1, -1] = 1e-6
    for _ in range(50):
        squares, right, crossed = newton_sums(sample, width, w, before)
        if not crossed:
            break
        w, before = np.linalg.solve(keep + 2 * strength * squares, 2 * strength * right), w
    return w


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels, with targets drawn in by the class sizes."""
    plus, minus = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))
    ab, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * ab)
        ab = ab - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def word_ties(sample: DataFrame) -> DataFrame:
    """word, plus and minus: texts of each label that have the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("toxicity")
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(texts_of(batch), column(batch, "toxic").to_pylist(), strict=True):
                count[toxic].update({w for r in set(text.lower().split()) if 3 <= len(w := letters(r)) <= WINDOW})
        words = list(count[0].keys() | count[1].keys())
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([count[k][w] for w in words], pa.int64()) for k in (1, 0))], ["word", "plus", "minus"])

    return sample.select("text", "toxic").mapInArrow(run, "word string, plus long, minus long").groupBy("word").agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, texts: int = TRAINING_TEXTS, landmarks: int = LANDMARKS) -> Model:
    """Fit the machine to at most ``texts`` labelled texts whose fold isn't held out.

    Rows of ``labels`` with a null doc_id or label, or one other than 0 and 1, aren't used; an id that is labelled both
    ways counts as toxic. Null and empty texts are texts without words, and very long ones are read whole. Of rows of
    ``docs`` that share a doc_id one is used, that of the smallest text. With one label alone, no label, no document or
    no word that enough texts share, the model gives every text that label's share (0 without labels).
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts)
    labelled = text_columns(docs).join(F.broadcast(chosen), "doc_id")  # at most ``texts`` rows
    sample = materialise(labelled.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "labelled")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    plus, minus = size.get(1, 0), size.get(0, 0)
    share = (plus / (plus + minus)) if plus + minus else 0.0
    none = Model([], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, share)
    if not plus or not minus:
        return none
    a, b = F.col("plus") + 0.5, F.col("minus") + 0.5
    tie = (F.log(a / (plus + 1 - a)) - F.log(b / (minus + 1 - b))) / F.sqrt(1 / a + 1 / b)
    words = unlike([r["word"] for r in word_ties(sample).where(F.col("plus") + F.col("minus") >= LEAST_TEXTS).orderBy(F.desc(tie), "word").limit(CANDIDATES).collect()], landmarks)
    if not words:
        return none
    among = WordKernel(words).matches(words)
    values, vectors = np.linalg.eigh((among + among.T) / 2 + 1e-3 * np.eye(len(words)))
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    points = materialise(whitened(sample, words, whiten).coalesce(FIT_TASKS), "features")
    weights = fit_machine(points, POOLS * len(words) + 1)
    slope, offset = fit_curve(*margins(points, weights))
    return Model(words, whiten, weights[:-1], float(weights[-1]), slope, offset)


def unlike(words: list[str], n: int) -> list[str]:
    """The first n words of which none is too like an earlier one."""
    chosen: list[str] = []
    for lo in range(0, len(words), n):
        if len(chosen) >= n:
            break
        new = words[lo : lo + n]
        old, among = WordKernel(chosen).similarity(new), WordKernel(new).similarity(new)
        taken: list[int] = []
        for k in range(len(new)):
            if len(chosen) + len(taken) < n and not (old[k] >= ALIKE).any() and not (among[k, taken] >= ALIKE).any():
                taken.append(k)
        chosen += [new[k] for k in taken]
    return chosen


def whitened(sample: DataFrame, words: list[str], whiten: np.ndarray) -> DataFrame:
    """toxic and x, the packed features of each text with a one for the bias."""

    def make():
        keep_only("toxicity")
        kernel = WordKernel(words)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features(kernel.pooled(texts_of(batch)), whiten)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype("<f4")
            return pa.RecordBatch.from_arrays([column(batch, "toxic"), packed(x)], ["toxic", "x"])

        return each

    return map_arrow(sample, make, "toxic int, x binary", TOGETHER_TEXTS)


def margins(points: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margin and label (-1 or 1) of each text of the bounded sample: two numbers a text."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            margin = unpacked(column(batch, "x"), "<f4", len(weights)) @ weights
            return pa.RecordBatch.from_arrays([column(batch, "toxic"), pa.array(margin)], ["toxic", "margin"])

        return each

    found = map_arrow(points, make, "toxic int, margin double").toPandas()
    return found["margin"].to_numpy(), 2.0 * found["toxic"].to_numpy() - 1


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Each whole text is scored by its words alone; null and empty texts get the score of a text without matches. Rows
    with a null doc_id are not held out. Repeated rows get equal scores; an empty table gives an empty one; columns
    besides doc_id and text are ignored.
    """

    def make():
        keep_only("toxicity")
        kernel = WordKernel(model.landmarks)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.score(kernel.pooled(texts_of(batch))).astype(np.float64)
            return pa.RecordBatch.from_arrays([column(batch, "doc_id").cast("int64"), pa.array(score), pa.array((score >= REJECT).astype(np.int32))], ["doc_id", "score", "predicted"])

        return each

    scored = map_arrow(text_columns(docs), make, "doc_id long, score double, predicted int", TOGETHER_TEXTS)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit to the labelled texts and score all; the cases are those of ``fit_toxicity`` and ``score_toxicity``."""
    return score_toxicity(docs, fit_toxicity(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, all columns as they are, whose texts score under REJECT.

    Null and empty texts score as texts without matches, whole long texts are read, repeated rows go or stay together,
    rows with a null doc_id are scored like others, and an empty table gives an empty one. Any further columns stay.
    """
    model, names = fit_toxicity(docs, labels), docs.columns

    def make():
        keep_only("toxicity")
        kernel = WordKernel(model.landmarks)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.score(kernel.pooled(texts_of(batch)))
            return batch.filter(pa.array(score < REJECT)).select(names)

        return each

    return map_arrow(docs, make, docs.schema, TOGETHER_TEXTS)
