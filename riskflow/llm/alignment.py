"""Alignment of two tokenizers' tokens over the bytes of the same texts, and how often their ids meet in the corpus.

A batch of documents becomes two tables of tokens with their byte positions. An as-of join keyed by document finds for
each token start the other side's token that covers it; both directions together are all overlaps, as two tokens
overlap just when one covers the other's start. Positions where both sides' tokens end cut the tokens into groups.

How often a pair of ids is linked in the whole corpus is counted in two steps. A task keeps a book of the pairs that
it met, in which documents write pairs by their place; books are closed before they grow too large. The books' pairs
are then summed by Spark, joined with the books again, and each book's documents are scored from its own pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, few, keep_only, materialise, text_columns, texts_of, worker_cache
from .subwords import BYTE_NAMES, RunEncoder, tokenizer_path

#: Texts of about so many characters are aligned at once; a longer text is a batch by itself.
BATCH_CHARS = 1_000_000
#: Tokens of one as-of join; a batch is cut between groups.
JOINED_TOKENS = 400_000
#: A book of pairs is closed at so many pairs or links.
BOOK_PAIRS = 500_000
BOOK_LINKS = 12_000_000
#: Rows of pairs that a book writes at once.
PAIR_ROWS = 50_000

#: Characters with the spaces before them: neither side's tokens reach over such a border. Spaces at the end stay with the last run.
RUNS = re.compile(r" *[^ ]+(?: +\Z)?")
#: The byte-level split of white space reaches over borders where other white space meets several spaces.
MIXED_SPACE = re.compile(r"[^\S ] \s")
#: Runs kept by a worker; when there are more, those met only once go.
KEPT_RUNS = 500_000


class Runs:
    """Both sides' ids of the distinct runs met so far, one behind the other."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.uses = np.empty(0, np.int64)
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def add(self, runs: list[str], ids: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.place.update(zip(runs, range(len(self.uses), len(self.uses) + len(runs)), strict=True))
        self.uses = np.concatenate([self.uses, np.zeros(len(runs), np.int64)])
        for k in (0, 1):
            self.ids[k] = np.concatenate([self.ids[k], ids[k].astype(np.int32)])
            self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(counts[k])])

    def ids_of(self, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Side k's ids of the runs at ``places`` and how many each one has."""
        first, n = self.ends[k][places], self.ends[k][places + 1] - self.ends[k][places]
        return self.ids[k][np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def tidy(self) -> None:
        if len(self.uses) <= KEPT_RUNS:
            return
        keep = np.flatnonzero(self.uses > 1)
        keep = keep if len(keep) <= KEPT_RUNS // 2 else keep[:0]
        runs, kept = [*self.place], [self.ids_of(k, keep) for k in (0, 1)]
        self.__init__()
        self.add([runs[i] for i in keep.tolist()], [x[0] for x in kept], [x[1] for x in kept])


class Tokenizers:
    """Both sides' ids of whole texts; runs that are new are encoded as one text and cut again where the runs end."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        byte_level = RunEncoder(a, True, 0)
        byte_level.tokenizer.encode_special_tokens = True
        self.whole_a = lambda text: byte_level.tokenizer.encode(text, add_special_tokens=False).ids
        byte_of = {c: x for x, c in BYTE_NAMES.items()}
        vocabulary = byte_level.tokenizer.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        model = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.encode = byte_level.merge, lambda text: model.encode(text[1:])
        self.bytes = bytes_a, bytes_b
        self.sizes = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        self.by_runs = not any("▁" in p.lstrip("▁") for p in pieces)
        self.runs = Runs()

    def _kept(self, text: str, *ids: list[int]) -> bool:
        """Whether both sides' ids give back the bytes of the text."""
        return all(b"".join(map(names.__getitem__, x)) == text.encode() for x, names in zip(ids, self.bytes, strict=True))

    def _learn(self, runs: list[str]) -> None:
        """Enter runs that both sides keep as they are; others stay unknown."""
        runs = [r for r in runs if not r[-1].isspace()]
        text = "".join(runs)
        ids = [encode(text) for encode in self.encode] if text else [[], []]
        borders = np.cumsum([len(r.encode()) for r in runs])
        if self._kept(text, *ids) and not MIXED_SPACE.search(text):
            ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True)] if text else [borders, borders]
            at = [np.searchsorted(e, borders) for e in ends]
            if all((e[np.minimum(i, len(e) - 1)] == borders).all() for e, i in zip(ends, at, strict=True)):
                self.runs.add(runs, [np.array(x, np.int32) for x in ids], [np.diff(i + 1, prepend=0) for i in at])
                return
        if len(runs) > 1:  # something in them doesn't keep its bytes: look for it in halves
            self._learn(runs[: len(runs) // 2])
            self._learn(runs[len(runs) // 2 :])

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of a space and each text, and how many each text has: none if a side doesn't keep its bytes, nor for an empty text."""
        self.runs.tidy()
        found = [RUNS.findall(" " + t) if t and self.by_runs and not MIXED_SPACE.search(t) else [] for t in texts]
        place = self.runs.place
        self._learn([r for r in dict.fromkeys(chain.from_iterable(found)) if r not in place])
        n = np.array([len(f) for f in found])
        places = np.fromiter(map(place.get, chain.from_iterable(found), repeat(-1)), np.int64, n.sum())
        doc = np.repeat(np.arange(len(texts)), n)
        whole = np.bincount(doc, weights=places < 0, minlength=len(texts)).astype(bool) | (n == 0)
        places = places[~whole[doc]]
        self.runs.uses += np.bincount(places, minlength=len(self.runs.uses))
        doc = doc[~whole[doc]]
        parts = [self.runs.ids_of(k, places) for k in (0, 1)]
        ids, counts = [p[0] for p in parts], [np.bincount(doc, weights=p[1], minlength=len(texts)).astype(np.int64) for p in parts]
        others = {}
        for i in np.flatnonzero(whole).tolist():
            both = (self.whole_a(" " + texts[i]), self.encode[1](" " + texts[i])) if texts[i] else ([], [])
            if both[0] and both[1] and self._kept(" " + texts[i], *both):
                others[i] = both
        for k in (0, 1):
            if others:
                before = np.cumsum(counts[k]) - counts[k]
                at = [before[i] for i in others]
                ids[k] = np.insert(ids[k], np.repeat(at, [len(x[k]) for x in others.values()]), np.concatenate([np.array(x[k], np.int32) for x in others.values()]))
                counts[k][[*others]] = [len(x[k]) for x in others.values()]
        return [*zip(ids, counts, strict=True)]


_tokenizers: dict[tuple[str, str], Tokenizers] = worker_cache("alignment", {})


def tokenizers(a: str, b: str) -> Tokenizers:
    """Both tokenizers, once for each worker process."""
    keep_only("alignment")
    if (a, b) not in _tokenizers:
        _tokenizers[a, b] = Tokenizers(*(name if os.sep in name else tokenizer_path(name) for name in (a, b)))
    return _tokenizers[a, b]


def covering(starts: pd.DataFrame, tokens: pd.DataFrame) -> pd.DataFrame:
    """For each row of ``starts`` the document's token of ``tokens`` that covers its start."""
    return pd.merge_asof(starts, tokens, on="start", by="doc")


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of overlapping tokens, each once: places of a and b by the starts of a, then those by the starts of b alone.

    Args:
        a: doc, start, a in order; start counts through the batch, so that it rises from one document to the next.
        b: the same with b.
    """
    left = covering(a, b)
    right = covering(b, a.assign(same=a["start"]))
    later = (right["same"] != right["start"]).to_numpy()  # equal starts are in left already
    return [(left["a"].to_numpy(), left["b"].to_numpy()), (right["a"].to_numpy()[later], right["b"].to_numpy()[later])]


_names: dict[int, np.ndarray] = {}


def names_of(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1 with a comma, a bar and a semicolon behind them."""
    if n not in _names:
        _names[n] = np.array([f"{i}{end}".encode() for i in range(n) for end in ",|;"], object)
    return _names[n]


def interleaved(docs: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of two lists, each in order of ``docs`` (numbers under n), in one list where a number's items of the first come before those of the second."""
    one, two = (np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))]) for d in docs)
    return np.arange(len(docs[0])) + two[docs[0]], np.arange(len(docs[1])) + one[docs[1] + 1]


def group_digests(ids: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> list[str]:
    """The digest of ``a1,a2|b1;a3|b2,b3`` for each document; group numbers rise through the batch."""
    n_groups = int(group[0][-1]) + 1 if len(group[0]) else 0
    names = names_of(1 << 16)
    if n_groups and max(int(x.max()) for x in ids) >= 1 << 16:
        names = names_of(max(int(x.max()) for x in ids) + 1)
    at = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    for x, g, place, end in zip(ids, group, interleaved(group, n_groups), (1, 2), strict=True):
        at[place] = x * 3 + end * (np.diff(g, append=n_groups) > 0)
    text = names[at].tolist()
    stops = np.cumsum(tokens).tolist()
    return [hashlib.sha256(b"".join(text[lo:hi])[:-1]).hexdigest() if hi > lo else "" for lo, hi in zip([0, *stops[:-1]], stops, strict=True)]


class Aligned:
    """A batch of texts: for each one its counts and the digest of its groups, and all links as pairs of ids by document."""

    def __init__(self, texts: list[str], both: Tokenizers):
        n = len(texts)
        ids, self.n = zip(*((x.astype(np.int64), k) for x, k in both.encode_batch(texts)), strict=True)
        doc = tuple(np.repeat(np.arange(n), k) for k in self.n)
        sizes = tuple(s[x] for s, x in zip(both.sizes, ids, strict=True))
        ends = tuple(np.cumsum(s) for s in sizes)
        # a group's last tokens: those that end where a token of the other side does
        last = tuple(o[np.minimum(np.searchsorted(o, e), len(o) - 1)] == e for e, o in (ends, ends[::-1]))
        group = tuple(np.cumsum(x) - x for x in last)
        closing = tuple(np.flatnonzero(x) for x in last)
        self.groups = np.bincount(doc[0][closing[0]], minlength=n)
        self.digests = group_digests(ids, group, self.n[0] + self.n[1])
        pairs, of = ([], []), ([], [])
        for x, y in self._slices(closing):
            tables = (pd.DataFrame({"doc": doc[k][s], "start": ends[k][s] - sizes[k][s], name: np.arange(s.start, s.stop)}) for k, s, name in ((0, x, "a"), (1, y, "b")))
            for k, (at_a, at_b) in enumerate(overlaps(*tables)):
                pairs[k].append(ids[0][at_a] << 32 | ids[1][at_b])
                of[k].append(doc[0][at_a])
        pairs, of = ([np.concatenate(p) if p else np.empty(0, np.int64) for p in x] for x in (pairs, of))
        self.pairs = np.empty(len(pairs[0]) + len(pairs[1]), np.int64)
        for p, place in zip(pairs, interleaved(of, n), strict=True):
            self.pairs[place] = p
        self.links = np.bincount(of[0], minlength=n) + np.bincount(of[1], minlength=n)

    @staticmethod
    def _slices(last: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[slice, slice]]:
        """Ranges of the tokens of both sides that hold whole groups, of about JOINED_TOKENS each."""
        low = [0, 0]
        while low[0] < (last[0][-1] + 1 if len(last[0]) else 0):
            k = min(max(int(np.searchsorted(at, lo + JOINED_TOKENS, "right")) for at, lo in zip(last, low, strict=True)), len(last[0])) - 1
            k = max(k, int(np.searchsorted(last[0], low[0])))
            high = [int(at[k]) + 1 for at in last]
            yield slice(low[0], high[0]), slice(low[1], high[1])
            low = high


class Book:
    """The pairs that a task met, each with a place and the number of its links."""

    def __init__(self, number: int):
        self.number, self.links = number, 0
        self.pairs, self.counts = pd.Index([], dtype=np.int64), np.empty(0, np.int64)

    def places_of(self, pairs: np.ndarray) -> np.ndarray:
        """Places of the pairs; new ones are entered, more frequent ones first."""
        place = self.pairs.get_indexer(pairs)
        new = place < 0
        if new.any():
            fresh = pd.Series(pairs[new]).value_counts().index.to_numpy()
            self.pairs = pd.Index(np.concatenate([self.pairs.to_numpy(), fresh]))
            place[new] = self.pairs.get_indexer(pairs[new])
            self.counts = np.concatenate([self.counts, np.zeros(len(fresh), np.int64)])
        self.counts += np.bincount(place, minlength=len(self.counts))
        self.links += len(pairs)
        return place

    @property
    def full(self) -> bool:
        return len(self.pairs) >= BOOK_PAIRS or self.links >= BOOK_LINKS


def planes(places: np.ndarray) -> bytes:
    """Numbers of 32 bits as four runs of bytes: the high ones, mostly zero, then compress to nothing."""
    return places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


ALIGNED = "book long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, first long, pairs array<long>, counts array<long>"


def by_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about BATCH_CHARS characters at a time."""
    ids, texts, size = [], [], 0
    for batch in chain.from_iterable(few([b], 256) for b in batches):
        for i, t in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
            if texts and size + len(t) > BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def aligner(a: str, b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents, whose links name places in a book, and rows of the books' pairs (doc columns null)."""

    def rows(values: dict, n: int) -> pa.RecordBatch:
        kinds = {"groups_sha256": pa.string(), "links": pa.binary(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
        names = [f.split()[0] for f in ALIGNED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(values[k], kinds.get(k, pa.int64())) if k in values else pa.nulls(n, kinds.get(k, pa.int64())) for k in names], names)

    def written(book: Book) -> Iterator[pa.RecordBatch]:
        by_place = book.pairs.to_numpy()
        for lo in range(0, len(by_place), PAIR_ROWS):
            yield rows({"book": [book.number], "first": [lo], "pairs": [by_place[lo : lo + PAIR_ROWS]], "counts": [book.counts[lo : lo + PAIR_ROWS]]}, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a, b)
        book = Book(TaskContext.get().partitionId() << 32)
        for ids, texts in by_chars(batches):
            found = Aligned(texts, both)
            places = book.places_of(found.pairs)
            at = np.concatenate([[0], np.cumsum(found.links)])
            links = [planes(places[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield rows({"book": np.full(len(ids), book.number), "doc_id": ids, "n_a": found.n[0], "n_b": found.n[1], "n_groups": found.groups, "n_links": found.links, "groups_sha256": found.digests, "links": links, "first": np.full(len(ids), -1)}, len(ids))
            if book.full:
                yield from written(book)
                book = Book(book.number + 1)
        yield from written(book)

    return run


def scored(book: pa.Table, docs: pa.Table) -> pa.Table:
    """Documents of one book with n_best and count_sum from the totals of the book's pairs."""
    total, best = np.zeros(book.num_rows, np.int64), np.zeros(book.num_rows, np.int64)
    place = book["place"].to_numpy()
    total[place], best[place] = book["total"].to_numpy(), book["best"].to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for links in docs["links"].to_pylist():
        at = from_planes(links)
        n_best.append(int(best[at].sum()))
        count_sum.append(int(total[at].sum()))
    return docs.drop_columns(["links", "book"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align_tokens(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """Align the tokens of two tokenizers over every whole text and count how often their ids are linked.

    Args:
        docs: doc_id and text; further columns may have any name and are not read.
        a: a byte-level vocabulary of the tokenizers library; a space is put before the text, and special tokens'
            strings are plain text.
        b: a sentencepiece model, which puts the space there itself.
    Returns:
        doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256: see the module. A null or
        empty text, and one whose tokens on either side don't give back its bytes, has zeros and an empty digest.
        Repeated rows are documents of their own and count each time; a null doc_id stays null; of pairs with the
        same highest count for their b, all are best. Very long texts are joined in slices cut between groups. An
        empty table gives an empty one.
    """
    aligned = materialise(text_columns(docs).mapInArrow(aligner(a, b), ALIGNED), "aligned")
    of_docs = aligned.where("first = -1").select("book", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    books = aligned.where("first >= 0").select("book", "first", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x"))
    books = books.select("book", (F.col("first") + F.col("at")).alias("place"), F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = materialise(books.groupBy("pair").agg(F.sum("n").alias("total")), "totals")
    highest = totals.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("total").alias("highest"))
    # a row for each id of b's vocabulary at most
    marked = totals.join(F.broadcast(highest), F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b")).select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    known = books.select(F.col("book").alias("of"), "place", "pair").join(marked, "pair").select("of", "place", "total", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return known.groupBy("of").cogroup(of_docs.groupBy("book")).applyInArrow(scored, schema).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
