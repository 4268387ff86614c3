"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius of each other.

A text's terms are its shingles of five words; each distinct one votes on 128 signed bits by its hash, with a weight
that grows with its count. Near fingerprints are found in permuted block tables: the bits are cut into more blocks than
may differ, so that near ones agree in some choice of whole blocks, each of which is a table's key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, few, keep_only, materialise, texts_of, worker_cache

WORDS = 5
BITS = 128
#: Bits that may differ between near fingerprints, about 0.99 in cosine.
RADIUS = 6
#: Members of a bucket that are compared with each other; larger buckets are cut into pieces and their pieces compared.
PIECE = 2048
#: Characters of the texts whose words are hashed at once.
BATCH_CHARS = 1_000_000
#: Words whose hashes a worker keeps.
KEPT_WORDS = 500_000
#: Shingles that vote at once: their weights add up to less than 2 ** 24, so single precision is exact.
VOTERS = 65_536

#: Stands for no id.
NONE = (1 << 63) - 1

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_WHOLE = np.uint64(0x27D4EB2F165667C5)


class WordHashes(dict):
    """64-bit hashes of words (bytes)."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value
        return value


_words: dict[str, WordHashes] = worker_cache("simhash", {})


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Well-mixed 64 bits of each number."""
    x = x ^ np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts whose words' hashes lie one behind the other, and how many each text has."""
    n = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts - np.cumsum(n) + n, n) + np.arange(n.sum())
    length = np.repeat(np.minimum(counts, WORDS), n)
    out = length.astype(np.uint64) * _WHOLE
    for k in range(WORDS):
        inside = k < length
        out[inside] += mixed(words[first[inside] + k], k) * _MULTIPLIERS[k]
    return out, n


def votes(hashes: np.ndarray) -> np.ndarray:
    """128 bits (as 16 bytes) of one text's shingles: each distinct one counts with the binary digits of its number."""
    distinct, n = np.unique(hashes, return_counts=True)
    weight = np.frexp(n)[1]
    bits = np.stack([mixed(distinct, 1), mixed(distinct, 2)], 1).view(np.uint8)
    total = np.zeros(BITS, np.int64)
    for lo in range(0, len(distinct), VOTERS):
        part = np.unpackbits(bits[lo : lo + VOTERS], axis=1).astype(np.float32)
        total += (weight[lo : lo + VOTERS].astype(np.float32) @ part).astype(np.int64)
    return np.packbits(2 * total > weight.sum())


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of 16 bytes for each text; texts without words have zeros."""
    known = _words.setdefault("words", WordHashes())
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    done = 0
    while done < len(texts):
        words, size, first = [], 0, done
        while done < len(texts) and (done == first or size + len(texts[done]) <= BATCH_CHARS):
            words.append(texts[done].encode().lower().split())  # of bytes: A-Z alone become a-z, and only ASCII white space splits
            size += len(texts[done])
            done += 1
        counts = np.array([len(w) for w in words])
        hashes, n = shingles(np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, counts.sum()), counts)
        stops = np.cumsum(n)
        for k in np.flatnonzero(n).tolist():
            out[first + k] = votes(hashes[stops[k] - n[k] : stops[k]])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bits in which rows of fingerprints agree."""
    return 1 - np.bitwise_count(a ^ b).sum(1) / BITS


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters from the start of the following one, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ENDS = ", part int, end int, text string"
COLUMNS = [f.split()[0] for f in DONE.split(", ")]


def finished(ids: list, texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> list[pa.Array]:
    """The columns of DONE."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    new = fingerprints(changed)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array([p.tobytes().hex() for p in prints]), pa.array([p.tobytes().hex() for p in new]), pa.array(likeness(prints, new)), pa.array(likeness(prints, next_prints)),
    ]


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, each with the next one; the first (end 1) and the last (end 2) also with their texts, the last one unfinished."""
    keep_only("simhash")
    part = TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    names = [*COLUMNS, "part", "end", "text"]

    def ended(doc_id, text: str, bits: np.ndarray, end: int) -> pa.RecordBatch:
        values = [pa.array([doc_id], pa.int64()), pa.array([len(text)], pa.int64()), pa.nulls(1, pa.string()), pa.array([bits.tobytes().hex()]), *(pa.nulls(1, k) for k in kinds[4:])]
        return pa.RecordBatch.from_arrays([*values, pa.array([part], pa.int32()), pa.array([end], pa.int32()), pa.array([text])], names)

    ids, texts, bits = [], [], np.empty((0, BITS // 8), np.uint8)  # the row that waits for its next one
    for batch in few(batches, 256):
        new = texts_of(batch)
        new_bits = fingerprints(new)
        if not texts:
            yield ended(column(batch, "doc_id")[0].as_py(), new[0], new_bits[0], 1)
        ids, texts, bits = ids + column(batch, "doc_id").to_pylist(), texts + new, np.concatenate([bits, new_bits])
        if len(texts) > 1:
            n = len(texts) - 1
            values = finished(ids[:-1], texts[:-1], bits[:-1], texts[1:], bits[1:])
            yield pa.RecordBatch.from_arrays([*values, pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.string())], names)
            ids, texts, bits = ids[-1:], texts[-1:], bits[-1:]
    if texts:
        yield ended(ids[0], texts[0], bits[0], 2)


def at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of ranges with the first row of the next range."""
    for batch in few(batches, 64):
        bits = [np.array([[*bytes.fromhex(x)] for x in column(batch, c).to_pylist()], np.uint8).reshape(-1, BITS // 8) for c in ("fingerprint", "next_fingerprint")]
        yield pa.RecordBatch.from_arrays(finished(column(batch, "doc_id").to_pylist(), texts_of(batch), bits[0], texts_of(batch, "next_text"), bits[1]), COLUMNS)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness; see :func:`document_fingerprints`.

    Rows are ranged by descending doc_id (null last; equal ids by the hash of their text, then by their text), so that each
    one meets the next within its task; only the first and last row of each range are joined afterwards.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = materialise(ranged.mapInArrow(in_order, DONE + ENDS), "fingerprints")
    heads = rows.where("end = 1").select(F.col("part").alias("head"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    parts = rows.where("end = 1").select("part")  # a row for each range that has rows
    turns = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("later"), F.min("part").over(Window.partitionBy()).alias("lowest"))
    turns = turns.select("part", F.coalesce("later", "lowest").alias("head"))
    tails = rows.where("end = 2").select("doc_id", "text", "fingerprint", "part").join(turns, "part").join(heads, "head")
    return rows.where("end = 0").select(*COLUMNS).unionByName(tails.mapInArrow(at_borders, DONE))


def blocks_of(radius: int, rows: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks as (first bit, bits) and the tables as choices of blocks.

    Of radius + c blocks at least c agree in two near fingerprints. c grows with the table, so that a key has bits enough
    to tell most of the rows apart.
    """
    c = 1
    while c * BITS // (radius + c) < min(math.log2(max(rows, 2)) - 4, 40):
        c += 1
    m = radius + c
    cuts = [k * BITS // m for k in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], list(combinations(range(m), c))


def _masks(blocks: list[tuple[int, int]]) -> np.ndarray:
    """A row of 16 bytes for each block, with its bits set."""
    out = np.zeros((len(blocks), BITS), np.uint8)
    for k, (lo, n) in enumerate(blocks):
        out[k, lo : lo + n] = 1
    return np.packbits(out, axis=1)


def near_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each distinct fingerprint the rows whose fingerprints lie within ``radius`` bits of it.

    Args:
        prints: id (long) and fingerprint (32 hexadecimal digits); rows without a fingerprint take no part.
    Returns:
        fingerprint, n_near (rows within the radius, those that share it included) and near_id (the smallest id among them,
        null if all are null). Equal fingerprints are one class from the start. Pairs of classes are counted where they
        are found and in the first of their tables alone; they are never made into rows. A bucket of over PIECE classes is
        cut into pieces by hash, and each two pieces meet in a run of their own: that is exact at any size. An empty
        table gives an empty one.
    """
    classes = materialise(prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("id").alias("first")), "classes")
    blocks, tables = blocks_of(radius, classes.count())
    masks = _masks(blocks)
    keys = np.array([np.bitwise_or.reduce(masks[list(t)], axis=0) for t in tables])

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 4096):
            bits = np.frombuffer(bytes.fromhex("".join(column(batch, "fingerprint").to_pylist())), np.uint8).reshape(-1, BITS // 8)
            rows = pa.table({"print": [b.tobytes() for b in bits], "n": column(batch, "n"), "first": column(batch, "first")})
            for t, mask in enumerate(keys):
                key = mixed(np.ascontiguousarray(bits & mask).view(np.uint64)[:, 0], t) + mixed(np.ascontiguousarray(bits & mask).view(np.uint64)[:, 1], t + len(keys))
                full = rows.append_column("key", pa.array(key.view(np.int64))).append_column("t", pa.array(np.full(len(bits), t, np.int32)))
                yield from full.to_batches()

    members = materialise(classes.mapInArrow(bucketed, "print binary, n long, first long, key long, t int"), "buckets")
    hot = members.groupBy("t", "key").agg(F.count("*").alias("_size")).where(F.col("_size") > PIECE).withColumnsRenamed({"t": "_t", "key": "_key"})
    met = members.join(hot, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")), "left").withColumn("pieces", F.coalesce(F.ceil(F.col("_size") / PIECE).cast("long"), F.lit(1)))
    met = met.withColumn("piece", F.pmod(F.xxhash64("print"), F.col("pieces"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    met = met.withColumns({"low": F.least("piece", "other"), "high": F.greatest("piece", "other")})
    met = met.select(F.xxhash64("t", "key", "low", "high").alias("at"), "t", "low", "high", "piece", "print", "n", "first")
    found = met.repartition("at").sortWithinPartitions("at", "t", "low", "high").mapInArrow(comparer(tables, masks, radius), "fingerprint string, n long, first long")
    found = found.withColumn("first", F.nullif("first", F.lit(NONE)))
    return classes.unionByName(found).groupBy("fingerprint").agg(F.sum("n").alias("n_near"), F.min("first").alias("near_id"))


#: Runs of up to so many rows are compared all at once, place by place.
SHORT = 32


def comparer(tables: list[tuple[int, ...]], masks: np.ndarray, radius: int):
    """Near pairs within runs of equal ``at``, t, low and high: for each member that has any, the rows they stand for and their smallest id."""
    sets = masks.view(np.uint64).reshape(-1, 2)
    own = np.array([sum(1 << k for k in t) for t in tables])
    below = np.array([(1 << (max(t) + 1)) - 1 for t in tables])

    class Rows:
        def __init__(self, table: pa.Table):
            self.names = table["print"].to_pylist()
            self.bits = np.frombuffer(b"".join(self.names), np.uint64).reshape(-1, 2)
            self.t, self.piece, self.n = (table[c].to_numpy() for c in ("t", "piece", "n"))
            self.first = pc.fill_null(table["first"], NONE).to_numpy()
            keys = [table[c].to_numpy() for c in ("at", "t", "low", "high")]
            self.across = keys[2] != keys[3]
            self.run = np.cumsum(np.concatenate([[False], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            self.near, self.smallest = np.zeros(len(self.t), np.int64), np.full(len(self.t), NONE)

        def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
            """Enter those pairs that are near and meet in no earlier table."""
            ok = (np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(1, dtype=np.int32) <= radius) & (~self.across[i] | (self.piece[i] != self.piece[j]))
            i, j = i[ok], j[ok]
            diff, t = self.bits[i] ^ self.bits[j], self.t[i]
            agree = sum(((diff & s) == 0).all(1).astype(np.int64) << k for k, s in enumerate(sets))
            ok = (agree & below[t]) == own[t]
            for x, y in ((i[ok], j[ok]), (j[ok], i[ok])):
                np.add.at(self.near, x, self.n[y])
                np.minimum.at(self.smallest, x, self.first[y])

        def found(self) -> pa.RecordBatch:
            starts = np.flatnonzero(np.diff(self.run, prepend=-1))
            sizes = np.diff(np.append(starts, len(self.run)))
            short = (sizes <= SHORT)[self.run]
            for d in range(1, min(SHORT, int(sizes.max(initial=1)))):
                i = np.flatnonzero((self.run[d:] == self.run[:-d]) & short[d:])
                self.pairs(i, i + d)
            for k in np.flatnonzero(sizes > SHORT).tolist():
                rows = np.arange(starts[k], starts[k] + sizes[k])
                for lo in range(0, len(rows), 64):
                    a = rows[lo : lo + 64]
                    close = np.bitwise_count(self.bits[a, None] ^ self.bits[None, rows]).sum(2, dtype=np.int32) <= radius
                    i, j = np.nonzero(close)
                    i, j = a[i], rows[j]
                    self.pairs(i[i < j], j[i < j])
            hit = np.flatnonzero(self.near)
            return pa.RecordBatch.from_arrays([pa.array([self.names[k].hex() for k in hit], pa.string()), pa.array(self.near[hit]), pa.array(self.smallest[hit])], ["fingerprint", "n", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = column(batch, "at").to_numpy()
            last = int(np.searchsorted(at, at[-1])) if len(at) else 0  # the run at the end may go on
            if held and last == 0 and column(held[-1], "at")[-1].as_py() == at[0] if len(at) else True:
                held += [batch] if len(at) else []
                continue
            yield Rows(pa.Table.from_batches([*held, batch.slice(0, last)])).found()
            held = [batch.slice(last)]
        if held:
            yield Rows(pa.Table.from_batches(held)).found()

    return run


def document_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprint every whole text and its edited text, and count the documents with near fingerprints.

    Args:
        docs: doc_id and text; further columns may have any name and are not read.
        radius: bits that may differ between near fingerprints.
    Returns:
        doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (32 hexadecimal digits), near_edited and near_next
        (share of equal bits with the edited text and with the next document), n_near (other documents within the radius)
        and near_id (the smallest doc_id within it, its own included). The next document is the one with the next smaller
        doc_id, after the last one the first; equal doc_ids are rows of their own, in the order of their texts' hashes, and
        a null doc_id comes last. A null text is an empty one; texts without words have no votes and a fingerprint of
        zeros. A table of one row has itself as the next document; an empty one gives an empty one.
    """
    rows = fingerprint_documents(docs)
    near = near_fingerprints(rows.select(F.col("doc_id").alias("id"), "fingerprint"), radius)
    return rows.join(near, "fingerprint").select(*COLUMNS, (F.col("n_near") - 1).alias("n_near"), "near_id")
