"""Near-duplicate texts by an exact Jaccard join on word n-grams, with rare-first prefix filtering.

Equal sets are one class. The n-grams of a class are ordered from rare to frequent, by how many classes have them, and
only its prefix is joined: two sets as similar as asked share an n-gram of their prefixes. Counts are exact: blocks of
classes send the short keys of their n-grams, packed, to shards of all keys and get the counts back. An n-gram that one
class alone has can't be shared, so such n-grams are not joined, and the length and positional filters leave them out
of what two sets may share. Candidates pass these filters, a count of what their prefixes share and, before their sets
are compared, a suffix filter; each pair is verified once. Links matter for components alone, so a list of classes that
share an n-gram first offers each of them to one centre of its size. Components that are still apart do so again, each
with its best offer, while that links any; only classes which that leaves in different components are then paired with
each other, where signatures of their sets don't differ too much. Sets are made for the classes of candidates alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, few, keep_only, map_arrow, materialise, runs_of, text_columns, texts_of
from .components import connected_components

WORDS = 5
#: Similarity asked: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bits of an n-gram's key, by which it is counted. Keys that clash make counts too high, which costs time, not links.
KEY_BITS = 48
#: N-grams of a block of classes, and of a shard of keys, on average.
BLOCK_GRAMS = 1_000_000
#: A list of classes that may be longer than this is cut by hash.
HOT_LIST = 1000
#: Rounds of offers to centres, at most; what they leave apart is paired in full.
ROUNDS = 3
#: Columns of 64 bits each that tell which sets differ too much to be compared.
SIGNATURE = tuple(f"s{k}" for k in range(16))
#: Bits of the filter that finds the texts of candidates before they are joined.
BLOOM_BITS = 24
#: Texts that a task works on at once, and bytes whose words it hashes at once.
TOGETHER, CHUNK = 500, 1 << 20
#: Parts in which the suffix filter compares two sets.
PARTS = 64

WHITE = b" \t\n\v\f\r"
IS_WHITE = np.isin(np.arange(256), list(WHITE))
NEXT_WHITE = re.compile(rb"[ \t-\r]")
#: A 64-bit number for each byte, the same for a letter in either case.
OF_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
BASE = 0x9E3779B97F4A7C15
ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base & (2**64 - 1), np.uint64))])


_powers = powers(BASE, CHUNK), powers(pow(BASE, -1, 2**64), CHUNK)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[1]
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, lower-cased in A-Z, and where they start; chunks end at white space."""
    hashes, starts, lo = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while lo < len(data):
        hi = min(len(data), lo + CHUNK)
        if hi < len(data) and (cut := max(data.rfind(w, lo, hi) for w in WHITE)) >= lo:
            hi = cut + 1
        elif hi < len(data):
            gap = NEXT_WHITE.search(data, hi)
            hi = gap.end() if gap else len(data)
        part = np.frombuffer(data, np.uint8, hi - lo, lo)
        up, down = _powers if len(part) <= CHUNK else (powers(BASE, len(part)), powers(pow(BASE, -1, 2**64), len(part)))
        white = np.concatenate([[True], IS_WHITE[part], [True]])
        edge = np.flatnonzero(white[1:] != white[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(OF_BYTE[part] * up[: len(part)])])
        hashes.append(mixed((total[end] - total[start]) * down[start]))
        starts.append(start + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(starts)


def gram_sets(texts: list[str | bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams, one text after the other, and how many each has.

    A text of fewer words than ``words`` is one n-gram; one without words has none.
    """
    data = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, data), np.int64, len(data)) + 1
    h, start = word_hashes(b"\n".join(data))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))
    many = np.diff(first)

    def rolled(part: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(part) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ (out >> np.uint64(29))) * ODD[0] + part[k : len(part) - n + 1 + k]
        return mixed(out)

    grams = np.where(many >= words, many - words + 1, np.minimum(many, 1))
    at = np.cumsum(grams) - grams
    out = np.empty(int(grams.sum()), np.uint64)
    if len(h) >= words:
        every = rolled(h, words)
        owner = np.repeat(np.arange(len(texts)), many)
        out[np.repeat(many >= words, grams)] = every[owner[: len(every)] == owner[words - 1 :]]
    for k in np.flatnonzero((many > 0) & (many < words)):
        out[at[k]] = rolled(h[first[k] : first[k + 1]], int(many[k]))[0]
    for a, b in zip(at.tolist(), (at + grams).tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[grams > 0]] = True
    distinct = np.concatenate([[0], np.cumsum(new)])
    return out[new], distinct[at + grams] - distinct[at]


def gram_sets_of_many(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """``gram_sets``, few texts at a time."""
    parts = [gram_sets(texts[lo : lo + TOGETHER], words) for lo in range(0, len(texts), TOGETHER)]
    return (np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def sets_of_texts(texts: list[str | bytes], words: int = WORDS) -> list[np.ndarray]:
    grams, size = gram_sets(texts, words)
    return np.split(grams, np.cumsum(size)[:-1]) if len(size) else []


def class_of(grams: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return int(np.array(xxhash.xxh3_64_intdigest(grams.tobytes()), np.uint64).astype(np.int64))


def least_overlap(n: Column, m: Column) -> Column:
    """The smallest intersection of sets of n and m n-grams that is similar enough."""
    return F.ceil(PERCENT * (n + m) / (100 + PERCENT))


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n and class of each document; row and text, compressed, for the first one of a class that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("words")
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        row = TaskContext.get().partitionId() << 40
        for batch in few(batches, TOGETHER):
            texts, ids = texts_of(batch), column(batch, "doc_id").cast("int64")
            sets = sets_of_texts(texts, words)
            names = list(map(class_of, sets))
            new = []
            for name, own, known in zip(names, sets, ids.is_valid().to_pylist(), strict=True):
                new.append(len(own) > 0 and known and name not in seen)
                if new[-1]:
                    seen.add(name)
            rows = [row + k if one else None for k, one in enumerate(new)]
            row += len(rows)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array(rows, pa.int64()), pa.array([pack(t.encode("utf-8", "surrogatepass")) if one else None for t, one in zip(texts, new, strict=True)], pa.binary())], ["doc_id", "n", "class", "row", "text"])

    return text_columns(docs).mapInArrow(run, "doc_id long, n long, class long, row long, text binary")


def keys_of(grams: np.ndarray) -> np.ndarray:
    return grams >> np.uint64(64 - KEY_BITS)


def shard_edges(shards: int) -> np.ndarray:
    return (np.arange(1, shards) * (2.0**KEY_BITS / shards)).astype(np.uint64)


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers by bytes of equal weight, compressed: small numbers leave the high ones empty."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def unplaned(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T).view(dtype).ravel()


def distinct_texts(batches: list[pa.RecordBatch]) -> tuple[list[int], list[bytes]]:
    """Classes and texts of a block's rows, one of each class."""
    found: dict[int, bytes] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for name, text in zip(column(batch, "class").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            if text is not None:
                found[name] = unpack(text)
    return list(found), list(found.values())


def first_of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by block and class, without texts that repeat the class of the row before."""
    before = None
    for batch in batches:
        name, text = column(batch, "class").to_numpy(zero_copy_only=False), column(batch, "text").is_valid().to_numpy(zero_copy_only=False)
        keep = np.ones(len(name), bool)
        keep[1:] = ~text[1:] | (name[1:] != name[:-1])
        keep[:1] = ~text[:1] | (name[:1] != before)
        before = name[-1] if len(name) else before
        yield batch.filter(pa.array(keep))


def gram_counts(rows: DataFrame, shards: int, words: int) -> DataFrame:
    """block, shard and counts: for the sorted distinct keys of a block in a shard, how many classes have each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("words")
        for block, held in runs_of(first_of_class(batches), "block"):
            keys, many = np.unique(keys_of(gram_sets_of_many(distinct_texts(held)[1], words)[0]), return_counts=True)
            cut = np.concatenate([[0], np.searchsorted(keys, shard_edges(shards)), [len(keys)]])
            full = np.flatnonzero(np.diff(cut))
            blobs = [(planes(np.diff(keys[cut[k] : cut[k + 1]], prepend=np.uint64(0))), planes(many[cut[k] : cut[k + 1]].astype("<u4"))) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int64()), pa.array([k for k, _ in blobs], pa.binary()), pa.array([m for _, m in blobs], pa.binary())], ["block", "shard", "keys", "many"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in runs_of(batches, "shard"):
            blocks = [b for batch in held for b in column(batch, "block").to_pylist()]
            keys = [np.cumsum(unplaned(k, "<u8")) for batch in held for k in column(batch, "keys").to_pylist()]
            many = [unplaned(m, "<u4") for batch in held for m in column(batch, "many").to_pylist()]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, np.concatenate(many), len(distinct)).astype("<u4")[place]
            parts = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([shard] * len(blocks), pa.int64()), pa.array([planes(p) for p in parts], pa.binary())], ["block", "shard", "counts"])

    asked = rows.repartition("block").sortWithinPartitions("block", "class").mapInArrow(ask, "block long, shard long, keys binary, many binary")
    return asked.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(add, "block long, shard long, counts binary")


def prefixes(rows: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """gram, class, n, shared (n-grams that other classes have too) and pos (among these) for the prefix of each class that may link; salt cuts lists that may be long."""
    both = rows.withColumns({"shard": F.lit(None).cast("long"), "counts": F.lit(None).cast("binary")}).unionByName(counts, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("words")
        for _, held in runs_of(first_of_class(batches), "block"):
            names, texts = distinct_texts(held)
            counted = sorted((s, c) for batch in held for s, c in zip(column(batch, "shard").to_pylist(), column(batch, "counts").to_pylist(), strict=True) if s is not None)
            count = np.concatenate([unplaned(c, "<u4") for _, c in counted])
            grams, size = gram_sets_of_many(texts, words)
            count = count[np.unique(keys_of(grams), return_inverse=True)[1]]
            out: list[tuple[np.ndarray, ...]] = []
            for name, n, end in zip(names, size.tolist(), np.cumsum(size).tolist(), strict=True):
                own, many = grams[end - n : end], count[end - n : end]
                alone = int((many == 1).sum())
                if n - alone < -(-PERCENT * n // 100):
                    continue
                order = np.argsort(many, kind="stable")[alone : n - -(-PERCENT * n // 100) + 1]
                lists = -(-many[order].astype(np.int64) // HOT_LIST)
                salt = np.where(lists > 1, 1 + (name & 0x7FFFFFFF) % lists, 0)
                k = len(order)
                out.append((own[order].astype(np.int64), salt, np.full(k, name), np.full(k, n), np.full(k, n - alone), np.arange(k)))
            if out:
                gram, salt, name, n, shared, pos = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(salt.astype(np.int32)), pa.array(name), *(pa.array(x.astype(np.int32)) for x in (n, shared, pos))], ["gram", "salt", "class", "n", "shared", "pos"])

    return both.repartition("block").sortWithinPartitions("block", "class").mapInArrow(run, "gram long, salt int, class long, n int, shared int, pos int")


def shared_grams(rows: DataFrame) -> DataFrame:
    """Prefix rows, without repeats, whose gram at least two classes have; all rows of lists that were cut."""
    ranged = rows.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, whose list may go on
        before = False  # whether the row ahead of it is of its list

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            gram, salt, name = (column(batch, c).to_numpy() for c in ("gram", "salt", "class"))
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]) | (name[1:] != name[:-1])
            rows = np.flatnonzero(new)
            gram, salt = gram[rows], salt[rows]
            same = (gram[1:] == gram[:-1]) & (salt[1:] == salt[:-1])
            keep = np.zeros(len(rows), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep |= salt > 0
            keep[0] |= before
            before = bool(same[-1]) if len(same) else before
            held = batch.slice(rows[-1], 1)
            if (kept := rows[:-1][keep[:-1]]).size:
                yield batch.take(pa.array(kept))
        if held is not None and (before or column(held, "salt")[0].as_py() > 0):
            yield held

    return ranged.mapInArrow(run, "gram long, salt int, class long, n int, shared int, pos int").select("gram", *ROW)


#: What a list knows of a class.
ROW = ("n", "class", "shared", "pos")


def possible(other: str) -> Column:
    """Length filter, and positional filter: no more can be shared than what others have too before and behind a shared gram."""
    n, shared, pos, m, o_shared, at = (F.col(c) for side in ("", other) for c in (f"{side}n", f"{side}shared", f"{side}pos"))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (F.least(pos, at) + F.least(shared - pos, o_shared - at) >= least_overlap(n, m))


def signatures(sets: DataFrame) -> DataFrame:
    """class and SIGNATURE: for each hash of an n-gram whether the set has an odd number of such n-grams."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            odd = [np.bincount((np.frombuffer(g, "<u8") & np.uint64(64 * len(SIGNATURE) - 1)).astype(np.int64), minlength=64 * len(SIGNATURE)) & 1 for g in column(batch, "grams").to_pylist()]
            bits = np.packbits(np.array(odd, np.uint8), axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([column(batch, "class"), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(SIGNATURE)))], ["class", *SIGNATURE])

        return each

    return map_arrow(sets, make, "class long, " + ", ".join(f"{c} long" for c in SIGNATURE))


def few_unlike(other: str) -> Column:
    """N-grams that one of two sets has are at least as many as bits in which their signatures differ; similar sets have few."""
    differ = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{other}{c}"))) for c in SIGNATURE)
    n, m = F.col("n"), F.col(f"{other}n")
    return differ <= n + m - 2 * least_overlap(n, m)


def ordered_pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def overlap_possible(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Suffix filter: pivots cut both sets into parts, and no part shares more than its smaller side has."""
    cut = 64 - PARTS.bit_length() + 1
    a, b = (np.bincount((s >> np.uint64(cut)).astype(np.int64), minlength=PARTS) for s in (x, y))
    return int(np.minimum(a, b).sum()) >= least


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    least = -(-PERCENT * (len(x) + len(y)) // (100 + PERCENT))
    if min(len(x), len(y)) < least or not overlap_possible(x, y, least):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("grams").alias("y")), "b")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist(), strict=True)]
            return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return each

    return map_arrow(both, make, "a long, b long")


def behind(n: Column) -> Column:
    """N-grams of a set behind its prefix."""
    return F.ceil(PERCENT * n / 100) - 1


def shared_in_prefixes(n: Column, m: Column) -> Column:
    """How many n-grams both prefixes have at least: of all that two sets share, the others lie behind the prefix that ends first."""
    return least_overlap(n, m) - F.greatest(behind(n), behind(m))


def early(other: str) -> Column:
    """Whether a gram can be the first that both prefixes have, as others must follow it there: so a pair is met at few of its grams."""
    n, m = F.col("n"), F.col(f"{other}n")
    more = F.greatest(shared_in_prefixes(n, m), F.lit(1))
    return (F.col("pos") + more <= F.col("shared") - behind(n)) & (F.col(f"{other}pos") + more <= F.col(f"{other}shared") - behind(m))


def maybe_among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose class's hash has its bit set by one of ``wanted``: a filter of 2 ** BLOOM_BITS bits."""
    place = F.pmod(F.xxhash64("class"), F.lit(1 << BLOOM_BITS))
    bits = np.zeros(1 << BLOOM_BITS, bool)
    # Spark's bitmaps number buckets and values from 1.
    maps = wanted.select((place + 1).alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("map"))
    for r in maps.collect():  # at most 2 ** (BLOOM_BITS - 15) rows
        at = (r["bucket"] - 1) << 15
        bits[at : at + (1 << 15)] |= np.unpackbits(np.frombuffer(bytes(r["map"]), np.uint8), bitorder="little").astype(bool)
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(own[column(batch, "h").to_numpy()])).select(["class", "row", "text"])

    return texts.select("class", "row", "text").withColumn("h", place).mapInArrow(run, "class long, row long, text binary")


def either(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()


def sets_of(texts: DataFrame, asked: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """class and grams of the classes ``asked`` for, each from the text of the row that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in few(batches, TOGETHER):
            sets = sets_of_texts([unpack(t) for t in column(batch, "text").to_pylist()], words)
            yield pa.RecordBatch.from_arrays([column(batch, "class"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["class", "grams"])

    wanted = materialise(asked.join(classes, "class").select("class", "row"), "wanted")
    maybe = materialise(maybe_among(texts, wanted), "maybe")  # written, so that no task holds two Python workers at once
    return maybe.join(wanted, ["class", "row"], "left_semi").mapInArrow(run, "class long, grams binary")


def jaccard_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Connected components of the documents whose word n-gram sets are similar.

    Args:
        docs: doc_id and text; other columns are ignored.
    Returns:
        doc_id, n_shingles, component_id (the smallest doc_id reachable by links), one row per row of ``docs``.

    A null or empty text, or one of white space alone, has an empty set and links with nothing; very long texts are
    read whole. Rows with a null doc_id take no part and have a null component. Rows that share a doc_id are one
    document: what one of them links with, all do. Equal texts are one class and link. An empty table gives an empty one.
    """
    description = materialise(described(docs, words), "described")
    each = description.select("doc_id", "n", "class")
    texts = description.where("text is not null")
    named = each.where("n > 0 and doc_id is not null")
    classes = materialise(description.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.min("row").alias("row")), "classes")
    total = texts.agg(F.sum("n")).first()[0] or 0
    blocks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / BLOCK_GRAMS))
    placed_texts = texts.select(F.pmod("class", F.lit(blocks)).alias("block"), "class", "text")
    counts = materialise(gram_counts(placed_texts, blocks, words), "counts")
    rows = materialise(shared_grams(prefixes(placed_texts, counts, words)), "prefixes")

    sized = F.floor(F.log("n") / F.log(F.lit(1.2)))
    placed = rows.withColumns({"part": F.col("class"), "size": sized})
    links, tried = None, None
    for turn in range(ROUNDS):
        # Each component with the centre, of a gram and a size, with which a class of it shares most.
        # The centre is of the component that the list has most of, so that the largest grows.
        by_part = placed.groupBy("gram", "size", "part").agg(F.count("*").alias("many"), F.min(F.struct(*ROW)).alias("c"))
        most = by_part.groupBy("gram", "size").agg(F.max(F.struct("many", "part", "c")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
        centres = materialise(most.select("gram", "size", F.col("m.part").alias("c_part"), *(F.col(f"m.c.{c}").alias(f"c_{c}") for c in ROW)), "centres")
        near = placed.join(centres, ["gram", "size"]).where((F.col("part") != F.col("c_part")) & possible("c_"))
        offers = near.groupBy("part", "class", "c_class").agg(F.count("*").alias("k"), F.min("n").alias("n"), F.min("c_n").alias("c_n"))
        if not turn:  # the clear cases first; a pair may share more than the lists that have the one as the other's centre
            offers = offers.where(F.col("k") >= shared_in_prefixes(F.col("n"), F.col("c_n")))
        offers = offers.select("part", "k", *ordered_pair(F.col("class"), F.col("c_class")))
        if tried is not None:
            offers = offers.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(offers.groupBy("part").agg(F.max(F.struct("k", "a", "b")).alias("best")).select("best.a", "best.b").distinct(), "pairs")
        new = materialise(verified(pairs, materialise(sets_of(texts, either(pairs), classes, words), "sets")), "links")
        links, tried = (new, pairs) if links is None else (links.unionByName(new), tried.unionByName(pairs))
        parts = materialise(connected_components(links), "parts").select(F.col("id").alias("class"), F.col("component_id").alias("part"))
        placed = materialise(rows.join(parts, "class", "left").withColumns({"part": F.coalesce("part", "class"), "size": sized}), "placed")
        if new.isEmpty():
            break

    # Classes that share a gram and are still apart.
    apart = materialise(placed.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("gram"), "apart")
    left = materialise(placed.join(apart, "gram", "left_semi"), "left")
    sets = materialise(sets_of(texts, left.select("class").distinct(), classes, words), "sets")
    left = materialise(left.join(signatures(sets), "class"), "signed")
    right = left.select("gram", *(F.col(c).alias(f"o_{c}") for c in (*ROW, "part", *SIGNATURE)))
    cross = left.join(right, "gram").where((F.col("class") < F.col("o_class")) & (F.col("part") != F.col("o_part")) & early("o_") & possible("o_") & few_unlike("o_"))
    more_pairs = materialise(cross.select(F.col("class").alias("a"), F.col("o_class").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(materialise(verified(more_pairs, sets), "links"))

    # Rows that share a doc_id link their classes.
    reused = named.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("k")).where("a < b")
    same = reused.select("doc_id", "a").join(each, "doc_id").select("a", F.col("class").alias("b"))
    parts = materialise(connected_components(links.unionByName(same)), "parts").select(F.col("id").alias("class"), F.col("component_id").alias("part"))
    merged = materialise(classes.join(parts, "class", "left").withColumn("part", F.coalesce("part", "class")), "named")
    smallest = materialise(merged.groupBy("part").agg(F.min("first").alias("component_id")), "smallest")
    found = materialise(merged.join(smallest, "part").select("class", "component_id"), "found")
    linked = named.join(found, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(each.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each group of similar documents, one of the smallest doc_id; other rows and all columns as they are.

    Of rows that share that doc_id the one of the smallest text stays. Null, empty and blank texts are like no other,
    so that their rows stay, one for each doc_id; rows with a null doc_id all stay. An empty table gives an empty one.
    """
    kept = materialise(jaccard_components(docs, words).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
    once = docs.join(kept.where("rows = 1"), "doc_id", "left_semi")
    more = docs.join(kept.where("rows > 1"), "doc_id", "left_semi")
    one = more.groupBy("doc_id").agg(F.min_by(F.struct("*"), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return once.unionByName(one).unionByName(docs.where("doc_id is null"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), reach AS (
  SELECT a AS id, a AS other FROM link
  UNION
  SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a
), part AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(p.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN part p ON p.id = w.doc_id
"""
