"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs ``n + n * n / ATTENTION_SCALE``: the linear layers and attention within the piece. Each task
packs its documents in windows of a bounded number of tokens, so nothing is shuffled and no group can grow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import column, text_columns, texts_of
from .subwords import run_encoder

SEQUENCE_TOKENS = 2048
ATTENTION_SCALE = 4096.0
#: Tokens that a task holds before it packs them. A window pads less than one sequence.
WINDOW_TOKENS = 4_000_000
#: Runs that a worker knows in each generation; packing needs little memory besides.
KNOWN_RUNS = 250_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_tokens long"


def pack_lengths(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pack documents of the given lengths; returns pieces (document, start, length, sequence, offset) and fills.

    Whole sequences are cut off the front of long documents. The rests go, longest first, to the sequence of lowest
    cost that can still hold them; a rest that fits nowhere is cut at the emptiest sequence. There are as few
    sequences as the tokens allow, so less than one sequence is padding.
    """
    pieces, fills, rests = [], [], []
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, len(fills), 0))
            fills.append(capacity)
        if n % capacity:
            rests.append((n % capacity, d, whole * capacity))
    if not rests:
        return pieces, fills
    first = len(fills)
    room = np.full(-(-sum(r[0] for r in rests) // capacity), capacity, np.int64)
    cost = np.zeros(len(room))
    rests.sort(key=lambda r: (-r[0], r[1]))
    for n, d, start in rests:
        while n:
            fits = room >= n
            at = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            take = min(n, int(room[at]))
            pieces.append((d, start, take, first + at, capacity - int(room[at])))
            room[at] -= take
            cost[at] += take + take * take / ATTENTION_SCALE
            n, start = n - take, start + take
    return pieces, fills + (capacity - room).tolist()


def padded(length: int, capacity: int) -> int:
    """Padding fills a sequence up, except at a power of two."""
    return length if length & (length - 1) == 0 else capacity


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", spaced: bool = False, end_id: int = 1, capacity: int = SEQUENCE_TOKENS, window: int = WINDOW_TOKENS, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, append ``end_id`` and pack all tokens into sequences of ``capacity``.

    Returns one row per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id, offset, padded_tokens of its sequence, and with ``with_ids`` the ids themselves. A null or empty
    text is the end id alone; repeated rows and equal doc_ids are documents of their own; null doc_ids stay null;
    an empty table gives no piece.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = run_encoder(tokenizer, spaced, KNOWN_RUNS).encode
        sequence = TaskContext.get().partitionId() << 32
        keys: list = []
        held: list[bytes] = []
        tokens = 0

        def pack() -> pa.RecordBatch:
            nonlocal sequence
            pieces, fills = pack_lengths([len(x) // 4 for x in held], capacity)
            cut = [held[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            d, s, n, q, o = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            out = {
                "doc_id": pa.array([keys[i] for i in d], pa.int64()), "start": pa.array(s), "length": pa.array(n), "ids_crc32": pa.array(map(zlib.crc32, cut), pa.int64()),
                "doc_tokens": pa.array(np.array([len(x) // 4 for x in held], np.int64)[d]), "sequence_id": pa.array(q + sequence), "offset": pa.array(o),
                "padded_tokens": pa.array(np.array([padded(x, capacity) for x in fills], np.int64)[q]),
            }
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(x, "<i4") for x in cut], pa.list_(pa.int32()))
            sequence += len(fills)
            return pa.RecordBatch.from_arrays(list(out.values()), list(out))

        for batch in batches:
            for key, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = encode(text) + end
                keys.append(key)
                held.append(ids)
                tokens += len(ids) // 4
                if tokens >= window:
                    yield pack()
                    keys, held, tokens = [], [], 0
        if held:
            yield pack()

    return text_columns(docs).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
