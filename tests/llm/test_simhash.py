"""Operator 11 against fingerprints voted bit by bit and a comparison of all pairs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from riskflow.llm import simhash as sh

from .data import prose, table, texts

MASK = (1 << 64) - 1


def mix(x, seed):
    x ^= seed
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * factor) & MASK
    return x ^ (x >> 33)


def voted(text):
    """The fingerprint of a text, one vote after the other."""
    words = [xxhash.xxh64_intdigest(w) for w in text.encode().lower().split()]
    parts = [words[k : k + 5] for k in range(max(1, len(words) - 4))] if words else []
    hashes = Counter((len(p) * int(sh._WHOLE) + sum(mix(w, k) * int(sh._MULTIPLIERS[k]) for k, w in enumerate(p))) & MASK for p in parts)
    votes = [0] * 128
    for h, n in hashes.items():
        bits = b"".join(mix(h, seed).to_bytes(8, "little") for seed in (1, 2))
        for k in range(128):
            votes[k] += n.bit_length() if bits[k // 8] >> (7 - k % 8) & 1 else -n.bit_length()
    return "".join(f"{sum((votes[8 * k + b] > 0) << (7 - b) for b in range(8)):02x}" for k in range(16))


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_bits_are_voted():
    batch = [(t or "")[:4000] for _, t in texts()] + ["one", "One", "a b c d", "a b c d e", "x " * 300, "É é"]
    assert [p.tobytes().hex() for p in sh.fingerprints(batch)] == [voted(t) for t in batch]
    assert voted("") == voted(" \n") == "0" * 32 and voted("One") == voted("one") != voted("two")


def test_blocks_of_votes_add_up(monkeypatch):
    text = prose(9, 3000)
    whole = sh.fingerprints([text])
    monkeypatch.setattr(sh, "VOTERS", 64)
    assert (sh.fingerprints([text]) == whole).all()


def check(rows, got):
    """All columns of every row, whose order is known for distinct ids."""
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    prints = {t: voted(t) for _, t in order}
    assert len(got) == len(order)
    found = {r.doc_id: r for r in got}
    for k, (i, text) in enumerate(order):
        following, r = order[(k + 1) % len(order)][1], found[i]
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[text], voted(changed))
        assert r.near_edited == 1 - distance(prints[text], voted(changed)) / 128
        assert r.near_next == 1 - distance(prints[text], prints[following]) / 128
        near = [j for j, t in order if distance(prints[text], prints[t]) <= sh.RADIUS]
        assert (r.n_near, r.near_id) == (len(near) - 1, min(near))


@pytest.mark.parametrize("parts", [1, 7])
def test_whole_table(spark, parts):
    rows = {i: (t or "")[:5000] or None for i, t in texts() if i is not None}
    got = sh.document_fingerprints(table(spark, list(rows.items())).repartition(parts)).collect()
    check(list(rows.items()), got)
    assert {r.doc_id: r.near_edited for r in got}[2] == 1.0  # empty


def test_repeats_and_nulls(spark):
    rows = [(5, "b c"), (5, "b c"), (None, "x y z"), (None, None), (7, "q"), (5, "a")]
    got = sh.document_fingerprints(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert {r.n_near for r in got if r.doc_id == 5 and r.n_chars == 3} == {1}
    assert sh.document_fingerprints(table(spark, [])).count() == 0
    check([(4, "just one row")], sh.document_fingerprints(table(spark, [(4, "just one row")])).collect())


@pytest.mark.parametrize("piece", [2048, 16])
@pytest.mark.parametrize("blocks", [1, 2])
def test_tables_find_all_pairs(spark, monkeypatch, piece, blocks):
    """Clusters with up to nine flipped bits, a large one among them, ids that are null, and prints that differ far away in one block."""
    r = random.Random(3)
    rows = []
    for size in [90, 40, *[3] * 40]:
        base = r.getrandbits(128)
        rows += [base ^ sum(1 << b for b in r.sample(range(128), r.randint(0, 4))) for _ in range(size)]
    shared = r.getrandbits(40)
    rows += [shared << 88 | r.getrandbits(88) for _ in range(80)]
    rows = [(k if k % 17 else None, f"{x:032x}") for k, x in enumerate(rows + rows[:5])] + [(999, None)]
    monkeypatch.setattr(sh, "PIECE", piece)
    own = sh.blocks_of
    monkeypatch.setattr(sh, "blocks_of", lambda radius, n: own(radius, 1 << (18 if blocks == 1 else 26)))
    assert len(sh.blocks_of(6, 1)[1]) == (7 if blocks == 1 else 28)
    got = {x.fingerprint: (x.n_near, x.near_id) for x in sh.near_fingerprints(spark.createDataFrame(rows, "id long, fingerprint string")).collect()}
    for _, p in rows[:-1]:
        near = [i for i, q in rows[:-1] if distance(p, q) <= 6]
        assert got[p] == (len(near), min((i for i in near if i is not None), default=None))
    assert len(got) == len({p for _, p in rows[:-1]})


def test_more_blocks_for_larger_tables():
    sizes = [len(sh.blocks_of(6, n)[1]) for n in (10, 10**5, 10**8, 10**10)]
    assert sizes == sorted(sizes) and sizes[0] == 7 and sizes[-1] == 28
    assert sum(n for _, n in sh.blocks_of(6, 10**10)[0]) == 128
    assert np.bitwise_or.reduce(sh._masks(sh.blocks_of(6, 10)[0])).tolist() == [255] * 16
