"""Operator 13 against the libraries and a comparison of every token with every other."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from riskflow.llm import alignment as al
from riskflow.llm.subwords import BYTE_NAMES, tokenizer_path

from .data import table, texts

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["", "a", " ", "   ", "a  b", "a   ", "  a", "<|endoftext|> x <s></s>", "▁x", "x▁ y", "日本語 text é ü x　", "\0x", "\n\n\tx \r\n", "é ﬁ ½", "😀😀 z", "don't we'll", "▁", "a \n  b", "a\n  b", "a\n \n b", "x\t y", "x\n ", "a\x1c  b", "　 　 x", "é a‍b"]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(tokenizer_path(A)), SentencePieceProcessor(model_file=tokenizer_path(B))
    a.encode_special_tokens = True
    byte_of = {c: x for x, c in BYTE_NAMES.items()}
    name_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    name_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, name_a, name_b


def compared(text, libraries):
    """n_a, n_b, n_groups, the digest and the linked ids of a text."""
    a, b, name_a, name_b = libraries
    if not text:
        return 0, 0, 0, "", []
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    names = [name_a(i) for i in ids[0]], [name_b(i) for i in ids[1]]
    if any(b"".join(x) != (" " + text).encode() for x in names):
        return 0, 0, 0, "", []
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in names]
    spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
    low, groups = 0, []
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append("|".join(",".join(str(i) for i, e in zip(x, y, strict=True) if low < e <= cut) for x, y in zip(ids, ends, strict=True)))
        low = cut
    links = [(i, j) for i, (s, e) in zip(ids[0], spans[0], strict=True) for j, (p, q) in zip(ids[1], spans[1], strict=True) if s < q and p < e]
    return len(ids[0]), len(ids[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def linked(found, k):
    at = np.concatenate([[0], np.cumsum(found.links)])
    return sorted((int(p >> 32), int(p & 0xFFFFFFFF)) for p in found.pairs[at[k] : at[k + 1]])


def test_batches_align_as_the_libraries_do(libraries, monkeypatch):
    batch = ODD + [(t or "")[:1500] for _, t in texts()]
    both = al.tokenizers(A, B)
    for tokens in (400_000, 60):  # in one piece and cut between groups
        monkeypatch.setattr(al, "JOINED_TOKENS", tokens)
        found = al.Aligned(batch, both)
        for k, text in enumerate(batch):
            *want, links = compared(text, libraries)
            assert [found.n[0][k], found.n[1][k], found.groups[k], found.digests[k]] == want
            assert linked(found, k) == sorted(links)


def test_runs_that_are_dropped_are_learnt_again(monkeypatch):
    monkeypatch.setattr(al, "KEPT_RUNS", 20)
    batch = [(t or "")[:3000] for _, t in texts()]
    both, whole = al.Tokenizers(tokenizer_path(A), tokenizer_path(B)), al.tokenizers(A, B)
    for lo in range(0, len(batch), 5):
        for one, other in zip(both.encode_batch(batch[lo : lo + 5]), whole.encode_batch(batch[lo : lo + 5]), strict=True):
            assert one[0].tolist() == other[0].tolist() and one[1].tolist() == other[1].tolist()


def test_a_book_gives_each_pair_one_place():
    book = al.Book(3)
    first = book.places_of(np.array([7, 7, 9, 1 << 40]))
    again = book.places_of(np.array([1 << 40, 9, 5]))
    assert first[0] == first[1] and again[0] == first[3] and again[1] == first[2]
    assert dict(zip(book.pairs.tolist(), book.counts.tolist(), strict=True)) == {7: 2, 9: 2, 1 << 40: 2, 5: 1}
    places = np.array([0, 1, 255, 256, 70_000, 2**31])
    assert al.from_planes(al.planes(places)).tolist() == places.tolist()


def test_whole_table(spark, libraries):
    """Nulls, repeats (which count each time), long and odd texts, and columns of clashing names."""
    rows = [(i, t if len(t or "") < 9000 else t[:9000]) for i, t in texts()] + [(300 + k, t) for k, t in enumerate(ODD)]
    wanted = [(i, *compared(t or "", libraries)) for i, t in rows]
    counts = Counter(p for w in wanted for p in w[-1])
    best: dict = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter((i, na, nb, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha) for i, na, nb, g, sha, links in wanted)
    got = al.align_tokens(table(spark, rows).repartition(5)).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


def test_empty_table(spark):
    assert al.align_tokens(table(spark, [])).count() == 0
    assert [tuple(r) for r in al.align_tokens(table(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
