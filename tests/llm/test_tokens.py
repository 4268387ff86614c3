"""Operators 3, 5 and 9 against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskflow.llm.bpe import bpe_digests, bpe_round_trip, prefix_bpe
from riskflow.llm.common import scratch_path
from riskflow.llm.packing import pack_documents, pack_lengths, padded
from riskflow.llm.subwords import run_encoder, tokenizer_path
from riskflow.llm.token_files import read_token_files, token_round_trip, write_token_files

from .data import table, texts

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def ids_of(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def odd_texts(n=400):
    r = random.Random(5)
    return ["".join(r.choice("aabbeéntThHiIs.,'\"\n\t 0123Σ²ß") for _ in range(r.randint(1, 200))) for _ in range(n)] + ["".join(chr(r.randrange(1, 0x250)) for _ in range(80)) for _ in range(n)]


@pytest.mark.parametrize(("name", "spaced"), [(BYTE, True), (WORD, False)])
def test_runs_give_the_ids_of_the_library(name, spaced):
    encode, _ = ids_of(name)
    own = run_encoder(name, spaced, 50)  # small, so that generations change
    for text in odd_texts() + [t or "" for _, t in texts()]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == encode(text)


def test_prefix_programme_gives_the_ids_of_the_library():
    encode, decode = ids_of(WORD)
    model = prefix_bpe(tokenizer_path(WORD))
    for text in odd_texts() + [t or "" for _, t in texts() if len(t or "") < 5000]:
        ids, decoded = model.encode_decode(text)
        assert ids == " ".join(map(str, encode(text)))
        assert decoded == decode(encode(text))


def test_round_trip_of_a_table(spark):
    encode, decode = ids_of(WORD)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((i, len(e := encode(t)), sha(" ".join(map(str, e))), sha(decode(e))) for i, t in texts())
    assert Counter(tuple(r) for r in bpe_digests(table(spark)).collect()) == want
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe_round_trip(table(spark, [(4, "one two"), (1, None)])).collect()}
    assert got == {4: (encode("one two"), decode(encode("one two"))), 1: ([], "")}
    assert bpe_digests(table(spark, [])).count() == 0


def test_token_files_are_in_order_and_whole(spark):
    encode, _ = ids_of(BYTE)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_round_trip(table(spark)).collect()))
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [g[1] for g in got] == sorted((g[1] for g in got), key=lambda i: (i is not None, i or 0))
    want = Counter((i, len(e := [*encode(t), 0]), zlib.crc32(np.array(e, "<u4").tobytes())) for i, t in texts())
    assert Counter(g[1:] for g in got) == want
    assert token_round_trip(table(spark, [])).count() == 0


def test_token_files_give_single_columns(spark):
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark), path)
    plan = read_token_files(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("Physical Plan")[-1].split("ReadSchema")[1].split("\n")[0]


def test_packing_keeps_every_id_once(spark):
    encode, _ = ids_of(WORD)
    rows = pack_documents(table(spark), window=3000, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and {r["padded_tokens"] for r in own} == {padded(at, 2048)}
    for doc, own in by_doc.items():
        ids = [[*encode(t), 1] for i, t in texts() if i == doc]
        assert sorted(x for r in own for x in r["ids"]) == sorted(x for e in ids for x in e)
        if len(ids) == 1:
            assert [x for r in sorted(own, key=lambda r: r["start"]) for x in r["ids"]] == ids[0]
    assert pack_documents(table(spark, [])).count() == 0


def test_packing_balances_cost_and_pads_less_than_a_sequence():
    r = random.Random(3)
    lengths = [r.randint(1, 5000) for _ in range(500)]
    pieces, fills = pack_lengths(lengths, 2048)
    assert len(fills) * 2048 - sum(lengths) < 2048 and sum(fills) == sum(lengths)
    assert pack_lengths([], 2048) == ([], []) and padded(1024, 2048) == 1024 and padded(1000, 2048) == 2048
    assert sum(p[2] for p in pieces) == sum(lengths)
