"""Operators 1, 2, 7, 8 and 10 and the pipeline on small tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import urllib.parse
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from riskflow.llm import chat, jaccard, lm, toxicity
from riskflow.llm.common import shared_dir
from riskflow.llm.secrets import redact_secrets, redacted, scan, secret_scan

from .data import prose, table, texts

SECRET = "password=hunter2secret"


def brute_base(text):
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= n]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]


@pytest.mark.parametrize("wrap", [
    lambda s: s, lambda s: urllib.parse.quote(s, safe=""), lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
    lambda s: base64.b64encode(gzip.compress(base64.b64encode(s.encode()))).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: urllib.parse.quote(base64.b64encode(urllib.parse.quote(s, safe="").encode()).decode(), safe=""),
])
def test_nested_secrets_are_found_where_they_lie(wrap):
    inner = wrap(SECRET)
    text = f"é start {inner} end"
    spans = scan(text)[1]
    assert any(text[a:b].rstrip("=%3D") in inner and len(text[a:b]) > len(inner) / 2 for a, _, b in spans)
    assert inner not in redacted(text) and redacted(text).startswith("é start")


def test_base_spans_are_those_of_plain_patterns(spark):
    odd = [SECRET, "Token : 'abc' secret=abcdef", "AKIA" + "A" * 16 + " deadbeef" * 3 + "0123456789abcdef" * 2, "ſecret=abcdef", "%%%41%", "%ff%41pi_key%3dabcdefg", "a%2541%252541", "\\ud800 &#0; &#99999999;", "A" * 3000, base64.b64encode(b"\x00" * 40).decode()]
    rows = texts() + [(200 + k, t) for k, t in enumerate(odd)]
    got = Counter((r["doc_id"], r["base_sha256"], r["n_assign"] + r["n_access"] + r["n_hex"]) for r in secret_scan(table(spark, rows)).collect())
    assert got == Counter((i, hashlib.sha256(",".join(b := brute_base(t or "")).encode()).hexdigest(), len(b)) for i, t in rows)
    for _, t in rows:
        base, spans = scan(t or "")
        assert set(base) <= set(spans)
    assert secret_scan(table(spark, [])).count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    docs = table(spark, [*texts(), (300, f"x {SECRET} y")])
    out = redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    row = out.where("doc_id = 300").first()
    assert row["text"] == "x [SECRET] y" and row["n_chars"] == len(row["text"])
    assert out.where("doc_id = 6").first()["text"] == docs.where("doc_id = 6").first()["text"]


@pytest.mark.parametrize("mark", ["\u00a0", "\u3000", "\u200d", "\ufeff", "\u00ad", "\f", "\x1b[0m", "\0"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_layers_need_not_be_printable(mark, pack):
    inner = base64.b64encode(pack(f"clé{mark}: {SECRET} fin".encode())).decode()
    assert inner not in redacted(f"a {inner} z") and scan(f"a {inner} z")[1]


def test_wrapped_and_glued_base64():
    body = prose(4, 60).encode()
    for lead in range(0, 60, 7):
        plain = base64.encodebytes(b"." * lead + SECRET.encode() + b" " + body).decode()
        assert any(text[a:b].count("\n") <= 2 for text in [f"see\n{plain}"] for a, _, b in scan(text)[1]), lead
    noise = bytes(range(256)) * 2 + SECRET.encode()
    packed = base64.encodebytes(gzip.compress(noise)).decode()
    assert scan(f"x\n{packed}\ny")[1] and scan(packed.replace("\n", "\\n"))[1] and scan(packed.replace("\n", "\r\n  "))[1]
    for data in (SECRET.encode(), gzip.compress(noise)):
        for prefix in ("https://host.io/a/", "https://host.io/ab/", "x-", "key_", "a+", "abc/de-"):
            text = prefix + base64.b64encode(data).decode()
            assert scan(text)[1] and redacted(text) != text, prefix


def test_all_members_and_all_chunks_are_scanned(monkeypatch):
    two = base64.b64encode(gzip.compress(b"nothing here") + gzip.compress(SECRET.encode())).decode()
    assert scan(two)[1] == [(0, 0, len(two))]
    late = base64.b64encode(zlib.compress(b". " * (33 << 20) + SECRET.encode() + b" .")).decode()
    assert scan(late)[1] == [(0, 0, len(late))]
    from riskflow.llm import secrets

    monkeypatch.setattr(secrets, "unfolded", lambda pieces: iter(pieces))  # data that unfolds to itself
    assert scan("a " + base64.b64encode(gzip.compress(b"x" * 99)).decode())[1] == []


TURNS = "conv_id long, turn long, role string, text string, block string, perspective string"


def test_chat_against_sql(spark):
    rows = [(1, 0, "system", "Rules"), (1, 1, "anna", "Hi"), (1, 2, "ben", None), (1, 2, "ben", "Again"), (1, 2, "ben", "Again"), (1, None, "cara", "?"), (None, 1, "anna", "Null"), (2, 0, "system", "alone"), (3, 1, None, "who")]
    rows += [(4, k, "ab"[k % 2], f"turn {k} é") for k in range(300)]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    got = chat.rotate_perspectives(turns).toPandas()
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    want = con.execute(chat.ORACLE).df()
    names = sorted(want.columns)
    rows_of = lambda df: Counter(tuple(x if isinstance(x, str) else None if pd.isna(x) else int(x) for x in r) for r in df[names].itertuples(index=False))
    assert rows_of(got) == rows_of(want)
    whole = {}
    for r in got.sort_values("block").to_dict("records"):
        whole.setdefault((None if pd.isna(r["conv_id"]) else r["conv_id"], r["perspective"]), []).append(r)
    assert (2, "system") not in whole and (3, "unknown") in whole
    for parts in whole.values():
        text = "".join(p["rendering"] for p in parts)
        assert [p["start"] for p in parts] == [sum(len(q["rendering"]) for q in parts[:k]) for k in range(len(parts))]
        trained = "".join(text[int(a) : int(b)] for p in parts for a, _, b in (m.partition(":") for m in p["mask"].split(",") if m))
        assert trained == "".join(re.findall(r"<\|assistant\|>\n(.*?<\|end\|>\n)", text, re.S))
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_equal_turns_keep_their_order_over_ranges(spark):
    rows = [(1, turn, "abc"[k % 3], f"{'same ' * (60 * (k % 2))}{k * 7919 % 331:03d}") for turn in (None, 5) for k in range(300)] * 2
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(chat.ORACLE).df()
    names = sorted(want.columns)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in (1, 23):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = chat.rotate_perspectives(turns).toPandas()
            assert Counter(got[names].itertuples(index=False, name=None)) == Counter(want[names].itertuples(index=False, name=None)), parts
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def brute_components(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, grams(t)) for i, t in rows]
    part = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b) and part[i] != part[j]:
                    part[i] = part[j] = min(part[i], part[j])
                    changed = True
    return Counter((i, len(s), None if i is None else i if not s else part[i]) for i, s in sets)


def test_jaccard_against_brute_force(spark):
    words = prose(9, 120).split()
    rows = texts() + [(400 + k, " ".join(w if (j * 7 + k) % 61 else f"e{k}" for j, w in enumerate(words))) for k in range(25)]
    got = Counter(tuple(r) for r in jaccard.jaccard_components(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    out = jaccard.drop_near_duplicates(table(spark))
    kept = Counter(r["doc_id"] for r in out.collect())
    assert kept[6] == 1 and 7 not in kept and 8 not in kept and kept[9] == 1 and kept[None] == 2 and kept[4] == 1 and 5 not in kept and kept[1] == kept[2] == kept[3] == 1
    assert out.columns == table(spark).columns


def test_sets_take_one_python_worker_a_task(spark):
    docs = table(spark).select("doc_id", "text")
    described = jaccard.described(docs, 5).localCheckpoint()
    classes = described.where("n > 0").groupBy("class").agg({"row": "min"}).withColumnRenamed("min(row)", "row")
    sets = jaccard.sets_of(described.where("text is not null"), classes.select("class"), classes, 5)
    assert sets._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {len(r["grams"]) // 8 for r in sets.collect()} == {r["n"] for r in described.where("row is not null").collect()}


def test_links_are_written_before_components_are_sought(spark, monkeypatch):
    nested, own = [], jaccard.connected_components

    def watched(edges):
        nested.append(edges._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return own(edges)

    monkeypatch.setattr(jaccard, "connected_components", watched)
    jaccard.jaccard_components(table(spark))
    assert len(nested) > 1 and not any(nested)


def test_language_model_scores(spark):
    # Two kinds of texts with words of their own, as languages have.
    rows = texts() + [(500 + k, prose(k, 200) if k % 2 else prose(k, 200).translate(str.maketrans("aeiot", "uäßzk"))) for k in range(120)]
    got = lm.score_texts(table(spark, rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count, split = Counter(), lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in rows:
        if not held(i):
            count.update(split(t))
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t))
    want = Counter((i, held(i), len(split(t)), sum(count[w] > 0 for w in split(t)), n, round(base(t), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    fresh = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 500]
    assert sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)
    assert lm.score_texts(table(spark, [])).count() == 0
    assert lm.score_texts(table(spark, [(1, None)])).count() == 1


def test_bits_of_all_bytes_sum_to_one(spark):
    import numpy as np

    tables = np.random.default_rng(1).integers(0, 5, (lm.CONTEXTS, 2, 1 << lm.SLOT_BITS)).astype(np.float32)
    mixer = lm.Mixer(tables)
    mixer.learn([b"hello", b"help"], np.array([3, 1]))
    mixer.settle()
    # Words of one byte but white space, of two bytes and more share what their first byte leaves; the first byte's bits sum to one.
    strip = lm.Strip([bytes([k]) for k in range(256)])
    total = np.zeros(len(strip.bytes))
    for level, bit, slots in strip.levels():
        p = mixer.predict(level, slots)
        total += np.log(np.where(bit == 1, p, 1 - p))
    assert abs(np.exp(total[strip.first]).sum() - 1) < 1e-9


def test_weights_are_looked_up_only_for_bits_that_contexts_have_not_seen():
    class Weights(lm.np.ndarray):
        taken = 0

        def take(self, at, **how):
            Weights.taken += len(at)
            return super().take(at, **how)

    known, other = lm.row_of(prose(5, 300)), lm.row_of(prose(6, 100) + " é ½ new words")
    counts = lm.np.zeros((lm.CONTEXTS, 1 << lm.SLOT_BITS), lm.np.int32)
    lm.Strip([known]).count(counts)
    rng = lm.np.random.default_rng(1)
    mixer = lm.Mixer.settled(lm.np.stack([lm.said(lm.bits_of(c)) for c in counts]), rng.normal(0.2, 0.1, (lm.GATES, 8, lm.CONTEXTS)), lm.Mixer.untaught()[1])
    plain = []
    for text in (known, other):
        total = 0.0
        for level, bit, slots in lm.Strip([text]).levels():
            said = lm.np.stack([t[at] for t, at in zip(mixer.inputs, slots, strict=True)])
            gate = (said != 0).sum(0)
            mix = lm.np.zeros(len(gate), lm.np.float32)
            for x, weight in zip(said, mixer.light[level], strict=True):
                mix += x * weight[gate]
            place = lm.np.rint((lm.np.clip(mix, -lm.LIMIT, lm.LIMIT) + lm.np.float32(lm.LIMIT)) * lm.np.float32((lm.FINE - 1) / (2 * lm.LIMIT))).astype(int)
            p = mixer.chances[level][gate * lm.FINE + place]
            total += lm.np.log10(lm.np.where(bit == 1, p, 1 - p)).sum()
        plain.append(total)
    mixer.light = mixer.light.view(Weights)
    assert mixer.cost([known, known]) == pytest.approx([plain[0]] * 2, rel=1e-12) and Weights.taken == 0
    assert mixer.cost([other]) == pytest.approx([plain[1]], rel=1e-12) and Weights.taken > 0


def test_mixes_are_exact_in_any_order_of_contexts():
    np = lm.np
    rng = np.random.default_rng(3)
    inputs = np.zeros((lm.CONTEXTS, 1 << lm.SLOT_BITS), np.int8)
    mixer = lm.Mixer.settled(inputs, rng.normal(0.3, 0.5, (lm.GATES, 8, lm.CONTEXTS)), lm.Mixer.untaught()[1])
    x = rng.integers(-lm.STEPS, lm.STEPS + 1, (lm.CONTEXTS, 2000))
    for weights in mixer.light.reshape(8, lm.CONTEXTS, -1).transpose(0, 2, 1).reshape(-1, lm.CONTEXTS):
        sums = [sum(x[i].astype(np.float32) * weights[i] for i in order) for order in (range(lm.CONTEXTS), reversed(range(lm.CONTEXTS)))]
        assert (sums[0] == sums[1]).all() and (sums[0] == weights.astype(float) @ x).all()


def test_plain_texts_are_their_words_with_one_space_between():
    for text in ("", " ", "\t\n\v\f\r A  b\u00a0C\x1c\x85d \x00E ", "Äa\u2003b", "A B", "a\n\nB"):
        assert lm.plain(text.encode()) == b" ".join(text.encode().lower().split())


def test_frequent_words_are_whole_frequencies(spark, monkeypatch):
    words = spark.createDataFrame([(bytes([97 + k]), f, 1, -0.5 * k) for k, f in enumerate([9, 7, 7, 3, 3, 3, 1])], "word binary, f long, known long, base double")
    for most, kept in ((0, 0), (1, 1), (2, 1), (3, 3), (5, 3), (6, 6), (7, 7), (100, 7)):
        monkeypatch.setattr(lm, "FREQUENT", most)
        place, table = lm.most_frequent(words)
        assert sorted(place) == [bytes([97 + k]) for k in range(kept)] and table.shape == (kept, 2)
        assert all(table[at].tolist() == [1, -0.5 * (word[0] - 97)] for word, at in place.items())


def test_language_model_follows_the_order_of_words(spark):
    rows = [(k, prose(k, 150)) for k in range(60)]
    out = next(k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 1)
    words = dict(rows)[out].split()
    # Held out, so that the model is the same for both: one keeps a training text's words in order, one has them backwards.
    seen = next(t for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1).split()
    free = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 5 == 1]
    rows += [(free[0], " ".join(seen)), (free[1], " ".join(reversed(seen))), (free[2], " ".join(reversed(words)))]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(table(spark, rows).repartition(1)).collect()}
    assert got[free[0]] > got[free[1]] + 1 and got[out] != got[free[2]]
    again = {r["doc_id"]: r["score"] for r in lm.score_texts(table(spark, rows).repartition(5, "text")).collect()}
    assert got == again


def test_counts_of_nibbles_are_those_of_bits():
    import numpy as np

    rows = [lm.row_of(t) for t in (prose(3, 40), "", "Ä b\tc  ÄÄ", prose(3, 40)[:70])]
    counts = np.zeros((lm.CONTEXTS, 1 << lm.SLOT_BITS), np.int64)
    lm.Strip(rows).count(counts)
    strip, tables = lm.Strip(rows), np.zeros((lm.CONTEXTS, 2, 1 << lm.SLOT_BITS))
    for _, bit, slots in strip.levels():
        for i in range(lm.CONTEXTS):
            np.add.at(tables[i].reshape(-1), bit << lm.SLOT_BITS | slots[i], 1)
    assert all((lm.bits_of(c) == t).all() for c, t in zip(counts, tables, strict=True))
    # Contexts see the same bytes whatever texts lie before, and cross words: equal contexts, equal slots.
    alone = lm.Strip(rows[3:])
    assert (strip.blocks[:, :, strip.first[3] :] == alone.blocks).all()
    ab, cb = lm.Strip([b"aa bb"]), lm.Strip([b"ca bb"])
    differ = (ab.blocks[:, 0] != cb.blocks[:, 0]).T.tolist()
    # The second b sees four bytes before it, "aa b" or "ca b": orders 1 to 3 don't differ, order 5 and the pair of words do.
    assert differ[4] == [False, False, False, True, False, True]


def toxic_rows():
    bad, rows, labels = ["idiot", "moron", "stupid"], [], []
    for k in range(400):
        t, toxic = prose(1000 + k, 40), k % 4 == 0
        if toxic:
            w = t.split()
            w[5], w[20] = bad[k // 4 % 3], bad[(k // 4 + 1) % 3] + "###"
            t = " ".join(w)
        rows.append((k, t))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_tolerates_inserted_characters(spark):
    rows, labels = toxic_rows()
    odd = {900: "what an i d i o t and a stup.id thing", 901: "you id1ot, a st-upid mo.ron", 902: "idxiot and morron and stuppid all over", 903: "the quick brown fox", 904: None, 905: ""}
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, rows + list(odd.items())), lab).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k]["held_out"] for k in held)
    assert sum(got[k]["predicted"] == (k % 4 == 0) for k in held) / len(held) > 0.97
    assert [got[k]["predicted"] for k in (900, 901, 902, 903, 904, 905)] == [1, 1, 1, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.toxicity(table(spark, []), lab).count() == 0
    assert toxicity.toxicity(table(spark), lab.limit(0)).where("score <> 0").count() == 0
    kept = toxicity.drop_toxic(table(spark, rows), lab)
    assert kept.columns == table(spark).columns and kept.where("doc_id % 4 = 1").count() == 100


def test_toxicity_without_landmarks_gives_the_share(spark):
    rows = [(0, "quick brown fox"), (7, None), (5, ""), (8, "stupid words here"), (None, "no id"), (8, "stupid words here")]
    schema = "doc_id long, quality int, toxic int"
    cases = [([], 0.0), ([(0, 1, 1), (8, 1, 1)], 1.0), ([(0, 1, 0), (7, 1, 0)], 0.0), ([(0, 1, None), (None, 1, 1), (8, 1, 5)], 0.0), ([(0, 1, 1), (7, 1, 0)], 0.5), ([(77, 1, 1), (78, 1, 0)], 0.0)]
    for labels, share in cases:
        lab = spark.createDataFrame(labels, schema)
        assert [r["score"] for r in toxicity.toxicity(table(spark, rows), lab).collect()] == [share] * len(rows), labels
        assert toxicity.drop_toxic(table(spark, rows), lab).count() == (0 if share >= toxicity.REJECT else len(rows))


def test_own_kernel_is_one():
    words = ["idiot", "banana", "hahaha", "aaaaaaa", "éàü", "abc"]
    got = toxicity.WordKernel(words).similarity(words)
    assert abs(got.diagonal() - 1).max() < 1e-9 and (got < 1 + 1e-9).all()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_rows()
    rows = [(k + 1000 if k >= 100 else k, t) for k, t in rows] + [(5000, rows[1][1]), (5001, f"clean {SECRET} text")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in got.collect()}
    assert 5001 in ids and 1 in ids and 5000 not in ids and not ids & {k for k in range(0, 100, 4)}
    assert shared_dir(spark)
