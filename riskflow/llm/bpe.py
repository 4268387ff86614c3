"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last one of its encoding. An automaton lists the tokens
that end at each position; the one whose predecessor (the last token of the prefix before it) forms a pair that
byte-pair merging would leave apart is stored, and following the stored tokens back from the end gives the ids.
No merge queue is run.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column, map_arrow, text_columns, texts_of
from .subwords import BYTE_NAMES, RUNS, RunCache, tokenizer_path

NEVER = 1 << 60
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SCHEMA = "doc_id long, ids array<int>, decoded string"


class PrefixBpe:
    """A vocabulary with ranked merges, whose words end in a marked last symbol."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank = [-1] * (max(self.text_of) + 1)
        self.left, self.right = [0] * len(self.rank), [0] * len(self.rank)
        self.merges: dict[int, int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            if self.rank[whole] >= 0:
                raise ValueError("two merges make one token: the last token of a prefix isn't unique")
            self.merges[a << 20 | b] = self.rank[whole] = k
            self.left[whole], self.right[whole] = a, b
        names = BYTE_NAMES
        self.inner = [vocab[names[b]] for b in range(256)]
        self.final = [vocab[names[b] + self.suffix] for b in range(256)]
        self._build_automaton()
        self.pairs: dict[int, bool] = {}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.runs = RunCache(self._run)

    def _symbols(self, token: int) -> list[int]:
        out, stack = [], [token]
        while stack:
            t = stack.pop()
            if self.rank[t] < 0:
                out.append(t)
            else:
                stack += (self.right[t], self.left[t])
        return out

    def _build_automaton(self) -> None:
        """States are prefixes of tokens; ``ends[state]`` has (token, symbols) for each token ending there, longest first."""
        self.step: dict[int, int] = {}
        self.back = [0]
        self.ends: list[tuple] = [()]
        children: list[list[tuple[int, int]]] = [[]]
        base = [t for t in (*self.inner, *self.final)]
        tokens = base + [t for t in range(len(self.rank)) if self.rank[t] >= 0]
        for token in tokens:
            state, symbols = 0, self._symbols(token)
            for s in symbols:
                key = state << 20 | s
                if key not in self.step:
                    self.step[key] = len(self.back)
                    children[state].append((s, len(self.back)))
                    self.back.append(0)
                    self.ends.append(())
                    children.append([])
                state = self.step[key]
            self.ends[state] = ((token, len(symbols)),)
        queue = [child for _, child in children[0]]
        for state in queue:
            for s, child in children[state]:
                at = self.back[state]
                while at and at << 20 | s not in self.step:
                    at = self.back[at]
                self.back[child] = self.step.get(at << 20 | s, 0)
                queue.append(child)
            self.ends[state] += self.ends[self.back[state]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the symbols of ``a`` and ``b`` put together ends in just these two tokens.

        Undo merges from the latest one back: at each moment the two parts at the border must not have a merge
        that comes before the merge which takes either of them away. Of equal merges the left one comes first.
        """
        until_a = until_b = NEVER
        while True:
            m = self.merges.get(a << 20 | b)
            if m is not None and m < until_a and m <= until_b:
                return False
            if self.rank[a] > self.rank[b]:
                until_a, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                until_b, b = self.rank[b], self.left[b]
            else:
                return True

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word of at least one byte."""
        step, back, ends, pairs, inner = self.step, self.back, self.ends, self.pairs, self.inner
        symbols = [inner[b] for b in word]
        symbols[-1] = self.final[word[-1]]
        last: list[int] = [-1]
        size: list[int] = [0]
        state = 0
        for i, s in enumerate(symbols, 1):
            to = step.get(state << 20 | s)
            while to is None and state:
                state = back[state]
                to = step.get(state << 20 | s)
            state = to or 0
            for token, n in ends[state]:
                before = last[i - n]
                if before < 0:
                    break
                key = before << 20 | token
                good = pairs.get(key)
                if good is None:
                    if len(pairs) > 2_000_000:
                        pairs.clear()
                    good = pairs[key] = self.compatible(before, token)
                if good:
                    break
            last.append(token)
            size.append(n)
        out, i = [], len(symbols)
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _run(self, run: str) -> tuple[str, str]:
        """Ids and decoded text of a run of non-space characters, each joined by spaces."""
        text = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()
        ids = [i for word in self.words(text) for i in self.word_ids(word.encode())]
        return " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The tokens of ``ids`` joined by a space, as a tokenizer without a decoder gives them."""
        return " ".join([self.text_of[i] for i in ids])

    def encode_decode(self, text: str) -> tuple[str, str]:
        """The decimal ids of a whole text joined by one space, and its decoded text."""
        parts: list[tuple[str, str]] = []
        for piece in self.cut(text) if "<|" in text else (text,):
            if piece in self.special:
                parts.append((str(self.special[piece]), piece))
            else:
                parts += map(self.runs.__getitem__, RUNS.findall(piece))
        return " ".join([p[0] for p in parts if p[0]]), " ".join([p[1] for p in parts if p[0]])


_models: dict[str, PrefixBpe] = {}


def prefix_bpe(path: str) -> PrefixBpe:
    """One model per worker process and vocabulary file."""
    if path not in _models:
        _models[path] = PrefixBpe(path)
    return _models[path]


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every whole text and decode its ids.

    Args:
        docs: any table with doc_id and text; other columns are ignored.
        path: tokenizer file; the public word vocabulary by default, found on the executor.
    Returns:
        doc_id, ids array<int>, decoded. A null or empty text gives no ids and the empty text; repeated rows are
        encoded one by one; row order doesn't matter; an empty table gives an empty one.
    """

    def make():
        model = prefix_bpe(path or tokenizer_path("word_bpe_49k.json"))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.encode_decode(t) for t in texts_of(batch)]
            ids = pa.array([[int(i) for i in x.split()] for x, _ in found], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([column(batch, "doc_id").cast("int64"), ids, pa.array([d for _, d in found], pa.string())], ["doc_id", "ids", "decoded"])

        return each

    return map_arrow(text_columns(docs), make, SCHEMA)


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As :func:`bpe_round_trip`, with the ids and the decoded text as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        model = prefix_bpe(path or tokenizer_path("word_bpe_49k.json"))

        def sha(text: str) -> str:
            return hashlib.sha256(text.encode()).hexdigest()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, decoded = [], [], []
            for text in texts_of(batch):
                x, d = model.encode_decode(text)
                n.append(x.count(" ") + 1 if x else 0)
                ids.append(sha(x))
                decoded.append(sha(d))
            return pa.RecordBatch.from_arrays([column(batch, "doc_id").cast("int64"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return map_arrow(text_columns(docs), make, DIGEST_SCHEMA)
