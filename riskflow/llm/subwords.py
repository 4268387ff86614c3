"""Ids of whole texts as the tokenizers library gives them, with one encoding per distinct run of non-space characters.

Both public vocabularies split text at white space before merging, so the ids of a text are the ids of its
runs put together. A worker keeps the runs it has met; prose repeats most of them. New runs of Latin letters are
merged by tiktoken with the ranks of the same tokenizer file, which takes a third of the time for the same ids; other
runs, and texts with special tokens, go through the tokenizers library itself. Tests compare both over all texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

from .common import keep_only, worker_cache

#: White space as Unicode defines it (fixed values); Python's own ``\s`` also takes U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUNS = re.compile(f"[^{SPACE}]+")
SPACED_RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Runs kept by one worker, and the longest run kept; both bound memory only.
CACHE_RUNS = 600_000
CACHED_LENGTH = 48
#: As CACHE_RUNS, for each of the two generations of RunEncoder.
GENERATION = 400_000

#: How the two public vocabularies split a run into words (fixed values).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SPACED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The first character beyond the Latin blocks.
LATIN = "\u0250"


def byte_names() -> dict[int, str]:
    """The usual one-character names of bytes: printable Latin-1 bytes name themselves, others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(own)))}


BYTE_NAMES = byte_names()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class RunCache(dict):
    """``cache[run]`` computes and keeps the value of a run."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, run):
        value = self.compute(run)
        if len(run) <= CACHED_LENGTH:
            if len(self) >= CACHE_RUNS:
                self.clear()
            self[run] = value
        return value


def ranks_of(path: str) -> dict[bytes, int]:
    """The bytes of each token with its id; ids of a tokenizer's merges follow the order of the merges."""
    spec = json.load(open(path, encoding="utf-8"))
    model, byte_of = spec["model"], {c: b for b, c in BYTE_NAMES.items()}
    mark = model["end_of_word_suffix"] or ""
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged) or min(merged) <= max(i for t, i in model["vocab"].items() if len(t.removesuffix(mark)) == 1):
        raise ValueError("ids don't follow the order of merges")
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {}
    for token, i in model["vocab"].items():
        if token not in special:
            ended = bool(mark) and token.endswith(mark)
            ranks[bytes(byte_of[c] for c in token[: len(token) - ended * len(mark)]) + b"\0" * ended] = i
    return ranks


class Generations(dict):
    """``cache[run]`` computes and keeps the value of a run.

    When the younger generation is full the older is dropped, and what was used since lives on.
    """

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, run: str) -> bytes:
        value = self.old.get(run)
        if value is None:
            value = self.compute(run)
        if len(run) <= CACHED_LENGTH:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[run] = value
        return value


class RunEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    ``spaced``: the vocabulary keeps white space, so a run carries the space before it. A vocabulary without spaces
    marks the ends of words; here a zero byte behind each word stands for that mark.
    """

    def __init__(self, path: str, spaced: bool, generation: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ranks = ranks_of(path)
        self.merge = tiktoken.Encoding("own", pat_str=SPACED_WORDS if spaced else r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = (SPACED_RUNS if spaced else RUNS).findall
        self.spaced = spaced
        self.words = regex.compile(SPACED_WORDS if spaced else WORDS).findall
        self.runs = Generations(self._run, generation)

    def _direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        if max(run) >= LATIN or "\0" in run:
            return self._direct(run)
        if self.spaced:
            return array("I", self.merge(run)).tobytes()
        words = self.words(unicodedata.normalize("NFC", run).lower())
        return array("I", self.merge("\0".join(words) + "\0")).tobytes()

    def encode(self, text: str) -> bytes:
        for special in self.special:  # such a text is cut at the special tokens first
            if special in text:
                return self._direct(text)
        return b"".join(map(self.runs.__getitem__, self.find(text)))


_encoders: dict[tuple, RunEncoder] = worker_cache("encoders", {})


def run_encoder(name: str, spaced: bool, generation: int = GENERATION) -> RunEncoder:
    """One encoder per worker process, vocabulary and size."""
    keep_only("encoders")
    key = (name, spaced, generation)
    if key not in _encoders:
        _encoders[key] = RunEncoder(name if os.sep in name else tokenizer_path(name), spaced, generation)
    return _encoders[key]
