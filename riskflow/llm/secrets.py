"""Secret scans of texts and of every layer encoded within them.

A worklist unwraps URL escapes, Unicode escapes, base64 and compressed data until nothing new appears; each layer is
scanned with the same patterns, and every layer carries the place in the original text that each of its characters
came from, so that a find in a nested layer is reported as a span of the original.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, keep_only, map_arrow, text_columns, texts_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGNED_LENGTH = 6

URL_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
TEXT_ESCAPES = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: Digits of one run, which may go on over whole further lines; line ends may be escaped, as in JSON.
DIGITS, LINE_END = r"[A-Za-z0-9+/_-]", r"[\x20\t]*(?:\r\n?|\n|\\r\\n|\\n)[\x20\t]*"
BREAK = re.compile(LINE_END)
BASE64 = re.compile(rf"(?<!{DIGITS})(?:{DIGITS}{{16,}}+|{DIGITS}++(?={LINE_END}{DIGITS}{{16}}))(?:{LINE_END}{DIGITS}++(?=={{0,2}}[\x20\t]*(?:[\r\n\"']|\\[rn]|\Z)))*={{0,2}}")
#: The first digits of gzip, zlib, bzip2, xz and zstandard data.
PACKED = re.compile(r"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|Qlpo|/Td6WFo|KLUv/")
#: Every pattern here needs one of these in a layer: an escape, or as many plain characters as the shortest secret.
PLAUSIBLE = re.compile(rb"%[0-9A-Fa-f]{2}|\\[ux]|&#[0-9xX]|[\x20-\x7e]{12}")
#: Compressed data is unfolded in pieces and scanned in overlapping chunks, which bounds a task's memory. An open run of
#: base64 goes on into the next chunk whole, unless it is longer than LAYER_BYTES.
PIECE_BYTES, CHUNK_BYTES, LAYER_BYTES, OVERLAP_BYTES = 1 << 20, 8 << 20, 64 << 20, 1 << 16
RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n\\"

#: Texts that a task redacts at once.
TOGETHER = 500

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
Span = tuple[int, int, int]


def find_secrets(text: str) -> list[Span]:
    """Spans (start, kind number, end) of one layer, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text and, for each of its characters, the original's code points [start, end) that it came from."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def replaced(self, edits: list[tuple[int, int, str]]) -> Layer:
        """The layer with each (start, end, character) put in place of the characters there."""
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            texts += (self.text[at:a], new)
            starts += (self.starts[at:a], np.full(len(new), self.starts[a:b].min()))
            ends += (self.ends[at:a], np.full(len(new), self.ends[a:b].max()))
            at = b
        return Layer("".join([*texts, self.text[at:]]), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]))


def url_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Each escaped character with its place; escapes that aren't UTF-8 stay, but for those of ASCII."""
    for m in URL_ESCAPES.finditer(text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        k = 0
        while k < len(raw):
            n = 1 if raw[k] < 0x80 else 2 if 0xC2 <= raw[k] < 0xE0 else 3 if 0xE0 <= raw[k] < 0xF0 else 4
            try:
                yield m.start() + 3 * k, m.start() + 3 * (k + n), raw[k : k + n].decode()
                k += n
            except UnicodeDecodeError:
                k += 1


def text_edits(text: str) -> Iterator[tuple[int, int, str]]:
    r"""\u, \x and numeric character references; surrogate pairs and what isn't a character stay."""
    for m in TEXT_ESCAPES.finditer(text):
        code = int(m[m.lastindex], 10 if m.lastindex == 4 else 16)
        if code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            yield m.start(), m.end(), chr(code)


def decompressor(head: bytes):
    """A decompressor for data that begins with ``head``, if it is compressed."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def unfolded(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What compressed data holds, member after member, in pieces; it ends where the data does or is damaged."""
    rest = b""
    while True:
        while len(rest := rest.lstrip(b"\0")) < 6 and (more := next(pieces, b"")):
            rest += more
        if (d := decompressor(rest[:6])) is None:
            return
        bounded = not hasattr(d, "flush") or hasattr(d, "unconsumed_tail")  # zstandard's takes no limit
        try:
            while not d.eof:
                out = d.decompress(rest, PIECE_BYTES) if bounded else d.decompress(rest)
                rest = getattr(d, "unconsumed_tail", b"")
                if out:
                    yield out
                if not d.eof and not rest and len(out) < PIECE_BYTES and getattr(d, "needs_input", True) and not (rest := next(pieces, b"")):
                    return
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        except Exception as e:  # zstandard's error isn't importable without it
            if type(e).__name__ == "ZstdError":
                return
            raise
        rest = d.unused_data


def chunks(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces in overlapping chunks of bounded size."""
    data = bytearray()
    for piece in pieces:
        data += piece
        if len(data) >= CHUNK_BYTES:
            open_ = len(data) - len(data.rstrip(RUN_BYTES))
            if (whole := open_ < len(data) // 2) or len(data) >= LAYER_BYTES:
                yield bytes(data)
                del data[: -max(OVERLAP_BYTES, open_ if whole else 0)]
    if data:
        yield bytes(data)


def decoded(digits: str, at: int) -> Iterator[bytes]:
    """The bytes of base64 digits from a place on, in small pieces, so that what isn't compressed ends early."""
    stop = len(digits) - ((len(digits) - at) % 4 == 1)
    for k in range(at, stop, 1 << 16):
        part = digits[k : min(k + (1 << 16), stop)]
        yield binascii.a2b_base64(part + "=" * (-len(part) % 4))


def unfolded_chunks(digits: str, at: int) -> Iterator[bytes]:
    """Chunks of what compressed data holds, at each depth of compression; data met before, as in a cycle, ends it."""
    depth, seen = 0, set()

    def stream() -> Iterator[bytes]:
        pieces = decoded(digits, at)
        for _ in range(depth):
            pieces = unfolded(pieces)
        return pieces

    while True:
        depth += 1
        first = next(stream(), b"")
        if not first or first in seen:
            return
        seen.add(first)
        yield from chunks(stream())


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """The layers, plain at all four alignments or compressed any number of times, that runs of base64 hold.

    Each byte is a character (Latin-1): all patterns are ASCII, so they find the same in it as in UTF-8 or damaged text.
    """
    for m in BASE64.finditer(layer.text):
        ends_at = m.end() - len(m[0]) + len(m[0].rstrip("="))
        breaks = [(m.start(), m.start()), *(b.span() for b in BREAK.finditer(layer.text, m.start(), ends_at)), (ends_at, ends_at)]
        lines = [(b, c) for (_, b), (c, _) in zip(breaks, breaks[1:], strict=False)]
        digits = "".join(layer.text[b:c] for b, c in lines).translate({45: 43, 95: 47})
        place = np.concatenate([np.arange(b, c) for b, c in lines])
        for off in range(4):
            data = b"".join(decoded(digits, off))
            if not PLAUSIBLE.search(data):
                continue
            k = np.arange(len(data))  # byte k comes from the digits that hold its bits
            a, b = place[off + k * 4 // 3], place[off + ((k + 1) * 4 + 2) // 3 - 1]
            ends = layer.ends[b]
            if off + (len(data) * 4 + 2) // 3 == len(digits):
                ends[-1] = layer.ends[m.end() - 1]  # with the padding
            yield Layer(data.decode("latin-1"), layer.starts[a], ends)
        for p in PACKED.finditer(digits):
            for data in unfolded_chunks(digits, p.start()):
                a, b = layer.origin(place[p.start()], m.end())
                yield Layer(data.decode("latin-1"), np.broadcast_to(np.int64(a), len(data)), np.broadcast_to(np.int64(b), len(data)))


def inner_layers(layer: Layer) -> Iterator[Layer]:
    yield from base64_layers(layer)
    for edits in (url_edits, text_edits):
        if made := list(edits(layer.text)):
            yield layer.replaced(made)


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the text itself, and all spans with those found in nested layers, in order."""
    base = find_secrets(text)
    spans = set(base)
    escaped = "%" in text and URL_ESCAPES.search(text) or ("\\" in text or "&#" in text) and TEXT_ESCAPES.search(text)
    if not escaped and not BASE64.search(text):
        return base, base
    work, seen = [inner_layers(Layer(text))], {(digest(text), 0, len(text))}
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        key = (digest(layer.text), int(layer.starts[0]), int(layer.ends[-1]))
        if key not in seen:  # a layer met before, as in a cycle, isn't unwrapped again
            seen.add(key)
            spans |= {(a, kind, b) for s, kind, e in find_secrets(layer.text) for a, b in [layer.origin(s, e)]}
            work.append(inner_layers(layer))
    return base, sorted(spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """Find secrets in every whole text.

    Returns doc_id, n_assign, n_access, n_hex and base_sha256 of the finds in the text itself, and ``spans`` of all
    finds, ``kind:start:end`` in code points. A null or empty text has none; repeated rows are scanned one by one;
    null doc_ids stay null; an empty table gives an empty one; other columns are ignored.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in texts_of(batch):
                base, found = scan(text)
                for kind in range(3):
                    counts[kind].append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            return pa.RecordBatch.from_arrays([column(batch, "doc_id").cast("int64"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], SCHEMA.replace(" long", "").replace(" string", "").split(", "))

        return each

    return map_arrow(text_columns(docs), make, SCHEMA)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every found span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in scan(text)[1]:
        if a >= at:
            out += (text[at:a], mark)
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets replaced in ``text`` (null stays null), and ``n_chars``, if there, counted anew."""
    names = docs.columns

    def make():
        keep_only("secrets")

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t and redacted(t) for t in column(batch, "text").to_pylist()]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, column(batch, "n_chars").to_pylist(), strict=True)], batch.schema.field("n_chars").type)
            return pa.RecordBatch.from_arrays([new.get(n, batch.column(k)) for k, n in enumerate(names)], names)

        return each

    return map_arrow(docs, make, docs.schema, TOGETHER)
