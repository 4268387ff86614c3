"""Small tables with the cases that every operator has to bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, h string, class string, word string, n long"
WORDS = "the of and ing ation er on an re heat ther ones that all over quick brown fox jumps lazy dog river stone cloud paper light window garden".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", ","]) for _ in range(n))


def texts() -> list[tuple]:
    """doc_id and text: null, empty, blank, long, repeated and odd ones, and near copies."""
    base = prose(1, 400)
    words = base.split()
    near = " ".join(["changed" if k in (50, 200) else w for k, w in enumerate(words)])
    far = " ".join(["other" if k % 9 == 0 else w for k, w in enumerate(words)])
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, base), (7, base), (8, near), (9, far), (10, prose(2, 20_000)), (11, "x" * 50_000), (12, "İstanbul ΣΑΣ é 日本語 😀\u0085a\x1cb"),
        (13, "<|endoftext|> a<|startoftext|>b"), (14, prose(3, 60)), (15, prose(3, 60)), (6, base), (None, base), (None, None), (16, "don't I'LL we've ½ ² !!!"),
    ]
    return rows + [(100 + k, prose(50 + k, 30 + k)) for k in range(40)]


def table(spark, rows=None):
    """The rows with further columns whose names operators use themselves."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), 1, "h", "c", "w", 7) for i, t in rows], SCHEMA)
