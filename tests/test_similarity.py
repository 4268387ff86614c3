"""Fuzzy functions against plain loops and on small tables."""

from __future__ import annotations

import random

from riskflow.functions import similarity as s


def brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert s.common(a, b) == brute(a, b)
    assert s.token_sort_ratio("Txn Date", "date txn") == 1.0 and s.partial_ratio("abc", "xxabcxx") == 1.0 and s.ratio("", "") == 1.0


def test_categories(spark):
    rows = [(1, "electrcity due", "debit"), (2, "salary march", "credit"), (3, "qqq", "debit"), (4, None, "debit")]
    got = {r["id"]: r["category"] for r in s.assign_category(spark.createDataFrame(rows, "id long, narration string, direction string")).collect()}
    assert got == {1: "utility_bill", 2: "salary", 3: "uncategorized", 4: "uncategorized"}


def test_variants_and_templates(spark):
    rows = [(1, "BLUE DUNE TRADING"), (1, "DUNE BLUE TRADING"), (1, "OTHER"), (2, "BLUE DUNE"), (1, None)]
    got = {(r["statement_id"], r["name"]): r["key"] for r in s.merge_variants(spark.createDataFrame(rows, "statement_id long, name string")).collect()}
    assert got[(1, "DUNE BLUE TRADING")] == got[(1, "BLUE DUNE TRADING")] and got[(1, "OTHER")] == "OTHER" and got[(2, "BLUE DUNE")] == "BLUE DUNE"
    headers = spark.createDataFrame([("a", ["Date", "Narration", "Withdrawal Amt."]), ("b", ["x", "y"])], "file string, header array<string>")
    m = {r["file"]: r["template"] for r in s.match_templates(headers, {"t1": ["Date", "Narration", "Withdrawal Amt."], "t2": ["Txn", "Value"]}).collect()}
    assert m == {"a": "t1", "b": None}
