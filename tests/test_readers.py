"""Readers on files written here."""

from __future__ import annotations

import pytest

from riskflow.sources import readers

STATEMENT = '''My Bank
Account Name: Blue Dune

Transaction Date,Narration,Reference No,Debit Amount,Credit Amount,Balance
10/06/2024,"NEFT/DR/RING-AB/BLUE, DUNE/SBIN0001234",RING-AB,"1,450.00",,500.00
11/06/2024,deposit,R2,,48500.00,49000.00
,,,,,
Closing Balance,,,,,49000.00
'''


def test_statement_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(STATEMENT)
    (tmp_path / "b.csv").write_text("Date;Details;Amount\n2024-01-05;paid;-12.50\n2024-01-06;got;7\nnever;x;1\n")
    lines = readers.statement_lines(spark, str(tmp_path))
    body = readers.scan_statement_csv(lines)
    a, b = body.where("file like '%a.csv'"), body.where("file like '%b.csv'")
    got = readers.map_rows(a, {"date": "Transaction Date", "narration": "Narration", "reference": "Reference No", "debit": "Debit Amount", "credit": "Credit Amount", "balance": "Balance"}).orderBy("row_index").collect()
    assert [(str(r["txn_date"]), r["debit"] and float(r["debit"]), r["credit"] and float(r["credit"]), float(r["balance"])) for r in got] == [("2024-06-10", 1450.0, None, 500.0), ("2024-06-11", None, 48500.0, 49000.0)]
    assert got[0]["narration"] == "NEFT/DR/RING-AB/BLUE, DUNE/SBIN0001234"
    signed = readers.map_rows(b, {"date": "Date", "narration": "Details", "amount": "Amount"}).orderBy("row_index").collect()
    assert [(r["debit"] and float(r["debit"]), r["credit"] and float(r["credit"])) for r in signed] == [(12.5, None), (None, 7.0)]
    assert readers.extract_preamble(lines).where("file like '%a.csv'").first()["preamble"] == ["My Bank", "Account Name: Blue Dune"]


def test_ledger_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Timestamp,From Bank,Account,To Bank,Account.1,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n2022/09/01 00:20,10.0,A1,11,B1,5.5,USD,0,USD,Wire,1\n2022/09/01 00:21,,A1,11,B1,5.5,USD,1,USD,Wire,0\n")
    rows, stats = readers.scan_transfer_csv(spark, str(tmp_path))
    r = rows.first()
    assert (r["from_bank"], r["to_bank"], float(r["amount"]), r["labelled"], str(r["ts"])) == ("BANK_10", "BANK_11", 5.5, True, "2022-09-01 00:20:00")
    assert tuple(stats.first()) == (1, 1)
    with pytest.raises(ValueError, match="from_bank"):
        readers.detect_ledger_columns(["to bank", "x"])
    assert readers.scan_labelled_ledger(spark, str(tmp_path)).where("labelled").first()["from_account"] == "10.0_A1"


def test_columns_are_classified(spark):
    from riskflow.sources.columns import classify_columns

    rows = [(f, k, ["Posting Date", "Remarks", "DR.", "Amount Credited", "Clear Balance", "UTR", "Branch"], [f"0{k}/01/2024", f"paid to shop {k}", "" if k % 2 else "10.00", "1,000" if k % 2 else "", "5", f"R{k}7", "x"]) for f in ("a", "b") for k in range(1, 6)]
    got = classify_columns(spark.createDataFrame(rows, "file string, row long, header array<string>, cells array<string>"))
    fields = {(r["file"], r["col"]): r["field"] for r in got.collect()}
    want = ["txn_date", "narration", "debit_amount", "credit_amount", "balance_after", "reference_no"]
    assert fields == {(f, k): name for f in "ab" for k, name in enumerate(want)}
    assert classify_columns(spark.createDataFrame([], "file string, row long, header array<string>, cells array<string>")).count() == 0
