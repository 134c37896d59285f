import csv
import glob
import json
import random

import pytest
from datetime import datetime, timezone

from pyspark.sql import functions as F

import __spark_entry__ as E
from casegrid.operators.aggregate import outcome_counts, status_counts
from casegrid.operators.names import check_batches, stored_names
from casegrid.operators.report import iso_utc, ordered_report, report_rows, with_base_names
from casegrid.plans.triage import triage_rules
from casegrid.schema import REPORT_COLUMNS
from casegrid.sinks.publish import manifest_frame, read_report, write_report_csv


def _results(spark):
    rows = [("a1", "in/b/a.txt", ".txt", "Customer: Ann, Lee\nMy order, \"late\"", None),
            ("b1", "in/c.csv", ".csv", None, None),
            ("c1", "in/e.txt", ".txt", "  ", None)]
    docs = spark.createDataFrame(rows, "document_id string, source_file string, suffix string, "
                                       "text string, read_error string")
    t = datetime(2026, 1, 1, tzinfo=timezone.utc)
    return triage_rules(docs, started_at=t, completed_at=t)


def test_report_roundtrip(spark, tmp_path):
    rep = ordered_report(report_rows(_results(spark)))
    assert tuple(rep.columns) == REPORT_COLUMNS
    out = str(tmp_path / "report")
    write_report_csv(rep, out, single_file=True)
    files = glob.glob(out + "/*.csv")
    with open(files[0], newline="", encoding="utf-8") as fh:
        rows = list(csv.DictReader(fh))
    assert [r["document_id"] for r in rows] == ["a1", "b1", "c1"]
    a = rows[0]
    assert (a["status"], a["is_complaint"], a["email_generated"], a["error_code"]) == ("success", "true", "true", "")
    assert a["processed_at"] == "2026-01-01T00:00:00+00:00"
    assert rows[1]["is_complaint"] == "" and rows[1]["email_generated"] == "false"
    back = {r.document_id: r for r in read_report(spark, out).collect()}
    assert back["a1"].customer_name == "Ann" and back["c1"].error_code == "EMPTY_DOCUMENT"
    base = {r.document_id: r.source_file for r in with_base_names(rep).collect()}
    assert base == {"a1": "a.txt", "b1": "c.csv", "c1": "e.txt"}


def test_iso_timestamps(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1, 1, 2, 3, tzinfo=timezone.utc),),
                                (datetime(2026, 1, 1, 1, 2, 3, 450, tzinfo=timezone.utc),)], "t timestamp")
    got = sorted(r.s for r in df.select(iso_utc(F.col("t")).alias("s")).collect())
    assert got == ["2026-01-01T01:02:03+00:00", "2026-01-01T01:02:03.000450+00:00"]


def test_iso_timestamps_ignore_session_time_zone(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1, 1, 2, 3, tzinfo=timezone.utc),)], "t timestamp")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = df.select(iso_utc(F.col("t")).alias("s")).first().s
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == "2026-01-01T01:02:03+00:00"


def test_iso_timestamps_in_the_hour_that_daylight_saving_skips(spark):
    t = datetime(2026, 3, 8, 2, 30, tzinfo=timezone.utc)
    df = spark.createDataFrame([(t,), (t.replace(microsecond=7),)], "t timestamp")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(r.s for r in df.select(iso_utc(F.col("t")).alias("s")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2026-03-08T02:30:00+00:00", "2026-03-08T02:30:00.000007+00:00"]


def test_counts_on_empty_input_are_zero(spark):
    empty = _results(spark).where("false")
    c = outcome_counts(empty).first()
    assert (c.discovered, c.successful, c.failed, c.skipped) == (0, 0, 0, 0)
    assert status_counts(empty).count() == 0


def test_manifest_has_no_secrets_and_null_usage(spark):
    res = _results(spark)
    t = datetime(2026, 1, 1, tzinfo=timezone.utc)
    m = manifest_frame(spark, res, None, started_at=t, completed_at=t, report_path="r.csv",
                       config={"llm_provider": "rules", "api_key": "SECRET", "overwrite": False}).first()
    assert m.counts.discovered == 3 and m.token_usage is None
    assert "api_key" not in m.config.asDict() and m.config.llm_provider == "rules"


def _by_rule(rows):
    """{(batch, position): stored name} by the oracle's sequential rule."""
    import duckdb
    import pandas as pd

    from casegrid.plans.queries import names_rule_sql

    con = duckdb.connect()
    con.register("uploads", pd.DataFrame(rows, columns=["batch_id", "pos", "filename"]))
    found = con.execute(names_rule_sql("SELECT * FROM uploads") + " SELECT batch_id, pos, stored_name FROM named").fetchall()
    return {(b, p): n for b, p, n in found}


def test_upload_names_match_sequential_rule(spark):
    rnd = random.Random(3)
    pool = ["case.txt", "CASE.txt", "case_1.txt", "case_2.TXT", "case_1_1.txt", "a.pdf", "A.PDF",
            "a_1.pdf", "b.docx", "case.pdf"]
    rows = []
    for b in range(40):
        for pos in range(rnd.randint(1, 12)):
            rows.append((b, pos, rnd.choice(pool)))
    df = spark.createDataFrame(rows, "batch_id int, pos int, filename string")
    got = {(r.batch_id, r.pos): r.stored_name for r in stored_names(df).collect()}
    assert got == _by_rule(rows)
    fixed = spark.createDataFrame([(0, i, n) for i, n in enumerate(["case.txt", "CASE.txt", "case_1.txt", "case.txt"])],
                                  "batch_id int, pos int, filename string")
    assert [r.stored_name for r in stored_names(fixed).orderBy("pos").collect()] == \
        ["case.txt", "CASE_1.txt", "case_1_1.txt", "case_2.txt"]


def test_batch_name_check(spark):
    df = spark.createDataFrame([(1, 0, "dir/ok.txt"), (1, 1, "bad.exe"), (2, 0, "fine.PDF"), (3, 0, ".txt")],
                               "batch_id int, pos int, filename string")
    got = {(r.batch_id, r.pos): (r.name_error is None, r.batch_ok) for r in check_batches(df).collect()}
    assert got == {(1, 0): (True, False), (1, 1): (False, False), (2, 0): (True, True), (3, 0): (False, False)}


def test_no_upload_is_lost(spark):
    from casegrid.operators.names import accepted, quarantine

    rows = [(1, 0, "ok.txt"), (1, 1, None), (None, 0, "x.txt"), (2, 0, "a.txt"), (2, 1, "a.txt"), (3, 0, ""), (4, 0, "b.exe"), (4, 1, "c.pdf")]
    df = spark.createDataFrame(rows, "batch_id int, pos int, filename string")
    kept = sorted((r.batch_id, r.pos, r.stored_name) for r in stored_names(accepted(df)).collect())
    assert kept == [(2, 0, "a.txt"), (2, 1, "a_1.txt")]
    refused = {(r.batch_id, r.pos): r.reason for r in quarantine(df).collect()}
    assert len(refused) == 6 and all(refused.values())
    assert refused[(4, 1)] != refused[(4, 0)] and ".exe" in refused[(4, 0)]
    # Without the check, rows that cannot be named pass through unnamed.
    assert stored_names(df).count() == len(rows) and stored_names(df).where("stored_name IS NULL").count() == 2
    with pytest.raises(Exception, match="upload refused"):
        accepted(df, strict=True).collect()
    with pytest.raises(ValueError, match="at least one"):
        accepted(df.limit(0), strict=True)


def test_entry_contract(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"status", "error_code", "complaint_category", "n"}
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert "triage_summary" in q


def test_upload_rank_spans_chunks(spark, monkeypatch):
    import casegrid.operators.names as N

    monkeypatch.setattr(N, "RANK_CHUNK", 3)
    rows = [(7, pos, "Scan.PDF" if pos % 2 else "scan.pdf") for pos in range(0, 40, 1)]
    df = spark.createDataFrame(rows, "batch_id int, pos int, filename string")
    got = {(7, r.pos): r.stored_name for r in N.stored_names(df).collect()}
    assert got == _by_rule(rows)


@pytest.mark.parametrize("seed,chunk,block", [(11, 4, 1), (23, 3, 2), (5, 1 << 16, 1 << 16)])
def test_mixed_families_heavy_random(spark, monkeypatch, seed, chunk, block):
    import casegrid.operators.names as N

    monkeypatch.setattr(N, "RANK_CHUNK", chunk)
    monkeypatch.setattr(N, "CHILD_BLOCK", block)
    rnd = random.Random(seed)
    pool = ["case.txt", "CASE.TXT", "case_1.txt", "case_2.txt", "case_1_1.txt", "case_1_2.txt",
            "case_10.txt", "case_01.txt", "Case_3.Txt", "case_2_1.txt", "case.pdf", "case_1.pdf",
            "x_1_1_1.docx", "x.docx", "x_1.docx", "x_1_1.docx"]
    rows = []
    for b in range(150):
        positions = rnd.sample(range(0, 200), rnd.randint(1, 30))
        for pos in positions:
            rows.append((b, pos, rnd.choice(pool)))
    df = spark.createDataFrame(rows, "batch_id int, pos int, filename string")
    got = {(r.batch_id, r.pos): r.stored_name for r in stored_names(df).collect()}
    assert got == _by_rule(rows)


def test_one_family_of_many_names_stays_in_no_single_group(spark, monkeypatch):
    """100,000 distinct names of one family and many rows of its parent, against
    a walk in upload order; no group of names is larger than a block."""
    import casegrid.operators.names as N

    monkeypatch.setattr(N, "RANK_CHUNK", 10_000)
    monkeypatch.setattr(N, "CHILD_BLOCK", 30_000)
    rnd = random.Random(9)
    names = [f"scan_{k}.txt" for k in rnd.sample(range(1, 250_000), 100_000)] + ["Scan.txt"] * 60_000
    rnd.shuffle(names)
    used, want, free = set(), [], 1
    for n in names:
        if n.lower() not in used:
            stored = n
        elif n == "Scan.txt":
            while f"scan_{free}.txt" in used:
                free += 1
            stored = f"Scan_{free}.txt"
        else:
            stored = n[:-4] + "_1.txt"
        used.add(stored.lower())
        want.append(stored)
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "batch_id int, pos int, filename string")
    got = [r.stored_name for r in stored_names(df).select("pos", "stored_name").orderBy("pos").collect()]
    assert got == want


def test_empty_report_still_has_header(spark, tmp_path):
    out = str(tmp_path / "empty_report")
    write_report_csv(report_rows(_results(spark).where("false")), out, single_file=True)
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(out + "/*.csv"))
    assert text.splitlines()[0] == ",".join(REPORT_COLUMNS)


def test_status_messages_and_transient_kinds():
    from casegrid.operators.infer import ProviderError, status_message

    assert "403" in status_message(403) and "429" in status_message(429) and "404" in status_message(404)
    assert "500" in status_message(500) and status_message(None, "Acme") == "Acme: call failed"
    assert ProviderError("x", status=503).transient and ProviderError("x", kind="timeout").transient
    assert not ProviderError("x", status=401).transient


def test_run_timing(spark):
    from casegrid.operators.aggregate import run_timing

    t0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    t1 = datetime(2026, 1, 1, 0, 0, 2, tzinfo=timezone.utc)
    res = triage_rules(spark.createDataFrame([("a", "x/a.txt", ".txt", "order late", None)],
                                             "document_id string, source_file string, suffix string, "
                                             "text string, read_error string"),
                       started_at=t0, completed_at=t1)
    r = run_timing(res).first()
    assert r.max_duration_ms == 2000 and r.total_duration_ms == 2000


def test_payload_rows_defaults(spark):
    from casegrid.operators.report import payload_rows

    got = {r.document_id: r for r in payload_rows(_results(spark)).collect()}
    ok, skipped = got["a1"], got["b1"]
    assert ok.source_file == "a.txt" and ok.customer_email.startswith("# Subject:")
    assert ok.structured_data.startswith("{") and ok.structured_data != "{}"
    assert (skipped.customer_email, skipped.case_summary, skipped.structured_data) == ("", "", "{}")
    assert skipped.error_message == "UNSUPPORTED_FILE_TYPE" and skipped.case is None


def _many(spark):
    rows = [(f"d{i}", f"in/{'abc'[i % 3]}/{i:03d}.{'csv' if i % 5 == 0 else 'txt'}", ".csv" if i % 5 == 0 else ".txt",
             f'Customer: Zoë "Q" Ray\nOrder {i}, late\tagain \u2028 \\', None) for i in range(60)]
    docs = spark.createDataFrame(rows, "document_id string, source_file string, suffix string, text string, read_error string")
    t = datetime(2026, 1, 1, tzinfo=timezone.utc)
    return triage_rules(docs.repartition(4), started_at=t, completed_at=t)


def test_manifest_file_holds_header_and_results_in_report_order(spark, tmp_path):
    from casegrid.sinks.publish import write_manifest_file

    t, path = datetime(2026, 1, 1, tzinfo=timezone.utc), str(tmp_path / "run" / "manifest.json")
    for res in (_many(spark).where("false"), _many(spark)):  # the second takes the first one's place
        head = manifest_frame(spark, res, None, started_at=t, completed_at=t, report_path="r.csv", config={"llm_provider": "rules", "api_key": "S"})
        write_manifest_file(head, res, path)
        got = json.loads(open(path, encoding="utf-8").read())
        want = sorted(res.collect(), key=lambda r: r.source_file)
        assert got["results"] == [{"document_id": r.document_id, "source_file": r.source_file.split("/")[-1], "status": r.status,
                                   "error_code": r.error_code} for r in want]
        assert list(got) == ["started_at", "completed_at", "config", "counts", "token_usage", "report_path", "results"]
        assert got["token_usage"] is None and got["config"]["llm_provider"] == "rules" and got["config"]["model_name"] is None
        assert got["counts"]["discovered"] == len(want) and got["started_at"] == "2026-01-01T00:00:00+00:00" and "api_key" not in got["config"]
    assert [p.name for p in (tmp_path / "run").iterdir()] == ["manifest.json"]


def test_payload_file_holds_the_run(spark, tmp_path):
    from casegrid.sinks.publish import write_payload

    res, path = _many(spark), str(tmp_path / "payload.json")
    usage = spark.createDataFrame([("5", "3", "0"), ("1", "1", "9")], "prompt_tokens string, completion_tokens string, total_tokens string")
    write_payload(res, path, usage)
    got = json.loads(open(path, encoding="utf-8").read())
    assert list(got) == ["counts", "token_usage", "report_rows", "report_csv", "documents"]
    assert got["token_usage"] == {"calls": 2, "prompt_tokens": 6, "completion_tokens": 4, "total_tokens": 17}
    want = sorted(res.collect(), key=lambda r: r.source_file)
    assert got["counts"] == {"discovered": 60, "successful": 48, "failed": 0, "skipped": 12}
    assert [d["document_id"] for d in got["documents"]] == [r["document_id"] for r in got["report_rows"]] == [r.document_id for r in want]
    for d, r in zip(got["documents"], want, strict=True):
        assert d["case"] == (r.case.asDict() if r.case else None)
        assert (d["customer_email"], d["case_summary"], d["structured_data"]) == (r.customer_email or "", r.case_summary or "", r.structured_data or "{}")
    out = str(tmp_path / "report")
    write_report_csv(ordered_report(report_rows(res)), out, single_file=True)
    assert got["report_csv"] == open(glob.glob(out + "/*.csv")[0], encoding="utf-8", newline="").read()
    assert got["report_rows"] == [dict(r, source_file=r["source_file"].split("/")[-1])
                                  for r in csv.DictReader(got["report_csv"].splitlines())]
    write_payload(res.where("false"), path, with_csv=False)
    assert json.loads(open(path, encoding="utf-8").read()) == {
        "counts": {"discovered": 0, "successful": 0, "failed": 0, "skipped": 0}, "token_usage": None, "report_rows": [], "documents": []}


def test_lines_are_joined_across_blocks_and_files(tmp_path, monkeypatch):
    from casegrid.sinks import jsondoc

    parts = [b"", b'{"a":1}\n{"a":2}\n', b'{"a":3}\n', b"", b'{"a":4}\n']
    paths = [str(tmp_path / f"{i}") for i in range(len(parts))]
    for p, data in zip(paths, parts, strict=True):
        open(p, "wb").write(data)
    for block in (1, 3, 8, 1 << 20):
        monkeypatch.setattr(jsondoc, "BLOCK", block)
        assert json.loads(b"".join(jsondoc.pieces([("x", paths, False), ("y", "null", False), ("z", paths[:1], False)]))) == {
            "x": [{"a": i} for i in (1, 2, 3, 4)], "y": None, "z": []}
