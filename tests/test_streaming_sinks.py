import json
import os

import pytest
from pyspark.sql import functions as F

from casegrid.operators.report import report_rows
from casegrid.plans.triage import triage_rules
from casegrid.sinks import documents
from casegrid.sinks.documents import publish_documents, with_publish_errors
from casegrid.sinks.publish import published_ids, write_results
from casegrid.streaming.incremental import CANDIDATE_SCHEMA, start_incremental


def _batch(spark, rows, path):
    spark.createDataFrame(rows, CANDIDATE_SCHEMA).write.mode("append").parquet(path)


def test_incremental_run_resumes(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    _batch(spark, [("a", "in/a.txt", ".txt", "My order is late", None),
                   ("b", "in/b.csv", ".csv", None, None)], src)
    q = start_incremental(spark, src, out, ck)
    q.awaitTermination(120)
    first = {r.document_id: r.status for r in spark.read.parquet(out).collect()}
    assert first == {"a": "success", "b": "skipped"}
    # a second file arrives: a new document and a re-sent one
    _batch(spark, [("c", "in/c.txt", ".txt", "Refund please", None),
                   ("a", "in/a.txt", ".txt", "My order is late", None)], src)
    q = start_incremental(spark, src, out, ck)
    q.awaitTermination(120)
    rows = spark.read.parquet(out).where("run_id != 'epoch-0'").collect()
    assert {r.document_id: r.error_code for r in rows} == {"c": None, "a": "ARTIFACTS_EXIST"}


def test_a_replay_leaves_the_same_rows(spark, tmp_path):
    """The same epoch, and the same batch under its run id, run twice."""
    docs = spark.createDataFrame([("a", "in/a.txt", ".txt", "My order is late", None)], CANDIDATE_SCHEMA)
    path = str(tmp_path / "results")
    for run_id in ("epoch-0", "epoch-0", "nightly", "nightly"):
        write_results(triage_rules(docs, published=published_ids(spark, path, run_id)), path, run_id)
        rows = {r.run_id: (r.status, r.error_code) for r in spark.read.parquet(path).collect()}
        assert rows["epoch-0"] == ("success", None)
    assert rows["nightly"] == ("failed", "ARTIFACTS_EXIST")


def test_a_storage_error_is_not_an_empty_table(spark, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        published_ids(spark, str(tmp_path / "broken"))


def test_results_table_and_export(spark, tmp_path):
    docs = spark.createDataFrame([("a", "in/a.txt", ".txt", "Customer: Bo Li\nOrder late", None)],
                                 CANDIDATE_SCHEMA)
    res = triage_rules(docs)
    path = str(tmp_path / "results")
    write_results(res, path, "r1")
    write_results(res.withColumn("status", F.lit("failed")), path, "r2")
    write_results(res, path, "r2")  # replacing a run leaves other runs alone
    t = spark.read.parquet(path)
    assert sorted(r.run_id for r in t.collect()) == ["r1", "r2"]
    assert published_ids(spark, path).distinct().count() == 1
    assert published_ids(spark, str(tmp_path / "none")) is None


FOLDERS = (("structured_data", "json"), ("customer_emails", "md"), ("case_summaries", "md"))


def files_below(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(root) for f in fs}


def test_sets_appear_whole_or_the_prior_one_stays(spark, tmp_path):
    rows = [(i, f"in/{i}.txt", ".txt", f"Customer: Bo Li\nOrder {i} is late, señor", None) for i in "abcde"] + [("x", "in/x.csv", ".csv", None, None),
            ("a", "in/z.txt", ".txt", "Order late too", None)]
    res = triage_rules(spark.createDataFrame(rows, CANDIDATE_SCHEMA).repartition(3))
    out = str(tmp_path / "export")
    for folder, ext in FOLDERS:  # prior sets of b and c
        for i in "bc":
            documents.storage.make_folder(f"{out}/{folder}")
            documents.storage.write_bytes(f"{out}/{folder}/{i}.{ext}", f"old {folder} {i}".encode())
    os.remove(f"{out}/case_summaries/c.md")
    os.makedirs(f"{out}/case_summaries/c.md/taken")  # the third file of c and of d cannot be put in place
    os.makedirs(f"{out}/case_summaries/d.md")
    got = {(r.document_id, r.source_file): r.error for r in publish_documents(res, out).collect()}
    assert got == {("a", "in/a.txt"): None, ("b", "in/b.txt"): None, ("e", "in/e.txt"): None, ("c", "in/c.txt"): "IsADirectoryError",
                   ("d", "in/d.txt"): "IsADirectoryError", ("a", "in/z.txt"): "FileExistsError"}
    want = {r.document_id: r for r in res.where("status = 'success' and source_file != 'in/z.txt'").collect()}
    files = files_below(out)
    assert set(files) == {f"{folder}/{i}.{ext}" for folder, ext in FOLDERS for i in "abe"} | {"structured_data/c.json", "customer_emails/c.md"}
    for i in "abe":
        assert json.loads(files[f"structured_data/{i}.json"]) == json.loads(want[i].structured_data)
        assert files[f"structured_data/{i}.json"] == json.dumps(json.loads(want[i].structured_data), indent=2) + "\n"
        assert files[f"customer_emails/{i}.md"] == want[i].customer_email and files[f"case_summaries/{i}.md"] == want[i].case_summary
    assert files["structured_data/c.json"] == "old structured_data c" and files["customer_emails/c.md"] == "old customer_emails c"


def test_publish_errors_reach_report_and_counts(spark, tmp_path):
    rows = [("a", "in/a.txt", ".txt", "Order late", None), ("b", "in/b.txt", ".txt", "Order late", None), ("c", "in/c.csv", ".csv", None, None)]
    res = triage_rules(spark.createDataFrame(rows, CANDIDATE_SCHEMA))
    out = str(tmp_path / "out")
    os.makedirs(f"{out}/structured_data/b.json")
    done = with_publish_errors(res, publish_documents(res, out))
    assert done.columns == res.columns
    assert {r.document_id: (r.status, r.error_code, r.error_message) for r in done.collect()} == {
        "a": ("success", None, None), "b": ("failed", "DOCUMENT_PROCESS_ERROR", "IsADirectoryError"),
        "c": ("skipped", "UNSUPPORTED_FILE_TYPE", "UNSUPPORTED_FILE_TYPE")}
    b = {r.document_id: r for r in report_rows(done).collect()}["b"]
    assert (b.status, b.email_generated, b.error_code, b.complaint_category) == ("failed", "false", "DOCUMENT_PROCESS_ERROR", "")


def test_a_publish_task_run_again_goes_on_where_it_stopped(tmp_path, monkeypatch):
    out, staged = str(tmp_path), str(tmp_path / "s" / "0")
    storage = documents.storage
    storage.make_folder(str(tmp_path / "s"))
    for i, (folder, ext) in enumerate(FOLDERS):
        storage.make_folder(f"{out}/{folder}")
        storage.write_bytes(f"{out}/{folder}/a.{ext}", b"old")
        storage.write_bytes(documents._staged_names(staged)[i], b"new")
    real, moves = storage.move, []

    def stop_at(n, error):
        def move(source, target):
            moves.append(source)
            if len(moves) == n:
                raise error
            real(source, target)
        return move

    monkeypatch.setattr(storage, "move", stop_at(4, KeyboardInterrupt()))  # the worker is killed
    with pytest.raises(KeyboardInterrupt):
        documents.publish_set(out, "r", "a", staged)
    monkeypatch.setattr(storage, "move", real)
    assert documents.publish_set(out, "r", "a", staged) is None
    assert {storage.read_bytes(documents.artifact_path(out, i, "a")) for i in range(3)} == {b"new"}
    # A move that fails, on a second set: the first one stays, also when asked again.
    for name in documents._staged_names(staged):
        storage.write_bytes(name, b"newer")
    moves.clear()
    monkeypatch.setattr(storage, "move", stop_at(6, PermissionError("no")))
    assert documents.publish_set(out, "r", "a", staged) == "PermissionError"
    assert documents.publish_set(out, "r", "a", staged) == "PermissionError"
    assert {storage.read_bytes(documents.artifact_path(out, i, "a")) for i in range(3)} == {b"new"}
    assert not [f for f in files_below(out) if f.endswith(".bak") or f.startswith("s/0.json")]


def test_an_aborted_job_leaves_nothing(tmp_path):
    writer = documents.DocumentSetWriter({"path": str(tmp_path / ".publish-x")})
    documents.storage.make_folder(str(tmp_path / ".publish-x" / "0-0-a"))
    writer.abort([None])
    assert os.listdir(tmp_path) == []


def test_publishing_nothing(spark, tmp_path):
    res = triage_rules(spark.createDataFrame([], CANDIDATE_SCHEMA))
    assert publish_documents(res, str(tmp_path / "out")).count() == 0


def test_publishing_runs_the_triage_once(spark, monkeypatch):
    from casegrid.plans import queries as Q

    rows, real = spark.sparkContext.accumulator(0), Q._results

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    def results(spark, sf_dir):
        df = real(spark, sf_dir)
        return df.mapInArrow(counted, df.schema)

    monkeypatch.setattr(Q, "_results", results)
    got = Q.q_publish_outcomes(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and rows.value == 200
    assert {r.files for r in got} == {0, 3}
