"""Files written by jobs, files that arrive, and state that ends."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lingloom.sources import files as S
from lingloom.sources import sink
from lingloom.sources.tables import languages
from lingloom.streaming import jobs

UNIT = '<xliff><trans-unit id="1"><source>{}</source></trans-unit></xliff>'


def tree(path) -> list[str]:
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_files_are_written_under_their_names(spark, tmp_path):
    (tmp_path / "old.txt").write_text("old")
    df = spark.createDataFrame([("a.txt", b"A"), ("b é.txt", None), ("old.txt", b"new")], "name string, content binary").repartition(3)
    sink.write_files(df, str(tmp_path))
    assert tree(tmp_path) == ["a.txt", "b é.txt", "old.txt"] and (tmp_path / "old.txt").read_bytes() == b"new" and (tmp_path / "a.txt").read_bytes() == b"A"


@pytest.mark.parametrize("rows", [[("a", b"1"), ("b", b"2"), ("x/y", b"3")], [("a", b"1"), ("b", b"2"), ("a", b"3")], [(None, b"1"), ("a", b"1")]])
def test_a_failed_job_leaves_nothing(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    with pytest.raises(Exception, match="no name for a file|two rows of one name"):
        sink.write_files(df, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_export_names_and_gates(spark, tmp_path):
    for d in ("x", "y", "z"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.b.xliff").write_text(UNIT.format(f"{d} rope"))
    found = S.read_files(spark, str(tmp_path))
    segments = S.xliff_segments(S.xml_documents(found))
    results = segments.select("doc_id", "segment_id", F.lit("completed").alias("status"), F.upper("source_text").alias("translated_raw"), F.upper("source_text").alias("translated_text"))
    gates = found.select("doc_id", F.contains("doc_id", F.lit("/y/")).alias("blocked"))
    out = str(tmp_path / "out")
    names = sink.export_documents(found, segments, results, out, F.lit("hi"), languages(spark), gates)
    assert tree(out) == ["a.b_hindi (3).xliff", "a.b_hindi.xliff"] and sorted(r.name for r in names.collect()) == tree(out)
    assert "<target>X ROPE</target>" in open(f"{out}/a.b_hindi.xliff").read()


def package(text: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(S.DOCUMENT_MEMBER, text)
    return out.getvalue()


def test_a_member_is_inflated_no_further_than_the_bound(spark):
    bomb, fine = package(b" " * 5_000_000), package(b"<w:p><w:r><w:t>x</w:t></w:r></w:p>")
    df = spark.createDataFrame([("a", bomb), ("b", fine)], "doc_id string, content binary")
    got = {r.doc_id: r for r in S.unpacked(df, max_inflated=1_000_000).collect()}
    assert len(bomb) < 10_000 and got["a"].xml is None and "larger than 1000000 bytes" in got["a"].error_message and got["b"].error_message is None


def test_arriving_files_equal_the_batch(spark, tmp_path):
    src, home = tmp_path / "in", tmp_path / "home"
    src.mkdir()
    first = {"a.xliff": UNIT.format("one"), "empty.xliff": " ", "n.txt": "x", "none.mqxliff": "<x/>"}
    for name, text in first.items():
        (src / name).write_text(text)
    (src / "big.xml").write_text(UNIT.format("w" * 5000))

    def run():
        jobs.ingest(jobs.arriving_files(spark, str(src), per_batch=2), str(home), str(home / "state"), max_bytes=4000).awaitTermination()

    run()
    assert {r.source_text for r in spark.read.parquet(str(home / "segments")).collect()} == {"one"}
    (src / "sub").mkdir()
    (src / "sub" / "b.xliff").write_text(UNIT.format("two"))
    (src / "d.docx").write_bytes(package(b"<w:p><w:r><w:t>three</w:t></w:r></w:p>"))
    (src / "broken.docx").write_bytes(b"no")
    run()
    run()
    found = S.read_files(spark, str(src))
    ok, rejected = S.split_acceptable(found, 4000)
    batch = S.read_xliff(spark, str(src)).where("not doc_id like '%big.xml'").unionByName(S.read_docx(spark, str(src)))
    got = spark.read.parquet(str(home / "segments")).select("doc_id", "segment_id", "source_text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("doc_id", "segment_id", "source_text").collect())) and got.count() == 3
    bad = {tuple(r) for r in rejected.select("doc_id", "error_message").unionByName(S.scan_errors(ok)).collect()}
    assert {(r.doc_id, r.error_message) for r in spark.read.parquet(str(home / "quarantine")).collect()} == bad and len(bad) == 5


def test_state_of_finished_jobs_goes(spark, tmp_path):
    rows = [(f"j{k}", "failed" if i == 1 else "completed", 3) for k in range(40) for i in range(3 if k % 4 else 2)]
    schema = "job_id string, status string, expected int"
    (tmp_path / "in").mkdir()
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.run_available(jobs.stream_progress_until_done(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 10
    out = jobs.latest(spark.read.parquet(str(tmp_path / "out")), ["job_id"]).collect()
    assert {r.job_id: (r.total, r.completed, r.failed, r.finished) for r in out} == {f"j{k}": (3, 2, 1, True) if k % 4 else (2, 1, 1, False) for k in range(40)}


def test_the_driver_lists_and_moves_no_names(spark, tmp_path):
    for k in range(7):
        (tmp_path / "in" / f"{k % 2}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"{k % 2}" / f"f{k} é.xliff").write_text(UNIT.format(k))
    (tmp_path / "in" / "_staging-x").mkdir()
    (tmp_path / "in" / "_staging-x" / "h.xliff").write_text("hidden")
    (tmp_path / "in" / "x.XML").write_text("<x/>")
    found = S.read_files(spark, str(tmp_path / "in"), S.PATTERNS["xliff"])
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", S.PATTERNS["xliff"]).load(str(tmp_path / "in"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, S.file_rows(plain).collect())) and found.count() == 8
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "in" / "late.xml").write_text("<x/>")
    assert found.count() == 8  # as it was when it was read
    assert not [f for f in sink.Written.__dataclass_fields__ if f == "names"]


def test_a_list_of_arrivals_names_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log, total = str(tmp_path / "log"), 0
    for new in (0, 5, 0, 4):
        for k in range(new):
            (tmp_path / "in" / f"{total + k}.xml").write_text("<x/>")
        total += new
        jobs.arriving_files(spark, str(tmp_path / "in"), per_batch=2).stream(log)
        rows = spark.read.parquet(log).select("path", F.input_file_name().alias("at")).collect()
        assert len(rows) == len({r.path for r in rows}) == total
    assert max(sum(r.at == x.at for r in rows) for x in rows) <= 2


def test_tasks_that_go_on_cannot_bring_a_staging_folder_back(tmp_path):
    w = sink.FileWriter(str(tmp_path)).begin()
    store, root = sink.store_of(str(tmp_path))
    w.abort([])
    with pytest.raises(OSError):
        store.create_dir(f"{w._staging(root)}/0-0", recursive=False)
    assert os.listdir(tmp_path) == []


def test_one_name_twice_in_a_task(spark, tmp_path):
    df = spark.createDataFrame([("a", b"1"), ("a", b"2")], "name string, content binary").coalesce(1)
    with pytest.raises(Exception, match="two rows of one name"):
        sink.write_files(df, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_globs_as_patterns():
    import re

    from lingloom.sources.listing import as_pattern

    for glob, names, no in ((S.PATTERNS["docx"], ["a.docx", ".DOCX", "a.b.dOcX"], ["docx", "a.docxx"]), (S.PATTERNS["xliff"], ["a.XML", "b.mqxliff"], ["a.xm", "xml", "a.xmls"]), ("a?,[!b]*", ["ax,c", "a,,cd"], ["ax,b", "a,c"])):
        assert all(re.fullmatch(as_pattern(glob), n) for n in names) and not any(re.fullmatch(as_pattern(glob), n) for n in no)


def test_exported_files_are_opened_once_and_not_named_by_the_driver(spark, tmp_path):
    import pickle

    from lingloom.plans import queries_flow as Q

    plan = Q.k11_k9_export_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and len([x for x in plan.splitlines() if "MapInArrow" in x and "content" in x]) == 1
    w = sink.FileWriter(str(tmp_path)).begin()
    store, root = sink.store_of(str(tmp_path))
    store.create_dir(f"{w._staging(root)}/0-0", recursive=False)
    for k in range(3000):
        (tmp_path / f"_staging-{w.run}" / "0-0" / f"f{k}").touch()
    message = sink.Written(f"{w._staging(root)}/0-0", 3000)
    assert len(pickle.dumps(message)) < 500
    w.commit([message, None])
    assert len(os.listdir(tmp_path)) == 3000 and not [x for x in os.listdir(tmp_path) if x[0] == "_"]
