"""The tree loader's number of jobs, and files that tasks write against those of the driver."""

import uuid

import pytest

from lexgauge.sinks.reports import export_csv, write_corpora, write_csv
from lexgauge.sources.result_tree import load_tree, scan

KEY = "model_name,run_id,id,input_variant"


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def bundle(root, name, files):
    folder = root / name / "standard"
    folder.mkdir(parents=True)
    for i in range(files):
        more = f",c{i}" if i % 2 else ""
        (folder / f"run_{i}_raw_results.csv").write_text(f"﻿{KEY},request_success,total_latency_ms{more}\n{name},{i},a,standard,true,5{',x' if more else ''}\n", encoding="utf-8")
        (folder / f"run_{i}_rule_evaluation.csv").write_text(f"{KEY},rule_check_status\n{name},{i},a,standard,PASS\n", encoding="utf-8")


def test_jobs_do_not_grow_with_files_headers_or_bundles(spark, tmp_path):
    bundle(tmp_path / "few", "m0", 1)
    bundle(tmp_path / "few", "m1", 1)
    for n in range(5):
        bundle(tmp_path / "many", f"m{n}", 4)
    few, jobs = jobs_of(spark, lambda: load_tree(spark, str(tmp_path / "few")))
    many, more = jobs_of(spark, lambda: load_tree(spark, str(tmp_path / "many")))
    assert jobs == more
    rows = many.facts.collect()
    assert len(rows) == 20 and few.facts.count() == 2 and many.bundles == [f"m{n}" for n in range(5)]
    assert {(r.run_id, r.c1, r.c3) for r in rows} == {("0", None, None), ("1", "x", None), ("2", None, None), ("3", None, "x")}


def test_flat_folder_and_nothing(spark, tmp_path):
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "x_raw_results.csv").write_text(f"{KEY},request_success,total_latency_ms\nm,1,a,standard,true,5\nm,,b,,true,6\n")
    (tmp_path / "flat" / "x_rule_evaluation.csv").write_text("model_name,run_id,id,rule_check_status\nm,1,a,PASS\n,1,b,WARN\n")
    t = load_tree(spark, str(tmp_path / "flat"))
    assert t.bundles == ["flat"]
    got = {(r.model_name, r.run_id, r.id, r.input_variant, r.rule_check_status) for r in t.facts.collect()}
    assert got == {("m", "1", "a", "standard", "PASS"), ("m", "", "b", "", None), ("", "1", "b", "standard", "WARN")}
    (tmp_path / "none").mkdir()
    empty = load_tree(spark, str(tmp_path / "none"))
    assert empty.facts is None and empty.findings.count() == 0
    only = load_tree(spark, str(tmp_path / "flat"), models=["other"])
    assert only.facts is None and only.bundles == []


def test_files_are_read_as_wide_as_their_headers(spark, tmp_path):
    """Spark's reader does work for a short row that grows with the square of the width, so rows are not read 257 wide."""
    files = {"a": "\ufeffx,y,z\n1,2\n\"3\n,\",4,5,6\n", "b": "\r\n\r\nx,y\r\n7,8\r\n", "c": "p\n9\n", "d": ""}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    rows, heads = scan(spark, str(tmp_path))
    assert "_c3" not in rows._jdf.queryExecution().optimizedPlan().toString()
    name = lambda f: f.rsplit("/", 1)[1][0]
    assert {name(h.file): h.header for h in heads.collect()} == {"a": ["x", "y", "z"], "b": ["x", "y"], "c": ["p"]}
    got = {(name(r.file), r.record_no): r.cells for r in rows.collect()}
    assert got == {("a", 1): {"x": "1", "y": "2", "z": ""}, ("a", 2): {"x": "3\n,", "y": "4", "z": "5"}, ("b", 1): {"x": "7", "y": "8"}, ("c", 1): {"p": "9"}}


def test_headers_of_many_names(spark, tmp_path):
    """A name with a line break hides how many follow."""
    names = ['"a\nb"', *[f"c{i}" for i in range(99)]]
    (tmp_path / "w.csv").write_text(",".join(names) + "\n" + ",".join(map(str, range(100))) + "\n")
    rows, _ = scan(spark, str(tmp_path))
    cells = rows.first().cells
    assert len(cells) == 100 and cells["a\nb"] == "0" and cells["c98"] == "99"
    (tmp_path / "w.csv").write_text("a,b\n" + ",".join("1" * 257) + "\n")
    with pytest.raises(Exception, match="more than 256 columns"):
        scan(spark, str(tmp_path))[0].collect()


@pytest.mark.parametrize("n", [0, 5000])
def test_export_has_the_bytes_of_the_plain_writer(spark, tmp_path, n):
    rows = [(i * 7919 % 10007, f'a "quoted"\nline, {i}', i / 3 if i % 5 else None, i % 2 == 0, "日本語") for i in range(n)]
    df = spark.createDataFrame(rows, "k long, t string, x double, b boolean, u string").repartition(7).orderBy("k")
    names = ["u", "k", "t", "x", "b", "absent"]
    write_csv(df, tmp_path / "plain.csv", names)
    at = (tmp_path / "sub" / "tasks.csv").as_uri()
    export_csv(df, at, names)
    assert (tmp_path / "sub" / "tasks.csv").read_bytes() == (tmp_path / "plain.csv").read_bytes()
    with pytest.raises(FileExistsError):
        export_csv(df, at, names)
    export_csv(df.limit(0), at, ["k"], overwrite=True)
    assert (tmp_path / "sub" / "tasks.csv").read_bytes() == b"\xef\xbb\xbfk\r\n"
    assert not list((tmp_path / "sub").glob("*.parts-*"))


def test_corpora_are_aligned(spark, tmp_path):
    rows = [(f"i{i:04d}", "abc"[i % 7 % 3], f"s{i}\nx", None if i % 9 == 0 else f" t{i} ") for i in range(500)]
    df = spark.createDataFrame(rows, "id string, category string, source string, said string").repartition(6)
    write_corpora(df, tmp_path.as_uri(), ["source", "said"])
    for c in "abc":
        want = [r for r in rows if r[1] == c]
        joined = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name / f"category={c}").glob("part-*.txt")))
        assert joined("source") == "".join(f"{r[2].replace(chr(10), ' ')}\n" for r in want)
        assert joined("said") == "".join(f"{(r[3] or '').strip()}\n" for r in want)
