"""Readers, writers, inventories, and the streaming counters."""

import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veldt.operators import checks
from veldt.sources import files, matches, tables
from veldt.streaming import counters, ingest


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "NA")], "k int, v string")
    tables.write(df, str(tmp_path / "t.parquet"))
    assert tables.read(spark, str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(PySparkException):
        tables.write(df, str(tmp_path / "t.parquet"))
    tables.write(df, str(tmp_path / "t.parquet"), append=True)
    assert tables.require_rows(tables.read(spark, str(tmp_path / "t.parquet")), 4)
    tables.write(df, str(tmp_path / "t.csv.gz"), order=["k"])
    rows = tables.read(spark, str(tmp_path / "t.csv.gz")).orderBy("k").collect()
    assert [r["v"] for r in rows] == ["a", None]  # a missing-value text
    tables.write(spark.range(10).coalesce(1), str(tmp_path / "s.parquet"), rows_per_file=4)
    assert len(list((tmp_path / "s.parquet").glob("*.parquet"))) == 3
    with pytest.raises(checks.IntegrityError):
        tables.require_rows(df, 3)


def test_json(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        json.dump([{"a": 3}], f)
    assert tables.read(spark, str(tmp_path / "e.json")).count() == 2 and tables.read(spark, str(tmp_path / "g.json.gz")).first()["a"] == 3


def test_events_of_matches(spark):
    events = spark.createDataFrame([("e1", "1", "Pass", "[1, 2]"), ("e2", "1", "Shot", None), ("e3", "2", "Pass", None)], "id string, match_id string, type string, location string")
    matches = spark.createDataFrame([("1", "A"), ("1", "A"), ("2", "B")], "match_id string, home_team string")
    got = tables.passes(events, matches)
    assert got.columns == [f.name for f in tables.PASS_SCHEMA] and "period" in got.columns
    assert {r["id"]: r["home_team"] for r in got.collect()} == {"e1": "A", "e3": "B"}


def test_role_scan_refuses_unknown_matches(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "m int, v double")
    roles = spark.createDataFrame([(1, "train")], "m int, role string")
    with pytest.raises(PySparkException):
        tables.scan_by_role(df, ["m", "v"], roles, "m", ["train"]).collect()
    with pytest.raises(checks.IntegrityError):
        tables.scan(df, ["m", "zzz"])


def test_scan_with_total(spark):
    rows, seen = tables.with_total(spark.createDataFrame([(1, 1.0), (2, 2.0)], "m int, v double"), "v")
    assert rows.where("m = 1").count() == 1
    rows.collect()
    assert seen.get == {"total": 3.0, "n": 2}


def test_manifest(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert tables.manifest(df, ["k"], ["v"], "first").count() == 1
    with pytest.raises(checks.IntegrityError):
        tables.manifest(df, ["k"], ["v"])


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert tables.with_retries(flaky, sleep=waits.append) == "done" and len(waits) == 2 and 1 <= waits[0] <= 1.8 and 2 <= waits[1] <= 2.8
    with pytest.raises(OSError):
        tables.with_retries(lambda: (_ for _ in ()).throw(OSError("no")), most=2, sleep=waits.append)


def test_inventory_tells_kinds_and_matches(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/events_12.json").write_text('[{"id": 1}]')
    (tmp_path / "sub/events_13.json").write_text('\ufeff {"events": []}')
    with gzip.open(tmp_path / "sub/12.json.gz", "wt") as f:
        json.dump([{"a": 3}], f)
    (tmp_path / "sub/14.json.gz").write_bytes(b"\x1f\x8bbroken")
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    (tmp_path / "15.json").write_text("")
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    with open(tmp_path / "large_16.csv", "wb") as f:
        f.write(b"a,b\n")
        f.truncate(3 << 30)  # more than a file's content may have in a row
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    want = {"events_12.json": ("json list", "12"), "events_13.json": ("json events", "13"), "12.json.gz": ("json list", "12"), "14.json.gz": ("unreadable", "14"), "t.csv": ("table", None), "15.json": ("empty", "15"), "large_16.csv": ("table", "16")}
    assert {k: (got[k]["kind"], got[k]["match_id"]) for k in want} == want
    assert got["large_16.csv"]["bytes"] == 3 << 30 and got["12.json.gz"]["extension"] == ".json.gz" and got["14.json.gz"]["error"]
    assert [r["kind"] for n, r in got.items() if n.endswith(".parquet")] == ["parquet"]
    rows = {(r["extension"], r["kind"]): r for r in files.summary(files.inventory(spark, str(tmp_path / "sub"))).collect()}
    assert rows[".json", "json list"]["matches"] == 1 and rows[".json.gz", "unreadable"]["files"] == 1
    expected = spark.createDataFrame([(12,), (13,), (14,), (99,), (None,)], "match_id int")
    state = {r["match_id"]: (r["state"], r["files"]) for r in files.diagnosis(files.inventory(spark, str(tmp_path / "sub")), expected).collect()}
    assert state == {"12": ("repeated", 2), "13": ("ok", 1), "14": ("unreadable", 1), "99": ("missing", 0)}


def test_manifests_tell_what_changed(spark, tmp_path, monkeypatch):
    import hashlib
    import subprocess

    monkeypatch.setattr(files, "CHUNK", 1000)
    root = tmp_path / "data"
    (root / "a b").mkdir(parents=True)
    for name, content in (("a b/x.bin", bytes(range(256)) * 50), ("y", b""), ("z.txt", b"text"), ("w", b"w")):
        (root / name).write_bytes(content)
    found = {r["path"]: r for r in files.relative(files.hashes(spark, str(root)), str(root)).collect()}
    said = dict(reversed(line.split("  ", 1)) for line in subprocess.run("find . -type f -printf '%P\\n' | xargs -d '\\n' sha256sum", shell=True, cwd=root, capture_output=True, text=True).stdout.splitlines())
    assert {k: r["sha256"] for k, r in found.items()} == said and found["y"]["sha256"] == hashlib.sha256().hexdigest()
    files.write_manifest(files.relative(files.hashes(spark, str(root)), str(root)), str(tmp_path / "manifest"))
    (root / "z.txt").write_bytes(b"Text")
    (root / "w").rename(root / "v")
    now = files.relative(files.hashes(spark, str(root)), str(root))
    state = {r["path"]: r["state"] for r in files.verify(spark.read.parquet(str(tmp_path / "manifest")), now).collect()}
    assert state == {"z.txt": "changed", "w": "lost", "v": "new"}


def test_staged_matches_are_read_selectively(spark, tmp_path):
    rows = [("1", 1, "Pass", [1.0, 2.0]), ("1", 2, "Shot", None), ("2", 3, "Pass", [0.5]), (None, 4, "Pass", None)]
    events = spark.createDataFrame(rows, "match_id string, id int, type string, location array<double>")
    assert matches.stage(events, str(tmp_path / "in/a"), packed=True) == 2
    (tmp_path / "in/b").mkdir()
    (tmp_path / "in/b/match_77.json").write_text('{"events": [{"id": 9, "type": "Pass", "more": {"x": 1}}]}')
    (tmp_path / "in/b/match_78.json").write_text('[{"id": ')
    (tmp_path / "in/b/readme.txt").write_text("not an event file")
    schema = "match_id string, id int, type string, location array<double>, more string"
    with pytest.raises(PySparkException):
        matches.read(spark, str(tmp_path / "in"), schema).collect()  # a broken file is an error of the read
    status = {r["match_id"]: (r["status"], r["n_events"]) for r in matches.read(spark, str(tmp_path / "in"), report=True).collect()}
    assert status == {"1": ("success", 2), "2": ("success", 1), "77": ("success", 1), "78": ("failed", 0)}
    (tmp_path / "in/b/match_78.json").unlink()
    df = matches.read(spark, str(tmp_path / "in"), schema)
    assert {tuple(r) for r in df.select("match_id", "id", F.size("location"), "more").collect()} == {("1", 1, 2, None), ("1", 2, None, None), ("2", 3, 1, None), ("77", 9, None, '{"x": 1}')}
    root = str(tmp_path / "in")
    wanted, other = matches.read(spark, root, schema, {"type": "Pass"}), matches.read(spark, root, schema, {"type": "Shot"})
    assert sorted(r["id"] for r in wanted.where("id > 1").collect()) == [3, 9] and [r["id"] for r in other.collect()] == [2]
    assert wanted.join(other.select("match_id"), "match_id").count() == 1 and df.count() == 4
    one = matches.read(spark, root, schema, {"match_id": "2"})
    assert one.rdd.getNumPartitions() == 1 and df.rdd.getNumPartitions() == 3 and one.count() == 1
    assert matches.read(spark, root, schema, {"match_id": "5"}).count() == 0


def test_many_staged_matches_share_partitions(spark, tmp_path):
    root = str(tmp_path / "in")
    events = spark.range(60).selectExpr("cast(id % 20 as string) as match_id", "id", "if(id % 2 = 0, 'Pass', 'Shot') as type")
    assert matches.stage(events, root) == 20
    (tmp_path / "in/events_99.json").write_text("[1]")
    status = matches.read(spark, root, report=True, slices=3)
    assert status.rdd.getNumPartitions() == 3
    assert {r["match_id"]: (r["status"], r["n_events"]) for r in status.collect()} == {str(i): ("success", 3) for i in range(20)} | {"99": ("failed", 0)}


def test_selected_events_of_many_matches_share_partitions(spark, tmp_path):
    root = str(tmp_path / "in")
    events = spark.range(60).selectExpr("cast(id % 20 as string) as match_id", "id", "if(id % 2 = 0, 'Pass', 'Shot') as type")
    assert matches.stage(events, root, packed=True) == 20
    df = matches.read(spark, root, "match_id string, id bigint, type string", {"type": "Pass"}, slices=3)
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r["match_id"], r["id"]) for r in df.collect()) == sorted((str(i % 20), i) for i in range(0, 60, 2))


def test_ingest_resumes_after_a_failure(spark, tmp_path):
    def batch(n, matches, value=1.0):
        spark.createDataFrame([(m, i, value) for m in matches for i in range(3)], "match_id int, i int, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    def run(after=None):
        stream = ingest.staged(spark, str(tmp_path / "in"), "match_id int, i int, v double", most=1)
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), "match_id", after).awaitTermination()

    def stored():
        return sorted((r["match_id"], r["i"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    seen = []

    def fails(number):
        seen.append(number)
        if number == 1:
            raise RuntimeError("killed after the batch was written, before it was noted")

    for n in range(3):
        batch(n, [2 * n, 2 * n + 1])
    with pytest.raises(Exception, match="killed"):
        run(fails)
    assert seen == [0, 1] and len(stored()) == 12
    again = []
    run(again.append)
    assert again == [1, 2] and stored() == [(m, i, 1.0) for m in range(6) for i in range(3)]
    run(again.append)
    assert again == [1, 2]  # nothing new, nothing done
    batch(3, [4], 2.0)
    run()
    assert stored() == [(m, i, 2.0 if m == 4 else 1.0) for m in range(6) for i in range(3)]


def test_stored_batches_are_partitions_and_matches_are_replaced(spark, tmp_path):
    def store(n, matches, value, state="state"):
        spark.createDataFrame([(m, i, value) for m in matches for i in range(2)], "match_id int, i int, v double").coalesce(1).write.parquet(str(tmp_path / f"{state}-in/{n}"))
        stream = ingest.staged(spark, str(tmp_path / f"{state}-in"), "match_id int, i int, v double")
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / state), "match_id").awaitTermination()

    def stored():
        return sorted((r["match_id"] or 0, r["i"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def folders():
        return sum(1 for x in (tmp_path / "out").iterdir() if x.is_dir() and "=" in x.name)

    store(0, range(1, 41), 1.0)
    assert folders() == 1  # and not one a match
    store(1, [7, 50, None], 2.0)
    assert folders() == 2 and stored() == sorted((m, i, 2.0 if m in (0, 7, 50) else 1.0) for m in (*range(41), 50) for i in range(2))
    store(2, [None, 7, 50], 3.0)  # all that the second batch held
    assert folders() == 2 and stored() == sorted((m, i, 3.0 if m in (0, 7, 50) else 1.0) for m in (*range(41), 50) for i in range(2))
    store(0, [60], 4.0, "other")  # the first batch of another query replaces no batch
    assert len(stored()) == 2 * 43 and folders() == 3


def test_reports(spark):
    df = spark.createDataFrame([("A", 1.5), ("B", 2.5)], "t string, v double")
    assert json.loads(tables.audit_json(df, "rows"))["rows"][1] == {"t": "B", "v": 2.5}
    assert tables.report(df, "%s has %.1f", ["t", "v"], ["t"]) == "A has 1.5\nB has 2.5"


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in"))
    q = counters.running_counts(stream, ["k"], "v").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r["k"]: (r["n"], r["total"]) for r in spark.table("counts").collect()} == {"a": (2, 3.0), "b": (1, 5.0)}
