"""Record files: byte ranges, parallel writes, failures, digests."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from latticeflow.functions.records import old_packed, old_unpacked
from latticeflow.sources import record_files, sinks


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"), F.encode(F.lpad(F.col("id").cast("string"), 10, "0"), "UTF-8").alias("record"))


def test_many_tasks_write_and_read_one_file(spark, tmp_path):
    path = str(tmp_path / "r.bin")
    record_files.write(numbered(spark, 5000).repartition(7), path, 10, b"head")
    assert open(path, "rb").read() == b"head" + b"".join(b"%010d" % i for i in range(5000))
    back = record_files.read(spark, path, 10, 4, split=1000)
    assert back.rdd.getNumPartitions() == 50
    assert [(r.idx, bytes(r.record)) for r in back.orderBy("idx").collect()] == [(i, b"%010d" % i) for i in range(5000)]
    some = record_files.read(spark, path, 10, 4, first=1234, end=1300, split=1000)
    assert some.rdd.getNumPartitions() == 1 and sorted(r.idx for r in some.collect()) == list(range(1234, 1300))
    record_files.write(numbered(spark, 3), path, 10)
    assert open(path, "rb").read() == b"".join(b"%010d" % i for i in range(3)) and os.listdir(tmp_path) == ["r.bin"]


def test_filters_bound_the_ranges(spark, tmp_path):
    path = str(tmp_path / "r.bin")
    record_files.write(numbered(spark, 1000), path, 10)
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        df = record_files.read(spark, path, 10, split=100).where("idx >= 250 AND idx < 260 AND record IS NOT NULL")
        assert df.rdd.getNumPartitions() == 1 and sorted(r.idx for r in df.collect()) == list(range(250, 260))
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize(("change", "why"), [("idx + CASE WHEN idx > 5 THEN 1 ELSE 0 END", "missing"), ("idx - CASE WHEN idx = 9 THEN 1 ELSE 0 END", "twice"), ("idx + 1", "missing")])
def test_places_must_be_filled_once(spark, tmp_path, change, why):
    with pytest.raises(Exception, match=why):
        record_files.write(numbered(spark, 10).selectExpr(f"{change} AS idx", "record").repartition(3), str(tmp_path / "r.bin"), 10)
    assert os.listdir(tmp_path) == []


def test_a_failed_write_leaves_the_file_before(spark, tmp_path):
    path = str(tmp_path / "r.bin")
    record_files.write(numbered(spark, 4), path, 10)
    before = open(path, "rb").read()
    with pytest.raises(Exception, match="bytes instead of"):
        record_files.write(numbered(spark, 4).withColumn("record", F.when(F.col("idx") == 2, F.lit(b"short")).otherwise(F.col("record"))), path, 10)
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["r.bin"]


def test_a_task_that_runs_twice_writes_the_same_bytes(tmp_path):
    from pyspark.sql import Row

    path = str(tmp_path / "r.bin")
    writer = record_files.RecordWriter(path, 2, b"h")
    rows = [[Row(idx=i, record=b"%02d" % i) for i in part] for part in ((3, 4, 5), (0, 1, 2, 6))]
    writer.write(iter(rows[0][:2]))  # a task that was lost
    messages = [writer.write(iter(part)) for part in rows]
    assert messages[1].runs == [(0, 3), (6, 7)]
    writer.commit(messages)
    assert open(path, "rb").read() == b"h00010203040506"


def test_bad_sizes_and_stores(spark, tmp_path):
    path = tmp_path / "r.bin"
    path.write_bytes(b"head" + b"x" * 25)
    with pytest.raises(Exception, match="whole records"):
        record_files.read(spark, str(path), 10, 4).collect()
    assert record_files.read(spark, str(path), 10, 4, partial=True).count() == 2
    path.write_bytes(b"h")
    assert record_files.read(spark, str(path), 10, 4, partial=True).count() == 0
    assert record_files.mounted("s3://a/b") is None and record_files.mounted("file:///a%20b") == "/a b"
    with pytest.raises(Exception, match="all machines mount"):
        record_files.write(numbered(spark, 1), "s3://bucket/r.bin", 10)


def test_ledger_of_files(spark, tmp_path):
    datas = {"a.bin": os.urandom(10_000), "b.bin": os.urandom(4096), "c.bin": b""}
    for name, data in datas.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = {os.path.basename(r.path): r for r in sinks.ledger(spark, str(tmp_path), block=1024).collect()}
    assert set(got) == set(datas)
    for name, data in datas.items():
        leaves = [hashlib.sha256(data[a : a + 1024]).hexdigest() for a in range(0, len(data), 1024)]
        assert (got[name].sha256, got[name].size_bytes) == (hashlib.sha256(data).hexdigest(), len(data))
        assert (got[name].blocks, got[name].tree_sha256) == ((len(leaves), hashlib.sha256("".join(leaves).encode()).hexdigest()) if leaves else (None, None))


def test_older_records_refuse_what_they_cannot_tell(spark):
    """Group 0 alone would be read as an empty record; groups above 127 have no bits."""
    rows = [(0, [0]), (1, [1]), (2, [127]), (3, [128]), (4, [])]
    df = spark.createDataFrame(rows, "n int, g array<int>").withColumn("none", F.array().cast("array<int>"))
    read = df.select("n", old_unpacked(old_packed(F.col("none"), F.col("none"), F.col("none"), F.col("g"), F.col("none"), F.transform("g", lambda _: F.lit(300)))).alias("t"))
    told = {r.n: (r.t.status, [g for g in r.t.face_r if g], r.t.height_r[:1]) for r in read.collect()}
    assert [told[n][0] for n in range(5)] == ["overflow", "ok", "ok", "overflow", "empty"]
    assert told[1][1:] == ([1], [300]) and told[2][1] == [127]


def test_tasks_do_not_grow_with_the_file(spark, tmp_path):
    """A task of its own for each small range, as s7_record_file and k9_ledger had, makes more tasks than work."""
    path = str(tmp_path / "r.bin")
    record_files.write(numbered(spark, 20_000), path, 10)
    back = record_files.read(spark, path, 10, split=10)
    assert back.rdd.getNumPartitions() <= record_files.MOST_RANGES
    assert [(r.idx, bytes(r.record)) for r in back.orderBy("idx").collect()] == [(i, b"%010d" % i) for i in range(20_000)]
    assert record_files.blocks(spark, path, 1000).rdd.getNumPartitions() == 1
    got = record_files.tree_digests(record_files.blocks(spark, path, 999)).first()
    data = open(path, "rb").read()
    leaves = [hashlib.sha256(data[a : a + 999]).hexdigest() for a in range(0, len(data), 999)]
    assert (got.blocks, got.tree_sha256) == (len(leaves), hashlib.sha256("".join(leaves).encode()).hexdigest())


def test_batches_are_written_by_runs(tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "r.bin")
    writer = record_files.ArrowRecordWriter(path, 2, b"h")
    batch = lambda *idx: pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.array([b"%02d" % i for i in idx], pa.binary())], ["idx", "record"])
    messages = [writer.write(iter([batch(3, 4), batch(5)])), writer.write(iter([batch(9, 0, 1, 2, 6).slice(1), batch()]))]
    assert messages[0].runs == [(3, 6)] and messages[1].runs == [(0, 3), (6, 7)]
    writer.commit(messages)
    assert open(path, "rb").read() == b"h00010203040506"


def test_older_records_are_spelt_out_once(spark):
    """Written out in each entry of its lists, a record's text and offsets were worked out a hundred times."""
    plan = spark.range(1).select(old_unpacked(F.lit(bytes(128))).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("hex(") == 1
