"""Queries of the streaming plan, compared with the batch answers."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from latticeflow.lineage import cut, shared_folder
from latticeflow.operators import tiles as T
from latticeflow.operators import windows as W
from latticeflow.params import Annulus
from latticeflow.queries import Query, table
from latticeflow.queries.lattice import _verdict_sql
from latticeflow.sources.tiles import tiles, towers
from latticeflow.streaming import columns as C
from latticeflow.streaming import keyed as K

_GRID = Annulus(10, 1000, 2000)


def st5_streamed_verdicts(spark, sf_dir):
    """Batches of columns, early exit; the same verdicts as the flat plan."""
    rows = [(k, C.solve(spark, Annulus(k, 40, 120, 16), target_tiles=8).verdict()) for k in (2, 8, 10)]
    return spark.createDataFrame(rows, "k long, verdict string")


def st1_file_stream(spark, sf_dir):
    """A Structured Streaming query over files of columns."""
    q = Annulus(8, 40, 120, 16)
    cols = cut(towers(spark, q))
    rows = cut(T.summaries(tiles(cols, q), q))
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    for i in sorted(r.i for r in cols.select("i").collect()):
        rows.where(F.col("i") == i).coalesce(1).write.mode("append").parquet(folder)
    stream = C.run_stream(spark, folder, cols, name=uuid.uuid4().hex)
    p = stream.progress
    return spark.createDataFrame([(stream.verdict(), p.tiles, p.batches)], "verdict string, tiles long, batches long")


def st7_batches(spark, sf_dir):
    return C.batches_of_columns(towers(spark, _GRID), 8)


def _tower_sql():
    from latticeflow.queries.lattice import _towers_sql

    return f"WITH {_towers_sql(_GRID)} SELECT i, (tower_offset // 8)::BIGINT AS batch, j_high - j_low + 1 AS height FROM towers"


def _file_sql():
    from latticeflow.queries.lattice import _towers_sql

    q = Annulus(8, 40, 120, 16)
    return f"WITH {_towers_sql(q)} SELECT 'MOAT' AS verdict, (SELECT count(*) FROM tiles) AS tiles, (SELECT count(*) FROM towers) AS batches"


def _event_files(spark, sf_dir, files, by):
    """The events in files of ranges of ``by``, written one after the other, as a stream of one file a batch."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min(by).alias("lo"), F.max(by).alias("hi")).first()
    part = F.least(F.lit(files - 1), F.floor((F.col(by) - ends.lo) * files / (ends.hi - ends.lo + 1)))
    placed = cut(events.withColumn("part", part))
    for k in range(files):
        placed.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def st9_streamed_samples(spark, sf_dir):
    """The events of smallest hash by type, kept while a stream of files runs."""
    stream = _event_files(spark, sf_dir, 5, "event_id").select(F.col("event_type").alias("sample_class"), F.sha2(F.col("event_id").cast("string"), 256).alias("h"), F.col("event_id").alias("id"))
    work = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    K.run_to_end(K.streamed_samples(stream, 20), f"{work}/state", f"{work}/out", uuid.uuid4().hex, "update")
    return K.latest(spark.read.parquet(f"{work}/out")).select("sample_class", "population", "place", "h", "id")


def st6_ordered_events(spark, sf_dir):
    """Runs of each user's events without a gap of more than 500 event numbers, from a stream in order."""
    work = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    K.run_to_end(K.in_order(_event_files(spark, sf_dir, 4, "event_id"), "user_id", "event_id", 500), f"{work}/state", f"{work}/out", uuid.uuid4().hex)
    return spark.read.parquet(f"{work}/out").select("user_id", "event_id", "run", "place")


def w10_stream_progress(spark, sf_dir):
    """What a listener saw of a stream against what its sink wrote: batches, rows, and whether times were told."""
    log, name, work = K.ProgressLog(), uuid.uuid4().hex, f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    spark.streams.addListener(log)
    try:
        K.run_to_end(_event_files(spark, sf_dir, 3, "event_id").select("event_id"), f"{work}/state", f"{work}/out", name)
        wait_until(lambda: log.ended)
    finally:
        spark.streams.removeListener(log)
    told = W.interval_slowdown(log.frame(spark, name), ["name"], "batch_id", 1, "input_rows", "milliseconds")
    sink = spark.read.parquet(f"{work}/out").groupBy(F.col("batch").cast("long").alias("interval")).agg(F.count(F.lit(1)).alias("written"))
    return sink.join(told, "interval", "full").agg(F.count(F.lit(1)).alias("batches"), F.sum("amount").alias("input_rows"), F.sum("written").alias("written"), F.count_if((F.col("amount") == F.col("written")) & (F.col("slowdown") > 0)).alias("agreeing"))


def wait_until(done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.1)


QUERIES: dict[str, Query] = {
    "st5_streamed_verdicts": Query(st5_streamed_verdicts, _verdict_sql()),
    "st1_file_stream": Query(st1_file_stream, _file_sql()),
    "st7_batches": Query(st7_batches, _tower_sql()),
    "st9_streamed_samples": Query(
        st9_streamed_samples,
        """SELECT event_type AS sample_class, count(*) OVER (PARTITION BY event_type) AS population, row_number() OVER (PARTITION BY event_type ORDER BY sha256(event_id::VARCHAR), event_id)::INTEGER AS place, sha256(event_id::VARCHAR) AS h, event_id AS id
FROM events QUALIFY place <= 20""",
    ),
    "st6_ordered_events": Query(
        st6_ordered_events,
        """SELECT user_id, event_id, run, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS place FROM (
  SELECT user_id, event_id, sum(new)::BIGINT AS run FROM (SELECT user_id, event_id, sum(CASE WHEN event_id - before <= 500 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS new FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)) GROUP BY user_id, event_id)""",
    ),
    "w10_stream_progress": Query(w10_stream_progress, "SELECT 3::BIGINT AS batches, count(*) AS input_rows, count(*) AS written, 3::BIGINT AS agreeing FROM events"),
}
