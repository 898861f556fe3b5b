"""State per key in Structured Streaming: samples kept while a stream runs (ST9, T4), order by key (ST3, ST6), progress as rows.

State lives in the query's checkpoint, so a query that is stopped or lost goes on where it was.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _field_types(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{n}` {types[n]}" for n in names)


def _frame(**columns: list) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})


class _Best(StatefulProcessor):
    """The ``k`` smallest (hash, id) of a class and how many rows it had; both are emitted whenever they may have changed."""

    def __init__(self, k: int, id_type: str):
        self.k, self.id_type = k, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getListState("best", f"h string, id {self.id_type}")
        self.seen = handle.getValueState("seen", "rows long, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, version = self.seen.get() if self.seen.exists() else (0, 0)
        best = [tuple(x) for x in self.best.get()]
        for frame in rows:
            n += int(frame["rows"].sum())
            best = sorted([*best, *zip(frame["h"].tolist(), frame["id"].tolist(), strict=True)])[: self.k]
        self.seen.update((n, version + 1))
        self.best.put(best)
        m = len(best)
        yield _frame(sample_class=[key[0]] * m, version=[version + 1] * m, population=[n] * m, place=list(range(1, m + 1)), h=[b[0] for b in best], id=[b[1] for b in best])

    def close(self) -> None:
        pass


def streamed_samples(rows: DataFrame, k: int) -> DataFrame:
    """ST9, T4: (sample_class, version, population, place, h, id): after each micro-batch, the ``k`` rows of smallest hash
    of each class that got rows, over all batches so far, and the class's rows so far.

    ``rows``: a stream (sample_class, h, id), hash and id given.  Each task first keeps its own ``k`` rows and a count per class, so that a
    class which holds most of the stream sends ``k`` rows a task; state is ``k`` rows a class.  The highest version of a
    class is its answer; equal hashes go by id.
    """
    id_type = dict(rows.dtypes)["id"]

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple]] = {}
        counts: dict[str, int] = {}
        for frame in frames:
            for name, group in frame.groupby("sample_class", dropna=False):
                name = None if pd.isna(name) else name
                counts[name] = counts.get(name, 0) + len(group)
                first = group.sort_values(["h", "id"]).head(k)
                held[name] = sorted([*held.get(name, []), *zip(first["h"].tolist(), first["id"].tolist(), strict=True)])[:k]
        for name, best in held.items():
            yield _frame(sample_class=[name] * len(best), h=[b[0] for b in best], id=[b[1] for b in best], rows=[counts[name], *[0] * (len(best) - 1)])

    slim = rows.select("sample_class", "h", "id").mapInPandas(local, f"sample_class string, h string, id {id_type}, rows long")
    schema = f"sample_class string, version long, population long, place int, h string, id {id_type}"
    return slim.groupBy("sample_class").transformWithStateInPandas(_Best(k, id_type), schema, "Update", "None")


def latest(emitted: DataFrame, by: str = "sample_class", version: str = "version") -> DataFrame:
    """The rows of each key's highest version."""
    last = F.max(version).over(Window.partitionBy(by))
    return emitted.withColumn("last_", last).where(F.col(version) == F.col("last_")).drop("last_")


class LateRow(ValueError):
    """A row came behind a later one of its key."""


class _Ordered(StatefulProcessor):
    def __init__(self, key: str, position: str, gap: int):
        self.key, self.position, self.gap = key, position, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "position long, run long, place long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, run, place = self.last.get() if self.last.exists() else (None, 0, 0)
        frame = pd.concat(list(rows)).sort_values(self.position, kind="stable")
        positions = frame[self.position].tolist()
        runs, places = [], []
        for p in positions:
            if last is not None and p <= last:
                raise LateRow(f"{self.key} {key[0]}: position {p} came behind {last}")
            if last is None or p - last > self.gap:  # nothing is carried across a gap
                run, place = run + 1, 0
            last, place = p, place + 1
            runs.append(run)
            places.append(place)
        self.last.update((int(last), run, place))
        yield _frame(**{self.key: [key[0]] * len(runs), self.position: positions, "run": runs, "place": places})

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, position: str, gap: int) -> DataFrame:
    """ST3, ST6: (key, position, run, place) of a stream whose rows come in order of ``position`` within each key.

    A row that isn't behind all earlier batches' rows of its key fails the query: it is neither dropped nor counted.
    A step of more than ``gap`` clears what the key carries: a new run begins, places start anew.
    """
    slim = rows.select(key, F.col(position).cast("long").alias(position))
    return slim.groupBy(key).transformWithStateInPandas(_Ordered(key, position, gap), f"{_field_types(slim, [key, position])}, run long, place long", "Append", "None")


class ProgressLog(StreamingQueryListener):
    """W10, ST9: progress of the session's streaming queries as rows, while they run and afterwards."""

    def __init__(self) -> None:
        self.lock, self.rows, self.ended = threading.Lock(), [], set()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        with self.lock:
            self.rows.append((str(p.id), str(p.runId), p.name or "", int(p.batchId), int(p.numInputRows), int(p.batchDuration), json.dumps(p.durationMs, sort_keys=True)))

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        with self.lock:
            self.ended.add(str(event.runId))

    def frame(self, spark: SparkSession, name: str | None = None) -> DataFrame:
        """(query_id, run_id, name, batch_id, input_rows, milliseconds, durations) of the batches that had rows."""
        with self.lock:
            rows = [r for r in self.rows if r[4] > 0 and (name is None or r[2] == name)]
        return spark.createDataFrame(rows, "query_id string, run_id string, name string, batch_id long, input_rows long, milliseconds long, durations string")


def run_to_end(stream: DataFrame, checkpoint: str, output: str, name: str, mode: str = "append") -> None:
    """Works off what there is and appends each batch's rows to Parquet, each batch once even if it is run again."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        write = lambda df, batch: df.write.mode("overwrite").parquet(f"{output}/batch={batch}")
        query = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
