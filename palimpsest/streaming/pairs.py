"""Comparison of pairs that arrive in pieces, and the latest state of jobs on a stream."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.plans.compare import compare_text

LINES = "pair_id BIGINT, side STRING, ord INT, uid STRING, type STRING, level INT, text STRING"
#: Every arriving row tells how many rows its pair has on either side.
ANNOUNCED = f"{LINES}, a_rows BIGINT, b_rows BIGINT"
COLUMNS = [c.split()[0] for c in LINES.split(", ")]
OUT = Row(*COLUMNS, "complete")
#: Rows of a pair packed into one value at most.
CHUNK = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def announced(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the number of rows of either side of its pair, as a writer of pieces has to state them."""
    n = nodes.groupBy("pair_id").agg(F.count_if(F.col("side") == "A").alias("a_rows"), F.count_if(F.col("side") == "B").alias("b_rows"))
    return nodes.join(n, "pair_id").select(*COLUMNS[:2], F.col("ord").cast("int"), *COLUMNS[3:], "a_rows", "b_rows")


class WholePairs(StatefulProcessor):
    """Holds the rows of a pair until as many as announced are there on both sides, then hands them on at once.

    A pair that isn't whole ``wait_ms`` after its last rows came leaves as it is, with ``complete`` false. Rows that came in one batch are appended to a list in
    the state store as one packed value, so a batch reads the rows of a pair only when it closes, and those that close it are not stored; the counts, and when the
    pair is given up, are a value of their own. Rows that come after their pair has left start it anew.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed BINARY")
        self.counts = handle.getValueState("counts", "a BIGINT, b BIGINT, a_rows BIGINT, b_rows BIGINT, timer BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.counts.get()
        a, b, a_rows, b_rows, timer = held or (0, 0, None, None, None)
        came = []
        for *row, a_rows, b_rows in rows:
            came.append(tuple(row))
            a, b = a + (row[1] == "A"), b + (row[1] == "B")
            if len(came) == CHUNK and not (a >= a_rows and b >= b_rows):
                self.rows.appendValue((pickle.dumps(came),))
                held, came = held or True, []
        if timer is not None:
            self.handle.deleteTimer(timer)
        if a >= a_rows and b >= b_rows:
            if held:
                yield from self._leave(True)
            yield from (OUT(*r, True) for r in came)
        else:
            if came:
                self.rows.appendValue((pickle.dumps(came),))
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.counts.update((a, b, a_rows, b_rows, timer))
            self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._leave(False)

    def _leave(self, complete: bool) -> Iterator[Row]:
        for (packed,) in self.rows.get():
            yield from (OUT(*r, complete) for r in pickle.loads(packed))
        self.rows.clear()
        self.counts.clear()

    def close(self) -> None:
        pass


def whole_pairs(rows: DataFrame, wait_ms: int) -> DataFrame:
    """A stream of rows as announced (``ANNOUNCED``) to a stream of the rows of whole pairs, and with ``complete`` false of those given up."""
    return rows.groupBy("pair_id").transformWithState(
        statefulProcessor=WholePairs(wait_ms), outputStructType=f"{LINES}, complete BOOLEAN", outputMode="Append", timeMode="ProcessingTime")


def compare_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 1000, wait_ms: int = 3_600_000,
                   compare: Callable[[DataFrame], DataFrame] | None = None, once: bool = True):
    """Compare every arriving pair once, however its rows are dealt over files and batches.

    Rows of incomplete pairs wait in keyed state. Each batch keeps what closed in it as a table, which ``compare`` reads (by default the summary of a text
    comparison); result and pairs given up (``incomplete``) have a folder named by the batch, so a batch that is run again after a failure replaces its own
    output. With ``once`` the query ends when it has read what is there, and a pair is given up by the next run that reads something; otherwise it goes on.
    """
    compare = compare or (lambda nodes: compare_text(nodes).summary)
    rows = spark.readStream.schema(ANNOUNCED).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def one(batch: DataFrame, batch_id: int) -> None:
        own = f"{checkpoint}/closed/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(own)
        closed = batch.sparkSession.read.schema(batch.schema).parquet(own)
        whole, given_up = closed.filter("complete").drop("complete"), closed.filter("not complete").drop("complete")
        if not whole.isEmpty():
            compare(whole).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        if not given_up.isEmpty():
            given_up.write.mode("overwrite").parquet(f"{sink}-incomplete/batch_id={batch_id}")

    # several kinds of state per key need this store; what is there now ends without waiting for timers. A query keeps the settings it was started with.
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": str(not once).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        out = whole_pairs(rows, wait_ms).writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/query")
        return (out.trigger(availableNow=True) if once else out.trigger(processingTime="10 seconds")).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def latest_status(log: DataFrame) -> DataFrame:
    """Latest state of each job on a stream of updates; in update mode, a row whenever a job's state changes.

    There is one row of state per job, and no update comes too late: an older one that arrives after a newer one changes nothing.
    """
    return log.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"))
