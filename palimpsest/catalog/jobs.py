"""Job tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.catalog import sqlparts as S
from palimpsest.functions.text import norm_for_signature
from palimpsest.operators import align
from palimpsest.operators import jobs as jb
from palimpsest.operators import structure as st
from palimpsest.operators.scan import chunk_for
from palimpsest.plans import compare as cp
from palimpsest.plans import fixtures as fx
from palimpsest.session import cut_lineage, ensure_checkpoint_dir
from palimpsest.streaming import pairs as sp

LATEST = S.with_(S.JOBLOG) + """, js as (select job_id, max_by(username, (ts, event_id)) as username, max_by(status, (ts, event_id)) as status,
  max_by(files_deleted, (ts, event_id)) as files_deleted, min(ts) as created_at, max(ts) as updated_at from jl group by job_id)
"""


def latest(spark, sf):
    return jb.latest_state(fx.job_log(spark, sf))


@query("q4_latest_state", LATEST + "select job_id, username, status, files_deleted, epoch_us(created_at) as c, epoch_us(updated_at) as u from js")
def latest_state(spark, sf):
    return latest(spark, sf).select("job_id", "username", "status", "files_deleted", F.unix_micros("created_at").alias("c"),
                                    F.unix_micros("updated_at").alias("u"))


@query("q1_pending_jobs", LATEST + "select job_id, 'queued' as status from js where status in ('queued', 'processing')")
def pending(spark, sf):
    return jb.pending(latest(spark, sf)).select("job_id", "status")


@query("q2_purge", LATEST + """select job_id, status in ('done', 'error') and files_deleted and
 created_at < timestamp '2024-01-08 00:00:00' - interval 24 hours as purged from js""")
def purge(spark, sf):
    now = F.lit("2024-01-08 00:00:00").cast("timestamp")
    return latest(spark, sf).select("job_id", F.coalesce(jb.is_purgeable(now), F.lit(False)).alias("purged"))


@query("q3_retry_bound", S.with_(S.JOBLOG) + """select job_id, count(*) as failures, case when count(*) < 2 then 'queued' else 'error' end as next_status
 from jl where status = 'error' group by job_id""")
def retries(spark, sf):
    return jb.retries(fx.job_log(spark, sf))


@query("q5_status_view", LATEST + """select username, count(*) as total, count(*) filter (where status = 'queued') as queued,
 count(*) filter (where status = 'processing') as processing, count(*) filter (where status = 'done') as done,
 count(*) filter (where status = 'error') as error from js group by username""")
def status_view(spark, sf):
    return jb.status_view(latest(spark, sf))


@query("o5_job_history", LATEST + "select username, job_id, status, epoch_us(created_at) as c from js order by username, created_at desc, job_id")
def history(spark, sf):
    return jb.history(latest(spark, sf)).select("username", "job_id", "status", F.unix_micros("created_at").alias("c"))


@query("q6_artifact_retention", """select event_id, event_type = 'error' or ts < timestamp '2024-01-05 00:00:00' - interval 12 hours as deletable from events""")
def retention(spark, sf):
    ev = fx.table(spark, sf, "events")
    path = F.concat(F.lit("img"), F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", ".tmp").otherwise(".png"))
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    return ev.select("event_id", jb.is_deletable(path, F.col("ts"), now).alias("deletable"))


def _shared(spark) -> str:
    """A fresh folder next to the checkpoints, where every executor can read and write."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _in_pieces(spark, nodes, base) -> None:
    """Rows in four file sets: the sides of a pair lie in different ones, and some pairs are cut inside a side."""
    piece = (F.col("pair_id") + F.when(F.col("side") == "B", 1).otherwise(0) + F.when((F.col("pair_id") % 3 == 0) & (F.col("ord") % 2 == 1), 2).otherwise(0)) % 4
    rows = cut_lineage(sp.announced(nodes).withColumn("piece", piece))
    for part in range(4):
        rows.filter(F.col("piece") == part).drop("piece").coalesce(8).write.mode("append").parquet(f"{base}/in")


@query("x1_streaming_compare")
def streaming_compare(spark, sf):
    """Pairs arriving in four file sets, no pair whole in one of them, compared once each."""
    base = _shared(spark)
    _in_pieces(spark, cp.line_nodes(fx.line_versions(spark, sf)), base)
    sp.compare_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", files_per_batch=8).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


@query("x1_streamed_opcodes", S.with_(S.LINES, S.LINE_BLOCKS, S.align_sql("lblk", ["pair_id"], "q"), recursive=True)
       + "select pair_id, tag, i1, i2, j1, j2 from qops")
def streamed_opcodes(spark, sf):
    """Opcodes of pairs that arrive in pieces, file by file."""
    base = _shared(spark)
    _in_pieces(spark, cp.line_nodes(fx.line_versions(spark, sf)), base)

    def opcodes(nodes):
        kept = nodes.withColumn("key", norm_for_signature(F.col("text"))).filter("key <> ''")
        return align.opcodes(st.number_blocks(kept, ["pair_id", "side"], chunk_for(kept, ["pair_id", "side"])), ["pair_id"])

    sp.compare_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", files_per_batch=5, compare=opcodes).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


@query("x2_streaming_latest_status", LATEST + "select job_id, status from js")
def streaming_status(spark, sf):
    """The update log as a stream; of what it says on each job, the last."""
    base = _shared(spark)
    schema = fx.table(spark, sf, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    latest_ = sp.latest_status(fx.job_log_of(ev))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    q = latest_.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/ckpt").trigger(
        availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("job_id").agg(F.max_by("status", "batch_id").alias("status"))
