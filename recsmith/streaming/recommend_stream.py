"""Ranking as a stream job: requests arrive as JSON files, each micro-batch
is ranked against the static item table.

  * the item table (vectors + base scores) and metadata are query independent:
    written once to the shared folder, read by every micro-batch
  * a request id is answered once: the state store keeps the ids that were seen
    until the watermark passes ``window`` after the request time, so a copy in a
    later batch, or after a restart, is dropped, and state does not grow with the
    age of the stream. A request without a time counts as sent when its batch
    begins; one that is older than the watermark is late and dropped
  * of valid requests that share an id inside a batch the first in the order of
    their fields counts, as in the batch job
  * invalid requests are written to ``rejected/batch_id=<id>`` with the reason
  * ``foreachBatch`` writes each batch to ``out/batch_id=<id>`` with overwrite,
    so a batch replayed after a failure replaces its own output (idempotent)
  * progress and state live in the checkpoint location (shared storage), so a
    restarted query resumes after the last committed batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recsmith.operators import similarity as SIM
from recsmith.plans import recommend as R
from recsmith.session import stored

REQUEST_SCHEMA = ("query_id long, query_text string, k int, weights map<string,double>, "
                  "query_emb array<float>, requested_at timestamp")
ONCE_SCHEMA = ("query_id long, query_text string, k int, w_joint double, w_text double, "
               "query_emb array<float>, requested_at timestamp")
# minutes for which an id is remembered after the time of its request
WINDOW_MINUTES = 60


def _field_order(row) -> tuple:
    """The order of ``recommend.one_per_id``: defaults filled in, nulls first."""
    k = R.DEFAULT_K if pd.isna(row.k) else int(row.k)
    wj = R.DEFAULT_W_JOINT if pd.isna(row.w_joint) else row.w_joint
    wt = R.DEFAULT_W_TEXT if pd.isna(row.w_text) else row.w_text
    return (row.query_text or "", k, wj, wt, row.query_emb is not None, tuple(row.query_emb) if row.query_emb is not None else ())


def _first_of(window_ms: int):
    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)          # the requests of one id in one batch
        valid = rows["k"].isna() | rows["k"].between(R.MIN_K, R.MAX_K)
        out = [rows[~valid]]
        if valid.any() and not state.exists:
            some = rows[valid]
            first = min(some.index, key=lambda i: _field_order(some.loc[i]))
            out.append(some.loc[[first]])
            sent = int(some.loc[first, "requested_at"].value // 1_000_000)
            state.update((True,))
            state.setTimeoutTimestamp(max(sent, state.getCurrentWatermarkMs()) + window_ms)
        yield pd.concat(out, ignore_index=True)
    return fn


def answer_once(requests: DataFrame, window_minutes: int = WINDOW_MINUTES) -> DataFrame:
    """The requests of a stream without those whose id was seen already."""
    w = F.col("weights")
    rows = requests.select("query_id", "query_text", "k", w["joint_score"].alias("w_joint"), w["text_similarity"].alias("w_text"),
                           "query_emb", F.coalesce("requested_at", F.current_timestamp()).alias("requested_at"))
    once = (rows.withWatermark("requested_at", f"{window_minutes} minutes").groupBy("query_id")
            .applyInPandasWithState(_first_of(window_minutes * 60_000), ONCE_SCHEMA, "seen boolean", "append",
                                    GroupStateTimeout.EventTimeTimeout))
    weights = F.create_map(F.lit("joint_score"), F.col("w_joint"), F.lit("text_similarity"), F.col("w_text"))
    return once.select("query_id", "query_text", "k", weights.alias("weights"), "query_emb")


def start(spark: SparkSession, requests_path: str, out_path: str, checkpoint: str,
          items: DataFrame, metadata: DataFrame, files_per_trigger: int = 1, available_now: bool = True,
          window_minutes: int = WINDOW_MINUTES, rejected_path: str | None = None):
    """The running query. Rankings go to ``out_path``, rejected requests to
    ``rejected_path`` (by default next to it)."""
    rejected_path = rejected_path or f"{out_path.rstrip('/')}_rejected"
    items, metadata = stored(items, "stream-items"), stored(metadata, "stream-metadata")
    n_items, dim = items.count(), SIM.common_length(items)

    def rank_batch(batch: DataFrame, batch_id: int) -> None:
        # the batch's requests are counted (block sizes) and ranked: keep them
        # for this batch only, so a long-running stream holds no old batches
        reqs = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            out = R.recommend(items, reqs, metadata, n_items=n_items, n_queries=reqs.count(), dim=dim)
            out.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
            R.rejected(reqs).write.mode("overwrite").parquet(f"{rejected_path}/batch_id={batch_id}")
        finally:
            reqs.unpersist()

    requests = (spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(requests_path))
    stream = answer_once(requests, window_minutes)
    w = stream.writeStream.foreachBatch(rank_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_end(spark: SparkSession, requests_path: str, out_path: str, checkpoint: str,
               items: DataFrame, metadata: DataFrame, files_per_trigger: int = 1,
               window_minutes: int = WINDOW_MINUTES) -> DataFrame:
    q = start(spark, requests_path, out_path, checkpoint, items, metadata, files_per_trigger, True, window_minutes)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(out_path)
