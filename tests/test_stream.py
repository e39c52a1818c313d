"""Stream job: same rows as the batch job; a replay adds nothing."""
import tempfile

from recsmith.operators import metadata as MD
from recsmith.plans import recommend as R
from recsmith.sources import testdata as td
from recsmith.streaming import recommend_stream as RS
from tools.check_oracle import rows_of

from conftest import SF_SMALL


def test_stream_equals_batch_and_replay_is_idempotent(spark):
    ix = td.interactions(spark, SF_SMALL, with_vectors=True)
    base, mu = R.item_base_scores(ix.select("split", "business_id", "user_id", "rating"))
    items = R.item_table(ix, base, mu)
    md = MD.first_metadata_per_item(td.interactions(spark, SF_SMALL, with_pics=True, with_name=True))
    reqs = td.query_requests(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="stream-")
    reqs.repartition(3, "query_id").write.json(f"{d}/in")
    out = RS.run_to_end(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt", items, md).drop("batch_id")
    batch = R.recommend(items, reqs, md)
    a = rows_of(out.columns, [tuple(r) for r in out.collect()])
    b = rows_of(batch.columns, [tuple(r) for r in batch.select(*out.columns).collect()])
    assert a == b
    n_batches = len(spark.read.parquet(f"{d}/out").select("batch_id").distinct().collect())
    again = RS.run_to_end(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt", items, md)
    assert again.count() == out.count()
    assert len(again.select("batch_id").distinct().collect()) == n_batches


def _ask(spark, path, rows):
    spark.createDataFrame(rows, "query_id long, query_text string, k int, weights map<string,double>, query_emb array<float>, requested_at string") \
        .coalesce(1).write.mode("append").json(path)


def _small(spark):
    items = spark.createDataFrame([(f"b{i}", [float(i % 5), 1.0], i * 0.1) for i in range(20)], "business_id string, vec array<float>, base double")
    md = spark.createDataFrame([("b1", "x", "u", 1.0, 2)], "business_id string, name string, image_url string, avg_rating double, num_reviews long")
    return items, md


def test_an_id_is_answered_once_across_batches_and_restarts(spark):
    """A copy in a later batch, or after a restart, adds nothing; invalid requests are written with their reason."""
    items, md = _small(spark)
    d = tempfile.mkdtemp(prefix="stream-")
    t = "2024-05-01T10:00:00"
    _ask(spark, f"{d}/in", [(1, "b", 3, None, [1.0, 0.0], t), (1, "a", 3, None, [0.0, 1.0], t), (2, "z", 99, None, [1.0, 0.0], t)])
    _ask(spark, f"{d}/in", [(1, "a", 5, None, [1.0, 1.0], t), (3, "c", 2, None, [1.0, 0.0], None)])
    first = RS.run_to_end(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt", items, md)
    assert {(r.query_id, r["count"]) for r in first.groupBy("query_id").count().collect()} == {(1, 3), (3, 2)}
    # of the two in one batch the first in the order of the fields counts, as in the batch job
    want = R.recommend(items, spark.createDataFrame([(1, "a", 3, None, [0.0, 1.0])],
                       "query_id long, query_text string, k int, weights map<string,double>, query_emb array<float>"), md)
    key = lambda df: sorted((r["rank"], r.business_id, round(r.score, 9)) for r in df.filter("query_id = 1").collect())
    assert key(first) == key(want)
    bad = spark.read.parquet(f"{d}/out_rejected").collect()
    assert [(r.query_id, r.reason) for r in bad] == [(2, "k=99 is not in 1..50")]
    # id 3 had no time, so the watermark stands shortly before now: requests of then are late, those without a time are not
    _ask(spark, f"{d}/in", [(1, "a", 5, None, [1.0, 1.0], t), (3, "c", 2, None, [1.0, 0.0], None), (4, None, None, None, [1.0, 0.0], None)])
    again = RS.run_to_end(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt", items, md)
    assert {(r.query_id, r["count"]) for r in again.groupBy("query_id").count().collect()} == {(1, 3), (3, 2), (4, 10)}


def test_state_expires(spark):
    """Once the watermark has passed the window after a request, its id is forgotten."""
    items, md = _small(spark)
    d = tempfile.mkdtemp(prefix="stream-")
    run = lambda: RS.run_to_end(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt", items, md, window_minutes=10)
    _ask(spark, f"{d}/in", [(1, "a", 1, None, [1.0, 0.0], "2024-05-01T10:00:00")])
    run()
    _ask(spark, f"{d}/in", [(9, "a", 1, None, [1.0, 0.0], "2024-05-01T12:00:00")])
    run()
    _ask(spark, f"{d}/in", [(8, "a", 1, None, [1.0, 0.0], "2024-05-01T12:01:00")])
    run()
    _ask(spark, f"{d}/in", [(1, "a", 1, None, [1.0, 0.0], "2024-05-01T12:02:00"), (9, "a", 1, None, [1.0, 0.0], "2024-05-01T12:02:00")])
    counts = {r.query_id: r["count"] for r in run().groupBy("query_id").count().collect()}
    assert counts == {1: 2, 9: 1, 8: 1}
