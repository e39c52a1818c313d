"""The same answers with 1 and 7 shuffle partitions."""
import pytest

import __spark_entry__ as E
from tools.check_oracle import rows_of

from conftest import SF_SMALL

KEYS = ["recommend", "ranking_metrics_mean", "item_mean_pool", "image_manifest", "row_id_assign",
        "describe_numeric", "first_metadata_per_item"]


@pytest.mark.parametrize("key", KEYS)
def test_partition_invariance(spark, key):
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = E.queries()[key](spark, SF_SMALL)
        out.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


@pytest.mark.parametrize("bounds", [(7, 5, 30), (1000, 3, 10_000), (4, 1000, 10_000)])
def test_blocked_similarity_equals_brute_force(spark, bounds):
    """Many item and query blocks give the exact per-query top-k of a NumPy
    brute force over all pairs (score desc, id asc)."""
    import numpy as np
    from pyspark.sql import functions as F
    from recsmith.operators import similarity as SIM
    from recsmith.sources import testdata as td

    emb = td.table(spark, SF_SMALL, "embeddings")
    items = emb.select(F.concat(F.lit("b"), F.col("vec_id").cast("string")).alias("business_id"),
                       F.col("embedding").alias("vec"), ((F.col("vec_id") % 7) * 0.01).alias("base"))
    queries = emb.filter(F.col("vec_id") % 3 == 0).select(
        F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("qvec"),
        F.lit(1.0).alias("w_joint"), (F.col("vec_id") % 5 * 0.5).alias("w_text"))
    ipb, qpb, spt = bounds
    k = 6
    c = SIM.similarity_topk(items, queries, k, items_per_block=ipb, queries_per_block=qpb, scores_per_task=spt)
    got = {(r["query_id"], r["rank"]): r["business_id"] for r in SIM.rank_candidates(c, None, k, k).collect()}

    it = items.collect()
    ids = [r["business_id"] for r in it]
    I = np.array([r["vec"] for r in it], dtype=np.float64)
    I = I / np.maximum(np.linalg.norm(I, axis=1), 1e-12)[:, None]
    base = np.array([r["base"] for r in it])
    want = {}
    for q in queries.collect():
        v = np.array(q["qvec"], dtype=np.float64)
        v = v / max(np.linalg.norm(v), 1e-12)
        score = q["w_joint"] * base + q["w_text"] * (I @ v)
        order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k]
        for rank, i in enumerate(order, 1):
            want[(q["query_id"], rank)] = ids[i]
    assert got == want


def test_block_counts_respect_bounds():
    """Every block within its row bound, every block pair within the score
    bound, and a side that fits one block is never split (never replicated)."""
    import math
    from recsmith.operators.similarity import block_counts

    for ipb_max, qpb_max, budget in [(20000, 20000, 40_000_000), (7, 5, 30), (1000, 3, 10_000)]:
        side = math.isqrt(budget)
        for ni in (1, 5, 99, 1000, 123_457, 10**8):
            for nq in (1, 3, 500, 2001, 10**6):
                ib, qb = block_counts(ni, nq, ipb_max, qpb_max, budget)
                ipb, qpb = math.ceil(ni / ib), math.ceil(nq / qb)
                assert ipb <= ipb_max and qpb <= qpb_max
                assert ipb * qpb <= budget
                if nq <= min(side, qpb_max):
                    assert qb == 1
                if ni <= min(side, ipb_max) and nq > min(side, qpb_max):
                    assert ib == 1
