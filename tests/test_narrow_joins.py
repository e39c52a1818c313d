"""Texts and vectors do not travel for another column's join, and what several
plans read is computed once."""
import glob

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsmith.operators import profile as P
from recsmith.plans import catalog_joint as CJ
from recsmith.plans import joint_ranking as JR
from recsmith.plans import modeling as MO
from recsmith.sources import ingest as IG
from recsmith.sources import testdata as td

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _joins(df) -> list[str]:
    """Conditions of the joins, outermost first."""
    return [x for x in _plan(df).splitlines() if "Join " in x]


def test_texts_are_joined_last(spark):
    """Names were joined after them, so every text was dealt out by its row's name."""
    df = td.raw_records(spark, SF)
    joins = _joins(df)
    assert len(joins) == 2 and "_doc" in joins[0] and "_k" in joins[1]
    assert df.columns == ["row_id", "split", "business_id", "user_id", "rating", "review_text", "pics", "history_reviews", "name"]


def test_json_lines_are_compressed_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IG, "ROWS_PER_JSON", 40)
    rows = [(i, "train", "a text " * 200) for i in range(100)]
    path = IG.sink_json(spark.createDataFrame(rows, "row_id long, split string, review_text string").coalesce(1), str(tmp_path / "x"))
    assert len(glob.glob(f"{path}/part-*.json.gz")) == 3 and not glob.glob(f"{path}/part-*.json")
    back = IG.scan_records_jsonl(spark, path).select("row_id", "split", "review_text").collect()
    assert sorted(map(tuple, back)) == rows


def test_users_are_joined_before_the_long_vectors(spark):
    users = td.interactions(spark, SF).filter("split = 'train'")
    model = JR.fixed_model(users, 2 * CJ.DIM)
    scored = JR.ablation(CJ._two_modalities(spark, SF, model), model, {"text_emb": CJ.DIM, "img_emb": CJ.DIM})
    joins = _joins(scored)
    assert len(joins) == 3 and "_v" in joins[0] and "_vec" in joins[1] and "user_id" in joins[2]


def test_vectors_of_a_matrix_go_through_once(spark):
    """The sums were read by three aggregates, each of which summed all vectors again."""
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v
    rows = [(s, [float(i), 1.0]) for i in range(10) for s in ("train", "val")] + [("val", None)]
    df = spark.createDataFrame(rows, "split string, v array<double>")
    got = P.summarize_matrices(df.withColumn("v", F.udf(count, T.ArrayType(T.DoubleType())).asNondeterministic()("v")), "split", ["v"]).collect()
    assert seen.value == len(rows)
    assert {(r.split, r.pos): (r.n_rows, r.n_missing, r.mean) for r in got} == {
        ("train", 1): (10, 0, 4.5), ("train", 2): (10, 0, 1.0), ("val", 1): (11, 1, 4.5), ("val", 2): (11, 1, 1.0)}


def test_feature_rows_pool_pictures_once_and_join_short_vectors_first(spark):
    rows = MO.row_features(spark, SF)
    assert "Aggregate" not in _plan(rows)                    # the pooled pictures are read, not computed by every plan on the rows
    joins = _joins(rows.select("row_id", "text_emb", "img_emb", "dense"))
    assert "business_id" in joins[0] and "_vec" in joins[1] and "row_id" in joins[2]
    first = rows.withColumn("x", F.concat("text_emb", "img_emb", "dense")).first()
    assert {c: len(first[c]) for c in ("text_emb", "img_emb", "dense", "x")} == MO.dims(spark, SF)
