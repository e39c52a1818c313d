"""Hand-made edge rows the generated data lacks."""
import math

import pytest
from pyspark.sql import functions as F

from recsmith.functions import presentation as PR
from recsmith.functions import text as TX
from recsmith.functions import vectors as V
from recsmith.operators import features as FT
from recsmith.operators import metadata as MD
from recsmith.operators import metrics as M
from recsmith.operators import profile as P
from recsmith.operators import stats as ST
from recsmith.plans import recommend as R
from recsmith.sources import ingest as IG


def test_clean_html_whitespace_and_entities(spark):
    rows = [(1, None), (2, "A B\x1cC D\x0bE"), (3, "<p>Hi<!-- x --></p><script>var a=1;</script>&amp;&copy;"),
            (4, "  Mixed   CASE  "), (5, "&#233;t&eacute;")]
    df = spark.createDataFrame(rows, "id int, t string")
    out = {r["id"]: r["c"] for r in df.select("id", TX.clean_html_text("t").alias("c")).collect()}
    assert out[1] == ""
    assert out[2] == "a b c d e"
    assert out[3] == "hi &©"
    assert out[4] == "mixed case"
    assert out[5] == "été"


# expected values written by hand, not taken from either engine
MARKUP = [
    ("caf&eacute; &#8217;s &hellip;", "café ’s …"), ("&#x41;&#66;&notin;", "ab∉"), ("a &amp;lt; b", "a &lt; b"), ("x &amp y &copy z", "x & y © z"),
    ("<b title='x>y'>z", "z"), ('<a href="p>q" class=r>s</a>t', "s t"), ("5 < 6 and 7 > 3", "5 < 6 and 7 > 3"), ("<p title=it's>don't</p>", "don't"),
    ("<script>if (a < b) {}</script>c<style>p>q{}</style>d", "c d"), ("<!-- <p> -->e<br/>f", "e f"), ("<a href='never closed", "<a href='never closed"),
    ("&bogus; &", "&bogus; &"),
]


def test_markup_and_entities_on_both_text_paths(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MARKUP)], "id int, t string")
    want = {i: w for i, (_, w) in enumerate(MARKUP)}
    assert {r["id"]: r["c"] for r in df.select("id", TX.clean_html_text("t").alias("c")).collect()} == want
    one = TX.with_text_features(df, "t", {"x": 1.0}, [], {}, keep_cleaned=True)
    assert {r["id"]: r["cleaned_text"] for r in one.collect()} == want


def test_sentiment_by_join_equals_the_function(spark):
    lex = {"good": 2.0, "bad": -2.0, "fine": 0.0}
    texts = ["good", "not good", "very good bad", "", "good, bad!", "no x y good", "no x y z good", "very very bad", "(good)"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, c string")
    a = TX.with_sentiment(df, "c", "s", lex, ["not", "no"], {"very": 0.293})
    table = spark.createDataFrame(list(lex.items()), "token string, valence double")
    b = TX.with_sentiment_join(df, "id", "c", "s", table, ["not", "no"], {"very": 0.293})
    x, y = ({r["id"]: r["s"] for r in d.collect()} for d in (a, b))
    assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-12 for k in x)


def _items(spark):
    return spark.createDataFrame([("a", [1.0, 0.0], 3.0), ("b", [0.0, 1.0], 3.5), ("c", None, 4.0), ("d", [1.0, 0.0, 0.0], 1.0)],
                                 "business_id string, vec array<float>, base double")


def _requests(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query_text string, k int, weights map<string,double>, query_emb array<float>")


def test_duplicate_requests_and_null_vectors(spark):
    rows = [(1, "q", 2, None, [1.0, 0.0]), (1, "q", 2, None, [1.0, 0.0]), (2, "q", 4, None, None), (3, "q", 99, None, [0.0, 1.0]),
            (4, "q", 1, None, [1.0])]
    req = _requests(spark, rows)
    got = {}
    for r in R.rank_requests(_items(spark), req).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["business_id"], round(r["text_similarity"], 6)))
    assert sorted(got[1]) == [(1, "a", 1.0), (2, "c", 0.0)]
    assert sorted(got[2]) == [(1, "c", 0.0), (2, "b", 0.0), (3, "a", 0.0), (4, "d", 0.0)]
    assert got[4] == [(1, "c", 0.0)] and 3 not in got
    assert [(r["query_id"], r["reason"]) for r in R.rejected(req).collect()] == [(3, "k=99 is not in 1..50")]


def test_merge_of_many_item_blocks(spark, monkeypatch):
    from recsmith.operators import similarity as SIM
    monkeypatch.setattr(SIM, "MERGE_FANOUT", 3)
    items = spark.range(400).selectExpr("concat('i', id) AS business_id", "array(cast(id % 7 as float), 1f) AS vec", "cast(id % 50 as double) AS base")
    q = spark.createDataFrame([(1, [1.0, 0.5], 1.0, 2.0), (2, [0.0, 1.0], 1.0, 0.0)], "query_id long, qvec array<float>, w_joint double, w_text double")
    one = SIM.rank_candidates(SIM.similarity_topk(items, q, 9), None, 9, 9)
    many = SIM.rank_candidates(SIM.similarity_topk(items, q, 9, items_per_block=20, scores_per_task=40), None, 9, 9)
    key = lambda d: sorted((r["query_id"], r["rank"], r["business_id"]) for r in d.collect())
    assert key(one) == key(many)


def test_nothing_stays_cached(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    for k in ("topk_per_query", "query_steering", "zscore_apply"):
        E.queries()[k](spark, SF_SMALL).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_word_count_empty_and_spaces(spark):
    df = spark.createDataFrame([("",), ("a b  c",), (None,)], "t string")
    got = [r[0] for r in df.select(TX.word_count(TX.clean_html_text("t"))).collect()]
    assert got == [0, 3, 0]


def test_sentiment_rules(spark):
    lex = {"good": 2.0, "bad": -2.0}
    df = spark.createDataFrame([(1, "good"), (2, "not good"), (3, "very good"), (4, ""), (5, "good, bad!")],
                               "id int, c string")
    out = {r["id"]: r["s"] for r in TX.with_sentiment(df, "c", "s", lex, ["not"], {"very": 0.293}).collect()}
    assert out[1] == pytest.approx(2 / math.sqrt(4 + 15))
    assert out[2] == pytest.approx(-1.48 / math.sqrt(1.48 ** 2 + 15))
    assert out[3] == pytest.approx(2.293 / math.sqrt(2.293 ** 2 + 15))
    assert out[4] == 0.0
    assert out[5] == 0.0


def test_sentiment_matches_jvm_form(spark):
    lex = {"good": 2.0, "bad": -2.0, "ok": 0.5}
    texts = ["good bad ok", "not very good at all", "never bad", "ok ok ok not ok", "very bad, not good."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, c string")
    a = TX.with_sentiment(df, "c", "s", lex, ["not", "never"], {"very": 0.293})
    b = a.withColumn("_w", TX.words("c")).withColumn("s2", TX.sentiment_from_words("_w", lex, ["not", "never"],
                                                                                     {"very": 0.293}))
    for r in b.collect():
        assert r["s"] == pytest.approx(r["s2"], abs=1e-12)


def test_text_features_batch_matches_jvm_chain(spark):
    lex = {"good": 2.0, "bad": -2.0, "ok": 0.5}
    neg, boost = ["not", "never"], {"very": 0.293}
    texts = ["<p>Good &amp; <b>bad</b></p>", "  not\tvery good!! ", None, "", "!!! ...", "ok,ok;ok (not) ok",
             "<script>bad</script>never  bad", "x" * 50 + " good"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    a = TX.with_text_features(df, "t", lex, neg, boost, keep_cleaned=True)
    b = (df.withColumn("c", TX.clean_html_text("t")).withColumn("n", TX.word_count("c")))
    b = TX.with_sentiment(b, "c", "s", lex, neg, boost)
    got = {r["id"]: (r["cleaned_text"], r["text_len_words"], r["sentiment"]) for r in a.collect()}
    for r in b.collect():
        c, n, s = got[r["id"]]
        assert (c, n) == (r["c"], r["n"])
        assert s == pytest.approx(r["s"], abs=1e-12)


def test_keyed_text_features_equal_per_row(spark):
    from recsmith.plans import features_build as FB
    lex, neg, boost = FB.sentiment_params(spark)
    texts = spark.createDataFrame([(0, "Great <b>day</b>"), (1, "not very bad"), (2, None)],
                                  "text_key long, review_text string")
    rows = spark.createDataFrame([(10, 0), (11, 1), (12, 0), (13, 2), (14, 7)], "row_id long, text_key long")
    keyed = {r["row_id"]: (r["text_len_words"], r["sentiment"])
             for r in FB.keyed_text_features(rows, texts, spark).collect()}
    per_row = rows.join(texts, "text_key", "left")
    per_row = TX.with_text_features(per_row, "review_text", lex, neg, boost)
    assert len(keyed) == 5
    for r in per_row.collect():
        n, s = keyed[r["row_id"]]
        assert n == r["text_len_words"]
        assert s == pytest.approx(r["sentiment"], abs=1e-12)


def test_l2_normalize_zero_and_null(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), (None,)], "v array<float>")
    got = [r[0] for r in df.select(V.l2_normalize("v")).collect()]
    assert got[0] == [0.0, 0.0]
    assert got[1] == pytest.approx([0.6, 0.8])
    assert got[2] is None


def test_clean_pics_and_manifest(spark):
    rows = [(0, "train", "b1", ["p1", "", None, "p1"]), (1, "train", "b1", None), (2, "train", None, ["p9"]),
            (3, "val", "b1", [])]
    df = spark.createDataFrame(rows, "row_id long, split string, business_id string, pics array<string>")
    m = {(r["business_id"], r["split"]): r["pic_count"] for r in FT.image_manifest(df).collect()}
    assert m == {("b1", "train"): 2, ("b1", "val"): 0}   # duplicates kept, null business dropped
    long = FT.manifest_pictures(df).orderBy("row_id", "pic_pos").collect()
    assert [r["pic_id"] for r in long] == ["p1", "p1"]


def test_ids_rating_contract(spark):
    rows = [("", "u", 3, "t", [], []), (None, "u", 6, "t", ["ok"], []), ("b", "u", None, "", [""], ["x"]),
            ("b", "u", 0, None, None, None)]
    df = spark.createDataFrame(rows, "business_id string, user_id string, rating int, review_text string, "
                                     "pics array<string>, history_reviews array<string>").withColumn("split", F.lit("train"))
    v = {r["rule"]: r["violations"] for r in IG.contract_violations(df).collect()}
    assert v["empty_business_id"] == 2
    assert v["rating_out_of_range"] == 3
    assert v["empty_text_without_rating"] == 1
    assert v["bad_pic_id"] == 1
    good, bad = IG.quarantine(df)
    assert good.count() == 0 and bad.count() == 4


def test_unseen_users_fall_back_to_mu(spark):
    rows = [("train", "u1", "b1", 5), ("train", "u2", "b1", 3), ("test", "u9", "b7", 4), ("test", None, None, 1)]
    ix = spark.createDataFrame(rows, "split string, user_id string, business_id string, rating int")
    mu, users, items = ST.train_stats(ix)
    assert mu == 4.0
    pred = ST.bias_prediction(ST.join_user_item_stats(ix, users, items), mu)
    t = pred.filter("split = 'test'").select("pred").collect()
    assert [r[0] for r in t] == [4.0, 4.0]


def test_zscore_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    p = ST.zscore_fit(df, ["a", "b"])
    assert p["a"] == (1.0, 1.0)
    assert p["b"] == (3.0, 1.0)


def test_ranking_metrics_edge(spark):
    # u1: ties and a NaN score; u2: no positives (skipped); u3: fewer rows than k
    rows = [("u1", 1, 5, 0.9), ("u1", 2, 1, 0.9), ("u1", 3, 4, float("nan")), ("u2", 4, 1, 0.5),
            ("u3", 5, 4, 0.1)]
    df = spark.createDataFrame(rows, "user_id string, row_id long, rating int, score double")
    pu = {(r["user_id"], r["k"]): r for r in M.per_user_metrics(df, ks=(1, 5)).collect()}
    assert ("u2", 1) not in pu
    assert pu[("u1", 1)]["precision"] == 1.0                 # tie broken by row_id: row 1 first
    assert pu[("u1", 5)]["precision"] == pytest.approx(2 / 5)  # denominator is k
    assert pu[("u3", 5)]["recall"] == 1.0 and pu[("u3", 5)]["ndcg"] == 1.0
    empty = M.ranking_metrics(df.filter("rating > 10"), ks=(5,))
    assert empty.count() == 0 and "ndcg" in empty.columns


def test_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(P.guarded_corr("a", "b")).first()[0] is None


def test_request_validation_bounds(spark):
    rows = [(1, None, None, None, [1.0]), (2, "x", 0, {"joint_score": 2.0}, [1.0]), (3, "y", 51, None, [1.0]),
            (4, "", 50, {"text_similarity": 0.0}, [1.0])]
    df = spark.createDataFrame(rows, "query_id long, query_text string, k int, weights map<string,double>, "
                                     "query_emb array<float>")
    out = {r["query_id"]: r for r in R.validate_requests(df).collect()}
    assert out[1]["k"] == 10 and out[1]["valid"] == 1 and out[1]["query_text"] == ""
    assert out[1]["w_joint"] == 1.0 and out[1]["w_text"] == 10.0
    assert out[2]["valid"] == 0 and out[2]["w_joint"] == 2.0
    assert out[3]["valid"] == 0
    assert out[4]["valid"] == 1 and out[4]["w_text"] == 0.0


def test_metadata_fallbacks_and_lookup(spark):
    rows = [(0, "train", "b1", "", ["", "p2"], 4, None), (1, "val", "b1", "Z", ["p3"], 2, None),
            (2, "test", "b2", None, None, None, 3.5)]
    df = spark.createDataFrame(rows, "row_id long, split string, business_id string, name string, "
                                     "pics array<string>, rating int, stars double")
    md = {r["business_id"]: r for r in MD.first_metadata_per_item(df).collect()}
    assert md["b1"]["name"] == "Business b1" and md["b1"]["image_url"] is None and md["b1"]["avg_rating"] == 4.0
    assert md["b2"]["avg_rating"] == 3.5
    req = spark.createDataFrame([("b1",), ("nope",)], "business_id string")
    look = {r["business_id"]: r for r in MD.item_detail_lookup(req, MD.first_metadata_per_item(df)).collect()}
    assert look["nope"]["found"] == 0 and look["nope"]["name"] is None and look["b1"]["found"] == 1


def test_presentation(spark):
    df = spark.createDataFrame([(None,), (4.5,), (5.7,), (2.49,)], "a double")
    got = [tuple(r) for r in df.select(*PR.star_buckets("a")).collect()]
    assert got == [(None, None, None), (4, 1, 0), (5, 0, 0), (2, 0, 3)]
    lab = spark.createDataFrame([(3.05,), (-0.04,), (2.0,)], "s double").select(PR.one_decimal_label("s")).collect()
    assert [r[0] for r in lab] == ["3.1", "-0.0", "2.0"]


def test_exact_quantiles_linear(spark):
    import numpy as np
    vals = [float(x) for x in [5, 1, 3, 3, 9, 2, 8]]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = {r["q"]: r["value"] for r in P.exact_quantiles(df, "x").collect()}
    for k, v in q.items():
        assert v == pytest.approx(np.quantile(vals, k))


def test_split_dump_object(spark, tmp_path):
    import json
    p = tmp_path / "dump.json"
    rec = {"business_id": "b1", "user_id": "u1", "rating": 5, "review_text": "x", "pics": ["p1"], "history_reviews": []}
    p.write_text(json.dumps({"train": [rec, rec], "val": [], "test": [rec]}))
    df = IG.scan_split_dump(spark, str(p))
    assert {(r["split"], r["row_id"]) for r in df.collect()} == {("train", 0), ("train", 1), ("test", 0)}
    p2 = tmp_path / "bad.json"
    p2.write_text(json.dumps({"train": [rec], "val": []}))
    with pytest.raises(KeyError):
        IG.scan_split_dump(spark, str(p2))


def test_point_lookup_prunes_files_and_row_groups(spark):
    """A lookup reads one bucket, with the id pushed to the files; no aggregate."""
    import io
    import contextlib
    import tempfile
    from recsmith.operators import metadata as MD
    md = spark.createDataFrame([(f"b{i}", f"n{i}", None, float(i % 5), None) for i in range(500)],
                               "business_id string, name string, image_url string, avg_rating double, num_reviews long")
    path = MD.store_details(md, tempfile.mkdtemp(prefix="details-"), buckets=8)
    assert [r.name for r in MD.detail_of(spark, path, "b77", md.schema, 8).collect()] == ["n77"]
    assert MD.detail_of(spark, path, "x", md.schema, 8).collect() == []
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        MD.detail_of(spark, path, "b77", md.schema, 8).explain("formatted")
    plan = out.getvalue()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(business_id,b77)" in plan and "Aggregate" not in plan and "Exchange" not in plan
    assert len(MD.detail_of(spark, path, "b77", md.schema, 8).inputFiles()) >= 1


def test_matrix_summary_against_numpy(spark):
    """Moments, missing and NaN rows of vector columns, whatever the number of tasks."""
    import numpy as np
    from recsmith.operators import profile as P
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        a = (1e6 + rng.standard_normal(3)).tolist()
        if i % 17 == 0:
            a[i % 3] = float("nan")
        rows.append((["x", "y", None][i % 3], None if i % 11 == 0 else a, [float(i)] if i % 5 else []))
    df = spark.createDataFrame(rows, "split string, a array<float>, b array<double>").repartition(7)
    got = {(r.split, r.matrix, r.pos): r for r in P.summarize_matrices(df, "split", ["a", "b"]).collect()}
    assert len(got) == 3 * (3 + 1)
    for g in ("x", "y", None):
        mine = [r for r in rows if r[0] == g]
        m = np.array([np.float32(r[1]) for r in mine if r[1] is not None], float)
        for p in range(3):
            r, v = got[g, "a", p + 1], m[:, p]
            assert (r.n_rows, r.n_missing, r.nan_rows, r.n) == (len(mine), sum(x[1] is None for x in mine), int(np.isnan(m).any(1).sum()), int((~np.isnan(v)).sum()))
            assert abs(r["mean"] - np.nanmean(v)) < 1e-6 and abs(r["std"] - np.nanstd(v)) < 1e-6
        b = np.array([x[2][0] for x in mine if x[2]])
        assert (got[g, "b", 1].n_rows, got[g, "b", 1].n) == (len(mine), len(b)) and abs(got[g, "b", 1]["std"] - b.std()) < 1e-9


def test_describe_is_exact_whatever_the_brackets(spark, monkeypatch):
    """Quantiles equal NumPy's for continuous, tied, constant and tiny columns, also when brackets miss their rank."""
    import numpy as np
    from recsmith.operators import profile as P
    rng = np.random.default_rng(6)
    rows = [(["a", "b", None][i % 3], float(rng.standard_normal()), float(i % 4), 7.0, float("nan") if i % 2 else None if i % 5 else float(i)) for i in range(700)]
    rows.append(("one", 3.0, None, 1.0, None))
    df = spark.createDataFrame(rows, "g string, x double, y double, z double, w double").repartition(5)
    want = {}
    for g in ("a", "b", None, "one"):
        for i, c in enumerate("xyzw", 1):
            v = np.array([r[i] for r in rows if r[0] == g and r[i] is not None and r[i] == r[i]])
            if len(v):
                want.update({(g, c, f"{q}%"): np.percentile(v, q) for q in (25, 50, 75)})
                want[g, c, "count"] = len(v)
    for accuracy in (10_000, 3):
        monkeypatch.setattr(P, "ACCURACY", accuracy)
        got = {(r.g, r.column, r.stat): r.value for r in P.describe_by(df, ["x", "y", "z", "w"], ["g"]).collect()}
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and {k for k in got if k[2] in ("count", "25%", "50%", "75%")} == set(want)
