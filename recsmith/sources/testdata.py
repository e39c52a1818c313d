"""Adapters from the generated parquet tables to the engine's data model.

The generated tables are generic (events, documents, embeddings, lineitem...);
these adapters derive interactions, pictures, queries and item metadata from
them with plain joins and column expressions, so every derived table grows
with its inputs. The mapping rules are fixed (see FIXTURES.md):

  interactions   events: row_id = event_id, user 'u'||user_id, business 'b'||props.k,
                 rating from value thresholds, split from id rules,
                 review_text = documents.text at doc_id = event_id % n_docs,
                 text_emb = embeddings.embedding at vec_id = event_id % n_vecs,
                 pics = event_id % 4 ids 'p'||((event_id*7+i) % n_vecs)
  ratings_large  lineitem join orders: user o_custkey, item l_partkey,
                 rating 1 + floor((l_quantity-1)/10), split by l_orderkey % 10
  pictures       embeddings as picture vectors, pic_id 'p'||vec_id
  queries        every embeddings row is one request
  item names     part.p_name for business 'b'||p_partkey
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# fixed values: rating thresholds on events.value (upper bounds of ratings 1..4)
RATING_UPPER = (11, 25, 46, 80)
# fixed values: the three picture slots used by the picture rule
PIC_SLOTS = 3
# fixed values: split rules
TEST_USER_MOD, TEST_USER_REM = 20, 7
VAL_ITEM_MOD, VAL_ITEM_REM = 25, 3
ROW_MOD, TEST_ROW_REM, VAL_ROW_REM = 10, 9, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    # parquet counts come from footers: no data scan
    return table(spark, sf_dir, name).count()


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer splits than there are cores, dealt out to all of them by
    ``key``; others as they are. Such a table holds one split's bytes a core at
    most, and its splits may be as uneven as its row groups (a file of one row
    group is read by one task, whatever its number of splits)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _rating_expr(value) -> F.Column:
    r1, r2, r3, r4 = RATING_UPPER
    return (F.when(value < r1, 1).when(value < r2, 2).when(value < r3, 3)
            .when(value < r4, 4).otherwise(5)).cast("int")


def _split_expr(user_num, item_num, row_num) -> F.Column:
    return (F.when((user_num % TEST_USER_MOD == TEST_USER_REM) | (row_num % ROW_MOD == TEST_ROW_REM), "test")
            .when((item_num % VAL_ITEM_MOD == VAL_ITEM_REM) | (row_num % ROW_MOD == VAL_ROW_REM), "val")
            .otherwise("train"))


def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review texts keyed by the text key of the interaction rows:
    (text_key, review_text)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_key"), F.col("text").alias("review_text"))


def interactions(spark: SparkSession, sf_dir: str, with_text: bool = False,
                 with_vectors: bool = False, with_pics: bool = False,
                 with_history: bool = False, with_name: bool = False,
                 with_text_key: bool = False) -> DataFrame:
    """Interaction rows (row_id, split, business_id, user_id, rating [, ...]).

    Optional columns are joined only when asked for, so plans that do not
    need text or vectors never touch those tables. ``with_text_key`` adds the
    key of the row's review in ``text_source`` (no join).

    Names are joined first and texts last: what is dealt out for a join is the
    row as it is then, so no text and no vector travels for another join.
    """
    ev = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "value", "props"), "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    df = ev.select(
        F.col("event_id").alias("row_id"),
        _split_expr(F.col("user_id"), k, F.col("event_id")).alias("split"),
        F.concat(F.lit("b"), k.cast("string")).alias("business_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        _rating_expr(F.col("value")).alias("rating"),
        k.alias("_k"),
    )
    n_vecs = row_count(spark, sf_dir, "embeddings") if with_pics else None
    if with_text_key:
        df = df.withColumn("text_key", F.col("row_id") % F.lit(row_count(spark, sf_dir, "documents")))
    if with_pics:
        slots = F.array(*[
            F.concat(F.lit("p"), ((F.col("row_id") * 7 + i) % F.lit(n_vecs)).cast("string"))
            for i in range(PIC_SLOTS)])
        df = df.withColumn("pics", F.slice(slots, 1, (F.col("row_id") % 4).cast("int")))
    if with_history:
        df = df.withColumn("history_reviews", F.array().cast("array<string>"))
    if with_name:
        names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_k"), F.col("p_name").alias("name"))
        df = df.join(names, "_k", "left")
    df = df.drop("_k")
    if with_vectors:
        df = join_text_vectors(spark, sf_dir, df)
    if with_text:
        n_docs = row_count(spark, sf_dir, "documents")
        docs = table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("_doc"), F.col("text").alias("review_text"))
        df = (df.withColumn("_doc", F.col("row_id") % F.lit(n_docs))
              .join(docs, "_doc", "left").drop("_doc"))
    last = [c for c in ("text_key", "review_text", "text_emb", "pics", "history_reviews", "name") if c in df.columns]
    return df.select(*[c for c in df.columns if c not in last], *last)


def join_text_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame, form: Callable = F.col) -> DataFrame:
    """Interaction rows with ``text_emb``, the vector of the row's text (as ``form`` makes it of the vector's column)."""
    n_vecs = row_count(spark, sf_dir, "embeddings")
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("_vec"), form("embedding").alias("text_emb"))
    return rows.withColumn("_vec", F.col("row_id") % F.lit(n_vecs)).join(emb, "_vec", "left").drop("_vec")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full records as the ingest stage sees them (all optional fields).

    Plans that use a few fields ask ``interactions`` for just those: the text
    and name joins are many-to-one on unique keys (they add no rows), but the
    planner cannot know that and would keep them."""
    return interactions(spark, sf_dir, with_text=True, with_pics=True, with_history=True, with_name=True)


# fixed values: flaws of the raw feed by row_id: (column, modulus, remainder, value)
FLAWS = [
    ("business_id", 97, 5, None), ("business_id", 101, 7, ""), ("user_id", 89, 3, None), ("user_id", 113, 11, ""),
    ("rating", 83, 1, None), ("rating", 79, 2, 9), ("review_text", 71, 4, None), ("review_text", 83, 1, ""), ("name", 59, 8, None),
]


def flawed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full records as a careless feed sends them: ids missing or empty, ratings
    missing or out of range, texts missing, an empty id among the pictures, and a
    history whose entries may be empty. The rules are in FIXTURES.md."""
    df = interactions(spark, sf_dir, with_text=True, with_pics=True, with_name=True)
    row = F.col("row_id")
    cols = {}
    for column, mod, rem, value in FLAWS:
        kind = "int" if column == "rating" else "string"
        cols[column] = F.when(row % mod == rem, F.lit(value).cast(kind)).otherwise(cols.get(column, F.col(column)))
    empty = F.array(F.lit(""))
    cols["pics"] = F.when(row % 61 == 6, F.concat("pics", empty)).otherwise(F.col("pics"))
    past = F.transform(F.sequence(F.lit(1), (row % 3 + 1).cast("int")), lambda i: F.concat(F.lit("visit "), i.cast("string")))
    cols["history_reviews"] = (F.when(row % 67 == 9, F.concat(past, empty)).when(row % 5 == 0, past)
                               .otherwise(F.array().cast("array<string>")))
    return df.withColumns(cols)


def ratings_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem join orders as a large ratings table with the unique row key."""
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"), "l_orderkey")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        (F.when(F.col("l_orderkey") % 10 == 9, "test").when(F.col("l_orderkey") % 10 == 8, "val")
         .otherwise("train")).alias("split"),
        F.concat(F.lit("b"), F.col("l_partkey").cast("string")).alias("business_id"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        (F.lit(1) + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("rating"),
    )


RATINGS_LARGE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def picture_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("pic_id"),
        F.col("embedding").alias("img_vec"))


# fixed values: request parameters assigned to query rows by vec_id % 4 / % 3
QUERY_K = (5, 10, 50, None)
QUERY_WEIGHTS = (None, {"joint_score": 1.0, "text_similarity": 0.0},
                 {"joint_score": 0.0, "text_similarity": 1.0})


def query_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embeddings row is a request: (query_id, query_text, k, weights, query_emb)."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    kcase = F.when(F.col("vec_id") % 4 == 0, F.lit(QUERY_K[0]))
    for i in (1, 2):
        kcase = kcase.when(F.col("vec_id") % 4 == i, F.lit(QUERY_K[i]))
    kcase = kcase.otherwise(F.lit(None))

    def _map(w):
        return F.create_map(*[x for kk, vv in w.items() for x in (F.lit(kk), F.lit(float(vv)))])

    wcase = (F.when(F.col("vec_id") % 3 == 1, _map(QUERY_WEIGHTS[1]))
             .when(F.col("vec_id") % 3 == 2, _map(QUERY_WEIGHTS[2])))
    return emb.select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("query "), F.col("vec_id").cast("string")).alias("query_text"),
        kcase.cast("int").alias("k"),
        wcase.alias("weights"),
        F.col("embedding").alias("query_emb"),
    )


# fixed values: requests without a user and with an unknown one, by vec_id % 10
NO_USER_REM, UNKNOWN_USER_REM = 0, 1


def user_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests with the text of a benchmark item (``query_text``) and a
    user: (query_id, query_text, k, weights, query_emb, user_id)."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("_text"))
    n = row_count(spark, sf_dir, "benchmark")
    q = query_requests(spark, sf_dir).withColumn("_item", F.col("query_id") % F.lit(n)).join(items, "_item", "left")
    rem = F.col("query_id") % 10
    user = F.when(rem == NO_USER_REM, F.lit(None)).when(rem == UNKNOWN_USER_REM, F.lit("nobody")).otherwise(
        F.concat(F.lit("u"), F.col("query_id").cast("string")))
    return q.select("query_id", F.col("_text").alias("query_text"), "k", "weights", "query_emb", user.alias("user_id"))


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("business_id"),
        F.col("p_name").alias("name"))


# fixed values: a small sentiment lexicon (token, valence) over words that occur
# in the documents table; an input table for lexicon_sentiment.
LEXICON = [
    ("the", 0.0), ("and", 0.4), ("le", 0.6), ("un", -0.6), ("of", -0.2), ("is", 0.9),
    ("with", 1.5), ("are", -1.1), ("by", 0.3), ("on", -0.4), ("de", 1.2), ("la", -1.3),
    ("en", 0.8), ("der", -0.9), ("die", -2.0), ("und", 1.1), ("el", 0.7), ("los", -0.5),
    ("que", 1.9), ("good", 1.9), ("great", 3.1), ("bad", -2.5), ("terrible", -2.1),
]
NEGATIONS = ["not", "no", "never", "nor", "ne", "nicht", "pas", "without"]
BOOSTERS = [("very", 0.293), ("really", 0.293), ("extremely", 0.293), ("slightly", -0.293)]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "token string, valence double")
