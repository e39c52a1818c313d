"""Ingest: split dumps (one JSON object or JSON lines), flattening, required
columns, QA and contract checks, provenance, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsmith.session import checkpoint_dir

# fixed values: the interaction contract
SPLITS = ("train", "val", "test")
REQUIRED = ["business_id", "user_id", "rating", "review_text", "pics", "history_reviews"]
OPTIONAL = ["name", "stars", "review_count", "num_reviews"]

RECORD_SCHEMA = T.StructType([
    T.StructField("business_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("pics", T.ArrayType(T.StringType())),
    T.StructField("history_reviews", T.ArrayType(T.StringType())),
    T.StructField("name", T.StringType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("num_reviews", T.LongType()),
])

DUMP_SCHEMA = T.StructType([T.StructField(s, T.ArrayType(RECORD_SCHEMA)) for s in SPLITS])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def scan_split_dump(spark: SparkSession, path: str, schema: T.StructType = DUMP_SCHEMA) -> DataFrame:
    """One JSON object {train: [...], val: [...], test: [...]} -> records with
    split and row_id (position in its split). The explicit schema matters: an
    empty split would otherwise infer as array<string>. A missing split key
    raises. A single JSON object is one task by nature; large dumps should use
    ``scan_records_jsonl``."""
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    missing = raw.select(*[F.col(s).isNull().cast("int").alias(s) for s in SPLITS]).first()
    absent = [s for s in SPLITS if missing is None or missing[s] == 1]
    if absent:
        raise KeyError(f"Missing split key: {absent[0]}")
    parts = [raw.select(F.lit(s).alias("split"), F.posexplode(s).alias("row_id", "r"))
             .select("split", F.col("row_id").cast("long"), "r.*") for s in SPLITS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_records_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines of records with a ``split`` column (and ``row_id``): scales
    with the number of files and splits."""
    schema = schema or T.StructType([T.StructField("row_id", T.LongType()), T.StructField("split", T.StringType())]
                                    + RECORD_SCHEMA.fields)
    return spark.read.schema(schema).json(path)


def require_splits(df: DataFrame, splits: tuple = SPLITS) -> DataFrame:
    """``df`` if rows of every split occur in it, else KeyError (one small aggregate)."""
    have = df.agg(*[F.coalesce(F.max((F.col("split") == s).cast("int")), F.lit(0)).alias(s) for s in splits]).first()
    if absent := [s for s in splits if not have[s]]:
        raise KeyError(f"Missing split key: {absent[0]}")
    return df


def discover_tables(spark: SparkSession, pattern: str) -> list[tuple[str, DataFrame]]:
    """(name, table) of the Parquet files and folders that a path pattern fits, by
    name; any filesystem Spark reads. Listed on the driver, as Spark lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    paths = sorted(s.getPath().toString() for s in found)
    return [(p.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet"), spark.read.parquet(p)) for p in paths]


def describe_tables(spark: SparkSession, pattern: str) -> DataFrame:
    """(table, pos, column, dtype, n_rows) of all columns of the tables a pattern
    fits. Types and row counts come from the files' footers; no data are read."""
    rows = []
    for name, df in discover_tables(spark, pattern):
        n = df.count()
        rows += [(name, i, f.name, f.dataType.simpleString(), n) for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table string, pos int, column string, dtype string, n_rows long")


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Any JSON lines file; schema given or inferred."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def flatten_records(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> flat columns named a.b.c (json_normalize style)."""
    def walk(st: T.StructType, prefix: list[str]):
        for f in st.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                yield F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))
    return df.select(*walk(df.schema, []))


def require_columns(df: DataFrame, required: list[str] = REQUIRED, what: str = "input") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"{what} missing columns: {missing}")
    return df


def project_required(df: DataFrame, required: list[str] = REQUIRED, keep: list[str] = ("row_id", "split")) -> DataFrame:
    require_columns(df, required)
    return df.select(*[c for c in keep if c in df.columns], *required)


def qa_report(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Per split: columns-in-order flag and row count."""
    ok = [c for c in df.columns if c not in ("row_id", "split")] == list(required)
    return (df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("columns_ok", F.lit(int(ok))))


def contract_rules() -> dict[str, F.Column]:
    """Conditions under which a record breaks the contract, by rule."""
    bad_list = lambda c: F.coalesce(F.exists(c, lambda p: p.isNull() | (p == "")), F.lit(False))
    return {
        "empty_business_id": F.col("business_id").isNull() | (F.col("business_id") == ""),
        "empty_user_id": F.col("user_id").isNull() | (F.col("user_id") == ""),
        "rating_out_of_range": F.col("rating").isNull() | ~F.col("rating").between(1, 5),
        "empty_text_without_rating": (F.coalesce(F.col("review_text"), F.lit("")) == "") & F.col("rating").isNull(),
        "bad_pic_id": bad_list("pics"),
        "bad_history_entry": bad_list("history_reviews"),
    }


def contract_violations(df: DataFrame) -> DataFrame:
    """One count per contract rule and split, from a single aggregate pass.

    ids non-empty; rating in 1..5; text empty only if a rating exists;
    list elements non-empty strings."""
    rules = contract_rules()
    agg = df.groupBy("split").agg(*[F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(k) for k, cond in rules.items()])
    return agg.select("split", F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("x")).select(
        "split", "x.rule", "x.violations")


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, violating rows with the ``reasons`` they break), by all contract rules."""
    why = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(k)) for k, cond in contract_rules().items()])
    marked = df.withColumn("reasons", F.filter(why, lambda x: x.isNotNull()))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def provenance_manifest(df: DataFrame, n_pictures: int | None = None, seed: int = 42,
                        source: str = "", version: str = "v1") -> DataFrame:
    """One row: split counts pivoted to columns, picture count, seed, source,
    version and creation time (the time is not part of checked output)."""
    counts = df.groupBy().pivot("split", list(SPLITS)).agg(F.count(F.lit(1)))
    counts = counts.select(*[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(f"rows_{s}") for s in SPLITS])
    return counts.select("*", F.lit(n_pictures).cast("long").alias("image_manifest_count"),
                         F.lit(seed).alias("random_seed"), F.lit(source).alias("source_file"),
                         F.lit(version).alias("dataset_version"), F.current_timestamp().alias("created_at_utc"))


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] = ("split",), mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# JSON lines that one compressed file holds at most: such a file is read by one task
ROWS_PER_JSON = 100_000


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines in compressed files of bounded rows."""
    df.write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_JSON).json(path)
    return path


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def vectors_long(df: DataFrame, key: list[str], col: str) -> DataFrame:
    """array column -> (key..., pos, value) rows (1-based pos)."""
    return df.select(*key, F.posexplode(col).alias("pos", "value")).select(
        *key, (F.col("pos") + 1).cast("int").alias("pos"), F.col("value").cast("double").alias("value"))


def scan_images(spark: SparkSession, folder: str, pic_ids: DataFrame | None = None,
                glob: str = "*.jpg") -> DataFrame:
    """binaryFile listing of picture files: ``{pic_id}.jpg`` names, or a
    ``pic_id=<id>/`` partitioned layout. With a picture table, a left join so
    missing pictures keep a null ``content`` (skipped by the encoder)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    pid = F.col("pic_id") if "pic_id" in raw.columns else F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    files = raw.select(pid.cast("string").alias("pic_id"), "length", "content")
    if pic_ids is None:
        return files
    return pic_ids.join(files, "pic_id", "left")


def scan_metadata(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Item metadata JSON lines; a missing path gives an empty typed frame."""
    schema = schema or T.StructType([
        T.StructField("business_id", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("image_url", T.StringType()), T.StructField("avg_rating", T.DoubleType()),
        T.StructField("num_reviews", T.LongType())])
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:  # absent file -> empty metadata, as the service does
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
