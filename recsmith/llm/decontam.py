"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words of documents and items are hashed; from every window of W consecutive
K-gram hashes the minimum is kept as a fingerprint. Any span of K + W - 1 =
SPAN words that a document shares with an item has the same minimum on both
sides, so joining the fingerprints misses no such span. Hits are extended: for
each matched fingerprint the SPAN-word windows around it are compared whole,
which leaves no false hit. Items of fewer words are one window of their own
length: their hash is compared with all spans of that length (one pass for each
of these lengths, SPAN - 1 at most).

Only fingerprints (8 bytes each) and document keys are joined; texts move once,
for the documents that share a fingerprint. The item side of a join holds a row
per distinct hash; nothing is broadcast by hint.

Defined results: null or empty text has no words and is clean; an item without
words never occurs; repeated rows get equal results; rows that share an id but
not a text are judged apart; a null item_id counts as the empty string;
items_sha256 without items is that of the empty string; texts of any length are
read whole; nothing is chosen among equals (hits are unions), so there are no
ties; an empty table gives an empty table, and without items all rows are clean;
other columns may have any names. Spans are compared by 96 bits of two hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsmith.llm.common import materialize, text_key, unused

SPAN = 13
K, W = 8, 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the words; A-Z count as a-z, other letters as they are."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), "")
    return F.transform(words, lambda w: F.xxhash64(
        F.when(w.rlike("[A-Z]"), F.translate(w, _UPPER, _LOWER)).otherwise(w)))


def _pairwise(df: DataFrame, src: str, dst: str, apart: int, op) -> DataFrame:
    """Adds array ``dst``: op of each element and the one ``apart`` places on."""
    a = F.col(src)
    return df.select("*", F.transform(F.slice(a, 1, F.greatest(F.size(a) - apart, F.lit(0))),
                                      lambda x, i: op(x, F.get(a, i + apart))).alias(dst))


def grams(df: DataFrame, words: str = "words") -> DataFrame:
    """Adds ``gram``: the hash of the K = 8 words from each place on."""
    df = _pairwise(df, words, "_g2", 1, F.xxhash64)
    df = _pairwise(df, "_g2", "_g4", 2, F.xxhash64)
    return _pairwise(df, "_g4", "gram", 4, F.xxhash64).drop("_g2", "_g4")


def fingerprints(df: DataFrame, short: list[int], words: str = "words") -> DataFrame:
    """Adds ``fps``: the distinct minima of all windows of W = 6 grams, and the
    hashes of all spans of the lengths ``short``."""
    df = grams(df, words)
    df = _pairwise(df, "gram", "_m2", 1, F.least)
    df = _pairwise(df, "_m2", "_m4", 2, F.least)
    df = _pairwise(df, "_m4", "_m6", 2, F.least)
    sets = [F.col("_m6"), *[span_hashes(F.col(words), n) for n in short]]
    return df.select("*", F.array_distinct(F.concat(*sets)).alias("fps")).drop("_m2", "_m4", "_m6", "gram")


def span_hashes(words: Column, n: int) -> Column:
    """Hash of the ``n`` words from each place on."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))),
                       lambda _, i: F.xxhash64(F.slice(words, i + 1, F.lit(n)), F.lit(n)))


def _check_hash(words: Column, start: Column, n: Column) -> Column:
    """A second, independent hash of a span."""
    return F.hash(F.slice(words, start + 1, n))


def windows(items: DataFrame) -> DataFrame:
    """len, h, h2, items: the distinct windows of the benchmark, and the ids,
    as text, of the items that have each."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_hashes(F.col("text")).alias("words"))
    n = F.size("words")
    # explode_outer: explode would push a filter over the whole array expression to the scan
    w = w.select("item", "words", F.least(n, F.lit(SPAN)).alias("len"),
                 F.explode_outer(F.sequence(F.lit(0), F.greatest(n - SPAN, F.lit(0)))).alias("start"))
    words = F.col("words")
    return (w.select("item", "len", F.xxhash64(F.slice(words, F.col("start") + 1, F.col("len")), F.col("len")).alias("h"),
                     _check_hash(words, F.col("start"), F.col("len")).alias("h2"))
            .filter("len > 0").groupBy("len", "h", "h2").agg(F.sort_array(F.collect_set("item")).alias("items")))


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and _key
    (the key of the row's text) of every row."""
    items = items.select("item_id", "text")
    win = materialize(windows(items), "benchmark-windows")
    short = sorted(r.len for r in win.filter(F.col("len") < SPAN).select("len").distinct().collect())
    marks = (fingerprints(items.select(word_hashes(F.col("text")).alias("words")), [])
             .select(F.explode_outer("fps").alias("fp")).filter("fp is not null")
             .unionByName(win.filter(F.col("len") < SPAN).select(F.col("h").alias("fp"))).distinct())
    marks = materialize(marks, "benchmark-fingerprints")

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    key = [F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_id"), text_key(F.col("text")).alias("_key")]
    base = fingerprints(rows.select("doc_id", *key, word_hashes(F.col("text")).alias("words")), short).select(
        "doc_id", "_id", "_key", F.size("words").cast("long").alias("n_words"), "fps")
    base = materialize(base, "document-fingerprints")
    found = (base.select("_id", "_key", F.explode("fps").alias("fp")).join(marks, "fp")
             .groupBy("_id", "_key").agg(F.collect_set("fp").alias("matched")))

    # extension: the spans around each matched fingerprint, compared whole
    some = rows.select(*key, "text").join(found, ["_id", "_key"])
    some = grams(some.select("_id", "_key", "matched", word_hashes(F.col("text")).alias("words")))
    words, n = F.col("words"), F.size("words")
    hit_at = lambda hashes: F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains("matched", h), i)),
                                     lambda x: x.isNotNull())
    around = F.array_distinct(F.flatten(F.transform(hit_at(F.col("gram")), lambda p: F.sequence(
        F.greatest(p - (W - 1), F.lit(0)), F.least(p, n - SPAN)))))

    def of_length(starts: Column, m: int) -> Column:
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(m).alias("len")))

    spans = [F.when(n >= SPAN, of_length(around, SPAN)), *[of_length(hit_at(span_hashes(words, m)), m) for m in short]]
    none = F.array().cast("array<struct<start:int,len:int>>")
    some = some.select("_id", "_key", "words", F.explode_outer(F.concat(*[F.coalesce(s, none) for s in spans])).alias("s"))
    some = some.select("_id", "_key", "s.start", "s.len",
                       F.xxhash64(F.slice(words, F.col("s.start") + 1, F.col("s.len")), F.col("s.len")).alias("h"),
                       _check_hash(words, F.col("s.start"), F.col("s.len")).alias("h2"))
    hits = (some.join(win, ["len", "h", "h2"]).groupBy("_id", "_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n")))["n"]
    hits = hits.select("_id", "_key", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = base.drop("fps").join(hits, ["_id", "_key"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "_id", "_key")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns."""
    id_name, key_name = unused(docs, "_decontam_id", "_decontam_key")
    bad = (contamination(docs, items).filter("contaminated")
           .select(F.col("_id").alias(id_name), F.col("_key").alias(key_name)).distinct())
    bad = materialize(bad, "contaminated")
    mine = (F.coalesce(docs["doc_id"], F.lit(-1)) == F.col(id_name)) & (text_key(docs["text"]) == F.col(key_name))
    return docs.join(bad, mine, "left_anti")
