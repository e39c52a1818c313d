"""URL filters: fixed host and path rules first, then association rules mined by
FP-growth from labelled URLs. DataFrame functions only.

A URL's tokens are its scheme, host, every label of the host, every segment of
the path, the words inside labels and segments, the file extension, every query
key, and whether it has a fragment; no token is left out for its place. Mining
is kept affordable by what the tokens do, not where they stand: a token with too
few blocked URLs cannot be in any rule; of tokens that stand in exactly the same
labelled URLs one is mined for all of them; a token that blocked URLs do not
have more often than others (lift under 1) is left to rules without it. Labelled
URLs with an extra token for blocked ones go through Spark's FP-growth; rules
that conclude "blocked" are kept when they have ``length`` tokens at most, when
confidence, lift and the number of supporting URLs suffice, and when no shorter
rule inside them is as confident. Every kept rule is filed under its rarest
token; a URL looks up its tokens in that index and a rule matches if the URL has
all of its tokens.

Defined results: host and path are empty for a null URL or one without ``://``;
such a URL has no token, so the method allows it; of several fixed rules that
fit the longest (host and path together) decides, and of equally long ones the
block; repeated rows and null ids are judged row by row, repeated labelled URLs
count each; URLs of any length are read whole; without labels nothing is mined
and the method allows all; an empty table gives an empty table; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsmith.llm.common import materialize

# fixed values: host and path rules
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
BLOCKED = "!blocked"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Pruning:
    """What a mined rule needs: confidence, lift over the share of blocked URLs,
    the share and number of labelled URLs that have it and are blocked, and its
    number of tokens at most."""
    confidence: float = 0.6
    lift: float = 1.5
    support: float = 0.002
    rows: int = 8
    length: int = 4


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, as written, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), rules[r] == "block")):     # later tests win
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(r)).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The URL's tokens, distinct, each with its kind."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    kind = lambda name, values: F.transform(values, lambda v: F.concat(F.lit(name + "="), v))
    words = lambda values: F.filter(F.split(F.lower(F.array_join(values, " ")), r"[^\p{L}\p{N}]+"), lambda v: v.rlike(r"\p{L}"))
    one = lambda value: F.filter(F.array(value), lambda v: v != "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda v: F.regexp_extract(v, "^([^=]*)", 1)), lambda v: v != "")
    found = F.concat(
        kind("scheme", one(F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1)))), kind("host", one(host)), kind("label", labels),
        kind("hostword", words(labels)), kind("segment", segments), kind("pathword", words(segments)),
        kind("ext", one(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))), kind("query", keys),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment="))).otherwise(F.array().cast("array<string>")))
    return F.when(host != "", F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def useful(rows: DataFrame, n: int, bad: int, need: Pruning) -> DataFrame:
    """(token, n): the tokens worth mining, of (uid, tokens, blocked) rows."""
    each = rows.select("blocked", F.explode("tokens").alias("token"), F.xxhash64("uid").alias("h"), F.xxhash64("uid", F.lit(1)).alias("h2"))
    same = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("h", "h2")]       # tells the set of rows, whatever their order
    stat = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad"), *same)
    stat = stat.filter((F.col("bad") >= max(need.rows, need.support * n)) & (F.col("bad") * n >= F.col("n") * bad))
    # of equal ones a part of the host rather than the whole, so that the rule also fits hosts that are not labelled
    first = F.min(F.struct(F.col("token").startswith("host=").alias("whole"), "token"))
    return stat.groupBy("n", "bad", "h", "h2").agg(first.alias("x")).select("x.token", "n")


def mine(labelled: DataFrame, need: Pruning = Pruning()) -> DataFrame:
    """Rules (tokens, confidence, support) from rows (tokens, blocked)."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("uid"), "tokens", "blocked")
    rows = materialize(rows, "url-labelled")
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("blocked").cast("int")), F.lit(0)).alias("bad")).first()
    if not n.bad:
        return spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    some = useful(rows, n.n, n.bad, need).select("token")
    kept = (rows.select("uid", F.explode("tokens").alias("token")).join(some, "token")
            .groupBy("uid").agg(F.collect_list("token").alias("tokens")))               # a URL's tokens
    items = rows.select("uid", "blocked").join(kept, "uid").select(
        F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens")).alias("items"))
    items = materialize(items, "url-items")
    m = items.count()
    if not m:
        return spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    least = min(1.0, max(need.support * n.n, need.rows) / m)
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=need.confidence).fit(items)
    rules = model.associationRules.filter(
        (F.array_size("consequent") == 1) & (F.get("consequent", F.lit(0)) == BLOCKED) & (F.array_size("antecedent") <= need.length)
        & (F.col("confidence") >= need.lift * (n.bad / n.n)) & (F.col("support") * m >= need.rows - 0.5))
    rules = materialize(rules.select(F.sort_array("antecedent").alias("tokens"), "confidence",
                                     (F.col("support") * m / n.n).alias("support")), "url-rules")
    # a rule goes if a shorter one inside it is as confident; both share a token
    short = rules.select(F.col("tokens").alias("inner"), F.col("confidence").alias("inner_confidence"),
                         F.explode("tokens").alias("token"))
    worse = (rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(short, "token")
             .filter((F.size("inner") < F.size("tokens")) & (F.col("inner_confidence") >= F.col("confidence"))
                     & (F.size(F.array_except("inner", "tokens")) == 0)).select("tokens").distinct())
    return rules.join(worse, "tokens", "left_anti")


def indexed(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """token, rule: each rule under the rarest of its tokens; ``seen`` has
    (token, n) of the labelled URLs."""
    each = rules.select("tokens", F.explode("tokens").alias("token")).join(seen, "token", "left")
    return each.groupBy("tokens").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("x")).select(
        F.col("x.token").alias("token"), F.col("tokens").alias("rule"))


def judge(pages: DataFrame, labelled: DataFrame, rules: dict[str, str] | None = None, need: Pruning = Pruning(),
          url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether a mined rule matches)
    of every row. ``labelled``: rows (url, blocked)."""
    rules = RULES if rules is None else rules
    marks = labelled.filter("url is not null and blocked is not null").select(tokens(F.col("url")).alias("tokens"), "blocked")
    marks = materialize(marks, "url-marks")
    mined = mine(marks, need)
    seen = marks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    index = materialize(indexed(mined, seen), "url-index")

    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    urls = rows.filter("url is not null").select("url").distinct()
    hit = (urls.select("url", tokens(F.col("url")).alias("tokens")).select("url", "tokens", F.explode_outer("tokens").alias("token"))
           .join(index, "token").filter(F.size(F.array_except("rule", "tokens")) == 0)
           .select("url", F.lit(True).alias("mined")).distinct())
    out = rows.join(hit, "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = out.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("mined", F.lit(False)).alias("mined"))
    out = out.select("*", fixed_rule(F.col("host"), F.col("path"), rules).alias("rule"))
    verdict = F.when(F.col("mined"), "block").otherwise("allow")
    for r, v in rules.items():
        verdict = F.when(F.col("rule") == r, v).otherwise(verdict)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined")


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of the pages whose URL names a labelled document by its
    number: blocked if a label says low quality or toxic."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(((F.col("quality") < 1) | (F.col("toxic") > 0)).cast("int")).alias("bad")).filter("bad is not null")
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:[/.]|$)", 1)
    return (pages.select("url", F.when(F.length(number) > 0, number).cast("long").alias("doc_id"))
            .join(marks, "doc_id").select("url", (F.col("bad") > 0).alias("blocked")))
