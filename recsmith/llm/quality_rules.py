"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule is a ratio per text (higher is worse), put into ``BINS`` equal bins.
Every language is a stratum. Labelled rows are dealt by a hash of their id into
a design part (a third) and a holdout. The design part proposes, for each
stratum and rule, the cutoff that rejects the most bad rows, clean ones counting
``CLEAN_WEIGHT`` times, and orders a stratum's rules by that gain. So a path is
fixed before the holdout is looked at: first the best rule alone, then the best
two together, and so on. The holdout certifies steps of the path while the exact
binomial bound says that all rules of the step together reject at most ``risk``
of the clean rows: P(Binomial(clean rows, risk) <= clean rows rejected) must be
``delta / strata`` at most, where ``strata`` counts the languages with enough
clean holdout rows to pass at all (a number that does not depend on any result).
Testing in a fixed order needs no further correction (a step can only follow
certified ones), and dividing delta by the strata keeps the chance of any wrong
certificate in any language under ``delta``. The last certified step's rules
reject; a language without one rejects nothing beyond the base rules.

The counts cover all labelled rows. Cutoffs are a table (a row per language with
a certified step) that is joined to the rows; the driver gets one number.

Defined results: null text has no words and fails the base rules (as any text
under 50 words); a null language is the stratum of the empty one; ties at a
cutoff reject, ties of gain go to the higher cutoff and the earlier rule; a
document whose labels disagree is not clean; null and repeated ids are judged
row by row; texts are read whole; other columns may have any names; an empty
table gives an empty table; without labels only the base rules reject.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recsmith.llm.common import materialize, unused

WS = " \t\n\x0b\f\r"
BINS = 200
CLEAN_WEIGHT = 5.0

#: Ratios, by rule: numerator, denominator (columns of ``measure``).
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "shouting": ("n_shout", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words_32"),
}


@dataclass(frozen=True)
class Risk:
    """risk: share of clean rows that may be rejected; delta: chance that the promise fails."""
    risk: float = 0.02
    delta: float = 0.05


def measure(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``df`` with the counts of its text column added, under ``prefix``."""
    c = lambda name: F.col(f"`{prefix}{name}`")
    put = lambda d, **cols: d.select("*", *[v.alias(prefix + k) for k, v in cols.items()])
    less = lambda t, cls: F.length(t) - F.length(F.regexp_replace(t, cls, ""))
    d = put(df, t=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    trimmed = F.btrim(c("t"), F.lit(WS))
    d = put(d, w=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
            lines=F.filter(F.split(c("t"), "\n"), lambda x: F.btrim(x, F.lit(WS)) != ""),
            n_symbols=less(c("t"), r"[#*$%&|<>]+").cast("long"), n_shout=less(c("t"), "[A-Z!]+").cast("long"))
    d = put(d, n_words=F.size(c("w")).cast("long"), word_chars=F.length(F.array_join(c("w"), "")).cast("long"),
            n_lines=F.size(c("lines")).cast("long"),
            n_dup_lines=(F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            tri=F.transform(F.slice(c("w"), 1, F.greatest(F.size(c("w")) - 2, F.lit(0))),
                            lambda x, i: F.xxhash64(x, F.get(c("w"), i + 1), F.get(c("w"), i + 2))))
    # windows sorted by hash and place; those equal to a neighbour occur twice or more
    d = put(d, pairs=F.when(F.size(F.array_distinct(c("tri"))) < F.size(c("tri")), F.sort_array(
        F.transform(c("tri"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(x["h"] == F.get(c("pairs"), k)["h"], F.lit(False))
    d = put(d, starts=F.sort_array(F.transform(F.filter(c("pairs"), lambda x, k: same(x, k - 1) | same(x, k + 1)),
                                               lambda x: x["i"])))
    # a window covers three words, fewer if the next one starts before
    d = put(d, n_repeat_words=F.coalesce(F.aggregate(
        F.transform(c("starts"), lambda p, k: F.least(F.lit(3), F.coalesce(F.get(c("starts"), k + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"), n_words_32=c("n_words") * 32)
    return d.drop(*[prefix + k for k in ("t", "w", "lines", "tri", "pairs", "starts")])


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    return (n < 50) | (100 * r > 50 * n)


def bins(prefix: str = "") -> Column:
    """Bin of each rule's ratio, 0 to BINS, in the order of RULES."""
    def one(num: str, den: str) -> Column:
        a, b = F.col(f"`{prefix}{num}`"), F.col(f"`{prefix}{den}`")
        return F.when(b > 0, F.least(F.lit(BINS), F.floor(BINS * a / b))).otherwise(0).cast("int")
    return F.array(*[one(*r) for r in RULES.values()])


def most_rejected(n: Column, risk: float, delta: Column) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= delta, -1 if there is
    none; summed in logarithms, term after term."""
    import math
    logit = math.log(risk) - math.log1p(-risk)
    start = F.struct((n * math.log1p(-risk)).cast("double").alias("term"), F.lit(None).cast("double").alias("total"),
                     F.lit(-1).cast("long").alias("best"))

    def step(s: Column, k: Column) -> Column:
        total = F.when(s["total"].isNull(), s["term"]).otherwise(
            F.greatest(s["total"], s["term"]) + F.log1p(F.exp(-F.abs(s["total"] - s["term"]))))
        return F.struct((s["term"] + F.log((n - k).cast("double") / (k + 1)) + logit).alias("term"), total.alias("total"),
                        F.when(total <= F.log(delta), k).otherwise(s["best"]).alias("best"))

    # beyond the mean the probability is about a half
    last = F.least(n - 1, F.ceil(n * risk))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), last).cast("long")), start, step)["best"]).otherwise(-1)


def is_design(doc_id: Column) -> Column:
    """Whether a labelled row designs the path (a third of them) or certifies it."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 3 == 0


def fit(measured: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, cuts): the certified rules of a language, as an array of structs
    (step, rule, bin); ``rule`` counts RULES from 0. ``measured``: doc_id, lang,
    base_failed, bins."""
    import math

    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    rows = (measured.filter(~F.col("base_failed")).select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "bins")
            .join(marks, "doc_id").groupBy("stratum", is_design(F.col("doc_id")).alias("design"), "bins").agg(
                F.sum((F.col("quality") >= 1).cast("long")).alias("clean"), F.sum((F.col("quality") < 1).cast("long")).alias("bad")))
    rows = materialize(rows, "quality-counts")
    hist = (rows.filter("design").select("stratum", "clean", "bad", F.posexplode("bins").alias("rule", "bin"))
            .groupBy("stratum", "rule", "bin").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")))
    # a row for each stratum, rule and bin at most: a window's group has BINS + 1 rows
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("bin"))
    gain = (F.sum("bad").over(above) - CLEAN_WEIGHT * F.sum("clean").over(above)).alias("gain")
    best = (hist.select("stratum", "rule", "bin", gain).filter("bin > 0 and gain > 0")
            .groupBy("stratum", "rule").agg(F.max(F.struct("gain", "bin")).alias("x")))
    step = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("x.gain"), "rule"))
    path = best.select("stratum", step.alias("step"), "rule", "x.bin").groupBy("stratum").agg(
        F.sort_array(F.collect_list(F.struct("step", "rule", "bin"))).alias("path"))     # a row per rule at most

    first = F.array_min(F.transform("path", lambda p: F.when(F.get("bins", p["rule"]) >= p["bin"], p["step"])))
    steps = range(1, len(RULES) + 1)
    held = (rows.filter("not design").join(path, "stratum", "left").select("stratum", "clean", first.alias("first")).groupBy("stratum").agg(
        F.sum("clean").alias("n"), *[F.sum(F.when(F.col("first") <= j, F.col("clean")).otherwise(0)).alias(f"k{j}") for j in steps]))
    held = materialize(held, "quality-holdout")
    strata = held.filter(F.col("n") * math.log1p(-risk.risk) <= math.log(risk.delta)).count()
    most = held.select("*", most_rejected(F.col("n"), risk.risk, F.lit(risk.delta / max(1, strata))).alias("most"))
    # a later step rejects no less: the certified ones are a prefix
    last = most.select("stratum", sum(((F.col(f"k{j}") <= F.col("most")).cast("int") for j in steps), F.lit(0)).alias("last"))
    cuts = last.join(path, "stratum").select("stratum", F.filter("path", lambda p: p["step"] <= F.col("last")).alias("cuts"))
    return materialize(cuts.filter(F.size("cuts") > 0), "quality-cuts")


def rejected(bins_col: Column, cuts: Column) -> Column:
    """Whether any of the certified rules rejects a row with these bins."""
    return F.coalesce(F.exists(cuts, lambda c: F.get(bins_col, c["rule"]) >= c["bin"]), F.lit(False))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"),
                         F.col(f"`{text_col}`").alias("text"))
    return measure(narrow, "text").select("doc_id", "lang", *COUNTS, base_failed().alias("base_failed"), bins().alias("bins"))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row. The texts are
    read once; the narrow counts are written to the shared folder, fitted and
    judged from there."""
    rows = materialize(measured_rows(docs), "quality-measured")
    cuts = fit(rows, labels, risk)
    both = rows.join(cuts, F.coalesce("lang", F.lit("")) == F.col("stratum"), "left")
    return both.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~rejected(F.col("bins"), F.col("cuts"))).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns. The texts are measured
    twice, for the fit and for the verdict; the cutoffs join them (a row per
    language: the planner sends them to the texts, which stay where they are)."""
    cuts = fit(materialize(measured_rows(docs), "quality-measured"), labels, risk)
    p, stratum, cut, row = unused(docs, "_quality_", "_cut_stratum", "_cut_rules", "_cut_row")
    # the row number keeps the filter above the measures: pushed to the scan, they would be computed once per use
    d = measure(docs, "text", prefix=p).withColumn(row, F.monotonically_increasing_id())
    d = d.join(cuts.select(F.col("stratum").alias(stratum), F.col("cuts").alias(cut)), F.coalesce(d["lang"], F.lit("")) == F.col(stratum), "left")
    ok = ~base_failed(p) & ~rejected(bins(p), F.col(cut)) & (F.col(row) >= 0)
    return d.filter(ok).select(*[F.col(f"`{c}`") for c in docs.columns])
