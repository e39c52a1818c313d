"""Picture fetch planning: candidate urls, skip already-present files, pick
the first accepted base per picture, tally outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: picture hosts, in preference order
BASES = ["https://lh3.googleusercontent.com/p/", "https://lh5.googleusercontent.com/p/"]
# fixed values: accepted content-type prefixes of a successful fetch
ACCEPTED_TYPES = ("image/", "application/octet-stream")


def candidate_urls(pictures: DataFrame, bases: list[str] = BASES) -> DataFrame:
    """(pic_id, base_pos, url): every picture against every base, in order."""
    arr = F.array(*[F.lit(b) for b in bases])
    return pictures.select("pic_id", F.posexplode(arr).alias("base_pos", "base")).select(
        "pic_id", F.col("base_pos").cast("int"), F.concat("base", "pic_id").alias("url"))


def anti_join_downloaded(pictures: DataFrame, listing: DataFrame) -> DataFrame:
    """Pictures with no file of size > 0 yet (listing: pic_id, length)."""
    present = listing.filter(F.col("length") > 0).select("pic_id")
    return pictures.join(present, "pic_id", "left_anti")


def accepted(status: str = "status", content_type: str = "content_type") -> F.Column:
    ct = F.coalesce(F.col(content_type), F.lit(""))
    ok_type = F.lit(False)
    for p in ACCEPTED_TYPES:
        ok_type = ok_type | ct.startswith(p)
    return (F.col(status) == 200) & ok_type


def fetch_outcome(pictures: DataFrame, attempts: DataFrame, listing: DataFrame) -> DataFrame:
    """Per picture: 'present' (file already there), 'saved' (first accepted base
    wins) or 'failed'; the chosen url for saved ones."""
    present = listing.filter(F.col("length") > 0).select("pic_id").distinct().withColumn("_present", F.lit(1))
    best = (attempts.filter(accepted()).groupBy("pic_id")
            .agg(F.min_by("url", "base_pos").alias("url")))
    j = pictures.join(present, "pic_id", "left").join(best, "pic_id", "left")
    outcome = (F.when(F.col("_present") == 1, "present").when(F.col("url").isNotNull(), "saved")
               .otherwise("failed"))
    return j.select("pic_id", outcome.alias("outcome"),
                    F.when(F.col("_present").isNull(), F.col("url")).alias("url"))


def fetch_tally(outcomes: DataFrame) -> DataFrame:
    """saved (present counts as saved) and failed totals."""
    return outcomes.agg(F.count_if(F.col("outcome") != "failed").alias("saved"),
                        F.count_if(F.col("outcome") == "failed").alias("failed"))
