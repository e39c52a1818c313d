"""Display mappings of the ranking page, as column expressions over result
and detail tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: display constants
ORIGIN = "http://127.0.0.1:8000"
CARD_PLACEHOLDER = "https://via.placeholder.com/400x260?text=No+Image"
DETAIL_PLACEHOLDER = "https://via.placeholder.com/800x400?text=No+Image"
UNKNOWN_NAME = "Unknown Restaurant"
NO_ADDRESS = "Address not available"
JOINT_BAR_MAX = 8.0
TEXT_BAR_MAX = 15.0
TEXT_WEIGHT_PER_MODE = 20.0
# fixed values: slider label thresholds (upper bounds) and labels
MODE_LABELS = [(0.2, "Discovery (Model Only)"), (0.4, "Balanced"), (0.7, "Search (Default)")]
MODE_LAST_LABEL = "Strict Match"
STARS = 5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mode_to_weights(mode) -> list[Column]:
    """slider m -> (w_joint 1.0, w_text 20*m, label)."""
    m = _c(mode)
    label = F.when(m < MODE_LABELS[0][0], MODE_LABELS[0][1])
    for bound, name in MODE_LABELS[1:]:
        label = label.when(m < bound, name)
    return [F.lit(1.0).alias("w_joint"), (m * TEXT_WEIGHT_PER_MODE).alias("w_text"),
            label.otherwise(MODE_LAST_LABEL).alias("mode_label")]


def _js_falsy_num(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (x == 0)


def image_src(url, placeholder: str) -> Column:
    u = _c(url)
    prefixed = F.when(u.startswith("/"), F.concat(F.lit(ORIGIN), u)).otherwise(u)
    return F.when(u.isNull() | (u == ""), F.lit(placeholder)).otherwise(prefixed)


def result_presentation(joint="joint_score", text="text_similarity", url="representative_image_url",
                        name="name", reviews="num_reviews", score="score") -> list[Column]:
    j = F.when(_js_falsy_num(_c(joint)), 0.0).otherwise(_c(joint))
    t = F.when(_js_falsy_num(_c(text)), 0.0).otherwise(_c(text))
    return [
        F.least(j / JOINT_BAR_MAX * 100.0, F.lit(100.0)).alias("joint_pct"),
        F.least(t / TEXT_BAR_MAX * 100.0, F.lit(100.0)).alias("text_pct"),
        image_src(url, CARD_PLACEHOLDER).alias("img_src"),
        F.coalesce(F.nullif(_c(name), F.lit("")), F.lit(UNKNOWN_NAME)).alias("display_name"),
        F.coalesce(_c(reviews), F.lit(0)).cast("long").alias("display_reviews"),
        one_decimal_label(score).alias("score_label"),
    ]


def one_decimal_label(x) -> Column:
    """Score text with one decimal, half-up on the 6-decimal value, sign kept
    ("-0.0" like the page). Integer arithmetic, so every engine agrees."""
    s6 = F.round(_c(x) * F.lit(1e6)).cast("long")
    tenths = F.floor((F.abs(s6) + F.lit(50000)) / F.lit(100000)).cast("long")
    txt = F.concat(F.when(s6 < 0, "-").otherwise(""), (tenths / 10).cast("long").cast("string"), F.lit("."),
                   (tenths % 10).cast("string"))
    return F.when(_c(x).isNull(), None).otherwise(txt)


def star_buckets(avg) -> list[Column]:
    """full stars = floor(avg) (0..5), one half star if the remainder >= 0.5
    and room is left, the rest empty; null rating -> no stars (nulls)."""
    a = _c(avg)
    fl = F.floor(a)
    full = F.least(F.greatest(fl, F.lit(0)), F.lit(STARS)).cast("int")
    half = F.when((fl >= 0) & (fl < STARS) & (a - fl >= 0.5), 1).otherwise(0)
    return [F.when(a.isNull(), None).otherwise(full).alias("full_stars"),
            F.when(a.isNull(), None).otherwise(half).alias("half_star"),
            F.when(a.isNull(), None).otherwise(STARS - full - half).alias("empty_stars")]


def _js_num_str(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def detail_presentation(df_cols=None) -> list[Column]:
    """Detail page strings from an item_detail_lookup row."""
    city, state = F.col("city"), F.col("state")
    sales = F.col("sales_volume")
    return [
        F.coalesce(one_decimal_label("avg_rating"), F.lit("N/A")).alias("rating_label"),
        F.concat(F.coalesce(F.col("num_reviews").cast("string"), F.lit("")), F.lit(" reviews")).alias("reviews_label"),
        F.when(city.isNotNull() & (city != ""), F.concat(city, F.lit(", "), F.coalesce(state, F.lit(""))))
        .alias("location_label"),
        F.coalesce(F.nullif(F.col("address"), F.lit("")), F.lit(NO_ADDRESS)).alias("address_label"),
        F.concat(F.coalesce(F.col("name"), F.lit("")), F.lit(" is located in "), F.coalesce(city, F.lit("")), F.lit("."),
                 F.when(~_js_falsy_num(sales), F.concat(F.lit(" It has an estimated sales volume of "),
                                                        _js_num_str(sales), F.lit("."))).otherwise(F.lit("")))
        .alias("about"),
        image_src("image_url", DETAIL_PLACEHOLDER).alias("img_src"),
    ]
