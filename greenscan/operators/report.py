"""Result analysis and display tables.

The reference draws pair plots; at table scale the data behind them is what
matters: per-column histograms (the diagonal), per-pair correlations (the
off-diagonal), both single aggregations.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenscan.operators.ranking import global_row_number

# Display names of the score fields, as the reference shows them.
DISPLAY_NAMES = {
    "num_tokens_scored": "Tokens Counted (T)",
    "num_green_tokens": "# Tokens in Greenlist",
    "green_fraction": "Fraction of T in Greenlist",
    "z_score": "z-score",
    "p_value": "p value",
    "prediction": "Prediction",
    "confidence": "Confidence",
}
THRESHOLD_NAME = "z-score Threshold"
SHORT_TEXT_ERROR = "string too short to compute metrics"
FEW_TOKENS_ERROR = "too few tokens to compute metrics"


def format_names(s: Column) -> Column:
    """Replace metric keys by display names inside a string."""
    for k, v in DISPLAY_NAMES.items():
        s = F.replace(s, F.lit(k), F.lit(v))
    return s


def fmt_g3(x: Column) -> Column:
    """Python's ``{x:.3g}``. Python rounds the exact binary value half-even; so does
    format_number, while %g rounds the shortest decimal form half-up. Values from 1e-4 to
    1000 are written with as many decimals as leave three digits (their number is corrected
    where rounding gains a digit, 9.999 -> 10.0), the others in scientific form."""
    size = F.abs(x)
    places = F.lit(2) - F.floor(F.log10(size)).cast("int")

    def fixed(decimals: int) -> Column:
        return F.replace(F.format_number(x, decimals), F.lit(","), F.lit(""))

    s = F.lit(None).cast("string")
    for d in range(7, -1, -1):
        one = fixed(d)
        gained = F.regexp_replace(one, r"^-?0?\.?0*|\.", "")  # significant digits
        s = F.when(places == d, F.when(F.char_length(gained) > 3, fixed(max(d - 1, 0))).otherwise(one)).otherwise(s)
    s = F.when(size == 0, F.when(x.cast("string").startswith("-"), F.lit("-0")).otherwise(F.lit("0"))) \
        .when((size >= 9.995e-5) & (size < 999.5), s).otherwise(F.format_string("%.2e", x))
    s = F.regexp_replace(s, r"(\.\d*?)0+(e|$)", "$1$2")
    return F.when(x.isNotNull(), F.regexp_replace(s, r"\.(e|$)", "$1"))


def fmt_pct(x: Column, digits: int) -> Column:
    """Python's ``{x:.Nf%}`` for fractions in [0, 1]. Python rounds the exact binary
    value half-even; java.text.DecimalFormat (behind format_number) does the same,
    where the %f of format_string rounds the shortest decimal form half-up."""
    return F.when(x.isNotNull(), F.concat(F.format_number(x * F.lit(100.0), digits), F.lit("%")))


def display_rows(scores: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """Long display table (id, ord, metric, value) per scored text.

    Order as the reference lists it: T, green count, fraction, z, p, threshold,
    verdict, and confidence only for a positive verdict. Texts that could not be
    scored show one error row and six blank rows.
    """
    def row(metric, value):
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"))
    ok = [
        row(DISPLAY_NAMES["num_tokens_scored"], F.col("num_tokens_scored").cast("string")),
        row(DISPLAY_NAMES["num_green_tokens"], F.col("num_green_tokens").cast("string")),
        row(DISPLAY_NAMES["green_fraction"], fmt_pct(F.col("green_fraction"), 1)),
        row(DISPLAY_NAMES["z_score"], fmt_g3(F.col("z_score"))),
        row(DISPLAY_NAMES["p_value"], fmt_g3(F.col("p_value"))),
        row(THRESHOLD_NAME, F.lit(repr(float(threshold)))),
        row(DISPLAY_NAMES["prediction"],
            F.when(F.col("prediction"), F.lit("Watermarked")).otherwise(F.lit("Human/Unwatermarked"))),
        row(DISPLAY_NAMES["confidence"], fmt_pct(F.col("confidence"), 3)),
    ]
    ok_arr = F.filter(F.array(*ok), lambda s: s["value"].isNotNull())
    msg = F.when(F.col("status") == "too_short", F.lit(SHORT_TEXT_ERROR)).otherwise(F.lit(FEW_TOKENS_ERROR))
    err_arr = F.array(F.struct(F.lit("Error").alias("metric"), msg.alias("value")),
                      *[row("", F.lit("")) for _ in range(6)])
    arr = F.when(F.col("status") == "ok", ok_arr).otherwise(err_arr)
    out = scores.select(id_col, F.posexplode(arr).alias("ord", "r"))
    return out.select(id_col, F.col("ord").cast("int").alias("ord"), F.col("r.metric").alias("metric"),
                      F.col("r.value").alias("value"))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows with any null removed (P5)."""
    return df.na.drop("any")


def arm_columns(results: DataFrame, arm: str, metrics) -> DataFrame:
    """One arm's numeric columns cast to DOUBLE (P6), prefix removed."""
    return results.select(*[F.col(f"{arm}_{m}").cast("double").alias(m) for m in metrics])


def histograms(df: DataFrame, group_col: str, columns, bins: int = 20) -> DataFrame:
    """Equal-width histogram of each column per group (A18): (group, metric, bin,
    lo, hi, n). Min and max come from one aggregation joined back by (group,
    metric) - a table of a few rows, broadcast."""
    long = df.select(group_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s"))
    long = long.select(group_col, F.col("s.metric").alias("metric"), F.col("s.x").alias("x")) \
        .where(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = long.groupBy(group_col, "metric").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = long.join(F.broadcast(rng), [group_col, "metric"])
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width * F.lit(float(bins))), F.lit(bins - 1)))
    return j.groupBy(group_col, "metric", b.cast("int").alias("bin"), "lo", "hi") \
        .agg(F.count(F.lit(1)).alias("n"))


def pair_corr(df: DataFrame, group_col: str, columns) -> DataFrame:
    """Pearson correlation and pair count for every pair of columns per group (A19),
    in one aggregation; output (group, x_col, y_col, n, corr)."""
    pairs = list(combinations(columns, 2))
    aggs = []
    for x, y in pairs:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        aggs.append(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"c__{x}__{y}"))
        aggs.append(F.count(F.when(both, F.lit(1))).alias(f"n__{x}__{y}"))
    wide = df.groupBy(group_col).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(x).alias("x_col"), F.lit(y).alias("y_col"),
                              F.col(f"n__{x}__{y}").alias("n"), F.col(f"c__{x}__{y}").alias("corr"))
                     for x, y in pairs])
    out = wide.select(group_col, F.explode(rows).alias("r"))
    return out.select(group_col, "r.x_col", "r.y_col", "r.n", "r.corr")


def pair_bins(df: DataFrame, group_col: str, columns, bins: int = 10) -> DataFrame:
    """Sparse two-dimensional histogram of every pair of columns per group (A19): (group,
    x_col, y_col, x_bin, y_bin, n), cells that hold rows only. Each value is binned once in its
    row; one unpivot gives the pairs, counted per partition before the shuffle. Pairs with a
    null or NaN are left out, so the cells of a pair sum to its rows in :func:`pair_corr`
    wherever the columns hold no NaN. The ranges are one row per group."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    ranges = df.groupBy(group_col).agg(*[x for c in columns for x in (
        F.min(value(c)).alias(f"_lo_{c}"), F.max(value(c)).alias(f"_hi_{c}"))])
    ranges = ranges.withColumnRenamed(group_col, "_group")

    def bin_of(c: str) -> Column:
        lo, width = F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        at = F.least(F.floor((value(c) - lo) / width * F.lit(float(bins))), F.lit(bins - 1))
        return F.when(value(c).isNotNull(), F.when(width == 0, F.lit(0)).otherwise(at)).cast("int")

    binned = df.join(F.broadcast(ranges), F.col(group_col).eqNullSafe(F.col("_group"))) \
        .select(group_col, *[bin_of(c).alias(f"_b_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(x).alias("x_col"), F.lit(y).alias("y_col"), F.col(f"_b_{x}").alias("x_bin"),
                               F.col(f"_b_{y}").alias("y_bin")) for x, y in combinations(columns, 2)])
    rows = binned.select(group_col, F.explode(pairs).alias("p")).select(group_col, "p.*") \
        .where("x_bin is not null and y_bin is not null")
    return rows.groupBy(group_col, "x_col", "y_col", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def category_codes(df: DataFrame, columns, key_cols) -> DataFrame:
    """String columns -> integer codes by sorted distinct value (P7), as pandas
    ``category`` codes are. Distinct values are numbered by a distributed global
    rank and joined back (adaptive execution broadcasts small code tables)."""
    out = df.select(*key_cols, *columns)
    for c in columns:
        vals = df.select(F.col(c).alias("_v")).where(F.col("_v").isNotNull()).distinct()
        codes = global_row_number(vals, [F.col("_v")], "_code")
        out = out.join(codes, out[c] == codes["_v"], "left") \
            .withColumn(f"{c}_code", F.coalesce(F.col("_code"), F.lit(-1).cast("bigint"))) \
            .drop("_v", "_code")
    return out
