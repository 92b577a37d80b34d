"""Data-quality profile: gaps, duplicates, ranges, scaling and feature scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.numbers import half_up, ratio_or_zero
from wattframe.operators.cleaning import COPIES, Cleaned, count_copies
from wattframe.operators.encoding import Scaler, category_domains, domain_rows, fit_scaler
from wattframe.roles import METERED, Roles


def _rows(one_row: DataFrame, entries: list[Column]) -> DataFrame:
    """One aggregate row turned into one row per entry."""
    return one_row.select(F.inline(F.array(*entries)))


def missing_profile(df: DataFrame) -> DataFrame:
    """(position, column, missing, pct) for columns that have a gap."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).alias("missing"),
                 half_up(ratio_or_zero(F.col(c) * 100, F.col("_rows")), 2).alias("pct"))
        for i, c in enumerate(df.columns)
    ]
    return _rows(row, entries).where(F.col("missing") > 0)


def table_summary(distinct: DataFrame, stage: str) -> DataFrame:
    """(stage, row_count, column_count, missing_total, duplicates) from distinct rows with their copies."""
    columns = [c for c in distinct.columns if c != COPIES]
    gaps = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return distinct.agg(
        F.lit(stage).alias("stage"),
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("row_count"),
        F.lit(len(columns)).cast("bigint").alias("column_count"),
        F.coalesce(F.sum(F.col(COPIES) * gaps), F.lit(0)).alias("missing_total"),
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("duplicates"),
    )


def before_after(cleaned: Cleaned) -> DataFrame:
    """The raw side needs no second shuffle: cleaning has left its distinct rows."""
    after = table_summary(count_copies(cleaned.rows), "after")
    return table_summary(cleaned.distinct, "before").unionAll(after)


def timestamp_range(raw: DataFrame, cleaned: DataFrame, roles: Roles = METERED) -> DataFrame:
    types = [dict(df.dtypes)[roles.timestamp] for df in (raw, cleaned)]
    stamp = F.col(roles.timestamp)
    return cleaned.agg(
        F.lit(types[0]).alias("type_before"), F.lit(types[1]).alias("type_after"),
        F.min(stamp).cast("string").alias("first_timestamp"),
        F.max(stamp).cast("string").alias("last_timestamp"),
    )


def encoding_report(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """(column, method, categories, new_columns): one-hot widths of the features, codes of the class label."""
    domains = category_domains(df, roles.class_categorical)
    features = df.sparkSession.createDataFrame(
        [(c, "One-hot", domains.listed[c], n) for c, n in domains.counts.items() if n],
        "column string, method string, categories string, new_columns bigint")
    order = F.array(*[F.lit(c) for c in roles.category_order])
    code = F.array_position(order, F.col("value")) - 1
    labels = domain_rows(df, [roles.category]).where(code >= 0).agg(
        F.lit(f"{roles.category} (target)").alias("column"), F.lit("Label / ordinal").alias("method"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(code.alias("code"), "value"))),
                        lambda x: F.concat(x["value"], F.lit(" = "), x["code"].cast("string"))), ", ",
        ).alias("categories"),
        F.lit(1).cast("bigint").alias("new_columns"),
    )
    return features.unionAll(labels)


def scaling_report(df: DataFrame, columns: Sequence[str], scaler: Scaler | None = None) -> DataFrame:
    """Mean and deviation before (sample deviation) and after (population deviation) scaling, 3 digits."""
    scaler = scaler or fit_scaler(df, columns)
    z = scaler.expressions()
    aggregates = []
    for c in columns:
        aggregates += [F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"),
                       F.avg(z[c]).alias(f"{c}_zm"), F.stddev_pop(z[c]).alias(f"{c}_zs")]
    entries = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"),
            half_up(F.col(f"{c}_m"), 3).alias("mean_before"), half_up(F.col(f"{c}_s"), 3).alias("std_before"),
            half_up(F.col(f"{c}_zm"), 3).alias("mean_after"), half_up(F.col(f"{c}_zs"), 3).alias("std_after"),
        )
        for i, c in enumerate(columns)
    ]
    return _rows(df.agg(*aggregates), entries)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null for a constant column (the built-in fails the job there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_with_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, corr_with_energy), 3 digits."""
    row = df.agg(*[correlation(F.col(c).cast("double"), F.col(target)).alias(c) for c in features])
    entries = [F.struct(F.lit(c).alias("feature"), half_up(F.col(c), 3).alias("corr_with_energy")) for c in features]
    return _rows(row, entries)


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, f_score): variance between the classes over variance within them, 1 digit.

    One aggregation by class, then sums over the few class rows; means are taken relative to the first class
    so that large offsets do not cancel.
    """
    moments = []
    for c in features:
        x = F.col(c).cast("double")
        moments += [F.count(x).alias(f"{c}_n"), F.avg(x).alias(f"{c}_m"), F.var_pop(x).alias(f"{c}_v")]
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(*moments)
    long = per_class.select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_m").alias("m"),
                     F.col(f"{c}_v").alias("v")) for c in features
        ]))
    )
    sums = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.collect_list(F.struct("n", "m")).alias("means"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
    )
    between = F.aggregate(
        "means", F.lit(0.0),
        lambda acc, p: acc + p["n"] * (p["m"] - F.col("grand")) * (p["m"] - F.col("grand")),
    )
    score = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k")))
    return sums.select("feature", half_up(score, 1).alias("f_score"))


def feature_selection(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """(position, feature, corr_with_energy, f_score_vs_category, used_in)."""
    corr = corr_with_target(df, roles.regression_numeric, roles.measure)
    scores = anova_f(df, roles.class_numeric, roles.category)
    sets = (
        ("Classification", roles.class_numeric + roles.class_categorical),
        ("Regression", roles.regression_numeric + roles.regression_categorical),
    )
    features = list(dict.fromkeys(roles.regression_numeric + roles.class_categorical))
    uses = [(i, c, ", ".join(name for name, columns in sets if c in columns) or "-") for i, c in enumerate(features)]
    listed = df.sparkSession.createDataFrame(uses, "position int, feature string, used_in string")
    # one row per feature on every side
    return (
        listed.join(F.broadcast(corr), "feature", "left").join(F.broadcast(scores), "feature", "left")
        .select("position", "feature", "corr_with_energy", F.col("f_score").alias("f_score_vs_category"), "used_in")
    )


def excluded_columns(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """(column, reason, values): columns of this table that must never be features, with their filled cells."""
    present = [(c, why) for c, why in roles.excluded if c in df.columns]
    row = df.agg(*[F.count(c).alias(c) for c, _ in present])
    return _rows(row, [
        F.struct(F.lit(c).alias("column"), F.lit(why).alias("reason"), F.col(c).alias("filled")) for c, why in present
    ])


# Preview columns.
PREVIEW_COLUMNS = (
    "building_name", "hour", "temperature_c", "occupancy_pct", "hvac_usage_pct", "energy_consumption_kwh",
)
SCALED_PREVIEW_COLUMNS = ("temperature_c", "occupancy_pct", "hvac_usage_pct", "lighting_usage_pct")


def _first_rows(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    return df.orderBy(*order).limit(rows) if order else df.limit(rows)


def preview_clean(df: DataFrame, roles: Roles = METERED, order: Sequence[str] | None = None, rows: int = 5) -> DataFrame:
    columns = [c for c in PREVIEW_COLUMNS if c in df.columns]
    top = _first_rows(df, roles.key if order is None else order, rows)
    return top.select(*[F.col(c).cast("int").alias(c) if c == roles.hour else F.col(c) for c in columns])


def preview_scaled(
    df: DataFrame, roles: Roles = METERED, scaler: Scaler | None = None, order: Sequence[str] | None = None,
    rows: int = 5,
) -> DataFrame:
    columns = [c for c in SCALED_PREVIEW_COLUMNS if c in df.columns]
    z = (scaler or fit_scaler(df, columns)).expressions()
    top = _first_rows(df, roles.key if order is None else order, rows)
    return top.select(*[half_up(z[c], 3).alias(c) for c in columns])


def step_log(
    summary: DataFrame, log: DataFrame, types: DataFrame, roles: Roles = METERED, table_name: str = "readings",
) -> DataFrame:
    """(position, step, result): the seven lines of the report, from `before_after`, the log and the types."""
    gaps = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("step") == "missing_filled",
                                               F.struct("position", "column", "count", "rule")))),
            lambda x: F.format_string("%s: %d -> %s", x["column"], x["count"], x["rule"])), "; ")
    rows = summary.where(F.col("stage") == "before").select(
        F.lit(0).alias("position"), F.lit("Load into table").alias("step"),
        F.format_string(f"%s rows imported into table '{table_name}'", F.format_number("row_count", 0)).alias("result"),
    )
    from_log = log.agg(
        F.max(F.when(F.col("step") == "duplicates_removed", F.col("count"))).alias("duplicates"), gaps.alias("gaps"),
    ).select(F.inline(F.array(
        F.struct(F.lit(1).alias("position"), F.lit("Duplicate removal").alias("step"),
                 F.format_string("%d duplicate rows removed", "duplicates").alias("result")),
        F.struct(F.lit(2).alias("position"), F.lit("Missing value handling").alias("step"),
                 F.when(F.col("gaps") == "", "No missing values found").otherwise(F.col("gaps")).alias("result")),
    )))
    from_types = types.select(
        F.lit(3).alias("position"), F.lit("Timestamp conversion").alias("step"),
        F.concat("type_before", F.lit(" -> "), "type_after").alias("result"),
    )
    fixed = summary.where(F.col("stage") == "before").select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(step).alias("step"), F.lit(text).alias("result"))
        for i, step, text in (
            (4, "Categorical encoding", f"One-hot for {len(roles.class_categorical)} features, ordinal for target"),
            (5, "Numerical scaling", f"Z-score on {len(roles.scaled_columns)} numeric columns"),
            (6, "Feature selection", "Target-derived columns and identifiers excluded"),
        )
    ])))
    return rows.unionAll(from_log).unionAll(from_types).unionAll(fixed)
