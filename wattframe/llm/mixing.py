"""Source mixing by a time-varying curriculum.

Each source has a target number of words and a schedule of how its weight changes over the training time. The
schedule is integrated to the words demanded until any time. The documents of a source lie one behind the other
in hash order, epoch after epoch; the word at which a document's middle lies is turned into a training position
by inverting the integral. Documents beyond the target get no position, repeated ones several.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.errors import ArgumentError
from wattframe.llm.words import count_blank_words
from wattframe.session import materialize

MAX_EPOCHS = 3
BUCKET_DIGITS = 3
Schedule = Sequence[tuple[float, float]]
# (time, weight), linear in between: early, even and late sources take turns
DEFAULT_SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def source_targets(sums: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`sums` (source_key, source, source_size) with `place` (0, 1, ..) and `target`.

    Sources by code point, null last, weigh `weights`, repeating. A target is min(max_epochs * size, level *
    weight) with the one level at which the targets add up to all sizes: the excess of full sources is shared by
    the others by weight until none is above. One row per source passes these windows.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    cap = F.col("source_size") * float(max_epochs)
    filled = everything.orderBy(F.col("_cap") / F.col("_weight"), "place")
    return (
        sums.withColumn("place", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn("_weight", weight).withColumn("_cap", cap)
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_rest"))
        .withColumn("_level", F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), "_level"))).over(everything)["_level"])
        .withColumn("target", F.least("_cap", F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_weight")))
        .drop("_weight", "_cap", "_all", "_full", "_rest", "_level")
    )


def knot_rows(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """The schedule as (time, weight, slope, integral until then), over a whole of 1."""
    times = [float(t) for t, _ in schedule]
    weights = [float(w) for _, w in schedule]
    if len(times) < 2 or times[0] != 0.0 or times[-1] != 1.0 or times != sorted(set(times)):
        raise ArgumentError("a schedule needs rising times from 0 to 1")
    if min(weights) < 0 or max(weights) <= 0:
        raise ArgumentError("weights are at least 0, and one is above")
    sums = [0.0]
    for i in range(len(times) - 1):
        sums.append(sums[-1] + (times[i + 1] - times[i]) * (weights[i] + weights[i + 1]) / 2)
    return [(times[i], weights[i] / sums[-1], (weights[i + 1] - weights[i]) / (times[i + 1] - times[i]) / sums[-1],
             sums[i] / sums[-1]) for i in range(len(times) - 1)]


def _knots(schedule: Schedule) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("time", "weight", "slope", "before"), knot, strict=True)])
                     for knot in knot_rows(schedule)])


def training_time(share: Column, knots: Column) -> Column:
    """The time until which the schedule demands this share (0 to 1) of its words."""
    def within(knot: Column) -> Column:
        rest = share - knot["before"]
        # weight * x + slope / 2 * x^2 = rest; this form also holds for a slope of 0
        root = F.sqrt(F.greatest(knot["weight"] * knot["weight"] + 2 * knot["slope"] * rest, F.lit(0.0)))
        return F.when(rest <= 0, knot["time"]).otherwise(knot["time"] + 2 * rest / (knot["weight"] + root))

    passed = F.filter(knots, lambda k: (k["before"] <= share) | (k["before"] == 0))
    return F.least(within(F.element_at(passed, -1)), F.lit(1.0))


def curriculum_plan(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    source: str = "source",
    columns: Sequence[Column] | None = None,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    schedules: Mapping[str, Schedule] | None = None,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """One row per document: `row` (struct of `columns`, or of all), size, source_size, target, positions, taken.

    `positions`: the training times (0 to 1) at which the document is read, none to `max_epochs`; `taken`: its
    words times their number. `schedules` by source name; others take turns at DEFAULT_SCHEDULES.

    The running sum within a source is taken in two steps, so that no source is summed in one task: sums of
    buckets of the hash order, then the order within a bucket.

    Nulls: a null text has 0 words, a null source is a source of its own, a null id is an id like others. Texts
    of 0 words take no words wherever they lie. Rows with equal ids, sources and texts are equal, in whatever
    order they lie. A single text that is most of its source is taken whole or not, which misses the target by
    at most half of it. An empty table gives an empty result.
    """
    kept = F.struct(*(columns if columns is not None else [F.col(f"`{c}`") for c in docs.columns]))
    name = F.col(source)
    order = F.md5(F.concat_ws(" ", F.coalesce(F.col(row_id).cast("string"), F.lit("-")), F.coalesce(name, F.lit("-")),
                              F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(
        kept.alias("row"), name.alias("source"), count_blank_words(F.col(text)).alias("size"), order.alias("_order"),
        F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), name)).alias("source_key"),
    ).withColumn("_bucket", F.left("_order", F.lit(BUCKET_DIGITS)))
    buckets = materialize(
        rows.groupBy("source_key", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("_sum")), "mix-buckets")
    sums = buckets.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size"))
    targets = source_targets(sums, weights, max_epochs)
    turns = F.array(*[_knots(s) for s in DEFAULT_SCHEDULES])
    knots = F.element_at(turns, F.col("place") % len(DEFAULT_SCHEDULES) + 1)
    for key, schedule in (schedules or {}).items():
        knots = F.when(F.col("source") == key, _knots(schedule)).otherwise(knots)
    earlier = Window.partitionBy("source_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        buckets.select("source_key", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
        .join(targets.select("source_key", "source_size", "target", knots.alias("_knots")), "source_key")
    )
    here = Window.partitionBy("source_key", "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_start") + F.sum("size").over(here) - F.col("size") / 2
    reads = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: F.col("_middle") + e * F.col("source_size")),
        lambda at: at < F.col("target"))
    return (
        rows.drop("source").join(starts, ["source_key", "_bucket"])
        .withColumn("_middle", middle)
        .withColumn("positions", F.transform(reads, lambda at: training_time(at / F.col("target"), F.col("_knots"))))
        .select("row", "size", "source_size", "target", "positions",
                (F.col("size") * F.size("positions")).alias("taken"))
    )


def curriculum_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order, once per reading; their columns as they were."""
    plan = curriculum_plan(docs, **options)
    return plan.select("row", F.explode("positions").alias("position")).orderBy("position").select("row.*")


def in_training_order(plan: DataFrame) -> DataFrame:
    """The rows of a plan, range-sorted by the first position; documents that are not read come last."""
    return plan.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), F.col("row"))


def position_text(positions: Column) -> Column:
    """Positions in billionths, comma-joined."""
    return F.array_join(F.transform(positions, lambda p: F.floor(p * 1e9 + 0.5).cast("string")), ",")


def _position_sql(share: str) -> str:
    """The billionths of `training_time` in SQL, by the turn of the source."""
    def within(knot: tuple[float, float, float, float]) -> str:
        time, weight, slope, before = (f"{v!r}::DOUBLE" for v in knot)
        rest = f"({share} - {before})"
        root = f"sqrt(greatest({weight} * {weight} + 2 * {slope} * {rest}, 0))"
        return f"CASE WHEN {rest} <= 0 THEN {time} ELSE {time} + 2 * {rest} / ({weight} + {root}) END"

    def turn(schedule: Schedule) -> str:
        knots = knot_rows(schedule)
        later = " ".join(f"WHEN {share} >= {k[3]!r}::DOUBLE THEN {within(k)}" for k in reversed(knots[1:]))
        return f"CASE {later} ELSE {within(knots[0])} END" if later else within(knots[0])

    turns = " ".join(f"WHEN {i} THEN {turn(s)}" for i, s in enumerate(DEFAULT_SCHEDULES))
    return f"floor(least(CASE place % {len(DEFAULT_SCHEDULES)} {turns} END, 1) * 1e9 + 0.5)::BIGINT"


#: DuckDB: targets by the same level, the running sum of each source in one window, positions from the same integral.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws(' ', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(source, '-'), md5(coalesce(text, '')))) AS o
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1.0::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS everything FROM s),
l AS (
  SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min_by(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT w.source, place, source_size, least(cap, f.level * w) AS target FROM w, f),
m AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE AS middle
  FROM d)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  size * ((middle < target)::BIGINT + (middle + source_size < target)::BIGINT + (middle + 2 * source_size < target)::BIGINT) AS taken,
  concat_ws(',', %s) AS positions
FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source
""".replace("%s", ", ".join(
    f"CASE WHEN middle + {e} * source_size < target THEN {_position_sql(f'((middle + {e} * source_size) / target)')} END" for e in range(MAX_EPOCHS)))
