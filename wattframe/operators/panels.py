"""Many grouped aggregates from one scan.

All series of a dashboard share one `GROUPING SETS` aggregation over a few bundles of keys: rows are expanded once
per bundle in memory and combined before the shuffle, which carries one row per cell and task. Keys with small,
fixed domains (month, hour, label, percent bin) share a bundle, so that there are fewer copies of each row than
series; a key whose domain grows with the data (an entity) is a bundle of its own. Everything after that works
on cells: they are summed per key, become long rows `(panel, sort_key, label, value)`, and a last small
aggregation picks the extremes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.labels import plain_label
from wattframe.functions.numbers import half_up
from wattframe.operators.encoding import ordinal_code


@dataclass(frozen=True)
class Series:
    """One value per group of `key`. Sorted by the key, by falling value, or by a fixed list of keys."""

    panel: str
    key: str
    value: str
    label: Callable[[Column], Column] = plain_label
    falling: bool = False
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Kpi:
    """One aggregate over all rows."""

    name: str
    value: str


@dataclass(frozen=True)
class Extreme:
    """The group of `key` with the largest (or smallest) value; the first by key on ties."""

    panel: str
    key: str
    value: str
    label: Callable[[Column], Column] = plain_label
    largest: bool = True


@dataclass(frozen=True)
class GroupCount:
    """The number of distinct non-null keys."""

    name: str
    key: str


Spec = Series | Kpi | Extreme | GroupCount


def _entry(panel: str | Column, sort_key: Column, label: Column, value: Column, filled: int = 0,
           rank: Column | None = None, name: Column | None = None, add: Column | None = None) -> Column:
    """`pick` is the smallest of its group: a filled row before a default, then by rank, then by name."""
    pick = F.struct(
        F.lit(filled).alias("is_default"), (F.lit(0.0) if rank is None else rank).alias("rank"),
        (F.lit(None).cast("string") if name is None else name).alias("name"),
        value.cast("double").alias("value"),
    )
    return F.struct(
        (F.lit(panel) if isinstance(panel, str) else panel).alias("panel"),
        sort_key.cast("double").alias("sort_key"), label.cast("string").alias("label"),
        pick.alias("pick"), (F.lit(None) if add is None else add).cast("bigint").alias("add"),
    )


def _of_group(spec: Series | Extreme | GroupCount, position: int) -> Column:
    key = F.col(spec.key)
    if isinstance(spec, GroupCount):
        return _entry("kpi", F.lit(position), F.lit(spec.name), F.lit(0.0), add=F.when(key.isNull(), 0).otherwise(1))
    value = F.coalesce(F.col(spec.value), F.lit(0.0))
    if isinstance(spec, Extreme):
        rank = -value if spec.largest else value
        return _entry(spec.panel, F.lit(0.0), F.lit(None), value, rank=rank, name=spec.label(key))
    if spec.falling:
        sort_key = -value
    elif spec.order:
        sort_key = ordinal_code(key, spec.order) + 1
    else:
        sort_key = key
    panel = F.when(sort_key.isNotNull(), F.lit(spec.panel)) if spec.order else F.lit(spec.panel)
    return _entry(panel, sort_key, spec.label(key), half_up(value.cast("double"), 2))


@dataclass(frozen=True)
class Measure:
    """Sum or average of a column, or the number of rows."""

    kind: str
    column: str = ""

    def of_cells(self) -> Column:
        if self.kind == "count":
            return F.col("_n")
        total = F.col(f"_sum_{self.column}")
        return total if self.kind == "sum" else F.try_divide(total, F.col(f"_n_{self.column}"))


def _cells(df: DataFrame, bundles: Sequence[Sequence[str]], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums and counts per cell of each bundle; `_bundle` tells which one."""
    parts = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        parts += [F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_n_{c}")]
    cells = df.groupingSets([list(b) for b in bundles], *keys).agg(F.grouping_id().alias("_gid"), *parts)
    bundle = F.lit(None).cast("int")
    for i, members in enumerate(bundles):
        gid = sum(1 << (len(keys) - 1 - j) for j, key in enumerate(keys) if key not in members)
        bundle = F.when(F.col("_gid") == gid, F.lit(i)).otherwise(bundle)
    return cells.withColumn("_bundle", bundle)


def _per_key(cells: DataFrame, bundles: Sequence[Sequence[str]], keys: Sequence[str],
             columns: Sequence[str]) -> DataFrame:
    """Cells summed up per value of each single key (`_key` names it), and over all rows (`_key` is '')."""
    types = {f.name: f.dataType for f in cells.schema}

    def only(name: str) -> Column:
        values = [(F.col(k) if k == name else F.lit(None).cast(types[k])).alias(k) for k in keys]
        return F.struct(F.lit(name).alias("_key"), *values)

    wanted = F.when(F.col("_bundle") == 0, F.array(only(""), *[only(k) for k in bundles[0]]))
    for i, members in enumerate(bundles[1:], start=1):
        wanted = wanted.when(F.col("_bundle") == i, F.array(*[only(k) for k in members]))
    sums = ["_n", *[f"_{kind}_{c}" for c in columns for kind in ("sum", "n")]]
    return (
        cells.select(F.explode(wanted).alias("_k"), *sums).select("_k.*", *sums)
        .groupBy("_key", *keys).agg(*[F.sum(x).alias(x) for x in sums])
    )


def panel_bundle(df: DataFrame, bundles: Sequence[Sequence[str]], measures: dict[str, Measure],
                 specs: Sequence[Spec]) -> DataFrame:
    """Every spec reads one key of one bundle (or all rows) and one measure."""
    spark = df.sparkSession
    keys = [k for b in bundles for k in b]
    columns = list(dict.fromkeys(m.column for m in measures.values() if m.column))
    groups = _per_key(_cells(df, bundles, keys, columns), bundles, keys, columns)
    groups = groups.select("_key", *keys, *[m.of_cells().alias(n) for n, m in measures.items()])
    grand = [
        _entry("kpi", F.lit(i), F.lit(s.name), F.coalesce(F.col(s.value).cast("double"), F.lit(0.0)))
        for i, s in enumerate(specs) if isinstance(s, Kpi)
    ]
    choices = F.when(F.col("_key") == "", F.array(*grand))
    for key in keys:
        rows = [_of_group(s, p) for p, s in enumerate(specs) if not isinstance(s, Kpi) and s.key == key]
        choices = choices.when(F.col("_key") == key, F.array(*rows))
    # without any input row there is no group either: KPIs then come from these defaults
    defaults = []
    for i, s in enumerate(specs):
        if isinstance(s, Kpi):
            defaults.append(_entry("kpi", F.lit(i), F.lit(s.name), F.lit(0.0), filled=1))
        elif isinstance(s, GroupCount):
            defaults.append(_entry("kpi", F.lit(i), F.lit(s.name), F.lit(0.0), filled=1, add=F.lit(0)))
        elif isinstance(s, Extreme):
            defaults.append(_entry(s.panel, F.lit(0.0), F.lit(None), F.lit(0.0), filled=1, name=F.lit("-")))
    # a key outside a fixed order has no panel
    rows = groups.select(F.inline(choices)).where(F.col("panel").isNotNull())
    if defaults:
        rows = rows.unionAll(spark.range(1).select(F.inline(F.array(*defaults))))
    return (
        rows.groupBy("panel", "sort_key", "label").agg(F.min("pick").alias("pick"), F.sum("add").alias("add"))
        .select(
            "panel", "sort_key", F.coalesce("pick.name", "label").alias("label"),
            F.coalesce(F.col("add").cast("double"), F.col("pick.value")).alias("value"),
        )
    )
