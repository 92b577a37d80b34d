"""Turning categories into numbers and putting numbers on one scale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.operators.lookups import is_small, look_up, numbered
from wattframe.roles import METERED, Roles
from wattframe.session import materialize

#: A message names this many categories of a column; of more it names the first and says how many there are.
LISTED = 1000


def domain_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null (column, value) pairs, from one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


@dataclass(frozen=True)
class Domains:
    """The known categories of some columns as a stored table (column, value) of any size."""

    rows: DataFrame
    #: Per column its categories as a message lists them, in order.
    listed: Mapping[str, str]
    counts: Mapping[str, int]
    small: bool

    def known(self, column: str, value: str, flag: str) -> DataFrame:
        """The categories of a column as `value`, each with a true `flag`."""
        return self.rows.where(F.col("column") == column).select(F.col("value").alias(value), F.lit(True).alias(flag))


def _listed(values: DataFrame, count: int) -> str:
    first = [row["value"] for row in values.orderBy("value").limit(LISTED).collect()]
    return ", ".join(first) + (f" and {count - LISTED} more" if count > LISTED else "")


def stored_domains(rows: DataFrame, columns: Sequence[str]) -> Domains:
    """Domains from distinct (column, value) rows. What reaches the driver is the text of messages."""
    rows = materialize(rows.select("column", F.col("value").cast("string").alias("value")), "domains")
    counts = {row["column"]: row["n"] for row in rows.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    listed = {c: _listed(rows.where(F.col("column") == c), counts.get(c, 0)) for c in columns}
    return Domains(rows, listed, {c: counts.get(c, 0) for c in columns}, is_small(rows))


def category_domains(df: DataFrame, columns: Sequence[str]) -> Domains:
    """The categories that occur, from one pass."""
    return stored_domains(domain_rows(df, columns), columns)


def class_labels(df: DataFrame, label: str) -> list[str]:
    """The labels that occur, sorted. A classifier holds all of them itself, so they are few enough to be collected."""
    return [row[label] for row in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def ordinal_code(label: Column, order: Sequence[str]) -> Column:
    """0, 1, 2 … by position in `order`; null for any other label."""
    position = F.array_position(F.array(*[F.lit(c) for c in order]), label)
    return F.when(position > 0, (position - 1).cast("int"))


def one_hot_stages(columns: Sequence[str]) -> list:
    """A category unseen in fitting gets the dropped last slot: all zeros."""
    indexer = StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_index" for c in columns],
        handleInvalid="keep", stringOrderType="alphabetAsc",
    )
    encoder = OneHotEncoder(
        inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_slots" for c in columns], dropLast=True)
    return [indexer, encoder]


def feature_stages(numeric: Sequence[str], categorical: Sequence[str], roles: Roles = METERED) -> list:
    """Numbers as they are, then one slot per category."""
    roles.check_features([*numeric, *categorical])
    assembler = VectorAssembler(inputCols=[*numeric, *[f"{c}_slots" for c in categorical]], outputCol="features")
    return [*one_hot_stages(categorical), assembler]


@dataclass(frozen=True)
class SlotTable:
    """Categories of a column and their slots, as a stored table (value, slot)."""

    column: str
    rows: DataFrame
    size: int
    small: bool

    def encode(self, df: DataFrame) -> DataFrame:
        """Adds `<column>_slots`, a sparse 0/1 vector; all zeros for null and for a category not in the table."""
        value, slot, index = f"_value_{self.column}", f"_slot_{self.column}", f"{self.column}_index"
        table = self.rows.select(F.col("value").alias(value), F.col("slot").alias(slot))
        salt = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        found = look_up(df, table, F.col(f"`{self.column}`"), value, salt, self.small)
        # the number of slots travels as metadata, so that fitting the encoder reads no rows
        attribute = {"ml_attr": {"type": "nominal", "num_vals": self.size + 1, "name": index}}
        place = F.coalesce(F.col(slot), F.lit(self.size)).cast("double").alias(index, metadata=attribute)
        indexed = found.select(*[F.col(f"`{c}`") for c in df.columns], place)
        encoder = OneHotEncoder(inputCols=[index], outputCols=[f"{self.column}_slots"], dropLast=True)
        return encoder.fit(indexed).transform(indexed).drop(index)


def slot_table(df: DataFrame, column: str) -> SlotTable:
    """Slots 0, 1, 2 .. of the sorted categories; any number of them, none is held by the driver."""
    rows = numbered(df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()), "value", "slot")
    return SlotTable(column, rows, rows.count(), is_small(rows))


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds `<column>_slots`, one 0/1 vector per column."""
    for c in columns:
        df = slot_table(df, c).encode(df)
    return df


@dataclass(frozen=True)
class Scaler:
    """Fitted means and population deviations; a constant column scales to 0."""

    means: Mapping[str, float]
    deviations: Mapping[str, float]

    def expressions(self) -> dict[str, Column]:
        return {
            c: (F.col(c).cast("double") - F.lit(m)) / F.lit(self.deviations[c])
            if self.deviations[c] else F.col(c).cast("double") * F.lit(0.0)
            for c, m in self.means.items()
        }

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.withColumns({f"{prefix}{c}": z for c, z in self.expressions().items()})


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    aggregates = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*aggregates).first()
    return Scaler({c: row[f"{c}_m"] or 0.0 for c in columns}, {c: row[f"{c}_s"] or 0.0 for c in columns})
