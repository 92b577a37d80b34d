"""Association rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.functions.labels import item_text
from wattframe.functions.numbers import half_up
from wattframe.operators import itemsets as I
from wattframe.plans.rules import mine_rules
from workload.readings import READINGS, duckdb_cte, readings
from workload.registry import half_up_sql as hu
from workload.registry import query

_ITEMS = """
, items AS MATERIALIZED (SELECT reading_id, 'building_type=' || building_type AS a, 'occupancy_level=' || occupancy_level AS b,
 'temperature_level=' || temperature_level AS c, 'energy_category=' || energy_category AS d,
 CASE is_weekend WHEN 1 THEN 'day_type=Weekend' ELSE 'day_type=Weekday' END AS e FROM readings)"""
_SETS = """
, tot AS (SELECT count(*) AS t FROM items),
iset AS MATERIALIZED (SELECT grouping_id(a, b, c, d, e) AS gid, a, b, c, d, e, count(*) AS n FROM items GROUP BY CUBE (a, b, c, d, e)),
frequent AS MATERIALIZED (SELECT iset.*, t, array_to_string(list_sort(list_filter([a, b, c, d, e], lambda x: x IS NOT NULL)), ', ') AS txt
 FROM iset, tot WHERE gid <> 31 AND n / t >= CAST(0.1 AS DOUBLE)),
halves AS MATERIALIZED (SELECT f.gid AS whole, p.range AS part FROM (SELECT DISTINCT gid FROM frequent) f, range(0, 31) p
 WHERE (f.gid & p.range) = f.gid AND p.range <> f.gid),
rules AS MATERIALIZED (SELECT p.txt AS antecedent, k.txt AS consequent, f.n / f.t AS support, f.n / p.n AS confidence,
  (f.n / p.n) / (k.n / f.t) AS lift
 FROM frequent f JOIN halves ON whole = f.gid JOIN frequent p ON p.gid = part
  AND (p.a IS NULL OR p.a = f.a) AND (p.b IS NULL OR p.b = f.b) AND (p.c IS NULL OR p.c = f.c)
  AND (p.d IS NULL OR p.d = f.d) AND (p.e IS NULL OR p.e = f.e)
 JOIN frequent k ON k.gid = 31 - (p.gid - f.gid)
  AND (k.a IS NULL OR k.a = f.a) AND (k.b IS NULL OR k.b = f.b) AND (k.c IS NULL OR k.c = f.c)
  AND (k.d IS NULL OR k.d = f.d) AND (k.e IS NULL OR k.e = f.e)
 WHERE f.n / p.n >= CAST(0.6 AS DOUBLE)),
ranked AS (SELECT row_number() OVER (ORDER BY round(lift, 12) DESC, round(confidence, 12) DESC, round(support, 12) DESC,
  antecedent, consequent) AS position, * FROM rules)"""
R = duckdb_cte() + _ITEMS
RS = R + _SETS


@query("transactions", R + """SELECT reading_id, array_to_string(list_sort([a, b, c, d, e]), ', ') AS items FROM items""")
def transactions(spark, sf_dir):
    return I.transactions(readings(spark, sf_dir), READINGS).select("reading_id", item_text("items").alias("items"))


@query("frequent_itemsets", RS + f"SELECT txt AS items, n, {hu('(n / t)', 6)} AS support FROM frequent")
def frequent_itemsets(spark, sf_dir):
    found = I.frequent_itemsets(readings(spark, sf_dir), 0.1, READINGS)
    return found.with_support(6)


@query("frequent_itemsets_baskets", RS + f"SELECT txt AS items, n, {hu('(n / t)', 6)} AS support FROM frequent")
def frequent_itemsets_baskets(spark, sf_dir):
    """The same sets by FP-growth, the way for baskets of any width."""
    baskets = I.transactions(readings(spark, sf_dir), READINGS).select("items")
    return I.basket_itemsets(baskets, 0.1).with_support(6)


@query("association_rules", RS + f"""SELECT antecedent, consequent, {hu('support', 6)} AS support,
 {hu('confidence', 6)} AS confidence, {hu('lift', 6)} AS lift FROM rules""")
def association_rules(spark, sf_dir):
    rules = I.association_rules(I.frequent_itemsets(readings(spark, sf_dir), 0.1, READINGS), 0.6)
    return rules.select(
        item_text("antecedent").alias("antecedent"), item_text("consequent").alias("consequent"),
        *[half_up(F.col(c), 6).alias(c) for c in ("support", "confidence", "lift")])


@query("top_rules", RS + f"""SELECT CAST(position AS INT) AS position, antecedent, consequent, {hu('support', 4)} AS support,
 {hu('confidence', 4)} AS confidence, {hu('lift', 3)} AS lift FROM ranked WHERE position <= 200""")
def top_rules(spark, sf_dir):
    return mine_rules(readings(spark, sf_dir), roles=READINGS)["rules"]


@query("rules_chart", RS + f"""SELECT CAST(position AS INT) AS position, antecedent || ' → ' || consequent AS label, {hu('lift', 3)} AS lift,
 {hu('confidence', 4)} AS confidence FROM ranked WHERE position <= 10""")
def rules_chart(spark, sf_dir):
    return mine_rules(readings(spark, sf_dir), roles=READINGS)["chart"]


@query("rules_summary", RS + """SELECT (SELECT count(*) FROM items) AS transactions,
 (SELECT count(DISTINCT a) + count(DISTINCT b) + count(DISTINCT c) + count(DISTINCT d) + count(DISTINCT e) FROM items) AS items,
 (SELECT count(*) FROM frequent) AS frequent_itemsets, (SELECT count(*) FROM rules) AS total_rules""")
def rules_summary(spark, sf_dir):
    return mine_rules(readings(spark, sf_dir), roles=READINGS)["summary"]
