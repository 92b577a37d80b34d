"""Benchmark decontamination: word windows of the test items are looked for in the documents.

The windows of the items are hashed and broadcast. Each document's windows of the same lengths are hashed in one
scan and joined with that set. Whatever meets a hash is verified word by word, from a second look at the few
documents concerned. Hit words can then be removed as spans, or their documents as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.sizes import broadcast_if_small
from wattframe.llm.words import let, letter_words
from wattframe.session import materialize

WIDTH = 13
_KEY = ["_id", "_digest"]


@dataclass(frozen=True)
class Found:
    """`base`: _id, _digest, n_words, copies (equal rows) of every document. `hits`: _id, _digest, at, n: the
    verified occurrences, n words from word `at`, with the `window` text. `windows`: window, item_id."""

    base: DataFrame
    hits: DataFrame
    windows: DataFrame


def _window_hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.slice(words, at + 1, n))


def _starts(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """(window, n, hash, item_id): all windows of `width` words; a shorter item is one window, an empty one none."""
    words = items.select(F.col(item_id).alias("item_id"), letter_words(F.col(text)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(width))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - n))
    return (
        words.select("item_id", "words", n.alias("n"), starts.alias("at"))
        .select("item_id", "n", F.slice("words", F.col("at") + 1, F.col("n")).alias("w"))
        .select("item_id", "n", F.array_join("w", " ").alias("window"),
                F.xxhash64(F.transform("w", lambda w: F.xxhash64(w))).alias("hash"))
        .distinct()
    )


def _keyed(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    return docs.select(F.col(row_id).alias("_id"), F.xxhash64(F.col(text).isNull(), F.col(text)).alias("_digest"),
                       letter_words(F.col(text)).alias("words"))


def _join_documents(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """By id (null equals null) and digest; the columns of both sides, the key once."""
    right = right.withColumnsRenamed({"_id": "_right_id", "_digest": "_right_digest"})
    same = F.col("_id").eqNullSafe(F.col("_right_id")) & (F.col("_digest") == F.col("_right_digest"))
    return left.join(right, same, how).drop("_right_id", "_right_digest")


def find_windows(
    docs: DataFrame, items: DataFrame, text: str = "text", row_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id", width: int = WIDTH,
) -> Found:
    """Every verified occurrence of an item window in the documents.

    Documents are told apart by id and a hash of the text; equal rows are looked at as one. A null id is an id
    like others; a null or empty text has no words. A window of an item without id counts as a hit but is listed
    for no item. Empty tables give no hits. Whole texts are read; a document is one row, so its words must fit a
    task's memory.
    """
    windows = materialize(item_windows(items, item_text, item_id, width), "item-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `width` numbers
    hashes = broadcast_if_small(windows.select("hash").distinct())

    place = "array<struct<at: int, n: int, hash: bigint>>"
    whole = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("hash")))

    def windows_of(h: Column, n: int) -> Column:
        return F.transform(_starts(h, n), lambda at: F.struct(
            at.alias("at"), F.lit(n).alias("n"), _window_hash(h, at, n).alias("hash"))).cast(place)

    def places(h: Column) -> Column:
        found = F.concat(whole.cast(place), *[windows_of(h, n) for n in lengths])
        return F.struct(F.size(h).alias("n_words"), found.alias("places"))

    # one row per window, and one with `at` -1 for the document itself
    hashes_of_words = F.transform(F.col("words"), lambda w: F.xxhash64(w))
    placed = (
        _keyed(docs, text, row_id).select("_id", "_digest", let(hashes_of_words, places).alias("found"))
        .select("_id", "_digest", "found.n_words", F.inline("found.places"))
    )
    met = (
        placed.join(hashes.withColumn("met", F.lit(True)), "hash", "left")
        .where((F.col("at") < 0) | F.col("met")).select("_id", "_digest", "n_words", "at", "n")
    )
    met = materialize(met, "window-hits")
    base = met.where(F.col("at") < 0).groupBy("_id", "_digest", "n_words").agg(F.count("*").alias("copies"))

    candidates = met.where(F.col("at") >= 0).groupBy(*_KEY).agg(F.collect_set(F.struct("at", "n")).alias("places"))
    candidates = broadcast_if_small(materialize(candidates, "window-candidates"), 100_000)
    cut = _join_documents(_keyed(docs, text, row_id), candidates, "inner").select(
        *_KEY,
        F.inline(F.transform("places", lambda p: F.struct(
            p["at"].alias("at"), p["n"].alias("n"),
            F.array_join(F.slice("words", p["at"] + 1, p["n"]), " ").alias("window")))))
    known = broadcast_if_small(windows.select("window", "n").distinct())
    hits = materialize(cut.join(known, ["window", "n"]).distinct(), "verified-hits")
    return Found(base, hits, windows.select("window", "item_id").distinct())


def contamination(found: Found) -> DataFrame:
    """Per document: _id, _digest, n_words, copies, n_hit, n_items, items (sorted text ids), contaminated.

    n_hit: words inside any occurrence. Contaminated: at least one hit, and a twentieth of the words or more.
    """
    in_order = Window.partitionBy(*_KEY).orderBy("at", "n")
    end = F.col("at") + F.col("n")
    before = F.coalesce(F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cover = (
        found.hits.select(*_KEY, "at", "n", F.greatest(end - F.greatest(before, F.col("at")), F.lit(0)).alias("new"))
        .groupBy(*_KEY).agg(F.sum("new").alias("n_hit"))
    )
    items = (
        found.hits.select(*_KEY, "window").distinct()
        .join(found.windows.where(F.col("item_id").isNotNull()), "window")
        .select(*_KEY, F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy(*_KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0))
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return (
        _join_documents(_join_documents(found.base, cover, "left"), items, "left")
        .select(*_KEY, F.col("n_words").cast("bigint").alias("n_words"), "copies", n_hit.alias("n_hit"),
                F.size(listed).cast("bigint").alias("n_items"), listed.alias("items"),
                ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The documents without the contaminated ones, all columns as they were."""
    bad = contamination(find_windows(docs, items, text, row_id)).where("contaminated").select(*_KEY)
    bad = broadcast_if_small(materialize(bad, "contaminated"))
    digest = F.xxhash64(F.col(text).isNull(), F.col(text))
    rows = docs.select(F.struct("*").alias("_row"), F.col(row_id).alias("_id"), digest.alias("_digest"))
    return _join_documents(rows, bad, "left_anti").select("_row.*")


def remove_hit_spans(docs: DataFrame, items: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The documents with every hit word and the separators behind it cut out of the text; other texts unchanged."""
    found = find_windows(docs, items, text, row_id)
    hit = found.hits.groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_list(
        F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))).alias("_hit"))
    hit = broadcast_if_small(materialize(hit, "hit-words"), 100_000)
    body = F.col(text)
    rows = docs.select(F.struct("*").alias("_row"), F.col(row_id).alias("_id"), body.alias("_text"),
                       F.xxhash64(body.isNull(), body).alias("_digest"))
    # a word together with the separators behind it; what precedes the first word stays
    words = F.regexp_extract_all(F.col("_text"), F.lit(r"([A-Za-z0-9\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(1))
    lead = F.regexp_extract(F.col("_text"), r"^([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)", 1)
    left = F.concat(lead, F.array_join(F.filter(words, lambda _, i: ~F.array_contains("_hit", i)), ""))
    fields = [F.when(F.col("_hit").isNull(), F.col("_row")[c]).otherwise(left).alias(c) if c == text else F.col("_row")[c].alias(c)
              for c in docs.columns]
    return _join_documents(rows, hit, "left").select(*fields)


#: DuckDB: n_words, hits and items of every document.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
b1 AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(len(w) - least(len(w), 13) + 1)) AS pos FROM b WHERE len(w) > 0),
iw AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[pos + 1 : pos + n], ' ') AS win FROM b1),
lens AS (SELECT DISTINCT n FROM iw),
d1 AS (SELECT k, w, n, unnest(range(len(w) - n + 1)) AS pos FROM d, lens WHERE len(w) >= n),
hits AS MATERIALIZED (
  SELECT k, pos, n, win FROM (SELECT k, pos, n, array_to_string(w[pos + 1 : pos + n], ' ') AS win FROM d1)
  WHERE (n, win) IN (SELECT n, win FROM iw)),
covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY k),
found AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM hits JOIN iw USING (n, win) WHERE item_id IS NOT NULL)
  GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN found USING (k)
"""
