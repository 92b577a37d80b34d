"""Spelling variants: words one edit apart, found among the sorted rotations of all words.

Every word gets an end mark and is rotated to every place (a permuterm index). A rotation that starts behind the
character at place i and is read up to that character skips it. Two words with an equal rotation of this kind differ
by the skipped character only (a replacement); a word of which it is a whole rotation lacks that character (an
insertion or deletion). So all neighbours of a word lie in runs of the sorted rotations that share a prefix. A run
holds at most one word per character of the alphabet and one shorter word; it is summed up in one scan, and no pairs
are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattframe.llm.words import ascii_lower, let
from wattframe.session import materialize

# What separates runs of letters, and the rule by which single characters are left out.
NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"
LEAVE_OUT_EVERY = 97
#: The end mark; it sorts before all characters. A word that holds it is an error.
END = "\u0000"
MIN_LETTERS = 5
MIN_OCCURRENCES = 3
#: A neighbour becomes a word's form if it occurs this many times as often.
FORM_FACTOR = 2


def _leave_out(run: Column, row_id: Column) -> Column:
    """The run less one code point where the hash of the id and the run says so; a null id changes nothing."""
    def changed(h: Column) -> Column:
        place = F.pmod(h, F.length(run).cast("bigint")).cast("int")
        shorter = F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))
        return F.when(F.pmod(h, F.lit(LEAVE_OUT_EVERY)) == 0, shorter).otherwise(run)

    return let(F.crc32(F.concat(row_id.cast("string"), F.lit(":"), run)), changed)


def count_words(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(word, n): the distinct letter runs of all texts (A-Z in lower case) and how often they occur.

    One code point is left out of about one run in 97, by a hash of row id and run. Null and empty texts have no
    runs; equal rows count each; all other columns are ignored.
    """
    runs = docs.select(F.col(row_id).alias("id"), F.explode(F.split(ascii_lower(F.col(text)), NOT_LETTERS)).alias("run"))
    words = runs.where(F.col("run") != "").select(_leave_out(F.col("run"), F.col("id")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, first_of_run, n): per word and place the rotation without the character at that place, and
    the whole rotations, which skip nothing (null). `first_of_run`: leaving out this character gives another word
    than leaving out any earlier one."""
    word, length = F.col("word"), F.length("word")

    def rotated(start: Column, end: Column) -> Column:
        return F.concat(F.substr(word, start + 1), F.lit(END), F.substr(word, F.lit(1), end))

    def without(i: Column) -> Column:
        char = F.substr(word, i + 1, F.lit(1))
        new = (i == 0) | (F.substr(word, i, F.lit(1)) != char)
        return F.struct(rotated(i + 1, i).alias("key"), char.alias("skipped"), new.alias("first_of_run"))

    def whole(i: Column) -> Column:
        return F.struct(rotated(i, i).alias("key"), F.lit(None).cast("string").alias("skipped"), F.lit(False).alias("first_of_run"))

    places = F.transform(F.sequence(F.lit(0), length - 1), without)
    ends = F.transform(F.sequence(F.lit(0), length), whole)
    return words.select("n", F.inline(F.concat(places, ends)))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): number of near words, and the most frequent one (ties: smallest in code-point
    order), for the words of (word, n) that have any. Words must be distinct, neither null nor empty.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. Rotations are
    shuffled and sorted by the part that is compared; a run of equal parts has a row per character at most.
    """
    marked = F.when(F.contains("word", F.lit(END)), F.raise_error(F.lit("a word holds the end mark"))).otherwise(F.col("word"))
    rotations = _rotations(words.select(marked.alias("word"), "n"))
    in_order = Window.partitionBy("key").orderBy(F.col("skipped").isNull(), F.col("n").desc(), "skipped")
    run = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.struct((-F.col("n")).alias("less"), "skipped")
    is_gap = F.col("skipped").isNotNull()
    scanned = rotations.select(
        "*", F.count("skipped").over(run).alias("gaps"),
        F.count(F.when(F.col("first_of_run"), 1)).over(run).alias("longer"),
        F.nth_value(gap, 1).over(run).alias("top"), F.nth_value(gap, 2).over(run).alias("second"),
        F.first(F.when(F.col("first_of_run"), gap), ignorenulls=True).over(run).alias("top_longer"),
        F.max(F.when(~is_gap, F.col("n"))).over(run).alias("short_n"))
    has_short = F.col("first_of_run") & F.col("short_n").isNotNull()
    n_near = F.when(is_gap, F.col("gaps") - 1 + has_short.cast("int")).otherwise(F.col("longer"))
    found = scanned.select("*", n_near.alias("n_near")).where(F.col("n_near") > 0)
    before, behind = F.substring_index("key", END, -1), F.substring_index("key", END, 1)

    def named(choice: Column) -> Column:
        name = F.concat(before, choice["skipped"], behind)
        return F.when(choice["skipped"].isNotNull(), F.struct(choice["less"].alias("less"), name.alias("name")))

    other = F.when(F.col("top.skipped") != F.col("skipped"), F.col("top")).when(F.col("gaps") > 1, F.col("second"))
    short = F.when(has_short, F.struct((-F.col("short_n")).alias("less"), F.concat(before, behind).alias("name")))
    best = F.when(is_gap, F.least(named(other), short)).otherwise(named(F.col("top_longer")))
    each = found.select(F.concat(before, F.coalesce("skipped", F.lit("")), behind).alias("word"), "n_near", best.alias("best"))
    summed = each.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return summed.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.name").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word reached by following forms. Paths halve in each round."""
    paths = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = paths.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                         F.col("next").isNotNull().alias("moved"))
        longer = materialize(longer, "roots")
        paths = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return paths


def group_variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, n, form, root, n_near, form_n) for each row of (word, n), words being distinct.

    `form` is the most frequent near word if it occurs at least `factor` times as often as the word, else null;
    `root` is reached by following forms and is the word itself if it has none. Frequencies grow along a path, so
    there are no cycles and paths are short. An empty table gives an empty table.
    """
    words = materialize(words.select("word", "n"), "words")
    has_form = F.col("best_n") >= factor * F.col("n")
    joined = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"))
    joined = materialize(joined, "forms")
    roots = _roots(joined.where(F.col("form").isNotNull()))
    return joined.join(roots, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, text: str = "text", row_id: str = "doc_id",
    min_letters: int = MIN_LETTERS, min_occurrences: int = MIN_OCCURRENCES,
) -> DataFrame:
    """`group_variants` of the words of all texts that have enough letters and occur often enough."""
    words = count_words(docs, text, row_id)
    return group_variants(words.where((F.length("word") >= min_letters) & (F.col("n") >= min_occurrences)))


def _oracle() -> str:
    """The same in DuckDB: crc32 from its table, near words by words with one character taken out or masked."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE shifted(b, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, {step} FROM shifted WHERE k < 8),
crc(steps) AS (SELECT list(c ORDER BY b) FROM shifted WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
lowered AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM runs GROUP BY ALL),
bytes AS (SELECT *, list_transform(string_split(hex(encode(concat(doc_id, ':', run))), ''), lambda x: instr('0123456789ABCDEF', x) - 1) AS d
  FROM lowered),
hashed AS (SELECT run, times, CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(
    list_transform(range(1, len(d), 2), lambda i: (16 * d[i] + d[i + 1])::BIGINT),
    lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) END AS h
  FROM bytes, crc),
changed AS (SELECT CASE WHEN h % {LEAVE_OUT_EVERY} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times
  FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM changed GROUP BY word
  HAVING sum(times) >= {MIN_OCCURRENCES} AND length(word) >= {MIN_LETTERS}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gaps AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) AS place,
  count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= {FORM_FACTOR} * w.n THEN r.other END AS form,
  CASE WHEN r.n >= {FORM_FACTOR} * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
path(word, root) AS (SELECT word, word FROM formed
  UNION ALL SELECT p.word, f.form FROM path p JOIN formed f ON f.word = p.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, p.root, f.n_near, f.form_n
FROM formed f JOIN path p ON p.word = f.word JOIN formed t ON t.word = p.root AND t.form IS NULL
"""


ORACLE = _oracle()
