"""Secrets in texts, and weak candidates that only count together.

Strong parts (assignments, access keys, long hex strings) are reported wherever they occur. Weak parts (user names,
mixed tokens, endpoints) are reported only if complementary parts lie in their scope: an identifier needs a secret,
a secret an identifier, an endpoint both. Linked parts of all sorts come out as groups, one per credential. Which do is found by an interval join: parts are put into bins as wide as
the scope, each bin keeps the first and the last part of a role, and a candidate meets its own and the two
neighbouring bins. That is exact, and no pair of parts is ever listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.words import let
from wattframe.session import materialize

#: A weak part and its complement start at most this many characters apart.
SCOPE = 300
#: Elements of an array that are summed one after the other.
SUM_BLOCK = 64

# The patterns of the strong kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
# a shorter run cannot hold a longer match, so the least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

IDENTIFIER = r"""(?i:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
TOKEN = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?=[a-z+/_-]*[A-Z0-9])(?=[A-Z0-9+/_-]*[a-z])"
         r"(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]++")
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?(?![0-9.])"

STRONG = ("assign", "access", "hex")
#: kind: (pattern, role)
WEAK = {"identifier": (IDENTIFIER, "who"), "token": (TOKEN, "what"), "endpoint": (ENDPOINT, "where")}
KINDS = (*STRONG, *WEAK)
ROLES = {"assign": "what", "access": "who", "hex": "what"} | {k: role for k, (_, role) in WEAK.items()}
_SPANS = "array<struct<start: int, rank: int, end: int, kind: string, text: string>>"


def running_sums(lengths: Column, levels: int = 2) -> Column:
    """The sum up to each element, itself included, in a time that grows with the array and not with its square.

    Appending to an array copies it, so elements are summed in blocks, the sums of blocks likewise, and only the sums
    of the highest level (an element each 4,096 here) are appended one by one to one array.
    """
    def appended(values: Column) -> Column:
        return F.reduce(values, F.array().cast("array<int>"),
                        lambda sums, x: F.concat(sums, F.array(F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + x)))

    def total(values: Column) -> Column:
        return F.reduce(values, F.lit(0), lambda sum_, x: sum_ + x)

    def blocks_of(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / SUM_BLOCK).cast("int")),
                           lambda i: F.slice(values, i * SUM_BLOCK + 1, SUM_BLOCK))

    def shifted(blocks: Column) -> Column:
        return let(running_sums(F.transform(blocks, total), levels - 1), lambda ends: F.flatten(F.transform(
            blocks, lambda block, i: let(F.coalesce(F.get(ends, i - 1), F.lit(0)),
                                         lambda before: F.transform(appended(block), lambda x: x + before)))))

    if levels == 0:
        return appended(lengths)
    return F.when(F.size(lengths) > SUM_BLOCK, let(blocks_of(lengths), shifted)).otherwise(appended(lengths))


def spans_of(text: Column, kind: str, pattern: str) -> Column:
    """The non-overlapping matches as spans in code points; positions from the pieces between the matches."""
    def placed(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found,
                             lambda gap, match: F.length(gap) + F.length(match))
        return let(lengths, lambda both: F.zip_with(running_sums(both), found, lambda end, match: F.struct(
            (end - F.length(match)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
            F.lit(kind).alias("kind"), match.alias("text"))))

    nothing = F.array().cast(_SPANS)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(matches, placed).cast(_SPANS)).otherwise(nothing)


def find_secrets(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, strong, weak, groups): the strong spans, the weak ones that are linked, and the credentials that the
    linked spans of both sorts form; one row per document.

    A span is (start, rank, end, kind, text) in code points, end exclusive, in order of start and kind. Weak spans
    that overlap a strong one are left out. A group holds the linked spans that follow each other with starts at most
    `SCOPE` apart; groups come in order of place. An endpoint whose identifier and secret lie on its two sides, too
    far from each other to be linked themselves, is a group of its own. A null or empty text has no spans; a null id
    is an id like others; equal rows have equal spans, each its own row. Whole texts are read. An empty table gives
    an empty result.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    assign = F.filter(spans_of(F.col("_text"), "assign", ASSIGN),
                      lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_VALUE)
    strong = F.concat(assign, spans_of(F.col("_text"), "access", ACCESS), spans_of(F.col("_text"), "hex", HEX))
    weak = F.concat(*[spans_of(F.col("_text"), kind, pattern) for kind, (pattern, _) in WEAK.items()])
    found = docs.select(F.col(row_id).alias("doc_id"), body.alias("_text")).select(
        "doc_id", F.xxhash64("_text").alias("digest"), F.array_sort(strong).alias("strong"), weak.alias("weak"))
    # written with the spans as they are: what follows reads it several times, and never the texts again
    found = materialize(found, "secret-parts")
    linked = _linked(found).withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    groups = F.coalesce("groups", F.array().cast(f"array<{_SPANS}>"))
    return found.drop("weak").join(linked, same, "left").select(
        "doc_id", "strong", F.array_sort(F.filter(F.flatten(groups), lambda s: s["rank"] >= len(STRONG))).alias("weak"),
        groups.alias("groups"))


def _linked(found: DataFrame) -> DataFrame:
    """(doc_id, digest, groups): the spans with complementary parts in scope, as groups of neighbours.

    What is collected, or met in a window, is of one text, and was one row of `found` before.
    """
    key = ["doc_id", "digest"]
    mapping = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    both = F.concat("strong", "weak")
    # a link takes an identifier and a secret; texts without either have none
    candidates = found.where(F.exists(both, lambda s: mapping[s["kind"]] == "who")
                             & F.exists(both, lambda s: mapping[s["kind"]] == "what")).dropDuplicates(key)
    parts = candidates.select(*key, F.explode(both).alias("part")).select(
        *key, "part", mapping[F.col("part.kind")].alias("role"), F.floor(F.col("part.start") / SCOPE).alias("bin"))
    # a weak part goes if a strong one that starts before its end ends after its start
    is_weak = F.col("part.rank") >= len(STRONG)
    before = Window.partitionBy(*key).orderBy(F.when(is_weak, F.col("part.end")).otherwise(F.col("part.start")), (~is_weak).cast("int"))
    covered = F.max(F.when(~is_weak, F.col("part.end"))).over(before.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("covered", covered).where(
        ~is_weak | F.col("covered").isNull() | (F.col("covered") <= F.col("part.start"))).drop("covered")
    bins = parts.groupBy(*key, "role", "bin").agg(
        F.min("part.start").alias("first"), F.max("part.start").alias("last"))
    bins = bins.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("role").alias("_role"),
                       F.col("bin").alias("_bin"), "first", "last")
    near = parts.withColumn("near", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    start = F.col("part.start")
    in_scope = (
        F.when(F.col("near") < F.col("bin"), start - F.col("last") <= SCOPE)
        .when(F.col("near") > F.col("bin"), F.col("first") - start <= SCOPE).otherwise(True)
    )
    met = near.join(bins, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
                    & (F.col("near") == F.col("_bin")) & (F.col("role") != F.col("_role")) & in_scope)
    roles = met.groupBy(*key, "part", "role").agg(
        F.bool_or(F.col("_role") == "who").alias("who"), F.bool_or(F.col("_role") == "what").alias("what"))
    complete = F.when(F.col("role") == "who", F.col("what")).when(F.col("role") == "what", F.col("who")).otherwise(
        F.col("who") & F.col("what"))
    in_order = Window.partitionBy(*key).orderBy("part.start", "part.rank")
    opens = F.coalesce((start - F.lag("part.start").over(in_order) > SCOPE).cast("int"), F.lit(0))
    numbered = roles.where(complete).withColumn("opens", opens).withColumn("group", F.sum("opens").over(in_order))
    groups = numbered.groupBy(*key, "group").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    ordered = F.array_sort(F.collect_list(F.struct("group", "parts")))
    return groups.groupBy(*key).agg(F.transform(ordered, lambda g: g["parts"]).alias("groups"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
