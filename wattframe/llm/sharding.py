"""Shards of near equal bytes by histogram sort.

Rows are ordered by a three-word key: hash of the text, hash of the id, hash of the row. To cut this order into
ranges of equal bytes, the bytes and rows of key cells are counted over all partitions; a cell that holds a wanted
cut is divided into finer cells and counted again, until an edge lies within the tolerance of the cut. Then the
rows are exchanged once, by range. As the counts are exact, they also give the number of rows before each range,
and so gapless slots without another pass.

Equal texts are neighbours in this order. A group of them stays in one shard unless no edge between two texts
is near enough to the cut; then the group is divided by the ids, and rows with equal ids by the row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.errors import ArgumentError
from wattframe.session import materialize

WORD_BITS = 64
LOWEST = -(1 << 63)
FIRST_BITS = 12
MAX_CELLS = 1 << 18
MAX_RANGES = 1 << 14
RANGE_BYTES = 64 << 20
_WORDS = ("_k0", "_k1", "_k2")


@dataclass(frozen=True)
class Cut:
    """A key; rows and bytes below it. Rows at the key lie above it."""

    key: tuple[int, int, int]
    rows: int
    size: int


@dataclass
class _Wanted:
    target: int
    tolerance: float


@dataclass(frozen=True)
class _Cell:
    """All keys whose first `bits` bits are those of `low`; what lies below."""

    low: tuple[int, int, int]
    rows: int
    size: int


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1; a null text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def histogram_shards(
    docs: DataFrame,
    shards: int = 8,
    text: str = "text",
    row_id: str = "doc_id",
    columns: Sequence[Column] | None = None,
    tolerance: float = 0.01,
) -> DataFrame:
    """The rows with `shard` (0 .. shards - 1), `slot` (0, 1, .. within the shard) and `size`.

    `columns`: what to return besides these; without it the whole row. An input column of one of the three names
    is replaced. `tolerance`: share of a shard by which a cut may miss the even one in order to keep equal texts
    together; without such an edge the nearest one counts, which misses by less than one row's size.

    Nulls: a null text has size 1 and the key of its own group; a null id is an id like others. Repeated rows are
    separate rows with slots of their own. An empty table gives an empty result. Fewer rows than shards leave
    shards empty. Long texts only weigh more: a text larger than a shard fills one of its own.
    """
    if shards < 1:
        raise ArgumentError("at least one shard is needed")
    outputs = ("size", "shard", "slot")
    kept = columns if columns is not None else [F.col(f"`{c}`") for c in docs.columns if c.lower() not in outputs]
    keyed = materialize(docs.select(
        F.struct(*kept).alias("_row"), text_size(F.col(text)).alias("_size"),
        F.xxhash64(F.col(text).isNull(), F.col(text)).alias("_k0"),
        F.xxhash64(F.col(row_id).isNull(), F.col(row_id)).alias("_k1"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_k2"),
    ), "shard-keys")
    shard_cuts, range_cuts = find_cuts(keyed, shards, tolerance)
    placed = _place(keyed, shard_cuts, range_cuts)
    return placed.select("_row.*", F.col("_size").alias("size"), "shard", "slot")


def find_cuts(keyed: DataFrame, shards: int, tolerance: float) -> tuple[list[Cut], list[Cut]]:
    """The cuts between shards, and those between the smaller ranges that one task sorts."""
    whole = keyed.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("size")).first()["size"]
    if not whole:
        return [], []
    ranges = min(max(1, ceil(whole / shards / RANGE_BYTES)), max(1, MAX_RANGES // shards))
    tight = [_Wanted(whole * i // shards, tolerance * whole / shards) for i in range(1, shards)]
    parts = shards * ranges
    loose = [_Wanted(whole * i // parts, 0.25 * whole / parts) for i in range(1, parts) if i % ranges]
    found = _refine(keyed, tight + loose)
    return found[: len(tight)], found[len(tight):]


def _refine(keyed: DataFrame, wanted: list[_Wanted]) -> list[Cut]:
    found: list[Cut | None] = [None] * len(wanted)
    open_cells: dict[_Cell, list[int]] = {_Cell((LOWEST,) * 3, 0, 0): list(range(len(wanted)))}
    bits = 0
    while open_cells and wanted:
        more = _next_bits(bits, len(open_cells))
        counted = _count(keyed, list(open_cells), bits, more)
        bits += more
        inner: dict[_Cell, list[int]] = {}
        for (cell, members), rows in zip(open_cells.items(), counted, strict=True):
            ends, low = [], (cell.rows, cell.size)
            for edge, n, size in rows:
                ends.append((edge, low, (low[0] + n, low[1] + size)))
                low = ends[-1][2]
            for i in members:
                _settle(i, wanted[i], ends, bits, found, inner)
        open_cells = inner
    return found  # type: ignore[return-value]


def _settle(i, want, ends, bits, found, inner) -> None:
    """Takes an edge of the cell that holds the target, or leaves that cell open."""
    at = min(bisect_left(ends, want.target, key=lambda e: e[2][1]), len(ends) - 1)
    edge, below, above = ends[at]
    upper = ends[at + 1][0] if at + 1 < len(ends) else _after(edge, bits)
    near_low = abs(want.target - below[1]) <= abs(above[1] - want.target) or upper is None
    miss = abs(want.target - (below if near_low else above)[1])
    if miss <= want.tolerance or above[0] - below[0] <= 1 or bits == 3 * WORD_BITS:
        found[i] = Cut(edge, *below) if near_low else Cut(upper, *above)
    else:
        inner.setdefault(_Cell(edge, *below), []).append(i)


def _after(low: tuple[int, int, int], bits: int) -> tuple[int, int, int] | None:
    """The first key behind the cell; None behind the last one."""
    word, used = divmod(bits - 1, WORD_BITS)
    key = list(low)
    key[word] += 1 << (WORD_BITS - 1 - used)
    while key[word] > -LOWEST - 1:
        if word == 0:
            return None
        key[word] = LOWEST
        word -= 1
        key[word] += 1
    return tuple(key)


def _next_bits(bits: int, cells: int) -> int:
    """So many bits that the counts of all open cells stay below MAX_CELLS, within one word of the key."""
    return min(FIRST_BITS, max(2, int(log2(MAX_CELLS / cells))), WORD_BITS - bits % WORD_BITS)


def _count(keyed: DataFrame, cells: list[_Cell], bits: int, more: int) -> list[list[tuple]]:
    """For each cell the (low key, rows, bytes) of its finer cells, in order."""
    word, used = divmod(bits, WORD_BITS)
    shift = WORD_BITS - used - more
    finer = F.shiftright(F.col(_WORDS[word]), shift) if shift else F.col(_WORDS[word])
    rows = keyed.select(*_WORDS, "_size")
    if bits:
        prefix = [*(F.col(w) for w in _WORDS[:word])]
        values = [[c.low[w] for w in range(word)] for c in cells]
        if used:
            prefix.append(F.shiftright(F.col(_WORDS[word]), WORD_BITS - used))
            values = [v + [c.low[word] >> (WORD_BITS - used)] for v, c in zip(values, cells, strict=True)]
        names = [f"_p{n}" for n in range(len(prefix))]
        # at most one open cell per cut, of which there are less than MAX_RANGES
        side = F.broadcast(keyed.sparkSession.createDataFrame(
            [(i, *v) for i, v in enumerate(values)], ", ".join(["_open int", *[f"{n} bigint" for n in names]])))
        rows = rows.select("*", *[p.alias(n) for p, n in zip(prefix, names, strict=True)]).join(side, names)
    else:
        rows = rows.withColumn("_open", F.lit(0))
    counts: list[list[tuple]] = [[] for _ in cells]
    for r in rows.groupBy("_open", finer.alias("_fine")).agg(F.count("*").alias("n"), F.sum("_size").alias("s")).collect():
        low = list(cells[r["_open"]].low)
        low[word] = r["_fine"] << shift
        counts[r["_open"]].append((tuple(low), r["n"], r["s"]))
    return [sorted(c) for c in counts]


def _place(keyed: DataFrame, shard_cuts: list[Cut], range_cuts: list[Cut]) -> DataFrame:
    """One exchange by range; slots from the exact counts below the range and the position within it."""
    spark = keyed.sparkSession
    cuts = sorted([*shard_cuts, *range_cuts], key=lambda c: c.key)
    shard_keys = [c.key for c in shard_cuts]
    starts = [Cut((LOWEST,) * 3, 0, 0), *cuts]
    places = []
    for n, start in enumerate(starts):
        shard = bisect_right(shard_keys, start.key)
        first = shard_cuts[shard - 1].rows if shard else 0
        places.append((n, shard, start.rows - first))
    # by the first bits of the key: how many cuts lie before, and those inside
    firsts = [c.key[0] >> (WORD_BITS - FIRST_BITS) for c in cuts]
    half = 1 << (FIRST_BITS - 1)
    table = [(cell, bisect_left(firsts, cell), [c.key for c in cuts[bisect_left(firsts, cell):bisect_right(firsts, cell)]])
             for cell in range(-half, half)]
    cells = spark.createDataFrame(
        table, "_cell bigint, _before int, _inside array<struct<_k0: bigint, _k1: bigint, _k2: bigint>>")
    lookup = spark.createDataFrame(places, "_range int, shard int, _offset bigint")
    key = F.struct(*_WORDS)
    ranged = (
        keyed.withColumn("_cell", F.shiftright("_k0", WORD_BITS - FIRST_BITS))
        .join(F.broadcast(cells), "_cell")  # 4,096 rows
        .withColumn("_range", F.col("_before") + F.size(F.filter("_inside", lambda cut: cut <= key)))
        .select("_row", "_size", *_WORDS, "_range")
    )
    order = Window.partitionBy("_range").orderBy(*_WORDS)
    return (
        ranged.withColumn("_at", F.row_number().over(order) - 1)
        .join(F.broadcast(lookup), "_range")  # less than MAX_RANGES rows
        .withColumn("slot", F.col("_offset") + F.col("_at"))
    )
