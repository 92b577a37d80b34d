"""Near duplicates by b-bit MinHash.

Every text becomes the set of its five-word shingles, a signature of minima of which only the low bits are kept
(packed in bit planes), and hashes of bands of full minima. Equal sets form a class. Classes that share a band are
candidates; the share of equal low bits, corrected for chance, estimates their similarity, and what may reach the
threshold is confirmed on the full sets.

No pairs of a bucket are listed. First every class meets the most connected class of each of its buckets, which
joins a group of copies at about one comparison per copy. Buckets that still hold several components are compared in
blocks of bounded size within a task: there the estimate leaves families of classes that may be linked, and each
family's full sets are compared once more in blocks. A block gives a spanning forest of its links, so that rows grow
with the members and no link that would join two components is lost.

Two sets at the threshold share a band with probability 1 - 3e-6 or more: 40 bands of 8 minima at 0.85, 42 bands of
6 at 0.80. The estimate has a standard deviation of 0.024 at 0.85 and 0.027 at 0.80; what lies five of them below the
threshold is dropped unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.errors import ArgumentError
from wattframe.llm.components import connected_components
from wattframe.llm.sizes import broadcast_if_small
from wattframe.llm.words import NOT_BLANK
from wattframe.session import materialize

SHINGLE = 5
BAND_ROWS = 8
#: Two sets at the threshold share no band with at most this probability.
MAX_MISS = 3e-6
KEPT_BITS = 2
SEED = 20_240_229
MINIMA = 320
PLANE_WORDS = MINIMA // 64
_CHUNK = 2048
BLOCK_ROWS = 512
BLOCK_SHINGLES = 2_000_000
_CACHED_WORDS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the usual xor-shift and multiply rounds)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHED_WORDS:  # later words are hashed each time
            self[word] = value
        return value


def shingles(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the five-word shingles; `bytes.lower` and `split` know ASCII only."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    total = np.full(n, min(len(words), SHINGLE), np.uint64)
    for i in range(min(len(words), SHINGLE)):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(total)


def band_layout(percent: int) -> tuple[int, int]:
    """(minima per band, bands): the widest bands, and the fewest of them, that miss at most MAX_MISS at the threshold."""
    for rows in range(BAND_ROWS, 0, -1):
        for bands in range(1, MINIMA // rows + 1):
            if (1 - (percent / 100) ** rows) ** bands <= MAX_MISS:
                return rows, bands
    raise ArgumentError(f"no bands of {MINIMA} minima find similarities of {percent} %")


class _Signer:
    def __init__(self, percent: int = 85) -> None:
        self.band_rows, self.n_bands = band_layout(percent)
        rng = np.random.default_rng(SEED)
        self.a = (rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]

    def minima(self, found: np.ndarray) -> np.ndarray:
        x = (found >> np.uint64(32)).astype(np.uint32)
        least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
        for start in range(0, len(x), _CHUNK):
            block = self.a * x[None, start : start + _CHUNK]
            block += self.b
            np.minimum(least, block.min(axis=1), out=least)
        return least

    @staticmethod
    def planes(least: np.ndarray) -> np.ndarray:
        """The low bits of the minima, spread first (low bits of a linear hash are weak), one plane per bit."""
        mixed = _mix(least.astype(np.uint64))
        return np.concatenate([np.packbits(((mixed >> np.uint64(i)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
                               for i in range(KEPT_BITS)])

    def bands(self, least: np.ndarray) -> np.ndarray:
        rows = least[: self.n_bands * self.band_rows].astype(np.uint64).reshape(self.n_bands, self.band_rows)
        key = np.arange(1, self.n_bands + 1, dtype=np.uint64)
        for i in range(self.band_rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
        return key.view(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *[len(v) for v in values]])
    flat = np.concatenate([np.empty(0, np.int64), *values])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _sign(percent: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, known = _Signer(percent), _WordHashes()
        nothing = np.empty(0, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sizes, sums, mixes, planes, bands = [], [], [], [], []
                for text in _texts(batch):
                    found = shingles(text or b"", known)
                    sizes.append(len(found))
                    sums.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                    mixes.append(int(np.bitwise_xor.reduce(_mix(found), initial=np.uint64(0)).view(np.int64)))
                    least = signer.minima(found) if len(found) else None
                    planes.append(nothing if least is None else signer.planes(least))
                    bands.append(nothing if least is None else signer.bands(least))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                     pa.array(mixes, pa.int64()), _lists(planes), _lists(bands)],
                    ["doc_id", "n", "f1", "f2", "planes", "bands"])

    return sign


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for whole in batches:
        for start in range(0, whole.num_rows, 200):
            batch = whole.slice(start, 200)
            found = [shingles(t or b"", known).view(np.int64) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(found)], ["doc_id", "shingles"])


def signatures(docs: DataFrame, text: str = "text", row_id: str = "doc_id", percent: int = 85) -> DataFrame:
    """(doc_id, n, f1, f2, planes, bands): size and 128-bit fingerprint of the set, packed low bits, band hashes."""
    thin = docs.select(F.col(row_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return thin.mapInArrow(
        _sign(percent), "doc_id bigint, n bigint, f1 bigint, f2 bigint, planes array<bigint>, bands array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed signatures: the share of equal values, less what chance makes equal."""
    differ = None
    for w in range(PLANE_WORDS):
        word = None
        for bit in range(KEPT_BITS):
            i = bit * PLANE_WORDS + w
            part = a[i].bitwiseXOR(b[i])
            word = part if word is None else word.bitwiseOR(part)
        count = F.bit_count(word)
        differ = count if differ is None else differ + count
    chance = 2.0**-KEPT_BITS
    return ((1 - differ / float(MINIMA)) - chance) / (1 - chance)


def _may_reach(threshold: float) -> Column:
    """What estimate and sizes leave of the candidates (planes_a, planes_b, n_a, n_b)."""
    by_size = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold - 1e-9)
    return by_size & (estimate(F.col("planes_a"), F.col("planes_b")) >= F.lit(threshold - _slack(threshold)))


def _slack(threshold: float) -> float:
    """Five standard deviations of the estimate at the threshold."""
    chance = 2.0**-KEPT_BITS
    equal = chance + (1 - chance) * threshold
    return 5 * sqrt(equal * (1 - equal) / MINIMA) / (1 - chance)


def _both(pairs: DataFrame, classes: DataFrame, value: str) -> DataFrame:
    a, b = (classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col(value).alias(f"{value}_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return (
        _both(pairs, sets, "shingles")
        .select("a", "b", "n_a", "n_b", both.alias("both"))
        .where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both")))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document.

    component_id: the smallest doc_id that links reach; kept: whether it is the document's own. A null or empty
    text has no shingles and is linked with nothing; fewer than five words are one shingle. A document with a
    null id is linked with nothing, has no component and is kept. Rows with one id are one document: their texts'
    links count together. An empty table gives an empty result. Long texts are hashed whole, in blocks; one text
    and its shingles must fit a Python worker.
    """
    signed = materialize(signatures(docs, text, row_id, percent), "signatures")
    threshold = percent / 100
    classes = materialize(
        signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        .groupBy("n", "f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.first("planes").alias("planes"), F.first("bands").alias("bands")),
        "classes")
    links = _links(docs, classes, text, row_id, threshold, percent)
    component = connected_components(links)

    named = classes.select("n", "f1", "f2", "rep").join(
        component.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select(F.col("n"), "f1", "f2", F.coalesce("component", "rep").alias("component"))
    found = signed.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _links(docs: DataFrame, classes: DataFrame, text: str, row_id: str, threshold: float, percent: int) -> DataFrame:
    members = classes.select("rep", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = materialize(members.join(shared, "key"), "bucket-members")
    wanted = materialize(members.select("rep").distinct(), "candidates")

    # star: every class and the class of its bucket that shares most buckets with others
    weight = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    leaders = (
        members.join(weight, "rep").groupBy("key")
        .agg(F.min_by("rep", F.struct(-F.col("weight"), F.col("rep"))).alias("leader"))
    )
    star = members.join(leaders, "key").where(F.col("rep") != F.col("leader"))
    star = star.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    star = materialize(_both(star, classes, "planes").where(_may_reach(threshold)).select("a", "b"), "star-pairs")

    # one more look at the texts of classes with candidates; sets of others are never stored
    ids = broadcast_if_small(wanted.select(F.col("rep").alias("doc_id")))
    thin = docs.select(F.col(row_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = thin.join(ids, "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id bigint, shingles array<bigint>")
    sets = sets.select(F.col("doc_id").alias("rep"), F.size("shingles").alias("n"), "shingles").where(F.col("n") > 0)
    sets = materialize(sets, "full-sets")
    first = materialize(_confirm(star, sets, percent), "star-links")

    # the rest: classes of one bucket that are still apart
    joined = connected_components(first).withColumnRenamed("node", "rep")
    placed = members.select("key", "rep").join(joined, "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    mixed = mixed.where(F.col("low") < F.col("high")).select("key", F.ceil(F.col("size") / BLOCK_ROWS).alias("blocks"))
    apart = placed.join(mixed, "key").join(classes.select("rep", "n", "planes"), "rep")
    near = _in_blocks(apart, "key", "planes").mapInArrow(_near_in_blocks(threshold), "a bigint, b bigint")

    family = materialize(connected_components(near).withColumnsRenamed({"node": "rep", "component": "key"}), "families")
    family = family.join(joined, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    family = materialize(family.join(sets.groupBy("rep").agg(F.max("n").alias("n")), "rep"), "family-members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    whole = family.join(family.groupBy("key").agg(blocks), "key").drop("n").join(sets, "rep")
    second = _in_blocks(whole, "key", "shingles").mapInArrow(_linked_in_blocks(percent), "a bigint, b bigint")
    return materialize(first.unionAll(second), "links")


def _in_blocks(rows: DataFrame, group: str, payload: str) -> DataFrame:
    """Rows of (group, rep, component, n, payload, blocks), once per pair of blocks of their group, sorted by pair.

    A group of up to BLOCK_ROWS rows is one pair of a block with itself; a larger one is spread over several
    tasks, each of which holds two blocks.
    """
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    return (
        rows.select(F.col(group).alias("g"), "rep", "component", "n", payload, own.alias("block"), other.alias("other"))
        .select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", "rep", "component", "n", payload)
        .repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (g, i, j) after the other, whatever batches they come in."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[start])
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(pa.Table.from_batches([batch.slice(start, end - start)]))
            last = key
    if held:
        yield pa.concat_tables(held)


def _whole(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _may_pair(table: pa.Table, low: float) -> np.ndarray:
    """The pairs (upper triangle) of this pair of blocks that lie in different components and are of like size."""
    component, block, n = (_whole(table, c) for c in ("component", "block", "n"))
    apart = np.triu(component[:, None] != component[None, :], 1)
    if block.min() != block.max():
        apart &= block[:, None] != block[None, :]
    return apart & (np.minimum(n[:, None], n[None, :]) >= (low - 1e-9) * np.maximum(n[:, None], n[None, :]))


def _forest(pairs: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that join the same names as all the given pairs do."""
    up = {int(x): int(x) for x in names}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    found = []
    for row, column in np.argwhere(pairs):
        a, b = root(int(names[row])), root(int(names[column]))
        if a != b:
            up[max(a, b)] = min(a, b)
            found.append((int(row), int(column)))
    return found


def _edges(rep: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array([sorted((rep[a], rep[b])) for a, b in found], np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _near_in_blocks(threshold: float):
    """Classes whose estimate may reach the threshold, as a forest."""
    least = threshold - _slack(threshold)
    chance = 2.0**-KEPT_BITS

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            pairs = _may_pair(table, threshold)
            if not pairs.any():
                continue
            planes = table.column("planes").combine_chunks().flatten().to_numpy().reshape(table.num_rows, KEPT_BITS, PLANE_WORDS)
            differ = np.zeros(pairs.shape, np.int64)
            for w in range(PLANE_WORDS):
                word = planes[:, None, 0, w] ^ planes[None, :, 0, w]
                for bit in range(1, KEPT_BITS):
                    word |= planes[:, None, bit, w] ^ planes[None, :, bit, w]
                differ += np.bitwise_count(word.view(np.uint64))
            pairs &= ((1 - differ / MINIMA) - chance) / (1 - chance) >= least
            rep = _whole(table, "rep")
            yield _edges(rep, _forest(pairs, rep))

    return near


def _linked_in_blocks(percent: int):
    """Links confirmed on the full sets, as a forest of the components."""
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            pairs = _may_pair(table, percent / 100)
            if not pairs.any():
                continue
            n = _whole(table, "n")
            union = n[:, None] + n[None, :] - (both := _common(table))
            pairs &= 100 * both >= percent * union
            yield _edges(_whole(table, "rep"), _forest(pairs, _whole(table, "component")))

    return linked


def _common(table: pa.Table) -> np.ndarray:
    """The sizes of all intersections, as products of 0/1 matrices over the shingles that occur more than once."""
    column = table.column("shingles").combine_chunks()
    row = np.repeat(np.arange(table.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
    _, place, times = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
    often = times[place] > 1
    row, place = row[often], place[often]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    place = np.cumsum(np.r_[0, place[1:] != place[:-1]]) if len(place) else place
    total = np.zeros((table.num_rows, table.num_rows), np.float32)  # counts stay far below 2^24
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, _CHUNK):
        here = slice(*np.searchsorted(place, [start, start + _CHUNK]))
        part = np.zeros((table.num_rows, _CHUNK), np.float32)
        part[row[here], place[here] - start] = 1
        total += part @ part.T
    return total.astype(np.int64)


def drop_near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", percent: int = 85) -> DataFrame:
    """One document of each group: the one with the smallest id; all columns as they were."""
    gone = near_duplicates(docs, text, row_id, percent).where(~F.col("kept")).select("doc_id").distinct()
    gone = broadcast_if_small(materialize(gone, "near-duplicates"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(row_id).cast("bigint").alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select("_row.*")


def oracle(percent: int = 85) -> str:
    """The same in DuckDB, by counting the common shingles of every two documents that share any; ids are unique."""
    return f"""
WITH RECURSIVE spoken AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '{NOT_BLANK}') AS words FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - {SHINGLE} + 2), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' ')) END) AS shingle FROM spoken),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= {percent} * (x.n + y.n - common.n)),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reached.doc_id, b FROM reached JOIN links ON a = other),
roots AS (SELECT doc_id, min(other) AS root FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) IS NOT DISTINCT FROM doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)"""
