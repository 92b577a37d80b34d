"""Search and near duplicates against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import plain
from wattframe.llm.components import connected_components
from wattframe.llm.minhash import _Signer, drop_near_duplicates, near_duplicates
from wattframe.llm.search import top_inner_products

VECTORS = "vec_id bigint, embedding array<float>"


def best_of(rows, k):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in good:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("n", [1, 3, 700])
def test_search_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(n)]
    rows += [(10_000 + i, rows[0][1]) for i in range(150)]  # ties, more than a leaf
    found = top_inner_products(spark.createDataFrame(rows, VECTORS), spark.createDataFrame(rows, VECTORS), k=5)
    assert {tuple(r) for r in found.collect()} == best_of(rows, 5)


def test_search_leaves_out_what_has_no_score(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0]),
            (7, []), (8, []), (9, [3.0, -1.0]), (10, [3e15, 1e15]), (11, [-3e15, 0.5])]
    table = spark.createDataFrame(rows, VECTORS)
    found = {tuple(r) for r in top_inner_products(table, table, k=5).collect()}
    clip = {(q, n, i, max(min(s, 2**63 - 1), -(2**63))) for q, n, i, s in best_of(rows, 5)}
    assert {r[:3] for r in found} == {r[:3] for r in clip} and {r[0] for r in found} == {1, 7, 8, 9, 10, 11}
    assert top_inner_products(table.limit(0), table.limit(0)).collect() == []


def brute_components(rows, percent=85):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def families(seed, groups=12, members=25):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_near_duplicates_equal_brute_force(spark, make_docs):
    rows = families(3)
    assert plain(near_duplicates(make_docs(rows)).collect()) == plain(brute_components(rows))


def test_one_large_family_in_blocks(spark, make_docs, monkeypatch):
    from wattframe.llm import minhash

    rows = families(5, groups=1, members=200)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 20)
    assert plain(near_duplicates(make_docs(rows)).collect()) == plain(brute_components(rows))


def test_documents_of_the_table(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert plain(near_duplicates(documents).collect()) == plain(brute_components(rows))


def test_near_duplicates_of_awkward_rows(awkward, clashing):
    for docs in (awkward, clashing):
        found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
        assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, None, True), (5, 1, 5, True), (6, 1, 5, False)} <= found
        left = drop_near_duplicates(docs)
        assert left.columns == docs.columns and left.count() == 9
    assert near_duplicates(awkward.limit(0)).collect() == []


def test_estimate_is_near_the_similarity():
    signer, rng = _Signer(), np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85):
        found = []
        for _ in range(40):
            common = rng.integers(0, 1 << 63, int(400 * share), dtype=np.uint64)
            a, b = (np.concatenate([common, rng.integers(0, 1 << 63, (400 - len(common)) // 2, dtype=np.uint64)]) for _ in "ab")
            p, q = signer.planes(signer.minima(a)).reshape(2, 5), signer.planes(signer.minima(b)).reshape(2, 5)
            differ = np.bitwise_count(((p[0] ^ q[0]) | (p[1] ^ q[1])).view(np.uint64)).sum()
            found.append(((1 - differ / 320) - 0.25) / 0.75)
        assert abs(np.mean(found) - share) < 0.03


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 230), rng.randrange(230, 260)) for _ in range(25)]
    up = defaultdict(set)
    for a, b in edges:
        up[a].add(b)
        up[b].add(a)
    want = {}
    for start in sorted(up):
        stack = [start] if start not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = start
                stack.extend(up[x])
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in connected_components(table).collect()} == want
    assert connected_components(table.limit(0)).collect() == []
    assert connected_components(spark.createDataFrame([(3, 3)], "a bigint, b bigint").where(F.lit(True))).collect() == []
