"""Sharding, mixing and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_pairs import brute_components
from tests.llm.test_texts import brute_contamination
from wattframe.errors import ArgumentError
from wattframe.llm import queries
from wattframe.llm.minhash import band_layout
from wattframe.llm.mixing import _knots, curriculum_mix, curriculum_plan, training_time
from wattframe.llm.sharding import histogram_shards


def check_shards(rows, shards, largest):
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(size.values())
    assert all(abs(size[s] - total / shards) <= 0.02 * total / shards + 2 * largest for s in range(shards))


def test_shards_of_the_table(spark, sf_dir, documents):
    rows = queries.op8(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    check_shards(rows, 8, max(r["size"] for r in rows))


def test_equal_texts_and_hot_groups(make_docs):
    docs = make_docs([(i, "hot text " * 5) for i in range(900)] + [(1000 + i, f"text {i}" * (i % 40)) for i in range(2000)]
                     + [(5000 + i, f"pair {i % 100}") for i in range(200)])
    rows = histogram_shards(docs, shards=8).collect()
    check_shards(rows, 8, max(r["size"] for r in rows))
    places = defaultdict(set)
    for r in rows:
        places[r["text"]].add(r["shard"])
    # the hot group is larger than a shard; of the others only one at a cut may be divided
    assert sum(len(p) > 1 for t, p in places.items() if not t.startswith("hot")) <= 7


def test_shards_of_awkward_rows(awkward, clashing, make_docs):
    rows = histogram_shards(clashing, shards=3).collect()
    assert len(rows) == 10 and Counter(r["size"] for r in rows)[1] == 2
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(3))
    equal = histogram_shards(make_docs([(1, "same")] * 400), shards=4).collect()
    check_shards(equal, 4, 5)
    assert histogram_shards(awkward.limit(0)).collect() == []
    with pytest.raises(ArgumentError):
        histogram_shards(awkward, shards=0)


def test_mix_meets_targets(make_docs):
    docs = make_docs([(i, "w " * (i % 50), "en", s) for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 20 + [None] * 80)])
    rows = curriculum_plan(docs).collect()
    taken, target, size = Counter(), {}, {}
    for r in rows:
        s = r["row"]["source"]
        taken[s] += r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["positions"] == sorted(r["positions"])
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 50
    again = curriculum_plan(docs.repartition(7)).collect()
    assert sorted((r["row"]["doc_id"], r["taken"]) for r in again) == sorted((r["row"]["doc_id"], r["taken"]) for r in rows)


def test_mix_of_awkward_rows(awkward, clashing):
    plan = curriculum_plan(clashing).collect()
    assert len(plan) == 10 and all(r["taken"] <= 3 * r["size"] for r in plan)
    mixed = curriculum_mix(clashing)
    assert mixed.columns == clashing.columns
    assert curriculum_plan(awkward.limit(0)).collect() == []


def test_schedule_inverse(spark):
    schedule = ((0.0, 0.0), (0.3, 2.0), (0.6, 2.0), (1.0, 0.5))
    shares = spark.range(101).select((F.col("id") / 100).alias("f"))
    rows = shares.select("f", training_time(F.col("f"), _knots(schedule)).alias("t")).collect()

    def integral(t, steps=20000):
        def weight(x):
            for (a, u), (b, v) in zip(schedule[:-1], schedule[1:], strict=True):
                if x <= b:
                    return u + (v - u) * (x - a) / (b - a)
        return sum(weight((i + 0.5) * t / steps) for i in range(steps)) * t / steps

    whole = integral(1.0)
    for r in rows[::10]:
        assert integral(r["t"]) / whole == pytest.approx(r["f"], abs=1e-4)
    with pytest.raises(ArgumentError):
        _knots(((0.0, 1.0), (0.5, 1.0)))


def test_pipeline(spark, sf_dir, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "histogram_sort_sharding"]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        kept.append(docs)
        if name != "histogram_sort_sharding":
            assert docs.columns == before.columns
    rows = [sorted((r["doc_id"], r["text"]) for r in f.collect()) for f in [documents, *kept]]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {i for i, _ in rows[0]} - {i for i, _ in rows[1]}
    assert all(labels.get(i) != 0 for i in gone)
    assert [i for i, _ in rows[2]] == [i for i, _, _, keep in brute_components(rows[1], corpus_pipeline.NEAR_PERCENT) if keep]
    clean = {r[0] for r in brute_contamination(rows[2], bench) if not r[4]}
    assert {i for i, _ in rows[3]} == clean
    assert set(rows[4]) <= set(rows[3]) and rows[5] == rows[4]
    assert max(Counter(i for i, _ in rows[4]).values()) <= 3


def test_pipeline_stages_keep_clashing_columns(spark, sf_dir, clashing):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == clashing.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
    empty = clashing.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def planted_pairs(low, high, seed=11):
    """Pairs and chains of documents; neighbours have a similarity of `low` to below `high` percent."""
    rng, rows = random.Random(seed), []
    while len(rows) < 150:
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(rng.choice([2, 2, 3])):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for i in rng.sample(range(20), 4):  # each new word changes five shingles of 196
                words[10 * i + 5] = f"x{rng.randrange(10**6)}"
    sets = [{tuple(t.split()[j:j + 5]) for j in range(196)} for _, t in rows]
    shared = [len(a & b) / len(a | b) for a, b in zip(sets, sets[1:], strict=False)]
    return rows, [s for s in shared if s > 0.5 and 100 * s >= low and 100 * s < high]


def test_near_dedup_stage_at_80_percent(spark, sf_dir, documents, make_docs):
    rows, between = planted_pairs(80, 85)
    assert len(between) > 50
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    for docs in (make_docs(rows), documents):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        found = sorted(r["doc_id"] for r in stage(spark, docs, sf_dir).collect())
        assert found == [i for i, _, _, keep in brute_components(texts, 80) if keep]
        assert found != [i for i, _, _, keep in brute_components(texts, 85) if keep]


def test_bands_find_what_reaches_the_threshold():
    assert band_layout(85) == (8, 40) and band_layout(80) == (6, 42)
    with pytest.raises(ArgumentError):
        band_layout(0)
