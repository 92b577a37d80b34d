"""Spelling variants, piece encoding and runs of words, against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import plain
from wattframe.errors import ArgumentError
from wattframe.llm import pieces, queries, runs, spelling

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


# spelling variants

def brute_variants(counts):
    """(word, n, form, root, n_near, form_n) by trying every edit."""
    letters, found = {c for w in counts for c in w}, {}
    for word, n in counts.items():
        edits = {word[:i] + c + word[i + cut:] for i in range(len(word) + 1) for c in [*letters, ""] for cut in (0, 1)}
        near = [w for w in edits if w in counts and w != word]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        found[word] = (n, form, len(near), counts[form] if form else None)

    def root(word):
        return root(found[word][1]) if found[word][1] else word

    return sorted(((w, n, f, root(w), k, fn) for w, (n, f, k, fn) in found.items()), key=repr)


def counted(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_variants_of_the_table(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = spelling.spelling_variants(documents).collect()
    assert plain(found) == brute_variants(counted(rows))
    assert sum(r["form"] is not None for r in found) > 50


def test_variants_of_random_words(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))): rng.choice([1, 2, 3, 4, 9, 40]) for _ in range(500)}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert plain(spelling.group_variants(table).collect()) == brute_variants(words)


def test_long_chains_and_hubs(spark):
    chain = {"x" * (30 + i): 2**i for i in range(20)}
    hub = {"hub": 10**6} | {"hub"[:i] + chr(200 + j) + "hub"[i:]: 1 for i in range(4) for j in range(50)}
    found = {r["word"]: r for r in spelling.group_variants(
        spark.createDataFrame(list((chain | hub).items()), "word string, n bigint")).collect()}
    assert all(found[w]["root"] == "x" * 49 for w in chain)
    assert found["hub"]["n_near"] == 200 and all(found[w]["root"] == "hub" for w in hub)
    # equal characters: each shorter word is a neighbour once, though several places lead to it
    assert found["x" * 31]["n_near"] == 2


def test_variants_of_awkward_rows(spark, awkward, clashing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for docs in (awkward, clashing):
        assert plain(spelling.spelling_variants(docs).collect()) == brute_variants(counted(rows))
    assert spelling.spelling_variants(awkward.limit(0)).collect() == []
    with pytest.raises(Exception, match="end mark"):
        spelling.group_variants(spark.createDataFrame([("a\0b", 1)], "word string, n bigint")).collect()


# piece encoding

@pytest.fixture(scope="module")
def model():
    return pieces.read_model(queries.vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))


def test_encoding_of_random_texts(model, library):
    encoder, decoder, rng = pieces.Encoder(model), pieces.Decoder(model), random.Random(1)
    parts = [*"abcdefgh  ▁▁\n\t\0<s>/é漢字😀12.,﻿́", *model.pieces[500:560], "    ", "▁" * 5, " " * 17, "aaaa", "Ġ"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        ids = list(encoder.encode(text))
        assert ids == library.encode(text)
        assert decoder.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_decoding_of_random_ids(model, library):
    decoder, rng = pieces.Decoder(model), random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 29871]) for _ in range(rng.randrange(10))]
        assert decoder.decode(np.array(ids, np.int32)) == library.decode(ids)
    with pytest.raises(ArgumentError):
        decoder.decode(np.array([32000]))


def test_small_memories_change_nothing(model, library, documents, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_WORDS", 5)
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 3)
    monkeypatch.setattr(pieces, "REMEMBERED_LETTERS", 4)
    encoder = pieces.Encoder(model)
    texts = [r["text"] for r in documents.limit(60).collect()]
    assert [list(encoder.encode(t)) for t in texts] == library.encode(texts)


def test_backtracking_takes_tokens_back():
    """Long matches that go nowhere: `abc` is a piece, but merging `ab cd` needs `ab` first."""
    names = ["cd", "ab", "abc", "bcd", "de"]
    scores = {p: -float(i) for i, p in enumerate(names)} | {c: -9.0 for c in "abcde"}
    texts = list(scores)
    toy = pieces.PieceModel(texts, scores, {p: i for i, p in enumerate(texts)}, [0] * 256, [], 0, "?", False, False)
    encoder, rng = pieces.Encoder(toy), random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 14)))
        assert [texts[i] for i in encoder.encode(text)] == pieces.merged(text, scores)


def test_pieces_of_the_table(spark, sf_dir, documents, library):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    wanted = []
    for r in documents.collect():
        ids = library.encode(r["text"] or "")
        wanted.append((r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert plain(queries.op12(spark, sf_dir).collect()) == sorted(wanted, key=repr)


def test_pieces_of_awkward_rows(model, library, awkward, clashing):
    clashing = clashing.withColumn("IDS", F.lit("mine")).withColumn("row", F.lit("mine")).withColumn("value", F.lit(1))
    for docs in (awkward, clashing):
        rows = pieces.decode_ids(pieces.encode_texts(docs, model), model).collect()
        assert len(rows) == 10
        for r in rows:
            assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"])
        both = pieces.encode_texts(docs, model, decoded="decoded").select("ids", "decoded").collect()
        assert plain(both) == plain([(r["ids"], r["decoded"]) for r in rows])
    assert set(clashing.columns) - {"IDS"} < set(pieces.encode_texts(clashing, model).columns)
    assert pieces.encode_texts(awkward.limit(0), model).collect() == []
    nulls = pieces.decode_ids(awkward.select(F.lit(None).cast("array<int>").alias("ids")), model)
    assert {r["decoded"] for r in nulls.collect()} == {""}


# runs of words

def brute_runs(words):
    """By the definition: for each period the maximal stretches, each with its smallest period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_digests(i, text):
    words = BLANK_WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
    rows = brute_runs(words)
    dropped = {k for s, size, q in rows for k in range(s + q, s + size)}
    best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in (
        "".join(f"{s},{size},{q}\n" for s, size, q in rows), " ".join(w for k, w in enumerate(words) if k not in dropped))]
    return (i, len(rows), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)


def random_words(rng):
    letters, size, words = rng.choice([1, 2, 3, 50]), rng.choice([0, 5, 23, 24, 40, 100, 300]), []
    while len(words) < size:
        if rng.random() < 0.5:
            period = [rng.randrange(letters) for _ in range(rng.randrange(1, 12))]
            words += (period * 80)[:rng.randrange(1, 80)]
        else:
            words += [rng.randrange(letters) for _ in range(rng.randrange(1, 6))]
    return words


def test_runs_of_random_words(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK_PLACES", 7)
    rng, count = random.Random(3), 0
    for _ in range(120):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 10))]
        found = runs.runs_of([np.array(t, np.int64) for t in texts])
        for text, rows in zip(texts, found, strict=True):
            assert [tuple(r) for r in rows.tolist()] == brute_runs(text)
            count += len(rows)
    assert count > 500


def test_extensions_of_random_places():
    rng = random.Random(4)
    for _ in range(60):
        words = np.array([*(random_words(rng) + random_words(rng)), -1])
        if len(words) < 3:
            continue
        a = np.array([rng.randrange(len(words) - 1) for _ in range(50)])
        b = np.array([rng.randrange(x + 1, len(words)) for x in a])
        wanted = [next(k for k in range(len(words)) if words[x + k] != words[y + k]) for x, y in zip(a, b, strict=True)]
        assert runs.Extensions(words).common(a, b).tolist() == wanted


def test_runs_of_the_table(spark, sf_dir, documents):
    short = [r for r in documents.collect() if len(r["text"] or "") < 20_000]
    found = {r["doc_id"]: tuple(r) for r in queries.op13(spark, sf_dir).collect()}
    assert len(found) == documents.count()
    for r in short:
        assert found[r["doc_id"]] == brute_digests(r["doc_id"], r["text"])
    assert sum(row[1] > 0 for row in found.values()) > 10


def test_runs_of_awkward_rows(make_docs, awkward, clashing):
    clashing = clashing.withColumn("Runs", F.lit("mine")).withColumn("row", F.lit("mine"))
    docs = make_docs([(1, "a " * 30), (2, "a b " * 12 + "a"), (2, "a b " * 12 + "a"), (3, "x " + "a b c " * 9 + "y"), (4, "a " * 23)])
    found = sorted((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(docs).collect())
    assert found == [(1, [(0, 30, 1)], "a"), (2, [(0, 25, 2)], "a b"), (2, [(0, 25, 2)], "a b"), (3, [(1, 27, 3)], "x a b c y"),
                     (4, [], " ".join("a" * 23))]
    for rows in (awkward, clashing):
        for r in runs.find_runs(rows).collect():
            assert [tuple(x) for x in r["runs"]] == ([] if len(r["text"] or "") > 10_000 else brute_runs(BLANK_WORD.findall(r["text"] or "")))
            assert r["runs"] or r["collapsed"] == " ".join(BLANK_WORD.findall(r["text"] or ""))
    assert runs.find_runs(awkward.limit(0)).collect() == []
    planted = queries.with_planted_runs(awkward)
    assert planted.count() == 10 and planted.where(F.col("doc_id").isNull()).first()["text"] == "a null id has words"
