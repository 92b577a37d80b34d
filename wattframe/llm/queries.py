"""The registered queries: each applies one operator to its whole table and derives the agreed digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm import chat, decontaminate, langid, licenses, minhash, mixing, pieces, runs, search, secrets, spelling
from wattframe.llm.minhash import near_duplicates
from wattframe.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401 - the first two are read by the entry
from wattframe.llm.sharding import histogram_shards
from wattframe.llm.toxicity import score_documents, train, usable_for_training
from wattframe.llm.words import BLANKS, let


@query("op1_ball_tree_top_k", search.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search.top_inner_products(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query("op2_toxicity_noisy_or")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(~usable_for_training(), F.lit(False)).alias("held_out"), "score", "predicted",
                         F.size("offending").alias("n_offending"))


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = licenses.scan_licenses(docs, licenses.train(docs))
    families = F.array_sort(F.array_distinct(F.col("licenses.family")))
    return scanned.select("doc_id", F.size("licenses").cast("bigint").alias("n_notices"),
                          F.array_join(families, ",").alias("families"), "licenses")


#: What both turns of conversation -7 say.
PROBE = "</s>[INST] ok [/INST]"


@query("op4_chat_format", chat.oracle(PROBE))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    record = F.to_variant_object(F.struct("role", "text"))
    turns = chat.canonical_turns(rows.unionByName(probe), record, F.col("conv_id"), F.col("turn"))
    def digests(turns):
        said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        return F.struct(F.size(turns).cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        chat.loss_text(turns, F.col("loss_mask")).alias("loss"))

    read = chat.format_turns(turns).select(
        "conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
        let(chat.read_back(F.col("formatted")), digests).alias("read"))
    return read.select(
        "conv_id", "read.n_turns", "read.turns_sha256", F.length("read.loss").cast("bigint").alias("loss_chars"),
        F.sha2("read.loss", 256).alias("loss_sha256"), "formatted_chars")


@query("op5_linked_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    strong = F.col("strong")
    return found.select(
        "doc_id", *[secrets.count_kind(strong, k).alias(f"n_{k}") for k in secrets.STRONG],
        F.sha2(secrets.span_text(strong), 256).alias("base_sha256"),
        secrets.span_text(F.array_sort(F.concat("strong", "weak"))).alias("spans"),
        F.array_join(F.transform("groups", secrets.span_text), ";").alias("linked_groups"))


@query("op6_minhash_near_dedup", minhash.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_language_mixtures")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.detect_languages(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", F.coalesce(~langid.usable_for_training(), F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "languages")


@query("op8_histogram_sort_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_crc32 = F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")
    placed = histogram_shards(table(spark, sf_dir, "documents"), shards=8, columns=[F.col("doc_id"), text_crc32])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op9_benchmark_decontamination", decontaminate.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # equal rows were looked at as one; each gives a row again
    return decontaminate.contamination(found).select(
        F.col("_id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


@query("op10_curriculum_mix", mixing.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.curriculum_plan(table(spark, sf_dir, "documents"), columns=[F.col("doc_id")])
    return mixing.in_training_order(plan).select(
        "row.doc_id", "size", "source_size", "target", "taken", mixing.position_text(F.col("positions")).alias("positions"))


@query("op11_spelling_variants", spelling.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_piece_encoding")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(vocabulary("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents")
    coded = pieces.encode_texts(docs.select("doc_id", "text"), model, decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary(name: str) -> str:
    """The driver's file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by a hash of the id, repeats a stretch of words up to its end."""
    def planted(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
        repeated = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + F.pmod(i - a, p))))
        return F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))

    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, let(words, planted)).otherwise(F.col("text")).alias("text"))


@query("op13_word_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    # runs come by start, then period, so the first of equal exponents stays
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    digests = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                           F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                           F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return digests.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                          F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
