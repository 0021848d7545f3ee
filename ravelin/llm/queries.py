"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, embeddings, fingerprints, language, merkle, oracles, packing, quality, secrets, sentencepieces, simhash, structure, substrings, token_counts


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove(spark, docs, give=("n_words", "n_removed", "kept_sha256"), keep_text=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = quality.fit(spark, docs, common.table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    return sentencepieces.digest(sentencepieces.encode(spark, common.table(spark, sf_dir, "documents"), path), path)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = common.durable(spark, simhash.fingerprint(docs).select("doc_id", "simhash"), "simhash")
    found = simhash.components(spark, prints)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = language.predict(spark, docs.select("doc_id", "text"), language.fit(spark, docs))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark, common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near(spark, common.table(spark, sf_dir, "embeddings"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(spark, common.table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base_secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secrets.as_text(F.col("base_secrets")), 256).alias("base_sha256"),
        secrets.as_text(F.col("secrets")).alias("spans"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    made = merkle.build(spark, docs, ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": tampered})
    found = merkle.proofs(spark, made)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(more)
    template = chat.Template()
    return chat.read_back(chat.format_conversations(rows, template.render), template)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations as transport may leave them: by the checksum of ``conv_id:turn`` rows are dropped, emptied, stripped of
    their sentence ends, repeated or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("by")
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), by).where("by <> 0")
    role = F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role")
    left = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text")
    times = F.sequence(F.lit(1), F.when(F.col("by") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role, left, F.explode(times).alias("copy")).drop("copy")


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations")
    return structure.audit(spark, damaged(rows), of=rows)


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_quality": op2_quality,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash": op4_simhash,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_embeddings": op7_embeddings,
    "op8_fingerprints": op8_fingerprints,
    "op9_secrets": op9_secrets,
    "op10_token_counts": op10_token_counts,
    "op11_chat": op11_chat,
    "op12_merkle": op12_merkle,
    "op13_structure": op13_structure,
}

#: The others hash, tokenize or learn in ways that SQL has no functions for; the tests hold them against plain versions.
ORACLES = {
    "op1_substrings": oracles.SUBSTRINGS,
    "op7_embeddings": oracles.EMBEDDINGS,
    "op9_secrets": oracles.SECRETS,
    "op11_chat": oracles.CHAT,
    "op12_merkle": oracles.MERKLE,
    "op13_structure": oracles.STRUCTURE,
}
