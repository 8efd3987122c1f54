"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, chat, exact_dedup, langid, mixing, pieces, pii, quality, secretscan, simhash, spelling, toxicity, turnrepair
from millrace.llm.common import table

#: A SentencePiece model with byte pieces; only the driver reads it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, folder, "documents")))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"), keep="largest")


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in chat.EXTRA)
    extra = spark.sql(f"SELECT * FROM VALUES {rows} AS t(conv_id, turn, role, text)")
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.render(chat.fold(chat.log_of(given))))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), k=20, every=20)


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), repeat=mixing.REPEAT, places=True)


def mixing_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), entropy=mixing.ENTROPY, places=True)


def mixing_budget(spark: SparkSession, folder: str) -> DataFrame:
    """A budget in tokens: sources that are larger than their share are cut, smaller ones repeated."""
    return mixing.mix(table(spark, folder, "documents"), repeat=mixing.REPEAT, budget=mixing.BUDGET, places=True)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Two segmentations of every document: the number and hash of their ids, the digest of what they decode to, scores."""
    found = pieces.encode(table(spark, folder, "documents"), MODEL, samples=2)
    found = found.select("doc_id", "sample", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "ids", "log_p", "log_inclusion")
    return pieces.decode(found, MODEL).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, folder, "documents"), shingle=3, radius=2)


def op11_turnrepair(spark: SparkSession, folder: str) -> DataFrame:
    return turnrepair.audits(turnrepair.damaged(table(spark, folder, "conversations")), present=F.col("present"))


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.digests(secretscan.scan(table(spark, folder, "documents")))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_language": op2_language,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_ann": op6_ann,
    "op7_mixing": op7_mixing,
    "mixing_entropy": mixing_entropy,
    "mixing_budget": mixing_budget,
    "op8_quality": op8_quality,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
    "op11_turnrepair": op11_turnrepair,
    "op12_secrets": op12_secrets,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_chat": chat.SQL,
    "op7_mixing": mixing.SQL,
    "mixing_entropy": mixing.ENTROPY_SQL,
    "mixing_budget": mixing.BUDGET_SQL,
    "op12_secrets": secretscan.SQL,
    "op13_spelling": spelling.SQL,
}
