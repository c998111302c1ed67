"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm import (
    bpe,
    chat,
    ctph,
    decontaminate,
    language_id,
    lexical,
    mixing,
    quality,
    sharding,
    simhash,
    token_files,
    warc,
    whitening,
)
from tillroll.llm.common import shipped, table
from tillroll.llm.oracle_sql import STATEMENTS
from tillroll.sources.scratch import hold


# The public tokenizer of the registered query and the id it ends documents with (fixed values).
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
# The public vocabulary of the byte-level encoder (fixed value).
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    documents = table(spark, sf_dir, "documents")
    manifest, dictionary = token_files.write_tokens(documents, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_tokens(manifest, dictionary)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random shards of all documents, digested from the written rows."""
    rows = sharding.shuffled_shards(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives, read back."""
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    planned = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return planned.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("_id").alias("doc_id"),
        simhash.hexadecimal(F.col("_print")).alias("fingerprint"),
        F.col("_group").alias("component_id"),
    )


# Said by both sides of the added conversation (fixed value).
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted, written and read back."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    written = hold(chat.format_conversations(conversations.unionByName(added)), "chat")
    turns = chat.parsed(F.col("formatted"))
    digest = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return written.select(
        "conv_id",
        F.size(turns).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(digest, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_id").alias("doc_id"), "item_id", "item_words", "covered_words", "changed_slots")


def op10_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and likeness to the next document."""
    return ctph.fingerprints(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    path = public_tokenizers.path(BYTE_VOCABULARY)
    decoded = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first four whitened components; a deviation beyond a long is null."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_language_id": op2_language_id,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_source_mix": op5_source_mix,
    "op6_simhash": op6_simhash,
    "op7_chat_format": op7_chat_format,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_ctph": op10_ctph,
    "op11_lexical_search": op11_lexical_search,
    "op12_bpe": op12_bpe,
    "op13_whitening": op13_whitening,
}

QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for name, sql in STATEMENTS.items() if name in QUERIES}
