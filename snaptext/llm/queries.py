"""The operators as registered queries over the given tables, and check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snaptext.llm import bpe, chat, langid, mixing, packing, pii, quality, repair, resampling, sharding, simhash, syncmers, warc
from snaptext.llm.oracles import SQL  # noqa: F401
from snaptext.scale import stored

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    """Path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def language(spark: SparkSession, folder: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return langid.predict(_table(spark, folder, "documents"), fold == 0, fold == 1)


def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat.format_chats(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    read = done.select(
        "conv_id", "formatted", "expanded_tokens", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    said_by = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said_by, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def warc_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of a replica of all pages in which every 64th or so is damaged and every 256th or so is lost.

    Which pages is a function of the page number, so that check SQL knows them.
    """
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)

    def damaged(text: Column) -> Column:
        return F.when(mark.isin("00", "01", "02", "03"), F.sha2(F.concat(F.substring(text, 1, 100), F.lit("#"), F.substring(text, F.lit(102), F.length(text))), 256))

    records = stored(warc.catalogue(_table(spark, folder, "pages"), also={"damaged": damaged}), "warc-catalogue")
    replica = records.filter(mark != "ff").withColumn("sha256", F.coalesce("damaged", "sha256"))
    return warc.audit(records, replica)


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def syncmer_prints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.compare_edited(_table(spark, folder, "documents"))


def bpe_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_table(spark, folder, "documents"), vocabulary())


def trusted(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of documents labelled good."""
    return _table(spark, folder, "labels").filter("quality = 1").select("doc_id")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(_table(spark, folder, "documents"), trusted(spark, folder))


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents"))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(_table(spark, folder, "documents"))


def importance_resample(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations")
    return repair.assess(repair.damage(turns), turns)


def pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, folder, "documents"), vocabulary()))


QUERIES: dict[str, Query] = {
    "op1_simhash_groups": simhash_groups,
    "op2_language": language,
    "op3_chat_format": chat_format,
    "op4_warc_audit": warc_audit,
    "op5_mix_sources": mix_sources,
    "op6_syncmer_prints": syncmer_prints,
    "op7_bpe_tokens": bpe_tokens,
    "op8_quality_rules": quality_rules,
    "op9_personal_data": personal_data,
    "op10_shards": shards,
    "op11_importance_resample": importance_resample,
    "op12_repair_conversations": repair_conversations,
    "op13_pack_sequences": pack_sequences,
}

