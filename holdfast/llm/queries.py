"""The registered queries of the text operators: thin digests of what the operators give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import chat, decontamination, mixing, near_dedup, pii, quality, secrets, substring_dedup, token_store, topk
from holdfast.llm.oracle import ORACLE

#: The place of the tokenizer files; a parameter, as they are no part of the library.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark, sf_dir):
    return pii.sanitise(_read(spark, sf_dir, "documents")).drop("clean_text")


def op2_secrets(spark, sf_dir):
    return secrets.scan(_read(spark, sf_dir, "documents")).drop("clean_text")


def op3_quality(spark, sf_dir):
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_chat(spark, sf_dir):
    extra = spark.sql(r"""select -7L as conv_id, turn, role, r'\### Assistant: </turn> ok' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)""")
    log = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra).withColumnRenamed("turn", "seq")
    log = log.withColumns({"message_id": F.concat(F.lit("turn "), "seq"), "kind": F.lit("message")})  # each row an event
    back = chat.parse_chats(chat.format_chats(log))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_token_store(spark, sf_dir):
    return token_store.token_store(_read(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, split_words=True)


def op6_topk(spark, sf_dir):
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_mixing(spark, sf_dir):
    planned = mixing.plan_copies(_read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "source", F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_weight").alias("weight"), F.col("_mix_copies").alias("copies"), F.col("_mix_block").alias("block"), F.col("_mix_places").alias("places"))


def op8_decontamination(spark, sf_dir):
    return decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), window=13)


def op10_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii, op2_secrets, op3_quality, op4_chat, op5_token_store, op6_topk, op7_mixing, op8_decontamination, op9_substring_dedup, op10_near_dedup, pipeline)}
ORACLE_SQL = ORACLE
