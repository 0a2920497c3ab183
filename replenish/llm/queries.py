"""The registered queries of the training-data operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish.llm import bpe, chat_format, exact_dedup, fingerprint, lexical_search, mixing, ngram_join, packing, spelling, suffix_dedup, token_counts, toxicity, url_filter
from replenish.llm.common import table

#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: A conversation whose texts look like another template's control strings.
TRICKY = "</s>[INST] ok [/INST]"


#: Vocabulary files of public tokenizers (op4: pieces and pre-token pattern; op5: the whole scheme).
PIECES, WORD_BPE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, num=85, den=100).drop("text_key")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), span=200)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, token_counts.read_ranks(public_tokenizers.path(PIECES)), public_tokenizers.PATTERN)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), str(public_tokenizers.path(WORD_BPE)))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.to_json(F.struct("turn", "role", "text")).alias("json"))
    tricky = json.dumps({"messages": [{"role": r, "content": TRICKY} for r in ("user", "assistant")]})
    records = rows.unionByName(spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(tricky).alias("json")))
    return chat_format.digest_formatted(chat_format.render(chat_format.canonical_turns(records)))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")).drop("key")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("is_heavy")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_suffix_dedup, op3_url_filter, op4_token_counts, op5_bpe, op6_chat_format,
                                   op7_fingerprint, op8_toxicity, op9_exact_dedup, op10_packing, op11_lexical_search,
                                   op12_mixing, op13_spelling)}
