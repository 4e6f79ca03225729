"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe_codec, fm_decontam, media_mpeg, ngram_join, quality_gbdt, token_counts, tool_chat, toxicity_knn, url_cascade, xent_lm
from textloom.llm.common import dropped

#: Where the vocabulary files of public tokenizers are; never copied into the repository.
TOKEN_LIMIT = 4096


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return token_counts.over_limit(counts, TOKEN_LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_pretokens")


def op2_media_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_mpeg.probe_media(media_mpeg.store_texts(table(spark, sf_dir, "documents")))


#: Fixed by the contract: (action, host, path).
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "action string, host string, path string")
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"), rules)


OP3_SQL = """
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), rules(action, rule_host, rule_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')
), ranked AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, action,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
  FROM parsed LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM ranked WHERE place = 1
"""


def op4_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = fm_decontam.hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        fm_decontam.items_digest(F.col("items")).alias("items_sha256"), fm_decontam.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op5_xent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the texts of ``conversations``; background: all ``documents``."""
    documents = table(spark, sf_dir, "documents")
    model = xent_lm.fit(table(spark, sf_dir, "conversations"), documents)
    scores = xent_lm.score(documents, model)
    dropped(model.table)
    return scores


#: The tools that turns of ``conversations`` are calls of: what a system turn sets and what a user turn asks.
CHAT_TOOLS = {
    "configure": {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "maximum": 0}}},
    "ask": {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}},
}


def chat_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results): system and user turns, and turns without a role, as calls, each assistant turn as the result of the turn before it; a call needs the last two turns' calls.

    An identifier joins conversation and turn; where either is null it is null and links with nothing."""
    call_id = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = turns.where(~answer).select(
        "conv_id", call_id(0).alias("call_id"), "turn", F.when(F.col("role") == "system", "configure").otherwise("ask").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"), F.array(call_id(1), call_id(2)).alias("needs"),
    )
    return calls, turns.where(answer).select("conv_id", call_id(1).alias("call_id"), "turn", F.col("text").alias("content"))


def op6_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_calls(table(spark, sf_dir, "conversations"))
    return tool_chat.link_calls(calls, results, CHAT_TOOLS)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern()
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), ranks, pattern)


def fold(divisor: int) -> Column:
    """The fold of a document by its id, as the contracts count."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def quality_model(spark: SparkSession, sf_dir: str) -> quality_gbdt.Trees:
    """Fitted on labelled rows outside the held-out fold."""
    return quality_gbdt.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", fold(5) != 0)


def op8_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_gbdt.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def toxicity_index(spark: SparkSession, sf_dir: str) -> toxicity_knn.Index:
    """Examples from labelled rows outside the held-out fold."""
    return toxicity_knn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", fold(4) != 2)


def op10_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_knn.score(table(spark, sf_dir, "documents"), toxicity_index(spark, sf_dir))
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted", "evidence")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_media_mpeg, op3_url_cascade, op4_fm_decontam, op5_xent_lm, op6_tool_chat, op7_byte_bpe, op8_quality_gbdt, op9_ngram_join, op10_toxicity_knn)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_cascade": OP3_SQL}
