"""Queries of layouts, exports and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import mapping, planning
from millrace.schema import as_samples

STRIP_SQL = r"regexp_replace({}, '\A[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+\z', '', 'g')"


def stripped(c: str) -> str:
    return STRIP_SQL.format(c)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as plain-text samples: language and source mapped, what is left in extra."""
    return mapping.map_columns(table(spark, sf_dir, "documents"), {"text": "text", "lang": "language", "source": "source_id", "doc_id": "id"}, "doc_id").withColumn("id", F.col("_pos").cast("string"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chat samples, turns in order."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    turns = F.transform("x", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return as_samples(t.select(F.col("conv_id").cast("string").alias("id"), turns.alias("turns"), F.col("conv_id").alias("_pos")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn and the assistant turn next to it as an instruction sample; _pos is conv_id * 1000 + turn."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    t = t.filter("role = 'user' AND next_role = 'assistant'")
    return as_samples(t.select(F.col("text").alias("instruction"), F.col("next_text").alias("response"), (F.col("conv_id") * 1000 + F.col("turn")).alias("_pos")))


PAIRS_SQL = """p AS (SELECT conv_id * 1000 + turn AS pos, text AS instruction, next_text AS response FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def map_documents_to_samples(spark, sf_dir):
    extra = F.get_json_object("extra", "$.n_chars").cast("bigint")
    return documents(spark, sf_dir).select(F.col("_pos").alias("doc_id"), "text", "language", "source_id", extra.alias("n_chars"))


def map_conversations_to_turns(spark, sf_dir):
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("="), t["content"])), "\x1e")
    return chats(spark, sf_dir).select(F.col("_pos").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.md5(told).alias("turns_md5"))


def export_sft_pairs(spark, sf_dir):
    return mapping.project(pairs(spark, sf_dir), "sft").select(F.col("_pos").alias("pos"), "instruction", "response")


def export_chat_sharegpt(spark, sf_dir):
    t = mapping.project(chats(spark, sf_dir), "chat")
    told = F.array_join(F.transform("conversations", lambda t: F.concat(t["from"], F.lit(">"), t["value"])), "\x1e")
    return t.select(F.col("_pos").alias("conv_id"), F.md5(told).alias("conversations_md5"))


def export_openai_messages(spark, sf_dir):
    t = mapping.project(chats(spark, sf_dir), "openai")
    told = F.array_join(F.transform("messages", lambda t: F.concat(t["role"], F.lit("|"), t["content"])), "\x1e")
    return t.select(F.col("_pos").alias("conv_id"), F.md5(told).alias("messages_md5"))


def _chat_sql(sep: str, name: str) -> str:
    return f"""SELECT conv_id, md5(string_agg(coalesce(role, 'user') || '{sep}' || coalesce(text, ''), chr(30) ORDER BY turn)) AS {name}
FROM conversations GROUP BY conv_id HAVING count(*) >= 2"""


def _preferences(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id").filter("source IS NOT NULL")
    best = planning.best_and_worst(joined, "source", "quality", "text", "doc_id")
    return as_samples(best.select(F.col("source").alias("instruction"), "chosen", "rejected", "chosen_score", "rejected_score"))


def export_dpo_pairs(spark, sf_dir):
    return mapping.project(_preferences(spark, sf_dir), "dpo").select("prompt", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


_EVENTS = "SELECT event_id, event_type AS instruction, props AS info FROM events"


def _verifiable(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("question"), F.col("props").alias("info"), F.col("event_id").alias("_pos"))
    return mapping.map_columns(t)


def export_rlvr_info(spark, sf_dir):
    return mapping.project(_verifiable(spark, sf_dir), "rlvr").select(F.col("_pos").alias("event_id"), "question", "info")


def export_pretrain(spark, sf_dir):
    return mapping.project(documents(spark, sf_dir), "pretrain").select(F.col("_pos").alias("doc_id"), "text")


def _validated(samples: DataFrame, layout: str) -> DataFrame:
    from millrace.operators import reports

    return reports.validated(samples, layout).groupBy(F.coalesce("why", F.lit("ok")).alias("why")).agg(F.count("*").alias("n"))


def validate_sft(spark, sf_dir):
    return _validated(pairs(spark, sf_dir), "sft")


def validate_chat(spark, sf_dir):
    return _validated(chats(spark, sf_dir), "chat")


def validate_dpo(spark, sf_dir):
    return _validated(_preferences(spark, sf_dir), "dpo")


def validate_rlvr(spark, sf_dir):
    return _validated(_verifiable(spark, sf_dir), "rlvr")


def validate_pretrain(spark, sf_dir):
    return _validated(documents(spark, sf_dir), "pretrain")


def validation_errors(spark, sf_dir):
    """The first 20 documents that don't fit the plain-text layout: the report's feature."""
    from millrace.operators import reports

    bad = reports.validated(documents(spark, sf_dir), "pretrain").filter("why IS NOT NULL").orderBy("_pos").limit(20)
    return bad.select(F.col("_pos").alias("doc_id"), "why")


_DPO = """b AS (SELECT source, arg_max(text, (quality, -doc_id)) AS chosen, arg_min(text, (quality, doc_id)) AS rejected, max(quality) AS hi, min(quality) AS lo
  FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY source HAVING max(quality) > min(quality))"""
_PRE_WHY = f"CASE WHEN coalesce(text, '') = '' THEN 'no text' WHEN length({stripped('text')}) < 50 THEN 'text under 50 characters' END"
_SFT_WHY = f"CASE WHEN coalesce(instruction, '') = '' THEN 'no instruction' WHEN coalesce(response, '') = '' THEN 'no response' WHEN length({stripped('response')}) < 10 THEN 'response under 10 characters' END"

QUERIES = {
    f.__name__: f
    for f in (
        map_documents_to_samples, map_conversations_to_turns, export_sft_pairs, export_chat_sharegpt, export_openai_messages, export_dpo_pairs, export_rlvr_info, export_pretrain,
        validate_sft, validate_chat, validate_dpo, validate_rlvr, validate_pretrain, validation_errors,
    )
}
SQL = {
    "map_documents_to_samples": "SELECT doc_id, text, lang AS language, source AS source_id, n_chars FROM documents",
    "map_conversations_to_turns": "SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || '=' || text, chr(30) ORDER BY turn)) AS turns_md5 FROM conversations GROUP BY conv_id",
    "export_sft_pairs": f"WITH {PAIRS_SQL} SELECT pos, instruction, response FROM p WHERE ({_SFT_WHY}) IS NULL",
    "export_chat_sharegpt": _chat_sql(">", "conversations_md5"),
    "export_openai_messages": _chat_sql("|", "messages_md5"),
    "export_dpo_pairs": f"WITH {_DPO} SELECT source AS prompt, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5 FROM b WHERE source <> '' AND chosen <> '' AND rejected <> '' AND chosen <> rejected",
    "export_rlvr_info": f"SELECT event_id, instruction AS question, info FROM ({_EVENTS}) WHERE coalesce(instruction, '') <> '' AND info IS NOT NULL",
    "export_pretrain": f"SELECT doc_id, text FROM documents WHERE ({_PRE_WHY}) IS NULL",
    "validate_sft": f"WITH {PAIRS_SQL} SELECT coalesce({_SFT_WHY}, 'ok') AS why, count(*) AS n FROM p GROUP BY 1",
    "validate_chat": "SELECT CASE WHEN n < 2 THEN 'fewer than 2 turns' ELSE 'ok' END AS why, count(*) AS n FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY 1",
    "validate_dpo": f"WITH {_DPO} SELECT CASE WHEN source = '' THEN 'no prompt' WHEN coalesce(chosen, '') = '' THEN 'no chosen answer' WHEN coalesce(rejected, '') = '' THEN 'no rejected answer' WHEN chosen = rejected THEN 'chosen equals rejected' ELSE 'ok' END AS why, count(*) AS n FROM b GROUP BY 1",
    "validate_rlvr": f"SELECT CASE WHEN coalesce(instruction, '') = '' THEN 'no question' WHEN info IS NULL THEN 'no info' ELSE 'ok' END AS why, count(*) AS n FROM ({_EVENTS}) GROUP BY 1",
    "validate_pretrain": f"SELECT coalesce({_PRE_WHY}, 'ok') AS why, count(*) AS n FROM documents GROUP BY 1",
    "validation_errors": f"SELECT doc_id, {_PRE_WHY} AS why FROM documents WHERE ({_PRE_WHY}) IS NOT NULL ORDER BY doc_id LIMIT 20",
}
