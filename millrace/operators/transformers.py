"""Stages that rewrite samples through a backend. Rows that aren't eligible are left alone and not sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import resources
from millrace.functions.backends import Backend
from millrace.functions.text import json_value, judge_score, strip
from millrace.operators import planning
from millrace.operators.dedup import settled
from millrace.operators.filters import _with_reason
from millrace.schema import truthy

EVOLUTIONS = ("deepen", "broaden", "concretize", "rephrase", "complicate", "switch_task")
REWRITES = ("faq", "math", "table", "tutorial")


def _usage(df: DataFrame, stage: str, reply: Column) -> DataFrame:
    """Adds the call's tokens to `_usage`, an array of (stage, prompt_tokens, completion_tokens)."""
    one = F.array(F.struct(F.lit(stage).alias("stage"), F.coalesce(reply["prompt_tokens"], F.lit(0).cast("bigint")).alias("prompt_tokens"), F.coalesce(reply["completion_tokens"], F.lit(0).cast("bigint")).alias("completion_tokens")))
    more = F.when(reply.isNotNull(), one).otherwise(F.expr("cast(array() as array<struct<stage:string,prompt_tokens:bigint,completion_tokens:bigint>>)"))
    return df.withColumn("_usage", F.concat("_usage", more) if "_usage" in df.columns else more)


def _called(df: DataFrame, backend: Backend, prompt: Column, stage: str, role: str = "model") -> DataFrame:
    done = settled(backend.complete(df, prompt, stage, "_reply", role))
    return _usage(done, stage, F.col("_reply"))


def evolve(df: DataFrame, backend: Backend, strategies: list[str] | None = None, rounds: int = 1, seed: int = 0, overrides: dict[str, str] | None = None) -> DataFrame:
    """Rewrites instructions by a drawn strategy in each round; blank or failed replies leave no trace."""
    strategies = list(strategies or EVOLUTIONS)
    unknown = sorted(set(strategies) - set(EVOLUTIONS))
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(unknown)}")
    for k in range(rounds):
        df = df.withColumn("_strategy", planning.strategy(strategies, seed, F.col("id"), k))
        prompt = None
        for s in strategies:
            text = resources.render(resources.template(f"transformers.evol_{s}", overrides), instruction=F.col("instruction"))
            prompt = F.when(F.col("_strategy") == s, text) if prompt is None else prompt.when(F.col("_strategy") == s, text)
        done = _called(df, backend, F.when(truthy("instruction"), prompt), "evol_instruct")
        new = strip(F.col("_reply.content"))
        good = F.coalesce(new != "", F.lit(False))
        df = done.withColumns({"instruction": F.when(good, new).otherwise(F.col("instruction")), "evolution_history": F.when(good, F.array_append("evolution_history", F.col("_strategy"))).otherwise(F.col("evolution_history"))}).drop("_reply", "_strategy")
    return df


def respond(df: DataFrame, backend: Backend, use_cot: bool = False, system_prompt: str = "", overrides: dict[str, str] | None = None) -> DataFrame:
    """Answers instructions without a response."""
    text = resources.render(resources.template("transformers.response_generator", overrides), system_prompt=F.lit(system_prompt), cot="Think step by step." if use_cot else "", instruction=F.col("instruction"))
    done = _called(df, backend, F.when(truthy("instruction") & ~truthy("response"), text), "response_generator", "response_model")
    new = strip(F.col("_reply.content"))
    good = F.coalesce(new != "", F.lit(False))
    return done.withColumns({"response": F.when(good, new).otherwise(F.col("response")), "generation_model": F.when(good, F.col("_reply.model")).otherwise(F.col("generation_model"))}).drop("_reply")


def rewrite(df: DataFrame, backend: Backend, strategies: list[str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """Rewrites texts, strategies in turn over the rows that have one; the original goes to extra."""
    strategies = list(strategies or REWRITES)
    turned = planning.positions_in_turn(df, truthy("text"))
    turned = turned.withColumn("_strategy", planning.in_turn(strategies, F.col("_turn")))
    prompt = None
    for s in strategies:
        text = resources.render(resources.template(f"pretrain.{s}", overrides), text=F.col("text"))
        prompt = F.when(F.col("_strategy") == s, text) if prompt is None else prompt.when(F.col("_strategy") == s, text)
    done = _called(turned, backend, prompt, "pretrain_rewriter")
    new = strip(F.col("_reply.content"))
    good = F.coalesce(new != "", F.lit(False))
    extra = F.map_filter(F.coalesce(F.from_json("extra", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("original_text", "pretrain_strategy"))
    noted = F.to_json(F.map_concat(extra, F.create_map(F.lit("original_text"), F.col("text"), F.lit("pretrain_strategy"), F.col("_strategy"))))
    return done.withColumns({"extra": F.when(good, noted).otherwise(F.col("extra")), "text": F.when(good, new).otherwise(F.col("text"))}).drop("_reply", "_strategy", "_turn")


def judge(df: DataFrame, backend: Backend, overrides: dict[str, str] | None = None) -> DataFrame:
    """Scores samples with an instruction and a response; failed calls leave no score."""
    text = resources.render(resources.template("filters.quality_judge", overrides), instruction=F.col("instruction"), response=F.col("response"))
    done = _called(df, backend, F.when(truthy("instruction") & truthy("response"), text), "quality_filter")
    told = F.when(F.col("_reply.error").isNull(), judge_score(F.col("_reply.content")))
    return done.withColumn("quality_score", F.coalesce(told, F.col("quality_score"))).drop("_reply")


def cultural_check(df: DataFrame, backend: Backend, context: str, text: Column, overrides: dict[str, str] | None = None) -> DataFrame:
    """Rejects samples that the backend finds unsafe for a context; unreadable replies and failures pass."""
    told = resources.preset(context)["custom_instruction"]
    prompt = resources.render(resources.template("filters.safety_check", overrides), context=context, custom_instruction=told, text=text)
    done = _called(df, backend, prompt, "safety_filter")
    reply = F.col("_reply.content")
    v = json_value(reply)
    safe = F.try_variant_get(v, "$.safe", "string")
    missing = F.try_variant_get(v, "$.safe", "variant").isNull()
    object_ = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    loose = F.regexp_extract(F.lower(reply), r'"safe": ?(true|false)', 1) == "false"
    unsafe = F.when(object_, ~missing & F.coalesce(F.lower(safe).isin("false", "0", "0.0", ""), F.lit(True))).otherwise(loose)
    return _with_reason(done, F.coalesce(unsafe, F.lit(False)), "safety_blocked").drop("_reply")
