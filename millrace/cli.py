"""Command line: generate, inspect, validate, convert, recipes."""

from __future__ import annotations

import argparse
import json
import os
import sys
from functools import partial

from pyspark.sql import SparkSession

from millrace import config as C
from millrace import resources
from millrace.functions.backends import DeterministicBackend, HttpBackend
from millrace.functions.text import content
from millrace.operators import filters, generators, mapping, reports, transformers
from millrace.pipeline import Pipeline
from millrace.sources import dataset, jsonl


def session() -> SparkSession:
    return SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def backend(config: dict):
    llm = config["llm"]
    if not llm["base_url"]:
        return DeterministicBackend()
    return HttpBackend(llm["base_url"], llm["model"], llm["response_model"], llm["embedding_model"], os.environ.get(llm["api_key_env"], ""), llm["max_concurrent"], llm["max_retries"], llm["timeout"], config["responses"]["max_tokens"])


def build(spark: SparkSession, config: dict) -> Pipeline:
    """The pipeline that settings ask for."""
    model, seed = backend(config), config["seed"] or 0
    method, domain, languages = config["method"], config["domain"], tuple(config["languages"])
    if method == "topic_tree":
        t = config["topic_tree"]
        source = generators.TopicTree(model, domain, t["max_depth"], t["max_attribute_count"], tuple(config["task_types"]), languages, tuple(config["difficulty"]), seed).generate
    elif method == "persona":
        p = config["persona"]
        texts = jsonl.corpus(spark, p["source"], p["text_field"], p["max_personas"], seed)
        source = generators.Personas(model, texts, "text", "_pos", domain, languages, p["max_personas"], p["expansion_rounds"], p["dedup_threshold"], seed).generate
    elif method == "seed_dataset":
        where = config.get("source") or config.get("seed_dataset", {}).get("source")
        source = generators.SeedDataset(model, dataset.load(spark, where).df, seed=seed).generate
    elif method == "pretrain_rewriter":
        texts = jsonl.corpus(spark, config.get("source") or config["persona"]["source"])
        source = lambda s, n, k: mapping.map_columns(texts).orderBy("_pos").offset(n * k).limit(n)
    else:
        raise ValueError(f"unknown method {method!r}")
    over = config["prompts"]
    steps = []
    if config["evolve"]["enabled"]:
        steps.append(partial(transformers.evolve, backend=model, strategies=config["evolve"]["strategies"], rounds=config["evolve"]["rounds"], seed=seed, overrides=over))
    if config["responses"]["enabled"] and method != "pretrain_rewriter":
        steps.append(partial(transformers.respond, backend=model, use_cot=config["responses"]["use_cot"], overrides=over))
    if method == "pretrain_rewriter":
        steps.append(partial(transformers.rewrite, backend=model, overrides=over))
    f, checks = config["filters"], []
    if f["safety"]["enabled"]:
        checks.append(partial(filters.safety, words=f["safety"]["blocklist_words"], preset=f["safety"]["cultural_context"]))
        if f["safety"]["cultural_context"] and config["llm"]["base_url"]:
            checks.append(partial(transformers.cultural_check, backend=model, context=f["safety"]["cultural_context"], text=content(), overrides=over))
    if f["quality"]["enabled"]:
        checks += [partial(transformers.judge, backend=model, overrides=over), partial(filters.quality_threshold, least=f["quality"]["min_score"])]
    if f["template_collapse"]["enabled"]:
        t = f["template_collapse"]
        checks.append(partial(filters.collapse, action=t["action"], length=t["prefix_length"], most=t["max_repeat"]))
    return Pipeline(source, steps, checks, config["over_generate_factor"], check_empty=method != "pretrain_rewriter")


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    g = commands.add_parser("generate")
    g.add_argument("--recipe")
    g.add_argument("--config")
    g.add_argument("--n", type=int)
    g.add_argument("--seed", type=int)
    g.add_argument("--output")
    g.add_argument("--resume", action="store_true")
    g.add_argument("--dry-run", action="store_true")
    g.add_argument("pairs", nargs="*", help="settings as a.b=value")
    i = commands.add_parser("inspect")
    i.add_argument("path")
    i.add_argument("--json", action="store_true")
    i.add_argument("--samples", type=int, default=3)
    v = commands.add_parser("validate")
    v.add_argument("path")
    v.add_argument("--format", default="sft")
    v.add_argument("--strict", action="store_true")
    c = commands.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--format", default="sft")
    r = commands.add_parser("recipes")
    r.add_argument("action", choices=["list", "show", "export"])
    r.add_argument("name", nargs="?")
    a = top.parse_args(argv)
    if a.command == "recipes":
        if a.action == "list":
            print("\n".join(sorted(resources.RECIPES)))
        else:
            text = json.dumps(resources.recipe(a.name), indent=2)
            if a.action == "export":
                with open(f"{a.name}.json", "w", encoding="utf-8") as f:
                    f.write(text)
            print(text)
        return 0
    if a.command == "generate":
        pairs = dict(p.split("=", 1) for p in a.pairs)
        told = {k: C.value(x) for k, x in pairs.items()} | {k: x for k, x in (("n", a.n), ("seed", a.seed), ("output", a.output)) if x is not None}
        config = C.load(a.recipe, a.config, told)
        if a.dry_run:
            print(json.dumps(reports.estimate(config["n"], config["over_generate_factor"], config["evolve"]["enabled"], config["responses"]["enabled"], config["filters"]["quality"]["enabled"])))
            return 0
        spark = session()
        work = config["output"] + ".run"
        done = build(spark, config).run(spark, config["n"], work, {k: x for k, x in config.items() if k != "n"}, a.resume)
        rows = Pipeline.output(spark, work)
        order = rows.orderBy("round", "_pos").drop("round", "_usage", "_pos")
        jsonl.write_file(order, config["output"], None)
        print(json.dumps(done))
        return 0
    spark = session()
    if a.command == "inspect":
        data = dataset.load(spark, a.path)
        size = os.path.getsize(a.path)
        print(json.dumps(data.inspect() | {"file_size_bytes": size}, indent=2) if a.json else reports.described(data.df, a.samples, size, os.path.basename(a.path)))
        return 0
    if a.command == "validate":
        told = dataset.load(spark, a.path).validate(a.format, a.strict)
        print(json.dumps(told, indent=2))
        return int(told["failed"] > 0)
    print(dataset.convert(spark, a.source, a.target, a.format))
    return 0


if __name__ == "__main__":
    sys.exit(main())
