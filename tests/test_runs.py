"""Generators, transformers, the quota pipeline, the stream, the endpoint and the command line."""

import json
import threading
from collections import Counter
from functools import partial
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from millrace import cli, config, registry, resources
from millrace.functions.backends import DeterministicBackend, HttpBackend, Limiter
from millrace.operators import filters, generators, planning, transformers
from millrace.pipeline import CheckpointError, ConfigChanged, Pipeline
from millrace.schema import as_samples
from millrace.sources import jsonl
from millrace.streaming import curate
from tests.test_filters import _stages


def source(spark, n, round_):
    k = F.col("id") + round_ * 1000
    return as_samples(spark.range(n).select(F.concat(F.lit("question "), k.cast("string")).alias("instruction"), F.concat(F.lit("a long answer "), k.cast("string")).alias("response"), (F.pmod(F.xxhash64(k), F.lit(10)) / 10.0).alias("quality_score"), F.col("id").alias("_pos")))


def test_quota(spark, tmp_path):
    p = Pipeline(source, [], [partial(filters.quality_threshold, least=0.5)])
    done = p.run(spark, 30, str(tmp_path / "out"), {"a": 1})
    assert done["written"] == 30 and Pipeline.output(spark, str(tmp_path / "out")).count() == 30
    assert done["counts"]["low_quality"] > 0 and done["rounds"] > 1
    assert p.run(spark, 30, str(tmp_path / "out"), {"a": 1}, resume=True) == done
    told = Pipeline.summary(spark, str(tmp_path / "out"))
    assert told["written"] == 30 and told["rejected"] == {"low_quality": done["counts"]["low_quality"]} and 0 < told["kept"] < 1 and told["tokens"] == {}
    with pytest.raises(CheckpointError):
        Pipeline.summary(spark, str(tmp_path))
    with pytest.raises(ConfigChanged):
        p.run(spark, 30, str(tmp_path / "out"), {"a": 2}, resume=True)
    (tmp_path / "out" / "state.json").write_text("{")
    with pytest.raises(CheckpointError):
        p.run(spark, 30, str(tmp_path / "out"), {"a": 1}, resume=True)


def test_jsonl_writer(spark, tmp_path):
    path = str(tmp_path / "out.jsonl")
    rows = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    w = jsonl.JsonlWriter(spark, path)
    assert w.count == 0 and w.append(rows) == 2 and w.append(rows) == 4
    again = jsonl.JsonlWriter(spark, path, resume=True)
    assert again.count == 4 and again.append(rows.limit(1)) == 5
    assert sorted(r.value for r in spark.read.text(path).collect())[-1] == '{"a":2,"b":null}'
    assert jsonl.JsonlWriter(spark, path).count == 0 and jsonl.JsonlWriter(spark, path, resume=True).count == 0


def test_quota_of_nothing(spark, tmp_path):
    p = Pipeline(lambda s, n, k: source(s, 0, k))
    assert p.run(spark, 5, str(tmp_path / "o"))["written"] == 0


def test_empty_response(spark):
    df = as_samples(spark.createDataFrame([("q", None, 0), ("q", "", 1), ("q", "a", 2), (None, None, 3)], "instruction string, response string, _pos bigint"))
    assert [r.reject_reason for r in filters.empty_response(df).orderBy("_pos").collect()] == ["empty_response", "empty_response", None, None]


def test_transformers(spark):
    model = DeterministicBackend()
    df = source(spark, 6, 0).withColumn("response", F.when(F.col("_pos") > 2, F.col("response")))
    done = transformers.respond(df, model).orderBy("_pos").collect()
    assert all(r.response for r in done) and [r.generation_model for r in done] == ["deterministic"] * 3 + [None] * 3
    two = transformers.evolve(df, model, ["deepen", "rephrase"], rounds=2, seed=1).collect()
    assert all(len(r.evolution_history) == 2 and set(r.evolution_history) <= {"deepen", "rephrase"} for r in two)
    with pytest.raises(ValueError):
        transformers.evolve(df, model, ["nonsense"])
    texts = as_samples(spark.createDataFrame([(t, i) for i, t in enumerate(["a", None, "b", "", "c", "d", "e"])], "text string, _pos bigint"))
    done = transformers.rewrite(texts, model).orderBy("_pos").collect()
    assert [json.loads(r.extra).get("pretrain_strategy") for r in done] == ["faq", None, "math", None, "table", "tutorial", "faq"]
    used = Pipeline.usage(transformers.judge(source(spark, 4, 0), model))
    assert used.count() == 4 and used.filter("stage = 'quality_filter' AND prompt_tokens > 0").count() == 4


class Told:
    """Replies by stage, the same for every prompt; a function of the number of the call where it is one."""

    def __init__(self, **replies):
        self.replies, self.calls = {k.replace("_to_", "."): v for k, v in replies.items()}, Counter()

    def complete(self, df, prompt, stage, out="reply", role="model"):
        self.calls[stage] += 1
        told = self.replies[stage]
        content = F.lit(told(self.calls[stage]) if callable(told) else told)
        return df.withColumn(out, F.struct(F.when(prompt.isNotNull(), content).alias("content"), F.lit(None).cast("string").alias("error")))


KINDS = '{"dimension": "kind", "attributes": {"x": [0], "y": [1]}}'


def _tree(spark, **settings):
    replies = {"topic_tree": '["a", "b"]', "topic_tree_to_dimension": KINDS, "topic_tree_to_expand": "null", "topic_tree_to_instructions": '["one", "two"]'} | {k: settings.pop(k) for k in list(settings) if k.startswith("topic_tree")}
    tree = generators.TopicTree(Told(**replies), "d", **({"depth": 1, "task_types": ("qa",), "difficulty": (1, 1)} | settings))
    return tree, tree.nodes(spark).filter("depth > 0").orderBy("node_id").collect()


@pytest.mark.parametrize("reply", [KINDS, "```json\n" + KINDS + "\n```", "Well: " + KINDS + " so.", KINDS[:-2]])
def test_tree_reads_replies(spark, reply):
    """Whole, fenced, talked around and cut off objects; a dimension is used once, so the next level stays without one."""
    tree, nodes = _tree(spark, topic_tree_to_dimension=reply, depth=3)
    assert [(r.node_id, [tuple(x) for x in r.path], r.open) for r in nodes] == [("0.0", [("kind", "x")], False), ("0.1", [("kind", "y")], False)]
    assert tree.backend.calls["topic_tree.dimension"] == 1 + tree.attempts
    assert sorted(r.topic for r in tree.generate(spark, 2).collect()) == ["x", "x", "y", "y"]


def test_tree_refuses(spark):
    for bad in ('{"dimension": "k", "attributes": {"x": [0, 1], "y": [1]}}', '{"dimension": "k", "attributes": {"x": [0]}}', '["x", "y"]', "no", '{"attributes": {"x": [0], "y": [1]}}'):
        tree, nodes = _tree(spark, topic_tree_to_dimension=bad)
        assert not nodes and tree.backend.calls["topic_tree.dimension"] == 5
    assert not _tree(spark, topic_tree="no list")[1] and not _tree(spark, topic_tree="[]")[1]
    tree, nodes = _tree(spark, topic_tree_to_dimension=lambda k: "no" if k < 3 else KINDS)
    assert len(nodes) == 2 and tree.backend.calls["topic_tree.dimension"] == 3
    assert [r.topic for r in _tree(spark, topic_tree="no")[0].generate(spark, 1).collect()] == ["d", "d"]


def test_tree_completes(spark):
    more = lambda word: lambda k: f'{{"attributes": ["x", "n{k}"], "completeness": "{word}"}}'
    names = lambda nodes: [r.path[-1].attribute_value for r in nodes]
    assert names(_tree(spark, topic_tree_to_expand='["z", "x"]')[1]) == ["x", "y", "z"]
    assert names(_tree(spark, topic_tree_to_expand=more("complete"))[1]) == ["x", "y", "n1"]
    assert names(_tree(spark, topic_tree_to_expand=lambda k: more("infinite")(min(k, 3)))[1]) == ["x", "y", "n1", "n2", "n3"]
    tree, nodes = _tree(spark, topic_tree_to_expand=more("infinite"), most=4)
    assert names(nodes) == ["x", "y", "n1", "n2"] and tree.backend.calls["topic_tree.expand"] == 2
    tree, nodes = _tree(spark, topic_tree_to_expand='["p", "q", "r", "s"]', most=3)
    assert [(r.open, r.dimension, r.attributes, r.path) for r in nodes] == [(True, "kind", ["x", "y", "p"], [])]
    made = tree.generate(spark, 40)
    assert {r.topic for r in made.collect()} == {"x", "y", "p"} and {r.topic for r in made.collect()} == {r.topic for r in tree.generate(spark, 40).collect()}


def test_generators(spark):
    model = DeterministicBackend(items=2)
    tree = generators.TopicTree(model, "d", depth=2, task_types=("qa",), difficulty=(1, 2))
    by = {r.node_id: r for r in tree.nodes(spark).collect()}
    assert len(by) > 6 and all(r.parent_id is None or by[r.parent_id].depth == r.depth - 1 for r in by.values())
    rows = tree.generate(spark, 11).orderBy("_pos").collect()
    assert len(rows) == 11 and {r.difficulty for r in rows} == {1, 2} and any(" > " in r.topic for r in rows)
    seeds = generators.SeedDataset(DeterministicBackend(), source(spark, 9, 0))
    made = seeds.generate(spark, 7)
    assert made.count() == 7 and made.filter("source_id = 'seed_dataset'").count() == 7
    corpus = spark.createDataFrame([(i, f"text number {i}") for i in range(4)] + [(9, " ")], "_pos bigint, text string")
    people = generators.Personas(model, corpus, rounds=1, most=10)
    assert people.extracted().count() == 4
    assert people.generate(spark, 5).count() == 5


def test_draws_dont_depend_on_partitions(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    one = {tuple(r) for r in planning.subsets(df.limit(5), "k", df.select(F.col("k").alias("s")).repartition(1), "s", 3, 1).collect()}
    many = {tuple(r) for r in planning.subsets(df.limit(5).repartition(3), "k", df.select(F.col("k").alias("s")).repartition(7), "s", 3, 1).collect()}
    assert one == many and len(one) == 15


def test_stream(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select(F.concat(F.lit("text "), F.when(F.col("id") % 4 == 0, "hell").otherwise("fine")).alias("text"), F.col("id").alias("_pos")).write.parquet(str(tmp_path / "in" / str(k)))
    stage = lambda d: filters.safety(as_samples(d), preset="family_friendly")
    q = curate.curate(curate.read_stream(spark, str(tmp_path / "in" / "*"), "text string, _pos bigint", files=1), stage, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.reason: r.n for r in curate.counts(spark, str(tmp_path / "out")).collect()} == {"passed": 22, "safety_blocked": 8}
    assert curate.kept(spark, str(tmp_path / "out")).count() == 22


@pytest.fixture
def endpoint():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(self.path)
            if len(calls) == 1:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            if self.path.endswith("/embeddings"):
                told = {"data": [{"index": k, "embedding": [1.0, float(len(x))]} for k, x in reversed(list(enumerate(body["input"])))]}
            elif "bad" in body["messages"][0]["content"]:
                self.send_response(404)
                self.end_headers()
                return
            else:
                told = {"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}, "model": body["model"]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(told).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_endpoint(spark, endpoint):
    model = HttpBackend(endpoint, "m", embedding_model="e", concurrent=2)
    df = spark.createDataFrame([("a",), ("b",), ("bad",), (None,)], "p string").coalesce(1)
    got = {r.p: r.reply for r in model.complete(df, F.col("p"), "stage").collect()}
    assert got["a"].content == "A" and got["a"].completion_tokens == 4 and got["bad"].content is None and "404" in got["bad"].error and got[None] is None
    assert [r.embedding for r in model.embed(df.filter("p = 'a'"), F.col("p")).collect()] == [[1.0, 1.0]]
    many = spark.createDataFrame([(k, "x" * k if k % 7 else None) for k in range(230)], "k int, p string").coalesce(1)
    assert all(r.embedding == ([1.0, float(r.k)] if r.k % 7 else None) for r in model.embed(many, F.col("p")).collect())


def test_limiter():
    x = Limiter(8, patience=1)
    x.refused(0)
    assert x.limit == 4
    for _ in range(5):
        x.success()
    assert x.limit == 5
    with pytest.raises(TimeoutError):
        x.waited = 2
        x.refused(0)


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"n": 7, "filters": {"quality": {"min_score": 0.2}}}')
    c = config.load("sft", str(tmp_path / "c.json"), {"seed": 3, "evolve.enabled": True})
    assert (c["n"], c["seed"], c["evolve"]["enabled"], c["filters"]["quality"]) == (7, 3, True, {"enabled": True, "min_score": 0.2})
    assert [config.value(x) for x in ("yes", "No", "3", "0.5", "x")] == [True, False, 3, 0.5, "x"]
    with pytest.raises(KeyError):
        resources.recipe("nope")
    with pytest.raises(KeyError, match="b"):
        resources.render("{{a}} {{b}}", a=1)
    assert resources.render("{{a}}-{{a}}", a="{{b}}") == "{{b}}-{{b}}"

    @registry.register("filter", "mine")
    def mine(df):
        return df

    assert registry.get("filter", "mine") is mine
    with pytest.raises(KeyError):
        registry.get("filter", "other")


def test_command_line(spark, tmp_path, capsys):
    out = tmp_path / "o.jsonl"
    assert cli.main(["generate", "--n", "6", "--output", str(out), "topic_tree.max_depth=1", "filters.safety.enabled=no"]) == 0
    assert sum(1 for _ in out.open()) == 6
    assert cli.main(["inspect", str(out), "--json"]) == 0
    assert cli.main(["validate", str(out), "--format", "sft"]) == 0
    assert cli.main(["convert", str(out), str(tmp_path / "c.jsonl"), "--format", "sft"]) == 0
    assert cli.main(["recipes", "list"]) == 0
    assert cli.main(["generate", "--dry-run", "--n", "10"]) == 0
    assert '"calls": 20' in capsys.readouterr().out


def test_jsonl_file_order(spark, tmp_path):
    assert jsonl.write_file(source(spark, 20, 0).select("_pos", "instruction"), str(tmp_path / "f.jsonl")) == 20
    assert [json.loads(x)["instruction"] for x in (tmp_path / "f.jsonl").open()][:3] == ["question 0", "question 1", "question 2"]


def test_file_is_written_without_its_rows_in_the_driver(spark, tmp_path):
    text = F.concat(*[F.md5(F.concat_ws("-", F.col("id"), F.lit(k))) for k in range(32)])
    df = spark.range(2000).select((1999 - F.col("id")).alias("_pos"), text.alias("instruction"), F.when(F.col("id") % 2 == 0, "\u00e9\u2028\n").alias("more")).repartition(7)
    before = _stages(spark)
    assert jsonl.write_file(df, str(tmp_path / "deep" / "f.jsonl"), nulls=False) == 2000
    assert sum(x.resultSize() for k, x in _stages(spark).items() if k not in before) < 300_000
    with (tmp_path / "deep" / "f.jsonl").open(encoding="utf-8", newline="\n") as f:
        got = [json.loads(x) for x in f]
    assert got == [{"instruction": r.instruction} | ({"more": r.more} if r.more else {}) for r in df.orderBy("_pos").collect()]
    assert jsonl.write_file(df.limit(0), str(tmp_path / "none.jsonl")) == 0 and (tmp_path / "none.jsonl").read_bytes() == b""
