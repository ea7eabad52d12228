"""Queries of sources, sinks, layouts, settings, prompts and repaired replies, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import config, pipeline, resources
from millrace.functions import text as X
from millrace.functions.backends import DeterministicBackend
from millrace.operators import dedup, filters, mapping, reports, transformers
from millrace.plans.mapping_queries import PAIRS_SQL, documents, pairs, stripped, table
from millrace.schema import as_samples, has_content
from millrace.sources import dataset, jsonl

_DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def jsonl_round_trip(spark, sf_dir):
    """documents written as JSON Lines and read back, with bad lines refused."""
    docs = table(spark, sf_dir, "documents").select(_DOCS)
    path = dedup.shared_folder(spark, "jsonl")
    jsonl.write_jsonl(docs, path, "overwrite")
    return jsonl.read_jsonl(spark, path, docs.schema).select(_DOCS)


def jsonl_resumed(spark, sf_dir):
    """Output that is begun afresh, left, and taken up again: rows and the number that was there on resuming."""
    docs = table(spark, sf_dir, "documents").select(_DOCS)
    path = dedup.shared_folder(spark, "resumed")
    jsonl.JsonlWriter(spark, path).append(docs.limit(3))
    first = jsonl.JsonlWriter(spark, path)
    first.append(docs.filter("doc_id % 2 = 0"))
    again = jsonl.JsonlWriter(spark, path, resume=True)
    there = again.count
    again.append(docs.filter("doc_id % 2 = 1 OR doc_id IS NULL"))
    return jsonl.read(spark, path, "jsonl", docs.schema).select("doc_id", "text", F.lit(there).cast("long").alias("there"))


def _file_round_trip(kind, spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")
    path = dedup.shared_folder(spark, kind)
    jsonl.write(docs, path, kind)
    return jsonl.read(spark, path, kind, docs.schema)


def _loaded(spark, records: DataFrame, column_map: dict | None = None) -> DataFrame:
    """Records by way of a JSON Lines folder and the loader."""
    path = dedup.shared_folder(spark, "load")
    jsonl.write_jsonl(records, path, "overwrite")
    return dataset.load(spark, path, column_map).df


def _id():
    return F.get_json_object("extra", "$.doc_id").cast("long").alias("doc_id")


def load_alpaca(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.lit("Continue this.").alias("instruction"), F.when(F.col("doc_id") % 3 > 0, F.substring("text", 1, 20)).otherwise("").alias("input"), F.coalesce("lang", F.lit("")).alias("output"))
    return _loaded(spark, t).select(_id(), "instruction", "response")


def _turns_text() -> list:
    return [_id(), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("="), t["content"])), "|").alias("told")]


def load_sharegpt(spark, sf_dir):
    say = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    t = table(spark, sf_dir, "documents").select("doc_id", F.array(say("system", F.lit("s")), say("human", F.col("source")), say("gpt", F.col("lang")), say(None, F.lit("x"))).alias("conversations"))
    return _loaded(spark, t).select(*_turns_text())


def load_openai(spark, sf_dir):
    say = lambda who, what: F.struct(F.lit(who).alias("role"), what.alias("content"))
    t = table(spark, sf_dir, "documents").select("doc_id", F.array(say("user", F.col("source")), say("assistant", F.col("lang"))).alias("messages"))
    return _loaded(spark, t).select(*_turns_text())


def load_preferences(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("prompt"), F.concat(F.lit("good "), "lang").alias("chosen"), F.lit("bad").alias("rejected"))
    return _loaded(spark, t).select(_id(), "instruction", "chosen", "rejected")


def load_questions(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("question"), F.col("lang").alias("answer"))
    return _loaded(spark, t).select(_id(), "instruction", "response")


def load_verifiable(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("question"), F.struct(F.lit(1).alias("tests"), F.col("event_type").alias("kind")).alias("info"))
    rows = _loaded(spark, t)
    return rows.select(F.get_json_object("extra", "$.event_id").cast("long").alias("event_id"), "instruction", F.get_json_object("info", "$.kind").alias("kind"))


def load_pretrain(spark, sf_dir):
    return _loaded(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select(_id(), "text")


def map_user_columns(spark, sf_dir):
    """A user's map comes before everything and switches detection off; later pairs to one field win."""
    t = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = mapping.map_columns(t, {"lang": "instruction", "text": "response", "source": "instruction"}, "doc_id")
    return rows.select(F.col("_pos").alias("doc_id"), "instruction", "response", "text", F.get_json_object("extra", "$.lang").alias("lang"))


def map_direct_fields(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"), F.col("lang").alias("language"), F.col("n_chars").alias("difficulty"), F.lit("x").alias("quality_score"))
    return mapping.map_columns(t, pos="doc_id").select(F.col("_pos").alias("doc_id"), "topic", "language", "difficulty", "quality_score")


def map_synonyms(spark, sf_dir):
    """The first column in order wins a field; later synonyms are used up."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query"), F.lit("late").alias("user"), F.col("lang").alias("reply"), F.lit("p").alias("preferred"), F.lit("n").alias("negative"))
    rows = mapping.map_columns(t, pos="doc_id")
    return rows.select(F.col("_pos").alias("doc_id"), "instruction", "response", "chosen", "rejected", "extra")


def map_overflow(spark, sf_dir):
    """What no field takes goes to extra, beside what extra holds already."""
    t = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit('{"a":"1"}').alias("extra"), F.col("n_chars"), F.col("source").alias("origin"))
    rows = mapping.map_columns(t, pos="doc_id")
    at = lambda k: F.get_json_object("extra", f"$.{k}")
    return rows.select(F.col("_pos").alias("doc_id"), at("a").alias("a"), at("n_chars").alias("n_chars"), at("origin").alias("origin"))


def detected_layouts(spark, sf_dir):
    columns = [("instruction", "input", "output"), ("conversations", "id"), ("messages",), ("prompt", "chosen", "rejected"), ("question", "answer"), ("question", "info"), ("text", "id"), ("instruction", "response"), ("conversations", "text")]
    return spark.createDataFrame([(",".join(c), mapping.detect(list(c))) for c in columns], "columns string, layout string")


def export_renamed(spark, sf_dir):
    t = mapping.project(pairs(spark, sf_dir), "sft", {"instruction": "ask", "nothing": "x"})
    return t.select(F.col("_pos").alias("pos"), "ask", "response")


def export_scored(spark, sf_dir):
    scored = pairs(spark, sf_dir).withColumn("quality_score", F.pmod(F.col("_pos"), F.lit(11)) / 10.0)
    return mapping.project(scored, "scored").select(F.col("_pos").alias("pos"), "instruction", "response", F.round("quality_score", 4).alias("quality_score"))


def saved_samples(spark, sf_dir):
    """A dataset saved in a layout and loaded again: what fits is written, strictly."""
    fit = dataset.Dataset(mapping.project(pairs(spark, sf_dir), "sft").withColumn("id", F.col("_pos").cast("string")))
    path = dedup.shared_folder(spark, "saved").removeprefix("file://") + ".jsonl"
    n = fit.save(path, "sft")
    back = dataset.load(spark, path).df
    return back.select("instruction", "response", F.lit(n).cast("long").alias("written"))


def _corpus(kind, spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    path = f"{dedup.shared_folder(spark, 'corpus')}.{kind}"
    if kind == "txt":
        docs.select(F.regexp_replace("text", r"[\n\r]+", " ")).write.text(path)
    else:
        jsonl.write_jsonl(docs.select("doc_id", "text"), path, "overwrite")
    return jsonl.corpus(spark, path).select(F.md5("text").alias("digest"))


def corpus_sample(spark, sf_dir):
    """At most 50 documents of a corpus, drawn by a seeded order of positions: the sample is the feature."""
    path = f"{dedup.shared_folder(spark, 'corpus')}.jsonl"
    jsonl.write_jsonl(table(spark, sf_dir, "benchmark").select("item_id", "text").coalesce(1), path, "overwrite")
    drawn = jsonl.corpus(spark, path, most=10, seed=4)
    return drawn.agg(F.count("*").alias("n"), F.countDistinct("_pos").alias("places"))


def malformed_lines(spark, sf_dir):
    """Numbers of the lines of a file that are no JSON, blank lines counted."""
    path = dedup.shared_folder(spark, "lines")
    x = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 5 == 0, '{"a": ').otherwise(F.concat(F.lit('{"a": '), F.col("doc_id").cast("string"), F.lit("}")))
    table(spark, sf_dir, "documents").coalesce(1).sortWithinPartitions("doc_id").select(x.alias("value")).write.text(path)
    return jsonl.malformed(spark, path).select(F.col("_line").alias("line"), "value")


def cultural_check(spark, sf_dir):
    """What the deterministic backend lets pass for a context."""
    t = transformers.cultural_check(documents(spark, sf_dir), DeterministicBackend(), "family_friendly", F.coalesce(F.col("text"), F.lit("")))
    return t.select(F.col("_pos").alias("doc_id"), F.col(filters.REASON).isNull().alias("passed"))


def row_invariant(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 2 == 0, F.col("text")).alias("instruction"), F.col("role").alias("topic"), (F.col("conv_id") * 1000 + F.col("turn")).alias("_pos"))
    return as_samples(t).select(F.col("_pos").alias("pos"), has_content().alias("whole"))


def failing_calls_policy(spark, sf_dir):
    """Calls that fail leave samples unscored, and unscored samples pass."""
    t = pairs(spark, sf_dir).withColumn("quality_score", F.when(F.col("_pos") % 4 > 0, F.pmod(F.col("_pos"), F.lit(10)) / 10.0))
    return filters.quality_threshold(t, 0.5).select(F.col("_pos").alias("pos"), F.col(filters.REASON).isNull().alias("passed"))


def validation_counts(spark, sf_dir):
    """What `validate` reports, strictly: repeated pairs and echoed responses fail too."""
    told = reports.validate(pairs(spark, sf_dir), "sft", strict=True)
    return spark.createDataFrame([(told["total"], told["passed"], told["failed"])], "total bigint, passed bigint, failed bigint")


def price_resolution(spark, sf_dir):
    prices = {"a/m": (1.0, 2.0), "b": (3.0, 4.0)}
    names = ["a/m", "a/m:free", "m", "z/b", "b:x", "q", "m:tag", "own"]
    rows = [(n, *(reports.price(n, prices, {"own": (5e6, 6e6)}) or (None, None))) for n in names]
    return spark.createDataFrame(rows, "model string, price_in double, price_out double")


def config_hashes(spark, sf_dir):
    """Settings by the hash that a resumed run compares; the order of keys doesn't matter."""
    some = [{"a": 1, "b": [1, 2]}, {"b": [1, 2], "a": 1}, {"a": 2}]
    return spark.createDataFrame([(k, pipeline.config_hash(c)) for k, c in enumerate(some)], "k bigint, hash string")


def layered_settings(spark, sf_dir):
    """Defaults under a recipe under dotted pairs."""
    c = config.load("sft_persona", None, {"n": config.value("7"), "llm.timeout": config.value("1.5"), "filters.quality.enabled": config.value("no"), "domain": config.value("law")})
    rows = [("n", c["n"]), ("llm.timeout", c["llm"]["timeout"]), ("llm.model", c["llm"]["model"]), ("filters.quality.enabled", c["filters"]["quality"]["enabled"]), ("filters.quality.min_score", c["filters"]["quality"]["min_score"]), ("method", c["method"]), ("domain", c["domain"]), ("persona.most", c["persona"]["max_personas"])]
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "key string, value string")


def recipe_settings(spark, sf_dir):
    names = sorted(resources.RECIPES)
    return spark.createDataFrame([(n, resources.recipe(n)["method"], resources.recipe(n)["n"]) for n in names], "recipe string, method string, n bigint")


def rendered_prompts(spark, sf_dir):
    """A template filled from columns in one pass: what a value holds isn't filled again."""
    prompt = resources.render("{{text}} in {{language}}: {{text}}", text=F.when(F.col("doc_id") % 2 == 0, F.lit("{{language}}")).otherwise(F.col("source")), language=F.col("lang"), other="x")
    return table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))


def repaired_replies(spark, sf_dir):
    """Model replies that are whole, fenced, talked around, cut off or none, as JSON; cut-off ones lose ten characters at a
    time and what follows the last comma then."""
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 8
    reply = (
        F.when(kind == 0, F.concat(F.lit('["a", "'), n, F.lit('"]'))).when(kind == 1, F.concat(F.lit('```json\n{"a": '), n, F.lit("}\n```")))
        .when(kind == 2, F.concat(F.lit('Here: {"a": '), n, F.lit("} as asked"))).when(kind == 3, F.concat(F.lit('["a", "b", "'), n))
        .when(kind == 4, F.concat(F.lit('{"a": '), n, F.lit(', "b": ["x", "y'))).when(kind == 5, F.lit("no idea")).when(kind == 6, n)
        .otherwise(F.concat(F.lit('the list ["x", '), n, F.lit("] ends")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", X.repaired(reply).alias("json"))


def listed_replies(spark, sf_dir):
    """Replies as lists of texts: lists, one value, a cut-off list, plain text."""
    from millrace.operators.generators import listed

    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 5
    reply = F.when(kind == 0, F.concat(F.lit('["a", " ", "'), n, F.lit('"]'))).when(kind == 1, F.concat(F.lit('"v '), n, F.lit('"'))).when(kind == 2, F.concat(F.lit('["a", "b '), n, F.lit('", "c'))).when(kind == 3, n).otherwise(F.concat(F.lit(" plain "), n))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(listed(reply), "|").alias("items"))


def usage_by_stage(spark, sf_dir):
    used = pipeline.Pipeline.usage(transformers.judge(pairs(spark, sf_dir), DeterministicBackend()))
    return used.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def cost_text(spark, sf_dir):
    """The lines of the cost report, stages by their tokens."""
    t = table(spark, sf_dir, "documents")
    usage = t.select(F.col("source").alias("stage"), F.ceil(F.col("n_chars") / 4.0).cast("bigint").alias("prompt_tokens"), F.pmod(F.col("n_chars"), F.lit(97)).cast("bigint").alias("completion_tokens"))
    lines = reports.cost_lines(reports.cost(usage.filter("stage IS NOT NULL"), F.lit(0.15e-6), F.lit(0.6e-6)))
    return spark.createDataFrame(list(enumerate(lines)), "line bigint, told string")


def pipeline_resumed_run(spark, sf_dir):
    """A quota run that stops after 20 samples and is taken up to 60, over-generating by half."""
    docs = documents(spark, sf_dir)

    def generate(_, n, round_):
        from millrace.operators import planning

        numbered = planning.ranked(docs, F.coalesce(F.floor(F.col("_pos") / (1 << 16)), F.lit(-1)), ["_pos"])
        return numbered.filter((F.col("_k") >= 40 * round_) & (F.col("_k") < 40 * (round_ + 1))).drop("_k")

    run = pipeline.Pipeline(generate, [], [partial(filters.safety, preset="family_friendly")], over_generate=1.5)
    out = dedup.shared_folder(spark, "resumed")
    run.run(spark, 20, out, {"a": 1})
    run.run(spark, 60, out, {"a": 1}, resume=True)
    return pipeline.Pipeline.output(spark, out).groupBy(F.col("round").cast("bigint").alias("round")).agg(F.count("*").alias("n"), F.sum("_pos").alias("ids"))


QUERIES = {
    **{f"{k}_round_trip": partial(_file_round_trip, k) for k in ("csv", "tsv", "parquet", "orc")},
    **{f"corpus_{k}": partial(_corpus, k) for k in ("txt", "jsonl")},
    **{
        f.__name__: f
        for f in (
            jsonl_round_trip, jsonl_resumed, load_alpaca, load_sharegpt, load_openai, load_preferences, load_questions, load_verifiable, load_pretrain, map_user_columns, map_direct_fields, map_synonyms, map_overflow,
            detected_layouts, export_renamed, export_scored, saved_samples, corpus_sample, malformed_lines, cultural_check, row_invariant, failing_calls_policy, validation_counts, price_resolution, config_hashes,
            layered_settings, recipe_settings, rendered_prompts, repaired_replies, listed_replies, usage_by_stage, cost_text, pipeline_resumed_run,
        )
    },
}
_WORD = stripped("regexp_replace(text, '[\\n\\r]+', ' ', 'g')")
_FIT = f"coalesce(instruction, '') <> '' AND coalesce(response, '') <> '' AND length({stripped('response')}) >= 10"
_BAD = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in sorted([*resources.BLOCKED, *resources.preset("family_friendly")["blocklist_words"]])) + ")"
_CULTURE = resources.preset("family_friendly")["custom_instruction"].replace("'", "''")
_JUDGED = "'Rate the answer from 0 to 1 as JSON with score and reason.' || chr(10) || 'Task: ' || instruction || chr(10) || 'Answer: ' || response"
SQL = {
    **{f"{k}_round_trip": "SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents" for k in ("csv", "tsv", "parquet", "orc")},
    "corpus_txt": f"SELECT md5({_WORD}) AS digest FROM documents WHERE text IS NOT NULL AND {_WORD} <> ''",
    "corpus_jsonl": f"SELECT md5({stripped('text')}) AS digest FROM documents WHERE text IS NOT NULL AND {stripped('text')} <> ''",
    "jsonl_round_trip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "jsonl_resumed": "SELECT doc_id, text, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS there FROM documents",
    "load_alpaca": "SELECT doc_id, 'Continue this.' || CASE WHEN doc_id % 3 > 0 AND substring(text, 1, 20) <> '' THEN chr(10) || substring(text, 1, 20) ELSE '' END AS instruction, coalesce(lang, '') AS response FROM documents",
    "load_sharegpt": "SELECT doc_id, 'system=s|user=' || coalesce(source, '') || '|assistant=' || coalesce(lang, '') || '|user=x' AS told FROM documents",
    "load_openai": "SELECT doc_id, 'user=' || coalesce(source, '') || '|assistant=' || coalesce(lang, '') AS told FROM documents",
    "load_preferences": "SELECT doc_id, source AS instruction, 'good ' || lang AS chosen, 'bad' AS rejected FROM documents",
    "load_questions": "SELECT doc_id, source AS instruction, lang AS response FROM documents",
    "load_verifiable": "SELECT event_id, event_type AS instruction, event_type AS kind FROM events",
    "load_pretrain": "SELECT doc_id, text FROM documents",
    "map_user_columns": "SELECT doc_id, source AS instruction, text AS response, NULL::VARCHAR AS text, NULL::VARCHAR AS lang FROM documents",
    "map_direct_fields": "SELECT doc_id, source AS topic, lang AS language, CAST(n_chars AS INTEGER) AS difficulty, NULL::DOUBLE AS quality_score FROM documents",
    "map_synonyms": "SELECT doc_id, source AS instruction, lang AS response, 'p' AS chosen, 'n' AS rejected, '{}' AS extra FROM documents",
    "map_overflow": "SELECT doc_id, '1' AS a, CAST(n_chars AS VARCHAR) AS n_chars, source AS origin FROM documents",
    "detected_layouts": """SELECT * FROM (VALUES ('instruction,input,output', 'alpaca'), ('conversations,id', 'sharegpt'), ('messages', 'openai'), ('prompt,chosen,rejected', 'dpo'), ('question,answer', 'qa'), ('question,info', 'rlvr'),
  ('text,id', 'pretrain'), ('instruction,response', NULL), ('conversations,text', 'sharegpt')) t(columns, layout)""",
    "export_renamed": f"WITH {PAIRS_SQL} SELECT pos, instruction AS ask, response FROM p WHERE {_FIT}",
    "export_scored": f"WITH {PAIRS_SQL} SELECT pos, instruction, response, round((pos % 11) / 10.0::DOUBLE, 4) AS quality_score FROM p WHERE {_FIT}",
    "saved_samples": f"WITH {PAIRS_SQL}, f AS (SELECT * FROM p WHERE {_FIT}) SELECT instruction, response, (SELECT count(*) FROM f) AS written FROM f",
    "corpus_sample": "SELECT least(count(*), 10) AS n, least(count(*), 10) AS places FROM benchmark",
    "malformed_lines": "SELECT line, '{\"a\":' AS value FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line FROM documents) WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0",
    "cultural_check": f"""SELECT doc_id, CAST('0x' || substr(md5('safety_filter:' || 'Is this safe for family_friendly? {_CULTURE} Answer as JSON with safe.' || chr(10) || coalesce(text, '')), 1, 6) AS BIGINT) % 20 <> 0 AS passed FROM documents""",
    "row_invariant": "SELECT conv_id * 1000 + turn AS pos, turn % 2 = 0 AND text IS NOT NULL AS whole FROM conversations",
    "failing_calls_policy": f"WITH {PAIRS_SQL} SELECT pos, pos % 4 = 0 OR (pos % 10) / 10.0 >= 0.5 AS passed FROM p",
    "validation_counts": f"""WITH {PAIRS_SQL}, c AS (SELECT {_FIT} AND instruction <> response AND row_number() OVER (PARTITION BY instruction, response ORDER BY pos) = 1 AS ok FROM p)
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok OR ok IS NULL) AS failed FROM c""",
    "price_resolution": "SELECT * FROM (VALUES ('a/m', 1.0::DOUBLE, 2.0::DOUBLE), ('a/m:free', 1, 2), ('m', 1, 2), ('z/b', 3, 4), ('b:x', 3, 4), ('q', NULL, NULL), ('m:tag', NULL, NULL), ('own', 5, 6)) t(model, price_in, price_out)",
    "config_hashes": """SELECT k::BIGINT AS k, substr(sha256(c), 1, 16) AS hash FROM (VALUES (0, '{"a": 1, "b": [1, 2]}'), (1, '{"a": 1, "b": [1, 2]}'), (2, '{"a": 2}')) t(k, c)""",
    "layered_settings": "SELECT * FROM (VALUES ('n', '7'), ('llm.timeout', '1.5'), ('llm.model', 'gpt-4o-mini'), ('filters.quality.enabled', 'False'), ('filters.quality.min_score', '0.7'), ('method', 'persona'), ('domain', 'law'), ('persona.most', '500')) t(key, value)",
    "recipe_settings": "SELECT recipe, method, n::BIGINT AS n FROM (VALUES ('augment', 'seed_dataset', 5000), ('pretrain', 'pretrain_rewriter', 1000), ('sft', 'topic_tree', 1000), ('sft_persona', 'persona', 5000)) t(recipe, method, n)",
    "rendered_prompts": "SELECT doc_id, concat(x, ' in ', coalesce(lang, ''), ': ', x) AS prompt FROM (SELECT doc_id, lang, coalesce(CASE WHEN doc_id % 2 = 0 THEN '{{language}}' ELSE source END, '') AS x FROM documents)",
    "repaired_replies": """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '["a", "' || doc_id || '"]' WHEN 1 THEN '{"a": ' || doc_id || '}' WHEN 2 THEN '{"a": ' || doc_id || '}' WHEN 3 THEN CASE WHEN doc_id >= 10 THEN '["a"]' END WHEN 4 THEN '{"a": ' || doc_id || '}'
  WHEN 6 THEN CAST(doc_id AS VARCHAR) WHEN 7 THEN '["x", ' || doc_id || ']' END AS json FROM documents""",
    "listed_replies": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a|' || doc_id WHEN 1 THEN 'v ' || doc_id WHEN 2 THEN 'a' WHEN 3 THEN CAST(doc_id AS VARCHAR) ELSE 'plain ' || doc_id END AS items FROM documents""",
    "usage_by_stage": f"""WITH {PAIRS_SQL}, j AS (SELECT {_JUDGED} AS prompt FROM p WHERE coalesce(instruction, '') <> '' AND coalesce(response, '') <> ''),
r AS (SELECT prompt, (CAST('0x' || substr(md5('quality_filter:' || prompt), 1, 6) AS BIGINT) % 101) / 100.0::DOUBLE AS s FROM j)
SELECT 'quality_filter' AS stage, count(*) AS calls, CAST(sum(ceil(length(prompt) / 4.0)) AS BIGINT) AS prompt_tokens, CAST(sum(ceil(length('{{"score": ' || CAST(s AS VARCHAR) || ', "reason": "drawn"}}') / 4.0)) AS BIGINT) AS completion_tokens FROM r""",
    "cost_text": """WITH u AS (SELECT source AS stage, CAST(ceil(n_chars / 4.0) AS BIGINT) AS p, n_chars % 97 AS c FROM documents WHERE source IS NOT NULL),
g AS (SELECT stage, sum(p + c) AS t, sum(p * 0.15e-6 + c * 0.6e-6) AS m FROM u GROUP BY stage), w AS (SELECT sum(t) AS t, sum(m) AS m FROM g),
o AS (SELECT row_number() OVER (ORDER BY t DESC, stage) - 1 AS line, printf('%s: %d tokens (%.1f %%), $%.4f', stage, CAST(t AS BIGINT), round(100.0::DOUBLE * t / (SELECT t FROM w), 1), round(m, 4)) AS told FROM g ORDER BY 1)
SELECT line, told FROM o UNION ALL SELECT (SELECT count(*) FROM g), printf('total: %d tokens, $%.4f', CAST(t AS BIGINT), round(m, 4)) FROM w""",
    "pipeline_resumed_run": f"""WITH k AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 40 AS round FROM documents), s AS (SELECT doc_id, round, row_number() OVER (PARTITION BY round ORDER BY doc_id) AS nth FROM k WHERE NOT {_BAD}),
a AS (SELECT * FROM s WHERE round = 0 AND nth <= 20), b AS (SELECT *, row_number() OVER (ORDER BY round, nth) AS place FROM s WHERE round > 0)
SELECT round, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, round FROM a UNION ALL SELECT doc_id, round FROM b WHERE place <= 40) GROUP BY round""",
}
