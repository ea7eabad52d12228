"""Queries of filters, near-duplicates and the quota pipeline, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import resources
from millrace.functions import text as X
from millrace.functions.backends import DeterministicBackend
from millrace.operators import dedup, filters, planning, reports, transformers
from millrace.pipeline import Pipeline
from millrace.plans.mapping_queries import PAIRS_SQL, chats, documents, pairs, stripped, table
from millrace.schema import as_samples


def survivors_by_language(spark, sf_dir):
    """The flagship: documents to samples, blocked phrases and words out, those long enough counted by language."""
    from millrace.operators import mapping

    safe = filters.survivors(filters.safety(documents(spark, sf_dir), preset="family_friendly"))
    return mapping.project(safe.select("*"), "pretrain").join(safe.select("_pos", "language"), "_pos").groupBy("language").agg(F.count("*").alias("n"))


def _blocked_sql(preset: str | None, text: str) -> str:
    words = sorted([*resources.BLOCKED, *resources.preset(preset)["blocklist_words"]])
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def _safety(preset, spark, sf_dir):
    return filters.safety(documents(spark, sf_dir), preset=preset).select(F.col("_pos").alias("doc_id"), "safety_passed")


def safety_conversations(spark, sf_dir):
    return filters.safety(chats(spark, sf_dir), preset="family_friendly").select(F.col("_pos").alias("conv_id"), "safety_passed")


def _staged(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_pos"), F.col("quality").cast("double").alias("label"))
    t = documents(spark, sf_dir).join(labels, "_pos", "left").withColumn("quality_score", F.col("label")).drop("label")
    t = filters.exact_duplicates(t, F.col("text"))
    t = filters.safety(t, preset="family_friendly")
    t = filters.quality_threshold(t, 0.7)
    return filters.collapse(t, "remove")


def filter_summary_by_reason(spark, sf_dir):
    return reports.rejections(_staged(spark, sf_dir))


def quality_threshold(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_pos"), F.col("quality").cast("double").alias("quality"))
    t = filters.quality_threshold(documents(spark, sf_dir).join(labels, "_pos", "left"), 1.0, "quality")
    return filters.survivors(t).select(F.col("_pos").alias("doc_id"), "quality")


def quality_parse(spark, sf_dir):
    """Judge replies of seven kinds made from document numbers, and the scores read from them."""
    x = (F.col("doc_id") % 103 / 100.0).cast("string")
    kind = F.col("doc_id") % 7
    reply = (
        F.when(kind == 0, F.concat(F.lit('{"score": '), x, F.lit(', "reason": "r"}')))
        .when(kind == 1, F.concat(F.lit('```json\n{"score": '), x, F.lit("}\n```")))
        .when(kind == 2, F.concat(F.lit("I give it "), (F.col("doc_id") % 13).cast("string"), F.lit(" points")))
        .when(kind == 3, F.lit("no idea")).when(kind == 4, F.lit('{"reason": "none"}')).when(kind == 5, x)
        .otherwise(F.concat(F.lit('{"score": "'), x, F.lit('"}')))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.judge_score(reply), 6).alias("score"))


def _collapse(action, spark, sf_dir):
    return filters.collapse(documents(spark, sf_dir), action)


def collapse_report(spark, sf_dir):
    t = documents(spark, sf_dir).select(X.prefix_key(F.col("text")).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
    return t.filter("n > 3 AND prefix <> ''")


def collapse_flag(spark, sf_dir):
    flagged = F.coalesce(F.get_json_object("extra", "$.template_collapse"), F.lit("false")) == "true"
    return _collapse("flag", spark, sf_dir).select(F.col("_pos").alias("doc_id"), flagged.alias("flagged"))


def collapse_remove(spark, sf_dir):
    return filters.survivors(_collapse("remove", spark, sf_dir)).select(F.col("_pos").alias("doc_id"))


def exact_dedup(spark, sf_dir):
    return filters.survivors(filters.exact_duplicates(documents(spark, sf_dir), F.col("text"))).select(F.col("_pos").alias("doc_id"))


def contamination_8gram(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select(F.col("text").alias("item"))
    t = filters.contamination(documents(spark, sf_dir), bench, F.col("text"), F.col("item"), 8)
    return t.filter(F.col(filters.REASON).isNotNull()).select(F.col("_pos").alias("doc_id"))


def structural_checks(spark, sf_dir):
    t = filters.structure(chats(spark, sf_dir))
    return t.select(F.col("_pos").alias("conv_id"), F.coalesce(filters.REASON, F.lit("ok")).alias("reason"))


def strict_validation(spark, sf_dir):
    p = pairs(spark, sf_dir)
    same = F.sha2(F.concat_ws("\x1f", "instruction", "response"), 256)
    t = filters.exact_duplicates(filters.structure(p), same)
    return t.select(F.col("_pos").alias("pos"), F.coalesce(filters.REASON, F.lit("ok")).alias("reason"))


def empty_responses(spark, sf_dir):
    """Conversation turns as samples whose response is the next assistant turn, null at the end."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    s = as_samples(t.select(F.col("text").alias("instruction"), F.col("next").alias("response"), (F.col("conv_id") * 1000 + F.col("turn")).alias("_pos")))
    return reports.rejections(filters.empty_response(s)).select("reason", "n")


def _personas(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text")


def minhash_signature(spark, sf_dir):
    """Signatures of benchmark texts, as a digest of their 128 values in hexadecimal."""
    t = table(spark, sf_dir, "benchmark")
    sig = F.array_join(F.transform("sig", lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ",")
    return dedup.signatures(t, "text", "item_id").select(F.col("key").alias("item_id"), F.md5(sig).alias("sig_md5"))


def minhash_pairs(spark, sf_dir):
    """Pairs of classes of benchmark texts with equal signatures, whose agreement is over 0.2."""
    sigs = dedup.signatures(table(spark, sf_dir, "benchmark"), "text", "item_id")
    return dedup.minhash_pairs(dedup.settled(sigs), 0.2).select("a", "b", F.round("sim", 6).alias("sim"))


def minhash_dedup(spark, sf_dir):
    """Conversation turns that the greedy pass at 0.8 keeps."""
    return dedup.minhash_dedup(_personas(spark, sf_dir), "text", "pos", 0.8).select("pos")


def deduplicated_turns(spark, sf_dir):
    """Conversation turns after deduplication at 0.9 without a model for vectors, which leaves the MinHash pass."""
    return dedup.deduplicate(_personas(spark, sf_dir).filter("text IS NOT NULL"), "text", "pos", 0.9).select("pos")


def embedded_texts(spark, sf_dir):
    t = DeterministicBackend().embed(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    return t.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round((x + 1) * 127.5).cast("int").cast("string")), ",").alias("bytes"))


def cosine_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return dedup.cosine_pairs(t, "vec_id", "embedding", 0.3).select("a", "b", F.round("sim", 6).alias("sim"))


def embedding_dedup(spark, sf_dir):
    return dedup.embedding_dedup(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4).select("vec_id")


def nearest_cosine(spark, sf_dir):
    return dedup.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(F.col("key").alias("vec_id"), F.round("nearest", 6).alias("nearest"))


def diverse_sample(spark, sf_dir):
    """Ten vectors by marginal relevance: a selection of ten is the operator's result."""
    keys = dedup.relevance_diversity(spark, table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 10)
    return spark.createDataFrame(list(enumerate(keys)), "rank int, vec_id bigint")


def minhash_members(spark, sf_dir):
    """The class of equal signatures of each benchmark text."""
    sigs = dedup.signatures(table(spark, sf_dir, "benchmark"), "text", "item_id")
    return dedup.minhash_members(dedup.settled(sigs)).select(F.col("key").alias("item_id"), "rep")


def pipeline_quota_run(spark, sf_dir):
    """The first tenth of all documents that survives safety, duplicate and collapse filters, in rounds of a sixth of the
    table by the order of ids: the quota is the operator. Collapse and duplicates are judged within a round."""
    docs = documents(spark, sf_dir)
    total = docs.count()
    numbered = dedup.settled(planning.ranked(docs, F.coalesce(F.floor(F.col("_pos") / (1 << 16)), F.lit(-1)), ["_pos"]))

    def generate(_, n, round_):
        return numbered.filter(F.floor(F.col("_k") * 6 / F.lit(max(total, 1))) == round_).drop("_k")

    run = Pipeline(generate, [], [partial(filters.safety, preset="family_friendly"), lambda d: filters.exact_duplicates(d, F.col("text")), partial(filters.collapse, action="remove")])
    out = dedup.shared_folder(spark, "quota")
    run.run(spark, total // 10, out)
    return Pipeline.output(spark, out).select(F.col("_pos").alias("doc_id"))


def judged_pairs(spark, sf_dir):
    """Scores that the deterministic judge gives conversation pairs, and which pass 0.7."""
    t = filters.quality_threshold(transformers.judge(pairs(spark, sf_dir), DeterministicBackend()), 0.7)
    return t.select(F.col("_pos").alias("pos"), "quality_score", F.col(filters.REASON).isNull().alias("passed"))


def stream_filter_equivalence(spark, sf_dir):
    """Safety-filtered documents by way of a stream of files."""
    from millrace.streaming import curate

    out = dedup.shared_folder(spark, "stream")
    schema = table(spark, sf_dir, "documents").schema
    # The folder's only table of this name; the stream reads it as files that arrive.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    stage = lambda d: filters.safety(as_samples(d.select(F.col("text"), F.col("doc_id").alias("_pos"))), preset="family_friendly")
    curate.curate(stream, stage, out, f"{out}/checkpoint").awaitTermination()
    return curate.kept(spark, out).select(F.col("_pos").alias("doc_id"))


_BAD = _blocked_sql("family_friendly", "text")
_PREFIX = f"lower({stripped('substring(text, 1, 50)')})"
_GRAM = lambda col, key, t: f"""SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g
  FROM (SELECT {key}, list_filter(string_split(regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {t}) WHERE len(w) >= 8"""  # noqa: E731
_STAGED = f"""s AS (
  SELECT d.doc_id, l.quality, {_BAD} AS bad, row_number() OVER (PARTITION BY text ORDER BY d.doc_id) AS copy, {_PREFIX} AS prefix,
    row_number() OVER (PARTITION BY {_PREFIX} ORDER BY d.doc_id) AS nth
  FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT CASE WHEN copy > 1 THEN 'duplicate' WHEN bad THEN 'safety_blocked' WHEN quality < 0.7 THEN 'low_quality'
  WHEN nth > 3 AND prefix <> '' THEN 'template_collapse' ELSE 'passed' END AS reason FROM s)"""
_GREEDY = lambda items, pairs: f"""{pairs}, n AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM ({items})), b AS (SELECT b AS id, list(a) AS before FROM near GROUP BY b),
k AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT k.n + 1, CASE WHEN b.before IS NOT NULL AND list_has_any(kept, b.before) THEN kept ELSE list_append(kept, n.id) END FROM k JOIN n ON n.n = k.n + 1 LEFT JOIN b ON b.id = n.id)"""  # noqa: E731
_SHINGLES = """t AS (SELECT item_id, trim(lower(text)) AS t FROM benchmark),
sh AS (SELECT DISTINCT item_id, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)) END) AS g FROM t),
v AS (SELECT g, i, substr(sha256(unhex(printf('%08x', i)) || encode(g)), 1, 16) AS x FROM (SELECT DISTINCT g FROM sh), range(128) r(i)),
h AS (SELECT g, i, array_to_string(list_transform([15, 13, 11, 9, 7, 5, 3, 1], lambda p: substr(x, p, 2)), '') AS h FROM v),
m AS (SELECT item_id, i, min(h) AS h FROM sh JOIN h USING (g) GROUP BY item_id, i)"""
_BYTES = "list_transform(range(0, 8), lambda k: CAST('0x' || substr(d, CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT) / 127.5::DOUBLE - 1)"


def _turns_sql(threshold: float) -> str:
    """The greedy pass over the signatures of conversation turns."""
    turns = _SHINGLES.replace("SELECT item_id, trim(lower(text)) AS t FROM benchmark", f"SELECT conv_id * 1000 + turn AS item_id, {stripped('lower(coalesce(text, chr(32)))')} AS t FROM conversations")
    near = f"near AS (SELECT a.item_id AS a, b.item_id AS b FROM m a JOIN m b ON a.i = b.i AND a.h = b.h AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) > {threshold} * 128)"
    return "WITH RECURSIVE " + _GREEDY("SELECT DISTINCT item_id AS id FROM t", f"{turns}, {near}")


QUERIES = {
    "survivors_by_language": survivors_by_language,
    "safety_universal": partial(_safety, None),
    "safety_academic": partial(_safety, "academic"),
    "safety_family_friendly": partial(_safety, "family_friendly"),
    "safety_islamic": partial(_safety, "islamic"),
    **{
        f.__name__: f
        for f in (
            safety_conversations, filter_summary_by_reason, quality_threshold, quality_parse, collapse_report, collapse_flag, collapse_remove, exact_dedup, contamination_8gram, structural_checks,
            strict_validation, empty_responses, minhash_signature, minhash_pairs, minhash_members, minhash_dedup, deduplicated_turns, embedded_texts, cosine_pairs, embedding_dedup, nearest_cosine, diverse_sample, pipeline_quota_run, judged_pairs, stream_filter_equivalence,
        )
    },
}
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
SQL = {
    "survivors_by_language": f"SELECT lang AS language, count(*) AS n FROM documents WHERE NOT {_BAD} AND length({stripped('text')}) >= 50 GROUP BY lang",
    **{f"safety_{p}": f"SELECT doc_id, NOT {_blocked_sql(None if p == 'universal' else p, 'text')} AS safety_passed FROM documents" for p in ("universal", "academic", "family_friendly", "islamic")},
    "safety_conversations": f"SELECT conv_id, NOT {_blocked_sql('family_friendly', 't')} AS safety_passed FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)",
    "filter_summary_by_reason": f"WITH {_STAGED} SELECT reason, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM r GROUP BY reason",
    "quality_threshold": "SELECT doc_id, CAST(quality AS DOUBLE) AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality >= 1",
    "quality_parse": """SELECT doc_id, round(CASE doc_id % 7 WHEN 0 THEN least(1.0, x) WHEN 1 THEN least(1.0, x) WHEN 6 THEN least(1.0, x) WHEN 5 THEN NULL WHEN 3 THEN 0.5 WHEN 4 THEN 0.5
  ELSE CASE WHEN y <= 1 THEN y WHEN y <= 5 THEN y / 5 WHEN y <= 10 THEN y / 10 ELSE 0.5 END END, 6) AS score
FROM (SELECT doc_id, (doc_id % 103)::DOUBLE / 100 AS x, (doc_id % 13)::DOUBLE AS y FROM documents)""",
    "collapse_report": f"SELECT {_PREFIX} AS prefix, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 3 AND {_PREFIX} <> ''",
    "collapse_flag": f"SELECT doc_id, count(*) OVER (PARTITION BY {_PREFIX}) > 3 AND {_PREFIX} <> '' AS flagged FROM documents",
    "collapse_remove": f"SELECT doc_id FROM (SELECT doc_id, {_PREFIX} AS p, row_number() OVER (PARTITION BY {_PREFIX} ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 3 OR p = ''",
    "exact_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "contamination_8gram": f"SELECT DISTINCT d.doc_id FROM ({_GRAM('text', 'doc_id', 'documents')}) d JOIN ({_GRAM('text', 'item_id', 'benchmark')}) b USING (g)",
    "structural_checks": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT conv_id, CASE WHEN bool_or({stripped("text")} = '') THEN 'empty_turn' WHEN bool_or(role <> 'system' AND role <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) OR bool_or(role = 'system' AND place > 1)
  THEN 'roles_out_of_turn' ELSE 'ok' END AS reason FROM n GROUP BY conv_id""",
    "strict_validation": f"""WITH {PAIRS_SQL} SELECT pos, CASE WHEN {stripped("response")} = {stripped("instruction")} THEN 'response_is_instruction'
  WHEN row_number() OVER (PARTITION BY instruction, response ORDER BY pos) > 1 THEN 'duplicate' ELSE 'ok' END AS reason FROM p""",
    "empty_responses": """SELECT CASE WHEN coalesce(text, '') <> '' AND coalesce(nxt, '') = '' THEN 'empty_response' ELSE 'passed' END AS reason, count(*) AS n
FROM (SELECT text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) GROUP BY 1""",
    "minhash_signature": f"WITH {_SHINGLES} SELECT item_id, md5(string_agg(h, ',' ORDER BY i)) AS sig_md5 FROM m GROUP BY item_id",
    "minhash_members": f"WITH {_SHINGLES}, g AS (SELECT item_id, md5(string_agg(h, ',' ORDER BY i)) AS sig FROM m GROUP BY item_id) SELECT item_id, min(item_id) OVER (PARTITION BY sig) AS rep FROM g",
    "minhash_pairs": f"WITH {_SHINGLES}, g AS (SELECT item_id, md5(string_agg(h, ',' ORDER BY i)) AS sig FROM m GROUP BY item_id), r AS (SELECT min(item_id) AS item_id FROM g GROUP BY sig) SELECT a.item_id AS a, b.item_id AS b, round(count(*) / 128.0::DOUBLE, 6) AS sim FROM m a JOIN m b ON a.i = b.i AND a.h = b.h AND a.item_id < b.item_id WHERE a.item_id IN (FROM r) AND b.item_id IN (FROM r) GROUP BY 1, 2 HAVING count(*) > 0.2 * 128",
    "embedding_dedup": "WITH RECURSIVE " + _GREEDY("SELECT vec_id AS id FROM embeddings", f"near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} > 0.4)") + " SELECT unnest(kept) AS vec_id FROM k WHERE n = (SELECT max(n) FROM k)",
    "minhash_dedup": _turns_sql(0.8) + " SELECT unnest(kept) AS pos FROM k WHERE n = (SELECT max(n) FROM k)",
    "deduplicated_turns": _turns_sql(0.9).replace("FROM conversations)", "FROM conversations WHERE text IS NOT NULL)") + " SELECT unnest(kept) AS pos FROM k WHERE n = (SELECT max(n) FROM k)",
    "embedded_texts": f"SELECT doc_id, array_to_string(list_transform({_BYTES}, lambda x: CAST(round((x + 1) * 127.5) AS INTEGER)), ',') AS bytes FROM (SELECT doc_id, text, md5(text) AS d FROM documents)",
    "diverse_sample": """WITH RECURSIVE e AS (SELECT vec_id, CAST(label AS DOUBLE) AS s, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (SELECT 0 AS step, NULL::BIGINT AS vec_id, []::BIGINT[] AS ids, []::DOUBLE[][] AS vs UNION ALL
  SELECT step + 1, b.vec_id, list_append(ids, b.vec_id), list_append(vs, b.v) FROM (
    SELECT step, ids, vs, arg_max({'vec_id': vec_id, 'v': v}, (0.5 * s - 0.5 * list_max(list_append(list_transform(vs, lambda x: list_cosine_similarity(x, v)), 0.0::DOUBLE)), -vec_id)) AS b
    FROM (SELECT r.*, e.vec_id AS id2, e.s, e.v FROM r, e WHERE step < 10 AND NOT list_contains(ids, e.vec_id)) t(step, last, ids, vs, vec_id, s, v) GROUP BY step, ids, vs))
SELECT CAST(step - 1 AS INTEGER) AS rank, vec_id FROM r WHERE step > 0""",
    "cosine_pairs": f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} > 0.3",
    "nearest_cosine": f"SELECT a.vec_id, round(max({_COS}), 6) AS nearest FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id",
    "pipeline_quota_run": f"""WITH n AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) * 6 // count(*) OVER () AS round, count(*) OVER () AS total FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY round, text ORDER BY doc_id) AS copy, row_number() OVER (PARTITION BY round, {_PREFIX} ORDER BY doc_id) AS nth, {_PREFIX} AS prefix, {_BAD} AS bad FROM n),
k AS (SELECT doc_id, total, row_number() OVER (ORDER BY round, doc_id) AS place FROM r WHERE copy = 1 AND NOT bad AND (nth <= 3 OR prefix = ''))
SELECT doc_id FROM k WHERE place <= total // 10""",
    "judged_pairs": f"""WITH {PAIRS_SQL}, j AS (SELECT pos, CASE WHEN coalesce(instruction, '') <> '' AND coalesce(response, '') <> '' THEN
  (CAST('0x' || substr(md5('quality_filter:' || 'Rate the answer from 0 to 1 as JSON with score and reason.' || chr(10) || 'Task: ' || instruction || chr(10) || 'Answer: ' || response), 1, 6) AS BIGINT) % 101) / 100.0::DOUBLE END AS quality_score FROM p)
SELECT pos, quality_score, quality_score IS NULL OR quality_score >= 0.7 AS passed FROM j""",
    "stream_filter_equivalence": f"SELECT doc_id FROM documents WHERE NOT {_BAD}",
}
