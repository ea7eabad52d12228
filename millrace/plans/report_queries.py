"""Queries of reports, planning and cost, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from millrace import resources
from millrace.functions.backends import DeterministicBackend
from millrace.operators import generators, planning, reports, transformers
from millrace.plans.mapping_queries import PAIRS_SQL, documents, pairs, table
from millrace.schema import as_samples, truthy


def _labelled(spark, sf_dir):
    """documents as samples with topic (source), task type and difficulty, scores from labels."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_pos"), F.col("quality").cast("double").alias("q"), F.col("toxic").alias("toxic"))
    t = documents(spark, sf_dir).join(labels, "_pos", "left")
    level = (1 + F.pmod(F.get_json_object("extra", "$.n_chars").cast("int"), F.lit(5))).cast("int")
    return t.withColumns({"topic": F.col("source_id"), "difficulty": level, "quality_score": F.col("q"), "safety_passed": F.col("toxic") == 0}).drop("q", "toxic")


_LABELLED = """s AS (SELECT doc_id, text, lang AS language, source AS topic, CAST(1 + n_chars % 5 AS INTEGER) AS difficulty, CAST(quality AS DOUBLE) AS quality_score, toxic = 0 AS safety_passed
  FROM documents LEFT JOIN labels USING (doc_id))"""


def inspect_population(spark, sf_dir):
    return reports.population(_labelled(spark, sf_dir))


def inspect_distributions(spark, sf_dir):
    return reports.distributions(_labelled(spark, sf_dir), ("language", "topic", "difficulty"))


def inspect_top_values(spark, sf_dir):
    """The five most frequent topics: a top-k report."""
    return reports.top(_labelled(spark, sf_dir), "topic", 5)


def quality_quantiles(spark, sf_dir):
    return reports.order_statistics(table(spark, sf_dir, "documents"), "n_chars", ["lang"])


def health_coverage(spark, sf_dir):
    return reports.coverage(_labelled(spark, sf_dir))


def health_topics_top10(spark, sf_dir):
    return reports.top(_labelled(spark, sf_dir), "topic", 10)


def health_difficulty_skew(spark, sf_dir):
    return reports.skew(_labelled(spark, sf_dir), 0.3)


def health_missing_topics(spark, sf_dir):
    targets = table(spark, sf_dir, "region").select(F.lower("r_name").alias("topic")).unionByName(table(spark, sf_dir, "documents").select(F.col("source").alias("topic")))
    return reports.missing_topics(_labelled(spark, sf_dir), targets)


def health_safety(spark, sf_dir):
    return _labelled(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(~F.col("safety_passed")).alias("blocked"), F.count("quality_score").alias("scored"))


def health_scarce_topics(spark, sf_dir):
    return reports.scarce_topics(_labelled(spark, sf_dir))


def leaf_plan(spark, sf_dir):
    """The shuffled grid of nations, task types, languages and levels."""
    leaf = table(spark, sf_dir, "nation").select(F.col("n_name").alias("leaf"))
    grid = planning.grid(leaf, task_type=["qa", "explain"], language=["en", "de"], level=[1, 2, 3])
    return planning.shuffled(grid, 7).select("leaf", "task_type", "language", F.col("level").cast("bigint").alias("level"), F.col("_k").alias("k"))


def round_robin_tasks(spark, sf_dir):
    leaf = table(spark, sf_dir, "region").select(F.col("r_name").alias("leaf"))
    return planning.round_robin(leaf, 17, 7).select("task", "leaf")


def round_robin_personas(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return planning.paired(2500, people, "c_custkey", ["en", "fr", "de"]).select("pair", "c_custkey", F.col("other").alias("language"))


def few_shot_selection(spark, sf_dir):
    calls, seeds = table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "documents").select("doc_id")
    return planning.subsets(calls, "s_suppkey", seeds, "doc_id", 3, 11)


def rewrite_round_robin(spark, sf_dir):
    t = planning.positions_in_turn(documents(spark, sf_dir), truthy("text"))
    return t.select(F.col("_pos").alias("doc_id"), planning.in_turn(list(transformers.REWRITES), F.col("_turn")).alias("strategy"))


def evol_strategy_assignment(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("_pos").alias("doc_id"), planning.strategy(list(transformers.EVOLUTIONS), 3, F.col("_pos").cast("string"), 1).alias("strategy"))


def _tree(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return planning.tree_paths([(r, "r_regionkey", None, "r_name"), (n, "n_nationkey", "n_regionkey", "n_name"), (c, "c_custkey", "c_nationkey", "c_name")])


def tree_paths(spark, sf_dir):
    return _tree(spark, sf_dir).select("node_id", "parent_id", F.col("depth").cast("bigint").alias("depth"), F.array_join("path", " > ").alias("path"))


def tree_leaves(spark, sf_dir):
    return planning.leaves(_tree(spark, sf_dir)).select("node_id")


def tree_subspaces(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.array(F.struct(F.lit("region").alias("dimension"), F.col("r_name").alias("attribute_value")), F.struct(F.lit("nation").alias("dimension"), F.col("n_name").alias("attribute_value")))
    return n.select("n_nationkey", planning.subspace("trade", path).alias("subspace"))


def _numbered(samples):
    """Samples whose id is their position, which draws go by."""
    return samples.withColumn("id", F.col("_pos").cast("string"))


def persona_expansion_rounds(spark, sf_dir):
    """Personas of customers, expanded twice by the deterministic backend; a round that brings none counts as well."""
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("persona"))
    people = generators.Personas(DeterministicBackend(items=2), first, rounds=2, most=1 << 40)
    told = people.expanded(first).groupBy(F.col("hop").cast("bigint").alias("hop")).agg(F.count("*").alias("n"), F.countDistinct("persona").alias("personas"))
    return spark.range(people.rounds + 1).withColumnRenamed("id", "hop").join(told, "hop", "left").fillna(0, ["n", "personas"])


_TOPICS = generators.TopicTree(DeterministicBackend(items=2), domain="trade", depth=3, most=4, pivots=2, task_types=("qa", "explain"), difficulty=(1, 2))


def topic_tree_nodes(spark, sf_dir):
    """The tree that the deterministic backend's replies make."""
    told = F.array_join(F.transform("path", lambda x: F.concat(x["dimension"], F.lit("="), x["attribute_value"])), ", ")
    return _TOPICS.nodes(spark).select("node_id", "parent_id", F.col("depth").cast("bigint").alias("depth"), told.alias("path"), "open", F.array_join("attributes", ",").alias("attributes"))


def topic_tree_samples(spark, sf_dir):
    source = replace(_TOPICS, depth=2, most=50)
    return source.generate(spark, 20).select("_pos", "instruction", "topic", "task_type", "language", "difficulty")


def seed_dataset_samples(spark, sf_dir):
    source = generators.SeedDataset(DeterministicBackend(), _numbered(pairs(spark, sf_dir)))
    return source.generate(spark, 12).select("_pos", "instruction", "source_id")


def evolved_instructions(spark, sf_dir):
    t = transformers.evolve(_numbered(pairs(spark, sf_dir)), DeterministicBackend(), rounds=2, seed=5)
    return t.select(F.col("_pos").alias("pos"), "instruction", F.size("evolution_history").cast("bigint").alias("steps"))


def answered_instructions(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").filter("role = 'user'")
    s = as_samples(t.select(F.col("text").alias("instruction"), (F.col("conv_id") * 1000 + F.col("turn")).alias("_pos")))
    return transformers.respond(s, DeterministicBackend()).select(F.col("_pos").alias("pos"), "response", "generation_model")


def rewritten_texts(spark, sf_dir):
    t = transformers.rewrite(documents(spark, sf_dir), DeterministicBackend())
    return t.select(F.col("_pos").alias("doc_id"), "text", F.get_json_object("extra", "$.pretrain_strategy").alias("strategy"))


def _usage(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("stage"), F.ceil(F.col("n_chars") / 4).cast("bigint").alias("prompt_tokens"), (F.col("n_chars") % 97).alias("completion_tokens"))


def cost_by_stage(spark, sf_dir):
    return reports.cost(_usage(spark, sf_dir), F.lit(0.15e-6), F.lit(0.6e-6))


def dry_run_estimate(spark, sf_dir):
    told = reports.estimate(12000, 1.25, evolve=True, quality=True)
    return spark.createDataFrame([(told["samples"], told["calls"], told["tokens"])], "samples bigint, calls bigint, tokens bigint")


def gap_analysis(spark, sf_dir):
    return reports.gaps(table(spark, sf_dir, "documents"), "lang", "source", 5)


def cross_lingual_gap(spark, sf_dir):
    return reports.language_gaps(table(spark, sf_dir, "documents"), "lang", "source")


def dataset_compare(spark, sf_dir):
    """Labelled documents against all, by language, with the difference of mean length."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return reports.compare(docs, labelled, "lang", "n_chars")


def best_of_source(spark, sf_dir):
    """The three best labelled documents of each source: rejection sampling keeps k."""
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return planning.best_of(t, "source", "quality", "doc_id", 3).select("source", "doc_id", "quality", F.col("rank").cast("bigint").alias("rank"))


def audit(spark, sf_dir):
    """By source: documents, labelled ones, toxic share of those, mean length."""
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return t.groupBy("source").agg(F.count("*").alias("n"), F.count("toxic").alias("labelled"), F.round(F.avg("toxic"), 6).alias("toxic_share"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


_draw = lambda seed, *keys: "md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(keys) + "))"
_hex = lambda e: f"CAST('0x' || substr({e}, 1, 8) AS BIGINT)"
_pick = lambda values, index: "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} AS BIGINT) + 1]"
_stat = lambda k: f"round(max(CASE WHEN rn - 1 = {k} THEN v END), 3)"
_TREE = """p AS (
  SELECT '0:' || r_regionkey AS node_id, NULL AS parent_id, 0 AS depth, r_name AS path FROM region UNION ALL
  SELECT '1:' || n_nationkey, '0:' || n_regionkey, 1, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT '2:' || c_custkey, '1:' || c_nationkey, 2, r_name || ' > ' || n_name || ' > ' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_BACK = lambda stage, prompt: f"md5('{stage}:' || {prompt})"

_ROOT = "l0 AS (SELECT '0' AS node_id, NULL::VARCHAR AS parent_id, 0 AS depth, '' AS path, []::VARCHAR[] AS excluded, false AS open, NULL::VARCHAR AS attributes)"


def _level_sql(k: int, most: int) -> str:
    """Level k of the deterministic topic tree: pivots, a dimension, its completed values, children."""
    sub = "'Domain ''trade''' || CASE WHEN path = '' THEN '' ELSE ' where ' || path END"
    cut = lambda d, i: f"substr({d}, {4 * i + 1}, 4)"
    number = lambda d: f"CAST('0x' || substr({d}, 1, 6) AS BIGINT)"
    return f"""p{k} AS (SELECT *, {sub} AS sub, md5('topic_tree:' || 'Name 2 different instances of ' || {sub} || ' as a JSON list of strings.') AS d FROM l{k - 1}),
q{k} AS (SELECT node_id, path, excluded, sub, md5('topic_tree.dimension:' || 'Instances of ' || sub || ':' || chr(10) || '[0] topic_tree ' || {cut("d", 0)} || chr(10) || '[1] topic_tree ' || {cut("d", 1)} || chr(10)
  || 'Give one dimension that tells them apart, none of ' || CASE WHEN len(excluded) = 0 THEN 'none' ELSE array_to_string(list_sort(excluded), ', ') END || ', as a JSON object with dimension and attributes.') AS d FROM p{k}),
s{k} AS (SELECT node_id, path, excluded, sub, 'axis ' || substr(d, 1, 2) AS dim, ['v' || {cut("d", 0)}, 'v' || {cut("d", 1)}] AS attrs FROM q{k}
  WHERE {number("d")} % 16 <> 5 AND {cut("d", 0)} <> {cut("d", 1)} AND NOT list_contains(excluded, 'axis ' || substr(d, 1, 2))),
e{k} AS (SELECT *, false AS done, 0 AS k FROM s{k} UNION ALL
  SELECT node_id, path, excluded, sub, dim, CASE WHEN {number("d")} % 4 = 0 OR list_contains(attrs, 'e' || {cut("d", 0)}) THEN attrs ELSE list_append(attrs, 'e' || {cut("d", 0)}) END, {number("d")} % 4 <> 2 OR list_contains(attrs, 'e' || {cut("d", 0)}), k + 1
  FROM (SELECT *, md5('topic_tree.expand:' || 'Dimension ' || dim || ' of ' || sub || ' has ["' || array_to_string(attrs, '","') || '"]. Give what is missing as JSON, or null.') AS d FROM e{k} WHERE NOT done AND len(attrs) < {most} AND k < 10)),
f{k} AS (SELECT * FROM e{k} QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY k DESC) = 1),
l{k} AS (SELECT node_id || '.' || (i - 1) AS node_id, node_id AS parent_id, {k} AS depth, concat(path, CASE WHEN path = '' THEN '' ELSE ', ' END, dim, '=', attrs[i]) AS path, list_append(excluded, dim) AS excluded, false AS open, NULL::VARCHAR AS attributes
  FROM (SELECT *, unnest(range(1, len(attrs) + 1)) AS i FROM f{k} WHERE len(attrs) <= {most})
  UNION ALL SELECT node_id || '.0', node_id, {k}, path, list_append(excluded, dim), true, array_to_string(attrs[1:{most}], ',') FROM f{k} WHERE len(attrs) > {most})"""



_FOUR = lambda d, i: f"substr({d}, {4 * i + 1}, 4)"


def _evolved_sql(k: int) -> str:
    """Round k of evolution over v{k}(pos, instruction)."""
    pick = _pick(transformers.EVOLUTIONS, _hex(_draw(5, "CAST(pos AS VARCHAR)", f"'{k}'")) + " % 6")
    told = " ".join(f"WHEN '{n}' THEN '{resources.TEMPLATES[f'transformers.evol_{n}'].partition(chr(10))[0]}'" for n in transformers.EVOLUTIONS)
    prompt = f"(CASE {pick} {told} END || chr(10) || instruction)"
    return f"v{k + 1} AS (SELECT pos, CASE WHEN instruction <> '' THEN 'evol_instruct reply ' || md5('evol_instruct:' || {prompt}) ELSE instruction END AS instruction, steps + CASE WHEN instruction <> '' THEN 1 ELSE 0 END AS steps FROM v{k})"


def _seeded_sql(draw: int, calls: str, wanted: str) -> str:
    """What the seed generator's calls of one attempt bring: (call, j, instruction)."""
    return f"""(WITH o AS (SELECT *, row_number() OVER (ORDER BY {_draw(draw, "CAST(pos AS VARCHAR)")}, CAST(pos AS VARCHAR)) - 1 AS k, count(*) OVER () AS n FROM p),
  c AS (SELECT call, {wanted} AS wanted, {_hex(_draw(draw + 1, "CAST(call AS VARCHAR)"))} AS st FROM (SELECT unnest({calls}) AS call)),
  x AS (SELECT call, wanted, string_agg('- ' || instruction, chr(10) ORDER BY nth) AS examples FROM c, (SELECT unnest([0, 1, 2]) AS nth) JOIN o ON (st + nth) % n = k WHERE instruction <> '' GROUP BY call, wanted),
  d AS (SELECT call, md5('seed_dataset:' || 'Here are some tasks:' || chr(10) || examples || chr(10) || 'Write ' || wanted || ' new ones as a JSON list of strings.' || ' #{draw}.') AS d FROM x)
  SELECT call, unnest([0, 1, 2]) AS j, unnest(['seed_dataset ' || {_FOUR("d", 0)}, 'seed_dataset ' || {_FOUR("d", 1)}, 'seed_dataset ' || {_FOUR("d", 2)}]) AS instruction FROM d)"""


def _people_sql(k: int) -> str:
    """Personas of round k: those that round k - 1's bring and nobody had before."""
    had = " UNION ALL ".join(f"SELECT persona FROM h{j}" for j in range(k))
    d = f"SELECT md5('persona_expand:' || 'Name people close to this person, as a JSON list of one-sentence descriptions.' || chr(10) || chr(10) || persona) AS d FROM h{k - 1}"
    return f"h{k} AS (SELECT DISTINCT persona FROM (SELECT unnest(['persona_expand ' || {_FOUR('d', 0)}, 'persona_expand ' || {_FOUR('d', 1)}]) AS persona FROM ({d})) WHERE persona NOT IN ({had}))"


QUERIES = {
    f.__name__: f
    for f in (
        inspect_population, inspect_distributions, inspect_top_values, quality_quantiles, health_coverage, health_topics_top10, health_difficulty_skew, health_missing_topics, health_safety, health_scarce_topics,
        leaf_plan, round_robin_tasks, round_robin_personas, few_shot_selection, rewrite_round_robin, evol_strategy_assignment, tree_paths, tree_leaves, tree_subspaces, persona_expansion_rounds, topic_tree_nodes, topic_tree_samples,
        seed_dataset_samples, evolved_instructions, answered_instructions, rewritten_texts, cost_by_stage, dry_run_estimate, gap_analysis, cross_lingual_gap, dataset_compare, best_of_source, audit,
    )
}
_FILLED = [(f, {"text": "count(text)", "quality_score": "count(quality_score)", "topic": "count(topic)", "language": "count(language)", "difficulty": "count(difficulty)"}.get(f, "0")) for f in reports.POPULATION]
SQL = {
    "inspect_population": f"WITH {_LABELLED} " + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({c} AS BIGINT) AS filled, count(*) AS total FROM s" for f, c in _FILLED),
    "inspect_distributions": f"WITH {_LABELLED} " + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM s WHERE {f} IS NOT NULL GROUP BY {f}" for f in ("language", "topic", "difficulty")),
    "inspect_top_values": "SELECT source AS value, count(*) AS n FROM documents WHERE source <> '' GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 5",
    "quality_quantiles": f"""SELECT lang, count(*) AS n, round(avg(v), 3) AS mean, {_stat("n // 2")} AS median, {_stat("greatest(n // 10 - 1, 0)")} AS p10, {_stat("least(n - 1, 9 * n // 10)")} AS p90
FROM (SELECT lang, CAST(n_chars AS DOUBLE) AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL) GROUP BY lang""",
    "health_coverage": f"WITH {_LABELLED} " + " UNION ALL ".join(f"SELECT '{f}' AS dimension, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM s WHERE {f} IS NOT NULL AND CAST({f} AS VARCHAR) <> '' GROUP BY {f}" for f in ("topic", "language", "difficulty")),
    "health_topics_top10": "SELECT source AS value, count(*) AS n FROM documents WHERE source <> '' GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 10",
    "health_difficulty_skew": f"WITH {_LABELLED} SELECT easy, total, round(easy / total::DOUBLE, 4) AS share, easy / total::DOUBLE > 0.3 AS skewed FROM (SELECT count(*) FILTER (WHERE difficulty IN (1, 2)) AS easy, count(difficulty) AS total FROM s)",
    "health_missing_topics": "SELECT lower(r_name) AS topic FROM region EXCEPT SELECT source FROM documents",
    "health_safety": f"WITH {_LABELLED} SELECT count(*) AS total, count(*) FILTER (WHERE NOT safety_passed) AS blocked, count(quality_score) AS scored FROM s",
    "health_scarce_topics": "SELECT topic, n FROM (SELECT source AS topic, count(*) AS n, row_number() OVER (ORDER BY count(*), source) AS r, count(*) OVER () AS t FROM documents WHERE source <> '' GROUP BY source) WHERE r <= ceil(t * 0.1)",
    "topic_tree_samples": f"""WITH RECURSIVE {_ROOT}, {_level_sql(1, 50)}, {_level_sql(2, 50)},
a AS (SELECT node_id, parent_id, path FROM l0 UNION ALL SELECT node_id, parent_id, path FROM l1 UNION ALL SELECT node_id, parent_id, path FROM l2),
g AS (SELECT *, '[' || replace(regexp_replace(path, '(axis ..)=(\\w+)', '{{"dimension":"\\1","attribute_value":"\\2"}}', 'g'), ', ', ',') || ']' AS told
  FROM a, (SELECT unnest(['qa', 'explain']) AS task_type), (SELECT unnest([1, 2]) AS level) WHERE node_id NOT IN (SELECT parent_id FROM a WHERE parent_id IS NOT NULL)),
o AS (SELECT *, row_number() OVER (ORDER BY {_draw(0, "node_id", "told", "'false'", "''", "''", "task_type", "'en'", "CAST(level AS VARCHAR)")}) - 1 AS k, count(*) OVER () AS n FROM g)
SELECT t.range * 1024 AS _pos, 'do ' || md5('topic_tree.instructions:' || 'Write 1 ' || task_type || ' tasks at level ' || level || ' in en on ' || CASE WHEN path = '' THEN 'trade' ELSE replace(replace(path, '=', ': '), ', ', '; ') END || ', as a JSON list.' || ' #' || t.range) AS instruction,
  CASE WHEN path = '' THEN 'trade' ELSE replace(regexp_replace(path, 'axis ..=', '', 'g'), ', ', ' > ') END AS topic, task_type, 'en' AS language, CAST(level AS INTEGER) AS difficulty FROM range(20) t JOIN o ON t.range % n = k""",
    "topic_tree_nodes": f"WITH RECURSIVE {_ROOT},\n"
    + ",\n".join(_level_sql(k, _TOPICS.most) for k in range(1, _TOPICS.depth + 1)) + "\n" + " UNION ALL ".join(f"SELECT node_id, parent_id, depth::BIGINT AS depth, path, open, attributes FROM l{k}" for k in range(_TOPICS.depth + 1)),
    "evolved_instructions": f"WITH {PAIRS_SQL}, v0 AS (SELECT pos, instruction, 0::BIGINT AS steps FROM p), {_evolved_sql(0)}, {_evolved_sql(1)} SELECT * FROM v2",
    "seed_dataset_samples": f"""WITH {PAIRS_SQL} SELECT call * 5 + j AS _pos, instruction, 'seed_dataset' AS source_id
FROM (SELECT * FROM {_seeded_sql(0, "[0, 1, 2]", "least(5, 12 - call * 5)")} UNION ALL SELECT * FROM {_seeded_sql(1, "[3]", "3")})""",
    "persona_expansion_rounds": f"WITH h0 AS (SELECT c_name AS persona FROM customer), {_people_sql(1)}, {_people_sql(2)} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS hop, count(*) AS n, count(DISTINCT persona) AS personas FROM h{k}" for k in range(3)),
    "leaf_plan": f"""SELECT leaf, task_type, language, level, row_number() OVER (ORDER BY {_draw(7, "leaf", "task_type", "language", "CAST(level AS VARCHAR)")}, leaf, task_type, language, level) - 1 AS k
FROM (SELECT n_name AS leaf FROM nation), (SELECT unnest(['qa', 'explain']) AS task_type), (SELECT unnest(['en', 'de']) AS language), (SELECT unnest([1, 2, 3])::BIGINT AS level)""",
    "round_robin_tasks": f"SELECT t.range AS task, leaf FROM range(17) t JOIN (SELECT r_name AS leaf, row_number() OVER (ORDER BY {_draw(7, 'r_name')}, r_name) - 1 AS k, count(*) OVER () AS n FROM region) ON t.range % n = k",
    "round_robin_personas": f"SELECT t.range AS pair, c_custkey, {_pick(['en', 'fr', 'de'], 't.range % 3')} AS language FROM range(2500) t JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) ON t.range % n = k",
    "few_shot_selection": f"""SELECT s_suppkey, doc_id, nth FROM (SELECT s_suppkey, {_hex(_draw(12, "CAST(s_suppkey AS VARCHAR)"))} AS st FROM supplier), (SELECT unnest([0, 1, 2])::BIGINT AS nth)
JOIN (SELECT doc_id, row_number() OVER (ORDER BY {_draw(11, "CAST(doc_id AS VARCHAR)")}, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) ON (st + nth) % n = k""",
    "rewrite_round_robin": f"SELECT doc_id, CASE WHEN text <> '' THEN {_pick(transformers.REWRITES, '(k - 1) % 4')} END AS strategy FROM (SELECT doc_id, text, count(*) FILTER (WHERE text <> '') OVER (ORDER BY doc_id) AS k FROM documents)",
    "evol_strategy_assignment": f"SELECT doc_id, {_pick(transformers.EVOLUTIONS, _hex(_draw(3, 'CAST(doc_id AS VARCHAR)', chr(39) + '1' + chr(39))) + ' % 6')} AS strategy FROM documents",
    "tree_paths": f"WITH {_TREE} SELECT node_id, parent_id, CAST(depth AS BIGINT) AS depth, path FROM p",
    "tree_leaves": f"WITH {_TREE} SELECT node_id FROM p WHERE node_id NOT IN (SELECT parent_id FROM p WHERE parent_id IS NOT NULL)",
    "tree_subspaces": "SELECT n_nationkey, 'Domain ''trade'' where region=' || r_name || ', nation=' || n_name AS subspace FROM nation JOIN region ON n_regionkey = r_regionkey",
    "answered_instructions": f"SELECT conv_id * 1000 + turn AS pos, CASE WHEN text <> '' THEN 'response_generator reply ' || {_BACK('response_generator', 'chr(10) || chr(10) || ' + chr(39) + 'Answer:' + chr(39) + ' || chr(10) || text')} END AS response, CASE WHEN text <> '' THEN 'deterministic' END AS generation_model FROM conversations WHERE role = 'user'",
    "rewritten_texts": f"""SELECT doc_id, CASE WHEN text <> '' THEN 'pretrain_rewriter reply ' || md5('pretrain_rewriter:Recast as ' || {_pick(["questions and answers", "worked problems", "tables", "a tutorial"], "(k - 1) % 4")} || ':' || chr(10) || text) ELSE text END AS text,
  CASE WHEN text <> '' THEN {_pick(transformers.REWRITES, "(k - 1) % 4")} END AS strategy
FROM (SELECT doc_id, text, count(*) FILTER (WHERE text <> '') OVER (ORDER BY doc_id) AS k FROM documents)""",
    "cost_by_stage": """WITH u AS (SELECT source AS stage, CAST(ceil(n_chars / 4.0) AS BIGINT) AS p, n_chars % 97 AS c FROM documents),
g AS (SELECT CASE WHEN grouping(stage) = 1 THEN 'total' ELSE stage END AS stage, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, round(sum(p * 0.15e-6 + c * 0.6e-6), 4) AS cost, grouping(stage) AS a FROM u GROUP BY ROLLUP (stage))
SELECT stage, prompt_tokens, completion_tokens, cost, round(100.0::DOUBLE * (prompt_tokens + completion_tokens) / max(CASE WHEN a = 1 THEN prompt_tokens + completion_tokens END) OVER (), 1) AS pct FROM g""",
    "dry_run_estimate": "SELECT CAST(15000 AS BIGINT) AS samples, CAST(15000 * 4 AS BIGINT) AS calls, CAST(15000 * 4 * 1000 AS BIGINT) AS tokens",
    "gap_analysis": """SELECT l.lang, s.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l CROSS JOIN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s
LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) c ON c.lang = l.lang AND c.source = s.source WHERE coalesce(n, 0) < 5""",
    "cross_lingual_gap": "SELECT lang, source, count(*) AS n, max(count(*)) OVER (PARTITION BY source) - count(*) AS missing FROM documents GROUP BY lang, source",
    "dataset_compare": """SELECT lang AS value, count(*) AS n_a, count(l.doc_id) AS n_b, round(avg(n_chars) FILTER (WHERE l.doc_id IS NOT NULL) - avg(n_chars), 4) AS delta
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY lang""",
    "best_of_source": "SELECT source, doc_id, quality, rank FROM (SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)) WHERE rank <= 3",
    "audit": "SELECT source, count(*) AS n, count(toxic) AS labelled, round(avg(toxic), 6) AS toxic_share, round(avg(n_chars), 4) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
}
