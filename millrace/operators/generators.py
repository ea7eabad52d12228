"""Sources of new samples: a topic tree, personas, and few-shot variation of a seed dataset.

Each generate(spark, n, round_) returns one DataFrame of samples with `_pos`, a function of its settings and the round
alone. Frontier loops write each step down, so replies are asked for once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import resources
from millrace.functions.backends import Backend
from millrace.functions.text import repaired, strip, unfenced
from millrace.operators import dedup, planning
from millrace.operators.dedup import settled
from millrace.schema import as_samples, truthy


def listed(reply: Column) -> Column:
    """A reply as a list of texts: a JSON list's items (of a cut-off list those that are whole), another JSON value as the
    only one, else the reply itself; blank items are dropped."""
    v = repaired(reply)
    many = F.when(F.startswith(v, F.lit("[")), v).otherwise(F.concat(F.lit("["), v, F.lit("]")))
    items = F.when(v.isNotNull(), F.from_json(many, "array<string>")).when(reply.isNotNull(), F.array(unfenced(reply)))
    return F.filter(F.transform(items, strip), lambda x: F.coalesce(x != "", F.lit(False)))


@dataclass
class TopicTree:
    """Expands a domain level by level and writes tasks for its leaves: every leaf, task type, language and level, shuffled.

    A node's subject is told by a few instances (pivots); a dimension that tells them apart is asked for, up to `attempts`
    times, until it is a new one whose values hold instances of their own; its values are completed until the model says
    that none is missing. A node without pivots or dimension stays a leaf.
    """

    backend: Backend
    domain: str = "general"
    depth: int = 4
    most: int = 50
    task_types: tuple[str, ...] = ("qa", "explain", "compare", "creative")
    languages: tuple[str, ...] = ("en",)
    difficulty: tuple[int, int] = (1, 5)
    seed: int = 0
    pivots: int = 10
    attempts: int = 5
    completions: int = 10
    overrides: dict[str, str] | None = None

    def _asked(self, df: DataFrame, stage: str, name: str, **values) -> DataFrame:
        """df with `_json`, the repaired reply to a template, and `_said`, the reply itself."""
        prompt = resources.render(resources.template(f"generators.{name}", self.overrides), subspace=planning.subspace(self.domain, F.col("path")), **values)
        replied = self.backend.complete(df, prompt, stage)
        return settled(replied.withColumns({"_json": repaired(F.col("reply.content")), "_said": F.col("reply.content")}).drop("reply"))

    def _with_pivots(self, nodes: DataFrame) -> DataFrame:
        told = self._asked(nodes, "topic_tree", "topic_tree", n=str(self.pivots))
        items = F.when(F.startswith("_json", F.lit("[")), F.filter(F.from_json("_json", "array<string>"), lambda x: F.coalesce(x != "", F.lit(False))))
        return told.withColumn("pivots", items).filter(F.size("pivots") > 0).drop("_json", "_said")

    def _with_dimension(self, nodes: DataFrame) -> DataFrame:
        """nodes with dimension and attributes; those whose replies are all refused are left out."""
        shown = F.array_join(F.transform("pivots", lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x)), "\n")
        none = F.coalesce(F.nullif(F.array_join(F.array_sort("excluded"), ", "), F.lit("")), F.lit("none"))
        reply = F.from_json(F.when(F.startswith("_json", F.lit("{")), F.col("_json")), "dimension string, attributes map<string,string>")
        places = F.flatten(F.transform(F.map_values("_told.attributes"), lambda x: F.coalesce(F.from_json(x, "array<string>"), F.expr("cast(array() as array<string>)"))))
        good = F.col("_told.dimension").isNotNull() & ~F.array_contains("excluded", F.col("_told.dimension")) & (F.size("_told.attributes") >= 2) & (F.size(places) == F.size(F.array_distinct(places)))
        pending, out = nodes, None
        for _ in range(self.attempts):
            told = settled(self._asked(pending, "topic_tree.dimension", "topic_tree_dimension", pivots=shown, excluded=none).withColumn("_told", reply).withColumn("_good", F.coalesce(good, F.lit(False))))
            found = told.filter("_good").withColumns({"dimension": F.col("_told.dimension"), "attributes": F.map_keys("_told.attributes")}).drop("_told", "_good", "_json", "_said")
            out = found if out is None else out.unionByName(found)
            pending = told.filter("NOT _good").select(nodes.columns)
            if not pending.take(1):
                break
        return out

    def _completed(self, nodes: DataFrame) -> DataFrame:
        """nodes with attributes that the model takes for complete; `completions` rounds at most, or until `most` are there."""
        pending, out = nodes.withColumn("_done", F.size("attributes") >= self.most), None
        for _ in range(self.completions):
            done = pending.filter("_done").drop("_done")
            out = done if out is None else out.unionByName(done)
            pending = pending.filter("NOT _done").drop("_done")
            if not pending.take(1):
                return out
            told = self._asked(pending, "topic_tree.expand", "topic_tree_expand", dimension=F.col("dimension"), attributes=F.to_json("attributes"))
            object_ = F.startswith("_json", F.lit("{"))
            new = F.when(object_, F.from_json(F.get_json_object("_json", "$.attributes"), "array<string>")).when(F.startswith("_json", F.lit("[")), F.from_json("_json", "array<string>"))
            new = F.filter(F.coalesce(new, F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull())
            null = F.lower(F.btrim(strip(F.col("_said")), F.lit('"'))) == "null"
            union = F.when(null, F.col("attributes")).otherwise(F.array_union("attributes", new))
            more = object_ & (F.coalesce(F.get_json_object("_json", "$.completeness"), F.lit("complete")) == "infinite")
            # A model that calls the values endless but brings none is done.
            told = told.withColumn("_all", union).withColumn("_done", ~F.coalesce(more, F.lit(False)) | (F.size("_all") == F.size("attributes")) | (F.size("_all") >= self.most))
            pending = settled(told.withColumn("attributes", F.col("_all")).drop("_all", "_json", "_said"))
        return out.unionByName(pending.drop("_done"))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(node_id, parent_id, depth, path, excluded, open, dimension, attributes): path of (dimension, attribute_value); an open
        node stands for more than `most` values of a dimension, of which it holds the first."""
        path = "array<struct<dimension:string,attribute_value:string>>"
        none = F.expr("cast(array() as array<string>)")
        root = spark.range(1).select(F.lit("0").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.expr(f"cast(array() as {path})").alias("path"), none.alias("excluded"), F.lit(False).alias("open"), F.lit(None).cast("string").alias("dimension"), F.lit(None).cast("array<string>").alias("attributes"))
        out = frontier = settled(root)
        for level in range(1, self.depth + 1):
            found = self._completed(self._with_dimension(self._with_pivots(frontier.select("node_id", "path", "excluded"))))
            wide = F.size("attributes") > self.most
            kids = found.withColumn("kids", F.when(wide, F.array(F.lit(None).cast("string"))).otherwise(F.col("attributes")))
            named = kids.select("node_id", "path", "excluded", "dimension", "attributes", wide.alias("open"), F.posexplode("kids").alias("k", "value"))
            own = F.concat("path", F.array(F.struct("dimension", F.col("value").alias("attribute_value"))))
            frontier = settled(named.select(
                F.concat("node_id", F.lit("."), F.col("k").cast("string")).alias("node_id"), F.col("node_id").alias("parent_id"), F.lit(level).alias("depth"), F.when(F.col("open"), F.col("path")).otherwise(own).alias("path"),
                F.array_append("excluded", F.col("dimension")).alias("excluded"), "open", F.when(F.col("open"), F.col("dimension")).alias("dimension"), F.when(F.col("open"), F.slice("attributes", 1, self.most)).alias("attributes"),
            ))
            if not frontier.take(1):
                break
            out = out.unionByName(frontier)
        return settled(out)

    def plan(self, spark: SparkSession, n: int, round_: int = 0) -> DataFrame:
        """(task, node_id, path, task_type, language, level): n tasks over the grid, in a seeded order; a task of an open leaf
        draws one of its values."""
        lo, hi = self.difficulty
        last = planning.leaves(self.nodes(spark)).select("node_id", F.to_json("path").alias("path"), "open", "dimension", F.to_json("attributes").alias("attributes"))
        grid = planning.grid(last, task_type=list(self.task_types), language=list(self.languages), level=list(range(lo, hi + 1)))
        tasks = planning.round_robin(grid, n, self.seed + round_)
        values = F.from_json("attributes", "array<string>")
        drawn = F.get(values, F.pmod(F.xxhash64(F.lit(self.seed), F.lit(round_), "task", "node_id"), F.size(values)).cast("int"))
        path = F.from_json("path", "array<struct<dimension:string,attribute_value:string>>")
        full = F.when(F.col("open"), F.array_append(path, F.struct("dimension", drawn.alias("attribute_value")))).otherwise(path)
        return tasks.withColumn("path", F.to_json(full)).drop("open", "dimension", "attributes")

    def generate(self, spark: SparkSession, n: int, round_: int = 0) -> DataFrame:
        """Samples of n tasks: all instructions of each reply; failed calls bring none."""
        tasks = self.plan(spark, n, round_).withColumn("path", F.from_json("path", "array<struct<dimension:string,attribute_value:string>>"))
        told = F.array_join(F.transform("path", lambda x: F.concat(x["dimension"], F.lit(": "), x["attribute_value"])), "; ")
        prompt = resources.render(resources.template("generators.topic_tree_instructions", self.overrides), n=1, task_type=F.col("task_type"), difficulty=F.col("level").cast("string"), language=F.col("language"), constraints=F.when(told == "", F.lit(self.domain)).otherwise(told))
        prompt = F.concat(prompt, F.lit(" #"), (F.col("task") + round_ * n).cast("string"))
        replied = settled(self.backend.complete(tasks, prompt, "topic_tree.instructions"))
        topic = F.array_join(F.transform("path", lambda x: x["attribute_value"]), " > ")
        one = replied.select("*", F.posexplode(listed(F.col("reply.content"))).alias("j", "instruction")).filter(truthy("instruction"))
        return as_samples(one.select("instruction", F.lit(self.domain).alias("domain"), F.when(topic == "", F.lit(self.domain)).otherwise(topic).alias("topic"), "task_type", "language", F.col("level").alias("difficulty"), F.lit("topic_tree").alias("source_id"), (F.col("task") * 1024 + F.col("j")).alias("_pos")))


@dataclass
class Personas:
    """Describes the people behind a corpus, those around them, and asks questions in their names."""

    backend: Backend
    corpus: DataFrame
    text: str = "text"
    key: str = "_pos"
    domain: str = "general"
    languages: tuple[str, ...] = ("en",)
    most: int = 500
    rounds: int = 6
    threshold: float = 0.9
    seed: int = 0

    def extracted(self) -> DataFrame:
        docs = self.corpus.filter(strip(F.col(self.text)) != "").select(F.col(self.key).cast("long").alias("k"), strip(F.col(self.text)).alias("t"))
        few = docs.orderBy(planning.draw(self.seed, F.col("k").cast("string")), "k").limit(self.most)
        replied = settled(self.backend.complete(few, resources.render(resources.template("generators.persona"), text=F.col("t")), "persona"))
        return replied.select("k", strip(F.col("reply.content")).alias("persona")).filter(truthy("persona"))

    def expanded(self, first: DataFrame) -> DataFrame:
        """first and the personas that each round finds around the last round's new ones."""
        width = 1 << 20
        pool = frontier = settled(first.withColumns({"hop": F.lit(0)}))
        n = pool.count()
        for hop in range(1, self.rounds + 1):
            if n >= 10 * self.most:
                break
            prompt = resources.render(resources.template("generators.persona_expand"), persona=F.col("persona"))
            replied = settled(self.backend.complete(frontier, prompt, "persona_expand"))
            around = replied.select("k", F.posexplode(listed(F.col("reply.content"))).alias("j", "persona"))
            fresh = around.join(pool.select("persona").distinct(), "persona", "left_anti").groupBy("persona").agg(F.min(F.struct("k", "j")).alias("o"))
            order = F.row_number().over(Window.orderBy("o", "persona"))
            frontier = settled(fresh.select((F.lit(hop * width) + order).cast("long").alias("k"), "persona", F.lit(hop).alias("hop")))
            new = frontier.count()
            if not new:
                break
            n += new
            pool = pool.unionByName(frontier)
        return pool

    def generate(self, spark: SparkSession, n: int, round_: int = 0) -> DataFrame:
        people = dedup.deduplicate(self.expanded(self.extracted()), "persona", "k", self.threshold)
        pairs = planning.paired(n * (round_ + 1), people.select("k", "persona"), "k", list(self.languages)).filter(F.col("pair") >= n * round_)
        prompt = resources.render(resources.template("generators.persona_questions"), persona=F.col("persona"), domain=self.domain, language=F.col("other"))
        replied = settled(self.backend.complete(pairs, F.concat(prompt, F.lit(" #"), F.col("pair").cast("string")), "persona_questions"))
        return as_samples(replied.select(strip(F.col("reply.content")).alias("instruction"), F.lit(self.domain).alias("domain"), "persona", F.col("other").alias("language"), F.lit("persona").alias("source_id"), (F.col("pair") - n * round_).alias("_pos")).filter(truthy("instruction")))


@dataclass
class SeedDataset:
    """New instructions from few-shot prompts over samples that exist."""

    backend: Backend
    seeds: DataFrame
    shots: int = 3
    per_call: int = 5
    seed: int = 0

    def _asked(self, spark: SparkSession, n: int, first: int, draw: int) -> DataFrame:
        """(call, j, instruction): what calls for n instructions bring, calls counted from `first`."""
        calls = spark.range(first, first + -(-n // self.per_call)).withColumnRenamed("id", "call")
        chosen = planning.subsets(calls, "call", self.seeds, "id", self.shots, self.seed + draw)
        shown = chosen.join(self.seeds.filter(truthy("instruction")).select("id", "instruction"), "id").groupBy("call").agg(F.array_sort(F.collect_list(F.struct("nth", "instruction"))).alias("s"))
        examples = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["instruction"])), "\n")
        prompt = resources.render(resources.template("generators.seed_instruct"), examples=examples, n=F.least(F.lit(self.per_call), F.lit(n) - (F.col("call") - first) * self.per_call).cast("string"))
        replied = self.backend.complete(shown, F.concat(prompt, F.lit(f" #{draw}.")), "seed_dataset")
        return settled(replied.select("call", F.posexplode(listed(F.col("reply.content"))).alias("j", "instruction")).filter(F.col("j") < self.per_call))

    def generate(self, spark: SparkSession, n: int, round_: int = 0) -> DataFrame:
        """Asks until n instructions are there, five times at most."""
        rows, had, first = None, 0, 0
        for attempt in range(5):
            more = self._asked(spark, n - had, first, round_ * 5 + attempt)
            new = more.count()
            rows = more if rows is None else rows.unionByName(more)
            had, first = had + new, first + -(-(n - had) // self.per_call)
            if had >= n or not new:
                break
        return as_samples(rows.select("instruction", F.lit("seed_dataset").alias("source_id"), (F.col("call") * self.per_call + F.col("j")).alias("_pos")).orderBy("_pos").limit(n))
