"""Completion backends: a remote function as a stage that adds a struct column
`(content, prompt_tokens, completion_tokens, model, error)`.

A remote stage must be written down before its result is used twice, since a plan that runs again calls again.
"""

from __future__ import annotations

import json
import random
import threading
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts in one request for vectors.
EMBEDDED = 100
REPLY = "struct<content:string,prompt_tokens:bigint,completion_tokens:bigint,model:string,error:string>"


class Backend(Protocol):
    def complete(self, df: DataFrame, prompt: Column, stage: str, out: str = "reply", role: str = "model") -> DataFrame:
        """df with the replies to `prompt` in `out`; null prompts are not sent and have null replies."""


def tokens(text: Column) -> Column:
    """Tokens by the rule of four characters each."""
    return F.ceil(F.length(text) / 4).cast("bigint")


@dataclass
class DeterministicBackend:
    """Replies that are a function of stage and prompt alone, as column expressions: for tests and rehearsals.

    Judges give a score of the prompt's digest; list stages a JSON list; the topic tree's stages objects, plain, fenced,
    talked around and cut off, some of them wrong; all else a line that ends in the digest.
    """

    model: str = "deterministic"
    items: int = 3

    def reply(self, stage: str, prompt: Column) -> Column:
        digest = F.md5(F.concat(F.lit(stage + ":"), prompt))
        number = F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint")
        if stage == "quality_filter":
            return F.concat(F.lit('{"score": '), (F.pmod(number, F.lit(101)) / 100.0).cast("string"), F.lit(', "reason": "drawn"}'))
        if stage in ("topic_tree", "persona_expand", "seed_dataset"):
            return F.to_json(F.transform(F.sequence(F.lit(1), F.lit(self.items)), lambda i: F.concat(F.lit(f"{stage} "), F.substring(digest, i * 4 - 3, F.lit(4)))))
        if stage == "topic_tree.dimension":
            index = lambda i: F.when(F.pmod(number, F.lit(16)) == 5, F.lit(0)).otherwise(i - 1).cast("string")
            told = F.transform(F.sequence(F.lit(1), F.lit(self.items)), lambda i: F.concat(F.lit('"v'), F.substring(digest, i * 4 - 3, F.lit(4)), F.lit('": ['), index(i), F.lit("]")))
            whole = F.concat(F.lit('{"dimension": "axis '), F.substring(digest, 1, 2), F.lit('", "attributes": {'), F.array_join(told, ", "))
            kind = F.pmod(number, F.lit(4))
            return F.when(kind == 0, F.concat(F.lit("```json\n"), whole, F.lit("}}\n```"))).when(kind == 1, whole).when(kind == 2, F.concat(F.lit("So: "), whole, F.lit("}} I think."))).otherwise(F.concat(whole, F.lit("}}")))
        if stage == "topic_tree.expand":
            more, kind = F.concat(F.lit('["e'), F.substring(digest, 1, 4), F.lit('"]')), F.pmod(number, F.lit(4))
            object_ = lambda word: F.concat(F.lit('{"attributes": '), more, F.lit(f', "completeness": "{word}"}}'))
            return F.when(kind == 0, F.lit("null")).when(kind == 1, object_("complete")).when(kind == 2, object_("infinite")).otherwise(more)
        if stage == "topic_tree.instructions":
            return F.concat(F.lit('["do '), digest, F.lit('"]'))
        if stage == "safety_filter":
            return F.when(F.pmod(number, F.lit(20)) == 0, F.lit('{"safe": false}')).otherwise(F.lit('{"safe": true}'))
        return F.concat(F.lit(f"{stage} reply "), digest)

    def complete(self, df: DataFrame, prompt: Column, stage: str, out: str = "reply", role: str = "model") -> DataFrame:
        work = df.withColumn("__prompt", prompt).withColumn("__content", self.reply(stage, F.col("__prompt")))
        reply = F.struct(F.col("__content").alias("content"), tokens(F.col("__prompt")).alias("prompt_tokens"), tokens(F.col("__content")).alias("completion_tokens"), F.lit(self.model).alias("model"), F.lit(None).cast("string").alias("error"))
        return work.withColumn(out, F.when(F.col("__prompt").isNotNull(), reply)).drop("__prompt", "__content")


    def embed(self, df: DataFrame, text: Column, out: str = "embedding") -> DataFrame:
        """df with vectors of eight numbers from -1 to 1 that the text's digest gives; null texts have none."""
        digest = F.md5(text)
        return df.withColumn(out, F.when(text.isNotNull(), F.array(*[F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("double") / 127.5 - 1 for k in range(8)])))


@dataclass
class Limiter:
    """Adaptive concurrency of one task: a refusal halves it and waits, five successes in a row raise it by one."""

    most: int = 10
    patience: float = 300.0
    limit: int = field(init=False)

    def __post_init__(self):
        self.limit, self.active, self.good, self.waited, self.pause = self.most, 0, 0, 0.0, 1.0
        self.free = threading.Condition()

    def __enter__(self):
        with self.free:
            while self.active >= self.limit:
                self.free.wait()
            self.active += 1

    def __exit__(self, *_):
        with self.free:
            self.active -= 1
            self.free.notify_all()

    def success(self):
        with self.free:
            self.good += 1
            if self.good % 5 == 0:
                self.limit = min(self.most, self.limit + 1)
            if self.good >= 10:
                self.pause, self.waited = 1.0, 0.0
            self.free.notify_all()

    def refused(self, after: float | None = None):
        with self.free:
            self.good, self.limit = 0, max(1, self.limit // 2)
            pause = min(60.0, self.pause if after is None else after)
            self.pause, self.waited = min(60.0, self.pause * 2), self.waited + pause
            if self.waited > self.patience:
                raise TimeoutError(f"refused for {self.waited:.0f} s in all")
        time.sleep(pause)


@dataclass
class HttpBackend:
    """A chat-completion endpoint, called from mapInPandas. `concurrent` bounds the calls at a time of a whole run: it is shared
    among the tasks that can run at once, each with a limiter and thread pool of its own, and no more tasks run than
    calls are allowed. A call that fails for good leaves its message in `error`."""

    url: str
    model: str
    response_model: str | None = None
    embedding_model: str | None = None
    key: str = ""
    concurrent: int = 10
    retries: int = 3
    timeout: float = 300.0
    max_tokens: int | None = None

    def named(self, role: str) -> str:
        if role == "response_model":
            return self.response_model or self.model
        if role == "embedding_model":
            if not self.embedding_model:
                raise ValueError("no embedding model is set")
            return self.embedding_model
        return self.model

    def _post(self, path: str, body: dict, limiter: Limiter) -> dict:
        request = urllib.request.Request(self.url.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})})
        for attempt in range(self.retries + 1):
            try:
                with limiter, urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    told = json.load(answer)
                limiter.success()
                return told
            except urllib.error.HTTPError as e:
                if e.code in (401, 403, 404) or attempt == self.retries:
                    raise
                if e.code == 429:
                    after = e.headers.get("Retry-After", "")
                    limiter.refused(float(after) if after.replace(".", "", 1).isdigit() else None)
                else:
                    time.sleep(min(2**attempt, 30) * random.uniform(0.5, 1))
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(min(2**attempt, 30) * random.uniform(0.5, 1))
        raise AssertionError

    def ask(self, prompt: str, model: str, limiter: Limiter) -> tuple:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}]} | ({"max_tokens": self.max_tokens} if self.max_tokens else {})
        try:
            told = self._post("/chat/completions", body, limiter)
            message, used = told["choices"][0]["message"], told.get("usage") or {}
            return message.get("content") or message.get("reasoning") or "", used.get("prompt_tokens", 0), used.get("completion_tokens", 0), told.get("model", model), None
        except Exception as e:  # a failed call is a row with an error, not a failed job
            return None, 0, 0, model, f"{type(e).__name__}: {e}"

    def _mapped(self, df: DataFrame, value: Column, out: str, kind: str, many) -> DataFrame:
        """df with a column that many(values, limiter, pool) gives for each batch."""
        slots = df.sparkSession.sparkContext.defaultParallelism
        share = max(1, self.concurrent // slots)
        work = df.withColumn("__value", value)
        if slots > self.concurrent:
            work = work.coalesce(self.concurrent)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` {kind}"])

        def run(batches):
            from concurrent.futures import ThreadPoolExecutor

            limiter = Limiter(share)
            with ThreadPoolExecutor(share) as pool:
                for pdf in batches:
                    pdf[out] = many(list(pdf.pop("__value")), limiter, pool)
                    yield pdf

        return work.mapInPandas(run, schema)

    def complete(self, df: DataFrame, prompt: Column, stage: str, out: str = "reply", role: str = "model") -> DataFrame:
        model = self.named(role)

        def one(text, limiter):
            return None if text is None else dict(zip(("content", "prompt_tokens", "completion_tokens", "model", "error"), self.ask(text, model, limiter), strict=True))

        return self._mapped(df, prompt, out, REPLY, lambda texts, limiter, pool: list(pool.map(lambda t: one(t, limiter), texts)))

    def embed(self, df: DataFrame, text: Column, out: str = "embedding") -> DataFrame:
        """df with vectors; texts are sent EMBEDDED at a time, null ones have none."""
        model = self.named("embedding_model")

        def many(texts, limiter, pool):
            told = [k for k, t in enumerate(texts) if t is not None]
            parts = [told[k : k + EMBEDDED] for k in range(0, len(told), EMBEDDED)]
            found = pool.map(lambda ks: self._post("/embeddings", {"model": model, "input": [texts[k] for k in ks]}, limiter)["data"], parts)
            vectors: list = [None] * len(texts)
            for ks, data in zip(parts, found, strict=True):
                for n, row in enumerate(data):
                    vectors[ks[row.get("index", n)]] = row["embedding"]
            return vectors

        return self._mapped(df, text, out, "array<double>", many)
