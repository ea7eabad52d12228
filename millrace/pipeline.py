"""Runs with a quota: generate, transform, filter and write, in at most six rounds, until exactly n samples survive.

A round is one plan. Its survivors are written to a folder of its own and the state beside it is replaced by a rename (on the file system of the folder),
so a run that stops is resumed from its last whole round, and a round that is repeated overwrites itself.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import filters, reports
from millrace.operators.dedup import settled

ROUNDS = 6


class ConfigChanged(RuntimeError):
    """A run is resumed with other settings than it began with."""


class CheckpointError(RuntimeError):
    """The state of a run can't be read."""


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def _file(spark: SparkSession, path: str):
    """A path and its file system, as Spark knows it; without checksum files beside it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.setVerifyChecksum(False)
    fs.setWriteChecksum(False)
    return fs, there


@dataclass
class State:
    config: str
    rounds: int = 0
    written: int = 0
    counts: dict[str, int] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the state beside its name and renames it, on whatever file system the folder is."""
        fs, there = _file(spark, path)
        mine = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        out = fs.create(mine, True)
        out.write(json.dumps(self.__dict__).encode())
        out.close()
        fs.delete(there, False)
        fs.rename(mine, there)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State | None:
        """The state, or that which a writer left that stopped before its renaming; none if there is neither."""
        for name in (path, f"{path}.new"):
            fs, there = _file(spark, name)
            if fs.exists(there):
                data = fs.open(there)
                try:
                    return cls(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")))
                except (ValueError, TypeError) as e:
                    raise CheckpointError(f"{name} can't be read: {e}") from e
                finally:
                    data.close()
        return None


@dataclass
class Pipeline:
    """generate(spark, n, round) gives samples; stages change them or add reject reasons, the empty-response rule between
    transformers and filters. Filters over all samples of a round (collapse, dedup) are stages like others."""

    generate: Callable[[SparkSession, int, int], DataFrame]
    transformers: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    filters: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    over_generate: float = 1.0
    check_empty: bool = True

    def staged(self, samples: DataFrame) -> DataFrame:
        """samples with reject_reason, nothing removed."""
        for t in self.transformers:
            samples = t(samples)
        samples = filters.empty_response(samples, self.check_empty)
        for f in self.filters:
            samples = f(samples)
        return samples

    def run(self, spark: SparkSession, n: int, out: str, config: dict | None = None, resume: bool = False) -> dict:
        """Writes exactly n survivors as Parquet below `out` (fewer only if the rounds run out) and returns counts by reason."""
        mark, told = f"{out}/state.json", config_hash(config or {})
        state = State.load(spark, mark) if resume else None
        if state is not None and state.config != told:
            raise ConfigChanged("the settings differ from those the run began with")
        state = state or State(told)
        while state.written < n and state.rounds < ROUNDS:
            left = n - state.written
            made = self.generate(spark, math.ceil(left * self.over_generate), state.rounds)
            done = settled(self.staged(made))
            found = {r.reason: r.n for r in reports.rejections(done).collect()}
            if not found:
                break
            kept = filters.survivors(done).orderBy("_pos").limit(left)
            kept.write.mode("overwrite").parquet(f"{out}/round={state.rounds}")
            for k, v in found.items():
                state.counts[k] = state.counts.get(k, 0) + v
            state.written += min(left, found.get("passed", 0))
            state.rounds += 1
            state.save(spark, mark)
        return {"written": state.written, "rounds": state.rounds, "counts": state.counts}

    @staticmethod
    def output(spark: SparkSession, out: str) -> DataFrame:
        return spark.read.option("basePath", out).parquet(f"{out}/round=*")

    @staticmethod
    def summary(spark: SparkSession, out: str) -> dict:
        """What a run did: samples made, kept and rejected by reason, the share kept, rounds, and tokens by stage."""
        state = State.load(spark, f"{out}/state.json")
        if state is None:
            raise CheckpointError(f"no run in {out}")
        made = sum(state.counts.values())
        rows = Pipeline.output(spark, out)
        used = Pipeline.usage(rows).groupBy("stage").agg(F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c")).orderBy("stage").collect() if "_usage" in rows.columns else []
        rejected = {k: v for k, v in sorted(state.counts.items()) if k != "passed"}
        return {"generated": made, "written": state.written, "rejected": rejected, "kept": round(state.counts.get("passed", 0) / made, 4) if made else 0.0, "rounds": state.rounds, "tokens": {r.stage: {"prompt": r.p, "completion": r.c} for r in used}}

    @staticmethod
    def usage(df: DataFrame) -> DataFrame:
        """(stage, prompt_tokens, completion_tokens) of all calls whose tokens came along in `_usage`."""
        return df.select(F.explode("_usage").alias("u")).select("u.*")
