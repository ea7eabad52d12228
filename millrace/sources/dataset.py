"""A dataset of samples: a DataFrame in the sample schema with `_pos`, and what is done with one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from millrace.operators import mapping, reports
from millrace.schema import as_samples
from millrace.sources import jsonl


class Dataset:
    """Lazy, unlike a list of samples; `df` is the DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = as_samples(df)

    @classmethod
    def from_jsonl(cls, spark: SparkSession, path: str) -> Dataset:
        return cls(jsonl.read_samples(spark, path))

    def filter(self, condition: Column | str) -> Dataset:
        return Dataset(self.df.filter(condition))

    def save(self, path: str, layout: str = "sft", rename: dict[str, str] | None = None) -> int:
        """One file in a layout; ExportError if a sample doesn't fit."""
        return jsonl.write_file(mapping.export(self.df, layout, rename), path, nulls=False)

    def inspect(self) -> dict:
        return reports.inspect(self.df)

    def validate(self, layout: str, strict: bool = False) -> dict:
        return reports.validate(self.df, layout, strict=strict)

    def health(self, target_topics: list[str] | None = None) -> dict:
        return reports.health(self.df, target_topics)

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self):
        return self.df.orderBy("_pos").toLocalIterator()

    def __repr__(self) -> str:
        return f"Dataset({', '.join(c for c in self.df.columns if c != '_pos')})"


def load(spark: SparkSession, path: str, column_map: dict[str, str] | None = None) -> Dataset:
    """A JSON Lines file in any known layout, mapped to samples."""
    return Dataset(mapping.map_columns(jsonl.read_jsonl(spark, path), column_map))


def convert(spark: SparkSession, source: str, target: str, layout: str, rename: dict[str, str] | None = None) -> int:
    """One layout's file to another's, through the mapper."""
    return load(spark, source).save(target, layout, rename)
