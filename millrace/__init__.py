"""A curation engine for training data on PySpark: every dataset is a DataFrame, every step a stage that Catalyst plans."""

import sys

from pyspark import cloudpickle

# Kernels that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from millrace.operators.mapping import map_columns  # noqa: E402
from millrace.operators.reports import inspect, validate  # noqa: E402
from millrace.schema import SAMPLE  # noqa: E402
from millrace.sources.dataset import Dataset, load  # noqa: E402
from millrace.sources.jsonl import read_jsonl  # noqa: E402

__all__ = ["SAMPLE", "Dataset", "inspect", "load", "map_columns", "read_jsonl", "validate"]
