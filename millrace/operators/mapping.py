"""Layouts in and out: detection of the input's layout, its projection to samples, and strict export projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import strip
from millrace.schema import FIELDS, as_samples, truthy

#: Layouts by the columns they need, tried in this order.
LAYOUTS: tuple[tuple[str, frozenset[str]], ...] = (
    ("alpaca", frozenset(("instruction", "input", "output"))),
    ("sharegpt", frozenset(("conversations",))),
    ("openai", frozenset(("messages",))),
    ("dpo", frozenset(("prompt", "chosen", "rejected"))),
    ("qa", frozenset(("question", "answer"))),
    ("rlvr", frozenset(("question", "info"))),
    ("pretrain", frozenset(("text",))),
)
_SYNONYMS = {
    "instruction": "prompt query question input user",
    "response": "output answer completion assistant reply",
    "chosen": "preferred accepted positive",
    "rejected": "dispreferred negative worse",
}
SYNONYM = {s: field for field, names in _SYNONYMS.items() for s in names.split()}


def detect(columns: list[str]) -> str | None:
    have = set(columns)
    return next((name for name, needs in LAYOUTS if needs <= have), None)


def _chat(c: str, role: str, text: str, names: dict[str, str]) -> Column:
    def one(x: Column) -> Column:
        told = x[role]
        for old, new in names.items():
            told = F.when(x[role] == old, F.lit(new)).otherwise(told)
        return F.struct(F.coalesce(told, F.lit("user")).alias("role"), F.coalesce(x[text], F.lit("")).alias("content"))

    return F.transform(c, one)


def _layout_fields(layout: str) -> dict[str, tuple[Column, list[str]]]:
    """Target field to its expression and the source columns that it uses up."""
    own = lambda a, b: {b: (F.col(a), [a])}
    if layout == "alpaca":
        both = F.concat_ws("\n", "instruction", F.when(truthy("input"), F.col("input")))
        return {"instruction": (both, ["instruction", "input"]), **own("output", "response")}
    if layout == "sharegpt":
        return {"turns": (_chat("conversations", "from", "value", {"human": "user", "gpt": "assistant"}), ["conversations"])}
    if layout == "openai":
        return {"turns": (_chat("messages", "role", "content", {}), ["messages"])}
    if layout == "dpo":
        return own("prompt", "instruction") | own("chosen", "chosen") | own("rejected", "rejected")
    if layout == "qa":
        return own("question", "instruction") | own("answer", "response")
    if layout == "rlvr":
        return own("question", "instruction") | own("info", "info")
    return own("text", "text")


def map_columns(df: DataFrame, column_map: dict[str, str] | None = None, pos: Column | str | None = None) -> DataFrame:
    """df as samples, in one projection: the user's map first, else the detected layout; then direct names and synonyms,
    the first column winning a field; what is left goes to `extra` as JSON."""
    fields: dict[str, Column] = {}
    used: set[str] = set()
    hidden = {"_pos"} | ({pos} if isinstance(pos, str) else set())
    columns = [c for c in df.columns if c not in hidden]
    if column_map:
        for source, field in column_map.items():
            if source in columns:
                fields[field] = F.col(source)
                used.add(source)
    elif layout := detect(columns):
        for field, (value, sources) in _layout_fields(layout).items():
            fields[field] = value
            used.update(sources)
    for c in columns:
        if c in used:
            continue
        field = c if c in FIELDS else SYNONYM.get(c)
        if field:
            fields.setdefault(field, F.col(c))
            used.add(c)
    rest = [c for c in columns if c not in used]
    own = fields.get("extra")
    if rest:
        more = F.to_json(F.struct(*rest))
        if own is None:
            fields["extra"] = more
        else:
            parts = [F.coalesce(F.from_json(x.cast("string"), "map<string,string>"), F.create_map().cast("map<string,string>")) for x in (own, more)]
            fields["extra"] = F.to_json(F.map_concat(*parts))
    if "info" in fields and "info" in df.columns and not isinstance(df.schema["info"].dataType, T.StringType):
        fields["info"] = F.to_json("info")
    place = pos if isinstance(pos, Column) else F.col(pos or "_pos") if (pos or "_pos") in df.columns else F.lit(None).cast("long")
    return as_samples(df.select(*[v.alias(k) for k, v in fields.items()], place.alias("_pos")), "_pos")


# --- what each output layout asks of a sample, as (condition, message) of the first failure


def gate(layout: str) -> list[tuple[Column, str]]:
    long_enough = lambda c, n: F.length(strip(F.coalesce(F.col(c), F.lit("")))) >= n
    if layout == "sft":
        return [(~truthy("instruction"), "no instruction"), (~truthy("response"), "no response"), (~long_enough("response", 10), "response under 10 characters")]
    if layout == "chat":
        return [(F.coalesce(F.size("turns"), F.lit(0)) < 2, "fewer than 2 turns")]
    if layout == "dpo":
        return [(~truthy("instruction"), "no prompt"), (~truthy("chosen"), "no chosen answer"), (~truthy("rejected"), "no rejected answer"), (F.col("chosen") == F.col("rejected"), "chosen equals rejected")]
    if layout == "rlvr":
        return [(~truthy("instruction"), "no question"), (F.col("info").isNull(), "no info")]
    if layout == "pretrain":
        return [(~truthy("text"), "no text"), (~long_enough("text", 50), "text under 50 characters")]
    raise ValueError(f"unknown layout {layout!r}")


def failure(layout: str) -> Column:
    """Why a sample doesn't fit a layout; null if it does."""
    out = None
    for bad, why in gate(layout):
        out = F.when(bad, why) if out is None else out.when(bad, why)
    return out


def _columns(layout: str) -> list[tuple[str, Column]]:
    if layout == "sft":
        return [("instruction", F.col("instruction")), ("response", F.col("response")), ("system_prompt", F.when(truthy("system_prompt"), F.col("system_prompt")))]
    if layout == "chat":
        return [("conversations", F.transform("turns", lambda t: F.struct(t["role"].alias("from"), t["content"].alias("value"))))]
    if layout == "openai":
        return [("messages", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))]
    if layout == "dpo":
        return [("prompt", F.col("instruction")), ("chosen", F.col("chosen")), ("rejected", F.col("rejected"))]
    if layout == "scored":
        return [("instruction", F.col("instruction")), ("response", F.col("response")), ("quality_score", F.col("quality_score"))]
    if layout == "rlvr":
        return [("question", F.col("instruction")), ("info", F.col("info"))]
    return [("text", F.col("text"))]


EXPORTS = ("sft", "chat", "openai", "dpo", "scored", "rlvr", "pretrain")
_GATES = {"openai": "chat", "scored": "sft"}


class ExportError(ValueError):
    """Samples that don't fit the layout; .messages holds the first ten."""

    def __init__(self, layout: str, total: int, messages: list[str]):
        super().__init__(f"{total} samples don't fit {layout}: " + "; ".join(messages))
        self.total, self.messages = total, messages


def project(samples: DataFrame, layout: str, rename: dict[str, str] | None = None) -> DataFrame:
    """The layout's columns of the samples that fit it."""
    if layout not in EXPORTS:
        raise ValueError(f"unknown layout {layout!r}")
    names = rename or {}
    fit = samples.filter(failure(_GATES.get(layout, layout)).isNull())
    return fit.select("_pos", *[c.alias(names.get(n, n)) for n, c in _columns(layout)])


def export(samples: DataFrame, layout: str, rename: dict[str, str] | None = None) -> DataFrame:
    """All samples in a layout, or ExportError if any doesn't fit: one aggregate over the validity column decides."""
    if layout not in EXPORTS:
        raise ValueError(f"unknown layout {layout!r}")
    why = failure(_GATES.get(layout, layout))
    bad = samples.select("_pos", why.alias("why")).filter("why IS NOT NULL")
    first = bad.orderBy("_pos").limit(10).collect()
    if first:
        raise ExportError(layout, bad.count(), [f"sample {r['_pos']}: {r.why}" for r in first])
    return project(samples, layout, rename)


Stage = Callable[[DataFrame], DataFrame]
