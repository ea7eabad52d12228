"""Packaged constants: blocked phrases, presets, recipes, prompt templates. All are small and live on the driver."""

from __future__ import annotations

import copy
import logging
import re
from pathlib import Path
from typing import Any

log = logging.getLogger(__name__)

#: Phrases that no sample may hold, whatever the settings.
BLOCKED = frozenset(
    [f"{x} {y}" for x, ys in {"child": ("abuse", "exploitation"), "how to": ("poison", "hack into"), "how to make": ("explosives", "a bomb")}.items() for y in ys]
    + [f"{x} instructions" for x in ("self-harm", "suicide")]
    + [f"{x} weapon" for x in ("chemical", "biological")]
)
_PRESETS: dict[str, tuple[str, str, str]] = {
    "academic": ("", "informal_language marketing opinion_pieces", "Keep a scholarly, neutral register and back claims with evidence."),
    "family_friendly": ("ass cocaine damn drug fuck hell heroin shit", "adult_content violence substance_use profanity", "Stay suitable for children and adults alike."),
    "islamic": ("beer casino gambling poker pornography slot_machine strip_club vodka whiskey wine", "alcohol gambling adult_entertainment pork interest_based_finance", "Respect Islamic values; leave out what they forbid."),
}


def preset(name: str | None) -> dict[str, Any]:
    """Words, topics and the instruction of a cultural preset; an unknown one is reported and empty."""
    if name and name not in _PRESETS:
        log.warning("no preset named %s", name)
    words, topics, told = _PRESETS.get(name or "", ("", "", ""))
    return {"name": name, "blocklist_words": words.split(), "blocklist_topics": topics.split(), "custom_instruction": told}


def _quality(on: bool) -> dict:
    return {"enabled": on, "min_score": 0.7} if on else {"enabled": on}


RECIPES: dict[str, dict[str, Any]] = {
    "sft": {
        "method": "topic_tree", "n": 1000, "topic_tree": {"max_depth": 4, "max_attribute_count": 50, "num_samples_per_node": 10},
        "evolve": {"enabled": False}, "responses": {"enabled": True}, "filters": {"safety": {"enabled": True}, "quality": _quality(True), "template_collapse": {"enabled": True, "action": "report"}},
    },
    "sft_persona": {
        "method": "persona", "n": 5000, "persona": {"source": "corpus.jsonl", "max_personas": 500, "expansion_rounds": 6, "dedup_threshold": 0.9},
        "responses": {"enabled": True}, "filters": {"safety": {"enabled": True}, "quality": _quality(True)},
    },
    "augment": {
        "task": "augment", "method": "seed_dataset", "n": 5000, "evolve": {"enabled": True, "rounds": 1, "strategies": ["deepen", "concretize", "rephrase"]},
        "responses": {"enabled": True}, "filters": {"safety": {"enabled": True}, "quality": _quality(True)},
    },
    "pretrain": {
        "method": "pretrain_rewriter", "n": 1000, "responses": {"enabled": False},
        "filters": {"safety": {"enabled": True}, "quality": _quality(False), "template_collapse": {"enabled": True, "action": "remove", "max_repeat": 3}},
    },
}


def recipe(name: str) -> dict[str, Any]:
    if name not in RECIPES:
        raise KeyError(f"no recipe named {name}; there are {', '.join(sorted(RECIPES))}")
    return copy.deepcopy({"config_version": "0.1", **RECIPES[name]})


TEMPLATES: dict[str, str] = {
    "generators.persona": "Who would write or read this text? Describe that person in one sentence.\n\n{{text}}",
    "generators.persona_expand": "Name people close to this person, as a JSON list of one-sentence descriptions.\n\n{{persona}}",
    "generators.persona_questions": "You are {{persona}}. Ask one question about {{domain}} in {{language}}.",
    "generators.seed_instruct": "Here are some tasks:\n{{examples}}\nWrite {{n}} new ones as a JSON list of strings.",
    "generators.topic_tree": "Name {{n}} different instances of {{subspace}} as a JSON list of strings.",
    "generators.topic_tree_dimension": "Instances of {{subspace}}:\n{{pivots}}\nGive one dimension that tells them apart, none of {{excluded}}, as a JSON object with dimension and attributes.",
    "generators.topic_tree_expand": "Dimension {{dimension}} of {{subspace}} has {{attributes}}. Give what is missing as JSON, or null.",
    "generators.topic_tree_instructions": "Write {{n}} {{task_type}} tasks at level {{difficulty}} in {{language}} on {{constraints}}, as a JSON list.",
    "transformers.evol_deepen": "Ask this with one more level of depth:\n{{instruction}}",
    "transformers.evol_broaden": "Ask for something wider in scope than this:\n{{instruction}}",
    "transformers.evol_concretize": "Make this more specific:\n{{instruction}}",
    "transformers.evol_rephrase": "Say this in other words:\n{{instruction}}",
    "transformers.evol_complicate": "Add a constraint to this:\n{{instruction}}",
    "transformers.evol_switch_task": "Turn this into another kind of task on the same subject:\n{{instruction}}",
    "transformers.response_generator": "{{system_prompt}}\n{{cot}}\nAnswer:\n{{instruction}}",
    "filters.quality_judge": "Rate the answer from 0 to 1 as JSON with score and reason.\nTask: {{instruction}}\nAnswer: {{response}}",
    "filters.safety_check": "Is this safe for {{context}}? {{custom_instruction}} Answer as JSON with safe.\n{{text}}",
    "pretrain.faq": "Recast as questions and answers:\n{{text}}",
    "pretrain.math": "Recast as worked problems:\n{{text}}",
    "pretrain.table": "Recast as tables:\n{{text}}",
    "pretrain.tutorial": "Recast as a tutorial:\n{{text}}",
}
_SLOT = re.compile(r"\{\{(\w+)\}\}")


def template(name: str, overrides: dict[str, str] | None = None) -> str:
    """A template by category.name; an override is a file's path or the text itself."""
    told = (overrides or {}).get(name)
    if told is not None:
        try:
            if Path(told).is_file():
                return Path(told).read_text(encoding="utf-8")
        except OSError:
            pass
        return told
    if name not in TEMPLATES:
        raise KeyError(f"no template named {name}")
    return TEMPLATES[name]


def render(text: str, /, **values):
    """A template filled in one pass: a string for plain values, a Column if any value is one. All slots must be given."""
    from pyspark.sql import Column
    from pyspark.sql import functions as F

    missing = sorted({s for s in _SLOT.findall(text) if s not in values})
    if missing:
        raise KeyError(f"template lacks {', '.join(missing)}")
    if not any(isinstance(v, Column) for v in values.values()):
        return _SLOT.sub(lambda m: str(values[m[1]]), text)
    parts, at = [], 0
    for m in _SLOT.finditer(text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit("")) if isinstance(values[m[1]], Column) else F.lit(str(values[m[1]]))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
