"""Settings in layers: defaults, then a recipe, then a YAML or JSON file, then dotted pairs."""

from __future__ import annotations

import copy
import json
import warnings
from pathlib import Path
from typing import Any

from millrace import resources

VERSION = "0.1"
_TREE = {"max_depth": 4, "max_attribute_count": 50, "num_samples_per_node": 10}
_PERSONA = {"source": None, "text_field": "text", "max_personas": 500, "expansion_rounds": 6, "dedup_threshold": 0.9}
_LLM = {"model": "gpt-4o-mini", "response_model": None, "embedding_model": None, "base_url": None, "api_key_env": "OPENAI_API_KEY", "max_concurrent": 10, "max_retries": 3, "timeout": 300, "pricing": None}
_FILTERS = {
    "safety": {"enabled": True, "cultural_context": None, "blocklist_words": [], "blocklist_topics": []},
    "quality": {"enabled": False, "min_score": 0.7},
    "template_collapse": {"enabled": False, "action": "report", "prefix_length": 50, "max_repeat": 3},
}
DEFAULTS: dict[str, Any] = {
    "n": 100, "method": "topic_tree", "task": "generate", "config_version": VERSION, "domain": "general", "seed": None, "languages": ["en"],
    "difficulty": [1, 5], "task_types": ["qa", "explain", "compare", "creative"], "over_generate_factor": 1.0, "output": "output.jsonl",
    "topic_tree": _TREE, "persona": _PERSONA, "llm": _LLM, "filters": _FILTERS, "prompts": {},
    "evolve": {"enabled": False, "strategies": ["deepen", "concretize", "complicate"], "rounds": 1}, "responses": {"enabled": True, "use_cot": False, "max_tokens": None},
}


def merge(base: dict, over: dict) -> dict:
    """Deep merge; lists are replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def value(text: str) -> Any:
    """yes/true, no/false, a number, else the text."""
    low = text.lower()
    if low in ("true", "yes"):
        return True
    if low in ("false", "no"):
        return False
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def dotted(pairs: dict[str, Any]) -> dict:
    """{'a.b': 1} to {'a': {'b': 1}}."""
    out: dict = {}
    for k, v in pairs.items():
        at = out
        *path, last = k.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return out


def _file(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need a YAML library; give a .json file") from e
    return yaml.safe_load(text) or {}


def load(recipe: str | None = None, path: str | None = None, pairs: dict[str, Any] | None = None) -> dict:
    out = copy.deepcopy(DEFAULTS)
    for layer in (resources.recipe(recipe) if recipe else {}, _file(path) if path else {}, dotted(pairs or {})):
        if layer.get("config_version", VERSION) != VERSION:
            warnings.warn(f"settings are of version {layer['config_version']}, this is {VERSION}", stacklevel=2)
        out = merge(out, layer)
    return out
