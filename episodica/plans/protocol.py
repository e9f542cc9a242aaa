"""Protocol configurations: JSON with inheritance that is pinned by checksum."""

from __future__ import annotations

import json
import re
from pathlib import Path

from ..sources.jsonl import file_sha256


#: Keys that a configuration must have, and what all of this generation share.
REQUIRED = ("schema_version", "human_version", "protocol_id", "prompt", "retrieval", "interaction", "token_budget")
TOP_K, SEARCH_ACTIONS, BUDGET = 3, 4, (8192, 768, 768)


def merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def inherited(path: str | Path) -> dict:
    """The configuration with everything that it inherits. A parent whose bytes changed is an error. A key that stands
    beside ``overrides`` takes the place of what they say for it; then both are laid over the parent."""
    path = Path(path)
    own = json.loads(path.read_text(encoding="utf-8"))
    if (parent := own.pop("extends", None)) is None:
        return own
    parent, want = path.parent / parent, own.pop("extends_sha256", None)
    if file_sha256(parent) != want:
        raise ValueError(f"{parent} is not the parent that {path} names")
    over = own.pop("overrides", None) or {}
    return merged(inherited(parent), over | own)


def checked(config: dict) -> dict:
    """The configuration, if it has all keys and keeps to what this generation froze, also in its longest episode."""
    if missing := sorted(set(REQUIRED) - set(config)):
        raise ValueError(f"the configuration lacks {missing}")
    version = re.fullmatch(r"R3\.(\d+)", str(config["human_version"]))
    if not version or not str(config["protocol_id"]).endswith(f"_v3_{version[1]}_0"):
        raise ValueError("the identifier is not that of the version")
    if config["retrieval"]["top_k"] != TOP_K or config["interaction"]["max_search_actions"] != SEARCH_ACTIONS:
        raise ValueError(f"top_k is {TOP_K} and there are {SEARCH_ACTIONS} search actions")
    b = config["token_budget"]
    if (b["max_model_len"], b["max_new_tokens_per_action"], b["max_observation_tokens"]) != BUDGET:
        raise ValueError(f"the token budget is {BUDGET}")
    last = int(b.get("max_new_tokens_final_action", BUDGET[1]))
    longest = int(b["initial_prompt_tokens"]) + SEARCH_ACTIONS * (BUDGET[1] + BUDGET[2]) + last
    if last < BUDGET[1] or longest > BUDGET[0]:
        raise ValueError(f"the longest episode has {longest} tokens")
    return config


def load(path: str | Path) -> dict:
    return checked(inherited(path))
