"""Settings as plain dictionaries: defaults, repair, warnings, patches, and loading; driver-side and small."""

from __future__ import annotations

import copy
import json
import os
from typing import Any

from .detectors import RULES
from .masking import Settings

# Defaults and limits.
LABELS = sorted({r.label for r in RULES})
ON = sorted({r.label for r in RULES if r.on})
ACTIONS = ("mask", "warn", "block")
ALLOW_MOST, ALLOW_CHARS = 200, 256
DEFAULTS: dict[str, Any] = {
    "mask": {"builtin_rules": {n: n in ON for n in LABELS}, "rule_actions": {}, "allow_values": [], "secret_prefixes": ["sk-", "ah-"], "custom_words": {}, "custom_word_groups": [], "custom_regexes": [], "sensitive_word_whole": [], "sensitive_disabled": [], "sensitive_word_disabled": {}},
    "command_block": {"mode": "observe", "channels": ["tool"], "allow_patterns": []},
    "session": {"ttl_seconds": 600, "mapping_ttl_seconds": 86400},
    "store": {"retention_days": 7, "trace_keep": 20, "trace_each_bytes": 32 << 20, "trace_total_bytes": 256 << 20},
}
#: Least and most of numbers.
BOUNDS = {("session", "ttl_seconds"): (60, 86400), ("session", "mapping_ttl_seconds"): (60, 30 * 86400), ("store", "retention_days"): (1, 90), ("store", "trace_keep"): (0, 1000), ("store", "trace_each_bytes"): (1024, 256 << 20), ("store", "trace_total_bytes"): (1024, 4 << 30)}


def warnings(config: dict[str, Any]) -> list[str]:
    """What is odd in a configuration: unknown or missing rules, unknown actions, warnings for credentials, long lists, numbers out of bounds."""
    mask, out = config.get("mask", {}), []
    rules = mask.get("builtin_rules", {})
    out += [f"unknown rule {n}" for n in sorted(set(rules) - set(LABELS))] + [f"missing rule {n}" for n in sorted(set(LABELS) - set(rules))]
    for label, action in sorted(mask.get("rule_actions", {}).items()):
        if str(action).strip().lower() not in ACTIONS:
            out.append(f"unknown action {action} of {label}")
    if len(mask.get("allow_values", [])) > ALLOW_MOST:
        out.append(f"more than {ALLOW_MOST} allowed values")
    out += [f"allowed value of more than {ALLOW_CHARS} characters" for v in mask.get("allow_values", []) if len(str(v)) > ALLOW_CHARS]
    for (part, name), (low, high) in BOUNDS.items():
        value = config.get(part, {}).get(name)
        if value is not None and not (isinstance(value, int) and low <= value <= high):
            out.append(f"{part}.{name} is not between {low} and {high}")
    return out


def normalized(config: dict[str, Any]) -> dict[str, Any]:
    """The configuration with defaults filled in, unknown rules and actions dropped, lists trimmed and each value once, and numbers within bounds."""
    out = copy.deepcopy(DEFAULTS)
    for part, values in config.items():
        if isinstance(out.get(part), dict) and isinstance(values, dict):
            out[part] |= {k: copy.deepcopy(v) for k, v in values.items() if k in out[part]}
    mask = out["mask"]
    mask["builtin_rules"] = DEFAULTS["mask"]["builtin_rules"] | {k: bool(v) for k, v in mask["builtin_rules"].items() if k in LABELS}
    mask["rule_actions"] = {k.strip().upper(): a for k, v in mask["rule_actions"].items() if (a := str(v).strip().lower()) in ACTIONS}
    kept = dict.fromkeys(t for v in mask["allow_values"] if (t := str(v).strip()) and len(t) <= ALLOW_CHARS)
    mask["allow_values"] = list(kept)[:ALLOW_MOST]
    mask["secret_prefixes"] = list(dict.fromkeys(t for p in mask["secret_prefixes"] if (t := str(p).strip())))
    mask["custom_word_groups"] = list(dict.fromkeys([*map(str, mask["custom_word_groups"]), *map(str, mask["custom_words"].values())]))
    for (part, name), (low, high) in BOUNDS.items():
        value = out[part][name]
        out[part][name] = min(high, max(low, value)) if isinstance(value, int) else DEFAULTS[part][name]
    return out


def patched(config: dict[str, Any], path: list[str], value: Any) -> dict[str, Any]:
    """The configuration with the entry at ``path`` set, or removed for None; parts on the way are made."""
    out = copy.deepcopy(config)
    here = out
    for p in path[:-1]:
        if not isinstance(here.get(p), dict):
            here[p] = {}
        here = here[p]
    if value is None:
        here.pop(path[-1], None)
    else:
        here[path[-1]] = value
    return out


def load(path: str) -> tuple[dict[str, Any], list[str]]:
    """A file's configuration, repaired, and its warnings; the defaults if there is none or it can't be read."""
    if not os.path.exists(path):
        return normalized({}), []
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except ValueError:
        return normalized({}), ["unreadable configuration"]
    return normalized(found if isinstance(found, dict) else {}), warnings(found if isinstance(found, dict) else {})


def save(path: str, config: dict[str, Any]) -> None:
    """Write the configuration beside the file, then put it in its place."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(config, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.new", path)


def settings(config: dict[str, Any]) -> Settings:
    """Masking settings of a normalized configuration."""
    m = config["mask"]
    return Settings(
        labels=frozenset(n for n, on in m["builtin_rules"].items() if on), prefixes=tuple(m["secret_prefixes"]), words=tuple(m["custom_words"].items()), whole=frozenset(m["sensitive_word_whole"]),
        labels_off=frozenset(m["sensitive_disabled"]), words_off=frozenset((n, w) for n, ws in m["sensitive_word_disabled"].items() for w in ws), patterns=tuple((r["name"], r["pattern"]) for r in m["custom_regexes"]),
        actions=tuple(m["rule_actions"].items()), allow=frozenset(m["allow_values"]),
    )
