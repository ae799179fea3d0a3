"""Redaction of structured payloads: JSON of any shape, field by field.

A batch of payloads is flattened to one table of its texts, each with the field and place that it stands
in.  Rules are matched against whole columns of that table, by the ordered tables of ``vocabulary``; markers
are then put back in place, and each payload is written out again as canonical JSON.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import vocabulary as V

REDACTED = "content string, rules array<string>, paths array<string>, n int, rejected string"
_KIND = pa.struct([("content", pa.string()), ("rules", pa.list_(pa.string())), ("paths", pa.list_(pa.string())), ("n", pa.int32()), ("rejected", pa.string())])


@dataclass
class Leaves:
    """The texts of a batch: payload, field, path, text, and where each stands."""

    payload: list[int] = field(default_factory=list)
    name: list[str | None] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    place: list[tuple] = field(default_factory=list)

    def add(self, number: int, root: list) -> None:
        """List the texts under ``root``, a list of the payload alone, level by level."""
        level = [(root, 0, root[0], "payload", None)]
        while level:
            below = []
            for holder, key, value, path, name in level:
                if isinstance(value, str):
                    for column, x in zip((self.payload, self.name, self.path, self.text, self.place), (number, name, path, value, (holder, key)), strict=True):
                        column.append(x)
                elif isinstance(value, dict):
                    below += [(value, k, v, f"{path}.{k}", k) for k, v in value.items()]
                elif isinstance(value, list):
                    below += [(value, i, v, f"{path}[{i}]", None) for i, v in enumerate(value)]
            level = below


def _matched(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def field_rules(names: list[str | None]) -> np.ndarray:
    """The rule that each field's name calls for, or None."""
    plain = pc.replace_substring(pc.utf8_lower(pa.array(names, pa.string())), "-", "_")
    tests = [_matched(plain, rf"(?s)\A({pattern})\z") for _, pattern in V.FIELD_RULES]
    return np.select(tests, [np.array(rule, object) for rule, _ in V.FIELD_RULES], None) if names else np.zeros(0, object)


def leaf_rules(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the rule recorded, or None, and whether it may not be kept at all."""
    column = pa.array(texts, pa.string())
    broken = {rule: _matched(column, pattern) for rule, pattern in V.SECRET_RULES}
    every, some = np.ones(len(texts), bool), wanted != np.array(None)
    tests, values = [], []
    for secret, called, recorded in V.LEAF_RULES:
        by_field = every if called is None else some if called == "*" else wanted == called
        tests.append((every if secret is None else broken[secret]) & by_field)
        values.append(wanted if recorded is None else np.full(len(texts), recorded, object))
    found = np.select(tests, values, None) if texts else np.zeros(0, object)
    return found, broken["private_key_block"] & ~_matched(column, V.WHOLE_PRIVATE_KEY)


def _redacted(payloads: list[str | None]) -> list[dict | None]:
    roots: list[list | None] = []
    leaves = Leaves()
    for number, text in enumerate(payloads):
        try:
            root = None if text is None else [json.loads(text)]
        except (ValueError, RecursionError):
            root = None
        roots.append(root)
        if root is not None:
            leaves.add(number, root)
    rules, refused = leaf_rules(leaves.text, field_rules(leaves.name))
    rejected = {leaves.payload[i] for i in np.flatnonzero(refused).tolist()}
    told: dict[int, list[tuple[str, str]]] = {}
    for i in np.flatnonzero(rules != np.array(None)).tolist():
        holder, key = leaves.place[i]
        holder[key] = f"[REDACTED:{rules[i]}]"
        told.setdefault(leaves.payload[i], []).append((rules[i], leaves.path[i]))
    out: list[dict | None] = []
    for number, (text, root) in enumerate(zip(payloads, roots, strict=True)):
        if text is None:
            out.append({"content": None, "rules": None, "paths": None, "n": None, "rejected": None})
        elif root is None or number in rejected:
            out.append({"content": None, "rules": [], "paths": [], "n": 0, "rejected": "unsafe_input" if root is None else "malformed_private_key"})
        else:
            marks = told.get(number, [])
            try:
                content = json.dumps(root[0], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except RecursionError:
                out.append({"content": None, "rules": [], "paths": [], "n": 0, "rejected": "unsafe_input"})
                continue
            out.append({"content": content, "rules": sorted({r for r, _ in marks}), "paths": sorted({p for _, p in marks}), "n": len(marks), "rejected": None})
    return out


def redact_json(payload: Column) -> Column:
    """A JSON payload redacted, with its audit; what cannot be read or kept is rejected whole.

    Content is canonical JSON (sorted keys, no blanks).  A null payload gives nulls.
    """

    def run(payloads: pa.Array) -> pa.Array:
        return pa.array(_redacted(payloads.to_pylist()), _KIND)

    return F.arrow_udf(run, REDACTED)(payload)
