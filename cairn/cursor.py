"""Opaque page cursors, bound to the filters, order and limit they came from."""

from __future__ import annotations

import base64
import hashlib
import json

DEFAULT_LIMIT, MAX_LIMIT = 50, 500


class CursorError(ValueError):
    """A cursor that is unreadable or belongs to another query."""


def check_limit(limit) -> int:
    if limit is None:
        return DEFAULT_LIMIT
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be a whole number from 1 to {MAX_LIMIT}")
    return limit


def corpus_limit(limit) -> int:
    """The corpus reads' own rule: anything that is no positive whole number counts as 100."""
    return 100 if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1 else limit


def fingerprint(filters: dict, **binding) -> str:
    """A digest of everything that a page's meaning depends on."""
    text = json.dumps({"f": {k: v for k, v in filters.items() if v is not None}, **binding}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def encode(values: list, order: list[str], limit: int, print_: str) -> str:
    body = json.dumps({"lim": limit, "qf": print_, "sort": order, "v": values}, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).rstrip(b"=").decode()


def decode(cursor: str, order: list[str], limit: int, print_: str) -> dict:
    """The keyset values by column, if the cursor belongs to this query."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        values, sort, lim, qf = body["v"], body["sort"], body["lim"], body["qf"]
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("unreadable cursor") from e
    if sort != order or lim != limit or qf != print_ or not isinstance(values, list) or len(values) != len(order):
        raise CursorError("the cursor belongs to another query")
    return dict(zip(order, values, strict=True))
