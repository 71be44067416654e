"""The audience language: validation of JSON definitions, with paths in errors."""

from __future__ import annotations

import datetime as dt
from typing import Any

MAX_DEPTH, MAX_RULES, MAX_WHERE, MAX_VALUES, MAX_TEXT = 5, 50, 20, 200, 4096
NULLS = ("is_null", "is_not_null")
#: Operators by logical type.
OPERATORS: dict[str, tuple[str, ...]] = {
    "text": ("eq", "neq", "in", "not_in", "contains", "starts_with", *NULLS, "exists"),
    "number": ("eq", "neq", "gt", "gte", "lt", "lte", "between", *NULLS, "exists"),
    "date": ("before", "after", "between", "in_last_days", "not_in_last_days", "within_previous_days", *NULLS, "exists"),
    "timestamp": ("before", "after", "between", "in_last_days", "not_in_last_days", "within_previous_days", *NULLS, "exists"),
    "boolean": ("is_true", "is_false", "exists"),
    "enum": ("in", "not_in", "exists"),
}
NO_VALUE = {*NULLS, "is_true", "is_false", "exists"}
RULE_KEYS: dict[str, tuple[set[str], set[str]]] = {  # required, optional
    "profile": ({"type", "field", "operator"}, {"value"}),
    "trait": ({"type", "field", "operator"}, {"value"}),
    "attribute": ({"type", "field", "operator"}, {"value"}),
    "enrichment": ({"type", "source", "field", "operator"}, {"value"}),
    "gift": ({"type", "aggregate", "operator"}, {"value", "where", "window"}),
    "event": ({"type", "aggregate", "operator", "name"}, {"value", "where", "window"}),
    "consent": ({"type", "channel", "status"}, set()),
    "source": ({"type", "source_key", "operator"}, set()),
    "segment": ({"type", "segment_id", "operator"}, set()),
}
AGGREGATES = {"gift": ("count", "sum", "max", "min", "exists"), "event": ("count", "exists")}
GIFT_WHERE = {"fund": "text", "campaign": "text", "appeal_code": "text", "channel": "text", "amount": "number", "is_recurring": "boolean"}
#: Reference tables of a context, and the facts' column that has their key.
RESOURCES = {"source_codes": ("source_codes", "source_code"), "products": ("products", "product_id"), "titles": ("titles", "title_id")}
WINDOW_KEYS = {"last_days": {"days"}, "previous_days": {"days"}, "previous_years": {"years"}, "between": {"from", "to"}, "before": {"date"}, "after": {"date"}}


class SegmentError(ValueError):
    """A definition that breaks the grammar; the message starts with the path."""

    def __init__(self, path: str, message: str):
        super().__init__(f"{path}: {message}")
        self.path = path


def day(value: Any, path: str) -> dt.date:
    try:
        found = dt.date.fromisoformat(str(value)[:10])
    except ValueError:
        raise SegmentError(path, "expected an ISO date") from None
    if not 1900 <= found.year <= 2999:
        raise SegmentError(path, "year must be from 1900 to 2999")
    return found


def whole(value: Any, path: str, most: int = 36_600) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise SegmentError(path, f"expected a whole number from 1 to {most}")
    return value


def value_of(kind: str, operator: str, value: Any, path: str, choices: tuple[str, ...] | None = None) -> Any:
    """The checked operand."""
    def number(x, p):
        if isinstance(x, bool) or not isinstance(x, (int, float)) or x != x or x in (float("inf"), float("-inf")):
            raise SegmentError(p, "expected a number")
        return x

    def text(x, p):
        if not isinstance(x, str) or len(x) > MAX_TEXT:
            raise SegmentError(p, f"expected text of at most {MAX_TEXT} characters")
        if choices and x not in choices:
            raise SegmentError(p, f"{x!r} isn't one of {list(choices)}")
        return x

    at = f"{path}.value"
    if operator not in OPERATORS[kind]:
        raise SegmentError(f"{path}.operator", f"{operator!r} isn't an operator of {kind}")
    if operator in NO_VALUE:
        if value is not None:
            raise SegmentError(at, "this operator takes no value")
        return None
    one = {"text": text, "enum": text, "number": number}.get(kind, day)
    if operator in ("in", "not_in"):
        if not isinstance(value, list) or not 1 <= len(value) <= MAX_VALUES:
            raise SegmentError(at, f"expected 1 to {MAX_VALUES} values")
        return [one(x, f"{at}[{i}]") for i, x in enumerate(value)]
    if operator == "between":
        if not isinstance(value, list) or len(value) != 2:
            raise SegmentError(at, "expected two values")
        low, high = (one(x, f"{at}[{i}]") for i, x in enumerate(value))
        if low > high:
            raise SegmentError(at, "the first value must not be above the second")
        return [low, high]
    if operator.endswith("_days"):
        return whole(value, at)
    return one(value, at)


def window_of(window: Any, path: str) -> dict:
    if not isinstance(window, dict) or window.get("kind") not in WINDOW_KEYS:
        raise SegmentError(path, f"kind must be one of {list(WINDOW_KEYS)}")
    keys = WINDOW_KEYS[window["kind"]]
    if set(window) != {"kind", *keys}:
        raise SegmentError(path, f"expected the keys {sorted({'kind', *keys})}")
    out: dict[str, Any] = {"kind": window["kind"]}
    for k in keys:
        if k == "days":
            out[k] = whole(window[k], f"{path}.days")
        elif k == "years":
            if window[k] != 5:
                raise SegmentError(f"{path}.years", "must be 5")
            out[k] = 5
        else:
            out[k] = day(window[k], f"{path}.{k}")
    if out["kind"] == "between" and out["from"] > out["to"]:
        raise SegmentError(path, "from must not be after to")
    return out


def validate(definition: Any) -> dict:
    """The definition itself if its structure holds; SegmentError otherwise. Fields are checked on compiling."""
    if not isinstance(definition, dict) or set(definition) != {"version", "root"} or definition["version"] != 1:
        raise SegmentError("definition", "expected version 1 and a root")
    rules = 0

    def node(n: Any, path: str, depth: int) -> None:
        nonlocal rules
        if not isinstance(n, dict):
            raise SegmentError(path, "expected an object")
        if "op" in n:
            if depth > MAX_DEPTH:
                raise SegmentError(path, f"groups nest at most {MAX_DEPTH} deep")
            if n["op"] not in ("and", "or") or set(n) - {"op", "rules", "negate"} or not isinstance(n.get("negate", False), bool):
                raise SegmentError(path, "a group has op and/or, rules, and perhaps negate")
            if not isinstance(n.get("rules"), list) or not n["rules"]:
                raise SegmentError(f"{path}.rules", "expected at least one rule")
            for i, r in enumerate(n["rules"]):
                node(r, f"{path}.rules[{i}]", depth + 1)
            return
        rules += 1
        if rules > MAX_RULES:
            raise SegmentError(path, f"at most {MAX_RULES} rules")
        if n.get("type") not in RULE_KEYS:
            raise SegmentError(f"{path}.type", f"expected one of {list(RULE_KEYS)}")
        required, optional = RULE_KEYS[n["type"]]
        if required - set(n):
            raise SegmentError(path, f"{sorted(required - set(n))[0]} is missing")
        if set(n) - required - optional:
            raise SegmentError(path, f"{sorted(set(n) - required - optional)[0]} isn't allowed")
        if n["type"] in AGGREGATES and n["aggregate"] not in AGGREGATES[n["type"]]:
            raise SegmentError(f"{path}.aggregate", f"expected one of {list(AGGREGATES[n['type']])}")
        if n["type"] == "consent" and n["status"] not in ("opted_in", "opted_out", "unknown"):
            raise SegmentError(f"{path}.status", "expected opted_in, opted_out or unknown")
        if n["type"] in ("source", "segment") and n["operator"] not in ("in", "not_in"):
            raise SegmentError(f"{path}.operator", "expected in or not_in")
        if n["type"] == "segment":
            whole(n["segment_id"], f"{path}.segment_id", 2**62)
        if len(n.get("where") or {}) > MAX_WHERE:
            raise SegmentError(f"{path}.where", f"at most {MAX_WHERE} filters")
        if "window" in n:
            window_of(n["window"], f"{path}.window")

    node(definition["root"], "root", 1)
    return definition


def references(definition: dict) -> set[int]:
    """Ids of segments that a definition reads."""
    found: set[int] = set()

    def walk(n: dict) -> None:
        if "op" in n:
            for r in n["rules"]:
                walk(r)
        elif n.get("type") == "segment":
            found.add(n["segment_id"])

    walk(definition["root"])
    return found


def order_of(definitions: dict[int, dict]) -> list[int]:
    """Ids so that each comes after those it reads; a cycle or an unknown id raises."""
    done: list[int] = []
    state: dict[int, int] = {}

    def visit(i: int, trail: tuple[int, ...]) -> None:
        if i not in definitions:
            raise SegmentError(f"segment {trail[-1]}" if trail else "root", f"segment {i} doesn't exist")
        if state.get(i) == 1:
            raise SegmentError(f"segment {i}", f"a cycle: {' > '.join(map(str, (*trail, i)))}")
        if state.get(i) != 2:
            state[i] = 1
            for j in sorted(references(definitions[i])):
                visit(j, (*trail, i))
            state[i] = 2
            done.append(i)

    for i in sorted(definitions):
        visit(i, ())
    return done


def without_rule(definition: dict, path: str) -> dict:
    """The definition without the rule at root.rules[i]...; groups left empty go too."""
    steps = [int(x.split("]")[0]) for x in path.split("[")[1:]]

    def cut(n: dict, at: list[int]) -> dict | None:
        if not at:
            return None
        if "op" not in n or at[0] >= len(n["rules"]):
            raise SegmentError(path, "there is no such rule")
        kept = [x for i, r in enumerate(n["rules"]) if (x := cut(r, at[1:]) if i == at[0] else r) is not None]
        return n | {"rules": kept} if kept else None

    root = cut(definition["root"], steps)
    if root is None:
        raise SegmentError(path, "nothing would be left")
    return {"version": 1, "root": root}


def ads_safe(definition: dict, allowed: set[tuple[str, str]], others: dict[int, dict] | None = None) -> bool:
    """Whether only whitelisted (type, field) rules are used, nested segments included."""
    def ok(n: dict, seen: frozenset[int]) -> bool:
        if "op" in n:
            return all(ok(r, seen) for r in n["rules"])
        if n["type"] == "segment":
            i = n["segment_id"]
            return i not in seen and i in (others or {}) and ok(others[i]["root"], seen | {i})
        return (n["type"], n.get("field") or n.get("name") or n.get("channel") or n.get("source_key") or "*") in allowed or (n["type"], "*") in allowed

    return ok(definition["root"], frozenset())
