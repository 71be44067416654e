"""Compiles audience definitions to one DataFrame of profile ids.

Every rule becomes a two-valued column; aggregates over gifts and events become conditional aggregates, so a
definition makes one pass over each fact table whatever the number of its rules, and one boolean filter.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgework.operators.rollups import month_shift
from pledgework.operators.scratch import written
from pledgework.operators.traits import global_rank
from pledgework.segments.ast import GIFT_WHERE, RESOURCES, SegmentError, validate, value_of, window_of


@dataclass
class Context:
    """Tables and registries that definitions are compiled against, at one pinned day.

    fields: by rule type, field -> (logical type, choices or None). attributes: one column a key, by profile.
    logins: (profile_id, kind, value) of login providers. A table may be given as a function that makes it when a rule
    needs it.
    """

    as_of: dt.date
    profiles: DataFrame
    fields: dict[str, dict[str, tuple[str, tuple[str, ...] | None]]]
    traits: DataFrame | None = None
    attributes: DataFrame | None = None
    gifts: DataFrame | None = None
    events: DataFrame | None = None
    consents: DataFrame | None = None
    source_keys: DataFrame | None = None
    enrichment: DataFrame | None = None
    source_codes: DataFrame | None = None
    products: DataFrame | None = None
    titles: DataFrame | None = None
    logins: DataFrame | None = None
    segments: dict[int, DataFrame] = field(default_factory=dict)
    donation: str = "donation"
    donation_return: str = "donation_return"
    login_kinds: tuple[str, ...] = ()

    def __getattribute__(self, name: str) -> Any:
        value = object.__getattribute__(self, name)
        if not name.startswith("_") and callable(value):
            value = value()
            object.__setattr__(self, name, value)
        return value


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def predicate(col: Column, kind: str, operator: str, value: Any, as_of: dt.date) -> Column:
    """Null never satisfies, except is_null. An instant is compared by its day's bounds, so filters reach the scan."""
    one = dt.timedelta(days=1)
    back = lambda n: F.lit(as_of - dt.timedelta(days=n))
    if operator == "is_null":
        return col.isNull()
    if operator == "is_not_null":
        return col.isNotNull()
    if operator == "is_true":
        return two_valued(col)
    if operator == "is_false":
        return two_valued(~col)
    if operator == "exists":
        return F.nullif(F.trim(col.cast("string")), F.lit("")).isNotNull()
    if operator == "eq":
        test = col == F.lit(value)
    elif operator == "neq":
        test = col != F.lit(value)
    elif operator == "in":
        test = col.isin(value)
    elif operator == "not_in":
        test = ~col.isin(value)
    elif operator in ("gt", "gte", "lt", "lte"):
        test = {"gt": col > value, "gte": col >= value, "lt": col < value, "lte": col <= value}[operator]
    elif operator == "between":
        test = col.between(*value) if kind == "number" else (col >= F.lit(value[0])) & (col < F.lit(value[1] + one))
    elif operator == "before":
        test = col < F.lit(value)
    elif operator == "after":
        test = col >= F.lit(value + one)
    elif operator == "contains":
        test = col.contains(value)
    elif operator == "starts_with":
        test = col.startswith(value)
    elif operator == "in_last_days":
        test = (col >= back(value - 1)) & (col < back(-1))
    elif operator == "not_in_last_days":
        test = col.isNotNull() & ~((col >= back(value - 1)) & (col < back(-1)))
    else:
        test = (col >= back(value)) & (col < back(0))
    return two_valued(test)


def window_filter(col: Column, window: dict | None, as_of: dt.date, path: str = "window") -> Column:
    """G24."""
    if window is None:
        return F.lit(True)
    w, one = window_of(window, path), dt.timedelta(days=1)
    back = lambda n: F.lit(as_of - dt.timedelta(days=n))
    kind = w["kind"]
    if kind == "last_days":
        test = (col >= back(w["days"] - 1)) & (col < back(-1))
    elif kind == "previous_days":
        test = (col >= back(w["days"])) & (col < back(0))
    elif kind == "previous_years":
        test = (col >= F.lit(month_shift(as_of, -60))) & (col < back(0))
    elif kind == "between":
        test = (col >= F.lit(w["from"])) & (col < F.lit(w["to"] + one))
    elif kind == "before":
        test = col < F.lit(w["date"])
    else:
        test = col >= F.lit(w["date"] + one)
    return two_valued(test)


class Compiler:
    def __init__(self, context: Context):
        self.c, self.columns, self.joins = context, {}, {}
        self.facts: dict[str, list[Column]] = {"gifts": [], "events": []}
        self.marks: dict[str, list[tuple[DataFrame, str]]] = {"gifts": [], "events": []}
        self.unreturned_used = False

    def name(self, prefix: str) -> str:
        self.columns[prefix] = self.columns.get(prefix, 0) + 1
        return f"_{prefix}{self.columns[prefix]}"

    def field(self, rule: dict, path: str) -> tuple[str, tuple[str, ...] | None]:
        known = self.c.fields.get(rule["type"], {})
        if rule["field"] not in known:
            raise SegmentError(f"{path}.field", f"{rule['field']!r} isn't a field of {rule['type']}")
        return known[rule["field"]]

    def table(self, key: str, make) -> None:
        if key not in self.joins:
            self.joins[key] = make()

    def node(self, n: dict, path: str) -> Column:
        if "op" in n:
            parts = [self.node(r, f"{path}.rules[{i}]") for i, r in enumerate(n["rules"])]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if n["op"] == "and" else out | p
            return ~out if n.get("negate") else out
        return getattr(self, n["type"])(n, path)

    def profile(self, r: dict, path: str) -> Column:
        kind, choices = self.field(r, path)
        return predicate(F.col(r["field"]), kind, r["operator"], value_of(kind, r["operator"], r.get("value"), path, choices), self.c.as_of)

    def trait(self, r: dict, path: str) -> Column:
        if r["field"] == "top_5_percent":
            if r["operator"] not in ("is_true", "is_false"):
                raise SegmentError(f"{path}.operator", "expected is_true or is_false")
            self.table("top", lambda: top_share(self.c.traits, self.c.profiles))
            return two_valued(F.col("_top")) == F.lit(r["operator"] == "is_true")
        kind, choices = self.field(r, path)
        value = value_of(kind, r["operator"], r.get("value"), path, choices)
        self.table("traits", lambda: self.c.traits.select(F.col("profile_id").alias("_id"), *[F.col(f).alias(f"_t_{f}") for f in self.c.traits.columns if f != "profile_id"]))
        return predicate(F.col(f"_t_{r['field']}"), kind, r["operator"], value, self.c.as_of)

    def login(self, r: dict, path: str) -> Column:
        """Having a login is one of any provider's; values are compared within the provider that is asked for."""
        value, name, present = value_of("text", r["operator"], r.get("value"), path), self.name("login"), ("exists", "is_not_null", "is_null")
        kinds = self.c.login_kinds if r["operator"] in present else (r["field"],)
        fits = F.lit(True) if r["operator"] in present else two_valued(predicate(F.col("value"), "text", r["operator"], value, self.c.as_of))
        self.joins[name] = self.c.logins.filter(F.col("kind").isin(*kinds)).groupBy(F.col("profile_id").alias("_id")).agg(F.bool_or(fits).alias(name))
        has = two_valued(F.col(name))
        return ~has if r["operator"] == "is_null" else has

    def attribute(self, r: dict, path: str) -> Column:
        if r["field"] in self.c.login_kinds:
            return self.login(r, path)
        kind, choices = self.field(r, path)
        value = value_of(kind, r["operator"], r.get("value"), path, choices)
        self.table("attributes", lambda: self.c.attributes.select(F.col("profile_id").alias("_id"), *[F.col(f).alias(f"_a_{f}") for f in self.c.attributes.columns if f != "profile_id"]))
        return predicate(F.col(f"_a_{r['field']}"), kind, r["operator"], value, self.c.as_of)

    def enrichment(self, r: dict, path: str) -> Column:
        """One row decides if any unexpired value of the source and key fits."""
        kind, choices = self.field(r, path)
        value = value_of(kind, r["operator"], r.get("value"), path, choices)
        col = {"number": "value_num", "date": "value_date"}.get(kind, "value_text")
        name = self.name("enrichment")
        live = self.c.enrichment.filter((F.col("source_key") == r["source"]) & (F.col("attribute_key") == r["field"]) & (F.col("license_expires_at").isNull() | (F.col("license_expires_at") >= F.lit(self.c.as_of))))
        fits = predicate(F.col(col), kind, r["operator"], value, self.c.as_of)
        self.joins[name] = live.groupBy(F.col("profile_id").alias("_id")).agg(F.bool_or(two_valued(fits)).alias(name))
        # a profile without a value is null, which only is_null accepts
        return F.coalesce(F.col(name), F.lit(r["operator"] == "is_null"))

    def consent(self, r: dict, path: str) -> Column:
        name = self.name("consent")
        self.joins[name] = self.c.consents.filter(F.col("channel") == r["channel"]).select(F.col("profile_id").alias("_id"), F.col("status").alias(name))
        return F.coalesce(F.col(name), F.lit("unknown")) == r["status"]

    def source(self, r: dict, path: str) -> Column:
        self.table("source_keys", lambda: self.c.source_keys.select(F.col("profile_id").alias("_id"), F.col("source_keys").alias("_keys")))
        has = two_valued(F.array_contains("_keys", r["source_key"]))
        return has if r["operator"] == "in" else ~has

    def segment(self, r: dict, path: str) -> Column:
        if r["segment_id"] not in self.c.segments:
            raise SegmentError(f"{path}.segment_id", "there is no such segment")
        name = self.name("segment")
        self.joins[name] = self.c.segments[r["segment_id"]].select(F.col("profile_id").alias("_id"), F.lit(True).alias(name)).distinct()
        has = two_valued(F.col(name))
        return has if r["operator"] == "in" else ~has

    def where(self, r: dict, path: str) -> Column:
        out = F.lit(True)
        for key, spec in (r.get("where") or {}).items():
            at = f"{path}.where.{key}"
            if set(spec) - {"operator", "value"} or "operator" not in spec:
                raise SegmentError(at, "expected operator and perhaps value")
            if key.split(".")[0] in RESOURCES:
                out = out & self.resource("gifts" if r["type"] == "gift" else "events", key, spec, at)
                continue
            if r["type"] == "gift" and key in GIFT_WHERE:
                kind, col = GIFT_WHERE[key], F.col(key)
            elif r["type"] == "event" and key.startswith("properties.") and 11 < len(key) <= 211:
                kind, col = "text", F.get_json_object("properties", f"$['{key[11:]}']")
            else:
                raise SegmentError(at, "isn't a filter of this rule")
            out = out & predicate(col, kind, spec["operator"], value_of(kind, spec["operator"], spec.get("value"), at), self.c.as_of)
        return out

    def resource(self, table: str, key: str, spec: dict, path: str) -> Column:
        """Facts are marked by a join with the matching keys of the reference table."""
        column = key.split(".")[1]
        if column not in ("key", "name", "series"):
            raise SegmentError(path, "expected key, name or series")
        fits = predicate(F.col(column), "text", spec["operator"], value_of("text", spec["operator"], spec.get("value"), path), self.c.as_of)
        kind, own = RESOURCES[key.split(".")[0]]
        name = self.name("resource")
        self.marks[table].append((getattr(self.c, kind).filter(fits).select(F.col("key").alias(own), F.lit(True).alias(name)).distinct(), own))
        return two_valued(F.col(name))

    def gift(self, r: dict, path: str) -> Column:
        fits = self.where(r, path) & window_filter(F.col("gift_date"), r.get("window"), self.c.as_of, f"{path}.window")
        return self.aggregate("gifts", r, fits, path)

    def event(self, r: dict, path: str) -> Column:
        fits = (F.col("name") == r["name"]) & self.where(r, path) & window_filter(F.col("day"), r.get("window"), self.c.as_of, f"{path}.window")
        # returned donations count, except where a rule asks for any donation in the last or previous days
        if r["name"] == self.c.donation and r["aggregate"] == "exists" and not r.get("where") and (r.get("window") or {}).get("kind") in ("previous_days", "last_days"):
            self.unreturned_used = True
            fits = fits & ~two_valued(F.col("_returned"))
        return self.aggregate("events", r, fits, path)

    def aggregate(self, table: str, r: dict, fits: Column, path: str) -> Column:
        name, kind = self.name("fact"), "boolean" if r["aggregate"] == "exists" else "number"
        value = value_of(kind, r["operator"], r.get("value"), path)
        made = {
            "count": F.count_if(fits), "exists": F.bool_or(fits), "sum": F.sum(F.when(fits, F.col("amount") if table == "gifts" else F.lit(0))),
            "max": F.max(F.when(fits, F.col("amount") if table == "gifts" else F.lit(None))), "min": F.min(F.when(fits, F.col("amount") if table == "gifts" else F.lit(None))),
        }[r["aggregate"]]
        self.facts[table].append(made.alias(name))
        col = F.col(name)
        if r["aggregate"] in ("count", "sum"):
            col = F.coalesce(col, F.lit(0))
        elif r["aggregate"] == "exists":
            col = two_valued(col)
        return predicate(col, kind, r["operator"], value, self.c.as_of)

    def frame(self, definition: dict) -> DataFrame:
        keep = self.node(validate(definition)["root"], "root")
        out = self.c.profiles
        for table, made in self.facts.items():
            if made:
                fact = getattr(self.c, table)
                for marked, own in self.marks[table]:
                    fact = fact.join(marked, own, "left")
                if table == "events" and self.unreturned_used:
                    back = fact.filter(F.col("name") == self.c.donation_return).select("profile_id", "source_id", "donation_id", F.lit(True).alias("_returned")).distinct()
                    fact = fact.join(back, ["profile_id", "source_id", "donation_id"], "left")
                out = out.join(fact.groupBy(F.col("profile_id").alias("_id")).agg(*made), out["id"] == F.col("_id"), "left").drop("_id")
        for other in self.joins.values():
            out = out.join(other, out["id"] == other["_id"], "left").drop("_id")
        return out.filter(keep).select(F.col("id").alias("profile_id"))


def top_share(traits: DataFrame, profiles: DataFrame, percent: int = 5) -> DataFrame:
    """The profiles with the highest twelve months' giving, ties included, of all with any."""
    given = written(traits.filter("gift_amount_12m > 0").join(profiles.select(F.col("id").alias("profile_id")), "profile_id", "left_semi").select("profile_id", "gift_amount_12m"), "given")
    n = given.count()
    kept = -(-n * percent // 100)
    # rank <= kept holds from the kept-th largest amount up; it is found by an exact distributed row number
    cut = global_rank(given, "place", F.desc("gift_amount_12m"), F.asc("profile_id")).filter(F.col("place") == kept).first() if kept else None
    if cut is None:
        return given.filter("false").select(F.col("profile_id").alias("_id"), F.lit(True).alias("_top"))
    least = cut["gift_amount_12m"]
    return given.filter(F.col("gift_amount_12m") >= F.lit(least)).select(F.col("profile_id").alias("_id"), F.lit(True).alias("_top"))


def compile_segment(definition: dict, context: Context) -> DataFrame:
    """profile_id of the audience."""
    return Compiler(context).frame(definition)


def membership_diff(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows to add and to remove, in one full outer join."""
    both = current.select("profile_id", F.lit(True).alias("was")).join(wanted.select("profile_id", F.lit(True).alias("now")), "profile_id", "full")
    return both.filter("was IS NULL OR now IS NULL").select("profile_id", F.when(F.col("was").isNull(), "add").otherwise("remove").alias("change"))
