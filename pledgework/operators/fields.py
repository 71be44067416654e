"""Which fields may leave, mappings of output columns to them, and the columns that a mapping makes."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgework.operators.catalogue import TRAITS

#: Profile columns, those of a person, names that are sensitive whatever their metadata say, most columns, longest label and constant.
PROFILE_FIELDS = ("id", "master_id", "email", "phone", "first_name", "last_name", "address1", "city", "region", "postal_code", "country", "first_seen_at", "last_seen_at")
PERSONAL = ("email", "phone", "first_name", "last_name", "address1", "postal_code")
PERSONAL_CANONICAL = (*PERSONAL, "address2", "donor_account_number")
SENSITIVE = r"religio|politic|military|veteran"
MOST, LONGEST_LABEL, LONGEST_VALUE = 5000, 100, 2000
SPEC_KEYS = {"kind", "key", "source", "value", "required"}


class MappingError(ValueError):
    """A mapping that may not be exported; the message starts with the output column."""


@dataclass(frozen=True)
class Field:
    kind: str
    key: str
    source: str | None = None
    pii: bool = False
    sensitive: bool = False

    @property
    def name(self) -> str:
        return ":".join(x for x in (self.kind, self.source, self.key) if x is not None)


def licensed(sources: DataFrame, as_of: dt.date) -> DataFrame:
    """Sources whose values may leave: active, exportable unless they say no, with a licence that hasn't ended. A column that isn't there, or null, stands for yes, yes and no end."""
    ok = F.lit(True)
    for flag in ("is_active", "exportable"):
        if flag in sources.columns:
            ok = ok & F.coalesce(flag, F.lit(True))
    if "license_expires_at" in sources.columns:
        ok = ok & (F.col("license_expires_at").isNull() | (F.col("license_expires_at") >= F.lit(as_of)))
    return sources.filter(ok).select(F.col("id").alias("source_id"), F.col("key").alias("source"))


def offered(attributes: DataFrame, sources: DataFrame, as_of: dt.date) -> DataFrame:
    """(source, key, sensitive) of enrichment that may leave. attributes: source_id, attribute_key and, where known, is_active and sensitive, a row an attribute or a value; one sensitive row makes the attribute so, one inactive row takes it away."""
    flag = lambda name, other: F.coalesce(name, F.lit(other)) if name in attributes.columns else F.lit(other)
    by = attributes.groupBy("source_id", "attribute_key").agg(F.bool_or(flag("sensitive", False)).alias("said"), F.bool_and(flag("is_active", True)).alias("live"))
    return by.filter("live").join(licensed(sources, as_of), "source_id").select("source", F.col("attribute_key").alias("key"), (F.col("said") | F.lower("attribute_key").rlike(SENSITIVE)).alias("sensitive"))


def registry(enrichment: DataFrame | None = None, canonical: dict[str, bool] | None = None, role: str = "admin") -> dict[tuple[str, str | None, str], Field]:
    """The fields by (kind, source, key). enrichment: what offered() gives, at most MOST rows, else an error; canonical: key -> whether it is sensitive. Viewers get none that is sensitive."""
    out = [Field("profile", k, pii=k in PERSONAL) for k in PROFILE_FIELDS]
    out += [Field("trait", t.key) for t in TRAITS]
    out += [Field("canonical", k, pii=k in PERSONAL_CANONICAL, sensitive=s) for k, s in sorted((canonical or {}).items())]
    if enrichment is not None:
        rows = enrichment.orderBy("source", "key").limit(MOST + 1).collect()  # a catalogue, bounded
        if len(rows) > MOST:
            raise ValueError(f"more than {MOST} fields of enrichment")
        out += [Field("enrichment", r["key"], r["source"], True, r["sensitive"]) for r in rows]
    return {(f.kind, f.source, f.key): f for f in out if role != "viewer" or not f.sensitive}


def everything(allowed: dict, labels: bool = False) -> dict[str, dict]:
    """A mapping of all fields but the sensitive ones. labels: canonical keys and the master id keep their own names, others say that they are computed."""
    out: dict[str, dict] = {}
    for f in allowed.values():
        if f.sensitive:
            continue
        name = f.name if not labels else f.key if f.kind == "canonical" or f.key == "master_id" else f"computed__{f.kind}__{f.source or ''}__{f.key}"
        if name in out:
            raise MappingError(f"{name}: two fields have this name")
        out[name] = {"kind": f.kind, "key": f.key} | ({"source": f.source} if f.source else {})
    return out


def sensitive(mapping: dict, allowed: dict) -> list[str]:
    """Names of the sensitive fields that a mapping takes."""
    found = (allowed.get((s.get("kind"), s.get("source"), s.get("key"))) for s in mapping.values())
    return sorted({f.name for f in found if f and f.sensitive})


def validated(mapping: dict, allowed: dict, include_pii: bool = True, chosen: tuple[str, ...] = ()) -> dict:
    """The mapping, if each column has a fit label and an allowed field. chosen: names of sensitive fields that an administrator approved. Without personal data neither personal fields nor constants are taken."""
    if not isinstance(mapping, dict) or not 1 <= len(mapping) <= MOST:
        raise MappingError(f"mapping: expected 1 to {MOST} columns")
    for target, spec in mapping.items():
        if not isinstance(target, str) or not target.strip() or len(target) > LONGEST_LABEL or re.search(r"[\x00-\x1f]", target):
            raise MappingError(f"{target!r}: isn't a label")
        if not isinstance(spec, dict) or set(spec) - SPEC_KEYS:
            raise MappingError(f"{target}: expected only {sorted(SPEC_KEYS)}")
        if not isinstance(spec.get("kind"), str) or any(spec.get(k) is not None and not isinstance(spec[k], str) for k in ("key", "source")):
            raise MappingError(f"{target}: kind, key and source are text")
        if not isinstance(spec.get("required", False), bool):
            raise MappingError(f"{target}: required is true or false")
        if spec["kind"] == "constant":
            if not isinstance(spec.get("value"), str) or len(spec["value"]) > LONGEST_VALUE:
                raise MappingError(f"{target}: a constant is text of at most {LONGEST_VALUE} characters")
            if not include_pii:
                raise MappingError(f"{target}: constants don't go where personal data may not")
            continue
        field = allowed.get((spec["kind"], spec.get("source"), spec.get("key")))
        if field is None:
            raise MappingError(f"{target}: no such field, or it may not leave")
        if field.sensitive and field.name not in chosen:
            raise MappingError(f"{target}: a sensitive field must be approved")
        if field.pii and not include_pii:
            raise MappingError(f"{target}: personal data may not go there")
    return mapping


def plain(c: Column, kind: str) -> Column:
    """Lists and objects as JSON, numbers and truth values as they are, all else as text."""
    if kind.startswith(("array", "map", "struct", "variant")):
        return F.to_json(c)
    return c if kind in ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double") else c.cast("string")


def enriched(values: DataFrame, sources: DataFrame, pairs: list[tuple[str, str]], as_of: dt.date) -> DataFrame:
    """By profile a column e0, e1.. for each (source, key), the newest value whose licence and whose source's haven't ended; the first typed one that is set, as text. Only the pairs' rows are shuffled, one aggregate for all."""
    typed = [c for c in ("value_text", "value_num", "value_bool", "value_date") if c in values.columns]
    live = values.filter((F.col("license_expires_at").isNull() | (F.col("license_expires_at") >= F.lit(as_of))) & F.col("attribute_key").isin(*{k for _, k in pairs}))
    value, age = F.coalesce(*[F.col(c).cast("string") for c in typed]), F.struct("imported_at", "_value")
    rows = live.join(licensed(sources, as_of), "source_id").withColumn("_value", value)
    fits = [(F.col("source") == s) & (F.col("attribute_key") == k) for s, k in pairs]
    return rows.groupBy("profile_id").agg(*[F.max_by(F.when(f, F.col("_value")), F.when(f, age)).alias(f"e{i}") for i, f in enumerate(fits)])


def mapped(people: DataFrame, mapping: dict, as_of: dt.date, traits: DataFrame | None = None, canonical: DataFrame | None = None, values: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(profile_id, missing, the mapping's columns). people has id and profile columns; traits and canonical have profile_id. Each table is joined once, with the columns that the mapping takes; one that it doesn't take isn't read. missing: a required column is null or empty. Columns that people lacks are null."""
    specs = list(mapping.items())
    pairs = sorted({(s["source"], s["key"]) for _, s in specs if s["kind"] == "enrichment"})
    rows = people.select(F.col("id").alias("profile_id"), *[(F.col(k) if k in people.columns else F.lit(None).cast("string")).alias(f"p_{k}") for k in sorted({s["key"] for _, s in specs if s["kind"] == "profile"})])
    for kind, table in (("trait", traits), ("canonical", canonical)):
        if keys := sorted({s["key"] for _, s in specs if s["kind"] == kind}):
            rows = rows.join(table.select("profile_id", *[(F.col(k) if k in table.columns else F.lit(None).cast("string")).alias(f"{kind[0]}_{k}") for k in keys]), "profile_id", "left")
    if pairs:
        rows = rows.join(enriched(values, sources, pairs, as_of), "profile_id", "left")
    kinds = dict(rows.dtypes)
    made, missing = [], F.lit(False)
    for target, s in specs:
        if s["kind"] == "constant":
            c = F.lit(s["value"])
        else:
            name = f"e{pairs.index((s['source'], s['key']))}" if s["kind"] == "enrichment" else f"{s['kind'][0]}_{s['key']}"
            c = plain(F.col(name), kinds[name])
        if s.get("required"):
            missing = missing | (F.coalesce(c.cast("string"), F.lit("")) == "")
        made.append(c.alias(target))
    return rows.select("profile_id", missing.alias("missing"), *made)
