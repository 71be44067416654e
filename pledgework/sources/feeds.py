"""Records of partner feeds, of six shapes and any fields, as canonical rows. Bodies are read as VARIANT, so no shape needs a schema of its own.

Each row gets a record type and its canonical columns; what else it says is kept by name in `values` (contacts, enrichments, resources) or
`properties` (events), as text, nested objects as JSON. A row that breaks a rule keeps its body and says in `reason` which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that identify a person, in the order of their preference; of them, those that events keep as attributes; the feeds of people.
IDENTITIES = ("zeta_cdp_id", "zeta_uid", "donor_account_number", "hubspot_record_id", "okta_customer_id", "fusionauth_user_id")
LOGINS = ("okta_customer_id", "fusionauth_user_id")
PEOPLE = ("people", "models", "lookups")
TYPES = ("track", "page", "screen", "identify")
LONGEST_KEY = 200
EVENT_FIELDS = ("external_id", "contact_external_id", "email", "phone", "name", "occurred_at", "message_id", "type", "received_at", "context", "properties")
MAP = "map<string,variant>"


def empty() -> Column:
    return F.create_map().cast(MAP)


def as_map(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, MAP)


def text(m: Column, key: str) -> Column:
    """A field's value as text, null if it is empty or not there."""
    return F.nullif(F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", "string"), F.lit(""))


def first(m: Column, *keys: str) -> Column:
    return F.coalesce(*[text(m, k) for k in keys])


def over(under: Column, upper: Column) -> Column:
    """Both maps' entries; upper's count where both have a key."""
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.map_contains_key(upper, k)), upper)


def without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def texts(m: Column) -> Column:
    """Values as text, without those that are null."""
    made = F.transform_values(m, lambda _, v: F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))
    return F.map_filter(made, lambda _, v: v.isNotNull())


def odd(m: Column, key: str) -> Column:
    """Whether a field is there but no object; a null one isn't either."""
    at = F.try_element_at(m, F.lit(key))
    return F.map_contains_key(m, key) & as_map(at).isNull()


def not_text(m: Column, key: str) -> Column:
    at = F.try_element_at(m, F.lit(key))
    return at.isNotNull() & ~F.is_variant_null(at) & (F.schema_of_variant(at) != "STRING")


def own_or(m: Column, key: str, *others: Column) -> Column:
    """The field if the row has it, even empty, else the first of the others."""
    return F.when(F.map_contains_key(m, key), text(m, key)).otherwise(F.coalesce(*others))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def canonical(rows: DataFrame, event_names: tuple[str, ...] = ()) -> DataFrame:
    """The rows (feed, body and others) with record_type, external_id, contact_external_id, key, name, type, message_id, occurred_at, values, properties and reason (null for a good row).

    Feeds other than people, models, lookups, enrichment and resources are events, gifts pass as they are. event_names: names that events
    are brought to when they differ in case and punctuation only. A null feed or body, or a body that is no object, is a reject.
    """
    own = lambda name: F.coalesce(as_map(F.try_element_at("row", F.lit(name))), empty())
    read = rows.withColumn("row", as_map(F.try_parse_json("body")))
    people = F.col("feed").isin(*PEOPLE)
    merged = F.when(people, over(over(own("properties"), own("attributes")), without(F.col("row"), "properties", "attributes"))).when(F.col("feed") == "enrichment", over(own("attributes"), without(F.col("row"), "attributes"))).otherwise(F.col("row"))
    read = read.withColumn("m", merged)
    m, kind = F.col("m"), F.when(people, "contact").when(F.col("feed") == "gifts", "gift").when(F.col("feed") == "enrichment", "enrichment").when(F.col("feed") == "resources", "resource").otherwise("event")
    user = first(m, "user_id", "id")
    cdp, uid = text(m, IDENTITIES[0]), text(m, IDENTITIES[1])
    named = cdp.isNull() & uid.isNull() & user.isNotNull()
    cdp_, uid_ = F.when(named & user.startswith("cdp-"), user).otherwise(cdp), F.when(named & ~user.startswith("cdp-"), user).otherwise(uid)
    person = F.coalesce(text(m, "user_id"), *[text(m, k) for k in IDENTITIES])
    contact = own_or(m, "contact_external_id", person)
    digest = F.sha2(F.to_json(F.array_sort(F.map_entries(texts(without(m, *IDENTITIES, "user_id"))))), 256)
    event_id = own_or(m, "external_id", text(m, "id"))
    raw_name = own_or(m, "name", text(m, "event"), text(m, "type"))
    known = {compact_name(n): n for n in event_names}
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else None
    name = F.coalesce(F.try_element_at(names, compact(raw_name)), raw_name) if known else raw_name
    key = first(m, "key", "id", "source_code")
    by = lambda **of: F.coalesce(*[F.when(F.col("record_type") == k, c) for k, c in of.items()])
    read = read.withColumn("record_type", F.when(F.col("feed").isNotNull(), kind))
    out = read.withColumns({
        "external_id": by(contact=own_or(m, "external_id", cdp_, uid_, *[text(m, k) for k in IDENTITIES[2:]]), gift=text(m, "external_id"), enrichment=F.concat(F.lit("_enrichment:"), own_or(m, "external_id", digest)), event=F.concat(F.lit("_event:"), event_id)),
        "contact_external_id": by(gift=text(m, "contact_external_id"), enrichment=contact, event=contact),
        "key": by(resource=key),
        "name": by(resource=text(m, "name"), event=name),
        "type": by(event=F.when(text(m, "type").isin(*TYPES), text(m, "type"))),
        "message_id": by(event=own_or(m, "message_id", event_id)),
        "occurred_at": by(event=own_or(m, "occurred_at", text(m, "timestamp"))),
    })
    zeta = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in IDENTITIES[:2]]), F.array(cdp_, uid_)), lambda _, v: v.isNotNull())
    event_rest = texts(F.map_filter(m, lambda k, _: ~k.isin(*EVENT_FIELDS, *IDENTITIES, "attributes", "id", "user_id", "event", "timestamp")))
    logins = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in LOGINS]), F.array(*[text(m, k) for k in LOGINS])), lambda _, v: v.isNotNull())
    attributes = texts(own("attributes"))
    out = out.withColumns({
        "values": by(
            contact=F.map_concat(without(texts(m), "user_id", "id", "external_id", *IDENTITIES[:2]), zeta),
            gift=texts(m),
            enrichment=without(texts(m), *IDENTITIES, "user_id", "external_id", "contact_external_id"),
            resource=F.map_concat(F.map_filter(attributes, lambda k, _: ~F.map_contains_key(texts(without(m, "id", "key", "name", "attributes")), k)), texts(without(m, "id", "key", "name", "attributes"))),
            event=F.map_concat(F.map_filter(attributes, lambda k, _: ~F.map_contains_key(logins, k)), logins),
        ),
        "properties": by(event=F.map_concat(F.map_filter(texts(own("properties")), lambda k, _: ~F.map_contains_key(event_rest, k)), event_rest)),
    })
    typed = lambda k: F.col("record_type") == k
    reason = (
        F.when(F.col("feed").isNull(), "no feed")
        .when(F.col("row").isNull(), "no object")
        .when((people | typed("event")) & odd(F.col("row"), "properties"), "properties are no object")
        .when(~typed("gift") & odd(F.col("row"), "attributes"), "attributes are no object")
        .when(people & F.map_contains_key(m, "enrichment"), "enrichment without evidence")
        .when(people & F.col("external_id").isNull(), "no identity")
        .when(typed("enrichment") & (text(m, "vendor").isNull() | text(m, "license_id").isNull() | text(m, "append_date").isNull() | F.col("contact_external_id").isNull()), "no evidence or identity")
        .when(typed("resource") & (F.col("key").isNull() | (F.length("key") > LONGEST_KEY)), "no key")
        .when(typed("resource") & (not_text(m, "name") | not_text(m, "series")), "name or series is no text")
        .when(typed("event") & F.col("external_id").isNull(), "no external id")
        .when(typed("event") & F.col("contact_external_id").isNull() & text(m, "email").isNull() & text(m, "phone").isNull(), "no contact")
    )
    return out.withColumn("reason", reason).drop("row", "m")


def compact_name(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())
