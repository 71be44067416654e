"""The audience language on hand rows: operators, windows, limits, errors."""

import datetime as dt
from decimal import Decimal

import pytest

from pledgework.segments import ast, templates
from pledgework.segments.ast import SegmentError
from pledgework.segments.compiler import Context, compile_segment, membership_diff

DAY = dt.date(2024, 12, 31)
FIELDS = {
    "profile": {"first_name": ("text", None), "region": ("text", None), "first_seen": ("date", None)},
    "trait": {"ltv_total": ("number", None), "gift_amount_12m": ("number", None), "donor_status": ("enum", ("active", "lapsed", "prospect")), "is_recurring_active": ("boolean", None), "last_gift_date": ("date", None)},
    "enrichment": {"score": ("number", None)},
}


@pytest.fixture(scope="module")
def context(spark):
    d = dt.date
    profiles = spark.createDataFrame([(1, "A%_", "TX", d(2024, 12, 31)), (2, "Bob", "OK", d(2024, 12, 1)), (3, None, None, d(2020, 1, 1))], "id long, first_name string, region string, first_seen date")
    traits = spark.createDataFrame([(1, Decimal(100), Decimal(100), "active", True, d(2024, 12, 31)), (2, Decimal(50), Decimal(50), "lapsed", False, d(2024, 12, 1))], "profile_id long, ltv_total decimal(14,2), gift_amount_12m decimal(14,2), donor_status string, is_recurring_active boolean, last_gift_date date")
    gifts = spark.createDataFrame([(1, Decimal(10), d(2024, 12, 31), "Mission%_", True, "a"), (1, Decimal(20), d(2024, 12, 1), "Other", False, None), (2, Decimal(5), d(2023, 1, 1), "Other", False, "b")], "profile_id long, amount decimal(14,2), gift_date date, fund string, is_recurring boolean, source_code string")
    events = spark.createDataFrame([(1, 1, "donation", d(2024, 12, 30), "d1", '{"k":"v"}'), (1, 1, "donation_return", d(2024, 12, 31), "d1", "{}"), (2, 1, "donation", d(2024, 12, 29), "d2", "{}")], "profile_id long, source_id int, name string, day date, donation_id string, properties string")
    consents = spark.createDataFrame([(1, "email", "opted_in"), (2, "email", "opted_out")], "profile_id long, channel string, status string")
    keys = spark.createDataFrame([(1, ["crm"]), (2, ["crm"]), (3, [])], "profile_id long, source_keys array<string>")
    enrichment = spark.createDataFrame([(1, "crm", "score", None, Decimal(9), None, DAY), (2, "crm", "score", None, Decimal(10), None, d(2024, 12, 30))], "profile_id long, source_key string, attribute_key string, value_text string, value_num decimal(14,2), value_date date, license_expires_at date")
    codes = spark.createDataFrame([("a", "Alpha", "s1"), ("b", "Beta", "s2")], "key string, name string, series string")
    return Context(DAY, profiles, FIELDS, traits, None, gifts, events, consents, keys, enrichment, codes)


P, T = (lambda f, o, v=None: templates.rule("profile", f, o, v)), (lambda f, o, v=None: templates.rule("trait", f, o, v))
GIFT = {"type": "gift", "aggregate": "count", "operator": "gte", "value": 1}
CASES = [
    (P("first_name", "eq", "Bob"), [2]), (P("first_name", "neq", "Bob"), [1]), (P("first_name", "in", ["Bob", "A%_"]), [1, 2]), (P("first_name", "not_in", ["Bob"]), [1]),
    (P("first_name", "contains", "%_"), [1]), (P("first_name", "starts_with", "A%"), [1]), (P("first_name", "is_null"), [3]), (P("first_name", "is_not_null"), [1, 2]), (P("first_name", "exists"), [1, 2]),
    (T("ltv_total", "gt", 50), [1]), (T("ltv_total", "gte", 50), [1, 2]), (T("ltv_total", "lt", 100), [2]), (T("ltv_total", "lte", 100), [1, 2]), (T("ltv_total", "between", [50, 99]), [2]), (T("ltv_total", "is_null"), [3]),
    (P("first_seen", "before", "2024-12-01"), [3]), (P("first_seen", "after", "2024-12-01"), [1]), (P("first_seen", "between", ["2024-12-01", "2024-12-31"]), [1, 2]), (P("first_seen", "in_last_days", 1), [1]),
    (P("first_seen", "in_last_days", 31), [1, 2]), (P("first_seen", "not_in_last_days", 30), [2, 3]), (P("first_seen", "within_previous_days", 30), [2]),
    (T("is_recurring_active", "is_true"), [1]), (T("is_recurring_active", "is_false"), [2]), (T("donor_status", "in", ["lapsed"]), [2]), (T("donor_status", "not_in", ["lapsed"]), [1]), (T("top_5_percent", "is_true"), [1]), (T("top_5_percent", "is_false"), [2, 3]),
    (GIFT | {"value": 2}, [1]), (GIFT | {"operator": "lt"}, [3]), (GIFT | {"aggregate": "sum", "operator": "lt", "value": 6}, [2, 3]), (GIFT | {"aggregate": "min", "operator": "lt", "value": 100}, [1, 2]), (GIFT | {"aggregate": "max", "operator": "gte", "value": 20}, [1]),
    (GIFT | {"where": {"fund": {"operator": "contains", "value": "%_"}}}, [1]), (GIFT | {"window": {"kind": "last_days", "days": 31}}, [1]), (GIFT | {"window": {"kind": "previous_days", "days": 30}}, [1]), (GIFT | {"window": {"kind": "before", "date": "2023-01-02"}}, [2]),
    (GIFT | {"window": {"kind": "after", "date": "2024-12-30"}}, [1]), (GIFT | {"window": {"kind": "previous_years", "years": 5}}, [1, 2]), (GIFT | {"window": {"kind": "between", "from": "2023-01-01", "to": "2023-01-01"}}, [2]),
    (GIFT | {"where": {"source_codes.name": {"operator": "eq", "value": "Alpha"}}}, [1]), (templates.done("donation", {"kind": "last_days", "days": 30}), [2]), (templates.done("donation", {"kind": "after", "date": "2024-01-01"}), [1, 2]),
    (templates.done("donation", None, {"properties.k": {"operator": "eq", "value": "v"}}), [1]), ({"type": "consent", "channel": "email", "status": "unknown"}, [3]), ({"type": "source", "source_key": "crm", "operator": "not_in"}, [3]),
    ({"type": "enrichment", "source": "crm", "field": "score", "operator": "gte", "value": 1}, [1]), (templates.group("or", P("region", "eq", "TX"), negate=True), [2, 3]), (templates.group("or", P("first_name", "eq", "' OR 1=1"), P("region", "eq", "OK")), [2]),
]


@pytest.mark.parametrize("rule,ids", CASES)
def test_operator(context, rule, ids):
    assert sorted(r["profile_id"] for r in compile_segment(templates.definition(rule), context).collect()) == ids


BAD = [
    ({"version": 2, "root": {}}, "definition"), (templates.definition(templates.group("and")), "root.rules"), (templates.definition(P("nope", "eq", "x")), "root.rules[0].field"), (templates.definition(P("first_name", "gt", "x")), "root.rules[0].operator"),
    (templates.definition(P("first_name", "in", [])), "root.rules[0].value"), (templates.definition(P("first_name", "in", [1])), "root.rules[0].value[0]"), (templates.definition(T("ltv_total", "between", [2, 1])), "root.rules[0].value"), (templates.definition(P("first_seen", "in_last_days", 0)), "root.rules[0].value"),
    (templates.definition(GIFT | {"window": {"kind": "previous_years", "years": 4}}), "root.rules[0].window.years"), (templates.definition(GIFT | {"where": {"nope": {"operator": "eq", "value": "x"}}}), "root.rules[0].where.nope"), (templates.definition(GIFT | {"extra": 1}), "root.rules[0]"),
    (templates.definition({"type": "segment", "segment_id": 9, "operator": "in"}), "root.rules[0].segment_id"), (templates.definition(T("donor_status", "in", ["rich"])), "root.rules[0].value[0]"),
]


@pytest.mark.parametrize("definition,path", BAD)
def test_error_path(context, definition, path):
    with pytest.raises(SegmentError) as e:
        compile_segment(definition, context)
    assert e.value.path == path


def test_limits(context):
    deep = P("first_name", "exists")
    for _ in range(6):
        deep = templates.group("and", deep)
    for root in (deep, templates.group("or", *[P("first_name", "exists")] * 51)):
        with pytest.raises(SegmentError):
            ast.validate({"version": 1, "root": root})


def test_templates_hold():
    made = templates.lifecycle() | templates.audited()
    assert len(made) == 29
    for d in made.values():
        ast.validate(d)


def test_references_and_cycles():
    seg = lambda i: templates.definition({"type": "segment", "segment_id": i, "operator": "in"})
    leaf = templates.definition(P("first_name", "exists"))
    assert ast.order_of({1: seg(2), 2: seg(3), 3: leaf}) == [3, 2, 1]
    with pytest.raises(SegmentError):
        ast.order_of({1: seg(2), 2: seg(1)})
    assert ast.ads_safe(leaf, {("profile", "first_name")}) and not ast.ads_safe(seg(1), {("profile", "first_name")}, {1: seg(1)})


def test_rule_delta_prunes():
    d = {"version": 1, "root": templates.group("and", P("region", "exists"), templates.group("or", P("first_name", "exists")))}
    assert ast.without_rule(d, "root.rules[1].rules[0]")["root"]["rules"] == [P("region", "exists")]


def test_membership(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "profile_id long") for x in ([1, 2], [2, 3]))
    assert sorted(map(tuple, membership_diff(a, b).collect())) == [(1, "remove"), (3, "add")]
