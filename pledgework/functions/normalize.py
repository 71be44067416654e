"""Normalisation and validation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: E-mail length limits and the pattern of an address.
EMAIL = r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1", "on", "t"), ("false", "no", "n", "0", "off", "f")


def trim_all(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def email(c: Column) -> Column:
    """trimmed, lower-case, or null. Internationalised domains aren't supported and give null."""
    x = F.lower(trim_all(c))
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    ok = x.rlike(EMAIL) & (F.length(local) <= 64) & (F.length(x) <= 254) & (F.length(domain) <= 253) & ~x.contains("..") & ~local.startswith(".") & ~local.endswith(".")
    return F.when(ok, x)


def phone_us(c: Column) -> Column:
    """E.164 under the North American plan, extension dropped, else null."""
    bare = F.regexp_replace(F.lower(c), r"\s*(x|ext\.?|extension)\s*\d+\s*$", "")
    digits = F.regexp_replace(bare, r"\D", "")
    ten = F.when(digits.rlike(r"^1\d{10}$"), F.substring(digits, 2, 10)).when(digits.rlike(r"^\d{10}$"), digits)
    return F.when(ten.rlike(r"^[2-9]\d{2}[2-9]\d{6}$"), F.concat(F.lit("+1"), ten))


def external_id(source: Column, c: Column) -> Column:
    """source:id of at most 200 characters."""
    x = blank_to_null(c)
    return F.when(F.length(x) <= 200, F.concat_ws(":", source, x))


def name(c: Column) -> Column:
    """inner white space collapsed; title case only if all upper or all lower."""
    x = F.nullif(F.regexp_replace(trim_all(c), r"\s+", " "), F.lit(""))
    title = F.array_join(F.transform(F.split(F.lower(x), r"(?<=[^a-z])"), lambda w: F.initcap(w)), "")
    return F.when((x == F.upper(x)) | (x == F.lower(x)), title).otherwise(x)


def postal(c: Column, country: Column) -> Column:
    """five digits in the US, else collapsed."""
    x = F.regexp_replace(trim_all(c), r"\s+", " ")
    us = F.upper(F.coalesce(country, F.lit("US"))).isin("US", "USA", "UNITED STATES")
    return F.nullif(F.when(us, F.nullif(F.regexp_extract(x, r"^(\d{5})", 1), F.lit(""))).otherwise(x), F.lit(""))


def number(c: Column) -> Column:
    """$ and , off; must be finite."""
    x = F.try_cast(F.regexp_replace(trim_all(c), r"[$,]", ""), "double") if hasattr(F, "try_cast") else F.regexp_replace(trim_all(c), r"[$,]", "").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def boolean(c: Column) -> Column:
    x = F.lower(trim_all(c))
    return F.when(x.isin(*TRUE_WORDS), True).when(x.isin(*FALSE_WORDS), False)


def mixed_date(c: Column, configured: str = "yyyy-MM-dd") -> tuple[Column, Column]:
    """the configured form, ISO, MM/DD/YYYY, Mon DD, YYYY; and a warning: null, date_fallback_format or date_ambiguous."""
    def parse(x: Column, form: str, shape: str) -> Column:
        return F.when(x.rlike(shape), F.try_to_timestamp(x, F.lit(form)).cast("date"))

    x = trim_all(c)
    forms = (("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("MMM dd, yyyy", r"^[A-Z][a-z]{2} \d{2}, \d{4}$"))
    shapes = dict(forms)
    first = parse(x, configured, shapes.get(configured, ".*"))
    rest = [parse(x, f, s) for f, s in forms if f != configured]
    found = F.coalesce(first, *rest)
    slash = x.rlike(r"^(0[1-9]|1[0-2])/(0[1-9]|1[0-2])/\d{4}$") & (F.substring(x, 1, 2) != F.substring(x, 4, 2))
    warning = F.when(found.isNull() | first.isNotNull(), F.lit(None).cast("string")).when(slash, "date_ambiguous").otherwise("date_fallback_format")
    return found, warning


def signed_amount(amount: Column, refund: Column) -> Column:
    """below 1e12, two decimals at most, negative only for refunds, refunds always negative; else null."""
    x = amount.cast("decimal(18,6)")
    ok = (F.abs(x) < F.lit(1_000_000_000_000)) & (x == F.round(x, 2)) & ((x >= 0) | refund)
    return F.when(ok, F.when(refund, -F.abs(x)).otherwise(x).cast("decimal(14,2)"))


def canonical_key(c: Column) -> Column:
    """lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def sensitive(c: Column) -> Column:
    """F23."""
    return c.rlike("(?i)religio|politic|military|veteran")


def ip_prefix(c: Column) -> Column:
    """version 4 to /24; version 6, written in full or with ::, to its first three groups."""
    six = F.concat(F.array_join(F.transform(F.slice(F.split(F.split(F.lower(c), "::")[0], ":"), 1, 3), lambda g: F.coalesce(F.nullif(F.regexp_replace(g, "^0+", ""), F.lit("")), F.lit("0"))), ":"), F.lit("::"))
    return F.when(c.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.regexp_replace(c, r"\.\d+$", ".0")).when(c.contains(":"), six)


def clamp_time(at: Column, received: Column) -> tuple[Column, Column]:
    """outside [received - 730 days, received + 7 days] the time is the receipt's, and flagged."""
    inside = at.between(received - F.expr("INTERVAL 730 DAY"), received + F.expr("INTERVAL 7 DAY"))
    keep = F.coalesce(inside, F.lit(False))
    return F.when(keep, at).otherwise(received), ~keep


def csv_safe(c: Column) -> Column:
    """F32: an apostrophe before what a spreadsheet would run."""
    return F.when(c.rlike(r"^\s*[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def mask_pii(c: Column) -> Column:
    """e-mail addresses and phone numbers inside text."""
    mails = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "***@***")
    return F.regexp_replace(mails, r"\+?\d[\d ().-]{7,}\d", "***")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """F8: HMAC by nested digests over padded keys; no Python in the rows."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def letters_only(c: Column) -> Column:
    """F29."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


def google_email(c: Column) -> Column:
    """without dots in the name part of gmail addresses."""
    x = F.lower(trim_all(c))
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    return F.when(domain.isin("gmail.com", "googlemail.com"), F.concat(F.regexp_replace(local, r"\.", ""), F.lit("@"), domain)).otherwise(x)


def trigrams(c: Column) -> Column:
    """the distinct trigrams of the words, two spaces before and one after each."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.round(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), 6)


def master_id(issued_ms: Column, key: Column, prefix: str = "mid_") -> Column:
    """the prefix, ten characters of the time and sixteen of a digest, in Crockford's alphabet; the same for the same input."""
    alphabet = "0123456789abcdefghjkmnpqrstvwxyz"
    bits = F.concat(F.lpad(F.conv(issued_ms.cast("string"), 10, 2), 50, "0"), *[F.lpad(F.conv(F.substring(F.sha2(key, 256), i, 10), 16, 2), 40, "0") for i in (1, 11)])
    digits = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.substring(F.lit(alphabet), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.concat(F.lit(prefix), F.array_join(digits, ""))
