"""Scalar rules as Column expressions.

Everything here stays in generated JVM code; no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Missing-code sentinels of the report files.
SENTINEL_CODES = ("*", "NA", "NI", "UNK")
# Severity letters that count as serious.
SERIOUS_CODES = ("G", "H", "I", "J", "K", "L")
# The survey type of a standard inspection, and what a citation of one says.
STANDARD_SURVEY = "Health Standard"
HEALTH_CITATION = "Health"
STANDARD_DEFICIENCY = "Y"
# Ownership roles left out of the current-owner records.
EXCLUDED_CURRENT_ROLES = (
    "W-2 MANAGING EMPLOYEE",
    "5% OR GREATER MORTGAGE INTEREST",
    "5% OR GREATER SECURITY INTEREST",
    "CONTRACTED MANAGING EMPLOYEE",
)
# Roles kept from change-of-ownership filings.
CHANGE_ROLES = (
    "OPERATIONAL/MANAGERIAL CONTROL",
    "5% OR GREATER INDIRECT OWNERSHIP INTEREST",
    "CORPORATE OFFICER",
    "5% OR GREATER DIRECT OWNERSHIP INTEREST",
    "CORPORATE DIRECTOR",
    "LIMITED PARTNERSHIP INTEREST",
    "GENERAL PARTNERSHIP INTEREST",
)


def quarter_of_date(day: Column) -> Column:
    """Ordinal quarter ``year*4 + (quarter-1)`` of a date column."""
    return F.year(day) * 4 + F.quarter(day) - 1


def quarter_label(ordinal: Column) -> Column:
    return F.concat(
        F.floor(ordinal / 4).cast("int").cast("string"),
        F.lit("Q"),
        (ordinal % 4 + 1).cast("int").cast("string"),
    )


def quarter_ordinal(label: str) -> int:
    year, quarter = label.split("Q")
    return int(year) * 4 + int(quarter) - 1


def quarter_from_text(text: Column, first: str, last: str) -> Column:
    """Ordinal quarter of ``YYYY/MM/DD`` text; NULL when malformed or outside the window."""
    parts = F.split(F.trim(text), "/", 3)
    year = F.try_element_at(parts, F.lit(1)).try_cast("int")
    month = F.try_element_at(parts, F.lit(2)).try_cast("int")
    ordinal = year * 4 + F.floor((month - 1) / 3).cast("int")
    inside = (
        (F.size(parts) == 3)
        & month.between(1, 12)
        & ordinal.between(quarter_ordinal(first), quarter_ordinal(last))
    )
    return F.when(inside, ordinal)


def is_real_code(code: Column) -> Column:
    return (F.trim(code) != "") & ~F.trim(code).isin(*SENTINEL_CODES)


def flexible_date(text: Column) -> Column:
    """First ``m/d/yyyy`` anywhere in the text, else an ISO date, else NULL."""
    pattern = r"(\d{1,2})/(\d{1,2})/(\d{4})"
    trimmed = F.trim(text)
    year = F.regexp_extract(trimmed, pattern, 3)
    month = F.lpad(F.regexp_extract(trimmed, pattern, 1), 2, "0")
    day = F.lpad(F.regexp_extract(trimmed, pattern, 2), 2, "0")
    slashed = F.concat_ws("-", year, month, day)
    return F.when(trimmed.rlike(pattern), slashed.try_cast("date")).when(
        trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), trimmed.try_cast("date")
    )


def owner_token(owner_type: Column, name: Column) -> Column:
    return F.regexp_replace(F.upper(F.concat_ws("|", owner_type, name)), "[^A-Z0-9]+", "")


def strip_owner_kind(token: Column) -> Column:
    return F.regexp_replace(token, "^(INDIVIDUAL|ORGANIZATION)", "")


def normalize_name(text: Column) -> Column:
    """Case-folded, whitespace-collapsed name; blank becomes NULL.

    Folding is upper-then-lower, which unifies letters with several lower forms
    (for example the two sigmas), plus the sharp s, whose folded form is two letters.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u00df\u1e9e]", "ss")
    folded = F.lower(F.upper(plain))
    collapsed = F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))
    return F.when(collapsed != "", collapsed)


def category_value(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit("__MISSING__")).otherwise(trimmed)


def stable_hex(*parts) -> Column:
    """First 16 hex digits of SHA-256 over ``|``-joined parts; hex order is integer order."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256), 1, 16)


def stable_modulo(n: Column, *parts) -> Column:
    """The full 64-bit unsigned hash modulo ``n``, exact through decimal arithmetic."""
    value = F.conv(stable_hex(*parts), 16, 10).cast("decimal(20,0)")
    return (value % n.cast("decimal(20,0)")).cast("long")


def stable_modulo60(n: Column, *parts) -> Column:
    """60-bit variant (15 hex digits), which fits a signed long in any SQL engine."""
    return F.conv(F.substring(stable_hex(*parts), 1, 15), 16, 10).cast("long") % n


def log1p(value: Column) -> Column:
    return F.log1p(value.cast("double"))


def sigmoid(value: Column) -> Column:
    bounded = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), value))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded))


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL-safe ratio: undefined (NULL) when the denominator is zero."""
    return F.when(denominator != 0, numerator / denominator)


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """Band label: the first ``(upper, label)`` with ``value <= upper``, else ``last``."""
    start = F.when(value <= steps[0][0], steps[0][1])
    return reduce(lambda acc, s: acc.when(value <= s[0], s[1]), steps[1:], start).otherwise(last)


def support_band(reports: Column) -> Column:
    return ladder(reports, [(9, "1-9"), (49, "10-49"), (199, "50-199")], "200+")


def claim_band(claims: Column) -> Column:
    return ladder(claims, [(20, "11-20"), (50, "21-50")], "51+")


def history_band(inspections: Column) -> Column:
    return ladder(inspections, [(1, "sparse_1")], "higher_history_2+")


def parse_number(text: Column) -> Column:
    """Number with thousands commas; NULL when blank, malformed or not finite."""
    value = F.regexp_replace(F.trim(text), ",", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def parse_flag(text: Column) -> Column:
    token = F.lower(F.trim(text))
    # The words that count as true and false.
    return F.when(token.isin("t", "true", "yes", "y", "1"), 1.0).when(
        token.isin("f", "false", "no", "n", "0"), 0.0
    )


def number_error(text: Column) -> Column:
    """True where non-blank text is not a finite number."""
    return (F.coalesce(F.trim(text), F.lit("")) != "") & parse_number(text).isNull()


def flag_error(text: Column) -> Column:
    return (F.coalesce(F.trim(text), F.lit("")) != "") & parse_flag(text).isNull()


def npi_error(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike("^[0-9]{10}$")


def claims_error(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return ~trimmed.rlike("^[0-9]+$") | F.coalesce(trimmed.try_cast("long") < 11, F.lit(True))


def cost_error(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    value = trimmed.try_cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0)
    return (trimmed != "") & bad


def is_standard_survey(survey_type: Column) -> Column:
    return F.trim(F.coalesce(survey_type, F.lit(""))) == STANDARD_SURVEY


def is_serious_citation(survey_type: Column, standard: Column, severity: Column) -> Column:
    """A standard deficiency of a health survey with a serious severity letter."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return (blank(survey_type) == HEALTH_CITATION) & (blank(standard) == STANDARD_DEFICIENCY) & blank(severity).isin(*SERIOUS_CODES)
