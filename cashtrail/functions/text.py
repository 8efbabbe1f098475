"""Text and label rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six working statuses and the outcome labels of an alert.
CASE_STATUSES = ("New", "Under Review", "Investigating", "Intervention Required", "Resolved", "Closed")
CLOSED_STATUSES = ("Resolved", "Closed")

FORMATS = {
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "account": r"^\d{4}-\d{4}-\d{4}$",
    "ifsc": r"^[A-Z]{4}0[A-Z0-9]{6}$",
    "atm": r"^ATM-[A-Z0-9]{8}$",
}


def clean_absent(value: Column) -> Column:
    """'', 'nan' and NaN all mean absent."""
    text = F.trim(value.cast("string"))
    return F.when((text == "") | (F.lower(text) == "nan"), None).otherwise(value)


def fold_name(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def working_status(status: Column) -> Column:
    return F.when(status.isNull() | (status == "ACTIVE"), "New").otherwise(status)


def rupee_text(amount: Column) -> Column:
    v = F.coalesce(amount, F.lit(0.0))
    return (F.when(v >= 1e7, F.format_string("Rs %.2f Cr", v / 1e7))
            .when(v >= 1e5, F.format_string("Rs %.2f L", v / 1e5))
            .otherwise(F.concat(F.lit("Rs "), F.format_number(v, 0))))


def safe_display_name(name: Column) -> Column:
    """What follows the last slash, without leading dots, in plain characters; only the part that stays is looked at character by character."""
    base = F.ltrim(F.trim(F.substring_index(F.coalesce(name, F.lit("")), "/", -1)), F.lit("."))
    cleaned = F.regexp_replace(F.substring(base, 1, 180), r"[^A-Za-z0-9._ -]", "_")
    return F.when(cleaned == "", "artefact").otherwise(cleaned)


def role_label(hop: Column, is_terminal: Column, is_victim: Column) -> Column:
    return (F.when(is_victim, "victim").when(is_terminal, "terminal")
            .when(hop <= 0, "victim").when(hop >= 4, "terminal").otherwise("mule"))


def alert_headline(rupees: Column, district: Column, cell: Column, start: Column, end: Column, cases: Column) -> Column:
    place = F.when(F.coalesce(district, F.lit("")) == "", cell).otherwise(district)
    return F.concat(rupee_text(rupees), F.lit(" forecast in "), place, F.lit(" within "), start.cast("string"),
                    F.lit("-"), end.cast("string"), F.lit(" min ("), cases.cast("string"), F.lit(" open case(s))"))


def sms_text(subject: Column, body: Column) -> Column:
    return F.substring(F.concat(subject, F.lit(" "), body), 1, 160)


def numbered_id(prefix: str, number: Column) -> Column:
    """``ALT-000001`` style id: at least six digits, longer numbers whole."""
    digits = number.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0")))


def id_number(column) -> Column:
    """The number behind the last dash of an id."""
    return F.substring_index(F.col(column) if isinstance(column, str) else column, "-", -1).cast("long")
