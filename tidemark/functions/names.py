"""Meaning from names and types: type kinds, XSD types, measure classes, implied foreign keys, display names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

# Type tokens.
NUMERIC = frozenset(
    "int integer bigint smallint tinyint mediumint byteint hugeint int2 int4 int8 serial bigserial smallserial decimal numeric bignumeric dec fixed number float double real float4 float8 money smallmoney".split()
)
SIZED = re.compile(r"^(?:u?int|float)$")
COMPOSITE = frozenset("array map tuple struct nested json jsonb variant object list row set geometry geography".split())
NON_NUMERIC = frozenset(
    "char varchar nchar nvarchar text string clob nvarchar2 varchar2 enum date time datetime timestamp timestamptz datetime2 smalldatetime interval year datetimeoffset bool boolean bit binary varbinary blob bytea bytes uuid guid uniqueidentifier point geopoint polygon linestring multipoint inet cidr macaddr xml".split()
)
# Name parts of measures by additivity, first family wins.
NON_ADDITIVE = "unit_price unitprice unit_cost unitcost _rate rate_ _pct _percent percentage _ratio ratio_ margin _avg avg_ average _price price_ discount_pct tax_rate exchange_rate score rating temperature latitude longitude".split()
SEMI_ADDITIVE = "balance _level level_ stock on_hand onhand inventory headcount occupancy _snapshot".split()
ADDITIVE = "amount _amt amt_ quantity _qty qty_ revenue sales _total total_ _sum sum_ _count count_ cost profit spend volume weight".split()
QUANTITY = "quantity qty count cnt number num amount amt".split()
# Substrings of a type and the XSD type, first hit wins.
XSD = [
    (("tinyint",), "byte"), (("int", "serial"), "integer"), (("char", "text", "string", "clob", "blob"), "string"), (("timestamp", "datetime"), "dateTime"),
]
XSD_LATER = [(("float", "real"), "float"), (("double",), "double"), (("decimal", "numeric", "number", "money"), "decimal"), (("bool", "bit"), "boolean"), (("binary", "bytea"), "base64Binary")]


def type_kind(sql_type: str) -> str:
    """``numeric``, ``non_numeric`` or ``unknown``: composite types first, then numeric tokens, then known others."""
    tokens = re.findall(r"[a-z]+", sql_type.lower())
    if any(t in COMPOSITE for t in tokens):
        return "non_numeric"
    if any(t in NUMERIC or t.removeprefix("u") in NUMERIC for t in tokens):
        return "numeric"
    return "non_numeric" if any(t in NON_NUMERIC for t in tokens) else "unknown"


def xsd_type(name: str, sql_type: str) -> str:
    """The XSD type of a column; a fractional type under a quantity's name counts as integer."""
    low, kind = name.lower(), sql_type.lower()
    if any(q in low for q in QUANTITY) and any(t in kind for t in ("float", "double", "decimal", "numeric", "real")):
        return "integer"
    for parts, xsd in XSD:
        if any(p in kind for p in parts):
            return xsd
    for start in ("date", "time"):
        if kind.startswith(start):
            return start
    return next((xsd for parts, xsd in XSD_LATER if any(p in kind for p in parts)), "string")


def measure_class(name: str, sql_type: str, primary: bool = False, foreign: bool = False) -> tuple[str | None, str | None]:
    """(class, basis): keys and non-numeric columns are attributes by structure; the rest goes by name."""
    if primary or foreign or type_kind(sql_type) == "non_numeric":
        return "attribute", "structural"
    if type_kind(sql_type) == "numeric":
        for family, parts in (("non_additive", NON_ADDITIVE), ("semi_additive", SEMI_ADDITIVE), ("additive", ADDITIVE)):
            if any(p in name.lower() for p in parts):
                return family, "name_pattern"
    return None, None


def _singular(name: str) -> str | None:
    for end, to in (("ies", "y"), ("es", ""), ("s", "")):
        if name.endswith(end):
            return name[: -len(end)] + to
    return None


def variations(table: str) -> list[str]:
    low = table.lower()
    return [v for v in dict.fromkeys([low, _singular(low)]) if v]


def names_table(part: str, tables: Iterable[str]) -> str | None:
    """The table that a word names, as it is or in another number."""
    for t in sorted(tables):
        low = t.lower()
        if part in (low, _singular(low)) or low in (part + "s", part + "es", part[:-1] + "ies" if part.endswith("y") else part):
            return t
    return None


# Column shapes that hold a table's name, in order of trial.
SHAPES = [(r"^(.+?)(?:_)?id$", "suffix_id"), (r"^id[_]?(.+)$", "prefix_id"), (r"^fk[_]?(.+)$", "prefix_fk"), (r"^(.+?)[_]?fk$", "suffix_fk"), (r"^(.+?)(?:_)?sk$", "suffix_sk"), (r"^[a-z]{1,3}_(.+?)(?:_)?sk$", "tpcds_sk")]
TAILS = frozenset(["id", "_id", "sk", "_sk", ""])


def implied_key(table: str, column: str, tables: Mapping[str, tuple[str, ...]], endings: tuple[str, ...] = ()) -> tuple[str, str, str] | None:
    """(target table, target column, pattern) that an undeclared foreign key's name implies.

    First a table's name inside the column's, followed by a key's ending; longer names
    are tried first. Then the known shapes, of which the part must name a table. ``endings``
    are a key's endings beside the usual ones, with or without an underscore before them.
    """
    low, tails = column.lower(), TAILS.union(endings, (f"_{e}" for e in endings))
    target = lambda t: tables[t][0] if tables[t] else "id"
    for name, variation in sorted(((t, v) for t in tables for v in variations(t)), key=lambda p: (-len(p[1]), p)):
        if name.lower() != table.lower() and len(variation) >= 4 and variation in low and low.split(variation, 1)[1] in tails:
            return name, target(name), "embedded_table_name"
    for shape, label in SHAPES:
        if (m := re.match(shape, low)) and len(m[1]) >= 3:
            found = names_table(m[1], tables)
            if found and found.lower() != table.lower():
                return found, target(found), label
    return None


def _key_kind(sql_type: str) -> str:
    """Integers of any size are one kind, and so are texts; other types are only like themselves."""
    low = sql_type.lower()
    if "interval" not in low and re.search(r"int|serial", low):
        return "integer"
    return "text" if re.search(r"char|text|string", low) else ""


def key_confidence(column: str, column_type: str, target_table: str, target_type: str) -> str:
    """high, medium or low: two points for types of one kind (any integers, any texts), two for the table's name, as it is or in another number, or one for a part of it, one for ``id``."""
    low, table = column.lower(), target_table.lower()
    stem = next((m[1] for shape, _ in SHAPES if (m := re.match(shape, low))), low)
    alike = column_type.lower() == target_type.lower() or _key_kind(column_type) == _key_kind(target_type) != ""
    points = 2 * alike + (2 if names_table(stem, [table]) else int(stem in table)) + low.endswith("id")
    return "high" if points >= 4 else "medium" if points >= 2 else "low"


# What follows a table's name in a column that copies its description.
DESCRIPTIONS = ("name", "title", "desc", "description")


def denormalized(table: str, column: str, sql_type: str, tables: Iterable[str]) -> str | None:
    """The other table whose description a text column seems to copy: its name, alone, at the end or before a word for a description; longest names first."""
    low = column.lower()
    if not re.search("char|text|string", sql_type.lower()):
        return None
    for name, variation in sorted(((t, v) for t in tables for v in variations(t)), key=lambda p: (-len(p[1]), p)):
        if name.lower() != table.lower() and len(variation) >= 4 and variation in low and low.split(variation, 1)[1].lstrip("_") in ("", *DESCRIPTIONS):
            return name
    return None


def display_name(name: str) -> str:
    return name.replace("_", " ").title()


def clean_name(name: str) -> str:
    """A name that is safe in a URI."""
    out = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return f"_{out}" if out[:1].isdigit() else out
