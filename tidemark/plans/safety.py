"""The gate before any query: deny patterns, read-only statements, identifiers and row limits."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

_WRITES = "DROP|DELETE|INSERT|UPDATE|CREATE|ALTER|TRUNCATE"
# Patterns that make a text unsafe.
DENY = (
    rf";.*(?:{_WRITES})",
    r"OR\s+1\s*=\s*1",
    r"AND\s+1\s*=\s*1",
    r"OR\s+'[^']*'\s*=\s*'[^']*'",
    r"'[^']*'\s*--",
    r";\s*;",
    rf";\s*(?:{_WRITES})",
    r"xp_cmdshell|sp_executesql|exec\s*\(",
    r"load_file|into\s+outfile|into\s+dumpfile",
    r"pg_read_file|copy.*from|copy.*to",
    r"information_schema\.(?:user_privileges|schema_privileges|table_privileges)",
    r"pg_catalog\.pg_authid|pg_catalog\.pg_user_mapping",
    r"mysql\.(?:user|db|global_priv|tables_priv|columns_priv|procs_priv|proxies_priv)",
    r"snowflake\.account_usage\.(?:grants_to_users|grants_to_roles|login_history|users)",
)
#: Off by default: they refuse ordinary queries (block comments; any UNION whose later part has a column such as o_custkey).
STRICT = (r"/\*.*\*/", r"UNION\s+(?:ALL\s+)?SELECT\s+.*(?:password|pwd|secret|token|key|admin)")
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
MAX_IDENTIFIER, MAX_TEXT, MAX_ROWS, DEFAULT_ROWS = 128, 100_000, 5000, 1000
_WRITE_NODES = re.compile(r"Insert|Delete|Update|Merge|Create|Drop|Alter|Truncate|Write|Append|Overwrite|Replace|Load|Set|Add|Refresh|Cache|Repair|Analyze")
_METADATA_NODES = re.compile(r"Show|Describe|Explain")


@dataclass(frozen=True)
class Gate:
    kind: str  # SELECT, CTE_SELECT, METADATA, WRITE, UNKNOWN or DENIED
    allowed: bool
    reason: str = ""


def identifier(name: str) -> bool:
    """Whether a name of up to three parts is plain."""
    parts = name.split(".")
    return len(parts) <= 3 and all(IDENTIFIER.match(p) and len(p) <= MAX_IDENTIFIER for p in parts)


def masked(sql: str) -> str:
    """The text with its literals hidden, for logs."""
    return re.sub(r"'(?:[^']|'')*'", "'***'", sql)


def gate(spark: SparkSession, sql: str, strict: bool = False) -> Gate:
    """Classify a text with Spark's parser; only reading statements pass.

    A write anywhere in the tree, under a WITH or a subquery too, is a write.
    """
    text = " ".join(sql.split())
    if not text or len(sql) > MAX_TEXT:
        return Gate("UNKNOWN", False, "empty or too long")
    for pattern in DENY + (STRICT if strict else ()):
        if re.search(pattern, text, re.I):
            return Gate("DENIED", False, f"matches {pattern}")
    try:
        return statement(spark, sql)
    except ParseException as e:
        return Gate("UNKNOWN", False, str(e).split("\n")[0])


def statement(spark: SparkSession, sql: str) -> Gate:
    """What a text that parses is, by its tree alone; nothing runs."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kinds = [n["class"].rpartition(".")[2] for n in json.loads(plan.toJSON())]
    if any(_METADATA_NODES.match(k) for k in kinds[:1]):
        return Gate("METADATA", True)
    if any(_WRITE_NODES.match(k) and k not in ("SetOperation",) for k in kinds) or any(k.endswith(("Command", "Statement")) for k in kinds):
        return Gate("WRITE", False, "only reading statements run")
    return Gate("CTE_SELECT" if kinds[0] == "UnresolvedWith" else "SELECT", True)


def limited(df: DataFrame, rows: int = DEFAULT_ROWS) -> DataFrame:
    """At most ``rows`` rows plus one, which tells whether there were more; whatever LIMIT the text holds."""
    if not 1 <= rows <= MAX_ROWS:
        raise ValueError(f"the limit must lie between 1 and {MAX_ROWS}")
    return df.limit(rows + 1)
