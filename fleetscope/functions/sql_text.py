"""Fingerprints of statements and the tables they name, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Repeated groups are possessive (``*+``): they never give characters back, so a literal or
# list of any length is matched in a loop and cannot overflow the matcher's stack.
STRING = r"'(?:[^'\\]++|\\[\s\S]|'')*+'"
DOUBLE_QUOTED = r'"(?:[^"\\]++|\\[\s\S])*+"'
NUMBER = r"\b0x[0-9a-f]+\b|\b[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?\b"
BITS = r"\b[xb]'[0-9a-f]*'"
COMMENT = r"/\*(?:[^*]|\*+[^*/])*\*+/|--[ \t][^\n]*|#[^\n]*"
# One pattern, so that whichever literal starts first wins and quotes inside the other kind are text.
QUOTED = f"{STRING}|{DOUBLE_QUOTED}"
LITERAL = f"{BITS}|{QUOTED}|{NUMBER}"
# Quoted text is kept as it is, so that a comment sign inside it starts nothing.
QUOTED_OR_COMMENT = f"({QUOTED})|{COMMENT}"
SIGNED = r"([=(,<>] ?)[-+] ?\?"
VALUE_LIST = r"\( ?\?(?: ?, ?\?)*+ ?\)"
FINGERPRINT_RULES = ((QUOTED_OR_COMMENT, "$1"), (LITERAL, "?"), (r"\s+", " "), (SIGNED, "$1?"), (VALUE_LIST, "(?+)"))
TABLE_LIST = r"\b(?:FROM|JOIN|UPDATE|INTO)\s+((?:[\w`.$]++(?:\s+(?:AS\s+)?\w+)?\s*,\s*)*+[\w`.$]+)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_fingerprint(text: str | Column) -> Column:
    """Lower case without comments, literals and their signs as ``?``, value lists as ``(?+)``, single spaces."""
    out = F.lower(_col(text))
    for pattern, new in FINGERPRINT_RULES:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def sql_checksum(fingerprint: str | Column) -> Column:
    """Last 16 hexadecimal digits of the digest."""
    return F.substring(F.md5(_col(fingerprint)), 17, 16)


def sql_tables(text: str | Column, default_db: str | Column) -> Column:
    """Distinct ``db.table`` names after FROM, JOIN, UPDATE and INTO, lower case.

    Comma lists are split, quotes are stripped, subqueries contribute their own tables,
    DUAL is dropped, and a bare name belongs to ``default_db``.
    """
    masked = F.regexp_replace(F.upper(_col(text)), QUOTED, "?")
    masked = F.regexp_replace(masked, r"ON\s+DUPLICATE\s+KEY\s+UPDATE", "")
    lists = F.regexp_extract_all(masked, F.lit(TABLE_LIST), F.lit(1))
    names = F.flatten(F.transform(lists, lambda x: F.split(x, r"\s*,\s*")))
    clean = F.transform(names, lambda x: F.replace(F.regexp_extract(x, r"^\s*([\w`.$]+)", 1), F.lit("`"), F.lit("")))
    kept = F.filter(clean, lambda x: x.rlike(r"\w") & (x != "DUAL"))
    return F.array_distinct(F.transform(kept, lambda x: F.lower(
        F.when(F.contains(x, F.lit(".")), x).otherwise(F.concat(_col(default_db), F.lit("."), x)))))
