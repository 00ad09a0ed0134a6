"""Column expressions for industry codes.

Codes are strings: one letter for a Section, then 2/3/4/5 digits for
Division, Group, Class and Sub-class. Levels are prefixes of the code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level names and the code length of each level.
LEVEL_LENGTHS = {"Section": 1, "Division": 2, "Group": 3, "Class": 4, "Sub-class": 5}
PREFIX_LEVELS = {"Division": 2, "Group": 3, "Class": 4, "Sub-class": 5}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_code(c, width: int = 5) -> Column:
    """Left-pad with zeros to ``width``; longer values are kept whole
    (Spark's ``lpad`` would cut them)."""
    c = _col(c).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def code_prefix(c, n: int) -> Column:
    """First ``n`` characters of a code (Division = 2, Group = 3, ...)."""
    return F.substring(_col(c).cast("string"), 1, n)


def code_prefixes(c, suffix: str = "") -> dict[str, Column]:
    """All prefix columns of one code, named Division/Group/Class/Sub-class + suffix."""
    return {f"{name}{suffix}": code_prefix(c, n) for name, n in PREFIX_LEVELS.items()}


def code_as_int(c) -> Column:
    """Code -> integer, null when it is not a number (ANSI-safe)."""
    return F.expr(f"try_cast({_sql(c)} as bigint)")


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name")


def synthetic_code(key) -> Column:
    """Deterministic 5-digit code derived from an integer key (fixture rule)."""
    return F.lpad((_col(key) * F.lit(37) % F.lit(100000)).cast("string"), 5, "0")
