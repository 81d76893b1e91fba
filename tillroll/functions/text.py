"""Column expressions shared by the jobs (all JVM-side, no Python UDFs)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's ``str.strip()`` removes (those with ``str.isspace()``).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B))
              + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c: Column | str) -> Column:
    """Whitespace strip with Python semantics (tabs/newlines too, unlike plain
    ``trim``): a character-set ``btrim``, no regular expression per row."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def header_name(name: str) -> str:
    """Header normalisation: surrounding whitespace removed, inner spaces dropped."""
    return name.strip().replace(" ", "")


def is_cancelled(invoice: Column | str) -> Column:
    """Invoice text starts with "C" (case-sensitive); a null invoice is not cancelled."""
    return F.coalesce(_col(invoice).cast("string").startswith("C"), F.lit(False))


def regex_contains_ci(c: Column | str, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive containment, null -> false.

    Default treats ``pattern`` as a regular expression (the served API's
    behaviour); ``literal=True`` matches the plain text.
    """
    col = _col(c)
    if literal:
        hit = F.lower(col).contains(pattern.lower())
    else:
        hit = col.rlike("(?i)" + pattern)
    return F.coalesce(hit, F.lit(False))


def items_text(items: Column | str) -> Column:
    """Itemset as display text: sorted items joined by ", "."""
    return F.array_join(F.array_sort(_col(items)), ", ")


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole elapsed days between two timestamps (47 h 50 min -> 1)."""
    return F.timestamp_diff("DAY", _col(earlier), _col(later)).cast("int")


def money_to_double(c: Column | str) -> Column:
    return _col(c).cast("double")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
