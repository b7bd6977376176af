"""Web-domain normal forms (D1, D2) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip


def _strip_common(c: Column) -> Column:
    s = F.lower(py_strip(c))
    s = F.replace(s, F.lit("http://"), F.lit(""))
    s = F.replace(s, F.lit("https://"), F.lit(""))
    s = F.replace(s, F.lit("www."), F.lit(""))
    return F.regexp_replace(s, r"/+$", "")


def clean_domain(c: Column) -> Column:
    """Lower, trim, drop every http:// https:// www., strip trailing '/',
    keep the part before the first '/'; empty -> null."""
    s = F.split_part(_strip_common(c), F.lit("/"), F.lit(1))
    return F.nullif(s, F.lit(""))


def clean_crm_domain(c: Column) -> Column:
    """As D1 but the path is kept (so CRM domains with a path never match
    a D1 domain, H10); empty -> null."""
    return F.nullif(_strip_common(c), F.lit(""))
