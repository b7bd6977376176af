"""Text functions over whole documents.

All are built-in string expressions (``regexp_count``, ``regexp_replace``,
``split``/``slice``) evaluated per row inside generated code; a document is
never cut before it is counted or searched.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

# whitespace as Python's str.split() sees it (ASCII and Unicode spaces)
_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, f"^{_WS}|{_WS}$", "")


def title_case(c: Column) -> Column:
    """Python ``str.title()``: every run of letters starts upper and goes on lower ('c-level' -> 'C-Level')."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)")), F.initcap), "")


def flags_differ(stored: Column, found: Column) -> Column:
    """A stored count that differs from the text's; a document without a stored count is not compared."""
    return F.coalesce(stored != found, F.lit(False))


def truncate_reasoning(c: Column, limit: int = config.REASONING_MAX_CHARS) -> Column:
    """Text longer than ``limit`` characters -> first ``limit`` + '...';
    null -> ''."""
    return (F.when(c.isNull(), F.lit(""))
             .when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("...")))
             .otherwise(c))


def count_marker(c: Column, marker: str) -> Column:
    """Case-sensitive count of a literal marker (non-overlapping)."""
    return F.regexp_count(c, F.lit(_regex_literal(marker))).cast("int")


def _regex_literal(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch for ch in s)


def highlight(c: Column, marker: str, icon: str) -> Column:
    """Prefix every exact marker (e.g. '**URGENT:**') with an icon."""
    return F.regexp_replace(c, _regex_literal(marker), (icon + " " + marker).replace("\\", "\\\\").replace("$", "\\$"))


def format_research_document(c: Column) -> Column:
    """Both highlights, URGENT first."""
    return highlight(highlight(c, config.URGENT_MARKER, "🚨"), config.ACTION_MARKER, "✅")


def words(c: Column) -> Column:
    """Whitespace-separated words (Python ``str.split()``: no empty items)."""
    return F.filter(F.split(c, _WS), lambda w: w != F.lit(""))


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(words(c))).cast("int")


def truncate_document(c: Column, max_words: int = config.DOCUMENT_MAX_WORDS) -> tuple[Column, Column]:
    """More than ``max_words`` words -> first ``max_words`` joined
    by a space + notice; returns (text, was_truncated)."""
    w = words(c)
    cut = F.size(w) > max_words
    text = F.when(cut, F.concat(F.array_join(F.slice(w, 1, max_words), " "), F.lit(config.TRUNCATION_NOTICE))) \
            .otherwise(c)
    return text, F.coalesce(cut, F.lit(False))


def document_validity(doc: Column, status: Column, word_count_stat: Column | None = None) -> Column:
    """Null when valid, else the reason (first failing check)."""
    wc = word_count_stat if word_count_stat is not None else F.lit(None).cast("int")
    return (F.when(doc.isNull(), F.lit("Missing 'research_document' field"))
             .when(status.isNull(), F.lit("Missing 'status' field"))
             .when(status != F.lit("completed"), F.concat(F.lit("Status is '"), status, F.lit("', expected 'completed'")))
             .when(F.length(doc) < config.DOC_MIN_CHARS,
                   F.concat(F.lit("Document too short: "), F.length(doc).cast("string"),
                            F.lit(f" chars (minimum {config.DOC_MIN_CHARS})")))
             .when(wc < config.DOC_MIN_WORDS,
                   F.concat(F.lit("Word count too low: "), wc.cast("string"),
                            F.lit(f" (minimum {config.DOC_MIN_WORDS})"))))


def company_name_or_unknown(c: Column) -> Column:
    """D22 helper: missing company name -> 'Unknown Company'."""
    return F.coalesce(c, F.lit("Unknown Company"))


def document_summary(c: Column) -> list[Column]:
    """Word count, URGENT and ACTION counts, has_content (words > 0)."""
    n = word_count(c)
    # has_content: any non-whitespace character (same as words > 0, without a second split)
    content = F.coalesce(F.regexp_like(c, F.lit(r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                                                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")), F.lit(False))
    return [n.alias("word_count"), count_marker(c, "URGENT").alias("urgent_flags"),
            count_marker(c, "ACTION").alias("action_flags"), content.alias("has_content")]
