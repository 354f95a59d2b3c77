"""Column functions over page blocks, captions and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, collapse

#: How headings and captions begin.
HEADING = r"(?i)^(?:\d+(?:\.\d+)*\.?\s+)?(?:abstract|introduction|related work|method(?:ology)?|experiments?|results?|discussion|conclusion|references)\b"
CAPTION = r"(?i)^(?:(?:fig(?:ure)?\.?)|table) *(\d+[A-Za-z]?)\b"
#: Words that name a section's type, tested in this order.
SECTION_WORDS = (
    ("background", ("introduction", "related work", "background", "preliminar", "motivation")),
    ("method", ("method", "approach", "model", "framework", "algorithm", "architecture", "system")),
    ("experiment", ("experiment", "result", "evaluation", "benchmark", "dataset", "comparison", "empirical", "ablation")),
    ("discussion", ("discussion", "conclusion", "limitation", "future work", "summary")),
    ("references", ("reference",)),
)
#: Words that name a figure's type, tested in this order.
FIGURE_WORDS = (
    ("architecture", ("architecture", "framework", "pipeline", "network")),
    ("ablation", ("ablation", "component analysis")),
    ("result", ("result", "comparison", "performance", "qualitative")),
)


def word_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def _letters(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[^\p{L}]", ""))


def visual_key(label: Column) -> Column:
    """A label's number, with the letter of a part, in lower case: what mentions are joined by; null without a number."""
    return F.lower(F.nullif(F.regexp_extract(label, r"(\d+[A-Za-z]?)", 1), F.lit("")))


def core_key(key: Column) -> Column:
    """The leading number of a key: the parent of a sub-figure; null for supplementary keys."""
    return F.nullif(F.regexp_extract(key, r"^(\d+)", 1), F.lit(""))


def strip_marker(token: Column) -> Column:
    return F.trim(F.regexp_replace(token, "[()]", ""))


#: What a page number looks like, and what a section title never does.
PAGE_NUMBERS = (r"^[-–—·\s]*\d+[-–—·\s]*$", r"(?i)^[-–—·\s]*[ivxlcdm]+[-–—·\s]*$")
FORMULA = r"(?i)arg\s*min|^[=+\-]|[{}]{2}"


def _page_number(low: Column) -> Column:
    return (word_count(low) <= 8) & (low.rlike(PAGE_NUMBERS[0]) | low.rlike(PAGE_NUMBERS[1]))


def is_page_number(text: Column) -> Column:
    return _page_number(collapse(text))


def _heading(low: Column, size: Column, median: Column) -> Column:
    short = (F.char_length(low) <= 160) & (word_count(low) <= 18) & ~low.rlike(r"[.。]$")
    readable = _letters(low) >= F.greatest(F.lit(3.0), F.char_length(low) * F.lit(0.4))
    return short & readable & (low.rlike(HEADING) | (size >= F.greatest(F.lit(12.0), median * 1.25)))


def is_heading(text: Column, size: Column, median: Column) -> Column:
    return bind(collapse(text), lambda low: _heading(low, size, median))


def heading_confidence(size: Column, median: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.7) + F.greatest(size - median, F.lit(0.0)) / 20)


def _caption(low: Column, kind: str | None = None) -> Column:
    named = {"figure": "(?i)^fig", "table": "(?i)^table", None: ""}[kind]
    return low.rlike(CAPTION) & low.rlike(named)


def is_caption(text: Column, kind: str | None = None) -> Column:
    """Whether a block is a caption: a figure's, a table's, or either (no kind)."""
    return _caption(collapse(text), kind)


def caption_label(text: Column) -> Column:
    return F.nullif(F.regexp_extract(collapse(text), CAPTION, 0), F.lit(""))


def block_role(text: Column, y0: Column, y1: Column, size: Column, page_height: Column, median: Column) -> Column:
    """page_number, header, footer, heading, caption or body, in that order of precedence.

    White space is collapsed once a block, also where the role is filtered by.
    """
    top, bottom = y1 <= page_height * 0.09, y0 >= page_height * 0.91

    def role(low: Column) -> Column:
        small = (F.char_length(low) <= 220) & (word_count(low) <= 30)
        return (
            F.when((top | bottom) & _page_number(low), "page_number").when(top & small, "header").when(bottom & small, "footer")
            .when(_heading(low, size, median), "heading").when(_caption(low), "caption").otherwise("body")
        )

    return bind(collapse(text), role)


def _by_words(low: Column, table, other: str) -> Column:
    out = None
    for kind, words in table:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(other)


def section_type(title: Column) -> Column:
    low = F.lower(collapse(title))
    return F.when((low == "abstract") | F.startswith(low, F.lit("abstract ")), "abstract").otherwise(_by_words(low, SECTION_WORDS, "other"))


def figure_type(caption: Column) -> Column:
    return _by_words(F.lower(F.coalesce(caption, F.lit(""))), FIGURE_WORDS, "other")


def useful_section(title: Column) -> Column:
    """The title if it reads like one (3 to 100 characters, 55 % letters, no sign of a formula), else null."""
    low = collapse(title)
    n = F.char_length(low)
    good = n.between(3, 100) & (F.try_divide(_letters(low).cast("double"), n) >= 0.55) & ~low.rlike(FORMULA)
    return F.when(good, low)
