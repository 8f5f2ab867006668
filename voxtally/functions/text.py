"""Text, URL and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Python's str.strip() also takes the four ASCII separator controls.
_BLANK = r"[\s\x1c-\x1f]"
_CASED_RUNS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def strip_ws(c: Column) -> Column:
    """Remove all leading and trailing Unicode whitespace (``trim`` takes spaces only)."""
    return F.regexp_replace(c, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def clean_company_url(c: Column) -> Column:
    """Reduce a URL to its host part.

    The prefixes go wherever they occur, in this order, so ``awww.b.com``
    becomes ``ab.com``; a query string stays when no slash precedes it.
    """
    host = strip_ws(F.lower(c))
    for prefix in ("http://", "https://", "www."):
        host = F.replace(host, F.lit(prefix), F.lit(""))
    return strip_ws(F.split_part(host, F.lit("/"), F.lit(1)))


def title_case(c: Column) -> Column:
    """Capital after every uncased character: ``o'neil`` becomes ``O'Neil``."""
    runs = F.regexp_extract_all(c, F.lit(_CASED_RUNS), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2)))),
        ),
        "",
    )


def company_name(c: Column) -> Column:
    """Display name from a URL: first host label, hyphens to spaces, title case."""
    label = F.split_part(clean_company_url(c), F.lit("."), F.lit(1))
    return title_case(F.replace(label, F.lit("-"), F.lit(" ")))


def contains_text(c: Column, query: str, wildcards: bool = False) -> Column:
    """Case-insensitive partial match.

    The query is literal text. With ``wildcards=True`` its ``%`` and ``_`` match
    as in LIKE, and a backslash is still an ordinary character.
    """
    if not wildcards:
        return F.lower(c).contains(F.lower(F.lit(query)))
    escape = next(ch for ch in "\x01\x02\x03~!^" if ch not in query)
    return F.like(F.lower(c), F.lower(F.lit(f"%{query}%")), F.lit(escape))


MIN_LETTERS = 3


def terms(c: Column, min_length: int = MIN_LETTERS) -> Column:
    """Distinct lower-case words of at least ``min_length`` letters."""
    pattern = rf"(\p{{L}}{{{min_length},}})"
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1)))


def json_text(c: Column) -> Column:
    """JSON text of an array, map or struct; null stays null."""
    return F.to_json(c)


def json_string(c: Column) -> Column:
    """A plain string as a quoted JSON value."""
    wrapped = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substr(wrapped, F.lit(2), F.length(wrapped) - 2))
