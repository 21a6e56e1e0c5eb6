"""Text derivation for the product catalog and storefront labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of cased letters vs. everything else: Python's str.title capitalises
# the first cased letter after any non-cased character (digits, apostrophes).
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_RUNS = rf"([{_CASED}]+|[^{_CASED}]+)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_case(c) -> Column:
    """Equivalent of Python ``str.title`` (``initcap`` differs after ``'`` and digits)."""
    runs = F.regexp_extract_all(_c(c), F.lit(_RUNS), 1)
    cap = F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30))))
    return F.when(_c(c).isNull(), F.lit(None)).otherwise(F.array_join(cap, ""))


def strip_ws(c) -> Column:
    """Python ``str.strip()`` (all whitespace, not only spaces as ``trim``)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def humanize(c) -> Column:
    """``_`` and ``-`` become spaces, surrounding whitespace goes, title case."""
    return title_case(strip_ws(F.translate(_c(c), "_-", "  ")))


def _parts(c) -> Column:
    return F.filter(F.split(_c(c), r"\."), lambda p: p != F.lit(""))


def category_top(c) -> Column:
    """First non-blank dot segment; NULL for NULL, blank or dots only."""
    return F.try_element_at(_parts(c), F.lit(1))


def category_leaf(c) -> Column:
    """Last non-blank dot segment; NULL for NULL, blank or dots only."""
    return F.try_element_at(_parts(c), F.lit(-1))


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def display_name(category_code, brand, product_id) -> Column:
    """Brand + leaf, brand + "Product", leaf, or "Unbranded Product #id"."""
    leaf = category_leaf(category_code)
    leaf_name = F.when(_present(leaf), humanize(leaf))
    brand_name = F.when(_present(_c(brand)), humanize(brand))
    return (F.when(_present(brand_name) & _present(leaf_name), F.concat_ws(" ", brand_name, leaf_name))
             .when(_present(brand_name), F.concat(brand_name, F.lit(" Product")))
             .when(_present(leaf_name), leaf_name)
             .otherwise(F.concat(F.lit("Unbranded Product #"), _c(product_id).cast("string"))))


def image_ref(category_code) -> Column:
    top = category_top(category_code)
    return F.when(_present(top), top).otherwise(F.lit("generic"))


def category_label(c) -> Column:
    """Storefront label: first ``_`` becomes a space, then each word starts upper case.

    Word = run of ``[A-Za-z0-9_]`` (the JavaScript ``\\w`` class); the rest
    of a word keeps its case.
    """
    once = F.regexp_replace(_c(c), r"^([^_]*)_", "$1 ")
    runs = F.regexp_extract_all(once, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    up = F.transform(runs, lambda x: F.when(x.rlike(r"^[A-Za-z0-9_]"),
                                             F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30)))
                     .otherwise(x))
    return F.when(_c(c).isNull(), F.lit(None)).otherwise(F.array_join(up, ""))


def price_label(price) -> Column:
    """``$x.xx`` from a decimal price, an em dash when NULL."""
    return F.when(_c(price).isNull(), F.lit("—")).otherwise(
        F.concat(F.lit("$"), _c(price).cast("decimal(12,2)").cast("string")))
