"""Column functions over product and query text. All of them stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove surrounding Unicode whitespace (plain ``trim`` knows only U+0020)."""
    return F.trim(_col(c), F.lit(K.WHITESPACE))


def is_set(c) -> Column:
    """Null and the empty string count as absent; never yields null."""
    return F.coalesce(_col(c), F.lit("")) != ""


def split_list(c) -> Column:
    """Comma list to array: elements stripped, blank elements kept."""
    c = _col(c)
    return F.when(is_set(c), F.transform(F.split(c, ","), strip)).otherwise(
        F.array().cast("array<string>")
    )


def non_blank(arr) -> Column:
    """Strip the elements of an array and drop the blank ones; null gives []."""
    cleaned = F.filter(F.transform(_col(arr), strip), is_set)
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def list_items(c) -> Column:
    """Non-blank, stripped elements of a comma list."""
    return non_blank(F.split(_col(c), ","))


# Positions where a word starts inside a run of letters and digits: before an
# upper-case letter or a digit. The cheap Unicode classes come first because the
# explicit letter sets are slow to rule out.
_WORD_START = (
    r"(?=[\p{{Lu}}\p{{Nd}}])(?<=\p{{L}})"
    r"(?:(?<=[{lo}])(?=[{up}]|\p{{Nd}})|(?<=[{up}])(?=[{up}][{lo}]|\p{{Nd}}))"
).format(lo=K.LOWER_LETTERS, up=K.UPPER_LETTERS)
_DIGIT_THEN_LETTER = rf"\p{{Nd}}(?=[{K.LOWER_LETTERS}{K.UPPER_LETTERS}])"
# Java's Unicode white space lacks four separators that Python counts.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def format_query(c) -> Column:
    """Normalise a receipt-style query into lower-case words and numbers."""
    out = F.coalesce(_col(c), F.lit(""))
    for mark in (",", ";"):
        out = F.replace(out, F.lit(mark), F.lit(" "))
    out = F.regexp_replace(out, _WORD_START, " ")
    out = F.regexp_replace(out, _DIGIT_THEN_LETTER, "$0 ")
    return strip(F.regexp_replace(F.lower(out), _SPACES, " "))


def product_names(names) -> Column:
    """Distinct non-empty names in first-seen order, not stripped."""
    texts = F.filter(F.transform(_col(names), lambda n: n["text"]), is_set)
    return F.coalesce(F.array_distinct(texts), F.array().cast("array<string>"))


def clean_tag(c) -> Column:
    """``en:dark-chocolate`` -> ``dark chocolate``."""
    return F.translate(F.regexp_replace(_col(c), "^[a-z]{2}:", ""), "-", " ")


def is_taxonomy_entry(c) -> Column:
    return F.lower(c).startswith(K.TAXONOMY_PREFIX)


def is_plain_category(c) -> Column:
    return ~c.contains(":")


def is_usable_category(c) -> Column:
    """A Polish-taxonomy entry with a body, or any entry without a colon."""
    body = F.length(c) > len(K.TAXONOMY_PREFIX)
    return F.when(is_taxonomy_entry(c), body).otherwise(is_plain_category(c))


def has_name(names) -> Column:
    found = F.exists(_col(names), lambda n: is_set(strip(n["text"])))
    return F.coalesce(found, F.lit(False))


def has_category(categories) -> Column:
    return F.exists(list_items(categories), is_usable_category)


def is_valid_product(product_name="product_name", categories="categories") -> Column:
    return has_name(product_name) & has_category(categories)


def given_name(categories, product_name) -> Column:
    """Display name: last usable category, else the main name, else any name.

    ``categories`` is the array shape; use ``list_items`` for a comma list.
    """
    last = F.try_element_at(F.filter(non_blank(categories), is_usable_category), F.lit(-1))
    prefix = len(K.TAXONOMY_PREFIX)
    body = F.substring(last, prefix + 1, 2_147_483_647)
    category = F.when(is_taxonomy_entry(last), body).otherwise(last)
    named = F.filter(_col(product_name), lambda n: is_set(n["text"]))
    main = F.try_element_at(F.filter(named, lambda n: n["lang"] == "main"), F.lit(1))["text"]
    first = F.try_element_at(named, F.lit(1))["text"]
    return F.coalesce(category, main, first, F.lit(""))


def search_text(
    product_name="product_name",
    quantity="quantity",
    brands="brands",
    categories="categories",
    labels="labels",
) -> Column:
    """Lower-cased text of all searchable fields; commas become spaces."""
    parts = [F.nullif(_col(c), F.lit("")) for c in (quantity, brands, categories, labels)]
    return F.translate(F.lower(F.concat_ws(" ", product_names(product_name), *parts)), ",", " ")


def tokens(c) -> Column:
    """Search terms: lower-case, Polish accents folded, letters and digits only."""
    folded = F.translate(F.lower(_col(c)), K.FOLD_FROM, K.FOLD_TO)
    terms = F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.coalesce(terms, F.array().cast("array<string>"))
