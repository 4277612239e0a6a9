"""Text functions as columns: normalisation, tokens, digits, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Eastern Arabic and Persian digits, then their western forms (fixed values).
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
WESTERN_DIGITS = "01234567890123456789"
#: Harakat, superscript alef and tatweel (fixed values).
TASHKEEL = "[\\u064B-\\u065F\\u0670\\u0640]"




def western_digits(x: Column) -> Column:
    return F.translate(x, EASTERN_DIGITS, WESTERN_DIGITS)


def strip_tashkeel(x: Column) -> Column:
    return F.regexp_replace(x, TASHKEEL, "")


def fold_arabic(x: Column) -> Column:
    """Search form of Arabic text: no marks, one form for each letter family."""
    plain = strip_tashkeel(x)
    for group, to in (("[أإآٱ]", "ا"), ("ى", "ي"), ("ة", "ه"), ("ؤ", "و"), ("ئ", "ي")):
        plain = F.regexp_replace(plain, group, to)
    return plain


def strip_space(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def search_tokens(x: Column) -> Column:
    """Lower-cased runs of letters, digits and marks, two characters or more."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}\p{M}_]+"), lambda t: F.length(t) >= 2)


def text_key(x: Column) -> Column:
    return F.sha2(strip_space(x), 256)


def document_key(url: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(url, 256))


def article_key(doc: Column, number: Column, label: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", doc, number, label, text), 256)
