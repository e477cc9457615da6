"""Labels and issuer names in comparable form, as Arrow functions and, where Spark can, as Columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.numbers import BIDI

# Arabic marks that OCR adds, and letters written for one another.
ARABIC_MARKS = "ًٌٍَُِّْٰـ"
ARABIC_FROM = "أإآٱةىئؤیک"
ARABIC_TO = "ااااهييويك"
# Words of an issuer name that do not tell issuers apart.
ISSUER_SUFFIXES = ("company", "co", "the", "group", "pjsc", "sae", "plc", "inc", "corporation", "corp", "ltd", "limited", "for")
# Cues of a total, and of a figure per share (spaces ignored in Arabic).
SUBTOTAL_CUES = ("total", "اجمالي", "مجموع")
PER_SHARE_CUES = ("للسهم", "ربحيةالسهم", "صيبالسهم", "لكلسهم", "علىالسهم", "حصةالسهم")

_TABLE = str.maketrans(ARABIC_FROM, ARABIC_TO, ARABIC_MARKS + BIDI)
_PUNCTUATION = re.compile(r"[^\w\s]")


def label_form(text: str | None) -> str | None:
    """Decoration removed, never words: NFKC, marks and letter variants folded, case and punctuation dropped."""
    if text is None:
        return None
    folded = unicodedata.normalize("NFKC", text.translate(str.maketrans("", "", BIDI))).translate(_TABLE).casefold()
    return " ".join(_PUNCTUATION.sub(" ", folded).split())


@F.pandas_udf(T.StringType())
def normalize_label(texts: pd.Series) -> pd.Series:
    """Arrow form of ``label_form``; null stays null."""
    return texts.map(label_form)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no built-in for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def dataset_label(texts: pd.Series) -> pd.Series:
    """The identity of a label in datasets: NFKC, case folded, spaces collapsed; punctuation kept."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def simple_label(text: Column) -> Column:
    """JVM-side ``normalize_label`` for text without compatibility characters."""
    folded = F.translate(F.lower(text), ARABIC_FROM + ARABIC_MARKS + BIDI, ARABIC_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"(?U)[^\w\s]|[\u200c\u200d]", " "), r"(?U)\s+", " "))


def squash(label: Column) -> Column:
    """A normalised label without word boundaries."""
    return F.regexp_replace(label, r"\s", "")


def label_key(label: Column) -> Column:
    """Case, spaces and punctuation removed."""
    return F.regexp_replace(F.lower(label), r"(?U)[\W_]+", "")


def issuer_key(name: Column) -> Column:
    """An issuer name as lower-case words without legal forms."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(name), r"\.", ""), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*ISSUER_SUFFIXES)), " ")


def cik_key(cik: Column) -> Column:
    """``cik:`` and the number without leading zeros; null for a number that cannot be read."""
    return F.concat(F.lit("cik:"), cik.try_cast("bigint").cast("string"))


def document_key(cik: Column, issuer: Column) -> Column:
    """The registry number where there is one, else the issuer."""
    return F.coalesce(cik_key(cik), issuer_key(issuer))


def has_subtotal_cue(label: Column) -> Column:
    """Whether a normalised label starts like a total, or has the word in it."""
    return F.coalesce(label.rlike(r"(?U)\b(" + "|".join(SUBTOTAL_CUES) + r")\b"), F.lit(False))


def is_per_share(label: Column) -> Column:
    """Whether a label names a figure per share."""
    low = F.lower(label)
    arabic = F.regexp_replace(label, r"\s", "")
    hit = low.rlike(r"\b(eps|dps)\b|\bper (\w+ )?share\b")
    for cue in PER_SHARE_CUES:
        hit = hit | arabic.contains(cue)
    return F.coalesce(hit, F.lit(False))


def text_layer(readable_pages: Column, pages: Column) -> Column:
    """digital, scanned or mixed, from how many pages have enough characters."""
    return F.when(readable_pages == pages, "digital").when(readable_pages == 0, "scanned").otherwise("mixed")


def is_garbled(text: Column) -> Column:
    """At least 100 visible characters, of which fewer than nine in ten are readable."""
    visible = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    readable = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\p{Sc}\p{Sm}]", ""))
    return F.coalesce((visible >= 100) & (readable < 0.9 * visible), F.lit(False))


def reading_variants(text: Column) -> Column:
    """A text and the same with its words in reverse order, for lines stored in visual order."""
    return F.array_distinct(F.array(text, F.array_join(F.reverse(F.split(text, r"\s+")), " ")))
