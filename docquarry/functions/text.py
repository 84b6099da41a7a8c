"""Text normalisation, tokens and small string rules as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: What str.splitlines() splits at.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
WORD = r"[\p{L}\p{N}_]+"
# Fixed values.
TITLES = ["dr", "dr.", "prof", "prof.", "doç", "doç.", "doc", "doc.", "asst", "asst.", "assist", "assist.", "av", "av."]


def collapse(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_fast(text: Column) -> Column:
    """Builtin form of :func:`normalize_text`: equal for text that is NFKC already and needs no folding but of the sharp s."""
    return F.replace(F.replace(F.lower(collapse(text)), F.lit("ß"), F.lit("ss")), F.lit("i̇"), F.lit("i"))


def _normalize(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return re.sub(r"\s+", " ", text.strip()).casefold().replace("i̇", "i")


def _name(text: str) -> str:
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).strip()).casefold()
    kept = " ".join(w for w in text.split(" ") if w not in TITLES)
    return re.sub(r"^[\W_]+|[\W_]+$", "", kept.replace("i̇", "i"))


@pandas_udf(T.StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, case folded, dotted i made plain; exact for all of Unicode."""
    return text.map(lambda x: None if x is None else _normalize(x))


@pandas_udf(T.StringType())
def normalize_name_exact(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else _name(x))


def normalize_name(text: Column) -> Column:
    """Names without titles and edge punctuation, from builtins."""
    low = F.replace(F.lower(collapse(text)), F.lit("ß"), F.lit("ss"))
    kept = F.array_join(F.filter(F.split(low, " "), lambda w: ~w.isin(TITLES)), " ")
    return F.regexp_replace(F.replace(kept, F.lit("i̇"), F.lit("i")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def word_tokens(text: Column) -> Column:
    """Words of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def with_bigrams(words: Column) -> Column:
    """Words, then pairs of neighbours joined by a space."""
    n = F.size(words)
    pairs = F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def space_tokens(text: Column) -> Column:
    """Distinct space-separated tokens of normalised text."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def is_garbage(text: Column) -> Column:
    """Under three characters, or more than two fifths outside letters, digits and plain punctuation."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    odd = F.regexp_replace(t, "(?U)[\\x1c-\\x1fa-zA-Z0-9çğıöşüÇĞİÖŞÜ.,:;\\-()\\s\"'&]", "")
    return (F.length(t) < 3) | (F.length(odd) / F.length(t) > 0.40)


def text_density(text: Column) -> Column:
    """Share of letters and digits after collapsing white space; 0 for empty text."""
    t = collapse(F.coalesce(text, F.lit("")))
    return F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(t), F.lit(1))


def preview(text: Column, most: int = 55) -> Column:
    return F.concat(F.left(text, F.lit(most)), F.when(F.length(text) > most, "...").otherwise(""))


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def extension(filename: Column) -> Column:
    return F.regexp_extract(filename, r"(?<=.)(\.[^.]*)$", 1)


def sanitize_label(label: Column) -> Column:
    return F.replace(label, F.lit(" "), F.lit("_"))


def or_default(value: Column, default: str) -> Column:
    """default for null and for empty text."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def fixed(value: Column, digits: int, missing: str = "NA") -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)).otherwise(missing)


def base64_image(blob: Column, least: int = 100) -> Column:
    """Base64 of blobs longer than ``least`` bytes, else null."""
    return F.when(F.length(blob) > least, F.regexp_replace(F.base64(blob), r"\s", ""))


def pack_index(image: Column, rect: Column) -> Column:
    return image * 1000 + rect


def unpack_index(packed: Column) -> tuple[Column, Column]:
    return F.floor(packed / 1000), packed % 1000


def thumbnail_name(filename: Column, page: Column, packed: Column) -> Column:
    image, rect = unpack_index(packed)
    return F.concat(F.concat_ws("_", stem(filename), F.concat(F.lit("p"), page.cast("string")), image.cast("string"), rect.cast("string")), F.lit(".png"))


def now() -> Column:
    """The time at which the query began, one for all rows."""
    return F.current_timestamp()


def now_seconds() -> Column:
    return F.unix_timestamp()
