"""Person names by capitalised words, and which of them are taken for persons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import collapse, normalize_name

# Fixed values.
INSTITUTION_TAILS = ["üniversitesi", "universitesi", "fakültesi", "fakultesi", "bölümü", "bolumu", "müdürlüğü", "mudurlugu", "bakanlığı", "bakanligi", "kurumu", "kuruluşu", "kurulusu", "a.ş", "a.s", "ltd", "limited", "inc", "corp", "co"]
DOMAIN_WORDS = ["chess", "department", "exercises", "beginner", "beginners", "champion", "game", "attack", "opening", "lines", "black", "white", "king", "queen", "rook", "bishop", "knight", "pawn", "mate"]
ENTITY_LABELS = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORG", "LOC": "LOC", "GPE": "GPE"}
NAME = r"(?<![\p{L}\p{N}_])([A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}(?:\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}){1,3})(?![\p{L}\p{N}_])"


def person_candidates(text: Column) -> Column:
    """Two to four capitalised words of three letters or more, as they stand."""
    return F.regexp_extract_all(text, F.lit(NAME), 1)


def entity_label(label: Column) -> Column:
    """The common label; unknown ones stay as they are."""
    known = F.create_map(*(F.lit(x) for pair in ENTITY_LABELS.items() for x in pair))
    return F.coalesce(F.element_at(known, label), label)


def is_valid_person(text: Column) -> Column:
    """At least two words of two letters, no digit, not all upper case, no institution, not only domain words."""
    t = collapse(text)
    words = F.split(t, " ")
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    shouting = (letters != "") & (letters == F.upper(letters)) & (letters != F.lower(letters))
    name = F.filter(F.split(normalize_name(text), " "), lambda w: w != "")
    ok = (t != "") & ~t.rlike(r"\p{N}") & (F.size(words) >= 2) & F.forall(words, lambda w: F.length(w) >= 2) & ~shouting
    ok = ok & (F.size(name) >= 2) & ~F.coalesce(F.get(F.reverse(name), F.lit(0)).isin(INSTITUTION_TAILS), F.lit(True))
    return F.coalesce(ok & ~F.forall(name, lambda w: w.isin(DOMAIN_WORDS)), F.lit(False))
