"""Column helpers for Spanish text: folds, normal forms, codes, versions, numbers and keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precomposed letters and what remains of them without their marks. Letters with marks of their own follow as
#: combining characters, which FOLD_MARKS removes.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
MARKS = r"[̀-ͯ]"

#: The five code grammars.
CODE_IN_HEADER = r"(?i)C[OÓó]D(?:IGO)?\s*[:.]?\s*([A-Z]{2,4}-[A-Z]{2}-\d{1,3})"
CODE_IN_FILENAME = r"^([A-Z]{2,4}-[A-Z]{2}-\d{1,3})\b"
CODE_CITED = r"\b[A-Z]{2,5}-[A-Z]{2,5}-\d{1,3}\b"
CODE_IN_TURN = r"\b[a-z]{2,5}-[a-z]{2,5}-\d{1,3}\b"
REGISTER_ROW = r"\b([A-Z]{3}-[A-Z]{2}-\d{2})\s+(\d+|N/A)\s+(\d{2}/\d{2}/\d{4}|N/A)\s*$"


def strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def unaccented(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, MARKS, ""), ACCENTED, PLAIN)


def fold(c: Column) -> Column:
    """Lower case without accents; null counts as empty."""
    return F.lower(unaccented(F.coalesce(c, F.lit(""))))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal_turn(c: Column) -> Column:
    """The form of a message in which turns are classified: folded, without outer punctuation, single spaces."""
    outer = r"^[!¡?¿.,;:\s]+|[!¡?¿.,;:\s]+$"
    return squeezed(fold(F.regexp_replace(F.coalesce(c, F.lit("")), outer, "")))


def fingerprint(c: Column) -> Column:
    """Folded letters and digits with single spaces."""
    return squeezed(F.regexp_replace(fold(c), r"[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    s = F.regexp_replace(unaccented(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def base_code(c: Column) -> Column:
    """What stands before a qualifier in parentheses, in capitals."""
    return F.upper(F.split_part(c, F.lit(" ("), F.lit(1)))


def cited_codes(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CODE_CITED), F.lit(0)))


def version_number(c: Column) -> Column:
    """v3 gives 3; 0 without digits."""
    return F.coalesce(F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit("")).cast("int"), F.lit(0))


def document_type(code: Column) -> Column:
    """The middle segment of a code."""
    return F.when(code.contains("-"), F.upper(F.split_part(code, F.lit("-"), F.lit(2))))


def number_set(c: Column) -> Column:
    """Figures without leading zeros, decimal commas as points."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    clean = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", "."), r"^0+(?=\d)", ""))
    return F.array_distinct(clean)


#: Words that don't tell questions apart.
QUESTION_STOPS = (
    "que", "quien", "cual", "cuales", "como", "cuando", "donde", "por", "para", "el", "la", "los", "las", "un", "una", "de", "del", "en", "se",
    "debe", "y", "o", "a", "al", "es", "son", "mi", "me", "lo", "su", "sus",
)
STEM = 6


def question_key(c: Column) -> Column:
    """The sorted distinct stems of a question's words, without stop words."""
    words = F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9_]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*QUESTION_STOPS))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, STEM)))), " ")


#: Words that titles keep in lower case.
MINOR_WORDS = ("de", "del", "la", "las", "el", "los", "y", "o", "en", "a", "por", "para")


def title_from_filename(c: Column) -> Column:
    """A presentable title: without extension and code, separators as spaces, title case with minor words."""
    stem = F.trim(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", ""))
    bare = F.when(stem.rlike(CODE_IN_FILENAME), F.regexp_replace(stem, CODE_IN_FILENAME, "")).otherwise(F.regexp_replace(stem, r"(?i)^[a-z]{2,5}_[a-z]{2,5}_\d{1,3}_", ""))
    words = F.filter(F.split(F.regexp_replace(bare, r"[_\-]+", " "), r"\s+"), lambda w: w != "")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*MINOR_WORDS), F.lower(w)).otherwise(capital(w))), " ")
