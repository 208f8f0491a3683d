"""Column expressions for text and for the names used in VQA annotations.

Every function takes a Column and stays in the JVM. Nulls stay null unless
the docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Words in order, lower case: longest runs of letters and digits of any script. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def normal_form(text: Column) -> Column:
    """The words of ``text``, joined by one space; an empty string for null or wordless text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def image_name(path: Column) -> Column:
    """Path without folders and extension, lower case; null for null, empty and blank paths."""
    base = F.regexp_replace(F.trim(path), r"^.*[/\\]", "")
    name = F.lower(F.regexp_replace(base, r"\.[^.]*$", ""))
    return F.when(F.length(name) > 0, name)


def scene(name: Column) -> Column:
    """Image name up to its first underscore."""
    return F.substring_index(name, "_", 1)


def question_number(value: Column) -> Column:
    """Digits of the number in a question id without leading zeros, as a string of any length; null if there is none."""
    digits = F.regexp_extract(value, r"(\d+)", 1)
    short = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(F.length(short) > 0, short)


def squeezed(value: Column) -> Column:
    """Letters and digits only, lower case: the form in which data set names are compared."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")


def file_of(path: Column) -> Column:
    """File name without folders."""
    return F.regexp_replace(F.trim(path), r"^.*[/\\]", "")
