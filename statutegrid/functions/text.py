"""String functions with the reference semantics: Unicode blanks, line ends and lower case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from statutegrid.functions.patterns import java

#: Line ends of any kind, U+001C to U+001E among them.
LINE_END = r"\R|[\x1c-\x1e]"
#: Unicode's white space, which a pattern's \s is under (?U), and U+001C to U+001F.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: inside lambdas an expression would be worked out again for each element."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without blanks at both ends; trim() would take spaces only, a pattern would be tried at every blank inside."""
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\p{IsLowercase}")


def matches(text: Column, pattern: str, case: bool = False) -> Column:
    return text.rlike(java(pattern, case))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group matched, null where nothing did."""
    return F.nullif(F.regexp_extract(text, java(pattern), group), F.lit(""))


def without_accents(text: Column) -> Column:
    """Vowels without acute accents, graves and diaereses, composed or not; ñ stays a letter of its own."""
    accented, plain = "áéíóúàèìòùäëïöüÁÉÍÓÚÀÈÌÒÙÄËÏÖÜ", "aeiou" * 3 + "AEIOU" * 3
    return F.translate(F.regexp_replace(text, "[\u0300\u0301\u0308]", ""), accented, plain)


def blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")
