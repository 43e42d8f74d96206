"""Scalar text functions as Column builders; all stay in JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders that stand for "no value", lower case.
PLACEHOLDERS = (
    "-", "--", "—", "?", "n/a", "na", "n.a.", "null", "none", "nil", "unknown", "not available", "не вказано",
    "не визначено", "невідомо", "немає", "відсутній", "відсутня", "відсутнє", "нет", "не указано",
    "0000-00-00", "00.00.0000",
)

_ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC = "".join(chr(x) for x in range(0x400, 0x482)) + "".join(chr(x) for x in range(0x48A, 0x500))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The white space of Unicode.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column | str) -> Column:
    """Without white space of any script around it; a trim, no pattern."""
    return F.btrim(_col(x), F.lit(WHITE))


strip_ends = strip


def collapse(x: Column | str) -> Column:
    """White space runs as one blank, none at the ends; nothing else changes."""
    return F.trim(F.regexp_replace(_col(x), r"(?U)\s+", " "))


def classes(x: Column | str) -> Column:
    """Each character by its class: d digit, C Cyrillic letter, L other letter, else itself."""
    x = _col(x)
    plain = F.translate(
        F.translate(F.translate(x, _ASCII, "" * len(_ASCII)), "0123456789", "" * 10),
        _CYRILLIC,
        "" * len(_CYRILLIC),
    )
    rest = F.regexp_replace(F.regexp_replace(plain, r"\p{Nd}", ""), r"\p{L}", "")
    odd = F.when(plain.rlike(r"[\p{L}\p{Nd}]"), rest).otherwise(plain)
    return F.translate(odd, "", "dLC")


def shape(x: Column | str) -> Column:
    """``classes`` with runs of more than eight written ``x+``."""
    marked = F.translate(classes(x), "dLC", "")
    return F.translate(F.regexp_replace(marked, r"(.)\1{8,}", "$1+"), "", "dLC")


def outline(of_classes: Column) -> Column:
    """A shape or class string with every run of one class as a single mark."""
    return F.regexp_replace(of_classes, r"([dLC])\1*\+?", "$1")


#: No placeholder is longer.
_LONGEST = max(map(len, PLACEHOLDERS))


def is_placeholder(x: Column | str) -> Column:
    """Every non-blank line of the value is a placeholder or three or more stars."""
    x = _col(x)
    short = F.when(F.length(x) <= _LONGEST, F.lower(x).isin(*PLACEHOLDERS)).otherwise(F.lit(False))
    single = short | (x.startswith("***") & x.rlike(r"^\*{3,}$"))
    lines = F.filter(F.transform(F.split(x, r"\R"), strip), lambda v: v != "")
    many = (F.size(lines) > 0) & F.forall(lines, lambda v: F.lower(v).isin(*PLACEHOLDERS) | v.rlike(r"^\*{3,}$"))
    return F.when(x.contains("\n"), many).otherwise(single)


def fold(x: Column | str) -> Column:
    """Lower case, one apostrophe, underscores as blanks, blanks collapsed."""
    return collapse(F.regexp_replace(F.translate(F.lower(_col(x)), "`’ʼ‘_", "'''' "), "^$", ""))


def fold_header(x: Column | str) -> Column:
    """``fold`` after camel case is split."""
    return fold(F.regexp_replace(_col(x), r"([\p{Ll}0-9])(\p{Lu}\p{Ll})", "$1 $2"))


def composite(*parts: Column) -> Column:
    """An injective key of several parts: ``length:value|`` each; '' where all are empty."""
    filled = [F.coalesce(p, F.lit("")) for p in parts]
    body = F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p, F.lit("|")) for p in filled])
    return F.when(F.concat(*filled) == "", F.lit("")).otherwise(body)
