"""Visually identical text brought to one form.

Look-alikes are strings of code points: a Latin and a Cyrillic letter of one
glyph, a full-width form and its plain one, a letter with a combining accent
and the composed letter. A union-find over such pairs makes transitive classes.
Per alphabet the representative of a class is its member of that alphabet that
the corpus uses most. Text is rewritten greedily, longest match first, with a
multi-pattern automaton: first what holds for all text (width, blanks,
invisible characters, composition), then each word of mixed alphabets in the
alphabet most of its letters belong to.

Defined results: null stays null; line breaks stay; words of one alphabet stay;
a letter without a look-alike in its word's alphabet stays; at a tie, or where
the word would stay mixed, the alphabet of the word's compound decides, then
that of the rest of the text, then the corpus. In cells whose type takes blanks
as separators of values, runs of blanks are separators and stay. Counts cover all rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import map_batches, ship

# Latin letters and the Cyrillic letters of the same glyph.
LATIN_CYRILLIC = (
    ("a", "а"), ("c", "с"), ("e", "е"), ("i", "і"), ("j", "ј"), ("o", "о"), ("p", "р"), ("s", "ѕ"), ("x", "х"), ("y", "у"), ("h", "һ"),
    ("ï", "ї"), ("ë", "ё"), ("è", "ѐ"), ("ӏ", "l"), ("k", "к"), ("A", "А"), ("B", "В"), ("C", "С"), ("E", "Е"), ("H", "Н"), ("I", "І"), ("J", "Ј"),
    ("K", "К"), ("M", "М"), ("O", "О"), ("P", "Р"), ("S", "Ѕ"), ("T", "Т"), ("X", "Х"), ("Y", "У"), ("Ï", "Ї"), ("Ë", "Ё"), ("È", "Ѐ"),
)
# Latin letters and the Greek letters of the same glyph.
LATIN_GREEK = (
    ("o", "ο"), ("v", "ν"), ("A", "Α"), ("B", "Β"), ("E", "Ε"), ("Z", "Ζ"), ("H", "Η"), ("I", "Ι"), ("K", "Κ"), ("M", "Μ"), ("N", "Ν"),
    ("O", "Ο"), ("P", "Ρ"), ("T", "Τ"), ("Y", "Υ"), ("X", "Χ"),
)
#: Full-width and half-width forms.
WIDE = range(0xFF01, 0xFFEF)
SCRIPTS = ("CYRILLIC", "LATIN", "GREEK")

_WORD = re.compile(r"[^\W\d_]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_BLANKS = re.compile(r"[ ]{2,}")


def script_of(ch: str) -> str | None:
    """The alphabet of a letter, None for other characters."""
    at = ord(ch)
    if at < 0x250:
        return "LATIN" if ch.isalpha() else None
    if 0x400 <= at <= 0x52F:
        return "CYRILLIC"
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "")
    return next((s for s in SCRIPTS if name.startswith(s)), None)


def _letters(text: str) -> dict[str, int]:
    """How many letters of each alphabet a text has."""
    counts: dict[str, int] = {}
    for ch in text:
        s = script_of(ch)
        if s:
            counts[s] = counts.get(s, 0) + 1
    return counts


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def look_alikes() -> Classes:
    """The transitive classes of the pairs above, of full-width forms and of composed letters."""
    out = Classes()
    for a, b in (*LATIN_CYRILLIC, *LATIN_GREEK):
        out.union(a, b)
    for at in WIDE:
        plain = unicodedata.normalize("NFKC", chr(at))
        if plain != chr(at):
            out.union(chr(at), plain)
    for ch in [x for x in list(out.parent) if len(x) == 1]:
        parts = unicodedata.normalize("NFD", ch)
        if parts != ch:
            out.union(parts, ch)
            for other in [x for x in out.parent if out.find(x) == out.find(parts[0]) and len(x) == 1]:
                out.union(other + parts[1:], ch)
    return out


def automaton(rules: dict[str, str]) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for text, to in rules.items():
        out.add_word(text, (len(text), to))
    if not rules:
        return None
    out.make_automaton()
    return out


def rewrite(machine: ahocorasick.Automaton | None, text: str) -> str:
    """Every match, leftmost and longest, replaced by its representative."""
    if machine is None:
        return text
    out, at = [], 0
    for end, (size, to) in machine.iter_long(text):
        out.append(text[at : end + 1 - size])
        out.append(to)
        at = end + 1
    out.append(text[at:])
    return "".join(out)


def _neutral_rules() -> dict[str, str]:
    """What holds for all text: plain width, ordinary blanks, nothing invisible."""
    rules = {}
    for at in WIDE:
        plain = unicodedata.normalize("NFKC", chr(at))
        if plain != chr(at):
            rules[chr(at)] = plain
    for at in range(0x110000):
        kind = unicodedata.category(chr(at))
        if kind == "Zs" and at != 0x20 or at == 0x09:
            rules[chr(at)] = " "
        elif kind == "Cf" or kind == "Cc" and at not in (0x09, 0x0A, 0x0D) or at in (0x34F, 0x115F, 0x1160, 0x3164) or 0xFE00 <= at <= 0xFE0F:
            rules[chr(at)] = ""
    return rules


class Rewriter:
    """Consistent forms, for the corpus frequencies given (code point -> count)."""

    def __init__(self, frequency: dict[str, int] | None = None):
        frequency = frequency or {}
        self.neutral = automaton(_neutral_rules())
        classes = look_alikes().members()
        self.by_script = {}
        self.weight = {s: 0 for s in SCRIPTS}
        for ch, n in frequency.items():
            s = script_of(ch)
            if s:
                self.weight[s] += n
        for script in SCRIPTS:
            rules = {}
            for members in classes.values():
                own = [x for x in members if len(x) == 1 and script_of(x) == script and ord(x) not in WIDE]
                if own:
                    best = min(own, key=lambda x: (-frequency.get(x, 0), x))
                    rules |= {x: best for x in members if x != best and x not in own}
            self.by_script[script] = automaton(rules)

    def _word(self, word: str, compound: str, around: str) -> str:
        counts = _letters(word)
        if len(counts) < 2:
            return word
        most = max(counts.values())
        first = [s for s in counts if counts[s] == most]
        if len(first) == 1:
            got = rewrite(self.by_script[first[0]], word)
            if len(_letters(got)) < 2:
                return got
            first = list(counts)
        # Undecided by itself: an alphabet that makes the word whole, then what stands around it.
        got = {s: rewrite(self.by_script[s], word) for s in first}
        near, far = _letters(compound), _letters(around)
        best = min(first, key=lambda s: (len(_letters(got[s])), -near.get(s, 0), -far.get(s, 0), -self.weight[s], s))
        return got[best]

    def clean(self, text: str, runs_stay: bool = False) -> str:
        """The consistent form; with ``runs_stay`` runs of blanks are no text but separators."""
        text = unicodedata.normalize("NFC", rewrite(self.neutral, text))
        text = (text if runs_stay else _BLANKS.sub(" ", text)).strip(" ")
        return _COMPOUND.sub(lambda c: _WORD.sub(lambda m: self._word(m[0], c[0], text), c[0]), text)


def code_point_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(code_point, n) over all rows of the columns; counted per partition, then summed. No row leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for column in batch.columns:
                column = column.cast(pa.large_string())
                data = column.buffers()[2]
                if data is None or len(column) == 0:
                    continue
                ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
                text = str(memoryview(data)[ends[0] : ends[-1]], "utf-8")
                got = np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["code_point", "n"])

    counts = df.select(*columns).mapInArrow(run, "code_point int, n long")
    return counts.groupBy("code_point").agg(F.sum("n").alias("n"))


def frequencies(*counts: DataFrame) -> dict[str, int]:
    """Summed counts as a dictionary; at most one entry per code point of Unicode."""
    out: dict[str, int] = {}
    for df in counts:
        for r in df.collect():
            out[chr(r["code_point"])] = out.get(chr(r["code_point"]), 0) + r["n"]
    return out


#: Text of ASCII and plain Cyrillic letters that mixes none of them in a word is in the consistent form.
_SUSPECT = "|".join((
    r"[^\x0A\x0D\x20-\x7E\x{404}\x{406}\x{407}\x{410}-\x{44F}\x{451}\x{454}\x{456}\x{457}\x{490}\x{491}\x{2010}-\x{2015}\x{2018}-\x{201E}\x{2116}\xAB\xBB]",
    r"[A-Za-z][\x{400}-\x{52F}]",
    r"[\x{400}-\x{52F}][A-Za-z]",
    r"\x20{2}|^\x20|\x20\z",
))


def suspect(text: Column) -> Column:
    """Whether a text could be in another form than the consistent one; a JVM test that spares most rows Python."""
    return text.rlike(_SUSPECT)


def rewritten(cells: DataFrame, text: str, keep: list[str], frequency: dict[str, int], runs_stay: str | None = None) -> DataFrame:
    """``keep`` and clean_text of the rows whose text isn't in the consistent form; a narrow map.

    ``runs_stay`` names a boolean column: whether runs of blanks separate values in the row's cell.
    """
    stay = F.coalesce(F.col(runs_stay), F.lit(False)) if runs_stay else F.lit(False)
    source = cells.where(suspect(F.col(text))).select(*keep, F.col(text).alias("__text"), stay.alias("__stay"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keep).schema) + ", clean_text string"
    known = {ch: n for ch, n in frequency.items() if script_of(ch)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = Rewriter(known)
        for pdf in batches:
            clean = [writer.clean(x, bool(y)) for x, y in zip(pdf["__text"], pdf["__stay"], strict=True)]
            out = pdf[keep].copy()
            out["clean_text"] = clean
            yield out[[a != b for a, b in zip(clean, pdf["__text"], strict=True)]]

    ship(cells.sparkSession)
    return map_batches(source, run, schema)
