"""Several values packed in one field: a quote-aware finite-state tokenizer.

The automaton's states are BARE, QUOTED and ESCAPED, with a depth counter for
brackets where the type has any. In BARE at depth 0 a separator of the type
ends the value; in QUOTED nothing does. Which characters separate depends on
the type: what a value of the type may contain doesn't.

Defined results: null and blank cells have no values; empty parts don't count;
a quote that is never closed is an ordinary character; doubled quotes stay as
written inside, one pair of quotes around a whole value goes; repeats stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import map_batches

#: Blanks that don't count around a value.
BLANKS = " \t\r\n "


@dataclass(frozen=True)
class PackRule:
    """Separators of a type, its brackets (pairs) and its escape character, if it has any."""

    separators: str
    brackets: str = ""
    escape: str = ""


# What separates values, by the type of the column.
RULES = {
    "phone": PackRule(";,|/\n\r\t"),
    "email": PackRule(";,|/\n\r\t  "),
    "url": PackRule(";,|\n\r\t  "),
    "identifier": PackRule(";,|\n\r\t"),
    "name": PackRule(";|\n\r\t"),
    "country": PackRule(";,|/\n\r\t"),
    "date": PackRule(";|\n\r\t"),
    "address": PackRule(";|\n\r"),
    "json_list": PackRule(",;", brackets="[]{}()", escape="\\"),
}


class Tokenizer:
    """The automaton of one rule; it leaps from one special character to the next."""

    def __init__(self, rule: PackRule):
        self.rule = rule
        self._open, self._close = set(rule.brackets[::2]), set(rule.brackets[1::2])
        special = rule.separators + '"' + rule.brackets + rule.escape
        self._special = re.compile("[" + re.escape(special) + "]")

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of every part, the empty ones too."""
        out, start, depth, quoted, at = [], 0, 0, False, 0
        ends = set(self.rule.separators)
        last_quote = text.rfind('"')
        while m := self._special.search(text, at):
            at, ch = m.end(), m[0]
            if ch == self.rule.escape:
                at += 1
            elif ch == '"':
                quoted = not quoted and m.start() < last_quote
            elif quoted:
                continue
            elif ch in self._open:
                depth += 1
            elif ch in self._close:
                depth = max(0, depth - 1)
            elif depth == 0 and ch in ends:
                out.append((start, m.start()))
                start = at
        out.append((start, len(text)))
        return out

    def values(self, text: str | None) -> list[str]:
        """The values in their order, as written, without blanks and quotes around them."""
        out = []
        for a, b in self.spans(text or ""):
            part = (text or "")[a:b].strip(BLANKS)
            if len(part) >= 2 and part[0] == part[-1] == '"' and '"' not in part[1:-1].replace('""', ""):
                part = part[1:-1].strip(BLANKS)
            if part and part != '"':
                out.append(part)
        return out


def _one_of(characters: str) -> str:
    """A character class of the JVM's patterns, by code points."""
    return "[" + "".join(rf"\x{{{ord(ch):X}}}" for ch in characters) + "]"


def split_packed(cells: DataFrame, cell: str, type_name: str, keep: list[str], *, least: int = 1) -> DataFrame:
    """One row per value: ``keep``, part_no (from 1) and part_text.

    Cells without any special character of their type can't hold two values;
    with ``least`` = 2 they are dropped in the scan stage, before Python. A
    narrow map: no shuffle, and a long cell is only as long as its own row.
    Types without a rule are taken as one value.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keep).schema)
    schema += ", part_no int, part_text string"
    source = cells.select(*keep, F.col(cell).alias("__cell"), F.col(type_name).alias("__type"))
    if least > 1:
        might = F.lit(False)
        for name, rule in RULES.items():
            might = might | ((F.col("__type") == name) & F.col("__cell").rlike(_one_of(rule.separators)))
        source = source.where(might)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machines = {name: Tokenizer(rule) for name, rule in RULES.items()}
        whole = Tokenizer(PackRule(""))
        for pdf in batches:
            at, number, texts = [], [], []
            for k, (text, kind) in enumerate(zip(pdf["__cell"], pdf["__type"], strict=True)):
                parts = machines.get(kind, whole).values(text)
                if len(parts) >= least:
                    at.extend([k] * len(parts))
                    number.extend(range(1, len(parts) + 1))
                    texts.extend(parts)
            out = pdf[keep].iloc[at].reset_index(drop=True)
            out["part_no"], out["part_text"] = pd.Series(number, dtype="int32"), pd.Series(texts, dtype=object)
            yield out

    return map_batches(source, run, schema)
