"""Variant spellings of names typed by people: a join of near keys by what they keep in common.

1. Each typed name is read into fields: surname keys, given name, patronymic
   (persons) or core, trade word and legal form (organisations), in one sound
   alphabet for Cyrillic and Latin spellings.
2. Rows with the same fields are one *spelling*; only spellings are compared.
3. Distinct keys within two edits of each other are found once, without their
   rows: both, short of at most two sounds, have one rest in common, and hardly
   any other key has it. Long keys, of which too many rests could be made, meet by
   segments: cut into k + 1 (k edits allowed; a swap of neighbours is one), a
   key within k edits keeps one segment, at a place shifted by at most k,
   unchanged but for a swap across its left border.
   Spellings then meet under a whole key, their own or one near it, and what two
   rows of one party must share: the birth date; else the place (and the
   trade). Rows that have neither are linked by fewer edits only: one, or
   two beside the same given name. Three edits are allowed beside one birth
   date or code only: there one end of the key has at most one of them. So
   what a look-up meets are rows of near keys, not all that share a syllable.
4. Candidates are verified with the banded edit distance, then field by field.

Defined results: null, blank and letterless names link to nothing; rows without
birth date or place agree with any; extra columns are ignored; an empty table
gives no links. Exact copies are one spelling, expanded by membership only.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut, map_batches, ship

# Transliteration of Ukrainian and Russian letters.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "y",
    "і": "i", "ї": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s",
    "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia",
    "ь": "", "ъ": "", "'": "", "ы": "y", "э": "e", "ё": "e",
}
# Latin letter groups that are one sound, longest first.
SOUNDS = (
    ("shch", "Q"), ("zgh", "zH"), ("zh", "J"), ("kh", "X"), ("ts", "C"), ("ch", "T"), ("sh", "W"), ("iu", "U"), ("yu", "U"),
    ("ia", "A"), ("ya", "A"), ("ie", "E"), ("ye", "E"), ("yi", "i"), ("yy", "y"), ("iy", "i"), ("w", "v"), ("x", "ks"), ("j", "i"),
)

# Given names with their short, Russian and pet forms.
GIVEN = {
    "анатолій": "толя толик анатолий", "андрій": "андрійко андрей андрюша", "богдан": "бодя богданчик даня", "василь": "вася васько василий",
    "віктор": "вітя виктор витя", "володимир": "володя вова владимир", "григорій": "гриць гриша григорий", "дмитро": "діма митя дмитрий дима",
    "євген": "женя євгенко евгений", "іван": "ваня іванко иван", "ігор": "ігорко гарік игорь ігорьок", "максим": "макс максимко",
    "микола": "коля миколка николай", "михайло": "мишко миша михаил", "олег": "олежик олежко", "олександр": "саша сашко олесь александр шура",
    "павло": "паша павлик павел павлусь", "петро": "петя петрик пётр петр", "роман": "рома ромко", "сергій": "серьожа сергійко сергей сережа",
    "степан": "стьопа степанко стёпа", "тарас": "тарасик", "юрій": "юра юрко юрий", "ярослав": "славко ярик слава",
    "анна": "аня ганна ганнуся анюта", "валентина": "валя", "вікторія": "віка вика виктория", "галина": "галя",
    "дарина": "даша дарка дарья", "євгенія": "женя євгешка евгения", "зоряна": "зоря зорянка", "ірина": "іра іринка ирина ира",
    "катерина": "катя катруся екатерина", "лариса": "лара", "людмила": "люда люся мила", "марія": "марійка маша мария маруся",
    "надія": "надя надежда надійка", "наталія": "наташа наталка наталя наталья", "оксана": "ксеня оксанка ксенія", "олена": "лєна оленка елена лена",
    "ольга": "оля олька", "світлана": "світа светлана света", "софія": "соня софійка софия софья", "тетяна": "таня тетянка татьяна",
    "христина": "христя крістіна кристина", "юлія": "юля юлия", "зоя": "зойка", "лідія": "ліда лидия", "віра": "вера вірочка", "любов": "люба",
    "артем": "тьома", "денис": "дениска", "антон": "антошка", "леонід": "льоня леонид", "борис": "боря", "костянтин": "костя константин",
}
# Legal forms and what is written for them (letters only, lower case).
FORMS = {
    "тов": ("тов", "т о в", "т/о/в", "т.о.в", "товариство з обмеженою відповідальністю", "тзов", "ооо", "llc", "ltd", "tov"),
    "прат": ("прат", "пр ат", "прив ат", "приватне ат", "приватне акціонерне товариство", "зат", "prat", "зао"),
    "пат": ("пат", "публічне акціонерне товариство", "ват", "оао"),
    "ат": ("ат", "акціонерне товариство", "jsc"),
    "дп": ("дп", "д/п", "держ підпр", "державне підприємство", "держпідприємство", "гп", "dp"),
    "кп": ("кп", "к/п", "к п", "ком підпр", "комунальне підприємство", "kp"),
    "пп": ("пп", "п/п", "п п", "прив підпр", "приватне підприємство", "чп", "pp"),
    "фг": ("фг", "ф/г", "ф г", "ферм госп", "фермерське господарство", "фх", "fh"),
}
#: Share of the organisations' rows from which a word is a trade and no name.
TRADE_SHARE = 0.01
#: Sounds of a key up to which all its rests are made: their number grows with the square of its length.
SHORT_KEY = 16
#: Distinct keys per bucket in which their rests are compared: 50 to 170 rests of 16 bytes each.
BUCKET_KEYS = 20_000

_NOISE = re.compile(r"\((?:не діє|ліквідовано|недіюч\w*|ex)\)|^\s*(?:гр(?:омадян(?:ин|ка))?\.?|п(?:ан|ані)\.?|фоп)\s+(?=\w)", re.IGNORECASE)
_PATRONYMIC = re.compile(r"(?:[oeE]v[yi]T|[iyoeE]vna|yTna)$")
_LATIN = str.maketrans(LATIN)
_WORD = re.compile(r"[^\W\d_]+\.?(?:-[^\W\d_]+\.?)*")


def allowed_edits(n: int) -> int:
    """Edits allowed for a key of n sounds."""
    return 0 if n < 4 else 1 if n < 6 else 2 if n < 9 else 3


@lru_cache(maxsize=200_000)
def sounds(word: str) -> str:
    """A word, Cyrillic or Latin, in one letter per sound; case, marks and soft signs don't count."""
    text = unicodedata.normalize("NFKC", word).lower().replace("’", "'").replace("ʼ", "'").replace("`", "'")
    text = text.translate(_LATIN)
    if not (text.isascii() and text.isalpha()):
        text = "".join(ch for ch in unicodedata.normalize("NFD", text) if ch.isalpha())
    for a, b in SOUNDS:
        text = text.replace(a, b)
    return text


def osa(a: str, b: str, most: int) -> int:
    """Edits between a and b, a swap of neighbours being one; most + 1 if there are more. Banded."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    big = most + 1
    before, last = None, [j if j <= most else big for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        now = [big] * (len(b) + 1)
        if i <= most:
            now[0] = i
        for j in range(lo, hi + 1):
            y = b[j - 1]
            d = min(last[j - 1] + (x != y), last[j] + 1, now[j - 1] + 1)
            if before is not None and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            now[j] = d if d < big else big
        if min(now) > most:
            return big
        before, last = last, now
    return min(last[-1], big)


def shortened(word: str, most: int) -> set[str]:
    """The word without up to ``most`` of its letters: two words within ``most`` edits have one of these in common."""
    return {"".join(w) for k in range(min(most, len(word)) + 1) for w in combinations(word, len(word) - k)}


class NameReader:
    """Reads typed names into fields; its lexicon is parameters."""

    def __init__(self, given: Mapping[str, str] = GIVEN, forms: Mapping[str, tuple] = FORMS, trades: Iterable[str] = ()):
        self.given: dict[str, set[str]] = {}
        for name, others in given.items():
            for form in (name, *others.split()):
                self.given.setdefault(sounds(form), set()).add(sounds(name))
        self.full = {sounds(x) for x in given}
        self._near_given: dict[tuple[int, str], set[str]] = defaultdict(set)
        for most, least, known in ((1, 4, self.given), (2, 5, self.full)):
            for form in known:
                for rest in shortened(form, most) if len(form) >= least else ():
                    self._near_given[most, rest].add(form)
        spelled = [(re.sub(r"[^\w/]+", " ", text).split(), form) for form, texts in forms.items() for text in texts]
        self.forms = sorted(spelled, key=lambda x: -sum(map(len, x[0])))
        self.trades = {t: x for x in trades if (t := sounds(x))}
        self._given_cache: dict[str, frozenset[str]] = {}

    def given_of(self, word: str) -> frozenset[str]:
        """The full given names that a written one may stand for."""
        if word in self._given_cache:
            return self._given_cache[word]
        found = self.given.get(word)
        if found is None and len(word) >= 4:
            near = self._within(word, 1) or (self._within(word, 2) if len(word) >= 6 else [])
            found = set().union(*(self.given[x] for x in near)) if near else None
        self._given_cache[word] = frozenset(found or ())
        if len(self._given_cache) > 200_000:
            self._given_cache.clear()
        return frozenset(found or ())

    def _within(self, word: str, most: int) -> list[str]:
        """The known given names within ``most`` edits: forms of four letters or more for 1, full names of five or more for 2."""
        if len(word) > 40:  # longer than any known name by far; its rests are too many
            return [x for x in (self.given if most == 1 else self.full) if len(x) >= most + 3 and osa(word, x, most) <= most]
        found = set().union(*(self._near_given.get((most, rest), ()) for rest in shortened(word, most)))
        return [x for x in found if osa(word, x, most) <= most]

    def form_of(self, words: list[str]) -> tuple[str | None, list[str]]:
        """The legal form among lower-case words, and the words without it."""
        for spelled, form in self.forms:
            n = len(spelled)
            if spelled[0] not in words:
                continue
            for k in range(len(words) - n + 1):
                if words[k : k + n] == spelled:
                    return form, words[:k] + words[k + n :]
        for spelled, form in self.forms:
            n = len(spelled)
            if n < 2:
                continue
            for k in range(len(words) - n + 1):
                if all(a == b or len(b) > 4 and abs(len(a) - len(b)) <= 2 and osa(a, b, 2) <= 2 for a, b in zip(words[k : k + n], spelled, strict=True)):
                    return form, words[:k] + words[k + n :]
        return None, words

    def trade_of(self, word: str) -> str | None:
        """The trades that a word may stand for, joined by ``|``: itself, or all that it abbreviates or nearly is."""
        if word in self.trades:
            return word
        near = sorted(t for t in self.trades if len(word) >= 3 and (t.startswith(word) or abs(len(word) - len(t)) <= 1 and osa(word, t, 1) <= 1))
        return "|".join(near) or None

    def parts(self, text: str) -> tuple[str | None, list[str]]:
        """The legal form of an organisation's name and its other words."""
        plain = re.sub(r"[«»“”\"„,]+", " ", _NOISE.sub(" ", text.lower()))
        words = re.sub(r"[^\w/'’ʼ]+", " ", plain).split()
        form, rest = self.form_of(words)
        return self.form_of(" ".join(words).replace("/", " ").split()) if form is None else (form, rest)

    def organisation(self, text: str) -> dict:
        form, words = self.parts(text)
        keys, trade = [], None
        for w in (sounds(x) for x in words):
            t = self.trade_of(w) if trade is None and len(words) > 1 else None
            if t:
                trade = t
            elif w:
                keys.append(w)
        if trade is None and len(keys) == 1:
            for t in self.trades:
                if keys[0].endswith(t) and len(keys[0]) - len(t) >= 4:
                    trade, keys = t, [keys[0][: -len(t)]]
                    break
        core = max(keys, key=len, default="")
        return {"kind": "o", "keys": [core] if core else [], "given": "", "patronymic": "", "form": form or "", "trade": trade or ""}

    def looks_organisation(self, text: str) -> bool:
        words = re.sub(r"[^\w/'’ʼ]+", " ", text.lower()).split()
        if self.form_of(words)[0] or re.search(r"[«»“”\"„]", text):
            return True
        parts = [sounds(w) for w in words]
        return any(p in self.trades for p in parts) and not any(_PATRONYMIC.search(p) for p in parts)

    def person(self, text: str) -> dict:
        plain = _NOISE.sub(" ", text)
        raw = [m[0] for m in _WORD.finditer(re.sub(r"\.(?=\w)", ". ", plain))]
        short = [sounds(w) for w in raw if w.endswith(".") or len(w) == 1]
        long = [(k, sounds(w), w) for k, w in enumerate(raw) if not (w.endswith(".") or len(w) == 1)]
        patronymic, given, surname = "", "", None
        rest = [x for x in long if x[1]]
        if len(rest) > 1:
            for x in rest:
                if _PATRONYMIC.search(x[1]) and len(x[1]) >= 6 and "-" not in x[2]:
                    patronymic, rest = x[1], [y for y in rest if y is not x]
                    break
        if len(rest) > 1:
            known = [x for x in rest if x[1] in self.given] or [x for x in rest if self.given_of(x[1])]
            if known:
                pick = min(known, key=lambda x: len(x[1]))
                given, rest = pick[1], [y for y in rest if y is not pick]
        if rest:
            surname = max(rest, key=lambda x: len(x[1]))
            for x in rest:
                if x is not surname:
                    if not given:
                        given = x[1]
                    elif not patronymic:
                        patronymic = x[1]
        for s in short:
            if not given:
                given = s + "."
            elif not patronymic:
                patronymic = s + "."
        keys = [sounds(p) for p in surname[2].split("-")] if surname else []
        keys = [k for k in keys if len(k) >= 3] or ([surname[1]] if surname else [])
        full = self.given_of(given) if given and not given.endswith(".") else frozenset()
        return {"kind": "p", "keys": keys, "given": "|".join(sorted(full)) if full else given, "patronymic": patronymic, "form": "", "trade": ""}

    def read(self, text: str | None, kind: str | None) -> dict | None:
        text = unicodedata.normalize("NFKC", text or "").strip()
        if not any(map(str.isalpha, text)):
            return None
        org = kind == "organisation" or (kind != "person" and self.looks_organisation(text))
        got = self.organisation(text) if org else self.person(text)
        return got if got["keys"] else None


def day_of(text: str | None) -> str:
    """A birth date in one of the two styles, as yyyy-mm-dd; '' for anything else."""
    m = re.fullmatch(r"\s*(?:(\d\d)\.(\d\d)\.(\d{4})|(\d{4})-(\d\d)-(\d\d))\s*", text or "")
    return "" if not m else f"{m[3]}-{m[2]}-{m[1]}" if m[1] else f"{m[4]}-{m[5]}-{m[6]}"


FIELDS = ["kind", "keys", "given", "patronymic", "form", "trade", "birth", "place", "reg"]


@dataclass(frozen=True)
class Lexicon:
    """What is known of names: forms of given names, of legal forms, and trade words. Tables of the caller's."""

    given: Mapping[str, str] = field(default_factory=lambda: GIVEN)
    forms: Mapping[str, tuple] = field(default_factory=lambda: FORMS)
    trades: tuple[str, ...] = ()

    def reader(self) -> NameReader:
        return NameReader(self.given, self.forms, self.trades)


def mine_trades(df: DataFrame, name: str, kind: str, lexicon: Lexicon = Lexicon(), share: float = TRADE_SHARE) -> Lexicon:
    """The lexicon with the words that at least ``share`` of the organisations' rows hold beside others: their trades.

    Counted over all rows; by the share, at most a name's words / ``share`` of them reach the driver.
    """
    source = df.where((F.col(kind) == "organisation") & F.col(name).isNotNull()).select(F.col(name).cast("string").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, counts = lexicon.reader(), Counter()
        for pdf in batches:
            for text in pdf["n"]:
                words = {w for w in map(sounds, reader.parts(text)[1]) if len(w) >= 3}
                counts.update({*(words if len(words) > 1 else ()), ""})
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    counted = map_batches(source, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.where("word = ''").agg(F.sum("n").alias("n")).first()["n"] or 0
    often = counted.where((F.col("word") != "") & (F.col("n") >= F.lit(max(2.0, share * total)))).collect()
    return replace(lexicon, trades=tuple(sorted({*lexicon.trades, *(r["word"] for r in often)})))


def read_names(df: DataFrame, row_id: str, name: str, kind: str, birth: str, place: str, reg: str, lexicon: Lexicon | None = None) -> DataFrame:
    """row_id and the fields of each readable name; a narrow map. Without a lexicon trades are mined from the names."""
    lexicon = mine_trades(df, name, kind) if lexicon is None else lexicon
    source = df.select(*[F.col(c).cast("string").alias(a) for c, a in ((name, "n"), (kind, "k"), (birth, "b"), (place, "p"), (reg, "r"))], F.col(row_id).cast("long").alias("row_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = lexicon.reader()
        for pdf in batches:
            out = []
            for n, k, b, p, r, i in pdf[["n", "k", "b", "p", "r", "row_id"]].itertuples(index=False):
                got = reader.read(n, k)
                if got:
                    out.append((i, *got.values(), day_of(b), sounds(p or ""), (r or "").strip()))
            yield pd.DataFrame(out, columns=["row_id", *FIELDS])

    schema = "row_id long, kind string, keys array<string>, given string, patronymic string, form string, trade string, birth string, place string, reg string"
    return map_batches(source, run, schema)


def segment(n: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the edits + 1 segments of a key of n sounds; the last ones are the longer."""
    parts = edits + 1
    base, longer = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def index_entries(key: str, most: int = 3) -> list[str]:
    """The segments under which a key is found within ``most`` edits: length, number and text."""
    n = len(key)
    return [f"{n}.{i}.{key[a : a + size]}" for i, (a, size) in enumerate(segment(n, min(most, allowed_edits(n)))) if size]


@lru_cache(maxsize=1_000)
def _windows(m: int, most: int, longer: bool) -> tuple[tuple[int, int, int, range, range], ...]:
    """For a key of m sounds: length and number of each segment looked for, its size, where it may stand, and where with a swap before it."""
    out = []
    for n in range(max(1, m - most), m + (most if longer else 0) + 1):
        k, more = min(most, allowed_edits(n)), m - n
        if abs(more) > min(k, allowed_edits(min(m, n))):
            continue
        for i, (a, size) in enumerate(segment(n, k)):
            if size:
                # From both ends: what lies left of segment i has at most i edits, what lies right at most k - i.
                lo, hi = max(0, a - i, a + more - (k - i)), min(m - size, a + i, a + more + (k - i))
                # The swap is one of the i edits at the left and shifts nothing.
                lo2, hi2 = max(1, a - i + 1, a + more - (k - i)), min(m - size, a + i - 1, a + more + (k - i))
                out.append((n, i, size, range(lo, hi + 1), range(lo2, hi2 + 1)))
    return tuple(out)


def probe_entries(key: str, most: int = 3, longer: bool = False) -> list[str]:
    """The position-shifted substrings with which a key looks up keys within ``most`` edits that are no longer than itself (``longer``: of any length).

    A swap across a border spoils two segments. Counted for the left one of them, k edits still leave
    one of k + 1 segments without any, which is whole once a swap at its left border is undone.
    """
    out = set()
    for n, i, size, plain, swapped in _windows(len(key), most, longer):
        out.update([f"{n}.{i}.{key[s : s + size]}" for s in plain])
        out.update([f"{n}.{i}.{key[s - 1]}{key[s + 1 : s + size]}" for s in swapped])
    return sorted(out)


def meetings(x: Mapping) -> tuple[list[tuple[str, int]], list[tuple[str, int, bool]]]:
    """(offers, asks) of a spelling: what it is looked up and looks up under, each with the edits that ``same_party`` allows there.

    Two spellings that can be one party meet in one of: b, both have the birth date; r, both have the code; p, both have the
    place and, organisations, the trade; q, one of them without trade; u, one has neither birth date nor place; z, one
    has the place only, the other the birth date only. In u and z one edit is allowed, or two beside a given name (g)
    that both have in full. An ask says whether it looks for longer keys as well: not where both sides ask.
    """
    kind, born, placed = x["kind"], x["birth"], x["place"]
    offers, asks = [], []
    full = [f"g|{g}" for g in x["given"].split("|")] if kind == "p" and x["given"] and x["patronymic"] and x["given"][-1] != "." != x["patronymic"][-1] else []

    def far(name: str, into: list, *longer: bool) -> None:
        into.append((name, 1, *longer))
        into.extend((f"{name}|{g}", 2, *longer) for g in full)

    if born:
        offers.append((f"b{kind}|{born}", 3))
        asks.append((f"b{kind}|{born}", 3, False))
    if kind == "o" and x["reg"]:
        offers.append((f"r|{x['reg']}", 3))
        asks.append((f"r|{x['reg']}", 3, False))
    if placed and kind == "p":
        offers.append((f"p|{placed}", 2))
        if not born:
            asks.append((f"p|{placed}", 2, True))
    elif placed:
        for trade in x["trade"].split("|"):
            offers.append((f"po|{placed}|{trade}", 2))
            asks.append((f"po|{placed}|{trade}", 2, False))
        offers.append((f"qo|{placed}", 1))
        if not x["trade"]:
            asks.append((f"qo|{placed}", 1, True))
    far(f"u{kind}", offers)
    if not born and not placed:
        far(f"u{kind}", asks, True)
    if born and not placed:
        far(f"z{kind}", asks, True)
    elif placed and not born:
        far(f"z{kind}", offers)
    return offers, asks


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=100)
def _rests(n: int) -> np.ndarray:
    """Weights of the n sounds in each rest (a column) that a key of n sounds leaves without up to two of them."""
    places = _mixed(np.arange(1, n + 1)) | np.uint64(1)
    gone = [g for k in range(min(2, allowed_edits(n)) + 1) for g in combinations(range(n), k)]
    weights = np.zeros((n, len(gone)), np.uint64)
    for column, g in enumerate(gone):
        weights[[i for i in range(n) if i not in g], column] = places[: n - len(g)]
    return weights


def key_tokens(keys: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Keys with the hashes (a row each) that any two keys within two allowed edits have one of in common."""
    lengths = defaultdict(list)
    for key in keys:
        lengths[len(key)].append(key)
    for n, some in lengths.items():
        # An edit takes one sound at most from each key, so a key of 16 has to meet those of up to 18 by rests.
        if n <= SHORT_KEY + 2:
            codes = _mixed(np.frombuffer("".join(some).encode("utf-32-le"), "<u4")).reshape(len(some), n)
            yield some, (codes @ _rests(n)).view(np.int64)
        if n > SHORT_KEY:
            for key in some:
                entries = {*index_entries(key, 2), *probe_entries(key, 2)}
                yield [key], np.array([[int.from_bytes(hashlib.blake2b(e.encode(), digest_size=8).digest(), "big", signed=True) for e in sorted(entries)]])


def _near(a: str, b: str, cap: int):
    """Whether the keys in two columns may be within ``cap`` allowed edits; never false if they are."""
    # A swap is two plain edits and leaves the letters as they are: k edits with s swaps are at most k + s plain
    # ones, and at most k - s letters of one key are missing in the other, so both together are at most 2 k.
    least = F.least(F.length(a), F.length(b))
    most = F.when(least < 4, 0).when(least < 6, min(1, cap)).when(least < 9, min(2, cap)).otherwise(cap)  # allowed_edits of the shorter key
    plain = F.levenshtein(a, b, 2 * cap)
    missing = F.expr(f"greatest(length(translate({a}, {b}, '')), length(translate({b}, {a}, '')))")
    return F.when((plain < 0) | (plain > 2 * most), False).when(plain <= most, True).otherwise(plain + missing <= 2 * most)


def shared_runs(tokens: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different ids with one token, the smaller first, a few at a time; pairs recur with each further token."""
    order = np.argsort(tokens, kind="stable")
    tokens, ids = tokens[order], ids[order]
    # Rows k apart in the order share a token only if all between them do.
    at, step = np.arange(len(tokens)), 1
    while len(at := at[at < len(tokens) - step]):
        at = at[tokens[at] == tokens[at + step]]
        a, b = ids[at], ids[at + step]
        yield np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        step += 1


def near_keys(keys: DataFrame) -> DataFrame:
    """(id, other, edits): all pairs, both ways, of distinct keys (key, id) that may be within two allowed edits, 1 or 2.

    Tokens travel in arrays, one per batch and bucket; the buckets' number grows with the keys'.
    """
    buckets = keys.count() // BUCKET_KEYS + 8

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(), strict=True))
            made = [(tokens.ravel(), np.repeat([number[k] for k in some], tokens.shape[1])) for some, tokens in key_tokens(list(number))]
            if made:
                tokens, ids = (np.concatenate(x) for x in zip(*made, strict=True))
                bucket = (tokens.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                found, starts = np.unique(bucket[order], return_index=True)
                starts = np.append(starts, len(order)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(starts, x[order]) for x in (tokens, ids)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *lists], ["bucket", "tokens", "ids"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[x.flatten().to_numpy() for x in (b.column("tokens"), b.column("ids"))] for b in batches]
        for a, b in shared_runs(*(np.concatenate(x) for x in zip(*columns, strict=True))):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    ship(keys.sparkSession)
    rows = keys.select("key", "id").mapInArrow(scatter, "bucket int, tokens array<long>, ids array<long>")

    met = rows.groupBy("bucket").applyInArrow(gather, "a long, b long").distinct()
    both = met.join(keys.toDF("ka", "a"), "a").join(keys.toDF("kb", "b"), "b").where(_near("ka", "kb", 2))
    pairs = cut(both.select("a", "b", F.when(_near("ka", "kb", 1), 1).otherwise(2).alias("edits")))
    return pairs.toDF("id", "other", "edits").unionByName(pairs.toDF("other", "id", "edits"))


def end_entries(key: str) -> list[str]:
    """What keys within three edits, allowed from nine sounds on, have one of in common.

    Their first and their last four sounds lie apart, so one of these ends has at most one of the three edits:
    short of one sound it is then the same in both keys, be the edit a change, a loss, a gain or a swap.
    """
    if allowed_edits(len(key)) < 3:
        return []
    return sorted({f"{at}{end[:i]}{end[i + 1 :]}" for at, end in (("<", key[:4]), (">", key[-4:])) for i in range(4)})


def _meetings(spellings: DataFrame) -> DataFrame:
    """(sid, key, ask, context, most, longer, ends): ``meetings`` of each key as rows; ends where three edits are allowed, once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, *values in pdf[["sid", *FIELDS]].itertuples(index=False):
                x = dict(zip(FIELDS, values, strict=True))
                offers, asks = meetings(x)
                for key in x["keys"]:
                    out += [(sid, key, False, name, most, False, end_entries(key) if most > 2 else []) for name, most in offers]
                    out += [(sid, key, True, name, most, longer, []) for name, most, longer in asks]
            if out:
                yield pd.DataFrame(out, columns=["sid", "key", "ask", "context", "most", "longer", "ends"])

    return map_batches(spellings.select("sid", *FIELDS), run, "sid long, key string, ask boolean, context string, most int, longer boolean, ends array<string>")


def _candidates(spellings: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of spellings that ``same_party`` may accept.

    Tokens are hashes: eight bytes are shuffled instead of two texts, and whatever meets by chance is judged like the others.
    """
    number = F.xxhash64("key").alias("id")
    near = near_keys(cut(spellings.select(F.explode("keys").alias("key")).distinct().select("key", number)))
    rows = cut(_meetings(spellings)).withColumn("id", number)
    offers = rows.where("NOT ask").select(F.col("sid").alias("b"), F.xxhash64("context", "id").alias("token"))
    asks = rows.where("ask").select("sid", "id", "context", "most", "longer")
    own = asks.select(F.col("sid").alias("a"), F.xxhash64("context", "id").alias("token"))
    others = asks.join(near, "id").where("edits <= most AND (longer OR other > id)").select(F.col("sid").alias("a"), F.xxhash64("context", "other").alias("token"))
    met = own.unionByName(others).join(offers, "token").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ends = rows.select("sid", "key", "context", F.explode("ends").alias("end")).select("sid", "key", F.xxhash64("context", "end").alias("token"))
    far = ends.toDF("a", "ka", "token").join(ends.toDF("b", "kb", "token"), "token").where("a < b").where(_near("ka", "kb", 3))
    return met.unionByName(far.select("a", "b")).distinct()


def agreement(a: str, b: str) -> int:
    """How far two written given names or patronymics agree.

    3: the same name written out on both sides; 2: one is missing or an
    abbreviation of the other; 1: an abbreviation with a typing slip; 0: not at all.
    """
    if not a or not b:
        return 2
    if a.endswith(".") or b.endswith("."):
        x, y = a.rstrip("."), b.rstrip(".")
        best = 0
        for p in x.split("|"):
            for q in y.split("|"):
                if p.startswith(q) or q.startswith(p):
                    return 2
                n = min(len(p), len(q))
                if n >= 3 and any(osa(p[:m], q[:n], 1) <= 1 for m in (n - 1, n, n + 1)):
                    best = 1
        return best
    left, right = a.split("|"), b.split("|")
    if set(left) & set(right):
        return 3
    slips = lambda p, q: osa(p, q, 2) <= (2 if min(len(p), len(q)) >= 6 else 1)
    return 3 if any(slips(p, q) for p in left for q in right) else 0


def clash(a: dict, b: dict) -> bool:
    """Whether two spellings can't mean one party: another birth date, place, code, form, trade or kind."""
    if a["kind"] != b["kind"] or any(a[f] and b[f] and a[f] != b[f] for f in ("birth", "place", "reg", "form")):
        return True
    return bool(a["trade"] and b["trade"]) and set(a["trade"].split("|")).isdisjoint(b["trade"].split("|"))


def same_party(a: dict, b: dict) -> bool:
    """Whether two spellings mean one party by themselves. Fields as ``read_names`` makes them."""
    if clash(a, b):
        return False
    apart, n = min((osa(x, y, 3), -min(len(x), len(y))) for x in a["keys"] for y in b["keys"])
    most = allowed_edits(-n)
    placed = bool(a["place"] and b["place"])
    if a["kind"] == "o":
        if a["reg"] and b["reg"]:
            return apart <= most
        return apart <= min(most, 2 if placed and bool(a["trade"]) == bool(b["trade"]) else 1)
    given, patronymic = agreement(a["given"], b["given"]), agreement(a["patronymic"], b["patronymic"])
    if not given or not patronymic:
        return False
    born = bool(a["birth"] and b["birth"])
    if given == 1 or patronymic == 1:
        return born and given + patronymic > 2 and apart == 0
    if born:
        return apart <= most
    written = given == patronymic == 3 and not set(a["given"].split("|")).isdisjoint(b["given"].split("|"))
    return apart <= min(most, 2 if placed or written else 1)


def same_through(a: dict, b: dict) -> bool:
    """Whether two spellings that are linked to a third one, which has a birth date or a place, are one party."""
    if clash(a, b):
        return False
    near = min(osa(x, y, 5) for x in a["keys"] for y in b["keys"]) <= 5
    return near and (a["kind"] == "o" or bool(agreement(a["given"], b["given"]) and agreement(a["patronymic"], b["patronymic"])))


def link_spellings(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): row_id with its spelling_id, and linked pairs of spellings a < b.

    ``names`` as of ``read_names``. Both results are cut off from their lineage.
    """
    names = cut(names)
    spellings = cut(names.groupBy(*FIELDS).agg(F.min("row_id").alias("sid")))
    members = names.join(spellings, FIELDS).select("row_id", "sid")  # no field is null

    candidates = _candidates(spellings)

    side = lambda p: spellings.select(F.col("sid").alias(p), *[F.col(f).alias(f"{p}_{f}") for f in FIELDS])
    differs = lambda c: (F.col(f"a_{c}") != "") & (F.col(f"b_{c}") != "") & (F.col(f"a_{c}") != F.col(f"b_{c}"))
    trades = lambda p: F.split(F.col(f"{p}_trade"), r"\|")
    other_trade = (F.col("a_trade") != "") & (F.col("b_trade") != "") & ~F.arrays_overlap(trades("a"), trades("b"))
    apart = differs("birth") | differs("place") | differs("reg") | differs("form") | other_trade

    def judged(pairs: DataFrame, judge: Callable[[dict, dict], bool]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = len(FIELDS)
            for pdf in batches:
                fields = pdf[[*[f"a_{f}" for f in FIELDS], *[f"b_{f}" for f in FIELDS]]]
                keep = [judge(dict(zip(FIELDS, r[:n], strict=True)), dict(zip(FIELDS, r[n:], strict=True))) for r in fields.itertuples(index=False, name=None)]
                yield pdf.loc[keep, ["a", "b"]]

        both = pairs.join(side("a"), "a").join(side("b"), "b").where(~apart)
        return map_batches(both, run, "a long, b long")

    direct = cut(judged(candidates, same_party))
    # Two spellings of one party may be far apart, yet both near a third. The third one must
    # carry a birth date or a place: bare names would bridge different parties.
    either = direct.unionByName(direct.select(F.col("b").alias("a"), F.col("a").alias("b")))
    centres = spellings.where("birth <> '' OR place <> ''").select(F.col("sid").alias("b"))
    spokes = either.join(centres, "b", "left_semi")
    wedges = spokes.select(F.col("a"), F.col("b").alias("c")).join(spokes.select(F.col("a").alias("b"), F.col("b").alias("c")), "c")
    wedges = wedges.where("a < b").select("a", "b").distinct().join(direct, ["a", "b"], "left_anti")
    return members, direct.unionByName(judged(wedges, same_through))


def linked_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of rows (row_a < row_b) whose spellings are linked or one."""
    m1 = members.select(F.col("row_id").alias("r1"), F.col("sid").alias("a"))
    m2 = members.select(F.col("row_id").alias("r2"), F.col("sid").alias("b"))
    across = links.join(m1, "a").join(m2, "b").select("r1", "r2")
    within = m1.join(m2, (m1["a"] == m2["b"]) & (F.col("r1") < F.col("r2"))).select("r1", "r2")
    every = across.unionByName(within)
    return every.select(F.least("r1", "r2").alias("row_a"), F.greatest("r1", "r2").alias("row_b"))
