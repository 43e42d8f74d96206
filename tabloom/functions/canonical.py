"""Canonical values by type, as Column builders: STRUCT<ok, value, reason, canonicalizer, refused>.

``canonical(value, type)`` never fails on any text. Null and blank cells give
null. A cell that packs several values gives them joined with ``;``; parts that
are refused stand in ``refused`` with their reason. All of it is JVM-side.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions import text as X

JOIN = ";"
#: Types whose texts are all values.
FREE_TYPES = frozenset({"string", "text", "name", "address", "number", "entity", "html", "json", "checksum"})

# Separators of packed cells by type, and whether every part must be a value of its type.
PACKS = {
    "phone": (r"\s*[;,/|\n]\s*", True),
    "email": (r"\s*[;,/|]\s*|\s+", True),
    "url": (r"\s*[;,|]\s*|\s+", True),
    "identifier": (r"\s*[;,|]\s*|\s+", True),
    "country": (r"\s*[;,|]\s*", True),
    "date": (r"\s*[;|]\s*", True),
    "name": (r"\s*;\s*", False),
    "address": (r"\s*;\s*", False),
}
#: What a packed cell of the type has in it; one character class, so that single values are told at once.
HINTS = {"phone": r"[;,/|\n]", "email": r"[;,/|\s]", "url": r"[;,|\s]", "identifier": r"[;,|\s]", "country": "[;,|]", "date": "[;|]", "name": ";", "address": ";"}
MULTIVALUE = frozenset(PACKS)
#: Characters that are only ever packed between values.
PURE_PACKERS = ";|"

# Calling codes, length of the national number, trunk prefix, allowed beginnings.
PHONE_RULES = (("380", 9, "0", ""), ("7", 10, "8", "9"))
# Spellings of genders.
GENDERS = {
    "male": ("ч", "чол", "чоловік", "чоловіча", "м", "муж", "мужской", "1", "male", "m"),
    "female": ("ж", "жін", "жінка", "жіноча", "жен", "женский", "2", "female", "f"),
}
# Territories, their names and codes.
TERRITORIES = {
    "ua": "ukraine|україна|украина|ukr", "pl": "poland|польща|польша|polska|pol", "de": "germany|німеччина|германия|deutschland|deu",
    "fr": "france|франція|франция|fra", "gb": "united kingdom|велика британія|великобритания|gbr|uk|great britain", "us": "united states|сша|usa|united states of america",
    "it": "italy|італія|италия|ita", "es": "spain|іспанія|испания|esp", "pt": "portugal|португалія|португалия|prt", "ro": "romania|румунія|румыния|rou",
    "md": "moldova|молдова|республіка молдова|mda", "by": "belarus|білорусь|беларусь|blr", "ru": "russia|росія|россия|rus|російська федерація|российская федерация|russian federation",
    "tr": "türkiye|turkey|туреччина|турция|tur", "cn": "china|китай|chn", "in": "india|індія|индия|ind", "jp": "japan|японія|япония|jpn", "cy": "cyprus|кіпр|кипр|cyp",
    "mt": "malta|мальта|mlt", "lv": "latvia|латвія|латвия|lva", "lt": "lithuania|литва|ltu", "ee": "estonia|естонія|эстония|est", "cz": "czechia|чехія|чехия|czech republic|cze",
    "sk": "slovakia|словаччина|словакия|svk", "hu": "hungary|угорщина|венгрия|hun", "bg": "bulgaria|болгарія|болгария|bgr", "gr": "greece|греція|греция|grc",
    "pa": "panama|панама|pan", "lr": "liberia|ліберія|либерия|lbr", "ae": "united arab emirates|оае|оаэ|are", "il": "israel|ізраїль|израиль|isr", "ca": "canada|канада|can",
    "br": "brazil|бразилія|бразилия|bra", "ar": "argentina|аргентина|arg", "eg": "egypt|єгипет|египет|egy", "kz": "kazakhstan|казахстан|kaz", "ge": "georgia|грузія|грузия|geo",
}
# Property formats, as patterns.
FORMATS = {"wikidata": r"^Q[1-9][0-9]*$", "lei": r"^[0-9A-Z]{18}[0-9]{2}$", "imo": r"^(?:IMO)?[0-9]{7}$", "isin": r"^[A-Z]{2}[0-9A-Z]{9}[0-9]$", "bic": r"^[A-Z]{6}[0-9A-Z]{2}(?:[0-9A-Z]{3})?$"}

REFUSED = "array<struct<part:string,reason:string>>"
RESULT = f"struct<ok:boolean,value:string,reason:string,canonicalizer:string,refused:{REFUSED}>"

_registry: dict[str, Callable[..., Column]] = {}


def register(type_name: str, build: Callable[..., Column]) -> None:
    """Adds or replaces the canonicalizer of a type: (text Column) -> STRUCT<value, reason>, value null if refused."""
    _registry[type_name] = build


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pair(value: Column, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(value.cast("string").alias("value"), F.when(value.isNull(), reason).alias("reason"))


def _group(v: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(v, pattern, k), F.lit(""))


def _date_text(y: Column, m: Column, d: Column) -> Column:
    return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))


_ISO_DAY = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
_ISO_TIME = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(Z|[+-]\d{2}(?::?\d{2})?)?$"
_DAY_FIRST = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})$"
_MONTH_NAME = r"^(\d{1,2})-([A-Za-z]{3})[A-Za-z]{0,6}-(\d{4})$"
_MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC"


def date(v: Column, numeric: Column | None = None) -> Column:
    """Days as yyyy-MM-dd, moments as UTC wall time; bare numbers only where the column's evidence allows."""
    form = F.when(v.rlike(_ISO_DAY), 1).when(v.rlike(_DAY_FIRST), 2).when(v.rlike(_MONTH_NAME), 3).when(v.rlike(_ISO_TIME), 4)

    def day(kind: Column) -> Column:
        parts = F.split(v, r"[./-]")
        a, b, c = (F.get(parts, F.lit(k)) for k in range(3))
        year = F.when(kind == 1, a).when(F.length(c) == 2, F.concat(F.when(c >= "30", "19").otherwise("20"), c)).otherwise(c)
        number = F.instr(F.lit(_MONTHS), F.upper(F.substring(b, 1, 3)))
        month = F.when(kind == 3, F.when(number % 4 == 1, ((number + 3) / 4).cast("int").cast("string"))).otherwise(b)
        first = F.when(kind == 1, c).otherwise(a)
        swap = (kind != 3) & (month.try_cast("int") > 12) & (first.try_cast("int") <= 12)
        text = _date_text(year, F.when(swap, first).otherwise(month), F.when(swap, month).otherwise(first))
        return let(text, lambda t: F.when(F.try_to_date(t, "yyyy-MM-dd").isNotNull() & ~t.startswith("0000"), t))

    def moment(_: Column) -> Column:
        zone = F.coalesce(_group(v, _ISO_TIME, 7), F.lit("Z"))

        def shifted(z: Column) -> Column:
            digits = F.regexp_replace(F.substring(z, 2, 9), ":", "")
            minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
            shift = F.when(z == "Z", 0).when(z.startswith("-"), -minutes).otherwise(minutes)
            wall = F.concat(F.substring(v, 1, 10), F.lit(" "), F.substring(v, 12, 5), F.lit(":"), F.coalesce(_group(v, _ISO_TIME, 6), F.lit("00")))
            return F.date_format(wall.try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), shift), "yyyy-MM-dd'T'HH:mm:ss")

        return F.when(~v.startswith("0000"), let(zone, shifted))

    def verdict(kind: Column) -> Column:
        written = F.when(kind == 4, moment(kind)).when(kind.isNotNull(), day(kind))
        if numeric is not None:
            n = v.try_cast("int")
            year = F.when(v.rlike(r"^\d{4}$") & n.between(1850, 2100), v)
            serial = F.when(v.rlike(r"^\d{5}$") & n.between(1, 80000), F.date_format(F.date_add(F.to_date(F.lit("1899-12-30")), n), "yyyy-MM-dd"))
            written = F.when(kind.isNull() & numeric, F.coalesce(year, serial)).otherwise(written)
        return let(written, lambda w: _pair(w, F.when(kind.isNotNull(), "not a real date").otherwise("no date form")))

    return let(form, verdict)


def phone(v: Column) -> Column:
    """E.164 by the calling-code rules; a label before the number doesn't count."""
    bare = F.regexp_replace(v, r"^[^\d+:]{1,40}:\s*(?=[+\d(])", "")
    plus = X.strip(bare).startswith("+")
    digits = F.regexp_replace(bare, r"[\s()+\-–—.]", "")
    number: Column = F.lit(None).cast("string")
    for code, n, trunk, begins in PHONE_RULES:
        begin = f"(?=[{begins}])" if begins else ""
        forms = (
            F.when(digits.rlike(rf"^{code}{begin}\d{{{n}}}$"), digits),
            F.when(~plus & digits.rlike(rf"^{trunk}{begin}\d{{{n}}}$"), F.concat(F.lit(code), digits.substr(F.lit(len(trunk) + 1), F.lit(n)))),
            F.when(~plus & digits.rlike(rf"^{begin}\d{{{n}}}$") if begins else F.lit(False), F.concat(F.lit(code), digits)),
        )
        number = F.coalesce(number, *forms)
    return _pair(F.concat(F.lit("+"), number), F.when(digits.rlike(r"^\d+$"), "no phone rule").otherwise("not digits"))


def gender(v: Column) -> Column:
    key = F.regexp_replace(F.lower(v), r"\.+$", "")
    out: Column = F.lit(None).cast("string")
    for name, spellings in GENDERS.items():
        out = F.when(key.isin(*spellings), name).otherwise(out)
    return _pair(out, "no spelling of a gender")


def country(v: Column) -> Column:
    """Codes and names of territories; short lower-case words aren't codes."""
    key = F.lower(v)
    pairs = [x for code, names in TERRITORIES.items() for n in (code, *names.split("|")) for x in (F.lit(n), F.lit(code))]
    code = F.element_at(F.create_map(*pairs), key)
    return _pair(F.when((F.length(v) >= 4) | (v == F.upper(v)), code), "no territory of this name")


def identifier(v: Column) -> Column:
    """One token (or a series in capitals beside a number) with a digit, or shaped as a code."""
    words = F.split(v, r"\s+")
    a, b = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    upper, digits = r"^\p{Lu}+$", r"^\p{Nd}+$"
    series = (a.rlike(upper) & b.rlike(digits)) | (b.rlike(upper) & a.rlike(digits))
    bare = F.regexp_replace(v, r"[\-–—./\s]", "")
    squeezed = F.regexp_replace(v, r"\s", "")
    code = squeezed.rlike(r"^[\p{L}\p{Nd}]+(?:[-–—./][\p{L}\p{Nd}]+)+$") & ~squeezed.rlike(r"^\p{Lu}\p{Ll}*(?:[-–—./]\p{Lu}\p{Ll}*)+$")
    fine = (F.size(words) == 1) | ((F.size(words) == 2) & series)
    has = bare.rlike(r"\p{Nd}") | code
    why = F.when(F.size(words) > 2, "several words").when(~fine, "two words that are no series and number").when(bare == "", "only separators").otherwise("no digit and no code")
    return _pair(F.when(fine & has & (bare != ""), bare), why)


def email(v: Column) -> Column:
    at = F.instr(v, "@")
    value = F.concat(F.substring_index(v, "@", 1), F.lit("@"), F.lower(F.substring_index(v, "@", -1)))
    return _pair(F.when((at > 1) & v.rlike(r"^[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+$"), value), "not an address")


def url(v: Column) -> Column:
    whole = F.when(v.rlike(r"(?i)^https?://\S+$"), v).when(v.rlike(r"(?i)^www\.\S+\.\S+$"), F.concat(F.lit("http://"), v))
    host = F.lower(F.regexp_extract(whole, r"(?i)^(https?://[^/?#]+)", 1))
    rest = F.regexp_replace(whole, r"(?i)^https?://[^/?#]+", "")
    return _pair(F.when(whole.isNotNull(), F.concat(host, F.when(rest == "", "/").otherwise(rest))), "not a web address")


def _matching(pattern: str, why: str, change: Callable[[Column], Column] = F.lower) -> Callable[[Column], Column]:
    return lambda v: _pair(F.when(v.rlike(pattern), change(v)), why)


for _name, _build in {
    "date": date,
    "phone": phone,
    "gender": gender,
    "country": country,
    "identifier": identifier,
    "email": email,
    "url": url,
    "language": _matching(r"(?i)^[a-z]{2,3}$", "not a language code"),
    "ip": _matching(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$|^(?=.*:)[0-9A-Fa-f:]{2,39}$", "not an address of a host"),
    "topic": _matching(r"^[a-z]+(?:\.[a-z]+)*$", "not a topic"),
    "mimetype": _matching(r"(?i)^[a-z]+/[a-z0-9.+\-]+$", "not a media type"),
}.items():
    register(_name, _build)


def _scalar(v: Column, type_name: str, numeric: Column | None) -> Column:
    if type_name in FREE_TYPES or type_name not in _registry:
        return _pair(X.collapse(v), "")
    return date(v, numeric) if type_name == "date" and _registry["date"] is date else _registry[type_name](v)


def _verdict(ok: Column, text: Column, why: Column, name: Column, refused: Column) -> Column:
    return F.struct(ok.alias("ok"), text.alias("value"), why.alias("reason"), name.alias("canonicalizer"), refused.cast(REFUSED).alias("refused"))


def canonical(value: Column, type_name: str, numeric: Column | None = None) -> Column:
    """The verdict on one cell. ``numeric``: whether the column's bare numbers are dates."""
    return let(X.strip(value), lambda v: F.when(v != "", _cell(v, type_name, numeric)))


def _cell(v: Column, type_name: str, numeric: Column | None) -> Column:
    none, label = F.lit(None), F.lit("whitespace" if type_name in FREE_TYPES else type_name)

    def single(got: Column) -> Column:
        one = got["value"]
        if type_name not in MULTIVALUE:
            return _verdict(one.isNotNull(), one, got["reason"], label, none)
        # A single value that holds the joining character would fall apart later.
        leaks = F.coalesce(one.contains(JOIN), F.lit(False))
        why = F.when(leaks, "the value holds the joining character").otherwise(got["reason"])
        return _verdict(one.isNotNull() & ~leaks, F.when(~leaks, one), why, label, none)

    whole = let(_scalar(v, type_name, numeric), single)
    if type_name not in PACKS:
        return whole
    pattern, every = PACKS[type_name]
    name = lambda *x: F.concat(F.lit(type_name), *[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])

    def packed(pieces: Column) -> Column:
        parts = F.filter(pieces, lambda p: p.rlike(r"[\p{L}\p{Nd}]")) if not every else F.filter(pieces, lambda p: p != "")
        tried = _phones(parts) if type_name == "phone" else F.transform(parts, lambda p: F.struct(p.alias("part"), _scalar(p, type_name, numeric).alias("got")))

        def judged(tried: Column) -> Column:
            good = F.transform(F.filter(tried, lambda t: t["got"]["value"].isNotNull() & ~t["got"]["value"].contains(JOIN)), lambda t: t["got"]["value"])
            bad = F.transform(
                F.filter(tried, lambda t: t["got"]["value"].isNull() | t["got"]["value"].contains(JOIN)),
                lambda t: F.struct(t["part"].alias("part"), F.coalesce(t["got"]["reason"], F.lit("the value holds the joining character")).alias("reason")),
            )
            first, n = F.get(tried, F.lit(0))["got"], F.size(tried)
            # Partial acceptance only where nothing but pure packers split the cell.
            pure = F.size(F.split(v, r"\s*[;|]\s*")) == F.size(pieces)
            text = F.lit(None).cast("string")
            return let(good, lambda g: (
                F.when(n == 0, _verdict(F.lit(False), text, F.lit("only separators"), name("x0"), none))
                .when(n == 1, _verdict(first["value"].isNotNull(), first["value"], first["reason"], label, none))
                .when(F.size(g) == n, _verdict(F.lit(True), F.array_join(g, JOIN), text, name("x", n), none))
                .when((F.size(g) > 0) & pure, _verdict(F.lit(True), F.array_join(g, JOIN), text, name("x", F.size(g), "of", n), bad))
            ))

        return F.when(F.size(pieces) > 1, let(tried, judged))

    # Most cells are single values: only those with a separator are split at all.
    return F.when(v.rlike(HINTS[type_name]), F.coalesce(let(F.split(v, pattern), packed), whole)).otherwise(whole)


def _phones(parts: Column) -> Column:
    """Phone parts in order; a short number takes the beginning of the last good one."""
    start = F.struct(F.array().cast("array<struct<part:string,got:struct<value:string,reason:string>>>").alias("done"), F.lit(None).cast("string").alias("last"))

    def step(state: Column, part: Column) -> Column:
        digits = F.regexp_replace(part, r"[\s()\-–—.]", "")

        def with_own(own: Column) -> Column:
            short = own["value"].isNull() & digits.rlike(r"^\d{5,7}$") & state["last"].isNotNull()
            whole = F.concat(F.substring(state["last"], F.lit(1), F.length(state["last"]) - F.length(digits)), digits)
            got = F.when(short, _pair(whole, "")).otherwise(own)
            return let(got, lambda g: F.struct(F.concat(state["done"], F.array(F.struct(part.alias("part"), g.alias("got")))).alias("done"), F.coalesce(g["value"], state["last"]).alias("last")))

        return let(phone(part), with_own)

    return F.aggregate(parts, start, step, lambda s: s["done"])


def format_accepts(value: Column, fmt: str | None) -> Column:
    """Every part of a canonical value is of the property's format; an unknown format accepts all."""
    if fmt not in FORMATS:
        return value.isNotNull()
    return F.forall(F.split(value, JOIN), lambda p: p.rlike(FORMATS[fmt]))


def parts_of(value: Column, type_name: str) -> Column:
    """The values of a canonical value, split where the type has several."""
    return F.split(value, re.escape(JOIN)) if type_name in MULTIVALUE else F.array(value)
