"""Which properties a column could be: header similarity, type evidence, and the choice among them."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from difflib import SequenceMatcher

from tabloom.plans.facts import ColumnFacts
from tabloom.plans.ontology import Ontology, Prop

SIZE, FLOOR = 24, 0.6
TYPE_BONUS, HEADERLESS = 0.35, 0.15
#: Detectors that speak for a value type.
TYPE_DETECTORS = {
    "date": ("date",), "phone": ("phone_ua", "phone_ru"), "email": ("email",), "url": ("url",), "country": ("country",), "gender": ("gender_code",),
    "identifier": ("edrpou", "rnokpp", "inn_ru", "snils_ru"), "number": ("numeric",), "name": ("proper_name", "legal_name", "org_name"),
}
# How registers spell properties.
SPELLINGS = {
    "name": "назва;найменування;піб;прізвище ім'я по батькові;повне найменування;наименование;фио;full name;title", "birthDate": "дата народження;дата рождения;date of birth;birth date",
    "firstName": "ім'я;имя;first name;given name", "lastName": "прізвище;фамилия;surname;last name", "fatherName": "по батькові;отчество;patronymic", "gender": "стать;пол;sex",
    "email": "електронна пошта;електронна скринька;e-mail;mail", "phone": "телефон;телефони;контактний телефон;phone number;tel", "website": "вебсторінка;сайт;web site;url",
    "address": "адреса;адрес;місцезнаходження;address", "city": "населений пункт;місто;город;city", "street": "вулиця;улица;street", "postalCode": "поштовий індекс;індекс;zip", "region": "область;регіон;region",
    "country": "країна;страна;country", "taxNumber": "податковий номер;рнокпп;іпн;tax number;tin", "registrationNumber": "реєстраційний номер;код єдрпоу;єдрпоу;registration number;код", "idNumber": "ідентифікаційний код;id number",
    "position": "посада;должность;post", "legalForm": "організаційна форма;організаційно-правова форма;legal form", "incorporationDate": "дата реєстрації;дата заснування;incorporation date", "startDate": "дата початку;start date;valid from",
    "endDate": "дата закінчення;end date;valid to", "caseNumber": "номер справи;case number", "judge": "суддя;judge", "amount": "сума;сумма;amount", "imoNumber": "номер імо;imo", "flag": "прапор;флаг;flag", "buildDate": "рік побудови;build year",
    "model": "модель;марка;model", "area": "площа;площадь;area", "cadastralCode": "кадастровий номер;cadastral code", "status": "статус;стан;status", "description": "опис;примітка;описание;description", "nationality": "громадянство;гражданство;citizenship",
}


def fold_text(text: str | None) -> str:
    text = re.sub(r"(?<=[a-zа-яіїєґ0-9])(?=[A-ZА-ЯІЇЄҐ][a-zа-яіїєґ])", " ", text or "")
    text = text.lower().translate(str.maketrans("`’ʼ‘_", "'''' "))
    return " ".join(text.split())


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two texts as sets of words: the best of shared words against either side, 0 to 1."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    ratio = lambda p, q: SequenceMatcher(None, p, q, autojunk=False).ratio()
    if both and (x <= y or y <= x):
        return 1.0
    return max(ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0, ratio(left, right))


def spellings_of(onto: Ontology, schema: str, prop: str, lexicon: dict[str, str] = SPELLINGS) -> list[str]:
    """A property's spellings: its name's words, those of the schema's own entry, and those of its bare name."""
    bare = fold_text(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", prop))
    out = [bare]
    for key in (*(f"{a}:{prop}" for a in onto.ancestors(schema)), prop):
        out += [fold_text(s) for s in lexicon.get(key, "").split(";") if s]
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Candidate:
    column: str
    schema: str
    prop: Prop
    score: float

    @property
    def qname(self) -> str:
        return f"{self.schema}:{self.prop.name}"


def score(column: ColumnFacts, onto: Ontology, schema: str, prop: Prop, lexicon: dict[str, str] = SPELLINGS) -> float:
    """Header against spellings, plus what the values say of the type."""
    headers = [fold_text(h) for h in (column.header, column.label) if h]
    best = max((token_set_ratio(h, s) for h in headers for s in spellings_of(onto, schema, prop.name, lexicon)), default=0.0)
    best = best if best >= FLOOR else 0.0
    speaks = column.rate(*TYPE_DETECTORS.get(prop.type, ()))
    bonus = TYPE_BONUS * speaks if speaks >= 0.5 else 0.0
    if not headers and prop.type in ("string", "text"):
        bonus -= HEADERLESS
    return best + bonus


def shortlist(column: ColumnFacts, onto: Ontology, schemata: list[str], size: int = SIZE, lexicon: dict[str, str] = SPELLINGS) -> list[Candidate]:
    """The best candidates in a total order, unique by qualified and, beyond the first, by bare name."""
    every = [Candidate(column.id, s, p, score(column, onto, s, p, lexicon)) for s in schemata for p in onto.props(s).values() if p.type != "entity"]
    every.sort(key=lambda c: (-c.score, c.qname))
    out, names = [], set()
    for c in every:
        if c.score > 0 and c.prop.name not in names:
            names.add(c.prop.name)
            out.append(c)
            if len(out) == size:
                break
    return out


def subject_vote(columns: list[ColumnFacts], onto: Ontology) -> str:
    """The concrete schema whose properties the columns fit best; ties in order of name."""
    votes: dict[str, float] = defaultdict(float)
    for s in onto.concrete():
        if onto.schemata[s].edge:
            continue
        for c in columns:
            votes[s] += max((score(c, onto, s, p) for p in onto.props(s).values() if p.type != "entity"), default=0.0)
    return max(sorted(votes), key=lambda s: votes[s], default="Thing")


def identifier_keys(columns: list[ColumnFacts], most: int = 4) -> list[str]:
    return [c.id for c in columns if c.rate(*TYPE_DETECTORS["identifier"]) >= 0.5][:most]


def heuristic_choice(candidates: list[Candidate], first: bool = False) -> Candidate | None:
    """The best candidate; at a tie of different properties none, or the first."""
    if not candidates:
        return None
    top = [c for c in candidates if c.score == candidates[0].score]
    return top[0] if first or len({c.prop.name for c in top}) == 1 else None


def candidate_pairs(columns: list[ColumnFacts], onto: Ontology, subject: str, mode: str = "heuristic") -> dict[str, Candidate | None]:
    """Column -> choice, by mode: ``heuristic``, ``heuristic-first``, ``property`` (over the whole catalogue) or ``static`` (exact spelling)."""
    near = [s for s in onto.neighbours(subject) if not onto.schemata[s].abstract] if mode != "property" else onto.concrete()
    near = [subject, *[s for s in near if s != subject]]
    out = {}
    for c in columns:
        listed = shortlist(c, onto, near)
        if mode == "static":
            listed = [x for x in listed if any(fold_text(h) in spellings_of(onto, x.schema, x.prop.name) for h in (c.header, c.label) if h)]
        out[c.id] = heuristic_choice(listed, mode == "heuristic-first")
    return out


def label_of(labels: dict[str, str], onto: Ontology, qname: str) -> str | None:
    """A label by qualified name, else of the nearest ancestor, else of the bare name if all its labels agree."""
    schema, _, name = qname.partition(":")
    for a in onto.ancestors(schema):
        if f"{a}:{name}" in labels:
            return labels[f"{a}:{name}"]
    bare = {v for k, v in labels.items() if k.partition(":")[2] == name}
    return bare.pop() if len(bare) == 1 else None


# Units that a header declares, and the types of amount that they contradict.
UNITS = {"м": "length", "m": "length", "км": "length", "кв. м": "area", "кв.м": "area", "м2": "area", "га": "area", "т": "mass", "кг": "mass", "тонн": "mass", "грн": "money", "тис. грн": "money", "uah": "money", "usd": "money", "eur": "money", "%": "share", "шт": "count"}
PROP_UNITS = {"amount": "money", "amountUsd": "money", "capital": "money", "debtSum": "money", "sharesValue": "money", "tonnage": "mass", "grossRegisteredTonnage": "mass", "takeoffMass": "mass", "area": "area", "percentage": "share", "sharesCount": "count"}


def declared_unit(header: str | None) -> str | None:
    """The unit behind a header's comma or in its brackets."""
    m = re.search(r"(?:,\s*|\(\s*|\[\s*)([^,()\[\]]{1,8})[)\]]?\s*$", (header or "").lower())
    return UNITS.get(m[1].strip()) if m else None


def contradicts(header: str | None, prop: str) -> bool:
    unit, own = declared_unit(header), PROP_UNITS.get(prop)
    return unit is not None and own is not None and unit != own


def is_machinery(header: str | None) -> bool:
    """A header that a spreadsheet, not a register, wrote."""
    return bool(re.fullmatch(r"(?i)\s*(?:unnamed[: ]*\d*|column\s*\d+|стовпець\s*\d+|№(?:\s*з/п)?|n\s*п/п|index|field\d*|_+)\s*", header or ""))


def is_stray(column: ColumnFacts, fill: float = 0.01) -> bool:
    return not column.header and column.fill_rate < fill
