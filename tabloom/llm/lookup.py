"""Free-entered values mapped to a canonical list: a trie searched with a Levenshtein automaton.

Every entry of the list goes into a trie under all its spellings: its labels,
its name, its name beside its group, its aliases, with the words in any order
(entries of more than four words are matched word by word instead, each word by
a trie of words). A typed value is folded the same way and the trie is walked
with one automaton row (edits so far for every prefix of the value) per node;
branches whose whole row exceeds the bound, or that hold no spelling of a
fitting length, are left out; the bound grows from 0 until something is found.
A swap of neighbours is one edit; blanks cost nothing; an abbreviation
(``regist.``, ``н-р``) matches the rest of a word.

Aliases aren't written here: they are a table of the caller's, and are mined
from values that were entered beside each other for one thing. Where the
neighbours of a typed value nearly all mean one entry, the value is its alias.

Defined results: null values are no case; blank values and values without
letters are unmatched; among entries at equal distance the one of the given
group wins, else a tie between different entries is unmatched.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut, map_batches, ship

UNMATCHED = "unmatched"
#: Stands for the rest of a word in a folded value.
REST = "…"

#: Votes that make an alias: of values without an entry, of values that have another one; share of the commonest vote.
FEW, MANY, SHARE = 2, 5, 0.8

# Abbreviations that aren't beginnings of their words.
SHORT_WORDS = {"д-та": "дата", "дт": "дата", "н-р": "номер", "№": "номер", "dt": "date", "cd": "code", "no": "number", "nr": "number", "num": "number", "nm": "name"}


def allowed(n: int) -> int:
    """Edits allowed for a value of n letters."""
    return 0 if n <= 3 else 1 if n <= 6 else 2


def words_of(text: str) -> list[str]:
    """The folded words of a typed value; an abbreviated one ends with ``REST``."""
    text = unicodedata.normalize("NFKC", text).strip()
    text = re.sub(r"^\s*[\[«\"“(]*\s*\d+\s*[.)]\s+", "", text)  # 7. label
    text = re.sub(r"\s*\(\s*\d+\s*\)\s*$", "", text)  # label (1)
    text = re.sub(r"(?<=[^\W\d_])(?<=[a-zа-яіїєґ])(?=[A-ZА-ЯІЇЄҐ])", " ", text)
    text = text.lower().replace("’", "'").replace("ʼ", "'").replace("`", "'")
    text = re.sub(r"(?<![^\W\d_])(?:н-р|д-та)(?![^\W\d_])", lambda m: SHORT_WORDS[m[0]], text)
    text = re.sub(r"(?<![^\W\d_])н[\W_]{1,2}р(?![^\W\d_])", "номер", text)
    out = []
    for m in re.finditer(r"№|[^\W\d_]+(?:'[^\W\d_]+)*\.?|\d+", text):
        word, dotted = m[0].rstrip("."), m[0].endswith(".")
        if word in SHORT_WORDS:
            out.append(SHORT_WORDS[word])
        else:
            out.append(word.replace("'", "") + (REST if dotted else ""))
    return out


class Trie:
    """Entries under their spellings; a node is [children, values that end here, bits of the lengths of its spellings]."""

    def __init__(self) -> None:
        self.root: list = [{}, set(), 0]
        self.size = 0

    def add(self, spelling: str, value: str) -> None:
        node, bit = self.root, 1 << len(spelling)
        node[2] |= bit
        for ch in spelling:
            node = node[0].setdefault(ch, [{}, set(), 0])
            node[2] |= bit
        if value not in node[1]:
            node[1].add(value)
            self.size += 1

    def exact(self, query: str) -> set[str]:
        node = self.root
        for ch in query:
            node = node[0].get(ch)
            if node is None:
                return set()
        return node[1]

    def search(self, query: str, most: int) -> dict[str, int]:
        """All values within ``most`` edits of the query, each with its least distance.

        Without blanks and abbreviations only the band of ``most`` about the diagonal is filled.
        """
        free = any(ch in query for ch in (" ", REST))
        if not most and not free:
            return dict.fromkeys(self.exact(query), 0)
        found: dict[str, int] = {}
        n, big = len(query), most + 1
        lengths = -1 if free else ((1 << (2 * most + 1)) - 1) << n >> most
        first = [0] * (n + 1)
        for j in range(1, n + 1):
            first[j] = first[j - 1] + (0 if query[j - 1] in (" ", REST) else 1)
        stack = [(self.root, "", first, None, 0)]
        while stack:
            node, last, row, before, depth = stack.pop()
            if row[n] <= most:
                for value in node[1]:
                    found[value] = min(found.get(value, big), row[n])
            i = depth + 1
            lo, hi = (1, n) if free else (max(1, i - most), min(n, i + most))
            if lo > n:
                continue
            for ch, child in node[0].items():
                if not child[2] & lengths:
                    continue
                skip = 0 if ch == " " else 1
                now = [big] * (n + 1)
                now[0] = row[0] + skip
                least = now[0]
                for j in range(lo, hi + 1):
                    q = query[j - 1]
                    if q == REST:
                        d = min(now[j - 1], min(row[j], row[j - 1]) + (0 if ch != " " else big))
                    else:
                        d = row[j - 1] + (q != ch)
                        other = row[j] + skip
                        if other < d:
                            d = other
                        other = now[j - 1] + (q != " ")
                        if other < d:
                            d = other
                        if j > 1 and q == last and q != ch and query[j - 2] == ch and before is not None and before[j - 2] + 1 < d:
                            d = before[j - 2] + 1
                    now[j] = d
                    if d < least:
                        least = d
                if least <= most:
                    stack.append((child, ch, now, row, i))
        return found


def _paired(costs: list[dict[int, int]], most: int) -> int:
    """The least sum of a one-to-one pairing of rows with numbers, ``most`` + 1 if there is none within it."""
    best = {0: 0}
    for row in costs:
        now: dict[int, int] = {}
        for used, total in best.items():
            for k, d in row.items():
                if not used >> k & 1 and total + d <= most and total + d < now.get(used | 1 << k, most + 1):
                    now[used | 1 << k] = total + d
        best = now
    return min(best.values(), default=most + 1)


class Catalogue:
    """The reference list, ready for look-ups. ``aliases``: further spellings by qname."""

    #: Words of a spelling up to which all their orders are in the trie.
    ORDERED = 4

    def __init__(self, entries: Iterable[dict], aliases: Mapping[str, Iterable[str]] | None = None):
        self.spaced, self.solid, self.words = Trie(), Trie(), Trie()
        self.group: dict[str, str] = {}
        self.long: list[tuple[list[str], str]] = []
        self.long_with: dict[str, set[int]] = {}
        for e in entries:
            q, group, name = e["qname"], e["schema_name"], e["prop_name"]
            self.group[q] = (group or "").lower()
            for label in (e["label"], e["label_uk"], name, *(aliases or {}).get(q, ())):
                for words in ([], words_of(group or "")):
                    self._add(words_of(label or ""), words, q)
        self.cache: dict[tuple[str, str | None], tuple[str, int]] = {}

    def _add(self, words: list[str], group: list[str], q: str) -> None:
        words = [w.rstrip(REST) for w in words]
        if not words:
            return
        if len(words) > self.ORDERED:
            whole = [*words, *group]
            for w in whole:
                self.words.add(w, w)
                self.long_with.setdefault(w, set()).add(len(self.long))
            self.long.append((whole, q))
        orders = permutations(words) if len(words) <= self.ORDERED else [words]
        for order in orders:
            for whole in ([*order], [*group, *order], [*order, *group]) if group else ([*order],):
                self.spaced.add(" ".join(whole), q)
                self.solid.add("".join(whole), q)

    def find(self, text: str, group: str | None = None) -> tuple[str, int]:
        """(qname or ``unmatched``, distance; -1 if unmatched)."""
        key = (text, group)
        if key not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[key] = self.pick(*self.nearest(text), group)
        return self.cache[key]

    def pick(self, near: list[str], distance: int, group: str | None) -> tuple[str, int]:
        """The one of the nearest entries that is meant: that of the group, else the only one."""
        group = (group or "").lower()
        near = [q for q in near if self.group[q] == group] or near
        return (near[0], distance) if len(near) == 1 else (UNMATCHED, -1)

    def _long(self, words: list[str], most: int) -> dict[str, int]:
        """Entries of many words whose words, in any order, are those of the value."""
        if len(words) <= self.ORDERED or not self.long:
            return {}
        near = [self.words.search(w, min(most, allowed(len(w.rstrip(REST))))) for w in words]
        shared = None
        for row in near:
            own = set().union(*(self.long_with[w] for w in row)) if row else set()
            shared = own if shared is None else shared & own
        found: dict[str, int] = {}
        for k in shared or ():
            spelled, q = self.long[k]
            if len(spelled) == len(words):
                d = _paired([{i: row[w] for i, w in enumerate(spelled) if w in row} for row in near], most)
                if d <= most:
                    found[q] = min(found.get(q, d), d)
        return found

    def nearest(self, text: str, within: int = 2) -> tuple[list[str], int]:
        """The entries at the least distance, at most ``within``, and that distance; none and -1 if there are none."""
        words = words_of(text)
        letters = sum(len(w.rstrip(REST)) for w in words if not w.isdigit())
        if not letters:
            return [], -1
        solid, most = "".join(words).replace(REST, ""), allowed(letters)
        spaced = " ".join(words) if any(w.endswith(REST) for w in words) else None
        for bound in range(min(most, within) + 1):
            best = self.solid.search(solid, bound)
            if spaced is not None and bound <= most // 2:
                for q, d in self.spaced.search(spaced, bound).items():
                    best[q] = min(best.get(q, d), d)
            for q, d in self._long(words, bound).items():
                best[q] = min(best.get(q, d), d)
            if best:
                return sorted(q for q, d in best.items() if d == bound), bound
        return [], -1


#: Catalogues of this Python process by the name they were given on the driver.
_KNOWN: dict[str, Catalogue] = {}


def _catalogue(name: str, entries: list[dict], aliases: Mapping[str, list[str]]) -> Catalogue:
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = Catalogue(entries, aliases)
    return _KNOWN[name]


def read_catalogue(catalogue: DataFrame, most_entries: int = 100_000) -> list[dict]:
    """The reference list on the driver; refused beyond ``most_entries``."""
    columns = ["qname", "schema_name", "prop_name", "label", "label_uk"]
    entries = [r.asDict() for r in catalogue.select(*columns).limit(most_entries + 1).collect()]
    if len(entries) > most_entries:
        raise ValueError(f"the catalogue has more than {most_entries} entries")
    return entries


def folded(text: str | None) -> str:
    """The words of a value as one text; values that fold alike are one alias."""
    return " ".join(words_of(text or "")).replace(REST, "")


def mine_aliases(pairs: DataFrame, one: str, other: str, group: str, entries: list[dict], aliases: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(qname, alias, votes): values of either column that aren't spelled as an entry, under the entry that their neighbours mean.

    Every row with both values votes; counts cover all rows. A value without an entry needs ``FEW`` votes, one that
    is near another entry ``MANY``; the commonest vote must be ``SHARE`` of all. One shuffle of counted votes.
    """
    source = pairs.select(F.col(one).alias("a"), F.col(other).alias("b"), F.col(group).alias("g")).where("a IS NOT NULL AND b IS NOT NULL")
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _catalogue(name, entries, aliases or {})
        for pdf in batches:
            votes: Counter = Counter()
            for a, b, g in pdf[["a", "b", "g"]].itertuples(index=False):
                left, right = known.find(a, g), known.find(b, g)
                for text, (own, d), (vote, _) in ((a, left, right), (b, right, left)):
                    if d != 0 and vote not in (UNMATCHED, own):
                        votes[folded(text), own != UNMATCHED, vote] += 1
            yield pd.DataFrame([(*k, n) for k, n in votes.items() if k[0]], columns=["alias", "near", "qname", "n"])

    counted = map_batches(source, run, "alias string, near boolean, qname string, n long").groupBy("alias", "near", "qname").agg(F.sum("n").alias("n"))
    best = counted.groupBy("alias", "near").agg(F.max_by("qname", F.struct("n", "qname")).alias("qname"), F.max("n").alias("votes"), F.sum("n").alias("all"))
    enough = F.col("votes") >= F.when(F.col("near"), MANY).otherwise(FEW)
    return best.where(enough & (F.col("votes") >= SHARE * F.col("all"))).select("qname", "alias", "votes")


def _search_rest(texts: DataFrame, rest: DataFrame, entries: list[dict], shard: int, values: int) -> DataFrame:
    """(__text, near, distance) of the texts with what the aliases of ``rest`` add to it.

    The aliases are cut into shards, by length, of about ``shard``; every text is searched in a trie of each, within the
    distance that it has. The nearest entries of all are the nearest of the shards' nearest, so nothing is lost.
    """
    texts = cut(texts)
    shards, slices = -(-rest.count() // shard), max(1, -(-texts.count() // values))
    order = [F.length("alias"), "alias", "qname"]
    numbered = cut(rest.repartitionByRange(shards, *order).select("qname", "alias", F.spark_partition_id().alias("shard")))
    here = numbered.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    there = texts.withColumns({"s": F.pmod(F.xxhash64("__text"), F.lit(slices)).cast("int"), "t": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    bare = [{"qname": e["qname"], "schema_name": e["schema_name"], "prop_name": None, "label": None, "label_uk": None} for e in entries]
    ship(texts.sparkSession)

    def run(found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        also: dict[str, list[str]] = {}
        for q, alias in own[["qname", "alias"]].itertuples(index=False):
            also.setdefault(q, []).append(alias)
        known, out = Catalogue(bare, also), []
        for text, d in found[["__text", "distance"]].itertuples(index=False):
            got = known.nearest(text, d if d >= 0 else 2)
            if got[0]:
                out.append((text, *got))
        return pd.DataFrame(out, columns=["__text", "near", "distance"])

    schema = "__text string, near array<string>, distance int"
    more = there.groupBy("t", "s").cogroup(here.groupBy("shard", "slice")).applyInPandas(run, schema)
    every = texts.unionByName(more).where("distance >= 0")
    least = every.groupBy("__text", "distance").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    return least.groupBy("__text").agg(F.min_by("near", "distance").alias("near"), F.min("distance").alias("distance"))


def map_to_catalogue(
    values: DataFrame, text: str, group: str, entries: list[dict], keep: list[str], aliases: DataFrame | None = None, most_aliases: int = 50_000, shard: int = 5_000, slice_values: int = 20_000
) -> DataFrame:
    """``keep`` with qname and distance of each non-null value.

    ``entries`` as of ``read_catalogue``; ``aliases`` (qname, alias, votes) may be as many as the values give: the
    ``most_aliases`` with most votes are in the trie of every worker. Up to that many the map is narrow, so a value that a
    third of all rows carry costs one search per worker and no shuffle. If there are more, distinct values are also searched
    in tries of the others, ``shard`` aliases and ``slice_values`` values a task, with the result of one trie of all.
    """
    by_votes: list = []
    if aliases is not None:
        by_votes = aliases.orderBy(F.desc("votes"), "alias", "qname").limit(most_aliases + 1).collect()
    also: dict[str, list[str]] = {}
    for r in by_votes[:most_aliases]:
        also.setdefault(r["qname"], []).append(r["alias"])
    source = values.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"), F.col(group).alias("__group"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*keep).schema) + ", qname string, distance int"
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _catalogue(name, entries, also)
        for pdf in batches:
            if "__near" in pdf:
                rows = pdf[["__near", "__distance", "__group"]].itertuples(index=False)
                got = [(UNMATCHED, -1) if near is None else known.pick(list(near), int(d), g) for near, d, g in rows]
            else:
                got = [known.find(t, g) for t, g in zip(pdf["__text"], pdf["__group"], strict=True)]
            out = pdf[keep].copy()
            out["qname"], out["distance"] = [q for q, _ in got], pd.Series([d for _, d in got], dtype="int32", index=out.index)
            yield out

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _catalogue(name, entries, also)
        for pdf in batches:
            yield pd.DataFrame([(t, *known.nearest(t)) for t in pdf["__text"]], columns=["__text", "near", "distance"])

    if len(by_votes) > most_aliases:
        last = by_votes[most_aliases]
        same, later = F.col("alias") == last["alias"], F.col("alias") > last["alias"]
        after = (F.col("votes") < last["votes"]) | (F.col("votes") == last["votes"]) & (later | same & (F.col("qname") >= last["qname"]))
        texts = map_batches(source.select("__text").distinct(), nearest, "__text string, near array<string>, distance int")
        found = _search_rest(texts, aliases.where(after), entries, shard, slice_values)
        source = source.join(found.select("__text", F.col("near").alias("__near"), F.col("distance").alias("__distance")), "__text", "left")
    return map_batches(source, run, schema).select(*keep, "qname", "distance")
