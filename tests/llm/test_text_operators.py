"""Names, look-ups, look-alikes, mixes and toxicity: brute force, round trips and odd input."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import lookalike as A
from tabloom.llm import lookup as U
from tabloom.llm import mixing as M
from tabloom.llm import names as N
from tabloom.llm import toxicity as X


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j - 1] + (x != y), row[j] + 1, now[-1] + 1))
        row = now
    return row[-1]


def test_near_keys_always_share_an_entry():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        short, long = sorted((a, "".join(b)), key=len)
        if short and levenshtein(short, long) <= N.allowed_edits(len(short)):
            assert set(N.index_entries(short)) & set(N.probe_entries(long)), (short, long)


def test_keys_near_by_swaps_share_an_entry():
    rng = random.Random(3)
    for _ in range(20000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 14)))
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(b))
            if rng.random() < 0.6:
                b[at : at + 2] = b[at : at + 2][::-1]
            else:
                b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        short, long = sorted((a, "".join(b)), key=len)
        if short and N.osa(short, long, 3) <= N.allowed_edits(len(short)):
            assert set(N.index_entries(short)) & set(N.probe_entries(long)), (short, long)
            for most in (1, 2, 3):
                if N.osa(short, long, 3) <= most:
                    assert set(N.index_entries(long, most)) & set(N.probe_entries(short, most, True)), (short, long)
                    assert set(N.index_entries(short, most)) & set(N.probe_entries(long, most, True)), (short, long)


def test_every_pair_that_is_one_party_meets():
    rng = random.Random(12)
    key = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(4, 10)))
    met = 0
    for _ in range(40000):
        kind = rng.choice("po")
        base = {"kind": kind, "keys": [key()], "given": "", "patronymic": "", "form": "", "trade": "", "birth": "", "place": "", "reg": ""}
        pair = []
        for _ in range(2):
            k = list(base["keys"][0])
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(k))
                k[at : at + 2] = k[at : at + 2][::-1] if rng.random() < 0.5 else k[at + 1 : at + 2]
            x = base | {"keys": ["".join(k)]}
            if kind == "p":
                x |= {"given": rng.choice(["", "i.", "ivan", "ivan|petro", "petro"]), "patronymic": rng.choice(["", "p.", "petroviT"]), "birth": rng.choice(["", "2000-01-01"])}
            else:
                x |= {"trade": rng.choice(["", "prom", "proekt", "proekt|prom"]), "reg": rng.choice(["", "", "1"])}
            pair.append(x | {"place": rng.choice(["", "x"])})
        a, b = pair
        if a["keys"][0] and b["keys"][0] and N.same_party(a, b):
            met += 1
            tokens = []
            for x in pair:
                offers, asks = N.meetings(x)
                tokens.append(({(c, e) for c, m in offers for e in N.index_entries(x["keys"][0], m)}, {(c, e) for c, m, longer in asks for e in N.probe_entries(x["keys"][0], m, longer)}))
            (o1, a1), (o2, a2) = tokens
            assert o1 & a2 or o2 & a1, pair
    assert met > 3000


def test_keys_meet_by_rests_and_ends_if_near_and_hardly_otherwise():
    rng = random.Random(5)
    of = lambda key: {int(t) for _, tokens in N.key_tokens([key]) for t in tokens.ravel()}
    met = Counter()
    for _ in range(8000):
        a = "".join(rng.choice("abcdї") for _ in range(rng.randint(1, 22)))
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b[at : at + 2] = b[at : at + 2][::-1]
            else:
                b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        b = "".join(b)
        least, apart = N.allowed_edits(min(len(a), len(b))), N.osa(a, b, 3)
        if b and apart <= min(least, 2):
            met[min(len(a), len(b)) > N.SHORT_KEY] += 1
            assert of(a) & of(b), (a, b)
        if apart <= least == 3:
            met[3] += 1
            assert set(N.end_entries(a)) & set(N.end_entries(b)), (a, b)
    assert min(met[False], met[True], met[3]) > 500
    # All of these share a segment, so the segments of 1,000 bare names met half a million times; hardly any two are near.
    keys = sorted({"".join(rng.choice("abdehiklmnoprstuv") for _ in range(7)) + "mutnuk" for _ in range(1000)})
    tokens = np.concatenate([t for _, t in N.key_tokens(keys)])
    pairs = [(a, b) for x, y in N.shared_runs(tokens.ravel(), np.repeat(np.arange(len(keys)), tokens.shape[1])) for a, b in zip(x, y, strict=True)]
    ends = Counter(e for key in keys for e in {*N.index_entries(key, 2)})
    assert max(ends.values()) == len(keys) and len(pairs) < len(keys)
    assert sorted(zip(*[x.tolist() for x in map(np.concatenate, zip(*N.shared_runs(np.array([7, 5, 7, 7, 5]), np.array([1, 2, 3, 3, 1])), strict=True))], strict=True)) == [(1, 2), (1, 3), (1, 3)]


def test_candidates_hold_every_pair_that_is_one_party(spark):
    rng = random.Random(8)
    spellings = []
    for sid in range(400):
        keys = ["".join(rng.choice("ab") for _ in range(rng.choice([3, 4, 5, 7, 9, 10, 11]))) + rng.choice(["", "", "cdcdcdcdcd"]) for _ in range(rng.choice([1, 1, 2]))]
        x = {"kind": rng.choice("po"), "keys": keys, "given": "", "patronymic": "", "form": "", "trade": "", "birth": "", "place": rng.choice(["", "x"]), "reg": ""}
        if x["kind"] == "p":
            x |= {"given": rng.choice(["", "i.", "ivan"]), "patronymic": rng.choice(["", "petroviT"]), "birth": rng.choice(["", "2000-01-01"])}
        else:
            x |= {"keys": keys[:1], "trade": rng.choice(["", "prom", "proekt|prom"]), "reg": rng.choice(["", "", "1"])}
        spellings.append(x | {"sid": sid})
    schema = "sid long, kind string, keys array<string>, given string, patronymic string, form string, trade string, birth string, place string, reg string"
    df = spark.createDataFrame([tuple(x[c] for c in ("sid", *N.FIELDS)) for x in spellings], schema)
    got = [tuple(r) for r in N._candidates(df).collect()]
    one = {(a["sid"], b["sid"]) for i, a in enumerate(spellings) for b in spellings[i + 1 :] if N.same_party(a, b)}
    assert len(one) > 300 and one <= set(got) and len(got) == len(set(got))


def test_trades_are_the_words_that_many_organisations_have(spark):
    rows = [(f"ТОВ Назва{chr(1072 + i)}{chr(1072 + i)} {'Буд' if i % 2 else 'Агро'}", "organisation") for i in range(20)] + [("Агро Іван", "person"), (None, "organisation"), ("ПП Агро", "organisation")]
    df = spark.createDataFrame(rows, "n string, k string")
    assert N.mine_trades(df, "n", "k", share=0.2).trades == ("ahro", "bud") and N.mine_trades(df.limit(0), "n", "k").trades == ()


def test_swapped_spellings_are_linked(spark):
    def linked(*surnames):
        rows = [(i, "person", f"{s} Петро Тарасович", "16.02.1990") for i, s in enumerate(surnames)]
        df = spark.createDataFrame(rows, "id long, k string, n string, b string").withColumns({"p": F.lit(None).cast("string"), "r": F.lit(None).cast("string")})
        return {tuple(r) for r in N.linked_pairs(*N.link_spellings(N.read_names(df, "id", "n", "k", "b", "p", "r", N.Lexicon()))).collect()}

    # One swap across the segment border of a key of four, and three swaps (six plain edits) in a key of twelve.
    assert linked("Бура", "Бруа") == {(0, 1)}
    assert linked("Балодемогуни", "Аблодмеогнуи") == {(0, 1)}
    assert linked("Бура", "Колодемогуни") == set()


def test_edits_count_swaps_once():
    assert N.osa("abcd", "abdc", 2) == 1 and N.osa("abc", "abc", 0) == 0 and N.osa("a", "bcde", 2) == 3


def test_spellings_of_a_party_are_linked_and_namesakes_not(spark):
    rows = [
        (1, "person", "Турошмабук Петро Тарасович", "16.02.1990", "Озерянка", None), (2, "person", "ТУРОШМАБУК ПЕТ. ТАРАСОВИЧ", "1990-02-16", None, None), (3, None, "Turoshmabuk Petro Tarasovych", "16.02.1990", "Озерянка", None),
        (4, "person", "Туршомабук Петтро Тарасович", None, "Озерянка", None), (5, "person", "Турошмабук П.Т.", "16.02.1990", "Озерянка", None), (6, "person", "Турошмабук Петро Тарасович", "17.02.1990", "Гуслин", None),
        (7, "person", "Турошмабук Ольга Тарасівна", "16.02.1990", "Озерянка", None), (8, "organisation", 'ТОВ "Панакзуц-Пром"', None, "Гуслин", None), (9, "organisation", "Товариство з обмеженою відповідальністю «Пром Панакзуц»", None, None, None),
        (10, "organisation", 'ДП "Панакзуц-Пром"', None, "Гуслин", None), (11, "organisation", "ТОВ Панакзуц-Агро", None, "Гуслин", None), (12, None, None, None, None, None), (13, "person", "  ", None, None, None), (14, "person", "Турошмабук Петро Тарасович", "16.02.1990", "Озерянка", None),
    ]
    df = spark.createDataFrame(rows, "id long, k string, n string, b string, p string, r string")
    known = N.Lexicon(trades=("пром", "агро"))
    got = {tuple(r) for r in N.linked_pairs(*N.link_spellings(N.read_names(df, "id", "n", "k", "b", "p", "r", known))).collect()}
    one = [1, 2, 3, 4, 5, 14]
    assert got == {(a, b) for i, a in enumerate(one) for b in one[i + 1 :]} | {(8, 9)}
    assert N.linked_pairs(*N.link_spellings(N.read_names(df.limit(0), "id", "n", "k", "b", "p", "r"))).count() == 0


CATALOGUE = [("A:birthDate", "A", "birthDate", "Birth date", "Дата народження"), ("A:deathDate", "A", "deathDate", "Death date", "Дата смерті"), ("B:model", "B", "model", "Model", "Модель"), ("C:model", "C", "model", "Model", "Модель")]


def test_values_find_their_entry(spark):
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("Birth date", None), ("date, Birth *", None), ("БІРТ", None), ("7. Brith date", None), ("д-та народж.", None), ("a:deathdate", None), ("Model", "b"), ("Model", None), ("", None), ("12", None), ("x" * 5000, None), (None, None)])], "id long, t string, g string")
    cat = spark.createDataFrame(CATALOGUE, "qname string, schema_name string, prop_name string, label string, label_uk string")
    got = {r["id"]: r["qname"] for r in U.map_to_catalogue(df, "t", "g", U.read_catalogue(cat), ["id"]).collect()}
    assert got == {0: "A:birthDate", 1: "A:birthDate", 2: "unmatched", 3: "A:birthDate", 4: "A:birthDate", 5: "A:deathDate", 6: "B:model", 7: "unmatched", 8: "unmatched", 9: "unmatched", 10: "unmatched"}


def test_many_words_are_found_in_any_order():
    c = U.Catalogue([{"qname": "A:x", "schema_name": "A", "prop_name": "x", "label": "date of first entry here", "label_uk": None}])
    assert c.find("entry of date here first") == ("A:x", 0) and c.find("entrry of dtae here first") == ("A:x", 2)
    assert c.find("entry of date here") == (U.UNMATCHED, -1) and c.find("a entry of date here first") == ("A:x", 0)


def test_aliases_come_from_neighbours_and_need_agreement(spark):
    cat = U.read_catalogue(spark.createDataFrame(CATALOGUE, "qname string, schema_name string, prop_name string, label string, label_uk string"))
    rows = [("Entered the world", "birthDate")] * 3 + [("left us", "Death date"), ("left us", None), ("zzz", "birthDate"), ("zzz", "deathDate"), (None, "birthDate")]
    df = spark.createDataFrame(rows, "h string, p string").withColumn("g", F.lit(None).cast("string"))
    got = U.mine_aliases(df, "h", "p", "g", cat)
    assert [tuple(r) for r in got.collect()] == [("A:birthDate", "entered the world", 3)]
    for most in (10, 0):
        found = [r["qname"] for r in U.map_to_catalogue(df, "h", "g", cat, ["h"], got, most_aliases=most).orderBy("h").collect()]
        assert found == ["A:birthDate"] * 3 + ["unmatched"] * 4
    assert U.mine_aliases(df.limit(0), "h", "p", "g", cat).count() == 0


def test_aliases_beyond_the_workers_trie_are_found_as_those_in_it(spark):
    """Misspelled, in another order, abbreviated, beside the group, of many words, and tied with other entries."""
    cat = U.read_catalogue(spark.createDataFrame(CATALOGUE, "qname string, schema_name string, prop_name string, label string, label_uk string"))
    rows = [("A:birthDate", "entered the world", 5), ("A:deathDate", "left us", 4), ("B:model", "shape", 3), ("C:model", "shape", 3), ("B:model", "birth dates", 2), ("A:deathDate", "day of the last breath taken", 2), ("D:gone", "stranger", 2)]
    aliases = spark.createDataFrame(rows, "qname string, alias string, votes long")
    texts = ["Entered the world", "the wrold entered", "ent. the world", "A entered the world", "lft us", "shape", "shaep", "Birth date", "birth datess", "breath taken the last day of", "breth taken the last day of", "Model", "stranger", "zzz", "", "12", None]
    df = spark.createDataFrame([(2 * i + k, t, g) for i, t in enumerate(texts) for k, g in enumerate((None, "c"))], "id long, t string, g string")
    mapped = lambda most, *sizes: sorted(map(tuple, U.map_to_catalogue(df, "t", "g", cat, ["id"], aliases, most, *sizes).collect()))
    whole = mapped(10)
    assert mapped(3) == whole
    assert mapped(1, 2, 3) == whole and mapped(0, 3, 100) == whole
    at = {i: (q, d) for i, q, d in whole}
    assert at[2] == ("A:birthDate", 1) and at[8] == ("A:deathDate", 1) and at[10] == ("unmatched", -1) and at[13] == ("C:model", 1) and at[14] == ("A:birthDate", 0) and at[20] == ("A:deathDate", 1)


def test_the_automaton_agrees_with_brute_force():
    rng, trie, words = random.Random(2), U.Trie(), set()
    for _ in range(200):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        words.add(w)
        trie.add(w, w)
    for _ in range(300):
        q = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        for most in (0, 1, 2):
            assert trie.search(q, most) == {w: d for w in words if (d := N.osa(q, w, most)) <= most}


def test_disguised_text_comes_back():
    w = A.Rewriter(Counter("звичайний текст plain text"))
    plain = ["Районний суд Озерянка", "Kancelaria Żółwiniec", "ПП Рижбуд-Агро", "№ з/п 5", "Núria Castellvern", "поліції", "a\nb", "II відділ"]
    assert [w.clean(x) for x in plain] == plain
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)
    assert w.clean(wide("Kancelaria AB-1")) == "Kancelaria AB-1"
    assert w.clean("Рaйoнний суд  Озе​рянка ") == "Районний суд Озерянка"
    assert w.clean("поліцiï") == "поліції" and w.clean("Кancеlaria") == "Kancelaria" and w.clean("Петро й") == "Петро й"
    assert w.clean("") == "" and w.clean("​") == ""


def test_undecided_words_follow_their_compound():
    w = A.Rewriter()
    assert w.clean("ПрАТ Нежорпиг-Тpaнc") == "ПрАТ Нежорпиг-Транс" and w.clean("суд Hижній-Бpiд") == "суд Нижній-Брід"
    assert w.clean("IT-компанія") == "IT-компанія"


def test_blanks_that_separate_values_stay():
    w = A.Rewriter()
    assert w.clean("a@b.test  c@d.test ", True) == "a@b.test  c@d.test" and w.clean("a@b.test  c@d.test") == "a@b.test c@d.test"
    assert w.clean("a@b.test\u3000c@d.test", True) == "a@b.test c@d.test"


def test_classes_are_transitive():
    c = A.look_alikes()
    assert c.find("ｏ") == c.find("o") == c.find("о") == c.find("ο") and c.find("a") != c.find("o") and c.find("ï") == c.find("ї") == c.find("ї")


def test_only_changed_rows_and_all_counts(spark):
    df = spark.createDataFrame([(1, "Рaйон"), (2, "Район"), (3, None), (4, ""), (5, "я" * 100_000 + "­")], "id long, t string")
    f = A.frequencies(A.code_point_counts(df, ["t"]))
    assert f["я"] == 100_000 and f["Р"] == 2
    got = {r["id"]: r["clean_text"] for r in A.rewritten(df, "t", ["id"], f).collect()}
    assert got == {1: "Район", 5: "я" * 100_000}
    assert A.frequencies(A.code_point_counts(df.limit(0), ["t"])) == {}


def test_mixes_reach_their_shares(spark):
    rng = random.Random(4)
    rows = [(i, "abc"[i % 3 if i % 7 else 0], rng.randint(1, 50)) for i in range(6000)] + [(9000, "a", 0), (9001, "z", 10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)], "doc_source string, target_share double, max_repeats int")
    sizes = M.sized(df, "doc_id", "source")
    plans = M.plan_mix(sizes, targets)
    mixed = M.mix(sizes, plans)
    for p in plans.collect():
        # Brute force: documents in the order of their hash, as many as fit.
        have = sorted((r["key"], r["n_tokens"]) for r in sizes.where(F.col("source") == p.source).collect())
        left, taken = p.budget - p.passes * sum(n for _, n in have), 0
        for _, n in have:
            if taken + n > left or p.passes >= p.max_repeats:
                break
            taken += n
        assert p.reached == p.passes * sum(n for _, n in have) + taken
    for r in M.shares(mixed, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.002 and r["repeats"] <= r["max_repeats"]
    small = M.mix(sizes, M.plan_mix(sizes, targets, 5000))
    assert small.join(mixed, "doc_id", "left_anti").count() == 0
    assert M.mix(sizes.limit(0), M.plan_mix(sizes.limit(0), targets)).count() == 0


def test_equal_hashes_are_told_apart_by_their_ids(spark):
    rows = [(i, "a", 5, 10) for i in range(8)] + [(20, "a", 4, 7), (21, "a", 9, 1), (3, "a", 5, 10)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, key long, n_tokens long")
    budgets = lambda n: spark.createDataFrame([("a", n)], "source string, budget long")
    # The row of key 4, then ids 0, 1, 2; both rows of id 3 are too many for 45 tokens.
    assert tuple(M.thresholds(sizes, budgets(45)).first()) == ("a", 5, 2, 37)
    assert tuple(M.thresholds(sizes, budgets(57)).first()) == ("a", 5, 3, 57)
    assert M.thresholds(sizes, budgets(3)).first()["reached"] == 0 and M.thresholds(sizes, budgets(98)).first()["reached"] == 98


def corpus(n=600):
    rng, docs = random.Random(6), []
    bad = {"abusive": ["you stupid cow shut your mouth", "drown yourself you worthless rat"], "hateful": ["all oskeni are vermin and thieves", "burn the houses of the tarashi"], "sexual": ["send me nudes i want your body", "get naked with me tonight"]}
    good = ["the oskeni cooperative pays its rent", "cows and pigs were listed by the officer", "the file was sent to the office on monday", "the tarashi spoke through an interpreter", "the house of the debtor was sold", "the row is empty and the key is the number"]
    for i in range(n):
        parts, k = rng.sample(good, 4), "none"
        if i % 3 == 0:
            k = rng.choice(list(bad))
            parts.insert(rng.randint(0, 4), rng.choice(bad[k]))
        docs.append((i, ". ".join(parts), k))
    return docs


def test_toxic_passages_are_found_on_held_out_documents(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, category string")
    model = X.fit_corpus(df.select("doc_id", "text"), df.where("doc_id < 400").select("doc_id", "category"))
    got = X.score_documents(df, model, ["doc_id", "category"]).where("doc_id >= 400").collect()
    right = sum(all(r[c] == (r["category"] == c) for c in X.CATEGORIES) for r in got)
    assert right >= 0.9 * len(got)
    r = next(r for r in got if r["category"] == "abusive" and r["abusive"])
    words = X.tokens_of(docs[r["doc_id"]][1])[r["abusive_start"] : r["abusive_end"]]
    assert {"cow", "rat", "mouth", "worthless", "stupid", "drown"} & set(words)
    odd = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "12 34", None), (4, "you st*pid cow shut your mouth " * 3000, "s")], "doc_id long, text string, source string")
    scored = {r["doc_id"]: r for r in X.score_documents(odd, model, ["doc_id", "source"]).collect()}
    assert not any(scored[i][c] for i in (1, 2, 3) for c in X.CATEGORIES) and scored[4]["abusive"]
    assert X.rates(X.score_documents(odd, model, ["doc_id", "source"])).count() == 2


def test_without_labels_nothing_is_found(spark):
    df = spark.createDataFrame(corpus(30), "doc_id long, text string, category string")
    model = X.fit_corpus(df.select("doc_id", "text"), df.select("doc_id", "category").limit(0))
    assert X.score_documents(df, model, ["doc_id"]).where("abusive OR hateful OR sexual").count() == 0


def test_disguised_words_are_read():
    assert X.tokens_of("St00pid b@st@rd k r e t y n idiooot ar​t") == ["stoopid", "bastard", "kretyn", "idiot", "art"]


def test_segments_are_the_maximal_ones():
    rng = random.Random(8)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 1.0, 2.0]) for _ in range(12)]
        got = X.passages(np.array(s))
        best = max((sum(s[a:b]) for a in range(12) for b in range(a + 1, 13)), default=0)
        assert max((x[2] for x in got), default=0.0) == max(best, 0.0)
        assert all(abs(sum(s[a:b]) - x) < 1e-9 for a, b, x in got)
    assert X.passages(np.zeros(0)) == []


def test_several_passages_weigh_more_than_one_and_weak_ones_nothing():
    one, weak, two = X.significance([9.0]), X.significance([9.0, 1.0, 0.5]), X.significance([9.0, 8.0])
    assert one == weak and one[1] == 1 and two[0] > one[0] and two[1] == 2
    assert X.significance([]) == X.significance([-3.0]) == (0.0, 0)


def test_lambda_is_the_root_of_its_equation():
    scores, weights = np.array([-1.0, 2.0, -2.0]), np.array([70, 5, 25])
    x = X._root(scores, weights)
    assert abs((weights / 100 * np.exp(x * scores)).sum() - 1) < 1e-9


def test_numbers_of_words_and_pairs():
    lexis = X.Lexis(["a", "b", "a b"])
    assert lexis.numbers(["a", "b", "x", "a"]).tolist() == [2, 4, 3, X.NO_PAIR, X.NO_WORD, X.NO_PAIR, 2] and len(lexis.numbers([])) == 0


def test_the_labelled_sample_keeps_its_bounds(spark):
    df = spark.createDataFrame([(i, "abc def") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "none") for i in range(20)] + [(3, "sexual")], "doc_id long, category string")
    assert len(X.labelled_sample(df, labels, "doc_id", "text", 5)) == 5 and len(X.labelled_sample(df, labels, "doc_id", "text", 50, 36)) == 5
    assert len(X.labelled_sample(df, labels, "doc_id", "text")) == 20
