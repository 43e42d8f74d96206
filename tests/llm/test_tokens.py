import random

from tokenizers import Tokenizer

from tabloom.llm import tokens as T


def reference():
    t = Tokenizer.from_file(f"{T.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def texts():
    rng = random.Random(7)
    words = ["abc", "it's", "don't", "they'll", "12", "345", "  ", " ", "\n", "\n\n", "\t", "…", "ї", "Київ", "日本", "🙂", "-", "--", "'", "'r", "e", "<|endoftext|>", "a" * 30]
    for n in (0, 1, 2, 5, 40, 300):
        for _ in range(12):
            yield "".join(rng.choice(words) + (" " if rng.random() < 0.5 else "") for _ in range(n))
    yield "a" * 5000
    yield " " * 5000 + "x" + " " * 300
    yield "".join(rng.choice("abcdefgh") for _ in range(6000))
    yield "".join(rng.choice("абвгдежз") for _ in range(3000))
    yield "!" * 3000 + "?" * 100


def test_tree_concatenation_is_exact_at_any_leaf():
    ids, data = reference(), T.vocabulary()
    for leaf, run in ((1, 8), (3, 16), (17, 64), (1000, 256)):
        encoder = T.TreeEncoder(data, leaf=leaf, run=run)
        for text in texts():
            if leaf < 17 and len(text) > 1500:
                continue
            assert encoder.encode(text) == ids(text), (leaf, text[:80])
            assert encoder.tree([encoder.piece(text[i : i + leaf]) for i in range(0, len(text), leaf)]).ids == ids(text), (leaf, text[:80])
            assert encoder.encoding.encode_ordinary(text) == ids(text)


def test_null_and_empty_have_no_ids():
    encoder = T.TreeEncoder(T.vocabulary())
    assert encoder.encode(None) == [] and encoder.encode("") == []


def test_long_texts_are_cut_over_tasks(spark):
    ids = reference()
    rows = [(1, "word " * 50), (2, None), (3, ""), (4, "a" * 700 + " b" * 300), (5, "x" * 64), (6, "x" * 65)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in T.encode_texts(df, ["doc_id"], "text", leaf=16, spread=64).collect()}
    assert got == {i: ids(t or "") for i, t in rows}


def test_repeated_rows_come_out_as_often_and_tasks_agree_on_runs(spark):
    ids = reference()
    rng = random.Random(3)
    run = "".join(rng.choice("абвгд") for _ in range(3000))
    df = spark.createDataFrame([(1, "s", run), (1, "s", run), (1, "t", run), (1, "s", run[1:])], "doc_id long, ids_of string, text string")
    got = sorted((r["ids_of"], list(r["ids"])) for r in T.encode_texts(df, ["doc_id", "ids_of"], "text", spread=256).collect())
    assert got == sorted([("s", ids(run)), ("s", ids(run)), ("t", ids(run)), ("s", ids(run[1:]))])
    assert [r["n_tokens"] for r in T.token_counts(df.where("ids_of = 't'"), "text", ["doc_id"], spread=256).collect()] == [len(ids(run))]
    assert T.encode_texts(df.limit(0), ["doc_id"], "text").count() == 0
