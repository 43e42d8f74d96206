"""Queries of the llm operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import lookalike, lookup, mixing, names, tokens, toxicity
from tabloom.operators.packed import RULES
from tabloom.session import cut, table

CELLS = [f"c{k}" for k in range(14)]
#: Rows up to which a register of sources counts as small.
SMALL = 10_000


def _read_names(spark: SparkSession, d: str) -> DataFrame:
    return names.read_names(table(spark, d, "party_names"), "party_row_id", "name_typed", "party_kind", "birth_text", "place_name", "reg_code")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(*names.link_spellings(_read_names(spark, d)))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its spelling and the number of other spellings that this is linked to: the links without the pairs of their copies."""
    members, links = names.link_spellings(_read_names(spark, d))
    ends = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "sid", "left").select(F.col("row_id").alias("party_row_id"), F.col("sid").alias("spelling_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "decisions").select("decision_id", "entity_key", "header", "prop")
    return df.unpivot(["decision_id", "entity_key"], ["header", "prop"], "field_name", "typed")


def _mapped(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    """Every typed value under its entry; aliases come from what was entered beside each other in one decision."""
    entries = lookup.read_catalogue(table(spark, d, "prop_catalogue"))
    aliases = lookup.mine_aliases(table(spark, d, "decisions"), "header", "prop", "entity_key", entries)
    return lookup.map_to_catalogue(_typed(spark, d), "typed", "entity_key", entries, keep, cut(aliases))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, ["decision_id", "field_name"]).select("decision_id", "field_name", "qname")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """How often each unmatched value was typed."""
    got = _mapped(spark, d, ["field_name", "typed"])
    return got.where(F.col("qname") == lookup.UNMATCHED).groupBy("field_name", "typed").agg(F.count(F.lit(1)).alias("n"))


def p5_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The aliases that the decisions give."""
    return lookup.mine_aliases(table(spark, d, "decisions"), "header", "prop", "entity_key", lookup.read_catalogue(table(spark, d, "prop_catalogue")))


def _blank_separated(spark: SparkSession, d: str) -> DataFrame:
    """Per source the columns whose type takes blanks as separators of packed values."""
    types = [name for name, rule in RULES.items() if " " in rule.separators]
    spaced = F.filter(F.transform("column_types", lambda t, k: F.when(t.isin(types), F.concat(F.lit("c"), k.cast("string")))), lambda c: c.isNotNull())
    df = table(spark, d, "sources").select("source_id", spaced.alias("spaced"))
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows, columns = table(spark, d, "frame_rows"), table(spark, d, "frame_columns")
    frequency = lookalike.frequencies(lookalike.code_point_counts(rows, CELLS), lookalike.code_point_counts(columns, ["header"]))
    cells = rows.select("row_id", "source_id", *CELLS).unpivot(["row_id", "source_id"], CELLS, "column_id", "text")
    cells = cells.where(lookalike.suspect(F.col("text"))).join(_blank_separated(spark, d), "source_id", "left")
    cells = cells.select(F.concat(F.lit("frame_rows."), "column_id").alias("field_name"), F.col("row_id").alias("row_key"), "text", F.array_contains("spaced", F.col("column_id")).alias("runs"))
    headers = columns.select(F.lit("frame_columns.header").alias("field_name"), F.col("column_key").alias("row_key"), F.col("header").alias("text"), F.lit(False).alias("runs"))
    return lookalike.rewritten(cells.unionByName(headers), "text", ["field_name", "row_key"], frequency, "runs")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"), ["doc_id"], "text")


def p8_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every text's letters alone, four times over: a run that the tokenizer doesn't split, encoded by several tasks from 2,048 letters on."""
    letters = F.repeat(F.regexp_replace("text", r"[^\p{L}]", ""), F.lit(4))
    df = table(spark, d, "documents").select("doc_id", letters.alias("run"))
    return tokens.encode_texts(df, ["doc_id"], "run", spread=2_048)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, d, "documents"), "text", ["doc_id", "source"])
    return mixing.sized(counts, "doc_id", "source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d)
    return mixing.mix(sizes, mixing.plan_mix(sizes, table(spark, d, "mix_targets")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = toxicity.fit_corpus(documents, table(spark, d, "doc_labels"))
    return toxicity.score_documents(documents, model, ["doc_id", "source"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    long = p10_scores(spark, d).unpivot(["doc_id"], list(toxicity.CATEGORIES), "category", "found")
    return long.where("found").select("doc_id", "category")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(p10_scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p4_found, p4_members, p5_found, p5_unmatched, p5_aliases, p7_found, p8_ids, p8_runs, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)
}
ORACLE: dict[str, str] = {}
