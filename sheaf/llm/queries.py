"""Queries of the problems on names and texts, each over its whole tables with the operators' own parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import canonical, containers, encoding, leakage, lookalike, names, reading, survivors
from sheaf.llm.oracles import ORACLES as _ORACLES
from sheaf.session import materialized, table

ORACLES: dict[str, str] = dict(_ORACLES)


# 1: variant spellings of names


def _people(spark: SparkSession, d: str) -> DataFrame:
    return materialized(names.resolve(table(spark, d, "researchers"), "researcher_id", "name", "orcid", "field_of_research"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    people = _people(spark, d)
    pairs = names.same_person_pairs(people).select(F.lit("researcher").alias("link_kind"), "left_id", "right_id", F.lit(0).alias("pos"))
    own = names.author_entries(table(spark, d, "publications"), "publication_id", "researcher_id", "authors", people)
    own = own.where(F.col("entry") != F.trim("name")).select(F.lit("author").alias("link_kind"), F.col("paper_id").alias("left_id"), F.col("key").alias("right_id"), "pos")
    return pairs.unionByName(own)


def p1_people(spark: SparkSession, d: str) -> DataFrame:
    """Every key with its person and the person's number of keys."""
    people = _people(spark, d)
    n = people.groupBy("entity").agg(F.count(F.lit(1)).alias("n_keys"))
    return people.join(n, "entity").select(F.col("key").alias("researcher_id"), F.col("entity").alias("person_id"), "n_keys")


# 2: garbled text


def _counts(spark: SparkSession, d: str) -> dict:
    titles = table(spark, d, "publications").select(F.col("title").alias("t"))
    journals = table(spark, d, "journals").select(F.col("journal_name").alias("t"))
    return encoding.clean_counts(titles.unionByName(journals), "t")


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    titles = encoding.garbled(table(spark, d, "publications"), "publication_id", "title", counts).withColumn("table_name", F.lit("publications"))
    journals = encoding.garbled(table(spark, d, "journals"), "journal_id", "journal_name", counts).withColumn("table_name", F.lit("journals"))
    return titles.unionByName(journals)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("table_name", "record_id").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled texts with what they were restored to and the encoding pairs."""
    return _garbled(spark, d).select("table_name", "record_id", "original", "restored", "states").distinct()


# 3: canonical lists


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    restored = encoding.garbled(table(spark, d, "journals"), "journal_id", "journal_name", _counts(spark, d))
    fixed = restored.groupBy("record_id", "original").agg(F.max("restored").alias("restored"))
    loaded = F.max(F.struct("loaded_at", "v")).getField("v")
    names_of = table(spark, d, "journals").where(F.trim("journal_name") != "").withColumn("v", F.col("journal_name")).groupBy("journal_id").agg(loaded.alias("v"))
    names_of = names_of.join(fixed, (names_of.journal_id == fixed.record_id) & (names_of.v == fixed.original), "left").select("journal_id", F.coalesce("restored", "v").alias("v"))
    jobs = table(spark, d, "researchers").where(F.trim("job_title") != "").withColumn("v", F.col("job_title")).groupBy("researcher_id").agg(loaded.alias("v"))
    j = canonical.canonical(names_of, "journal_id", "v", table(spark, d, "journal_reference"), "ref_id", "journal_title")
    r = canonical.canonical(jobs, "researcher_id", "v", table(spark, d, "job_title_reference"), "ref_id", "job_title", canonical.JOB_ALIASES, strict=False)
    return j.withColumn("table_name", F.lit("journals")).unionByName(r.withColumn("table_name", F.lit("researchers")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("table_name", "record_id", "ref_id")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no entry of their list, with the number of keys."""
    return _mapped(spark, d).where("ref_id = 0").groupBy("table_name", "value").agg(F.count(F.lit(1)).alias("n_keys"))


# 4: survivors


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = materialized(survivors.read_deliveries(table(spark, d, "publications"), table(spark, d, "source_trust"), _counts(spark, d)))
    got = survivors.survivors(rows)
    return got.select("group_id", "field_name", F.col("id").alias("publication_id"))


# 6: look-alike characters


def _ungarbled_titles(spark: SparkSession, d: str) -> DataFrame:
    return encoding.ungarbled(table(spark, d, "publications"), "publication_id", "title", _counts(spark, d))


def _alike(spark: SparkSession, d: str) -> DataFrame:
    titles = lookalike.lookalikes(_ungarbled_titles(spark, d), "record_id", "original").withColumn("table_name", F.lit("publications"))
    people = lookalike.lookalikes(table(spark, d, "researchers").select("researcher_id", "name").distinct(), "researcher_id", "name")
    return titles.unionByName(people.withColumn("table_name", F.lit("researchers")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _alike(spark, d).select("table_name", "record_id").distinct()


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """The affected texts with their consistent form."""
    return _alike(spark, d).select("table_name", "record_id", "original", "form").distinct()


# 8: containers


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers.pack_all(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "container_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return containers.fill_report(p8_containers(spark, d))


# 9: leakage


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked run with its place in the document's text."""
    return _leaks(spark, d).distinct()


# 10: reading level


def _levels(spark: SparkSession, d: str, operator=reading.reading_levels) -> DataFrame:
    docs = table(spark, d, "documents")
    fitted = reading.train(docs, "doc_id", "text", table(spark, d, "reading_labels"), "doc_id", "band")
    return operator(docs, "doc_id", "text", fitted)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "band")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words and mean surprisal of each band."""
    return _levels(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("words").alias("words"), F.round(F.avg("surprisal"), 4).alias("surprisal"))


def p10_left_out(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a level by the reason why."""
    return _levels(spark, d, reading.judged).where("left_out is not null").groupBy("left_out").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_people, p2_found, p2_restored, p3_found, p3_unmatched, p4_found, p6_found, p6_forms, p8_containers, p8_fill, p9_found, p9_spans, p10_found, p10_profile, p10_left_out)
}
