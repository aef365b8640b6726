"""The whole run: clean, exclude, enrich, rate, screen, deduplicate, harmonise, build dimensions and the harvest.

Every step takes and gives DataFrames, destructive ones also their audit rows (kept, dropped with reason).
Rows carry `publication_id` as their order, so first-wins rules are the same on every layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import identifiers, text
from sheaf.operators import dedup, joins, rollup
from sheaf.plans.registry import Registry
from sheaf.session import materialized, table

R = Registry()


def clean(pubs: DataFrame) -> DataFrame:
    """Null-cleaned text, comparison keys, normal DOIs (the raw one kept) and plausible years."""
    return pubs.select(
        "publication_id", "researcher_id", "journal_id", text.null_clean("title").alias("title"), text.title_key("title").alias("title_key"),
        F.col("doi").alias("doi_raw"), identifiers.doi("doi").alias("doi"), identifiers.plausible_year("year").alias("year"), text.null_clean("authors").alias("authors"),
        text.null_clean("quality_rank").alias("quality_rank"), "sjr_quartile", "cited_by_count", "fwci", text.null_clean("oa_status").alias("oa_status"), "publication_status", F.lower(F.trim("source")).alias("source"), "loaded_at",
    )


def drop_notices(pubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with reason): rows without a title, and notices that are no papers."""
    reason = F.when(F.col("title").isNull(), "no title").when(text.excluded_title("title"), "notice").when(text.is_correction_notice("title"), "correction")
    marked = pubs.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("publication_id", "reason")


def rate(pubs: DataFrame, journals: DataFrame, reference: DataFrame) -> DataFrame:
    """Rating by the first known ISSN, else by the journal's title key; a missing rank is filled, match_method says how."""
    j = journals.groupBy("journal_id").agg(F.min("journal_name").alias("journal_name"), F.min("issn").alias("issn"), F.max("impact_factor").alias("impact_factor"))
    keys = F.explode(F.array_compact(F.array("issn", "issn_online"))).alias("i")
    by_issn = reference.select("rating", keys).groupBy("i").agg(F.min("rating").alias("rating"))
    hit = joins.first_hit(j.withColumn("keys", identifiers.issns("issn")), "journal_id", "keys", by_issn, "i", "rating")
    by_title = reference.groupBy(text.journal_key("journal_title").alias("jk")).agg(F.min("rating").alias("rating"))
    rated = joins.cascading(j.withColumn("jk", text.journal_key("journal_name")), "journal_id", [("issn", hit, "journal_id", "rating"), ("title", by_title, "jk", "rating")], "rating")
    out = pubs.join(rated.select("journal_id", "journal_name", "impact_factor", "rating", "match_method"), "journal_id", "left")
    return out.withColumn("quality_rank", F.coalesce("quality_rank", "rating")).drop("rating")


def screen(pubs: DataFrame, retrieved: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): retrieved rows of owners whose judged rows are too seldom rated."""
    flagged = dedup.outlier_screen(pubs, "researcher_id", F.col("journal_id").isNotNull(), F.col("quality_rank").isNotNull()).where("flagged").select("researcher_id", F.lit(True).alias("flagged"))
    marked = pubs.join(flagged, "researcher_id", "left").withColumn("gone", F.coalesce(F.col("flagged"), F.lit(False)) & F.coalesce(F.col("source").isin(*retrieved), F.lit(False)))
    return marked.where("not gone").drop("flagged", "gone"), marked.where("gone").select("publication_id", F.lit("screened").alias("reason"))


def drop_near_duplicates(pubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): nearly equal titles of one owner are one row, the representative, its blanks filled from its twins."""
    reps = materialized(dedup.representatives(dedup.near_pairs(pubs, "publication_id", "researcher_id", "title", "year", "doi", per_doi=True)))
    venue, rest = ["journal_id", "journal_name", "impact_factor", "match_method"], pubs.columns
    near = pubs.join(reps, pubs["publication_id"] == reps["id"]).drop("id").withColumn("venue", F.when(F.col("journal_id").isNotNull(), F.struct(*venue))).drop(*venue)
    fill = ["doi", "doi_raw", "year", "authors", "quality_rank", "sjr_quartile", "cited_by_count", "fwci", "oa_status", "venue"]
    filled = dedup.fill_from_twins(near, ["representative"], "publication_id", fill).select("*", "venue.*").select(*rest)
    alone = pubs.join(reps.select(F.col("id").alias("publication_id")), "publication_id", "left_anti").select(*rest)
    return alone.unionByName(filled), reps.where("id <> representative").select(F.col("id").alias("publication_id"), F.lit("near duplicate").alias("reason"))


def build(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """publications, journals, staff, harvest and audit of one run."""
    raw = clean(table(spark, d, "publications"))
    kept, notices = drop_notices(raw)
    rated = rate(kept, table(spark, d, "journals"), table(spark, d, "journal_reference"))
    screened, out = screen(rated, ["open index", "discovery feed"])
    pubs = materialized(dedup.doi_first(screened, ["researcher_id", "title_key"], "doi", "publication_id"))
    pubs, twins = drop_near_duplicates(pubs)
    pubs = materialized(pubs)
    years = rollup.majority(pubs.where("doi is not null"), ["doi"], "year", "publication_id").select("doi", F.col("year").alias("doi_year"))
    pubs = pubs.join(years, "doi", "left").withColumn("year", F.coalesce("doi_year", "year")).drop("doi_year")
    used = table(spark, d, "journals").join(pubs.select("journal_id").where("journal_id is not null"), "journal_id", "left_semi").where(F.trim("journal_name") != "")
    dims = rollup.first_filled_row(used.withColumn("name_key", text.journal_key("journal_name")), ["name_key"], ["journal_name", "publisher", "impact_factor", "sjr", "h_index"], "journal_id")
    staff = dedup.first_rows(table(spark, d, "researchers"), ["researcher_id"], [F.col("loaded_at"), F.coalesce("name", F.lit(""))]).join(pubs.select("researcher_id"), "researcher_id", "left_semi")
    university = staff.select("researcher_id", "university")
    harvest = pubs.join(university, "researcher_id").groupBy("university", "source").agg(F.count(F.lit(1)).alias("record_count"), F.max("year").alias("latest_year"))
    return {"publications": pubs, "journals": dims, "staff": staff, "harvest": harvest, "audit": notices.unionByName(out).unionByName(twins)}


@R.query("pipeline_publications")
def pipeline_publications(spark, d):
    """§3.1: the final rows of a whole run."""
    return build(spark, d)["publications"].select("publication_id", "researcher_id", "doi", "year", "quality_rank", "match_method", "source")


@R.query("pipeline_harvest")
def pipeline_harvest(spark, d):
    return build(spark, d)["harvest"]


@R.query("pipeline_audit")
def pipeline_audit(spark, d):
    """What a run dropped, by reason."""
    return build(spark, d)["audit"].groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


@R.query("document_citations")
def document_citations(spark, d):
    """Citation lines of all documents, parsed; only lines with a year and a comma are entries."""
    from sheaf.functions.citations import citations

    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = docs.where(F.col("line").rlike(r"^[^.]+, .*\((19|20)\d{2}\)")).select(F.concat_ws(":", "doc_id", "pos").alias("key"), "line")
    return citations(lines, "key", "line")
