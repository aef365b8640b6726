"""Decisions with reasons, alignment to a record, rankings and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import decisions, dedup, rollup
from sheaf.plans.registry import Registry
from sheaf.session import table

R = Registry()


@R.query(
    "decision_audit",
    """SELECT action, reason, count(*) AS n_rows FROM (SELECT CASE WHEN lower(title) LIKE '%audit%' THEN 'keep' WHEN title IS NULL OR trim(title) = '' THEN 'drop' WHEN publication_status = 'working_paper' AND journal_id IS NULL THEN 'drop'
    WHEN lower(title) LIKE 'book review%' THEN 'drop' WHEN year < 1950 OR year > 2027 THEN 'review' ELSE 'keep' END AS action,
    CASE WHEN lower(title) LIKE '%audit%' THEN 'kept by rule' WHEN title IS NULL OR trim(title) = '' THEN 'no title' WHEN publication_status = 'working_paper' AND journal_id IS NULL THEN 'open and unplaced'
    WHEN lower(title) LIKE 'book review%' THEN 'notice' WHEN year < 1950 OR year > 2027 THEN 'year' ELSE 'ordinary' END AS reason FROM publications) GROUP BY action, reason""",
)
def decision_audit(spark, d):
    """Ordered rules, each row with its decision and reason."""
    c = F.col
    rules = [
        ("keep", "kept by rule", F.lower("title").like("%audit%")),
        ("drop", "no title", c("title").isNull() | (F.trim("title") == "")),
        ("drop", "open and unplaced", (c("publication_status") == "working_paper") & c("journal_id").isNull()),
        ("drop", "notice", F.lower("title").like("book review%")),
        ("review", "year", (c("year") < 1950) | (c("year") > 2027)),
    ]
    got = decisions.decide(table(spark, d, "publications"), rules, ("keep", "ordinary"))
    return got.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


_MAJ = "SELECT doi, arg_min({0}, (-n, f)) AS v FROM (SELECT doi, {0}, count(*) AS n, min(publication_id) AS f FROM publications WHERE doi IS NOT NULL AND {0} IS NOT NULL GROUP BY doi, {0}) GROUP BY doi"


@R.query(
    "align_to_record",
    f"""WITH y AS ({_MAJ.format('year')}), j AS ({_MAJ.format('journal_id')})
    SELECT publication_id, CASE WHEN p.doi IS NULL THEN 'no record' WHEN p.journal_id <> j.v THEN 'journal differs' WHEN p.year IS DISTINCT FROM y.v THEN 'year changed' ELSE 'aligned' END AS reason,
    CASE WHEN p.doi IS NOT NULL AND NOT coalesce(p.journal_id <> j.v, false) AND y.v IS NOT NULL THEN y.v ELSE p.year END AS year
    FROM publications p LEFT JOIN y ON p.doi = y.doi LEFT JOIN j ON p.doi = j.doi""",
)
def align_to_record(spark, d):
    """Rows aligned to their DOI's record, refused with a reason where the venue differs."""
    p = table(spark, d, "publications").select("publication_id", "doi", "journal_id", "year")
    have = p.where("doi is not null")
    y = rollup.majority(have, ["doi"], "year", "publication_id").select("doi", F.col("year").alias("y"))
    j = rollup.majority(have, ["doi"], "journal_id", "publication_id").select("doi", F.col("journal_id").alias("j"))
    got = p.join(y, "doi", "left").join(j, "doi", "left")
    rules = [("refuse", "no record", F.col("doi").isNull()), ("refuse", "journal differs", F.col("journal_id") != F.col("j")), ("change", "year changed", ~F.col("year").eqNullSafe(F.col("y")))]
    got = decisions.decide(got, rules, ("keep", "aligned"))
    return got.select("publication_id", "reason", F.when(F.col("action") != "refuse", F.coalesce("y", "year")).otherwise(F.col("year")).alias("year"))


@R.query(
    "rank_by_each_metric",
    """WITH g AS (SELECT university, count(DISTINCT researcher_id) AS people, count(DISTINCT orcid) AS identified, count(DISTINCT field_of_research) AS fields FROM researchers WHERE university IS NOT NULL GROUP BY university),
    l AS (SELECT university, 'people' AS metric, CAST(people AS DOUBLE) AS value FROM g UNION ALL SELECT university, 'identified', CAST(identified AS DOUBLE) FROM g UNION ALL SELECT university, 'fields', CAST(fields AS DOUBLE) FROM g)
    SELECT university, metric, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, university) AS rank_no FROM l""",
)
def rank_by_each_metric(spark, d):
    """Groups ranked by each of several metrics."""
    g = table(spark, d, "researchers").where("university is not null").groupBy("university")
    g = g.agg(F.count_distinct("researcher_id").alias("people"), F.count_distinct("orcid").alias("identified"), F.count_distinct("field_of_research").alias("fields"))
    return decisions.rank_by_each(g, "university", ["people", "identified", "fields"])


@R.query("owner_listing", "SELECT publication_id, row_number() OVER (PARTITION BY researcher_id ORDER BY year DESC NULLS LAST, title NULLS LAST, publication_id) AS place FROM publications")
def owner_listing(spark, d):
    """Each owner's items, latest first, then by title."""
    p = table(spark, d, "publications").select("publication_id", "researcher_id", "year", "title")
    return dedup.ranked(p, ["researcher_id"], [F.col("year").desc_nulls_last(), F.col("title").asc_nulls_last(), F.col("publication_id")], "place").select("publication_id", "place")


@R.query(
    "two_column_search",
    """SELECT p.publication_id FROM publications p LEFT JOIN (SELECT journal_id, min(journal_name) AS journal_name FROM journals GROUP BY journal_id) j ON p.journal_id = j.journal_id
    WHERE (contains(lower(p.title), 'credit') OR contains(lower(j.journal_name), 'credit')) AND p.quality_rank IS NOT NULL AND lower(p.quality_rank) <> 'none'""",
)
def two_column_search(spark, d):
    """A text in one of two columns and a rank."""
    j = table(spark, d, "journals").groupBy("journal_id").agg(F.min("journal_name").alias("journal_name"))
    p = table(spark, d, "publications").where("quality_rank is not null and lower(quality_rank) <> 'none'").select("publication_id", "journal_id", "title").join(j, "journal_id", "left")
    return p.where(F.lower("title").contains("credit") | F.lower("journal_name").contains("credit")).select("publication_id")


@R.query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events)
    SELECT user_id, count(*) AS n_events, sum(fresh) AS n_sessions FROM g GROUP BY user_id""",
)
def event_sessions(spark, d):
    """§2.11 analogue: sessions by a gap of half an hour, as the batch twin of the streaming mode."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    gap = at - F.lag(at).over(w)
    e = table(spark, d, "events").select("user_id", F.when(gap <= 1800, 0).otherwise(1).alias("fresh"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("fresh").alias("n_sessions"))
