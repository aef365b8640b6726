"""Rollups, counts, coverage and rankings over the star schema and the publication tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import dedup, rollup
from sheaf.plans.registry import Registry
from sheaf.session import table

R = Registry()

_ROLL = """
WITH c AS (SELECT c_custkey, n_name AS group_name, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey),
who AS (SELECT group_name, segment, grouping(segment) AS g, count(DISTINCT c_custkey) AS entity_count FROM c GROUP BY GROUPING SETS ((group_name), (group_name, segment))),
i AS (SELECT group_name, segment, o_totalprice, o_orderpriority FROM orders JOIN c ON o_custkey = c_custkey),
what AS (SELECT group_name, segment, grouping(segment) AS g, count(*) AS item_count,
  count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS ranked_count, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS top_tier_count,
  ((2 * sum(CAST(round(o_totalprice * 100) AS BIGINT)) + count(*)) // (2 * count(*))) / 100 AS avg_metric FROM i GROUP BY GROUPING SETS ((group_name), (group_name, segment)))
SELECT who.group_name, who.segment, CASE WHEN who.g = 1 THEN 'overall' ELSE 'segment' END AS level, entity_count, coalesce(item_count, 0) AS item_count,
  coalesce(ranked_count, 0) AS ranked_count, coalesce(top_tier_count, 0) AS top_tier_count, avg_metric, round(coalesce(item_count, 0) / nullif(entity_count, 0), 6) AS items_per_entity,
  row_number() OVER (PARTITION BY who.g, CASE WHEN who.g = 1 THEN '' ELSE who.segment END ORDER BY avg_metric DESC NULLS LAST, who.group_name) AS rank_no
FROM who LEFT JOIN what ON who.group_name = what.group_name AND who.segment IS NOT DISTINCT FROM what.segment AND who.g = what.g
"""


@R.query("group_rollup", _ROLL)
def group_rollup(spark, d):
    """Groups ranked by a metric, overall and per segment."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("group_name"), F.col("c_mktsegment").alias("segment"))
    items = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderpriority").join(c, F.col("o_custkey") == F.col("c_custkey"))
    metrics = {
        "ranked_count": F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")),
        "top_tier_count": F.count_if(F.col("o_orderpriority") == "1-URGENT"),
        "avg_metric": F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / F.count(F.lit(1)), 2).cast("double"),
    }
    got = rollup.two_grain_rollup(c, items, "group_name", "segment", "c_custkey", metrics)
    got = got.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("ranked_count", "top_tier_count")}).withColumn("items_per_entity", F.round("items_per_entity", 6))
    return dedup.ranked(got, ["level", "segment"], [F.col("avg_metric").desc_nulls_last(), F.col("group_name")])


_LIVE = "r AS (SELECT researcher_id, min(university) AS university, min(field_of_research) AS field FROM researchers WHERE deleted_at IS NULL GROUP BY researcher_id)"


def _live(spark, d):
    return table(spark, d, "researchers").where("deleted_at is null").groupBy("researcher_id").agg(F.min("university").alias("university"), F.min("field_of_research").alias("field"))


@R.query(
    "university_rollup",
    f"""WITH {_LIVE},
    j AS (SELECT journal_id, max(impact_factor) AS jif, max(impact_factor_5yr) AS jif5 FROM journals GROUP BY journal_id),
    who AS (SELECT university, field, grouping(field) AS g, count(DISTINCT researcher_id) AS entity_count FROM r GROUP BY GROUPING SETS ((university), (university, field))),
    what AS (SELECT university, field, grouping(field) AS g, count(*) AS item_count, count(nullif(trim(quality_rank), '')) AS ranked, count(*) FILTER (WHERE quality_rank IN ('A*', 'A')) AS top_tier,
      round(avg(jif), 6) AS mean_jif, round(avg(jif5), 6) AS mean_jif5 FROM publications JOIN r USING (researcher_id) LEFT JOIN j USING (journal_id) GROUP BY GROUPING SETS ((university), (university, field)))
    SELECT who.university, who.field, CASE WHEN who.g = 1 THEN 'overall' ELSE 'segment' END AS level, entity_count, coalesce(item_count, 0) AS item_count, coalesce(ranked, 0) AS ranked, coalesce(top_tier, 0) AS top_tier,
      mean_jif, mean_jif5, round(coalesce(item_count, 0) / nullif(entity_count, 0), 6) AS items_per_entity
    FROM who LEFT JOIN what ON who.university IS NOT DISTINCT FROM what.university AND who.field IS NOT DISTINCT FROM what.field AND who.g = what.g""",
)
def university_rollup(spark, d):
    """A03 over researchers, publications and journals: means leave out missing metrics."""
    who = _live(spark, d)
    j = table(spark, d, "journals").groupBy("journal_id").agg(F.max("impact_factor").alias("jif"), F.max("impact_factor_5yr").alias("jif5"))
    items = table(spark, d, "publications").select("researcher_id", "journal_id", "quality_rank").join(who, "researcher_id").join(j, "journal_id", "left")
    got = rollup.two_grain_rollup(
        who, items, "university", "field", "researcher_id",
        {"ranked": F.count(F.nullif(F.trim("quality_rank"), F.lit(""))), "top_tier": F.count_if(F.col("quality_rank").isin("A*", "A")), "mean_jif": F.round(F.avg("jif"), 6), "mean_jif5": F.round(F.avg("jif5"), 6)},
    )
    return got.withColumns({"ranked": F.coalesce("ranked", F.lit(0)), "top_tier": F.coalesce("top_tier", F.lit(0)), "items_per_entity": F.round("items_per_entity", 6)})


@R.query(
    "entity_profile_counts",
    f"""WITH {_LIVE} SELECT r.researcher_id, count(p.publication_id) AS total, count(nullif(trim(p.quality_rank), '')) AS ranked, count(*) FILTER (WHERE p.quality_rank = 'A*') AS a_star,
    count(*) FILTER (WHERE p.quality_rank = 'A') AS a, count(*) FILTER (WHERE p.quality_rank = 'B') AS b, count(*) FILTER (WHERE p.quality_rank = 'C') AS c,
    count(p.publication_id) - count(nullif(trim(p.quality_rank), '')) AS unranked FROM r LEFT JOIN publications p ON r.researcher_id = p.researcher_id GROUP BY r.researcher_id""",
)
def entity_profile_counts(spark, d):
    """Counts by rank for every entity, zeros kept."""
    p = table(spark, d, "publications").groupBy("researcher_id").agg(
        F.count("publication_id").alias("total"), F.count(F.nullif(F.trim("quality_rank"), F.lit(""))).alias("ranked"),
        *[F.count_if(F.col("quality_rank") == k).alias(n) for k, n in (("A*", "a_star"), ("A", "a"), ("B", "b"), ("C", "c"))],
    )
    got = _live(spark, d).select("researcher_id").join(p, "researcher_id", "left").na.fill(0)
    return got.withColumn("unranked", F.col("total") - F.col("ranked"))


@R.query("harvest_summary", f"WITH {_LIVE} SELECT university, lower(trim(source)) AS source_name, count(*) AS record_count, max(year) AS latest_year FROM publications JOIN r USING (researcher_id) GROUP BY university, lower(trim(source))")
def harvest_summary(spark, d):
    """Records and latest year per group and source."""
    got = table(spark, d, "publications").select("researcher_id", "source", "year").join(_live(spark, d), "researcher_id")
    return got.groupBy("university", F.lower(F.trim("source")).alias("source_name")).agg(F.count(F.lit(1)).alias("record_count"), F.max("year").alias("latest_year"))


@R.query(
    "group_majority",
    """WITH v AS (SELECT journal_id, quality_rank, count(*) AS votes, min(publication_id) AS f FROM publications WHERE quality_rank IS NOT NULL GROUP BY journal_id, quality_rank)
    SELECT journal_id, quality_rank, votes FROM (SELECT *, row_number() OVER (PARTITION BY journal_id ORDER BY votes DESC, f) AS n FROM v) WHERE n = 1""",
)
def group_majority(spark, d):
    """Commonest value per group, of equals the first seen."""
    return rollup.majority(table(spark, d, "publications"), ["journal_id"], "quality_rank", "publication_id")


@R.query("longest_value", "SELECT researcher_id, year, (array_agg(title ORDER BY length(title) DESC, publication_id))[1] AS title FROM publications WHERE title IS NOT NULL GROUP BY researcher_id, year")
def longest_value(spark, d):
    """The longest value of each group, of equals the first."""
    p = table(spark, d, "publications").where("title is not null")
    return p.groupBy("researcher_id", "year").agg(F.max_by("title", F.struct(F.length("title"), -F.col("publication_id"))).alias("title"))


@R.query(
    "dimension_build",
    """SELECT lower(trim(journal_name)) AS name_key, arg_min(journal_name, journal_id) FILTER (WHERE journal_name IS NOT NULL) AS journal_name, arg_min(publisher, journal_id) FILTER (WHERE publisher IS NOT NULL) AS publisher,
    arg_min(sjr, journal_id) FILTER (WHERE sjr IS NOT NULL) AS sjr, count(*) AS n_keys FROM (SELECT journal_id, any_value(journal_name) AS journal_name, any_value(publisher) AS publisher, any_value(sjr) AS sjr FROM journals GROUP BY journal_id)
    WHERE trim(journal_name) <> '' GROUP BY lower(trim(journal_name))""",
)
def dimension_build(spark, d):
    """A dimension with the first filled value of each column."""
    j = table(spark, d, "journals").groupBy("journal_id").agg(*[F.any_value(c, True).alias(c) for c in ("journal_name", "publisher", "sjr")]).where(F.trim("journal_name") != "")
    j = j.withColumn("name_key", F.lower(F.trim("journal_name")))
    got = rollup.first_filled_row(j, ["name_key"], ["journal_name", "publisher", "sjr"], "journal_id")
    return got.join(j.groupBy("name_key").agg(F.count(F.lit(1)).alias("n_keys")), "name_key")


@R.query(
    "topn_per_group",
    """WITH n AS (SELECT researcher_id, journal_id, count(*) AS n_papers FROM publications WHERE journal_id IS NOT NULL GROUP BY researcher_id, journal_id)
    SELECT researcher_id, journal_id, n_papers, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY researcher_id ORDER BY n_papers DESC, journal_id) AS rank_no FROM n) WHERE rank_no <= 3""",
)
def topn_per_group(spark, d):
    """The three commonest journals of each researcher."""
    n = table(spark, d, "publications").where("journal_id is not null").groupBy("researcher_id", "journal_id").agg(F.count(F.lit(1)).alias("n_papers"))
    return rollup.top_per_group(n, ["researcher_id"], [F.col("n_papers").desc(), F.col("journal_id")], 3)


_COVER = ["journal_id", "year", "author_count", "authors", "doi", "quality_rank", "sjr_quartile", "citation_percentile", "cited_by_count", "fwci", "oa_status", "source"]


@R.query(
    "coverage_report",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(nullif(trim(CAST({c} AS VARCHAR)), '')) AS filled, count(*) AS total, round(count(nullif(trim(CAST({c} AS VARCHAR)), '')) / count(*), 6) AS share FROM publications" for c in _COVER),
)
def coverage_report(spark, d):
    """Filled share of each column in one pass."""
    return rollup.coverage(table(spark, d, "publications"), _COVER)


@R.query("conflict_sets", "SELECT lower(trim(doi)) AS doi_key, count(DISTINCT title) AS n_values FROM publications WHERE doi LIKE '10.%/%' GROUP BY lower(trim(doi)) HAVING count(DISTINCT title) >= 2")
def conflict_sets(spark, d):
    """Keys with several values."""
    p = table(spark, d, "publications").where(F.col("doi").like("10.%/%")).withColumn("doi_key", F.lower(F.trim("doi")))
    return rollup.conflicts(p, ["doi_key"], "title")


@R.query("duplicate_having", "SELECT researcher_id, title, year, journal_id, count(*) AS n_rows FROM publications GROUP BY researcher_id, title, year, journal_id HAVING count(*) > 1")
def duplicate_having(spark, d):
    """Rows alike in all key columns."""
    return rollup.repeated(table(spark, d, "publications"), ["researcher_id", "title", "year", "journal_id"])


@R.query(
    "outcome_counts",
    """SELECT outcome, n_rows, round(n_rows / sum(n_rows) OVER (), 6) AS share FROM (SELECT CASE WHEN doi LIKE '%10.%/%' THEN 'doi' WHEN doi IS NULL THEN 'none' ELSE 'unusable' END AS outcome, count(*) AS n_rows FROM publications GROUP BY 1)""",
)
def outcome_counts(spark, d):
    """Counts per outcome with their share."""
    label = F.when(F.col("doi").like("%10.%/%"), "doi").when(F.col("doi").isNull(), "none").otherwise("unusable")
    n = table(spark, d, "publications").groupBy(label.alias("outcome")).agg(F.count(F.lit(1)).alias("n_rows"))
    total = n.agg(F.sum("n_rows").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("outcome", "n_rows", F.round(F.col("n_rows") / F.col("_t"), 6).alias("share"))


@R.query("bucket_sums", "SELECT CASE WHEN publication_status IN ('published') THEN 'final' WHEN publication_status IS NULL THEN 'unknown' ELSE 'open' END AS bucket, sum(cited_by_count) AS cited, count(*) AS n_rows FROM publications GROUP BY 1")
def bucket_sums(spark, d):
    """Sums into buckets by a mapped label."""
    label = F.when(F.col("publication_status") == "published", "final").when(F.col("publication_status").isNull(), "unknown").otherwise("open")
    return table(spark, d, "publications").groupBy(label.alias("bucket")).agg(F.sum("cited_by_count").alias("cited"), F.count(F.lit(1)).alias("n_rows"))


@R.query(
    "quantile_bands",
    """SELECT CAST(least(floor(l_quantity / 10), 4) AS INT) AS band, min(l_extendedprice) AS lowest, round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, max(l_extendedprice) AS highest, count(*) AS n_rows
    FROM lineitem GROUP BY 1""",
)
def quantile_bands(spark, d):
    """Order statistics per band."""
    band = F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("band")
    return table(spark, d, "lineitem").groupBy(band).agg(
        F.min("l_extendedprice").alias("lowest"), F.round(F.median("l_extendedprice"), 4).alias("middle"), F.round(F.percentile("l_extendedprice", F.lit(0.9)), 4).alias("p90"), F.max("l_extendedprice").alias("highest"), F.count(F.lit(1)).alias("n_rows")
    )


@R.query("multiplicity_histogram", "SELECT times, count(*) AS n_keys FROM (SELECT doi, count(*) AS times FROM publications WHERE doi IS NOT NULL GROUP BY doi) GROUP BY times")
def multiplicity_histogram(spark, d):
    """How many keys occur how often."""
    return rollup.multiplicity(table(spark, d, "publications"), "doi")


@R.query("distinct_counts", "SELECT count(DISTINCT researcher_id) AS researchers, count(DISTINCT journal_id) AS journals, count(DISTINCT year) AS years, count(DISTINCT source) AS sources FROM publications")
def distinct_counts(spark, d):
    """A12, A24."""
    return table(spark, d, "publications").agg(*[F.count_distinct(c).alias(n) for c, n in (("researcher_id", "researchers"), ("journal_id", "journals"), ("year", "years"), ("source", "sources"))])


@R.query("option_list", "SELECT job, row_number() OVER (ORDER BY job) AS place FROM (SELECT DISTINCT lower(trim(job_title)) AS job FROM researchers WHERE trim(job_title) <> '')")
def option_list(spark, d):
    """Distinct options in order; the place is counted by ranges, not in one task."""
    jobs = table(spark, d, "researchers").where(F.trim("job_title") != "").select(F.lower(F.trim("job_title")).alias("job")).distinct()
    return rollup.global_rank(jobs, "job", "place")


@R.query(
    "prefer_affiliation",
    """SELECT * EXCLUDE (n) FROM (SELECT orcid, researcher_id, university, job_title, row_number() OVER (PARTITION BY orcid ORDER BY (job_title IS NOT NULL) DESC, (source_id IS NOT NULL) DESC, loaded_at, researcher_id, coalesce(university, '')) AS n
    FROM (SELECT DISTINCT orcid, researcher_id, university, job_title, source_id, loaded_at FROM researchers WHERE orcid IS NOT NULL)) WHERE n = 1""",
)
def prefer_affiliation(spark, d):
    """The preferred row of each person by a tuple of booleans, then the earliest."""
    r = table(spark, d, "researchers").where("orcid is not null").select("orcid", "researcher_id", "university", "job_title", "source_id", "loaded_at").distinct()
    order = [F.col("job_title").isNull(), F.col("source_id").isNull(), F.col("loaded_at"), F.col("researcher_id"), F.coalesce("university", F.lit(""))]
    return dedup.first_rows(r, ["orcid"], order).select("orcid", "researcher_id", "university", "job_title")


@R.query(
    "custom_rank_sort_page",
    """SELECT publication_id, quality_rank, place FROM (SELECT publication_id, quality_rank, row_number() OVER (ORDER BY CASE quality_rank WHEN 'A*' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 END NULLS LAST, cited_by_count DESC NULLS LAST, publication_id) AS place
    FROM publications) WHERE place > 100 AND place <= 150""",
)
def custom_rank_sort_page(spark, d):
    """A page of rows in a custom order, missing ones last; offset and limit push the order into a top-k."""
    rank = F.when(F.col("quality_rank") == "A*", 0).when(F.col("quality_rank") == "A", 1).when(F.col("quality_rank") == "B", 2).when(F.col("quality_rank") == "C", 3)
    order = [rank.asc_nulls_last(), F.col("cited_by_count").desc_nulls_last(), F.col("publication_id")]
    page = table(spark, d, "publications").orderBy(*order).limit(150)
    return dedup.ranked(page, [F.lit(1)], order, "place").where("place > 100").select("publication_id", "quality_rank", "place")


@R.query("severity_order", "SELECT oa_status, n_rows, row_number() OVER (ORDER BY CASE oa_status WHEN 'gold' THEN 0 WHEN 'green' THEN 1 WHEN 'hybrid' THEN 2 ELSE 9 END, oa_status NULLS LAST) AS place FROM (SELECT oa_status, count(*) AS n_rows FROM publications GROUP BY oa_status)")
def severity_order(spark, d):
    """A fixed order, unknown last."""
    n = table(spark, d, "publications").groupBy("oa_status").agg(F.count(F.lit(1)).alias("n_rows"))
    place = F.when(F.col("oa_status") == "gold", 0).when(F.col("oa_status") == "green", 1).when(F.col("oa_status") == "hybrid", 2).otherwise(9)
    return dedup.ranked(n, [F.lit(1)], [place, F.col("oa_status").asc_nulls_last()], "place")


@R.query("deterministic_sample", "SELECT publication_id, title FROM publications ORDER BY md5(publication_id || '|42'), publication_id LIMIT 200")
def deterministic_sample(spark, d):
    """A seeded sample of n rows; the hash order makes it the same on every layout."""
    return table(spark, d, "publications").select("publication_id", "title").orderBy(F.md5(F.concat_ws("|", "publication_id", F.lit("42"))), "publication_id").limit(200)


@R.query(
    "runner_up",
    """WITH n AS (SELECT journal_id, source, count(*) AS score FROM publications WHERE source IS NOT NULL AND journal_id IS NOT NULL GROUP BY journal_id, source),
    r AS (SELECT *, row_number() OVER (PARTITION BY journal_id ORDER BY score DESC, source) AS n, lead(score) OVER (PARTITION BY journal_id ORDER BY score DESC, source) AS next FROM n)
    SELECT journal_id, source, score, coalesce(next, 0) AS runner_up, score > coalesce(next, 0) AS clear FROM r WHERE n = 1""",
)
def runner_up(spark, d):
    """The best by score with whether it stands clear of the second; by two maxima, without a window."""
    n = table(spark, d, "publications").where("source is not null and journal_id is not null").groupBy("journal_id", "source").agg(F.count(F.lit(1)).alias("score"))
    best = n.groupBy("journal_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "source")).alias("b"))
    first = best.select("journal_id", F.col("b.source").alias("source"), (-F.col("b.s")).alias("score"))
    rest = n.join(first.select("journal_id", "source"), ["journal_id", "source"], "left_anti").groupBy("journal_id").agg(F.max("score").alias("runner_up"))
    got = first.join(rest, "journal_id", "left").withColumn("runner_up", F.coalesce("runner_up", F.lit(0)))
    return got.withColumn("clear", F.col("score") > F.col("runner_up"))
