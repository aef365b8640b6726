"""Deduplication, harmonising, screens, guards and validation over the publication tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import dedup, rollup
from sheaf.plans.registry import Registry
from sheaf.session import table

R = Registry()

_K = r"trim(regexp_replace(lower(title), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))"
_SOURCE = r"lower(trim(regexp_replace(source, '[\s_\-]+', ' ', 'g')))"


@R.query(
    "exact_dedup_doi_first",
    f"""WITH p AS (SELECT publication_id, researcher_id, {_K} AS k, doi FROM publications WHERE title IS NOT NULL),
    h AS (SELECT min(publication_id) AS publication_id, researcher_id, k FROM p WHERE doi IS NOT NULL GROUP BY researcher_id, k, doi)
    SELECT publication_id FROM h UNION ALL SELECT min(publication_id) FROM p WHERE doi IS NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.researcher_id = p.researcher_id AND h.k = p.k) GROUP BY researcher_id, k""",
)
def exact_dedup_doi_first(spark, d):
    """Every different DOI of a title once; rows without one only where the title has none."""
    p = table(spark, d, "publications").where("title is not null").select("publication_id", "researcher_id", text.title_key("title").alias("k"), "doi")
    return dedup.doi_first(p, ["researcher_id", "k"], "doi", "publication_id").select("publication_id")


@R.query("exact_rows_rule", f"SELECT min(publication_id) AS publication_id, count(*) AS n_rows FROM publications WHERE length({_K}) >= 20 AND len(string_split({_K}, ' ')) >= 3 GROUP BY researcher_id, {_K}, year, journal_id")
def exact_rows_rule(spark, d):
    """Long titles alike in year and journal."""
    k = text.title_key("title")
    p = table(spark, d, "publications").where((F.length(k) >= 20) & (F.size(F.split(k, " ")) >= 3))
    return p.groupBy("researcher_id", k.alias("k"), "year", "journal_id").agg(F.min("publication_id").alias("publication_id"), F.count(F.lit(1)).alias("n_rows")).select("publication_id", "n_rows")


@R.query("first_per_key", "SELECT min(publication_id) AS publication_id FROM publications WHERE doi IS NOT NULL GROUP BY researcher_id, doi")
def first_per_key(spark, d):
    """One row per person and DOI, the first."""
    p = table(spark, d, "publications").where("doi is not null").select("publication_id", "researcher_id", "doi")
    return dedup.first_rows(p, ["researcher_id", "doi"], [F.col("publication_id")]).select("publication_id")


@R.query(
    "fill_from_twins",
    """SELECT researcher_id, doi, min(publication_id) AS publication_id, arg_min(year, publication_id) FILTER (WHERE year IS NOT NULL) AS year, arg_min(oa_status, publication_id) FILTER (WHERE oa_status IS NOT NULL) AS oa_status,
    arg_min(quality_rank, publication_id) FILTER (WHERE quality_rank IS NOT NULL) AS quality_rank FROM publications WHERE doi IS NOT NULL GROUP BY researcher_id, doi""",
)
def fill_from_twins(spark, d):
    """The first row of each key with its blanks filled from its twins."""
    p = table(spark, d, "publications").where("doi is not null").select("publication_id", "researcher_id", "doi", "year", "oa_status", "quality_rank")
    return dedup.fill_from_twins(p, ["researcher_id", "doi"], "publication_id", ["year", "oa_status", "quality_rank"])


@R.query(
    "merge_dedup_first_source",
    f"""SELECT publication_id FROM (SELECT publication_id, row_number() OVER (PARTITION BY researcher_id, coalesce(doi, {_K} || '|' || coalesce(CAST(year AS VARCHAR), '')) ORDER BY coalesce(trust_rank, 99), publication_id) AS n
    FROM publications LEFT JOIN source_trust USING (source) WHERE title IS NOT NULL) WHERE n = 1""",
)
def merge_dedup_first_source(spark, d):
    """One row per person and DOI, else title and year, from the first source."""
    p = table(spark, d, "publications").where("title is not null").join(table(spark, d, "source_trust"), "source", "left")
    key = F.coalesce("doi", F.concat_ws("|", text.title_key("title"), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    p = p.select("publication_id", "researcher_id", key.alias("k"), F.coalesce("trust_rank", F.lit(99)).alias("t"))
    return dedup.first_rows(p, ["researcher_id", "k"], [F.col("t"), F.col("publication_id")]).select("publication_id")


@R.query("last_wins_dedup", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def last_wins_dedup(spark, d):
    """A later relation overwrites."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return dedup.last_rows(e, ["user_id", "event_type"], [F.col("event_id")])


@R.query("dimension_first_wins", "SELECT researcher_id, min(loaded_at) AS loaded_at FROM researchers GROUP BY researcher_id")
def dimension_first_wins(spark, d):
    """The first delivery of each key."""
    return table(spark, d, "researchers").groupBy("researcher_id").agg(F.min("loaded_at").alias("loaded_at"))


@R.query("neardup_pairs")
def neardup_pairs(spark, d):
    """Nearly equal titles of one researcher."""
    return dedup.near_pairs(table(spark, d, "publications"), "publication_id", "researcher_id", "title", "year", "doi")


@R.query("neardup_cluster")
def neardup_cluster(spark, d):
    """Greedy clusters with their representatives, one row per title that has a near one."""
    return dedup.representatives(neardup_pairs(spark, d))


@R.query(
    "harmonise_group",
    """WITH p AS (SELECT * FROM publications WHERE doi IS NOT NULL), y AS (SELECT doi, arg_min(year, (-n, f)) AS year FROM (SELECT doi, year, count(*) AS n, min(publication_id) AS f FROM p WHERE year IS NOT NULL GROUP BY doi, year) GROUP BY doi),
    t AS (SELECT doi, (array_agg(title ORDER BY length(title) DESC, publication_id))[1] AS title, count(*) AS n_rows FROM p WHERE title IS NOT NULL GROUP BY doi) SELECT t.doi, t.title, y.year, t.n_rows FROM t LEFT JOIN y ON t.doi = y.doi""",
)
def harmonise_group(spark, d):
    """Rows of one DOI get the longest title and the commonest year."""
    p = table(spark, d, "publications").where("doi is not null")
    years = rollup.majority(p, ["doi"], "year", "publication_id").select("doi", "year")
    titles = p.where("title is not null").groupBy("doi").agg(F.max_by("title", F.struct(F.length("title"), -F.col("publication_id"))).alias("title"), F.count(F.lit(1)).alias("n_rows"))
    return titles.join(years, "doi", "left").select("doi", "title", "year", "n_rows")


@R.query(
    "outlier_screen",
    """SELECT *, coalesce(judged >= 5 AND share < 0.25, false) AS flagged FROM (SELECT researcher_id, count(*) AS n_items, count(*) FILTER (WHERE journal_id IS NOT NULL) AS judged, count(*) FILTER (WHERE journal_id IS NOT NULL AND quality_rank IS NOT NULL) AS rated,
    round(count(*) FILTER (WHERE journal_id IS NOT NULL AND quality_rank IS NOT NULL) / nullif(count(*) FILTER (WHERE journal_id IS NOT NULL), 0), 6) AS share FROM publications GROUP BY researcher_id)""",
)
def outlier_screen(spark, d):
    """Owners whose judged items are too seldom rated."""
    return dedup.outlier_screen(table(spark, d, "publications"), "researcher_id", F.col("journal_id").isNotNull(), F.col("quality_rank").isNotNull())


@R.query(
    "screened_items",
    """WITH s AS (SELECT researcher_id FROM publications GROUP BY researcher_id HAVING count(journal_id) >= 5 AND count(*) FILTER (WHERE journal_id IS NOT NULL AND quality_rank IS NOT NULL) / count(journal_id) < 0.25)
    SELECT publication_id, source FROM (SELECT publication_id, researcher_id, """ + _SOURCE + """ AS source FROM publications) WHERE NOT (source IN ('open index', 'discovery feed') AND researcher_id IN (SELECT researcher_id FROM s)) OR source IS NULL""",
)
def screened_items(spark, d):
    """Retrieved rows of flagged owners go, listed ones stay."""
    p = table(spark, d, "publications")
    flagged = outlier_screen(spark, d).where("flagged").select("researcher_id", F.lit(True).alias("bad"))
    got = p.select("publication_id", "researcher_id", text.source_name("source").alias("source")).join(flagged, "researcher_id", "left")
    return got.where("bad is null or source is null or source not in ('open index', 'discovery feed')").select("publication_id", "source")


@R.query(
    "small_group_guard",
    """SELECT researcher_id, listed, found FROM (SELECT researcher_id, count(*) FILTER (WHERE """ + _SOURCE + """ = 'staff profile') AS listed, count(*) FILTER (WHERE """ + _SOURCE + """ <> 'staff profile') AS found FROM publications GROUP BY researcher_id)
    WHERE found <= greatest(3 * listed, 20) AND NOT (listed = 0 AND found > 50)""",
)
def small_group_guard(spark, d):
    """Owners whose found items are in proportion to their listed ones."""
    source = text.source_name("source")
    n = table(spark, d, "publications").groupBy("researcher_id").agg(F.count_if(source == "staff profile").alias("listed"), F.count_if(source != "staff profile").alias("found"))
    return n.where((F.col("found") <= F.greatest(3 * F.col("listed"), F.lit(20))) & ~((F.col("listed") == 0) & (F.col("found") > 50)))


@R.query("title_exclusion", "SELECT publication_id FROM publications WHERE title IS NOT NULL AND NOT regexp_matches(lower(trim(title)), '^(erratum|corrigendum|correction|editorial|rejoinder|comment on|book review)\\b')")
def title_exclusion(spark, d):
    """Titles that name no paper go."""
    return table(spark, d, "publications").where(F.col("title").isNotNull() & ~text.excluded_title("title")).select("publication_id")


@R.query(
    "cascade_drop",
    f"""WITH p AS (SELECT publication_id, researcher_id, doi, {_K} AS k, publication_status FROM publications WHERE title IS NOT NULL), x AS (SELECT DISTINCT researcher_id, k FROM p WHERE publication_status = 'working_paper')
    SELECT publication_id FROM p WHERE publication_status IS DISTINCT FROM 'working_paper' AND NOT (doi IS NULL AND EXISTS (SELECT 1 FROM x WHERE x.researcher_id = p.researcher_id AND x.k = p.k))""",
)
def cascade_drop(spark, d):
    """Dropped rows take their copies without a DOI with them."""
    p = table(spark, d, "publications").where("title is not null").select("publication_id", "researcher_id", "doi", text.title_key("title").alias("k"), "publication_status")
    gone = p.where("publication_status = 'working_paper'").select("researcher_id", "k").distinct()
    kept = p.where("publication_status is null or publication_status <> 'working_paper'")
    return kept.where("doi is not null").unionByName(kept.where("doi is null").join(gone, ["researcher_id", "k"], "left_anti").select(*kept.columns)).select("publication_id")


@R.query(
    "group_pattern_guard",
    "SELECT researcher_id, count(*) FILTER (WHERE regexp_matches(lower(title), 'audit|account|ledger|credit')) AS n_hits FROM publications GROUP BY researcher_id HAVING count(*) <= 40 OR count(*) FILTER (WHERE regexp_matches(lower(title), 'audit|account|ledger|credit')) >= 3",
)
def group_pattern_guard(spark, d):
    """Large groups must have three rows that fit a pattern."""
    n = table(spark, d, "publications").groupBy("researcher_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("title").rlike("audit|account|ledger|credit")).alias("n_hits"))
    return n.where("n <= 40 or n_hits >= 3").select("researcher_id", "n_hits")


@R.query("silent_owners", "SELECT DISTINCT researcher_id FROM researchers WHERE researcher_id NOT IN (SELECT researcher_id FROM publications WHERE researcher_id IS NOT NULL)")
def silent_owners(spark, d):
    """Owners without items."""
    return table(spark, d, "researchers").select("researcher_id").distinct().join(table(spark, d, "publications").select("researcher_id"), "researcher_id", "left_anti")


#: check -> (severity, condition that a bad row fulfils) on publications
CHECKS = {
    "year": ("FAIL", "year is not null and (year < 1950 or year > 2027)"),
    "doi": ("FAIL", "doi is not null and not doi rlike '^10[.][0-9]{4,9}/.+$'"),
    "rank": ("FAIL", "quality_rank is not null and quality_rank not in ('A*', 'A', 'B', 'C')"),
    "quartile": ("FAIL", "sjr_quartile is not null and sjr_quartile not in ('Q1', 'Q2', 'Q3', 'Q4')"),
    "percentile": ("FAIL", "citation_percentile is not null and (citation_percentile < 0 or citation_percentile > 1)"),
    "citations": ("FAIL", "cited_by_count is not null and cited_by_count < 0"),
    "title": ("FAIL", "title is null or trim(title) = ''"),
    "markup": ("FAIL", "title is not null and title rlike '<[A-Za-z/][^>]*>'"),
    "author_count": ("WARN", "author_count is not null and author_count < 1"),
    "rank_without_journal": ("FAIL", "quality_rank is not null and journal_id is null"),
    "status": ("FAIL", "publication_status is not null and publication_status not in ('published', 'forthcoming', 'working_paper')"),
}
_SQL = {k: v[1].replace("not doi rlike '^10[.][0-9]{4,9}/.+$'", "not regexp_matches(doi, '^10[.][0-9]{4,9}/.+$')").replace("title rlike '<[A-Za-z/][^>]*>'", "regexp_matches(title, '<[A-Za-z/][^>]*>')") for k, v in CHECKS.items()}


def findings(df: DataFrame, row_id: str, checks: dict[str, tuple[str, str]], examples: int = 5) -> DataFrame:
    """(severity, check, n_rows, examples): all checks in one pass; examples are the smallest ids, kept by a bounded minimum."""
    hits = F.array_compact(F.array(*[F.when(F.expr(cond), F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("check"))) for name, (sev, cond) in checks.items()]))
    rows = df.select(F.col(row_id).alias("id"), F.explode(hits).alias("h")).select("id", "h.severity", "h.check")
    n = rows.groupBy("severity", "check").agg(F.count(F.lit(1)).alias("n_rows"))
    top = rollup.top_per_group(rows, ["check"], [F.col("id")], examples).groupBy("check").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return n.join(top, "check").select("severity", "check", "n_rows", "examples")


@R.query(
    "findings_union",
    " UNION ALL ".join(f"SELECT '{CHECKS[k][0]}' AS severity, '{k}' AS \"check\", count(*) AS n_rows, list_slice(list(publication_id ORDER BY publication_id), 1, 5) AS examples FROM publications WHERE {c} HAVING count(*) > 0" for k, c in _SQL.items()),
)
def findings_union(spark, d):
    """Findings with examples."""
    return findings(table(spark, d, "publications"), "publication_id", CHECKS)


@R.query(
    "year_conflicts",
    f"SELECT researcher_id, {_K} AS k, count(DISTINCT year) AS n_values FROM publications WHERE title IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT year) >= 2",
)
def year_conflicts(spark, d):
    """One title, two years."""
    p = table(spark, d, "publications").where("title is not null").withColumn("k", text.title_key("title"))
    return rollup.conflicts(p, ["researcher_id", "k"], "year")


@R.query("contract_problems", "SELECT 'missing researcher' AS problem, count(*) AS n_rows FROM publications WHERE researcher_id IS NULL OR researcher_id NOT IN (SELECT researcher_id FROM researchers) UNION ALL SELECT 'missing title', count(*) FROM publications WHERE title IS NULL OR trim(title) = ''")
def contract_problems(spark, d):
    """Problems of the record contract."""
    p = table(spark, d, "publications")
    known = table(spark, d, "researchers").select("researcher_id").distinct()
    a = p.join(known, "researcher_id", "left_anti").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("missing researcher").alias("problem"), "n_rows")
    b = p.where("title is null or trim(title) = ''").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("missing title").alias("problem"), "n_rows")
    return reduce(DataFrame.unionByName, [a, b])
