"""Lookups, enrichment, linking, set operations and table maintenance over the publication tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import identifiers, people, text
from sheaf.operators import joins, mutation
from sheaf.plans.registry import Registry
from sheaf.session import table

R = Registry()

_ISSN = r"regexp_extract_all(upper(issn), '[0-9]{4}-?[0-9]{3}[0-9X]')"
_JKEY = r"regexp_replace(trim(regexp_replace(lower(replace({0}, '&', ' and ')), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')), '^the ', '')"
#: Publications with their source's name in one form, for the queries that take sources apart.
_PUBS = r"(SELECT * REPLACE (lower(trim(regexp_replace(source, '[\s_\-]+', ' ', 'g'))) AS source) FROM publications)"


def _sourced(spark, d):
    """Publications with their source's name in one form."""
    return table(spark, d, "publications").withColumn("source", text.source_name("source"))


def _journals(spark, d):
    """One row per journal key."""
    return table(spark, d, "journals").groupBy("journal_id").agg(F.min("journal_name").alias("journal_name"), F.min("issn").alias("issn"), F.min("quality_rank").alias("quality_rank"), F.min("publisher").alias("publisher"))


_J = "j AS (SELECT journal_id, min(journal_name) AS journal_name, min(issn) AS issn, min(quality_rank) AS quality_rank, min(publisher) AS publisher FROM journals GROUP BY journal_id)"
_REF = """ref AS (SELECT replace(issn, '-', '') AS k, rating FROM journal_reference WHERE issn IS NOT NULL UNION ALL SELECT replace(issn_online, '-', ''), rating FROM journal_reference WHERE issn_online IS NOT NULL),
ref1 AS (SELECT k, min(rating) AS rating FROM ref GROUP BY k)"""


def _ref_issn(spark, d):
    r = table(spark, d, "journal_reference")
    keys = F.explode(F.array_compact(F.array("issn", "issn_online"))).alias("i")
    return r.select("rating", keys).groupBy(F.replace("i", F.lit("-"), F.lit("")).alias("k")).agg(F.min("rating").alias("rating"))


@R.query(
    "array_first_hit_join",
    f"""WITH {_J}, {_REF}, e AS (SELECT journal_id, unnest({_ISSN}) AS i, generate_subscripts({_ISSN}, 1) AS pos FROM j WHERE issn IS NOT NULL)
    SELECT journal_id, arg_min(rating, pos) AS rating FROM e JOIN ref1 ON replace(i, '-', '') = k GROUP BY journal_id""",
)
def array_first_hit_join(spark, d):
    """The first of a cell's ISSNs that the list knows."""
    j = _journals(spark, d).where("issn is not null")
    keys = F.transform(F.regexp_extract_all(F.upper("issn"), F.lit("([0-9]{4}-?[0-9]{3}[0-9X])"), 1), lambda s: F.replace(s, F.lit("-"), F.lit("")))
    return joins.first_hit(j.withColumn("keys", keys), "journal_id", "keys", _ref_issn(spark, d), "k", "rating")


@R.query(
    "two_stage_lookup",
    f"""WITH {_J}, {_REF}, e AS (SELECT journal_id, unnest({_ISSN}) AS i, generate_subscripts({_ISSN}, 1) AS pos FROM j WHERE issn IS NOT NULL),
    h AS (SELECT journal_id, arg_min(rating, pos) AS rating FROM e JOIN ref1 ON replace(i, '-', '') = k GROUP BY journal_id),
    t AS (SELECT {_JKEY.format('journal_title')} AS jk, min(rating) AS rating FROM journal_reference GROUP BY 1)
    SELECT j.journal_id, coalesce(h.rating, t.rating) AS rating, CASE WHEN h.rating IS NOT NULL THEN 'issn' WHEN t.rating IS NOT NULL THEN 'title' END AS match_method
    FROM j LEFT JOIN h ON j.journal_id = h.journal_id LEFT JOIN t ON {_JKEY.format('j.journal_name')} = t.jk""",
)
def two_stage_lookup(spark, d):
    """By ISSN, else by title key, with the method."""
    j = _journals(spark, d)
    hit = array_first_hit_join(spark, d)
    by_title = table(spark, d, "journal_reference").groupBy(text.journal_key("journal_title").alias("jk")).agg(F.min("rating").alias("rating"))
    out = joins.cascading(j.withColumn("jk", text.journal_key("journal_name")), "journal_id", [("issn", hit, "journal_id", "rating"), ("title", by_title, "jk", "rating")], "found")
    return out.select("journal_id", F.col("found").alias("rating"), "match_method")


@R.query(
    "cascading_key_join",
    """WITH o AS (SELECT regexp_replace(upper(regexp_replace(orcid, '^.*/', '')), '[^0-9X]', '', 'g') AS k, researcher_id FROM researchers WHERE orcid IS NOT NULL),
    u AS (SELECT k, min(researcher_id) AS rid FROM o GROUP BY k HAVING min(researcher_id) = max(researcher_id)),
    s AS (SELECT source_id AS k, min(researcher_id) AS rid FROM researchers WHERE source_id IS NOT NULL GROUP BY source_id HAVING min(researcher_id) = max(researcher_id)),
    n AS (SELECT lower(name) AS k, max(researcher_id) AS rid FROM researchers WHERE name IS NOT NULL GROUP BY lower(name)),
    q AS (SELECT DISTINCT researcher_id, source_id, regexp_replace(upper(regexp_replace(orcid, '^.*/', '')), '[^0-9X]', '', 'g') AS ok, lower(name) AS nk FROM researchers)
    SELECT q.researcher_id, coalesce(s.rid, u.rid, n.rid) AS matched_id, CASE WHEN s.rid IS NOT NULL THEN 'source_id' WHEN u.rid IS NOT NULL THEN 'orcid' WHEN n.rid IS NOT NULL THEN 'name' END AS match_method
    FROM q LEFT JOIN s ON q.source_id = s.k LEFT JOIN u ON q.ok = u.k LEFT JOIN n ON q.nk = n.k""",
)
def cascading_key_join(spark, d):
    """By source id, else by an unambiguous ORCID, else by name (the last of a name wins)."""
    r = table(spark, d, "researchers")
    key = F.regexp_replace(F.upper(F.regexp_replace("orcid", "^.*/", "")), "[^0-9X]", "")
    q = r.select("researcher_id", "source_id", key.alias("ok"), F.lower("name").alias("nk")).distinct()
    by_source = joins.unambiguous(r, "source_id", "researcher_id").withColumnRenamed("researcher_id", "rid")
    by_orcid = joins.unambiguous(r.withColumn("ok", key), "ok", "researcher_id").withColumnRenamed("researcher_id", "rid")
    by_name = r.where("name is not null").groupBy(F.lower("name").alias("nk")).agg(F.max("researcher_id").alias("rid"))
    out = joins.cascading(q, "researcher_id", [("source_id", by_source, "source_id", "rid"), ("orcid", by_orcid, "ok", "rid"), ("name", by_name, "nk", "rid")], "matched_id")
    return out.select("researcher_id", "matched_id", "match_method")


@R.query("ambiguous_keys", "SELECT source_id, count(DISTINCT researcher_id) AS n_values FROM researchers WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(DISTINCT researcher_id) > 1")
def ambiguous_keys(spark, d):
    """Keys that several identities share."""
    return table(spark, d, "researchers").where("source_id is not null").groupBy("source_id").agg(F.count_distinct("researcher_id").alias("n_values")).where("n_values > 1")


@R.query(
    "fill_if_empty_join",
    f"""WITH {_J} SELECT p.publication_id, coalesce(p.quality_rank, j.quality_rank) AS quality_rank, j.publisher, j.journal_name FROM publications p LEFT JOIN j ON p.journal_id = j.journal_id""",
)
def fill_if_empty_join(spark, d):
    """Columns taken from a lookup or filled where empty."""
    p = table(spark, d, "publications").select("publication_id", "journal_id", "quality_rank")
    return joins.left_enrich(p, _journals(spark, d), ["journal_id"], fill=["quality_rank"], take=["publisher", "journal_name"]).drop("journal_id")


@R.query("name_dimension_join", f"WITH {_J} SELECT r.ref_id, count(j.journal_id) AS n_keys FROM journal_reference r LEFT JOIN j ON lower(trim(r.journal_title)) = lower(trim(j.journal_name)) GROUP BY r.ref_id")
def name_dimension_join(spark, d):
    """Dimension rows by name, case and outer blanks apart."""
    j = _journals(spark, d).select("journal_id", F.lower(F.trim("journal_name")).alias("k"))
    r = table(spark, d, "journal_reference").select("ref_id", F.lower(F.trim("journal_title")).alias("k"))
    return r.join(j, "k", "left").groupBy("ref_id").agg(F.count("journal_id").alias("n_keys"))


@R.query("entity_filter_ilike", "SELECT DISTINCT researcher_id, name, university FROM researchers WHERE name ILIKE '%ann%' AND field_of_research = 'Finance' AND deleted_at IS NULL")
def entity_filter_ilike(spark, d):
    """Optional equality filters and a case-insensitive substring; the equalities reach the scan."""
    return table(spark, d, "researchers").where("field_of_research = 'Finance' and deleted_at is null").where(F.col("name").ilike("%ann%")).select("researcher_id", "name", "university").distinct()


@R.query(
    "search_or_exists",
    "SELECT p.publication_id FROM publications p WHERE p.title ILIKE '%audit%' OR EXISTS (SELECT 1 FROM journals j WHERE j.journal_id = p.journal_id AND j.journal_name ILIKE '%audit%')",
)
def search_or_exists(spark, d):
    """The title or the journal's name contains a text."""
    named = table(spark, d, "journals").where(F.col("journal_name").ilike("%audit%")).select("journal_id", F.lit(True).alias("hit")).distinct()
    p = table(spark, d, "publications").select("publication_id", "journal_id", "title")
    return p.join(named, "journal_id", "left").where(F.coalesce("hit", F.lit(False)) | F.col("title").ilike("%audit%")).select("publication_id")


@R.query("not_null_filter", "SELECT count(*) AS n_rows, count(DISTINCT researcher_id) AS n_people FROM publications WHERE quality_rank IS NOT NULL AND lower(trim(quality_rank)) <> 'none'")
def not_null_filter(spark, d):
    """Ranked rows only; the literal 'none' counts as unranked."""
    return table(spark, d, "publications").where("quality_rank is not null and lower(trim(quality_rank)) <> 'none'").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("researcher_id").alias("n_people"))


_RULES = [("9000-0137", "rating", "A*"), ("9000-020X", "rating", None), ("9000-0277", "journal_title", "Archives of Forensic Book-keeping")]


@R.query(
    "override_apply",
    """WITH o(k, field, value) AS (VALUES ('9000-0137', 'rating', 'A*'), ('9000-020X', 'rating', NULL), ('9000-0277', 'journal_title', 'Archives of Forensic Book-keeping'))
    SELECT ref_id, issn, CASE WHEN EXISTS (SELECT 1 FROM o WHERE k = issn AND field = 'journal_title') THEN (SELECT value FROM o WHERE k = issn AND field = 'journal_title') ELSE journal_title END AS journal_title,
    CASE WHEN EXISTS (SELECT 1 FROM o WHERE k = issn AND field = 'rating') THEN (SELECT value FROM o WHERE k = issn AND field = 'rating') ELSE rating END AS rating FROM journal_reference""",
)
def override_apply(spark, d):
    """Long-form overrides; a null value sets null."""
    rules = spark.createDataFrame(_RULES, "issn string, field string, value string")
    return joins.overrides(table(spark, d, "journal_reference").select("ref_id", "issn", "journal_title", "rating"), rules, "issn", ["journal_title", "rating"])


@R.query(
    "reviewed_exclusion_anti",
    """WITH x AS (SELECT DISTINCT researcher_id, doi, title FROM publications WHERE publication_status = 'working_paper')
    SELECT publication_id FROM publications p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.researcher_id = p.researcher_id AND x.doi = p.doi) AND NOT EXISTS (SELECT 1 FROM x WHERE x.researcher_id = p.researcher_id AND x.title = p.title)""",
)
def reviewed_exclusion_anti(spark, d):
    """Rows that no reviewed exclusion names by DOI or by title; blank keys never match."""
    p = table(spark, d, "publications").select("publication_id", "researcher_id", "doi", "title", "publication_status")
    return joins.exclude(p, p.where("publication_status = 'working_paper'"), [["researcher_id", "doi"], ["researcher_id", "title"]]).select("publication_id")


@R.query(
    "add_only_missing",
    """WITH a AS (SELECT * FROM """ + _PUBS + """ WHERE source = 'institution repository'), b AS (SELECT * FROM """ + _PUBS + """ WHERE source = 'doi registry')
    SELECT publication_id FROM a UNION ALL SELECT publication_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.researcher_id = b.researcher_id AND a.doi = b.doi)
    AND NOT EXISTS (SELECT 1 FROM a WHERE a.researcher_id = b.researcher_id AND a.title = b.title AND a.year = b.year)""",
)
def add_only_missing(spark, d):
    """Only what is new to the person, by DOI or by title and year."""
    p = _sourced(spark, d).select("publication_id", "researcher_id", "doi", "title", "year", "source")
    got = joins.add_missing(p.where("source = 'institution repository'"), p.where("source = 'doi registry'"), [["researcher_id", "doi"], ["researcher_id", "title", "year"]])
    return got.select("publication_id")


@R.query(
    "best_match_join",
    """SELECT * EXCLUDE (n) FROM (SELECT a.publication_id, b.publication_id AS match_id, row_number() OVER (PARTITION BY a.publication_id ORDER BY (b.year IS NOT DISTINCT FROM a.year) DESC, b.publication_id) AS n
    FROM (SELECT * FROM """ + _PUBS + """ WHERE source = 'staff profile') a LEFT JOIN (SELECT * FROM """ + _PUBS + """ WHERE source = 'open index') b ON a.researcher_id = b.researcher_id AND lower(a.title) = lower(b.title)) WHERE n = 1""",
)
def best_match_join(spark, d):
    """Metadata of the same title, the same year preferred, else the first."""
    p = _sourced(spark, d).select("publication_id", "researcher_id", F.lower("title").alias("k"), "year", "source")
    a = p.where("source = 'staff profile'").drop("source")
    b = p.where("source = 'open index'").select("researcher_id", "k", F.col("year").alias("b_year"), F.col("publication_id").alias("match_id"))
    got = joins.best_match(a, b, ["researcher_id", "k"], "publication_id", [(~F.col("b_year").eqNullSafe(F.col("year"))), F.col("match_id")])
    return got.select("publication_id", "match_id")


@R.query(
    "merge_fill_full_outer",
    """WITH a AS (SELECT researcher_id, year, min(cited_by_count) AS cited, min(oa_status) AS oa FROM """ + _PUBS + """ WHERE source = 'institution repository' GROUP BY 1, 2),
    b AS (SELECT researcher_id, year, min(cited_by_count) AS cited, min(oa_status) AS oa FROM """ + _PUBS + """ WHERE source = 'open index' GROUP BY 1, 2)
    SELECT coalesce(a.researcher_id, b.researcher_id) AS researcher_id, coalesce(a.year, b.year) AS year, coalesce(a.cited, b.cited) AS cited, coalesce(a.oa, b.oa) AS oa,
    CASE WHEN a.researcher_id IS NULL THEN 'index' WHEN b.researcher_id IS NULL THEN 'repository' ELSE 'repository+index' END AS provenance FROM a FULL JOIN b ON a.researcher_id = b.researcher_id AND a.year = b.year""",
)
def merge_fill_full_outer(spark, d):
    """Two sources merged field by field."""
    side = lambda s: _sourced(spark, d).where(F.col("source") == s).groupBy("researcher_id", "year").agg(F.min("cited_by_count").alias("cited"), F.min("oa_status").alias("oa"))
    return joins.merge_sources(side("institution repository"), side("open index"), ["researcher_id", "year"], ["cited", "oa"], ("repository", "index"))


@R.query(
    "exactly_one_candidate",
    """WITH r AS (SELECT DISTINCT researcher_id, university, field_of_research AS f, lower(split_part(name, ' ', -1)) AS s FROM researchers WHERE name IS NOT NULL),
    p AS (SELECT a.researcher_id, b.researcher_id AS c FROM r a JOIN r b ON a.s = b.s AND a.f = b.f AND a.researcher_id <> b.researcher_id)
    SELECT researcher_id, CASE WHEN min(c) = max(c) THEN min(c) END AS candidate, CASE WHEN min(c) = max(c) THEN 'unique' ELSE 'ambiguous' END AS status FROM p GROUP BY researcher_id""",
)
def exactly_one_candidate(spark, d):
    """Candidates by an exploded key and a second attribute; only a single one counts.

    By counts and extremes of each key instead of its pairs: a key of two people gives each the other, one of more is ambiguous.
    """
    r = table(spark, d, "researchers").where("name is not null and field_of_research is not null").select("researcher_id", F.col("field_of_research").alias("f"), F.lower(F.element_at(F.split("name", " "), -1)).alias("s")).distinct()
    g = r.groupBy("f", "s").agg(F.count(F.lit(1)).alias("n"), F.min("researcher_id").alias("lo"), F.max("researcher_id").alias("hi")).where("n > 1")
    other = F.when(F.col("n") == 2, F.col("lo") + F.col("hi") - F.col("researcher_id"))
    c = r.join(g, ["f", "s"]).groupBy("researcher_id").agg(F.min(other).alias("a"), F.max(other).alias("b"), F.max("n").alias("n"))
    one = (F.col("n") == 2) & (F.col("a") == F.col("b"))
    return c.select("researcher_id", F.when(one, F.col("a")).alias("candidate"), F.when(one, "unique").otherwise("ambiguous").alias("status"))


@R.query("identifier_conflict", "SELECT a.researcher_id AS left_id, b.researcher_id AS right_id FROM (SELECT DISTINCT researcher_id, orcid, university FROM researchers) a JOIN (SELECT DISTINCT researcher_id, orcid, university FROM researchers) b ON a.orcid = b.orcid AND a.university <> b.university AND a.researcher_id < b.researcher_id")
def identifier_conflict(spark, d):
    """The same identifier with another attribute that differs: equality with a residual predicate."""
    r = table(spark, d, "researchers").where("orcid is not null").select("researcher_id", "orcid", "university").distinct()
    b = r.select("orcid", F.col("researcher_id").alias("right_id"), F.col("university").alias("u"))
    return r.join(b, "orcid").where("university <> u and researcher_id < right_id").select(F.col("researcher_id").alias("left_id"), "right_id")


def _given(spark, d):
    return table(spark, d, "researchers").where("name is not null").groupBy("researcher_id").agg(F.min("name").alias("name"))


#: Words of a name, letters of any script.
_WORDS = r"list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}]+', ' ', 'g')), ' '), lambda x: x <> '')))"


def _words(name):
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{M}]+", " "), " "), lambda w: w != "")))


@R.query(
    "subset_plus_one_name",
    f"""WITH r AS (SELECT researcher_id, {_WORDS.format("min(name)")} AS t FROM researchers WHERE name IS NOT NULL GROUP BY researcher_id),
    s AS (SELECT t, list_filter(t, lambda x: length(x) > 1) AS long, min(researcher_id) AS id, count(*) AS n FROM r WHERE len(t) >= 1 GROUP BY t),
    one AS (SELECT a.id AS short_id, b.id AS long_id, a.n AS n_short, b.n AS n_long, 'one word more' AS rule FROM s a JOIN s b ON len(b.t) = len(a.t) + 1 AND len(a.t) >= 2 AND list_has_all(b.t, a.t)),
    same AS (SELECT min(id) OVER w AS first_id, id, first_value(n) OVER (PARTITION BY long ORDER BY id) AS n_first, n FROM s WHERE len(long) >= 2 WINDOW w AS (PARTITION BY long))
    SELECT * FROM one UNION ALL SELECT first_id, id, n_first, n, 'initials apart' FROM same WHERE first_id <> id""",
)
def subset_plus_one_name(spark, d):
    """Names whose words are another's but one, and names equal but for initials, as pairs of different word sets.

    Equal word sets count once, with their smallest key and their number. A set of n words meets others by the
    n sets that lack one word of it, so equality joins find every pair, however short the words are.
    """
    r = _given(spark, d).select("researcher_id", _words("name").alias("t")).where(F.size("t") >= 1)
    s = r.groupBy("t").agg(F.min("researcher_id").alias("id"), F.count(F.lit(1)).alias("n"))
    short = s.where(F.size("t") >= 2).select("t", F.col("id").alias("short_id"), F.col("n").alias("n_short"))
    less = F.explode(F.transform("t", lambda w: F.array_remove("t", w))).alias("t")
    long = s.where(F.size("t") >= 3).select(less, F.col("id").alias("long_id"), F.col("n").alias("n_long"))
    one = short.join(long, "t").select("short_id", "long_id", "n_short", "n_long", F.lit("one word more").alias("rule"))
    bare = s.withColumn("long", F.filter("t", lambda w: F.length(w) > 1)).where(F.size("long") >= 2)
    first = bare.groupBy("long").agg(F.min("id").alias("short_id"), F.min_by("n", "id").alias("n_short"))
    same = bare.join(first, "long").where("id <> short_id").select("short_id", F.col("id").alias("long_id"), "n_short", F.col("n").alias("n_long"), F.lit("initials apart").alias("rule"))
    return one.unionByName(same)


_SLUG = r"list_filter(string_split(regexp_replace(list_extract(string_split(regexp_replace(lower({0}), '[?#].*$', ''), '/'), -1), '[^\p{{L}}\p{{M}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


@R.query(
    "words_in_slug",
    f"""WITH r AS (SELECT researcher_id, min(name) AS name FROM researchers WHERE name IS NOT NULL GROUP BY researcher_id),
    link AS (SELECT DISTINCT 'https://people.example/' || replace(lower(trim(name, ' ')), ' ', '-') AS url FROM researchers WHERE name IS NOT NULL),
    w AS (SELECT researcher_id, {_WORDS.format("name")} AS t FROM r), s AS (SELECT url, {_SLUG.format("url")} AS seg FROM link),
    hit AS (SELECT researcher_id, url, len(list_distinct(seg)) = len(t) AS exact FROM w JOIN s ON len(t) >= 2 AND list_has_all(seg, t)),
    best AS (SELECT researcher_id, bool_or(exact) AS any_exact FROM hit GROUP BY researcher_id)
    SELECT researcher_id, min(url) AS url, any_exact AS exact FROM hit JOIN best USING (researcher_id) WHERE exact OR NOT any_exact GROUP BY researcher_id, any_exact HAVING count(*) = 1""",
)
def words_in_slug(spark, d):
    """The one link of a directory whose last part holds all words of a name; links of exactly these words come first.

    Two or more equally good links are no hit. The directory is made from the names themselves. Names meet
    links by their rarest word; all other words are then compared whole.
    """
    r = _given(spark, d).select("researcher_id", _words("name").alias("t")).where(F.size("t") >= 2)
    link = table(spark, d, "researchers").where("name is not null").select(F.concat(F.lit("https://people.example/"), F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("-"))).alias("url")).distinct()
    last = F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1)
    s = link.select("url", _words(last).alias("seg"))
    by_word = s.select("url", "seg", F.explode("seg").alias("w"))
    count = by_word.groupBy("w").agg(F.count(F.lit(1)).alias("n_links"))
    rare = r.select("researcher_id", "t", F.explode("t").alias("w")).join(count, "w", "left").groupBy("researcher_id").agg(F.min(F.struct(F.coalesce("n_links", F.lit(0)).alias("n"), "w", "t")).alias("m"))
    hit = rare.select("researcher_id", F.col("m.w").alias("w"), F.col("m.t").alias("t")).join(by_word, "w").where(F.size(F.array_except("t", "seg")) == 0)
    ranked = hit.groupBy("researcher_id", (F.size("seg") == F.size("t")).alias("exact")).agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n"))
    best = ranked.groupBy("researcher_id").agg(F.max(F.struct("exact", "url", "n")).alias("b"))
    return best.where("b.n = 1").select("researcher_id", F.col("b.url").alias("url"), F.col("b.exact").alias("exact"))


@R.query(
    "unique_backfill",
    """WITH k AS (SELECT researcher_id, lower(title) AS t, min(doi) AS d, max(doi) AS d2 FROM publications WHERE doi LIKE '10.%/%' GROUP BY 1, 2)
    SELECT publication_id, d AS doi FROM publications p JOIN k ON p.researcher_id = k.researcher_id AND lower(p.title) = k.t WHERE p.doi IS NULL AND d = d2""",
)
def unique_backfill(spark, d):
    """A missing DOI from rows of the same person and title, only where there is exactly one."""
    p = table(spark, d, "publications").select("publication_id", "researcher_id", F.lower("title").alias("t"), "doi")
    k = p.where(F.col("doi").like("10.%/%")).groupBy("researcher_id", "t").agg(F.min("doi").alias("d"), F.max("doi").alias("d2")).where("d = d2").select("researcher_id", "t", "d")
    return p.where("doi is null").join(k, ["researcher_id", "t"]).select("publication_id", F.col("d").alias("doi"))


@R.query(
    "range_band_join",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS p, date_diff('day', TIMESTAMP '1970-01-01', CAST(o_orderdate AS TIMESTAMP)) AS day FROM orders)
    SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND abs(a.day - b.day) <= 14 AND a.o_orderkey < b.o_orderkey""",
)
def range_band_join(spark, d):
    """Pairs of one customer within a band of days, by buckets of the band."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    b = o.select(F.col("o_orderkey").alias("right_key"), "o_custkey", F.col("day").alias("other"))
    got = joins.band_join(o.withColumnRenamed("o_orderkey", "left_key"), b, ["o_custkey"], "day", "other", 14)
    return got.where("left_key < right_key").select("left_key", "right_key")


@R.query("label_propagation", "SELECT publication_id, coalesce(max(CAST(publication_status = 'published' AS INT)) OVER (PARTITION BY doi) = 1, false) AS published_any FROM publications WHERE doi IS NOT NULL")
def label_propagation(spark, d):
    """A label of one row to all rows of its DOI."""
    p = table(spark, d, "publications").where("doi is not null").select("publication_id", "doi", (F.col("publication_status") == "published").alias("published"))
    return joins.propagate(p, "doi", "published").select("publication_id", F.coalesce("published_any", F.lit(False)).alias("published_any"))


@R.query(
    "token_jaccard_best",
    r"""WITH t AS (SELECT ref_id, list_distinct(string_split(trim(regexp_replace(lower(journal_title), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ')) AS w FROM journal_reference),
    j AS (SELECT journal_id, list_distinct(string_split(trim(regexp_replace(lower(min(journal_name)), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ')) AS w FROM journals WHERE journal_name IS NOT NULL GROUP BY journal_id),
    p AS (SELECT journal_id, ref_id, len(list_intersect(j.w, t.w)) / len(list_distinct(list_concat(j.w, t.w))) AS s FROM j JOIN t ON len(list_intersect(list_filter(j.w, lambda x: length(x) > 3), t.w)) > 0)
    SELECT journal_id, ref_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY journal_id ORDER BY s DESC, ref_id) AS n FROM p WHERE s >= 0.6) WHERE n = 1""",
)
def token_jaccard_best(spark, d):
    """The best entry by word overlap above a threshold; pairs share a word of four letters or more."""
    words = lambda c: F.array_distinct(F.split(text.title_key(c), " "))
    t = table(spark, d, "journal_reference").select("ref_id", words("journal_title").alias("u"))
    j = table(spark, d, "journals").where("journal_name is not null").groupBy("journal_id").agg(F.min("journal_name").alias("n")).select("journal_id", words("n").alias("w"))
    inv = t.withColumn("k", F.explode("u")).where(F.length("k") > 3)
    near = j.withColumn("k", F.explode("w")).where(F.length("k") > 3).join(inv, "k").select("journal_id", "w", "ref_id", "u").distinct()
    scored = near.select("journal_id", "ref_id", text.jaccard(F.col("w"), F.col("u")).alias("s")).where("s >= 0.6")
    best = scored.groupBy("journal_id").agg(F.max(F.struct("s", (-F.col("ref_id")).alias("r"))).alias("b"))
    return best.select("journal_id", (-F.col("b.r")).alias("ref_id"), F.round("b.s", 6).alias("score"))


@R.query(
    "reference_integrity",
    """WITH u AS (SELECT DISTINCT researcher_id AS k FROM publications WHERE researcher_id IS NOT NULL), r AS (SELECT DISTINCT researcher_id AS k FROM researchers)
    SELECT 'unknown' AS side, k AS researcher_id FROM u WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT 'unused', k FROM r WHERE k NOT IN (SELECT k FROM u)""",
)
def reference_integrity(spark, d):
    """Keys unknown and keys unused."""
    return joins.anti_both(table(spark, d, "publications"), table(spark, d, "researchers"), "researcher_id")


@R.query("attribute_disagreement", f"WITH {_J} SELECT p.publication_id, p.quality_rank AS here, j.quality_rank AS there FROM publications p JOIN j ON p.journal_id = j.journal_id WHERE p.quality_rank <> j.quality_rank")
def attribute_disagreement(spark, d):
    """An attribute kept twice that differs."""
    j = _journals(spark, d).select("journal_id", F.col("quality_rank").alias("there"))
    p = table(spark, d, "publications").select("publication_id", "journal_id", F.col("quality_rank").alias("here"))
    return p.join(j, "journal_id").where("here <> there").select("publication_id", "here", "there")


@R.query(
    "count_reconciliation",
    """SELECT c.row_id, c.journal_name, c.publication_count AS expected, coalesce(n.got, 0) AS got FROM anu_journals c LEFT JOIN (SELECT j.journal_name, count(*) AS got FROM publications p
    JOIN (SELECT journal_id, min(journal_name) AS journal_name FROM journals GROUP BY journal_id) j USING (journal_id) GROUP BY j.journal_name) n ON c.journal_name = n.journal_name WHERE c.publication_count - coalesce(n.got, 0) > 2""",
)
def count_reconciliation(spark, d):
    """Claimed counts that fall short by more than the tolerance."""
    got = table(spark, d, "publications").select("journal_id").join(_journals(spark, d).select("journal_id", "journal_name"), "journal_id").groupBy("journal_name").agg(F.count(F.lit(1)).alias("got"))
    c = table(spark, d, "anu_journals").select("row_id", "journal_name", F.col("publication_count").alias("expected"))
    return c.join(got, "journal_name", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("expected - got > 2").select("row_id", "journal_name", "expected", "got")


@R.query("feed_membership", "SELECT DISTINCT p.researcher_id, p.journal_id FROM publications p JOIN (SELECT DISTINCT journal_id FROM journals) j ON p.journal_id = j.journal_id")
def feed_membership(spark, d):
    """Distinct relations that both sides know."""
    p = table(spark, d, "publications").select("researcher_id", "journal_id").distinct()
    return p.join(table(spark, d, "journals").select("journal_id").distinct(), "journal_id", "left_semi").select("researcher_id", "journal_id")


@R.query(
    "contains_join",
    """WITH k(phrase) AS (VALUES ('ledger'), ('audit'), ('credit'), ('archives of monetary')) SELECT DISTINCT journal_id, phrase FROM journals JOIN k ON contains(lower(journal_name), phrase)""",
)
def contains_join(spark, d):
    """Rows with the rule phrases they contain."""
    rules = spark.createDataFrame([(k,) for k in ("ledger", "audit", "credit", "archives of monetary")], "phrase string")
    return joins.contains_join(table(spark, d, "journals").select("journal_id", "journal_name").distinct(), "journal_name", rules, "phrase").select("journal_id", "phrase").distinct()


@R.query(
    "upsert_classify",
    """WITH cur AS (SELECT journal_title, min(rating) AS rating, min(issn) AS issn FROM journal_reference GROUP BY journal_title),
    n AS (SELECT journal_name, count(*) AS n FROM anu_journals GROUP BY journal_name)
    SELECT a.journal_name AS journal_title, a.quality_rank AS rating, a.issn, CASE WHEN a.journal_name IS NULL OR n.n > 1 OR a.quality_rank IS NULL OR trim(a.quality_rank) = '' THEN 'error' WHEN cur.journal_title IS NULL THEN 'insert'
    WHEN cur.rating IS NOT DISTINCT FROM a.quality_rank AND cur.issn IS NOT DISTINCT FROM a.issn THEN 'skip' ELSE 'update' END AS action
    FROM anu_journals a LEFT JOIN n ON a.journal_name = n.journal_name LEFT JOIN cur ON a.journal_name = cur.journal_title""",
)
def upsert_classify(spark, d):
    """Incoming rows as insert, update, skip or error (no key, a key twice, a required value missing)."""
    cur = table(spark, d, "journal_reference").groupBy("journal_title").agg(F.min("rating").alias("rating"), F.min("issn").alias("issn"))
    inc = table(spark, d, "anu_journals").select(F.col("journal_name").alias("journal_title"), F.col("quality_rank").alias("rating"), "issn")
    return mutation.classify_upsert(cur, inc, "journal_title", ["rating", "issn"], ["rating"])


@R.query(
    "cascade_update",
    f"WITH {_J} SELECT p.publication_id, CASE WHEN j.journal_id IS NOT NULL THEN j.quality_rank ELSE p.quality_rank END AS quality_rank, (CASE WHEN j.journal_id IS NOT NULL THEN j.quality_rank ELSE p.quality_rank END) IS DISTINCT FROM p.quality_rank AS changed FROM publications p LEFT JOIN j ON p.journal_id = j.journal_id",
)
def cascade_update(spark, d):
    """A parent's value copied to its children, with what changed."""
    p = table(spark, d, "publications").select("publication_id", "journal_id", "quality_rank")
    return mutation.cascade(_journals(spark, d), "journal_id", "quality_rank", p, "journal_id", "quality_rank").select("publication_id", "quality_rank", "changed")


@R.query("prune_unused", "SELECT DISTINCT journal_id FROM journals WHERE journal_id IN (SELECT journal_id FROM publications)")
def prune_unused(spark, d):
    """Parents that are still used."""
    return mutation.prune_unused(table(spark, d, "journals").select("journal_id").distinct(), "journal_id", table(spark, d, "publications"), "journal_id")


@R.query(
    "set_overlap",
    """WITH a AS (SELECT DISTINCT researcher_id, journal_id FROM """ + _PUBS + """ WHERE source = 'doi registry' AND journal_id IS NOT NULL), b AS (SELECT DISTINCT researcher_id, journal_id FROM """ + _PUBS + """ WHERE source = 'open index' AND journal_id IS NOT NULL)
    SELECT 'both' AS part, count(*) AS n_rows FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def set_overlap(spark, d):
    """Overlap and differences of two sets, counted from one full outer pass."""
    side = lambda s, n: _sourced(spark, d).where((F.col("source") == s) & F.col("journal_id").isNotNull()).select("researcher_id", "journal_id").distinct().withColumn(n, F.lit(1))
    m = side("doi registry", "a").join(side("open index", "b"), ["researcher_id", "journal_id"], "full_outer")
    n = m.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("first only"), F.count_if(F.col("a").isNull()).alias("second only"))
    return n.unpivot([], ["both", "first only", "second only"], "part", "n_rows")


@R.query("co_author_overlap")
def co_author_overlap(spark, d):
    """Pairs of papers of one researcher and year whose co-author surnames overlap, by exploded surnames."""
    p = table(spark, d, "publications").select("publication_id", "researcher_id", "year", F.explode(people.coauthor_surnames("authors")).alias("s"))
    b = p.select("researcher_id", "year", "s", F.col("publication_id").alias("other_id"))
    got = p.join(b, ["researcher_id", "year", "s"]).where("publication_id < other_id")
    return got.groupBy("publication_id", "other_id").agg(F.count(F.lit(1)).alias("n_shared"))


@R.query("withdraw_before_inception", """WITH t AS (SELECT lower(trim(journal_title)) AS k, min(year_inception) AS y FROM journal_reference GROUP BY 1), j AS (SELECT journal_id, min(journal_name) AS n FROM journals GROUP BY journal_id)
    SELECT p.publication_id, CASE WHEN p.year < t.y THEN NULL ELSE p.quality_rank END AS quality_rank FROM publications p JOIN j ON p.journal_id = j.journal_id JOIN t ON lower(trim(j.n)) = t.k""")
def withdraw_before_inception(spark, d):
    """A value withdrawn by an inequality on the joined row."""
    t = table(spark, d, "journal_reference").groupBy(F.lower(F.trim("journal_title")).alias("k")).agg(F.min("year_inception").alias("y"))
    j = _journals(spark, d).select("journal_id", F.lower(F.trim("journal_name")).alias("k")).join(t, "k")
    p = table(spark, d, "publications").select("publication_id", "journal_id", "year", "quality_rank").join(j, "journal_id")
    return p.select("publication_id", F.when(~F.coalesce(F.col("year") < F.col("y"), F.lit(False)), F.col("quality_rank")).alias("quality_rank"))


@R.query(
    "issn_orcid_checks",
    """WITH c AS (SELECT DISTINCT journal_id, regexp_extract_all(upper(issn), '[0-9]{4}-?[0-9]{3}[0-9X]') AS f FROM journals),
    i AS (SELECT DISTINCT journal_id, replace(x, '-', '') AS t FROM (SELECT journal_id, unnest(CASE WHEN f IS NULL OR len(f) = 0 THEN [NULL] ELSE f END) AS x FROM c)),
    iv AS (SELECT CASE WHEN t IS NULL THEN 'none' ELSE CAST(substr(t, 8, 1) = CASE (11 - list_sum(list_transform(range(1, 8), lambda k: (9 - k) * CAST(substr(t, CAST(k AS INT), 1) AS INT))) % 11) % 11 WHEN 10 THEN 'X'
      ELSE CAST(CAST((11 - list_sum(list_transform(range(1, 8), lambda k: (9 - k) * CAST(substr(t, CAST(k AS INT), 1) AS INT))) % 11) % 11 AS INT) AS VARCHAR) END AS VARCHAR) END AS valid FROM i),
    o AS (SELECT DISTINCT researcher_id, nullif(regexp_extract(replace(upper(orcid), '-', ''), '([0-9]{15}[0-9X])', 1), '') AS t FROM researchers),
    s AS (SELECT researcher_id, t, CAST((12 - list_sum(list_transform(range(1, 16), lambda k: CAST(substr(t, CAST(k AS INT), 1) AS BIGINT) * (1 << (16 - k)))) % 11) % 11 AS INT) AS n FROM o),
    ov AS (SELECT CASE WHEN t IS NULL THEN 'none' ELSE CAST(substr(t, 16, 1) = CASE n WHEN 10 THEN 'X' ELSE CAST(n AS VARCHAR) END AS VARCHAR) END AS valid FROM s)
    SELECT 'issn' AS kind, valid, count(*) AS n_rows FROM iv GROUP BY valid UNION ALL SELECT 'orcid', valid, count(*) FROM ov GROUP BY valid""",
)
def issn_orcid_checks(spark, d):
    """Shapes and check digits of identifiers."""
    i = table(spark, d, "journals").select("journal_id", F.explode_outer(identifiers.issns("issn")).alias("issn")).distinct()
    o = table(spark, d, "researchers").select("researcher_id", identifiers.orcid("orcid").alias("orcid")).distinct()
    a = i.groupBy(F.lit("issn").alias("kind"), F.coalesce(identifiers.issn_valid("issn").cast("string"), F.lit("none")).alias("valid")).agg(F.count(F.lit(1)).alias("n_rows"))
    return a.unionByName(o.groupBy(F.lit("orcid").alias("kind"), F.coalesce(identifiers.orcid_valid("orcid").cast("string"), F.lit("none")).alias("valid")).agg(F.count(F.lit(1)).alias("n_rows")))
