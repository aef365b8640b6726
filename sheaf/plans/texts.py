"""Text, identifier, title, author and payload functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import identifiers, people, similarity, text
from sheaf.plans.registry import Registry
from sheaf.session import table

R = Registry()


@R.query(
    "text_keys",
    r"""SELECT publication_id, trim(regexp_replace(lower(title), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS title_key, regexp_replace(trim(regexp_replace(lower(title), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), '^(the|a|an) ', '') AS article_key,
    regexp_replace(lower(title), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS bare_key, replace(trim(regexp_replace(lower(title), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ', '-') AS slug FROM publications""",
)
def text_keys(spark, d):
    """comparison keys."""
    p = table(spark, d, "publications")
    return p.select("publication_id", text.title_key("title").alias("title_key"), text.article_key("title").alias("article_key"), text.bare_key("title").alias("bare_key"), text.slug("title").alias("slug"))


@R.query("null_clean", "SELECT publication_id, CASE WHEN lower(trim(doi)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE trim(doi) END AS doi, CASE WHEN lower(trim(source)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE trim(source) END AS source FROM publications")
def null_clean(spark, d):
    """Blank cells and their stand-ins as null."""
    return table(spark, d, "publications").select("publication_id", text.null_clean("doi").alias("doi"), text.null_clean("source").alias("source"))


@R.query("clean_html_text")
def clean_html_text(spark, d):
    """Entities, tags, forms and exactly reversible repairs."""
    p = table(spark, d, "publications").select("publication_id", "title")
    return p.select("publication_id", text.clean_html("title").alias("clean"), text.normal_form("title").alias("nfkc"), text.without_accents("title").alias("plain"), text.reversible_repair("title").alias("repaired"))


@R.query(
    "tidy_names",
    r"""SELECT DISTINCT journal_id, journal_name AS old_name, CASE WHEN lower(trim(journal_name)) IN ('ssrn', 'ssrn electronic journal', 'repec', 'arxiv', 'arxiv.org', 'zenodo', 'figshare', 'research square')
    OR regexp_matches(lower(trim(journal_name)), 'working paper|discussion paper|unpublished') THEN NULL ELSE trim(journal_name) END AS venue FROM journals WHERE journal_name IS NOT NULL""",
)
def tidy_names(spark, d):
    """repository venues as null."""
    j = table(spark, d, "journals").where("journal_name is not null")
    return j.select("journal_id", F.col("journal_name").alias("old_name"), text.drop_repository("journal_name").alias("venue")).distinct()


_SMALL = ", ".join(f"'{w}'" for w in text.SMALL_WORDS)


@R.query(
    "title_case",
    rf"""SELECT DISTINCT journal_id, array_to_string(list_transform(list_filter(regexp_split_to_array(trim(replace(journal_name, '&', 'and'), ' '), ' +'), lambda w: w <> ''), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({_SMALL}) THEN lower(w)
      WHEN length(w) <= 4 AND regexp_matches(w, '^[A-Z]{{2,}}$') AND lower(w) NOT IN ({_SMALL}) THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS tidy,
    letters <> '' AND (letters = upper(letters) OR letters = lower(letters)) AS one_case,
    CASE WHEN len(regexp_split_to_array(trim(journal_name, ' '), ' +')) < 4 THEN journal_name WHEN regexp_matches(journal_name, '[a-z][0-9]$') THEN substr(journal_name, 1, length(journal_name) - 1) ELSE regexp_replace(journal_name, '[*†‡]+\s*$', '') END AS no_mark
    FROM (SELECT *, regexp_replace(journal_name, '[^\p{{L}}]', '', 'g') AS letters FROM journals) WHERE journal_name IS NOT NULL""",
)
def title_case(spark, d):
    """tidied names, single case, footnote marks."""
    j = table(spark, d, "journals").where("journal_name is not null").select("journal_id", "journal_name").distinct()
    return j.select("journal_id", text.tidy_title("journal_name").alias("tidy"), text.single_case("journal_name").alias("one_case"), text.strip_footnote("journal_name").alias("no_mark"))


_DOI = r"""nullif(regexp_replace(regexp_replace(regexp_extract(replace(lower(trim(doi)), '%2f', '/'), '(10\.[0-9]{4,9}/[^ ?#]+)', 1), '(/(pdf|full|abstract|epdf)|\.html?)$', ''), '[.,;)]+$', ''), '')"""


@R.query("identifier_normalise", f"SELECT publication_id, CASE WHEN regexp_matches({_DOI}, '^10\\.[0-9]{{4,9}}/.+') THEN {_DOI} END AS doi, CASE WHEN {_DOI} NOT LIKE '10.99200/%' AND regexp_matches({_DOI}, '^10\\.[0-9]{{4,9}}/.+') THEN {_DOI} END AS dedup_doi FROM publications")
def identifier_normalise(spark, d):
    """DOIs in one form; a repository's prefix counts as none for deduplication."""
    return table(spark, d, "publications").select("publication_id", identifiers.doi("doi").alias("doi"), identifiers.dedup_doi("doi", "10.99200/").alias("dedup_doi"))


@R.query(
    "issn_cells",
    """SELECT journal_id, list_sort(list_distinct(list_transform(regexp_extract_all(upper(issn), '[0-9]{4}-?[0-9]{3}[0-9X]'), lambda x: substr(x, 1, 4) || '-' || substr(x, -4, 4)))) AS issns FROM (SELECT DISTINCT journal_id, issn FROM journals WHERE issn IS NOT NULL)""",
)
def issn_cells(spark, d):
    """ISSNs of a cell."""
    j = table(spark, d, "journals").where("issn is not null").select("journal_id", "issn").distinct()
    return j.select("journal_id", F.array_sort(identifiers.issns("issn")).alias("issns"))


@R.query(
    "type_vocab_map",
    """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel|copper') THEN 'metal' WHEN regexp_matches(lower(p_type), 'tin|nickel') THEN 'light metal' WHEN regexp_matches(lower(p_type), 'brass') THEN 'alloy' ELSE 'other' END AS kind,
    CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS size_class FROM part""",
)
def type_vocab_map(spark, d):
    """an ordered mapping onto a vocabulary."""
    low = F.lower("p_type")
    kind = F.when(low.rlike("steel|copper"), "metal").when(low.rlike("tin|nickel"), "light metal").when(low.rlike("brass"), "alloy").otherwise("other")
    size = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large")
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), size.alias("size_class"))


_LADDER = " ".join(f"WHEN regexp_matches(lower(job_title), '{p}') THEN {{{i}}}" for i, (p, _, _) in enumerate(people.RANK_LADDER))


def _case(at: int) -> str:
    values = [repr(s[at]) if s[at] else "NULL" for s in people.RANK_LADDER]
    return "CASE " + _LADDER.format(*values) + " END"


@R.query("title_ladder", f"SELECT DISTINCT researcher_id, job_title, {_case(1)} AS rank_name, {_case(2)} AS level_code FROM researchers WHERE job_title IS NOT NULL")
def title_ladder(spark, d):
    """The first rank whose pattern fits, and its level."""
    r = table(spark, d, "researchers").where("job_title is not null").select("researcher_id", "job_title").distinct()
    return r.withColumn("rank_name", people.rank_of("job_title")).withColumn("level_code", people.level_of("job_title"))


@R.query("name_parts")
def name_parts(spark, d):
    """Honorifics, roles and name keys."""
    r = table(spark, d, "researchers").where("name is not null").select("researcher_id", "name", "job_title").distinct()
    return r.select("researcher_id", people.honorific("name").alias("prefix"), people.without_honorific("name").alias("bare"), people.name_key("name").alias("name_key"), people.surname("name").alias("surname"), people.roles_of("job_title").alias("roles"))


@R.query(
    "author_counts",
    """SELECT publication_id, CASE WHEN contains(authors, ';') THEN len(list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^et al')))
    WHEN NOT contains(authors, ',') AND NOT regexp_matches(lower(authors), ' and | & |\\||/|\\n') AND trim(authors) <> '' THEN 1 END AS n_names FROM publications""",
)
def author_counts(spark, d):
    """Names of semicolon lists; null where the separator is in doubt."""
    return table(spark, d, "publications").select("publication_id", people.author_count("authors").cast("bigint").alias("n_names"))


@R.query("author_forms")
def author_forms(spark, d):
    """given name first, fullness and co-author surnames."""
    p = table(spark, d, "publications").where("authors is not null")
    return p.select("publication_id", people.given_first("authors").alias("given_first"), people.fullness("authors").alias("fullness"), people.coauthor_surnames("authors").alias("surnames"))


@R.query("similarity_scores")
def similarity_scores(spark, d):
    """Scores of the titles that share a DOI within one researcher, next ones only."""
    from pyspark.sql import Window as W

    p = table(spark, d, "publications").where("doi is not null and title is not null")
    p = p.groupBy("researcher_id", "doi", "title").agg(F.min("publication_id").alias("id"))
    before = W.partitionBy("researcher_id", "doi").orderBy("id")
    got = p.select("id", "title", F.lag("title").over(before).alias("prior")).where("prior is not null")
    return got.select("id", F.round(similarity.sequence_ratio("title", "prior"), 6).alias("ratio"), F.round(similarity.title_containment("title", "prior"), 6).alias("containment"), text.prefix_of(text.title_key("prior"), text.title_key("title")).alias("longer"), (text.part_marker("title") == text.part_marker("prior")).alias("same_part"))


@R.query(
    "loose_numbers",
    "SELECT journal_id, CAST(trunc(TRY_CAST(trim(scimago_year) AS DOUBLE)) AS INT) AS year, TRY_CAST(replace(CAST(sjr AS VARCHAR), ',', '.') AS DOUBLE) AS sjr FROM (SELECT DISTINCT journal_id, scimago_year, sjr FROM journals)",
)
def loose_numbers(spark, d):
    """numbers from text, null where there is none."""
    j = table(spark, d, "journals").select("journal_id", "scimago_year", "sjr").distinct()
    return j.select("journal_id", identifiers.loose_int("scimago_year").alias("year"), identifiers.decimal_comma(F.col("sjr").cast("string")).alias("sjr"))


@R.query("array_ops", "SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS statuses, len(list_distinct(list(o_orderpriority))) AS n_priorities FROM orders GROUP BY o_custkey")
def array_ops(spark, d):
    """Distinct values in order; the sets are bounded by their vocabularies."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"), F.size(F.collect_set("o_orderpriority")).cast("bigint").alias("n_priorities"))


@R.query("first_wins_map", "SELECT user_id, event_type, arg_min(props, event_id) AS props FROM events GROUP BY user_id, event_type")
def first_wins_map(spark, d):
    """the first entry of each map key."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("props", "event_id").alias("props"))


@R.query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    """A path of a JSON payload with a fixed schema."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@R.query("json_ragged", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def json_ragged(spark, d):
    """Ragged payloads as VARIANT; a path that isn't there is null."""
    e = table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "int").alias("k"), F.try_variant_get("v", "$.missing.deep", "string").alias("missing"))


@R.query("stable_ids", "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS stable_id, replace(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS slug FROM customer")
def stable_ids(spark, d):
    """ids that depend on the value alone."""
    return table(spark, d, "customer").select("c_custkey", text.stable_id("c_name").alias("stable_id"), text.slug("c_name").alias("slug"))


@R.query("csv_safe", "SELECT publication_id, CASE WHEN regexp_matches(title, '^[=+\\-@\t\r]') THEN '''' || title ELSE title END AS title, CASE WHEN regexp_matches(lower(trim(link)), '^https?://') THEN trim(link) END AS link FROM publications")
def csv_safe(spark, d):
    """Values that spreadsheets and browsers take as text."""
    return table(spark, d, "publications").select("publication_id", text.csv_safe("title").alias("title"), text.safe_url("link").alias("link"))


@R.query("url_parts", "SELECT DISTINCT researcher_id, list_extract(string_split(regexp_replace(regexp_replace(profile_url, '[?#].*$', ''), '/+$', ''), '/'), -1) AS url_id FROM researchers WHERE profile_url IS NOT NULL")
def url_parts(spark, d):
    """ids from links."""
    return table(spark, d, "researchers").where("profile_url is not null").select("researcher_id", identifiers.url_id("profile_url").alias("url_id")).distinct()


@R.query("budget", "SELECT source, count(*) AS calls, round(count(*) * CAST(0.0001 AS DOUBLE), 6) AS cost FROM publications WHERE source IS NOT NULL GROUP BY source")
def budget(spark, d):
    """Calls times unit price."""
    return table(spark, d, "publications").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("calls")).withColumn("cost", F.round(F.col("calls") * 0.0001, 6))


@R.query("star_flatten", "SELECT l_orderkey, l_linenumber, c_name, n_name, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey")
def star_flatten(spark, d):
    """Keys with their context columns."""
    t = lambda n: table(spark, d, n)
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = t("orders").select("o_orderkey", "o_custkey")
    c = t("customer").select("c_custkey", "c_name", "c_nationkey").join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    got = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return got.select("l_orderkey", "l_linenumber", "c_name", "n_name", "p_brand")
