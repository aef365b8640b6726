"""Sources and sinks as queries: stored pages, feeds, responses and files made from the tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import dedup
from sheaf.plans.registry import Registry
from sheaf.session import ensure_checkpoint_dir, table
from sheaf.sources import readers, sinks

R = Registry()


def _folder(spark, kind: str) -> str:
    """A fresh folder in the application's part of the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


_CELL = "CASE WHEN lower(trim({0})) IN ('', 'nan', 'none', 'null') THEN NULL WHEN regexp_matches({0}, '^[=+\\-@\t\r]') THEN '''' || trim({0}) ELSE trim({0}) END"


@R.query("csv_round_trip", f"SELECT DISTINCT CAST(journal_id AS VARCHAR) AS journal_id, {_CELL.format('journal_name')} AS journal_name, {_CELL.format('publisher')} AS publisher, {_CELL.format('issn')} AS issn, CAST(h_index AS VARCHAR) AS h_index FROM journals")
def csv_round_trip(spark, d):
    """A table written as CSV and read again as clean text, whole numbers without '.0'."""
    path = _folder(spark, "csv")
    j = table(spark, d, "journals").select("journal_id", "journal_name", "publisher", "issn", F.col("h_index").cast("double").alias("h_index"))
    sinks.write_tables({"journals": j}, path, "all")
    return readers.read_csv(spark, f"{path}/all_journals_csv").distinct()


@R.query("json_round_trip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def json_round_trip(spark, d):
    """A table written as JSON rows and read again."""
    path = _folder(spark, "json")
    sinks.write_tables({"nation": table(spark, d, "nation")}, path, "all")
    return readers.read_json_rows(spark, f"{path}/all_nation_json", "n_nationkey bigint, n_name string", lines=True)


@R.query("partitioned_scan", "SELECT 'r' || n_regionkey AS partition, count(*) AS n_rows, min(n_name) AS first_name FROM nation GROUP BY n_regionkey")
def partitioned_scan(spark, d):
    """Files of one kind in a folder per partition, the folder's name as key."""
    root = _folder(spark, "parts")
    n = table(spark, d, "nation")
    for (key,) in table(spark, d, "region").select("r_regionkey").distinct().collect():  # a handful of regions
        one = sinks.flat_text(n.where(F.col("n_regionkey") == key).select("n_nationkey", "n_name"))
        one.write.options(header=True, escape='"').csv(f"{root}/r{key}/all_nation.csv")
    got = readers.read_partitioned(spark, root, "nation")
    return got.groupBy("partition").agg(F.count(F.lit(1)).alias("n_rows"), F.min("n_name").alias("first_name"))


@R.query(
    "offset_header",
    "SELECT CAST(n_nationkey AS VARCHAR) AS \"Key\", n_name AS \"Name\" FROM nation",
)
def offset_header(spark, d):
    """A sheet whose header stands below a note; unnamed columns go."""
    body = table(spark, d, "nation").select((F.col("n_nationkey") + 2).cast("int").alias("row_no"), F.col("n_nationkey").cast("string").alias("c0"), F.lit("x").alias("c1"), F.col("n_name").alias("c2"))
    top = spark.createDataFrame([(0, "a note", None, None), (1, " Key ", "Unnamed: 1", "Name")], "row_no int, c0 string, c1 string, c2 string")
    return readers.with_offset_header(top.unionByName(body), 1)


_PART = "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name, p_brand, p_type FROM part"


@R.query(
    "page_extract",
    f"""WITH p AS ({_PART})
    SELECT key, 1 AS pos, 'meta' AS kind, 'brand' AS name, p_brand AS value, '' AS extra FROM p UNION ALL SELECT key, 2, 'heading', 'h2', 'Facts', '' FROM p
    UNION ALL SELECT key, 3, 'property', 'Type & kind', p_type, 'Facts' FROM p UNION ALL SELECT key, 4, 'heading', 'h2', 'Works', '' FROM p
    UNION ALL SELECT key, 5, 'link', p_name, '/p/' || key, 'Works' FROM p UNION ALL SELECT key, 6, 'item', 'Works', p_name || ' < 2', '/p/' || key FROM p UNION ALL SELECT key, 7, 'card', 'Works', p_name, '/p/' || key FROM p""",
)
def page_extract(spark, d):
    """Meta tags, headings, properties, links, items with their section and cards of stored pages."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), *[text.html_escape(c).alias(c) for c in ("p_name", "p_brand", "p_type")])
    page = F.concat(
        F.lit('<html><head><meta name="brand" content="'), "p_brand", F.lit('"></head><body><h2>Facts</h2><dl><dt>Type &amp; kind</dt><dd>'), "p_type", F.lit('</dd></dl><h2>Works</h2><ul><li><a href="/p/'), "key", F.lit('">'), "p_name",
        F.lit('</a> &lt; 2</li></ul><div class="wide card"><br>'), "p_name", F.lit("</div></body></html>"),
    )
    return readers.html_parts(p.select("key", page.alias("page")), "key", "page")


@R.query("feed_items", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS title, '/p/' || p_partkey AS link, 'size ' || p_size AS pub_date FROM part")
def feed_items(spark, d):
    """Items of stored feeds."""
    p = table(spark, d, "part")
    xml = F.concat(F.lit("<rss><channel><title>all</title><item><title>"), text.html_escape("p_name"), F.lit("</title><link>/p/"), "p_partkey", F.lit("</link><pubDate>size "), "p_size", F.lit("</pubDate></item></channel></rss>"))
    return readers.rss_items(p.select(F.col("p_partkey").cast("string").alias("key"), xml.alias("xml")), "key", "xml")


@R.query("bibtex_fields", "SELECT p_partkey, p_name AS title, p_brand AS publisher, CAST(NULL AS VARCHAR) AS year FROM part")
def bibtex_fields(spark, d):
    """Fields of BibTeX entries, in braces or quotes; missing ones are null."""
    entry = F.concat(F.lit("@misc{k,\n  title = {{"), "p_name", F.lit('}},\n  publisher = "'), "p_brand", F.lit('"\n}'))
    p = table(spark, d, "part").withColumn("entry", entry)
    return p.select("p_partkey", *[readers.bibtex_field("entry", f).alias(f) for f in ("title", "publisher", "year")])


@R.query("stored_pages", "SELECT n_regionkey AS page_no, count(*) OVER () AS total, CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 0 AS missing FROM nation")
def stored_pages(spark, d):
    """Items of result pages of any paging style, with what is missing against the named total."""
    n = table(spark, d, "nation")
    total = n.agg(F.count(F.lit(1)).alias("total"))
    one = n.groupBy(F.col("n_regionkey").alias("page_no")).agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("items")).join(total)
    items = readers.pages(one.select("page_no", F.to_json(F.struct("total", "items")).alias("body")), "body", "id:bigint,name:string")
    gaps = readers.page_gaps(items).select(F.col("missing").cast("int").alias("missing"))
    return items.select("page_no", "total", "id", "name").join(gaps)


@R.query(
    "batched_lookup",
    """WITH k AS (SELECT doi, bool_or(oa_status IS NOT NULL) AS answered FROM publications WHERE doi IS NOT NULL GROUP BY doi)
    SELECT count(*) AS n_keys, count(*) FILTER (WHERE NOT answered) AS unanswered, 0 AS oversized FROM k""",
)
def batched_lookup(spark, d):
    """Keys in batches of 25 at most, and how many have no answer."""
    p = table(spark, d, "publications").where("doi is not null")
    asked = readers.batches(p, "doi", 25)
    size = asked.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))
    missing = readers.incomplete_batches(asked, p.where("oa_status is not null"), "doi").groupBy("batch_no").agg(F.sum("n_missing").alias("n_missing"))
    return size.join(missing, "batch_no", "left").agg(F.sum("n").alias("n_keys"), F.coalesce(F.sum("n_missing"), F.lit(0)).alias("unanswered"), F.count_if(F.col("n") > 25).cast("int").alias("oversized"))


_KEYED = "SELECT substr(sha256(concat_ws('?', article_url, doi)), 1, 16) AS key, loaded_at, title FROM publications WHERE article_url IS NOT NULL"


@R.query("response_cache", f"WITH k AS ({_KEYED}), m AS (SELECT *, max(loaded_at) OVER (PARTITION BY key) AS last FROM k) SELECT key, last AS fetched_at, max(title) AS body FROM m WHERE loaded_at = last GROUP BY key, last")
def response_cache(spark, d):
    """The newest stored response of each request, under a key made of its address and parameters."""
    p = table(spark, d, "publications").where("article_url is not null and loaded_at is not null")
    got = p.select(readers.request_key("article_url", "doi").alias("key"), F.col("loaded_at").alias("fetched_at"), F.col("title").alias("body"))
    return readers.upsert_cache(got.where("1 = 0"), got)


@R.query("cache_stats", f"SELECT count(*) AS n_responses, round(sum(length(title)) / 1e6, 6) AS megabytes FROM ({_KEYED})")
def cache_stats(spark, d):
    """How many responses are stored, and their size."""
    p = table(spark, d, "publications").where("article_url is not null")
    return readers.cache_stats(p.select(readers.request_key("article_url", "doi").alias("key"), F.col("title").alias("body")))


@R.query("latest_metric", "SELECT journal_id, arg_max(v, jcr_year) AS impact_factor FROM (SELECT journal_id, jcr_year, max(impact_factor) AS v FROM journals WHERE jcr_year IS NOT NULL GROUP BY 1, 2) WHERE v IS NOT NULL GROUP BY journal_id")
def latest_metric(spark, d):
    """Of a ragged array of yearly values the latest one there is."""
    j = table(spark, d, "journals").where("jcr_year is not null").groupBy("journal_id", "jcr_year").agg(F.max("impact_factor").alias("v"))
    j = j.groupBy("journal_id").agg(F.collect_list(F.struct(F.col("jcr_year").alias("y"), "v")).alias("a"))  # one entry a year
    return j.select("journal_id", readers.latest_value(F.col("a"), "y", "v").alias("impact_factor")).where("impact_factor is not null")


@R.query("first_name_of_key", "SELECT issn, arg_min(journal_name, journal_id) AS name FROM journals WHERE issn IS NOT NULL AND journal_name IS NOT NULL GROUP BY issn")
def first_name_of_key(spark, d):
    """Distinct keys of many rows, the first name of each."""
    j = table(spark, d, "journals").where("issn is not null and journal_name is not null").select("issn", F.col("journal_name").alias("name"), "journal_id")
    return dedup.first_rows(j, ["issn"], [F.col("journal_id")]).select("issn", "name")


@R.query("publish_swap", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 0")
def publish_swap(spark, d):
    """A new version is written beside the old one and then swapped in."""
    root, n = _folder(spark, "published"), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.publish(n.drop("n_regionkey"), root)
    sinks.publish(n.where("n_regionkey > 0").drop("n_regionkey"), root)
    return sinks.published(spark, root)


@R.query("audit_sink", "SELECT publication_id, 'no title' AS reason FROM publications WHERE title IS NULL OR trim(title) = ''")
def audit_sink(spark, d):
    """Dropped rows with their reason, written and read again."""
    path = _folder(spark, "audit")
    dropped = table(spark, d, "publications").where("title is null or trim(title) = ''").select("publication_id", F.lit("no title").alias("reason"))
    sinks.write_audit(dropped, path)
    return spark.read.parquet(path)


@R.query("quality_json", """SELECT '{"rows":' || count(*) || ',"no_doi":' || count(*) FILTER (WHERE doi IS NULL) || ',"no_year":' || count(*) FILTER (WHERE year IS NULL) || '}' AS report FROM publications""")
def quality_json(spark, d):
    """Counts of conditions as one JSON object."""
    return sinks.quality_report(table(spark, d, "publications"), {"no_doi": "doi is null", "no_year": "year is null"})


@R.query(
    "wide_snapshot",
    """SELECT CAST(region AS VARCHAR) AS region, names, CAST(few AS VARCHAR) AS few, kind FROM (
    SELECT n_regionkey AS region, string_agg(n_name, '; ' ORDER BY n_name) AS names, count(*) < 5 AS few, NULL AS kind FROM nation GROUP BY n_regionkey UNION ALL SELECT r_regionkey, NULL, NULL, r_name FROM region)""",
)
def wide_snapshot(spark, d):
    """Rows of sources with different columns in one text table; lists joined, booleans in lower case."""
    a = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("names"), (F.count(F.lit(1)) < 5).alias("few"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("kind"))
    return sinks.flat_text(a.unionByName(b, allowMissingColumns=True))


@R.query(
    "reviewed_additions",
    """WITH x(region, name) AS (VALUES (' 0', 'ADDED A'), ('0 ', 'ADDED B'), ('9', 'ELSEWHERE'), ('1', 'NATION_1'))
    SELECT n_regionkey AS region, n_name AS name FROM nation WHERE n_regionkey IN (0, 1) UNION SELECT CAST(trim(region) AS INT), name FROM x WHERE trim(region) IN ('0', '1')""",
)
def reviewed_additions(spark, d):
    """Rows found by a scan with the reviewed ones of the same source, each name once."""
    x = spark.createDataFrame([(" 0", "ADDED A"), ("0 ", "ADDED B"), ("9", "ELSEWHERE"), ("1", "NATION_1")], "region string, name string")
    n = table(spark, d, "nation").where("n_regionkey in (0, 1)").select(F.col("n_regionkey").cast("int").alias("region"), F.col("n_name").alias("name"))
    return n.unionByName(x.where(F.trim("region").isin("0", "1")).select(F.trim("region").cast("int").alias("region"), "name")).distinct()
