"""Repairs and decisions on publication rows: titles, journals, authors and identities, each with what it rests on."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import dedup
from sheaf.plans.registry import Registry
from sheaf.session import table

R = Registry()

_KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
#: What may stand before or after a title without belonging to it.
NUMBERING = r"^\s*(?:\[\d{1,3}\]|\(?\d{1,3}[.)]|[-•*])\s+"
AWARD = r"(?i)\s*[(\[](?:winner|recipient|awarded|best paper)[^)\]]*[)\]]\s*$"
WITH = r"(?i)\s*[(\[](?:with|joint with|joint work with)\s[^)\]]*[)\]]\s*$"
CITED = r",?\s*\d{1,3}\s*\(\d{1,3}\)\s*[:,]\s*\d+\s*[-–]\s*\d+\.?\s*$"


def repaired_title(x):
    """a title without list numbering, award and co-author clauses and the volume and pages of a citation."""
    for pattern in (NUMBERING, AWARD, WITH, CITED):
        x = F.regexp_replace(x, pattern, "")
    return F.trim(x)


def _sql_repaired(x: str) -> str:
    for pattern in (NUMBERING, AWARD, WITH, CITED):
        x = f"regexp_replace({x}, '{pattern}', '')"
    return f"trim({x}, ' ')"


@R.query("title_repairs", f"""SELECT publication_id, {_sql_repaired("title || CASE publication_id % 4 WHEN 0 THEN ' (winner of the 2019 prize)' WHEN 1 THEN ' (with A. Lee)' WHEN 2 THEN ', 12(3), 44-59.' ELSE '' END")} AS title FROM publications WHERE title IS NOT NULL""")
def title_repairs(spark, d):
    """Titles with clauses added by rule, repaired; the clauses stand for those that profile pages add."""
    added = F.when(F.col("publication_id") % 4 == 0, " (winner of the 2019 prize)").when(F.col("publication_id") % 4 == 1, " (with A. Lee)").when(F.col("publication_id") % 4 == 2, ", 12(3), 44-59.").otherwise("")
    p = table(spark, d, "publications").where("title is not null")
    return p.select("publication_id", repaired_title(F.concat("title", added)).alias("title"))


@R.query(
    "registered_title",
    f"""WITH p AS (SELECT publication_id, trim(title) AS t, lower(trim(doi)) AS d FROM publications WHERE title IS NOT NULL AND doi IS NOT NULL),
    b AS (SELECT d, max(t) FILTER (WHERE length(t) = m) AS reg FROM (SELECT *, max(length(t)) OVER (PARTITION BY d) AS m FROM p) GROUP BY d)
    SELECT publication_id, reg AS title FROM p JOIN b USING (d) WHERE starts_with(lower(reg), lower(t) || ':') AND len(string_split({_KEY.format("substr(reg, length(t) + 2)")}, ' ')) >= 2""",
)
def registered_title(spark, d):
    """the longest title under a DOI in place of one that lacks its subtitle; a single word is a running head, not a subtitle."""
    p = table(spark, d, "publications").where("title is not null and doi is not null").select("publication_id", F.trim("title").alias("t"), F.lower(F.trim("doi")).alias("d"))
    b = p.groupBy("d").agg(F.max(F.struct(F.length("t").alias("n"), F.col("t").alias("reg"))).alias("m")).select("d", "m.reg")
    rest = F.substr("reg", F.length("t") + 2)
    got = p.join(b, "d").where(F.startswith(F.lower("reg"), F.concat(F.lower("t"), F.lit(":"))) & (F.size(F.split(text.title_key(rest), " ")) >= 2))
    return got.select("publication_id", F.col("reg").alias("title"))


@R.query(
    "owner_named",
    f"""WITH r AS (SELECT researcher_id, {_KEY.format("min(name)")} AS n FROM researchers WHERE name IS NOT NULL GROUP BY researcher_id)
    SELECT publication_id, contains(' ' || {_KEY.format("authors")} || ' ', ' ' || list_extract(string_split(n, ' '), -1) || ' ') AS owner_named FROM publications JOIN r USING (researcher_id) WHERE authors IS NOT NULL""",
)
def owner_named(spark, d):
    """Whether a list of authors holds the owner's last word as a whole word."""
    r = table(spark, d, "researchers").where("name is not null").groupBy("researcher_id").agg(F.min("name").alias("name"))
    p = table(spark, d, "publications").where("authors is not null").select("publication_id", "researcher_id", "authors").join(r, "researcher_id")
    last = F.element_at(F.split(text.title_key("name"), " "), -1)
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return p.select("publication_id", F.contains(padded(text.title_key("authors")), padded(last)).alias("owner_named"))


@R.query("author_fallback", "WITH k AS (SELECT doi, min(authors) AS other FROM publications WHERE doi IS NOT NULL AND trim(authors) <> '' GROUP BY doi) SELECT publication_id, other AS authors FROM publications p JOIN k USING (doi) WHERE p.authors IS NULL OR trim(p.authors) = ''")
def author_fallback(spark, d):
    """An empty list of authors filled from another row of the same DOI."""
    p = table(spark, d, "publications").where("doi is not null").select("publication_id", "doi", "authors")
    k = p.where(F.trim("authors") != "").groupBy("doi").agg(F.min("authors").alias("other"))
    return p.where("authors is null or trim(authors) = ''").join(k, "doi").select("publication_id", F.col("other").alias("authors"))


@R.query(
    "citation_journal",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    s AS (SELECT doc_id, pos, lower(trim(unnest(regexp_split_to_array(line, '[,.]')))) AS seg FROM l),
    j AS (SELECT lower(trim(journal_title)) AS seg, ref_id FROM journal_reference)
    SELECT doc_id, pos, min(ref_id) AS ref_id FROM s JOIN j USING (seg) GROUP BY doc_id, pos HAVING count(DISTINCT ref_id) = 1""",
)
def citation_journal(spark, d):
    """The one known journal among the comma and full-stop segments of a citation line; two different ones are none."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    seg = lines.select("doc_id", "pos", F.explode(F.split("line", "[,.]")).alias("seg")).withColumn("seg", F.lower(F.trim("seg"))).where("seg <> ''")
    j = table(spark, d, "journal_reference").select(F.lower(F.trim("journal_title")).alias("seg"), "ref_id")
    got = seg.join(j, "seg").groupBy("doc_id", "pos").agg(F.min("ref_id").alias("ref_id"), F.max("ref_id").alias("hi"))
    return got.where("ref_id = hi").select("doc_id", "pos", "ref_id")


@R.query("rating_lookup", f"SELECT {_KEY.format('journal_title')} AS title_key, min(rating) AS rating, list_sort(list_distinct(flatten(list(list_filter([replace(issn, '-', ''), replace(issn_online, '-', '')], lambda x: x IS NOT NULL))))) AS issns, min(year_inception) AS inception FROM journal_reference GROUP BY 1")
def rating_lookup(spark, d):
    """Known titles with their rating, ISSNs and year of inception."""
    r = table(spark, d, "journal_reference").select(text.title_key("journal_title").alias("title_key"), "rating", "year_inception", F.array_compact(F.array(F.replace("issn", F.lit("-"), F.lit("")), F.replace("issn_online", F.lit("-"), F.lit("")))).alias("i"))
    return r.groupBy("title_key").agg(F.min("rating").alias("rating"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("issns"), F.min("year_inception").alias("inception"))


@R.query(
    "verified_external_title",
    f"""WITH r AS (SELECT researcher_id, list_extract(string_split({_KEY.format("min(name)")}, ' '), -1) AS s FROM researchers WHERE name IS NOT NULL GROUP BY researcher_id),
    p AS (SELECT publication_id, researcher_id, journal_id, year, doi, authors, {_KEY.format("title")} AS k FROM publications WHERE title IS NOT NULL AND journal_id IS NOT NULL AND year IS NOT NULL)
    SELECT a.publication_id, min(b.publication_id) AS external_id FROM p a JOIN r USING (researcher_id) JOIN p b ON a.k = b.k AND a.journal_id = b.journal_id AND abs(a.year - b.year) <= 1 AND a.k <> ''
    WHERE a.doi IS NULL AND b.doi IS NOT NULL AND contains(' ' || {_KEY.format("b.authors")} || ' ', ' ' || r.s || ' ') GROUP BY a.publication_id""",
)
def verified_external_title(spark, d):
    """A row with a DOI of the same title and journal, years one apart at most, that names the owner among its authors.

    The external rows of a key are first reduced to one for each year and list of authors, so copies cost nothing.
    """
    r = table(spark, d, "researchers").where("name is not null").groupBy("researcher_id").agg(F.min("name").alias("name"))
    p = table(spark, d, "publications").where("title is not null and journal_id is not null and year is not null").select("publication_id", "researcher_id", "journal_id", "year", "doi", "authors", text.title_key("title").alias("k")).where("k <> ''")
    b = p.where("doi is not null and authors is not null").groupBy("k", "journal_id", F.col("year").alias("b_year"), text.title_key("authors").alias("names")).agg(F.min("publication_id").alias("external_id"))
    b = b.withColumn("y", F.explode(F.array(F.col("b_year") - 1, F.col("b_year"), F.col("b_year") + 1))).drop("b_year")
    a = p.where("doi is null").join(r, "researcher_id").select("publication_id", "journal_id", "k", F.col("year").alias("y"), F.element_at(F.split(text.title_key("name"), " "), -1).alias("s"))
    hit = a.join(b, ["k", "journal_id", "y"]).where(F.contains(F.concat(F.lit(" "), "names", F.lit(" ")), F.concat(F.lit(" "), "s", F.lit(" "))))
    return hit.groupBy("publication_id").agg(F.min("external_id").alias("external_id"))


@R.query("quartile_guard", "SELECT row_id, CASE WHEN upper(trim(sjr_quartile)) IN ('Q1', 'Q2', 'Q3', 'Q4') THEN upper(trim(sjr_quartile)) END AS quartile FROM anu_journals")
def quartile_guard(spark, d):
    """A quartile, null where the cell holds anything else."""
    q = F.upper(F.trim("sjr_quartile"))
    return table(spark, d, "anu_journals").select("row_id", F.when(q.isin("Q1", "Q2", "Q3", "Q4"), q).alias("quartile"))


@R.query(
    "fallback_scan",
    """WITH r AS (SELECT DISTINCT researcher_id, university, coalesce(regexp_matches(lower(job_title), 'professor'), false) AS hit FROM researchers WHERE university IS NOT NULL),
    g AS (SELECT university, bool_or(hit) AS any_hit FROM r GROUP BY university) SELECT DISTINCT researcher_id, university FROM r JOIN g USING (university) WHERE hit OR NOT any_hit""",
)
def fallback_scan(spark, d):
    """The candidates of a source that pass a filter, or all of them where none does."""
    r = table(spark, d, "researchers").where("university is not null").select("researcher_id", "university", F.coalesce(F.lower("job_title").rlike("professor"), F.lit(False)).alias("hit")).distinct()
    g = r.groupBy("university").agg(F.max("hit").alias("any_hit"))
    return r.join(g, "university").where("hit or not any_hit").select("researcher_id", "university").distinct()


@R.query(
    "identity_status",
    """WITH r AS (SELECT DISTINCT researcher_id, field_of_research AS f, lower(split_part(name, ' ', -1)) AS s FROM researchers WHERE name IS NOT NULL AND field_of_research IS NOT NULL),
    n AS (SELECT s, f, count(DISTINCT researcher_id) AS n FROM r GROUP BY s, f)
    SELECT CASE WHEN n = 1 THEN 'not found' WHEN n = 2 THEN 'unique' ELSE 'ambiguous' END AS status, count(DISTINCT researcher_id) AS n_people FROM r JOIN n USING (s, f) GROUP BY 1""",
)
def identity_status(spark, d):
    """How many people have no, one or several other keys that may be theirs, by counts of keys and not by pairs."""
    r = table(spark, d, "researchers").where("name is not null and field_of_research is not null").select("researcher_id", F.col("field_of_research").alias("f"), F.lower(F.element_at(F.split("name", " "), -1)).alias("s")).distinct()
    n = r.groupBy("s", "f").agg(F.count_distinct("researcher_id").alias("n"))
    status = F.when(F.col("n") == 1, "not found").when(F.col("n") == 2, "unique").otherwise("ambiguous")
    return r.join(n, ["s", "f"]).groupBy(status.alias("status")).agg(F.count_distinct("researcher_id").alias("n_people"))


_DOI_OK = r"regexp_matches(lower(trim(doi)), '10\.[0-9]{4,9}/[^ ]')"


@R.query("collect_streams", f"SELECT CASE WHEN title IS NULL OR trim(title) = '' THEN 'skipped: no title' WHEN doi IS NOT NULL AND NOT {_DOI_OK} THEN 'unparsed: doi' WHEN year IS NULL THEN 'kept: no year' ELSE 'kept' END AS stream, count(*) AS n_rows FROM publications GROUP BY 1")
def collect_streams(spark, d):
    """Rows kept, skipped or unparsed side by side, each with its reason; a bad row ends in a stream of its own."""
    p = table(spark, d, "publications")
    stream = (
        F.when(F.col("title").isNull() | (F.trim("title") == ""), "skipped: no title").when(F.col("doi").isNotNull() & ~F.lower(F.trim("doi")).rlike(r"10\.[0-9]{4,9}/[^ ]"), "unparsed: doi").when(F.col("year").isNull(), "kept: no year").otherwise("kept")
    )
    return p.groupBy(stream.alias("stream")).agg(F.count(F.lit(1)).alias("n_rows"))


@R.query("plausible_count", "SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x BETWEEN 1 AND 999)) AS count FROM documents WHERE text IS NOT NULL")
def plausible_count(spark, d):
    """The largest plausible number of a whole text."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), 0), lambda x: x.try_cast("bigint"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_max(F.filter(numbers, lambda x: x.between(1, 999))).alias("count"))


@R.query(
    "author_verification",
    f"""WITH r AS (SELECT researcher_id, nullif(regexp_replace(upper(max(orcid)), '[^0-9X]', '', 'g'), '') AS o, {_KEY.format("min(name)")} AS n, min(university) AS u FROM researchers WHERE name IS NOT NULL AND orcid IS NOT NULL GROUP BY researcher_id),
    f AS (SELECT o, n, min(researcher_id) AS left_id FROM r WHERE o IS NOT NULL GROUP BY o, n),
    w AS (SELECT f.left_id, r.researcher_id AS right_id, r.u = l.u AS same_university FROM f JOIN r USING (o, n) JOIN r l ON l.researcher_id = f.left_id WHERE r.researcher_id <> f.left_id),
    dois AS (SELECT DISTINCT researcher_id, lower(trim(doi)) AS doi FROM publications WHERE doi IS NOT NULL),
    s AS (SELECT left_id, right_id, count(*) AS n FROM w JOIN dois a ON a.researcher_id = left_id JOIN dois b ON b.researcher_id = right_id AND a.doi = b.doi GROUP BY 1, 2)
    SELECT left_id, right_id, coalesce(s.n, 0) AS shared_dois, coalesce(same_university, false) AS same_university, coalesce(s.n, 0) > 0 OR coalesce(same_university, false) AS verified FROM w LEFT JOIN s USING (left_id, right_id)""",
)
def author_verification(spark, d):
    """Keys of one ORCID and one name against the first of them, verified by a common DOI or university."""
    code = F.nullif(F.regexp_replace(F.upper(F.max("orcid")), "[^0-9X]", ""), F.lit(""))
    r = table(spark, d, "researchers").where("name is not null and orcid is not null").groupBy("researcher_id").agg(code.alias("o"), F.min("name").alias("name"), F.min("university").alias("u"))
    r = r.where("o is not null").select("researcher_id", "o", text.title_key("name").alias("n"), "u")
    f = r.groupBy("o", "n").agg(F.min(F.struct(F.col("researcher_id").alias("left_id"), F.col("u").alias("left_u"))).alias("f")).select("o", "n", "f.*")
    w = r.join(f, ["o", "n"]).where("researcher_id <> left_id").select("left_id", F.col("researcher_id").alias("right_id"), F.coalesce(F.col("u") == F.col("left_u"), F.lit(False)).alias("same_university"))
    dois = table(spark, d, "publications").where("doi is not null").select("researcher_id", F.lower(F.trim("doi")).alias("doi")).distinct()
    a, b = dois.withColumnRenamed("researcher_id", "left_id"), dois.withColumnRenamed("researcher_id", "right_id")
    s = w.select("left_id", "right_id").join(a, "left_id").join(b, ["right_id", "doi"]).groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n"))
    got = w.join(s, ["left_id", "right_id"], "left").withColumn("shared_dois", F.coalesce("n", F.lit(0)))
    return got.select("left_id", "right_id", "shared_dois", "same_university", (F.col("same_university") | (F.col("shared_dois") > 0)).alias("verified"))


@R.query(
    "title_only_join",
    f"""WITH r AS (SELECT lower(journal_title) AS k, min(rating) AS rating FROM journal_reference GROUP BY 1), q AS (SELECT {_KEY.format("journal_title")} AS k, min(rating) AS rating FROM journal_reference GROUP BY 1),
    j AS (SELECT DISTINCT journal_id, journal_name FROM journals WHERE journal_name IS NOT NULL)
    SELECT journal_id, journal_name, coalesce(r.rating, q.rating) AS rating, CASE WHEN r.k IS NOT NULL THEN 'name' WHEN q.k IS NOT NULL THEN 'stripped name' END AS match_method FROM j LEFT JOIN r ON lower(journal_name) = r.k LEFT JOIN q ON {_KEY.format("journal_name")} = q.k""",
)
def title_only_join(spark, d):
    """Ratings by name alone, in lower case, else without punctuation."""
    ref = table(spark, d, "journal_reference")
    r = ref.groupBy(F.lower("journal_title").alias("k1")).agg(F.min("rating").alias("r1"), F.lit(1).alias("h1"))
    q = ref.groupBy(text.title_key("journal_title").alias("k2")).agg(F.min("rating").alias("r2"), F.lit(1).alias("h2"))
    j = table(spark, d, "journals").where("journal_name is not null").select("journal_id", "journal_name").distinct()
    j = j.withColumns({"k1": F.lower("journal_name"), "k2": text.title_key("journal_name")}).join(r, "k1", "left").join(q, "k2", "left")
    return j.select("journal_id", "journal_name", F.coalesce("r1", "r2").alias("rating"), F.when(F.col("h1") == 1, "name").when(F.col("h2") == 1, "stripped name").alias("match_method"))


@R.query(
    "row_flags",
    "SELECT DISTINCT researcher_id, coalesce(regexp_matches(lower(job_title), 'teaching|education.focused|sessional|casual|tutor'), false) AS less_research, coalesce(regexp_matches(lower(field_of_research), 'account|financ'), false) AS in_field FROM researchers",
)
def row_flags(spark, d):
    """Flags by pattern, false where nothing is known."""
    like = lambda c, p: F.coalesce(F.lower(c).rlike(p), F.lit(False))
    return table(spark, d, "researchers").select("researcher_id", like("job_title", "teaching|education.focused|sessional|casual|tutor").alias("less_research"), like("field_of_research", "account|financ").alias("in_field")).distinct()


@R.query(
    "line_before_stop",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    s AS (SELECT doc_id, min(pos) AS stop FROM l WHERE regexp_matches(lower(trim(line)), '^(references|publications|bibliography|notes)\b') GROUP BY doc_id),
    h AS (SELECT l.doc_id, min(pos) AS pos FROM l LEFT JOIN s ON l.doc_id = s.doc_id WHERE (stop IS NULL OR pos < stop) AND regexp_matches(lower(line), '\b(professor|lecturer|fellow|dean)\b') GROUP BY l.doc_id)
    SELECT doc_id, pos, line FROM h JOIN l USING (doc_id, pos)""",
)
def line_before_stop(spark, d):
    """The first line that names a post, before a heading that ends the profile; whole texts, line by line."""
    post, stop = r"\b(professor|lecturer|fellow|dean)\b", r"^(references|publications|bibliography|notes)\b"
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("pos", F.col("at") + 1)
    got = lines.groupBy("doc_id").agg(F.min(F.when(F.lower(F.trim("line")).rlike(stop), F.col("pos"))).alias("stop"), F.min(F.when(F.lower("line").rlike(post), F.struct("pos", "line"))).alias("m"))
    return got.where("m is not null and (stop is null or m.pos < stop)").select("doc_id", "m.pos", "m.line")


#: Words of the disciplines, in the order in which ties are decided.
DISCIPLINES = {"accounting": "account|audit|ledger|bookkeep", "finance": "financ|bank|credit|invest", "economics": "econom|trade|labour", "management": "manag|organisation|leader"}


@R.query(
    "doc_discipline",
    "SELECT doc_id, CASE WHEN m = 0 THEN NULL " + " ".join(f"WHEN n{i} = m THEN '{n}'" for i, n in enumerate(DISCIPLINES)) + " END AS discipline FROM (SELECT *, greatest(n0, n1, n2, n3) AS m FROM (SELECT doc_id, "
    + ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) AS n{i}" for i, p in enumerate(DISCIPLINES.values())) + " FROM documents WHERE text IS NOT NULL))",
)
def doc_discipline(spark, d):
    """the discipline whose words a whole text holds most often, null where it holds none."""
    n = {f"n{i}": F.regexp_count(F.lower("text"), F.lit(p)) for i, p in enumerate(DISCIPLINES.values())}
    got = table(spark, d, "documents").where("text is not null").select("doc_id", *[c.alias(k) for k, c in n.items()]).withColumn("m", F.greatest(*n))
    pick = F.when(F.col("m") == 0, None)
    for k, name in zip(n, DISCIPLINES):
        pick = pick.when(F.col(k) == F.col("m"), name)
    return got.select("doc_id", pick.alias("discipline"))


@R.query(
    "survivor_preference",
    f"""WITH p AS (SELECT publication_id, researcher_id, {_KEY.format("title")} AS k, journal_id IS NULL AS no_journal, coalesce(NOT {_DOI_OK} OR contains(lower(doi), '10.99200/'), true) AS no_doi FROM publications WHERE title IS NOT NULL AND researcher_id IS NOT NULL)
    SELECT researcher_id, k, publication_id FROM (SELECT *, row_number() OVER (PARTITION BY researcher_id, k ORDER BY no_journal, no_doi, publication_id) AS n FROM p WHERE k <> '') WHERE n = 1""",
)
def survivor_preference(spark, d):
    """Of the rows of one title the one with a journal, then with a publisher's DOI, then the first, by one combinable minimum."""
    p = table(spark, d, "publications").where("title is not null and researcher_id is not null")
    bad = F.coalesce(~F.lower(F.trim("doi")).rlike(r"10\.[0-9]{4,9}/[^ ]") | F.lower("doi").contains("10.99200/"), F.lit(True))
    p = p.select("publication_id", "researcher_id", text.title_key("title").alias("k"), F.col("journal_id").isNull().alias("no_journal"), bad.alias("no_doi")).where("k <> ''")
    return dedup.first_rows(p, ["researcher_id", "k"], [F.col("no_journal"), F.col("no_doi"), F.col("publication_id")]).select("researcher_id", "k", "publication_id")


@R.query(
    "relationship_evidence",
    """WITH e AS (SELECT user_id, event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT user_id, count(*) FILTER (WHERE k = user_id) AS by_id, count(*) FILTER (WHERE k IS NULL) AS unknown FROM e GROUP BY user_id""",
)
def relationship_evidence(spark, d):
    """How often a nested record names its owner's own id, and how often none."""
    e = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return e.groupBy("user_id").agg(F.count_if(F.col("k") == F.col("user_id")).alias("by_id"), F.count_if(F.col("k").isNull()).alias("unknown"))


@R.query("nested_ids", "SELECT researcher_id, arg_min(orcid, loaded_at) FILTER (WHERE orcid IS NOT NULL) AS orcid, count(DISTINCT orcid) AS n_orcids FROM (SELECT DISTINCT researcher_id, orcid, min(loaded_at) OVER (PARTITION BY researcher_id, orcid) AS loaded_at FROM researchers) GROUP BY researcher_id")
def nested_ids(spark, d):
    """The first identifier of a person and the number of different ones."""
    r = table(spark, d, "researchers").groupBy("researcher_id", "orcid").agg(F.min("loaded_at").alias("at"))
    return r.groupBy("researcher_id").agg(F.min_by("orcid", F.when(F.col("orcid").isNotNull(), F.col("at"))).alias("orcid"), F.count("orcid").alias("n_orcids"))
