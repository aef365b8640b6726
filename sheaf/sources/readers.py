"""Readers of files and stored payloads; every reader gives rows their source file and their order in it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.functions.text import first_filled, null_clean
from sheaf.session import hadoop_path


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", clean: bool = True) -> DataFrame:
    """All-text CSV with header: byte order mark and blanks out of the header, cells trimmed, missing ones null.

    Files of one call share a header; quoted line breaks and doubled quotes are understood. An empty folder or
    a missing path gives an empty table without columns.
    """
    try:
        df = spark.read.options(header=True, sep=sep, multiLine=True, escape='"', encoding="UTF-8").csv(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "empty string").drop("empty")
    names = [c.lstrip("﻿").strip() for c in df.columns]
    df = df.toDF(*names)
    return df.select(*[null_clean(F.col(f"`{c}`")).alias(c) for c in names]) if clean else df


def read_partitioned(spark: SparkSession, root: str, kind: str, sep: str = ",") -> DataFrame:
    """`<root>/<partition>/*_<kind>.csv` of all partitions, with partition, file and line order.

    Every partition is read under its own header and aligned by column name; what a partition lacks is null.
    ord is the row's place in its file (rows of one file keep their order in what its splits number).
    """
    fs, at = hadoop_path(spark, root)
    found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*_{kind}.csv")) or []
    folders = sorted({f.getPath().getParent().toString() for f in found})
    path = F.col("_metadata.file_path")
    parts = []
    for folder in folders:
        raw = spark.read.options(header=True, sep=sep, escape='"', multiLine=True, encoding="UTF-8").csv(f"{folder}/*_{kind}.csv")
        cells = [null_clean(F.col(f"`{c}`")).alias(c.lstrip("\ufeff").strip()) for c in raw.columns]
        parts.append(raw.select(*cells, F.lit(folder.rsplit("/", 1)[-1]).alias("partition"), path.alias("file"), F.monotonically_increasing_id().alias("ord")))
    if not parts:
        return spark.createDataFrame([], "partition string, file string, ord bigint")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def read_json_rows(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """A JSON array of rows in a file, or with lines one row a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def aliased(df: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Target columns, each the first filled one of its aliases; null where none exists."""
    return df.select(*[first_filled(list(names), df.columns).alias(target) for target, names in wanted.items()])


def with_offset_header(df: DataFrame, header_row: int) -> DataFrame:
    """A sheet read without header (columns c0, c1, ... and row_no) whose header is in a given row; unnamed columns go."""
    cols = [c for c in df.columns if c != "row_no"]
    head = df.where(F.col("row_no") == header_row).select(*cols).first()
    keep = [(c, str(head[c]).strip()) for c in cols if head is not None and head[c] and not str(head[c]).startswith("Unnamed")]
    return df.where(F.col("row_no") > header_row).select(*[F.col(c).alias(n) for c, n in keep])


# stored responses


def request_key(url: Column | str, params: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("?", url, params), 256), 1, 16)


def upsert_cache(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """key, fetched_at, body: the newest response of each request."""
    both = cache.unionByName(fetched)
    return both.groupBy("key").agg(F.max(F.struct("fetched_at", "body")).alias("r")).select("key", "r.fetched_at", "r.body")


def fresh(cache: DataFrame, now: Column, days: int) -> DataFrame:
    return cache.where(F.col("fetched_at") > now - F.expr(f"interval {int(days)} days"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("n_responses"), F.round(F.sum(F.length("body")) / 1e6, 6).alias("megabytes"))


def batches(keys: DataFrame, key: str, size: int) -> DataFrame:
    """Distinct keys with a batch number, never more than `size` keys a batch.

    Keys are numbered within hash buckets of some thousand batches each, so no global order is needed.
    """
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()
    per = 1000 * size
    buckets = max(1, -(-distinct.count() // per))
    placed = distinct.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    at = F.row_number().over(W.partitionBy("_b").orderBy(key))
    return placed.withColumn("_n", F.floor((at - 1) / size)).select(key, (F.col("_n") * buckets + F.col("_b")).alias("batch_no"))


def incomplete_batches(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """Batches some of whose keys have no answer."""
    return asked.join(answered.select(key).distinct(), key, "left_anti").groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_missing"))


def latest_value(values: Column, year: str, value: str) -> Column:
    """Of an array of structs the value of the latest year that has one."""
    have = F.filter(values, lambda v: v.getField(value).isNotNull())
    return F.get(F.array_sort(have, lambda a, b: (b.getField(year) - a.getField(year)).cast("int")), F.lit(0)).getField(value)


def pages(df: DataFrame, body: str, item_schema: str) -> DataFrame:
    """Items of stored JSON result pages ({"total": n, "items": [...]}), until the total: one row an item, with its page."""
    parsed = df.withColumn("_p", F.from_json(body, f"total bigint, items array<struct<{item_schema}>>"))
    return parsed.select("page_no", F.col("_p.total").alias("total"), F.posexplode("_p.items").alias("pos", "item")).select("page_no", "pos", "total", "item.*")


def page_gaps(items: DataFrame) -> DataFrame:
    """How many items are missing against the total that the pages name."""
    return items.agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("got")).withColumn("missing", F.greatest(F.col("total") - F.col("got"), F.lit(0)))


# documents


def rss_items(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, title, link, pub_date) of every item of stored feeds."""
    n = F.expr(f"cast(xpath_number({xml}, 'count(//item)') as int)")
    rows = df.select(key, xml, F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("_i"))
    titles, links, dates = (F.expr(f"xpath({xml}, '//item/{t}/text()')") for t in ("title", "link", "pubDate"))
    return rows.select(key, F.get(titles, F.col("_i") - 1).alias("title"), F.get(links, F.col("_i") - 1).alias("link"), F.get(dates, F.col("_i") - 1).alias("pub_date"))


def bibtex_field(text: Column | str, field: str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    v = F.regexp_extract(c, r"(?is)\b" + field + r"\s*=\s*[{\"](.*?)[}\"]\s*,?\s*(?:\n|\}|$)", 1)
    return F.when(v != "", F.regexp_replace(v, r"[{}]", ""))


class _Page(HTMLParser):
    """Meta tags, sections by heading, items of lists, property tables, links and cards of one page."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, card_class: str):
        super().__init__(convert_charrefs=True)
        self.card_class, self.rows, self.stack = card_class, [], []
        self.text: dict[int, list[str]] = {}
        self.section, self.label, self.link = "", "", ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("name") and a.get("content"):
            self.rows.append(("meta", a["name"], a["content"].strip(), ""))
        if tag == "a":
            self.link = a.get("href") or ""
        if tag not in self.VOID:
            card = self.card_class and self.card_class in (a.get("class") or "").split()
            self.stack.append((tag, "card" if card else tag))
            self.text[len(self.stack)] = []

    def handle_data(self, data):
        for depth in range(1, len(self.stack) + 1):
            self.text[depth].append(data)

    def handle_endtag(self, tag):
        while self.stack:
            depth = len(self.stack)
            name, kind = self.stack.pop()
            words = " ".join("".join(self.text.pop(depth, [])).split())
            if kind in ("h1", "h2", "h3", "h4"):
                self.section = words
                self.rows.append(("heading", kind, words, ""))
            elif kind in ("th", "dt"):
                self.label = words
            elif kind in ("td", "dd") and self.label:
                self.rows.append(("property", self.label, words, self.section))
                self.label = ""
            elif kind == "li" and words:
                self.rows.append(("item", self.section, words, self.link))
            elif kind == "a" and words:
                self.rows.append(("link", words, self.link, self.section))
            elif kind == "card":
                self.rows.append(("card", self.section, words, self.link))
            if name == tag:
                return


def html_parts(df: DataFrame, key: str, html: str, card_class: str = "card") -> DataFrame:
    """(key, pos, kind, name, value, extra) of stored pages: meta, heading, property, item, link and card parts.

    Pages are parsed one by one in Arrow batches; unclosed tags are closed by their parents; null pages give
    no rows; a page that can't be parsed gives one row of kind error with the reason.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for k, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    p = _Page(card_class)
                    p.feed(page)
                    p.close()
                    while p.stack:
                        p.handle_endtag(p.stack[-1][0])
                except Exception as e:  # noqa: BLE001, one bad page is a row, not the end of the job
                    rows.append((k, 0, "error", type(e).__name__, str(e), ""))
                else:
                    rows += [(k, i, *r) for i, r in enumerate(p.rows, 1)]
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string(), pa.int32()] + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "pos", "kind", "name", "value", "extra"])

    slim = df.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).where(F.col("html").isNotNull())
    return slim.mapInArrow(run, "key string, pos int, kind string, name string, value string, extra string")
