"""Quality reports, daily pulls, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.operators import incremental, quality
from civicgauge.operators.combine import union_by_name, union_strict
from civicgauge.operators.score_store import ScoreStore
from civicgauge.operators.reshape import flatten_struct
from civicgauge.plans import hiring
from civicgauge.session import scratch_path
from civicgauge.sources import headers, readers, writers
from civicgauge.streaming.consolidated import ConsolidatedStore, consolidate_landed_pulls
from civicgauge.streaming.first_seen import BATCH, RUN, append_landed_pulls, read_store
from queries.registry import load, query

# ---- quality ----


@query("""
SELECT year, l_returnflag, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)
GROUP BY year, l_returnflag
""")
def duplicate_report(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "lineitem").withColumn("year", F.year("l_shipdate"))
    return quality.duplicate_report(lines, ["year", "l_returnflag"], ["l_orderkey"])


@query("""
SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY l_orderkey, l_linenumber
HAVING count(DISTINCT l_suppkey) > 1
""")
def key_consistency(spark: SparkSession, folder: str) -> DataFrame:
    return quality.key_consistency(load(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey")


@query("""
SELECT o_orderkey, l_linenumber, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) < 2
""")
def range_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Durations of one day or less."""
    rows = load(spark, folder, "orders").join(load(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.range_violations(rows, F.datediff("l_shipdate", "o_orderdate"), low=2).select("o_orderkey", "l_linenumber", "l_shipdate")


@query("""
SELECT n_name, CAST(min(year(o_orderdate)) AS INTEGER) AS min_period, CAST(max(year(o_orderdate)) AS INTEGER) AS max_period, count(*) AS n_rows,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS num_it
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders").join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("year", F.year("o_orderdate"))
    return quality.coverage_report(rows, ["n_name"], "year", {"num_it": F.col("o_orderpriority") == "1-URGENT"})


@query("SELECT quality, count(*) AS n_rows FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def vocabulary_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "documents").select("doc_id").join(load(spark, folder, "labels"), "doc_id", "left")
    return quality.vocabulary_report(rows, "quality")


@query("""
WITH r AS (
  SELECT o_orderkey, l_linenumber, l_returnflag, l_shipdate, l_suppkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (
  SELECT count(*) AS n_rows, count(*) FILTER (days < 2) AS too_short, count(*) FILTER (l_suppkey IS NULL) AS null_l_suppkey,
    min(days) AS min_days, max(days) AS max_days, count(*) FILTER (l_returnflag = 'A') AS l_returnflag_A, count(*) FILTER (l_returnflag = 'N') AS l_returnflag_N,
    count(*) FILTER (l_returnflag NOT IN ('A', 'N') OR l_returnflag IS NULL) AS l_returnflag_other, count(*) FILTER (l_linenumber = 1) AS first_lines FROM r)
SELECT metric, CAST(value AS VARCHAR) AS value FROM (UNPIVOT (SELECT * FROM f) ON COLUMNS(*) INTO NAME metric VALUE value)
""")
def checks_on_the_way(spark: SparkSession, folder: str) -> DataFrame:
    """Violations, nulls, coverage and vocabulary of a join, counted while it is written."""
    rows = load(spark, folder, "orders").join(load(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", F.datediff("l_shipdate", "o_orderdate").alias("days"))
    checks = quality.Checks(
        ranges={"too_short": ("days", 2, None)}, filled=["l_suppkey"], periods=["days"], vocabulary={"l_returnflag": ["A", "N"]},
        flags={"first_lines": F.col("l_linenumber") == 1})
    written, figures = quality.written_with_checks(rows, checks)
    return quality.report_of(written, figures)


# ---- daily pulls ----

PULL = "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_quantity double, l_shipdate timestamp_ntz"
APPEND_SQL = """
WITH store AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
pull AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate FROM store
UNION ALL
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate FROM pull WHERE l_orderkey NOT IN (SELECT l_orderkey FROM store)
"""


def pulls(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")
    return lines.filter(F.col("l_shipdate") < "1998-01-01"), lines.filter(F.col("l_shipdate") >= "1998-01-01")


@query(APPEND_SQL)
def append_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    store, pull = pulls(spark, folder)
    return incremental.append_first_seen(store, pull, "l_orderkey")


@query(APPEND_SQL)
def append_first_seen_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream: two pulls land one after the other, and a third run finds nothing new."""
    root = scratch_path(spark, "landed")
    landing, store = f"{root}/landing", f"{root}/store"
    for pull in pulls(spark, folder):
        pull.write.mode("append").parquet(landing)
        append_landed_pulls(spark, landing, PULL, store, f"{root}/checkpoint", "l_orderkey", "parquet").awaitTermination()
    append_landed_pulls(spark, landing, PULL, store, f"{root}/checkpoint", "l_orderkey", "parquet").awaitTermination()
    # Under a second checkpoint all that landed comes again, and nothing is replaced or added.
    append_landed_pulls(spark, landing, PULL, store, f"{root}/second-checkpoint", "l_orderkey", "parquet").awaitTermination()
    return read_store(spark, store, PULL).drop(RUN, BATCH)


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
  AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
""")
def closed_since(spark: SparkSession, folder: str) -> DataFrame:
    old, new = pulls(spark, folder)
    return incremental.closed_since(old, new, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("""
WITH t AS (SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS all_keywords FROM events GROUP BY user_id)
SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, all_keywords FROM events JOIN t USING (user_id)
""")
def consolidate_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with the distinct terms of its id; rows of an id that differ in a lasting column stay apart."""
    hits = load(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id")
    return incremental.consolidate_hits(hits, ["user_id"], "event_type", volatile=["event_id"], distinct=True)


@query("""
WITH hits AS (SELECT user_id AS id, event_type AS keyword, CAST(ts AS DATE) AS day FROM events),
first AS (SELECT * FROM hits WHERE day < DATE '2024-01-02'), second AS (SELECT * FROM hits WHERE day >= DATE '2024-01-02'),
store AS (SELECT DISTINCT id, day, k AS all_keywords FROM first JOIN (SELECT id, string_agg(keyword, ', ' ORDER BY keyword) AS k FROM first GROUP BY id) USING (id)),
pull AS (SELECT DISTINCT id, day, k AS all_keywords FROM second JOIN (SELECT id, string_agg(keyword, ', ' ORDER BY keyword) AS k FROM second GROUP BY id) USING (id))
SELECT * FROM store UNION ALL SELECT * FROM pull WHERE id NOT IN (SELECT id FROM store)
""")
def daily_pull(spark: SparkSession, folder: str) -> DataFrame:
    """The whole daily job: stacked searches, one row per record with all terms that found it, first-seen rows appended."""
    hits = load(spark, folder, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("keyword"), F.to_date("ts").alias("day"), F.col("event_id").alias("page"))
    early = F.col("day") < "2024-01-02"
    searches = [hits.filter(F.col("keyword") == k) for k in ("click", "view")] + [hits.filter(~F.col("keyword").isin("click", "view"))]
    stacked = union_by_name(union_by_name(*searches[:2]), searches[2])
    store, pull = (hiring.postings_consolidated(stacked.filter(x)) for x in (early, ~early))
    return incremental.append_first_seen(store, pull, "id")


HIT = "id bigint, keyword string, day date, pull int, page bigint"
PULLS_SQL = """
hits AS (
  SELECT user_id AS id, event_type AS keyword, CAST(ts AS DATE) AS day, CASE WHEN ts < TIMESTAMP '2024-01-02' THEN 1 WHEN ts < TIMESTAMP '2024-01-09' THEN 2 ELSE 3 END AS pull
  FROM events
),
first AS (SELECT id, min(pull) AS pull FROM hits GROUP BY id),
taken AS (SELECT hits.* FROM hits JOIN first USING (id, pull))"""


def landed_pulls(spark: SparkSession, folder: str) -> ConsolidatedStore:
    """Three pulls land one after the other, the last one in two batches; the store is compacted in between, and all lands again."""
    root = scratch_path(spark, "landed-hits")
    hits = load(spark, folder, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("keyword"), F.to_date("ts").alias("day"),
        F.when(F.col("ts") < "2024-01-02", 1).when(F.col("ts") < "2024-01-09", 2).otherwise(3).alias("pull"), F.col("event_id").alias("page"))
    store = ConsolidatedStore(spark, f"{root}/store", HIT, "id", "keyword", "pull", ["page"], buckets=4)

    def take(rows: DataFrame | None, checkpoint: str = "checkpoint") -> None:
        if rows is not None:
            rows.coalesce(1).write.mode("append").parquet(f"{root}/landing")
        consolidate_landed_pulls(store, f"{root}/landing", HIT, f"{root}/{checkpoint}", "parquet").awaitTermination()

    last = hits.filter("pull = 3")
    for rows in (hits.filter("pull = 1"), hits.filter("pull = 2"), last.filter("keyword = 'click'"), last.filter("keyword <> 'click'")):
        take(rows)
        store.compact(2)
    take(None, "another-checkpoint")
    return store


@query("WITH" + PULLS_SQL + """,
terms AS (SELECT id, string_agg(keyword, ', ' ORDER BY keyword) AS all_keywords FROM taken GROUP BY id)
SELECT DISTINCT id, day, pull, all_keywords FROM taken JOIN terms USING (id)
""")
def daily_pull_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The daily job as a stream: each record with all terms that found it in the pull that saw its id first."""
    return landed_pulls(spark, folder).consolidated()


@query("WITH" + PULLS_SQL + " SELECT id, keyword, count(*) AS n FROM taken GROUP BY id, keyword")
def daily_pull_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The same as (id, term, count) rows, which do not grow with an id's records."""
    return landed_pulls(spark, folder).term_counts()


@query("""
WITH hits AS (SELECT user_id AS id, event_type AS keyword, CAST(ts AS DATE) AS day FROM events),
terms AS (SELECT id, keyword, count(*) AS n FROM hits GROUP BY id, keyword),
days AS (SELECT id, count(DISTINCT day) AS n_records FROM hits GROUP BY id)
SELECT id, keyword, n, n_records FROM terms JOIN days USING (id)
""")
def hit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of an id once, with counts, beside its number of records."""
    hits = load(spark, folder, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("keyword"), F.to_date("ts").alias("day"))
    terms, records = incremental.hit_counts(hits, ["id"], "keyword")
    return terms.join(records.groupBy("id").agg(F.count(F.lit(1)).alias("n_records")), "id")


def _letters(texts):
    """A stand-in for an expensive scorer."""
    return texts.str.replace(r"\s", "", regex=True).str.len().rename("letters").to_frame()


@query("""
WITH seen AS (SELECT DISTINCT text FROM documents WHERE lang = 'en' AND text IS NOT NULL)
SELECT doc_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS letters,
  CASE WHEN text IN (SELECT text FROM seen) THEN 'first' WHEN text IS NOT NULL THEN 'second' END AS scored_by FROM documents
""")
def kept_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores kept between runs: the first run scores one pull's texts, the second the unseen texts of the whole table."""
    docs = load(spark, folder, "documents").select("doc_id", "text", "lang")
    store = ScoreStore(spark, scratch_path(spark, "scores"), _letters, "letters bigint", buckets=2)
    store.update(docs.filter(F.col("lang") == "en"), "text", run="first")
    return store.enrich(docs, "text", run="second").select("doc_id", "letters", "scored_by")


# ---- sources and sinks ----

@query("SELECT doc_id, text, lang, CASE WHEN source <> 'src0' THEN source END AS source FROM documents")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with line breaks, quotes and commas through CSV; a null goes out as NA and comes back as null."""
    path = scratch_path(spark, "csv")
    docs = load(spark, folder, "documents").select("doc_id", "text", "lang", F.when(F.col("source") != "src0", F.col("source")).alias("source"))
    writers.write_table_csv(docs, path)
    return readers.read_table_csv(spark, path, "doc_id bigint, text string, lang string, source string", glob="*.csv")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def ragged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a missing last field are filled with null."""
    path = scratch_path(spark, "ragged")
    quoted = F.concat(F.lit('"'), "c_name", F.lit('"'))
    line = F.concat_ws(",", "c_custkey", quoted, "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    load(spark, folder, "customer").select(line).write.text(path)
    fields = "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"
    return readers.read_ragged(spark, path, fields, header=False)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def stacked_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of two folders, with the index column of data-frame exports, stacked by position."""
    orders = load(spark, folder, "orders").select(F.lit(1).alias("index"), "o_orderkey", "o_orderstatus")
    paths = [scratch_path(spark, "stacked") for _ in range(2)]
    for path, rows in zip(paths, (orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'"))):
        writers.write_table_csv(rows, path)
    return union_strict(*[readers.read_many(spark, p, "o_orderkey bigint, o_orderstatus string", index_column=True, multi_line=False) for p in paths])


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def year_folders(spark: SparkSession, folder: str) -> DataFrame:
    """A tree of year folders read in one scan; the year comes from the folder name."""
    path = scratch_path(spark, "years")
    orders = load(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("Cube_March"), F.year("o_orderdate")).alias("cube"))
    writers.write_partitioned(orders, path, ["cube"], file_format="csv")
    return readers.with_path_year(readers.read_many(spark, path, "o_orderkey bigint", multi_line=False))


@query("""
SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders
""")
def headers_stacked(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly folders of files in three column orders, one with other names and an index column, one without the price."""
    path = scratch_path(spark, "headers")
    orders = load(spark, folder, "orders").withColumn("cube", F.concat(F.lit("Cube March "), F.year("o_orderdate")))
    shapes = {
        "F": ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"],
        "O": [F.monotonically_increasing_id().alias(" "), F.col("o_totalprice").alias("O Totalprice"), F.col("o_orderpriority").alias("Priority"), "o_orderkey", "o_orderstatus"],
        "P": ["o_orderpriority", "o_orderkey", "o_orderstatus"]}
    for status, columns in shapes.items():
        writers.write_partitioned(orders.filter(F.col("o_orderstatus") == status).select(*columns, "cube"), f"{path}/{status}", ["cube"], file_format="csv")
    return headers.read_by_header(
        spark, [f"{path}/{status}" for status in shapes], "o_orderkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double",
        aliases={"priority": "o_orderpriority"}, required=["o_orderkey", "o_orderstatus"], index_column=True, year="year")


@query("SELECT user_id, event_id AS id, event_type AS kind, event_id // 500 AS page FROM events")
def json_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed result pages of 500 records, one page per line, to one row per record with nested fields flattened."""
    path = scratch_path(spark, "pages")
    item = F.struct("user_id", F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")).alias("matched"))
    page = F.floor(F.col("event_id") / 500).alias("page")
    pages = load(spark, folder, "events").groupBy(page).agg(
        F.struct(F.collect_list(item).alias("SearchResultItems")).alias("SearchResult"))
    pages.write.json(path)
    schema = ("page bigint, SearchResult struct<SearchResultItems: array<struct<user_id: bigint, matched: struct<id: bigint, "
              "kind: string>>>>")
    rows = readers.read_json_pages(
        spark, path, schema, "SearchResult.SearchResultItems", keep=["page"], page_in_path=None, multi_line=False)
    return flatten_struct(rows).select("user_id", F.col("matched_id").alias("id"), F.col("matched_kind").alias("kind"), "page")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def partitioned_write(spark: SparkSession, folder: str) -> DataFrame:
    """One folder per status; writing one status again replaces only that folder."""
    path = scratch_path(spark, "parts")
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    writers.write_partitioned(orders, path, ["o_orderstatus"])
    writers.write_partitioned(orders.filter(F.col("o_orderstatus") == "F"), path, ["o_orderstatus"])
    writers.write_partitioned(orders, path, ["o_orderstatus"], mode="ignore")
    return spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").parquet(path)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def absent_keys_written(spark: SparkSession, folder: str) -> DataFrame:
    """A table that holds one status is filled up: the others are written, the one it has is left as it is."""
    path = scratch_path(spark, "absent")
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    writers.write_absent(orders.filter(F.col("o_orderstatus") == "F").withColumn("o_totalprice", F.lit(-1.0)), path, ["o_orderstatus"])
    writers.write_partitioned(orders, path, ["o_orderstatus"], mode="absent")
    return spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").parquet(path)


@query("SELECT c_custkey, c_name, 2 AS version FROM customer")
def snapshot_swap(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot rewritten from its own last version."""
    root = scratch_path(spark, "snapshot")
    writers.snapshot_write(load(spark, folder, "customer").select("c_custkey", "c_name").withColumn("version", F.lit(1)), root)
    writers.snapshot_write(writers.snapshot_read(spark, root).withColumn("version", F.col("version") + 1), root)
    return writers.snapshot_read(spark, root)
