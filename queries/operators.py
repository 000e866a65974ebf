"""Single operators that no job query shows on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge import functions as fn
from civicgauge.operators import aggregate, combine, joins, project, ranking, reshape
from queries.registry import load, query

# ---- columns and rows ----


@query(r"""
SELECT doc_id, array_to_string(list_transform(
  regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}.''_]*|[^\p{L}\p{N}]'), lambda w: CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END || w[2:]), '') AS title
FROM documents
""")
def title_case(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts in title case."""
    return load(spark, folder, "documents").select("doc_id", fn.title_case("text").alias("title"))


@query("""
SELECT 'pull 7' AS source_pull, c_custkey, replace(c_name, 'Customer', 'Cust.') AS c_name, substr(c_name, strpos(c_name, '#') + 1) AS number,
  CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS digits, c_mktsegment || '--' || c_name AS label,
  CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 4 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END AS code,
  c_mktsegment LIKE 'A%' OR c_mktsegment LIKE '%H%' AS is_home, 'Cust' || 'omer' AS first_word, DATE '2025-01-05' AS pulled
FROM customer
""")
def column_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Header cleaning, renaming, moving, tagging and the small text functions."""
    raw = load(spark, folder, "customer").toDF("c_custkey", "C Name", "cNationkey", "c-acctbal", "c_mktsegment")
    named = project.rename_to_title(project.clean_names(raw), "c_name", "Name 2025")
    rows = named.select(
        "c_custkey", fn.expand_abbreviations("Name 2025", {"Customer": "Cust."}).alias("c_name"),
        fn.after_first("Name 2025", "#").alias("number"), fn.digits_only("Name 2025").cast("bigint").alias("digits"),
        fn.make_key("c_mktsegment", "Name 2025", separator="--").alias("label"), fn.pad_code("c_custkey", 4).alias("code"),
        fn.match_any("c_mktsegment", ["^a", "h"], ignore_case=True, regex=True).alias("is_home"),
        fn.nth_piece("Name 2025", "#", 1).alias("first_word"))
    tagged = project.tag(rows, source_pull="pull 7", pulled=F.lit("2025-01-05").cast("date"))
    return project.relocate(tagged, ["source_pull"])


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS year,
  year(o_orderdate) || ' Q' || quarter(o_orderdate) AS quarter,
  CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'P' THEN NULL ELSE floor(o_totalprice) END AS prize,
  CAST(round(o_totalprice / 1000000 * 100) AS BIGINT) || '%' AS of_million, CAST(floor(o_totalprice / 10000 + 0.5) AS BIGINT) * 10000 AS bin
FROM orders
""")
def value_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Dates, quarters, money text, percent text and bins."""
    status = F.col("o_orderstatus")
    money = F.when(status == "F", "NO prize").when(status == "P", "junk").otherwise(
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    text = F.when(status == "O", F.col("o_orderdate").cast("date").cast("string")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = load(spark, folder, "orders").withColumns({"day": fn.parse_date(text), "money": money})
    return rows.select(
        "o_orderkey", "day", fn.year_of("day").alias("year"), fn.quarter_label("day").alias("quarter"),
        fn.parse_money("money").alias("prize"), fn.percent_text(F.col("o_totalprice") / 1000000).alias("of_million"),
        fn.bin_to("o_totalprice", 10000).alias("bin"))


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity + coalesce(CASE WHEN l_returnflag = 'R' THEN l_tax END, 0) AS row_total,
  upper(l_linestatus) AS l_linestatus_code, upper(l_returnflag) AS l_returnflag_code
FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 AND l_returnflag IN ('A', 'R') AND (l_linenumber = 1 OR l_linestatus = 'O')
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
""")
def row_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges, short lists, a long list held in a table, lists on two columns, complete rows, one change on several columns."""
    rows = project.between(load(spark, folder, "lineitem"), "l_quantity", 5, 40)
    rows = project.keep_members(rows, "l_returnflag", ["A", "R"])
    rows = project.keep_members_of_any(rows, {"l_linenumber": [1], "l_linestatus": ["O"]})
    overdrawn = load(spark, folder, "supplier").filter(F.col("s_acctbal") < 0).select("s_suppkey")
    rows = project.drop_members(rows, "l_suppkey", overdrawn)
    rows = project.drop_incomplete(rows, ["l_orderkey", "l_shipdate"])
    rows = rows.withColumn("returned_tax", F.when(F.col("l_returnflag") == "R", F.col("l_tax")))
    rows = project.map_columns(rows, ["l_linestatus", "l_returnflag"], F.upper, "_code")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_suppkey", fn.row_sum(["l_quantity", "returned_tax"]).alias("row_total"), "l_linestatus_code",
        "l_returnflag_code")


@query("""
SELECT p_partkey, p_type || CASE p_type WHEN 'SMALL' THEN ', PROMO, Little' WHEN 'LARGE' THEN ', Big' ELSE '' END AS labelled FROM part
""")
def first_code_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The label of the first listed code only."""
    codes = F.when(F.col("p_type") == "SMALL", "SMALL, PROMO").otherwise(F.col("p_type"))
    labels = {"SMALL": "Little", "PROMO": "Offer", "LARGE": "Big", "STAND": "Never"}
    labelled = fn.label_codes(codes, labels, first_only=True)
    return load(spark, folder, "part").select(
        "p_partkey", F.when(F.col("p_type") == "PROMO", F.lit("PROMO")).otherwise(labelled).alias("labelled"))


@query("""
SELECT p_partkey, p_type || CASE p_type WHEN 'SMALL' THEN ', PROMO, Little, Offer' WHEN 'LARGE' THEN ', Big' ELSE '' END AS labelled
FROM part
""")
def code_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of exact codes; a code that only contains another one gets no label."""
    codes = F.when(F.col("p_type") == "SMALL", "SMALL, PROMO").otherwise(F.col("p_type"))
    labels = {"SMALL": "Little", "PROMO": "Offer", "LARGE": "Big", "STAND": "Never"}
    labelled = fn.label_codes(codes, labels)
    return load(spark, folder, "part").select(
        "p_partkey", F.when(F.col("p_type") == "PROMO", F.lit("PROMO")).otherwise(labelled).alias("labelled"))


@query("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'tech' WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'out' ELSE 'in' END AS tier,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#9') THEN 'One' WHEN p_brand = 'Brand#2' THEN 'Two' ELSE p_brand END AS brand_group,
  CASE WHEN p_type = 'SMALL' THEN 'S' WHEN p_brand = 'Brand#3' THEN 'B3' ELSE 'none' END AS rule
FROM part
""")
def entity_rules(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "part").select(
        "p_partkey", fn.classify_tiers("p_type", ["STANDARD", "ECONOMY"], {"tech": ["PROMO"]}, "out", "in").alias("tier"),
        fn.recode("p_brand", {"One": ["Brand#1", "Brand#9"], "Two": ["Brand#2"]}).alias("brand_group"),
        fn.first_rule([("p_type", "SMALL", "S"), ("p_brand", "Brand#3", "B3")], "none").alias("rule"))


# ---- joins ----

@query("""
SELECT n_name, r_name, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey
  LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name, r_name
""")
def reference_list(spark: SparkSession, folder: str) -> DataFrame:
    """A right join keeps all rows of the reference list; a natural join finds its own key; keys with other names drop out."""
    rich = load(spark, folder, "customer").filter(F.col("c_acctbal") > 9000)
    listed = joins.join_on(
        rich.select("c_custkey", "c_nationkey"), load(spark, folder, "nation"), {"c_nationkey": "n_nationkey"}, "right")
    regions = load(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.join_natural(listed, regions).groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"))


@query("""
SELECT o_custkey, coalesce(count(*) FILTER (o_orderstatus = 'O'), 0) AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_done
FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_custkey
""")
def align_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Two equally keyed results side by side."""
    orders = load(spark, folder, "orders")
    parts = [aggregate.count_by(orders.filter(F.col("o_orderstatus") == s), ["o_custkey"], n) for s, n in (("O", "n_open"), ("F", "n_done"))]
    return project.fill_nulls(joins.align_columns(parts, ["o_custkey"]), 0, ["n_open", "n_done"])


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN o_orderstatus ELSE 'X' END AS o_orderstatus
FROM orders
""")
def replace_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without lines are repaired and put back."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    fixed = joins.drop_matching(orders, lines, ["o_orderkey"]).withColumn("o_orderstatus", F.lit("X"))
    return joins.replace_rows(orders, fixed, ["o_orderkey"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
""")
def keep_matching(spark: SparkSession, folder: str) -> DataFrame:
    promo = load(spark, folder, "part").filter(F.col("p_type") == "PROMO").select(F.col("p_partkey").alias("l_partkey"))
    return joins.keep_matching(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), promo, ["l_partkey"])


@query("""
SELECT o_custkey, count(*) AS n, round(count(*) / (SELECT avg(k) FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey)), 8) AS of_mean
FROM orders GROUP BY o_custkey
""")
def apply_scalar(spark: SparkSession, folder: str) -> DataFrame:
    """One global mean used on every row."""
    counted = aggregate.count_by(load(spark, folder, "orders"), ["o_custkey"])
    mean = counted.agg(F.avg("n").alias("m"))
    return joins.with_scalar(counted, "mean", mean).select("o_custkey", "n", F.round(fn.ratio("n", "mean"), 8).alias("of_mean"))


# ---- aggregates ----

@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) AS total_price,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) / count(*) AS mean_price, min(l_shipdate) AS first_day,
  max(l_shipdate) AS last_day, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def group_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        fn.exact_sum("l_extendedprice").alias("total_price"), fn.exact_mean("l_extendedprice").alias("mean_price"),
        F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""
SELECT source, count(doc_id) AS doc_id, count(quality) AS quality, count(toxic) AS toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def count_non_null(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "documents").select("doc_id", "source").join(load(spark, folder, "labels"), "doc_id", "left")
    return aggregate.count_non_null_by(rows, ["source"])


@query("""
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities,
  string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS states FROM orders GROUP BY o_custkey
""")
def concat_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.concat_distinct_by(
        load(spark, folder, "orders"), ["o_custkey"], {"priorities": "o_orderpriority", "states": "o_orderstatus"})


@query("""
WITH named AS (SELECT DISTINCT o_orderpriority, CAST(o_custkey AS VARCHAR) AS v FROM orders),
placed AS (SELECT *, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY v) - 1) // 100 + 1 AS INTEGER) AS part FROM named)
SELECT o_orderpriority, part, string_agg(v, ', ' ORDER BY v) AS customers FROM placed GROUP BY o_orderpriority, part
""")
def concat_in_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Five groups of very many values, in texts of a hundred."""
    return aggregate.texts_in_parts(load(spark, folder, "orders"), ["o_orderpriority"], "o_custkey", "customers", most=100)


@query("""
SELECT c_mktsegment, o_orderpriority, CAST(count(*) AS BIGINT) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY c_mktsegment) AS DOUBLE) AS share
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority
""")
def share_in_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders").join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return ranking.share_in_group(aggregate.count_by(rows, ["c_mktsegment", "o_orderpriority"]), ["c_mktsegment"], "n", "share")


# ---- ranks ----

@query("""
SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3
""")
def top_n_per_group(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.top_n_per_group(orders, ["o_custkey"], "o_totalprice", ["o_orderkey"], 3, "place")


@query("""
SELECT o_custkey, o_orderkey, o_orderdate FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)
""")
def latest_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """Newest orders of each customer, ties kept."""
    return ranking.latest_per_group(
        load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) > 1 AS is_duplicate FROM events
""")
def mark_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.mark_duplicates(load(spark, folder, "events"), ["user_id", "event_type", "props"], ["event_id"]).select(
        "event_id", "is_duplicate")


# ---- shapes ----

@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id
""")
def pivot_wide(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.pivot_wide(load(spark, folder, "events"), ["user_id"], "event_type", ["click", "view"])


@query("""
WITH w AS (
  SELECT user_id, count(*) FILTER (event_type = 'click') AS click_count, count(*) FILTER (event_type = 'view') AS view_count, count(*) AS n
  FROM events GROUP BY user_id
)
SELECT user_id, 'click' AS name, click_count AS count, click_count / CAST(n AS DOUBLE) AS per FROM w
UNION ALL SELECT user_id, 'view', view_count, view_count / CAST(n AS DOUBLE) FROM w
""")
def pair_columns(spark: SparkSession, folder: str) -> DataFrame:
    """``*_count`` columns matched with their ``*_per`` twins by name."""
    counts = reshape.pivot_wide(load(spark, folder, "events").withColumn("any", F.lit("n")), ["user_id"], "event_type",
                                {"click": "click_count", "view": "view_count"})
    total = aggregate.count_by(load(spark, folder, "events"), ["user_id"])
    wide = counts.join(total, "user_id").withColumns({
        "click_per": fn.ratio("click_count", "n"), "view_per": fn.ratio("view_count", "n")})
    return reshape.unpivot_twins(wide, ["user_id"])


@query("""
SELECT doc_id, line AS line_text, CAST(length(line) AS INTEGER) AS line_size_letters, line LIKE '%,%' AS has_comma
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
""")
def unnest_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a text as an array of nested structs, then as flat rows."""
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(
        F.struct(t.alias("text"), F.struct(F.length(t).alias("letters")).alias("size")).alias("line"),
        F.contains(t, F.lit(",")).alias("has_comma")))
    nested = load(spark, folder, "documents").select("doc_id", lines.alias("lines"))
    return reshape.flatten_struct(reshape.unnest(nested, "lines"))


@query("""
SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS thing, CAST(NULL AS VARCHAR) AS rest FROM part
""")
def split_to_columns(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.split_to_columns(load(spark, folder, "part").select("p_partkey", "p_name"), "p_name", r"\s+", ["colour", "thing", "rest"])


@query("""
SELECT p_brand, word, count(*) AS count FROM (SELECT DISTINCT p_brand, p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL
""")
def item_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words of part names per brand, each part counted once per word."""
    parts = load(spark, folder, "part").withColumnRenamed("p_name", "word")
    return reshape.item_counts(parts, ["p_brand"], "p_partkey", "word", " ")


# ---- stacks ----

@query("""
SELECT c_nationkey AS nationkey, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_nationkey, s_name, NULL FROM supplier
""")
def union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of different width stacked by name."""
    customers = load(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"))
    suppliers = load(spark, folder, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"))
    return combine.union_by_name(customers, suppliers)


@query("SELECT DISTINCT text FROM documents")
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return combine.distinct_values(load(spark, folder, "documents"), "text")


@query("SELECT DISTINCT l_orderkey, l_suppkey, l_linestatus FROM lineitem")
def distinct_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus", "l_linenumber")
    return combine.distinct_rows(rows, ignore=["l_linenumber"])
