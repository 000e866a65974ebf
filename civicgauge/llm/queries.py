"""One query for each operator, with production parameters over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.llm import (
    bpe, fingerprints, manifest, mixing, near_duplicates, page_text, personal_data, prefix_trie, quality_classifier, quality_rules, secrets,
    token_counts, vector_links,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe.round_trip_digests(table(spark, folder, "documents"))


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every text."""
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("row_number", "text_hash")


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every text; a token over a line's end counts where its first character is."""
    counts = token_counts.line_token_counts(table(spark, folder, "documents"))
    return counts.withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query
def op4_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extract(table(spark, folder, "pages"))


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every text; labels of the held-out fold are not learnt from."""
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Domain posteriors, rate and copies of every text."""
    labels = table(spark, folder, "labels").withColumn("domain", mixing.domain_of_labels())
    return mixing.mix(table(spark, folder, "documents"), labels).drop("row_number", "text_hash")


@query
def op7_vector_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector: equal labels, cosine of at least 0.98."""
    return vector_links.near_vectors(table(spark, folder, "embeddings"))


ORACLES["op7_vector_links"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
units AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM usable),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, n.component_id, e.vec_id = n.component_id AS kept
FROM embeddings e JOIN named n USING (vec_id) LEFT JOIN counted c USING (vec_id)
"""


@query
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every text; the trees are trained on the table's own base spans."""
    docs = table(spark, folder, "documents")
    return personal_data.find(docs, personal_data.learn(docs))


@query
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every text."""
    return secrets.find(table(spark, folder, "documents"))


@query
def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every text: 3-word shingles, 85 % of the union shared."""
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), shingle=3, per_cent=85)


ORACLES["op10_near_duplicates"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * common >= 85 * (len(x.s) + len(y.s) - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


@query
def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they and the next text's are."""
    return fingerprints.with_following(table(spark, folder, "documents"))


def crc32_of(number: Column) -> Column:
    """Unsigned CRC-32 of an id's decimal digits."""
    return F.crc32(number.cast("string"))


@query
def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether rows altered in every fifth place by their ids still verify."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.when(crc32_of(F.col("doc_id")) % 5 == 0, lowered).otherwise(F.col("text"))
    proven = manifest.manifest(table(spark, folder, "documents"), altered={"text": altered})
    return manifest.verify(proven, "altered_leaf").select(
        "doc_id", "leaf", "subroot", "root", manifest.path_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of conversations that begin with up to three turns of their block's first conversation."""
    turns = prefix_trie.turns_of(table(spark, folder, "conversations"))
    rebuilt = prefix_trie.share_heads(turns, F.col("conv") - F.col("conv") % 20, crc32_of(F.col("conv")) % 4)
    return prefix_trie.trie(rebuilt)


def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal digits in SQL: eight shifts for each digit."""
    shifts = "list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))"
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {digits}), lambda c, d: {shifts}), 4294967295)"


def _piece(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_LEVELS = 6  # sixteen to the sixth rows of a source, and as many sources


def _levels(name: str, keys: str, count: int) -> str:
    """CTEs ``name0`` (given: keys, pos, digest) to ``name{count}``, each the level above; a finished tree stays as it is."""
    partition = f"PARTITION BY {keys}" if keys else ""
    group = f"{keys}, " if keys else ""
    return "".join(f""",
{name}{k + 1} AS (
  SELECT {group}CASE WHEN n > 1 THEN pos // 16 ELSE pos END AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos_below)) ELSE any_value(digest) END AS digest
  FROM (SELECT *, pos AS pos_below, count(*) OVER ({partition}) AS n FROM {name}{k})
  GROUP BY {group}n, CASE WHEN n > 1 THEN pos // 16 ELSE pos END)""" for k in range(count))


def _sides(name: str, keys: str, count: int) -> str:
    """CTEs ``name_way{k}``: what stands before and after each node in its run, null in a finished tree."""
    partition = f"{keys}, " if keys else ""
    whole = f"PARTITION BY {keys}" if keys else ""
    return "".join(f""",
{name}_way{k} AS (
  SELECT {partition}pos, count(*) OVER ({whole}) AS n,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{k} WINDOW run AS (PARTITION BY {partition}pos // 16 ORDER BY pos))""" for k in range(count))


def _climb(name: str, own: str, join: str, first: str, count: int) -> str:
    """CTEs that take a row's digest and proof up the levels of its tree."""
    return "".join(f""",
{own}{k + 1} AS (
  SELECT o.* EXCLUDE (here, proof, folded), CASE WHEN w.n > 1 THEN here // 16 ELSE here END AS here,
    CASE WHEN w.n > 1 THEN proof || w.before || w.after ELSE proof END AS proof,
    CASE WHEN w.n > 1 THEN sha256(w.before || folded || w.after) ELSE folded END AS folded
  FROM {first if k == 0 else f'{own}{k}'} o JOIN {name}_way{k} w ON {join}w.pos = here)""" for k in range(count))


ORACLES["op12_manifest"] = f"""
WITH named AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree,
    sha256({' || '.join(_piece(c) for c in manifest.FIELDS)}) AS leaf,
    sha256({' || '.join(_piece(c) for c in manifest.FIELDS[:-1])} || {_piece("CASE WHEN " + _crc32("doc_id") + " % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS altered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos FROM named),
leaves0 AS (SELECT tree, pos, leaf AS digest FROM placed){_levels("leaves", "tree", _LEVELS)}{_sides("leaves", "tree", _LEVELS)},
trees0 AS (SELECT row_number() OVER (ORDER BY tree) - 1 AS pos, tree, digest FROM leaves{_LEVELS}){_levels("trees", "", _LEVELS)}{_sides("trees", "", _LEVELS)},
start AS (SELECT doc_id, tree, leaf, pos AS here, '' AS proof, altered AS folded FROM placed){_climb("leaves", "inner", "w.tree = o.tree AND ", "start", _LEVELS)},
upper AS (SELECT i.* EXCLUDE (here), t.pos AS here, t.digest AS subroot FROM inner{_LEVELS} i JOIN trees0 t USING (tree)){_climb("trees", "outer", "", "upper", _LEVELS)}
SELECT doc_id, leaf, subroot, (SELECT digest FROM trees{_LEVELS}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT digest FROM trees{_LEVELS}) AS verified
FROM outer{_LEVELS}
"""

ORACLES["op13_prefix_trie"] = f"""
WITH said AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS d,
    struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(said ORDER BY d) AS own FROM said GROUP BY c),
headed AS (SELECT c, own, c - c % 20 AS base, {_crc32("c")} % 4 AS h FROM lists),
rebuilt AS (
  SELECT x.c, list_concat(coalesce(list_slice(b.own, 1, h), []), list_slice(x.own, h + 1, len(x.own))) AS turns
  FROM headed x LEFT JOIN lists b ON b.c = x.base),
members AS (SELECT c, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS d, turns FROM rebuilt),
prefixes AS (SELECT c, d, size, list_slice(turns, 1, d) AS seq FROM members),
nodes AS (
  SELECT seq, d, count(*) AS n_convs, min(c) AS conv_id, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = size), '') AS ends,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(seq[d].t, '[ \t-\r]+'), lambda w: w <> '')) END AS saved
  FROM prefixes GROUP BY seq, d),
children AS (SELECT list_slice(seq, 1, d - 1) AS seq, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (seq)),
above AS (SELECT list_slice(seq, 1, unnest(range(0, d + 1))) AS seq, n_children = 0 AS leaf, saved FROM counted),
sums AS (SELECT seq, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY seq)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN sums s USING (seq) LEFT JOIN nodes p ON n.d > 0 AND p.seq = list_slice(n.seq, 1, n.d - 1)
"""
