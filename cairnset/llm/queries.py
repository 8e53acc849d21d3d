"""Queries of the problems on training text, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.llm import encode, incremental, mixing, nearduplicates, splitting, survivors
from cairnset.sources.tables import table


def _merge_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("merges", "claims", "tools", "void_terms")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.merge_survivors(*_merge_tables(spark, d))


def p2_layers(spark: SparkSession, d: str) -> DataFrame:
    """The dominance layers that fill the fields, of each group's points: of equal completeness and trust only the most recent claim is one."""
    layers = survivors.dominance_layers(survivors.group_points(*_merge_tables(spark, d)))
    return layers.select("merge_key", "claim_ord", "layer")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearduplicates.every_pair(*nearduplicates.similar_claims(table(spark, d, "claims")))
    return pairs.select(F.col("a").alias("claim_ord_a"), F.col("b").alias("claim_ord_b"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of each claim: with p3_links the same as p3_found, in proportion to the claims."""
    return nearduplicates.claim_members(table(spark, d, "claims")).withColumnRenamed("id", "claim_ord")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Classes of p3_members that are near: two claims are a pair if their reps are equal or linked."""
    links, _ = nearduplicates.similar_claims(table(spark, d, "claims"))
    return links.select(F.col("id_a").alias("rep_a"), F.col("id_b").alias("rep_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.repeated_entries(table(spark, d, "intake_entries"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return encode.count_tokens(table(spark, d, "documents"), ["doc_id"], "text")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(*mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "documents"), "doc_id", "text")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "documents"), "doc_id", "text")


TRIM = "' ' || chr(9) || chr(10) || chr(13)"

P2_SQL = f"""WITH ids AS (
  SELECT DISTINCT merge_key, trim(x, {TRIM}) AS claim_id FROM (SELECT merge_key, unnest(claim_ids) AS x FROM merges)
  WHERE merge_key IS NOT NULL AND trim(x, {TRIM}) <> ''),
titles AS (
  SELECT DISTINCT merge_key, trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t
  FROM (SELECT merge_key, unnest(titles) AS x FROM merges)),
members AS (
  SELECT merge_key, claim_ord, recorded_at, trim(title, {TRIM}) AS title, trim(weakness, {TRIM}) AS weakness,
         trim(severity, {TRIM}) AS severity, coalesce(tools.trust, 0) AS trust
  FROM ids JOIN claims USING (claim_id) LEFT JOIN tools ON lower(trim(claims.tool, {TRIM})) = tools.tool),
vals AS (
  SELECT merge_key, claim_ord, recorded_at, trust, 'title' AS field_name, title AS v FROM members m
  WHERE EXISTS (FROM titles WHERE titles.merge_key = m.merge_key AND t = regexp_replace(m.title, '[ \\t\\r\\n]+', ' ', 'g'))
  UNION ALL SELECT merge_key, claim_ord, recorded_at, trust, 'weakness', weakness FROM members
  UNION ALL SELECT merge_key, claim_ord, recorded_at, trust, 'severity', severity FROM members)
SELECT merge_key, field_name, claim_ord FROM vals
WHERE v <> '' AND lower(v) NOT IN (SELECT term FROM void_terms)
QUALIFY row_number() OVER (PARTITION BY merge_key, field_name ORDER BY trust DESC, recorded_at DESC NULLS LAST, claim_ord) = 1"""

P2_LAYERS_SQL = P2_SQL[: P2_SQL.index("vals AS (")] + """rated AS (
  SELECT merge_key, claim_ord, trust, recorded_at, coalesce(weakness <> '' AND lower(weakness) NOT IN (SELECT term FROM void_terms), false) AS w,
    coalesce(severity <> '' AND lower(severity) NOT IN (SELECT term FROM void_terms), false) AS s,
    coalesce(title <> '' AND lower(title) NOT IN (SELECT term FROM void_terms), false) AND EXISTS (
      FROM titles WHERE titles.merge_key = m.merge_key AND t = regexp_replace(m.title, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM members m),
pts AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY merge_key, t, w, s, trust ORDER BY recorded_at DESC NULLS LAST, claim_ord) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY merge_key ORDER BY recorded_at DESC NULLS LAST, claim_ord) AS r FROM pts),
above AS (
  SELECT p.merge_key, p.claim_ord, q.claim_ord AS by FROM ranked p JOIN ranked q ON p.merge_key = q.merge_key AND q.r < p.r
  WHERE q.trust >= p.trust AND q.t >= p.t AND q.w >= p.w AND q.s >= p.s),
lay AS (
  SELECT merge_key, claim_ord, 1 AS layer FROM pts
  UNION SELECT a.merge_key, a.claim_ord, layer + 1 FROM lay l JOIN above a ON a.merge_key = l.merge_key AND a.by = l.claim_ord)
SELECT merge_key, claim_ord, max(layer) AS layer FROM lay GROUP BY ALL"""
P2_LAYERS_SQL = P2_LAYERS_SQL.replace("WITH ids", "WITH RECURSIVE ids", 1)

QUERIES = {
    "p2_found": p2_found,
    "p2_layers": p2_layers,
    "p3_found": p3_found,
    "p3_members": p3_members,
    "p3_links": p3_links,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p6_counts": p6_counts,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
}
P3_SQL = """WITH w AS (
  SELECT claim_ord, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(raw_text, '')), '[a-z0-9]+') AS w FROM claims),
s AS (
  SELECT DISTINCT claim_ord, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM w WHERE len(w) >= 20),
n AS (SELECT claim_ord, count(*) AS n FROM s GROUP BY claim_ord),
c AS (SELECT a.claim_ord AS x, b.claim_ord AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.claim_ord < b.claim_ord GROUP BY ALL)
SELECT x AS claim_ord_a, y AS claim_ord_b FROM c JOIN n p ON p.claim_ord = x JOIN n q ON q.claim_ord = y WHERE 2 * k >= p.n + q.n - k"""

SQL: dict[str, str] = {"p2_found": P2_SQL, "p2_layers": P2_LAYERS_SQL, "p3_found": P3_SQL}
