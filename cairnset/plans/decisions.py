"""Queries about the queue, anchors and bindings, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions.digest import text_digest
from cairnset.operators import baseline, binding, callgraph, locators, queue
from cairnset.plans import triage
from cairnset.plans.sites import DOCUMENTS, DOCUMENTS_NOW, GONE, GRAPH, NOW, SITES, DocumentTree, GivenSites, varchar
from cairnset.session import cut

BEFORE, AFTER, WHOLE = 10, 20, 40  #: fixed values: lines shown before and after a cited line, and after a function's first

# The queue


def _items(sites: GivenSites) -> DataFrame:
    return queue.items(sites.named, sites.claims, triage.evidence(sites), sites.resolved)


def triage_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(GivenSites(spark, d))


def item_members(spark: SparkSession, d: str) -> DataFrame:
    sites = GivenSites(spark, d)
    return queue.members(sites.named, sites.claims, triage.evidence(sites))


def queue_totals(spark: SparkSession, d: str) -> DataFrame:
    sites = GivenSites(spark, d)
    return queue.totals(_items(sites), triage.identity.related_sites(sites.named))


def merge_members(spark: SparkSession, d: str) -> DataFrame:
    """The claim ids of each group of at least two claims, numbered in order of arrival."""
    sites = GivenSites(spark, d)
    several = sites.named.groupBy("identity_key").agg(F.count("*").alias("size")).where("size > 1").select("identity_key")
    numbered = triage.identity.numbered_items(sites.named.join(several, "identity_key", "left_semi"))
    return numbered.join(sites.claims.select("ord", "claim_id"), "ord").select("identity_key", "n", "claim_id")


def assessments(spark: SparkSession, d: str) -> DataFrame:
    sites = GivenSites(spark, d)
    return queue.assessments(sites.claims, triage.evidence(sites))


def settled_by_tool(spark: SparkSession, d: str) -> DataFrame:
    """Per tool the claims, and how many of the two questions are settled for one on average."""
    sites = GivenSites(spark, d)
    settled = triage.evidence(sites).where("answer <> 'not_established'").groupBy("ord").agg(F.count("*").alias("s"))
    joined = sites.claims.select("ord", "tool").join(settled, "ord", "left").groupBy("tool")
    return joined.agg(F.count("*").alias("claims"), F.round(F.coalesce(F.sum("s"), F.lit(0)) / F.count("*"), 6).alias("settled_per_claim"))


def record_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row per claim, ready to write: what it cites, how that resolves, and an undetermined disposition."""
    sites = GivenSites(spark, d)
    counts = locators.resolution_counts(sites.resolved)
    joined = sites.claims.select("ord", "claim_id", "tool", "title").join(counts, "ord", "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", *locators.RESOLUTIONS)]
    return joined.select("ord", "claim_id", "tool", "title", *numbers, F.lit("undetermined").alias("status"))


# Anchors, bindings and context: over documents as files


def anchor_rows(spark: SparkSession, d: str) -> DataFrame:
    tree = DocumentTree(spark, d)
    return baseline.anchor_rows(tree.resolved, tree.functions, tree.cells)


def anchor_states(spark: SparkSession, d: str) -> DataFrame:
    """What became of each anchor in the tree as it is now: absent, unchanged, moved or changed."""
    tree = DocumentTree(spark, d)
    anchors = cut(baseline.anchor_rows(tree.resolved, tree.functions, tree.cells))
    return baseline.anchor_states(anchors, tree.functions_now, tree.cells_now).select("ord", "pos", "locator", "symbol_now", "span_state")


_RECORDED = "CASE WHEN doc % 2 = 0 THEN 'record' ELSE 'assessment' END"


def _then(tree: DocumentTree) -> DataFrame:
    """Recorded artifacts; every 19th digest was not written down."""
    content = tree.files.select("doc", "path", F.encode("text", "UTF-8").alias("content"))
    made = binding.artifacts(content.selectExpr(f"{_RECORDED} AS role", "path"), content)
    return made.selectExpr("role", "path", "CASE WHEN cast(regexp_extract(path, '([0-9]+)', 1) AS bigint) % 19 <> 0 THEN sha256 END AS sha256", "size")


def _now(tree: DocumentTree) -> DataFrame:
    return tree.files.where(f"NOT {GONE}").selectExpr("path", f"encode({NOW}, 'UTF-8') AS content")


def artifact_rows(spark: SparkSession, d: str) -> DataFrame:
    return _then(DocumentTree(spark, d))


def verify_artifacts(spark: SparkSession, d: str) -> DataFrame:
    tree = DocumentTree(spark, d)
    return binding.check_artifacts(_then(tree), _now(tree))


def _span_checks(tree: DocumentTree) -> DataFrame:
    quoted = baseline.quoted_citations(tree.resolved).select("ord", "pos", "locator", F.col("content_hash").alias("sha256"))
    return binding.check_spans(cut(quoted), tree.cells_now)


def verify_spans(spark: SparkSession, d: str) -> DataFrame:
    return _span_checks(DocumentTree(spark, d))


def verify_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Per claim one verdict over the spans it quotes and the files they are in; a claim without any is unverifiable."""
    tree = DocumentTree(spark, d)
    spans = cut(_span_checks(tree))
    cited = spans.select("ord", F.regexp_replace("locator", ":.*", "").alias("path")).distinct()
    files = cited.join(binding.check_artifacts(_then(tree), _now(tree)), "path").select("ord", "verdict")
    claims = tree.citations.select("ord").distinct()
    return binding.bindings(claims, spans.select("ord", "verdict").unionAll(files), "ord")


def context_spans(spark: SparkSession, d: str) -> DataFrame:
    """The lines that show a claim's first position: its function from the first line on, else those around it."""
    tree = DocumentTree(spark, d)
    counts = locators.file_counts(tree.cells)
    found = cut(locators.resolutions(tree.citations, counts).where("resolution = 'resolves' AND line_count IS NOT NULL"))
    around = callgraph.enclosing(found.selectExpr("ord", "pos", "file AS path", "start_line AS line"), tree.functions)
    order = F.struct(F.col("name").isNull(), "pos")
    first = around.groupBy("ord").agg(F.min_by(F.struct("path", "line", "name", "start_line", "end_line"), order).alias("p")).select("ord", "p.*")
    shown = first.join(counts.withColumnRenamed("file", "path"), "path").select(
        "ord", F.col("path").alias("file"), "name",
        F.coalesce("start_line", F.greatest(F.lit(1), F.col("line") - BEFORE)).alias("first"),
        F.least(F.coalesce("end_line", F.col("line") + AFTER), F.coalesce(F.col("start_line") + WHOLE, F.col("line") + AFTER), "line_count").alias("last"),
    )
    texts = locators.span_texts(shown, tree.cells).select("file", "first", "last", text_digest(F.col("text")).alias("digest"))
    return shown.join(texts, ["file", "first", "last"]).select("ord", "file", F.col("name").alias("function"), "first", "last", "digest")


_ITEMS = f"""{triage.NAMED}, ev AS (
  SELECT ord, 'component_present' AS question, answer FROM ({triage.COMPONENT}) UNION ALL SELECT ord, 'reachable', answer FROM ({triage.REACH})),
sps AS (SELECT ord, count(*) AS spans, count_if(resolution <> 'resolves') AS broken FROM res GROUP BY ord),
ans AS (SELECT ord, count_if(answer <> 'not_established')::BIGINT AS settled, count_if(answer = 'supports')::BIGINT AS candidates FROM ev GROUP BY ord),
grp AS (SELECT identity_key, kind, min(ord) AS ord, count(*) AS members, count(DISTINCT run_id) AS runs FROM idn GROUP BY ALL),
items AS (
  SELECT g.identity_key, g.kind, g.ord, title, members, coalesce(settled, 0) AS settled, coalesce(candidates, 0) AS candidates,
    CASE WHEN runs < 2 THEN 'new' WHEN coalesce(spans, 0) = 0 OR broken > 0 THEN 'stale' ELSE 'carried' END AS state
  FROM grp g JOIN idn USING (ord) LEFT JOIN sps USING (ord) LEFT JOIN ans USING (ord))"""
_REL = "SELECT anchor FROM idn WHERE anchor IS NOT NULL GROUP BY anchor HAVING count(DISTINCT identity_key) > 1"
_ANCHORS = varchar(f"""{DOCUMENTS},
penc AS (
  SELECT ord, pos, arg_min({{'n': name, 's': s, 'e': e, 'l': fn.l}}, {{'l': e - s, 'q': seq, 'n': name}}) AS f
  FROM res JOIN fn ON res.path = fn.path AND start_line BETWEEN s AND e WHERE content_hash IS NOT NULL GROUP BY ord, pos),
anchors AS (
  SELECT ord, pos, locator, path, path AS file, content_hash AS sha256, f.n AS symbol,
    CASE WHEN f IS NOT NULL THEN 'sha256:' || sha256(array_to_string(f.l[f.s:f.e], chr(10))) END AS symbol_sha256
  FROM res LEFT JOIN penc USING (ord, pos) WHERE content_hash IS NOT NULL)""")
_NOW = _ANCHORS + varchar(f""", {DOCUMENTS_NOW},
sym AS (SELECT path, name, 'sha256:' || sha256(any_value(array_to_string(l[s:e], chr(10)))) AS symbol_now FROM fnow GROUP BY path, name HAVING count(*) = 1),
recd AS (
  SELECT doc, {_RECORDED} AS role, path, CASE WHEN doc % 19 <> 0 THEN 'sha256:' || sha256(text) END AS sha256, octet_length(encode(text))::BIGINT AS size
  FROM (SELECT doc, path, text FROM files JOIN (SELECT doc_id, text FROM documents) ON doc_id = doc)),
filenow AS (SELECT path, sha256(t) AS h FROM (SELECT doc, path, {NOW.replace(chr(92) + 'n', "' || chr(10) || '")} AS t
  FROM (SELECT doc, path, text FROM files JOIN (SELECT doc_id, text FROM documents) ON doc_id = doc) WHERE NOT ({GONE}))),
fchecks AS (
  SELECT role, r.path, CASE WHEN r.sha256 IS NULL OR h IS NULL THEN 'unverifiable' WHEN r.sha256 = 'sha256:' || h THEN 'verified' ELSE 'contradicted' END AS verdict
  FROM recd r LEFT JOIN filenow n ON n.path = r.path),
schecks AS (
  SELECT ord, pos, locator, a.path, CASE WHEN g.content_hash IS NULL THEN 'unverifiable' WHEN g.content_hash = a.sha256 THEN 'verified' ELSE 'contradicted' END AS verdict
  FROM anchors a JOIN (SELECT ord, pos, content_hash FROM again) g USING (ord, pos))""")

SQL = {
    "triage_items": f"WITH {_ITEMS} SELECT * FROM items",
    "item_members": f"""WITH {_ITEMS} SELECT identity_key, n, ord, claim_id, CASE WHEN n = 1 THEN settled END AS settled
      FROM (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY ord) AS n FROM idn) LEFT JOIN ans USING (ord)""",
    "queue_totals": f"""WITH {_ITEMS} SELECT sum(members)::BIGINT AS claims_in, count(*) AS items, count_if(members > 1)::BIGINT AS merges,
      count_if(state = 'new')::BIGINT AS "new", count_if(state = 'carried')::BIGINT AS carried, count_if(state = 'stale')::BIGINT AS stale,
      (SELECT count(*) FROM ({_REL})) AS related_sites FROM items""",
    "merge_members": f"""WITH {triage.NAMED} SELECT identity_key, row_number() OVER (PARTITION BY identity_key ORDER BY ord) AS n, claim_id
      FROM idn QUALIFY count(*) OVER (PARTITION BY identity_key) > 1""",
    "assessments": f"""WITH {triage.EVIDENCE}, q AS (SELECT unnest(range({len(queue.QUESTIONS)}))::INT AS question_no, unnest({queue.QUESTIONS}) AS question)
      SELECT c.claim_ord AS ord, question_no, q.question, coalesce(answer, 'not_established') AS answer
      FROM claims c JOIN q ON true LEFT JOIN ev ON ev.ord = c.claim_ord AND ev.question = q.question""",
    "settled_by_tool": f"""WITH {_ITEMS} SELECT tool, count(*) AS claims, round(coalesce(sum(settled), 0) / count(*), 6) AS settled_per_claim
      FROM idn LEFT JOIN ans USING (ord) GROUP BY tool""",
    "record_rows": f"""WITH {SITES} SELECT claim_ord AS ord, claim_id, nullif(lower(trim(tool, {triage.TRIM})), '') AS tool, title, coalesce(total, 0) AS total,
      {', '.join(f'coalesce({r}, 0) AS {r}' for r in locators.RESOLUTIONS)}, 'undetermined' AS status FROM claims LEFT JOIN (SELECT ord, count(*) AS total,
      {', '.join(f"count_if(resolution = '{r}')::BIGINT AS {r}" for r in locators.RESOLUTIONS)} FROM res GROUP BY ord) ON ord = claim_ord""",
    "anchor_rows": f"WITH {_ANCHORS} SELECT * FROM anchors",
    "anchor_states": f"""WITH {_NOW} SELECT ord, pos, a.locator, s.symbol_now, CASE WHEN g.content_hash IS NULL THEN 'absent'
      WHEN g.content_hash = a.sha256 THEN CASE WHEN a.symbol_sha256 IS NOT NULL AND s.symbol_now IS DISTINCT FROM a.symbol_sha256 THEN 'changed' ELSE 'unchanged' END
      WHEN s.symbol_now = a.symbol_sha256 THEN 'moved' ELSE 'changed' END AS span_state
      FROM anchors a JOIN again g USING (ord, pos) LEFT JOIN sym s ON s.path = a.path AND s.name = a.symbol""",
    "artifact_rows": f"WITH {_NOW} SELECT role, path, sha256, size FROM recd",
    "verify_artifacts": f"WITH {_NOW} SELECT role, path, verdict FROM fchecks",
    "verify_spans": f"WITH {_NOW} SELECT ord, pos, locator, verdict FROM schecks",
    "verify_bindings": f"""WITH {_NOW}, c AS (SELECT ord, verdict FROM schecks UNION ALL SELECT ord, f.verdict FROM (SELECT DISTINCT ord, path FROM schecks) JOIN fchecks f USING (path))
      SELECT ord, count(verdict) AS checks, CASE WHEN count(verdict) = 0 OR bool_or(verdict = 'unverifiable') THEN 'unverifiable' WHEN bool_or(verdict = 'contradicted') THEN 'contradicted' ELSE 'verified' END AS verdict
      FROM (SELECT DISTINCT ord FROM cit) LEFT JOIN c USING (ord) GROUP BY ord""",
    "context_spans": f"""WITH {DOCUMENTS}, e AS (
        SELECT ord, pos, path, line_count, start_line AS line, l, arg_min({{'n': name, 's': s, 'e': e}}, {{'l': e - s, 'q': seq, 'n': name}}) AS f
        FROM (SELECT r.*, fn.name, fn.s, fn.e, fn.seq FROM res r LEFT JOIN fn ON r.path = fn.path AND start_line BETWEEN s AND e WHERE resolution = 'resolves' AND line_count IS NOT NULL) GROUP BY ALL),
      p AS (SELECT *, f.n AS name FROM e QUALIFY row_number() OVER (PARTITION BY ord ORDER BY f.n IS NULL, pos) = 1),
      b AS (SELECT *, coalesce(f.s, greatest(1, line - {BEFORE})) AS first, least(coalesce(f.e, line + {AFTER}), coalesce(f.s + {WHOLE}, line + {AFTER}), line_count) AS last FROM p)
      SELECT ord, path AS file, name AS function, first, last, 'sha256:' || sha256(array_to_string(l[first:last], chr(10))) AS digest FROM b""",
}
QUERIES = {
    f.__name__: f
    for f in (
        triage_items, item_members, queue_totals, merge_members, assessments, settled_by_tool, record_rows, anchor_rows, anchor_states,
        artifact_rows, verify_artifacts, verify_spans, verify_bindings, context_spans,
    )
}
