"""Triage queries over the given tables, each with its SQL twin.

Most read the locators that the tables give (``sites.GivenSites``). The few that
need the cited text itself, which no table gives, take documents for files
(``sites.DocumentTree``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions.digest import blank_to_null, canonical_digest
from cairnset.functions.text import LINE_END, STOP_WORDS, WEAKNESS, clean_path, fenced, first_line, normalise_weakness, parse_locator, split_lines, title_tokens
from cairnset.operators import callgraph, folds, identity, locators, snapshots
from cairnset.plans.numbered import STATES_SQL, TRIM, digest_sql
from cairnset.plans.sites import DOCUMENTS, GIVEN, GRAPH, PARTS, SITES, SPELLED, DocumentTree, GivenSites, claim_rows, cleaned
from cairnset.session import cut
from cairnset.sources.tables import table

# Queries


def locator_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every locator that claims or anchors give, once, with its parts and its path cleaned."""
    given = table(spark, d, "claims").select(F.explode("locators").alias("locator")).union(table(spark, d, "span_anchors").select("locator"))
    parts = [c.alias(n) for n, c in parse_locator(F.col("locator")).items()]
    return given.distinct().select("locator", *parts).withColumn("file", clean_path(F.col("path")))


def anchored_citations(spark: SparkSession, d: str) -> DataFrame:
    """Which citations name a file that the decisions' anchors know, and how far it is known."""
    return GivenSites(spark, d).resolved.select("ord", "pos", "locator", "file", "resolution", "line_count")


def claim_locators(spark: SparkSession, d: str) -> DataFrame:
    """The locators that the claims give, as spelled, and their parts."""
    given = table(spark, d, "claims").select(F.col("claim_ord").alias("ord"), F.posexplode("locators").alias("pos", "locator"))
    return locators.parsed(given)


def anchor_locators(spark: SparkSession, d: str) -> DataFrame:
    """The locators of the decisions' anchors, as spelled, and their parts; repeated rows stay."""
    parts = [c.alias(n) for n, c in parse_locator(F.col("locator")).items()]
    return table(spark, d, "span_anchors").select("entry_row", "pos", "locator", *parts)


def site_claims(spark: SparkSession, d: str) -> DataFrame:
    """Sites that several claims cite by their own locators: path and lines, however spelled, and the claims."""
    sites = claim_locators(spark, d).where("path IS NOT NULL").groupBy("path", "start_line", "end_line")
    grouped = sites.agg(F.count_distinct("ord").alias("n_claims"), F.min("ord").alias("first_ord"))
    return grouped.where("n_claims > 1")


def resolve_status(spark: SparkSession, d: str) -> DataFrame:
    return DocumentTree(spark, d).resolved.select("ord", "pos", "resolution", "line_count", "content_hash", "truncated")


def resolution_histogram(spark: SparkSession, d: str) -> DataFrame:
    return locators.resolution_counts(GivenSites(spark, d).resolved)


def fully_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return locators.fully_unresolved(GivenSites(spark, d).resolved)


def unresolved_shown(spark: SparkSession, d: str) -> DataFrame:
    shown = locators.shown_unresolved(GivenSites(spark, d).resolved)
    return shown.select("ord", "unresolved", F.array_join("shown", "|").alias("shown"))


def first_resolved(spark: SparkSession, d: str) -> DataFrame:
    tree = DocumentTree(spark, d)
    return locators.first_quoted(locators.resolutions(tree.citations, locators.file_counts(tree.cells)))


def cwe_normalise(spark: SparkSession, d: str) -> DataFrame:
    return claim_rows(spark, d).select("ord", normalise_weakness(F.col("weakness")).alias("weakness"))


def title_words(spark: SparkSession, d: str) -> DataFrame:
    return claim_rows(spark, d).select("ord", F.array_join(title_tokens(F.col("title"), F.col("raw_text")), " ").alias("tokens"))


def identity_key(spark: SparkSession, d: str) -> DataFrame:
    return GivenSites(spark, d).named.select("ord", "identity_key", "kind", "anchor")


def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    return identity.merges(claim_rows(spark, d), GivenSites(spark, d).named)


def representative(spark: SparkSession, d: str) -> DataFrame:
    return identity.representatives(GivenSites(spark, d).named)


def numbered_members(spark: SparkSession, d: str) -> DataFrame:
    return identity.numbered_items(GivenSites(spark, d).named)


def related_sites(spark: SparkSession, d: str) -> DataFrame:
    return identity.related_sites(GivenSites(spark, d).named)


def enclosing_function(spark: SparkSession, d: str) -> DataFrame:
    return GivenSites(spark, d).around.select("ord", "pos", "line", F.col("name").alias("function"))


def callers_topk(spark: SparkSession, d: str) -> DataFrame:
    sites = GivenSites(spark, d)
    found = callgraph.callers(sites.functions, sites.calls)
    return found.select("name", "n_callers", F.array_join("callers", "|").alias("callers"))


def reachability_verdict(spark: SparkSession, d: str) -> DataFrame:
    return GivenSites(spark, d).verdicts.select("ord", "pos", "function", "verdict")


def component_answers(sites: GivenSites) -> DataFrame:
    counts = locators.resolution_counts(sites.resolved).select("ord", "total", "resolves")
    n = F.coalesce("total", F.lit(0))
    answer = F.when(n == 0, "not_established").when(F.col("resolves") == 0, "supports").otherwise("contradicts")
    return sites.claims.select("ord").join(counts, "ord", "left").select("ord", answer.alias("answer"))


def reach_answers(sites: GivenSites) -> DataFrame:
    v = F.col("verdict")
    folded = sites.verdicts.groupBy("ord").agg(
        F.when(F.bool_or(v == "reachable_from"), "contradicts").when(F.bool_or(v == "no_caller_found"), "supports")
        .otherwise("not_established").alias("answer"),
        F.min_by("function", F.when(v == "reachable_from", F.col("pos"))).alias("function"),
    )
    joined = sites.claims.select("ord").join(folded, "ord", "left")
    return joined.select("ord", F.coalesce("answer", F.lit("not_established")).alias("answer"), "function")


def evidence(sites: GivenSites) -> DataFrame:
    """(ord, question, answer) of the two questions that need no model."""
    component = component_answers(sites).select("ord", F.lit("component_present").alias("question"), "answer")
    return component.unionByName(reach_answers(sites).select("ord", F.lit("reachable").alias("question"), "answer"))


def component_evidence(spark: SparkSession, d: str) -> DataFrame:
    return component_answers(GivenSites(spark, d))


def reach_evidence(spark: SparkSession, d: str) -> DataFrame:
    return reach_answers(GivenSites(spark, d))


def answer_matrix(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["supports", "contradicts", "not_established"]
    return evidence(GivenSites(spark, d)).groupBy("question").pivot("answer", kinds).count().na.fill(0, kinds)


def citation_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per tool the citations, how many resolve, their share, and the number of each resolution."""
    by_tool = GivenSites(spark, d).resolved.select("ord", "resolution").join(claim_rows(spark, d).select("ord", "tool"), "ord")
    n, hit = F.count("*"), F.count_if(F.col("resolution") == "resolves")
    each = [F.count_if(F.col("resolution") == r).alias(r) for r in locators.RESOLUTIONS]
    return by_tool.groupBy("tool").agg(n.alias("total"), hit.alias("resolved"), F.round(hit / n, 6).alias("rate"), *each)


def _dedupe(sites: GivenSites, claims: DataFrame) -> DataFrame:
    rows = cut(sites.named.select("ord", "identity_key").join(claims.select("ord", "tool", "claim_id", "run_id"), "ord"))
    groups = rows.groupBy("tool", "identity_key").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"))
    by_group = groups.groupBy("tool").agg(
        F.sum("n").alias("claims"), F.count("*").alias("identities"), F.max("n").alias("largest"), F.count_if(F.col("runs") > 1).alias("cross_run")
    )
    ids = rows.groupBy("tool").agg(F.count_distinct("claim_id").alias("claim_ids"))
    return by_group.join(ids, by_group.tool.eqNullSafe(ids.tool)).drop(ids.tool)


def dedupe_effect(spark: SparkSession, d: str) -> DataFrame:
    sites = GivenSites(spark, d)
    return _dedupe(sites, sites.claims)


def dedupe_resolving(spark: SparkSession, d: str) -> DataFrame:
    """The same over the claims of which a citation resolves."""
    sites = GivenSites(spark, d)
    hit = sites.resolved.where("resolution = 'resolves'").select("ord").distinct()
    return _dedupe(sites, sites.claims.join(hit, "ord", "left_semi"))


def span_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each anchor of a snapshot's entries beside the same key's anchor at that locator in the next snapshot.

    Of several rows for one locator of an entry the one with the smallest pos
    counts, then the one with the largest digests, so both digests are of one row.
    """
    entries = table(spark, d, "baseline_entries")
    keyed = entries.select("snapshot_no", "entry_row", canonical_digest(F.col("identity_key")).alias("identity_key"), "status")
    current = snapshots.current_rows(keyed, "snapshot_no", "identity_key", "entry_row", ["status"])
    index = snapshots.snapshot_index(entries, "snapshot_no")
    indexed = snapshots._with_index(current, index, "snapshot_no").select("snapshot_no", "next_snapshot", "identity_key", "entry_row")
    spans = table(spark, d, "span_anchors").where("locator IS NOT NULL").select(
        "entry_row", "locator", "pos", canonical_digest(F.col("sha256")).alias("sha"), canonical_digest(F.col("symbol_sha256")).alias("symbol")
    )
    first = F.max(F.struct((-F.col("pos")).alias("p"), "sha", "symbol")).alias("f")
    grouped = indexed.join(spans, "entry_row").groupBy("snapshot_no", "next_snapshot", "identity_key", "locator").agg(first)
    anchored = cut(grouped.select("snapshot_no", "next_snapshot", "identity_key", "locator", "f.sha", "f.symbol"))
    then = anchored.where("next_snapshot IS NOT NULL").select(
        F.col("next_snapshot").alias("snapshot_no"), "identity_key", "locator", F.col("sha").alias("sha_then"), F.col("symbol").alias("symbol_then")
    )
    now = anchored.select("snapshot_no", "identity_key", "locator", "sha", "symbol")
    state = folds.span_state(F.col("sha_then"), F.col("sha"), F.col("symbol_then"), F.col("symbol"))
    return then.join(now, ["snapshot_no", "identity_key", "locator"], "left").withColumn("span_state", state)


def span_state(spark: SparkSession, d: str) -> DataFrame:
    return span_pairs(spark, d).select("snapshot_no", "identity_key", "locator", "span_state")


def baseline_state(spark: SparkSession, d: str) -> DataFrame:
    """new, stale or carried for each key of a snapshot, against the snapshot before."""
    entries = table(spark, d, "baseline_entries")
    keyed = entries.select("snapshot_no", "entry_row", canonical_digest(F.col("identity_key")).alias("identity_key"))
    current = snapshots.current_rows(keyed, "snapshot_no", "identity_key", "entry_row", [])
    indexed = snapshots._with_index(current, snapshots.snapshot_index(entries, "snapshot_no"), "snapshot_no")
    before = indexed.where("next_snapshot IS NOT NULL").select(
        F.col("next_snapshot").alias("snapshot_no"), "identity_key", F.lit(True).alias("known")
    )
    spans = span_pairs(spark, d).groupBy("snapshot_no", "identity_key").agg(
        F.count("*").alias("spans"), F.count_if(F.col("span_state").isin("absent", "changed")).alias("broken")
    )
    key = ["snapshot_no", "identity_key"]
    state = folds.entry_state(F.col("known"), F.col("spans"), F.col("broken"))
    return indexed.select(key).join(before, key, "left").join(spans, key, "left").select(*key, state.alias("state"))


def queue_summary(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("new", "stale", "carried")]
    return baseline_state(spark, d).groupBy("snapshot_no").agg(F.count("*").alias("items"), *counts)


def needs_person(spark: SparkSession, d: str) -> DataFrame:
    return baseline_state(spark, d).where("state <> 'carried'")


def last_writer_wins(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "baseline_entries").select(
        canonical_digest(F.col("identity_key")).alias("identity_key"), "entry_row", F.lower(blank_to_null(F.col("status"))).alias("status")
    )
    return folds.last_write(keyed.where("identity_key IS NOT NULL"), ["identity_key"], "entry_row")


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "baseline_entries").select("snapshot_no", canonical_digest(F.col("identity_key")).alias("identity_key"))
    return folds.repeated_keys(keyed.where("identity_key IS NOT NULL"), ["snapshot_no", "identity_key"])


def upsert_entries(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the intake laid over those of the baseline, by key, the later entry of each winning."""
    def newest(name: str, order: str) -> DataFrame:
        rows = table(spark, d, name).select(canonical_digest(F.col("identity_key")).alias("identity_key"), F.col(order).alias("o"), "title")
        return folds.last_write(rows.where("identity_key IS NOT NULL"), ["identity_key"], "o").drop("o")

    return folds.upsert(newest("baseline_entries", "entry_row"), newest("intake_entries", "entry_id"), ["identity_key"])


def undecided(spark: SparkSession, d: str) -> DataFrame:
    """Intake keys that no baseline entry decides."""
    status = F.lower(blank_to_null(F.col("status")))
    decided = table(spark, d, "baseline_entries").where(status.isin("exploitable", "not_exploitable"))
    keys = decided.select(canonical_digest(F.col("identity_key")).alias("identity_key")).distinct()
    asked = table(spark, d, "intake_entries").select(canonical_digest(F.col("identity_key")).alias("identity_key"))
    return asked.where("identity_key IS NOT NULL").distinct().join(keys, "identity_key", "left_anti")


def verdict_combine(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "unverifiable").otherwise("contradicted")
    lines = table(spark, d, "lineitem").select("l_orderkey", verdict.alias("v"))
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("checks"), folds.combine(F.col("v")).alias("verdict"))


def fence_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    return docs.select("doc_id", fenced(F.col("text"), "QUOTED").alias("quoted"))


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", first_line(F.col("text")).alias("line"), F.size(split_lines(F.col("text"))).alias("n"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """A JSON member as a number, counted by kind of event."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    rows = table(spark, d, "events").select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


# Syntax trees: no SQL twin, tested against a plain walk


def _python_files(tree: DocumentTree) -> DataFrame:
    return tree.files.where("path LIKE '%.py'").select("path", "text")


def ast_functions(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.functions_of(callgraph.parse_files(_python_files(DocumentTree(spark, d))))


def ast_calls(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.calls_of(callgraph.parse_files(_python_files(DocumentTree(spark, d))))


def ast_reachability(spark: SparkSession, d: str) -> DataFrame:
    tree = DocumentTree(spark, d)
    nodes = cut(callgraph.parse_files(_python_files(tree)))
    found = locators.resolutions(tree.citations, locators.file_counts(tree.cells)).where("resolution = 'resolves'")
    points = found.select("ord", "pos", F.col("file").alias("path"), F.coalesce("start_line", F.lit(1)).alias("line"))
    verdict = callgraph.reachability(points, callgraph.functions_of(nodes), callgraph.calls_of(nodes), callgraph.failures_of(nodes))
    return verdict.select("ord", "pos", "path", "function", "verdict")


# SQL twins

STOP = "', '".join(STOP_WORDS)
TOKENS = (
    "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(nullif(title, ''), raw_text[1:200], '')),"
    f" '[a-z0-9]+'), lambda x: x NOT IN ('{STOP}')))), '%s')"
)
CWE = f"list_sort(list_distinct(list_transform(regexp_extract_all(lower(weakness), '{WEAKNESS}', 1), lambda x: x::INT)))"
CWE = f"nullif(array_to_string(list_transform({CWE}, lambda n: 'CWE-' || n), '+'), '')"
NAMED = f"""{SITES}, {GRAPH},
anc AS (
  SELECT r.ord, coalesce(min(CASE WHEN r.start_line IS NOT NULL AND function IS NOT NULL THEN r.path || '::' || function END), min(r.path)) AS anchor
  FROM res r JOIN enc USING (ord, pos) GROUP BY r.ord),
idn0 AS (
  SELECT claim_ord AS ord, claim_id, run_id, title, weakness, nullif(lower(trim(tool, {TRIM})), '') AS tool, anchor, {CWE} AS cwe, {TOKENS % "' || chr(10) || '"} AS topic
  FROM claims LEFT JOIN anc ON ord = claim_ord),
idn AS (
  SELECT *, 'sha256:' || sha256(m) AS identity_key FROM (
    SELECT *, CASE kind WHEN 'site+weakness' THEN kind || chr(10) || anchor || chr(10) || cwe WHEN 'site' THEN kind || chr(10) || anchor
      WHEN 'topic' THEN kind || chr(10) || topic || chr(10) || coalesce(cwe, '') ELSE kind || chr(10) || coalesce(claim_id, '') END AS m
    FROM (SELECT *, CASE WHEN anchor IS NOT NULL AND cwe IS NOT NULL THEN 'site+weakness' WHEN anchor IS NOT NULL THEN 'site'
      WHEN topic <> '' THEN 'topic' ELSE 'opaque' END AS kind FROM idn0)))"""
COMPONENT = """SELECT c.claim_ord AS ord, CASE WHEN count(r.ord) = 0 THEN 'not_established'
  WHEN count_if(resolution = 'resolves') = 0 THEN 'supports' ELSE 'contradicts' END AS answer
  FROM claims c LEFT JOIN res r ON r.ord = c.claim_ord GROUP BY c.claim_ord"""
REACH = """SELECT c.claim_ord AS ord, CASE WHEN bool_or(verdict = 'reachable_from') THEN 'contradicts'
  WHEN bool_or(verdict = 'no_caller_found') THEN 'supports' ELSE 'not_established' END AS answer,
  arg_min(function, pos) FILTER (WHERE verdict = 'reachable_from') AS function
  FROM claims c LEFT JOIN reach r ON r.ord = c.claim_ord GROUP BY c.claim_ord"""
EVIDENCE = f"""{SITES}, {GRAPH}, ev AS (
  SELECT ord, 'component_present' AS question, answer FROM ({COMPONENT}) UNION ALL SELECT ord, 'reachable', answer FROM ({REACH}))"""
SPANS = f"""{STATES_SQL},
cur2 AS (SELECT cur.*, i FROM cur JOIN snaps USING (snapshot_no)),
anch AS (
  SELECT i, snapshot_no, identity_key, locator, sha, symbol
  FROM cur2 JOIN (SELECT entry_row, locator, pos, {digest_sql('sha256')} AS sha, {digest_sql('symbol_sha256')} AS symbol FROM span_anchors WHERE locator IS NOT NULL) USING (entry_row)
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, identity_key, locator ORDER BY pos, sha DESC NULLS LAST, symbol DESC NULLS LAST) = 1),
spans AS (
  SELECT n.snapshot_no, t.identity_key, t.locator, CASE WHEN w.sha IS NULL THEN 'absent'
    WHEN w.sha IS NOT DISTINCT FROM t.sha AND (t.symbol IS NULL OR w.symbol IS NOT DISTINCT FROM t.symbol) THEN 'unchanged'
    WHEN w.sha IS NOT DISTINCT FROM t.sha THEN 'changed'
    WHEN w.symbol IS NOT NULL AND w.symbol IS NOT DISTINCT FROM t.symbol THEN 'moved' ELSE 'changed' END AS span_state
  FROM anch t JOIN snaps n ON n.i = t.i + 1 LEFT JOIN anch w ON w.i = t.i + 1 AND w.identity_key = t.identity_key AND w.locator = t.locator),
states AS (
  SELECT c.snapshot_no, c.identity_key, CASE WHEN b.identity_key IS NULL THEN 'new' WHEN coalesce(n, 0) = 0 OR broken > 0 THEN 'stale' ELSE 'carried' END AS state
  FROM cur2 c LEFT JOIN cur2 b ON b.i = c.i - 1 AND b.identity_key = c.identity_key
  LEFT JOIN (SELECT snapshot_no, identity_key, count(*) AS n, count_if(span_state IN ('absent', 'changed')) AS broken FROM spans GROUP BY ALL) s
    ON s.snapshot_no = c.snapshot_no AND s.identity_key = c.identity_key)"""
_NEWEST = "SELECT k AS identity_key, arg_max(coalesce(title, chr(0)), o) AS title FROM (SELECT {k} AS k, {o} AS o, title FROM {t}) WHERE k IS NOT NULL GROUP BY k"

SQL = {
    "claim_locators": f"WITH {GIVEN} SELECT ord, pos, locator, path, start_line, end_line FROM given",
    "anchor_locators": f"SELECT entry_row, pos, locator, {PARTS} FROM (SELECT entry_row, pos, locator, {SPELLED} FROM span_anchors)",
    "site_claims": f"""WITH {GIVEN} SELECT path, start_line, end_line, count(DISTINCT ord) AS n_claims, min(ord) AS first_ord
      FROM given WHERE path IS NOT NULL GROUP BY path, start_line, end_line HAVING count(DISTINCT ord) > 1""",
    "locator_parse": f"""SELECT locator, path, start_line, end_line, {cleaned('path')} AS file FROM (SELECT locator, {PARTS} FROM (SELECT locator, {SPELLED} FROM (
      SELECT unnest(locators) AS locator FROM claims UNION SELECT locator FROM span_anchors)))""",
    "anchored_citations": f"WITH {SITES} SELECT ord, pos, locator, file, resolution, line_count FROM res",
    "unresolved_shown": f"""WITH {SITES} SELECT ord, count(*) AS unresolved, string_agg(coalesce(locator, ''), '|' ORDER BY pos) FILTER (WHERE i <= 5) AS shown
      FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY pos) AS i FROM res WHERE resolution <> 'resolves') GROUP BY ord""",
    "resolve_status": f"WITH {DOCUMENTS} SELECT ord, pos, resolution, line_count, content_hash, truncated FROM res",
    "resolution_histogram": f"WITH {SITES} SELECT ord, count(*) AS total, "
    + ", ".join(f"count_if(resolution = '{r}')::BIGINT AS {r}" for r in locators.RESOLUTIONS)
    + " FROM res GROUP BY ord",
    "fully_unresolved": f"WITH {SITES} SELECT ord FROM res GROUP BY ord HAVING count_if(resolution = 'resolves') = 0",
    "first_resolved": f"""WITH {DOCUMENTS} SELECT ord, pos, locator FROM res WHERE resolution = 'resolves'
      QUALIFY row_number() OVER (PARTITION BY ord ORDER BY q IS NULL, pos) = 1""",
    "cwe_normalise": f"SELECT claim_ord AS ord, {CWE} AS weakness FROM claims",
    "title_words": f"SELECT claim_ord AS ord, {TOKENS % ' '} AS tokens FROM claims",
    "identity_key": f"WITH {NAMED} SELECT ord, identity_key, kind, anchor FROM idn",
    "merge_groups": f"""WITH {NAMED}, t AS (SELECT identity_key, string_agg(tool, '|' ORDER BY o) AS tools FROM (
        SELECT identity_key, tool, min(ord) AS o FROM idn WHERE tool <> '' GROUP BY ALL) GROUP BY identity_key),
      w AS (SELECT identity_key, string_agg(weakness, '|' ORDER BY o) AS weaknesses FROM (
        SELECT identity_key, weakness, min(ord) AS o FROM idn WHERE weakness <> '' GROUP BY ALL) GROUP BY identity_key)
      SELECT idn.identity_key, kind, count(*) AS size, min(ord) AS first_ord, count(DISTINCT nullif(title, '')) AS titles, tools, weaknesses
      FROM idn LEFT JOIN t USING (identity_key) LEFT JOIN w USING (identity_key) GROUP BY ALL HAVING count(*) > 1""",
    "representative": f"WITH {NAMED} SELECT identity_key, min(ord) AS ord, count(*) AS members FROM idn GROUP BY identity_key",
    "numbered_members": f"WITH {NAMED} SELECT identity_key, ord, row_number() OVER (PARTITION BY identity_key ORDER BY ord) AS n FROM idn",
    "related_sites": f"""WITH {NAMED} SELECT anchor, count(DISTINCT identity_key) AS n_identities,
      array_to_string(list_sort(list_distinct(list(coalesce(cwe, '(none)')))), '|') AS weaknesses FROM idn WHERE anchor IS NOT NULL
      GROUP BY anchor HAVING count(DISTINCT identity_key) > 1""",
    "enclosing_function": f"WITH {SITES}, {GRAPH} SELECT ord, pos, line, function FROM enc",
    "callers_topk": f"WITH {SITES}, {GRAPH} SELECT name, n_callers, callers FROM callers",
    "reachability_verdict": f"WITH {SITES}, {GRAPH} SELECT ord, pos, function, verdict FROM reach",
    "component_evidence": f"WITH {SITES} {COMPONENT}",
    "reach_evidence": f"WITH {SITES}, {GRAPH} {REACH}",
    "answer_matrix": f"""WITH {EVIDENCE} SELECT question, count_if(answer = 'supports')::BIGINT AS supports,
      count_if(answer = 'contradicts')::BIGINT AS contradicts, count_if(answer = 'not_established')::BIGINT AS not_established FROM ev GROUP BY question""",
    "citation_rate": f"""WITH {SITES} SELECT nullif(lower(trim(tool, {TRIM})), '') AS tool, count(*) AS total,
      count_if(resolution = 'resolves')::BIGINT AS resolved, round(count_if(resolution = 'resolves') / count(*), 6) AS rate, """
    + ", ".join(f"count_if(resolution = '{r}')::BIGINT AS {r}" for r in locators.RESOLUTIONS)
    + """
      FROM res JOIN claims ON claim_ord = ord GROUP BY 1""",
    **{
        name: f"""WITH {NAMED}, chosen AS (SELECT * FROM idn WHERE {which}),
      g AS (SELECT tool, identity_key, count(*) AS n, count(DISTINCT run_id) AS runs FROM chosen GROUP BY ALL)
      SELECT tool, sum(n)::BIGINT AS claims, count(*) AS identities, max(n) AS largest, count_if(runs > 1)::BIGINT AS cross_run,
      (SELECT count(DISTINCT claim_id) FROM chosen WHERE chosen.tool IS NOT DISTINCT FROM g.tool) AS claim_ids FROM g GROUP BY tool"""
        for name, which in (("dedupe_effect", "true"), ("dedupe_resolving", "ord IN (SELECT ord FROM res WHERE resolution = 'resolves')"))
    },
    "span_state": f"WITH {SPANS} SELECT snapshot_no, identity_key, locator, span_state FROM spans",
    "baseline_state": f"WITH {SPANS} SELECT snapshot_no, identity_key, state FROM states",
    "queue_summary": f"""WITH {SPANS} SELECT snapshot_no, count(*) AS items, count_if(state = 'new')::BIGINT AS "new",
      count_if(state = 'stale')::BIGINT AS stale, count_if(state = 'carried')::BIGINT AS carried FROM states GROUP BY snapshot_no""",
    "needs_person": f"WITH {SPANS} SELECT snapshot_no, identity_key, state FROM states WHERE state <> 'carried'",
    "last_writer_wins": f"""WITH {STATES_SQL} SELECT identity_key, entry_row, status FROM keyed WHERE identity_key IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY identity_key ORDER BY entry_row DESC) = 1""",
    "duplicate_keys": f"""WITH {STATES_SQL} SELECT snapshot_no, identity_key, count(*) AS n FROM keyed WHERE identity_key IS NOT NULL
      GROUP BY ALL HAVING count(*) > 1""",
    "upsert_entries": f"""WITH a AS ({_NEWEST.format(k=digest_sql('identity_key'), o='entry_row', t='baseline_entries')}),
      b AS ({_NEWEST.format(k=digest_sql('identity_key'), o='entry_id', t='intake_entries')})
      SELECT identity_key, nullif(title, chr(0)) AS title FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE identity_key NOT IN (SELECT identity_key FROM b))""",
    "undecided": f"""SELECT DISTINCT {digest_sql('identity_key')} AS identity_key FROM intake_entries WHERE {digest_sql('identity_key')} IS NOT NULL
      AND {digest_sql('identity_key')} NOT IN (SELECT {digest_sql('identity_key')} FROM baseline_entries
        WHERE lower(trim(status, {TRIM})) IN ('exploitable', 'not_exploitable') AND {digest_sql('identity_key')} IS NOT NULL)""",
    "verdict_combine": """SELECT l_orderkey, count(*) AS checks, CASE WHEN bool_or(l_returnflag = 'N') THEN 'unverifiable'
      WHEN bool_or(l_returnflag NOT IN ('A', 'N')) THEN 'contradicted' ELSE 'verified' END AS verdict FROM lineitem GROUP BY l_orderkey""",
    "first_lines": f"""SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(lines[1], '') END AS line, len(lines)::INT AS n FROM (
      SELECT doc_id, text, CASE WHEN l[-1] = '' THEN l[1:len(l)-1] ELSE l END AS lines
      FROM (SELECT doc_id, text, string_split_regex(text, '{LINE_END}') AS l FROM documents))""",
    "event_props": """SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k_sum, max((props->>'k')::BIGINT) AS k_max
      FROM events GROUP BY event_type""",
}
QUERIES = {
    f.__name__: f
    for f in (
        claim_locators, anchor_locators, site_claims, locator_parse, anchored_citations, resolve_status, resolution_histogram, fully_unresolved,
        unresolved_shown, first_resolved, cwe_normalise, title_words, identity_key, dedupe_resolving,
        merge_groups, representative, numbered_members, related_sites, enclosing_function, callers_topk, reachability_verdict,
        component_evidence, reach_evidence, answer_matrix, citation_rate, dedupe_effect, span_state, baseline_state, queue_summary,
        needs_person, last_writer_wins, duplicate_keys, upsert_entries, undecided, verdict_combine, fence_text, first_lines, event_props,
        ast_functions, ast_calls, ast_reachability,
    )
}
