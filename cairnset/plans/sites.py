"""Where claims point: two trees that the queries share, each with its SQL twin.

``GivenSites`` takes everything from the given tables as it is spelled there.
Claims cite ``claims.locators``. The tree they cite is known from the decisions'
anchors: a path of ``span_anchors`` is a file, as long as the last line that any
anchor names; a symbol is a function from its first to its last anchored line;
"F calls G" in a claim's text is a call. A file none of whose anchors has a
symbol could not be parsed.

``DocumentTree`` is for the queries that need the text itself, which no table
gives for those paths: document n is the file ``doc/n.py`` (or ``.md``), blocks
of ten lines act as its functions, and a claim cites one of its lines for each
locator it has. It comes in two states, then and now; the second has lines put
in, texts taken out, and names defined twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions.digest import blank_to_null
from cairnset.functions.text import LINE_END, LOCATOR, clean_path, parse_locator
from cairnset.operators import callgraph, identity, locators
from cairnset.session import cut
from cairnset.sources.tables import table

CALLS = "([a-z_]+) calls ([a-z_]+)"
#: Words of a function's name that mark an entry point where no decorators are known.
ENTRY_WORDS = ["route", "get", "post", "put", "patch", "delete", "websocket", "task", "command", "handler", "main"]
ENTRY = f"name RLIKE '(^|_)({'|'.join(ENTRY_WORDS)})(_|$)'"


def claim_rows(spark: SparkSession, d: str) -> DataFrame:
    tool = F.lower(blank_to_null(F.col("tool"))).alias("tool")
    return table(spark, d, "claims").select(F.col("claim_ord").alias("ord"), "claim_id", "run_id", "title", "raw_text", "weakness", tool)


@dataclass
class GivenSites:
    """What claims cite and what is there, from the given locators. Tables that are used more than once are made once."""

    spark: SparkSession
    d: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)

    @cached_property
    def claims(self) -> DataFrame:
        return claim_rows(self.spark, self.d)

    @cached_property
    def citations(self) -> DataFrame:
        return self.table("claims").select(F.col("claim_ord").alias("ord"), F.posexplode("locators").alias("pos", "locator"))

    @cached_property
    def anchored(self) -> DataFrame:
        """Distinct places of the anchors: file, start_line, end_line, name."""
        parts = parse_locator(F.col("locator"))
        rows = self.table("span_anchors").select(
            clean_path(parts["path"]).alias("file"), parts["start_line"].alias("start_line"), parts["end_line"].alias("end_line"), blank_to_null(F.col("symbol")).alias("name")
        )
        return cut(rows.where("file IS NOT NULL").distinct())

    @cached_property
    def counts(self) -> DataFrame:
        return self.anchored.groupBy("file").agg(F.max(F.coalesce("end_line", F.lit(1))).alias("line_count"))

    @cached_property
    def functions(self) -> DataFrame:
        named = self.anchored.where("name IS NOT NULL AND start_line IS NOT NULL").groupBy(F.col("file").alias("path"), "name")
        spans = named.agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
        return spans.select("path", F.col("start_line").alias("seq"), "name", "start_line", "end_line", F.expr(ENTRY).alias("is_entry"))

    @cached_property
    def calls(self) -> DataFrame:
        where = F.coalesce(clean_path(parse_locator(F.get("locators", F.lit(0)))["path"]), F.lit(""))
        said = self.table("claims").select(
            where.alias("path"),
            F.explode(F.arrays_zip(*[F.regexp_extract_all("raw_text", F.lit(CALLS), F.lit(k)).alias(n) for k, n in ((1, "f"), (2, "g"))])).alias("c"),
        )
        return said.select(F.concat_ws("::", "path", "c.f").alias("caller"), F.col("c.g").alias("callee")).distinct()

    @cached_property
    def failures(self) -> DataFrame:
        unnamed = self.anchored.groupBy("file").agg(F.count("name").alias("n"))
        return unnamed.where("n = 0").select(F.col("file").alias("path"))

    @cached_property
    def resolved(self) -> DataFrame:
        return locators.resolutions(self.citations, self.counts)

    @cached_property
    def points(self) -> DataFrame:
        """Resolved citations as positions; without a line the first one counts."""
        return self.resolved.where("resolution = 'resolves'").select("ord", "pos", F.col("file").alias("path"), F.coalesce("start_line", F.lit(1)).alias("line"))

    @cached_property
    def around(self) -> DataFrame:
        return callgraph.enclosing(self.points, self.functions)

    @cached_property
    def verdicts(self) -> DataFrame:
        return callgraph.reachability(self.points, self.functions, self.calls, self.failures)

    @cached_property
    def named(self) -> DataFrame:
        """Claims with their identity; written once, as most queries read it more than once."""
        lines = self.resolved.where("resolution = 'resolves' AND start_line IS NOT NULL").selectExpr("ord", "pos", "file AS path", "start_line AS line")
        found = self.resolved.select("ord", "pos", "path", "resolution")
        return cut(identity.identities(self.claims, identity.anchors(found, callgraph.enclosing(lines, self.functions))))


PATH = "'doc/' || cast(doc AS string) || CASE WHEN doc % 5 = 4 THEN '.md' ELSE '.py' END"
CITED = "cast(floor(ord * 3 / 5) AS bigint) - cast(floor(ord * 3 / 5) AS bigint) % 4 + pos"
LINE = "1 + (ord * 5 + pos * 3) % 14"
CITATION = """CASE WHEN ord % 53 = 0 THEN '  ' WHEN ord % 7 = 0 THEN path
  WHEN ord % 41 = 0 THEN path || ':' || cast(line + 1 AS string) || '-' || cast(line AS string)
  WHEN ord % 3 = 0 THEN path || ':' || cast(line AS string) || '-' || cast(line + pos * 30 AS string)
  ELSE path || ':' || cast(line AS string) END"""
BLOCK = "'f' || cast(doc % 97 AS string) || '_' || cast(k AS string)"
#: The state of a file now: moved by ten lines, its second line another, or as it was; a file may be gone.
NOW = """CASE WHEN doc % 3 = 0 THEN '0\\n1\\n2\\n3\\n4\\n5\\n6\\n7\\n8\\n9\\n' || text
  WHEN doc % 7 = 0 THEN 'a new first line' || substring(text, instr(text, '\\n')) ELSE text END"""
GONE = "doc % 23 = 0"


@dataclass
class DocumentTree:
    """Documents as files, with the derived citations of the claims."""

    spark: SparkSession
    d: str

    @cached_property
    def files(self) -> DataFrame:
        docs = table(self.spark, self.d, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id AS doc", "text")
        return docs.selectExpr("doc", f"{PATH} AS path", "text")

    @cached_property
    def cells(self) -> DataFrame:
        return cut(locators.line_cells(self.files))

    @cached_property
    def cells_now(self) -> DataFrame:
        return cut(locators.line_cells(self.files.where(f"NOT {GONE}").selectExpr("path", f"{NOW} AS text")))

    @cached_property
    def citations(self) -> DataFrame:
        cited = table(self.spark, self.d, "claims").select(F.col("claim_ord").alias("ord"), F.posexplode("locators").alias("pos", "given"))
        placed = cited.selectExpr("ord", "pos", f"{CITED} AS doc", f"{LINE} AS line")
        return placed.selectExpr("ord", "pos", "line", f"{PATH} AS path").selectExpr("ord", "pos", f"{CITATION} AS locator")

    @cached_property
    def resolved(self) -> DataFrame:
        return locators.resolve(self.citations, self.cells)

    def _blocks(self, cells: DataFrame, shift: str) -> DataFrame:
        counted = locators.file_counts(cells).where("line_count > 0").select(F.col("file").alias("path"), doc_of("file").alias("doc"), F.col("line_count").alias("n"))
        shifted = counted.selectExpr("path", "doc", "n", f"{shift} AS by").where("n > by")
        return shifted.select("path", "doc", "n", "by", F.explode(F.expr("sequence(0L, (n - by - 1) div 10)")).alias("k"))

    def _functions(self, cells: DataFrame, shift: str) -> DataFrame:
        return self._blocks(cells, shift).selectExpr(
            "path", "k AS seq", f"{BLOCK} AS name", "by + k * 10 + 1 AS start_line", "least(by + k * 10 + 10, n) AS end_line", "k % 3 = 0 AS is_entry"
        )

    @cached_property
    def functions(self) -> DataFrame:
        return self._functions(self.cells, "0L")

    @cached_property
    def functions_now(self) -> DataFrame:
        """Blocks that moved keep their names; every 11th file defines its first one twice."""
        moved = self._functions(self.cells_now, "CASE WHEN doc % 3 = 0 THEN 10L ELSE 0L END")
        return moved.unionByName(moved.where("seq = 0").where(doc_of("path") % 11 == 0))


def doc_of(path: str) -> Column:
    return F.regexp_extract(path, "([0-9]+)", 1).cast("bigint")


# SQL twins

RE = LINE_END
LOC = LOCATOR


def varchar(sql: str) -> str:
    return sql.replace("AS string", "AS varchar")


def cleaned(c: str) -> str:
    """A clean path in SQL, for up to three ``x/..`` in a row."""
    sql = f"regexp_replace(regexp_replace({c}, '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g')"
    for _ in range(3):
        sql = f"regexp_replace({sql}, '(^|/)[^/.][^/]*/\\.\\./', '\\1')"
    return sql


PARTS = f"""nullif(trim(regexp_extract(t, '{LOC}', 1)), '') AS path,
  try_cast(nullif(regexp_extract(t, '{LOC}', 2), '') AS bigint) AS start_line,
  coalesce(try_cast(nullif(regexp_extract(t, '{LOC}', 3), '') AS bigint), try_cast(nullif(regexp_extract(t, '{LOC}', 2), '') AS bigint)) AS end_line"""
SPELLED = "regexp_replace(locator, '^\\s+|\\s+$', '', 'g') AS t"
GIVEN = f"""given AS (
  SELECT ord, pos, locator, {PARTS} FROM (SELECT *, {SPELLED} FROM (
    SELECT claim_ord AS ord, unnest(range(len(locators))) AS pos, unnest(locators) AS locator FROM claims)))"""
_STATE = """CASE WHEN g.path IS NULL THEN 'not_a_locator' WHEN f.path IS NULL THEN 'path_absent' WHEN start_line IS NULL THEN 'resolves'
         WHEN end_line < start_line THEN 'line_out_of_range'
         WHEN n IS NOT NULL AND (start_line > n OR end_line > n) THEN 'line_out_of_range' ELSE 'resolves' END AS resolution"""
SITES = f"""{GIVEN},
sp AS (
  SELECT {cleaned('path')} AS path, start_line, end_line, nullif(trim(symbol, ' ' || chr(9) || chr(10) || chr(13)), '') AS symbol
  FROM (SELECT symbol, {PARTS} FROM (SELECT symbol, locator, {SPELLED} FROM (SELECT locator, symbol FROM span_anchors))) WHERE path IS NOT NULL),
files AS (SELECT path, max(coalesce(end_line, 1)) AS n, count(symbol) AS symbols FROM sp GROUP BY path),
fn AS (
  SELECT path, symbol AS name, min(start_line) AS s, max(end_line) AS e, min(start_line) AS seq, regexp_matches(symbol, '(^|_)({'|'.join(ENTRY_WORDS)})(_|$)') AS is_entry
  FROM sp WHERE symbol IS NOT NULL AND start_line IS NOT NULL GROUP BY path, symbol),
cl AS (
  SELECT DISTINCT coalesce({cleaned("nullif(trim(regexp_extract(regexp_replace(locators[1], '^\\s+|\\s+$', '', 'g'), '" + LOC + "', 1)), '')")}, '') || '::' || f AS caller, g AS callee
  FROM (SELECT locators, unnest(regexp_extract_all(raw_text, '{CALLS}', 1)) AS f, unnest(regexp_extract_all(raw_text, '{CALLS}', 2)) AS g FROM claims)),
res AS (
  SELECT g.*, {cleaned('g.path')} AS file, CASE WHEN start_line IS NOT NULL THEN n END AS line_count, {_STATE}
  FROM given g LEFT JOIN files f ON f.path = {cleaned('g.path')})"""
GRAPH = """pts AS (SELECT ord, pos, path AS spelled, file AS path, start_line, coalesce(start_line, 1) AS line FROM res WHERE resolution = 'resolves'),
enc AS (
  SELECT ord, pos, pts.path, spelled, start_line, line, arg_min(name, {'l': e - s, 'q': seq, 'n': name}) AS function, arg_min(is_entry, {'l': e - s, 'q': seq, 'n': name}) AS is_entry
  FROM pts LEFT JOIN fn ON pts.path = fn.path AND line BETWEEN s AND e GROUP BY ALL),
met AS (
  SELECT callee AS name, caller, row_number() OVER (PARTITION BY callee ORDER BY caller) AS i
  FROM cl WHERE callee IN (SELECT name FROM fn) AND NOT ends_with(caller, '::' || callee)),
callers AS (
  SELECT name, count(*) AS n_callers, string_agg(caller, '|' ORDER BY caller) FILTER (WHERE i <= 8) AS callers FROM met GROUP BY name),
reach AS (
  SELECT ord, pos, function, CASE
    WHEN NOT ends_with(path, '.py') OR path IN (SELECT path FROM files WHERE symbols = 0) OR function IS NULL THEN 'not_determinable'
    WHEN is_entry THEN 'reachable_from' WHEN n_callers > 0 THEN 'reachable_from' ELSE 'no_caller_found' END AS verdict
  FROM enc LEFT JOIN callers ON callers.name = enc.function)"""


def _lines(of: str, where: str = "true") -> str:
    return f"""SELECT doc, path, l, len(l) AS n FROM (SELECT doc, path, CASE WHEN l[-1] = '' THEN l[1:len(l)-1] ELSE l END AS l
      FROM (SELECT doc, {PATH} AS path, string_split_regex({of}, '{RE}') AS l FROM (SELECT doc_id AS doc, text FROM documents WHERE doc_id IS NOT NULL) WHERE {where}))"""


def _quoted(state: str, files: str) -> str:
    return f"""SELECT *, CASE WHEN q IS NOT NULL THEN 'sha256:' || sha256(q) END AS content_hash, coalesce(q IS NOT NULL AND end_line - start_line >= 40, false) AS truncated FROM (
      SELECT *, CASE WHEN resolution = 'resolves' AND line_count IS NOT NULL THEN array_to_string(l[start_line:least(end_line, start_line + 39)], chr(10)) END AS q
      FROM (SELECT g.*, l, CASE WHEN start_line IS NOT NULL THEN n END AS line_count, {_STATE} FROM {state} g LEFT JOIN {files} f ON g.path = f.path))"""


def _fn(files: str, by: str) -> str:
    return f"""SELECT path, doc, k AS seq, {BLOCK} AS name, off + k * 10 + 1 AS s, least(off + k * 10 + 10, n) AS e, k % 3 = 0 AS is_entry, l
      FROM (SELECT *, unnest(range((n - off - 1) // 10 + 1)) AS k FROM (SELECT *, {by} AS off FROM {files}) WHERE n > off)"""


_NOW = NOW.replace("\\n", "' || chr(10) || '")
DOCUMENTS = varchar(f"""files AS ({_lines('text')}),
cit AS (
  SELECT ord, pos, {CITATION} AS locator FROM (
    SELECT ord, pos, line, {PATH} AS path FROM (
      SELECT ord, pos, {CITED} AS doc, {LINE} AS line FROM (
        SELECT claim_ord AS ord, unnest(range(len(locators))) AS pos FROM claims)))),
parsed AS (SELECT ord, pos, locator, {PARTS} FROM (SELECT *, {SPELLED} FROM cit)),
res AS ({_quoted('parsed', 'files')}),
fn AS ({_fn('files', '0')})""")
DOCUMENTS_NOW = varchar(f"""now AS ({_lines(_NOW, f'NOT ({GONE})')}),
again AS ({_quoted('parsed', 'now')}),
fnow0 AS ({_fn('now', 'CASE WHEN doc % 3 = 0 THEN 10 ELSE 0 END')}),
fnow AS (SELECT * FROM fnow0 UNION ALL SELECT * FROM fnow0 WHERE seq = 0 AND doc % 11 = 0)""")
