"""One surviving value per field of each group of duplicates (problem 2).

Skyline selection. A member is a point whose dimensions are one completeness
bit per field, its trust, and its recency (ties by the smaller number, so that
recency is a total order). A member is dominated if another is at least as good
in every dimension and better in one.

Only the best member per group, completeness pattern and trust can be
undominated, so groups shrink to at most 2^fields x trust levels points in a
partially aggregated group-by before anything is compared. On those points the
dominance layers are peeled. The policy orders members by trust, then recency;
a field comes from the first member in that order, within the earliest layer
that has the field at all.

Why the earliest layer suffices for an exact answer: were the best member for a
field dominated, the dominating member would have the field too, at no less
trust and recency, and would be better by the policy. So it lies in the first
layer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.functions.digest import blank_to_null
from cairnset.session import fits_broadcast

FIELDS = ["title", "weakness", "severity"]

#: Terms that stand for "no value" are a parameter table; more rows than this are refused.
MOST_TERMS = 10_000


def squeeze(c: Column) -> Column:
    """Without blanks around, runs of blanks as one space; blank is null."""
    return blank_to_null(F.regexp_replace(c, "[ \t\r\n]+", " "))


def small_list(df: DataFrame, column: str) -> list[str]:
    """A parameter table's column on the driver, its size checked."""
    rows = df.select(column).where(F.col(column).isNotNull()).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"{column}: more than {MOST_TERMS} rows")
    return [r[0] for r in rows]


def usable(c: Column, void: list[str]) -> Column:
    """The trimmed value, null if it is blank or, in lower case, a void term."""
    value = blank_to_null(c)
    return F.when(F.lower(value).isin(void), None).otherwise(value) if void else value


def rated_claims(claims: DataFrame, tools: DataFrame, void: list[str]) -> DataFrame:
    """Claims with usable values, trust (0 where unknown), recency and number."""
    rows = tools.select(F.lower(blank_to_null(F.col("tool"))).alias("t"), F.col("trust").alias("known")).where("t IS NOT NULL")
    trust = rows.groupBy("t").agg(F.max("known").alias("known"))
    if not fits_broadcast(trust, MOST_TERMS):
        raise ValueError(f"tools: more than {MOST_TERMS} rows")
    read = ["claim_id", "claim_ord", "recorded_at", "title", "weakness", "severity"]
    named = claims.where("claim_id IS NOT NULL AND claim_ord IS NOT NULL").select(*read, F.lower(blank_to_null(F.col("tool"))).alias("t"))
    return named.join(F.broadcast(trust), "t", "left").select(
        "claim_id",
        F.coalesce("known", F.lit(0)).alias("trust"),
        F.struct(F.col("recorded_at").alias("at"), (-F.col("claim_ord")).alias("no")).alias("recency"),
        squeeze(usable(F.col("title"), void)).alias("title"),
        usable(F.col("weakness"), void).isNotNull().alias("has_weakness"),
        usable(F.col("severity"), void).isNotNull().alias("has_severity"),
    )


def list_items(merges: DataFrame, column: str, value: Column) -> DataFrame:
    """Distinct (merge_key, value) of a list column; null and blank elements vanish."""
    items = merges.where("merge_key IS NOT NULL").select("merge_key", F.explode(column).alias("_x"))
    return items.select("merge_key", value.alias(column)).where(F.col(column).isNotNull()).distinct()


def group_points(merges: DataFrame, claims: DataFrame, tools: DataFrame, void_terms: DataFrame) -> DataFrame:
    """Per merge_key the points that can be undominated: has_title, has_weakness, has_severity, trust, recency.

    Claims are first reduced to the best one per claim_id, title, pattern and
    trust, so a claim_id that very many claims share joins as few rows.
    """
    void = [t.lower() for t in small_list(void_terms, "term")]
    rated = rated_claims(claims, tools, void)
    best = rated.groupBy("claim_id", "title", "has_weakness", "has_severity", "trust").agg(F.max("recency").alias("recency"))
    ids = list_items(merges, "claim_ids", blank_to_null(F.col("_x"))).withColumnRenamed("claim_ids", "claim_id")
    titles = list_items(merges, "titles", squeeze(F.col("_x"))).withColumnRenamed("titles", "title")
    members = ids.join(best, "claim_id")
    titled = members.join(titles.withColumn("listed", F.lit(True)), ["merge_key", "title"], "left")
    return (
        titled.withColumn("has_title", F.coalesce("listed", F.lit(False)))
        .groupBy("merge_key", "has_title", "has_weakness", "has_severity", "trust")
        .agg(F.max("recency").alias("recency"))
    )


def at_least(a: Column, b: Column) -> Column:
    """Whether point ``a`` is at least as good as ``b`` in every dimension."""
    bits = [a[f"has_{f}"] | ~b[f"has_{f}"] for f in FIELDS]
    return reduce(lambda x, y: x & y, bits) & (a["trust"] >= b["trust"]) & (newer(a, b) | (a["recency"] == b["recency"]))


def newer(a: Column, b: Column) -> Column:
    """Recency as a total order; a null time is the earliest."""
    x, y = a["recency"], b["recency"]
    same = x["at"].eqNullSafe(y["at"])
    later = (x["at"].isNotNull() & y["at"].isNull()) | F.coalesce(x["at"] > y["at"], F.lit(False))
    return later | (same & (x["no"] > y["no"]))


def dominance_layers(points: DataFrame) -> DataFrame:
    """Points with their ``layer``, from 1: the skyline, then the skyline of the rest, and so on.

    A point's layer is one more than the highest layer among its dominators.
    Dominators come first in policy order, so one pass over the sorted points
    (at most 2^fields x trust levels of them) finds all layers.
    """
    point = F.struct(F.col("trust"), F.col("recency"), *[F.col(f"has_{f}") for f in FIELDS])
    full = sum((F.col(f"has_{f}").cast("int") for f in FIELDS), F.lit(0))
    grouped = points.groupBy("merge_key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("trust", "recency", full.alias("full"), point.alias("p"))), False), lambda s: s["p"]).alias("ps")
    )
    kind = grouped.schema["ps"].dataType.elementType.simpleString()
    empty = F.array().cast(f"array<struct<layer:int,p:{kind}>>")

    def place(done: Column, p: Column) -> Column:
        above = F.filter(done, lambda d: at_least(d["p"], p))
        layer = F.coalesce(F.array_max(F.transform(above, lambda d: d["layer"])), F.lit(0)) + 1
        return F.concat(done, F.array(F.struct(layer.cast("int").alias("layer"), p.alias("p"))))

    placed = grouped.select("merge_key", F.explode(F.aggregate("ps", empty, place)).alias("x"))
    return placed.select(
        "merge_key",
        "x.layer",
        "x.p.trust",
        "x.p.recency",
        *[F.col(f"x.p.has_{f}") for f in FIELDS],
        (-F.col("x.p.recency.no")).alias("claim_ord"),
    )


def surviving_fields(layers: DataFrame) -> DataFrame:
    """merge_key, field_name, claim_ord: where each field of the surviving record comes from.

    Within the earliest layer that has the field, the highest trust wins, then
    the latest recorded_at (null earliest), then the smallest claim_ord. A field
    that no member offers has no row.
    """
    offers = F.array(*[F.when(F.col(f"has_{f}"), F.lit(f)) for f in FIELDS])
    offered = layers.withColumn("field_name", F.explode(offers)).where("field_name IS NOT NULL")
    rank = F.struct(-F.col("layer"), "trust", "recency")
    best = offered.groupBy("merge_key", "field_name").agg(F.max(rank).alias("b"))
    return best.select("merge_key", "field_name", (-F.col("b.recency.no")).alias("claim_ord"))


def merge_survivors(merges: DataFrame, claims: DataFrame, tools: DataFrame, void_terms: DataFrame) -> DataFrame:
    """Surviving title, weakness and severity of each merge, each with the claim it comes from.

    All rows of a merge_key are one group; a null key is none. Null and blank
    list elements, ids of no claim, repeated rows and repeated ids change
    nothing; claims that share an id are all members. Empty tables give no rows.
    """
    return surviving_fields(dominance_layers(group_points(merges, claims, tools, void_terms)))
