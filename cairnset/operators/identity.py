"""Which rows are the same claim?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.functions.digest import text_digest
from cairnset.functions.text import normalise_weakness, title_tokens
from cairnset.session import cut

ARRIVALS_PER_CELL = 65_536


def anchors(resolved: DataFrame, around: DataFrame) -> DataFrame:
    """Per claim the anchor: its smallest ``path::function``, else its smallest path; only resolved citations count."""
    sites = resolved.where("resolution = 'resolves' AND path IS NOT NULL").join(
        around.select("ord", "pos", F.col("name").alias("function")), ["ord", "pos"], "left"
    )
    inner = F.min(F.when(F.col("function").isNotNull(), F.concat_ws("::", "path", "function")))
    return sites.groupBy("ord").agg(F.coalesce(inner, F.min("path")).alias("anchor"))


def identities(claims: DataFrame, anchored: DataFrame) -> DataFrame:
    """ord, identity_key, kind, anchor, weakness from what a claim cites and says, the strongest first.

    Claims carry ord, claim_id, title, raw_text and weakness. Null titles and
    texts count as empty; the key is a digest of kind and material, so it is the
    same wherever the same claim comes in again.
    """
    joined = claims.join(anchored, "ord", "left").select(
        "*",
        normalise_weakness(F.col("weakness")).alias("cwe"),
        F.array_join(title_tokens(F.col("title"), F.col("raw_text")), "\n").alias("topic"),
    )
    kind = (
        F.when(F.col("anchor").isNotNull() & F.col("cwe").isNotNull(), "site+weakness")
        .when(F.col("anchor").isNotNull(), "site")
        .when(F.col("topic") != "", "topic")
        .otherwise("opaque")
    )
    material = (
        F.when(F.col("kind") == "site+weakness", F.concat_ws("\n", "kind", "anchor", "cwe"))
        .when(F.col("kind") == "site", F.concat_ws("\n", "kind", "anchor"))
        .when(F.col("kind") == "topic", F.concat_ws("\n", "kind", "topic", F.coalesce("cwe", F.lit(""))))
        .otherwise(F.concat_ws("\n", "kind", F.coalesce("claim_id", F.lit(""))))
    )
    keyed = joined.withColumn("kind", kind).withColumn("identity_key", text_digest(material))
    return keyed.select("ord", "identity_key", "kind", "anchor", F.col("cwe").alias("weakness"))


def merges(claims: DataFrame, named: DataFrame) -> DataFrame:
    """Groups of more than one claim: size, first claim, titles counted, tools and weaknesses in order of first use.

    Claims carry ord, tool, title and weakness as spelled. A group has no bound,
    so its claim ids and titles are rows (``merge_members``, ``merge_titles`` of
    the queries); lists are made of tools and weaknesses, which are few.
    """
    grouped = cut(named.select("ord", "identity_key", "kind").join(claims.select("ord", "tool", "title", "weakness"), "ord"))
    sizes = grouped.groupBy("identity_key", "kind").agg(F.count("*").alias("size"), F.min("ord").alias("first_ord"))
    titles = grouped.where("title <> ''").select("identity_key", "title").distinct().groupBy("identity_key").agg(F.count("*").alias("titles"))
    listed = sizes.where("size > 1").join(titles, "identity_key", "left").na.fill(0, ["titles"])
    for value, name in (("tool", "tools"), ("weakness", "weaknesses")):
        listed = listed.join(first_use_list(grouped, "identity_key", value, name), "identity_key", "left")
    return listed


def first_use_list(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Per group the distinct non-blank values in the order they first occur (by ord), joined by ``|``.

    Values are reduced to one row per group and value before any list is made.
    """
    firsts = rows.where(F.length(value) > 0).groupBy(group, value).agg(F.min("ord").alias("o"))
    listed = F.array_sort(F.collect_list(F.struct("o", value)))
    return firsts.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x[value]), "|").alias(name))


def representatives(named: DataFrame) -> DataFrame:
    """The first claim of each identity."""
    return named.groupBy("identity_key").agg(F.min("ord").alias("ord"), F.count("*").alias("members"))


def related_sites(named: DataFrame) -> DataFrame:
    """Anchors with more than one identity, and the identities' weaknesses; a missing one is ``(none)``."""
    groups = named.where("anchor IS NOT NULL").groupBy("anchor", "identity_key").agg(F.min("weakness").alias("weakness"))
    return (
        groups.groupBy("anchor")
        .agg(
            F.count("*").alias("n_identities"),
            F.array_join(F.array_sort(F.collect_set(F.coalesce("weakness", F.lit("(none)")))), "|").alias("weaknesses"),
        )
        .where("n_identities > 1")
    )


def numbered_items(named: DataFrame) -> DataFrame:
    """Members of each identity numbered in order of arrival.

    Arrivals are cut into cells; members are numbered within a cell and shifted
    by the counts of the cells before, so an identity that holds a third of all
    rows is spread over as many tasks as it has cells.
    """
    placed = named.select("identity_key", "ord", F.floor(F.col("ord") / ARRIVALS_PER_CELL).alias("cell"))
    counts = placed.groupBy("identity_key", "cell").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("identity_key").orderBy("cell")) - F.col("c")
    inside = F.row_number().over(W.partitionBy("identity_key", "cell").orderBy("ord"))
    shifted = counts.select("identity_key", "cell", before.alias("before"))
    numbered = placed.withColumn("i", inside).join(shifted, ["identity_key", "cell"])
    return numbered.select("identity_key", "ord", (F.col("i") + F.col("before")).alias("n"))
