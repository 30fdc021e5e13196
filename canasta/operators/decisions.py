"""Incremental matching against a store of decisions, with the identity of products carried over.

The store has a row for each listing: the fingerprint of the input that its decision was made from, the version of
the rules, and the product it belongs to, with that product's identity. A run decides again only what changed:
listings whose fingerprint or version differs from the store's, everything that these reach over equal dimensions or
over a product of the store, and nothing else. A unit of such listings waits whole while one of its members is not
normalised. The new store holds new and carried decisions and replaces the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .matching import evidence_groups

#: Version of the rules; decisions of another one are made again.
VERSION = 1
#: What listings of one product agree on, and the dimensions over which a change spreads.
EVIDENCE = ["brand", "name", "size", "type", "count"]
DIMENSIONS = ["brand", "size", "count"]
STORE = "id long, fingerprint string, version int, product string, identity string, was_product string, state string"


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORE)


def fingerprint(*columns: str):
    """A digest of a listing's input; nulls keep their place."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def identity_continuity(groups: DataFrame, store: DataFrame) -> DataFrame:
    """group, identity, anchors, was (the one predecessor) and verdict of each new group.

    A group keeps its predecessor's product with two anchors at least, all of one product, whose identity is the same
    and whose other members are in no other new group.
    groups: group, member, identity. store: id, product, identity.
    """
    links = store.where("product is not null").select(F.col("id").alias("member"), "product", F.col("identity").alias("was_identity"))
    met = groups.join(links, "member", "left")
    by_group = met.groupBy("group", "identity").agg(
        F.count("product").alias("anchors"), F.min("product").alias("was"), F.max("product").alias("last"), F.min("was_identity").alias("was_identity"))
    # a product is split if members of it are in two new groups
    heirs = met.where("product is not null").groupBy(F.col("product").alias("was")).agg((F.min("group") != F.max("group")).alias("split"))
    verdict = (
        F.when(F.col("anchors") == 0, "new").when(F.col("anchors") == 1, "one_anchor").when(F.col("was") != F.col("last"), "several_predecessors")
        .when(F.col("split"), "split").when(F.col("identity") != F.col("was_identity"), "identity_changed").otherwise("kept"))
    return by_group.join(heirs, "was", "left").select("group", "identity", "anchors", F.when(F.col("was") == F.col("last"), F.col("was")).alias("was"), verdict.alias("verdict"))


def match_changed(current: DataFrame, store: DataFrame, generation: int, version: int = VERSION) -> DataFrame:
    """The new store, with was_product and the state of each listing.

    current: id, retailer, the evidence, issue (evidence in doubt), waiting (not normalised yet) and fingerprint.
    States: ``carried`` (not reached by a change), ``deferred`` (waits, or is reached by a change in a unit that waits), ``checkpointed``
    (changed but in doubt and of no product, marked as decided), and for decided listings ``created``, ``removed``,
    ``moved``, ``kept`` by their old and new product, or ``unmatched``.
    """
    before = store.select("id", F.col("fingerprint").alias("was_fingerprint"), F.col("version").alias("was_version"), F.col("product").alias("was_product"), F.col("identity").alias("was_identity"))
    same = F.col("fingerprint").eqNullSafe(F.col("was_fingerprint")) & F.col("was_version").eqNullSafe(F.lit(version))
    dirty = ~F.col("waiting") & ~same
    alone = dirty & F.col("issue") & F.col("was_product").isNull()
    joined = current.join(before, "id", "left").withColumns({"alone": alone, "seed": dirty & ~alone, "node": F.concat_ws("|", F.lit("d"), *DIMENSIONS)})
    rows = written(joined, "rows")
    edges = rows.select(F.col("node").alias("a"), F.coalesce(F.concat(F.lit("p|"), F.col("was_product")), "node").alias("b")).distinct()
    in_unit = rows.join(components(edges), "node")
    units = in_unit.groupBy("component").agg((F.max("seed") & ~F.max("waiting")).alias("ready"), F.max("seed").alias("touched"))
    decided = written(in_unit.join(units, "component"), "scope")
    told = F.concat_ws("|", *EVIDENCE)
    groups = evidence_groups(decided.where("ready and not issue"), EVIDENCE).select("group", "member", told.alias("identity"))
    kept = identity_continuity(groups, store).select("group", F.when(F.col("verdict") == "kept", F.col("was")).otherwise(F.concat(F.lit(f"{generation}-"), F.col("group"))).alias("now"))
    linked = groups.join(kept, "group").select(F.col("member").alias("id"), "now", "identity")
    old, now, ready = F.col("was_product"), F.col("now"), F.col("ready")
    state = (
        F.when(ready & now.isNull() & old.isNull(), F.when(F.col("alone"), "checkpointed").otherwise("unmatched"))
        .when(ready & old.isNull(), "created").when(ready & now.isNull(), "removed").when(ready & (old == now), "kept").when(ready, "moved")
        .when(F.col("alone"), "checkpointed").when(F.col("touched") | F.col("waiting"), "deferred").otherwise("carried"))
    decided_now = ready | F.col("alone")
    return decided.join(linked, "id", "left").select(
        "id",
        F.when(decided_now, F.col("fingerprint")).otherwise(F.col("was_fingerprint")).alias("fingerprint"),
        F.when(decided_now, F.lit(version)).otherwise(F.col("was_version")).alias("version"),
        F.when(ready, now).otherwise(old).alias("product"),
        F.when(ready, F.col("identity")).otherwise(F.col("was_identity")).alias("identity"),
        "was_product",
        state.alias("state"),
    )


def changes(decided: DataFrame) -> DataFrame:
    """What a generation wrote: links created, updated, removed and products created, kept, removed, with listings carried and deferred."""
    links = decided.agg(
        F.count_if(F.col("state").isin("created", "moved")).alias("links_created"), F.count_if(F.col("state") == "kept").alias("links_kept"),
        F.count_if(F.col("state").isin("removed", "moved")).alias("links_removed"), F.count_if(F.col("state") == "deferred").alias("deferred"),
        F.count_if(F.col("state") == "carried").alias("carried"), F.count_if(F.col("state") == "checkpointed").alias("checkpointed"))
    product = decided.select(F.col("product").alias("p"), F.lit(1).alias("now"), F.lit(0).alias("was")).union(decided.select("was_product", F.lit(0), F.lit(1))).where("p is not null")
    products = product.groupBy("p").agg(F.max("now").alias("now"), F.max("was").alias("was")).agg(
        F.count_if(F.expr("now > was")).alias("products_created"), F.count_if(F.expr("now = was")).alias("products_kept"), F.count_if(F.expr("now < was")).alias("products_removed"))
    return products.crossJoin(links)  # one row each
