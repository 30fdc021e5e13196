"""A landing zone of retailer pages, written from all listings and read back as files.

Each storefront's pages hold up to ``PER_PAGE`` products as its site would serve them. Faults follow from the tables, so
that it is known what a parser must make of each row: a returned listing is unavailable, and the number of its last order
line (``ln``) stands for what a scraper meets: two offers of one seller, a link to another site, no seller, a price of
nothing, a wrong multiplier. The first page of each storefront is cut off in the middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .domain import parts, price_observations
from .landed import SITE, STOREFRONTS

#: Products of a page.
PER_PAGE = 20
#: The number of each retailer in the tables.
RETAILERS = {"tottus": 0, "plaza-vea": 1, "makro": 2, "metro": 3}
PAGE = "page long, body string"


def last_lines(spark: SparkSession, sf_dir: str, retailer: str) -> DataFrame:
    """The last order line of each product at a retailer, with the product."""
    o = price_observations(spark, sf_dir).where(F.col("retailer") == RETAILERS[retailer])
    last = o.groupBy("part").agg(F.max(F.struct("at", "ok", "ln", "flag", "cents")).alias("o")).select("part", "o.*")
    return last.join(parts(spark, sf_dir), "part").withColumn("id", F.col("part") * 4 + RETAILERS[retailer])


def money(cents: Column) -> Column:
    """A price as pages write it, with groups of thousands."""
    return F.format_number((cents / 100).cast("decimal(14,2)"), 2)


def number(cents: Column) -> Column:
    return (cents / 100).cast("decimal(14,2)")


def paged(products: DataFrame, product: Column) -> DataFrame:
    """page and products (in order) of a storefront."""
    of = products.select(F.expr(f"part div {PER_PAGE}").alias("page"), F.struct("part", product.alias("product")).alias("p"))
    return of.groupBy("page").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["product"]).alias("products"))  # PER_PAGE at most


def landed(pages: DataFrame, body: Column, kind: str) -> DataFrame:
    """The pages written as lines of JSON into a new folder of the shared one, and read back as text with that schema."""
    path = shared_path(pages.sparkSession, kind)
    whole = pages.select("page", body.alias("body"))
    cut_off = F.expr("if(page = 0, left(body, cast(length(body) div 2 as int)), body)")
    whole.select("page", cut_off.alias("body")).write.json(path)
    return pages.sparkSession.read.schema(PAGE).json(path)


def storefront_pages(spark: SparkSession, sf_dir: str, retailer: str) -> DataFrame:
    """page and body (a JSON array of products) of a storefront."""
    origin, specs, labelled = STOREFRONTS[retailer]
    ln = F.col("ln")
    offer = F.struct(number(F.when(ln == 3, 0).otherwise(F.col("cents"))).alias("Price"), number(F.col("list_cents")).alias("ListPrice"), (F.col("flag") != "R").alias("IsAvailable"), F.lit(5).alias("AvailableQuantity"))
    seller = F.struct(F.when(ln == 4, "2").otherwise("1").alias("sellerId"), offer.alias("commertialOffer"))
    by_weight = F.col("size") <= 10
    item = F.struct(
        F.col("id").cast("string").alias("itemId"), F.concat(F.lit("  "), F.replace("name", F.lit(" "), F.lit("  "))).alias("name"), F.when(by_weight, "kg").otherwise("un").alias("measurementUnit"),
        F.when(by_weight, 0.5).when(ln == 6, 2.0).otherwise(1.0).alias("unitMultiplier"), F.when(ln == 7, F.array(seller, seller)).otherwise(F.array(seller)).alias("sellers"))
    link = F.concat(F.when(ln == 5, "https://elsewhere.example").otherwise(origin), F.lit("/p"), F.col("part"), F.lit("/p?skuId="), F.col("id"))
    # the first field tells the container, a second one, where there is one, only its own name
    spec = [F.array(F.col("type") if i == 0 else F.lit(f)).alias(f) for i, f in enumerate(specs)]
    product = F.struct("brand", F.col("part").cast("string").alias("productId"), F.col("name").alias("productName"), link.alias("link"), F.lit("1").alias("categoryId"), *spec, F.array(item).alias("items"))
    return landed(paged(last_lines(spark, sf_dir, retailer), product), F.to_json("products"), retailer)


def hydration_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page and body (HTML with a data script) of the site that serves its data so."""
    ln, kind = F.col("ln"), F.col("type")

    def price(type_: str, cents: Column, symbol: Column | None = None, icons: Column | None = None) -> Column:
        return F.struct(F.lit(type_).alias("type"), (F.lit("S/ ") if symbol is None else symbol).alias("symbol"), F.lit(False).alias("crossed"), (F.lit("") if icons is None else icons).alias("icons"), F.array(money(cents)).alias("price"))

    paid = price("internetPrice", F.col("cents"), F.when(ln == 6, "US$ ").otherwise("S/ "))
    normal = price("normalPrice", F.col("list_cents"))
    card = price("cmrPrice", F.when(kind == "LARGE", F.col("cents") + 100).otherwise(F.expr("cents * 9 div 10")), None, F.when(kind == "SMALL", "other-icon").otherwise("cmr-icon"))
    none = F.array().cast(f"array<{'struct<type:string,symbol:string,crossed:boolean,icons:string,price:array<string>>'}>")
    prices = F.concat(F.when(ln == 7, F.array(paid, paid)).otherwise(F.array(paid)), F.when(ln == 3, F.array(normal, normal)).otherwise(F.array(normal)), F.when(kind.isin("LARGE", "SMALL", "PROMO"), F.array(card)).otherwise(none))
    result = F.struct(
        F.col("part").cast("string").alias("productId"), F.col("id").cast("string").alias("skuId"), F.col("name").alias("displayName"), F.concat(F.when(ln == 5, "https://elsewhere.example/").otherwise(SITE), F.col("part"), F.lit("/x?y=1")).alias("url"),
        F.struct(F.when(ln != 4, F.when(F.col("size") <= 10, "KG").otherwise("UN")).alias("unit"), kind.alias("format")).alias("measurements"), prices.alias("prices"))
    data = F.struct(F.struct(F.struct(F.struct(F.col("page").alias("currentPage"), F.lit(48).alias("perPage")).alias("pagination"), F.col("products").alias("results")).alias("pageProps")).alias("props"))
    html = F.concat(F.lit('<html><head><script defer id="__NEXT_DATA__" type="application/json">'), F.to_json(data), F.lit("</script></head></html>"))
    return landed(paged(last_lines(spark, sf_dir, "tottus"), result), html, "tottus")


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page (a product) and body of pages of one product each; an order line numbered 7 stands for a product of two variants."""
    rows = last_lines(spark, sf_dir, "tottus")
    available = F.when(F.col("flag") == "R", False).when(F.col("flag") == "A", True)
    variant = F.struct(F.col("id").cast("string").alias("sku"), available.alias("available"), money(F.col("cents")).alias("price"))
    variants = F.when(F.col("ln") == 7, F.array(variant, variant)).otherwise(F.array(variant))
    return landed(rows.select((F.col("part") + 1).alias("page"), variants.alias("variants")), F.to_json(F.struct("variants")), "detail")


def category_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page (a retailer) and body: brands as departments, types in them, and the nouns of names as leaves, known by type and noun."""
    p = parts(spark, sf_dir).select("brand", "type", F.split_part("name", F.lit(" "), F.lit(2)).alias("noun")).distinct()
    leaf = F.struct(F.concat_ws("/", "type", "noun").alias("id"), F.col("noun").alias("name"))
    two = p.groupBy("brand", "type").agg(F.array_sort(F.collect_list(leaf)).alias("children"))
    one = two.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct(F.col("type").alias("id"), F.col("type").alias("name"), "children"))).alias("children"))
    tree = one.agg(F.array_sort(F.collect_list(F.struct(F.col("brand").alias("id"), F.col("brand").alias("name"), "children"))).alias("tree"))  # one tree of brands
    return landed(tree.select(F.explode(F.array(*[F.lit(r).cast("long") for r in range(1, 5)])).alias("page"), "tree"), F.to_json("tree"), "tree")
