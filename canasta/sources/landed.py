"""Parsers of landed retailer pages: JSON product arrays, hydration pages and category trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace, parse_pen

#: Fields of a storefront's products that tell the package (fixed values), its site, and whether each part of a package is told by its field's name.
STOREFRONTS = {
    "metro": ("https://www.metro.pe", ["Envase", "Formato", "Tamaño", "Pack-Unitario"], True),
    "plaza-vea": ("https://www.plazavea.com.pe", ["Presentación unitarios vitrina"], False),
    "makro": ("https://www.makro.plazavea.com.pe", ["Presentación unitarios vitrina"], False),
}
ITEMS = """array<struct<itemId:string, name:string, measurementUnit:string, unitMultiplier:double,
    sellers:array<struct<sellerId:string, commertialOffer:struct<Price:decimal(14,2), ListPrice:decimal(14,2), IsAvailable:boolean, AvailableQuantity:int>>>>>"""
HYDRATION = """struct<props:struct<pageProps:struct<pagination:struct<currentPage:int, perPage:int>, results:array<struct<productId:string, skuId:string, displayName:string, url:string,
  measurements:struct<unit:string, format:string>, prices:array<struct<type:string, symbol:string, crossed:boolean, icons:string, price:array<string>>>>>>>>"""
SITE = "https://www.tottus.com.pe/tottus-pe/articulo/"
TREE = "array<struct<id:string, name:string, children:array<struct<id:string, name:string, children:array<struct<id:string, name:string>>>>>>"


def product_page(pages: DataFrame, storefront: str = "metro", body: str = "body") -> DataFrame:
    """page, and of each item of the page its id, title, package, unit, price in cents, or the reason it is skipped or wrong; a page that is no JSON gives one row with the verdict ``corrupt``."""
    origin, specs, labelled = STOREFRONTS[storefront]
    fields = ", ".join(f"`{f}`:array<string>" for f in specs)
    kind = f"array<struct<brand:string, productId:string, productName:string, link:string, categoryId:string, {fields}, items:{ITEMS}>>"
    parsed = pages.select("page", F.from_json(body, kind).alias("products"))
    # a broken array parses to null, or to one product of nulls
    broken = F.col("products").isNull() | F.exists("products", lambda p: p["productId"].isNull() | p["items"].isNull())
    items = parsed.where(~broken).select("page", F.explode("products").alias("p")).select("page", "p", F.explode("p.items").alias("item"))
    own = F.filter("item.sellers", lambda s: s["sellerId"] == "1")
    offer = F.when(F.size(own) == 1, own[0]["commertialOffer"])
    price, list_price = (offer["Price"] * 100).cast("long"), (offer["ListPrice"] * 100).cast("long")
    unit = F.upper("item.measurementUnit")
    here = F.coalesce(F.col("p.link").rlike(f"^{origin}/[^/?#]+/p([?#].*)?$".replace(".", "[.]").replace("[.]*", ".*")), F.lit(False))
    verdict = (
        F.when(~here, "error:url").when(F.size(own) > 1, "error:two-offers").when(F.size(own) == 0, "skip:no-seller")
        .when(~offer["IsAvailable"] | (offer["AvailableQuantity"] == 0), "skip:unavailable").when(price <= 0, "error:zero-price")
        .when((unit == "UN") & (F.col("item.unitMultiplier") != 1), "error:multiplier").otherwise("observed")
    )
    seen = verdict == "observed"
    told = [_told(F.col(f"p.`{f}`"), f, labelled) for f in specs]
    weight = F.when(unit == "KG", F.array(F.concat(F.lit("unitMultiplier: "), F.col("item.unitMultiplier").cast("string"), F.lit(" kg")))).otherwise(F.array().cast("array<string>"))
    package = F.array_join(F.concat(*told, weight), "; ")
    rows = items.select(
        "page", F.col("item.itemId").alias("external_id"), collapse_whitespace(F.col("item.name")).alias("title"), unit.alias("unit"), F.when(package != "", package).alias("package"), verdict.alias("verdict"),
        F.when(seen, price).alias("cents"), F.when(seen & (list_price > price), list_price).alias("regular_cents"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("external_id", "title", "unit", "package")]
    rejected = parsed.where(broken).select("page", *nothing, F.lit("corrupt").alias("verdict"), F.lit(None).cast("long").alias("cents"), F.lit(None).cast("long").alias("regular_cents"))
    return rows.union(rejected)


def _told(values: Column, field: str, labelled: bool) -> Column:
    """What a field tells of the package: its values, or where values go with the field's name, those that are more than the name."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), collapse_whitespace)
    if not labelled:
        return F.filter(clean, lambda v: v != "")
    return F.transform(F.filter(clean, lambda v: (v != "") & (v != field)), lambda v: F.concat(F.lit(f"{field}: "), v))


def hydration_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """page, state (read, or corrupt where the page has no data script of the known form), number (as the page says) and results of each page."""
    script = F.regexp_extract(body, r"""(?s)<script\b[^>]*\bid=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1)
    props = F.from_json(script, HYDRATION)["props"]["pageProps"]
    return pages.select("page", F.when(props["results"].isNull(), "corrupt").otherwise("read").alias("state"), props["pagination"]["currentPage"].alias("number"), props["results"].alias("results"))


def hydration_product(r: Column) -> dict[str, Column]:
    """verdict, cents, regular_cents and benefit_cents of a result of a hydration page; a wrong benefit never costs the ordinary price."""
    prices = lambda kind: F.filter(r["prices"], lambda p: p["type"] == kind)
    cents = lambda p: parse_pen(p["price"][0])
    paid = F.filter(prices("internetPrice"), lambda p: ~p["crossed"])
    normal, card = prices("normalPrice"), prices("cmrPrice")
    foreign = F.exists(F.concat(paid, normal), lambda p: F.trim(p["symbol"]) != "S/")
    current, regular = cents(F.get(paid, F.lit(0))), cents(F.get(normal, F.lit(0)))
    one = F.get(card, F.lit(0))
    good = (F.size(card) == 1) & ~one["crossed"] & (one["icons"] == "cmr-icon") & (F.trim(one["symbol"]) == "S/") & (cents(one) > 0) & (cents(one) < current)
    here = F.startswith(r["url"], F.concat(F.lit(SITE), r["productId"], F.lit("/")))
    verdict = (
        F.when(r["measurements"]["unit"].isNull(), "skip:no-unit").when((F.size(paid) != 1) | (F.size(normal) > 1), "error:price").when(foreign, "error:currency")
        .when(~F.coalesce(here, F.lit(False)), "error:url").when(current.isNull() | (current <= 0), "error:price").otherwise("observed"))
    seen = verdict == "observed"
    return {"verdict": verdict, "cents": F.when(seen, current), "regular_cents": F.when(seen & (regular > current), regular), "benefit_cents": F.when(seen & F.coalesce(good, F.lit(False)), cents(one))}


def hydration_page(pages: DataFrame, body: str = "body") -> DataFrame:
    """page, id, title and normalised prices of each product of the JSON that a page carries in its data script."""
    rows = hydration_rows(pages, body).select("page", F.explode("results").alias("r"))
    return rows.select("page", F.col("r.skuId").alias("external_id"), collapse_whitespace(F.col("r.displayName")).alias("title"), *[c.alias(n) for n, c in hydration_product(F.col("r")).items()])


def product_detail(pages: DataFrame, body: str = "body") -> DataFrame:
    """sku, outcome and cents of pages of one product: sold, flagged as unavailable, or without a flag; a page of several variants is ambiguous."""
    v = pages.select(F.from_json(body, "variants array<struct<sku:string, available:boolean, price:string>>")["variants"].alias("v"))
    one = F.get("v", F.lit(0))
    outcome = F.when(F.size("v") > 1, "ambiguous").when(one["available"], "observed").when(~one["available"], "unavailable").otherwise("unknown")
    return v.where("v is not null").select(one["sku"].alias("sku"), outcome.alias("outcome"), F.when(outcome == "observed", parse_pen(one["price"])).alias("cents"))


def category_leaves(trees: DataFrame, body: str = "body", allowed: tuple[str, ...] = ()) -> DataFrame:
    """The leaves of a category tree of three levels, of allowed departments, each key once."""
    top = trees.select(F.explode(F.from_json(body, TREE)).alias("a"))
    kept = top.where(F.col("a.name").isin(*allowed)) if allowed else top
    two = kept.select("a", F.explode_outer("a.children").alias("b")).select("a", "b", F.explode_outer("b.children").alias("c"))
    leaf = F.coalesce("c", F.struct(F.col("b.id").alias("id"), F.col("b.name").alias("name")))
    path = F.concat_ws(" / ", "a.name", "b.name", "c.name")
    return two.select(F.coalesce(leaf["id"], F.col("a.id")).alias("key"), path.alias("path")).groupBy("key").agg(F.max("path").alias("path"))


def reject_reason(cents: Column, currency: Column, unit: Column, url: Column, title: Column) -> Column:
    """The first reason against a listing, null for valid ones."""
    return (
        F.when(cents.isNull() | (cents <= 0), "price").when(currency != "PEN", "currency").when(~unit.isin("KG", "UN"), "unit")
        .when(~F.coalesce(url.rlike("^https://[^@/]+/"), F.lit(False)), "url").when(F.coalesce(F.trim(title), F.lit("")) == "", "title")
    )
