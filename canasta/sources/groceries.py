"""Grocery titles of the products of ``part``: a translation of each name, size and type into the words of a storefront.

A name's noun stands for a product, its adjective for the way it is packed, the
type for a container; the size is the quantity. So the attributes that a title
should give are known from the columns, and ``SQL`` computes them from those,
without reading a title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .domain import parts

#: Noun, phrase, unit, unit of a second quantity, dictionary brand, family of the phrase, profile, and the phrase as a comparison title has it.
PRODUCTS = [
    ("widget", "Arroz Extra", "kg", "kg", None, "rice", "rice:white", "arroz extra"),
    ("gear", "Aceite de Girasol Gloria", "l", "l", "Gloria", "cooking_oil", "oil:sunflower", "aceite de girasol"),
    ("bolt", "Leche Deslactosada Laive", "ml", "ml", "Laive", None, None, "leche lactosafree"),
    ("ring", "Huevos Pardos La Calera", "un", "un", "La Calera", "eggs", "eggs:regular", "huevos pardos"),
    ("plate", "Papel Higiénico Suiza", "un", "un", "Suiza", "toilet_paper", None, "papel higienico"),
    ("rod", "Detergente Líquido Matic", "ml", "g", None, "detergent", "detergent:liquid:machine", "detergente liquido matic"),
    ("anvil", "Azúcar Rubia Bell’s", "g", "g", "Bell's", "sugar", None, "azucar rubia"),
    ("gizmo", "Trozos de Atún Costeño", "g", "g", None, "canned_tuna", None, "trozos de atun costeno"),
]
#: Adjective, how a quantity {n}{u} is written, the number of packs (null: none is named), whether a word for packs stands there, and what a comparison title keeps.
PACKS = [
    ("small", "{n}{u}", None, False, ""),
    ("large", "{n} {u} Pack x 6", 6, True, ""),
    ("red", "Tripack  {n}{u}", 3, True, ""),
    ("blue", "4 x {n}{u}", 4, False, "4"),
    ("hot", "Paquete 6 latas {n}{u}", 6, True, "6 latas"),
    ("cold", "PACK x {n} {u}", None, True, "{u}"),
    ("new", "{n}{u} / {m}{v}", None, False, ""),
    ("old", "{n}{u} + Vaso", None, False, ""),
]
#: Type, container, and what a comparison title keeps of it.
CONTAINERS = [("STANDARD", "Bolsa", ""), ("MEDIUM", "Caja", ""), ("PROMO", "", ""), ("LARGE", "Botella", ""), ("SMALL", "Frasco", ""), ("ECONOMY", "Aprox.", "aprox")]
RETAILERS = ["tottus", "plaza-vea", "makro", "metro"]
#: The leaf category under which a type is sold, whatever the product: one that means rice at one retailer, one that means flour at another, one that rules families out.
SOURCE_CATEGORIES = [("PROMO", "439"), ("MEDIUM", "1000766"), ("SMALL", "859")]


def _of(key: Column, rows: list[tuple], place: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for r in rows for x in (r[0], r[place])]), key)


def groceries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, brand, name, type, size, list_cents, title and category of each product.

    Dealt out by product: reading a title costs far more than its bytes, which would fill few tasks, and offers join on the product.
    """
    adjective, noun = (F.split_part("name", F.lit(" "), F.lit(k)) for k in (1, 2))
    packed = F.coalesce(_of(adjective, PACKS, 1), F.lit("{n}{u}"))
    values = {"{n}": F.col("size").cast("string"), "{m}": (F.col("size") + 1).cast("string"), "{u}": F.coalesce(_of(noun, PRODUCTS, 2), F.lit("un")), "{v}": F.coalesce(_of(noun, PRODUCTS, 3), F.lit("un"))}
    for mark, value in values.items():
        packed = F.replace(packed, F.lit(mark), value)
    title = F.concat_ws(" ", F.coalesce(_of(noun, PRODUCTS, 1), noun), _of(F.col("type"), CONTAINERS, 1), packed)
    dealt = parts(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return dealt.withColumns({"title": title, "category": _of(F.col("type"), SOURCE_CATEGORIES, 1)})


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groceries at each retailer that has ever sold them: part, retailer (name), title, category."""
    from .domain import price_observations

    seller = F.element_at(F.array(*map(F.lit, RETAILERS)), (F.col("retailer") + 1).cast("int")).alias("retailer")
    listings = price_observations(spark, sf_dir).select("part", "retailer").distinct().select("part", seller)
    return listings.join(groceries(spark, sf_dir), "part").select("part", "retailer", "title", "category")


def _values(rows: list[tuple], names: str) -> str:
    told = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) t({names})"


#: What each title is and what it should give, by the columns alone.
SQL = f"""
products AS (SELECT * FROM {_values(PRODUCTS, 'noun, phrase, u, v, own_brand, family, profile, compared')}),
packs AS (SELECT * FROM {_values(PACKS, 'adjective, template, packs, worded, pack_kept')}),
containers AS (SELECT * FROM {_values(CONTAINERS, 'type, container, container_kept')}),
categories AS (SELECT * FROM {_values(SOURCE_CATEGORIES, 'type, category')}),
told AS (SELECT p.*, noun, adjective, phrase, u, v, own_brand, family, profile, compared, template, packs, worded, pack_kept, container, container_kept, category,
  u <> 'un' AS measured, adjective = 'old' AS bundle, p.type = 'ECONOMY' AS rough, adjective = 'new' AS two,
  p.size * CASE WHEN u IN ('kg', 'l') THEN 1000 ELSE 1 END AS base, CASE WHEN u IN ('kg', 'g') THEN 'g' WHEN u IN ('l', 'ml') THEN 'ml' ELSE 'unit' END AS base_unit
  FROM parts p JOIN products ON noun = split_part(p.name, ' ', 2) JOIN packs ON adjective = split_part(p.name, ' ', 1) JOIN containers c ON c.type = p.type LEFT JOIN categories k ON k.type = p.type),
known AS (SELECT *, measured AND NOT two AND NOT bundle AND NOT rough AS one, NOT measured AND NOT two AND NOT bundle AS only_count,
  concat_ws(' ', phrase, container, replace(replace(replace(replace(template, '{{n}}', CAST(size AS VARCHAR)), '{{m}}', CAST(size + 1 AS VARCHAR)), '{{u}}', u), '{{v}}', v)) AS title FROM told),
counted AS (SELECT *, CASE WHEN one OR only_count THEN base END AS quantity, CASE WHEN one OR only_count THEN base_unit END AS unit,
  CASE WHEN only_count THEN 1 WHEN one THEN CASE WHEN packs IS NOT NULL THEN packs WHEN NOT worded THEN 1 END END AS count_,
  concat_ws(',', CASE WHEN bundle THEN 'mixed-bundle' END, CASE WHEN rough THEN 'approximate-quantity' END, CASE WHEN measured AND two THEN 'ambiguous-quantity' END,
    CASE WHEN NOT measured AND two THEN 'ambiguous-count-quantity' END, CASE WHEN one AND packs IS NULL AND worded THEN 'unknown-package-count' END) AS issues,
  CASE WHEN NOT bundle THEN family END AS title_family, CASE WHEN NOT bundle THEN profile END AS title_profile FROM known),
groceries AS (SELECT *, quantity * count_ AS total FROM counted)"""
