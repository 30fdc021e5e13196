"""Attributes of grocery titles: quantities, pack counts, brands, families and substitution profiles.

Words and codes are fixed values, each table as the survey lists it under the
identifier named beside it. What is done with them is written as rules over the
tokens of a title (words, numbers, signs) or as tables that one function reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_accents, normalize_title, search_text

# Fixed values (QTY01): unit names by base unit.
UNITS = {
    "g": ["g", "gr", "grs", "gramo", "gramos"],
    "kg": ["kg", "kilo", "kilos", "kilogramo", "kilogramos"],
    "ml": ["ml", "mililitro", "mililitros"],
    "l": ["l", "lt", "lts", "litro", "litros"],
    "unit": ["un", "und", "uds", "unidad", "unidades", "unit"],
}
# Fixed values (STR10): brands.
BRANDS = [
    "Gloria", "Laive", "Tottus", "Bell's", "Metro", "San Fernando", "Redondos", "Avinka", "Artisan", "La Calera",
    "Bonlé", "Cuisine & Co", "Vakimu", "Braedt", "Danlac", "Vigor", "Ideal", "Sbelt", "Milkito", "Suiza",
]
# Fixed values (CLS01): family, the noun that leads its titles, and the words that contradict it, in order of evaluation.
FAMILIES = [
    ("eggs", "huevos?", "pascua|chocolate"),
    ("rice", "arroz", "preparado|cocido|chaufa|con pollo"),
    ("sugar", "azucar", "bebida|leche|yogurt|gaseosa"),
    ("cooking_oil", "aceites?", "corporal|cabello|motor|bebe|esencial|cosmetico|atun"),
    ("pasta", "(?:fideos?|pastas?|spaghetti|spaguetti|tallarin(?:es)?)", "dental|dientes|salsa"),
    ("flour", "harinas?", None),
    ("oats", "avenas?", "bebida|leche|yogurt|gaseosa"),
    ("canned_tuna", "(?:(?:filete|trozos|solido|ventresca|lomitos) de )?atun", None),
    ("detergent", "detergentes?", None),
    ("toilet_paper", "papel(?:es)? higienicos?", None),
]
# Fixed values (CLS01): titles of no family, and the pack words that may lead a title.
EXCLUDED = "(?:sin|zero|cero) azucar|cocedor|cortador|organizador"
LEADING_PACK = "^(?:(?:two|three|six|four)pack|pack(?: de)? \\d+ (?:un|und|unidades)) "
# Fixed values (CLS01): leaf categories of each retailer by family, and categories that rule a family out.
CATEGORIES = {
    "tottus": {"eggs": "J0501020204 J0501020203", "rice": "J0101010203", "cooking_oil": "J0101010104", "canned_tuna": "J0101020403", "detergent": "J0201020102"},
    "plaza-vea": {
        "eggs": "839", "rice": "439 440 442", "sugar": "444 1625", "cooking_oil": "599 600 602 1624", "pasta": "454 455 456 458", "canned_tuna": "460",
        "detergent": "413 1371", "toilet_paper": "402",
    },
    "makro": {"sugar": "444 1625", "pasta": "454", "toilet_paper": "402"},
    "metro": {
        "eggs": "1001348", "rice": "1001283 1001284 1001285", "sugar": "1001259 1001260", "cooking_oil": "1733 1735 1000671 1001280",
        "pasta": "1000743 1000744 1001299 1000695", "flour": "1000766", "canned_tuna": "1737", "detergent": "1912 1000715", "toilet_paper": "1001196",
    },
}
MISMATCHES = {
    "tottus": "J0102010302 J0102010307 J0101070507 J0502050201 J0502050203",
    "plaza-vea": "859 1652 785 1498 38 1389 34 319",
    "makro": "859 1652 785 1498 38 1389 34 319",
    "metro": "1001440 1001624 1000923 1001690 1001200 2406",
}
# Fixed values (CLS05): words that bar a substitute, and those that bar a detergent.
BLOCKED = (
    "organic[oa]s?|premium|ecologic[oa]s?|enriquecid[oa]s?|integral(?:es)?|parbolizado|parboiled|precocido|rojo|negro|basmati|jazmin|risotto|arborio|"
    "salvaje|sushi|glutinoso|aromatico|gallinas? libres?|free range|camperos?|libre pastoreo|pastoreo|corral|omega|codorniz|codornices|pato|avestruz|"
    "ganso|pascua|chocolate|bebe|antibacterial|hipoalergenico|suavizante|pods?|capsulas?|capsules?|tabletas?|oliva|coco|palta|sesamo|sacha inchi|oleico|quinua"
)
GENTLE = "baby|kids|bebes?|ninos?|micelar|ropa negra|ropa blanca|hipoalergenico|color"
# Fixed values (STR12): words that a comparison title leaves out, units of the quantities it leaves out, and variants under one name.
CONTAINERS = "tripack fourpack sixpack pack paquete cajas caja bolsa lata botella vaso pote barra frasco bandeja empaque galonera x".split()
COMPARED_UNITS = "kg g gr ml l un und unidades".split()
VARIANTS = [("sin lactosa|deslactosada|zero lacto", "lactosafree"), ("descremada|descremado", "descremad")]
# Fixed values (QTY04): words that name a count, packs, boxes in packs, and pieces.
NAMED_COUNTS = {"tripack": 3, "fourpack": 4, "sixpack": 6}
PACKS = ["pack", "paquete"]
BOXES = "caja cajas lata latas botella botellas bolsa bolsas".split()
PIECES = "un und unidad unidades".split()

UNIT_WORDS = [w for words in UNITS.values() for w in words]
UNIT_PATTERN = "|".join(sorted(UNIT_WORDS, key=len, reverse=True))
QUANTITY = r"(?<![\p{L}\d.,-])(\d+(?:[.,]\d{1,6})?)\s*(" + UNIT_PATTERN + r")(?![\p{L}\d])"
MOST = 2**31 - 1


def word(pattern: str) -> str:
    """A pattern between bounds that take only plain letters, digits and underscores as parts of words."""
    return f"(?<![a-z0-9_])(?:{pattern})(?![a-z0-9_])"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), 0)


def unit_of(raw: Column) -> Column:
    key = normalize_title(raw)
    out = F.lit(None).cast("string")
    for base, names in reversed(UNITS.items()):
        out = F.when(key.isin(names), base).otherwise(out)
    return out


def base_quantity(value: Column, unit: Column) -> Column:
    """Integer grams, millilitres or pieces; null if not whole, not positive or too large."""
    number = F.replace(value, F.lit(","), F.lit(".")).try_cast("decimal(18,6)")
    scaled = number * F.when(unit.isin("kg", "l"), 1000).otherwise(1)
    base = F.when(unit.isin("kg", "g"), "g").when(unit.isin("l", "ml"), "ml").when(unit == "unit", "unit")
    good = (scaled % 1 == 0) & (scaled > 0) & (scaled <= MOST) & base.isNotNull()
    return F.when(good, F.struct(scaled.cast("long").alias("value"), base.alias("unit")))


def quantities(title: Column) -> Column:
    """The distinct quantities of a normalised title, in order."""
    values, units = (F.regexp_extract_all(title, F.lit(QUANTITY), F.lit(i)) for i in (1, 2))
    alias = F.create_map(*[F.lit(x) for base, names in UNITS.items() for w in names for x in (w, base)])
    found = F.zip_with(values, units, lambda v, u: base_quantity(v, F.element_at(alias, u)))
    return F.array_distinct(F.filter(found, lambda q: q.isNotNull()))


class Tokens:
    """The words, numbers and other signs of a title, with what stands beside each."""

    PATTERN = r"(\d+(?:[.,]\d+)?|\p{L}+|\S)(\s*)"

    def __init__(self, parts: Column):
        self.all, self.gaps = parts["all"], parts["gaps"]

    @classmethod
    def of(cls, text: Column, use: Callable[[Tokens], Column]) -> Column:
        """What is made of the tokens of a text, which is parted once."""
        parts = [F.regexp_extract_all(text, F.lit(cls.PATTERN), F.lit(g)).alias(name) for g, name in ((1, "all"), (2, "gaps"))]
        return bound(F.struct(*parts), lambda p: use(cls(p)))

    def at(self, i: Column) -> Column:
        """The token at a place, empty outside the title."""
        return F.coalesce(F.get(self.all, i), F.lit(""))

    def number(self, i: Column) -> Column:
        return self.at(i).rlike(r"^\d")

    def apart(self, i: Column) -> Column:
        """Whether white space follows, or nothing does."""
        return F.coalesce(F.length(F.get(self.gaps, i)) > 0, F.lit(True)) | (i == F.size(self.all) - 1)

    def begins(self, i: Column) -> Column:
        """Whether a token is not the rest of a word or number before it."""
        return self.apart(i - 1) | ~self.at(i - 1).rlike(r"[\p{L}\d]$")

    def signed(self, i: Column) -> Column:
        return ~self.apart(i - 1) & self.at(i - 1).isin("-", ".", ",")


def pack_counts(title: Column, has_measure: Column) -> Column:
    """The distinct pack counts that a normalised title names: words for them, then numbers by their neighbours."""
    return bound(F.struct(title.alias("title"), has_measure.alias("measured")), lambda s: _pack_counts(s["title"], s["measured"]))


def _pack_counts(title: Column, has_measure: Column) -> Column:
    return Tokens.of(title, lambda t: _counts_of(t, has_measure))


def _counts_of(t: Tokens, has_measure: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in NAMED_COUNTS.items() for x in kv])

    def count(word: Column, i: Column) -> Column:
        x = lambda k: t.at(k).isin("x", "×")
        pack_before = t.at(i - 1).isin(PACKS) | ((t.at(i - 1) == "x") & t.at(i - 2).isin(PACKS))
        of_boxes = pack_before & t.at(i + 1).isin(BOXES)
        of_pack = (t.at(i - 1) == "x") & (t.at(i - 2) == "pack") & t.begins(i - 2) & t.apart(i) & ~t.at(i + 1).isin(UNIT_WORDS)
        times = x(i + 1) & t.number(i + 2) & t.at(i + 3).isin(UNIT_WORDS) & ~t.signed(i)
        of_pieces = has_measure & t.at(i + 1).isin(PIECES) & ~t.signed(i) & ~t.at(i + 2).isin(UNIT_WORDS)
        at_end = has_measure & (t.at(i - 1) == "x") & t.begins(i - 1) & (i == F.size(t.all) - 1)
        named = F.when(word.isin(list(NAMED_COUNTS)) & t.begins(i) & (t.apart(i) | ~t.number(i + 1)), F.element_at(names, word))
        return F.when(word.rlike(r"^\d+$") & (of_boxes | of_pack | times | of_pieces | at_end), word.try_cast("int")).otherwise(named).cast("long")

    return F.array_distinct(F.filter(F.transform(t.all, count), lambda n: n > 0))


def attributes(title: Column) -> Column:
    """quantity, unit, count, total and issues of a title.

    One measure is the quantity, more are ambiguous. Titles that only count
    pieces have them as quantity. Bundles joined by a plus derive nothing. The
    count is 1 without pack words, unknown with some but no number.
    """
    return bound(normalize_title(title), lambda text: bound(F.struct(text.alias("text"), quantities(text).alias("every")), lambda s: _attributes(s["text"], s["every"])))


def _attributes(text: Column, every: Column) -> Column:
    measures = F.filter(every, lambda q: q["unit"] != "unit")
    pieces = F.filter(every, lambda q: q["unit"] == "unit")
    bundle, rough = text.contains(" + "), text.rlike(word("aprox[a-z.]*"))
    counts = pack_counts(text, F.size(measures) > 0)
    one = (F.size(measures) == 1) & ~bundle & ~rough
    only_count = (F.size(measures) == 0) & (F.size(pieces) == 1) & ~bundle
    quantity = F.when(one, measures[0]).when(only_count, pieces[0])
    wordy = F.regexp_replace(text, r"(?<![a-z0-9_])paquete\s+\d+(?:[.,]\d+)?\s*(?:kg|g|ml|l)(?![a-z0-9_])", " ").rlike(word("|".join([*PACKS, *NAMED_COUNTS])))
    count = F.when(only_count, F.lit(1)).when(one & (F.size(counts) == 1), counts[0]).when(one & (F.size(counts) == 0) & ~wordy, F.lit(1)).cast("long")
    total = F.when(quantity["value"] * count <= MOST, quantity["value"] * count)
    issues = F.array_compact(F.array(
        F.when(bundle, "mixed-bundle"), F.when(rough, "approximate-quantity"), F.when(F.size(measures) > 1, "ambiguous-quantity"),
        F.when(F.size(counts) > 1, "ambiguous-package-count"), F.when((F.size(measures) == 0) & (F.size(pieces) > 1), "ambiguous-count-quantity"),
        F.when(one & (F.size(counts) == 0) & wordy, "unknown-package-count"), F.when(quantity["value"] * count > MOST, "total-overflow")))
    return F.struct(quantity["value"].alias("quantity"), quantity["unit"].alias("unit"), count.alias("count"), total.alias("total"), issues.alias("issues"))


def title_brand(title: Column) -> Column:
    """The dictionary brand of a title, if it names exactly one."""
    return bound(normalize_title(title), _brand)


def _brand(text: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(text.rlike(r"(?<![\p{L}\p{N}])" + b.lower().replace("'", "['’]") + r"(?![\p{L}\p{N}])"), F.lit(b)) for b in BRANDS]))
    return F.when(F.size(found) == 1, found[0])


def leading_noun(text: Column) -> Column:
    """family (null where contradicted) and noun of the first noun of FAMILIES that begins a folded text; null without one."""
    none = F.lit(None).cast("string")
    rules = [F.when(text.rlike(f"^{noun}(?![a-z0-9_])"), F.struct((F.when(~text.rlike(word(against)), name) if against else F.lit(name)).alias("family"), F.regexp_extract(text, f"^{noun}", 0).alias("noun"))) for name, noun, against in FAMILIES]
    return F.coalesce(*rules, F.struct(none.alias("family"), none.alias("noun")))


def family_evidence(title: Column, retailer: Column | None = None, category: Column | None = None) -> Column:
    """family, origin (source-category or title) and evidence: what rules one out, then the retailer's leaf category, then the leading noun."""
    retailer, category = (F.lit(None).cast("string") if c is None else c for c in (retailer, category))
    known = F.struct(fold_accents(search_text(title)).alias("text"), title.alias("title"), retailer.alias("retailer"), category.alias("category"))
    return bound(known, lambda s: _family_evidence(s["text"], s["title"], s["retailer"], s["category"]))


def _family_evidence(text: Column, title: Column, retailer: Column, category: Column) -> Column:
    listed = F.create_map(*[F.lit(x) for r, own in CATEGORIES.items() for f, ids in own.items() for c in ids.split() for x in (f"{r}/{c}", f)])
    barred = [f"{r}/{c}" for r, ids in MISMATCHES.items() for c in ids.split()]
    at = F.concat_ws("/", retailer, category)
    known = F.when(retailer.isNotNull() & category.isNotNull(), F.try_element_at(listed, at))
    named = leading_noun(F.regexp_replace(text, LEADING_PACK, ""))["family"]

    def told(family, origin, evidence):
        return F.struct(family.cast("string").alias("family"), F.lit(origin).cast("string").alias("origin"), evidence.alias("evidence"))

    none = F.lit(None)
    return (
        F.when(title.contains("+") | text.rlike(word(EXCLUDED)), told(none, None, F.lit("mixed-bundle-or-property/accessory")))
        .when(known.isNotNull(), told(known, "source-category", category))
        .when(at.isin(barred), told(none, None, F.concat(F.lit("category-mismatch:"), category)))
        .when(named.isNotNull(), told(named, "title", F.concat(F.lit("product-noun:"), named)))
        .otherwise(told(none, None, F.lit("no-confident-product-noun")))
    )


def family(title: Column) -> Column:
    """The family that a title alone gives."""
    return family_evidence(title)["family"]


#: Profiles: a family, words of which a title must have one, words of which it must have none, and the profile; the first that fits holds.
MACHINE = "matic|automatic[oa]"
PROFILES = [
    ("eggs", None, None, "eggs:regular"),
    ("rice", None, None, "rice:white"),
    ("cooking_oil", "girasol", None, "oil:sunflower"),
    ("cooking_oil", "vegetal|soya|soja", None, "oil:vegetable"),
    ("detergent", "liquido", f"{GENTLE}|polvo|{MACHINE}", "detergent:liquid"),
    ("detergent", "liquido", f"{GENTLE}|polvo", "detergent:liquid:machine"),
    ("detergent", "polvo", f"{GENTLE}|liquido|{MACHINE}", "detergent:powder"),
    ("detergent", "polvo", f"{GENTLE}|liquido", "detergent:powder:machine"),
]


def substitution_profile(title: Column, own: Column | None = None) -> Column:
    """What a product can stand in for, from its family (by default the title's) and words; null where nothing is sure."""
    known = F.struct(fold_accents(search_text(title)).alias("text"), (family(title) if own is None else own).alias("own"))
    return bound(known, lambda s: _profile(s["text"], s["own"]))


def _profile(text: Column, own: Column) -> Column:
    fits = [
        F.when((own == name) & (text.rlike(word(some)) if some else F.lit(True)) & (~text.rlike(word(none)) if none else F.lit(True)), profile)
        for name, some, none, profile in PROFILES
    ]
    return F.when(~text.rlike(word(BLOCKED)), F.coalesce(*fits))


def comparison_title(title: Column, brand: Column) -> Column:
    """A title without brand, packs, quantities and containers, its variants under one name."""
    text = fold_accents(normalize_title(title))
    text = F.when(brand.isNull(), text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?<![\\p{L}\\p{N}])"), fold_accents(F.lower(brand)), F.lit("(?![\\p{L}\\p{N}])")), F.lit(" ")))
    for variants, name in VARIANTS:
        text = F.regexp_replace(text, word(variants), name)
    return bound(text, _compared)


def _compared(text: Column) -> Column:
    return Tokens.of(text, _compared_of)


def _compared_of(t: Tokens) -> Column:
    def named(i: Column, name: str) -> Column:
        return (t.at(i) == name) & t.begins(i)

    def whole(i: Column) -> Column:
        """Whether neither letter nor digit touches a token."""
        return t.begins(i) & (t.apart(i) | ~t.at(i + 1).rlike(r"^[\p{L}\d]"))

    def counts(i: Column) -> Column:
        """A number that belongs to an x or a pack before it, and so to no unit after it."""
        return t.number(i) & (t.apart(i) | ~t.at(i + 1).rlike(r"^[\p{L}\d]")) & (named(i - 1, "x") | named(i - 1, "pack"))

    def quantity(i: Column) -> Column:
        """A number with its unit beside it, or beyond a count that is left out."""
        beyond = named(i + 1, "x") & counts(i + 2) & t.at(i + 3).isin(COMPARED_UNITS)
        return t.number(i) & (t.begins(i)) & ~counts(i) & (t.at(i + 1).isin(COMPARED_UNITS) | beyond)

    def kept(token: Column, i: Column) -> Column:
        unit = token.isin(COMPARED_UNITS) & (quantity(i - 1) | (quantity(i - 3) & counts(i - 1)))
        leads = token.isin("x", "pack") & t.begins(i) & counts(i + 1)
        drop = counts(i) | quantity(i) | unit | leads | (token.isin(CONTAINERS) & whole(i)) | ~token.rlike(r"[\p{L}\d]")
        return F.when(drop, " ").otherwise(F.concat(token, F.when(t.apart(i), " ").otherwise("")))

    return F.trim(F.regexp_replace(F.array_join(F.transform(t.all, kept), ""), "[^\\p{L}\\p{N}]+", " "))
