"""Parsers of landed pages on payloads with known results."""

import json

from canasta.sources import landed as L


def pages(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "page long, body string")


def item(number, price, list_price=None, sellers=("1",), unit="un", multiplier=1.0, available=True, quantity=5):
    offer = {"Price": price, "ListPrice": list_price, "IsAvailable": available, "AvailableQuantity": quantity}
    return {"itemId": str(number), "name": "  x  y ", "measurementUnit": unit, "unitMultiplier": multiplier, "sellers": [{"sellerId": s, "commertialOffer": offer} for s in sellers]}


def product(*items, link="https://www.metro.pe/leche/p?x=1", **more):
    return {"productId": "1", "productName": "Leche", "link": link, "items": list(items)} | more


def test_storefront_page(spark):
    whole = json.dumps([
        product(item(11, 4.5, 5.9), item(12, 4.5, 4.0), Envase=[" Lata  grande ", "Envase", ""], Formato=["Caja"]),
        product(item(21, 0), item(22, 3, sellers=("1", "1")), item(23, 3, sellers=("2",)), item(24, 0, available=False), item(25, 3, multiplier=0.5), item(26, 3, unit="kg", multiplier=0.5), item(27, 3, quantity=0)),
        product(item(31, 3), link="https://elsewhere.pe/leche/p"), product(item(32, 3), link="https://www.metro.pe/a/b/p"), product(item(33, 3), link="https://wwwxmetro.pe/a/p")])
    got = [tuple(r) for r in L.product_page(pages(spark, whole, whole[:300], "[]", "nothing"), "metro").collect()]
    rows = {r[1]: r[2:] for r in got if r[0] == 0}
    assert rows["11"] == ("x y", "UN", "Envase: Lata grande; Formato: Caja", "observed", 450, 590) and rows["12"][-2:] == (450, None)
    verdicts = {k: v[3] for k, v in rows.items()}
    assert verdicts == {
        "11": "observed", "12": "observed", "21": "error:zero-price", "22": "error:two-offers", "23": "skip:no-seller", "24": "skip:unavailable", "25": "error:multiplier", "26": "observed",
        "27": "skip:unavailable", "31": "error:url", "32": "error:url", "33": "error:url"}
    assert rows["26"] == ("x y", "KG", "unitMultiplier: 0.5 kg", "observed", 300, None)
    assert sorted((r[0], r[5]) for r in got if r[0] > 0) == [(1, "corrupt"), (3, "corrupt")]


def test_other_storefront_has_its_own_field_and_site(spark):
    whole = json.dumps([product(item(1, 2), link="https://www.plazavea.com.pe/leche/p") | {"Presentación unitarios vitrina": ["Botella 1L", "Envase"]}, product(item(2, 2))])
    got = {r["external_id"]: (r["package"], r["verdict"]) for r in L.product_page(pages(spark, whole), "plaza-vea").collect()}
    assert got == {"1": ("Botella 1L; Envase", "observed"), "2": (None, "error:url")}


def price(kind, amount, crossed=False, symbol="S/ ", icons="cmr-icon"):
    return {"type": kind, "symbol": symbol, "crossed": crossed, "icons": icons, "price": [amount]}


def result(sku, *prices, unit="UN", url=None):
    return {"productId": "9", "skuId": sku, "displayName": " a  b ", "url": url or L.SITE + "9/a", "measurements": {"unit": unit} if unit else {}, "prices": list(prices)}


def test_hydration_page(spark):
    paid = price("internetPrice", "12.90")
    results = [
        result("1", paid, price("cmrPrice", "11.5")), result("2", price("internetPrice", "1,234.5"), price("cmrPrice", "2000"), price("normalPrice", "1,300")), result("3", paid, unit=None),
        result("4", paid, paid), result("5", price("internetPrice", "3", True), price("internetPrice", "2")), result("6", paid, price("normalPrice", "20"), price("normalPrice", "21")),
        result("7", price("internetPrice", "2", symbol="US$")), result("8", paid, url="https://x.pe/9/"), result("9", paid, price("cmrPrice", "1", icons="other")), result("10", paid, price("cmrPrice", "x")),
        result("11", paid, price("cmrPrice", "1"), price("cmrPrice", "2")), result("12", paid, price("normalPrice", "12.90")), result("13", price("internetPrice", "12.905"))]
    data = {"props": {"pageProps": {"pagination": {"currentPage": 3, "perPage": 48}, "results": results}}}
    html = f'<html><script async id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script></html>'
    got = {r["external_id"]: (r["verdict"], r["cents"], r["regular_cents"], r["benefit_cents"]) for r in L.hydration_page(pages(spark, html, "<html></html>")).collect()}
    ok = ("observed", 1290, None, None)
    assert got == {
        "1": ("observed", 1290, None, 1150), "2": ("observed", 123450, 130000, None), "3": ("skip:no-unit", None, None, None), "4": ("error:price", None, None, None), "5": ("observed", 200, None, None),
        "6": ("error:price", None, None, None), "7": ("error:currency", None, None, None), "8": ("error:url", None, None, None), "9": ok, "10": ok, "11": ok, "12": ok, "13": ("error:price", None, None, None)}
    assert [(r["state"], r["number"]) for r in L.hydration_rows(pages(spark, html, "<html></html>")).orderBy("page").collect()] == [("read", 3), ("corrupt", None)]


def test_product_detail(spark):
    body = lambda *v: json.dumps({"variants": [{"sku": s, "available": a, "price": p} for s, a, p in v]})
    df = pages(spark, body(("1", True, "9.90")), body(("2", False, "9.90")), body(("3", None, "9.90")), body(("4", True, "1"), ("5", True, "1")), "{")
    assert {r["sku"]: (r["outcome"], r["cents"]) for r in L.product_detail(df).collect()} == {"1": ("observed", 990), "2": ("unavailable", None), "3": ("unknown", None), "4": ("ambiguous", None)}


def test_category_leaves(spark):
    tree = [{"id": "1", "name": "Food", "children": [{"id": "11", "name": "Dry", "children": [{"id": "111", "name": "Rice"}, {"id": "112", "name": "Oil"}]}, {"id": "12", "name": "Fresh", "children": []}]}, {"id": "2", "name": "Toys", "children": []}, {"id": "3", "name": "Home", "children": []}]
    got = {r["key"]: r["path"] for r in L.category_leaves(pages(spark, json.dumps(tree)), allowed=("Food", "Home")).collect()}
    assert got == {"111": "Food / Dry / Rice", "112": "Food / Dry / Oil", "12": "Food / Fresh", "3": "Home"}
