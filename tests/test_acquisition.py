"""Sources as keyed state: transitions, the stream against the fold, and the stop rule."""

import datetime

from pyspark.sql import functions as F

from canasta.plans.control import acquired
from canasta.streaming import acquisition as A
from canasta.streaming import ingest

SF, H = "/root/testdata/sf0.001", A.HOUR


def states(*events):
    s, said = A.start(), []
    for kind, hours, found in events:
        s, outcome = A.step(s, kind, int(hours * H), found)
        said.append(outcome)
    return s, said


def test_back_off_and_leases():
    s, said = states(("page", 1, 5), ("failure", 2, 0), ("page", 3, 5), ("page", 8, 5), ("cycle", 9, 2), ("page", 20, 1), ("page", 29, 1))
    assert said == ["page", "failed", "not_due", "page", "cycle", "not_due", "page"]
    assert (s["cursor"], s["cycle"], s["last_cycle"], s["pages"], s["products"], s["completed"], s["error"]) == (A.PAGE, 1, 12, 4, 13, 9 * H, None)
    s, said = states(("crash", 1, 0), ("page", 1.05, 1), ("page", 1.1, 1))
    assert said == ["crashed", "leased", "page"] and s["lease_until"] == 0


def test_requests_bring_sources_forward():
    assert states(("cycle", 1, 0), ("request", 2, 0), ("page", 4.9, 1), ("page", 5, 1))[1] == ["cycle", "requested", "not_due", "page"]
    assert states(("redirect", 1, 0), ("request", 2, 0), ("page", 6, 1))[1] == ["failed", "ignored", "not_due"]
    assert states(("request", 1, 0), ("cycle", 2, 0))[0]["due"] == 6 * H  # asked for within a day: four hours


def test_the_last_page_that_is_served():
    s = A.start() | {"cursor": A.LAST_FROM, "cycle": 9, "last_cycle": 4}
    s, outcome = A.step(s, "page", 30 * H, 3)
    assert outcome == "limited" and (s["cursor"], s["cycle"], s["last_cycle"], s["error"], s["due"], s["completed"]) == (0, 0, 4, "pagination_limit", 50 * H, 0)
    assert A.step(s, "page", 50 * H, 1)[0]["error"] == "pagination_limit"


def test_stream_of_several_files_equals_the_fold(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    half = events.orderBy("ts").limit(500).agg(F.max("ts")).first()[0]
    A.state_store(spark)
    folder = str(tmp_path / "in")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    for n, part in enumerate((events.where(F.col("ts") <= half), events.where(F.col("ts") > half))):
        part.coalesce(1).write.parquet(str(tmp_path / f"tmp{n}"))
        found = next((tmp_path / f"tmp{n}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        found.rename(tmp_path / "in" / f"events{n}.parquet")
        ingest.run_once(A.acquisition(A.page_stream(spark, folder)), out, checkpoint)
    key = ["source", "event_id", "at_us", "outcome", *A.FIELDS]
    got = spark.read.parquet(out)
    want = acquired(spark, SF)
    assert sorted(map(repr, got.where("outcome <> 'lease_expired'").select(*key).collect())) == sorted(map(repr, want.select(*key).collect()))
    before = got.count()
    ingest.run_once(A.acquisition(A.page_stream(spark, folder)), out, checkpoint)
    assert spark.read.parquet(out).count() == before
    crashes = want.where("outcome = 'crashed'").count()
    assert 0 < got.where("outcome = 'lease_expired'").count() <= crashes


def test_a_run_stops_after_three_redirects_in_a_row(spark):
    def events(kinds):
        start = datetime.datetime(2024, 1, 5, 12)
        rows = [(4, i, start + datetime.timedelta(minutes=i), i, k, 0) for i, k in enumerate(kinds)]
        return spark.createDataFrame(rows, "source long, event_id long, at timestamp, at_us long, kind string, found long")

    def attempted(*kinds):
        return [r["attempted"] for r in A.stop_rule(events(kinds)).orderBy("event_id").collect()]

    assert attempted("redirect", "redirect", "page", "redirect", "redirect", "redirect", "page", "cycle") == [True] * 6 + [False] * 2
    assert attempted("redirect", "redirect", "failure", "redirect", "redirect") == [True] * 5
    assert attempted("request", "redirect") == [True]


def test_claims_take_asked_sources_first(spark):
    rows = [(4, {}), (8, {"attempted": 5}), (12, {"requested": 3, "completed": 1, "attempted": 9}), (16, {"due": 99}), (20, {"lease_until": 99}), (5, {"attempted": 7, "requested": 1, "completed": 2}), (9, {"attempted": 6})]
    df = spark.createDataFrame([(i, *((A.start() | s)[f] for f in A.FIELDS)) for i, s in rows], f"source long, {A.STATE}")
    assert {r["retailer"]: (r["source"], r["open"]) for r in A.claims(df, F.lit(50)).collect()} == {0: (12, 3), 1: (9, 2)}
