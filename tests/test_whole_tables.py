from loomspark import plans
from loomspark.plans.event_queries import reports
from loomspark.plans.registry import panel

FOLDER = "/root/testdata/sf0.001"


def test_rankings_have_all_events(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    got = plans.queries()["exploded_rankings"](spark, FOLDER)
    assert got.count() == events.count() > 500
    assert got.select("user_id").distinct().count() == events.select("user_id").distinct().count()


def test_peak_measures_have_all_users_days(spark):
    days = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("user_id", "to_date(ts)").distinct().count()
    assert plans.queries()["minute_peak_measures"](spark, FOLDER).count() == days


def test_labels_and_reports_have_all_rows(spark):
    q = plans.queries()
    rows = {s: n for s, n in panel(spark, FOLDER).groupBy("symbol").count().collect()}
    assert q["label_uniqueness"](spark, FOLDER).count() == sum(max(0, n - 8) for n in rows.values())
    barriers = q["triple_barrier"](spark, FOLDER).groupBy("symbol").count().collect()
    assert all(rows[s] - 5 <= n < rows[s] for s, n in barriers) and len(barriers) == len(rows)
    n = reports(spark, FOLDER).count()
    assert q["calendar_growth"](spark, FOLDER).count() == q["quarterly_flows"](spark, FOLDER).count() == n
