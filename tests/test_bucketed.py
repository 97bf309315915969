"""Bucketed history: the rows of the plain path, without an exchange of them."""

from pyspark.sql import functions as F

from tidemark.operators import history as hs
from tidemark.sources import bucketed as bk


def roll(df):
    return hs.rollup(df, "user_id", ["value"])


def table(df):
    return sorted(df.collect(), key=str)


def history(spark, n=3000):
    # User 7 holds a third of all rows; some rows have no user.
    user = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 31 == 0, F.lit(None)).otherwise(F.col("id") % 200).cast("long")
    return spark.range(n).select(F.col("id").alias("event_id"), user.alias("user_id"), (F.col("id") % 17).cast("double").alias("value"))


def test_bucketed_history_equals_the_plain_path(spark, tmp_path):
    h = history(spark)
    apps = spark.createDataFrame([(i, i * 3 if i else None) for i in range(100)], "front_id long, cust_id long")
    stored = bk.write_bucketed(h, "user_id", str(tmp_path / "h"), 8, hot_rows=100)
    assert table(stored.rows) == table(h)
    assert {r[0] for r in stored.hot.select("user_id").distinct().collect()} == {7, None}
    found, plain = stored.matched(apps, "cust_id"), hs.matched_history(h, apps, "user_id", "cust_id")
    assert table(found.rows) == table(plain)
    rolls = found.rollups(roll)
    assert table(rolls[0].unionByName(rolls[1])) == table(roll(plain))
    assert table(bk.attach_parts(apps, rolls, "cust_id", "user_id")) == table(hs.attach(apps, roll(plain), "cust_id", "user_id"))


def test_no_history_row_is_exchanged(spark, tmp_path):
    stored = bk.write_bucketed(history(spark), "user_id", str(tmp_path / "h"), 8, hot_rows=100)
    apps = history(spark).select(F.col("event_id").alias("front_id"), F.col("user_id").alias("cust_id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        calm = roll(hs.matched_history(stored.calm, apps, "user_id", "cust_id"))
        joined = apps.join(calm, apps["cust_id"] == calm["user_id"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    scans = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
    assert len(scans) == 1
    # Walk from the scan to the root: what stands above it, by indentation.
    depth, above = len(lines[scans[0]]) - len(lines[scans[0]].lstrip(" :+-")), []
    for line in reversed(lines[: scans[0]]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            depth = d
            above.append(line)
    assert above and not any("Exchange" in line for line in above), "\n".join(above)


def test_places_are_opened_again_and_replaced(spark, tmp_path):
    place = str(tmp_path / "h")
    bk.write_bucketed(history(spark), "user_id", place, 4, hot_rows=100)
    spark.sql(f"DROP TABLE {bk._table(place)}")  # as in another session; external files stay
    again = bk.open_bucketed(spark, place, "user_id", 4)
    assert table(again.rows) == table(history(spark))
    assert bk.write_bucketed(history(spark).limit(0), "user_id", place, 4).rows.count() == 0
