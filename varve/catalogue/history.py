"""Time-weighted price statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import giants, peers, scoring, timeseries

from .base import NOW_SQL, R6, now, points, products, query, r6, table
from .peer import PEER_SQL

DAYS = 730


def stats_sql(days: int, current: str | None = None) -> str:
    """CTEs up to one row per product with its statistics, named stats."""
    start = f"({NOW_SQL} - INTERVAL {days} DAY)"
    return f""", held AS (
    SELECT *, lead(observed_at) OVER (PARTITION BY product_id ORDER BY observed_at) AS next_at, last_value(price) OVER (PARTITION BY product_id ORDER BY observed_at ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_price FROM points),
weighted AS (SELECT *, greatest(0, date_diff('microsecond', greatest(observed_at, {start}), least(coalesce(next_at, {NOW_SQL}), {NOW_SQL}))) AS weight, {current or "last_price"} AS current_price FROM held),
summed AS (SELECT *, sum(weight) OVER (PARTITION BY product_id) AS total, sum(weight) OVER (PARTITION BY product_id ORDER BY price, observed_at ROWS UNBOUNDED PRECEDING) AS running FROM weighted),
grouped AS (
    SELECT product_id, max(current_price) AS current_price, max(total) AS total, min(price) FILTER (running * 2 >= total AND weight > 0) AS med, coalesce(sum(weight) FILTER (price < current_price - 0.005), 0) AS below,
           coalesce(sum(weight) FILTER (list_price > price), 0) AS claimed, min(price) FILTER (weight > 0) AS low, max(price) FILTER (weight > 0) AS high, min(price) AS lowest, max(price) AS highest, max(last_price) AS last_price,
           min(observed_at) AS first_at, count(*) FILTER (weight > 0) AS n_held FROM summed GROUP BY product_id),
stats AS (
    SELECT product_id, current_price, CASE WHEN total > 0 THEN med ELSE last_price END AS median, CASE WHEN total > 0 THEN below::DOUBLE / total::DOUBLE ELSE 0.5 END AS percentile,
           CASE WHEN total > 0 THEN claimed::DOUBLE / total::DOUBLE ELSE 0 END AS claim_share, CASE WHEN total > 0 THEN low ELSE last_price END AS min_in_window, CASE WHEN total > 0 THEN high ELSE last_price END AS max_in_window,
           CASE WHEN total > 0 THEN least(lowest, current_price) ELSE lowest END AS min_ever, CASE WHEN total > 0 THEN greatest(highest, current_price) ELSE highest END AS max_ever,
           CASE WHEN total > 0 THEN date_diff('microsecond', greatest(first_at, {start}), {NOW_SQL}) / 86400000000e0 ELSE 0 END AS days_observed, date_diff('microsecond', first_at, {NOW_SQL}) / 86400000000e0 AS days_spanned,
           CASE WHEN total > 0 THEN n_held - 1 ELSE 0 END AS changes FROM grouped)"""


COLUMNS = ("median", "percentile", "claim_share", "min_in_window", "max_in_window", "min_ever", "max_ever", "days_observed", "days_spanned")


def _stats(spark, d, days):
    return timeseries.price_stats(points(spark, d), now(), list_price="list_price", days=days)


def _rounded_sql(days: int) -> str:
    return f"{stats_sql(days)} SELECT product_id, {', '.join(f'{R6(c)} AS {c}' for c in COLUMNS)}, CAST(changes AS BIGINT) AS changes FROM stats"


@query(_rounded_sql(90))
def ts_price_stats(spark, d):
    return _stats(spark, d, 90).select("product_id", *(r6(F.col(c)).alias(c) for c in COLUMNS), "changes")


@query(_rounded_sql(DAYS))
def ts_price_stats_two_years(spark, d):
    return _stats(spark, d, DAYS).select("product_id", *(r6(F.col(c)).alias(c) for c in COLUMNS), "changes")


EVENTS_UNTIL = "2024-01-31 00:00:00"
GIANT_SQL = f"""{stats_sql(20)} SELECT product_id, current_price, {', '.join(f'{R6(c)} AS {c}' for c in COLUMNS)}, CAST(changes AS BIGINT) AS changes FROM stats"""
GIANT_SQL = GIANT_SQL.replace(NOW_SQL, f"TIMESTAMP '{EVENTS_UNTIL}'").replace("ORDER BY observed_at", "ORDER BY observed_at, event_id").replace("FROM points)", "FROM crowded)")


@query(f""", crowded AS (SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS product_id, ts AS observed_at, event_id, value AS price, value * (0.9e0 + event_id % 5 / 10e0) AS list_price FROM events){GIANT_SQL}""")
def ts_giant_histories(spark, d):
    """Values of events as price histories, a third of all rows in one of them, which is dealt out over tasks."""
    rows = table(spark, d, "events").select(
        F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id")).alias("product_id"), F.col("ts").cast("timestamp_ntz").alias("observed_at"), "event_id",
        F.col("value").alias("price"), (F.col("value") * (0.9 + F.col("event_id") % 5 / 10)).alias("list_price"),
    )
    until = F.lit(EVENTS_UNTIL).cast("timestamp_ntz")
    found = giants.price_stats_by_size(rows, until, giant_rows=200, list_price="list_price", days=20, order=["event_id"])
    return found.select("product_id", "current_price", *(r6(F.col(c)).alias(c) for c in COLUMNS), "changes")


@query(f"""{stats_sql(DAYS)} SELECT product_id, current_price, median, {R6('(median - current_price) / median')} AS drop_vs_median FROM stats
WHERE current_price <= min_ever + 0.005 AND changes > 0 AND days_observed >= 3 ORDER BY (median - current_price) / median DESC, product_id LIMIT 20""")
def flagship(spark, d):
    """The largest drops under the time-weighted usual price, among products at their lowest."""
    found = timeseries.drop_vs_median(_stats(spark, d, DAYS)).filter("is_lowest_ever")
    return found.orderBy(F.desc("drop_vs_median"), "product_id").limit(20).select("product_id", "current_price", "median", r6(F.col("drop_vs_median")).alias("drop_vs_median"))


@query("""SELECT product_id, observed_at, price, list_price FROM points WHERE product_id = 42""")
def ts_history(spark, d):
    return timeseries.history(points(spark, d), "product_id", 42).select("product_id", "observed_at", "price", "list_price")


@query(f"""SELECT product_id, observed_at, coalesce(lead(observed_at) OVER (PARTITION BY product_id ORDER BY observed_at), {NOW_SQL}) AS until, price,
price = min(price) OVER (PARTITION BY product_id) AS is_low, price = max(price) OVER (PARTITION BY product_id) AS is_high FROM points QUALIFY count(*) OVER (PARTITION BY product_id) > 1""")
def ts_chart_steps(spark, d):
    return timeseries.chart_steps(points(spark, d), now()).select("product_id", "observed_at", "until", "price", "is_low", "is_high")


@query("""SELECT user_id, ts, value, event_type FROM (SELECT *, lag(value) OVER w AS v, lag(event_type) OVER w AS t, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE n = 1 OR abs(value - v) >= 0.005 OR event_type IS DISTINCT FROM t""")
def ing_change_detection(spark, d):
    events = table(spark, d, "events")
    return timeseries.changes_only(events, "user_id", "ts", "value", in_stock="event_type", order=["event_id"]).select("user_id", "ts", "value", "event_type")


@query(f"""SELECT l_suppkey AS store_id, max(l_shipdate) AS last_seen, count(*) AS rows, date_diff('microsecond', max(l_shipdate), {NOW_SQL}) // 3600000000 AS hours_since FROM lineitem GROUP BY l_suppkey""")
def agg_freshness(spark, d):
    return timeseries.freshness(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "store_id"), "store_id", "l_shipdate", now())


CL = lambda x: f"greatest(0, least(1, {x}))"
SCORED_SQL = f"""{stats_sql(DAYS, "(SELECT 0)").replace("(SELECT 0) AS current_price FROM held", "pr.price AS current_price FROM (SELECT h.* FROM held h) h JOIN (SELECT product_id AS pid, price FROM products) pr ON pid = h.product_id").replace("SELECT *, greatest(0, date_diff", "SELECT h.*, greatest(0, date_diff")},
fields AS (SELECT p.*, s.median, s.percentile, s.claim_share, s.min_ever, s.changes, s.days_observed FROM products p JOIN stats s USING (product_id)),
s1 AS (SELECT *, CASE WHEN median > 0 THEN (median - price) / median ELSE 0 END AS dr, coalesce(price <= min_ever + 0.005 AND changes > 0 AND days_observed >= 3, false) AS low,
    CASE WHEN list_price > price THEN (list_price - price) / list_price ELSE 0 END AS claim FROM fields),
s2 AS (SELECT *, {CL(f"0.55 * {CL('dr / 0.4')} + 0.45 * (1 - percentile) + CASE WHEN low THEN 0.15 ELSE 0 END")} AS hist, {CL('claim / 0.45')} * 0.8 AS merch, {CL('days_observed / 30')} AS ch FROM s1),
s3 AS (SELECT *, {CL("0.32 * ch + 0.15 * CASE WHEN rating_count IS NULL THEN 0 ELSE " + CL("log10(1 + rating_count) / log10(201)") + " END + 0.07 * " + CL("changes / 4e0") + " + CASE WHEN recommend_total >= 20 THEN 0.1 ELSE 0 END")} AS conf,
    greatest(CASE WHEN ch > 0.25 AND claim > 0.15 AND dr < 0.02 THEN {CL('(claim - greatest(0, dr)) * 0.9')} ELSE 0 END, CASE WHEN claim_share > 0.85 AND days_observed > 14 THEN 0.35 ELSE 0 END) AS pen FROM s2),
w AS (SELECT *, recommend_yes::DOUBLE / nullif(recommend_total, 0) AS pp, recommend_total::DOUBLE AS nn, 1.28e0 * 1.28e0 AS z2 FROM s3),
q AS (SELECT *, CASE WHEN recommend_total > 0 THEN {CL("(greatest(0, (pp + z2 / (2 * nn) - 1.28e0 * sqrt((pp * (1 - pp) + z2 / (4 * nn)) / nn)) / (1 + z2 / nn)) - 0.25) / 0.73")}
    WHEN rating IS NOT NULL AND rating_count > 0 THEN 0.45 + ({CL("((rating_count * rating + 5 * 4.3e0) / (rating_count + 5e0) - 3) / 1.8")} - 0.45) * {CL("log10(1 + rating_count) / log10(51)")} ELSE 0.45 END AS qual FROM w),
f AS (SELECT *, {CL("(merch * (1 - pen) * 0.3 + hist * ch) / (0.3 + ch) * (1 - 0.6 * pen)")} AS deal, 0.75 + 0.25 * {CL("log10(1 + greatest(0, median - price, list_price - price)) / log10(501)")} AS boost FROM q),
scored AS (SELECT *, 100 * {CL("deal * (0.35 + 0.65 * qual) * boost * CASE WHEN in_stock = false THEN 0.3 ELSE 1 END * CASE condition WHEN 'open-box' THEN 0.93 WHEN 'refurbished' THEN 0.9 ELSE 1 END * (0.55 + 0.45 * conf)")} AS score FROM f)"""


def scored(spark, d):
    rows = products(spark, d)
    current = points(spark, d).join(rows.select("product_id", F.col("price").alias("now_price")), "product_id")
    stats = timeseries.price_stats(current, now(), list_price="list_price", current="now_price", days=DAYS).drop("current_price")
    return scoring.score(rows.join(stats, "product_id"))


@query(f"""{SCORED_SQL} SELECT product_id, {R6('score')} AS score, {R6('conf')} AS confidence, {R6('pen')} AS fake_deal_penalty, {R6('qual')} AS quality_score, {R6('claim')} AS claimed_discount, {R6(CL('dr'))} AS verified_drop, low AS is_lowest_ever FROM scored""")
def sco_score(spark, d):
    """History, claim, quality, penalties and damping without peers or references."""
    return scored(spark, d).select("product_id", *(r6(F.col(c)).alias(c) for c in ("score", "confidence", "fake_deal_penalty", "quality_score", "claimed_discount", "verified_drop")), "is_lowest_ever")


EVIDENCE = {
    "agreement": "CASE WHEN product_id % 3 = 1 THEN 0.8e0 END",
    "typical_price": "CASE WHEN product_id % 5 = 0 THEN price * (0.9e0 + product_id % 7 / 20e0) END",
    "known_low": "CASE WHEN product_id % 10 = 0 THEN price * (0.95e0 + product_id % 3 / 20e0) END",
    "reference_confidence": "CASE WHEN product_id % 5 = 0 THEN product_id % 6 / 6e0 END",
    "inherited_quality": "product_id % 8 = 0",
    "global_mean_rating": "4.1e0",
}
CLAIMED = "CASE WHEN product_id % 4 = 0 THEN list_price * 1.5e0 ELSE list_price END"
WHOLE = lambda x: f"CAST(CAST(floor({x} + 0.5e0) AS BIGINT) AS VARCHAR)"
PERCENT = lambda x: f"concat({WHOLE(f'({x}) * 100')}, ' %')"
LOG = lambda x, full: CL(f"log10(1 + {x}) / log10({full + 1}e0)")


@query(f"""{SCORED_SQL[: SCORED_SQL.index('fields AS')]}{PEER_SQL.lstrip(', ')},
shown AS (SELECT * REPLACE ({CLAIMED} AS list_price), {', '.join(f'{v} AS {k}' for k, v in EVIDENCE.items())} FROM products),
fields AS (SELECT p.*, s.median, s.percentile, s.claim_share, s.min_ever, s.changes, s.days_observed, e.* EXCLUDE (product_id) FROM shown p JOIN stats s USING (product_id) LEFT JOIN peers e USING (product_id)),
e1 AS (SELECT *, CASE WHEN median > 0 THEN (median - price) / median ELSE 0 END AS dr, coalesce(price <= min_ever + 0.005 AND changes > 0 AND days_observed >= 3, false) AS low, coalesce(price <= min_ever + 0.005 AND changes > 0 AND days_observed > 0, false) AS short_low,
    CASE WHEN list_price > price THEN (list_price - price) / list_price ELSE 0 END AS claim, CASE condition WHEN 'open-box' THEN 0.15e0 WHEN 'refurbished' THEN 0.22e0 ELSE 0e0 END AS expected,
    coalesce(peer_size >= 5 AND NOT peer_outlier, false) AS fit, coalesce(peer_size >= 8 AND peer_cohesion > 0.35 AND NOT peer_outlier, false) AS firm, coalesce(reference_confidence > 0, false) AS referred,
    coalesce(known_low > 0 AND price <= known_low * 1.02e0, false) AS at_low, coalesce(CASE WHEN typical_price > 0 THEN (typical_price - price) / typical_price END, 0) AS under, coalesce(list_price / peer_p90, 0) AS list_ratio, coalesce(price / peer_median, 0) AS price_ratio FROM fields),
e2 AS (SELECT *, {CL(f"0.55 * {CL('dr / 0.4')} + 0.45 * (1 - percentile) + CASE WHEN low THEN 0.15 ELSE 0 END")} AS hist, {CL('claim / 0.45')} * 0.8 AS merch, {CL('days_observed / 30')} AS ch,
    CASE WHEN fit THEN {CL(f"0.6e0 * {CL('(peer_below - expected) / 0.3e0')} + 0.4e0 * (1 - peer_percentile)")} ELSE 0 END AS peer, CASE WHEN fit THEN {CL('log10(peer_size) / log10(40e0)')} * peer_cohesion ELSE 0 END AS peer_conf,
    referred AND (typical_price > 0 OR coalesce(known_low > 0, false)) AS has_ref, {CL('greatest(dr, CASE WHEN firm THEN peer_below - expected ELSE 0 END)')} AS verified FROM e1),
e3 AS (SELECT *, CASE WHEN has_ref THEN {CL(f"{CL('under / 0.3e0')} * 0.75e0 + CASE WHEN at_low THEN 0.35e0 ELSE 0 END")} ELSE 0 END AS ref, CASE WHEN has_ref THEN 0.45e0 * reference_confidence ELSE 0 END AS ref_w,
    firm AND claim > 0.2 AND list_ratio > 1.05 AND price_ratio > 0.7 AS implausible, ch > 0.25 AND claim > 0.15 AND dr < 0.02 AS unconfirmed, coalesce(claim_share > 0.85 AND days_observed > 14, false) AS permanent,
    recommend_yes::DOUBLE / nullif(recommend_total, 0) AS pp, recommend_total::DOUBLE AS nn, 1.28e0 * 1.28e0 AS z2 FROM e2),
e4 AS (SELECT *, {CL(f"0.32e0 * ch + 0.16e0 * peer_conf + 0.12e0 * ref_w + 0.15e0 * coalesce({LOG('rating_count', 200)}, 0) * CASE WHEN rating_count IS NULL THEN 0 ELSE 1 END + 0.07e0 * {CL('changes / 4e0')} + 0.1e0 * coalesce(agreement, 0) + CASE WHEN recommend_total >= 20 THEN 0.1e0 ELSE 0 END")} AS conf,
    greatest(CASE WHEN implausible THEN {CL(f"0.35e0 + 0.5e0 * {CL('(list_ratio - 1.05e0) / 0.6e0')}")} ELSE 0 END, CASE WHEN unconfirmed THEN {CL('(claim - greatest(0, dr)) * 0.9')} ELSE 0 END, CASE WHEN permanent THEN 0.35 ELSE 0 END) AS pen,
    CASE WHEN recommend_total > 0 THEN {CL("(greatest(0, (pp + z2 / (2 * nn) - 1.28e0 * sqrt((pp * (1 - pp) + z2 / (4 * nn)) / nn)) / (1 + z2 / nn)) - 0.25) / 0.73")}
    WHEN rating IS NOT NULL AND rating_count > 0 THEN 0.45 + ({CL("((rating_count * rating + 5 * global_mean_rating) / (rating_count + 5e0) - 3) / 1.8")} - 0.45) * {LOG('rating_count', 50)} ELSE 0.45 END AS qual FROM e3),
e5 AS (SELECT *, {CL("(merch * (1 - pen) * 0.3e0 + hist * ch + peer * (0.8e0 * peer_conf) + ref * ref_w) / (0.3e0 + ch + 0.8e0 * peer_conf + ref_w) * (1 - 0.6e0 * pen)")} AS deal, 0.75 + 0.25 * {LOG('greatest(0, median - price, list_price - price)', 500)} AS boost FROM e4)
SELECT product_id, {R6(f"100 * {CL("deal * (0.35 + 0.65 * qual) * boost * CASE WHEN in_stock = false THEN 0.3 ELSE 1 END * CASE condition WHEN 'open-box' THEN 0.93 WHEN 'refurbished' THEN 0.9 ELSE 1 END * (0.55 + 0.45 * conf)")}")} AS score,
    {R6('conf')} AS confidence, {R6('pen')} AS fake_deal_penalty, {R6('verified')} AS verified_drop, {R6('peer')} AS peer_signal, {R6('peer_conf')} AS peer_confidence, {R6('ref')} AS reference_signal,
    concat_ws(' | ', CASE WHEN low THEN concat('lowest price in ', {WHOLE('days_observed')}, ' days') END, CASE WHEN implausible THEN 'list price above that of nearly all comparable products' END, CASE WHEN unconfirmed THEN 'claimed discount not confirmed by the history' END,
    CASE WHEN permanent THEN 'always on sale' END, CASE WHEN short_low AND NOT low THEN 'lowest seen so far, over a short time' END, CASE WHEN dr >= 0.08 THEN concat({PERCENT('dr')}, ' under the usual price') END,
    CASE WHEN fit AND peer_cohesion > 0.35 AND peer_below >= 0.1 THEN concat({PERCENT('peer_below')}, ' under the median of ', CAST(peer_size AS VARCHAR), ' comparable products') END,
    CASE WHEN referred AND at_low THEN 'at the lowest documented price' WHEN referred AND price < typical_price * 0.9e0 THEN concat({PERCENT('1 - price / typical_price')}, ' under the documented usual price') END,
    CASE WHEN claim >= 0.1 AND pen = 0 THEN concat('claimed discount of ', {PERCENT('claim')}) END,
    CASE WHEN recommend_total >= 20 AND recommend_yes IS NOT NULL THEN concat({PERCENT('recommend_yes / recommend_total')}, ' recommend it', CASE WHEN inherited_quality THEN ' (same model, new)' ELSE '' END)
        WHEN rating IS NOT NULL AND rating_count >= 20 THEN concat(printf('%.1f', rating), ' of 5', CASE WHEN inherited_quality THEN ' (same model, new)' ELSE '' END) WHEN coalesce(rating_count, 0) = 0 THEN 'no reviews' END,
    CASE condition WHEN 'open-box' THEN 'open box' WHEN 'refurbished' THEN 'refurbished' END, CASE WHEN ch < 0.35 THEN 'short history' END, CASE WHEN in_stock = false THEN 'out of stock' END) AS reasons FROM e5""")
def sco_score_with_peers(spark, d):
    """Every signal of the score at once: history, claim, peers and outside references, with penalties and reasons."""
    rows = products(spark, d).withColumns({k: F.expr(v) for k, v in EVIDENCE.items()}).withColumn("list_price", F.expr(CLAIMED))
    current = points(spark, d).join(rows.select("product_id", F.col("price").alias("now_price")), "product_id")
    stats = timeseries.price_stats(current, now(), list_price="list_price", current="now_price", days=DAYS).drop("current_price")
    near = peers.peer_stats(rows, key="kind", is_new=F.col("condition") == "new").drop("peer_key")
    found = scoring.score(rows.join(stats, "product_id").join(near, "product_id", "left"))
    parts = ("score", "confidence", "fake_deal_penalty", "verified_drop", "peer_signal", "peer_confidence", "reference_signal")
    return found.select("product_id", *(r6(F.col(c)).alias(c) for c in parts), F.concat_ws(" | ", "reasons").alias("reasons"))


@query(f"""{SCORED_SQL}, ranked AS (SELECT product_id, score, row_number() OVER (PARTITION BY store_id, variant_key ORDER BY floor(score * 1e6 + 0.5) DESC, product_id) AS n, variant_key FROM scored)
SELECT product_id, variant_key IS NULL OR n = 1 AS is_variant_lead FROM ranked""")
def win_leader_election(spark, d):
    rows = scored(spark, d).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5))
    return scoring.elect_leaders(rows).select("product_id", "is_variant_lead")


@query("""SELECT CAST(user_id AS STRING) AS key, ts AS observed_at, value AS price FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE n = 1 OR abs(value - before) >= 0.005""")
def str_changes_with_state(spark, d):
    """The file source, one state per key and a Parquet sink, until what is there is read."""
    import uuid

    from varve.staging import folder
    from varve.streaming import cdc

    out = f"{folder(spark)}/changes-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = stream.select(F.col("user_id").alias("key"), F.col("ts").alias("observed_at"), F.col("value").alias("price"), F.lit(None).cast("double").alias("list_price"), F.lit(None).cast("boolean").alias("in_stock"))
    writer = cdc.changes(rows).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(cdc.OUT).parquet(f"{out}/rows").select("key", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "price")


@query("""SELECT CAST(user_id AS STRING) AS key, ts AS observed_at, value AS price FROM (
    SELECT *, lag(value) OVER w AS before, row_number() OVER w AS n FROM events, (SELECT epoch_us(max(ts)) // 1000 * 1000 - CAST(ceil((epoch_us(max(ts)) - epoch_us(min(ts))) / 2e6) + 1 AS BIGINT) * 1000000 AS settled FROM events)
    WHERE epoch_us(ts) <= settled WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)) WHERE n = 1 OR abs(value - before) >= 0.005""")
def str_ordered_changes(spark, d):
    """Three files, of which each goes back behind the end of the one before, and a restart after each: the changes up to
    the last watermark, in order of time."""
    import uuid

    from varve.staging import folder
    from varve.streaming import ordered

    out = f"{folder(spark)}/ordered-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("value").alias("price"))
    first, last = events.agg(F.unix_micros(F.min("observed_at")), F.unix_micros(F.max("observed_at"))).first()
    slot = F.floor((F.unix_micros("observed_at") - first) * 4 / (last - first + 1))
    late = f"{-(-(last - first) // 2_000_000) + 1} seconds"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STORE)
    try:
        for wave in range(3):
            rows = events.filter(F.floor((slot + F.col("event_id") % 2) / 2) == wave)
            rows.select("key", "observed_at", "price").write.mode("append").parquet(f"{out}/in")
            stream = spark.readStream.schema("key string, observed_at timestamp, price double, list_price double, in_stock boolean").parquet(f"{out}/in")
            writer = ordered.ordered_changes(stream, late).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress")
            writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(ordered.OUT).parquet(f"{out}/rows").select("key", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "price")
