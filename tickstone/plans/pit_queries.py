"""Queries of the point-in-time operators over the tables of a data folder, and SQL for each that SQL can express.

Panels made of the tables: A, daily bars of ``events`` by event type; B, monthly bars of ``lineitem`` by supplier modulo 8; C, daily bars of
``lineitem`` by supplier; D, ``supplier`` as a list of weights.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickstone.functions.columns import DAY_US, norm_symbol, zone_day
from tickstone.operators.bars import daily_from_events, daily_to_pit, visible_at_ticks
from tickstone.operators.evaluation import metrics, predict, split, train_baseline
from tickstone.operators.features import add_features, buy_and_hold, drawdown, momentum, trailing_mean, usable_labels
from tickstone.operators.features import overnight_gap as gaps
from tickstone.operators.hot import latest
from tickstone.operators.simulation import CostModel, fold, missing_next, repeated, session_terms
from tickstone.operators.weights import DUST, Limits, decision, limited, top_equal
from tickstone.plans.flow import replay_differences
from tickstone.plans.reports import checked_scores
from tickstone.sources.calendar import session_table, weekdays
from tickstone.sources.pit_store import coverage, keep_first, new_keys, visible
from tickstone.sources.files import distinct_symbols
from tickstone.sources.tables import table

NOW = datetime(2024, 1, 25, 12, tzinfo=UTC)
TRAIN_END, EVAL_START = date(2024, 1, 18), date(2024, 1, 20)
NTZ = "timestamp_ntz"


def _at(d: date | datetime) -> Column:
    return F.lit(d.strftime("%Y-%m-%d %H:%M:%S")).cast(NTZ)


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Events as bars of one value, available 15 minutes later."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("event_time"), (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).cast("timestamp").alias("available_at"), F.col("value").alias("close"))


BARS = "bars AS (SELECT event_id, event_type AS symbol, ts AS event_time, ts + INTERVAL 15 MINUTE AS available_at, value AS close FROM events)"


def panel_a(spark: SparkSession, d: str) -> DataFrame:
    daily = daily_from_events(table(spark, d, "events"))
    at = F.col("session").cast(NTZ) + F.expr("INTERVAL 16 HOURS")
    return daily.withColumn("event_time", at).withColumn("available_at", F.col("event_time") + F.expr("INTERVAL 15 MINUTES"))


PANEL_A = """panel_a AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS session, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*) AS volume,
         CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 16 HOUR AS event_time, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 975 MINUTE AS available_at
  FROM events WHERE value > 0 AND NOT isnan(value) GROUP BY event_type, CAST(ts AS DATE))"""


def panel_b(spark: SparkSession, d: str) -> DataFrame:
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("string").alias("symbol"), F.trunc("l_shipdate", "month").cast(NTZ).alias("event_time"))
    bars = rows.agg(F.min(price).alias("open"), F.avg(price).alias("close"), F.sum("l_extendedprice").alias("adv_dollars"))
    return bars.withColumns({"target_weight": F.lit(0.005), "annual_volatility": F.lit(0.2), "signal_available_at": F.col("event_time")})


PANEL_B = """panel_b AS (
  SELECT CAST(l_suppkey % 8 AS VARCHAR) AS symbol, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS event_time,
         min(l_extendedprice / l_quantity) AS open, avg(l_extendedprice / l_quantity) AS close, sum(l_extendedprice) AS adv, 0.005 AS target, 0.2 AS vol
  FROM lineitem GROUP BY 1, 2)"""


def panel_c(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("session"))
    return rows.agg(F.round(F.avg("l_extendedprice"), 4).alias("close"), F.round(F.sum("l_extendedprice"), 2).alias("dollars"))


PANEL_C = """panel_c AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS session, round(avg(l_extendedprice), 4) AS close, round(sum(l_extendedprice), 2) AS dollars
  FROM lineitem GROUP BY 1, 2)"""


def panel_d(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    total = F.sum(F.abs("s_acctbal")).over(Window.partitionBy((F.col("s_suppkey") % 5)))
    return s.select(
        (F.col("s_suppkey") % 5).alias("tick"), F.col("s_suppkey").alias("symbol"), F.round(F.lit(1.4) * F.col("s_acctbal") / total, 9).alias("weight"), F.col("s_nationkey").cast("string").alias("sector"),
        F.when(F.col("s_suppkey") % 7 > 0, F.abs("s_acctbal") * 10 + 1).alias("adv"), F.lit(0.01).alias("current"),
    )


PANEL_D = """panel_d AS (
  SELECT s_suppkey % 5 AS tick, s_suppkey AS symbol, round(1.4 * s_acctbal / sum(abs(s_acctbal)) OVER (PARTITION BY s_suppkey % 5), 9) AS weight, CAST(s_nationkey AS VARCHAR) AS sector,
         CASE WHEN s_suppkey % 7 > 0 THEN abs(s_acctbal) * 10 + 1 END AS adv, 0.01 AS current
  FROM supplier)"""


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def pit_visible_bars(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d).where(visible(NOW)).where(F.col("symbol").isin("click", "purchase")).where(F.col("event_time") >= F.lit(datetime(2024, 1, 10, tzinfo=UTC)))
    return b.select("event_id", "symbol", F.col("event_time").cast(NTZ).alias("event_time"), "close").orderBy("event_time", "symbol")


def pit_excluded_count(spark: SparkSession, d: str) -> DataFrame:
    seen = F.coalesce(F.col("available_at") <= F.lit(NOW), F.lit(False))
    return _bars(spark, d).agg(F.count_if(seen).alias("visible"), F.count_if(~seen).alias("excluded"))


def pit_asof_ticks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("symbol"), (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("available_at"), "event_id", "value")
    ticks = spark.range(0, 40).select((F.lit("2023-12-31 21:00:00").cast(NTZ) + F.make_dt_interval(hours=(F.col("id") * 18).cast("int"))).alias("tick_at"))
    return visible_at_ticks(rows, ticks, "symbol").select("symbol", "tick_at", "event_id", "value")


def bars_daily_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    return daily_from_events(table(spark, d, "events"))


def bar_to_pit_close(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of every symbol's days in ``pit_bars`` against the calendar: full and short sessions, and days without one."""
    b = table(spark, d, "pit_bars").where("event_time is not null")
    start = F.timestamp_micros(F.unix_date(zone_day("event_time", "UTC")).cast("bigint") * DAY_US + 5 * 3_600_000_000)
    daily = b.groupBy(norm_symbol("symbol").alias("symbol"), start.alias("ts")).agg(F.min("close").alias("close")).where("symbol is not null")
    raw = daily.select("symbol", "ts", *(F.col("close").alias(c) for c in ("open", "high", "low", "close", "volume", "vwap")))
    p = daily_to_pit(raw, table(spark, d, "exchange_sessions"))
    return p.select("symbol", F.col("event_time").cast(NTZ).alias("event_time"), F.col("available_at").cast(NTZ).alias("available_at"), "close")


def calendar_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = session_table(spark, date(2025, 1, 1), date(2025, 12, 31))
    return s.select("session_date", F.col("open_utc").cast(NTZ).alias("open_utc"), F.col("close_utc").cast(NTZ).alias("close_utc"))


def business_days(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in weekdays(date(2020, 1, 1), date(2023, 7, 14))], "day date")


def keep_first_dedup(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    rest = [c for c in li.columns if c not in ("l_orderkey", "l_linenumber", "l_shipdate")]
    return keep_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", *rest]).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")


def new_keys_antijoin(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    stored = li.where("l_shipdate < timestamp_ntz'1998-01-01 00:00:00'")
    fresh = li.where("l_shipdate >= timestamp_ntz'1998-01-01 00:00:00'")
    return new_keys(fresh, stored, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_extendedprice")


def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    return coverage(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("event_time")))


def features_lag_ret(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(add_features(panel_a(spark, d)).select("symbol", "session", "ret_1", "ret_5"))


def features_label(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(add_features(panel_a(spark, d)).select("symbol", "session", "target_return", "target_available_at"))


def features_vol20(spark: SparkSession, d: str) -> DataFrame:
    c = panel_c(spark, d).withColumn("available_at", F.col("session"))
    return _rounded(add_features(c).select("symbol", "session", "vol_20"), 6)


def _frame(spark: SparkSession, d: str) -> DataFrame:
    seen = panel_a(spark, d).where(F.col("available_at") <= _at(NOW))
    return usable_labels(add_features(seen), _at(NOW))


def feature_frame(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_frame(spark, d).select("symbol", "session", "ret_1", "ret_5", "vol_20", "target_return", "target_available_at"))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return split(_frame(spark, d), _at(TRAIN_END), F.lit(EVAL_START), _at(NOW))


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    train, held = _split(spark, d)
    return train.agg(F.count("*").alias("n")).select(F.lit("train").alias("part"), "n").unionByName(held.agg(F.count("*").alias("n")).select(F.lit("eval").alias("part"), "n"))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics(_split(spark, d)[1].withColumn("prediction", F.col("ret_1") * 0.1 - F.col("ret_5") * 0.05)), 8)


def train_gbt(spark: SparkSession, d: str) -> DataFrame:
    train, held = _split(spark, d)
    return metrics(predict(train_baseline(train), held))


def topk_equal_weight(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("tick"), F.col("c_name").alias("symbol"), F.col("c_acctbal").alias("score"))
    return _rounded(top_equal(c, 25))


def _limited(spark: SparkSession, d: str) -> DataFrame:
    return limited(panel_d(spark, d), Limits(), adv="adv", equity=2000.0, sector="sector", current="current", drawdown=0.16, volatility=0.25)


def limited_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_limited(spark, d).where(F.col("limited") > DUST).select("tick", "symbol", "limited"))


def limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(decision(_limited(spark, d)).select("tick", "gross", F.array_join("constraints", ",").alias("constraints")))


def sector_scale(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(limited(panel_d(spark, d), Limits(max_name_weight=1.0), sector="sector").select("tick", "symbol", "sector", "limited"))


def cost_model(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    cost = CostModel(commission_bps=1.0).dollars(F.col("l_extendedprice"), F.col("l_quantity") * 1e5, F.col("l_discount") + 0.1)
    return li.groupBy("l_returnflag", "l_suppkey").agg(F.round(F.sum(cost), 4).alias("cost"), F.count("*").alias("n"))


def sim_session_terms(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(session_terms(panel_b(spark, d)), 7)


def sim_equity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fold(session_terms(panel_b(spark, d))), 6)


def holdings_missing_check(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).cast("string").alias("symbol"), F.to_date("l_shipdate").cast(NTZ).alias("event_time"), F.lit(0.01).alias("target_weight")).distinct()
    return missing_next(p).select("event_time", "symbol")


def holdings_missing_panel_c(spark: SparkSession, d: str) -> DataFrame:
    """As ``holdings_missing_check``, with every supplier its own symbol: the whole of panel C."""
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").cast(NTZ).alias("event_time"), F.lit(0.01).alias("target_weight")).distinct()
    return missing_next(p).select("event_time", "symbol")


def replay_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("tick"), F.col("o_orderkey").cast("string").alias("node"), F.col("o_orderstatus").alias("output"))
    return replay_differences(o.where("node % 11 <> 0"), o.where("node % 13 <> 0").withColumn("output", F.when(F.col("node") % 17 == 0, F.lit("x")).otherwise(F.col("output"))))


def universe_clean(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where(F.col("p_type").isin("ECONOMY", "SMALL"))
    return distinct_symbols(p.select(F.concat(F.lit(" \t"), "p_name", F.lit(" ")).alias("symbol")))


def event_log_parse(spark: SparkSession, d: str) -> DataFrame:
    last = latest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 1, "event_id")
    return last.select("user_id", "event_id", F.from_json("props", "k int").getField("k").alias("k"))


def recent_outputs(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5, "event_id").select("user_id", "event_id", "place")


def momentum_12_1(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(momentum(panel_c(spark, d)).where("momentum is not null").select("symbol", "session", "momentum"), 6)


def equity_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(drawdown(panel_c(spark, d), "symbol", "session", "close").select("symbol", "session", "drawdown"), 6)


def adv_20(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trailing_mean(panel_c(spark, d), F.col("dollars")).select("symbol", "session", "adv"), 5)


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """Scored answers about documents: some out of range, some with evidence that the document does not hold, some in no format."""
    docs = table(spark, d, "documents").where("doc_id is not null")
    score = (F.col("doc_id") % 5 - 2) / 1.5
    evidence = F.when(F.col("doc_id") % 3 == 0, F.reverse("text")).when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.substring("text", 3, 25))
    answer = F.when(F.col("doc_id") % 11 == 0, F.lit("no json")).otherwise(F.to_json(F.struct(score.alias("score"), evidence.alias("evidence"))))
    checked = checked_scores(docs.select("doc_id", answer.alias("answer"), F.col("text").alias("source")))
    return checked.select("doc_id", F.coalesce("problem", F.lit("")).alias("problem"))


def overnight_gap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(gaps(panel_a(spark, d)).select("symbol", "session", "gap"))


def buy_and_hold_growth(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(buy_and_hold(panel_a(spark, d)), 9)


def dup_key_check(spark: SparkSession, d: str) -> DataFrame:
    return repeated(table(spark, d, "lineitem"), ["l_suppkey", "l_shipdate"])


def _dated(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with dates as texts, which every client compares alike."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.withColumns({c.name: F.date_format(c.name, "yyyy-MM-dd") for c in df.schema.fields if c.dataType.typeName() == "date"})

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _dated(f)
    for f in (
        pit_visible_bars, pit_excluded_count, pit_asof_ticks, bars_daily_ohlcv, bar_to_pit_close, calendar_sessions, business_days, keep_first_dedup, new_keys_antijoin, coverage_stats,
        dup_key_check, features_lag_ret, features_label, features_vol20, feature_frame, split_counts, eval_metrics, train_gbt, topk_equal_weight, limited_weights, limit_decisions,
        sector_scale, cost_model, sim_session_terms, sim_equity, holdings_missing_check, holdings_missing_panel_c, replay_diff, universe_clean, event_log_parse, recent_outputs, momentum_12_1, equity_drawdown,
        adv_20, evidence_gate, overnight_gap, buy_and_hold_growth,
    )
}

FEATURES = """features AS (
  SELECT *, CASE WHEN count(ret_1) OVER w20 >= 10 THEN stddev_samp(ret_1) OVER w20 END AS vol_20
  FROM (SELECT *, close / lag(close, 1) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5, lead(close, 1) OVER w / close - 1 AS target_return, lead(available_at, 1) OVER w AS target_available_at
        FROM seen WINDOW w AS (PARTITION BY symbol ORDER BY session))
  WINDOW w20 AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
NOW_SQL = "TIMESTAMP '2024-01-25 12:00:00'"
USABLE = f"target_available_at <= {NOW_SQL} AND target_return IS NOT NULL AND ret_1 IS NOT NULL AND ret_5 IS NOT NULL AND vol_20 IS NOT NULL"
FRAME = f"WITH {PANEL_A}, seen AS (SELECT * FROM panel_a WHERE available_at <= {NOW_SQL}), {FEATURES}, frame AS (SELECT * FROM features WHERE {USABLE})"
ALL_FEATURES = f"WITH {PANEL_A}, seen AS (SELECT * FROM panel_a), {FEATURES}"
LIMITS = f"""WITH {PANEL_D},
s2 AS (SELECT *, weight < 0 AS b1, greatest(weight, 0) AS w1 FROM panel_d),
s3 AS (SELECT *, w1 > 0.05 AS b2, least(w1, 0.05) AS w2 FROM s2),
sd AS (SELECT * REPLACE (least(w2, current) AS w2), w2 > current AS b7 FROM s3),
s4 AS (SELECT *, adv IS NULL AND w2 > 0 AS b3, CASE WHEN adv IS NULL THEN 0 ELSE w2 END AS w3 FROM sd),
s5 AS (SELECT *, adv IS NOT NULL AND w3 > adv * (0.01 / 2000.0) AS b4, CASE WHEN adv IS NOT NULL THEN least(w3, adv * (0.01 / 2000.0)) ELSE w3 END AS w4 FROM s4),
s6 AS (SELECT *, sum(w4) OVER (PARTITION BY tick, sector) AS t5 FROM s5),
s7 AS (SELECT *, t5 > 0.30 AS b5, CASE WHEN t5 > 0.30 THEN w4 * 0.30 / t5 ELSE w4 END AS w5 FROM s6),
s8 AS (SELECT *, sum(w5) OVER (PARTITION BY tick) AS t6 FROM s7),
s9 AS (SELECT *, t6 > 1.0 AS b6, w5 * least(CASE WHEN t6 > 1.0 THEN 1.0 / t6 ELSE 1.0 END, 0.15 / 0.25) AS limited FROM s8)"""
TERMS = f"""WITH {PANEL_B},
i AS (SELECT *, sum(target * close / open - target) OVER (PARTITION BY event_time) AS r_in FROM panel_b),
h AS (SELECT *, target * close / open / (1 + r_in) AS held FROM i),
g AS (SELECT *, coalesce(lag(held) OVER w, 0) AS was, coalesce(open / lag(close) OVER w, 1) AS gap FROM h WINDOW w AS (PARTITION BY symbol ORDER BY event_time)),
o AS (SELECT *, sum(was * (gap - 1)) OVER (PARTITION BY event_time) AS r_over FROM g),
m AS (SELECT *, abs(target - was * gap / (1 + r_over)) AS d FROM o),
terms AS (SELECT event_time, any_value(r_over) AS r_over, any_value(r_in) AS r_in, sum(d) AS turnover, 0.00025 * sum(d) AS a, sum(0.1 * vol * pow(d, 1.5) / sqrt(adv)) AS b FROM m GROUP BY event_time)"""

SQL: dict[str, str] = {
    "pit_visible_bars": f"WITH {BARS} SELECT event_id, symbol, event_time, close FROM bars WHERE available_at <= {NOW_SQL} AND symbol IN ('click', 'purchase') AND event_time >= TIMESTAMP '2024-01-10' AND event_time <= {NOW_SQL}",
    "pit_excluded_count": f"WITH {BARS} SELECT count(*) FILTER (WHERE available_at <= {NOW_SQL}) AS visible, count(*) FILTER (WHERE NOT coalesce(available_at <= {NOW_SQL}, false)) AS excluded FROM bars",
    "pit_asof_ticks": f"""WITH {BARS}, ticks AS (SELECT TIMESTAMP '2023-12-31 21:00:00' + to_hours(18 * CAST(i AS INTEGER)) AS tick_at FROM range(40) t(i)), keys AS (SELECT DISTINCT symbol FROM bars)
SELECT k.symbol, t.tick_at, b.event_id, b.close AS value FROM keys k CROSS JOIN ticks t ASOF JOIN bars b ON b.symbol = k.symbol AND b.available_at <= t.tick_at""",
    "bars_daily_ohlcv": f"WITH {PANEL_A} SELECT symbol, session, open, high, low, close, volume FROM panel_a",
    "calendar_sessions": "SELECT session_date, open_utc AT TIME ZONE 'UTC' AS open_utc, close_utc AT TIME ZONE 'UTC' AS close_utc FROM exchange_sessions",
    "business_days": "SELECT CAST(d AS DATE) AS day FROM range(DATE '2020-01-01', DATE '2023-07-15', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6",
    "keep_first_dedup": """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS k FROM lineitem) WHERE k = 1""",
    "new_keys_antijoin": """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem a WHERE l_shipdate >= TIMESTAMP '1998-01-01'
AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_shipdate < TIMESTAMP '1998-01-01' AND b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber)""",
    "coverage_stats": "SELECT count(*) AS rows, count(DISTINCT l_suppkey) AS symbols, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem",
    "dup_key_check": "SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "features_lag_ret": f"{ALL_FEATURES} SELECT symbol, session, round(ret_1, 9) AS ret_1, round(ret_5, 9) AS ret_5 FROM features",
    "features_label": f"{ALL_FEATURES} SELECT symbol, session, round(target_return, 9) AS target_return, target_available_at FROM features",
    "features_vol20": f"WITH {PANEL_C}, seen AS (SELECT *, session AS available_at FROM panel_c), {FEATURES} SELECT symbol, session, round(vol_20, 6) AS vol_20 FROM features",
    "feature_frame": f"{FRAME} SELECT symbol, session, round(ret_1, 9) AS ret_1, round(ret_5, 9) AS ret_5, round(vol_20, 9) AS vol_20, round(target_return, 9) AS target_return, target_available_at FROM frame",
    "split_counts": f"""{FRAME} SELECT 'train' AS part, count(*) AS n FROM frame WHERE target_available_at <= TIMESTAMP '2024-01-18'
UNION ALL SELECT 'eval', count(*) FROM frame WHERE session >= DATE '2024-01-20' AND target_available_at <= {NOW_SQL}""",
    "eval_metrics": f"""{FRAME}, held AS (SELECT ret_1 * 0.1 - ret_5 * 0.05 AS p, target_return AS a FROM frame WHERE session >= DATE '2024-01-20' AND target_available_at <= {NOW_SQL})
SELECT count(*) AS n, round(sqrt(avg((p - a) * (p - a))), 8) AS rmse, round(sqrt(avg(a * a)), 8) AS zero_rmse,
       round(coalesce(covar_pop(p, a) / nullif(stddev_pop(p) * stddev_pop(a), 0), 0), 8) AS correlation FROM held""",
    "topk_equal_weight": """SELECT tick, symbol, CAST(rank AS INTEGER) AS rank, round(1.0 / count(*) OVER (PARTITION BY tick), 9) AS weight FROM (
SELECT c_nationkey AS tick, upper(replace(trim(c_name), ' ', '.')) AS symbol, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS rank FROM customer WHERE c_acctbal > 0) WHERE rank <= 25""",
    "limited_weights": f"{LIMITS} SELECT tick, symbol, round(limited, 9) AS limited FROM s9 WHERE limited > 1e-12",
    "limit_decisions": f"""{LIMITS}, labels AS (SELECT tick, unnest(list_filter([CASE WHEN b1 THEN 'long_only' END, CASE WHEN b2 THEN 'max_name_weight' END, CASE WHEN b3 THEN 'missing_adv' END, CASE WHEN b4 THEN 'liquidity_cap' END,
CASE WHEN b7 THEN 'drawdown_no_new_buys' END, CASE WHEN b5 THEN 'max_sector_weight' END, CASE WHEN b6 THEN 'max_gross_weight' END, 'volatility_target'], lambda x: x IS NOT NULL)) AS l FROM s9)
SELECT t.tick, round(t.gross, 9) AS gross, string_agg(DISTINCT l.l, ',' ORDER BY l.l) AS constraints
FROM (SELECT tick, sum(CASE WHEN limited > 1e-12 THEN limited ELSE 0 END) AS gross FROM s9 GROUP BY tick) t JOIN labels l ON l.tick = t.tick GROUP BY t.tick, t.gross""",
    "sector_scale": f"""WITH {PANEL_D}, p AS (SELECT *, least(greatest(weight, 0), 1.0) AS w FROM panel_d), s AS (SELECT *, sum(w) OVER (PARTITION BY tick, sector) AS t FROM p),
c AS (SELECT *, CASE WHEN t > 0.30 THEN w * 0.30 / t ELSE w END AS v FROM s), g AS (SELECT *, sum(v) OVER (PARTITION BY tick) AS u FROM c)
SELECT tick, symbol, sector, round(CASE WHEN u > 1.0 THEN v / u ELSE v END, 9) AS limited FROM g""",
    "cost_model": """SELECT l_returnflag, l_suppkey, round(sum(l_extendedprice * (0.00035 + 0.1 * (l_discount + 0.1) * sqrt(l_extendedprice / (l_quantity * 1e5)))), 4) AS cost, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "sim_session_terms": f"{TERMS} SELECT event_time, round(r_over, 7) AS r_over, round(r_in, 7) AS r_in, round(turnover, 7) AS turnover, round(a, 7) AS a, round(b, 7) AS b FROM terms",
    "sim_equity": f"""WITH RECURSIVE {TERMS[5:]}, n AS (SELECT *, row_number() OVER (ORDER BY event_time) AS k FROM terms),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS event_time, CAST(0 AS DOUBLE) AS gross_return, CAST(0 AS DOUBLE) AS transaction_costs, CAST(0 AS DOUBLE) AS turnover, CAST(0 AS DOUBLE) AS net_return, CAST(1000 AS DOUBLE) AS equity
UNION ALL
SELECT k, event_time, pre * (1 + r_in) / prior - 1, cost, turnover, (pre - cost) * (1 + r_in) / prior - 1, (pre - cost) * (1 + r_in)
FROM (SELECT n.*, f.equity AS prior, f.equity * (1 + n.r_over) AS pre, n.a * f.equity * (1 + n.r_over) + n.b * pow(f.equity * (1 + n.r_over), 1.5) AS cost FROM f JOIN n ON n.k = f.k + 1))
SELECT event_time, round(gross_return, 6) AS gross_return, round(transaction_costs, 6) AS transaction_costs, round(turnover, 6) AS turnover, round(net_return, 6) AS net_return, round(equity, 6) AS equity FROM f WHERE k > 0""",
    "holdings_missing_check": """WITH p AS (SELECT DISTINCT CAST(l_suppkey % 50 AS VARCHAR) AS symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS event_time FROM lineitem),
t AS (SELECT event_time, lead(event_time) OVER (ORDER BY event_time) AS nxt FROM (SELECT DISTINCT event_time FROM p))
SELECT t.nxt AS event_time, p.symbol FROM p JOIN t ON t.event_time = p.event_time WHERE t.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p q WHERE q.symbol = p.symbol AND q.event_time = t.nxt)""",
    "holdings_missing_panel_c": """WITH p AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS event_time FROM lineitem),
t AS (SELECT event_time, lead(event_time) OVER (ORDER BY event_time) AS nxt FROM (SELECT DISTINCT event_time FROM p))
SELECT t.nxt AS event_time, p.symbol FROM p JOIN t ON t.event_time = p.event_time WHERE t.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p q WHERE q.symbol = p.symbol AND q.event_time = t.nxt)""",
    "replay_diff": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS tick, CAST(o_orderkey AS VARCHAR) AS node, o_orderkey AS k, o_orderstatus AS output FROM orders)
SELECT coalesce(a.tick, b.tick) AS tick, coalesce(a.node, b.node) AS node, CASE WHEN b.node IS NULL THEN 'missing' WHEN a.node IS NULL THEN 'unexpected' ELSE 'changed' END AS difference
FROM (SELECT * FROM o WHERE k % 11 <> 0) a FULL JOIN (SELECT tick, node, CASE WHEN k % 17 = 0 THEN 'x' ELSE output END AS output FROM o WHERE k % 13 <> 0) b ON a.tick = b.tick AND a.node = b.node
WHERE a.node IS NULL OR b.node IS NULL OR a.output <> b.output""",
    "universe_clean": "SELECT DISTINCT upper(replace(trim(p_name), ' ', '.')) AS symbol FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND trim(p_name) <> ''",
    "event_log_parse": "SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "recent_outputs": "SELECT user_id, event_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5",
    "momentum_12_1": f"WITH {PANEL_C} SELECT symbol, session, round(m, 6) AS momentum FROM (SELECT *, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS m FROM panel_c WINDOW w AS (PARTITION BY symbol ORDER BY session)) WHERE m IS NOT NULL",
    "equity_drawdown": f"WITH {PANEL_C} SELECT symbol, session, round(1 - close / max(close) OVER (PARTITION BY symbol ORDER BY session ROWS UNBOUNDED PRECEDING), 6) AS drawdown FROM panel_c",
    "adv_20": f"WITH {PANEL_C} SELECT symbol, session, round(CASE WHEN count(*) OVER w = 20 THEN avg(dollars) OVER w END, 5) AS adv FROM panel_c WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "evidence_gate": """WITH a AS (SELECT doc_id, text, (doc_id % 5 - 2) / 1.5 AS score, CASE WHEN doc_id % 3 = 0 THEN list_reduce(list_prepend('', split(text, '')), lambda x, y: y || x) WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, 3, 25) END AS evidence FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR evidence IS NULL OR evidence = '' THEN 'format' WHEN score NOT BETWEEN -1 AND 1 THEN 'range' WHEN NOT contains(text, evidence) THEN 'evidence' ELSE '' END AS problem FROM a""",
    "buy_and_hold_growth": f"""WITH {PANEL_A}, f AS (SELECT symbol, arg_min(close, session) AS first FROM panel_a GROUP BY symbol)
SELECT session, count(*) AS symbols, round(avg(close / first), 9) AS growth FROM panel_a JOIN f USING (symbol) GROUP BY session""",
    "overnight_gap": f"WITH {PANEL_A} SELECT symbol, session, round(open / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1, 9) AS gap FROM panel_a",
    "bar_to_pit_close": """WITH b AS (SELECT nullif(upper(replace(trim(symbol, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)), ' ', '.')), '') AS symbol, CAST(event_time AT TIME ZONE 'UTC' AS DATE) AS utc_day, min(close) AS close FROM pit_bars WHERE event_time IS NOT NULL GROUP BY 1, 2),
c AS (SELECT b.*, coalesce(s.close_utc, (CAST(b.day AS TIMESTAMP) + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS event_time
      FROM (SELECT *, CAST((CAST(utc_day AS TIMESTAMP) + INTERVAL 5 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS day FROM b WHERE symbol IS NOT NULL) b LEFT JOIN exchange_sessions s ON s.session_date = b.day)
SELECT symbol, event_time, event_time + INTERVAL 15 MINUTE AS available_at, close FROM c""",
}

for _name, _days in {
    "session": ("bars_daily_ohlcv", "features_lag_ret", "features_label", "features_vol20", "feature_frame", "momentum_12_1", "equity_drawdown", "adv_20", "overnight_gap", "buy_and_hold_growth"),
    "session_date": ("calendar_sessions",),
    "day": ("business_days",),
}.items():
    for _q in _days:
        SQL[_q] = f"SELECT * REPLACE (CAST({_name} AS VARCHAR) AS {_name}) FROM ({SQL[_q]})"
