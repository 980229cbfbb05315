"""Queries of the store, the sources and sinks, flows, reports and streams over the tables of a data folder, and SQL for each.

Each writes what it needs into a new place of the shared folder and reads it back through the library.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from itertools import pairwise
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstone.operators.simulation import session_terms, violations
from tickstone.operators.weights import weight_faults
from tickstone.plans.clock import Clock, Tick
from tickstone.plans.flow import Context, Flow, FlowBuilder, Message, Node, digest, events, recorded_outputs
from tickstone.plans.pit_queries import BARS, FEATURES, NOW, NTZ, PANEL_A, panel_a, panel_b
from tickstone.plans.pit_queries import SQL as PIT_SQL
from tickstone.plans.reports import Registry, one_of_ranking, run_report, store_payload
from tickstone.plans.tools import BoundTools
from tickstone.schemas import EVENT, PIT_BAR, RAW_BAR, columns, struct
from tickstone.session import scratch
from tickstone.sources.dataset import build_dataset
from tickstone.sources.files import CsvBars, canonical, file_hashes, holdings, raw_bars, synthetic_bars, universe_members, write_csv, write_universe
from tickstone.sources.pit_store import PitStore
from tickstone.sources.storage import Storage
from tickstone.sources.tables import table
from tickstone.streaming.ingest import append_stream, bar_stream, live_equity, live_features

HALF = "2024-01-15 00:00:00"
NOW_SQL = "TIMESTAMP '2024-01-25 12:00:00'"


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Events as point-in-time bars of one value, available 15 minutes later."""
    e = table(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    named = e.select(F.col("event_type").alias("symbol"), at.alias("event_time"), (at + F.expr("INTERVAL 15 MINUTES")).alias("available_at"), *(F.col("value").alias(c) for c in ("open", "high", "low", "close")))
    return named.withColumns({c: F.lit(None).cast("double") for c in ("volume", "vwap", "adj_factor")}).select(*columns(PIT_BAR))


def _written(spark: SparkSession, d: str) -> tuple[PitStore, list[int]]:
    """A store with the first half of the bars, then all of them with other values, then all of them."""
    bars, store = _bars(spark, d), PitStore(spark, f"{scratch(spark)}/store")
    early = bars.where(F.col("event_time") < F.lit(HALF).cast(NTZ).cast("timestamp"))
    return store, [store.write(early), store.write(bars.withColumn("close", F.col("close") + 1)), store.write(bars)]


def store_append(spark: SparkSession, d: str) -> DataFrame:
    """The first row of a key stays: what is read is the first half as written first, and the rest as written second."""
    seen = _written(spark, d)[0].read(NOW)
    return seen.select("symbol", F.col("event_time").cast(NTZ).alias("event_time"), "close")


def store_inserts(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_written(spark, d)[1], 1)), "step int, inserted bigint")


def store_months(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d)[0].months()


def store_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = _written(spark, d)[0].coverage()
    return c.select("rows", "symbols", F.col("first").cast(NTZ).alias("first"), F.col("last").cast(NTZ).alias("last"))


def store_range(spark: SparkSession, d: str) -> DataFrame:
    """A half-open range of event times and a list of symbols, of a store behind a URI."""
    store = PitStore(spark, f"{scratch(spark)}/store")
    store.write(_bars(spark, d))
    seen = store.read(NOW, ["click", "purchase", "nothing"], datetime(2024, 1, 3, tzinfo=UTC), datetime(2024, 1, 9, tzinfo=UTC))
    return seen.select("symbol", F.col("event_time").cast(NTZ).alias("event_time"), "close")


def store_empty(spark: SparkSession, d: str) -> DataFrame:
    """A store that holds nothing gives typed columns and no rows."""
    return PitStore(spark, f"{scratch(spark)}/none").read(NOW).select("symbol", "close")


def csv_as_of(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/bars"
    texts = panel_a(spark, d).select("symbol", F.col("session").cast("string").alias("session"), F.date_format("available_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("available_at"), "close")
    write_csv(texts, path)
    seen, hidden = CsvBars(spark, path).load_as_of(NOW)
    return seen.select("symbol", F.col("session").cast("string").alias("session"), F.col("available_at").cast(NTZ).alias("available_at"), "close", F.lit(hidden).cast("bigint").alias("excluded"))


def _raw_folder(spark: SparkSession, rows: DataFrame) -> tuple[str, list[str]]:
    """``rows`` as one Parquet file a symbol, for the few symbols there are."""
    folder, names = scratch(spark), sorted(r[0] for r in rows.select("symbol").distinct().limit(1000).collect())
    for s in names:
        rows.where(F.col("symbol") == s).write.parquet(f"{folder}/{s}.parquet")
    return folder, names


def raw_bars_range(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    raw = e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), *(F.col("value").alias(c) for c in ("open", "high", "low", "close", "volume", "vwap")), F.lit(1).cast("bigint").alias("trade_count"))
    folder, names = _raw_folder(spark, raw.select(*columns(RAW_BAR)))
    got, absent = raw_bars(spark, folder, [*names, "NOPE"], date(2024, 1, 10), date(2024, 1, 20))
    return got.select("symbol", F.col("ts").cast(NTZ).alias("ts"), "close", F.lit(",".join(absent)).alias("absent"))


def universe_file(spark: SparkSession, d: str) -> DataFrame:
    path, names = f"{scratch(spark)}/universe.json", [r[0] for r in table(spark, d, "nation").select("n_name").limit(1000).collect()]
    write_universe(path, "I", "P", date(2024, 1, 1), NOW, [*names, *names])
    return universe_members(spark, path)


def holdings_members(spark: SparkSession, d: str) -> DataFrame:
    """A holdings file made of the parts: asset class by type, location by size, exchange by key."""
    p = table(spark, d, "part")
    asset = F.when(F.col("p_type") == "SMALL", "Equity").otherwise("Cash")
    place = F.when(F.col("p_size") % 2 == 0, "United States").otherwise("Germany")
    listed = F.when(F.col("p_partkey") % 3 == 0, "NYSE").otherwise("OTC")
    lines = p.select(F.concat(F.lit('" '), "p_name", F.lit('","a, b",'), asset, F.lit(","), place, F.lit(","), listed).alias("line"))
    body = "\n".join(r.line for r in lines.toLocalIterator())  # a holdings file is one text
    text = f'Some fund\nFund Holdings as of,"Jan 05, 2024"\n\nTicker,Name,Asset Class,Location,Exchange\n{body}\n'
    at, members = holdings(spark, text)
    return members.select("symbol", F.lit(at.isoformat()).alias("as_of"))


def log_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The last output of each (tick, node) in a log made of the events."""
    e = table(spark, d, "events")
    log = e.select(F.when(F.col("event_type") == "view", "node_started").otherwise("node_completed").alias("event"), F.lit("r").alias("run_id"), F.col("user_id").cast("string").alias("tick"), F.col("event_type").alias("node"), F.col("event_id").cast("string").alias("output"), F.col("event_id").alias("seq"))
    return recorded_outputs(log, "r")


def log_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "node_failed").when(F.col("event_type") == "view", "node_retried").otherwise("node_completed")
    made = {
        "event": kind, "run_id": F.concat(F.lit("r"), F.col("user_id") % 7), "tick": F.date_format("ts", "yyyy-MM-dd"), "node": F.col("user_id").cast("string"), "status": F.when(F.col("event_type") == "purchase", "ok").otherwise("missing"),
        "duration_ms": F.when(F.col("value") > 0, F.round("value", 3)),
    }
    log = e.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(EVENT)))
    return run_report(log).withColumn("duration_ms", F.round("duration_ms", 3))


def limit_faults(spark: SparkSession, d: str) -> DataFrame:
    """Weights of which some are null, NaN or infinite, with blank and repeated symbols."""
    k = F.col("c_custkey")
    symbol = F.when(k % 10 == 0, F.lit(" \t")).when(k % 10 < 3, F.concat(F.lit(" s "), k % 40)).otherwise(F.concat(F.lit("C"), k))
    weight = F.when(k % 13 == 0, F.lit(None).cast("double")).when(k % 17 == 0, F.lit(float("nan"))).when(k % 19 == 0, F.lit(float("inf"))).otherwise(F.lit(0.01))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("tick"), symbol.alias("symbol"), weight.alias("weight"))
    return weight_faults(rows, "tick").select("tick", F.coalesce("symbol", F.lit("")).alias("symbol"), "problem")


def sim_violations(spark: SparkSession, d: str) -> DataFrame:
    """All that a simulation refuses in the readings as they are: days off, odd prices, late signals, repeats, too much, gone."""
    b = table(spark, d, "pit_bars")
    panel = b.select("symbol", "event_time", "open", "close", F.lit(0.01).alias("target_weight"), (F.col("available_at") - F.expr("INTERVAL 24 HOURS")).alias("signal_available_at"), (F.col("close") * F.col("volume")).alias("adv_dollars"), F.lit(0.2).alias("annual_volatility"))
    v = violations(panel, table(spark, d, "exchange_sessions"))
    return v.select(F.col("event_time").cast(NTZ).alias("event_time"), "phase", F.coalesce("symbol", F.lit("")).alias("symbol"), "problem")


def single_name_rank(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("tick"), F.concat(F.lit("S"), F.col("c_custkey") % 50).alias("symbol"), F.col("c_acctbal").alias("score"))
    return one_of_ranking(c, "S7")


def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Two micro-batches into a store: keys that come again change nothing, late rows are kept."""
    folder = scratch(spark)
    bars, store = _bars(spark, d), PitStore(spark, f"{folder}/store")
    late = bars.where(F.col("event_time") < F.lit(HALF).cast(NTZ).cast("timestamp"))
    for part in (bars.where(F.col("event_time") >= F.lit("2024-01-10 00:00:00").cast(NTZ).cast("timestamp")), late.withColumn("close", F.col("close") * 2)):
        part.write.mode("append").parquet(f"{folder}/in")
        append_stream(bar_stream(spark, f"{folder}/in", 1000), store, f"{folder}/checkpoint").awaitTermination()
    return store.read(NOW).select("symbol", F.col("event_time").cast(NTZ).alias("event_time"), "close")


def stream_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of a stream that comes in three batches: those of the batch operator."""
    folder = scratch(spark)
    rows = panel_a(spark, d).select("symbol", (F.unix_date("session").cast("bigint") * 86_400_000_000).alias("session_us"), "close")
    schema = "symbol string, session_us bigint, close double"
    for a, z in ((0, 10), (10, 20), (20, 400)):
        first = F.lit(19_723 * 86_400_000_000)  # 2024-01-01
        rows.where(F.col("session_us").between(first + a * 86_400_000_000, first + z * 86_400_000_000 - 1)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = live_features(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("symbol", "session_us", *(F.round(c, 9).alias(c) for c in ("ret_1", "ret_5", "vol_20")))


@dataclass(frozen=True)
class Seen(Message):
    rows: int


@dataclass(frozen=True)
class Doubled(Message):
    rows: int


class CountSeen(Node):
    """Counts the bars visible at the tick."""

    name, writes = "CountSeen", Seen

    def __init__(self, bars: DataFrame):
        super().__init__()
        self.bars = bars

    def run(self, ctx: Context) -> Seen:
        return Seen(ctx.tick, self.name, self.bars.where(F.col("available_at") <= F.lit(ctx.clock.now())).count())


class Double(Node):
    name, reads, writes = "Double", (Seen,), Doubled

    def run(self, ctx: Context) -> Doubled:
        return Doubled(ctx.tick, self.name, 2 * ctx.inputs[Seen].rows)


def _flow(spark: SparkSession, d: str) -> tuple[Flow, list[Tick]]:
    ticks = [Tick.from_datetime(datetime(2024, 1, 5, 21, tzinfo=UTC) + timedelta(days=i), "close") for i in range(10)]
    return FlowBuilder().add(Double(), CountSeen(_bars(spark, d))).build(spark=spark), ticks


def _log(spark: SparkSession) -> Path:
    """A place for an event log, which the driver appends to line by line: the shared folder must be mounted on it."""
    place = urlparse(scratch(spark))
    if place.scheme not in ("", "file"):
        raise RuntimeError(f"an event log needs a mounted folder, not {place.scheme}")
    return Path(unquote(place.path)) / "events.jsonl"


def flow_runs(spark: SparkSession, d: str) -> DataFrame:
    """Ten ticks of a flow of two nodes, and what it gave at each."""
    flow, ticks = _flow(spark, d)
    out = flow.run_many(ticks, "r", _log(spark))
    return spark.createDataFrame([(t.id, m[Seen].rows, m[Doubled].rows) for t, m in zip(ticks, out, strict=True)], "tick string, seen bigint, doubled bigint")


def flow_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of a flow and of its replay, counted by kind and node."""
    flow, ticks = _flow(spark, d)
    log = _log(spark)
    flow.run_many(ticks, "r", log)
    flow.replay(spark, ticks, log, "r", log)
    rows = [(r.event, r.node or "", 1) for r in events(spark, log.as_uri()).select("event", "node").collect()]  # a log of ten ticks
    return spark.createDataFrame(rows, "event string, node string, n int").groupBy("event", "node").agg(F.count("*").alias("n"))


def flow_levels(spark: SparkSession, d: str) -> DataFrame:
    flow, _ = _flow(spark, d)
    return spark.createDataFrame([(i, n.name) for i, level in enumerate(flow.levels) for n in level], "level int, node string")


def dataset_build(spark: SparkSession, d: str) -> DataFrame:
    """A dataset from daily bars by symbol, built twice: the second adds nothing and has the same name."""
    raw = panel_a(spark, d).select("symbol", (F.col("session").cast(NTZ) + F.expr("INTERVAL 17 HOURS")).cast("timestamp").alias("ts"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), F.col("close").alias("vwap"), F.lit(1).cast("bigint").alias("trade_count"))
    folder, names = _raw_folder(spark, raw.select(*columns(RAW_BAR)))
    place = scratch(spark)
    write_universe(f"{place}/universe.json", "I", "P", date(2024, 1, 1), NOW, [*names, "NOPE"])
    args = (spark, f"{place}/universe.json", folder, f"{place}/store", f"{place}/out", table(spark, d, "exchange_sessions"), date(2024, 1, 3), date(2024, 1, 20))
    first, again = build_dataset(*args), build_dataset(*args)
    kept = PitStore(spark, f"{place}/out/snapshots/{first.snapshot_id}/bars").coverage().first()
    row = (first.inserted, again.inserted, first.snapshot_id == again.snapshot_id, kept["rows"], kept["symbols"], ",".join(first.absent))
    return spark.createDataFrame([row], "inserted bigint, again bigint, same boolean, kept_rows bigint, kept_symbols bigint, absent string")


def payload_rows(spark: SparkSession, d: str) -> DataFrame:
    root, n = scratch(spark), table(spark, d, "nation")
    first, again = store_payload(n, root), store_payload(n.repartition(3), root)
    return spark.read.parquet(first).select("n_nationkey", "n_name", F.lit(first == again).alias("same"))


def registry_best(spark: SparkSession, d: str) -> DataFrame:
    """The best of five runs of two names by a measure of the regions."""
    r = Registry(spark, f"{scratch(spark)}/registry")
    rows = table(spark, d, "region").select("r_regionkey", "r_name").limit(100).collect()
    for x in rows:
        r.add(x.r_name, "even" if x.r_regionkey % 2 == 0 else "odd", {}, {"score": float(x.r_regionkey % 3)}, datetime(2024, 1, 1 + x.r_regionkey, tzinfo=UTC))
    return r.best("score", highest=True).select("name", "run_id", "value")


def file_digests(spark: SparkSession, d: str) -> DataFrame:
    """Files hashed where they are read."""
    folder, storage = scratch(spark), Storage(spark)
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").limit(100).collect():
        storage.write(f"{folder}/{r.n_nationkey}.txt", r.n_name.encode())
    return file_hashes(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")


def value_digests(spark: SparkSession, d: str) -> DataFrame:
    """Canonical texts of values and their hashes."""
    rows = [{"b": r.n_name, "a": r.n_nationkey} for r in table(spark, d, "nation").select("n_nationkey", "n_name").limit(100).collect()]
    return spark.createDataFrame([(x["a"], canonical(x), digest(x)) for x in rows], "n_nationkey int, text string, sha256 string")


def live_equity_stream(spark: SparkSession, d: str) -> DataFrame:
    """The simulation's equity carried on by a stream of session terms that comes in three batches."""
    folder = scratch(spark)
    terms = session_terms(panel_b(spark, d)).select(F.lit("r").alias("run"), F.col("event_time").cast("timestamp").alias("event_time"), "r_over", "r_in", "turnover", "a", "b")
    terms.write.parquet(f"{folder}/all")
    kept = spark.read.parquet(f"{folder}/all")
    edges = [F.lit(f"{y}-01-01 00:00:00").cast(NTZ).cast("timestamp") for y in (1900, 1994, 1996, 2200)]
    for a, z in pairwise(edges):
        kept.where((F.col("event_time") >= a) & (F.col("event_time") < z)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    live_equity(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.col("event_time").cast(NTZ).alias("event_time"), *(F.round(c, 6).alias(c) for c in ("gross_return", "transaction_costs", "turnover", "net_return", "equity")))


MIDYEAR = datetime(2025, 6, 30, 12, tzinfo=UTC)


def _tools(spark: SparkSession, d: str, at: datetime) -> BoundTools:
    return BoundTools(Clock(Tick.from_datetime(at)), _bars(spark, d), table(spark, d, "documents"))


def tool_news(spark: SparkSession, d: str) -> DataFrame:
    return _tools(spark, d, MIDYEAR).call("get_news", {"symbol": " jorv", "lookback_hours": 2400}).select("symbol", "doc_id")


def tool_filing(spark: SparkSession, d: str) -> DataFrame:
    return _tools(spark, d, MIDYEAR).call("get_filing", {"symbol": "JORV", "form": "10-Q", "n": 3}).select("symbol", "doc_id", "place")


def tool_history(spark: SparkSession, d: str) -> DataFrame:
    seen = _tools(spark, d, NOW).call("get_price_history", {"symbol": "click", "lookback_days": 3})
    return seen.select("symbol", F.col("event_time").cast(NTZ).alias("event_time"), "close")


def tool_features(spark: SparkSession, d: str) -> DataFrame:
    got = _tools(spark, d, NOW).call("get_features", {"symbol": "click", "names": ["ret_1", "ret_5", "vol_20"]})
    return got.select("symbol", F.col("event_time").cast(NTZ).alias("event_time"), *(F.round(c, 6).alias(c) for c in ("ret_1", "ret_5", "vol_20")))


def synthetic_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = synthetic_bars(spark).where(F.col("close") > 0)
    return s.groupBy("symbol").agg(F.count("*").alias("n"), F.min("session").cast("string").alias("first"), F.max("session").cast("string").alias("last"), F.count_if(F.hour("available_at") == 21).alias("at_21"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        store_append, store_inserts, store_months, store_coverage, store_range, store_empty, csv_as_of, raw_bars_range, universe_file, holdings_members, log_outputs, log_report, limit_faults, sim_violations,
        single_name_rank, stream_append, stream_features, flow_runs, flow_events, flow_levels, dataset_build, payload_rows, registry_best, file_digests, value_digests, synthetic_sessions,
        live_equity_stream, tool_news, tool_filing, tool_history, tool_features,
    )
}

SYMBOL = "nullif(upper(replace(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)), ' ', '.')), '')"
EARLY = f"event_time < TIMESTAMP '{HALF}'"
FINITE = "({0} IS NOT NULL AND isfinite({0}))"
SQL: dict[str, str] = {
    "store_append": f"WITH {BARS} SELECT symbol, event_time, CASE WHEN {EARLY} THEN close ELSE close + 1 END AS close FROM bars WHERE available_at <= {NOW_SQL}",
    "store_inserts": f"WITH {BARS} SELECT 1 AS step, count(*) FILTER (WHERE {EARLY}) AS inserted FROM bars UNION ALL SELECT 2, count(*) FILTER (WHERE NOT {EARLY}) FROM bars UNION ALL SELECT 3, 0",
    "store_months": f"WITH {BARS} SELECT CAST(year(event_time) AS INTEGER) AS year, CAST(month(event_time) AS INTEGER) AS month, count(*) AS n FROM bars GROUP BY 1, 2",
    "store_coverage": f"WITH {BARS} SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(event_time) AS first, max(event_time) AS last FROM bars",
    "store_range": f"WITH {BARS} SELECT symbol, event_time, close FROM bars WHERE symbol IN ('click', 'purchase') AND event_time >= TIMESTAMP '2024-01-03' AND event_time < TIMESTAMP '2024-01-09' AND available_at <= {NOW_SQL}",
    "store_empty": "SELECT CAST('' AS VARCHAR) AS symbol, CAST(0 AS DOUBLE) AS close WHERE false",
    "csv_as_of": f"WITH {PANEL_A} SELECT symbol, CAST(session AS VARCHAR) AS session, available_at, close, (SELECT count(*) FROM panel_a WHERE available_at > {NOW_SQL}) AS excluded FROM panel_a WHERE available_at <= {NOW_SQL}",
    "raw_bars_range": "SELECT event_type AS symbol, ts, value AS close, 'NOPE' AS absent FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'",
    "universe_file": "SELECT DISTINCT n_name AS symbol FROM nation",
    "holdings_members": "SELECT DISTINCT upper(replace(trim(p_name), ' ', '.')) AS symbol, '2024-01-05' AS as_of FROM part WHERE p_type = 'SMALL' AND p_size % 2 = 0 AND p_partkey % 3 = 0",
    "log_outputs": """SELECT CAST(user_id AS VARCHAR) AS tick, event_type AS node, CAST(event_id AS VARCHAR) AS output FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events WHERE event_type <> 'view') WHERE k = 1""",
    "log_report": """WITH l AS (SELECT 'r' || (user_id % 7) AS run_id, strftime(ts, '%Y-%m-%d') AS tick, CAST(user_id AS VARCHAR) AS node, event_type AS t, CASE WHEN value > 0 THEN round(value, 3) END AS ms FROM events)
SELECT run_id, tick, count(DISTINCT node) AS nodes, count(*) FILTER (WHERE t = 'purchase') AS ok, count(*) FILTER (WHERE t NOT IN ('purchase', 'click', 'view')) AS missing,
       count(*) FILTER (WHERE t = 'click') AS failed, count(*) FILTER (WHERE t = 'view') AS retries, round(coalesce(sum(ms), 0), 3) AS duration_ms, arg_min(node, (-ms, node)) FILTER (WHERE ms IS NOT NULL) AS slowest
FROM l GROUP BY run_id, tick""",
    "limit_faults": f"""WITH r AS (SELECT c_nationkey AS tick, {SYMBOL.format("s")} AS symbol, weight FROM (
  SELECT *, CASE WHEN c_custkey % 10 = 0 THEN ' ' WHEN c_custkey % 10 < 3 THEN ' s ' || (c_custkey % 40) ELSE 'C' || c_custkey END AS s,
         CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'NaN'::DOUBLE WHEN c_custkey % 19 = 0 THEN 'inf'::DOUBLE ELSE 0.01 END AS weight FROM customer))
SELECT tick, '' AS symbol, 'blank symbol' AS problem FROM r WHERE symbol IS NULL
UNION ALL SELECT tick, symbol, 'duplicate symbol' FROM r WHERE symbol IS NOT NULL GROUP BY tick, symbol HAVING count(*) > 1
UNION ALL SELECT tick, coalesce(symbol, ''), 'weight is not finite' FROM r WHERE weight IS NULL OR NOT isfinite(weight)""",
    "sim_violations": f"""WITH p AS (SELECT {SYMBOL.format("symbol")} AS symbol, event_time AT TIME ZONE 'UTC' AS event_time, open, close, available_at - INTERVAL 24 HOUR AS signal, close * volume AS adv FROM pit_bars),
j AS (SELECT p.*, s.open_utc FROM p LEFT JOIN exchange_sessions s ON s.session_date = CAST(p.event_time AS DATE)),
r AS (SELECT event_time, 1 AS phase, coalesce(symbol, '') AS symbol, CASE WHEN open_utc IS NULL THEN 'date is no session' WHEN symbol IS NULL THEN 'blank symbol'
      WHEN NOT ({FINITE.format("open")} AND {FINITE.format("close")}) OR open <= 0 OR close <= 0 THEN 'invalid price or target' WHEN coalesce(signal > open_utc, true) THEN 'signal after the open'
      WHEN NOT {FINITE.format("adv")} OR adv <= 0 THEN 'invalid adv_dollars' END AS problem FROM j),
t AS (SELECT event_time, lead(event_time) OVER (ORDER BY event_time) AS nxt FROM (SELECT DISTINCT event_time FROM p WHERE event_time IS NOT NULL))
SELECT * FROM r WHERE problem IS NOT NULL
UNION ALL SELECT event_time, 1, coalesce(symbol, ''), 'duplicate symbol' FROM p GROUP BY event_time, symbol HAVING count(*) > 1
UNION ALL SELECT event_time, 2, '', 'targets above 100%' FROM p GROUP BY event_time HAVING count(*) > 100
UNION ALL SELECT t.nxt, 3, coalesce(p.symbol, ''), 'held symbol has no bar' FROM p JOIN t ON t.event_time = p.event_time WHERE t.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p q WHERE q.symbol = p.symbol AND q.event_time = t.nxt)""",
    "single_name_rank": """WITH c AS (SELECT c_nationkey AS tick, 'S' || (c_custkey % 50) AS symbol, c_acctbal AS score FROM customer), own AS (SELECT tick, max(score) AS own FROM c WHERE symbol = 'S7' GROUP BY tick)
SELECT c.tick, 'S7' AS symbol, own.own AS score, CAST(1 + count(*) FILTER (WHERE c.score > own.own OR (c.score = own.own AND c.symbol < 'S7')) AS INTEGER) AS rank, count(*) AS of FROM c JOIN own ON own.tick = c.tick GROUP BY c.tick, own.own""",
    "stream_append": f"WITH {BARS} SELECT symbol, event_time, CASE WHEN event_time >= TIMESTAMP '2024-01-10' THEN close ELSE close * 2 END AS close FROM bars WHERE available_at <= {NOW_SQL}",
    "stream_features": f"""WITH {PANEL_A}, r AS (SELECT symbol, epoch_us(CAST(session AS TIMESTAMP)) AS session_us, close / lag(close, 1) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5 FROM panel_a WHERE session >= DATE '2024-01-01' WINDOW w AS (PARTITION BY symbol ORDER BY session))
SELECT symbol, session_us, round(ret_1, 9) AS ret_1, round(ret_5, 9) AS ret_5, round(CASE WHEN count(ret_1) OVER v >= 10 THEN stddev_samp(ret_1) OVER v END, 9) AS vol_20 FROM r
WINDOW v AS (PARTITION BY symbol ORDER BY session_us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "flow_runs": """WITH t AS (SELECT TIMESTAMP '2024-01-05 21:00:00' + to_days(CAST(i AS INTEGER)) AS due FROM range(10) r(i))
SELECT strftime(due, '%Y-%m-%dT%H:%M:%S+00:00') AS tick, (SELECT count(*) FROM events WHERE ts + INTERVAL 15 MINUTE <= due) AS seen, 2 * (SELECT count(*) FROM events WHERE ts + INTERVAL 15 MINUTE <= due) AS doubled FROM t""",
    "flow_events": """SELECT e AS event, n AS node, CAST(20 AS BIGINT) AS n FROM (VALUES ('run_started', ''), ('tick_started', ''), ('tick_completed', ''), ('run_completed', ''),
('node_started', 'CountSeen'), ('node_started', 'Double'), ('node_completed', 'CountSeen'), ('node_completed', 'Double')) v(e, n)""",
    "flow_levels": "SELECT * FROM (VALUES (0, 'CountSeen'), (1, 'Double')) v(level, node)",
    "dataset_build": f"""WITH {PANEL_A}, k AS (SELECT * FROM panel_a WHERE session >= DATE '2024-01-03' AND session < DATE '2024-01-20')
SELECT count(*) AS inserted, CAST(0 AS BIGINT) AS again, true AS same, count(*) AS kept_rows, count(DISTINCT symbol) AS kept_symbols, 'NOPE' AS absent FROM k""",
    "payload_rows": "SELECT n_nationkey, n_name, true AS same FROM nation",
    "registry_best": """SELECT name, run_id, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value DESC, r_regionkey) AS k FROM (
SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END AS name, r_name AS run_id, CAST(r_regionkey % 3 AS DOUBLE) AS value, r_regionkey FROM region)) WHERE k = 1""",
    "file_digests": "SELECT n_nationkey || '.txt' AS name, sha256(n_name) AS sha256 FROM nation",
    "value_digests": """SELECT n_nationkey, t AS text, sha256(t) AS sha256 FROM (SELECT n_nationkey, '{"a":' || n_nationkey || ',"b":"' || n_name || '"}' AS t FROM nation)""",
    "live_equity_stream": PIT_SQL["sim_equity"],
    "tool_news": f"""SELECT 'JORV' AS symbol, doc_id FROM documents WHERE {SYMBOL.format("symbol")} = 'JORV' AND text IS NOT NULL AND lower(replace(trim(source), ' ', '_')) = 'newswire'
AND event_time AT TIME ZONE 'UTC' > TIMESTAMP '2025-03-22 12:00:00' AND event_time AT TIME ZONE 'UTC' <= TIMESTAMP '2025-06-30 12:00:00' AND available_at AT TIME ZONE 'UTC' <= TIMESTAMP '2025-06-30 12:00:00'""",
    "tool_filing": f"""SELECT 'JORV' AS symbol, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY event_time DESC, doc_id DESC) AS place FROM documents
WHERE {SYMBOL.format("symbol")} = 'JORV' AND text IS NOT NULL AND lower(replace(trim(source), ' ', '_')) = 'filings' AND upper(trim(form)) = '10-Q'
AND event_time AT TIME ZONE 'UTC' <= TIMESTAMP '2025-06-30 12:00:00' AND available_at AT TIME ZONE 'UTC' <= TIMESTAMP '2025-06-30 12:00:00') WHERE place <= 3""",
    "tool_history": f"WITH {BARS} SELECT symbol, event_time, close FROM bars WHERE symbol = 'click' AND available_at <= {NOW_SQL} AND event_time > {NOW_SQL} - INTERVAL 3 DAY",
    "tool_features": f"""WITH {BARS}, seen AS (SELECT *, event_time AS session FROM bars WHERE symbol = 'click' AND available_at <= {NOW_SQL}), {FEATURES}
SELECT symbol, event_time, round(ret_1, 6) AS ret_1, round(ret_5, 6) AS ret_5, round(vol_20, 6) AS vol_20 FROM features ORDER BY event_time DESC LIMIT 1""",
    "synthetic_sessions": """WITH d AS (SELECT CAST(x AS DATE) AS day FROM range(DATE '2020-01-01', DATE '2023-07-15', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6)
SELECT s AS symbol, count(*) AS n, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, count(*) AS at_21 FROM d CROSS JOIN (VALUES ('AAA'), ('BBB'), ('CCC'), ('DDD'), ('EEE')) v(s) GROUP BY s""",
}
