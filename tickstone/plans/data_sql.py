"""SQL for the data-preparation queries that SQL can express, over the same tables."""

from __future__ import annotations

SYMBOL = "nullif(upper(replace(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)), ' ', '.')), '')"
TEXT = "trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160))"
READINGS = f"""
readings AS (
  SELECT symbol, event_time, CAST(event_time AT TIME ZONE 'America/New_York' AS DATE) AS day, close, volume
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, event_time ORDER BY available_at NULLS LAST, volume NULLS FIRST, close NULLS FIRST) AS k
        FROM (SELECT {SYMBOL.format("symbol")} AS symbol, event_time, available_at, close, volume FROM pit_bars)
        WHERE symbol IS NOT NULL AND event_time IS NOT NULL)
  WHERE k = 1)"""
P1 = f"""
WITH {READINGS},
axis AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS i FROM (SELECT DISTINCT session_date FROM exchange_sessions)),
seen AS (SELECT DISTINCT symbol, i FROM readings JOIN axis ON day = session_date WHERE close IS NOT NULL AND NOT isnan(close)),
span AS (SELECT symbol, min(i) AS lo, max(i) AS hi FROM seen GROUP BY symbol)
SELECT s.symbol, strftime(a.session_date, '%Y-%m-%d') AS session_date
FROM span s JOIN axis a ON a.i > s.lo AND a.i < s.hi
WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.symbol = s.symbol AND x.i = a.i)"""


P1_OBSERVED = f"""
WITH {READINGS}, axis AS (SELECT DISTINCT session_date FROM exchange_sessions)
SELECT symbol, strftime(day, '%Y-%m-%d') AS session_date, arg_max(close, event_time) AS value, count(*) AS n_readings
FROM readings JOIN axis ON day = session_date WHERE close IS NOT NULL AND NOT isnan(close) GROUP BY symbol, day"""


def _standing(name: str, source: str, scope: str, as_of: str, published: str, items: str) -> str:
    return f"""
{name} AS (
  SELECT scope, as_of, items, row_number() OVER (PARTITION BY scope ORDER BY as_of) AS seq,
         lead(as_of) OVER (PARTITION BY scope ORDER BY as_of) AS next_as_of
  FROM (SELECT *, row_number() OVER (PARTITION BY scope, as_of ORDER BY published DESC NULLS LAST) AS k
        FROM (SELECT {TEXT.format(scope)} AS scope, {as_of} AS as_of, {published} AS published, {items} AS items FROM {source})
        WHERE scope IS NOT NULL AND as_of IS NOT NULL AND len(items) > 0)
  WHERE k = 1)"""


DAY = "coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%b %d, %Y'))::DATE"
UNIVERSE = _standing("universe", "universe_snapshots", "index_name", DAY.format(TEXT.format("as_of")), "retrieved_at", "symbols")
STORES = _standing("stores", "snapshot_manifests", "store_name", DAY.format(TEXT.format("universe_as_of")), "published_at", "map_entries(curated_files_sha256)")
MEMBERS = f"""
members AS (SELECT DISTINCT scope, as_of, next_as_of, seq, {SYMBOL.format("s")} AS item
            FROM (SELECT scope, as_of, next_as_of, seq, unnest(items) AS s FROM universe) WHERE {SYMBOL.format("s")} IS NOT NULL)"""
FILES = f"""
files AS (SELECT scope, as_of, seq, regexp_replace({TEXT.format("e.key")}, '^(\\./)+', '') AS item,
                 max(regexp_replace(lower({TEXT.format("e.value")}), '^sha256:', '')) AS hash
          FROM (SELECT scope, as_of, seq, unnest(items) AS e FROM stores) GROUP BY ALL)"""
P2 = f"""
WITH {UNIVERSE}, {MEMBERS},
runs AS (SELECT *, seq - row_number() OVER (PARTITION BY scope, item ORDER BY seq) AS run FROM members)
SELECT scope AS index_name, item AS symbol, strftime(min(as_of), '%Y-%m-%d') AS valid_from,
       coalesce(strftime(arg_max(coalesce(next_as_of, DATE '9999-01-01'), seq), '%Y-%m-%d'), '') AS valid_to
FROM runs GROUP BY scope, item, run"""
P2 = f"SELECT index_name, symbol, valid_from, CASE WHEN valid_to = '9999-01-01' THEN '' ELSE valid_to END AS valid_to FROM ({P2})"
P2_VERSIONS = f"""
WITH {STORES}, {FILES}, dates AS (SELECT scope, seq, as_of, next_as_of FROM stores),
begun AS (SELECT *, CASE WHEN seq = lag(seq) OVER w + 1 AND hash IS NOT DISTINCT FROM lag(hash) OVER w THEN 0 ELSE 1 END AS new FROM files WHERE item <> '' WINDOW w AS (PARTITION BY scope, item ORDER BY seq)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY scope, item ORDER BY seq) AS run FROM begun),
spans AS (SELECT scope, item, any_value(hash) AS hash, min(seq) AS a, max(seq) AS z FROM runs GROUP BY scope, item, run)
SELECT s.scope AS store_name, s.item AS path, s.hash AS sha256, strftime(f.as_of, '%Y-%m-%d') AS valid_from, coalesce(strftime(l.next_as_of, '%Y-%m-%d'), '') AS valid_to
FROM spans s JOIN dates f ON f.scope = s.scope AND f.seq = s.a JOIN dates l ON l.scope = s.scope AND l.seq = s.z"""
CHANGES = f"""
WITH {UNIVERSE}, {MEMBERS}, {STORES}, {FILES},
items AS (SELECT scope, seq, item, NULL AS hash, 'u' AS kind FROM members UNION ALL SELECT scope, seq, item, hash, 'f' FROM files),
dates AS (SELECT scope, seq, as_of, 'u' AS kind FROM universe UNION ALL SELECT scope, seq, as_of, 'f' FROM stores),
pairs AS (SELECT coalesce(a.scope, b.scope) AS scope, coalesce(a.kind, b.kind) AS kind, coalesce(a.seq, b.seq + 1) AS seq, coalesce(a.item, b.item) AS item,
                 a.item IS NOT NULL AS now, b.item IS NOT NULL AS before, a.hash IS DISTINCT FROM b.hash AS differs
          FROM items a FULL JOIN items b ON a.scope = b.scope AND a.kind = b.kind AND a.item = b.item AND a.seq = b.seq + 1)
SELECT p.scope, strftime(d.as_of, '%Y-%m-%d') AS as_of, p.item,
       CASE WHEN NOT before THEN 'added' WHEN NOT now THEN 'removed' ELSE 'changed' END AS change,
       CASE WHEN now AND before THEN 'sha256' ELSE '' END AS fields
FROM pairs p JOIN dates d ON d.scope = p.scope AND d.kind = p.kind AND d.seq = p.seq
WHERE p.seq > 1 AND (now <> before OR differs)"""
P5_TOTALS = f"""
WITH {READINGS},
daily AS (SELECT symbol, day, coalesce(sum(volume) FILTER (WHERE isfinite(volume) AND volume > 0), 0) AS volume,
                 count(*) FILTER (WHERE isfinite(volume) AND volume > 0) AS n_volume,
                 coalesce(sum(close) FILTER (WHERE isfinite(close)), 0) AS close, count(*) FILTER (WHERE isfinite(close)) AS n_close
          FROM readings GROUP BY symbol, day),
span AS (SELECT symbol, min(day) AS lo, max(day) AS hi FROM daily WHERE n_volume > 0 GROUP BY symbol),
grid AS (SELECT symbol, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
full_days AS (SELECT g.symbol, g.day, g.day - g.lo + 1 AS day_number, coalesce(d.volume, 0) AS volume, coalesce(d.n_volume, 0) AS n_volume,
                     coalesce(d.close, 0) AS close, coalesce(d.n_close, 0) AS n_close
              FROM grid g LEFT JOIN daily d ON d.symbol = g.symbol AND d.day = g.day),
totals AS (SELECT symbol, day, day_number, volume, n_volume,
                  round(sum(close) OVER w7, 4) AS close_sum_7, CAST(sum(n_close) OVER w7 AS BIGINT) AS close_n_7, round(sum(close) OVER w30, 4) AS close_sum_30, CAST(sum(n_close) OVER w30 AS BIGINT) AS close_n_30,
                  round(sum(close) OVER w7, 4) / nullif(sum(n_close) OVER w7, 0) AS close_avg_7, round(sum(close) OVER w30, 4) / nullif(sum(n_close) OVER w30, 0) AS close_avg_30,
                  sum(volume) OVER w7 AS volume_7, sum(n_volume) OVER w7 AS active_7, sum(volume) OVER w30 AS volume_30, sum(n_volume) OVER w30 AS active_30
           FROM full_days
           WINDOW w7 AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
                  w30 AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
P5 = f"""{P5_TOTALS}
SELECT symbol, strftime(day, '%Y-%m-%d') AS activity_day, mark
FROM (SELECT *, unnest(list_filter([CASE WHEN active_7 = 0 THEN 'idle7' END, CASE WHEN active_30 = 0 THEN 'idle30' END,
                                    CASE WHEN volume_7 * 2 > volume_30 THEN 'surge' END], lambda m: m IS NOT NULL)) AS mark
      FROM totals WHERE day_number >= 30)"""

# P3 by its rules alone, without the fitted model: what is away from both sides while they agree, and from the level around
_AWAY = " OR ".join(
    "(" + " AND ".join([f"abs(b{a} - n{b}) <= far", *(f"abs({x} - b{a}) > far AND abs({x} - n{b}) > far" for x in [*(f"b{k}" for k in range(1, a)), "l", *(f"n{k}" for k in range(1, b))])]) + ")"
    for a in (1, 2, 3)
    for b in (1, 2, 3)
    if a + b <= 4
)
P3 = f"""
WITH base AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, event_time ORDER BY available_at NULLS LAST, close NULLS FIRST, open NULLS FIRST, volume NULLS FIRST, adj_factor NULLS FIRST) AS k
    FROM (SELECT {SYMBOL.format("symbol")} AS symbol, event_time, available_at, close, open, volume, adj_factor FROM pit_bars) WHERE symbol IS NOT NULL AND event_time IS NOT NULL) WHERE k = 1),
long AS (
  SELECT symbol, epoch_us(event_time) AS event_us, unnest(['close', 'open', 'volume', 'adj_factor']) AS field, unnest([close, open, volume, adj_factor]) AS v FROM base),
logs AS (
  SELECT *, lag(l, 1) OVER w AS b1, lag(l, 2) OVER w AS b2, lag(l, 3) OVER w AS b3, lead(l, 1) OVER w AS n1, lead(l, 2) OVER w AS n2, lead(l, 3) OVER w AS n3,
         median(l) OVER (PARTITION BY symbol, field ORDER BY event_us ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS level
  FROM (SELECT *, ln(v) AS l FROM long WHERE isfinite(v) AND v > 0) WINDOW w AS (PARTITION BY symbol, field ORDER BY event_us)),
scale AS (
  SELECT symbol, field, median(l) AS typical, CASE WHEN field = 'adj_factor' THEN 1e-9 ELSE 10 * median(abs(l - b1)) FILTER (WHERE l <> b1) END AS far FROM logs GROUP BY symbol, field),
spread AS (SELECT symbol, field, median(abs(l - typical)) AS mad FROM logs JOIN scale USING (symbol, field) WHERE field = 'volume' GROUP BY symbol, field),
spikes AS (
  SELECT symbol, event_us, field FROM logs JOIN scale USING (symbol, field) WHERE field <> 'volume' AND abs(l - level) > far AND ({_AWAY})
  UNION ALL
  SELECT symbol, event_us, field FROM logs JOIN scale USING (symbol, field) JOIN spread USING (symbol, field) WHERE mad > 0 AND abs(l - typical) > 12.5 * mad),
held AS (
  SELECT *, row_number() OVER w AS i, v = lag(v) OVER w AS repeats
  FROM (SELECT * FROM long WHERE v IS NOT NULL AND NOT isnan(v) AND field <> 'adj_factor' AND (field <> 'volume' OR v <> 0)) WINDOW w AS (PARTITION BY symbol, field ORDER BY event_us)),
runs AS (SELECT *, count(*) OVER (PARTITION BY symbol, field, v, i - r) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol, field, v ORDER BY event_us) AS r FROM held)),
seldom AS (SELECT symbol, field FROM runs GROUP BY symbol, field HAVING count(*) FILTER (WHERE repeats AND n < 6) < 0.25 * greatest(count(*) FILTER (WHERE n < 6), 1)),
stuck AS (SELECT symbol, event_us, field FROM runs JOIN seldom USING (symbol, field) WHERE n >= 6 AND repeats)
"""
P3_CASES = f"""{P3}, cases AS (
  SELECT symbol, event_us, field, min(kind) AS kind FROM (
    SELECT symbol, event_us, field, 1 AS kind FROM long WHERE v < 0 OR isinf(v) OR (v = 0 AND field <> 'volume')
    UNION ALL SELECT symbol, event_us, field, 2 FROM spikes UNION ALL SELECT symbol, event_us, field, 3 FROM stuck)
  GROUP BY symbol, event_us, field)"""

SQL: dict[str, str] = {
    "p1_found": P1,
    "p1_observed": P1_OBSERVED,
    "p2_found": P2,
    "p2_versions": P2_VERSIONS,
    "p3_report": f"""{P3_CASES}
SELECT symbol, field, ['limit', 'spike', 'stuck'][kind] AS kind, count(*) AS n, min(event_us) AS first_us, max(event_us) AS last_us FROM cases GROUP BY symbol, field, cases.kind""",
    "p3_found": f"{P3_CASES} SELECT symbol, event_us, field FROM cases",
    "p4_changes": CHANGES,
    "p4_found": f"SELECT scope, as_of, item, change FROM ({CHANGES})",
    "p5_totals": f"""{P5_TOTALS}
SELECT symbol, strftime(day, '%Y-%m-%d') AS activity_day, CAST(day_number AS INTEGER) AS day_number, volume, n_volume, volume_7, CAST(active_7 AS BIGINT) AS active_7, close_sum_7, close_n_7, close_avg_7,
       volume_30, CAST(active_30 AS BIGINT) AS active_30, close_sum_30, close_n_30, close_avg_30 FROM totals""",
    "p5_found": P5,
}
