"""Common table expressions that the oracle statements share, in DuckDB's dialect."""

EVENT_PACKETS = """pk AS (SELECT 'events' AS capture_id, event_id AS seq, epoch_us(ts) AS us, 'u' || user_id AS src, 'svc-' || event_type AS dst, CAST(NULL AS INT) AS sp, CAST(NULL AS INT) AS dp, 'UDP' AS protocol, CAST(floor(value) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS flags FROM events)"""

FLAG_PACKETS = """pk AS (SELECT 'flags' AS capture_id, event_id AS seq, epoch_us(ts) AS us, CASE WHEN event_id % 2 = 1 THEN 'server' ELSE 'u' || user_id END AS src, CASE WHEN event_id % 2 = 1 THEN 'u' || user_id ELSE 'server' END AS dst,
  CASE WHEN event_id % 2 = 1 THEN 443 END AS sp, CASE WHEN event_id % 2 = 0 THEN 443 END AS dp, 'TCP' AS protocol, CAST(floor(value) AS BIGINT) AS size,
  CASE event_type WHEN 'signup' THEN 'SYN' WHEN 'view' THEN 'ACK' WHEN 'click' THEN 'PSH' WHEN 'purchase' THEN 'FIN' WHEN 'error' THEN 'RST' END AS flags FROM events)"""

TRADE_PACKETS = """line AS (SELECT l_orderkey, l_linenumber, 'c' || o_custkey AS c, 's' || l_suppkey AS s, o_orderdate, l_shipdate, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pk AS (SELECT 'trade' AS capture_id, l_orderkey * 100 + l_linenumber * 2 AS seq, epoch_us(o_orderdate) AS us, c AS src, s AS dst, CAST(NULL AS INT) AS sp, CAST(NULL AS INT) AS dp, 'UDP' AS protocol, CAST(floor(l_quantity) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS flags FROM line
  UNION ALL SELECT 'trade', l_orderkey * 100 + l_linenumber * 2 + 1, epoch_us(l_shipdate), s, c, NULL, NULL, 'UDP', CAST(floor(l_extendedprice / 100) AS BIGINT), NULL FROM line)"""


def flows(idle: float) -> str:
    """units and flows over pk; keys are (lo, hi) endpoint texts with ports."""
    return f"""kp AS (SELECT *, (src, coalesce(sp, 0)) AS ea, (dst, coalesce(dp, 0)) AS eb FROM pk WHERE protocol IN ('TCP', 'UDP')),
k AS (SELECT *, least(ea, eb) AS lo, greatest(ea, eb) AS hi, ea = least(ea, eb) AS from_lo FROM kp),
g AS (SELECT *, us - lag(us) OVER w AS gap0, row_number() OVER w AS i FROM k WINDOW w AS (PARTITION BY capture_id, lo, hi, protocol ORDER BY us, seq)),
b AS (SELECT *, CASE WHEN protocol = 'UDP' AND gap0 > {int(idle * 1000000)} THEN 1 ELSE 0 END AS brk FROM g),
ss AS (SELECT *, sum(brk) OVER (PARTITION BY capture_id, lo, hi, protocol ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS session, CASE WHEN brk = 0 THEN gap0 END AS gap,
  min(CASE WHEN flags = 'SYN' THEN i END) OVER (PARTITION BY capture_id, lo, hi, protocol) AS syn, min(CASE WHEN flags = 'FIN' THEN i END) OVER (PARTITION BY capture_id, lo, hi, protocol) AS fin FROM b),
u AS (SELECT capture_id, lo, hi, protocol, session, arg_min(src, i) AS src, arg_min(dst, i) AS dst, arg_min(sp, i) AS sp, arg_min(coalesce(dp, -1), i) AS dp0, arg_min(from_lo, i) AS first_lo, min(us) AS first_us, max(us) AS last_us, min(i) AS i0,
  count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS byte_count, CAST(sum(CASE WHEN from_lo THEN size ELSE 0 END) AS BIGINT) AS lo_bytes, count(gap) AS gaps, avg(gap) AS gap, stddev_pop(gap) AS dev,
  bool_or(coalesce(flags = 'RST', false)) AS rst, min(syn) AS syn, bool_or(coalesce(flags = 'ACK' AND i > syn AND (fin IS NULL OR i < fin), false)) AS est,
  bool_or(coalesce(flags = 'FIN', false) AND from_lo) AS fin_lo, bool_or(coalesce(flags = 'FIN', false) AND NOT from_lo) AS fin_hi FROM ss GROUP BY ALL),
un AS (SELECT *, CASE WHEN protocol <> 'TCP' THEN NULL WHEN rst THEN 'reset' WHEN syn IS NULL OR NOT est THEN 'partial' WHEN fin_lo AND fin_hi THEN 'closed' WHEN fin_lo OR fin_hi THEN 'closing' ELSE 'established' END AS tcp_state,
  (last_us - first_us) / 1000000.0 AS duration_seconds, coalesce(gap / 1000000, 0) AS mean_gap, CASE WHEN gaps >= 2 AND gap > 0 THEN dev / gap ELSE 0 END AS burstiness,
  CASE WHEN byte_count = 0 THEN 0.0 ELSE (CASE WHEN first_lo THEN lo_bytes ELSE byte_count - lo_bytes END) / CAST(byte_count AS DOUBLE) END AS ratio,
  count(*) OVER (PARTITION BY capture_id, lo, hi, protocol) > 1 AS persistent FROM u)"""


EDGES = """pairs AS (SELECT *, least(src, dst) AS source, greatest(src, dst) AS target FROM un WHERE src <> dst),
sig AS (SELECT source, target, count(*) AS observation_count, CAST(sum(packet_count) AS BIGINT) AS packets, min(first_us) AS first_us, max(last_us) AS last_us, max(CASE WHEN tcp_state = 'established' THEN 1 ELSE 0 END) AS established,
  max(CASE WHEN persistent THEN 1 ELSE 0 END) AS persistent, max(2 * least(ratio, 1 - ratio)) AS bidirectional, avg(ratio) AS mean_ratio, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols FROM pairs GROUP BY source, target),
edges AS (SELECT *, 1 - exp(-packets / 20.0) AS p_vol, 1 - (1 - (1 - exp(-packets / 20.0))) * (1 - 0.3 * established) * (1 - 0.3 * persistent) * (1 - 0.3 * bidirectional) AS confidence FROM sig)"""

EVENT_FLOWS = """ef AS (SELECT 'u' || user_id AS src, 'svc-' || event_type AS dst, CAST(json_extract(props, '$.k') AS INT) AS port, epoch_us(ts) AS us, CAST(floor(value) AS BIGINT) AS bytes FROM events)"""

#: Day fingerprints of users (as sources).
FINGERPRINTS = (
    EVENT_FLOWS
    + """,
fp AS (SELECT src AS ip, CAST(floor((us - 1704067200000000) / 86400000000.0) AS BIGINT) AS epoch, count(DISTINCT dst) AS distinct_destinations, 0.0 AS mean_flow_duration_seconds, CASE WHEN sum(bytes) = 0 THEN 0.0 ELSE 1.0 END AS outbound_byte_ratio, CAST(sum(bytes) AS BIGINT) AS total_byte_count FROM ef GROUP BY ALL),
long AS (SELECT ip, epoch, unnest(['distinct_destinations', 'mean_flow_duration_seconds', 'outbound_byte_ratio', 'total_byte_count']) AS feature, unnest([CAST(distinct_destinations AS DOUBLE), CAST(mean_flow_duration_seconds AS DOUBLE), CAST(outbound_byte_ratio AS DOUBLE), CAST(total_byte_count AS DOUBLE)]) AS value FROM fp),
med AS (SELECT ip, feature, median(value) AS med, count(*) AS n FROM long WHERE epoch < 20 GROUP BY ALL),
base AS (SELECT l.ip, l.feature, any_value(m.med) AS med, median(abs(l.value - m.med)) AS mad, any_value(m.n) AS n FROM long l JOIN med m ON l.ip = m.ip AND l.feature = m.feature WHERE l.epoch < 20 GROUP BY ALL)"""
)

SPARSE = """e AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, count(*) AS observation_count, 1 - pow(0.5, count(*)) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 490000.0 GROUP BY ALL),
bw AS (SELECT source AS a, target AS b, confidence FROM e UNION ALL SELECT target, source, confidence FROM e)"""

NATION = """per AS (SELECT a.n_name AS a, b.n_name AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE c_nationkey <> s_nationkey),
e AS (SELECT least(a, b) AS source, greatest(a, b) AS target, count(*) AS observation_count, 1 - exp(-count(*) / 50.0) AS confidence FROM per GROUP BY ALL),
bw AS (SELECT source AS a, target AS b, confidence FROM e UNION ALL SELECT target, source, confidence FROM e)"""
#: The graph of all orders.
WHOLE = SPARSE.replace(" WHERE o_totalprice > 490000.0", "")

CONTACT = """ln AS (SELECT o_custkey, l_suppkey, l_orderkey * 10 + l_linenumber AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT DISTINCT 'c' || o_custkey AS source, 's' || s AS target FROM (SELECT o_custkey, unnest([min({'p': pos, 's': l_suppkey}).s, max({'p': pos, 's': l_suppkey}).s]) AS s FROM ln GROUP BY o_custkey) UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
bw AS (SELECT source AS a, target AS b FROM e UNION ALL SELECT target, source FROM e)"""
