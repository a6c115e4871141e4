"""Queries of the query-log operators over events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkfield.functions.reference import CATEGORIES, LONG_TAIL, PREFECTURES, USAGE_COLUMNS
from larkfield.operators import querylog as q
from larkfield.sources.tables import LOG_SQL, query_log

LOG = f"WITH RECURSIVE log AS ({LOG_SQL}), "


def _pct(n: str, total: str) -> str:
    return f"concat(printf('%.1f', coalesce({n}::DOUBLE * 100.0::DOUBLE / nullif({total}, 0)::DOUBLE, 0)), '%')"


def _over(f, *args):
    return lambda spark, sf_dir: f(query_log(spark, sf_dir), *args)


QUERIES = {
    "log_dedup_window": lambda s, d: q.dedup_window(query_log(s, d).select("row_idx", F.col("ai_classification").alias("query"))),
    "log_clean": lambda s, d: q.clean(query_log(s, d)).select("row_idx", "query", "same_query_count"),
    "log_count_queries": _over(q.count_queries),
    "log_count_labels": _over(q.count_labels),
    "log_summary": _over(q.summary),
    "log_daily": _over(q.daily),
    "log_hourly": _over(q.hourly),
    "log_prefectures": _over(q.by_prefecture),
    "log_top_queries": _over(q.top_queries),
    "log_daily_category": _over(q.daily_category),
    "log_column_usage": _over(q.column_usage),
    "log_long_tail": _over(q.long_tail),
    "log_usage_distribution": lambda s, d: q.usage_distribution(q.count_queries(query_log(s, d))),
    "log_filter_rows": lambda s, d: q.filter_rows(q.with_query_count(query_log(s, d)), "click", 20, "WALKING").select("row_idx", "query", "same_query_count"),
    "log_retry_targets": lambda s, d: q.retry_targets(query_log(s, d), "error", 60).select("row_idx", "query"),
    "log_apply_labels": lambda s, d: q.apply_labels(query_log(s, d).select("row_idx", "query", "ai_classification"), q.count_queries(query_log(s, d)).where("first_idx % 3 = 0").select("query", F.lit("poi").alias("label")), "error"),
    "log_page": lambda s, d: q.page(query_log(s, d).select("row_idx", "query"), 100, 50),
}

_GREEDY = """kept(query, row_idx) AS (
  SELECT query, min(row_idx) FROM src GROUP BY query
  UNION ALL SELECT * FROM (SELECT k.query, (SELECT min(s.row_idx) FROM src s WHERE s.query = k.query AND s.row_idx > k.row_idx + 5) AS row_idx FROM kept k) x WHERE row_idx IS NOT NULL
)"""
_BUCKET = "CASE " + " ".join(f"WHEN n >= {low} THEN '{label}'" for label, low, _ in LONG_TAIL) + " END"
_DATE = "CASE WHEN length(trim(datetime)) < 10 THEN 'unknown' ELSE substr(datetime, 1, 10) END"
_HAVERSINE = "2 * 6371.0 * asin(least(1.0, sqrt(power(sin((radians(p.lat) - radians(l.lat)) / 2), 2) + cos(radians(l.lat)) * cos(radians(p.lat)) * power(sin((radians(p.lng) - radians(l.lng)) / 2), 2))))"
_VALUES = ", ".join(f"({k}, '{n}', {y}, {x}, '{r}')" for k, (n, y, x, r) in enumerate(PREFECTURES))
_KNOWN = ", ".join(f"'{c}'" for c in CATEGORIES)
_BUCKETS = ", ".join(f"('{b}')" for b, _, _ in LONG_TAIL)

ORACLE = {
    "log_dedup_window": f"{LOG} src AS (SELECT row_idx, ai_classification AS query FROM log), {_GREEDY} SELECT row_idx, query FROM kept",
    "log_clean": f"{LOG} src AS (SELECT row_idx, query FROM log), n AS (SELECT query, count(*) AS same_query_count FROM src GROUP BY query), {_GREEDY} SELECT k.row_idx, k.query, n.same_query_count FROM kept k JOIN n ON k.query = n.query",
    "log_count_queries": f"{LOG} x AS (SELECT 1) SELECT query, count(*) AS count, min(row_idx) AS first_idx FROM log GROUP BY query",
    "log_count_labels": f"{LOG} n AS (SELECT ai_classification, count(*) AS count FROM log GROUP BY 1), t AS (SELECT sum(count) AS total FROM n) SELECT ai_classification, count, {_pct('count', 'total')} AS ratio FROM n, t",
    "log_summary": f"{LOG} n AS (SELECT query, count(*) AS n FROM log GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS uniques, count(*) FILTER (n > 1) AS duplicated FROM n",
    "log_daily": f"{LOG} x AS (SELECT 1) SELECT {_DATE} AS date, count(*) AS count FROM log GROUP BY 1",
    "log_hourly": f"""{LOG} h AS (SELECT (try_cast(nullif(substr(datetime, 12, 2), '') AS INT) + 9) % 24 AS h, count(*) AS n FROM log GROUP BY 1)
SELECT r.range::VARCHAR AS hour_jst, coalesce(h.n, 0) AS count FROM range(24) r LEFT JOIN h ON h.h = r.range UNION ALL SELECT 'unknown', n FROM h WHERE h IS NULL""",
    "log_prefectures": f"""{LOG} p(ord, name, lat, lng, romaji) AS (VALUES {_VALUES}),
l AS (SELECT row_idx, CASE WHEN len(string_split(proximity, ',')) = 2 THEN try_cast(string_split(proximity, ',')[1] AS DOUBLE) END AS lng, CASE WHEN len(string_split(proximity, ',')) = 2 THEN try_cast(string_split(proximity, ',')[2] AS DOUBLE) END AS lat FROM log),
near AS (SELECT l.row_idx, arg_min(p.ord, struct_pack(d := {_HAVERSINE}, o := p.ord)) AS ord FROM l, p WHERE l.lng IS NOT NULL AND l.lat IS NOT NULL GROUP BY l.row_idx),
n AS (SELECT ord, count(*) AS n FROM near GROUP BY 1), t AS (SELECT count(*) AS total FROM log)
SELECT p.name AS prefecture, p.romaji AS prefecture_romaji, coalesce(n.n, 0) AS count, {_pct('coalesce(n.n, 0)', 'total')} AS rate_pct FROM p LEFT JOIN n USING (ord), t
UNION ALL SELECT '(no proximity)', '', total - (SELECT count(*) FROM near), {_pct('(total - (SELECT count(*) FROM near))', 'total')} FROM t""",
    "log_top_queries": f"""{LOG} n AS (SELECT ai_classification, query, count(*) AS count, min(row_idx) AS f FROM log GROUP BY 1, 2)
SELECT ai_classification, query, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY ai_classification ORDER BY count DESC, f) AS rank FROM n) WHERE rank <= 20""",
    "log_daily_category": f"""{LOG} n AS (SELECT {_DATE} AS date, ai_classification, count(*) AS n FROM log GROUP BY 1, 2), d AS (SELECT date, sum(n) AS total FROM n GROUP BY 1), c AS (SELECT DISTINCT ai_classification FROM n)
SELECT d.date, c.ai_classification, coalesce(n.n, 0) AS count, {_pct('coalesce(n.n, 0)', 'd.total')} AS ratio FROM d CROSS JOIN c LEFT JOIN n ON n.date = d.date AND n.ai_classification = c.ai_classification""",
    "log_column_usage": f"{LOG} x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{c}' AS parameter, count(*) FILTER (trim({c}) <> '') AS count, count(*) AS total, {_pct(f'''count(*) FILTER (trim({c}) <> '')''', 'count(*)')} AS rate_pct FROM log" for c in USAGE_COLUMNS),
    "log_long_tail": f"""{LOG} per AS (SELECT 'all' AS scope, query, count(*) AS n FROM log GROUP BY query UNION ALL SELECT 'category:' || ai_classification, query, count(*) FROM log GROUP BY ai_classification, query),
b AS (SELECT scope, {_BUCKET} AS bucket, count(*) AS u, sum(n)::BIGINT AS t FROM per GROUP BY 1, 2), s AS (SELECT scope, sum(n)::BIGINT AS total FROM per GROUP BY 1), k(bucket) AS (VALUES {_BUCKETS})
SELECT s.scope, k.bucket, coalesce(b.u, 0) AS unique_query_count, coalesce(b.t, 0) AS total_count, {_pct('coalesce(b.t, 0)', 's.total')} AS volume_pct FROM s CROSS JOIN k LEFT JOIN b ON b.scope = s.scope AND b.bucket = k.bucket""",
    "log_usage_distribution": f"{LOG} n AS (SELECT count(*) AS c FROM log GROUP BY query) SELECT count(*) FILTER (c = 1) AS n_1, count(*) FILTER (c BETWEEN 2 AND 10) AS n_2_10, count(*) FILTER (c BETWEEN 11 AND 50) AS n_11_50, count(*) FILTER (c >= 51) AS n_51 FROM n",
    "log_filter_rows": f"{LOG} n AS (SELECT query, count(*) AS same_query_count FROM log GROUP BY 1) SELECT row_idx, query, same_query_count FROM log JOIN n USING (query) WHERE ai_classification = 'click' AND same_query_count >= 20 AND navigation_profile = 'walking'",
    "log_retry_targets": f"{LOG} x AS (SELECT 1) SELECT row_idx, query FROM log WHERE ai_classification = 'error' ORDER BY row_idx LIMIT 60",
    "log_apply_labels": f"{LOG} n AS (SELECT query, min(row_idx) AS f FROM log GROUP BY 1) SELECT row_idx, query, CASE WHEN ai_classification = 'error' AND f % 3 = 0 THEN 'poi' ELSE ai_classification END AS ai_classification FROM log JOIN n USING (query)",
    "log_page": f"{LOG} x AS (SELECT 1) SELECT row_idx, query FROM log ORDER BY row_idx LIMIT 50 OFFSET 100",
}
