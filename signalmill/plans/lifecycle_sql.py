"""DuckDB SQL of the lifecycle: greedy weeks, state metrics and states, as common table expressions over `buckets`."""

from __future__ import annotations

#: Rules of the next state in order: condition, state, reason. cur, v7, v30, wow and mom are columns.
RULES = (
    ("v7 <= 0 AND v30 < 3", "dormant", "no recent activity"),
    ("cur = 'dormant' AND wow > 0.3 AND v7 >= 3", "resurgent", "active after dormancy"),
    ("v30 < 3", "candidate", "little volume"),
    ("wow < -0.24 AND mom < -0.24 AND v30 >= 5", "declining", "weekly and monthly fall"),
    ("cur = 'declining' AND mom > 0.3 AND v30 >= 5 AND wow >= 0 AND v30 >= 9", "sustained", "no longer declining"),
    ("cur = 'declining' AND mom > 0.3 AND v30 >= 5", "emerging", "no longer declining"),
    ("cur IN ('sustained', 'peaking') AND wow < 0.06 AND mom > 0.09", "peaking", "growth slows"),
    ("mom > 0.3 AND v30 >= 9 AND wow >= 0", "sustained", "monthly growth"),
    ("wow > 0.105 AND v30 >= 3", "emerging", "weekly growth"),
)
STATE = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in RULES) + " ELSE cur END"
REASON = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in RULES) + " ELSE 'unchanged' END"


def growth(before: str, now: str) -> str:
    return f"CASE WHEN {before} = 0 THEN CASE WHEN {now} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE ({now} - {before}) / {before} END"


def weeks_sql(day: str, n: str = "", source: str = "buckets") -> str:
    """CTEs that end in weeks{n}: the array of greedy weeks per entity and geography at a date, and the day sums d{n} below it."""
    return f"""d{n} AS (SELECT entity, geography, bucket_date, CAST(sum(mentions) AS BIGINT) AS m FROM {source} WHERE {day} - bucket_date BETWEEN 0 AND 90 GROUP BY ALL),
nx{n} AS (SELECT a.entity, a.geography, a.bucket_date, min(b.bucket_date) AS nxt FROM d{n} a LEFT JOIN d{n} b ON a.entity = b.entity AND a.geography = b.geography AND b.bucket_date >= a.bucket_date + 7 GROUP BY ALL),
wk{n} AS (SELECT entity, geography, min(bucket_date) AS first FROM d{n} GROUP BY ALL UNION ALL
  SELECT nx.entity, nx.geography, nx.nxt FROM wk{n} w JOIN nx{n} nx ON w.entity = nx.entity AND w.geography = nx.geography AND w.first = nx.bucket_date WHERE nx.nxt IS NOT NULL),
ws{n} AS (SELECT w.entity, w.geography, w.first, CAST(sum(d.m) AS BIGINT) AS s FROM wk{n} w JOIN nx{n} nx ON w.entity = nx.entity AND w.geography = nx.geography AND w.first = nx.bucket_date
  JOIN d{n} d ON d.entity = w.entity AND d.geography = w.geography AND d.bucket_date >= w.first AND (nx.nxt IS NULL OR d.bucket_date < nx.nxt) GROUP BY ALL),
weeks{n} AS (SELECT entity, geography, list(s ORDER BY first) AS weeks FROM ws{n} GROUP BY ALL)"""


def metrics_sql(day: str, n: str = "", source: str = "buckets") -> str:
    """weeks_sql() and met{n}: volumes, velocity, growth and volatility per entity and geography."""
    volume = ", ".join(f"coalesce(sum(m) FILTER ({day} - bucket_date <= {k}), 0) AS v{k}" for k in (7, 30, 90))
    return f"""{weeks_sql(day, n, source)},
vo{n} AS (SELECT entity, geography, {volume} FROM d{n} GROUP BY ALL),
mx{n} AS (SELECT v.*, weeks, weeks[-1] AS this, CASE WHEN len(weeks) >= 2 THEN weeks[-2] ELSE 0 END AS prev, CASE WHEN v30 > 0 THEN (v90 - v30) / 2 ELSE 0 END AS pm
  FROM vo{n} v JOIN weeks{n} w ON v.entity = w.entity AND v.geography = w.geography),
met{n} AS (SELECT entity, geography, CAST(v7 AS BIGINT) AS v7, CAST(v30 AS BIGINT) AS v30, CAST(v90 AS BIGINT) AS v90, weeks, {growth('prev', 'this')} AS wow, {growth('pm', 'v30')} AS mom,
  CASE WHEN len(weeks) >= 2 THEN list_aggregate(weeks[greatest(len(weeks) - 4, 1):len(weeks)], 'stddev_samp') ELSE 0 END AS vol FROM mx{n})"""
