"""SQL forms of the API-call adapter and its filters."""

from __future__ import annotations

from runlens import fixed_values as V
from runlens.plans import sql as S

CALLS_SQL = f"""
    SELECT page_id % 40 AS run_id, 'TC' || lpad(CAST(page_id % 60 AS VARCHAR), 3, '0') AS test_case, page_id AS seq,
           {S.pick(('GET', 'POST', 'PUT'), 'page_id % 3')} AS method, CAST({S.pick((200, 201, 404, 500), 'page_id % 4')} AS BIGINT) AS status,
           CAST(length(html) * 3 AS BIGINT) AS duration,
           CASE page_id % 12 WHEN 0 THEN url || '/app.CSS?v=1' WHEN 1 THEN url || '/static/logo' WHEN 2 THEN 'https://www.google-analytics.com/collect?u=' || url
                WHEN 3 THEN 'not a url ' || url WHEN 4 THEN 'https://api.example.com/api/v1/items/' || page_id || '?from=' || split_part(url, '//', 2)
                WHEN 5 THEN 'https://www.shop.example' WHEN 6 THEN url || '/Sentry/x' ELSE url END AS url
    FROM pages"""
_PATH = "split_part(lower(url), '?', 1)"
STATIC_SQL = "(" + " OR ".join([f"ends_with({_PATH}, '{e}')" for e in V.STATIC_EXTENSIONS] + [f"contains({_PATH}, '{p}')" for p in V.STATIC_PATHS]) + ")"
KEPT_SQL = f"NOT {STATIC_SQL} AND NOT (" + " OR ".join(f"contains(lower(url), '{v}')" for v in V.TELEMETRY_VENDORS) + ")"
