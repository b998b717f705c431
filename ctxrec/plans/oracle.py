"""DuckDB oracle SQL for the registered queries.

These texts are the *specification* the Spark operators are checked against
(the driver runs them in DuckDB on the same parquet tables). They restate the
fixture rules of FIXTURES.md and the semantics of each operator in plain SQL;
nothing in the engine executes them.
"""

from __future__ import annotations

# --- fixture prelude: driver tables -> events, views, resources -------------

_EVENTS = """
e0 AS (SELECT event_id, ts, user_id, event_type,
              cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events),
b_events AS (
  SELECT event_id, concat('u', cast(user_id AS varchar)) AS username,
         concat(cast(user_id AS varchar), '-', cast(k % 3 AS varchar)) AS tab_id,
         CASE event_type WHEN 'view' THEN 'ready' WHEN 'click' THEN 'activate'
              WHEN 'purchase' THEN 'deactivate' WHEN 'error' THEN 'close' ELSE 'open' END AS type,
         CASE WHEN k % 17 = 0 THEN concat('http://www.facebook.com/site', cast(k AS varchar))
              WHEN k % 29 = 0 THEN concat('ftp://site', cast(k AS varchar), '.example.com/')
              ELSE concat('http://site', cast(k AS varchar), '.example.com/') END AS url,
         epoch_us(ts) // 1000 AS ts_ms,
         cast(40 + user_id % 10 AS double) AS lat,
         cast(2 + floor(hour(ts) / 6) AS double) AS lon, k, user_id
  FROM e0)"""

_VIEWS = """
se AS (SELECT * FROM b_events WHERE type IN ('ready', 'activate', 'deactivate', 'close')),
s1 AS (
  SELECT *, lag(type) OVER w AS p_type, lag(event_id) OVER w AS p_event_id, lag(url) OVER w AS p_url,
         lag(ts_ms) OVER w AS p_ts_ms, lag(username) OVER w AS p_username,
         lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon,
         CASE WHEN type = 'ready' THEN lag(url) OVER (PARTITION BY tab_id, type = 'ready'
                                                      ORDER BY ts_ms, event_id) END AS prev_ready_url
  FROM se WINDOW w AS (PARTITION BY tab_id ORDER BY ts_ms, event_id)),
s2 AS (
  SELECT *, (type IN ('deactivate', 'close') AND coalesce(p_type IN ('ready', 'activate'), false)) AS emit,
         CASE WHEN type = 'ready' AND prev_ready_url <> '' THEN prev_ready_url END AS cand
  FROM s1),
s3 AS (
  SELECT *, coalesce(sum(CASE WHEN emit THEN 1 ELSE 0 END) OVER (
           PARTITION BY tab_id ORDER BY ts_ms, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM s2),
s4 AS (
  SELECT *, last_value(cand IGNORE NULLS) OVER (
           PARTITION BY tab_id, seg ORDER BY ts_ms, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent
  FROM s3),
views AS (
  SELECT p_event_id AS view_id, p_url AS url, p_username AS username,
         cast(floor((ts_ms - p_ts_ms) / 1000) AS bigint) AS duration,
         p_lat AS lat, p_lon AS lon, p_ts_ms AS ts_ms,
         cast(hour(epoch_ms(p_ts_ms)) AS int) AS daytime,
         cast(isodow(epoch_ms(p_ts_ms)) - 1 AS int) AS weekday,
         CASE WHEN (cast(substr(p_username, 2) AS bigint)
                    + cast(regexp_extract(p_url, 'site([0-9]+)', 1) AS int)) % 3 = 0
              THEN cast((cast(substr(p_username, 2) AS bigint) * 7
                         + cast(regexp_extract(p_url, 'site([0-9]+)', 1) AS int)) % 6 AS varchar)
              ELSE 'none' END AS feedback,
         parent, tab_id, event_id AS end_event_id
  FROM s4 WHERE emit)"""

# Resources: document k is the content of site k; default blacklist patterns.
_RESOURCES = """
resources AS (
  SELECT url, text AS content, true AS processed,
         (lower(regexp_extract(url, '^([A-Za-z0-9+.\\-]+):', 1)) NOT IN ('http', 'https')
          OR contains(url, 'facebook') OR contains(url, 'google') OR contains(url, 'gmail')
          OR contains(url, 'amazon') OR contains(url, 'twitter') OR contains(url, 'delicious')) AS blacklisted,
         coalesce(length(text), 0) >= 200 AS textual
  FROM (SELECT CASE WHEN doc_id % 17 = 0 THEN concat('http://www.facebook.com/site', cast(doc_id AS varchar))
                    WHEN doc_id % 29 = 0 THEN concat('ftp://site', cast(doc_id AS varchar), '.example.com/')
                    ELSE concat('http://site', cast(doc_id AS varchar), '.example.com/') END AS url, text
        FROM documents))"""

_HEUR = """
hu AS (SELECT username, url, count(*) AS n, avg(duration) AS d, sum(duration) AS sd
       FROM views WHERE feedback = 'none' GROUP BY username, url),
ha AS (SELECT username, avg(n) AS an, sum(sd) / sum(n) AS ad FROM hu GROUP BY username),
heur AS (
  SELECT hu.username, hu.url,
         cast(CASE WHEN n > an THEN 1 ELSE 0 END + CASE WHEN n > 3 * an THEN 1 ELSE 0 END
              + CASE WHEN d > ad THEN 1 ELSE 0 END + CASE WHEN d > 3 * ad THEN 2 ELSE 0 END AS int) AS score
  FROM hu JOIN ha ON hu.username = ha.username)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


EV = with_ctes(_EVENTS)
V = with_ctes(_EVENTS, _VIEWS)
VR = with_ctes(_EVENTS, _VIEWS, _RESOURCES)
VH = with_ctes(_EVENTS, _VIEWS, _HEUR)
VRH = with_ctes(_EVENTS, _VIEWS, _RESOURCES, _HEUR)

VIEW_COLS = "view_id, url, username, duration, lat, lon, ts_ms, daytime, weekday, feedback, parent"

ORACLE: dict[str, str] = {}


def sql(key: str, text: str) -> None:
    ORACLE[key] = text.strip()


sql("events_to_views", f"{V} SELECT {VIEW_COLS} FROM views")
sql("rank_heuristic", f"{VH} SELECT username, url, score FROM heur")

# --- 2.1 scans, sources, sinks --------------------------------------------------

_TABS = """
tn AS (SELECT DISTINCT user_id, k % 3 AS n FROM e0),
tp AS (SELECT user_id, n, lag(n) OVER (PARTITION BY user_id ORDER BY n) AS pn FROM tn),
tabs AS (SELECT concat(cast(user_id AS varchar), '-', cast(n AS varchar)) AS tab_id,
                concat(cast(user_id AS varchar), '-', cast(pn AS varchar)) AS parent_id,
                concat('u', cast(user_id AS varchar)) AS username
         FROM tp WHERE pn IS NOT NULL)"""



def _collection(name: str, key: str, table: str) -> str:
    part = f"cast(concat('0x', substr(md5(cast({key} AS varchar)), 1, 8)) AS bigint)"
    return f"SELECT '{name}' AS collection, count(*) AS n_rows, cast(sum({part}) AS bigint) AS keys_sum FROM {table}"


sql("scan_collections", with_ctes(_EVENTS, _VIEWS, _RESOURCES, _TABS) + " " + " UNION ALL ".join([
    _collection("events", "event_id", "b_events"), _collection("tabs", "tab_id", "tabs"),
    _collection("users", "username", "(SELECT DISTINCT username FROM b_events)"),
    _collection("resources", "url", "resources"), _collection("views", "view_id", "views")]))

sql("ingest_event", f"{EV} SELECT event_id, type, url, ts_ms, tab_id, username, lat, lon FROM b_events")

sql("ingest_tab_relation", with_ctes(_EVENTS, _TABS) + " SELECT tab_id, parent_id, username FROM tabs")

sql("register_users", """
SELECT DISTINCT concat('u', cast(user_id AS varchar)) AS username FROM events
WHERE event_type = 'signup'
  AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02 00:00:00')""")

sql("record_feedback", f"""{V}
SELECT view_id, username, url,
       CASE WHEN (cast(substr(username, 2) AS bigint) + cast(regexp_extract(url, 'site([0-9]+)', 1) AS int)) % 3 = 0
            THEN cast((cast(substr(username, 2) AS bigint) * 7 + cast(regexp_extract(url, 'site([0-9]+)', 1) AS int)
                       + 1) % 6 AS varchar)
            ELSE 'none' END AS feedback
FROM views""")

sql("feedback_worklist", f"""{VR}
SELECT DISTINCT username, url FROM views
WHERE feedback = 'none' AND url IN (SELECT url FROM resources WHERE NOT blacklisted)""")

sql("upsert_resources", f"""{VR}
SELECT url, processed, blacklisted, textual, cast(length(content) AS bigint) AS content_chars, md5(content) AS content_md5 FROM resources
UNION ALL
SELECT url, false, false, false, cast(NULL AS bigint), cast(NULL AS varchar) FROM (
  SELECT url FROM views UNION SELECT url FROM pages) n
WHERE url NOT IN (SELECT url FROM resources)""")

sql("mark_processed", f"""{V}
SELECT event_id, (event_id IN (SELECT view_id FROM views) OR event_id IN (SELECT end_event_id FROM views)) AS processed
FROM b_events""")

sql("reset_conversion", f"{EV} SELECT event_id, false AS processed FROM b_events")

sql("reset_downloads", f"""{with_ctes(_RESOURCES)}
SELECT url, false AS processed, false AS blacklisted, textual, cast(NULL AS bigint) AS content_chars,
       cast(NULL AS varchar) AS content_md5 FROM resources""")

sql("clean_users", f"{V} SELECT DISTINCT username FROM views")

sql("bulk_load", f"{V} SELECT {VIEW_COLS} FROM views")

sql("load_training_corpus", f"""{with_ctes(_RESOURCES)}
SELECT 'docs' AS training_set, url AS doc, cast(length(content) AS bigint) AS n_chars, md5(content) AS text_md5
FROM resources WHERE NOT blacklisted AND processed
UNION ALL SELECT 'folder', cast(item_id AS varchar), cast(length(text) AS bigint), md5(text) FROM benchmark WHERE text IS NOT NULL""")

# --- 2.2 projections, filters ------------------------------------------------------

sql("distinct_usernames", f"{V} SELECT DISTINCT username FROM views")
sql("user_view_urls", f"{V} SELECT DISTINCT username, url FROM views")
sql("eligible_resources", f"{with_ctes(_RESOURCES)} SELECT url FROM resources WHERE NOT blacklisted AND processed")
sql("nonempty_resources", f"{with_ctes(_RESOURCES)} SELECT url FROM resources WHERE length(content) > 0")
sql("ranked_view_urls", f"{V} SELECT DISTINCT username, url FROM views WHERE feedback IS NOT NULL AND feedback <> 'none'")
sql("unranked_view_urls", f"{V} SELECT DISTINCT username, url FROM views WHERE feedback = 'none'")
sql("particular_user", f"{V} SELECT DISTINCT username, url FROM views WHERE username = 'u1'")

sql("url_blacklist", f"""{EV}
SELECT url, (lower(regexp_extract(url, '^([A-Za-z0-9+.\\-]+):', 1)) NOT IN ('http', 'https')
             OR contains(url, 'facebook') OR contains(url, 'google') OR contains(url, 'gmail')
             OR contains(url, 'amazon') OR contains(url, 'twitter') OR contains(url, 'delicious')
             OR contains(url, 'spam-farm') OR contains(url, 'cheap-pills')) AS blacklisted
FROM (SELECT url FROM pages UNION SELECT url FROM b_events) u""")

sql("already_downloaded", f"""{VR}
SELECT url, url IN (SELECT url FROM resources WHERE processed) AS downloaded FROM (SELECT DISTINCT url FROM views) u""")

sql("pending_resources", f"""{with_ctes(_RESOURCES)}
SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM resources)""")

sql("views_features", f"""{V}
SELECT view_id, lat, lon, duration, daytime, cast(floor(daytime / 4) AS int) AS day_part, weekday FROM views""")

# --- 2.3 joins --------------------------------------------------------------------

sql("user_documents", f"""{VR}
SELECT u.username, u.url, cast(length(r.content) AS bigint) AS n_chars, md5(r.content) AS content_md5
FROM (SELECT DISTINCT username, url FROM views) u JOIN resources r ON u.url = r.url
WHERE NOT r.blacklisted AND r.processed
UNION ALL
SELECT source AS username, cast(doc_id AS varchar) AS url, cast(length(text) AS bigint) AS n_chars, md5(text) AS content_md5
FROM documents""")

sql("views_not_blacklisted", f"""{VR}
SELECT view_id, url, username FROM views v
WHERE NOT EXISTS (SELECT 1 FROM resources r WHERE r.url = v.url AND r.blacklisted)""")

_ELIG = "url IN (SELECT url FROM resources WHERE NOT blacklisted AND processed)"
sql("ranked_dataset", f"""{VR}
SELECT DISTINCT username, url FROM views WHERE feedback IS NOT NULL AND feedback <> 'none' AND {_ELIG}""")
sql("unranked_dataset", f"""{VR}
SELECT DISTINCT username, url FROM views WHERE feedback = 'none' AND {_ELIG}""")

sql("first_view_per_resource", f"""{V}
SELECT username, url, view_id, ts_ms, duration FROM (
  SELECT *, row_number() OVER (PARTITION BY username, url ORDER BY ts_ms, view_id) AS rn FROM views) WHERE rn = 1""")

_LABEL = """
lab AS (SELECT username, url, cast(feedback AS int) AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY username, url ORDER BY ts_ms, view_id) AS rn
  FROM views WHERE feedback IS NOT NULL AND feedback <> 'none') WHERE rn = 1)"""

sql("resource_label", with_ctes(_EVENTS, _VIEWS, _LABEL) + " SELECT username, url, label FROM lab")

sql("recent_activity", f"""{V}
SELECT view_id,
  count(*) OVER (PARTITION BY username ORDER BY ts_ms RANGE BETWEEN 3599999 PRECEDING AND 1 PRECEDING) > 0 AS active_1h,
  count(*) OVER (PARTITION BY username ORDER BY ts_ms RANGE BETWEEN 7199999 PRECEDING AND 1 PRECEDING) > 0 AS active_2h,
  count(*) OVER (PARTITION BY username ORDER BY ts_ms RANGE BETWEEN 10799999 PRECEDING AND 1 PRECEDING) > 0 AS active_3h,
  count(*) OVER (PARTITION BY username ORDER BY ts_ms RANGE BETWEEN 14399999 PRECEDING AND 1 PRECEDING) > 0 AS active_4h,
  count(*) OVER (PARTITION BY username ORDER BY ts_ms RANGE BETWEEN 17999999 PRECEDING AND 1 PRECEDING) > 0 AS active_5h
FROM views""")

# --- 2.4 conversion parts -----------------------------------------------------------

sql("view_attributes", f"{V} SELECT view_id, duration, ts_ms, daytime, weekday FROM views")
sql("view_parent", f"{V} SELECT view_id, url, parent FROM views")
sql("resource_parents", f"{V} SELECT DISTINCT url, parent FROM views WHERE parent IS NOT NULL")

# --- 2.5 aggregations ---------------------------------------------------------------

_LOC = """
lc AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL THEN 0.0
                      WHEN lat IS NOT DISTINCT FROM lag(lat) OVER w AND lon IS NOT DISTINCT FROM lag(lon) OVER w THEN 0.0
                      ELSE 1.0 END AS location_changed
       FROM views WINDOW w AS (PARTITION BY username, url ORDER BY ts_ms, view_id))"""


def _ctx_select(series):
    parts = ["count(*) AS n_views", "cast(sum(duration) AS bigint) AS total_duration"]
    fns = {"average": "avg", "mean": "avg", "median": "median", "var": "var_pop", "std": "stddev_pop"}
    for ind in ["average", "mean", "median", "var", "std"]:
        for s in series:
            parts.append(f"round({fns[ind]}(cast({s} AS double)), 6) AS {ind}_{s}")
    return ", ".join(parts)


CTX17 = _ctx_select(["daytime", "weekday", "location_changed"])
CTX12 = _ctx_select(["daytime", "weekday"])
sql("context_features", with_ctes(_EVENTS, _VIEWS, _LOC) + f" SELECT username, url, {CTX17} FROM lc GROUP BY username, url")
sql("context_features_v1", f"{V} SELECT username, url, {CTX12} FROM views GROUP BY username, url")

_CTXRAW = """
cf AS (SELECT username, url, count(*) AS a1, sum(duration) AS a2,
  avg(daytime) AS a3, avg(weekday) AS a4, avg(location_changed) AS a5,
  avg(daytime) AS a6, avg(weekday) AS a7, avg(location_changed) AS a8,
  median(cast(daytime AS double)) AS a9, median(cast(weekday AS double)) AS a10, median(location_changed) AS a11,
  var_pop(daytime) AS a12, var_pop(weekday) AS a13, var_pop(location_changed) AS a14,
  stddev_pop(daytime) AS a15, stddev_pop(weekday) AS a16, stddev_pop(location_changed) AS a17
  FROM lc GROUP BY username, url)"""
sql("context_row_mean", with_ctes(_EVENTS, _VIEWS, _LOC, _CTXRAW) + """
SELECT username, url, round((a1 + a2 + a3 + a4 + a5 + a6 + a7 + a8 + a9 + a10 + a11 + a12 + a13 + a14 + a15 + a16 + a17) / 17, 6) AS row_mean FROM cf""")

sql("user_averages", f"""{V}
SELECT username, round(sum(sd) / sum(n), 6) AS avg_duration, round(avg(n), 6) AS avg_views_per_url FROM (
  SELECT username, url, count(*) AS n, sum(duration) AS sd FROM views WHERE feedback = 'none' GROUP BY username, url)
GROUP BY username""")

sql("rank_histogram", f"{VH} SELECT cast(round(score) AS int) AS score_bucket, count(*) AS n FROM heur GROUP BY 1")

# --- 2.6 windows --------------------------------------------------------------------

sql("location_changed", with_ctes(_EVENTS, _VIEWS, _LOC) + " SELECT view_id, location_changed = 1.0 AS location_changed FROM lc")

sql("previous_ready_url", f"""{EV}
SELECT event_id, tab_id, lag(url) OVER (PARTITION BY tab_id ORDER BY ts_ms, event_id) AS prev_ready_url
FROM b_events WHERE type = 'ready'""")

# --- 2.7 sorts ----------------------------------------------------------------------

sql("events_by_tab_time", f"""{EV}
SELECT event_id, tab_id, row_number() OVER (PARTITION BY tab_id ORDER BY ts_ms, event_id) - 1 AS pos FROM b_events""")

sql("holdout_split", f"""{VR},
rd AS (SELECT DISTINCT username, url FROM views WHERE feedback IS NOT NULL AND feedback <> 'none' AND {_ELIG})
SELECT username, url, cast(CASE WHEN row_number() OVER (PARTITION BY username ORDER BY url) - 1
                                   < floor(count(*) OVER (PARTITION BY username) / 2) THEN 0 ELSE 1 END AS int) AS half
FROM rd""")

# --- 2.8 rankings -------------------------------------------------------------------

_EXPL = _LABEL + """,
expl AS (SELECT username, url, cast(label AS double) AS score, 'explicit' AS source FROM lab
         WHERE url IN (SELECT url FROM resources WHERE NOT blacklisted AND processed))"""

sql("rank_explicit", with_ctes(_EVENTS, _VIEWS, _RESOURCES, _EXPL) + " SELECT username, url, score, source FROM expl")

sql("rank_constant", f"""{VR}
SELECT DISTINCT username, url, 2.5 AS score FROM views WHERE feedback = 'none' AND {_ELIG}""")

sql("merge_rankings", with_ctes(_EVENTS, _VIEWS, _RESOURCES, _HEUR, _EXPL) + """
SELECT username, url, score, source FROM expl
UNION ALL
SELECT username, url, cast(score AS double), 'heuristic' FROM heur h
WHERE NOT EXISTS (SELECT 1 FROM expl e WHERE e.username = h.username AND e.url = h.url)""")

# --- 2.10 page text -------------------------------------------------------------------

_DROP = r"(?is)<(script|style|head)(\s[^>]*)?>.*?</(script|style|head)>|<!--.*?-->"
_BLOCK = r"(?i)<\s*/?\s*(p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|article|nav|section|header|footer|table|tr|td|br)\b[^>]*>"
_LINK = r"(?is)<a\b[^>]*>(.*?)</a>"


def _clean(x: str) -> str:
    t = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        t = f"replace({t}, '{ent}', '{ch}')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


_PAGE_TEXT = f"""
pg AS (SELECT page_id, url, string_split_regex(regexp_replace(coalesce(html, ''), '{_DROP}', '', 'g'), '{_BLOCK}') AS raw
       FROM pages),
bl AS (SELECT page_id, unnest(raw) AS b, generate_subscripts(raw, 1) AS pos FROM pg),
bc AS (SELECT page_id, pos, {_clean('b')} AS t,
              {_clean(f"array_to_string(regexp_extract_all(b, '{_LINK}', 1), ' ')")} AS lt FROM bl),
bw AS (SELECT page_id, pos, t, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS w,
              CASE WHEN lt = '' THEN 0 ELSE len(string_split(lt, ' ')) END AS lw FROM bc),
bn AS (SELECT page_id, pos, t, w, lw / w AS ld,
              coalesce(lag(w) OVER p, 0) AS pw, coalesce(lag(lw / w) OVER p, 0.0) AS pld,
              coalesce(lead(w) OVER p, 0) AS nw
       FROM bw WHERE w > 0 WINDOW p AS (PARTITION BY page_id ORDER BY pos)),
bk AS (SELECT page_id, pos, t, CASE WHEN ld > 1.0 / 3.0 THEN false
                                    WHEN pld <= 0.555556 THEN (w > 16 OR nw > 15 OR pw > 4)
                                    ELSE (w > 40 OR nw > 17) END AS keep FROM bn),
ptext AS (SELECT p.page_id, p.url, coalesce(string_agg(bk.t, chr(10) ORDER BY bk.pos) FILTER (WHERE bk.keep), '') AS text
          FROM pages p LEFT JOIN bk ON p.page_id = bk.page_id GROUP BY p.page_id, p.url)"""

sql("extract_page_text", with_ctes(_PAGE_TEXT) + " SELECT page_id, url, text FROM ptext")

sql("classify_resources", with_ctes(_PAGE_TEXT) + """
SELECT url, true AS processed, text = '' AS blacklisted, length(text) >= 200 AS textual,
       CASE WHEN text = '' THEN NULL ELSE cast(length(text) AS bigint) END AS content_chars,
       CASE WHEN text = '' THEN NULL ELSE md5(text) END AS content_md5
FROM ptext""")

sql("prepare_resources", with_ctes(_PAGE_TEXT) + """,
first_page AS (SELECT url, arg_min(text, page_id) AS text FROM ptext GROUP BY url),
pr AS (SELECT url, CASE WHEN lower(regexp_extract(url, '^([A-Za-z0-9+.\\-]+):', 1)) NOT IN ('http', 'https')
                          OR contains(url, 'facebook') OR contains(url, 'google') OR contains(url, 'gmail')
                          OR contains(url, 'amazon') OR contains(url, 'twitter') OR contains(url, 'delicious')
                          OR contains(url, 'spam-farm') OR contains(url, 'cheap-pills') THEN '' ELSE text END AS text
       FROM first_page)
SELECT url, true AS processed, text = '' AS blacklisted, length(text) >= 200 AS textual,
       CASE WHEN text = '' THEN NULL ELSE cast(length(text) AS bigint) END AS content_chars,
       CASE WHEN text = '' THEN NULL ELSE md5(text) END AS content_md5
FROM pr""")

# --- 2.11 text features ------------------------------------------------------------

_TOKEN = r"[\p{L}\p{N}_]{2,}"
_IDF = f"""
ctok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM documents),
ctf AS (SELECT doc_id, term, count(*) AS tf FROM ctok GROUP BY doc_id, term),
idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) AS idf FROM ctf GROUP BY term)"""

_UTF = f"""
ud AS (SELECT DISTINCT v.url, r.content FROM views v JOIN resources r ON v.url = r.url
       WHERE NOT r.blacklisted AND r.processed),
utok AS (SELECT url, unnest(regexp_extract_all(lower(content), '{_TOKEN}')) AS term FROM ud),
utf AS (SELECT url, term, count(*) AS tf FROM utok GROUP BY url, term)"""

sql("tokenize", f"""
SELECT doc_id, cast(len(regexp_extract_all(lower(text), '{_TOKEN}')) AS bigint) AS n_tokens,
       cast(len(list_distinct(regexp_extract_all(lower(text), '{_TOKEN}'))) AS bigint) AS n_terms,
       md5(array_to_string(regexp_extract_all(lower(text), '{_TOKEN}'), ' ')) AS tokens_md5
FROM documents""")

sql("tfidf", with_ctes(_IDF) + """,
uw AS (SELECT doc_id, ctf.term, tf * idf AS w FROM ctf JOIN idf ON ctf.term = idf.term),
un AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM uw GROUP BY doc_id)
SELECT uw.doc_id, term, round(w / norm, 6) AS weight FROM uw JOIN un ON uw.doc_id = un.doc_id""")

sql("user_text", with_ctes(_EVENTS, _VIEWS, _RESOURCES, _UTF) + f"""
SELECT username, term, cast(sum(tf) AS bigint) AS tf FROM (
  SELECT username, term, tf FROM (SELECT DISTINCT username, url FROM views) p JOIN utf ON p.url = utf.url
  UNION ALL
  SELECT source AS username, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term, 1 AS tf FROM documents)
GROUP BY username, term""")

sql("cluster_top_bigrams", r"""
WITH bt AS (SELECT source, doc_id, string_split_regex(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+') AS t
            FROM documents WHERE regexp_replace(lower(text), '^\s+|\s+$', '', 'g') <> ''),
bw AS (SELECT source, doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM bt),
bs AS (SELECT source, w, lead(w) OVER (PARTITION BY source ORDER BY doc_id, pos) AS w2 FROM bw),
bg AS (SELECT source, w AS w1, w2, count(*) AS n12 FROM bs WHERE w2 IS NOT NULL GROUP BY source, w, w2 HAVING count(*) >= 3),
wc AS (SELECT source, w, count(*) AS nw FROM bw GROUP BY source, w),
sc AS (SELECT bg.source, w1, w2, n12, n12 / (a.nw + b.nw - n12) AS score FROM bg
       JOIN wc a ON a.source = bg.source AND a.w = bg.w1 JOIN wc b ON b.source = bg.source AND b.w = bg.w2)
SELECT source, cast(rank AS int) AS rank, w1, w2, n12, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, w1, w2) AS rank FROM sc) WHERE rank <= 5""")

sql("cluster_top_word", with_ctes(_IDF) + """,
dw AS (SELECT doc_id, ctf.term, tf * idf AS w FROM ctf JOIN idf ON ctf.term = idf.term),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
cs AS (SELECT d.source, dw.term, sum(dw.w / dn.norm) AS weight FROM dw JOIN dn ON dw.doc_id = dn.doc_id
       JOIN documents d ON d.doc_id = dw.doc_id GROUP BY d.source, dw.term)
SELECT source, cast(rank AS int) AS rank, term, round(weight, 6) AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS rank FROM cs) WHERE rank <= 3""")

# --- 2.12 grouped k-means, unrolled --------------------------------------------------


def _sqd(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))")


def kmeans_ctes(points_cte: str, k: int, rounds: int, prefix: str = "km") -> tuple[str, str]:
    """CTEs of a grouped Lloyd run over ``points_cte`` (grp, key, feats).
    Returns (ctes, name of the final assignment CTE with grp, key, cluster)."""
    p = prefix
    ctes = [f"""
{p}_c0 AS (SELECT grp, cast(r - 1 AS int) AS cluster, feats AS center FROM (
  SELECT grp, feats, row_number() OVER (PARTITION BY grp ORDER BY mk) AS r
  FROM (SELECT grp, feats, min(key) AS mk FROM {points_cte} GROUP BY grp, feats)) WHERE r <= {k})"""]

    def assign(i):
        return f"""
{p}_a{i} AS MATERIALIZED (SELECT grp, key, feats, cluster FROM (
  SELECT pt.grp, pt.key, pt.feats, c.cluster,
         row_number() OVER (PARTITION BY pt.grp, pt.key
                            ORDER BY round({_sqd('pt.feats', 'c.center')}, 9), c.cluster) AS r
  FROM {points_cte} pt JOIN {p}_c{i} c ON pt.grp = c.grp) WHERE r = 1)"""

    for i in range(rounds):
        ctes.append(assign(i))
        ctes.append(f"""
{p}_m{i} AS (SELECT grp, cluster, list(v ORDER BY d) AS center FROM (
  SELECT grp, cluster, d, avg(x) AS v FROM (
    SELECT grp, cluster, unnest(feats) AS x, generate_subscripts(feats, 1) AS d FROM {p}_a{i})
  GROUP BY grp, cluster, d) GROUP BY grp, cluster),
{p}_c{i + 1} AS MATERIALIZED (SELECT c.grp, c.cluster, coalesce(m.center, c.center) AS center
  FROM {p}_c{i} c LEFT JOIN {p}_m{i} m ON c.grp = m.grp AND c.cluster = m.cluster)""")
    ctes.append(assign(rounds))
    return ",".join(ctes), f"{p}_a{rounds}"


LLOYD_ROUNDS = 20

_EMB_PTS = """
emb_pts AS (SELECT label AS grp, vec_id AS key, cast(embedding AS double[]) AS feats FROM embeddings)"""
_KM_TEXT, _KM_TEXT_OUT = kmeans_ctes("emb_pts", 5, LLOYD_ROUNDS, "kt")

_VIEW_PTS = """
cv AS (SELECT * FROM views v WHERE NOT EXISTS (SELECT 1 FROM resources r WHERE r.url = v.url AND r.blacklisted)),
view_pts AS (SELECT username AS grp, view_id AS key, url,
                    [lat, lon, cast(duration AS double), cast(daytime AS double),
                     cast(floor(daytime / 4) AS double), cast(weekday AS double)] AS feats FROM cv)"""
_KM_VIEW, _KM_VIEW_OUT = kmeans_ctes("view_pts", 10, LLOYD_ROUNDS, "kv")

_CTX_PTS = """
ctx_pts AS (SELECT username AS grp, url AS key,
  [cast(a1 AS double), cast(a2 AS double), round(a3, 6), round(a4, 6), round(a5, 6), round(a6, 6), round(a7, 6),
   round(a8, 6), round(a9, 6), round(a10, 6), round(a11, 6), round(a12, 6), round(a13, 6), round(a14, 6),
   round(a15, 6), round(a16, 6), round(a17, 6)] AS feats FROM cf)"""
_KM_CTX, _KM_CTX_OUT = kmeans_ctes("ctx_pts", 5, LLOYD_ROUNDS, "kc")

sql("kmeans_text_profiles", with_ctes(_EMB_PTS, _KM_TEXT) +
    f" SELECT grp AS label, key AS vec_id, cluster FROM {_KM_TEXT_OUT}")

sql("kmeans_view_profiles", with_ctes(_EVENTS, _VIEWS, _RESOURCES, _VIEW_PTS, _KM_VIEW) +
    f" SELECT grp AS username, key AS view_id, cluster FROM {_KM_VIEW_OUT}")

sql("kmeans_context_profiles", with_ctes(_EVENTS, _VIEWS, _LOC, _CTXRAW, _CTX_PTS, _KM_CTX) +
    f" SELECT grp AS username, key AS url, cluster FROM {_KM_CTX_OUT}")

sql("cluster_distribution", with_ctes(_EMB_PTS, _KM_TEXT) + f"""
SELECT grp AS label, cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 6) AS share
FROM {_KM_TEXT_OUT} GROUP BY grp, cluster""")

sql("cluster_members", with_ctes(_EMB_PTS, _KM_TEXT) +
    f" SELECT grp AS label, cluster, key AS member FROM {_KM_TEXT_OUT}")

_PROFILE_URLS = f"""
pu AS (SELECT DISTINCT a.grp AS username, a.cluster AS profile, p.url
       FROM {_KM_VIEW_OUT} a JOIN view_pts p ON a.grp = p.grp AND a.key = p.key)"""

sql("profile_urls", with_ctes(_EVENTS, _VIEWS, _RESOURCES, _VIEW_PTS, _KM_VIEW, _PROFILE_URLS) +
    " SELECT username, profile, url FROM pu")

sql("profile_documents", with_ctes(_EVENTS, _VIEWS, _RESOURCES, _VIEW_PTS, _KM_VIEW, _PROFILE_URLS, _UTF) + """
SELECT username, profile, term, cast(sum(tf) AS bigint) AS tf FROM pu JOIN utf ON pu.url = utf.url
GROUP BY username, profile, term""")

sql("profile_text", with_ctes(_EVENTS, _VIEWS, _RESOURCES, _LOC, _CTXRAW, _CTX_PTS, _KM_CTX, _UTF) + f"""
SELECT a.grp AS username, a.cluster AS profile, term, cast(sum(tf) AS bigint) AS tf
FROM {_KM_CTX_OUT} a JOIN utf ON a.key = utf.url GROUP BY a.grp, a.cluster, term""")

# --- 2.13 / 2.15 similarity and collaborative filtering ----------------------------------

_EMB_ALL = """
ep AS (SELECT cast(vec_id AS varchar) AS id, cast(label AS varchar) AS owner, cast(embedding AS double[]) AS feats
       FROM embeddings),
ed AS (SELECT a.id AS id_a, b.id AS id_b, round(sqrt(""" + _sqd("a.feats", "b.feats") + """), 9) AS distance
       FROM ep a JOIN ep b ON true)"""

sql("pairwise_euclidean", with_ctes(_EMB_ALL) + """
SELECT id_a, id_b, round(distance, 6) AS distance, cast(rank AS int) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS rank FROM ed WHERE id_a <> id_b)
WHERE rank <= 10""")

sql("best_matches", with_ctes(_EMB_ALL) + """
SELECT id_a, id_b, round(1.0 / (1.0 + distance), 6) AS similarity, cast(rank AS int) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS rank FROM ed)
WHERE rank <= 5""")

_PAGEVEC = """
pv AS (SELECT r.url, cast(e.embedding AS double[]) AS feats FROM resources r
       JOIN embeddings e ON e.vec_id = cast(regexp_extract(r.url, 'site([0-9]+)', 1) AS bigint)
       WHERE NOT r.blacklisted AND r.processed),
pvx AS (SELECT url, unnest(feats) AS x, generate_subscripts(feats, 1) AS d FROM pv)"""

_PROFVEC = """
pvec AS (SELECT username, profile, concat(username, ':', cast(profile AS varchar)) AS pid, list(v ORDER BY d) AS feats
         FROM (SELECT pu.username, pu.profile, d, avg(x) AS v FROM pu JOIN pvx ON pu.url = pvx.url
               GROUP BY pu.username, pu.profile, d) GROUP BY username, profile),
pnn AS (SELECT * FROM (
  SELECT a.pid AS id_a, b.pid AS id_b, a.username AS ua, a.profile AS pa, b.username AS ub, b.profile AS pb,
         round(sqrt(""" + _sqd("a.feats", "b.feats") + """), 9) AS distance FROM pvec a JOIN pvec b ON a.username <> b.username)
  QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) <= 10),
pnr AS (SELECT *, cast(row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS int) AS rank,
               1.0 / (1.0 + distance) AS similarity FROM pnn)"""

_RK = """
rk AS (SELECT username, url, score FROM expl
       UNION ALL SELECT username, url, cast(score AS double) FROM heur h
       WHERE NOT EXISTS (SELECT 1 FROM expl e WHERE e.username = h.username AND e.url = h.url))"""

_WR = """
wr AS (SELECT pnr.id_a, pnr.ua AS username, pnr.pa AS profile, pu.url, pnr.id_b, pnr.rank, rk.score * pnr.similarity AS weight
       FROM pnr JOIN pu ON pu.username = pnr.ub AND pu.profile = pnr.pb
       JOIN rk ON rk.username = pnr.ub AND rk.url = pu.url),
cfp AS (SELECT username, url, sum(weight) AS score FROM (
          SELECT username, profile, url, arg_max(weight, rank) AS weight FROM wr GROUP BY username, profile, url)
        GROUP BY username, url)"""

_CF_BASE = (_EVENTS, _VIEWS, _RESOURCES, _VIEW_PTS, _KM_VIEW, _PROFILE_URLS, _PAGEVEC, _PROFVEC)

sql("top10_profiles", with_ctes(*_CF_BASE) + " SELECT id_a, id_b, rank, round(similarity, 6) AS similarity FROM pnr")
sql("match_rank", with_ctes(*_CF_BASE) + " SELECT id_a, id_b, rank AS match_rank FROM pnr")
sql("weighted_ranks_join", with_ctes(*_CF_BASE, _HEUR, _EXPL, _RK, _WR) +
    " SELECT id_a, url, id_b, round(weight, 6) AS weight FROM wr")
sql("cf_profiles", with_ctes(*_CF_BASE, _HEUR, _EXPL, _RK, _WR) +
    " SELECT username, url, round(score, 6) AS score FROM cfp")
sql("sorted_recommendations", with_ctes(*_CF_BASE, _HEUR, _EXPL, _RK, _WR) + """
SELECT username, url, round(score, 6) AS score,
       cast(row_number() OVER (PARTITION BY username ORDER BY round(score, 6) DESC, url) AS int) AS position FROM cfp""")

sql("cf_users", with_ctes(_EVENTS, _VIEWS, _RESOURCES, _PAGEVEC, _HEUR, _EXPL, _RK) + """,
uvec AS (SELECT username, list(v ORDER BY d) AS feats FROM (
  SELECT u.username, d, avg(x) AS v FROM (SELECT DISTINCT username, url FROM views v
    WHERE NOT EXISTS (SELECT 1 FROM resources r WHERE r.url = v.url AND r.blacklisted)) u
  JOIN pvx ON u.url = pvx.url GROUP BY u.username, d) GROUP BY username),
unn AS (SELECT * FROM (
  SELECT a.username AS ua, b.username AS ub, round(sqrt(""" + _sqd("a.feats", "b.feats") + """), 9) AS distance
  FROM uvec a JOIN uvec b ON a.username <> b.username)
  QUALIFY row_number() OVER (PARTITION BY ua ORDER BY distance, ub) <= 3)
SELECT ua AS username, rk.url, round(sum(rk.score / (1.0 + distance)), 6) AS score
FROM unn JOIN rk ON rk.username = unn.ub GROUP BY ua, rk.url""")

# --- 2.11 / 2.13 context datasets -----------------------------------------------------------

sql("context_dataset", f"""{V}
SELECT username, view_id, lat, lon, duration, daytime, cast(floor(daytime / 4) AS int) AS day_part, weekday FROM views""")

sql("similarity_docs_context", with_ctes(_EVENTS, _VIEWS, _LOC, _CTXRAW, _CTX_PTS) + """,
cp AS (SELECT concat(grp, ' ', key) AS id, grp, feats FROM ctx_pts),
cd AS (SELECT a.id AS id_a, b.id AS id_b, round(sqrt(""" + _sqd("a.feats", "b.feats") + """), 9) AS distance
       FROM cp a JOIN cp b ON a.grp = b.grp AND a.id <> b.id)
SELECT id_a, id_b, round(distance, 6) AS distance, cast(rank AS int) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS rank FROM cd) WHERE rank <= 5""")

# --- 2.16 evaluation ---------------------------------------------------------------------------

_EST = _LABEL + f""",
ds AS (SELECT DISTINCT username, url FROM views WHERE feedback IS NOT NULL AND feedback <> 'none' AND {_ELIG}),
ev AS (SELECT v.* FROM views v JOIN ds ON v.username = ds.username AND v.url = ds.url),
eu AS (SELECT username, url, count(*) AS n, avg(duration) AS d, sum(duration) AS sd FROM ev GROUP BY username, url),
ea AS (SELECT username, avg(n) AS an, sum(sd) / sum(n) AS ad FROM eu GROUP BY username),
est AS (SELECT eu.username, eu.url,
               cast(CASE WHEN n > an THEN 1 ELSE 0 END + CASE WHEN n > 3 * an THEN 1 ELSE 0 END
                    + CASE WHEN d > ad THEN 1 ELSE 0 END + CASE WHEN d > 3 * ad THEN 2 ELSE 0 END AS double) AS estimated
        FROM eu JOIN ea ON eu.username = ea.username),
pairs AS (SELECT est.username, est.url, estimated, cast(label AS double) AS actual
          FROM est JOIN lab ON est.username = lab.username AND est.url = lab.url)"""

_EST_BASE = with_ctes(_EVENTS, _VIEWS, _RESOURCES, _EST)
sql("eval_estimator", _EST_BASE + """
SELECT username, count(*) AS n, round(avg(abs(estimated - actual)), 6) AS mae,
       round(sqrt(sum((estimated - actual) * (estimated - actual))) / count(*), 6) AS rmse_ref,
       round(sqrt(avg((estimated - actual) * (estimated - actual))), 6) AS rmse
FROM pairs GROUP BY username""")
sql("mae", _EST_BASE + " SELECT count(*) AS n, round(avg(abs(estimated - actual)), 6) AS mae FROM pairs")
sql("rmse", _EST_BASE + """
SELECT count(*) AS n, round(sqrt(sum((estimated - actual) * (estimated - actual))) / count(*), 6) AS rmse_ref,
       round(sqrt(avg((estimated - actual) * (estimated - actual))), 6) AS rmse FROM pairs""")

# --- 2.12 sweeps -----------------------------------------------------------------------------

_SWEEP = []
_SWEEP_SEL = []
for _k in (5, 10, 20, 50):
    _c, _out = kmeans_ctes("emb_pts", _k, LLOYD_ROUNDS, f"sw{_k}")
    _SWEEP.append(_c)
    _SWEEP_SEL.append(f"SELECT {_k} AS k, grp AS label, cluster, count(*) AS n FROM {_out} GROUP BY grp, cluster")
sql("sweep_kmeans", with_ctes(_EMB_PTS, *_SWEEP) + " " + " UNION ALL ".join(_SWEEP_SEL))

# --- 2.17 streaming: equal to their batch forms ----------------------------------------------

ORACLE["stream_ingest_events"] = ORACLE["ingest_event"]
ORACLE["stream_events_to_views"] = ORACLE["events_to_views"]

# --- 2.12 bandwidth: m-th nearest distance, all pairs per label (oracle only) ---------------

_BW_PAIRS = """
bp AS (SELECT label, cast(vec_id AS varchar) AS id, cast(embedding AS double[]) AS feats FROM embeddings),
bn AS (SELECT label, count(*) AS n FROM bp GROUP BY label),
bd AS (SELECT a.label, a.id, sqrt(""" + _sqd("a.feats", "b.feats") + """) AS d,
              row_number() OVER (PARTITION BY a.id ORDER BY sqrt(""" + _sqd("a.feats", "b.feats") + """)) AS r
       FROM bp a JOIN bp b ON a.label = b.label)"""

sql("estimate_bandwidth", with_ctes(_BW_PAIRS) + " " + " UNION ALL ".join(
    f"""SELECT bd.label, {q} AS quantile, round(avg(d), 6) AS bandwidth FROM bd JOIN bn ON bd.label = bn.label
        WHERE r = greatest(1, cast(floor(n * {q}) AS bigint)) GROUP BY bd.label"""
    for q in (0.1, 0.3, 0.5, 0.7, 0.9)))

# --- 2.18 extras -----------------------------------------------------------------------------

sql("tab_tree", "WITH RECURSIVE " + ",".join([_EVENTS, _TABS, """
nodes AS (SELECT DISTINCT tab_id FROM b_events),
w(tab_id, root, depth) AS (
  SELECT n.tab_id, n.tab_id, 0 FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM tabs e WHERE e.tab_id = n.tab_id)
  UNION ALL
  SELECT e.tab_id, w.root, w.depth + 1 FROM tabs e JOIN w ON e.parent_id = w.tab_id)"""])
    + " SELECT tab_id, root, depth FROM w")

sql("purge_user", with_ctes(_EVENTS, _VIEWS, _TABS) + " " + " UNION ALL ".join([
    _collection("events", "event_id", "b_events WHERE username <> 'u1'"), _collection("tabs", "tab_id", "tabs WHERE username <> 'u1'"),
    _collection("users", "username", "(SELECT DISTINCT username FROM b_events WHERE username <> 'u1')"),
    _collection("views", "view_id", "views WHERE username <> 'u1'")]))

sql("export_user", f"{V} SELECT {VIEW_COLS} FROM views WHERE username = 'u1'")

_SW = {
    "en": "the and of to in is that it for was with on as are this be at by not from",
    "fr": "le la les et des est un une du dans que qui pour pas sur au avec ce il sont",
    "de": "der die und das ist den nicht mit von ein eine zu sich auf für dem des im auch es",
    "es": "el la de que y los las en un una es por con para del se no al lo como",
}
_SW_ROWS = ", ".join(f"('{lang}', '{w}', {i + 1})" for i, lang in enumerate(["en", "fr", "de", "es"])
                     for w in _SW[lang].split())
sql("detect_language", f"""
WITH sw(lang, term, ord) AS (VALUES {_SW_ROWS}),
tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM documents),
hits AS (SELECT doc_id, lang, min(ord) AS ord, count(*) AS hits FROM tk JOIN sw ON tk.term = sw.term GROUP BY doc_id, lang),
best AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord) AS r FROM hits)
         WHERE r = 1)
SELECT d.doc_id, coalesce(b.lang, 'unknown') AS detected, d.lang FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id""")

# --- 2.18 other similarity measures (k best, all pairs in the oracle only) ------------------

_EMB_L1 = """
ep AS (SELECT cast(vec_id AS varchar) AS id, cast(embedding AS double[]) AS feats FROM embeddings),
ed AS (SELECT a.id AS id_a, b.id AS id_b,
              round(list_sum(list_transform(range(1, len(a.feats) + 1), lambda i: abs(a.feats[i] - b.feats[i]))), 9) AS distance
       FROM ep a JOIN ep b ON a.id <> b.id)"""
sql("manhattan_distance", with_ctes(_EMB_L1) + """
SELECT id_a, id_b, round(distance, 6) AS distance, cast(rank AS int) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS rank FROM ed) WHERE rank <= 5""")

_EMB_R = """
ep AS (SELECT cast(vec_id AS varchar) AS id, cast(embedding AS double[]) AS feats FROM embeddings),
ec AS (SELECT id, list_transform(feats, lambda x: x - list_avg(feats)) AS c FROM ep),
en AS (SELECT id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM ec),
ed AS (SELECT a.id AS id_a, b.id AS id_b,
              round(1.0 - list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * b.c[i])) / (a.norm * b.norm), 9) AS distance
       FROM en a JOIN en b ON a.id <> b.id)"""
sql("pearson_similarity", with_ctes(_EMB_R) + """
SELECT id_a, id_b, round(1.0 - distance, 6) AS correlation, cast(rank AS int) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS rank FROM ed) WHERE rank <= 5""")

# --- 2.14 learned ranks: every user's linear SVM, round by round ---------------------------------

_SVM_D = 7


def _dot(a: str, b: str) -> str:
    return " + ".join(f"{a}[{j + 1}] * {b}[{j + 1}]" for j in range(_SVM_D))


def learned_ctes(views: str = "views", train: str = "true", test: str = "label IS NULL", rounds: int = 10) -> str:
    """CTEs up to ``learned`` (username, url, score). ``train`` and ``test`` are
    conditions on the rows (username, url, label) fitted and predicted."""
    n, cells = _SVM_D, [(i, j) for i in range(_SVM_D) for j in range(_SVM_D)]
    raw = ["lat", "lon", "duration", "daytime", "day_part", "weekday"]
    scaled = ", ".join(f"CASE WHEN s_{c} > 1e-9 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END" for c in raw)
    seven = lambda of: "[" + ", ".join(of(j + 1) for j in range(n)) + "]"
    step = f"""SELECT w.it, w.username, w.label, any_value(w.v) AS v, any_value(w.z) AS z, any_value(w.f) AS f, sum(gap * gap) AS q,
      {seven(lambda j: f"sum(gap * y * x[{j}])")} AS s,
      [{", ".join(f"{float(i == j)} + 2 * sum(CASE WHEN gap > 0 THEN x[{i + 1}] * x[{j + 1}] ELSE 0.0 END)" for i, j in cells)}] AS a
      FROM (SELECT w.*, d.x, CASE WHEN d.label = w.label THEN 1.0 ELSE -1.0 END AS y,
                   greatest(1.0 - y * ({_dot("w.z", "d.x")}), 0.0) AS gap
            FROM wts w JOIN lfit d ON d.username = w.username WHERE w.it < {rounds}) w
      GROUP BY w.it, w.username, w.label"""
    for k in range(n):
        pivot = ", ".join(
            f"1.0 / a[{k * n + k + 1}]" if i == j == k else f"a[{i * n + j + 1}] / a[{k * n + k + 1}]" if i == k else
            f"-a[{i * n + j + 1}] / a[{k * n + k + 1}]" if j == k else
            f"a[{i * n + j + 1}] - a[{i * n + k + 1}] * a[{k * n + j + 1}] / a[{k * n + k + 1}]" for i, j in cells)
        step = f"SELECT it, username, label, v, z, f, q, s, [{pivot}] AS a FROM ({step})"
    newton = ", ".join("z[{0}] - ({1})".format(i + 1, " + ".join(
        f"a[{i * n + j + 1}] * (z[{j + 1}] - 2 * s[{j + 1}])" for j in range(n))) for i in range(n))
    eligible = "url IN (SELECT url FROM resources WHERE NOT blacklisted AND processed)"
    return f"""
lrk AS (SELECT DISTINCT username, url FROM {views} WHERE feedback IS NOT NULL AND feedback <> 'none' AND {eligible}),
lun AS (SELECT DISTINCT username, url FROM {views} WHERE feedback = 'none' AND {eligible} EXCEPT SELECT username, url FROM lrk),
lit AS (SELECT username, url, true AS rated FROM lrk WHERE username IN (SELECT username FROM lun)
        UNION ALL SELECT username, url, false FROM lun WHERE username IN (SELECT username FROM lrk)),
lfv AS (SELECT v.*, floor(daytime / 4) AS day_part FROM {views} v JOIN lit USING (username, url)
        QUALIFY row_number() OVER (PARTITION BY username, url ORDER BY ts_ms, view_id) = 1),
lst AS (SELECT username, {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in raw)} FROM lfv GROUP BY username),
llb AS (SELECT username, url, cast(feedback AS int) AS label FROM {views} WHERE feedback IS NOT NULL AND feedback <> 'none'
        QUALIFY row_number() OVER (PARTITION BY username, url ORDER BY ts_ms, view_id) = 1),
ldt AS (SELECT f.username, f.url, CASE WHEN rated THEN label END AS label, [{scaled}, 1.0] AS x
        FROM lfv f JOIN lst USING (username) JOIN lit USING (username, url) LEFT JOIN llb USING (username, url)),
lfit AS MATERIALIZED (SELECT * FROM ldt WHERE label IS NOT NULL AND {train}),
wts AS (
  SELECT 0 AS it, username, label, {seven(lambda j: "0.0::DOUBLE")} AS v, {seven(lambda j: "0.0::DOUBLE")} AS z, 'inf'::DOUBLE AS f
  FROM (SELECT DISTINCT username, label FROM lfit)
  UNION ALL
  SELECT it + 1, username, label, CASE WHEN fz <= f THEN z ELSE v END,
         CASE WHEN fz <= f THEN [{newton}] ELSE {seven(lambda j: f"0.5 * (v[{j}] + z[{j}])")} END, least(fz, f)
  FROM (SELECT *, 0.5 * ({_dot("z", "z")}) + q AS fz FROM ({step}))),
learned AS (SELECT username, url, cast(label AS double) AS score
  FROM (SELECT d.username, d.url, w.label, round({_dot("w.v", "d.x")}, 6) AS s
        FROM ldt d JOIN wts w ON w.username = d.username AND w.it = {rounds}
        WHERE (d.username, d.url) IN (SELECT (username, url) FROM ldt WHERE {test}))
  QUALIFY row_number() OVER (PARTITION BY username, url ORDER BY s DESC, label) = 1)"""


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


sql("rank_learned", _recursive(_EVENTS, _VIEWS, _RESOURCES, learned_ctes()) +
    " SELECT username, url, score, 'learned' AS source FROM learned")

_RANKS = """,
ranks AS (SELECT username, url, score, 'explicit' AS source FROM expl
  UNION ALL SELECT username, url, score, 'learned' FROM learned
  UNION ALL SELECT username, url, cast(score AS double), 'heuristic' FROM heur h
  WHERE username NOT IN (SELECT username FROM learned)
    AND NOT EXISTS (SELECT 1 FROM expl e WHERE e.username = h.username AND e.url = h.url))"""

sql("rankings", _recursive(_EVENTS, _VIEWS, _RESOURCES, _HEUR, _EXPL, learned_ctes()) + _RANKS +
    " SELECT username, url, score, source FROM ranks")

_HALVES = f"""
rd AS (SELECT DISTINCT username, url FROM views WHERE feedback IS NOT NULL AND feedback <> 'none' AND {_ELIG}),
hv AS (SELECT username, url, CASE WHEN row_number() OVER (PARTITION BY username ORDER BY url) - 1
         < floor(count(*) OVER (PARTITION BY username) / 2) THEN 0 ELSE 1 END AS half FROM rd),
hidden AS (SELECT v.* REPLACE (CASE WHEN hv.half = 1 THEN 'none' ELSE feedback END AS feedback)
           FROM views v LEFT JOIN hv USING (username, url))"""

sql("eval_classifier", _recursive(_EVENTS, _VIEWS, _RESOURCES, _HALVES, learned_ctes(
    "hidden", "(username, url) IN (SELECT (username, url) FROM hv WHERE half = 0)",
    "(username, url) IN (SELECT (username, url) FROM hv WHERE half = 1)"), _LABEL) + """,
pairs AS (SELECT l.username, l.score AS estimated, cast(lab.label AS double) AS actual
          FROM learned l JOIN lab ON lab.username = l.username AND lab.url = l.url)
SELECT username, count(*) AS n, round(avg(abs(estimated - actual)), 6) AS mae,
       round(sqrt(sum((estimated - actual) * (estimated - actual))) / count(*), 6) AS rmse_ref,
       round(sqrt(avg((estimated - actual) * (estimated - actual))), 6) AS rmse
FROM pairs GROUP BY username""")

# --- 2.12 affinity propagation, unrolled -----------------------------------------------------------


def affinity_ctes(points: str, rounds: int = 30) -> str:
    """CTEs up to ``ap_out`` (grp, key, exemplar) over ``points`` (grp, key, feats)."""
    ctes = [f"""
ap_d AS (SELECT a.grp, cast(a.key AS varchar) AS i, cast(b.key AS varchar) AS k, round(sqrt({_sqd('a.feats', 'b.feats')}), 9) AS d
  FROM {points} a JOIN {points} b ON a.grp = b.grp),
ap_n AS MATERIALIZED (SELECT grp, i, k, -d * d AS s FROM ap_d WHERE i <> k),
ap_p AS (SELECT grp, s AS p FROM ap_n
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY s) = cast(ceil(0.5 * count(*) OVER (PARTITION BY grp)) AS bigint)),
ap_0 AS MATERIALIZED (SELECT grp, i, k, s, 0.0::DOUBLE AS r, 0.0::DOUBLE AS a FROM ap_n
  UNION ALL SELECT e.grp, cast(key AS varchar), cast(key AS varchar), coalesce(p, 0.0), 0.0, 0.0 FROM {points} e LEFT JOIN ap_p ON ap_p.grp = e.grp)"""]
    for t in range(rounds):
        ctes.append(f"""
ap_r{t} AS MATERIALIZED (SELECT grp, i, k, s, a, 0.5 * r + 0.5 * (s - CASE WHEN a + s = b[1] THEN coalesce(b[2], s - 1.0) ELSE b[1] END) AS r
  FROM ap_{t} JOIN (SELECT i, max(a + s, 2) AS b FROM ap_{t} GROUP BY i) u USING (i)),
ap_{t + 1} AS MATERIALIZED (SELECT grp, i, e.k, s, r, 0.5 * a + 0.5 * CASE WHEN i = e.k THEN t ELSE least(0.0, own + t - greatest(r, 0.0)) END AS a
  FROM ap_r{t} e JOIN (SELECT k, sum(CASE WHEN i <> k THEN greatest(r, 0.0) ELSE 0.0 END) AS t, max(CASE WHEN i = k THEN r END) AS own
                     FROM ap_r{t} GROUP BY k) u ON u.k = e.k)""")
    ctes.append(f"""
ap_e AS (SELECT grp, k AS id, round(r + a, 9) AS e FROM ap_{rounds} WHERE i = k),
ap_x AS (SELECT grp, id FROM ap_e WHERE e > 0 UNION
         (SELECT grp, id FROM ap_e QUALIFY row_number() OVER (PARTITION BY grp ORDER BY e DESC, id) = 1)),
ap_out AS (SELECT e.grp, e.key, x.id AS exemplar FROM {points} e JOIN ap_x x ON x.grp = e.grp
           JOIN ap_d d ON d.i = cast(e.key AS varchar) AND d.k = x.id
           QUALIFY row_number() OVER (PARTITION BY e.key ORDER BY d, x.id) = 1)""")
    return ",".join(ctes)


sql("affinity_propagation", with_ctes(_EMB_PTS, affinity_ctes("emb_pts")) +
    " SELECT grp AS label, key AS vec_id, exemplar FROM ap_out")

# --- 2.12 mean shift, round by round -----------------------------------------------------------------


def meanshift_ctes(prefix: str, quantile: float, dims: int = 64, rounds: int = 50) -> str:
    """CTEs up to ``<prefix>_out`` (label, key, cluster, converged) over ``emb_pts``
    and the ranked distances ``bd``, ``bn``: every point a seed, kept centers in
    order of their counts, points to the nearest kept center."""
    p = prefix
    mean = ", ".join(f"avg(e.feats[{j + 1}])" for j in range(dims))
    return f"""
{p}_bw AS MATERIALIZED (SELECT bd.label, avg(d) AS bw FROM bd JOIN bn ON bd.label = bn.label
  WHERE r = greatest(1, cast(floor(n * {quantile}) AS bigint)) GROUP BY bd.label),
{p}_s AS (
  SELECT 0 AS it, e.grp, e.key, e.feats AS c, 0::BIGINT AS cnt, false AS done, b.bw FROM emb_pts e JOIN {p}_bw b ON b.label = e.grp
  UNION ALL
  SELECT it + 1, grp, key, nc, n, sqrt({_sqd('nc', 'c')}) < 1e-3 * bw, bw
  FROM (SELECT s.it, s.grp, s.key, s.bw, any_value(s.c) AS c, count(*) AS n, [{mean}] AS nc
        FROM {p}_s s JOIN emb_pts e ON e.grp = s.grp AND sqrt({_sqd('e.feats', 's.c')}) <= s.bw
        WHERE NOT s.done AND s.it < {rounds} GROUP BY s.it, s.grp, s.key, s.bw)),
{p}_c AS MATERIALIZED (SELECT grp, key, c, cnt, done, bw,
    row_number() OVER (PARTITION BY grp ORDER BY cnt DESC, list_transform(c, lambda x: -x), cast(key AS varchar)) AS pos
  FROM (SELECT * FROM {p}_s QUALIFY row_number() OVER (PARTITION BY grp, key ORDER BY it DESC) = 1)),
{p}_k AS (
  SELECT grp, 1::BIGINT AS pos, [c] AS kept FROM {p}_c WHERE pos = 1
  UNION ALL
  SELECT k.grp, n.pos, CASE WHEN len(list_filter(k.kept, lambda h: sqrt({_sqd('h', 'n.c')}) <= n.bw)) = 0
                            THEN list_append(k.kept, n.c) ELSE k.kept END
  FROM {p}_k k JOIN {p}_c n ON n.grp = k.grp AND n.pos = k.pos + 1),
{p}_h AS (SELECT grp, unnest(kept) AS c, generate_subscripts(kept, 1) - 1 AS cluster
  FROM (SELECT * FROM {p}_k QUALIFY row_number() OVER (PARTITION BY grp ORDER BY pos DESC) = 1)),
{p}_out AS (SELECT e.grp AS label, e.key, cast(h.cluster AS int) AS cluster, m.done AS converged
  FROM emb_pts e JOIN {p}_h h ON h.grp = e.grp JOIN {p}_c m ON m.grp = e.grp AND m.key = e.key
  QUALIFY row_number() OVER (PARTITION BY e.grp, e.key ORDER BY round(sqrt({_sqd('e.feats', 'h.c')}), 9), h.cluster) = 1)"""


sql("meanshift", _recursive(_EMB_PTS, _BW_PAIRS, meanshift_ctes("ms", 0.3)) +
    " SELECT label, key AS vec_id, cluster, converged FROM ms_out")
sql("sweep_meanshift", _recursive(_EMB_PTS, _BW_PAIRS, *[meanshift_ctes(f"m{int(q * 10)}", q) for q in (0.1, 0.3, 0.5, 0.7, 0.9)]) + " " +
    " UNION ALL ".join(f"SELECT {q} AS quantile, label, cluster, count(*) AS n FROM m{int(q * 10)}_out GROUP BY label, cluster"
                       for q in (0.1, 0.3, 0.5, 0.7, 0.9)))

ORACLE["persist_features"] = ORACLE["context_features"]  # what is reloaded equals what is computed
