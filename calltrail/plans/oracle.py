"""DuckDB SQL for each catalogue query (the correctness oracle).

Each text runs on DuckDB with the driver tables registered as views.  The
trace view is inlined as the CTE ``trace``; params / stack stay JSON text.
"""

from __future__ import annotations

from calltrail.functions.render import LOG_TAGS
from calltrail.traceview import duck_trace_sql

APP = "com.example.app1"
CURSOR_TS = 1705276800000
DAY_3 = 1704240000000
DAY_25 = 1706140800000
ERASE_USER = "user-8"


def q(body: str, ctes: str = "") -> str:
    return f"WITH trace AS ({duck_trace_sql()}){ctes}\n{body}"


def dur(x: str) -> str:
    return (f"CASE WHEN {x} >= 60000 THEN CAST({x} // 60000 AS VARCHAR) || 'm ' || "
            f"CAST(({x} % 60000) // 1000 AS VARCHAR) || 's' "
            f"WHEN {x} >= 1000 THEN CAST({x} // 1000 AS VARCHAR) || 's ' || CAST({x} % 1000 AS VARCHAR) || 'ms' "
            f"ELSE CAST({x} AS VARCHAR) || 'ms' END")


def jget(j: str, k: str) -> str:
    return f"json_extract_string({j}, '$.\"' || {k} || '\"')"


ENTER_DETAIL = ("coalesce(array_to_string(list_transform(json_keys(params), lambda x: x || ': ' || "
                + jget("params", "x") + "), '  '), '')")
DETAIL = f"""CASE type
  WHEN 'ENTER' THEN {ENTER_DETAIL}
  WHEN 'EXIT' THEN coalesce('result: ' || result || '  ', '') || coalesce('[' || {dur('duration_ms')} || ']', '')
  WHEN 'CATCH' THEN coalesce(exception, '') || coalesce(': ' || message, '') ||
    coalesce('  (try: line ' || CAST(try_start_line AS VARCHAR) || ' -> catch: line ' || CAST(line AS VARCHAR) || ')', '')
  WHEN 'BRANCH' THEN CASE WHEN coalesce(condition_result, false) THEN 'TRUE -- entered if block'
    ELSE 'FALSE -- entered else block' END END"""

EXTRA_JSON = ("'{' || array_to_string(list_concat("
              "coalesce(list_transform(json_keys(params), lambda x: to_json(x) || ':' || to_json(" + jget("params", "x") + ")), []),"
              "list_filter([CASE WHEN result IS NOT NULL THEN '\"result\":' || to_json(result) END,"
              " CASE WHEN duration_ms IS NOT NULL THEN '\"durationMs\":' || to_json(CAST(duration_ms AS VARCHAR)) END,"
              " CASE WHEN exception IS NOT NULL THEN '\"exception\":' || to_json(exception) END,"
              " CASE WHEN message IS NOT NULL THEN '\"message\":' || to_json(message) END,"
              " CASE WHEN try_start_line IS NOT NULL THEN '\"tryStartLine\":' || to_json(CAST(try_start_line AS VARCHAR)) END,"
              " CASE WHEN condition_result IS NOT NULL THEN '\"conditionResult\":' || to_json(CAST(condition_result AS VARCHAR)) END],"
              " lambda e: e IS NOT NULL)), ',') || '}'")

DEVICE_LABEL = """CASE WHEN tag <> '' AND device_model <> '' THEN device_model || ' (' || tag || ')'
  WHEN tag <> '' THEN tag WHEN device_model <> '' THEN device_model ELSE '' END"""
DEVICE_GROUP = f"CASE WHEN ({DEVICE_LABEL}) = '' THEN '(unknown)' ELSE ({DEVICE_LABEL}) END"
PLATFORM_LABEL = """CASE WHEN platform IS NULL OR platform = '' THEN '' WHEN platform = 'android-jvm' THEN 'Android'
  WHEN platform = 'react-native' THEN 'RN' WHEN platform = 'ios-swift' THEN 'iOS' WHEN platform = 'web-js' THEN 'Web'
  ELSE platform END"""
COMPONENT = "CASE WHEN ends_with(class_name, 'Activity') THEN 'ACTIVITY' WHEN ends_with(class_name, 'Fragment') THEN 'FRAGMENT' ELSE 'OTHER' END"


def trunc(x: str, n: int = 200) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"


MASK_RULES = [
    (r"(?i)(password|passwd|token|jwt|api[_-]?key|secret|cvv|ssn|pin|auth)\s*([=:])\s*\S+", r"\1\2***"),
    (r"(?i)(authorization|bearer)\s+=[A-Za-z0-9._~+/=-]*", r"\1=***"),
    (r"(?i)(authorization|bearer)(\s+)[A-Za-z0-9._~+/-][A-Za-z0-9._~+/=-]*", r"\1\2***"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "***"),
]


def mask(x: str) -> str:
    out = x
    for pat, rep in MASK_RULES:
        out = f"regexp_replace({out}, '{pat}', '{rep}', 'g')"
    return out


def masked_params(hit: str) -> str:
    return ("'{' || array_to_string(list_transform(json_keys(params), lambda x: to_json(x) || ':' || "
            f"to_json(CASE WHEN {hit} THEN '***' ELSE " + jget("params", "x") + " END)), ',') || '}'")


WORDS = ["password", "token", "pin", "secret", "cvv", "ssn"]
KEY_RX = "(?i)(?:(?:password)|(?:token)|(?:jwt)|(?:api[_-]?key)|(?:secret)|(?:cvv)|(?:ssn)|(?:pin)|(?:creditcard))"

RAW_CLASS = """'com/example/' || class_name || CASE WHEN method = 'onCreate' THEN '$1'
  WHEN method = 'reduce' THEN '$$Lambda$' || CAST(line AS VARCHAR) ELSE '$' || method END"""
RAW_METHOD = """CASE WHEN class_name = 'LoginViewModel' THEN 'get' || upper(substr(method, 1, 1)) || substr(method, 2)
  WHEN class_name = 'CheckoutActivity' THEN 'set' || upper(substr(method, 1, 1)) || substr(method, 2)
  WHEN class_name = 'CartFragment' THEN '<init>' WHEN class_name = 'AuthRepository' THEN 'invokeSuspend' ELSE method END"""

ORACLE: dict[str, str] = {}

ORACLE["page"] = q("""
SELECT seq, ts, type, class_name, method, app_id, detail, CAST(page_pos AS INTEGER) AS page_pos,
  CASE WHEN n > 100 THEN max(CASE WHEN page_pos = 100 THEN ts END) OVER () END AS next_cursor
FROM r WHERE page_pos <= 100""", f""",
p AS (SELECT *, {DETAIL} AS detail FROM trace WHERE ts > 0 AND app_id = '{APP}' AND type = 'CATCH'
      ORDER BY ts, seq LIMIT 101),
r AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS page_pos, count(*) OVER () AS n FROM p)""")

ORACLE["after_cursor"] = q(f"SELECT seq, ts, type FROM trace WHERE ts > {CURSOR_TS} OR (ts = {CURSOR_TS} AND seq > 0)")

ORACLE["viewer_filter"] = q(f"""
SELECT seq, type, class_name, method, tag FROM trace
WHERE type IN ('ENTER', 'CATCH') AND regexp_matches(class_name, '(?i)cart')
  AND regexp_matches(method, '(?i)LOAD|reduce') AND device_manufacturer = 'google'
  AND contains(lower(tag), 'qa-team') AND ts >= {DAY_3} AND ts <= {DAY_25}""")

NOISE = ["HiltComponents", "Hilt_", "_HiltModules", "hilt_aggregated_deps", "Dagger", "dagger.",
         "_MembersInjector", "_Factory", "_Impl", "_GeneratedInjector", "databinding.", "BR.", "Repository"]
ORACLE["noise_filter"] = q(
    "SELECT seq, class_name, method FROM trace WHERE NOT ("
    + " OR ".join(f"contains(class_name, '{f}')" for f in NOISE)
    + " OR method = '<clinit>' OR contains(method, '$$') OR starts_with(method, 'access$')"
    + " OR ends_with(method, '$default') OR (length(method) > 3 AND (starts_with(method, 'get') OR"
    + " starts_with(method, 'set')) AND regexp_matches(substr(method, 4, 1), '^\\p{Lu}$')))")

ORACLE["file_exclude"] = q(r"""SELECT seq, file FROM trace WHERE NOT (coalesce(file, '') = ''
  OR contains(file, chr(0)) OR contains(file, '/node_modules/') OR regexp_matches(file, 'Fragment\.kt$'))""")

ORACLE["flat_table"] = q(f"""
SELECT seq, strftime(epoch_ms(ts), '%Y-%m-%d') AS date, strftime(epoch_ms(ts), '%H:%M:%S.%g') AS time,
  type, class_name, method, file || ':' || CAST(line AS VARCHAR) AS file_line,
  {PLATFORM_LABEL} AS platform_label, coalesce(app_id, '') AS app, coalesce(user_id, '') AS user,
  device_manufacturer AS manufacturer, device_model AS device, tag, {DETAIL} AS detail,
  {dur('duration_ms')} AS duration_text, {DEVICE_LABEL} AS device_label,
  duration_ms > 100000000000 AS epoch_duration
FROM trace""")

ORACLE["detail_text"] = q(f"SELECT seq, type, {DETAIL} AS detail, {EXTRA_JSON} AS extra FROM trace")

LOG_LINE = f"""CASE type
  WHEN 'ENTER' THEN '[' || class_name || '] ' || method || '()  src:' || file || ':' || CAST(line AS VARCHAR) ||
    CASE WHEN params IS NOT NULL THEN chr(10) || '  ' || array_to_string(list_transform(json_keys(params),
      lambda x: x || ': ' || {jget('params', 'x')}), chr(10) || '  ') ELSE '' END
  WHEN 'EXIT' THEN '[' || class_name || '] ' || method || '  [' || {dur('coalesce(duration_ms, 0)')} || ']  src:' ||
    file || ':' || CAST(line AS VARCHAR) || coalesce(chr(10) || '  result: ' || result, '')
  WHEN 'CATCH' THEN '[' || class_name || '] ' || method || '  src:' || file || ':' || CAST(line AS VARCHAR) ||
    chr(10) || '  try started: line ' || coalesce(CAST(try_start_line AS VARCHAR), '0') || ' -> catch: line ' ||
    CAST(line AS VARCHAR) || chr(10) || '  ' || coalesce(exception, 'Exception') || ': ' || coalesce(message, '-')
  WHEN 'BRANCH' THEN '[' || class_name || '] ' || method || '  src:' || file || ':' || CAST(line AS VARCHAR) ||
    chr(10) || '  condition -> ' || CASE WHEN coalesce(condition_result, false) THEN 'TRUE -- entered if block'
    ELSE 'FALSE -- entered else block' END END"""
LOG_TAG_SQL = "CASE type " + " ".join(f"WHEN '{t}' THEN '{tag}'" for t, tag in LOG_TAGS.items()) + " END"
ORACLE["log_lines"] = q(f"""SELECT seq, {LOG_TAG_SQL} AS log_tag, {LOG_LINE} AS log_line FROM trace""")

ORACLE["component_class"] = q(f"""SELECT class_name, {COMPONENT} AS component, CAST(count(*) AS BIGINT) AS events
FROM trace GROUP BY class_name""")

ORACLE["class_names"] = q(r"""
SELECT seq, raw, CASE WHEN s = '' THEN simple ELSE s END AS clean FROM (
  SELECT seq, raw, simple, regexp_replace(replace(regexp_replace(regexp_replace(simple, '\$\$[^$]*', '', 'g'),
    '\$\d+', '', 'g'), '$', '.'), '^\.+|\.+$', '', 'g') AS s
  FROM (SELECT seq, raw, regexp_extract(raw, '([^/]*)$', 1) AS simple FROM (SELECT seq, """ + RAW_CLASS + """ AS raw FROM trace)))""")

ORACLE["method_names"] = q(r"""
SELECT seq, raw, CASE WHEN raw = '<init>' THEN 'init'
  WHEN starts_with(raw, 'get') AND length(raw) > 3 AND regexp_matches(substr(raw, 4, 1), '^\p{Lu}$')
    THEN lower(substr(raw, 4, 1)) || substr(raw, 5)
  WHEN starts_with(raw, 'set') AND length(raw) > 3 AND regexp_matches(substr(raw, 4, 1), '^\p{Lu}$')
    THEN lower(substr(raw, 4, 1)) || substr(raw, 5) || '='
  WHEN raw = 'invokeSuspend' THEN '{coroutine}' ELSE raw END AS clean
FROM (SELECT seq, """ + RAW_METHOD + " AS raw FROM trace)")

ORACLE["mask_params_words"] = q(
    "SELECT seq, " + masked_params("(" + " OR ".join(f"contains(lower(x), '{w}')" for w in WORDS) + ")")
    + " AS params FROM trace WHERE params IS NOT NULL")
ORACLE["mask_params_regex"] = q(
    "SELECT seq, " + masked_params(f"regexp_matches(x, '{KEY_RX}')") + " AS params FROM trace WHERE params IS NOT NULL")

ORACLE["mask_text"] = q(f"""SELECT seq, {mask('message')} AS message, {mask('result')} AS result,
  array_to_string(list_transform(from_json(stack, '["VARCHAR"]'), lambda s: {mask('s')}), chr(10)) AS stack FROM trace""")

ORACLE["truncate"] = q(f"SELECT seq, {trunc('result')} AS result_text, {trunc('d', 20)} AS detail_short "
                       f"FROM (SELECT *, {DETAIL} AS d FROM trace)")

ORACLE["stack_frames"] = q("""SELECT seq, array_to_string(fr, '|') AS frames, CAST(len(fr) AS INTEGER) AS n_frames FROM (
  SELECT seq, list_filter(list_transform(string_split('  ' || array_to_string(from_json(stack, '["VARCHAR"]'),
    ' ' || chr(10) || chr(10) || chr(9)) || chr(10), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
    lambda x: x <> '') AS fr FROM trace WHERE stack IS NOT NULL)""")

_V2_NULLS = ("CAST(NULL AS INTEGER) AS schema_version, CAST(NULL AS VARCHAR) AS platform, CAST(NULL AS VARCHAR) AS runtime, "
             "CAST(NULL AS VARCHAR) AS app_id, CAST(NULL AS VARCHAR) AS app_version, CAST(NULL AS VARCHAR) AS build_number, "
             "CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS device_id, CAST(NULL AS VARCHAR) AS session_id, "
             "CAST(NULL AS VARCHAR) AS stack, CAST(NULL AS VARCHAR) AS source_map_id, CAST(NULL AS VARCHAR) AS proguard_map_id, "
             "CAST(NULL AS BOOLEAN) AS is_minified")
ORACLE["conform"] = q(f"""SELECT seq, type, class_name, method, file, line, thread_id, thread_name, ts,
  device_manufacturer, device_model, tag, replace(params, ' ', '') AS params, result, duration_ms, exception, message,
  try_start_line, condition_result, {_V2_NULLS} FROM trace""")

ORACLE["length_check"] = q("""
SELECT seq, 'class_name' AS "column", CAST(length(class_name) AS INTEGER) AS length, 12 AS cap FROM trace WHERE length(class_name) > 12
UNION ALL SELECT seq, 'tag', CAST(length(tag) AS INTEGER), 8 FROM trace WHERE length(tag) > 8""")

ORACLE["total"] = q("SELECT CAST(count(*) AS BIGINT) AS total_events FROM trace")

ORACLE["stats"] = q(f"""
SELECT 'device' AS kind, {DEVICE_GROUP} AS key, CAST(count(*) AS BIGINT) AS events FROM trace GROUP BY 2
UNION ALL SELECT 'type', type, CAST(count(*) AS BIGINT) FROM trace GROUP BY 2
UNION ALL SELECT 'total', '', CAST(count(*) AS BIGINT) FROM trace""")

ORACLE["apps"] = q("""SELECT app_id, CAST(count(*) AS BIGINT) AS event_count, max(ts) AS last_seen,
  array_to_string(list_sort(list_distinct(list(platform) FILTER (WHERE platform IS NOT NULL))), ',') AS platforms
FROM trace WHERE app_id IS NOT NULL GROUP BY app_id""")

ORACLE["first_seen"] = q(f"""
SELECT 'device' AS kind, {DEVICE_LABEL} AS value, min(seq) AS first_seq FROM trace WHERE ({DEVICE_LABEL}) <> '' GROUP BY 2
UNION ALL SELECT 'manufacturer', device_manufacturer, min(seq) FROM trace WHERE coalesce(device_manufacturer, '') <> '' GROUP BY 2""")

ORACLE["batch_sources"] = q("""SELECT CAST(seq // 50 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS events,
  array_to_string(list_sort(list_distinct(list(CASE WHEN coalesce(tag, '') <> '' THEN tag ELSE device_model END))), ',') AS sources
FROM trace GROUP BY 1""")

ORACLE["method_rollup"] = q("""SELECT class_name || '.' || method AS name, CAST(count(*) AS BIGINT) AS events,
  CAST(count(*) FILTER (WHERE type = 'ENTER') AS BIGINT) AS enter, CAST(count(*) FILTER (WHERE type = 'EXIT') AS BIGINT) AS exit,
  CAST(count(*) FILTER (WHERE type = 'CATCH') AS BIGINT) AS catch, CAST(count(*) FILTER (WHERE type = 'BRANCH') AS BIGINT) AS branch
FROM trace GROUP BY 1""")

ORACLE["method_sequence"] = q("""SELECT class_name || '.' || method AS name,
  CAST(row_number() OVER (PARTITION BY class_name || '.' || method ORDER BY seq) AS BIGINT) AS pos, seq, type FROM trace""")

ORACLE["coverage"] = q("""
SELECT e.class_name, e.method, CAST(coalesce(p.events, 0) AS BIGINT) AS events, p.events IS NULL AS missing,
  coalesce(NOT p.has_enter, true) AS no_enter, coalesce(NOT p.has_exit, true) AS no_exit, coalesce(NOT p.has_catch, true) AS no_catch
FROM (SELECT DISTINCT class_name, unnest(['onCreate', 'reduce', 'load', 'onResume']) AS method FROM trace) e
LEFT JOIN (SELECT class_name, method, count(*) AS events, bool_or(type = 'ENTER') AS has_enter,
  bool_or(type = 'EXIT') AS has_exit, bool_or(type = 'CATCH') AS has_catch FROM trace GROUP BY 1, 2) p
ON e.class_name = p.class_name AND e.method = p.method""")

SCOPE_SQL = {
    "thread": "CAST(thread_id AS VARCHAR)",
    "class": "''",
    "manufacturer": "CASE WHEN coalesce(device_manufacturer, '') = '' THEN '(unknown)' ELSE device_manufacturer END",
    "device": DEVICE_GROUP,
}


def labelled(scope: str) -> str:
    """CTEs ``lab``: every row with scope, bal, floor, level, partner (the
    plain-window formulation, independent of the library's chunked one)."""
    return f""",
sc AS (SELECT *, {SCOPE_SQL[scope]} AS scope,
  CASE type WHEN 'ENTER' THEN 1 WHEN 'EXIT' THEN -1 ELSE 0 END AS d FROM trace),
b AS (SELECT *, sum(d) OVER (PARTITION BY scope, class_name, method ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bal FROM sc),
f AS (SELECT *, least(0, coalesce(min(bal) OVER (PARTITION BY scope, class_name, method ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fl FROM b),
o AS (SELECT *, type = 'EXIT' AND bal < fl AS orphan,
  CASE type WHEN 'ENTER' THEN bal - fl WHEN 'EXIT' THEN bal - fl + 1 END AS lvl FROM f),
m AS (SELECT *, CASE WHEN type IN ('ENTER', 'EXIT') THEN
  lead(seq) OVER (PARTITION BY scope, class_name, method, orphan, lvl, type IN ('ENTER', 'EXIT') ORDER BY seq) END AS nx,
  CASE WHEN type IN ('ENTER', 'EXIT') THEN
  lead(type) OVER (PARTITION BY scope, class_name, method, orphan, lvl, type IN ('ENTER', 'EXIT') ORDER BY seq) END AS nxt,
  CASE WHEN type IN ('ENTER', 'EXIT') THEN
  lead(coalesce(CAST(duration_ms AS VARCHAR), {jget('params', "'durationMs'")})) OVER (PARTITION BY scope, class_name, method, orphan, lvl,
    type IN ('ENTER', 'EXIT') ORDER BY seq) END AS nxdur FROM o),
lab AS (SELECT *, CASE WHEN type = 'ENTER' AND nxt = 'EXIT' AND NOT orphan THEN nx END AS exit_seq FROM m)"""


def pairs_sql(scope: str) -> str:
    return q("""SELECT scope, class_name, method, seq AS enter_seq, exit_seq, CAST(lvl AS BIGINT) AS depth
FROM lab WHERE type = 'ENTER'""", labelled(scope))


for _s in ("thread", "class", "manufacturer", "device"):
    ORACLE["call_pairs" + ("" if _s == "thread" else f"_{_s}")] = pairs_sql(_s)

ORACLE["open_calls"] = q("""SELECT scope, class_name, method, seq, CAST(lvl AS BIGINT) AS depth
FROM lab WHERE type = 'ENTER' AND exit_seq IS NULL""", labelled("thread"))
ORACLE["orphan_exits"] = q("SELECT scope, class_name, method, seq FROM lab WHERE orphan", labelled("thread"))

SCOPE_LABEL = {
    "thread": "'Thread: ' || arg_min(thread_name, seq) || ' [' || CAST(arg_min(thread_id, seq) AS VARCHAR) || ']'",
    "manufacturer": "'Manufacturer: ' || scope",
    "device": "'Device: ' || scope",
}


def tree_sql(scope: str, table: bool = False) -> str:
    top = -1 if scope == "class" else 0
    ev_extra = ""
    blank = ""
    if table:
        ev_extra = (f""", strftime(epoch_ms(ts), '%Y-%m-%d') AS date, strftime(epoch_ms(ts), '%H:%M:%S.%g') AS time,
  type AS type_, file || ':' || CAST(line AS VARCHAR) AS file_line, device_manufacturer AS manufacturer,
  device_model AS device, tag AS tag_, {DETAIL} AS detail, coalesce(exit_seq, pseq, seq) AS nav_seq""")
        blank = (", '' AS date, '' AS time, '' AS type_, '' AS file_line, '' AS manufacturer, '' AS device, "
                 "'' AS tag_, '' AS detail, CAST(NULL AS BIGINT) AS nav_seq")
    scope_rows = ""
    if scope != "class":
        scope_rows = f"""
UNION ALL SELECT scope, CAST(NULL AS VARCHAR) AS class_name, min(seq) AS sf, CAST(-1 AS BIGINT) AS cf, 0 AS level,
  0 AS depth, 'scope' AS kind, {SCOPE_LABEL[scope]} AS label, arg_min(ts, seq) AS start_ts, CAST(-1 AS BIGINT) AS seq{blank}
FROM lab GROUP BY scope"""
    body = f"""
SELECT e.scope, e.class_name, c.sf, c.cf, 2 AS level, {2 + top} AS depth,
  CASE WHEN type = 'ENTER' THEN 'call' ELSE 'leaf' END AS kind,
  CASE WHEN type = 'ENTER' THEN e.class_name || '.' || method || coalesce(' [' || nxdur_ok || 'ms]', '')
    ELSE type || ': ' || e.class_name || '.' || method END AS label, ts AS start_ts, seq{ev_extra}
FROM (SELECT *, CASE WHEN exit_seq IS NOT NULL THEN nxdur END AS nxdur_ok FROM ev) e
JOIN comps c ON e.scope = c.scope AND e.class_name = c.class_name
UNION ALL SELECT scope, class_name, sf, cf, 1, {1 + top}, 'component', {COMPONENT} || ': ' || class_name, start_ts,
  CAST(-1 AS BIGINT){blank} FROM comps{scope_rows}"""
    ctes = labelled(scope) + """,
pairs AS (SELECT exit_seq AS xs, seq AS pseq FROM lab WHERE exit_seq IS NOT NULL),
ev AS (SELECT * FROM lab LEFT JOIN pairs ON lab.seq = pairs.xs WHERE type <> 'EXIT' OR orphan),
scopes AS (SELECT scope, min(seq) AS sf FROM lab GROUP BY scope),
comps AS (SELECT l.scope, l.class_name, min(l.seq) AS cf, arg_min(l.ts, l.seq) AS start_ts, any_value(s.sf) AS sf
  FROM lab l JOIN scopes s ON l.scope = s.scope GROUP BY l.scope, l.class_name)"""
    if table:
        body = f"SELECT * RENAME (type_ AS type, tag_ AS tag) FROM ({body})"
    return q(body, ctes)


for _s in ("thread", "class", "manufacturer", "device"):
    ORACLE[f"tree_{_s}"] = tree_sql(_s)
ORACLE["grouped_table"] = tree_sql("thread", table=True)

ORACLE["call_durations"] = q("""SELECT class_name, method, CAST(count(*) AS BIGINT) AS calls,
  CAST(count(exit_seq) AS BIGINT) AS closed, CAST(count(*) FILTER (WHERE exit_seq IS NULL) AS BIGINT) AS open,
  CAST(sum(CASE WHEN exit_seq IS NOT NULL THEN TRY_CAST(nxdur AS BIGINT) END) AS BIGINT) AS total_ms,
  CAST(max(CASE WHEN exit_seq IS NOT NULL THEN TRY_CAST(nxdur AS BIGINT) END) AS BIGINT) AS max_ms
FROM lab WHERE type = 'ENTER' GROUP BY class_name, method""", labelled("thread"))

# --- governance and sources -------------------------------------------------

STORE_COLS = ["type", "class_name", "method", "file", "line", "thread_id", "thread_name", "ts",
              "device_manufacturer", "device_model", "tag", "params", "result", "duration_ms", "exception",
              "message", "try_start_line", "condition_result", "schema_version", "platform", "runtime", "app_id",
              "app_version", "build_number", "user_id", "device_id", "session_id", "stack", "source_map_id",
              "proguard_map_id", "is_minified"]
TEXT_STORE = ", ".join(
    "array_to_string(from_json(stack, '[\"VARCHAR\"]'), chr(10)) AS stack" if c == "stack" else c
    for c in STORE_COLS)

ORACLE["erase_user"] = q(f"SELECT seq, user_id FROM trace WHERE user_id IS DISTINCT FROM '{ERASE_USER}'")

ORACLE["drop_repeats"] = q(
    "SELECT min(seq) AS seq, CAST(count(*) AS BIGINT) AS copies FROM all_rows GROUP BY " + ", ".join(STORE_COLS),
    """, all_rows AS (SELECT * FROM trace UNION ALL
  SELECT * REPLACE (seq + 1000000000 AS seq) FROM trace WHERE platform = 'react-native')""")

ORACLE["quota_audit"] = q("""
SELECT 'source' AS kind, source AS key, CAST(floor(ts / 60000) * 60000 AS BIGINT) AS window_start,
  CAST(count(*) AS BIGINT) AS requests, 600 AS "limit", count(*) > 600 AS over_limit FROM req GROUP BY 2, 3
UNION ALL
SELECT 'token', coalesce(token, 'anon'), CAST(floor(ts / 60000) * 60000 AS BIGINT), CAST(count(*) AS BIGINT), 10000,
  count(*) > 10000 FROM req GROUP BY 2, 3""", f""",
req AS (SELECT seq // 50 AS batch_id, coalesce(device_id, {DEVICE_GROUP}) AS source, min(ts) AS ts,
  arg_min(app_id, seq) AS token FROM trace GROUP BY 1, 2)""")

ORACLE["decode_batch"] = q(f"""SELECT CAST(seq // 50 AS BIGINT) AS batch_id,
  CAST(row_number() OVER (PARTITION BY seq // 50 ORDER BY seq) - 1 AS INTEGER) AS pos, {TEXT_STORE} FROM trace""")

ORACLE["decode_log"] = q(f"SELECT seq * 2 + 1 AS seq, {TEXT_STORE} FROM trace")

ORACLE["load_report"] = q("""SELECT 'any' AS kind, '' AS source, CAST(count(*) AS BIGINT) AS loaded,
  CAST(count(*) AS BIGINT) AS skipped FROM trace""")

# --- streaming (oracle = the batch answer) ----------------------------------

ORACLE["live_stats"] = ORACLE["stats"]
ORACLE["live_pairs"] = q("""SELECT scope, class_name, method, seq AS enter_seq, exit_seq
FROM lab WHERE type = 'ENTER' AND exit_seq IS NOT NULL""", labelled("thread"))
ORACLE["live_quota"] = ORACLE["quota_audit"]

# --- insights ------------------------------------------------------------------

RETAIN_FROM = 1705363200000
STACK_LIST = "from_json(stack, '[\"VARCHAR\"]')"

ORACLE["issues"] = q(f"""SELECT app_id, fingerprint, min(ts) AS first_seen, max(ts) AS last_seen,
  CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
  arg_min(exception, seq) AS exception
FROM (SELECT *, sha256(coalesce(exception, '') || chr(10) ||
  coalesce(array_to_string(list_slice({STACK_LIST}, 1, 5), chr(10)), '')) AS fingerprint
  FROM trace WHERE type = 'CATCH') GROUP BY app_id, fingerprint""")

ORACLE["alerts"] = q("""SELECT app_id, ws AS window_start, ws + 300000 AS window_end, CAST(count(*) AS BIGINT) AS events,
  count(*) > 10 AS alert
FROM (SELECT app_id, (ts // 60000) * 60000 - k * 60000 AS ws FROM trace, range(0, 5) r(k) WHERE type = 'CATCH')
GROUP BY app_id, ws""")

ORACLE["latency"] = q("""SELECT class_name, method, CAST(count(*) AS BIGINT) AS n,
  CAST(quantile_cont(duration_ms, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(duration_ms, 0.95) AS DOUBLE) AS p95,
  CAST(quantile_cont(duration_ms, 0.99) AS DOUBLE) AS p99
FROM trace WHERE type = 'EXIT' AND duration_ms IS NOT NULL AND duration_ms <= 100000000000
GROUP BY class_name, method""")

ORACLE["sample"] = q("""SELECT seq, type, session_id FROM trace
WHERE (CAST('0x' || substr(md5(coalesce(session_id, CAST(seq AS VARCHAR))), 1, 8) AS BIGINT) % 100) < 1
  OR type = 'CATCH'""")

ORACLE["breadcrumbs"] = q("""SELECT session_id, seq, CAST(coalesce(len(l), 0) AS INTEGER) AS n_crumbs,
  coalesce(array_to_string(l, chr(10)), '') AS crumbs
FROM (SELECT session_id, seq, type, list(type || ' ' || class_name || '.' || method) OVER (
  PARTITION BY session_id ORDER BY seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS l
  FROM trace WHERE session_id IS NOT NULL) WHERE type = 'CATCH'""")

ORACLE["timeline"] = q("""SELECT user_id, seq, type, rank FROM (SELECT user_id, seq, type,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS INTEGER) AS rank
  FROM trace WHERE user_id IS NOT NULL) WHERE rank <= 20""")

ORACLE["retention"] = q(f"SELECT seq FROM trace WHERE ts // 86400000 >= {RETAIN_FROM} // 86400000")

ORACLE["demap"] = q(f"""SELECT f.seq, string_agg(coalesce(m.original, f.frame), chr(10) ORDER BY f.pos) AS stack,
  CAST(count(m.original) AS INTEGER) AS mapped
FROM fr f LEFT JOIN mp m ON f.map_id = m.map_id AND f.frame = m.frame GROUP BY f.seq""", f""",
fr AS (SELECT seq, source_map_id AS map_id, unnest({STACK_LIST}) AS frame,
  generate_subscripts({STACK_LIST}, 1) AS pos FROM trace WHERE stack IS NOT NULL),
mp AS (SELECT DISTINCT map_id, frame, regexp_replace(frame, '^at f(\\d+)', 'at handler\\1') AS original
  FROM fr WHERE starts_with(frame, 'at f'))""")

ORACLE["anomalies"] = q("""SELECT class_name, method, seq, duration_ms,
  CASE WHEN c >= 2 THEN round(m, 2) END AS baseline_mean, CASE WHEN c >= 2 THEN round(sd, 2) END AS baseline_sd,
  CASE WHEN c >= 2 AND sd > 0 THEN abs((duration_ms - m) / sd) > 3.0 END AS anomaly
FROM (SELECT class_name, method, seq, duration_ms,
  count(*) OVER w AS c, avg(duration_ms) OVER w AS m, stddev_samp(duration_ms) OVER w AS sd
  FROM trace WHERE type = 'EXIT' AND duration_ms IS NOT NULL AND duration_ms <= 100000000000
  WINDOW w AS (PARTITION BY class_name, method ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""")

# --- store round trip, views, live notices ------------------------------------

STORE_SINCE = 1704844800000
STORE_UNTIL = 1705449600000

ORACLE["store_page"] = q(f"""
SELECT seq, ts, type, app_id, CAST(page_pos AS INTEGER) AS page_pos,
  CASE WHEN n > 250 THEN max(CASE WHEN page_pos = 250 THEN ts END) OVER () END AS next_cursor,
  strftime(epoch_ms(ts), '%Y-%m-%d') AS event_date
FROM r WHERE page_pos <= 250""", f""",
p AS (SELECT * FROM trace WHERE ts > {STORE_SINCE} AND ts <= {STORE_UNTIL} AND platform = 'react-native'
      ORDER BY ts, seq LIMIT 251),
r AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS page_pos, count(*) OVER () AS n FROM p)""")

ORACLE["sort_view"] = q(f"SELECT seq, class_name, {DETAIL} AS detail FROM trace")
ORACLE["unknown_types"] = q("""SELECT CAST(count(*) FILTER (WHERE type IS NULL OR type NOT IN
  ('ENTER', 'EXIT', 'CATCH', 'BRANCH')) AS BIGINT) AS dropped FROM trace""")
ORACLE["live_apps"] = ORACLE["apps"]
ORACLE["live_labels"] = q(f"""SELECT DISTINCT 'device' AS kind, {DEVICE_LABEL} AS value FROM trace WHERE ({DEVICE_LABEL}) <> ''
UNION ALL SELECT DISTINCT 'manufacturer', device_manufacturer FROM trace WHERE coalesce(device_manufacturer, '') <> ''""")

ORACLE["live_alerts"] = ORACLE["alerts"]
ORACLE["live_dedupe"] = q("SELECT DISTINCT ts, type, class_name, method, user_id FROM trace")


# --- files, the store and streams -------------------------------------------------

ORACLE["bodies"] = q("""
SELECT batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY seq) - 1 AS INTEGER) AS pos, type, class_name,
  method, ts, CAST(NULL AS VARCHAR) AS reason FROM b WHERE batch % 7 NOT IN (3, 5, 6)
UNION ALL SELECT DISTINCT batch, CAST(NULL AS INTEGER), NULL, NULL, NULL, CAST(NULL AS BIGINT), CASE batch % 7
  WHEN 3 THEN 'not a JSON array' WHEN 5 THEN 'undecodable event' ELSE 'malformed JSON' END
FROM b WHERE batch % 7 IN (3, 5, 6)""", ", b AS (SELECT *, CAST(seq // 100 AS BIGINT) AS batch FROM trace)")

ORACLE["pages"] = q("""SELECT CAST(seq // 100 AS BIGINT) AS page,
  CAST(row_number() OVER (PARTITION BY seq // 100 ORDER BY seq) - 1 AS BIGINT) AS pos, type, class_name, method, ts
FROM trace WHERE (seq // 100) % 9 <> 4""")
ORACLE["session"] = q(f"SELECT {TEXT_STORE} FROM trace")
ORACLE["session_compat"] = q("""SELECT type, class_name, method, file, line, thread_id, thread_name, ts,
  device_manufacturer, device_model, tag, CAST(NULL AS VARCHAR) AS params, result, duration_ms, exception, message,
  try_start_line, condition_result FROM trace""")
ORACLE["read_any"] = q("""SELECT CASE WHEN seq % 2 = 0 THEN 'session' ELSE 'log' END AS kind, type, class_name,
  method, ts FROM trace""")
ORACLE["log_stream"] = q("SELECT type, class_name, method, ts FROM trace")
ORACLE["params_text"] = q("""SELECT seq, CAST(line AS VARCHAR) AS n, 'true' AS b, 'null' AS z, '{"a":[1,2]}' AS o,
  class_name AS s FROM trace""")

ORACLE["store_erase"] = q(f"""SELECT seq, user_id,
  (SELECT CAST(count(*) AS BIGINT) FROM trace WHERE user_id = '{ERASE_USER}') AS erased
FROM trace WHERE user_id IS DISTINCT FROM '{ERASE_USER}'""")
ORACLE["store_clear"] = q("""SELECT CAST(count(*) AS BIGINT) AS cleared,
  CAST(count(*) FILTER (WHERE type = 'CATCH') AS BIGINT) AS rows FROM trace""")
ORACLE["store_retention"] = ORACLE["retention"]
ORACLE["store_evolution"] = q("SELECT seq, type, tag, " + ", ".join(
    f"CASE WHEN seq % 2 = 1 THEN {c} END AS {c}" for c in ("platform", "app_id", "session_id", "is_minified"))
    + " FROM trace")
ORACLE["ingest"] = q(f"""
SELECT ts, type, class_name, method, user_id, {mask('message')} AS message, CAST(NULL AS VARCHAR) AS reason
FROM b WHERE batch % 7 NOT IN (3, 5, 6)
UNION ALL SELECT CAST(NULL AS BIGINT), NULL, NULL, NULL, NULL, NULL, reason FROM (
  SELECT DISTINCT batch, CASE batch % 7 WHEN 3 THEN 'not a JSON array' WHEN 5 THEN 'undecodable event'
    ELSE 'malformed JSON' END AS reason FROM b WHERE batch % 7 IN (3, 5, 6))""",
                     ", b AS (SELECT *, CAST(seq // 100 AS BIGINT) AS batch FROM trace)")

LOADS = f""", a AS (SELECT *, CASE WHEN thread_id IS NULL OR thread_id NOT IN (1, 2) THEN 2
  WHEN seq < (SELECT max(seq) // 2 FROM trace) THEN 0 ELSE 1 END AS load FROM trace),
f AS (SELECT seq, ts, type, load FROM a WHERE app_id = '{APP}' AND ts > 0)"""
ORACLE["follow"] = q("SELECT seq, ts, type FROM f", LOADS)
ORACLE["follow_compat"] = q("""SELECT seq, ts, type FROM f
WHERE ts > coalesce((SELECT max(g.ts) FROM f g WHERE g.load < f.load), -1)""", LOADS)

ORACLE["ingest_two_inboxes"] = q("SELECT ts, type, class_name, method, user_id, line FROM trace")
ORACLE["follow_after_erase"] = q(f"""SELECT seq, ts, type, 'fresh' AS follower FROM f WHERE user_id IS DISTINCT FROM '{ERASE_USER}'
UNION ALL SELECT seq, ts, type, 'lagging' FROM f WHERE load = 0 OR user_id IS DISTINCT FROM '{ERASE_USER}'""",
                                 LOADS.replace("app_id = '", "'' <> '").replace("ts, type, load", "ts, type, user_id, load"))

ORACLE["late_alerts"] = ORACLE["live_alerts"]
ORACLE["late_dedupe"] = ORACLE["live_dedupe"]
ORACLE["usage_days"] = q("""SELECT app_id, CAST(count(*) AS BIGINT) AS events,
  CAST(count(*) FILTER (WHERE type = 'CATCH') AS BIGINT) AS errors, true AS users_ok FROM trace GROUP BY app_id""")
ORACLE["latency_days"] = q("""SELECT class_name, method, CAST(count(*) AS BIGINT) AS n, true AS p50_ok,
  true AS p95_ok, true AS p99_ok
FROM trace WHERE type = 'EXIT' AND duration_ms IS NOT NULL GROUP BY class_name, method""")
ORACLE["log_follow"] = ORACLE["log_stream"]

ISSUES = f""", o AS (SELECT app_id, ts, seq, sha256(coalesce(exception, '') || chr(10) ||
  coalesce(array_to_string(list_slice({STACK_LIST}, 1, 5), chr(10)), '')) AS fingerprint FROM trace WHERE type = 'CATCH'),
i AS (SELECT app_id, fingerprint, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM o GROUP BY app_id, fingerprint),
h AS (SELECT *, (first_seen + last_seen) // 2 AS mid FROM i),
r AS (SELECT *, ts - lag(ts, 2) OVER w AS b2, ts - lag(ts, 3) OVER w AS b3, ts - lag(ts, 4) OVER w AS b4,
  ts - lag(ts, 5) OVER w AS b5 FROM o WINDOW w AS (PARTITION BY app_id, fingerprint ORDER BY ts, seq))"""
FIRINGS = f"""
SELECT 'any-new' AS rule, app_id, fingerprint, min(ts) AS ts, arg_min(seq, (ts, seq)) AS seq FROM o GROUP BY app_id, fingerprint
UNION ALL SELECT 'back-again', o.app_id, o.fingerprint, min(o.ts), arg_min(o.seq, (o.ts, o.seq)) FROM o JOIN h
  ON o.app_id IS NOT DISTINCT FROM h.app_id AND o.fingerprint = h.fingerprint
  WHERE o.ts > h.mid AND (h.n % 2 = 1 OR o.ts <= h.mid + 86400000) GROUP BY o.app_id, o.fingerprint
UNION ALL SELECT 'burst', app_id, fingerprint, ts, seq FROM r WHERE b2 < 21600000 AND NOT coalesce(b3 < 21600000, false)
UNION ALL SELECT 'app-burst', app_id, fingerprint, ts, seq FROM r WHERE app_id = '{APP}' AND b4 < 86400000
  AND NOT coalesce(b5 < 86400000, false)"""
ORACLE["rule_alerts"] = q(FIRINGS, ISSUES)
ORACLE["live_rules"] = ORACLE["rule_alerts"]
ORACLE["issue_status"] = q("""SELECT app_id, fingerprint, first_seen, last_seen, CAST(n AS BIGINT) AS events,
  CASE WHEN n % 2 = 0 THEN 'ignored' WHEN last_seen > mid THEN 'unresolved' ELSE 'resolved' END AS status FROM h""", ISSUES)
ORACLE["tree_window"] = f"""SELECT pos, level, kind, label, date, time, type, detail FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY sf, cf, level, seq) - 1 AS BIGINT) AS pos FROM ({tree_sql("device", table=True)}) x) y
WHERE pos >= 3000 AND pos < 3500"""

# --- rules on rows that meet them ----------------------------------------------------

ORACLE["unknown_types"] = q("""SELECT CAST(count(*) FILTER (WHERE seq % 10 IN (0, 1)
  OR type NOT IN ('ENTER', 'EXIT', 'CATCH', 'BRANCH')) AS BIGINT) AS dropped FROM trace""")
ORACLE["regex_literal"] = q("""SELECT seq, class_name || '(1)' AS class_name FROM trace
WHERE seq % 3 = 0 AND contains(lower(class_name), 'cart')
  AND lower(class_name) LIKE '%cart'""")
ORACLE["noise_builtin"] = q(
    "SELECT seq, class_name, method FROM n WHERE NOT ("
    + " OR ".join(f"contains(class_name, '{f}')" for f in NOISE if f != "Repository")
    + " OR method = '<clinit>' OR regexp_matches(method, '^[gs]et\\p{Lu}'))",
    """, n AS (SELECT seq, CASE seq % 6 WHEN 0 THEN 'Hilt_' || class_name WHEN 1 THEN class_name || '_Factory'
    ELSE class_name END AS class_name, CASE seq % 6 WHEN 2 THEN '<clinit>'
    WHEN 3 THEN 'get' || upper(left(method, 1)) || lower(substr(method, 2))
    WHEN 4 THEN 'get' || method ELSE method END AS method FROM trace)""")

ORACLE["repeats"] = ORACLE["drop_repeats"]
ORACLE["drop_repeats"] = ORACLE["repeats"].replace(
    "SELECT min(seq) AS seq, CAST(count(*) AS BIGINT) AS copies", "SELECT min(seq) AS seq, ts, type")
ORACLE["quota_audit"] = ORACLE["quota_audit"].replace(
    "600 AS", "2 AS").replace("> 600", "> 2").replace("10000,", "2,").replace("> 10000", "> 2")
ORACLE["live_quota"] = ORACLE["quota_audit"]

ORACLE["late_quota"] = ORACLE["quota_audit"]

UNEVEN = """SELECT * REPLACE (CASE seq % 97 WHEN 5 THEN duration_ms * 50 WHEN 6 THEN duration_ms + 1700000000000
  ELSE duration_ms END AS duration_ms) FROM trace"""
ORACLE["anomalies"] = ORACLE["anomalies"].replace("FROM trace WHERE type", f"FROM ({UNEVEN}) WHERE type")
ORACLE["latency_cut"] = q(f"""SELECT class_name, method, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE duration_ms > 100000000000) AS BIGINT) AS cut
FROM ({UNEVEN}) WHERE type = 'EXIT' AND duration_ms IS NOT NULL GROUP BY class_name, method""")
ORACLE["latency_approx"] = q("""SELECT class_name, method, CAST(count(*) AS BIGINT) AS n, true AS p50_ok,
  true AS p95_ok, true AS p99_ok
FROM trace WHERE type = 'EXIT' AND duration_ms IS NOT NULL AND duration_ms <= 100000000000
GROUP BY class_name, method""")
