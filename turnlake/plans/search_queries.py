"""Search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.functions import fulltext as ft
from turnlake.functions.query_string import parse
from turnlake.operators import search as s
from turnlake.operators.text_index import TextIndex
from turnlake.plans.common import query
from turnlake.sources.archive import from_parquet, to_parquet
from turnlake.sources.places import work_folder

TOKENS = r"regexp_extract_all(lower(strip_accents(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"
_BASE = """,
base AS (SELECT t.session_id, t.id, t.ordinal, t.type, t.timestamp, t.content, coalesce(p.path, '') AS project_path,
    coalesce(p.display_name, '') AS project_name, coalesce(s.model, '') AS model, s.has_error, s.has_subagent, s.source
    FROM turns t JOIN sessions s ON t.session_id = s.id LEFT JOIN projects p ON s.project_id = p.id)
"""
_HITS = f"""{_BASE},
hits AS (SELECT session_id, id FROM turns WHERE list_contains({TOKENS.format('content')}, '{{w}}')
    UNION SELECT session_id, turn_id FROM tool_uses
    WHERE list_contains({TOKENS.format("input_json || ' ' || result_content")}, '{{w}}'))
"""
_KEYS = "SELECT session_id, id FROM base WHERE "


def _keys(line: str):
    return lambda a: s.matching(a, parse(line)).select("session_id", "id")


query("search_base", _BASE + "SELECT * FROM base")(s.base)
query("search_text", _HITS.replace("{w}", "deploy") + "SELECT session_id, id, ordinal, type, timestamp FROM base SEMI JOIN hits USING (session_id, id) WHERE timestamp > TIMESTAMP '2024-01-01 12:00:00'")(
    lambda a: s.matching(a, parse("deploy")).filter(F.col("timestamp") > F.lit("2024-01-01 12:00:00").cast("timestamp")).select("session_id", "id", "ordinal", "type", "timestamp")
)
query("search_tool", _BASE + _KEYS + "session_id IN (SELECT session_id FROM tool_uses WHERE lower(tool_name) = 'signup')")(_keys("tool:SignUp"))
query("search_project", _BASE + _KEYS + "contains(lower(project_path), 'machin') OR contains(lower(project_name), 'machin')")(_keys("project:MACHIN"))
query("search_model", _BASE + _KEYS + "contains(lower(model), 'high')")(_keys("model:high"))
query("search_file", _BASE + _KEYS + "session_id IN (SELECT session_id FROM tool_uses WHERE contains(lower(file_path), 'view/7.'))")(_keys("file:View/7."))
query("search_tool_file", _BASE + _KEYS + "session_id IN (SELECT session_id FROM tool_uses WHERE tool_name = 'error' AND contains(file_path, '/17.py'))")(_keys("tool:error file:/17.py"))
query("search_before", _BASE + _KEYS + "timestamp < TIMESTAMP '2024-01-03 00:00:00'")(_keys("before:2024-01-03"))
query("search_after", _BASE + _KEYS + "timestamp > TIMESTAMP '2024-01-03 00:00:00'")(_keys("after:2024/01/03"))
query("search_has_error", _BASE + _KEYS + "has_error")(_keys("has:error"))
query("search_has_subagent", _BASE + _KEYS + "has_subagent")(_keys("has:agent"))
query("search_toolerror", _BASE + _KEYS + "(session_id, id) IN (SELECT (session_id, turn_id) FROM tool_uses WHERE is_error)")(_keys("has:tool-error"))
query("search_source", _BASE + _KEYS + "source = 'O'")(_keys("source:O"))
_ORDER = " ORDER BY timestamp DESC NULLS LAST, id, session_id "
query("search_topk", _BASE + "SELECT session_id, id, timestamp, model FROM base WHERE source = 'F'" + _ORDER + "LIMIT 20")(
    lambda a: s.search(a, parse("source:F")).select("session_id", "id", "timestamp", "model")
)
query("search_page", _BASE + "SELECT session_id, id, timestamp, true AS has_more, 20 AS next_offset FROM base" + _ORDER + "LIMIT 10 OFFSET 10")(
    lambda a: s.page(a, parse(""), 10, 10).select("session_id", "id", "timestamp", "has_more", "next_offset")
)
query(
    "search_attribution",
    _HITS.replace("{w}", "deploy") + """,
page AS (SELECT * FROM base SEMI JOIN hits USING (session_id, id)""" + _ORDER + """LIMIT 20),
calls AS (SELECT session_id, turn_id, tool_name, input_json, result_content, row_number() OVER (PARTITION BY session_id, turn_id ORDER BY turn_ordinal) AS n
    FROM tool_uses WHERE list_contains(""" + TOKENS.format("input_json || ' ' || result_content") + """, 'deploy')),
found AS (SELECT page.session_id, page.id, content, tool_name, contains(lower(coalesce(content, '')), 'deploy') AS own,
        instr(lower(content), 'deploy') AS i, regexp_extract_all(input_json, '[\\p{L}\\p{N}]+') AS wi, regexp_extract_all(result_content, '[\\p{L}\\p{N}]+') AS wr
    FROM page LEFT JOIN calls ON page.session_id = calls.session_id AND page.id = turn_id AND n = 1),
side AS (SELECT *, list_contains(list_transform(wi, lambda x: lower(x)), 'deploy') AS first,
        CASE WHEN list_contains(list_transform(wi, lambda x: lower(x)), 'deploy') THEN wi ELSE wr END AS w FROM found),
spot AS (SELECT *, list_position(list_transform(w, lambda x: lower(x)), 'deploy') - 1 AS p, CASE WHEN i > 1 THEN greatest(i - 51, 0) ELSE 0 END AS st FROM side),
win AS (SELECT *, greatest(0, least(p - 11, len(w) - 24)) AS b FROM spot)
SELECT session_id, id, CASE WHEN NOT own THEN tool_name END AS matched_tool,
    CASE WHEN own OR tool_name IS NULL THEN trim(regexp_replace((CASE WHEN st > 0 THEN '...' ELSE '' END) || substring(content, st + 1, 150)
        || (CASE WHEN st + 150 < length(content) THEN '...' ELSE '' END), '\\s+', ' ', 'g'))
    ELSE (CASE WHEN b > 0 THEN '\u2026' ELSE '' END) || array_to_string(w[b + 1:b + 24], ' ') || (CASE WHEN b + 24 < len(w) THEN '\u2026' ELSE '' END) END AS snippet
FROM win""".replace("\\\\", "\\"),
)(lambda a: s.attributed(a, parse("deploy")).select("session_id", "id", "matched_tool", "snippet"))
query(
    "search_snippet",
    """, f AS (SELECT session_id, id, content, instr(lower(content), 'the') AS i FROM turns),
g AS (SELECT *, CASE WHEN i > 1 THEN greatest(i - 51, 0) ELSE 0 END AS st FROM f)
SELECT session_id, id, trim(regexp_replace((CASE WHEN st > 0 THEN '...' ELSE '' END) || substring(content, st + 1, 150)
    || (CASE WHEN st + 150 < length(content) THEN '...' ELSE '' END), '\\s+', ' ', 'g')) AS snippet FROM g""".replace("\\\\s", "\\s"),
)(lambda a: a.turns.select("session_id", "id", ft.snippet(F.col("content"), "the").alias("snippet")))
query("ts_coerce", ", x AS (SELECT id, CASE WHEN ordinal % 3 = 0 THEN 'soon' ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS raw, session_id FROM turns) SELECT session_id, id, try_cast(raw AS TIMESTAMP) AS ts FROM x")(
    lambda a: a.turns.select("session_id", "id", F.when(F.col("ordinal") % 3 == 0, "soon").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).try_cast("timestamp").alias("ts"))
)
_BM25 = """, docs AS (SELECT session_id, id, TOK AS t FROM turns),
st AS (SELECT count(*) AS n, avg(len(t)) AS l, count(*) FILTER (list_contains(t, 'de')) AS d1, count(*) FILTER (list_contains(t, 'la')) AS d2 FROM docs),
sc AS (SELECT session_id, id, len(t) AS dl, len(list_filter(t, lambda x: x = 'de')) AS f1, len(list_filter(t, lambda x: x = 'la')) AS f2
    FROM docs WHERE list_contains(t, 'de') AND list_contains(t, 'la'))
SELECT session_id, id, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / l))
    + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / l)), 6) AS score
FROM sc, st ORDER BY score DESC, session_id, id LIMIT 1000000""".replace("TOK", TOKENS.format("content"))
query("search_ranked", _BM25)(lambda a: s.ranked(a, "de la", 1000000).withColumn("score", F.round("score", 6)))

_T = lambda: ft.tokens(F.col("content"))  # noqa: E731  columns need a session
_MATCH = lambda text: lambda a: a.turns.filter(ft.compile_text(text)(_T())).select("session_id", "id")
_TOK = TOKENS.format("content")
_HAS = lambda w: f"list_contains({_TOK}, '{w}')"
query("fts_tokens", f"SELECT session_id, id, array_to_string({_TOK}, ' ') AS tokens FROM turns")(lambda a: a.turns.select("session_id", "id", F.array_join(_T(), " ").alias("tokens")))
query("fts_and", f"SELECT session_id, id FROM turns WHERE {_HAS('de')} AND {_HAS('la')}")(_MATCH("de la"))
query("fts_phrase", f"SELECT session_id, id FROM turns WHERE contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' de la ')")(_MATCH('"de la"'))
query("fts_or", f"SELECT session_id, id FROM turns WHERE {_HAS('der')} OR {_HAS('que')}")(_MATCH("der OR que"))
query("fts_not", f"SELECT session_id, id FROM turns WHERE {_HAS('de')} AND NOT {_HAS('la')}")(_MATCH("de NOT la"))
query("turn_date_bounds", "SELECT strftime(min(timestamp), '%Y-%m-%d') AS first_day, strftime(max(timestamp), '%Y-%m-%d') AS last_day FROM turns")(s.date_bounds)
query(
    "index_integrity",
    "SELECT count(*) AS n_rows, count(*) FILTER (ordinal <> 3) + 1 AS n_indexed, count(*) FILTER (ordinal = 3) AS n_missing, CAST(1 AS BIGINT) AS n_orphans FROM turns",
)(
    lambda a: s.index_integrity(
        a.turns,
        s.token_index(a._replace(turns=a.turns.filter("ordinal <> 3"))).unionByName(a.spark.createDataFrame([("gone", "t0", ["x"])], "session_id string, id string, tokens array<string>")),
    )
)
query("index_strict", "SELECT session_id, id, CASE WHEN ordinal = 2 THEN 'missing' ELSE 'different' END AS fault FROM turns WHERE ordinal IN (2, 4)")(
    lambda a: s.index_strict(
        a.turns,
        a.turns.filter("ordinal <> 2").select("session_id", "id", F.when(F.col("ordinal") == 4, F.array(F.lit("stale token"))).otherwise(_T()).alias("tokens")),
    )
)
query("resolve_project", "SELECT id, path FROM projects WHERE contains(lower(path), 'customer#00000001') OR contains(lower(display_name), 'customer#00000001')")(
    lambda a: s.project_matches(a, "Customer#00000001").select("id", "path")
)
query("tool_names_like", "SELECT DISTINCT tool_name FROM tool_uses WHERE contains(lower(tool_name), 'i') ORDER BY 1 LIMIT 10")(lambda a: s.tool_names_like(a, "I"))

# -- the stored index


def _indexed(a, name: str):
    """The archive written by month below the shared folder and read again, with its index."""
    folder = work_folder(a.spark, name)
    to_parquet(a, folder)
    stored = from_parquet(a.spark, folder)
    return stored, TextIndex(a.spark, f"{folder}/text_index").rebuild(stored)


def _by_index(name: str, line: str):
    def run(a):
        stored, index = _indexed(a, name)
        return s.matching(stored, parse(line), index).select("session_id", "id", "ordinal", "type", "timestamp")

    return run


_FOUND = "SELECT session_id, id, ordinal, type, timestamp FROM base SEMI JOIN hits USING (session_id, id) "
query("search_indexed", _HITS.replace("{w}", "deploy") + _FOUND + "WHERE has_error")(_by_index("search_indexed", "deploy has:error"))
query("search_dated", _HITS.replace("{w}", "la") + _FOUND + "WHERE timestamp > TIMESTAMP '2024-01-01 00:00:00' AND timestamp < TIMESTAMP '2024-01-05 00:00:00'")(
    _by_index("search_dated", "la after:2024-01-01 before:2024-01-05")
)
_PAYLOAD = "SELECT t.session_id, t.id FROM turns t WHERE EXISTS (SELECT 1 FROM tool_uses u WHERE u.session_id = t.session_id AND u.turn_id = t.id AND contains(' ' || array_to_string({}, ' ') || ' ', ' deploy failed '))"
query("fts_payload_phrase", _PAYLOAD.format(TOKENS.format("result_content")))(
    lambda a: _indexed(a, "fts_payload_phrase")[1].matches('"deploy failed"').filter("kind = 'call'").select("session_id", "id").distinct()
)
# of the places where one of the words stands, those whose window of three more tokens before holds the other one
_NEAR = f""", w AS (SELECT session_id, id, {_TOK} AS t FROM turns),
p AS (SELECT session_id, id, list_filter(range(len(t)), lambda i: t[i + 1] = 'de') AS a, list_filter(range(len(t)), lambda i: t[i + 1] = 'que') AS b FROM w)
SELECT session_id, id FROM p WHERE len(list_filter(flatten(list_transform(a, lambda x: list_transform(b, lambda y: abs(x - y)))), lambda d: d <= 4)) > 0"""
query("fts_near", _NEAR)(lambda a: _indexed(a, "fts_near")[1].matches("NEAR(de que, 3)").filter("kind = 'content'").select("session_id", "id"))
query("index_ranked", _BM25)(lambda a: _indexed(a, "index_ranked")[1].ranked("de la", 1000000).withColumn("score", F.round("score", 6)))


def _touched(a):
    """Every third session's turns get other words, every seventh session goes."""
    number = F.col("session_id").cast("long")
    turns = a.turns.withColumn("content", F.when(number % 3 == 0, F.concat(F.lit("rewritten "), F.coalesce("content", F.lit("")))).otherwise(F.col("content")))
    return a._replace(turns=turns.filter(number % 7 != 1))


def _replaced(a):
    stored, index = _indexed(a, "index_replaced")
    number = F.col("session_id").cast("long")
    touched = stored.turns.filter((number % 3 == 0) | (number % 7 == 1)).select("session_id")
    changed = _touched(stored)
    return changed, index.replace(changed, touched)


query(
    "index_replaced",
    f""", c AS (SELECT session_id, id, CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN 'rewritten ' || coalesce(content, '') ELSE content END AS content
    FROM turns WHERE CAST(session_id AS BIGINT) % 7 <> 1) SELECT session_id, id FROM c WHERE list_contains({_TOK}, 'rewritten') OR list_contains({_TOK}, 'der')""",
)(lambda a: _replaced(a)[1].matches("rewritten OR der").filter("kind = 'content'").select("session_id", "id"))
query("index_replaced_strict", ", x AS (SELECT 1) SELECT session_id, id, '' AS fault FROM turns WHERE false")(
    lambda a: (lambda c, i: i.strict(c).select("session_id", "id", "fault"))(*_replaced(a))
)
query(
    "index_replaced_integrity",
    """, t AS (SELECT session_id, id FROM turns WHERE CAST(session_id AS BIGINT) % 7 <> 1),
d AS (SELECT 'content' AS kind FROM t UNION ALL SELECT 'call' FROM tool_uses u JOIN t ON u.session_id = t.session_id AND u.turn_id = t.id)
SELECT kind, count(*) AS n_rows, count(*) AS n_indexed, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_orphans FROM d GROUP BY kind""",
)(lambda a: (lambda c, i: i.integrity(c))(*_replaced(a)))
query(
    "best_snippet",
    f""", w AS (SELECT session_id, id, {_TOK} AS t, regexp_extract_all(coalesce(content, ''), '[\\p{{L}}\\p{{N}}]+') AS o FROM turns),
m AS (SELECT session_id, id, o, list_filter(range(len(t)), lambda i: t[i + 1] = 'de') AS a, list_filter(range(len(t)), lambda i: t[i + 1] = 'que') AS b FROM w),
f AS (SELECT session_id, id, o, unnest(list_sort(a || b)) AS f, a, b FROM m),
c AS (SELECT session_id, id, o, f, len(list_filter(a, lambda x: x >= f AND x < f + 24)) AS na, len(list_filter(b, lambda x: x >= f AND x < f + 24)) AS nb,
    list_max(list_filter(a || b, lambda x: x >= f AND x < f + 24)) AS l FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY least(na, 1) + least(nb, 1) DESC, na + nb DESC, f) AS n FROM c),
s AS (SELECT *, greatest(0, least(f - CAST(floor((24 - (l - f + 1)) / 2) AS BIGINT), len(o) - 24)) AS st FROM r WHERE n = 1)
SELECT session_id, id, (CASE WHEN st > 0 THEN '\u2026' ELSE '' END) || array_to_string(o[st + 1:st + 24], ' ') || (CASE WHEN st + 24 < len(o) THEN '\u2026' ELSE '' END) AS snippet FROM s""".replace("\\\\", "\\"),
)(lambda a: a.turns.select("session_id", "id", ft.best_snippet([F.col("content")], ["de", "que"]).alias("snippet")).filter("snippet is not null"))
