"""The DuckDB twin of conversation structure repair: a table of cheapest edits per state, filled turn by turn."""

from __future__ import annotations


def _edit(state: str, cost: str, letter: str, line: str | None) -> str:
    """The (c)ost, (a)udit and (r)epaired lines of ``state`` after one more edit."""
    lines = f"list_append({state}.r, {line})" if line else f"{state}.r"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {lines}}} END"


def _if(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} END"


def _stays(state: str, wanted: str) -> list[str]:
    keep = _if(f"fault NOT IN ('b', 'd') AND initial = '{wanted[0]}'", _edit(state, "extra", "K", "role || ':' || text"))
    return [keep, _if("fault NOT IN ('b', 'd')", _edit(state, "1 + extra", "R", f"'{wanted}:' || text"))]


def _turn() -> str:
    system = _if("fault NOT IN ('b', 'd') AND initial = 's'", _edit("s0", "extra", "K", "role || ':' || text"))
    user = [x for s in ("s0", "s1", "s3") for x in _stays(s, "user")]
    said = {"t0": [], "t1": [system], "t2": user, "t3": _stays("s2", "assistant")}
    return ", ".join(f"least({_edit('s' + t[1], '2', 'D', None)}, {', '.join(x) or 'NULL'}) AS {t}" for t, x in said.items())


def _inserted(t0: str, t1: str, t2: str, t3: str) -> tuple[str, str]:
    user = f"least({t2}, {', '.join(_edit(t, '5', 'I', repr('user:')) for t in (t0, t1, t3))})"
    return user, f"least({t3}, {_edit('s2', '5', 'I', repr('assistant:'))})"


def op12_sql() -> str:
    user, assistant = _inserted("t0", "t1", "t2", "t3")
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]))"
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS x(i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS b FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INTEGER)])), CAST(4294967295 AS BIGINT)) % 20 AS how
  FROM keyed, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE how <> 0),
numbered AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered),
turns AS (SELECT *, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS extra FROM faulty),
wrong AS (
  SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS s0, {none} AS s1,
    {{'c': CAST(5 AS BIGINT), 'a': 'I', 'r': ['user:']}} AS s2, {{'c': CAST(10 AS BIGINT), 'a': 'II', 'r': ['user:', 'assistant:']}} AS s3 FROM wrong
  UNION ALL
  SELECT conv_id, i, t0 AS s0, t1 AS s1, s2, {assistant} AS s3
  FROM (SELECT *, {user} AS s2 FROM (SELECT walk.conv_id, turns.i, {_turn()} FROM walk JOIN turns ON turns.conv_id IS NOT DISTINCT FROM walk.conv_id AND turns.i = walk.i + 1) AS x) AS y),
best AS (SELECT wrong.*, least(s0, s3) AS b FROM walk JOIN wrong ON wrong.conv_id IS NOT DISTINCT FROM walk.conv_id AND wrong.n = walk.i)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(array_to_string(coalesce(b.r, CAST([] AS VARCHAR[])), chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS ids LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
