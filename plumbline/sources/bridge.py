"""Stand-in inputs: tables of the right shape derived from the star-schema test tables.

Each text runs in Spark SQL and in DuckDB; ``{sha}`` is the engine's SHA-256 of a string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.running import running

TABLES = {
    "members": ("lineitem",),
    "snap_edges": ("lineitem", "orders"),
    "snap_nodes": ("lineitem", "orders"),
    "runs": ("events",),
    "element_status": ("events",),
    "call_sites": ("lineitem", "part"),
    "definitions": ("part",),
    "doc_versions": ("documents",),
    "commits": ("orders",),
    "commit_files": ("events",),
    "layer_evidence": ("lineitem", "part"),
    "history": ("events",),
    "mutations": ("part",),
    "associations": ("lineitem",),
    "code_sites": ("lineitem", "part"),
    "code_classes": ("part",),
    "code_functions": ("supplier",),
    "code_imports": ("part",),
    "code_fields": ("lineitem",),
    "code_callables": ("lineitem",),
    "code_history": ("lineitem", "orders"),
    "renamed_nodes": ("orders",),
    "renamed_edges": ("orders",),
    "responses": ("part",),
    "rings": ("orders",),
    "ring_nodes": ("orders",),
    "ring_edges": ("orders",),
    "chain_nodes": ("orders",),
    "chain_edges": ("orders",),
}

#: Every order a directed ring of 3 to 6 classes in its customer's graph; version 1 renames them, version 2 of odd customers
#: takes rings of one more or one less, which often leaves the counts as they were.
_RINGS = """
SELECT o_custkey AS project, version, o_orderkey AS ring, mark, CASE WHEN o_orderstatus = 'F' THEN 'class' ELSE 'interface' END AS kind,
  3 + CASE WHEN version < 2 OR o_custkey % 2 = 0 THEN o_orderkey % 4 WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 + 1 ELSE o_orderkey % 4 - 1 END AS size
FROM orders CROSS JOIN (SELECT CAST(0 AS BIGINT) AS version, 'R' AS mark UNION ALL SELECT 1, 'M' UNION ALL SELECT 2, 'Z') v"""
_STEPS = "(SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) s"
_TIMES = " + ".join(f"CASE WHEN v >= {u} AND (o_orderkey + {u}) % 3 = 0 THEN 1 ELSE 0 END" for u in (1, 2, 3, 4, 5))
_RENAMED = f"(SELECT o_custkey, o_orderkey AS ring, CAST(v AS BIGINT) AS version, concat('O', CAST(o_orderkey AS STRING), '_', CAST({_TIMES} AS STRING)) AS node FROM orders CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) w) t"
_IN_CHAIN = "(SELECT *, CAST(v AS BIGINT) AS version, concat(CASE WHEN v = 1 AND o_orderkey % 3 = 0 THEN 'N' ELSE 'O' END, CAST(o_orderkey AS STRING)) AS node FROM orders CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1) w) t"

SQL = {
    "members": """
SELECT DISTINCT side, project, element, member, member_kind FROM (
  SELECT 'design' AS side, l_suppkey % 5 AS project, concat('C', CAST(l_partkey AS STRING)) AS element,
    concat(CASE WHEN l_tax < 0.04 THEN 'attr' ELSE 'op' END, CAST(l_linenumber AS STRING)) AS member,
    CASE WHEN l_tax < 0.04 THEN 'attribute' ELSE 'method' END AS member_kind
  FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL
  SELECT 'code', l_suppkey % 5, concat('C', CAST(l_partkey AS STRING)),
    concat(CASE WHEN l_tax < 0.04 THEN 'attr' ELSE 'op' END, CAST(l_linenumber AS STRING)),
    CASE WHEN l_tax < 0.04 THEN 'attribute' ELSE 'method' END
  FROM lineitem WHERE l_linestatus = 'O') t""",
    "snap_edges": """
SELECT DISTINCT l_suppkey % 5 AS project, CAST(year(o_orderdate) - 1995 AS BIGINT) AS version,
  concat('S', CAST(l_suppkey AS STRING)) AS src, concat('P', CAST(l_partkey AS STRING)) AS dst,
  CASE WHEN l_partkey % 3 = 0 THEN 'calls' WHEN l_partkey % 3 = 1 THEN 'contains' ELSE 'extends' END AS relation
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "snap_nodes": """
SELECT project, version, node, kind, signature FROM (
  SELECT l_suppkey % 5 AS project, CAST(year(o_orderdate) - 1995 AS BIGINT) AS version,
    concat('P', CAST(l_partkey AS STRING)) AS node, 'class' AS kind, CAST(max(l_linenumber) AS STRING) AS signature
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4
  UNION ALL
  SELECT l_suppkey % 5, CAST(year(o_orderdate) - 1995 AS BIGINT),
    concat('S', CAST(l_suppkey AS STRING)), 'module', CAST(count(DISTINCT l_returnflag) AS STRING)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4) t""",
    "runs": """
SELECT project, commit_index, commit_id, gate_strategy, fired AS gate_allowed_llm,
  conformance_changed, source_touched, (conformance_changed AND NOT fired) AS missed_change,
  CASE WHEN fired THEN tok ELSE CAST(0 AS BIGINT) END AS prompt_tokens,
  CAST(CASE WHEN fired THEN 40 ELSE 0 END AS BIGINT) AS completion_tokens,
  CAST(CASE WHEN fired THEN value * 10 ELSE 12 END AS DOUBLE) AS latency_ms, divergences, absences,
  concat(CAST(divergences AS STRING), '|', CAST(absences AS STRING)) AS findings_hash
FROM (
  SELECT c.*, g.gate_strategy,
    CASE g.gate_strategy WHEN 'always' THEN true WHEN 'content' THEN source_touched
      WHEN 'structural' THEN structural ELSE (structural AND NOT renamed_only) END AS fired
  FROM (
    SELECT user_id % 5 AS project,
      CAST(row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS BIGINT) AS commit_index,
      CAST(event_id AS STRING) AS commit_id, value,
      CAST(floor(value * 100) AS BIGINT) AS tok,
      event_type <> 'view' AS source_touched,
      event_type IN ('error', 'purchase') AS structural,
      (event_type = 'error' AND value > 20) AS renamed_only,
      (event_type = 'error' AND user_id % 2 = 0) AS conformance_changed,
      CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER
        (PARTITION BY user_id % 5 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS divergences,
      CAST(sum(CASE WHEN event_type = 'signup' AND value > 20 THEN 1 ELSE 0 END) OVER
        (PARTITION BY user_id % 5 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS absences
    FROM events) c
  CROSS JOIN (SELECT 'always' AS gate_strategy UNION ALL SELECT 'content'
    UNION ALL SELECT 'structural' UNION ALL SELECT 'isomorphism') g) t""",
    "element_status": """
SELECT user_id % 5 AS project, concat('E', CAST(user_id AS STRING)) AS element,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS commit_index,
  CASE WHEN event_type = 'error' AND value > 120 THEN 'absent'
    WHEN event_type = 'purchase' AND value > 150 THEN 'partial'
    WHEN event_type = 'click' AND value > 180 THEN 'divergent' ELSE 'conforming' END AS status
FROM events""",
    "call_sites": """
SELECT l_orderkey AS caller, CAST(l_linenumber AS BIGINT) AS site, l_suppkey % 25 AS caller_file,
  CASE WHEN p_size > 40 THEN concat(p_name, ' ', CAST(p_partkey AS STRING)) ELSE p_name END AS callee
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "definitions": """
SELECT CAST(p_partkey AS STRING) AS def_id, CAST(p_size AS BIGINT) AS def_file,
  CASE WHEN p_size > 40 THEN concat(p_name, ' ', CAST(p_partkey AS STRING)) ELSE p_name END AS name
FROM part WHERE p_name NOT LIKE 'red %'""",
    "doc_versions": """
SELECT source AS project,
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS version, doc_id,
  {sha}(text) AS text_hash,
  {sha}(replace(replace(text, chr(10), ''), ' ', '')) AS structure_hash, n_chars
FROM documents""",
    "commits": """
SELECT o_custkey % 5 AS project, o_orderkey AS sha, o_orderdate AS committed_at,
  lag(o_orderkey) OVER (PARTITION BY o_custkey % 5, o_orderkey % 4 = 3 ORDER BY o_orderkey) AS parent0,
  CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey - 1 END AS parent1
FROM orders""",
    "commit_files": """
SELECT user_id % 5 AS project, event_id AS commit_ord, CAST(ts AS DATE) AS committed_on,
  CASE WHEN event_type = 'signup' AND user_id % 10 = 3 THEN concat('model/', CAST(user_id AS STRING), '.mdj') WHEN event_type = 'signup' AND value > 40 THEN 'model/design.mdj'
    WHEN event_type = 'view' THEN concat('docs/', CAST(user_id AS STRING), '.md')
    ELSE concat('src/', CAST(user_id AS STRING), '.py') END AS path
FROM events""",
    "history": """
SELECT user_id % 5 AS project, CAST(row_number() OVER w - 1 AS BIGINT) AS version,
  CAST(sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER w AS STRING) AS text_hash,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS STRING) AS structure_hash,
  CAST(sum(CASE WHEN event_type = 'signup' AND value > 45 THEN 1 ELSE 0 END) OVER w AS STRING) AS design_hash,
  CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS delta_size,
  CASE WHEN event_type = 'error' THEN user_id % 3 = 0 END AS isomorphic,
  CAST(sum(CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS divergences,
  CAST(sum(CASE WHEN event_type = 'purchase' AND value > 40 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS absences
FROM events WINDOW w AS (PARTITION BY user_id % 5 ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
    "code_sites": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS site, CAST(p_size AS BIGINT) AS file,
  CASE WHEN l_linenumber < 6 THEN concat('K', CAST(l_partkey AS STRING)) END AS class,
  CASE (l_orderkey + l_linenumber) % 10 WHEN 1 THEN 'self' WHEN 2 THEN 'this.f1' WHEN 3 THEN 'x' WHEN 4 THEN concat('C', CAST(l_suppkey AS STRING)) WHEN 5 THEN 'mod1' END AS receiver,
  CASE (l_orderkey + l_linenumber) % 10 WHEN 0 THEN concat('C', CAST(l_suppkey AS STRING)) WHEN 1 THEN concat('m', CAST(l_suppkey % 4 AS STRING))
    WHEN 2 THEN 'm0' WHEN 3 THEN 'm1' WHEN 4 THEN 'm2' WHEN 7 THEN concat('g', CAST(l_suppkey AS STRING)) WHEN 8 THEN concat('C', CAST(l_suppkey AS STRING))
    WHEN 9 THEN 'm3' ELSE concat('fn', CAST(l_suppkey % 30 AS STRING)) END AS name,
  (l_orderkey + l_linenumber) % 10 = 0 AS instantiation,
  CASE WHEN (l_orderkey + l_linenumber) % 10 = 3 THEN concat('pkg.C', CAST(l_suppkey AS STRING)) END AS local_type
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "code_classes": """
SELECT concat('K', CAST(p_partkey AS STRING)) AS class, CAST(p_size AS BIGINT) AS file,
  concat('C', CAST(CASE WHEN p_size > 40 THEN p_partkey % 3 ELSE p_partkey END AS STRING)) AS class_name, p_partkey AS k, CAST(p_size AS BIGINT) AS size
FROM part""",
    "code_functions": """
SELECT s_suppkey % 50 AS file, concat('fn', CAST(s_suppkey % 30 AS STRING)) AS name, concat('F', CAST(s_suppkey AS STRING)) AS function_id FROM supplier
UNION ALL SELECT s_suppkey % 50, concat('g', CAST(s_suppkey AS STRING)), concat('G', CAST(s_suppkey AS STRING)) FROM supplier""",
    "code_imports": """
SELECT DISTINCT CAST(p_size AS BIGINT) AS file, symbol, CAST((p_size + step) % 50 AS BIGINT) AS target
FROM part CROSS JOIN (SELECT 'mod1' AS symbol, 1 AS step UNION ALL SELECT 'fn3', 7 UNION ALL SELECT 'C5', 2) t""",
    "associations": """
SELECT DISTINCT l_suppkey % 5 AS project, concat('C', CAST(l_partkey AS STRING)) AS source, concat('S', CAST(l_suppkey AS STRING)) AS target,
  CASE WHEN l_linenumber % 2 = 0 THEN 'association' ELSE 'dependency' END AS relation
FROM lineitem WHERE l_returnflag = 'A'""",
    "code_fields": """
SELECT l_suppkey % 5 AS project, concat('C', CAST(l_partkey AS STRING)) AS element, l_orderkey * 10 + l_linenumber AS pos,
  CASE WHEN l_linenumber % 3 = 0 THEN concat('s', CAST(l_suppkey AS STRING), 's')
    WHEN l_linenumber % 3 = 1 THEN concat('s', CAST(l_suppkey AS STRING), '_old') ELSE 'x' END AS name,
  CASE WHEN l_tax < 0.02 THEN concat('pkg.S', CAST(l_suppkey AS STRING)) WHEN l_tax < 0.04 THEN '' END AS type
FROM lineitem WHERE l_linestatus = 'O'""",
    "code_callables": """
SELECT l_suppkey % 5 AS project, concat('C', CAST(l_partkey AS STRING)) AS element, l_orderkey AS pos, CAST(l_linenumber AS BIGINT) AS ref_pos,
  CASE WHEN l_linenumber % 3 = 0 THEN 'param' WHEN l_linenumber % 3 = 1 THEN 'return' ELSE 'instantiation' END AS kind,
  concat('S', CAST(l_suppkey AS STRING)) AS type
FROM lineitem WHERE l_linestatus = 'O' AND l_tax > 0.06""",
    "code_history": """
SELECT DISTINCT l_suppkey % 5 AS project, CAST(year(o_orderdate) - 1992 AS BIGINT) AS version, concat('C', CAST(l_partkey AS STRING)) AS element,
  CASE WHEN l_tax < 0.04 THEN 'attribute' ELSE 'method' END AS member_kind, concat(CASE WHEN l_tax < 0.04 THEN 'attr' ELSE 'op' END, CAST(l_linenumber AS STRING)) AS member
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "renamed_nodes": f"SELECT o_custkey AS project, version, ring, node, 'class' AS kind FROM {_RENAMED}",
    "renamed_edges": f"""
SELECT * FROM (SELECT o_custkey AS project, version, node AS src, lead(node) OVER (PARTITION BY o_custkey, version ORDER BY ring) AS dst, 'calls' AS relation FROM {_RENAMED}) c
WHERE dst IS NOT NULL""",
    "responses": """
SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN 'Sure: ' WHEN 1 THEN concat('```json', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 11 = 0 THEN '{"similarity_score": ' ELSE concat('{"similarity_score": ', CASE WHEN p_size % 3 = 0 THEN concat('"', CAST(p_size * 3 AS STRING), '"') ELSE CAST(p_size AS STRING) END,
    ', "gaps": ', CASE WHEN p_size % 2 = 0 THEN '"one"' ELSE '["a", "b"]' END, ', "recommendations": ', CASE WHEN p_size % 4 = 0 THEN 'null' ELSE '["r", 7]' END,
    ', "unit_tests": [{"code": "x = 1", "framework": "f"}, {"target_file": "t.py"}], "semantic_graph": {"nodes": ["A", {"id": "B', CAST(p_size AS STRING), '", "type": "class"}, {"type": "class"}], "edges": [{"source": "A", "target": "B',
    CAST(p_size % 7 AS STRING), '"}, {"source": "C", "target": "A", "relation": "calls"}, {"source": "C"}, "no"]}}') END,
  CASE p_partkey % 5 WHEN 0 THEN ' Bye.' WHEN 1 THEN concat(chr(10), '```') ELSE '' END) AS response
FROM part""",
    "rings": _RINGS,
    "ring_nodes": f"""
SELECT project, version, concat(mark, CAST(ring AS STRING), '_', CAST(i AS STRING)) AS node, kind FROM ({_RINGS}) r CROSS JOIN {_STEPS} WHERE i < size""",
    "ring_edges": f"""
SELECT project, version, concat(mark, CAST(ring AS STRING), '_', CAST(i AS STRING)) AS src, concat(mark, CAST(ring AS STRING), '_', CAST((i + 1) % size AS STRING)) AS dst, 'calls' AS relation
FROM ({_RINGS}) r CROSS JOIN {_STEPS} WHERE i < size""",
    "chain_nodes": f"SELECT o_custkey AS project, version, node, o_orderstatus AS kind FROM {_IN_CHAIN}",
    "chain_edges": f"""
SELECT * FROM (SELECT o_custkey AS project, version, node AS src, lead(node) OVER (PARTITION BY o_custkey, version ORDER BY o_orderkey) AS dst, 'calls' AS relation FROM {_IN_CHAIN}) c
WHERE dst IS NOT NULL""",
    "mutations": """
SELECT p_partkey AS mutation, p_brand AS category, CAST(v AS BIGINT) AS version, p_size % 3 = 0 AS expect_structural_change,
  CAST(CASE WHEN v = 1 AND p_size % 7 > 0 THEN 1 ELSE 0 END AS STRING) AS text_hash,
  CAST(CASE WHEN v = 1 AND p_size % 3 = 0 THEN 1 ELSE 0 END AS STRING) AS structure_hash,
  p_size % 2 = 0 AS isomorphic,
  CAST(CASE WHEN v = 1 AND p_size % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS divergences,
  CAST(CASE WHEN v = 1 AND p_size % 4 = 0 THEN NULL ELSE 0 END AS BIGINT) AS absences
FROM part CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1) t""",
    "layer_evidence": """
SELECT DISTINCT concat('s', CAST(l_suppkey AS STRING), '/', lower(p_type)) AS file_path, lower(p_name) AS evidence
FROM lineitem JOIN part ON l_partkey = p_partkey""",
}

_ERRORS, _SIGNUPS = "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END", "CASE WHEN event_type = 'signup' AND value > 20 THEN 1 ELSE 0 END"
_IN_ORDER = "PARTITION BY user_id % 5 ORDER BY event_id"
#: Windows over all events of a project, by their text, and what each adds up: a project is too large for one task, so Spark works them out in blocks.
WINDOWS = {
    "runs": {f"row_number() OVER ({_IN_ORDER})": "1"} | {f"sum({x}) OVER\n        ({_IN_ORDER} ROWS UNBOUNDED PRECEDING)": x for x in (_ERRORS, _SIGNUPS)},
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stand-in table as a DataFrame."""
    for table in TABLES[name]:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    text = SQL[name].replace("{sha}(text)", "sha2(text, 256)")
    if name in WINDOWS:
        sums = {f"running_{i}": F.expr(added) for i, added in enumerate(WINDOWS[name].values())}
        events = spark.table("events").withColumn("of_project", F.expr("user_id % 5"))
        running(events, ["of_project"], "event_id", sums).createOrReplaceTempView("running_events")
        for column, window in zip(sums, WINDOWS[name], strict=True):
            text = text.replace(window, column)
        text = text.replace("FROM events", "FROM running_events")
    return spark.sql(text.replace("{sha}(replace(replace(text, chr(10), ''), ' ', ''))", "sha2(replace(replace(text, chr(10), ''), ' ', ''), 256)"))


def cte(*names: str) -> str:
    """WITH list of stand-in tables for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].replace('{sha}', 'sha256')})" for n in names)
