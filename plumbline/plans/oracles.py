"""The registered queries in DuckDB SQL, over the same stand-in tables."""

from __future__ import annotations

from plumbline.sources.bridge import cte

Z = "1.959963984540054"


def _wilson(part: str, whole: str, name: str) -> str:
    n = f"CAST(nullif({whole}, 0) AS DOUBLE)"
    p = f"({part} / {n})"
    centre = f"(({p} + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n}))"
    half = f"({Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * {n} * {n})) / (1 + {Z} * {Z} / {n}))"
    low, high = f"{centre} - {half}", f"{centre} + {half}"
    return (
        f"round(CASE WHEN {whole} > 0 THEN greatest(0.0, {low}) END, 6) AS {name}_low, round(CASE WHEN {whole} > 0 THEN least(1.0, {high}) END, 6) AS {name}_high"
    )


def _rate(part: str, whole: str, name: str) -> str:
    return f"round(CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} END, 6) AS {name}"


_ELEMENTS = """, d AS (SELECT DISTINCT project, element FROM members WHERE side = 'design'), c AS (SELECT DISTINCT project, element FROM members WHERE side = 'code'),
elements AS (SELECT coalesce(d.project, c.project) AS project, coalesce(d.element, c.element) AS element,
  CASE WHEN c.element IS NULL THEN 'missing' WHEN d.element IS NULL THEN 'extra' ELSE 'matched' END AS state
  FROM d FULL JOIN c ON d.project = c.project AND d.element = c.element),
dm AS (SELECT * FROM members WHERE side = 'design'), cm AS (SELECT * FROM members WHERE side = 'code'),
compared AS (SELECT coalesce(dm.project, cm.project) AS project, coalesce(dm.element, cm.element) AS element, coalesce(dm.member_kind, cm.member_kind) AS member_kind,
  coalesce(dm.member, cm.member) AS member, CASE WHEN cm.member IS NULL THEN 'missing' WHEN dm.member IS NULL THEN 'extra' ELSE 'matched' END AS state
  FROM dm FULL JOIN cm ON dm.project = cm.project AND dm.element = cm.element AND dm.member = cm.member AND dm.member_kind = cm.member_kind),
mm AS (SELECT compared.* FROM compared JOIN (SELECT project, element FROM elements WHERE state = 'matched') USING (project, element))
"""
_M = cte("members") + _ELEMENTS
_REFLEX = "CAST(count(*) FILTER (state = 'extra') AS BIGINT) AS divergences, CAST(count(*) FILTER (state = 'missing') AS BIGINT) AS absences, CAST(count(*) FILTER (state = 'matched') AS BIGINT) AS convergences"
_RESOLVED = cte("call_sites", "definitions") + """, here AS (SELECT name, def_file, min(def_id) AS local_id FROM definitions GROUP BY ALL),
anywhere AS (SELECT name, count(DISTINCT def_id) AS n, min(def_id) AS def_id FROM definitions GROUP BY name),
resolved AS (SELECT s.*, CASE WHEN local_id IS NOT NULL THEN 'same_file' WHEN n = 1 THEN 'unique_global' WHEN n > 1 THEN 'ambiguous' ELSE 'external' END AS bucket,
  CASE WHEN local_id IS NOT NULL THEN local_id WHEN n = 1 THEN a.def_id END AS target
  FROM call_sites s LEFT JOIN here h ON s.callee = h.name AND s.caller_file = h.def_file LEFT JOIN anywhere a ON s.callee = a.name)
"""
_COUNTS = """count(*) AS runs, count(*) FILTER (gate_allowed_llm) AS reanalysed, count(*) FILTER (NOT gate_allowed_llm) AS skipped,
  count(missed_change) AS checked, count(*) FILTER (missed_change) AS missed, count(*) FILTER (conformance_changed AND gate_allowed_llm) AS tp,
  count(*) FILTER (conformance_changed AND NOT gate_allowed_llm) AS fn, count(*) FILTER (NOT conformance_changed AND gate_allowed_llm) AS fp,
  count(*) FILTER (NOT conformance_changed AND NOT gate_allowed_llm) AS tn, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens,
  quantile_cont(latency_ms, 0.5) AS median_latency_ms"""
_R = cte("runs")
_RANK = "(CASE gate_strategy WHEN 'always' THEN 1 WHEN 'content' THEN 2 WHEN 'structural' THEN 3 WHEN 'isomorphism' THEN 4 ELSE 99 END)"
#: Runs of which one project lacks a gate, one was never checked and one has no always runs; rep is one row per project for structural, over all runs where it is lacking.
_UNEVEN = _R + f""", u AS (SELECT * REPLACE (CASE WHEN project <> 2 THEN missed_change END AS missed_change), gate_allowed_llm AND commit_index % 4 <> 0 AS called FROM runs
  WHERE NOT (project = 1 AND gate_strategy = 'structural') AND NOT (project = 3 AND gate_strategy = 'always')),
foc AS (SELECT project, count(*) AS runs, count(*) FILTER (NOT gate_allowed_llm) AS skipped, count(missed_change) AS checked, count(*) FILTER (missed_change) AS missed, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens
  FROM u WHERE gate_strategy = 'structural' OR project = 1 GROUP BY project),
al AS (SELECT project, CAST(sum(prompt_tokens + completion_tokens) FILTER (gate_strategy = 'always') AS BIGINT) AS always, count(DISTINCT commit_id) AS commits,
  quantile_cont(CASE WHEN called THEN CAST(100 - divergences % 40 AS DOUBLE) END, 0.5) AS ms,
  (arg_max(divergences + absences, commit_index) - arg_min(divergences + absences, commit_index)) / CAST(greatest(1, max(commit_index) - min(commit_index)) AS DOUBLE) AS drift FROM u GROUP BY project),
pg AS (SELECT p.project, gate_strategy, coalesce(s, -1) AS s FROM (SELECT DISTINCT project FROM u) p CROSS JOIN (SELECT DISTINCT gate_strategy FROM u) g
  LEFT JOIN (SELECT project, gate_strategy, count(*) FILTER (NOT gate_allowed_llm) / CAST(count(*) AS DOUBLE) AS s FROM u GROUP BY ALL) USING (project, gate_strategy)),
rk AS (SELECT project, string_agg(gate_strategy, ' > ' ORDER BY s DESC, {_RANK}) AS gate_ranking FROM pg GROUP BY project),
rep AS (SELECT * FROM foc JOIN al USING (project) JOIN rk USING (project))
"""
_GATES = _R + f", g AS (SELECT gate_strategy, {_COUNTS} FROM runs GROUP BY gate_strategy), b AS (SELECT gate_strategy AS baseline_gate, tokens AS baseline_tokens FROM g WHERE gate_strategy = 'always')"
_GATE_ROWS = (
    _GATES
    + ", t AS (SELECT g.*, b.*, "
    + ", ".join(
        f"{_rate(p, w, n + '_rate')}, {_wilson(p, w, n)}" for n, p, w in (("skip", "skipped", "runs"), ("miss", "missed", "checked"), ("recall", "tp", "(tp + fn)"), ("specificity", "tn", "(tn + fp)"))
    )
    + ", baseline_tokens - tokens AS saved_tokens, round(CAST(baseline_tokens - tokens AS DOUBLE) / nullif(baseline_tokens, 0), 6) AS saved_share, runs >= 10 AS enough_runs FROM g, b) "
)
_SERVED = _R + """, fresh AS (SELECT *, CASE WHEN gate_allowed_llm OR row_number() OVER (PARTITION BY project, gate_strategy ORDER BY commit_index) = 1 THEN findings_hash END AS h FROM runs),
s1 AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY project, gate_strategy ORDER BY commit_index ROWS UNBOUNDED PRECEDING) AS served_hash FROM fresh),
served AS (SELECT * EXCLUDE (missed_change), served_hash <> findings_hash AS diverges_from_oracle, served_hash <> findings_hash AND NOT gate_allowed_llm AS missed_change FROM s1)
"""
_HORIZON = _SERVED + """, o AS (SELECT *, coalesce(lag(diverges_from_oracle) OVER w, false) AS before,
  min(CASE WHEN NOT diverges_from_oracle THEN commit_index END) OVER (PARTITION BY project, gate_strategy ORDER BY commit_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS good
  FROM served WINDOW w AS (PARTITION BY project, gate_strategy ORDER BY commit_index)),
horizons AS (SELECT project, gate_strategy, commit_index, good - commit_index AS horizon FROM o WHERE missed_change AND NOT before)
"""
_POINTS = _R + f""", pts AS (SELECT project, commit_index, divergences, absences, source_touched, conformance_changed FROM runs
  QUALIFY row_number() OVER (PARTITION BY project, commit_index ORDER BY {_RANK}, gate_strategy) = 1)
"""
_OBS = cte("element_status") + """, obs AS (SELECT project, element, arg_min(status, commit_index) IN ('absent', 'partial', 'divergent') AS at_freeze,
  coalesce(min(commit_index) FILTER (status IN ('absent', 'partial', 'divergent')), max(commit_index)) - min(commit_index) AS time, max(commit_index) AS last,
  count(*) FILTER (status IN ('absent', 'partial', 'divergent')) > 0 AS event FROM element_status GROUP BY project, element)
"""


def _curve(keys: str, source: str = "obs WHERE NOT at_freeze") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    by = f"{keys}, " if keys else ""
    return f""", tm AS (SELECT {by}time, CAST(sum(CASE WHEN event THEN 1 ELSE 0 END) AS BIGINT) AS events, count(*) AS leaving FROM {source} GROUP BY ALL),
ar AS (SELECT *, CAST(sum(leaving) OVER ({part} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM tm),
cv AS (SELECT {by}time, at_risk, events, product(1 - events / CAST(at_risk AS DOUBLE)) OVER ({part} ORDER BY time ROWS UNBOUNDED PRECEDING) AS survival FROM ar),
curve AS (SELECT * FROM cv WHERE events > 0)
"""


_SNAP = cte("doc_versions") + ", snaps AS (SELECT *, CAST(version // 25 AS VARCHAR) AS design_hash FROM doc_versions)" + """,
gates AS (SELECT unnest(['always', 'content', 'structural', 'isomorphism']) AS gate_strategy),
moved AS (SELECT project, version, lag(version) OVER w AS previous, lag(design_hash) OVER w IS DISTINCT FROM design_hash AS dm, lag(text_hash) OVER w IS DISTINCT FROM text_hash AS xm,
  lag(structure_hash) OVER w IS DISTINCT FROM structure_hash AS sm FROM snaps WINDOW w AS (PARTITION BY project ORDER BY version)),
dec0 AS (SELECT project, version, previous, gate_strategy, CASE WHEN previous IS NULL THEN 'first version' WHEN dm THEN 'design changed' WHEN gate_strategy = 'always' THEN 'always'
  WHEN gate_strategy = 'content' THEN (CASE WHEN xm THEN 'content changed' ELSE 'content unchanged' END) WHEN NOT sm THEN 'structure unchanged' ELSE 'structure changed' END AS reason FROM moved, gates),
decided AS (SELECT project, version, gate_strategy, reason NOT IN ('content unchanged', 'structure unchanged', 'same shape') AS fired, reason, previous FROM dec0)
"""


_CASCADE = cte("code_sites", "code_classes", "code_functions", "code_imports") + """, kn AS (SELECT class_name, min(class) AS id FROM code_classes GROUP BY class_name HAVING count(DISTINCT class) = 1),
own AS (SELECT class, 'm' || CAST(size % 4 AS VARCHAR) AS name FROM code_classes), me AS (SELECT class, name, class || '::' || name AS method_id FROM own),
ih AS (SELECT c.class, m.name, m.method_id FROM code_classes c JOIN kn ON kn.class_name = 'C' || CAST(k - 1 AS VARCHAR) JOIN me m ON m.class = kn.id WHERE k % 4 = 3 AND kn.id <> c.class),
mo AS (SELECT * FROM me UNION ALL SELECT * FROM ih WHERE NOT EXISTS (SELECT 1 FROM me WHERE me.class = ih.class AND me.name = ih.name)),
fc AS (SELECT class, id AS field_class FROM code_classes JOIN kn ON kn.class_name = 'C' || CAST(k // 2 AS VARCHAR)),
fu AS (SELECT file, name, min(function_id) AS fid FROM code_functions GROUP BY ALL), pl AS (SELECT file, class_name AS name, min(class) AS cid FROM code_classes GROUP BY ALL),
an AS (SELECT name, count(DISTINCT id) AS n, min(id) AS id FROM (SELECT name, function_id AS id FROM code_functions UNION ALL SELECT name, method_id FROM me) GROUP BY name),
st AS (SELECT s.*, lc.id AS lcid, sc.id AS scid, mc.id AS mcid, fc.field_class FROM code_sites s LEFT JOIN kn lc ON lc.class_name = split_part(local_type, '.', -1)
  LEFT JOIN kn sc ON sc.class_name = receiver LEFT JOIN kn mc ON mc.class_name = s.name LEFT JOIN fc ON fc.class = s.class AND receiver = 'this.f1'),
ho AS (SELECT *, CASE WHEN instantiation THEN NULL WHEN receiver IS NULL OR receiver = 'self' THEN class WHEN receiver = 'this.f1' THEN field_class ELSE coalesce(lcid, scid) END AS holder FROM st),
al AS (SELECT ho.*, mo.method_id, fu.fid, pl.cid, f2.fid AS ifid, p2.cid AS icid, an.n, an.id AS gid FROM ho LEFT JOIN mo ON mo.class = holder AND mo.name = ho.name
  LEFT JOIN code_imports im ON im.file = ho.file AND im.symbol = coalesce(receiver, ho.name) LEFT JOIN fu ON fu.file = ho.file AND fu.name = ho.name LEFT JOIN pl ON pl.file = ho.file AND pl.name = ho.name
  LEFT JOIN fu f2 ON f2.file = im.target AND f2.name = ho.name LEFT JOIN pl p2 ON p2.file = im.target AND p2.name = ho.name LEFT JOIN an ON an.name = ho.name),
bk AS (SELECT *, CASE WHEN instantiation THEN (CASE WHEN mcid IS NOT NULL THEN 'instantiation' ELSE 'external' END)
  WHEN receiver = 'self' THEN (CASE WHEN method_id IS NOT NULL THEN 'self' ELSE 'external' END) WHEN receiver = 'this.f1' THEN (CASE WHEN method_id IS NOT NULL THEN 'field' ELSE 'external' END)
  WHEN receiver IS NOT NULL AND lcid IS NOT NULL THEN (CASE WHEN method_id IS NOT NULL THEN 'local' ELSE 'external' END)
  WHEN receiver IS NOT NULL AND scid IS NOT NULL THEN (CASE WHEN method_id IS NOT NULL THEN 'static' ELSE 'external' END)
  WHEN receiver IS NOT NULL THEN (CASE WHEN coalesce(ifid, icid) IS NOT NULL THEN 'import' ELSE 'external' END)
  WHEN method_id IS NOT NULL THEN 'self' WHEN fid IS NOT NULL THEN 'same_file' WHEN cid IS NOT NULL THEN 'instantiation' WHEN ifid IS NOT NULL THEN 'import' WHEN icid IS NOT NULL THEN 'instantiation'
  WHEN n = 1 THEN 'unique_global' WHEN n > 1 THEN 'ambiguous' WHEN mcid IS NOT NULL THEN 'instantiation' ELSE 'external' END AS bucket FROM al),
cas AS (SELECT site, class, bucket, CASE WHEN bucket IN ('self', 'field', 'local', 'static') THEN method_id WHEN bucket = 'same_file' THEN fid WHEN bucket = 'unique_global' THEN gid
  WHEN bucket = 'import' THEN coalesce(ifid, icid) WHEN bucket = 'instantiation' THEN (CASE WHEN instantiation THEN mcid ELSE coalesce(cid, icid, mcid) END) END AS target FROM bk)
"""
_EVID = cte("members", "associations", "code_fields", "code_callables", "snap_edges", "layer_evidence") + _ELEMENTS + """, cf AS (SELECT a.project, source, target, pos, lower(name) AS name, lower(target) AS want, split_part(type, '.', -1) = target AS typed
  FROM associations a JOIN code_fields f ON a.project = f.project AND source = element),
cand AS (SELECT project, source, target, 1 AS k0, pos AS k1, 0 AS k2, 0 AS k3, 'strong' AS ev FROM cf WHERE typed
  UNION ALL SELECT project, source, target, 3, pos, 0, 0, 'weak' FROM cf WHERE name IN (want, want || 's', want || '_list')
  UNION ALL SELECT project, source, target, 4, pos, 0, 0, 'weak' FROM cf WHERE starts_with(name, want)
  UNION ALL SELECT a.project, source, target, 2, pos, CASE kind WHEN 'param' THEN 0 WHEN 'return' THEN 1 ELSE 2 END, ref_pos, CASE kind WHEN 'instantiation' THEN 'weak' ELSE 'strong' END
  FROM associations a JOIN code_callables u ON a.project = u.project AND source = element AND type = target),
best AS (SELECT DISTINCT project, source, target, ev FROM cand QUALIFY row_number() OVER (PARTITION BY project, source, target ORDER BY k0, k1, k2, k3) = 1),
ev AS (SELECT a.project, a.source, a.target, a.relation, CASE WHEN c.element IS NULL THEN 'none' ELSE coalesce(ev, 'none') END AS evidence
  FROM associations a LEFT JOIN best USING (project, source, target) LEFT JOIN (SELECT DISTINCT project, element FROM members WHERE side = 'code') c ON c.project = a.project AND c.element = a.source),
rl AS (SELECT d.project, d.src, d.dst, d.relation, max(x.relation IS NOT NULL) OR max(u.relation IS NOT NULL) AS satisfied FROM (SELECT * FROM snap_edges WHERE version = 0) d
  LEFT JOIN (SELECT * FROM snap_edges WHERE version = 1 AND relation <> 'extends') x ON x.project = d.project AND x.src = d.src AND x.dst = d.dst AND x.relation = d.relation
  LEFT JOIN (SELECT * FROM snap_edges WHERE version = 2 AND relation = 'extends') u ON u.project = d.project AND u.src = d.src AND u.dst = d.dst GROUP BY ALL)
"""
_PRINT = """, pt AS (SELECT project, left(sha256(finding), 3) AS part, sha256(string_agg(finding, chr(10) ORDER BY finding)) AS digest FROM f GROUP BY ALL)
SELECT project, left(sha256(string_agg(part || digest, chr(10) ORDER BY part)), 16) AS fingerprint FROM pt GROUP BY project"""
_OWN = """SELECT project, state || ':' || element AS finding FROM elements WHERE state <> 'matched'
  UNION SELECT project, state || '-' || member_kind || ':' || element || '.' || member FROM mm WHERE state <> 'matched'"""


def _decided(source: str, key: str, design: str, delta: str) -> str:
    """CTEs h (what moved) and dec (reason and fired per policy) over one table of snapshots."""
    moved = ", ".join(f"lag({c}) OVER w IS DISTINCT FROM {c} AS {n}" for c, n in ((design, "dm"), ("text_hash", "xm"), ("structure_hash", "sm")))
    return f""", h AS (SELECT *, lag(version) OVER w AS previous, {moved} FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY version)),
why AS (SELECT h.*, g AS gate_strategy, CASE WHEN previous IS NULL THEN 'first version' WHEN dm THEN 'design changed' WHEN g = 'always' THEN 'always'
  WHEN g = 'content' THEN (CASE WHEN xm THEN 'content changed' ELSE 'content unchanged' END) WHEN NOT (sm OR {delta} > 0) THEN 'structure unchanged'
  WHEN g = 'isomorphism' AND coalesce(isomorphic, false) THEN 'same shape' ELSE 'structure changed' END AS reason FROM h, (SELECT unnest(['always', 'content', 'structural', 'isomorphism']) AS g)),
dec AS (SELECT *, reason NOT IN ('content unchanged', 'structure unchanged', 'same shape') AS fired FROM why)
"""


_REPLAY = cte("history") + _decided("history", "project", "design_hash", "delta_size") + """, sv AS (SELECT *, arg_max(divergences, version) FILTER (fired) OVER u AS sd, arg_max(absences, version) FILTER (fired) OVER u AS sa,
  lag(divergences) OVER v AS bd, lag(absences) OVER v AS ba FROM dec
  WINDOW u AS (PARTITION BY project, gate_strategy ORDER BY version ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY project, gate_strategy ORDER BY version)),
rp AS (SELECT project, version, gate_strategy, fired, reason, concat_ws(',', CASE WHEN sd <> divergences THEN 'divergences' END, CASE WHEN sa <> absences THEN 'absences' END) AS differing_fields,
  sd <> divergences OR sa <> absences AS diverges_from_oracle, (sd <> divergences OR sa <> absences) AND NOT fired AS missed_change,
  CASE WHEN previous IS NOT NULL THEN bd <> divergences OR ba <> absences END AS conformance_changed, CASE WHEN previous IS NOT NULL THEN xm END AS source_touched FROM sv)
"""
_STALE = cte("commit_files") + """, lastc AS (SELECT project, path AS diagram, max(commit_ord) AS last_commit, max(committed_on) AS last_changed FROM commit_files WHERE path LIKE '%.mdj' GROUP BY ALL),
head AS (SELECT project, max(committed_on) AS head_date FROM commit_files GROUP BY project),
sums AS (SELECT l.project, diagram, count(DISTINCT commit_ord) AS stale_commits, count(DISTINCT CASE WHEN path LIKE '%.py' THEN path END) AS code FROM lastc l JOIN commit_files f ON l.project = f.project AND f.commit_ord > l.last_commit GROUP BY ALL),
stale AS (SELECT l.project, l.diagram, last_commit, coalesce(stale_commits, 0) AS stale_commits, coalesce(code, 0) AS code_files_changed_since, CAST(date_diff('day', last_changed, head_date) AS BIGINT) AS stale_days
  FROM lastc l LEFT JOIN sums s ON l.project = s.project AND l.diagram = s.diagram JOIN head h ON l.project = h.project)
"""
_VERDICT = "CASE WHEN stale_commits = 0 THEN 'current' WHEN stale_commits < 30 THEN 'recent' WHEN code_files_changed_since = 0 THEN 'unaffected' ELSE 'candidate' END"
_PATHS = cte("commit_files") + ", paths AS (SELECT DISTINCT path FROM commit_files)"
_NODES = cte("snap_nodes", "snap_edges") + """, vn AS (SELECT DISTINCT project, version FROM snap_nodes), nx AS (SELECT project, version, lead(version) OVER (PARTITION BY project ORDER BY version) AS nxt FROM vn),
oldn AS (SELECT n.project, nxt AS version, node, kind, signature FROM snap_nodes n JOIN nx USING (project, version) WHERE nxt IS NOT NULL),
newn AS (SELECT n.* FROM snap_nodes n JOIN (SELECT project, min(version) AS f FROM vn GROUP BY project) USING (project) WHERE version > f),
nd AS (SELECT coalesce(n.project, o.project) AS project, coalesce(n.version, o.version) AS version, coalesce(n.node, o.node) AS node,
  CASE WHEN o.node IS NULL THEN 'added' WHEN n.node IS NULL THEN 'removed' WHEN n.kind IS NOT DISTINCT FROM o.kind AND n.signature IS NOT DISTINCT FROM o.signature THEN 'unchanged' ELSE 'changed' END AS change
  FROM newn n FULL JOIN oldn o ON n.project = o.project AND n.version = o.version AND n.node = o.node),
pe AS (SELECT DISTINCT project, version, src, dst FROM snap_edges), ve AS (SELECT DISTINCT project, version FROM pe),
nxe AS (SELECT project, version, lead(version) OVER (PARTITION BY project ORDER BY version) AS nxt FROM ve),
olde AS (SELECT p.project, nxt AS version, src, dst FROM pe p JOIN nxe USING (project, version) WHERE nxt IS NOT NULL),
newe AS (SELECT p.* FROM pe p JOIN (SELECT project, min(version) AS f FROM ve GROUP BY project) USING (project) WHERE version > f),
ed AS (SELECT coalesce(n.project, o.project) AS project, coalesce(n.version, o.version) AS version, coalesce(n.src, o.src) AS src, coalesce(n.dst, o.dst) AS dst,
  CASE WHEN o.src IS NULL THEN 'added' ELSE 'removed' END AS change FROM newe n FULL JOIN olde o ON n.project = o.project AND n.version = o.version AND n.src = o.src AND n.dst = o.dst WHERE n.src IS NULL OR o.src IS NULL)
"""

_CALLED = _R + """, r AS (SELECT *, gate_allowed_llm AND commit_index % 4 <> 0 AS called, CASE WHEN gate_allowed_llm AND commit_index % 4 <> 0 THEN CAST(100 - divergences % 40 AS DOUBLE) END AS score FROM runs)
"""
_GROUND = cte("snap_nodes", "snap_edges") + """, n AS (SELECT DISTINCT project, node FROM snap_nodes WHERE version = 0), s AS (SELECT project, 'x/' || src AS node, src AS leaf FROM snap_edges WHERE version = 1 UNION SELECT project, dst, dst FROM snap_edges WHERE version = 1),
gr AS (SELECT s.project, s.node, CASE WHEN n.node IS NOT NULL THEN n.node ELSE 'llm::' || s.node END AS g FROM s LEFT JOIN n ON n.project = s.project AND n.node = s.leaf)
"""
_TREE = cte("commit_files") + """, o AS (SELECT project, path, max(commit_ord % 1000) AS size FROM commit_files GROUP BY ALL),
p AS (SELECT project, string_split(path, '/') AS a, size FROM o), q AS (SELECT project, array_to_string(a[1:n], '/') AS path, size FROM p, LATERAL (SELECT unnest(range(1, len(a))) AS n) r),
b AS (SELECT project, path, 'blob' AS type, size, CAST(1 AS BIGINT) AS files FROM o UNION ALL SELECT project, path, 'tree', CAST(sum(size) AS BIGINT), count(*) FROM q GROUP BY project, path),
t AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY len(string_split(path, '/')), type = 'blob', path) AS place FROM b)
"""
_HUBS = cte("snap_nodes", "snap_edges") + """, e AS (SELECT project, version, src AS node FROM snap_edges UNION ALL SELECT project, version, dst FROM snap_edges), d AS (SELECT project, version, node, count(*) AS k FROM e GROUP BY ALL),
n AS (SELECT DISTINCT project, version, node FROM snap_nodes WHERE kind IN ('class', 'interface', 'module')),
h AS (SELECT n.*, coalesce(k, 0) AS degree, row_number() OVER (PARTITION BY project, version ORDER BY coalesce(k, 0) DESC, node) AS place FROM n LEFT JOIN d USING (project, version, node))
"""
_FOUND = cte("members", "code_history") + """, dm AS (SELECT DISTINCT project, element, member_kind, member FROM members WHERE side = 'design'), de AS (SELECT DISTINCT project, element FROM dm),
vs AS (SELECT DISTINCT project, version FROM code_history), ce AS (SELECT DISTINCT project, version, element FROM code_history),
fd AS (SELECT v.project, v.version, 'missing_class' AS kind, element, NULL AS mk, NULL AS m FROM vs v JOIN de USING (project) WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.project = v.project AND ce.version = v.version AND ce.element = de.element)
  UNION ALL SELECT project, version, 'extra_class', element, NULL, NULL FROM ce WHERE NOT EXISTS (SELECT 1 FROM de WHERE de.project = ce.project AND de.element = ce.element)
  UNION ALL SELECT ce.project, ce.version, 'missing_member', dm.element, member_kind, member FROM ce JOIN dm ON dm.project = ce.project AND dm.element = ce.element
    WHERE NOT EXISTS (SELECT 1 FROM code_history c WHERE c.project = ce.project AND c.version = ce.version AND c.element = dm.element AND c.member_kind = dm.member_kind AND c.member = dm.member)
  UNION ALL SELECT c.project, c.version, 'extra_member', c.element, c.member_kind, c.member FROM code_history c JOIN de ON de.project = c.project AND de.element = c.element
    WHERE NOT EXISTS (SELECT 1 FROM dm WHERE dm.project = c.project AND dm.element = c.element AND dm.member_kind = c.member_kind AND dm.member = c.member)),
ck AS (SELECT v.project, v.version, (SELECT count(*) FROM de WHERE de.project = v.project) + (SELECT count(*) FROM dm JOIN ce ON ce.project = dm.project AND ce.element = dm.element WHERE ce.project = v.project AND ce.version = v.version) AS checks_total FROM vs v),
fc AS (SELECT project, version, count(*) FILTER (kind = 'missing_class') AS n_missing_class, count(*) FILTER (kind = 'extra_class') AS n_extra_class, count(*) FILTER (kind = 'missing_member') AS n_missing_member,
  count(*) FILTER (kind = 'extra_member') AS n_extra_member, md5(string_agg(element, ',' ORDER BY element) FILTER (kind = 'missing_class')) AS h1, md5(string_agg(element, ',' ORDER BY element) FILTER (kind = 'extra_class')) AS h2,
  md5(string_agg(kind || element || mk || m, ',' ORDER BY kind, element, mk, m) FILTER (kind IN ('missing_member', 'extra_member'))) AS h3 FROM fd GROUP BY ALL),
pv AS (SELECT ck.project, ck.version, coalesce(n_missing_class, 0) AS n_missing_class, coalesce(n_extra_class, 0) AS n_extra_class, coalesce(n_missing_member, 0) AS n_missing_member, coalesce(n_extra_member, 0) AS n_extra_member,
  checks_total, checks_total - coalesce(n_missing_class, 0) - coalesce(n_missing_member, 0) AS checks_passed, h1, h2, h3 FROM ck LEFT JOIN fc USING (project, version)),
an AS (SELECT *, 100 * (checks_passed / CAST(checks_total AS DOUBLE)) AS score, checks_passed AS convergences, n_extra_class + n_extra_member AS divergences, n_missing_class + n_missing_member AS absences FROM pv)
"""
_SHAPE = """, w AS (SELECT project, version, list_sort(list(kind || CAST(size AS VARCHAR))) AS rings, sum(size) AS n FROM rings GROUP BY ALL),
shape AS (SELECT project, version, CASE WHEN n <> lag(n) OVER p THEN false WHEN n <= 400 THEN rings = lag(rings) OVER p END AS isomorphic FROM w WINDOW p AS (PARTITION BY project ORDER BY version))
"""

_RUN_ROWS = (
    _NODES + """, n AS (SELECT project, version, count(*) FILTER (change = 'added') AS an, count(*) FILTER (change = 'removed') AS rn, count(*) FILTER (change = 'changed') AS cn FROM nd GROUP BY ALL),
e AS (SELECT project, version, count(*) FILTER (change = 'added') AS ae, count(*) FILTER (change = 'removed') AS re FROM ed GROUP BY ALL),
al AS (SELECT project, version, count(DISTINCT node) AS all_nodes, count(*) AS tokens FROM snap_nodes GROUP BY ALL),
tn AS (SELECT nd.project, nd.version, nd.node FROM nd WHERE change IN ('added', 'changed')),
im AS (SELECT project, version, node FROM tn UNION SELECT t.project, t.version, x.dst FROM tn t JOIN pe x ON x.project = t.project AND x.version = t.version AND x.src = t.node
  UNION SELECT t.project, t.version, x.src FROM tn t JOIN pe x ON x.project = t.project AND x.version = t.version AND x.dst = t.node),
ti AS (SELECT project, version, count(*) AS k FROM im GROUP BY ALL),
j AS (SELECT al.*, n.* EXCLUDE (project, version), ae, re, coalesce(an + rn + cn + coalesce(ae, 0) + coalesce(re, 0), 0) AS delta_size, coalesce(k, 0) AS k, CAST(NULL AS BOOLEAN) AS isomorphic,
  't' AS text_hash, 's' AS structure_hash, CAST(CAST(floor(al.version / 4) AS BIGINT) AS VARCHAR) AS design_hash
  FROM al LEFT JOIN n USING (project, version) LEFT JOIN e USING (project, version) LEFT JOIN ti USING (project, version))
""" + _decided("j", "project", "design_hash", "delta_size") + """SELECT project, version, gate_strategy, fired AS gate_allowed_llm, CASE WHEN fired THEN 'invoke' ELSE 'reuse' END AS decision, reason,
  CASE WHEN previous IS NULL THEN all_nodes ELSE coalesce(an, 0) END AS added_nodes, CASE WHEN previous IS NULL THEN 0 ELSE coalesce(rn, 0) END AS removed_nodes,
  CASE WHEN previous IS NULL THEN 0 ELSE coalesce(cn, 0) END AS changed_nodes, CASE WHEN previous IS NULL THEN 0 ELSE coalesce(ae, 0) END AS added_edges, CASE WHEN previous IS NULL THEN 0 ELSE coalesce(re, 0) END AS removed_edges,
  CASE WHEN reason IN ('first version', 'design changed', 'always') THEN all_nodes WHEN fired THEN k ELSE 0 END AS impact_nodes"""
)

SQL = {
    "c01_element_compare": _M + "SELECT * FROM elements",
    "c02_member_compare": _M + "SELECT * FROM mm",
    "e01_conformance_score": _M + """, k AS (SELECT project, state FROM elements UNION ALL SELECT project, state FROM mm)
SELECT project, count(*) AS checks_total, CAST(count(*) FILTER (state = 'matched') AS DOUBLE) AS checks_passed, CAST(printf('%.2f', 100 * (CAST(count(*) FILTER (state = 'matched') AS DOUBLE) / count(*))) AS DOUBLE) AS score
FROM k WHERE state <> 'extra' GROUP BY project""",
    "b14_reflexion_counts": _M + f"SELECT project, {_REFLEX} FROM (SELECT project, state FROM elements UNION ALL SELECT project, state FROM mm) GROUP BY project",
    "b15_findings_fingerprint": _M + f", f AS ({_OWN})" + _PRINT,
    "b15_all_findings": _EVID + f""", lv AS (SELECT DISTINCT file_path FROM layer_evidence, (SELECT unnest(['widget', 'red', 'blue']) AS m) WHERE contains(file_path, 'economy') AND contains(evidence, m)),
f AS ({_OWN} UNION SELECT project, 'missing-relation:' || src || ' --' || relation || '--> ' || dst FROM rl WHERE NOT satisfied
  UNION SELECT project, 'no-evidence:' || source || ' --' || relation || '--> ' || target FROM ev WHERE evidence = 'none' UNION SELECT length(file_path) % 5, 'violation:view-layer@' || file_path FROM lv)""" + _PRINT,
    "c04_association_evidence": _EVID + "SELECT * FROM ev",
    "e01_score_with_relations": _EVID + """, k AS (SELECT project, CAST(state = 'matched' AS DOUBLE) AS credit FROM elements WHERE state <> 'extra' UNION ALL SELECT project, CAST(state = 'matched' AS DOUBLE) FROM mm WHERE state <> 'extra'
  UNION ALL SELECT project, CAST(satisfied AS DOUBLE) FROM rl UNION ALL SELECT project, CASE evidence WHEN 'strong' THEN 1.0 WHEN 'weak' THEN 0.5 ELSE 0.0 END FROM ev)
SELECT project, count(*) AS checks_total, sum(credit) AS checks_passed, CAST(printf('%.2f', 100 * (sum(credit) / count(*))) AS DOUBLE) AS score FROM k GROUP BY project""",
    "b09_code_as_design": cte("code_fields", "code_callables") + """, el AS (SELECT DISTINCT project, element, CASE WHEN element LIKE '%7' THEN 'interface' ELSE 'class' END AS element_type FROM code_fields),
mb AS (SELECT project, element, name AS member, 'attribute' AS member_kind, coalesce(nullif(type, ''), 'Object') AS type FROM code_fields
  UNION SELECT project, element, 'm' || CAST(pos AS VARCHAR), 'method', CASE WHEN kind = 'return' THEN type ELSE 'void' END FROM code_callables WHERE kind <> 'param')
SELECT mb.*, element_type FROM mb LEFT JOIN el USING (project, element)""",
    "b16_signature_difference": _M + f""", a AS (SELECT project, {_REFLEX} FROM (SELECT project, state FROM elements UNION ALL SELECT project, state FROM mm WHERE member_kind = 'attribute') GROUP BY project),
b AS (SELECT project, {_REFLEX} FROM (SELECT project, state FROM elements UNION ALL SELECT project, state FROM mm) GROUP BY project)
SELECT b.project, array_to_string(list_filter([CASE WHEN a.divergences <> b.divergences THEN 'divergences' END, CASE WHEN a.absences <> b.absences THEN 'absences' END,
  CASE WHEN a.convergences <> b.convergences THEN 'convergences' END], lambda x: x IS NOT NULL), ',') AS changed_fields FROM a JOIN b USING (project)""",
    "b17_element_status": _M + """, s AS (SELECT project, element, count(*) FILTER (state = 'missing') AS m, count(*) FILTER (state = 'extra') AS x FROM mm GROUP BY ALL)
SELECT e.project, e.element, CASE WHEN state = 'missing' THEN 'absent' WHEN m > 0 THEN 'partial' WHEN x > 0 THEN 'divergent' ELSE 'conforming' END AS status
FROM elements e LEFT JOIN s USING (project, element) WHERE state <> 'extra'""",
    "b24_gap_sentences": _EVID + """SELECT project, 'Class ''' || element || CASE WHEN state = 'missing' THEN ''' appears in the UML design but not in the code.' ELSE ''' exists in the code but not in the UML design.' END AS gap FROM elements WHERE state <> 'matched'
UNION ALL SELECT project, element || '.' || member || CASE member_kind WHEN 'method' THEN '()' ELSE '' END || ' is designed but not implemented.' FROM mm WHERE state = 'missing'
UNION ALL SELECT project, 'Relationship not implemented: ' || src || ' --' || relation || '--> ' || dst FROM rl WHERE NOT satisfied
UNION ALL SELECT project, 'Association has no supporting evidence in the code: ' || source || ' --' || relation || '--> ' || target FROM ev WHERE evidence = 'none'""",
    "b24_recommendations": _EVID + """, k AS (SELECT DISTINCT project, CASE state WHEN 'missing' THEN 0 ELSE 1 END AS place FROM elements WHERE state <> 'matched' AND project <> 2
  UNION SELECT DISTINCT project, 2 FROM ev WHERE evidence = 'none' AND project < 2),
a AS (SELECT DISTINCT project FROM elements)
SELECT a.project, CAST(coalesce(place, 3) AS BIGINT) AS place, ['Implement the missing classes, or remove them from the diagram if the design moved on.', 'Add the undocumented classes to the UML model so the diagram stays authoritative.',
  'Give each modelled association a typed field or signature so it is visible in the code.', 'No structural divergence detected by the deterministic checker.'][coalesce(place, 3) + 1] AS recommendation FROM a LEFT JOIN k USING (project)""",
    "b14_reflexion_with_relations": _EVID + """, cr AS (SELECT project, CAST(state = 'matched' AS DOUBLE) AS credit FROM elements WHERE state <> 'extra' UNION ALL SELECT project, CAST(state = 'matched' AS DOUBLE) FROM mm WHERE state <> 'extra'
  UNION ALL SELECT project, CAST(satisfied AS DOUBLE) FROM rl UNION ALL SELECT project, CASE evidence WHEN 'strong' THEN 1.0 WHEN 'weak' THEN 0.5 ELSE 0.0 END FROM ev),
p AS (SELECT project, count(*) AS checks_total, CAST(floor(sum(credit)) AS BIGINT) AS passed FROM cr GROUP BY project),
m AS (SELECT project, count(*) FILTER (state = 'extra') AS x, count(*) FILTER (state = 'missing') AS o FROM (SELECT project, state FROM elements UNION ALL SELECT project, state FROM mm) GROUP BY project),
h AS (SELECT project, count(*) FILTER (ok) AS held, count(*) FILTER (NOT ok) AS broken FROM (SELECT project, satisfied AS ok FROM rl UNION ALL SELECT project, evidence <> 'none' FROM ev) GROUP BY project)
SELECT project, x AS divergences, o + broken AS absences, passed + held AS convergences, checks_total FROM p JOIN m USING (project) JOIN h USING (project)""",
    "h01_round2": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, CAST(printf('%.2f', CAST(l_quantity AS DOUBLE) / 8) AS DOUBLE) AS halves,
  CAST(printf('%.2f', CAST(l_extendedprice AS DOUBLE) / 1000) AS DOUBLE) AS thousands FROM lineitem""",
    "g08_member_sets": cte("members") + """, d AS (SELECT project, element, member FROM members WHERE side = 'design'), c AS (SELECT project, element, member FROM members WHERE side = 'code')
SELECT project, 'missing' AS part, count(*) AS n FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM c) GROUP BY project UNION ALL
SELECT project, 'extra', count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM d) GROUP BY project UNION ALL
SELECT project, 'both', count(*) FROM (SELECT * FROM d INTERSECT SELECT * FROM c) GROUP BY project""",
    "c03_relation_check": cte("snap_edges") + """SELECT d.project, d.src AS source, d.dst AS target, d.relation,
  EXISTS (SELECT 1 FROM snap_edges c WHERE c.version = 1 AND c.relation <> 'extends' AND c.project = d.project AND c.src = d.src AND c.dst = d.dst AND c.relation = d.relation)
  OR EXISTS (SELECT 1 FROM snap_edges u WHERE u.version = 2 AND u.relation = 'extends' AND u.project = d.project AND u.src = d.src AND u.dst = d.dst) AS satisfied
FROM snap_edges d WHERE d.version = 0""",
    "c06_unique_names": cte("definitions") + "SELECT name, CASE WHEN count(DISTINCT def_id) = 1 THEN min(def_id) END AS def_id, count(DISTINCT def_id) AS candidates FROM definitions GROUP BY name",
    "c09_call_resolution": _RESOLVED + "SELECT caller, site, bucket, target FROM resolved",
    "c10_call_edges": _RESOLVED + "SELECT DISTINCT CAST(caller_file AS VARCHAR) AS src, target AS dst, 'calls' AS relation FROM resolved WHERE target IS NOT NULL AND target <> CAST(caller_file AS VARCHAR)",
    "e02_resolution_stats": _RESOLVED + """SELECT caller_file, count(*) FILTER (bucket = 'same_file') AS same_file, count(*) FILTER (bucket = 'unique_global') AS unique_global,
  count(*) FILTER (bucket = 'ambiguous') AS ambiguous, count(*) FILTER (bucket = 'external') AS external, count(*) AS sites,
  count(*) FILTER (bucket IN ('same_file', 'unique_global')) AS resolved, round(count(*) FILTER (bucket IN ('same_file', 'unique_global')) / CAST(count(*) AS DOUBLE), 6) AS rate
FROM resolved GROUP BY caller_file""",
    "c09_call_cascade": _CASCADE + "SELECT site, bucket, target FROM cas",
    "e02_cascade_stats": _CASCADE + "SELECT " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in ("instantiation", "self", "field", "local", "static", "import", "same_file", "unique_global", "ambiguous", "external")) + """,
  count(*) AS sites, count(*) FILTER (bucket NOT IN ('ambiguous', 'external')) AS resolved, round(count(*) FILTER (bucket NOT IN ('ambiguous', 'external')) / CAST(count(*) AS DOUBLE), 6) AS rate FROM cas""",
    "c11_implementation_graph": _CASCADE + """, nodes AS (SELECT DISTINCT 'file' || CAST(file AS VARCHAR) AS node, 'module' AS kind FROM (SELECT file FROM code_classes UNION SELECT file FROM code_functions)
  UNION SELECT class, 'class' FROM code_classes UNION SELECT method_id, 'method' FROM me UNION SELECT function_id, 'function' FROM code_functions),
ed AS (SELECT 'file' || CAST(file AS VARCHAR) AS src, class AS dst, 'contains' AS relation, 1 AS o FROM code_classes UNION ALL SELECT class, method_id, 'contains', 1 FROM me
  UNION ALL SELECT 'file' || CAST(file AS VARCHAR), function_id, 'contains', 1 FROM code_functions UNION ALL SELECT class, 'K' || CAST(k - 1 AS VARCHAR), 'extends', 3 FROM code_classes WHERE k % 4 = 3
  UNION ALL SELECT class, target, CASE WHEN bucket = 'instantiation' THEN 'instantiates' ELSE 'calls' END, 4 FROM cas WHERE class IS NOT NULL AND target IS NOT NULL),
one AS (SELECT src, dst, relation FROM ed WHERE src <> dst AND src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY o DESC, relation DESC) = 1)
SELECT 'node' AS part, kind, node AS src, CAST(NULL AS VARCHAR) AS dst FROM nodes UNION ALL SELECT 'edge', relation, src, dst FROM one""",
    "c12_design_graph_nodes": cte("snap_nodes", "snap_edges") + """, own AS (SELECT DISTINCT project, node, kind, 'uml' AS origin FROM snap_nodes WHERE version = 0 AND kind = 'class'),
ends AS (SELECT project, src AS node FROM snap_edges WHERE version = 0 UNION SELECT project, dst FROM snap_edges WHERE version = 0)
SELECT * FROM own UNION ALL SELECT project, node, 'class', 'uml-implied' FROM ends WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.project = ends.project AND own.node = ends.node)""",
    "c11_single_edges": cte("snap_edges") + "SELECT project, src, dst, arg_max(relation, version) AS relation FROM snap_edges GROUP BY project, src, dst",
    "c13_snapshot_node_diff": _NODES + "SELECT * FROM nd WHERE change <> 'unchanged'",
    "c13_snapshot_edge_diff": _NODES + "SELECT * FROM ed",
    "c14_version_diff": cte("snap_nodes", "snap_edges") + """, o AS (SELECT * FROM snap_nodes WHERE version = 0), n AS (SELECT * FROM snap_nodes WHERE version = 3),
m AS (SELECT coalesce(o.project, n.project) AS project, coalesce(o.node, n.node) AS node, CASE WHEN o.node IS NULL THEN 'added' WHEN n.node IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM o FULL JOIN n ON o.project = n.project AND o.node = n.node WHERE o.node IS NULL OR n.node IS NULL OR o.kind <> n.kind OR o.signature <> n.signature),
p AS (SELECT DISTINCT project, version, src, dst FROM snap_edges),
x AS (SELECT coalesce(a.project, b.project) AS project, a.src IS NULL AS is_new FROM (SELECT * FROM p WHERE version = 0) a FULL JOIN (SELECT * FROM p WHERE version = 3) b
  ON a.project = b.project AND a.src = b.src AND a.dst = b.dst WHERE a.src IS NULL OR b.src IS NULL),
xe AS (SELECT project, count(*) FILTER (is_new) AS ae, count(*) FILTER (NOT is_new) AS re FROM x GROUP BY project),
s AS (SELECT project, version, 100 * CAST(count(*) FILTER (kind = 'class') AS DOUBLE) / count(*) AS score FROM snap_nodes GROUP BY ALL),
k AS (SELECT project, max(score) FILTER (version = 0) AS score_from, max(score) FILTER (version = 3) AS score_to FROM s GROUP BY project),
r AS (SELECT *, row_number() OVER (PARTITION BY project, change ORDER BY node) AS place FROM m),
l AS (SELECT project, count(*) FILTER (change = 'added') AS an, count(*) FILTER (change = 'removed') AS rn, count(*) FILTER (change = 'changed') AS cn,
  string_agg(node, ',' ORDER BY node) FILTER (change = 'added' AND place <= 200) AS la, string_agg(node, ',' ORDER BY node) FILTER (change = 'removed' AND place <= 200) AS lr,
  string_agg(node, ',' ORDER BY node) FILTER (change = 'changed' AND place <= 200) AS lc FROM r GROUP BY project),
q AS (SELECT k.*, score_from IS NOT NULL AND score_to IS NOT NULL AS retained, l.* EXCLUDE (project), ae, re FROM k LEFT JOIN l USING (project) LEFT JOIN xe USING (project))
SELECT project, retained, CASE WHEN retained THEN coalesce(an, 0) END AS added_nodes, CASE WHEN retained THEN coalesce(rn, 0) END AS removed_nodes, CASE WHEN retained THEN coalesce(cn, 0) END AS changed_nodes,
  CASE WHEN retained THEN coalesce(ae, 0) END AS added_edges, CASE WHEN retained THEN coalesce(re, 0) END AS removed_edges,
  CASE WHEN retained THEN coalesce(la, '') END AS added, CASE WHEN retained THEN coalesce(lr, '') END AS removed, CASE WHEN retained THEN coalesce(lc, '') END AS changed,
  CASE WHEN retained THEN round(score_from, 6) END AS score_from, CASE WHEN retained THEN round(score_to, 6) END AS score_to FROM q""",
    "a12_snapshot_store": cte("snap_nodes", "snap_edges") + """, n AS (SELECT project, version, count(DISTINCT node) AS node_count, 100 * CAST(count(*) FILTER (kind = 'class') AS DOUBLE) / count(*) AS score FROM snap_nodes GROUP BY ALL),
e AS (SELECT project, version, count(DISTINCT (src, dst)) AS edge_count FROM snap_edges GROUP BY ALL)
SELECT project, row_number() OVER w AS version, nullif(row_number() OVER w - 1, 0) AS parent_version, node_count, coalesce(edge_count, 0) AS edge_count, round(score, 6) AS score
FROM n LEFT JOIN e USING (project, version) WINDOW w AS (PARTITION BY project ORDER BY version)""",
    "a12_stored_intervals": cte("snap_nodes") + """, v AS (SELECT project, version, row_number() OVER w AS ord, lead(version) OVER w AS next FROM (SELECT DISTINCT project, version FROM snap_nodes) t WINDOW w AS (PARTITION BY project ORDER BY version)),
r AS (SELECT s.*, ord, next, lag(ord) OVER w AS o, lag(kind || '/' || signature) OVER w AS d FROM snap_nodes s JOIN v USING (project, version) WINDOW w AS (PARTITION BY project, node ORDER BY ord)),
i AS (SELECT *, sum(CASE WHEN o = ord - 1 AND d = kind || '/' || signature THEN 0 ELSE 1 END) OVER (PARTITION BY project, node ORDER BY ord) AS run FROM r)
SELECT project, node, min(version) AS valid_from, CASE WHEN bool_or(next IS NULL) THEN NULL ELSE max(next) END AS valid_to FROM i GROUP BY project, node, run""",
    "c16_same_shape": cte("rings") + _SHAPE.replace("WHEN n <= 400 THEN rings = lag(rings) OVER p END", "ELSE rings = lag(rings) OVER p END") + "SELECT project, version, isomorphic FROM shape WHERE version > 0",
    "c17_rename_recovery": "SELECT o_custkey AS project, CAST(1 AS BIGINT) AS version, 'O' || CAST(o_orderkey AS VARCHAR) AS node, 'N' || CAST(o_orderkey AS VARCHAR) AS new_node FROM orders WHERE o_orderkey % 3 = 0",
    "d01_gate_on_shapes": cte("rings") + _SHAPE + """SELECT project, version, g AS gate_strategy, version = 0 OR g = 'structural' OR NOT isomorphic AS fired,
  CASE WHEN version = 0 THEN 'first version' WHEN g = 'isomorphism' AND isomorphic THEN 'same shape' ELSE 'structure changed' END AS reason FROM shape, (SELECT unnest(['structural', 'isomorphism']) AS g)""",
    "c15_impact_set": cte("snap_nodes", "snap_edges") + """, seed AS (SELECT DISTINCT project, version, node FROM snap_nodes WHERE kind = 'class' AND signature = '7'),
b AS (SELECT project, version, src AS a, dst AS z FROM snap_edges UNION SELECT project, version, dst, src FROM snap_edges),
x AS (SELECT project, version, node, 0 AS hops FROM seed UNION ALL SELECT b.project, b.version, z, 1 FROM seed JOIN b ON b.project = seed.project AND b.version = seed.version AND b.a = seed.node)
SELECT project, version, node, CAST(min(hops) AS BIGINT) AS hops FROM x GROUP BY ALL""",
    "c18_edit_distance": _NODES + """, n AS (SELECT project, version, count(*) FILTER (change = 'added') AS added_nodes, count(*) FILTER (change = 'removed') AS removed_nodes, count(*) FILTER (change = 'changed') AS changed_nodes FROM nd GROUP BY ALL),
e AS (SELECT project, version, count(*) FILTER (change = 'added') AS added_edges, count(*) FILTER (change = 'removed') AS removed_edges FROM ed GROUP BY ALL)
SELECT n.*, coalesce(added_edges, 0) AS added_edges, coalesce(removed_edges, 0) AS removed_edges,
  added_nodes + removed_nodes + changed_nodes + coalesce(added_edges, 0) + coalesce(removed_edges, 0) AS edit_distance FROM n LEFT JOIN e USING (project, version)""",
    "c19_annotated_nodes": _M + """, s AS (SELECT project, element, count(*) FILTER (state = 'missing') AS m, count(*) FILTER (state = 'extra') AS x FROM mm GROUP BY ALL),
st AS (SELECT e.project, e.element, state, CASE WHEN m > 0 OR x > 0 THEN 'partial' ELSE 'conforming' END AS q FROM elements e LEFT JOIN s USING (project, element))
SELECT project, CASE WHEN state = 'missing' THEN 'uml::' || element ELSE element END AS node, element AS name, 'class' AS kind,
  CASE state WHEN 'missing' THEN 'missing' WHEN 'extra' THEN 'undocumented' ELSE q END AS conformance FROM st""",
    "c20_grounding": cte("call_sites", "definitions") + """, n AS (SELECT DISTINCT callee FROM call_sites), k AS (SELECT name, arg_min(def_id, CAST(def_id AS BIGINT)) AS hit FROM definitions GROUP BY name)
SELECT 'class::x/' || callee AS node, coalesce(hit, 'llm::class::x/' || callee) AS grounded_as, hit IS NOT NULL AS grounded FROM n LEFT JOIN k ON callee = name""",
    "c21_layer_rules": cte("layer_evidence") + """, r AS (SELECT unnest(['widget', 'red', 'blue']) AS m)
SELECT 'view-layer' AS rule, file_path, string_agg(DISTINCT m, ',' ORDER BY m) AS markers FROM layer_evidence, r WHERE contains(file_path, 'economy') AND contains(evidence, m) GROUP BY file_path""",
    "c25_model_agreement": """WITH r AS (SELECT CAST(p_size AS BIGINT) AS project, p_brand AS model, avg(p_retailprice) AS score, list(DISTINCT p_type) AS gaps, count(*) AS nodes FROM part GROUP BY ALL)
SELECT a.project, a.model, b.model AS other, round(abs(a.score - b.score), 6) AS score_gap,
  round(CAST(len(list_intersect(a.gaps, b.gaps)) AS DOUBLE) / nullif(len(list_distinct(list_concat(a.gaps, b.gaps))), 0), 6) AS overlap, abs(a.nodes - b.nodes) AS node_gap FROM r a JOIN r b ON a.project = b.project AND a.model < b.model""",
    "g05_hub_nodes": _HUBS + "SELECT project, version, node, degree, place FROM h WHERE place <= 10",
    "g05_induced_edges": _HUBS + "SELECT s.* FROM snap_edges s JOIN h a ON a.project = s.project AND a.version = s.version AND a.node = s.src JOIN h b ON b.project = s.project AND b.version = s.version AND b.node = s.dst WHERE a.place <= 60 AND b.place <= 60",
    "g06_layers": cte("snap_nodes", "snap_edges") + """, n AS (SELECT DISTINCT project, version, node, CASE WHEN node LIKE '%7' THEN 2 WHEN node LIKE '%3' THEN 0 END AS told FROM snap_nodes),
t AS (SELECT e.project, e.version, dst AS node, max(coalesce(told, 0)) + 1 AS up FROM snap_edges e JOIN n ON n.project = e.project AND n.version = e.version AND n.node = e.src GROUP BY ALL),
l AS (SELECT n.project, n.version, n.node, coalesce(told, up, 0) AS layer FROM n LEFT JOIN t USING (project, version, node))
SELECT project, version, node, CAST(dense_rank() OVER (PARTITION BY project, version ORDER BY layer) - 1 AS BIGINT) AS layer FROM l""",
    "d01_gate_decisions": _SNAP + "SELECT project, version, gate_strategy, fired, reason FROM decided",
    "d02_chained_previous": cte("doc_versions") + "SELECT project, version, lag(version) OVER (PARTITION BY project ORDER BY version) AS previous FROM doc_versions",
    "d03_reuse_bookkeeping": _SNAP + """SELECT project, version, gate_strategy, last_value(CASE WHEN fired THEN version END IGNORE NULLS) OVER (PARTITION BY project, gate_strategy ORDER BY version ROWS UNBOUNDED PRECEDING) AS served_version,
  CASE WHEN NOT fired THEN previous END AS reused_from FROM decided""",
    "d05_corpus_replay": _SNAP + "SELECT project, gate_strategy, count(*) AS runs, count(*) FILTER (fired) AS fired, count(DISTINCT reason) AS reasons FROM decided GROUP BY ALL",
    "d01_all_policies": cte("history") + _decided("history", "project", "design_hash", "delta_size") + "SELECT project, version, gate_strategy, fired, reason FROM dec",
    "d04_run_rows": _RUN_ROWS + """, CASE WHEN fired THEN tokens ELSE 0 END AS prompt_tokens, CAST(1 AS BIGINT) AS impact_radius, 'none' AS provider FROM dec""",
    "i04_incremental_runs": _RUN_ROWS + " FROM dec",
    "d05_oracle_replay": _REPLAY + "SELECT * FROM rp",
    "d05_misses": _REPLAY + "SELECT project, gate_strategy, version, differing_fields, reason FROM rp WHERE missed_change",
    "d05_findings_by_delta": _FOUND + "SELECT * EXCLUDE (h1, h2, h3) REPLACE (round(score, 6) AS score) FROM an",
    "d05_element_statuses": _FOUND + """SELECT v.project, v.version, de.element, CASE WHEN count(*) FILTER (kind = 'missing_class') > 0 THEN 'absent' WHEN count(*) FILTER (kind = 'missing_member') > 0 THEN 'partial'
  WHEN count(*) FILTER (kind = 'extra_member') > 0 THEN 'divergent' ELSE 'conforming' END AS status
FROM vs v JOIN de USING (project) LEFT JOIN fd ON fd.project = v.project AND fd.version = v.version AND fd.element = de.element GROUP BY ALL""",
    "d05_replay_from_facts": _FOUND + """, sn AS (SELECT an.*, CASE WHEN version % 3 = 0 THEN 'same' ELSE CAST(ms AS VARCHAR) END AS structure_hash, CAST(al AS VARCHAR) AS text_hash, 'd' AS design_hash, 0 AS delta_size, CAST(NULL AS BOOLEAN) AS isomorphic,
  {'a': h1, 'b': h2, 'c': h3, 'd': score} AS truth FROM an JOIN (SELECT project, version, count(*) FILTER (member_kind = 'method') AS ms, count(*) AS al FROM code_history GROUP BY ALL) USING (project, version))
""" + _decided("sn", "project", "design_hash", "delta_size") + """, sv AS (SELECT *, arg_max(truth, version) FILTER (fired) OVER (PARTITION BY project, gate_strategy ORDER BY version ROWS UNBOUNDED PRECEDING) AS served,
  lag(truth) OVER (PARTITION BY project, gate_strategy ORDER BY version) AS was FROM dec),
df AS (SELECT *, concat_ws(',', CASE WHEN truth.a IS DISTINCT FROM served.a THEN 'missing_classes' END, CASE WHEN truth.b IS DISTINCT FROM served.b THEN 'extra_classes' END,
  CASE WHEN truth.c IS DISTINCT FROM served.c THEN 'element_differences' END, CASE WHEN truth.d IS DISTINCT FROM served.d THEN 'score' END) AS differing_fields FROM sv)
SELECT project, version, gate_strategy, fired, reason, differing_fields, differing_fields <> '' AS diverges_from_oracle, differing_fields <> '' AND NOT fired AS missed_change,
  CASE WHEN previous IS NOT NULL THEN was IS DISTINCT FROM truth END AS conformance_changed, CASE WHEN previous IS NOT NULL THEN xm END AS source_touched FROM df""",
    "d04_rows_with_analysis": "WITH base AS (" + _RUN_ROWS + """, fired, k FROM dec), tk AS (""" + _NODES.replace("WITH ", "WITH ", 1) + """, tn AS (SELECT project, version, node FROM nd WHERE change IN ('added', 'changed')),
im AS (SELECT project, version, node FROM tn UNION SELECT t.project, t.version, x.dst FROM tn t JOIN pe x ON x.project = t.project AND x.version = t.version AND x.src = t.node
  UNION SELECT t.project, t.version, x.src FROM tn t JOIN pe x ON x.project = t.project AND x.version = t.version AND x.dst = t.node)
SELECT a.project, a.version, CAST(a.s AS BIGINT) AS all_tokens, CAST(coalesce(b.s, 0) AS BIGINT) AS touched FROM (SELECT project, version, sum(length(node)) AS s FROM snap_nodes GROUP BY ALL) a
  LEFT JOIN (SELECT project, version, sum(length(node)) AS s FROM im GROUP BY ALL) b USING (project, version)),
ana AS (""" + _FOUND + """SELECT project, version - 3 AS version, convergences, divergences, absences, round(score, 6) AS score FROM an)
SELECT base.* EXCLUDE (fired, k), CASE WHEN NOT fired THEN 0 WHEN reason IN ('first version', 'design changed', 'always') OR k = 0 THEN all_tokens ELSE touched END AS counterfactual_prompt_tokens,
  convergences, divergences, absences, score FROM base JOIN tk USING (project, version) LEFT JOIN ana USING (project, version)""",
    "d03_relabelled_gaps": cte("renamed_nodes") + """SELECT a.project, 'isomorphism' AS gate_strategy, b.version, CAST(0 AS BIGINT) AS served_version, a.node, 'lacks a method' AS gap, b.node AS name
FROM renamed_nodes a JOIN renamed_nodes b ON a.project = b.project AND a.ring = b.ring WHERE a.version = 0 AND b.version > 0 AND a.ring % 5 = 0""",
    "b25_scores": "SELECT p_partkey, p_partkey % 11 <> 0 AS readable, CASE WHEN p_partkey % 11 <> 0 THEN CAST(least(100, CASE WHEN p_size % 3 = 0 THEN p_size * 3 ELSE p_size END) AS BIGINT) END AS score FROM part",
    "b25_texts": """SELECT p_partkey, CAST(place AS BIGINT) AS place, text, field FROM part, (SELECT unnest([0, 1]) AS place), (SELECT unnest(['gaps', 'recommendations']) AS field),
  LATERAL (SELECT CASE WHEN field = 'gaps' THEN (CASE WHEN p_size % 2 = 0 THEN (CASE WHEN place = 0 THEN 'one' END) ELSE ['a', 'b'][place + 1] END) WHEN p_size % 4 <> 0 THEN ['r', '7'][place + 1] END AS text) t
WHERE p_partkey % 11 <> 0 AND text IS NOT NULL""",
    "b25_tests": "SELECT p_partkey, CAST(0 AS BIGINT) AS place, 'unknown' AS target_file, 'f' AS framework, 'x = 1' AS code FROM part WHERE p_partkey % 11 <> 0",
    "b25_graph_edges": """SELECT p_partkey, CAST(0 AS BIGINT) AS place, 'A' AS source, 'B' || CAST(p_size % 7 AS VARCHAR) AS target, 'depends_on' AS relation FROM part WHERE p_partkey % 11 <> 0
UNION ALL SELECT p_partkey, 1, 'C', 'A', 'calls' FROM part WHERE p_partkey % 11 <> 0""",
    "b25_graph_nodes": """SELECT p_partkey, 'A' AS id, 'unknown' AS type FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT p_partkey, 'B' || CAST(p_size AS VARCHAR), 'class' FROM part WHERE p_partkey % 11 <> 0
UNION ALL SELECT p_partkey, 'C', 'inferred' FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT p_partkey, 'B' || CAST(p_size % 7 AS VARCHAR), 'inferred' FROM part WHERE p_partkey % 11 <> 0 AND p_size % 7 <> p_size""",
    "a14_file_tree": _TREE + "SELECT * FROM t WHERE place <= 200",
    "a14_totals": _TREE + "SELECT project, count(*) FILTER (type = 'blob') AS files, count(*) FILTER (type = 'tree') AS directories, CAST(sum(size) FILTER (type = 'blob') AS BIGINT) AS bytes FROM t GROUP BY project",
    "e23_overview_with_files": _TREE.replace("WITH ", "WITH " + cte("snap_nodes")[5:] + ", ", 1) + """, v AS (SELECT project, version, 100 * CAST(count(*) FILTER (kind = 'class') AS DOUBLE) / count(*) AS score FROM snap_nodes GROUP BY ALL),
k AS (SELECT project, count(*) AS versions, max(version) AS latest_version, round(arg_max(score, version), 6) AS latest_score, 'v' || CAST(max(version) AS VARCHAR) AS last_analysed FROM v GROUP BY project),
f AS (SELECT project, count(*) FILTER (type = 'blob') AS files, count(*) FILTER (type = 'tree') AS directories, CAST(sum(size) FILTER (type = 'blob') AS BIGINT) AS bytes, count(*) FILTER (path LIKE '%.mdj') > 0 AS d FROM t WHERE project <> 3 GROUP BY project)
SELECT project, coalesce(versions, 0) AS versions, latest_version, latest_score, last_analysed, coalesce(files, 0) AS files, coalesce(directories, 0) AS directories, coalesce(bytes, 0) AS bytes, coalesce(d, false) AS has_design FROM k FULL JOIN f USING (project)""",
    "d07_labelled_deviations": cte("mutations") + _decided("mutations", "mutation", "''", "0") + """, f AS (SELECT mutation, max(divergences) FILTER (version = 0) AS d0, max(divergences) FILTER (version = 1) AS d1, max(absences) FILTER (version = 0) AS a0, max(absences) FILTER (version = 1) AS a1 FROM mutations GROUP BY mutation),
g AS (SELECT mutation, concat_ws(';', CASE WHEN d0 IS DISTINCT FROM d1 THEN 'divergences' END, CASE WHEN a0 IS DISTINCT FROM a1 THEN 'absences' END) AS changed_fields FROM f)
SELECT mutation, category, gate_strategy, fired AS gate_fired, changed_fields <> '' AS findings_changed, changed_fields, fired = expect_structural_change AS gate_correct_on_structure,
  changed_fields <> '' AND NOT fired AS missed_change, changed_fields = '' AND fired AS wasted_reanalysis, reason FROM dec JOIN g USING (mutation) WHERE version = 1""",
    "d06_forced_run": _SNAP + "SELECT project, version, reason FROM decided WHERE gate_strategy = 'always'",
    "b07_project_roll_up": cte("doc_versions") + """, pt AS (
  SELECT project, left(sha256(CAST(doc_id AS VARCHAR)), 3) AS part, sha256('[' || string_agg('{"path":"' || CAST(doc_id AS VARCHAR) || '","hash":"' || text_hash || '"}', ',' ORDER BY CAST(doc_id AS VARCHAR)) || ']') AS digest FROM doc_versions GROUP BY ALL)
SELECT project, sha256('[' || string_agg('{"part":"' || part || '","digest":"' || digest || '"}', ',' ORDER BY part) || ']') AS tree_hash FROM pt GROUP BY project""",
    "b08_source_touched": cte("doc_versions") + "SELECT project, version, lag(text_hash) OVER (PARTITION BY project ORDER BY version) <> text_hash AS source_touched FROM doc_versions",
    "b06_text_fingerprint": cte("doc_versions") + "SELECT doc_id, text_hash, structure_hash FROM doc_versions",
    "b22_token_estimate": _SNAP + """SELECT d.project, gate_strategy, CAST(sum(CASE WHEN fired THEN greatest(1, n_chars // 4) ELSE 0 END) AS BIGINT) AS tokens FROM decided d JOIN doc_versions v ON d.project = v.project AND d.version = v.version GROUP BY ALL""",
    "b23_representation_saving": """SELECT source, raw AS raw_tokens, facts AS fact_tokens, round(100 * (1 - facts / CAST(greatest(raw, 1) AS DOUBLE)), 6) AS saving FROM (
  SELECT source, CAST(sum(greatest(1, n_chars // 4)) AS BIGINT) AS raw, CAST(sum(greatest(1, length(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')) // 4)) AS BIGINT) AS facts FROM documents GROUP BY source)""",
    "b22_payload_tokens": cte("snap_nodes") + """, f AS (SELECT project, version, 'f' || signature AS file_path, length(to_json(struct_pack(file_path := 'f' || signature, classes := list_sort(list(node))))) AS chars FROM snap_nodes GROUP BY project, version, signature),
s AS (SELECT project, version, 12 + sum(chars) + count(*) - 1 AS whole, 12 + coalesce(sum(chars) FILTER (file_path = 'f7'), 0) AS part, bool_or(file_path = 'f7') AND version % 2 = 0 AS reached FROM f GROUP BY project, version)
SELECT project, version, lag(version) OVER w AS previous, version % 3 <> 0 AS fired, version % 3 <> 0 AND reached AND lag(version) OVER w IS NOT NULL AS scoped,
  CAST(CASE WHEN version % 3 = 0 THEN 0 ELSE greatest(1, (CASE WHEN reached AND lag(version) OVER w IS NOT NULL THEN part ELSE whole END) // 4) END AS BIGINT) AS tokens
FROM s WINDOW w AS (PARTITION BY project ORDER BY version)""",
    "b23_fact_tokens": """SELECT source, count(*) AS files, CAST(sum(length(t)) + count(*) - 1 AS BIGINT) // 4 AS raw_tokens, CAST(12 + sum(length(to_json(struct_pack(file_path := doc_id, names := names)))) + count(*) - 1 AS BIGINT) // 4 AS fact_tokens,
  round((1 - fact_tokens / CAST(raw_tokens AS DOUBLE)) * 100, 2) AS saving
FROM (SELECT source, doc_id, coalesce(text, '') AS t, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+'))) AS names FROM documents) GROUP BY source""",
    "f13_version_ring": cte("doc_versions") + "SELECT project, version, doc_id FROM doc_versions QUALIFY row_number() OVER (PARTITION BY project ORDER BY version DESC) <= 3",
    "g02_latest_versions": cte("doc_versions") + "SELECT project, max(version) AS latest, arg_max(doc_id, version) AS doc_id FROM doc_versions GROUP BY project",
    "e23_project_overview": cte("doc_versions") + "SELECT project, count(*) AS versions, max(version) AS latest, arg_max(n_chars, version) AS latest_size, CAST(sum(n_chars) AS BIGINT) AS total_size FROM doc_versions GROUP BY project",
    "b13_run_normalisation": _R + """SELECT CAST(project AS VARCHAR) AS project, commit_id AS commit, commit_index, CASE gate_strategy WHEN 'isomorphism' THEN 'unknown' ELSE gate_strategy END AS gate_strategy, gate_allowed_llm,
  CASE WHEN source_touched THEN missed_change END AS missed_change, CAST(NULL AS BOOLEAN) AS diverges_from_oracle, CAST(NULL AS BOOLEAN) AS conformance_changed, CAST(prompt_tokens + completion_tokens AS DOUBLE) AS tokens,
  0.0::DOUBLE AS counterfactual_tokens, CAST(NULL AS BOOLEAN) AS source_touched, '' AS provenance, 0.0::DOUBLE AS latency_ms, 0.0::DOUBLE AS changed_nodes, CAST(NULL AS DOUBLE) AS similarity,
  CASE WHEN commit_index > 0 THEN CAST(divergences AS DOUBLE) END AS divergences, CAST(NULL AS DOUBLE) AS absences, findings_hash, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS provider,
  CAST(NULL AS VARCHAR) AS llm_mode, 0.5::DOUBLE AS temperature, '7' AS seed, CAST(NULL AS VARCHAR) AS association_scoring, CAST(NULL AS VARCHAR) AS impact_radius, CAST(NULL AS VARCHAR) AS degraded FROM runs""",
    "e03_ledger_metrics": _CALLED + """, a AS (SELECT project, count(*) AS n, count(*) FILTER (gate_allowed_llm) AS ra, count(*) FILTER (called) AS lc, CAST(sum(prompt_tokens) AS BIGINT) AS p, CAST(sum(completion_tokens) AS BIGINT) AS c,
  coalesce(avg(prompt_tokens) FILTER (called), 0) * count(*) AS bp, coalesce(avg(completion_tokens) FILTER (called), 0) * count(*) AS bc, coalesce(avg(latency_ms) FILTER (called), 0) AS ml,
  coalesce(avg(latency_ms) FILTER (NOT gate_allowed_llm), 0) AS mc, count(score) AS s, CASE WHEN count(score) >= 2 THEN var_pop(score) END AS v FROM r GROUP BY project)
SELECT project, n AS total_runs, ra AS reanalyses, lc AS llm_calls, n - ra AS cached_runs, p AS prompt_tokens, c AS completion_tokens, round(ml, 6) AS mean_latency_ms_llm, round(mc, 6) AS mean_latency_ms_cached,
  s AS scored_runs, round(v, 6) AS score_variance, round((n - ra) / CAST(n AS DOUBLE), 6) AS cache_hit_rate, p + c AS total_tokens, CAST(floor(bp + bc) AS BIGINT) AS baseline_total_tokens,
  greatest(0, CAST(floor(bp + bc) AS BIGINT) - p - c) AS tokens_saved, round((p * 5.0 + c * 15.0) / 1e6, 6) AS actual_cost_usd, round((bp * 5.0 + bc * 15.0) / 1e6, 6) AS baseline_cost_usd,
  round(greatest(0.0, (bp * 5.0 + bc * 15.0) / 1e6 - (p * 5.0 + c * 15.0) / 1e6), 6) AS cost_saved_usd, round(greatest(0.0, (ml - mc) * (n - ra)), 6) AS latency_saved_ms FROM a""",
    "e04_by_strategy": _CALLED + "SELECT gate_strategy, count(*) AS runs, count(*) FILTER (gate_allowed_llm) AS reanalyses, count(*) FILTER (called) AS llm_calls FROM r GROUP BY gate_strategy",
    "e17_confused_commits": _R + """SELECT gate_strategy, CASE WHEN gate_allowed_llm THEN 'wasted' ELSE 'missed' END AS outcome, commit_id AS id FROM runs
WHERE gate_allowed_llm <> conformance_changed""",
    "e05_score_variance": _R + "SELECT project, round(CASE WHEN count(latency_ms) >= 2 THEN var_pop(latency_ms) END, 6) AS variance FROM runs GROUP BY project",
    "e06_describe_latency": _R + """SELECT gate_strategy, count(latency_ms) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS median, round(avg(latency_ms), 6) AS mean, round(min(latency_ms), 6) AS min,
  round(max(latency_ms), 6) AS max, round(sum(latency_ms), 6) AS total FROM runs GROUP BY gate_strategy""",
    "e08_wilson_intervals": _R + f", g AS (SELECT project, gate_strategy, {_COUNTS} FROM runs GROUP BY ALL) SELECT project, gate_strategy, rate, r_low AS low, r_high AS high FROM (SELECT *, {_rate('skipped', 'runs', 'rate')}, {_wilson('skipped', 'runs', 'r')} FROM g)",
    "e09_exact_paired_test": _R + """, p AS (SELECT a.project, NOT a.gate_allowed_llm AS a, NOT b.gate_allowed_llm AS b FROM runs a JOIN runs b ON a.project = b.project AND a.commit_id = b.commit_id WHERE a.gate_strategy = 'structural' AND b.gate_strategy = 'isomorphism'),
c AS (SELECT project, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, count(*) FILTER (a = b) AS agreed FROM p GROUP BY project),
t AS (SELECT *, a_only + b_only AS discordant FROM c)
SELECT *, round(CASE WHEN discordant = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(discordant + 1) - lgamma(k + 1) - lgamma(discordant - k + 1) - discordant * ln(2.0))) FROM range(0, least(a_only, b_only) + 1) r(k))) END, 6) AS p,
  discordant >= 6 AS usable FROM t""",
    "e10_study_table": _R + "SELECT count(DISTINCT project) AS projects, count(DISTINCT (project, commit_id)) AS commits, count(*) AS runs, count(DISTINCT gate_strategy) AS gates, bool_or(missed_change IS NOT NULL) AS has_oracle FROM runs",
    "e11_gate_table": _GATE_ROWS + "SELECT * REPLACE (round(median_latency_ms, 6) AS median_latency_ms) FROM t",
    "e12_baseline_choice": _R + f", g AS (SELECT gate_strategy, {_COUNTS} FROM runs WHERE gate_strategy <> 'always' GROUP BY gate_strategy) SELECT gate_strategy AS baseline_gate, tokens AS baseline_tokens FROM g ORDER BY tokens DESC, {_RANK} LIMIT 1",
    "e13_recommendation": _GATE_ROWS + f"SELECT gate_strategy AS recommended, skip_rate FROM t WHERE gate_strategy <> baseline_gate AND checked > 0 ORDER BY missed > 0, skip_rate DESC, {_RANK} LIMIT 1",
    "e14_project_table": _R + f""", g AS (SELECT project, gate_strategy, {_COUNTS} FROM runs GROUP BY ALL), k AS (SELECT project, string_agg(gate_strategy, '>' ORDER BY skipped / CAST(runs AS DOUBLE) DESC, {_RANK}) AS ranking FROM g GROUP BY project)
SELECT m.project, m.runs, m.skipped, m.missed, m.tokens, {_rate('m.skipped', 'm.runs', 'skip_rate')}, a.tokens AS always_tokens, c.commits, ranking, a.tokens - m.tokens AS saved_tokens
FROM g m JOIN g a ON a.project = m.project AND a.gate_strategy = 'always' JOIN (SELECT project, count(DISTINCT commit_id) AS commits FROM runs GROUP BY project) c ON c.project = m.project JOIN k ON k.project = m.project WHERE m.gate_strategy = 'structural'""",
    "e14_project_report": _UNEVEN + """SELECT project, 'structural' AS gate, commits, runs, skipped, round(skipped / CAST(runs AS DOUBLE), 6) AS skip_rate, CASE WHEN checked > 0 THEN missed END AS missed, CAST(always - tokens AS DOUBLE) AS tokens_saved,
  round(drift, 6) AS drift_per_commit, round(ms, 6) AS median_similarity, split_part(gate_ranking, ' > ', 1) AS best_gate, gate_ranking, runs >= 10 AS enough_runs FROM rep""",
    "e14_project_agreement": _UNEVEN + """SELECT count(DISTINCT gate_ranking) = 1 AS consistent_ranking, round(min(skipped / CAST(runs AS DOUBLE)), 6) AS lowest_skip_rate, round(max(skipped / CAST(runs AS DOUBLE)), 6) AS highest_skip_rate, count(*) AS projects FROM rep""",
    "a10_merged_elements": cte("element_status") + "SELECT project, element, commit_index, CASE WHEN commit_index < 6 THEN status ELSE upper(status) END AS status FROM element_status",
    "e15_project_gate_cells": _R + f""", q AS (SELECT * FROM runs WHERE NOT (project = 1 AND gate_strategy = 'content')), g AS (SELECT project, gate_strategy, {_COUNTS} FROM q GROUP BY ALL),
cells AS (SELECT * FROM (SELECT DISTINCT project FROM q), (SELECT DISTINCT gate_strategy FROM q))
SELECT project, gate_strategy, coalesce(runs, 0) AS runs, coalesce(skipped, 0) AS skipped, coalesce(missed, 0) AS missed, {_rate('skipped', 'runs', 'skip_rate')} FROM cells LEFT JOIN g USING (project, gate_strategy)""",
    "e16_configuration": _R + """, l AS (SELECT DISTINCT 'gate_strategy' AS setting, gate_strategy AS v FROM runs UNION SELECT 'completion_tokens', CAST(completion_tokens AS VARCHAR) FROM runs UNION SELECT 'project', CAST(project AS VARCHAR) FROM runs)
SELECT setting, string_agg(v, ',' ORDER BY v) AS found, count(*) <= 1 AS consistent FROM l GROUP BY setting""",
    "e16_study_settings": _R + """SELECT 'llm_mode' AS setting, 'offline' AS found, true AS consistent UNION ALL SELECT 'model', string_agg(DISTINCT CASE WHEN project = 4 THEN 'm2' ELSE 'm1' END, ',' ORDER BY CASE WHEN project = 4 THEN 'm2' ELSE 'm1' END), false FROM runs
UNION ALL SELECT 'temperature', '0.0', true UNION ALL SELECT 'seed', '7', true FROM runs GROUP BY ALL HAVING bool_or(commit_index > 5) UNION ALL SELECT 'degraded', CAST(count(*) AS VARCHAR), false FROM runs WHERE latency_ms > 400 HAVING count(*) > 0""",
    "c19_annotated_edges": cte("snap_nodes", "snap_edges") + """, n AS (SELECT project, node FROM snap_nodes WHERE version = 2), c AS (SELECT * FROM snap_edges WHERE version = 2),
d AS (SELECT e.* FROM snap_edges e JOIN n a ON a.project = e.project AND a.node = e.src JOIN n b ON b.project = e.project AND b.node = e.dst WHERE version = 1)
SELECT project, src, dst, relation, 'code' AS origin FROM c UNION ALL SELECT project, src, dst, relation, 'uml' FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project = d.project AND c.src = d.src AND c.dst = d.dst)""",
    "c20_merged_edges": _GROUND + """, i AS (SELECT DISTINCT e.project, a.g AS src, b.g AS dst FROM snap_edges e JOIN gr a ON a.project = e.project AND a.node = 'x/' || e.src JOIN gr b ON b.project = e.project AND b.node = e.dst WHERE version = 1 AND a.g <> b.g)
SELECT coalesce(k.project, i.project) AS project, coalesce(k.src, i.src) AS src, coalesce(k.dst, i.dst) AS dst, coalesce(k.relation, 'uses') AS relation, CASE WHEN k.src IS NULL THEN 'model' ELSE 'code' END AS origin,
  k.src IS NOT NULL AND i.src IS NOT NULL AS confirmed FROM (SELECT project, src, dst, relation FROM snap_edges WHERE version = 0) k FULL JOIN i ON k.project = i.project AND k.src = i.src AND k.dst = i.dst""",
    "c20_grounded_ratio": _GROUND + "SELECT project, count(*) AS inferred, count(*) FILTER (g NOT LIKE 'llm::%') AS grounded, round(count(*) FILTER (g NOT LIKE 'llm::%') / CAST(count(*) AS DOUBLE), 6) AS ratio FROM gr GROUP BY project",
    "e17_confusion_matrix": _GATES + f"SELECT gate_strategy, tp, fn, fp, tn, {_rate('tp', '(tp + fp)', 'precision')}, {_rate('tp', '(tp + fn)', 'recall')} FROM g",
    "e19_replay_summary": _R + """, s AS (SELECT gate_strategy, count(*) AS runs, count(*) FILTER (gate_allowed_llm) AS reanalyses, round(count(*) FILTER (NOT gate_allowed_llm) / CAST(count(*) AS DOUBLE), 6) AS reuse_rate,
  round(count(*) FILTER (missed_change) / CAST(count(missed_change) AS DOUBLE), 6) AS miss_rate, round(avg(latency_ms), 6) AS mean_latency_ms,
  round(avg(commit_index % 50) FILTER (gate_allowed_llm), 6) AS mean_impact_nodes FROM runs GROUP BY gate_strategy)
SELECT *, round(reanalyses / CAST((SELECT max(reanalyses) FROM s WHERE gate_strategy = 'always') AS DOUBLE), 6) AS share_of_always FROM s""",
    "e20_spread": _R + "SELECT project, gate_strategy, round(avg(latency_ms), 6) AS mean, round(coalesce(stddev_samp(latency_ms), 0.0), 6) AS stdev, round(min(latency_ms), 6) AS min, round(max(latency_ms), 6) AS max, round(max(latency_ms) - min(latency_ms), 6) AS range FROM runs GROUP BY ALL",
    "e21_corpus_totals": _R + f""", o AS (SELECT project, commit_index, bool_or(source_touched) AS t, bool_or(conformance_changed) AS c FROM runs GROUP BY ALL), j AS (SELECT *, commit_index > min(commit_index) OVER (PARTITION BY project) AS later FROM o),
s AS (SELECT project, count(*) AS commits, count(*) FILTER (later) AS judged, count(*) FILTER (later AND t) AS touched, count(*) FILTER (later AND c) AS changed FROM j GROUP BY GROUPING SETS ((project), ()))
SELECT project, commits, judged, touched, changed, touched_rate, changed_rate, w_low AS low, w_high AS high FROM (SELECT *, {_rate('touched', 'judged', 'touched_rate')}, {_rate('changed', 'judged', 'changed_rate')}, {_wilson('changed', 'judged', 'w')} FROM s)""",
    "e22_design_screening": cte("members") + "SELECT project, count(DISTINCT element) AS elements, count(*) FILTER (member_kind = 'attribute') AS attributes, count(*) FILTER (member_kind = 'method') AS methods FROM members WHERE side = 'design' GROUP BY project",
    "c22_serving_as_of": _SERVED + "SELECT project, gate_strategy, commit_index, served_hash, diverges_from_oracle, missed_change FROM served",
    "c23_paired_gates": _R + "SELECT a.project, a.commit_id, NOT a.gate_allowed_llm AS a, NOT b.gate_allowed_llm AS b FROM runs a JOIN runs b ON a.project = b.project AND a.commit_id = b.commit_id WHERE a.gate_strategy = 'content' AND b.gate_strategy = 'structural'",
    "c24_dominance": _GATE_ROWS + """, x AS (SELECT a.gate_strategy, a.skip_rate, a.recall_rate, b.gate_strategy AS o, (b.skip_low > a.skip_high OR b.recall_low > a.recall_high) AS apart FROM t a LEFT JOIN t b ON b.recall_rate IS NOT NULL AND a.gate_strategy <> b.gate_strategy
  AND b.skip_rate >= a.skip_rate AND b.recall_rate >= a.recall_rate AND (b.skip_rate > a.skip_rate OR b.recall_rate > a.recall_rate) WHERE a.recall_rate IS NOT NULL)
SELECT gate_strategy, skip_rate, recall_rate, coalesce(string_agg(o, ',' ORDER BY o), '') AS dominated_by, coalesce(string_agg(o, ',' ORDER BY o) FILTER (apart), '') AS robustly_dominated_by, count(o) = 0 AS on_frontier FROM x GROUP BY ALL""",
    "f01_conformance_changed": _R + "SELECT project, commit_index, lag(findings_hash) OVER (PARTITION BY project ORDER BY commit_index) <> findings_hash AS changed FROM runs WHERE gate_strategy = 'always'",
    "f02_label_inference": _R + """, g AS (SELECT project, gate_strategy, commit_index, CASE WHEN source_touched THEN conformance_changed END AS c, CASE WHEN commit_index % 3 <> 0 THEN findings_hash END AS h FROM runs),
k AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY project, gate_strategy ORDER BY commit_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM g), f AS (SELECT *, CASE WHEN p IS NOT NULL AND h IS NOT NULL THEN p <> h END AS guess FROM k)
SELECT project, gate_strategy, count(*) FILTER (c IS NULL AND guess IS NOT NULL) AS filled, count(*) FILTER (coalesce(c, guess)) AS changed, count(coalesce(c, guess)) AS labelled FROM f GROUP BY ALL""",
    "f03_trajectories": _POINTS + "SELECT * FROM pts",
    "f04_drift_direction": _POINTS + """, m AS (SELECT *, divergences - lag(divergences) OVER w AS dd, absences - lag(absences) OVER w AS da FROM pts WINDOW w AS (PARTITION BY project ORDER BY commit_index)),
s AS (SELECT project, count(*) AS points, arg_max(divergences, commit_index) - arg_min(divergences, commit_index) AS nd, arg_max(absences, commit_index) - arg_min(absences, commit_index) AS na,
  greatest(1, max(commit_index) - min(commit_index)) AS span, count(*) FILTER (dd + da > 0) AS eroding, count(*) FILTER (dd + da < 0) AS repairing, count(*) FILTER (dd IS NOT NULL AND source_touched) AS touched FROM m GROUP BY project)
SELECT project, points, nd AS net_divergences, na AS net_absences, span, eroding, repairing, touched, CASE WHEN nd = 0 AND na = 0 THEN 'stable' WHEN nd > 0 AND nd >= greatest(na, 0) THEN 'divergence-led' WHEN na > 0 THEN 'absence-led' ELSE 'converging' END AS label,
  round((nd + na) / CAST(span AS DOUBLE), 6) AS per_commit, round((nd + na) / CAST(nullif(touched, 0) AS DOUBLE), 6) AS per_touching FROM s WHERE points >= 2""",
    "f05_drift_rate": _R + """SELECT project, CASE WHEN count(*) >= 2 THEN round((max(divergences + absences) FILTER (commit_index = hi) - max(divergences + absences) FILTER (commit_index = lo)) / CAST(greatest(1, any_value(hi) - any_value(lo)) AS DOUBLE), 6) END AS drift_rate
FROM (SELECT *, max(commit_index) OVER (PARTITION BY project) AS hi, min(commit_index) OVER (PARTITION BY project) AS lo FROM runs) GROUP BY project""",
    "f06_drift_series": _POINTS + "SELECT project, commit_index, divergences + absences AS drift FROM pts QUALIFY count(*) OVER (PARTITION BY project) >= 2",
    "f07_kaplan_meier": _OBS + _curve("project") + "SELECT project, time, at_risk, events, round(survival, 6) AS survival FROM curve",
    "f08_km_quantile": _OBS + _curve("project") + "SELECT project, min(time) FILTER (survival <= 0.8 + 1e-12) AS quantile FROM curve GROUP BY project",
    "f09_element_survival": _OBS + _curve("project") + """, s AS (SELECT project, count(*) FILTER (NOT at_freeze) AS at_risk, count(*) FILTER (at_freeze) AS deviating_at_freeze, count(*) FILTER (NOT at_freeze AND event) AS events, max(last) + 1 AS "window" FROM obs GROUP BY project),
e AS (SELECT project, min(survival) AS e, min(time) FILTER (survival <= 0.5 + 1e-12) AS half_life FROM curve GROUP BY project)
SELECT s.*, half_life, round(coalesce(e, CASE WHEN at_risk > 0 THEN 1.0 END), 6) AS survival_at_end, CASE WHEN half_life IS NULL THEN "window" - 1 END AS censored_beyond FROM s LEFT JOIN e USING (project)""",
    "f10_pooled_survival": _OBS + _curve("") + """SELECT (SELECT count(*) FROM obs WHERE NOT at_freeze) AS at_risk, (SELECT count(*) FROM obs WHERE at_freeze) AS deviating_at_freeze, (SELECT count(*) FROM obs WHERE NOT at_freeze AND event) AS events,
  (SELECT max(last) + 1 FROM obs) AS "window", min(time) FILTER (survival <= 0.5 + 1e-12) AS half_life, round(coalesce(min(survival), CASE WHEN (SELECT count(*) FROM obs WHERE NOT at_freeze) > 0 THEN 1.0 END), 6) AS survival_at_end,
  CASE WHEN min(time) FILTER (survival <= 0.5 + 1e-12) IS NULL THEN (SELECT max(last) FROM obs) END AS censored_beyond FROM curve""",
    "f11_recovery_horizons": _HORIZON + "SELECT * FROM horizons",
    "f12_median_horizon": _HORIZON + """, tot AS (SELECT gate_strategy, count(*) AS total, count(horizon) AS resolved, max(horizon) AS longest FROM horizons GROUP BY ALL),
ev AS (SELECT gate_strategy, horizon, count(*) AS n FROM horizons WHERE horizon IS NOT NULL GROUP BY ALL),
ar AS (SELECT ev.*, total - coalesce(sum(n) OVER (PARTITION BY gate_strategy ORDER BY horizon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_risk FROM ev JOIN tot USING (gate_strategy)),
sv AS (SELECT gate_strategy, horizon, product(1 - n / CAST(at_risk AS DOUBLE)) OVER (PARTITION BY gate_strategy ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS s FROM ar),
h AS (SELECT gate_strategy, min(horizon) FILTER (s <= 0.5 + 1e-12) AS median FROM sv GROUP BY ALL)
SELECT gate_strategy, total, resolved, median, CASE WHEN median IS NULL THEN coalesce(longest, 0) END AS censored_beyond FROM tot LEFT JOIN h USING (gate_strategy)""",
    "f14_run_ordinals": _R + "SELECT project, gate_strategy, commit_index, row_number() OVER (PARTITION BY project, gate_strategy ORDER BY commit_index) AS ordinal FROM runs",
    "c26_mainline_history": cte("commits").replace("WITH", "WITH RECURSIVE", 1) + """, tips AS (SELECT project, max(sha) AS sha FROM commits GROUP BY project),
line AS (SELECT project, sha, CAST(0 AS BIGINT) AS depth FROM tips UNION ALL SELECT l.project, c.parent0, depth + 1 FROM line l JOIN commits c ON c.project = l.project AND c.sha = l.sha WHERE c.parent0 IS NOT NULL) SELECT * FROM line""",
    "c26_newest_plain_commits": cte("commits") + "SELECT project, sha, row_number() OVER (PARTITION BY project ORDER BY committed_at DESC, sha DESC) AS place FROM commits WHERE parent1 IS NULL QUALIFY place <= 25",
    "c27_diagram_staleness": _STALE + f"SELECT *, {_VERDICT} AS verdict FROM stale",
    "g03_stale_diagrams": _STALE + f"SELECT project, diagram, stale_commits FROM stale WHERE {_VERDICT} = 'candidate'",
    "g01_gate_order": _R + f"SELECT DISTINCT gate_strategy, CAST({_RANK} AS BIGINT) AS place FROM runs",
    "b02_type_heads": "SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 'Map' ELSE split_part(p_type, ' ', 1) END AS head FROM part",
    "b03_callee_split": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'self.' || split_part(p_name, ' ', 1) END AS receiver, CASE WHEN p_size % 2 = 0 THEN 'save' END AS name FROM part",
    "b18_module_keys": _PATHS + r""", s AS (SELECT path, str_split(regexp_replace(path, '\.[A-Za-z]+$', ''), '/') AS p FROM paths), k AS (SELECT path, path AS k FROM s UNION SELECT path, array_to_string(p[i:], '/') FROM s, range(1, 3) r(i) UNION SELECT path, array_to_string(p[i:], '.') FROM s, range(1, 3) r(i))
SELECT path, string_agg(k, ',' ORDER BY k) AS keys FROM k GROUP BY path""",
    "b19_import_strings": _PATHS + r"SELECT path, regexp_replace(path, '\.py$', '') AS module FROM paths",
    "h07_languages": _PATHS + "SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' END AS language, 'module::' || path AS node FROM paths",
    "b26_staleness_verdicts": cte("commit_files") + f", s AS (SELECT project, CAST(week(committed_on) AS BIGINT) AS week, count(*) AS stale_commits, count(DISTINCT CASE WHEN path LIKE '%.py' THEN path END) AS code_files_changed_since FROM commit_files GROUP BY ALL) SELECT project, week, {_VERDICT} AS verdict FROM s",
    "b01_field_normalisation": """SELECT l_orderkey AS class, 'f' || CAST(l_partkey % 3 AS VARCHAR) AS name, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS type, CAST(l_linenumber AS BIGINT) AS pos FROM lineitem
QUALIFY row_number() OVER (PARTITION BY class, name ORDER BY type IS NULL, l_linenumber, type) = 1""",
    "b04_call_lists": cte("call_sites") + """, r AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY site, callee) AS k FROM call_sites)
SELECT caller, count(*) AS kept, string_agg(DISTINCT callee, ',' ORDER BY callee) AS calls FROM r WHERE k <= 96 GROUP BY caller""",
    "b20_impact_scope": _PATHS + "SELECT path AS file_path FROM paths WHERE path IN (SELECT path FROM commit_files WHERE project = 1)",
    "b21_evaluability": cte("commit_files") + """, s AS (SELECT project, committed_on, count(*) FILTER (path LIKE '%.mdj') AS d, count(*) FILTER (path LIKE '%.py') AS c, count(*) FILTER (path LIKE '%.md') > 2 AS u FROM commit_files GROUP BY ALL),
i AS (SELECT *, list_filter([CASE WHEN d = 0 THEN 'no design' END, CASE WHEN c = 0 THEN 'no classes in code' END, CASE WHEN u THEN 'unsupported languages' END], lambda x: x IS NOT NULL) AS l FROM s)
SELECT project, CAST(committed_on AS VARCHAR) AS day, array_to_string(l, ',') AS issues, CASE WHEN len(l) = 0 THEN 50.0 END AS score FROM i""",
    "b25_output_coercion": """SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CAST(least(100, p_size * 3) AS BIGINT) END AS score,
  CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_size % 2 = 0 THEN 'one' ELSE 'a,b' END AS gaps, p_partkey % 7 <> 0 AS readable FROM part""",
    "c05_symbol_tables": "SELECT p_brand AS class, split_part(p_name, ' ', 1) AS method, min(p_partkey) AS method_id, count(*) AS candidates FROM part GROUP BY ALL",
    "c07_inherited_methods": """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size FROM part), m AS (SELECT k AS class, 'm' || CAST(p_size % 8 AS VARCHAR) AS name FROM p WHERE p_size % 4 = 0),
n AS (SELECT k AS c FROM p), l AS (SELECT c, c AS a, 0 AS d FROM n UNION ALL SELECT c, a // 2, d + 1 FROM l WHERE d < 4 AND a // 2 > 0 AND EXISTS (SELECT 1 FROM p WHERE p.k = l.a))
SELECT l.c AS class, name, arg_min(m.class, d) AS method_id FROM l JOIN m ON m.class = l.a GROUP BY ALL""",
    "c08_import_bindings": _PATHS + """SELECT DISTINCT 'f' || CAST(project AS VARCHAR) AS file, replace(split_part(path, '/', 2), '.py', '') AS symbol, path AS target FROM commit_files WHERE path LIKE 'src/%'""",
    "e18_controlled_tests": _R + f"""SELECT gate_strategy, kind, tp, fn, fp, tn, {_rate('tp', '(tp + fp)', 'precision')}, {_rate('tp', '(tp + fn)', 'recall')} FROM (
  SELECT gate_strategy, CASE WHEN source_touched THEN 'touched' ELSE 'untouched' END AS kind, {_COUNTS} FROM runs GROUP BY ALL)""",
    "a06_active_designs": cte("commit_files") + "SELECT project, arg_min(path, list_extract(str_split(path, '/'), -1)) AS path FROM commit_files GROUP BY project",
    "a10_merged_results": _R + """, q AS (SELECT project, gate_strategy, commit_index, conformance_changed FROM runs WHERE project <> 3 UNION ALL SELECT project, gate_strategy, commit_index, NULL FROM runs WHERE project = 3
  UNION ALL SELECT project, gate_strategy, commit_index, conformance_changed FROM runs WHERE project = 2 AND commit_index < 5)
SELECT 'repeated' AS conflict, count(*) AS n FROM (SELECT 1 FROM q GROUP BY project, gate_strategy, commit_index HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'rows', count(*) FROM q""",
    "a13_report_tables": _GATES.replace("WITH ", "WITH ", 1) + """, pt AS (SELECT project, commit_index FROM runs GROUP BY ALL),
n AS (SELECT count(DISTINCT gate_strategy) AS g, count(DISTINCT project) AS p, count(*) AS r FROM runs)
SELECT 'table1-what-was-studied' AS "table", CAST(5 AS BIGINT) AS rows UNION ALL SELECT 'table2-gate-performance', g FROM n UNION ALL SELECT 'table3-per-project', p FROM n
UNION ALL SELECT 'table3b-per-project-per-gate', g * p FROM n UNION ALL SELECT 'table4-controlled-test', g FROM n UNION ALL SELECT 'study-configuration', 1 UNION ALL SELECT 'comparison-mcnemar', 1
UNION ALL SELECT 'figure3-pareto', count(*) FROM g WHERE tp + fn > 0 UNION ALL SELECT 'figure2-drift', count(*) FROM pt WHERE project IN (SELECT project FROM pt GROUP BY project HAVING count(*) >= 2)
UNION ALL SELECT 'raw-runs', r FROM n""",
    "a13_report_projects": _GATE_ROWS + f""", q AS (SELECT gate_strategy AS gate FROM t WHERE gate_strategy <> baseline_gate AND checked > 0 ORDER BY missed > 0, skip_rate DESC, {_RANK} LIMIT 1),
x AS (SELECT project, gate_strategy, {_COUNTS}, count(DISTINCT commit_id) AS commits FROM runs GROUP BY ALL),
k AS (SELECT project, string_agg(gate_strategy, ' > ' ORDER BY skipped / CAST(runs AS DOUBLE) DESC, {_RANK}) AS gate_ranking FROM x GROUP BY project),
d AS (SELECT project, (arg_max(divergences + absences, commit_index) - arg_min(divergences + absences, commit_index)) / CAST(greatest(1, max(commit_index) - min(commit_index)) AS DOUBLE) AS drift, count(*) AS c FROM runs GROUP BY project),
m AS (SELECT project, quantile_cont(CASE WHEN gate_allowed_llm AND commit_index % 4 <> 0 THEN CAST(100 - divergences % 40 AS DOUBLE) END, 0.5) AS ms FROM runs GROUP BY project)
SELECT x.project, gate, commits, x.runs, x.skipped, round(x.skipped / CAST(x.runs AS DOUBLE), 6) AS skip_rate, x.missed, a.tokens - x.tokens AS tokens_saved, round(drift, 6) AS drift_per_commit, round(ms, 6) AS median_similarity,
  split_part(gate_ranking, ' > ', 1) AS best_gate, gate_ranking
FROM x JOIN q ON x.gate_strategy = gate JOIN (SELECT project, tokens FROM x WHERE gate_strategy = 'always') a USING (project) JOIN k USING (project) JOIN d USING (project) JOIN m USING (project)""",
    "a15_changed_files": cte("commit_files") + "SELECT DISTINCT project, path FROM commit_files WHERE path LIKE 'src/%' OR path LIKE 'docs/%'",
    "i01_streaming_gate": """WITH s AS (SELECT source AS project, doc_id AS version, sha256(text) AS x, sha256(replace(replace(text, chr(10), ''), ' ', '')) AS t FROM documents),
m AS (SELECT project, version, lag(x) OVER w IS DISTINCT FROM x AS xm, lag(t) OVER w IS DISTINCT FROM t AS tm FROM s WINDOW w AS (PARTITION BY project ORDER BY version))
SELECT project, version, g AS gate_strategy, CASE g WHEN 'always' THEN true WHEN 'content' THEN xm ELSE tm END AS fired, false AS late FROM m, (SELECT unnest(['always', 'content', 'structural']) AS g)""",
    "i02_streaming_metrics": "SELECT user_id % 5 AS project, event_type AS gate_strategy, count(*) AS runs, count(*) FILTER (value > 20) AS reanalyses, CAST(sum(floor(value) + 1) AS BIGINT) AS tokens FROM events GROUP BY ALL",
    "i03_streaming_changed_files": "SELECT DISTINCT user_id % 5 AS project, 'src/' || CAST(user_id AS VARCHAR) || '.py' AS path FROM events WHERE event_type <> 'view'",
}
