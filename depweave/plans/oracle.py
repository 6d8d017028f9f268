"""For every query of the catalog, the same question as plain SQL over the given tables.

The statements share named table expressions; ``_sql`` puts those a statement needs before it.
They are written independently of the operators: closures by recursive SQL, PageRank round by
round, percentiles by window position.
"""

from __future__ import annotations

import re

from depweave.functions.tokens import STOP_WORDS
from depweave.plans.catalog import REQUEST_TEXT, SEARCH_TEXT, SYMBOL_TEXT
from depweave.sources.derived import JAVA, PYTHON, SCRIPT

CTE: dict[str, str] = {}

# --- the part graph --------------------------------------------------------------------------

CTE["f"] = """
SELECT p_partkey AS id,
       lower(p_type) || '/' ||
       CASE p_partkey % 8 WHEN 0 THEN 'api' WHEN 1 THEN 'models' WHEN 2 THEN 'tests'
                          WHEN 3 THEN 'config' WHEN 4 THEN 'routes' ELSE 'core' END ||
       '/m' || CAST(p_partkey - p_partkey % 8 AS VARCHAR) ||
       CASE WHEN p_partkey % 8 = 2 THEN '.test' ELSE '' END ||
       CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.py' ELSE '.java' END AS path,
       CASE p_partkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'javascript'
                          WHEN 2 THEN 'python' ELSE 'java' END AS lang,
       p_size * 10 AS loc,
       CAST(p_partkey % 18 AS INT) AS n_exports, p_size % 45 AS n_functions,
       CAST(p_partkey % 8 AS INT) AS n_classes, NULL::TIMESTAMP AS day
FROM part
UNION ALL SELECT -8 * k - kind, path, lang, CAST(k % 60 AS INT) * 10, CAST(k % 18 AS INT), CAST(k % 45 AS INT), CAST(k % 8 AS INT), day FROM (
  SELECT o_orderkey AS k, 1 AS kind, 'orders/' || regexp_replace(lower(o_orderpriority[3:]), '[^a-z]+', '_', 'g') || '/o' || o_orderkey ||
         CASE WHEN o_orderstatus = 'P' THEN '.test' ELSE '' END || '.ts' AS path, 'typescript' AS lang, o_orderdate AS day FROM orders
  UNION ALL SELECT c_custkey, 2, 'customers/' || regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g') || '/c' || c_custkey || '.py', 'python', NULL FROM customer
  UNION ALL SELECT s_suppkey, 3, 'suppliers/n' || s_nationkey || '/s' || s_suppkey || '.java', 'java', NULL FROM supplier
  UNION ALL SELECT n_nationkey, 4, 'nations/' || regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') || '/index.js', 'javascript', NULL FROM nation
  UNION ALL SELECT r_regionkey, 5, 'regions/' || regexp_replace(lower(r_name), '[^a-z0-9]+', '_', 'g') || '/index.ts', 'typescript', NULL FROM region)"""


def _keys(where: str) -> str:
    """Imports by every key of the tables, over the orders of a period."""
    return f"""
SELECT DISTINCT src, dst FROM (
  SELECT -8 * o_orderkey - 1 AS src, -8 * o_custkey - 2 AS dst FROM orders WHERE {where}
  UNION ALL SELECT -8 * o_orderkey - 1, -8 * lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 FROM orders WHERE {where}
  UNION ALL SELECT -8 * o_custkey - 2, -8 * arg_max(o_orderkey, (o_orderdate, o_orderkey)) - 1 FROM orders WHERE {where} GROUP BY o_custkey
  UNION ALL SELECT -8 * l_orderkey - 1, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {where}
  UNION ALL SELECT -8 * l_orderkey - 1, -8 * l_suppkey - 3 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {where}
  UNION ALL SELECT -8 * c_custkey - 2, -8 * c_nationkey - 4 FROM customer
  UNION ALL SELECT -8 * s_suppkey - 3, -8 * s_nationkey - 4 FROM supplier
  UNION ALL SELECT -8 * n_nationkey - 4, -8 * n_regionkey - 5 FROM nation
  UNION ALL SELECT -8 * n_regionkey - 5, -8 * n_nationkey - 4 FROM nation)
WHERE dst IS NOT NULL"""


CTE["e"] = _keys("true")

CTE["deg"] = """
SELECT f.*, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree,
       coalesce(i.n, 0) + coalesce(o.n, 0) AS degree
FROM f LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = f.id
       LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON o.src = f.id"""

CTE["ep"] = """
SELECT e.src, e.dst, a.path AS from_path, b.path AS to_path
FROM e JOIN f a ON a.id = e.src JOIN f b ON b.id = e.dst"""

CTE["hub"] = "SELECT id, path FROM deg ORDER BY in_degree DESC, path LIMIT 1"

# Shortest distance of every pair: only pairs that are new to a round go on to the next.
CTE["walk"] = """
SELECT src, dst, 1 FROM e
UNION
SELECT w.s, e.dst, min(w.d + 1) FROM walk w JOIN e ON e.src = w.t
LEFT JOIN recurring.walk k ON k.s = w.s AND k.t = e.dst WHERE k.s IS NULL GROUP BY w.s, e.dst"""

CTE["pairs"] = "SELECT s, t, d AS hop FROM walk WHERE s <> t"

# Distance of everything that depends on the hub.
CTE["hubwalk"] = """
SELECT id, 0 FROM hub
UNION
SELECT e.src, min(w.d + 1) FROM hubwalk w JOIN e ON e.dst = w.id
LEFT JOIN recurring.hubwalk k ON k.id = e.src WHERE k.id IS NULL GROUP BY e.src"""

CTE["comp"] = """
SELECT a.s AS id, least(a.s, min(a.t)) AS comp
FROM pairs a JOIN pairs b ON a.s = b.t AND a.t = b.s GROUP BY a.s"""

CTE["cyc"] = """
SELECT comp, count(*) AS length, min(path) AS first_file,
       CASE WHEN count(*) <= 2 THEN 'low' WHEN count(*) <= 4 THEN 'medium' ELSE 'high' END AS severity,
       sum(('0x' || md5(path)[1:13])::BIGINT) || '/' || sum(('0x' || md5(path)[14:26])::BIGINT) AS sig
FROM comp JOIN f USING (id) GROUP BY comp"""

CTE["links_out"] = "SELECT src, count(*) AS n FROM e GROUP BY src"

CTE["rank_rounds"] = """
SELECT 0 AS it, id, 1.0::DOUBLE / (SELECT count(*) FROM f) AS r FROM f
UNION ALL
SELECT p.it + 1, p.id,
       0.15 / (SELECT count(*) FROM f)
       + 0.85 * (coalesce(m.w, 0) + l.lost / (SELECT count(*) FROM f))
FROM rank_rounds p
LEFT JOIN (SELECT e.dst, sum(q.r / o.n) AS w FROM rank_rounds q JOIN e ON e.src = q.id
           JOIN links_out o ON o.src = q.id GROUP BY e.dst) m ON m.dst = p.id
CROSS JOIN (SELECT coalesce(sum(q.r), 0) AS lost FROM rank_rounds q
            WHERE q.id NOT IN (SELECT src FROM links_out)) l
WHERE p.it < 40"""

CTE["pr"] = "SELECT id, r FROM rank_rounds WHERE it = 40"

CTE["norm"] = """
SELECT d.id, d.path, d.in_degree, d.out_degree, d.loc, d.n_exports, pr.r,
       d.in_degree / greatest(1, max(d.in_degree) OVER ()) AS n_in,
       pr.r / greatest(1e-9, max(pr.r) OVER ()) AS n_pr,
       d.out_degree / greatest(1, max(d.out_degree) OVER ()) AS n_out,
       d.loc / greatest(1, max(d.loc) OVER ()) AS n_loc,
       d.n_exports / greatest(1, max(d.n_exports) OVER ()) AS n_exp
FROM deg d JOIN pr USING (id)"""

CTE["hot"] = """
SELECT id, path, in_degree, out_degree, loc, n_exports, r, raw,
       CAST(floor(round(raw, 9) + 0.5) AS BIGINT) AS score,
       CASE WHEN why = '' THEN 'elevated combined risk' ELSE why END AS reasons
FROM (SELECT *, 100.0 * (n_in * 0.30 + n_pr * 0.25 + n_out * 0.15 + n_loc * 0.15 + n_exp * 0.15) AS raw,
             concat_ws('; ', CASE WHEN n_in >= 0.5 THEN 'many dependents' END,
                             CASE WHEN n_pr >= 0.5 THEN 'high centrality' END,
                             CASE WHEN n_out >= 0.5 THEN 'many dependencies' END,
                             CASE WHEN n_loc >= 0.5 THEN 'large file' END,
                             CASE WHEN n_exp >= 0.5 THEN 'wide public API' END) AS why
      FROM norm)"""

CTE["top10"] = "SELECT * FROM hot WHERE score > 0 ORDER BY score DESC, path LIMIT 10"

CTE["god"] = """
SELECT path, in_degree, concat_ws('; ', a, b, c, d, x) AS reasons
FROM (SELECT path, in_degree,
             CASE WHEN loc > 300 THEN loc || ' LOC (> 300)' END AS a,
             CASE WHEN n_functions > 20 THEN n_functions || ' functions (> 20)' END AS b,
             CASE WHEN n_classes > 6 THEN n_classes || ' classes (> 6)' END AS c,
             CASE WHEN n_exports > 15 THEN n_exports || ' exports (> 15)' END AS d,
             CASE WHEN in_degree > 20 THEN in_degree || ' dependents (> 20)' END AS x
      FROM deg)
WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT
      + (x IS NOT NULL)::INT >= 2"""

IS_TEST = (
    "(regexp_matches({p}, '(^|/)[^/]*(\\.test\\.|\\.spec\\.|_test\\.|_spec\\.)[^/]*$')"
    " OR regexp_matches({p}, '(^|/)(test|tests|__tests__)/.*'))"
)
IS_ENTRY = (
    "(regexp_matches({p}, '(^|/)(main|index|cli|app|server)\\.[^/]*$') OR regexp_matches({p}, '(^|/)__init__\\.py$')"
    " OR regexp_matches({p}, '(^|/)[^/]*(\\.test\\.|\\.spec\\.|_test\\.)[^/]*$') OR regexp_matches({p}, '^tests?/'))"
)
BASE = "regexp_extract({p}, '[^/]*$')"
STEM = (
    "regexp_replace(regexp_replace(regexp_replace(" + BASE + ", '\\.[^.]*$', ''), '\\.(test|spec)$', ''), '_(test|spec)$', '')"
)
KIND = (
    "CASE WHEN regexp_matches(" + BASE + ", '^(main|index|cli|app|server|__main__)\\.[^.]+$') THEN 'main'"
    " WHEN regexp_matches({p}, '(^|/)pages/') THEN 'page/route' WHEN regexp_matches({p}, '(^|/)routes?/') THEN 'route'"
    " WHEN regexp_matches({p}, '(^|/)api/') THEN 'api route'"
    " WHEN regexp_matches({p}, '(^|/)(handlers?|controllers?)/') THEN 'handler'"
    " WHEN regexp_matches(" + BASE + ", '^(setup|conftest)\\.[^.]+$') THEN 'entry' END"
)


def _p(template: str, column: str = "path") -> str:
    return template.replace("{p}", column)


CTE["unused"] = f"""
SELECT path, concat_ws('; ', 'no dependents', CASE WHEN n_exports = 0 THEN 'no exports' END,
                       CASE WHEN out_degree = 0 THEN 'no imports' END, 'unreachable from entry points') AS reasons
FROM deg WHERE in_degree = 0 AND NOT {_p(IS_ENTRY)}"""

CTE["layered"] = """
SELECT from_path, to_path, string_split(from_path, '/')[1] AS a, string_split(to_path, '/')[1] AS b FROM ep"""

CTE["layer_hits"] = """
SELECT from_path AS "from", to_path AS "to", a AS from_layer, b AS to_layer, a || ' cannot import ' || b AS rule
FROM layered WHERE (a = 'orders' AND b IN ('promo', 'large')) OR (a = 'customers' AND b = 'orders') OR (a = 'regions' AND b = 'nations')"""

CTE["banned"] = """
SELECT from_path AS file, to_path, from_path || ' must not import ' || to_path AS detail FROM ep
WHERE regexp_matches(from_path, '^[^/]*/low/.*$') AND regexp_matches(to_path, '^[^/]*/tests/.*$')
UNION ALL
SELECT from_path, to_path, 'tests stay away from the suppliers' FROM ep
WHERE regexp_matches(from_path, '^orders/(.*/)?[^/]*\\.test\\.ts$') AND regexp_matches(to_path, '^suppliers/n1[^/]*/[^/]*\\.java$')"""

CTE["depths"] = "SELECT s AS id, max(hop) AS depth FROM pairs GROUP BY s"

CTE["limits"] = """
SELECT 'maxImports' AS rule, 'warning' AS severity, path AS file, out_degree || ' imports (> 25)' AS detail
FROM deg WHERE out_degree > 25
UNION ALL SELECT 'maxFanIn', 'warning', path, in_degree || ' dependents (> 30)' FROM deg WHERE in_degree > 30
UNION ALL SELECT 'maxCoupling', 'warning', path, 'coupling ' || degree || ' (> 45)' FROM deg WHERE degree > 45
UNION ALL SELECT 'maxFunctionCount', 'warning', path, n_functions || ' functions (> 40)' FROM deg WHERE n_functions > 40
UNION ALL SELECT 'maxFileSize', 'warning', path, loc || ' LOC (> 500)' FROM deg WHERE loc > 500
UNION ALL SELECT 'maxDependencyDepth', 'warning', path, 'dependency depth ' || depth || ' (> 10)'
FROM depths JOIN f USING (id) WHERE depth > 10
UNION ALL SELECT 'noCircularDependencies', 'error', first_file, 'cycle (' || severity || '): ' || length || ' files from ' || first_file || ', signature ' || sig FROM cyc"""

CTE["broken"] = """
SELECT * FROM limits
UNION ALL SELECT 'forbiddenImport', 'error', file, detail FROM banned
UNION ALL SELECT 'layerViolation', 'error', "from", rule || ': ' || "from" || ' → ' || "to" FROM layer_hits"""


def _score(x: str) -> str:
    return f"greatest(0, least(100, CAST(floor(round({x}, 9) + 0.5) AS BIGINT)))"


def _health(counts: str) -> str:
    """Health over a table with one row of counts (and any key columns)."""
    return f"""
SELECT h3.*, {_score("0.25 * maintainability + 0.2 * modularity + 0.2 * coupling + 0.2 * stability + 0.15 * complexity - least(30, errors * 3)")} AS overall
FROM (SELECT h2.*, {_score("0.4 * complexity + 0.3 * (100 - hotspot_mean) + 0.3 * (100 - least(100, errors * 8 + warnings * 2))")} AS maintainability
FROM (SELECT h1.*,
  {_score("100 - cycle_files / files * 100 - hotspot_mean * 0.3")} AS stability,
  {_score("100 - greatest(0, 2 * edges / files - 2) * 14")} AS coupling,
  {_score("100 - greatest(0, loc_mean - 120) / 8 - greatest(0, functions_mean - 6) * 3 - god_modules / files * 200")} AS complexity,
  {_score("100 - cycle_files / files * 150 - unused / files * 80 - CASE WHEN cycles > 0 THEN 8 ELSE 0 END")} AS modularity
FROM ({counts}) h1) h2) h3"""


GRADE = "CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 55 THEN 'D' ELSE 'F' END"
HEALTH_COLUMNS = f"""overall, {GRADE} AS grade, maintainability, stability, modularity, coupling, complexity,
  files, edges, round(2 * edges / files, 2) AS avg_degree, cycles, cycle_files, god_modules, unused,
  CAST(floor(round(hotspot_mean, 9) + 0.5) AS BIGINT) AS hotspot_avg,
  CAST(floor(round(loc_mean, 9) + 0.5) AS BIGINT) AS avg_loc, round(functions_mean, 1) AS avg_functions, errors, warnings"""

CTE["health"] = _health("""
SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM e) AS edges,
       (SELECT avg(loc) FROM f) AS loc_mean, (SELECT avg(n_functions) FROM f) AS functions_mean,
       (SELECT count(*) FROM cyc) AS cycles, (SELECT count(*) FROM comp) AS cycle_files,
       (SELECT count(*) FROM god) AS god_modules, (SELECT count(*) FROM unused) AS unused,
       (SELECT coalesce(avg(score), 0) FROM top10) AS hotspot_mean,
       (SELECT count(*) FROM limits WHERE severity = 'error') AS errors,
       (SELECT count(*) FROM limits WHERE severity = 'warning') AS warnings""")

CTE["kinds"] = f"""
SELECT id, path, {_p(IS_TEST)} AS test, {_p(KIND)} AS kind, {_p(STEM)} AS stem FROM f"""

CTE["named"] = """
SELECT a.id AS target, b.id, b.path FROM kinds a JOIN kinds b ON a.stem = b.stem AND a.id <> b.id WHERE b.test"""

CTE["hubhits"] = "SELECT hub.id AS target, k.*, w.d AS hop FROM hubwalk w JOIN kinds k USING (id) CROSS JOIN hub WHERE w.d > 0"

CTE["hubtests"] = """
SELECT target, id, path, 'import' AS via FROM hubhits WHERE test
UNION ALL
SELECT n.target, n.id, n.path, 'naming' FROM named n JOIN hub ON hub.id = n.target
WHERE n.id NOT IN (SELECT id FROM hubhits WHERE test)"""

CTE["far"] = "SELECT id, d FROM hubwalk WHERE d > 0 ORDER BY d DESC, id LIMIT 1"

# Distances from the farthest file, and the way to it from the hub by the smallest file one step nearer.
CTE["farwalk"] = """
SELECT id, 0 FROM far
UNION
SELECT e.dst, min(w.d + 1) FROM farwalk w JOIN e ON e.src = w.id
LEFT JOIN recurring.farwalk k ON k.id = e.dst WHERE k.id IS NULL GROUP BY e.dst"""

CTE["farway"] = """
SELECT hub.id, far.d FROM hub CROSS JOIN far
UNION ALL
SELECT min(e.src), c.d - 1 FROM farway c JOIN e ON e.dst = c.id JOIN farwalk w ON w.id = e.src AND w.d = c.d - 1 GROUP BY c.d"""

CTE["hits"] = "SELECT p.t AS target, p.hop, k.* FROM pairs p JOIN kinds k ON k.id = p.s"

CTE["tests_of"] = """
SELECT target, id, path, 'import' AS via FROM hits WHERE test
UNION ALL
SELECT n.target, n.id, n.path, 'naming' FROM named n
WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.test AND h.target = n.target AND h.id = n.id)"""

CTE["blast"] = """
SELECT *, CASE WHEN affected = 0 THEN 0.0 ELSE
  100.0 * (0.35 * sqrt(affected / (SELECT count(*) FROM f)) + 0.15 * least(1.0, max_hop / 6) + 0.2 * least(1.0, entries / 5)
  + 0.1 * least(1.0, tests / 8) + 0.1 * (r / (SELECT max(r) FROM pr)) + 0.1 * in_cycle::INT) END AS raw
FROM (SELECT f.id, f.path, coalesce(a.n, 0) AS affected, coalesce(a.direct, 0) AS direct, coalesce(a.max_hop, 0) AS max_hop,
             coalesce(t.n, 0) AS tests, coalesce(a.entries, 0) AS entries, f.id IN (SELECT id FROM comp) AS in_cycle, pr.r
      FROM f JOIN pr USING (id)
      LEFT JOIN (SELECT target, count(*) AS n, count(*) FILTER (hop = 1) AS direct, max(hop) AS max_hop,
                        count(kind) AS entries FROM hits GROUP BY target) a ON a.target = f.id
      LEFT JOIN (SELECT target, count(*) AS n FROM tests_of GROUP BY target) t ON t.target = f.id)"""

# --- change log ------------------------------------------------------------------------------

CTE["ch"] = """
SELECT event_id AS commit_id, event_type || '/f' || regexp_extract(props, '[0-9]+', 0) AS path,
       CAST(user_id AS VARCHAR) AS author, ts,
       CAST(floor(value) AS BIGINT) AS insertions, event_id % 7 AS deletions
FROM events"""

CTE["st"] = """
SELECT path, count(*) AS commits, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions,
       count(DISTINCT author) AS authors, min(ts) AS first_date, max(ts) AS last_date,
       CAST(sum(insertions) + sum(deletions) AS BIGINT) AS churn
FROM ch GROUP BY path"""

CTE["dirs"] = """
SELECT string_split(path, '/')[1] AS module, CAST(sum(churn) AS BIGINT) AS churn, count(*) AS files, min(first_date) AS oldest,
       count(*) FILTER (first_date >= (SELECT first_date FROM
         (SELECT first_date, row_number() OVER (ORDER BY first_date) - 1 AS k, count(*) OVER () AS n FROM st)
         WHERE k = floor(n * 0.7) )) AS recent_files
FROM st GROUP BY module"""

# --- two revisions ---------------------------------------------------------------------------

PERIODS = {"base": "o_orderdate < TIMESTAMP '1998-07-01'", "head": "o_orderdate >= TIMESTAMP '1998-01-01'"}

CTE["re"] = " UNION ALL ".join(f"SELECT '{rev}' AS rev, * FROM ({_keys(where)})" for rev, where in PERIODS.items())

CTE["rf"] = " UNION ALL ".join(
    f"SELECT '{rev}' AS rev, * FROM f WHERE day IS NULL OR {where.replace('o_orderdate', 'day')}" for rev, where in PERIODS.items()
)

CTE["revs"] = "SELECT rev, count(*) AS n FROM rf GROUP BY rev"

CTE["rdeg"] = """
SELECT rf.*, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree,
       coalesce(i.n, 0) + coalesce(o.n, 0) AS degree
FROM rf
LEFT JOIN (SELECT rev, dst, count(*) AS n FROM re GROUP BY ALL) i ON i.rev = rf.rev AND i.dst = rf.id
LEFT JOIN (SELECT rev, src, count(*) AS n FROM re GROUP BY ALL) o ON o.rev = rf.rev AND o.src = rf.id"""

CTE["rwalk"] = """
SELECT rev, src, dst, 1 FROM re
UNION
SELECT w.rev, w.s, re.dst, min(w.d + 1) FROM rwalk w JOIN re ON re.rev = w.rev AND re.src = w.t
LEFT JOIN recurring.rwalk k ON k.rev = w.rev AND k.s = w.s AND k.t = re.dst WHERE k.s IS NULL GROUP BY w.rev, w.s, re.dst"""

CTE["rpairs"] = "SELECT rev, s, t, d AS hop FROM rwalk WHERE s <> t"

CTE["rcomp"] = """
SELECT a.rev, a.s AS id, least(a.s, min(a.t)) AS comp
FROM rpairs a JOIN rpairs b ON a.rev = b.rev AND a.s = b.t AND a.t = b.s GROUP BY a.rev, a.s"""

CTE["rcyc"] = """
SELECT rev, comp, count(*) AS length, min(path) AS first_file,
       CASE WHEN count(*) <= 2 THEN 'low' WHEN count(*) <= 4 THEN 'medium' ELSE 'high' END AS severity,
       sum(('0x' || md5(path)[1:13])::BIGINT) || '/' || sum(('0x' || md5(path)[14:26])::BIGINT) AS sig
FROM rcomp JOIN f USING (id) GROUP BY rev, comp"""

CTE["rout"] = "SELECT rev, src, count(*) AS n FROM re GROUP BY ALL"

CTE["rrounds"] = """
SELECT 0 AS it, rev, id, 1.0::DOUBLE / n AS r FROM rf JOIN revs USING (rev)
UNION ALL
SELECT p.it + 1, p.rev, p.id, 0.15 / v.n + 0.85 * (coalesce(m.w, 0) + coalesce(l.lost, 0) / v.n)
FROM rrounds p JOIN revs v ON v.rev = p.rev
LEFT JOIN (SELECT q.rev, re.dst, sum(q.r / o.n) AS w FROM rrounds q JOIN re ON re.rev = q.rev AND re.src = q.id
           JOIN rout o ON o.rev = q.rev AND o.src = q.id GROUP BY ALL) m ON m.rev = p.rev AND m.dst = p.id
LEFT JOIN (SELECT q.rev, sum(q.r) AS lost FROM rrounds q ANTI JOIN rout o ON o.rev = q.rev AND o.src = q.id
           GROUP BY ALL) l ON l.rev = p.rev
WHERE p.it < 40"""

CTE["rhot"] = """
SELECT rev, path, CAST(floor(round(100.0 * (n_in * 0.30 + n_pr * 0.25 + n_out * 0.15 + n_loc * 0.15 + n_exp * 0.15), 9) + 0.5) AS BIGINT) AS score
FROM (SELECT d.rev, d.path,
        d.in_degree / greatest(1, max(d.in_degree) OVER (PARTITION BY d.rev)) AS n_in,
        p.r / greatest(1e-9, max(p.r) OVER (PARTITION BY d.rev)) AS n_pr,
        d.out_degree / greatest(1, max(d.out_degree) OVER (PARTITION BY d.rev)) AS n_out,
        d.loc / greatest(1, max(d.loc) OVER (PARTITION BY d.rev)) AS n_loc,
        d.n_exports / greatest(1, max(d.n_exports) OVER (PARTITION BY d.rev)) AS n_exp
      FROM rdeg d JOIN rrounds p ON p.it = 40 AND p.rev = d.rev AND p.id = d.id)"""

CTE["rtop"] = """
SELECT rev, path, score FROM rhot WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY rev ORDER BY score DESC, path) <= 10"""

CTE["rlimits"] = """
SELECT rev, 'maxImports' AS rule, 'warning' AS severity, path AS file, out_degree || ' imports (> 25)' AS detail
FROM rdeg WHERE out_degree > 25
UNION ALL SELECT rev, 'maxFanIn', 'warning', path, in_degree || ' dependents (> 30)' FROM rdeg WHERE in_degree > 30
UNION ALL SELECT rev, 'maxCoupling', 'warning', path, 'coupling ' || degree || ' (> 45)' FROM rdeg WHERE degree > 45
UNION ALL SELECT rev, 'maxFunctionCount', 'warning', path, n_functions || ' functions (> 40)' FROM rdeg WHERE n_functions > 40
UNION ALL SELECT rev, 'maxFileSize', 'warning', path, loc || ' LOC (> 500)' FROM rdeg WHERE loc > 500
UNION ALL SELECT rev, 'maxDependencyDepth', 'warning', path, 'dependency depth ' || max(hop) || ' (> 10)'
FROM rpairs JOIN f ON f.id = rpairs.s GROUP BY rev, path HAVING max(hop) > 10
UNION ALL SELECT rev, 'noCircularDependencies', 'error', first_file, 'cycle (' || severity || '): ' || length || ' files from ' || first_file || ', signature ' || sig FROM rcyc"""

CTE["rgod"] = CTE["god"].replace("SELECT path, in_degree, concat_ws", "SELECT rev, path, in_degree, concat_ws").replace(
    "FROM (SELECT path, in_degree,", "FROM (SELECT rev, path, in_degree,").replace("FROM deg)", "FROM rdeg)")

CTE["rhealth"] = _health(f"""
SELECT r.rev, r.n AS files, (SELECT count(*) FROM re WHERE re.rev = r.rev) AS edges,
       (SELECT avg(loc) FROM rf WHERE rf.rev = r.rev) AS loc_mean, (SELECT avg(n_functions) FROM rf WHERE rf.rev = r.rev) AS functions_mean,
       (SELECT count(*) FROM rcyc c WHERE c.rev = r.rev) AS cycles,
       (SELECT count(*) FROM rcomp c WHERE c.rev = r.rev) AS cycle_files,
       (SELECT count(*) FROM rgod g WHERE g.rev = r.rev) AS god_modules,
       (SELECT count(*) FROM rdeg d WHERE d.rev = r.rev AND in_degree = 0 AND NOT {_p(IS_ENTRY)}) AS unused,
       (SELECT coalesce(avg(score), 0) FROM rtop t WHERE t.rev = r.rev) AS hotspot_mean,
       (SELECT count(*) FROM rlimits v WHERE v.rev = r.rev AND severity = 'error') AS errors,
       (SELECT count(*) FROM rlimits v WHERE v.rev = r.rev AND severity = 'warning') AS warnings
FROM revs r""")

CTE["rnamed"] = """
SELECT re.rev, a.path AS "from", b.path AS "to" FROM re JOIN f a ON a.id = re.src JOIN f b ON b.id = re.dst"""

CTE["dep_changes"] = """
SELECT CASE WHEN min(rev) = 'head' THEN 'added' ELSE 'removed' END AS change, "from", "to"
FROM rnamed GROUP BY "from", "to" HAVING count(*) = 1"""


def _cycle_changes(base: str, head: str) -> str:
    one = """SELECT '{change}' AS change, c.first_file, f.path FROM rcyc c
      JOIN rcomp m ON m.rev = c.rev AND m.comp = c.comp JOIN f ON f.id = m.id
      WHERE c.rev = '{here}' AND c.sig NOT IN (SELECT sig FROM rcyc WHERE rev = '{there}')"""
    new = one.format(change="new", here=head, there=base)
    return new + "\nUNION ALL\n" + one.format(change="resolved", here=base, there=head)


CTE["hot_sides"] = """
SELECT path, coalesce(max(score) FILTER (rev = 'base'), 0) AS before, coalesce(max(score) FILTER (rev = 'head'), 0) AS after
FROM rhot GROUP BY path"""

CTE["deg_sides"] = """
SELECT path, coalesce(CAST(sum(degree) FILTER (rev = 'base') AS BIGINT), 0) AS before, coalesce(CAST(sum(degree) FILTER (rev = 'head') AS BIGINT), 0) AS after
FROM rdeg GROUP BY path"""

CTE["module_sides"] = """
SELECT string_split(path, '/')[1] AS module, coalesce(CAST(sum(degree) FILTER (rev = 'base') AS BIGINT), 0) AS before,
       coalesce(CAST(sum(degree) FILTER (rev = 'head') AS BIGINT), 0) AS after
FROM rdeg GROUP BY module"""

# --- derived source texts --------------------------------------------------------------------

CTE["p"] = """
SELECT f.id, f.path, f.lang, p_name AS name, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand,
       f.id - f.id % 8 + 8 AS near, f.id + 8 AS prior, string_split(f.path, '/')[1] AS kind,
       string_split(f.path, '/')[2] AS folder
FROM f JOIN part ON p_partkey = f.id"""

CTE["sy"] = """
SELECT *, 'sym:' || path || '#' || kind || ':' || name || '@' || line AS id FROM (
SELECT path, lang, 'f' || id AS name, 'function' AS kind, 4 AS line, true AS exported, NULL AS parent, '' AS ext, NULL AS doc
FROM p WHERE lang IN ('typescript', 'javascript')
UNION ALL SELECT path, lang, 'g' || id, 'variable', 5, false, NULL, '', NULL FROM p WHERE lang IN ('typescript', 'javascript')
UNION ALL SELECT path, lang, 'C' || id, 'class', 6, true, NULL, CASE lang WHEN 'typescript' THEN 'C' || prior ELSE '' END, NULL
FROM p WHERE lang IN ('typescript', 'javascript')
UNION ALL SELECT path, lang, 'h' || id, 'method', 7, false, 'C' || id, '', NULL FROM p WHERE lang IN ('typescript', 'javascript')
UNION ALL SELECT path, lang, 'f' || id, 'function', 5, true, NULL, '', 'Makes ' || name || '.' FROM p WHERE lang = 'python'
UNION ALL SELECT path, lang, '_g' || id, 'variable', 9, false, NULL, '', NULL FROM p WHERE lang = 'python'
UNION ALL SELECT path, lang, 'C' || id, 'class', 11, true, NULL, 'C' || prior, NULL FROM p WHERE lang = 'python'
UNION ALL SELECT path, lang, 'h' || id, 'method', 12, true, 'C' || id, '', NULL FROM p WHERE lang = 'python'
UNION ALL SELECT path, lang, 'C' || id, 'class', 5, true, NULL, 'C' || prior, NULL FROM p WHERE lang = 'java'
UNION ALL SELECT path, lang, 'g' || id, 'variable', 6, false, 'C' || id, '', NULL FROM p WHERE lang = 'java'
UNION ALL SELECT path, lang, 'h' || id, 'method', 7, true, 'C' || id, '', NULL FROM p WHERE lang = 'java')"""

CTE["im"] = """
SELECT i.path, i.raw, i.line, t.path AS resolved, t.path IS NULL AS external FROM (
SELECT path, './m' || near AS raw, 2 AS line, kind || '/' || folder || '/m' || near AS base, lang FROM p
WHERE lang IN ('typescript', 'javascript')
UNION ALL SELECT path, brand, 3, NULL, lang FROM p WHERE lang IN ('typescript', 'javascript')
UNION ALL SELECT path, brand, 2, brand, lang FROM p WHERE lang = 'python'
UNION ALL SELECT path, '.m' || near, 3, kind || '/' || folder || '/m' || near, lang FROM p WHERE lang = 'python'
UNION ALL SELECT path, kind || '.' || folder || '.m' || near, 3, kind || '/' || folder || '/m' || near, lang FROM p WHERE lang = 'java'
UNION ALL SELECT path, 'java.util.' || brand, 4, NULL, lang FROM p WHERE lang = 'java') i
LEFT JOIN p t ON (i.lang IN ('typescript', 'javascript') AND t.path IN (i.base || '.ts', i.base || '.js'))
  OR (i.lang = 'python' AND t.path = i.base || '.py') OR (i.lang = 'java' AND t.path = i.base || '.java')"""



def _filled(template: str) -> str:
    text = "'" + template.replace("'", "''") + "'"
    for gap, column in (("name", "name"), ("near", "near"), ("brand", "brand"), ("key", "id"), ("prior", "prior"), ("kind", "kind"), ("folder", "folder")):
        text = f"replace({text}, '{{{gap}}}', CAST({column} AS VARCHAR))"
    return text


CTE["src_text"] = f"""
SELECT path, lang, CASE lang WHEN 'python' THEN {_filled(PYTHON)} WHEN 'java' THEN {_filled(JAVA)} ELSE {_filled(SCRIPT)} END AS text
FROM p"""

CTE["dirs_of"] = """
SELECT DISTINCT kind AS dir, '' AS parent FROM p
UNION ALL SELECT DISTINCT kind || '/' || folder, kind FROM p"""

CTE["uniq"] = "SELECT name, min(id) AS target FROM sy WHERE kind = 'class' GROUP BY name HAVING count(*) = 1"

CTE["cn"] = """
SELECT 'repo:parts' AS id, 'Repository' AS type, 'parts' AS name, '' AS path, NULL AS language, NULL::INT AS loc, NULL::INT AS line, NULL::BOOLEAN AS exported, NULL::BOOLEAN AS external
UNION ALL SELECT 'dir:' || dir, 'Directory', regexp_extract(dir, '[^/]*$'), dir, NULL, NULL, NULL, NULL, NULL FROM dirs_of
UNION ALL SELECT 'file:' || path, 'File', regexp_extract(path, '[^/]*$'), path, lang,
  CASE lang WHEN 'python' THEN 14 ELSE 9 END, NULL, NULL, NULL FROM p
UNION ALL SELECT id, upper(kind[1]) || kind[2:], name, path, lang, NULL, line, exported, NULL FROM sy
UNION ALL SELECT DISTINCT 'pkg:' || raw, 'Package', raw, NULL, NULL, NULL::INT, NULL::INT, NULL::BOOLEAN, true FROM im WHERE external"""

CTE["ce"] = """
SELECT DISTINCT type || ':' || source || '->' || target AS id, type, source, target FROM (
SELECT 'CONTAINS' AS type, CASE parent WHEN '' THEN 'repo:parts' ELSE 'dir:' || parent END AS source, 'dir:' || dir AS target FROM dirs_of
UNION ALL SELECT 'CONTAINS', 'dir:' || kind || '/' || folder, 'file:' || path FROM p
UNION ALL SELECT 'CONTAINS', o.id, m.id FROM sy m JOIN sy o ON o.path = m.path AND o.name = m.parent
UNION ALL SELECT 'DECLARES', 'file:' || path, id FROM sy WHERE parent IS NULL
UNION ALL SELECT 'EXPORTS', 'file:' || path, id FROM sy WHERE parent IS NULL AND exported
UNION ALL SELECT 'IMPORTS', 'file:' || path, coalesce('file:' || resolved, 'pkg:' || raw) FROM im
UNION ALL SELECT 'EXTENDS', sy.id, u.target FROM sy JOIN uniq u ON u.name = sy.ext)"""

CTE["mn"] = """
SELECT cn.id, cn.type, cn.name, coalesce(cn.path, cn.name) AS path, cn.language, coalesce(d.n, 0) AS degree
FROM cn LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source AS id FROM ce WHERE type = 'IMPORTS'
  UNION ALL SELECT target FROM ce WHERE type = 'IMPORTS') GROUP BY id) d USING (id)
WHERE cn.type IN ('File', 'Directory', 'Package')"""

CTE["placed"] = """
SELECT *, CASE WHEN starts_with(path, 'small/api/') THEN 'small/api' WHEN starts_with(path, 'small/') OR starts_with(path, 'regions/') THEN '(root)'
          ELSE string_split(path, '/')[1] END AS package FROM f"""

CTE["pkg_deps"] = """
SELECT DISTINCT a.package, b.package AS depends_on FROM e JOIN placed a ON a.id = e.src JOIN placed b ON b.id = e.dst
WHERE a.package <> b.package"""

CTE["sym_hits"] = f"""
SELECT * FROM sy WHERE contains(lower(name), '{SYMBOL_TEXT}')
ORDER BY (lower(name) = '{SYMBOL_TEXT}') DESC, length(name), id LIMIT 25"""

WORDS = [w for w in dict.fromkeys(re.split("[^a-z0-9]+", REQUEST_TEXT.lower())) if len(w) >= 3 and w not in STOP_WORDS]

CTE["words"] = "SELECT unnest([" + ", ".join(f"'{w}'" for w in WORDS) + "]) AS word"

CTE["related"] = """
SELECT d.id, d.path, d.lang, d.loc, d.in_degree, d.out_degree, h.score,
       2 * (SELECT count(*) FROM words WHERE contains(lower(d.path), word)) + (d.path IN (
         SELECT path FROM sy JOIN words ON contains(lower(name), word)))::INT AS match
FROM deg d JOIN hot h USING (id) WHERE match > 0 ORDER BY match DESC, d.path LIMIT 12"""

CTE["near"] = """
SELECT id FROM related UNION SELECT dst FROM e JOIN related r ON r.id = e.src
UNION SELECT src FROM e JOIN related r ON r.id = e.dst"""

# --- statements ------------------------------------------------------------------------------

STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"


def _stamp(column: str) -> str:
    return STAMP.replace("{c}", column)


def _hops(edges: str, depth: int) -> str:
    """Files at most ``depth`` hops from the hub, by unrolled joins."""
    reach = "SELECT id FROM hub"
    for _ in range(depth):
        reach = f"SELECT id FROM ({reach}) UNION SELECT x.b FROM ({edges}) x JOIN ({reach}) y ON y.id = x.a"
    return reach


OUT, IN = "SELECT src AS a, dst AS b FROM e", "SELECT dst AS a, src AS b FROM e"
BOTH = f"{OUT} UNION ALL {IN}"

SQL: dict[str, str] = {
    "file_graph_stats": """SELECT count(*) AS files, (SELECT count(*) FROM e) AS edges, CAST(sum(n_functions) AS BIGINT) AS functions,
        CAST(sum(n_classes) AS BIGINT) AS classes, CAST(sum(loc) AS BIGINT) AS total_loc FROM f""",
    "language_histogram": "SELECT lang, count(*) AS files FROM f GROUP BY lang",
    "degrees": "SELECT path, in_degree, out_degree, degree FROM deg",
    "degree_stats": "SELECT round(avg(degree), 2) AS avg_degree, max(degree) AS max_degree FROM deg",
    "hubs": "SELECT path, in_degree FROM deg WHERE in_degree > 0 ORDER BY in_degree DESC, path LIMIT 10",
    "connectors": "SELECT path, out_degree FROM deg WHERE out_degree > 0 ORDER BY out_degree DESC, path LIMIT 10",
    "orphans": "SELECT path, lang FROM deg WHERE degree = 0",
    "folder_counts": "SELECT string_split(path, '/')[1] AS folder, count(*) AS files FROM f GROUP BY folder",
    "external_packages": """SELECT raw AS name, count(*) AS count FROM
        (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS raw FROM pages)
        GROUP BY raw ORDER BY count DESC, name LIMIT 15""",
    "file_edges": "SELECT from_path, to_path FROM ep",
    "search_path": f"SELECT path FROM f WHERE contains(path, '{SEARCH_TEXT}') ORDER BY path LIMIT 50",
    "search_path_short_first": f"SELECT path FROM f WHERE contains(path, '{SEARCH_TEXT}') ORDER BY length(path), path LIMIT 20",
    "search_map": f"SELECT id, path FROM mn WHERE contains(lower(path), '{SEARCH_TEXT}') OR contains(lower(name), '{SEARCH_TEXT}') ORDER BY id LIMIT 30",
    "filter_map": """SELECT id, type, degree FROM mn WHERE type IN ('File', 'Directory')
        AND (language IN ('python', 'java') OR (language IS NULL AND type = 'Directory'))
        AND (path = 'promo' OR starts_with(path, 'promo/'))""",
    "subgraph_folder": "SELECT path, degree FROM deg WHERE starts_with(path, 'orders/')",
    "subgraph_folder_edges": "SELECT src, dst FROM ep WHERE starts_with(from_path, 'orders/') AND starts_with(to_path, 'orders/')",
    "subgraph_min_degree": "SELECT path, degree FROM deg WHERE degree >= 4",
    "subgraph_limit": "SELECT path, degree FROM deg WHERE starts_with(path, 'large/') AND degree >= 2 ORDER BY degree DESC, path LIMIT 25",
    "neighbors_out_2": f"SELECT path FROM f WHERE id IN ({_hops(OUT, 2)})",
    "neighbors_in_2": f"SELECT path FROM f WHERE id IN ({_hops(IN, 2)})",
    "neighbors_both_1": f"SELECT path FROM f WHERE id IN ({_hops(BOTH, 1)})",
    "neighbors_both_2_edges": f"SELECT src, dst FROM e WHERE src IN ({_hops(BOTH, 2)}) AND dst IN ({_hops(BOTH, 2)})",
    "resolve_target": "SELECT id, path FROM f WHERE ends_with(path, '/core/m16.js') ORDER BY path LIMIT 1",
    "search_imports": """SELECT 'dependency' AS relation, to_path AS path FROM ep WHERE src IN (SELECT id FROM hub)
        UNION ALL SELECT 'dependent', from_path FROM ep WHERE dst IN (SELECT id FROM hub)""",
    "reach_out": "SELECT s AS src, t AS dst, hop FROM pairs",
    "reach_in": """SELECT path, count(*) AS transitive_dependents, max(hop) AS max_hop FROM pairs JOIN f ON f.id = pairs.t GROUP BY path""",
    "dependency_depth": "SELECT path, depth FROM depths JOIN f USING (id)",
    "deep_files": "SELECT path, depth FROM depths JOIN f USING (id) WHERE depth > 10",
    "node_metrics": """SELECT h.path, h.in_degree, h.out_degree, coalesce(a.n, 0) AS transitive_imports,
        coalesce(b.n, 0) AS transitive_dependents, coalesce(a.depth, 0) AS depth, round(h.r, 9) AS centrality, h.score AS hotspot_score
        FROM hot h LEFT JOIN (SELECT s, count(*) AS n, max(hop) AS depth FROM pairs GROUP BY s) a ON a.s = h.id
        LEFT JOIN (SELECT t, count(*) AS n FROM pairs GROUP BY t) b ON b.t = h.id""",
    "shortest_path": """SELECT w.id AS source, hub.id AS target, w.d AS length FROM hubwalk w CROSS JOIN hub WHERE w.d > 0
        ORDER BY w.d DESC, w.id LIMIT 1""",
    "path_nodes": "SELECT d::INT AS hop, path FROM farway JOIN f USING (id)",
    "reachable_from_entries": """SELECT path FROM f WHERE contains(path, '/tests/') OR contains(path, '.test.')
        OR id IN (SELECT t FROM pairs JOIN f r ON r.id = pairs.s WHERE contains(r.path, '/tests/') OR contains(r.path, '.test.'))""",
    "cycles": """SELECT c.first_file, c.length, c.severity, b.from_path AS break_from, b.to_path AS break_to FROM cyc c JOIN (
        SELECT x.comp, ep.from_path, ep.to_path FROM ep JOIN comp x ON x.id = ep.src JOIN comp y ON y.id = ep.dst AND y.comp = x.comp
        JOIN deg d ON d.id = ep.src
        QUALIFY row_number() OVER (PARTITION BY x.comp ORDER BY d.out_degree DESC, ep.from_path, ep.to_path) = 1) b ON b.comp = c.comp""",
    "cycle_members": "SELECT c.first_file, f.path FROM comp JOIN cyc c USING (comp) JOIN f USING (id)",
    "pagerank": "SELECT path, round(r, 9) AS pagerank FROM pr JOIN f USING (id)",
    "most_central": "SELECT path, round(r, 9) AS pagerank FROM pr JOIN f USING (id) ORDER BY round(r, 12) DESC, path LIMIT 1",
    "hotspots": """SELECT path, score, reasons, in_degree AS dependents, out_degree AS dependencies, loc, n_exports AS exports FROM top10""",
    "hotspot_scores": "SELECT path, round(raw, 6) AS raw_score, score, reasons FROM hot",
    "god_modules": "SELECT path, reasons, in_degree AS dependents FROM god",
    "unused_files": "SELECT path, reasons FROM unused",
    "layer_violations": "SELECT * FROM layer_hits",
    "forbidden_imports": "SELECT * FROM banned",
    "rule_violations": "SELECT * FROM broken",
    "violation_gate": """SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
        count(*) FILTER (severity = 'error') = 0 AS passes FROM broken""",
    "health_score": f"SELECT {HEALTH_COLUMNS} FROM health",
    "analysis_summary": """SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM cyc) AS cycles,
        (SELECT count(*) FROM top10) AS hotspots, (SELECT count(*) FROM god) AS god_modules, (SELECT count(*) FROM unused) AS unused,
        0::BIGINT AS layer_violations, (SELECT path FROM pr JOIN f USING (id) ORDER BY round(r, 12) DESC, path LIMIT 1) AS most_central""",
    "impact_hops": """SELECT h.path, h.hop, 'imports ' || min(v.path) AS reason FROM hubhits h
        JOIN e ON e.src = h.id JOIN hubwalk w ON w.id = e.dst AND w.d = h.hop - 1 JOIN f v ON v.id = e.dst GROUP BY h.path, h.hop""",
    "affected_tests": "SELECT path, via FROM hubtests",
    "affected_entry_points": "SELECT path, kind FROM hubhits WHERE kind IS NOT NULL",
    "affected_directories": "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM hubhits",
    "blast_radius": """SELECT path, affected, direct, max_hop, tests, entries, in_cycle, round(raw, 6) AS raw_score,
        CAST(floor(round(raw, 9) + 0.5) AS BIGINT) AS score FROM blast""",
    "impact_report": """SELECT path, affected, direct, max_hop, tests, entries, in_cycle, round(raw, 6) AS raw_score,
        CAST(floor(round(raw, 9) + 0.5) AS BIGINT) AS score FROM (SELECT *, CASE WHEN affected = 0 THEN 0.0 ELSE
          100.0 * (0.35 * sqrt(affected / (SELECT count(*) FROM f)) + 0.15 * least(1.0, max_hop / 6) + 0.2 * least(1.0, entries / 5)
          + 0.1 * least(1.0, tests / 8) + 0.1 * (r / (SELECT max(r) FROM pr)) + 0.1 * in_cycle::INT) END AS raw
        FROM (SELECT path, r, (SELECT count(*) FROM hubhits) AS affected, (SELECT count(*) FROM hubhits WHERE hop = 1) AS direct,
                     (SELECT coalesce(max(hop), 0) FROM hubhits) AS max_hop, (SELECT count(*) FROM hubtests) AS tests,
                     (SELECT count(kind) FROM hubhits) AS entries,
                     EXISTS (SELECT 1 FROM e JOIN hubhits h ON h.id = e.dst WHERE e.src = hub.id) AS in_cycle
              FROM hub JOIN pr USING (id)))""",
    "file_history": f"""SELECT path, commits, insertions, deletions, authors, {_stamp('first_date')}, {_stamp('last_date')}, churn FROM st""",
    "churn": """SELECT path, commits, churn, authors, score, CASE WHEN score < 10 THEN 'Very Low' WHEN score < 30 THEN 'Low'
        WHEN score < 55 THEN 'Medium' WHEN score < 80 THEN 'High' ELSE 'Extreme' END AS level
        FROM (SELECT *, CAST(floor(round(100 * churn / greatest(1, max(churn) OVER ()), 9) + 0.5) AS BIGINT) AS score FROM st)""",
    "stability": """SELECT path, CAST(floor(round(100 * (1 - (0.4 * (commits / greatest(1, max(commits) OVER ()))
        + 0.3 * (authors / greatest(1, max(authors) OVER ())) + 0.3 * (churn / greatest(1, max(churn) OVER ())))), 9) + 0.5) AS BIGINT) AS stability,
        commits, authors, churn FROM st""",
    "churn_by_directory": f"SELECT module, churn, files, {_stamp('oldest')}, recent_files FROM dirs",
    "evolution_insights": """SELECT (SELECT module FROM dirs ORDER BY churn DESC, module LIMIT 1) AS most_changed_module,
        (SELECT module FROM dirs WHERE recent_files > 0 ORDER BY recent_files DESC, module LIMIT 1) AS fastest_growing_subsystem,
        (SELECT module FROM dirs WHERE files >= 2 ORDER BY churn / files, module LIMIT 1) AS most_stable_subsystem,
        (SELECT module FROM dirs ORDER BY oldest DESC, module LIMIT 1) AS newest_layer,
        (SELECT path FROM st ORDER BY churn DESC, path LIMIT 1) AS most_volatile_file""",
    "timeline_sample": f"""SELECT position, commit_id, author, {_stamp('ts')} FROM
        (SELECT *, row_number() OVER (ORDER BY ts, commit_id) - 1 AS position, count(*) OVER () AS n FROM ch)
        WHERE position IN (SELECT CAST(floor(i * ((SELECT count(*) FROM ch) - 1) / 23 + 0.5) AS BIGINT) FROM range(24) r(i))""",
    "rename_paths": """SELECT p_partkey AS id, CASE p_partkey % 3
        WHEN 0 THEN 'src/' || lower(replace(p_brand, '#', '')) || '/m' || p_partkey
        WHEN 1 THEN lower(replace(p_brand, '#', '')) || '/m' || p_partkey ELSE 'lib/m' || p_partkey END AS path FROM part""",
    "revision_sizes": "SELECT r.rev, r.n AS files, (SELECT count(*) FROM re WHERE re.rev = r.rev) AS edges FROM revs r",
    "dependency_changes": "SELECT * FROM dep_changes",
    "file_changes": """SELECT CASE WHEN min(rev) = 'head' THEN 'added' ELSE 'removed' END AS change, path
        FROM rf GROUP BY path HAVING count(*) = 1""",
    "cycle_changes": _cycle_changes("base", "head"),
    "cycle_changes_backward": _cycle_changes("head", "base"),
    "violation_changes": """SELECT CASE rev WHEN 'head' THEN 'new' ELSE 'resolved' END AS change, rule, severity, file, detail FROM rlimits v
        WHERE NOT EXISTS (SELECT 1 FROM rlimits o WHERE o.rev <> v.rev AND o.rule = v.rule AND o.file = v.file AND o.detail = v.detail)""",
    "hotspot_changes": """SELECT path, coalesce(b.score, 0) AS before, coalesce(a.score, 0) AS after,
        a.score IS NOT NULL AND b.score IS NULL AS is_new, coalesce(a.score > coalesce(b.score, 0), false) AS worsened
        FROM (SELECT path, score FROM rtop WHERE rev = 'head') a FULL JOIN (SELECT path, score FROM rtop WHERE rev = 'base') b USING (path)""",
    "score_changes": "SELECT *, after - before AS delta FROM hot_sides WHERE before <> after",
    "coupling_changes": "SELECT *, after - before AS delta FROM deg_sides WHERE before <> after",
    "coupling_increased": "SELECT * FROM deg_sides WHERE after > before ORDER BY after - before DESC, path LIMIT 20",
    "coupling_trends": """(SELECT *, after - before AS delta, 'increasing' AS direction FROM module_sides WHERE after > before ORDER BY delta DESC, module LIMIT 5)
        UNION ALL (SELECT *, after - before AS delta, 'decreasing' FROM module_sides WHERE after < before ORDER BY delta, module LIMIT 5)""",
    "coupling_delta": "SELECT 2 * (SELECT sum(CASE rev WHEN 'head' THEN 1 ELSE -1 END) FROM re)::BIGINT AS blast_radius_increase",
    "architecture_diff": f"""SELECT CASE WHEN min(rev) = 'head' THEN 'added file' ELSE 'removed file' END AS kind, path AS subject,
        NULL AS other, NULL::BIGINT AS before, NULL::BIGINT AS after FROM rf GROUP BY path HAVING count(*) = 1
        UNION ALL SELECT change || ' dependency' AS kind, "from" AS subject, "to" AS other, NULL::BIGINT AS before, NULL::BIGINT AS after FROM dep_changes
        UNION ALL SELECT change || ' cycle', first_file, path, NULL, NULL FROM ({_cycle_changes("base", "head")})
        UNION ALL SELECT 'hotspot', path, NULL, before, after FROM hot_sides WHERE before <> after
        UNION ALL SELECT 'coupling', path, NULL, before, after FROM deg_sides WHERE before <> after""",
    "branch_report": f"""SELECT a.overall AS health_before, b.overall AS health_after, {GRADE.replace('overall', 'a.overall')} AS grade_before,
        {GRADE.replace('overall', 'b.overall')} AS grade_after, b.overall - a.overall AS health_delta,
        2 * (b.edges - a.edges) AS blast_radius_increase, b.errors = 0 AS passes
        FROM rhealth a JOIN rhealth b ON a.rev = 'base' AND b.rev = 'head'""",
    "health_trend": f"""SELECT h.rev AS timestamp, h.overall, {GRADE.replace('overall', 'h.overall')} AS grade,
        CASE WHEN p.overall IS NULL THEN 'first-scan' WHEN h.overall - p.overall > 2 THEN 'improving'
             WHEN h.overall - p.overall < -2 THEN 'declining' ELSE 'stable' END AS direction,
        coalesce(h.overall - p.overall, 0) AS health_delta,
        coalesce(round(round(2 * h.edges / h.files, 2) - round(2 * p.edges / p.files, 2), 2), 0.0) AS coupling_delta,
        coalesce(h.cycles - p.cycles, 0) AS cycles_delta,
        coalesce(CAST(floor(round(h.hotspot_mean, 9) + 0.5) - floor(round(p.hotspot_mean, 9) + 0.5) AS BIGINT), 0) AS hotspots_delta,
        coalesce(h.god_modules - p.god_modules, 0) AS god_modules_delta
        FROM rhealth h LEFT JOIN rhealth p ON p.rev = 'base' AND h.rev = 'head'""",
    "health_range": """SELECT measure, min(v) AS low, max(v) AS high FROM
        (SELECT overall, maintainability, stability, modularity, coupling, complexity FROM rhealth)
        UNPIVOT (v FOR measure IN (overall, maintainability, stability, modularity, coupling, complexity)) GROUP BY measure""",
    "line_count": r"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(text, '\r\n|\r|\n')) END::INT AS loc FROM documents""",
    "keyword_counts": f"""SELECT keyword, count(*) AS turns FROM (SELECT DISTINCT conv_id, turn, rowid_, keyword FROM (
        SELECT conv_id, turn, row_number() OVER () AS rowid_, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS keyword FROM conversations))
        WHERE length(keyword) >= 3 AND keyword NOT IN ({", ".join(repr(w) for w in STOP_WORDS)}) GROUP BY keyword""",
    "source_symbols": "SELECT path, name, kind, line, exported, parent, ext AS extends, doc FROM sy",
    "source_facts": """SELECT path, 'symbol' AS fact, name, kind, line, exported, parent FROM sy
        UNION ALL SELECT path, 'import', raw, NULL, line, NULL, NULL FROM im
        UNION ALL SELECT path, 'export', name, NULL, NULL, NULL, NULL FROM sy WHERE parent IS NULL AND exported""",
    "source_exports": "SELECT path, name FROM sy WHERE parent IS NULL AND exported",
    "source_comments": "SELECT path, CASE lang WHEN 'python' THEN '# ' ELSE '// ' END || name AS comment FROM p",
    "source_files": """SELECT path, lang AS language, CAST(strlen(text) AS BIGINT) AS size,
        len(string_split_regex(text, '\\r\\n|\\r|\\n'))::INT AS loc FROM src_text""",
    "import_resolution": "SELECT * FROM im",
    "resolved_file_graph": "SELECT 'file:' || path AS source, 'file:' || resolved AS target, raw FROM im WHERE resolved IS NOT NULL",
    "code_graph_nodes": "SELECT id, type, name, path, language, loc, line, exported, external FROM cn",
    "code_graph_edges": "SELECT id, type, source, target FROM ce",
    "node_type_counts": "SELECT type, count(*) AS nodes FROM cn GROUP BY type",
    "edge_type_counts": "SELECT type, count(*) AS edges FROM ce GROUP BY type",
    "directory_tree": "SELECT dir, parent FROM dirs_of",
    "primary_language": "SELECT lang AS primary_language FROM p GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1",
    "map_graph_nodes": "SELECT id, type, path, language, degree FROM mn",
    "map_graph_edges": """SELECT id, type, source, target FROM ce WHERE type IN ('IMPORTS', 'CONTAINS')
        AND source IN (SELECT id FROM mn) AND target IN (SELECT id FROM mn)""",
    "map_facets": """SELECT 'type' AS facet, type AS value, count(*) AS nodes FROM mn GROUP BY type
        UNION ALL SELECT 'language', language, count(*) FROM mn WHERE language IS NOT NULL GROUP BY language""",
    "map_extent": "SELECT max(degree) AS max_degree, count(*) FILTER (type = 'Directory') AS directories FROM mn",
    "derived_symbols": "SELECT id, name, kind, path, line, exported FROM sy WHERE parent IS NULL AND kind IN ('function', 'class')",
    "derived_contains": """SELECT 'file:' || path || '=>' || id AS id, 'file:' || path AS source, id AS target
        FROM sy WHERE parent IS NULL AND kind IN ('function', 'class')""",
    "package_rollup": """SELECT package, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc,
        coalesce((SELECT string_agg(depends_on, '; ' ORDER BY depends_on) FROM pkg_deps d WHERE d.package = placed.package), '') AS depends_on
        FROM placed GROUP BY package""",
    "package_dependencies": "SELECT * FROM pkg_deps",
    "find_entry_points": f"SELECT path, {_p(KIND)} AS kind, lang, n_exports FROM f WHERE kind IS NOT NULL",
    "find_tests": f"SELECT path, lang, n_exports FROM f WHERE {_p(IS_TEST)}",
    "find_api_routes": """SELECT path, lang, n_exports FROM f WHERE
        regexp_matches(path, '(^|/)(api|routes?|controllers?|handlers?|endpoints?|views)/|\\.(route|routes|controller|handler|api|endpoint)\\.[^.]+$', 'i')""",
    "find_models": """SELECT path, lang, n_exports FROM f WHERE
        regexp_matches(path, '(^|/)(models?|entities|entity|schema|schemas|repositor(y|ies)|migrations|dao|orm|db)/|\\.(model|entity|schema|repository|dao)\\.[^.]+$', 'i')""",
    "find_config": """SELECT path, lang, n_exports FROM f WHERE
        regexp_matches(path, '(^|/)(config|configs|settings)/|(^|/)(config|configuration|settings|constants)\\.[^.]+$|\\.config\\.[^.]+$', 'i')""",
    "health_report": f"""SELECT 'score' AS part, item, value::VARCHAR AS value FROM
        (SELECT overall, maintainability, stability, modularity, coupling, complexity FROM health)
        UNPIVOT (value FOR item IN (overall, maintainability, stability, modularity, coupling, complexity))
        UNION ALL SELECT 'score', 'grade', {GRADE} FROM health
        UNION ALL SELECT 'count', item, value::VARCHAR FROM
        (SELECT files, edges, cycles, cycle_files, god_modules, unused, errors, warnings FROM health)
        UNPIVOT (value FOR item IN (files, edges, cycles, cycle_files, god_modules, unused, errors, warnings))
        UNION ALL SELECT severity, rule || ' ' || file, detail FROM limits
        UNION ALL SELECT 'hotspot', path, score || ': ' || reasons FROM top10""",
    "tree_changes": """WITH base AS (SELECT lang || '/' || doc_id AS path, md5(text) AS key FROM documents),
        head AS (SELECT CASE lang WHEN 'en' THEN source ELSE lang END || '/' || doc_id AS path, md5(rtrim(text, ' ')) AS key FROM documents),
        gone AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path) AS k FROM base ANTI JOIN head USING (path)),
        come AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path) AS k FROM head ANTI JOIN base USING (path))
        SELECT 'M' AS status, path, NULL AS old_path FROM base JOIN head h USING (path) WHERE base.key IS DISTINCT FROM h.key
        UNION ALL SELECT CASE WHEN g.path IS NULL THEN 'A' WHEN c.path IS NULL THEN 'D' ELSE 'R' END, coalesce(c.path, g.path),
        CASE WHEN c.path IS NOT NULL THEN g.path END FROM gone g FULL JOIN come c ON g.key = c.key AND g.k = c.k""",
    "export_sections": """SELECT 'header' AS section, 1::BIGINT AS lines UNION ALL SELECT 'nodes', count(*) FROM p
        UNION ALL SELECT 'edges', count(DISTINCT path || resolved) FROM im WHERE resolved IS NOT NULL
        UNION ALL SELECT 'symbols', count(*) FROM sy WHERE parent IS NULL AND kind IN ('function', 'class')
        UNION ALL SELECT 'contains', count(*) FROM sy WHERE parent IS NULL AND kind IN ('function', 'class')""",
    "symbol_search": "SELECT id, name, kind, line, exported FROM sym_hits",
    "symbol_references": """SELECT s.id, a.path AS reference FROM sym_hits s JOIN f b ON b.path = s.path JOIN e ON e.dst = b.id JOIN f a ON a.id = e.src""",
    "context_related": """SELECT path, lang, loc, match, score AS hotspot_score, in_degree AS dependents, out_degree AS imports FROM related""",
    "context_edges": """SELECT from_path AS "from", to_path AS "to" FROM ep WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)""",
    "context_modules": "SELECT DISTINCT string_split(path, '/')[1] AS module FROM f WHERE id IN (SELECT id FROM near)",
}


# Recursive tables that keep one row for each key.
HEADS = {
    "walk": "walk(s, t, d) USING KEY (s, t)",
    "hubwalk": "hubwalk(id, d) USING KEY (id)",
    "farwalk": "farwalk(id, d) USING KEY (id)",
    "farway": "farway(id, d)",
    "rwalk": "rwalk(rev, s, t, d) USING KEY (rev, s, t)",
}


def _needs(text: str, known: list[str]) -> list[str]:
    return [n for n in known if re.search(rf"(?<![\w.']){n}(?![\w'])", text)]


def _sql(body: str) -> str:
    """Put the table expressions a statement uses, and those they use, before it."""
    used: dict[str, None] = {}

    def add(text: str) -> None:
        for name in _needs(text, list(CTE)):
            if name not in used:
                used[name] = None
                add(CTE[name])

    add(body)
    ordered = [n for n in CTE if n in used]
    once = {"rank_rounds", "rrounds"}
    parts = [HEADS[n] + f" AS ({CTE[n]})" if n in HEADS else f"{n} AS {'' if n in once else 'MATERIALIZED '}({CTE[n]})" for n in ordered]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body if parts else body


def oracle_sql() -> dict[str, str]:
    return {name: _sql(text) for name, text in SQL.items()}
