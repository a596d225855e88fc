"""Queries of the graph, history, resolution, similarity and sink operators over whole tables, with DuckDB SQL written from their definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.common import durable
from graphloom.functions import tokens as T
from graphloom.operators import history as H
from graphloom.operators import iterate, paths, similarity, structure
from graphloom.plans import resolve
from graphloom.plans.views import Graph, build_graph, extension_of, folder_of
from graphloom.queries import table
from graphloom.sinks import reports
from graphloom.sources import extract, scan

# -- bindings -------------------------------------------------------------------------------------


def code_graph(spark: SparkSession, folder: str) -> Graph:
    """Symbols and shared symbols with the resolved edges of the edges table."""
    cols = ("id", "name", "file_path", "category", "kind", "properties")
    shared = table(spark, folder, "shared_symbols").withColumn("properties", F.create_map().cast("map<string,string>"))
    return build_graph(table(spark, folder, "symbols").select(*cols).unionByName(shared.select(*cols)), table(spark, folder, "edges"))


_SYM = r"""
WITH RECURSIVE sym AS (SELECT id, min(name) AS name, min(file_path) AS file_path, min(category) AS category, min(kind) AS kind, bool_or(abstract) AS abstract,
    CASE WHEN instr(min(file_path), '/') > 0 THEN regexp_replace(min(file_path), '/[^/]*$', '') ELSE '.' END AS package
  FROM (SELECT id, name, file_path, category, kind, coalesce(properties['abstract'] = 'true', false) AS abstract FROM symbols UNION ALL
    SELECT id, name, file_path, category, kind, false FROM shared_symbols) WHERE id <> '' GROUP BY id),
e AS (SELECT src, dst, lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) AS kind, ord FROM edges
  WHERE src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym) AND regexp_replace(kind, '^\s+|\s+$', '', 'g') <> ''),
u AS (SELECT * FROM e WHERE kind <> 'contains'),
c AS (SELECT * FROM e WHERE kind = 'contains'),
fan AS (SELECT id, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM u UNION ALL SELECT dst, 1, 0 FROM u) GROUP BY id),
pe AS (SELECT a.package AS src, b.package AS dst, count(*) AS weight FROM u JOIN sym a ON a.id = u.src JOIN sym b ON b.id = u.dst WHERE a.package <> b.package GROUP BY 1, 2),
pi AS (SELECT package, sum(ce) * 1.0 / (sum(ce) + sum(ca)) AS i FROM (SELECT src AS package, weight AS ce, 0 AS ca FROM pe UNION ALL SELECT dst, 0, weight FROM pe) GROUP BY package),
"""
_LAYER = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in structure.LAYERS.items()) + ") AS m(layer, level)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _graph_query(name: str, build, sql: str | None = None, prefix: str = _SYM) -> None:
    QUERIES[name] = lambda spark, folder: build(code_graph(spark, folder))
    if sql is not None:
        SQL[name] = prefix.rstrip().rstrip(",") + sql if sql.lstrip().startswith("SELECT") else prefix + sql


_graph_query("hubs", structure.hubs, " SELECT id, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out FROM fan WHERE fan_in >= 10 OR fan_out >= 10")
_graph_query("orphans", structure.orphans, " SELECT id, name, kind FROM sym WHERE category <> 'module' AND id NOT IN (SELECT dst FROM u) AND id NOT IN (SELECT src FROM c) AND id NOT IN (SELECT dst FROM c)")
_graph_query("god_symbols", lambda g: structure.god_symbols(g, 4), " SELECT c.src AS id, count(*) AS children FROM c JOIN sym s ON s.id = c.src WHERE s.category <> 'module' GROUP BY c.src HAVING count(*) >= 4")
_graph_query("instability", structure.instability, " SELECT f.id, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out, round(fan_out * 1.0 / (fan_in + fan_out), 6) AS instability FROM fan f JOIN sym s ON s.id = f.id WHERE fan_out > 0 AND s.category IN ('type', 'module')")
_graph_query("dependency_weight", structure.dependency_weight, " SELECT src, dst, weight FROM pe")
_graph_query("main_sequence", structure.main_sequence, """
ty AS (SELECT package, count(*) AS types, count(*) FILTER (WHERE kind IN ('interface', 'abstract_class', 'trait') OR abstract) AS abstract_types FROM sym WHERE category = 'type' GROUP BY package)
SELECT ty.package, types, abstract_types, round(coalesce(i, 0), 6) AS instability, round(abs(abstract_types * 1.0 / types + coalesce(i, 0) - 1), 6) AS distance
FROM ty LEFT JOIN pi ON pi.package = ty.package WHERE abs(abstract_types * 1.0 / types + coalesce(i, 0) - 1) >= 0.1""")
_graph_query("layer_violations", structure.layer_violations, f"""
parts AS (SELECT id, unnest(string_split(lower(package), '/')) AS part, generate_subscripts(string_split(lower(package), '/'), 1) AS pos FROM sym),
lay AS (SELECT id, arg_max(layer, pos) AS layer, arg_max(level, pos) AS level FROM parts JOIN {_LAYER} ON m.layer = parts.part GROUP BY id)
SELECT u.src, u.dst, u.kind, a.layer AS from_layer, b.layer AS to_layer FROM u JOIN lay a ON a.id = u.src JOIN lay b ON b.id = u.dst
WHERE u.kind <> 'imports' AND a.level > b.level AND a.layer <> b.layer""")
_graph_query("shotgun_surgery", lambda g: structure.shotgun_surgery(g, 1, 2), """
sg AS (SELECT dst AS id, count(*) AS callers, string_agg(src, ',' ORDER BY src) AS sig FROM u GROUP BY dst)
SELECT s.package, callers, count(*) AS targets, min(s.id) AS first_target FROM sg JOIN sym s ON s.id = sg.id WHERE s.category <> 'module' GROUP BY s.package, callers, sig HAVING count(*) >= 2""")
_graph_query("feature_envy", structure.feature_envy, """
n AS (SELECT u.src, a.package AS home, b.package AS target, count(*) AS n FROM u JOIN sym a ON a.id = u.src JOIN sym b ON b.id = u.dst WHERE a.category = 'callable' GROUP BY 1, 2, 3),
own AS (SELECT src, sum(CASE WHEN target = home THEN n ELSE 0 END) AS own FROM n GROUP BY src),
best AS (SELECT src, target, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, target) AS r FROM n WHERE target <> home)
SELECT best.src AS id, target, n AS foreign_uses, CAST(own AS BIGINT) AS own_uses FROM best JOIN own ON own.src = best.src WHERE r = 1 AND n > own AND n >= 3""")
_graph_query("stable_dep_violations", structure.stable_dependency_violations, " SELECT pe.src, pe.dst, round(a.i, 6) AS from_instability, round(b.i, 6) AS to_instability FROM pe JOIN pi a ON a.package = pe.src JOIN pi b ON b.package = pe.dst WHERE b.i - a.i > 0.3")
_graph_query("interface_segregation", lambda g: structure.interface_segregation(g, members=2), """
sz AS (SELECT c.src AS id, count(*) AS members FROM c JOIN sym s ON s.id = c.src WHERE s.kind IN ('interface', 'trait', 'protocol') GROUP BY 1 HAVING count(*) >= 2),
par AS (SELECT src AS child, dst AS parent FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord DESC, dst DESC) AS r FROM u WHERE kind IN ('inherits', 'implements')) WHERE r = 1),
im AS (SELECT parent AS id, child AS impl FROM par WHERE parent IN (SELECT id FROM sz)),
nm AS (SELECT DISTINCT c.src AS id, s.name FROM c JOIN sym s ON s.id = c.dst WHERE c.src IN (SELECT id FROM sz)),
h AS (SELECT im.id, im.impl, count(*) AS n FROM im JOIN c ON c.src = im.impl JOIN sym s ON s.id = c.dst JOIN nm ON nm.id = im.id AND nm.name = s.name GROUP BY 1, 2),
b AS (SELECT im.id, max(coalesce(n, 0)) AS used FROM im LEFT JOIN h ON h.id = im.id AND h.impl = im.impl GROUP BY 1)
SELECT b.id, members, used, round(used * 1.0 / members, 6) AS share FROM b JOIN sz ON sz.id = b.id WHERE used * 1.0 / members < 0.6""")
_REACH = """
l AS (SELECT DISTINCT src, dst FROM {links} WHERE src <> dst),
reach AS (SELECT src, dst FROM l UNION SELECT r.src, l.dst FROM reach r JOIN l ON l.src = r.dst)
"""
_SCC = _REACH + """, mutual AS (SELECT a.src AS id, a.dst AS other FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst)
SELECT id, least(id, min(other)) AS component FROM mutual GROUP BY id"""
_graph_query("cyclic_dependencies", lambda g: iterate.strong_components(g.uses), _SCC.format(links="u"))
_graph_query("circular_packages", lambda g: iterate.strong_components(g.package_edges()), _SCC.format(links="pe"))
_graph_query("weak_components", iterate.weak_components, """
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT id, id FROM sym),
lab AS (SELECT 0 AS it, id, id AS low FROM sym UNION ALL SELECT it + 1, dst, min(low) FROM lab JOIN b ON b.src = lab.id WHERE it < 40 GROUP BY it, dst),
sizes AS (SELECT low AS component, count(*) AS members FROM lab WHERE it = 40 GROUP BY low)
SELECT component, members FROM sizes WHERE (SELECT count(*) FROM sizes) > 1""")
_graph_query("transitive_fan_in", iterate.transitive_fan_in, _REACH.format(links="u") + """, t AS (SELECT dst AS id, count(*) AS transitive FROM reach WHERE src <> dst GROUP BY dst)
SELECT f.id, CAST(fan_in AS BIGINT) AS fan_in, transitive FROM fan f JOIN t ON t.id = f.id WHERE fan_in > 0 AND transitive > fan_in""")
_graph_query("unreachable", lambda g: iterate.unreachable(g, g.symbols.where("category = 'module'").select("id")), """
par AS (SELECT dst AS src, src AS dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY ord DESC, src DESC) AS r FROM c) WHERE r = 1),
l AS (SELECT src, dst FROM e UNION SELECT src, dst FROM par),
seen AS (SELECT id FROM sym WHERE category = 'module' UNION SELECT l.dst FROM seen JOIN l ON l.src = seen.id)
SELECT id, kind FROM sym WHERE category <> 'module' AND id NOT IN (SELECT id FROM seen)""")
_graph_query("entry_points", iterate.entry_points, r""" SELECT id FROM sym WHERE lower(name) IN ('main', 'app', 'init') OR (regexp_matches(regexp_extract(file_path, '([^/]*)$', 1), '^(main|app|index|server)\.') AND category IN ('callable', 'type'))""")
_graph_query("deep_inheritance", lambda g: iterate.deep_inheritance(g, 2), """
par AS (SELECT child, parent FROM (SELECT src AS child, dst AS parent, row_number() OVER (PARTITION BY src ORDER BY ord DESC, dst DESC) AS r FROM u WHERE kind IN ('inherits', 'implements')) WHERE r = 1 AND child <> parent),
w AS (SELECT child AS id, parent AS cur, [child] AS seen, 1 AS depth FROM par
  UNION ALL SELECT w.id, par.parent, list_append(w.seen, w.cur), w.depth + 1 FROM w JOIN par ON par.child = w.cur WHERE NOT list_contains(w.seen, w.cur))
SELECT id, CAST(max(depth) AS INTEGER) AS depth, arg_max(cur, depth) AS top FROM w GROUP BY id HAVING max(depth) >= 2""")
_graph_query("containment_depth", lambda g: iterate.containment_depth(g, 1), """
k AS (SELECT DISTINCT c.src, c.dst FROM c JOIN sym s ON s.id = c.dst WHERE s.category IN ('type', 'callable')),
w AS (SELECT DISTINCT src AS id, 0 AS depth FROM c WHERE src NOT IN (SELECT dst FROM c) UNION SELECT k.dst, w.depth + 1 FROM w JOIN k ON k.src = w.id WHERE w.depth < 400)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id HAVING min(depth) >= 1""")
_graph_query("pagerank", lambda g: iterate.page_rank(g.symbols, g.uses).select("id", F.round("rank", 9).alias("rank")), """
deg AS (SELECT src AS id, count(*) AS d FROM u GROUP BY src),
li AS (SELECT u.src, u.dst, count(*) * 1.0 / any_value(d) AS w FROM u JOIN deg ON deg.id = u.src GROUP BY u.src, u.dst UNION ALL SELECT id, id, 0 FROM sym),
pr AS (SELECT 0 AS it, id, 1.0::DOUBLE / (SELECT count(*) FROM sym) AS rank FROM sym UNION ALL
  SELECT it + 1, dst, 0.15::DOUBLE / (SELECT count(*) FROM sym) + 0.85::DOUBLE * (any_value(lost) / (SELECT count(*) FROM sym) + sum(rank * w)) FROM (
    SELECT it, id, rank, sum(CASE WHEN id IN (SELECT id FROM deg) THEN 0 ELSE rank END) OVER (PARTITION BY it) AS lost FROM pr WHERE it < 30) p JOIN li ON li.src = p.id GROUP BY it, dst)
SELECT id, round(rank, 9) AS rank FROM pr WHERE it = 30""")
_graph_query("betweenness", lambda g: paths.betweenness(g.symbols, g.uses).where("value > 0").select("id", F.round("value", 9).alias("value")))
_graph_query("change_propagation", paths.change_propagation)


FOLLOWERS = 3


def order_flow(spark: SparkSession, folder: str, followers: int = FOLLOWERS) -> Graph:
    """Suppliers, each with the ``followers`` that follow it in most orders (by line number; ties: smaller key), over all order lines."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    a = lines.select("l_orderkey", F.col("l_suppkey").alias("a"), F.col("l_linenumber").alias("m"))
    b = lines.select("l_orderkey", F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("n"))
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    often = a.join(b, "l_orderkey").where("m < n AND a <> b").groupBy("a", "b").agg(F.count("*").alias("times"))
    best = often.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.col("times").desc(), "b"))).where(F.col("place") <= followers)
    e = best.select(name("a").alias("src"), name("b").alias("dst"))
    s = table(spark, folder, "supplier").select(name("s_suppkey").alias("id"), name("s_suppkey").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/s")).alias("file_path"), F.lit("type").alias("category"), F.lit("class").alias("kind"), F.create_map().cast("map<string,string>").alias("properties"))
    return build_graph(s, e.select("src", "dst", F.lit("calls").alias("kind"), F.lit(0).cast("bigint").alias("ord")))


_FLOW = """
WITH RECURSIVE s AS (SELECT 'S' || s_suppkey AS id FROM supplier),
li AS (SELECT l_orderkey AS o, l_suppkey AS k, l_linenumber AS n FROM lineitem),
often AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM li a JOIN li b ON a.o = b.o WHERE a.n < b.n AND a.k <> b.k GROUP BY 1, 2),
u AS (SELECT 'S' || a AS src, 'S' || b AS dst FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM often) WHERE r <= 3),
"""
QUERIES["flow_articulation_points"] = lambda spark, folder: paths.articulation_points(order_flow(spark, folder, 1), 1)
SQL["flow_articulation_points"] = _FLOW.replace("r <= 3", "r <= 1") + """
b AS (SELECT src, dst FROM u UNION SELECT dst, src FROM u), n AS (SELECT DISTINCT src AS id FROM b), b2 AS (SELECT src, dst FROM b UNION SELECT id, id FROM n),
lab AS (SELECT 0 AS it, g.id AS gone, n.id AS id, n.id AS low FROM n JOIN n g ON n.id <> g.id
  UNION ALL SELECT it + 1, gone, dst, min(low) FROM lab JOIN b2 ON b2.src = lab.id AND b2.dst <> gone WHERE it < 60 GROUP BY it, gone, dst),
uncut AS (SELECT 0 AS it, id, id AS low FROM n UNION ALL SELECT it + 1, dst, min(low) FROM uncut JOIN b2 ON b2.src = uncut.id WHERE it < 60 GROUP BY it, dst),
parts AS (SELECT gone, low, count(*) AS n FROM lab WHERE it = 60 GROUP BY 1, 2),
placed AS (SELECT gone, n, row_number() OVER (PARTITION BY gone ORDER BY n DESC, low) AS r, count(*) OVER (PARTITION BY gone) AS c FROM parts)
SELECT gone AS id, n AS second FROM placed WHERE r = 2 AND c > (SELECT count(DISTINCT low) FROM uncut WHERE it = 60)"""
QUERIES["flow_pagerank"] = lambda spark, folder: iterate.page_rank(order_flow(spark, folder).symbols, order_flow(spark, folder).uses).select("id", F.round("rank", 9).alias("rank"))
SQL["flow_pagerank"] = _FLOW + """
deg AS (SELECT s.id, count(u.dst) AS d FROM s LEFT JOIN u ON u.src = s.id GROUP BY s.id),
pr AS (SELECT 0 AS it, id, 1.0::DOUBLE / (SELECT count(*) FROM s) AS rank FROM s UNION ALL
  SELECT it + 1, id, rank FROM (
    SELECT p.it, d2.id, 0.15 / (SELECT count(*) FROM s) + 0.85 * (sum(CASE WHEN d1.d = 0 THEN p.rank ELSE 0 END) / (SELECT count(*) FROM s) + sum(CASE WHEN u.dst IS NOT NULL THEN p.rank / d1.d ELSE 0 END)) AS rank
    FROM pr p JOIN deg d1 ON d1.id = p.id CROSS JOIN deg d2 LEFT JOIN u ON u.src = p.id AND u.dst = d2.id WHERE p.it < 30 GROUP BY p.it, d2.id))
SELECT id, round(rank, 9) AS rank FROM pr WHERE it = 30"""

# -- history: orders as commits, order lines as changed files -----------------------------------------


def _history(spark: SparkSession, folder: str, path: str, max_files: int = 8, max_commits: int | None = None) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(1).alias("n_parents"))
    files = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col(path).cast("string").alias("path"), F.col("l_quantity").cast("int").alias("additions"), F.col("l_linenumber").cast("int").alias("deletions"))
    window = H.commit_window(orders, files, max_files, max_commits)
    return window, H.touched(window, files)


def _now(spark: SparkSession, folder: str):
    return F.lit(table(spark, folder, "orders").agg(F.max("o_orderdate")).first()[0])


def _metrics(spark: SparkSession, folder: str, path: str) -> DataFrame:
    m = H.file_metrics(_history(spark, folder, path)[1], _now(spark, folder))
    return m.select("path", "commits", "additions", "deletions", F.round("recency_score", 6).alias("recency_score"), "last_changed")


_HIST = """
WITH RECURSIVE n AS (SELECT l_orderkey AS c, count(DISTINCT {path}) AS n FROM lineitem GROUP BY 1),
w AS (SELECT o_orderkey AS c, o_orderdate AS ts, o_orderpriority = '1-URGENT' AS merge, coalesce(n, 0) > 8 AS big FROM orders LEFT JOIN n ON n.c = o_orderkey),
t AS (SELECT w.c, w.ts, CAST({path} AS VARCHAR) AS path, sum(CAST(l_quantity AS INTEGER)) AS additions, sum(l_linenumber) AS deletions FROM w JOIN lineitem ON l_orderkey = w.c WHERE NOT merge AND NOT big GROUP BY 1, 2, 3),
m AS (SELECT path, count(*) AS commits, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
  sum(exp(-ln(2) * (epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(ts)) / 86400000000.0 / 90)) AS r, max(ts) AS last_changed FROM t GROUP BY path)
"""
QUERIES["file_metrics"] = lambda spark, folder: _metrics(spark, folder, "l_partkey")
SQL["file_metrics"] = _HIST.format(path="l_partkey") + "SELECT path, commits, additions, deletions, round(r, 6) AS recency_score, last_changed FROM m"
QUERIES["commit_counters"] = lambda spark, folder: H.commit_counters(_history(spark, folder, "l_partkey")[0])
SQL["commit_counters"] = _HIST.format(path="l_partkey") + "SELECT count(*) AS visited, count(*) FILTER (WHERE NOT merge AND NOT big) AS analyzed, count(*) FILTER (WHERE merge) AS merges_skipped, count(*) FILTER (WHERE big AND NOT merge) AS bulk_skipped FROM w"
QUERIES["cochange"] = lambda spark, folder: H.co_changes(_history(spark, folder, "l_partkey")[1])
_PAIRS = """, p AS (SELECT a.path AS "left", b.path AS "right", count(*) AS n FROM t a JOIN t b ON a.c = b.c WHERE a.path < b.path GROUP BY 1, 2)"""
SQL["cochange"] = _HIST.format(path="l_partkey") + _PAIRS + """ SELECT "left", "right", n FROM p"""


def coupling(spark: SparkSession, folder: str) -> DataFrame:
    rows = durable(_history(spark, folder, "l_partkey")[1]).df
    return H.couplings(H.co_changes(rows), H.file_metrics(rows, _now(spark, folder))).withColumn("strength", F.round("strength", 6))


QUERIES["coupling"] = coupling
SQL["coupling"] = _HIST.format(path="l_partkey") + _PAIRS + """ SELECT "left", "right", n, round(n * 1.0 / least(a.commits, b.commits), 6) AS strength FROM p JOIN m a ON a.path = "left" JOIN m b ON b.path = "right" WHERE n >= 3"""


def hotspots(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as files: their order history with their place in the order-flow graph."""
    metrics = H.file_metrics(_history(spark, folder, "l_suppkey")[1], _now(spark, folder)).withColumn("path", F.concat(F.lit("S"), "path"))
    g = order_flow(spark, folder)
    nodes = durable(g.symbols.select("id")).df
    links = durable(g.uses.select("src", "dst").where("src <> dst").distinct()).df
    rank = iterate.page_rank(nodes, links)
    shape = rank.join(paths.centrality(nodes, links), "id").select(F.col("id").alias("path"), F.col("rank").alias("pagerank"), F.col("value").alias("betweenness"), "transitive")
    out = H.hotspots(metrics, shape)
    return out.select("file", *[F.round(c, 6).alias(c) for c in ("history", "structure", "score")])


QUERIES["hotspots"] = hotspots

# -- names and files ----------------------------------------------------------------------------------


def _named(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "symbols").where("id <> '' AND file_path <> '' AND name IS NOT NULL").select("file_path", "name", "scoped_name", "category", "kind", "ord", "signature", "span", "properties").dropDuplicates(["file_path", "ord"])
    return resolve.global_ids(rows)


_NAMED = """
WITH RECURSIVE d AS (SELECT file_path, ord, any_value(name) AS name, any_value(scoped_name) AS scoped_name, any_value(category) AS category FROM symbols WHERE id <> '' AND file_path <> '' AND name IS NOT NULL GROUP BY file_path, ord),
g AS (SELECT *, coalesce(nullif(scoped_name, ''), name) AS scope, row_number() OVER (PARTITION BY file_path, coalesce(nullif(scoped_name, ''), name) ORDER BY ord) - 1 AS k FROM d),
s AS (SELECT *, file_path || '::' || scope || CASE WHEN k > 0 THEN '#' || k ELSE '' END AS gid, CASE WHEN instr(file_path, '/') > 0 THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS dir,
  regexp_extract(file_path, '(\\.[^./]*)$', 1) AS ext FROM g)
""".replace("\\\\", "\\")
QUERIES["global_ids"] = lambda spark, folder: _named(spark, folder).select("file_path", "ord", "gid")
SQL["global_ids"] = _NAMED + "SELECT file_path, ord, gid FROM s"
QUERIES["short_ids"] = lambda spark, folder: resolve.short_ids(_named(spark, folder))
SQL["short_ids"] = _NAMED + "SELECT file_path, ord, 'S' || row_number() OVER (ORDER BY file_path, ord) AS sid FROM s"
QUERIES["first_definitions"] = lambda spark, folder: resolve.first_definitions(_named(spark, folder))
SQL["first_definitions"] = _NAMED + "SELECT file_path, name, arg_min(gid, ord) AS gid FROM s GROUP BY 1, 2"
QUERIES["module_dedup"] = lambda spark, folder: resolve.drop_repeated_modules(_named(spark, folder)).where("category = 'module'").select("gid")
SQL["module_dedup"] = _NAMED + "SELECT gid FROM (SELECT gid, row_number() OVER (PARTITION BY dir, name ORDER BY file_path, ord) AS r FROM s WHERE category = 'module') WHERE r = 1"
QUERIES["module_contains"] = lambda spark, folder: resolve.module_contains(_named(spark, folder))
SQL["module_contains"] = _NAMED + """, m AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY file_path, ord) AS r FROM s WHERE category = 'module')
SELECT m.gid AS src, x.gid AS dst, 'contains' AS kind FROM m JOIN s x ON m.dir = x.dir AND m.ext = x.ext WHERE m.r = 1 AND x.category <> 'module'"""


def nearest_definition(spark: SparkSession, folder: str) -> DataFrame:
    """What the last segment of each edge's target means in the source's file."""
    syms = _named(spark, folder)
    refs = table(spark, folder, "edges").where("src <> '' AND dst <> ''").select(F.substring_index("src", "::", 1).alias("file_path"), F.element_at(F.split("dst", r"[.:]+"), -1).alias("name")).where("name <> ''")
    return resolve.nearest_definitions(refs, syms)


QUERIES["nearest_definition"] = nearest_definition
SQL["nearest_definition"] = _NAMED + r"""
, r AS (SELECT DISTINCT CASE WHEN instr(src, '::') > 0 THEN split_part(src, '::', 1) ELSE src END AS file_path, regexp_extract(dst, '([^.:]*)$', 1) AS name FROM edges WHERE src <> '' AND dst <> '' AND regexp_extract(dst, '([^.:]*)$', 1) <> ''),
own AS (SELECT file_path, name, arg_min(gid, ord) AS gid FROM s GROUP BY 1, 2),
nm AS (SELECT DISTINCT gid, dir, n FROM (SELECT gid, dir, name AS n FROM s UNION ALL SELECT gid, dir, scope FROM s)),
rd AS (SELECT r.*, CASE WHEN instr(r.file_path, '/') > 0 THEN regexp_replace(r.file_path, '/[^/]*$', '') ELSE '.' END AS home FROM r LEFT JOIN own USING (file_path, name) WHERE own.gid IS NULL),
cand AS (SELECT rd.file_path, rd.name, nm.gid, list_filter(string_split(rd.home, '/'), lambda x: x <> '' AND x <> '.') AS a, list_filter(string_split(nm.dir, '/'), lambda x: x <> '' AND x <> '.') AS b FROM rd JOIN nm ON nm.n = rd.name),
dist AS (SELECT file_path, name, gid, len(a) + len(b) - 2 * len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: list_slice(a, 1, k) = list_slice(b, 1, k))) AS d FROM cand),
best AS (SELECT file_path, name, gid FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY d, gid) AS k FROM dist) WHERE k = 1)
SELECT r.file_path, r.name, coalesce(own.gid, best.gid, r.file_path || '::' || r.name) AS target, coalesce(own.gid, best.gid) IS NOT NULL AS resolved
FROM r LEFT JOIN own USING (file_path, name) LEFT JOIN best USING (file_path, name)"""


def alias_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls added by following order-flow edges of even suppliers as aliases."""
    links = durable(order_flow(spark, folder).uses.select("src", "dst")).df
    even = F.substring("src", 2, 20).cast("bigint") % 2 == 0
    hints = links.where(even).select("src", "dst", F.substring("dst", 2, 20).cast("bigint").alias("ord"))
    return resolve.resolve_aliases(links.where(~even), hints)


QUERIES["alias_fixpoint"] = alias_calls
SQL["alias_fixpoint"] = _FLOW + """
h AS (SELECT src AS name, arg_min(dst, CAST(substr(dst, 2) AS BIGINT)) AS t FROM u WHERE CAST(substr(src, 2) AS BIGINT) % 2 = 0 GROUP BY src),
c AS (SELECT src, dst FROM u WHERE CAST(substr(src, 2) AS BIGINT) % 2 = 1),
f AS (SELECT src, dst, 0 AS n FROM c UNION SELECT f.src, h.t, f.n + 1 FROM f JOIN h ON h.name = f.dst WHERE h.t <> f.src AND f.n < 10)
SELECT DISTINCT src, dst FROM f WHERE n > 0 AND (src, dst) NOT IN (SELECT src, dst FROM c)"""


def scanned_files(spark: SparkSession, folder: str) -> DataFrame:
    return scan.select_sources(table(spark, folder, "source_files").select("path"), table(spark, folder, "scanner_extensions")).distinct()


QUERIES["scanned_files"] = scanned_files
SQL["scanned_files"] = r"""
SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL AND regexp_extract(path, '(\.[^./]*)$', 1) IN (SELECT ext FROM scanner_extensions)
AND NOT regexp_matches(path, '(^|/)(\.git|\.hg|\.svn|node_modules|__pycache__|\.tox|\.mypy_cache|\.pytest_cache|\.venv|venv)/') AND NOT regexp_matches(path, '(^|/)(__tests__|test|tests|spec|specs)/')
AND NOT regexp_matches(path, '[^/]*\.(test|spec)\.[^/]*$') AND NOT regexp_matches(path, '(/|^)test_[^/]*\.(py|pyi|rb)$') AND NOT regexp_matches(path, '_test\.(py|pyi|rb|go|c|h|cpp|hpp|cc|cxx|hxx|rs)$') AND NOT regexp_matches(path, '_spec\.rb$')
AND NOT regexp_matches(path, '(Test|Tests|Spec|Suite)\.(java|scala|sc)$') AND NOT regexp_matches(path, '(Test|Tests|Spec)\.cs$') AND NOT regexp_matches(path, '(Test|Spec)\.php$')"""


def extracted_symbols(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files").where("path IS NOT NULL").groupBy("path").agg(F.min("content").alias("content"))
    return extract.extract_symbols(files, table(spark, folder, "scanner_extensions"))


def extracted_edges(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files").where("path IS NOT NULL").groupBy("path").agg(F.min("content").alias("content"))
    return extract.extract_edges(files, table(spark, folder, "scanner_extensions"))


QUERIES["extracted_symbols"], QUERIES["extracted_edges"] = extracted_symbols, extracted_edges


def call_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Edge targets' spans in files: the innermost-last callable whose span holds each symbol's first line (range join)."""
    s = table(spark, folder, "symbols").where("id <> '' AND span IS NOT NULL").select("id", "file_path", "category", "ord", F.col("span.start").alias("a"), F.col("span.end").alias("z")).dropDuplicates(["id"])
    own = s.where("category IN ('callable', 'type')").select("file_path", F.col("id").alias("owner"), F.col("ord").alias("o"), F.col("a").alias("oa"), F.col("z").alias("oz"))
    rows = s.join(own, "file_path").where("a BETWEEN oa AND oz AND id <> owner")
    return rows.groupBy("id").agg(F.max(F.struct("o", "owner"))["owner"].alias("owner"))


QUERIES["span_owner"] = call_attribution
SQL["span_owner"] = """
WITH s AS (SELECT id, any_value(file_path) AS file_path, any_value(category) AS category, any_value(ord) AS ord, any_value(span.start) AS a, any_value(span."end") AS z FROM symbols WHERE id <> '' AND span IS NOT NULL GROUP BY id)
SELECT id, owner FROM (SELECT x.id, o.id AS owner, row_number() OVER (PARTITION BY x.id ORDER BY o.ord DESC, o.id DESC) AS r FROM s x JOIN s o ON o.file_path = x.file_path AND o.category IN ('callable', 'type') AND x.a BETWEEN o.a AND o.z AND o.id <> x.id) WHERE r = 1"""

# -- sinks --------------------------------------------------------------------------------------------


def symbol_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _named(spark, folder)
    return reports.symbol_lines(rows.join(resolve.short_ids(rows), ["file_path", "ord"]))


def line_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Symbol lines read back."""
    return reports.read_lines(symbol_lines(spark, folder)).select("sid", "category", "kind", "start", "end")


QUERIES["symbol_lines"], QUERIES["line_reader"] = symbol_lines, line_round_trip
SQL["line_reader"] = _NAMED + """, p AS (SELECT file_path, ord, 'S' || row_number() OVER (ORDER BY file_path, ord) AS sid FROM s),
x AS (SELECT file_path, ord, any_value(category) AS category, any_value(kind) AS kind, any_value(span.start) AS "start", any_value(span."end") AS "end" FROM symbols WHERE id <> '' AND file_path <> '' AND name IS NOT NULL GROUP BY 1, 2)
SELECT sid, category, kind, "start", "end" FROM p JOIN x USING (file_path, ord)"""
_graph_query("edge_blocks", lambda g: reports.edge_blocks(g.edges), """
f AS (SELECT src, kind, dst, min(ord) AS ord FROM e GROUP BY 1, 2, 3)
SELECT src, kind, string_agg(dst, ', ' ORDER BY ord, dst) AS targets FROM f GROUP BY 1, 2""")
_graph_query("json_edges", lambda g: reports.json_edges(g.edges, g.symbols), """ SELECT sym.file_path AS position_file, e.src, e.kind, e.dst, '{"from":"' || e.src || '","to":"' || e.dst || '","kind":"' || e.kind || '"}' AS json FROM e JOIN sym ON sym.id = e.src""")
_graph_query("file_graph", lambda g: H.file_graph(g.edges, g.symbols), " SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM e JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst WHERE e.kind NOT IN ('contains', 'imports') AND a.file_path <> b.file_path")


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "symbols").where("id <> ''").dropDuplicates(["id"]).select(F.explode(F.array("category", "kind", folder_of(F.col("file_path")))).alias("token")).where("token <> ''")
    return reports.dictionary(words.groupBy("token").agg(F.count("*").alias("count")))


def flat_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Files with their symbol line counts, filled into numbered parts."""
    return reports.flat_blocks(_named(spark, folder).groupBy("file_path").agg((F.count("*") + 1).alias("lines")))


QUERIES["dictionary"], QUERIES["flat_blocks"] = dictionary, flat_blocks
SQL["dictionary"] = """
WITH RECURSIVE d AS (SELECT any_value(category) AS category, any_value(kind) AS kind, any_value(file_path) AS f FROM symbols WHERE id <> '' GROUP BY id),
t AS (SELECT token, count(*) AS n FROM (SELECT category AS token FROM d UNION ALL SELECT kind FROM d UNION ALL SELECT CASE WHEN instr(f, '/') > 0 THEN regexp_replace(f, '/[^/]*$', '') ELSE '.' END FROM d) WHERE token <> '' GROUP BY token),
o AS (SELECT token, n, row_number() OVER (ORDER BY token) AS k FROM t),
fold AS (SELECT k, CAST((length(token) - 2) * n > 0 AS INTEGER) AS upto, (length(token) - 2) * n > 0 AS given, 0 AS number FROM o WHERE k = 1
  UNION ALL SELECT o.k, f.upto + CAST((length(o.token) - length('d' || f.upto)) * o.n > 0 AS INTEGER), (length(o.token) - length('d' || f.upto)) * o.n > 0, f.upto FROM fold f JOIN o ON o.k = f.k + 1)
SELECT 'd' || number AS code, token FROM fold JOIN o USING (k) WHERE given"""
SQL["flat_blocks"] = _NAMED + """
, b AS (SELECT file_path, lines, row_number() OVER (ORDER BY file_path) AS k FROM (SELECT file_path, count(*) + 1 AS lines FROM s GROUP BY file_path)),
fill AS (SELECT k, 1 + lines AS n, 0 AS part FROM b WHERE k = 1 UNION ALL
  SELECT b.k, CASE WHEN fill.n > 1 AND fill.n + b.lines + 2 > 500 THEN 1 + b.lines ELSE fill.n + b.lines END, CASE WHEN fill.n > 1 AND fill.n + b.lines + 2 > 500 THEN fill.part + 1 ELSE fill.part END
  FROM fill JOIN b ON b.k = fill.k + 1)
SELECT file_path, lines, CAST(part AS BIGINT) AS part FROM b JOIN fill USING (k)"""
SQL["symbol_lines"] = _NAMED + r"""
, p AS (SELECT file_path, ord, 'S' || row_number() OVER (ORDER BY file_path, ord) AS sid FROM s),
x AS (SELECT file_path, ord, category, kind, span.start AS a, span."end" AS z, trim(regexp_replace(signature, '\s+', ' ', 'g')) AS sig,
  list_aggregate(list_transform(list_sort(map_keys(properties)), lambda k: CASE WHEN properties[k] = 'true' THEN k ELSE k || '=' || coalesce(properties[k], '') END), 'string_agg', ' ') AS props,
  row_number() OVER (PARTITION BY file_path, ord ORDER BY id) AS r FROM symbols WHERE id <> '' AND file_path <> '' AND name IS NOT NULL)
SELECT file_path, ord, concat_ws(' ', sid, concat_ws('/', category, kind), CASE WHEN a = z THEN 'L' || a ELSE 'L' || a || '-L' || z END, nullif(sig, ''), CASE WHEN props <> '' THEN '{' || props || '}' END) AS line
FROM p JOIN x USING (file_path, ord) WHERE r = 1""".replace("\\\\", "\\")

# -- token streams and vectors --------------------------------------------------------------------------


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "symbols").where("id <> '' AND octet_length(body_tokens) >= 4").select("id", "category", F.col("body_tokens").alias("tokens")).dropDuplicates(["id"])
    return durable(s.select("id", "category", "tokens", T.structural_of("tokens").alias("shape"), T.fuzzy_hash_of("tokens").alias("hash"), T.bigram_vector_of("tokens").alias("vec"))).df


QUERIES["ctph_hash"] = lambda spark, folder: _entries(spark, folder).select("id", "hash")
QUERIES["structural_tokens"] = lambda spark, folder: _entries(spark, folder).select("id", F.hex("shape").alias("shape"))
QUERIES["bigram_vectors"] = lambda spark, folder: _entries(spark, folder).select("id", F.posexplode("vec").alias("bucket", "v")).where("v <> 0").select("id", "bucket", F.round("v", 6).alias("value"))
SQL["bigram_vectors"] = """
WITH t AS (SELECT id, any_value(hex(body_tokens)) AS h FROM symbols WHERE id <> '' AND octet_length(body_tokens) >= 4 GROUP BY id),
b AS (SELECT id, k, CAST(('0x' || substr(h, CAST(2 * k - 1 AS BIGINT), 2)) AS INTEGER) AS x FROM (SELECT id, h, unnest(range(1, length(h) // 2 + 1)) AS k FROM t)),
w AS (SELECT a.id, (31 * a.x + c.x) % 128 AS bucket, 1.0 AS w FROM b a JOIN b c ON c.id = a.id AND c.k = a.k + 1 UNION ALL SELECT id, x % 128, 0.5 FROM b),
s AS (SELECT id, bucket, sum(w) AS w FROM w GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM s GROUP BY 1)
SELECT s.id, CAST(bucket AS INTEGER) AS bucket, round(w / n, 6) AS value FROM s JOIN n ON n.id = s.id"""


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Scored duplicates: all pairs of symbols of a category with a similarity from 65 to 95."""
    return similarity.duplicates(_entries(spark, folder))


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("category"), F.col("embedding").alias("vec"))


def knn_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest embeddings of the same label for every id divisible by 20."""
    v = _embedded(spark, folder)
    return similarity.nearest(v, v.where("id % 20 = 0"), 5).select("id", "other", F.round("similarity", 5).alias("similarity"))


QUERIES["near_duplicates"], QUERIES["knn_embedding"] = near_duplicates, knn_embedding
SQL["knn_embedding"] = """
SELECT id, other, round(s, 5) AS similarity FROM (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE r <= 5"""
QUERIES["project_vector"] = lambda spark, folder: _embedded(spark, folder).select("id", F.posexplode(T.project(F.col("vec"))).alias("bucket", "v")).where("v <> 0").select("id", "bucket", F.round("v", 6).alias("value"))
SQL["project_vector"] = """
WITH x AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
p AS (SELECT id, (k * 2654435761 % 4294967296) % 128 AS bucket, sum(CASE WHEN k * 2654435761 % 4294967296 >= 2147483648 THEN -v ELSE v END) AS v FROM x GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(v * v)) AS n FROM p GROUP BY 1)
SELECT p.id, CAST(bucket AS INTEGER) AS bucket, round(v / n, 6) AS value FROM p JOIN n ON n.id = p.id WHERE v <> 0"""


def token_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Edit similarity of each symbol's tokens with those of the symbol before it in its file."""
    s = table(spark, folder, "symbols").where("id <> '' AND octet_length(body_tokens) > 0").select("id", "file_path", "ord", "body_tokens").dropDuplicates(["id"])
    nxt = s.select("file_path", (F.col("ord") + 1).alias("ord"), F.col("id").alias("before"), F.col("body_tokens").alias("b"))
    return s.join(nxt, ["file_path", "ord"]).select("id", "before", T.edit_similarity(F.col("body_tokens"), F.col("b")).alias("similarity"))


QUERIES["token_similarity"] = token_similarity


def rerank(spark: SparkSession, folder: str) -> DataFrame:
    """All near duplicates and the five nearest of every symbol, rescored with the symbols' token-pair vectors (which stand in for embeddings)."""
    e = _entries(spark, folder)
    scored = durable(similarity.duplicates(e)).df
    semantic = similarity.nearest_of_all(e, 5, 0.8 - 1e-6).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return similarity.rerank(scored, semantic, e.select("id", "vec"), e, 0, 100)


QUERIES["rerank"] = rerank
