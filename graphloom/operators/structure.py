"""Structural queries without iteration: hubs, orphans, instability, coupling and design smells.

Each takes a ``Graph`` and gives a DataFrame in a total order (the measure, then the id). ``top`` = 0
means no limit. Joins are on symbol ids or packages; degree counts are aggregates, so a symbol with
a share of all edges needs no special treatment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.views import Graph


def _top(df: DataFrame, *order: Column, top: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return out.limit(top) if top else out


def hubs(g: Graph, threshold: int = 10, top: int = 0) -> DataFrame:
    """Symbols with at least ``threshold`` edges in or out."""
    rows = g.fans().where((F.col("fan_in") >= threshold) | (F.col("fan_out") >= threshold))
    return _top(rows, (F.col("fan_in") + F.col("fan_out")).desc(), F.col("id"), top=top)


def orphans(g: Graph) -> DataFrame:
    """Symbols nothing refers to, contains, or is contained by; modules left out."""
    used = g.uses.select(F.col("dst").alias("id"))
    held = g.contains.select(F.col("dst").alias("id")).unionAll(g.contains.select("src"))
    return g.symbols.where("category <> 'module'").join(used.unionAll(held).distinct(), "id", "left_anti").select("id", "name", "kind").orderBy("id")


def god_symbols(g: Graph, threshold: int = 15) -> DataFrame:
    """Symbols that contain at least ``threshold`` others; modules left out."""
    n = g.contains.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("children")).where(F.col("children") >= threshold)
    return n.join(g.symbols.where("category <> 'module'").select("id"), "id", "left_semi").orderBy(F.col("children").desc(), "id")


def instability(g: Graph) -> DataFrame:
    """Ce / (Ca + Ce) of types and modules that use others."""
    rows = g.fans().where("fan_out > 0").join(g.symbols.where("category IN ('type', 'module')").select("id"), "id", "left_semi")
    return rows.select("id", "fan_in", "fan_out", F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 6).alias("instability")).orderBy(F.col("instability").desc(), "id")


def dependency_weight(g: Graph, top: int = 0) -> DataFrame:
    """Edges between packages."""
    return _top(g.package_edges(), F.col("weight").desc(), F.col("src"), F.col("dst"), top=top)


def _package_instability(g: Graph) -> DataFrame:
    e = g.package_edges()
    both = e.select(F.col("src").alias("package"), F.col("weight").alias("ce"), F.lit(0).alias("ca")).unionAll(e.select("dst", F.lit(0), "weight"))
    return both.groupBy("package").agg(F.sum("ce").alias("ce"), F.sum("ca").alias("ca")).withColumn("i", F.col("ce") / (F.col("ce") + F.col("ca")))


def main_sequence(g: Graph, least: float = 0.1) -> DataFrame:
    """|A + I - 1| of packages with types; abstract are interfaces, traits, abstract classes and types marked so."""
    types = g.symbols.where("category = 'type'")
    abstract = F.col("kind").isin("interface", "abstract_class", "trait") | F.col("abstract")
    a = types.groupBy("package").agg(F.count("*").alias("types"), F.count_if(abstract).alias("abstract_types"))
    rows = a.join(_package_instability(g).select("package", "i"), "package", "left").withColumn("i", F.coalesce("i", F.lit(0.0))).withColumn("a", F.col("abstract_types") / F.col("types"))
    rows = rows.withColumn("distance", F.abs(F.col("a") + F.col("i") - 1)).where(F.col("distance") >= least)
    return rows.select("package", "types", "abstract_types", F.round("i", 6).alias("instability"), F.round("distance", 6).alias("distance")).orderBy(F.col("distance").desc(), "package")


#: Ranks of layers by folder name (fixed values).
LAYERS = {
    "handler": 0, "handlers": 0, "controller": 0, "controllers": 0, "api": 0, "route": 0, "routes": 0, "cmd": 0,
    "service": 1, "services": 1, "usecase": 1, "usecases": 1, "domain": 1,
    "model": 2, "models": 2, "entity": 2, "entities": 2,
    "repo": 3, "repository": 3, "store": 3, "db": 3, "database": 3, "infra": 3, "infrastructure": 3,
}


def _layers(g: Graph) -> DataFrame:
    """(id, layer, level) by the deepest folder with a layer's name."""
    names = F.create_map(*[x for k, v in LAYERS.items() for x in (F.lit(k), F.lit(v))])
    parts = F.split(F.lower("package"), "/")
    hit = F.filter(parts, lambda p: F.map_contains_key(names, p))
    rows = g.symbols.select("id", hit.alias("hit")).where(F.size("hit") > 0)
    return rows.select("id", F.try_element_at("hit", F.lit(-1)).alias("layer")).withColumn("level", names[F.col("layer")])


def layer_violations(g: Graph) -> DataFrame:
    """Uses that run from a lower to a higher layer; imports left out."""
    lay = _layers(g)
    e = g.uses.where("kind <> 'imports'").select("src", "dst", "kind")
    rows = e.join(lay.select(F.col("id").alias("src"), F.col("layer").alias("from_layer"), F.col("level").alias("a")), "src").join(lay.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer"), F.col("level").alias("b")), "dst")
    return rows.where("a > b AND from_layer <> to_layer").select("src", "dst", "kind", "from_layer", "to_layer").orderBy("src", "dst", "kind")


def shotgun_surgery(g: Graph, callers: int = 2, members: int = 3) -> DataFrame:
    """Symbols of a package with the same multiset of callers, as a fixed-size signature plus counts.

    The multiset is compared by order-free sums over two caller hashes and its size, so no task
    collects the callers of a popular symbol.
    """
    a, b = F.xxhash64("src"), F.xxhash64(F.reverse("src"), F.lit(1))
    sums = g.uses.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.sum(a.cast("decimal(38,0)")).alias("h1"), F.sum(b.cast("decimal(38,0)")).alias("h2")).where(F.col("callers") >= callers)
    rows = sums.join(g.symbols.where("category <> 'module'").select("id", "package"), "id")
    groups = rows.groupBy("package", "callers", "h1", "h2").agg(F.count("*").alias("targets"), F.min("id").alias("first_target")).where(F.col("targets") >= members)
    return groups.select("package", "callers", "targets", "first_target").orderBy(F.col("targets").desc(), "package", "first_target")


def feature_envy(g: Graph, least: int = 3) -> DataFrame:
    """Callables that use another package more than their own."""
    pack = g.symbols.select("id", "package")
    own = g.symbols.where("category = 'callable'").select(F.col("id").alias("src"), F.col("package").alias("home"))
    refs = g.uses.join(own, "src").join(pack.select(F.col("id").alias("dst"), F.col("package").alias("target")), "dst")
    n = refs.groupBy("src", "home", "target").agg(F.count("*").alias("n"))
    per = n.groupBy("src", "home").agg(
        F.sum(F.when(F.col("target") == F.col("home"), F.col("n")).otherwise(0)).alias("own"),
        F.min(F.when(F.col("target") != F.col("home"), F.struct((-F.col("n")).alias("m"), "target"))).alias("best"),
    )
    rows = per.where("best IS NOT NULL").select(F.col("src").alias("id"), F.col("best.target").alias("target"), (-F.col("best.m")).alias("foreign_uses"), F.col("own").alias("own_uses"))
    return rows.where((F.col("foreign_uses") > F.col("own_uses")) & (F.col("foreign_uses") >= least)).orderBy((F.col("foreign_uses") - F.col("own_uses")).desc(), "id")


def stable_dependency_violations(g: Graph, least: float = 0.3) -> DataFrame:
    """Package edges towards a clearly less stable package."""
    i = _package_instability(g).select("package", "i")
    rows = g.package_edges().join(i.select(F.col("package").alias("src"), F.col("i").alias("a")), "src").join(i.select(F.col("package").alias("dst"), F.col("i").alias("b")), "dst")
    rows = rows.where(F.col("b") - F.col("a") > least)
    return rows.select("src", "dst", F.round("a", 6).alias("from_instability"), F.round("b", 6).alias("to_instability")).orderBy(F.round(F.col("b") - F.col("a"), 6).desc(), "src", "dst")


def interface_segregation(g: Graph, members: int = 4, least: float = 0.6) -> DataFrame:
    """Interfaces whose best implementor provides too small a part of their members, by name."""
    names = g.symbols.select("id", "name")
    held = g.contains.select(F.col("src").alias("id"), F.col("dst").alias("m"))
    inter = g.symbols.where("kind IN ('interface', 'trait', 'protocol')").select("id")
    size = held.join(inter, "id", "left_semi").groupBy("id").agg(F.count("*").alias("members")).where(F.col("members") >= members)
    wanted = held.join(size, "id").join(names.withColumnRenamed("id", "m"), "m").select("id", "name").distinct()
    impl = g.last_parent(["inherits", "implements"]).select(F.col("parent").alias("id"), F.col("child").alias("impl")).join(size, "id", "left_semi")
    given = impl.join(held.select(F.col("id").alias("impl"), "m"), "impl").join(names.withColumnRenamed("id", "m"), "m").select("id", "impl", "name")
    hits = given.join(wanted, ["id", "name"]).groupBy("id", "impl").agg(F.count("*").alias("n"))
    best = impl.join(hits, ["id", "impl"], "left").groupBy("id").agg(F.max(F.coalesce("n", F.lit(0))).alias("used"))
    rows = best.join(size, "id").withColumn("share", F.col("used") / F.col("members")).where(F.col("share") < least)
    return rows.select("id", "members", "used", F.round("share", 6).alias("share")).orderBy(F.col("members").desc(), "id")
