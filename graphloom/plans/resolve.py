"""Name resolution across files as joins and windows: ids, imports, nearest definition, module containment, aliases.

The order of rows in a file (``ord``) decides first and last; it is always carried explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import durable
from graphloom.plans.views import extension_of, folder_of


def effective_scope(scoped: Column, name: Column) -> Column:
    return F.coalesce(F.when(scoped != "", scoped), name)


def drop_repeated_modules(symbols: DataFrame) -> DataFrame:
    """The first module of a name in a folder stays (by file, then ord); other symbols all stay."""
    w = Window.partitionBy(folder_of(F.col("file_path")), "name").orderBy("file_path", "ord")
    modules = symbols.where("category = 'module'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return symbols.where("category IS NULL OR category <> 'module'").unionByName(modules)


def global_ids(symbols: DataFrame) -> DataFrame:
    """Adds ``gid``: file::scope, and #n for the n-th repeat (from 1) of a scope in its file."""
    scope = effective_scope(F.col("scoped_name"), F.col("name"))
    rows = symbols.withColumn("_s", scope)
    nth = F.row_number().over(Window.partitionBy("file_path", "_s").orderBy("ord")) - 1
    base = F.concat_ws("::", "file_path", "_s")
    return rows.withColumn("_n", nth).withColumn("gid", F.when(F.col("_n") > 0, F.concat(base, F.lit("#"), F.col("_n"))).otherwise(base)).drop("_s", "_n")


def short_ids(symbols: DataFrame) -> DataFrame:
    """(file_path, ord, sid): S1, S2, ... over files in order and symbols in order, from per-file counts and a running sum of files."""
    inside = symbols.withColumn("_r", F.row_number().over(Window.partitionBy("file_path").orderBy("ord")))
    per = durable(symbols.groupBy("file_path").agg(F.count("*").alias("n")).repartitionByRange("file_path").withColumn("p", F.spark_partition_id()))
    within = per.df.withColumn("a", F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = per.df.groupBy("p").agg(F.sum("n").alias("n"))  # one row per partition
    parts = parts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    starts = within.join(F.broadcast(parts), "p").select("file_path", (F.col("a") + F.col("b")).alias("before"))
    return inside.join(starts, "file_path").select("file_path", "ord", F.concat(F.lit("S"), (F.col("before") + F.col("_r")).cast("string")).alias("sid"))


def first_definitions(symbols: DataFrame) -> DataFrame:
    """(file_path, name, gid): what a name means in its file; the first definition wins."""
    return symbols.groupBy("file_path", "name").agg(F.min(F.struct("ord", "gid"))["gid"].alias("gid"))


def path_distance(a: Column, b: Column) -> Column:
    """Steps up and down between two folders."""
    x, y = (F.filter(F.split(c, "/"), lambda p: (p != "") & (p != ".")) for c in (a, b))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, m: F.struct((s["n"] + F.when(s["on"] & m, 1).otherwise(0)).alias("n"), (s["on"] & m).alias("on")))["n"]
    return F.size(x) + F.size(y) - 2 * common


def _folders_above(folder: Column) -> Column:
    """(depth, above) of a folder, of those around it and of the root."""
    parts = F.filter(F.split(folder, "/"), lambda p: (p != "") & (p != "."))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct((F.size(parts) - k).alias("steps"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))


def _nearest_by_folders(rest: DataFrame, names: DataFrame) -> DataFrame:
    """(file_path, name, gid): the definition of a name fewest folders away, ties to the smaller id. ``rest`` has home, ``names`` there.

    Of a name the least steps down are kept at each folder over a definition, so that a reference looks at the folders over its own,
    never at all definitions of its name; the steps over a common folder are never too few, and over the last one they are right.
    """
    below = names.select("name", "gid", F.inline(_folders_above(folder_of(F.col("there")))))
    below = below.groupBy("name", "above").agg(F.min(F.struct("steps", "gid")).alias("down"))
    up = rest.select("name", "home").distinct().select("name", "home", F.inline(_folders_above(F.col("home"))))
    way = up.join(below, ["name", "above"]).select("name", "home", F.struct((F.col("steps") + F.col("down.steps")).alias("far"), F.col("down.gid").alias("gid")).alias("way"))
    nearest = way.groupBy("name", "home").agg(F.min("way")["gid"].alias("gid"))
    return rest.select("file_path", "name", "home").join(nearest, ["name", "home"]).select("file_path", "name", "gid")


def nearest_definitions(references: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(file_path, name, target, resolved): what each referenced name (file_path, name) stands for.

    First a definition in the same file; else the candidates of that name or scope whose path holds the imported module
    (near the file first, then anywhere; without a match the import says nothing), of those the nearest by folders, ties to
    the smaller id; else a dangling file::name. ``imports``: file_path, name, module, ord (the last import of a name counts, ties by module).
    """
    refs = references.select("file_path", "name").distinct()
    own = first_definitions(symbols)
    hit = refs.join(own, ["file_path", "name"])
    rest = refs.join(own.select("file_path", "name"), ["file_path", "name"], "left_anti")
    scope = effective_scope(F.col("scoped_name"), F.col("name"))
    names = symbols.select("gid", F.col("file_path").alias("there"), F.explode(F.array_distinct(F.array("name", scope))).alias("name"))
    if imports is None:
        rest = rest.withColumn("module", F.lit(None).cast("string"))
    else:
        last = imports.groupBy("file_path", "name").agg(F.max(F.struct("ord", "module"))["module"].alias("module"))
        rest = rest.join(last, ["file_path", "name"], "left")
    plain = F.regexp_replace(F.regexp_replace("module", r"^[./]+", ""), r"[.]", "/")
    rest = rest.withColumn("plain", plain).withColumn("home", folder_of(F.col("file_path")))
    free = F.col("module").isNull() | (F.col("plain") == "")
    best = _nearest_by_folders(rest.where(free), names)
    if imports is not None:
        relative = F.col("module").startswith(".")
        rows = rest.where(~free).join(names, "name")
        inside = F.instr("there", F.col("plain")) > 0
        near = inside & (relative & (folder_of(F.col("there")) == F.col("home")) | ~relative & F.col("there").startswith(F.concat(F.split("home", "/")[0], F.lit("/"))))
        tier = F.when(near, 0).when(inside, 1).otherwise(2)
        rows = rows.withColumn("tier", tier).withColumn("far", path_distance(F.col("home"), folder_of(F.col("there"))))
        best = best.unionByName(rows.groupBy("file_path", "name").agg(F.min(F.struct("tier", "far", "gid"))["gid"].alias("gid")))
    found = hit.select("file_path", "name", "gid").unionByName(best)
    return refs.join(found, ["file_path", "name"], "left").select("file_path", "name", F.coalesce("gid", F.concat_ws("::", "file_path", "name")).alias("target"), F.col("gid").isNotNull().alias("resolved"))


def module_contains(symbols: DataFrame) -> DataFrame:
    """(src, dst, kind): a module contains every symbol of its folder and extension that is no module itself.

    Of modules of one name in a folder only the first (``drop_repeated_modules``) stands for all of them.
    """
    rows = drop_repeated_modules(symbols).withColumn("_d", folder_of(F.col("file_path"))).withColumn("_e", extension_of(F.col("file_path")))
    modules = rows.where("category = 'module'").select("_d", "_e", F.col("gid").alias("src"))
    return modules.join(rows.where("category <> 'module'").select("_d", "_e", F.col("gid").alias("dst")), ["_d", "_e"]).select("src", "dst", F.lit("contains").alias("kind"))


def resolve_aliases(calls: DataFrame, hints: DataFrame, rounds: int = 10) -> DataFrame:
    """(src, dst): calls that follow aliases and returned callables, added up to ``rounds`` times until nothing is new.

    ``hints``: src, dst, ord of alias and return edges; of several targets of a name the first counts. Loops end.
    """
    step = durable(hints.groupBy(F.col("src").alias("dst")).agg(F.min(F.struct("ord", F.col("dst").alias("t")))["t"].alias("to")))
    base = durable(calls.select("src", "dst").distinct())
    front, added, n = base, None, 0
    while n < rounds:
        new = front.df.join(step.df, "dst").select("src", F.col("to").alias("dst")).where("src <> dst").distinct().join(base.df, ["src", "dst"], "left_anti")
        front = durable(new if added is None else new.join(added.df, ["src", "dst"], "left_anti"))
        n += 1
        if not front.df.limit(1).count():
            break
        added = durable(front.df if added is None else added.df.unionByName(front.df))
    return added.df if added is not None else front.df


def without_hints(edges: DataFrame) -> DataFrame:
    """Edges without alias and return hints."""
    return edges.where("kind NOT IN ('aliases', 'returns')")
