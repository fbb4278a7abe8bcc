"""Dependency graph: edges, resolution to modules, matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.paths import (
    last_segment,
    node_key,
    parent_dir,
    strip_code_suffix,
)
from corpuscope.functions.windows import KEYS, lengths_of, window_keys
from corpuscope.operators.joins import grid_join
from corpuscope.session import materialize

NO_DEPENDENCIES = "_No dependencies_"


def dependency_graph(deps: DataFrame) -> DataFrame:
    """Distinct ``path, specifier`` with the first position as ``ord``."""
    return deps.groupBy("path", "specifier").agg(F.min("ord").alias("ord"))


def distinct_specifiers(deps: DataFrame) -> DataFrame:
    return deps.select("specifier").distinct()


def dependency_kind_counts(deps: DataFrame) -> DataFrame:
    """``path, imports, requires, distinct_deps``.

    Two plain aggregates on the same leading key, so no row is expanded for the
    distinct count.
    """
    per_specifier = deps.groupBy("path", "specifier").agg(
        F.count_if(F.col("kind") == "import").alias("imports"),
        F.count_if(F.col("kind") == "require").alias("requires"),
    )
    return per_specifier.groupBy("path").agg(
        F.sum("imports").alias("imports"),
        F.sum("requires").alias("requires"),
        F.count("*").alias("distinct_deps"),
    )


def module_edges(modules: DataFrame) -> DataFrame:
    """``path, specifier, ord`` straight from the module table (already distinct)."""
    return modules.select("path", F.posexplode("dependencies").alias("ord", "specifier")).select(
        "path", "specifier", "ord"
    )


def files_with_deps(files: DataFrame, deps: DataFrame) -> DataFrame:
    """Files with their specifiers in first-seen order, an empty array when none."""
    graph = dependency_graph(deps)
    listed = graph.groupBy("path").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "specifier"))), lambda s: s.specifier
        ).alias("dependencies")
    )
    none = F.array().cast("array<string>")
    return files.join(listed, "path", "left").withColumn(
        "dependencies", F.coalesce("dependencies", none)
    )


def dependency_list(dependencies: Column) -> Column:
    """Bullet list of specifiers, or a marker when there are none."""
    bullets = F.transform(dependencies, lambda d: F.concat(F.lit("- `"), d, F.lit("`")))
    return F.when(F.size(dependencies) > 0, F.array_join(bullets, "\n")).otherwise(NO_DEPENDENCIES)


def deps_per_file(modules: DataFrame) -> DataFrame:
    """``path, dep_list`` for rows that carry a ``dependencies`` array."""
    return modules.select("path", dependency_list(F.col("dependencies")).alias("dep_list"))


def _first(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.min("seq").alias("seq"))


def _answered(asked: DataFrame, held: DataFrame, suffixes: bool) -> DataFrame:
    """``text, seq``: for each of the ``asked`` texts the earliest of the ``held`` ones
    (``text, seq``) that contains it or is contained in it, or, with ``suffixes``, ends
    with it or is an end of it.

    Both tests are equi joins on hashes of substrings. Of either side only substrings
    are made whose length occurs on the other one, and those of the held texts are
    reduced map-side to the earliest module.
    """
    asked = materialize(asked.withColumn("id", F.monotonically_increasing_id()), "asked-texts")
    within = window_keys(held, "text", "seq", lengths_of(asked, "text"), suffixes)
    within = within.groupBy(*KEYS).agg(F.min("id").alias("seq"))
    outside = window_keys(asked, "text", "id", None).join(within, [*KEYS]).select("id", "seq")
    whole = window_keys(held, "text", "seq", None).withColumnRenamed("id", "seq")
    # A substring that many texts share is one row of ``whole``: Spark splits the other side.
    inside = window_keys(asked, "text", "id", lengths_of(held, "text"), suffixes).join(whole, [*KEYS]).select("id", "seq")
    first = outside.unionByName(inside).groupBy("id").agg(F.min("seq").alias("seq"))
    return asked.join(first, "id").select("text", "seq")


def _resolve_specifiers(specs: DataFrame, modules: DataFrame, match_empty_dir: bool) -> DataFrame:
    """``specifier, seq, pass`` for every specifier some module answers.

    Every test is a string containment between a specifier and a module, which
    as a theta join would compare all pairs; see ``_answered``.
    """
    last = last_segment(F.col("specifier"))
    parts = specs.select(
        "specifier",
        strip_code_suffix(last).alias("dep_name"),
        parent_dir(F.col("specifier")).alias("dep_dir"),
    )
    located = modules.select(
        "seq",
        "name",
        last_segment(F.col("path")).alias("base"),
        parent_dir(F.col("path")).alias("dir"),
    )

    bases = _first(located, "base")
    wanted = F.array_distinct(F.array("specifier", "dep_name"))
    exact = (
        parts.select("specifier", F.explode(wanted).alias("base"))
        .where(F.col("base") != "")
        .join(bases, "base")
    )
    # Distinct specifiers are few next to edges; stored once, read by every test.
    tried = materialize(parts.join(_first(exact, "specifier"), "specifier", "left"), "specifiers")
    rest = tried.where(F.col("seq").isNull()).drop("seq")
    dirs = materialize(_first(located.withColumnRenamed("dir", "text"), "text"), "module-dirs")
    names = materialize(_first(located.withColumnRenamed("name", "text"), "text"), "module-names")
    if not match_empty_dir:
        dirs = dirs.where(F.col("text") != "")
    tails = rest.select(F.col("dep_dir").alias("text")).distinct()
    if not match_empty_dir:
        tails = tails.where(F.col("text") != "")
    # With the empty directory the first module of all has already answered.
    named = rest.where(F.col("dep_name") != "")
    if match_empty_dir:
        named = named.where(F.col("dep_dir") != "")
    heads = named.select(F.col("dep_name").alias("text")).distinct()
    by_dir = _answered(tails, dirs, suffixes=True).withColumnRenamed("text", "dep_dir")
    by_name = _answered(heads, names, suffixes=False).withColumnRenamed("text", "dep_name")
    # Lookups are unique per key; a directory that most specifiers have is split by Spark.
    partial = rest.join(by_dir, "dep_dir").select("specifier", "seq")
    partial = partial.unionByName(named.join(by_name, "dep_name").select("specifier", "seq"))
    exact = tried.where(F.col("seq").isNotNull()).select("specifier", "seq", F.lit(1).alias("pass"))
    found = exact.unionByName(_first(partial, "specifier").withColumn("pass", F.lit(2)))
    return materialize(found, "resolved-specifiers")


def _holds(specifier: Column, path: Column, name: Column) -> Column:
    """The loose test itself, for one specifier and one module."""
    dep_name, dep_dir = strip_code_suffix(last_segment(specifier)), parent_dir(specifier)
    folder = parent_dir(path)
    by_dir = folder.endswith(dep_dir) | dep_dir.endswith(folder)
    return by_dir | ((dep_name != "") & (F.contains(name, dep_name) | F.contains(dep_name, name)))


def resolve_dependencies(
    deps: DataFrame, modules: DataFrame, match_empty_dir: bool = True
) -> DataFrame:
    """``src_path, specifier, dst_path, pass``, nulls where nothing matches.

    Pass 1: the module's file name equals the specifier or its bare last segment.
    Pass 2: the earliest module whose directory ends with the specifier's, or the
    reverse, or whose name contains the segment, or the reverse. A specifier
    without a slash has the empty directory, with which every directory ends, so
    it resolves to the first module; ``match_empty_dir=False`` drops that case.

    ``modules`` is read several times: give it a stored table, not a plan that
    lexes the corpus.
    """
    specs = distinct_specifiers(deps)
    hits = _resolve_specifiers(specs, modules, match_empty_dir)
    winners = modules.select("seq", F.col("path").alias("dst_path"), F.col("name").alias("__name"))
    winners = winners.join(hits.select("seq").distinct(), "seq")
    sound = (F.col("pass") == 1) | _holds(F.col("specifier"), F.col("dst_path"), F.col("__name"))
    target = F.when(sound, F.col("dst_path")).otherwise(F.raise_error(F.lit("two substrings share a hash")))
    # A module that answers very many specifiers, and a specifier that very many files
    # have, are hot on the left side only: both joins are left to Spark's skew handling.
    targets = hits.join(winners, "seq").select("specifier", target.alias("dst_path"), "pass")
    edges = deps.select(F.col("path").alias("src_path"), "specifier")
    return edges.join(targets, "specifier", "left").select("src_path", "specifier", "dst_path", "pass")


def internal_edges(resolved: DataFrame) -> DataFrame:
    """``src_key, dst_key`` for every edge that resolves."""
    return resolved.where(F.col("dst_path").isNotNull()).select(
        node_key(F.col("src_path")).alias("src_key"), node_key(F.col("dst_path")).alias("dst_key")
    )


def external_dependencies(deps: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges of ``deps`` that no module answers."""
    inside = resolved.where(F.col("dst_path").isNotNull()).select(
        F.col("src_path").alias("path"), "specifier"
    )
    return deps.join(inside, ["path", "specifier"], "left_anti")


def matrix_factors(modules: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``src, specifier``, ``specifier, dst``): the matrix as a product of two tables,
    as long as the edges and the spellings, where the matrix itself may have a row for
    every source and target that meet in one name.

    A source depends on a target when one of its specifiers is the target's path,
    name, or path without ``.ts`` or ``.js``.
    """
    path = F.col("path")
    spellings = F.array_distinct(
        F.array(
            path,
            F.col("name"),
            F.regexp_replace(path, r"\.ts$", ""),
            F.regexp_replace(path, r"\.js$", ""),
        )
    )
    targets = modules.select(F.explode(spellings).alias("specifier"), F.col("path").alias("dst")).distinct()
    return deps.select(F.col("path").alias("src"), "specifier").distinct(), targets


def dependency_matrix(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """``src, dst, has_dep``: the pairs that hold. Pairs not listed do not.

    The two factors are joined on a grid, so that a name which both many sources and
    many targets have is many tasks.
    """
    edges, targets = (materialize(side, "matrix-side") for side in matrix_factors(modules, deps))
    pairs = grid_join(edges, targets, "specifier", ["src"], ["dst"])
    return pairs.select("src", "dst").distinct().withColumn("has_dep", F.lit(True))
