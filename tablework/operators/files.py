"""File inventories ``(path, length, ...)``: sizes, directories, picks and rename plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.text import base_name, fmt_size, parent_dir, starts_with_match
from tablework.plans.skew import lookup_join


def size_filter(df: DataFrame, max_size: int | None = None, min_size: int = 1_048_576,
                length: str = "length") -> DataFrame:
    """Small files (``<= max_size``) when that is given, else large ones (``> min_size``)."""
    if max_size is not None:
        return df.where(F.col(length) <= max_size)
    return df.where(F.col(length) > min_size)


def impact(df: DataFrame, kind: str = "kind", length: str = "length") -> DataFrame:
    """One row: how many files and directories, and the files' total size."""
    is_file = F.col(kind) == "file"
    total = F.coalesce(F.sum(F.when(is_file, F.col(length))), F.lit(0)).cast("bigint")
    return (df.agg(F.count_if(is_file).alias("files"),
                   F.count_if(F.col(kind) == "dir").alias("dirs"),
                   total.alias("total_size"))
            .withColumn("size_text", fmt_size(F.col("total_size"))))


def line_count(df: DataFrame, text: str = "value") -> DataFrame:
    """One row: newline characters over all texts."""
    per_text = F.regexp_count(text, F.lit("\n")).cast("bigint")
    return df.agg(F.coalesce(F.sum(per_text), F.lit(0)).alias("lines"))


def _ancestors(directory: Column) -> Column:
    """``a/b/c`` gives ``a``, ``a/b`` and ``a/b/c``; the root itself is not listed."""
    parts = F.split(F.regexp_replace(directory, "^/", ""), "/")
    lead = F.when(directory.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda k: F.concat(lead, F.array_join(F.slice(parts, F.lit(1), k), "/")))


def _by_directory(files: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates per directory that directly holds files (the root left out)."""
    return (files.withColumn("dir", parent_dir(F.col("path"))).where("dir <> ''")
            .groupBy("dir").agg(*aggregates))


def sparse_leaf_dirs(files: DataFrame, n: int) -> DataFrame:
    """Directories without subdirectories that hold at most ``n`` files.

    Directories that hold no file at any depth cannot be seen in an inventory.
    """
    counted = _by_directory(files, F.count(F.lit(1)).alias("files"))
    every = counted.select(F.explode_outer(_ancestors(F.col("dir"))).alias("dir")).distinct()
    inner = every.select(parent_dir(F.col("dir")).alias("dir")).distinct()
    return counted.where(F.col("files") <= n).join(inner, "dir", "left_anti")


def emptied_dirs(files: DataFrame, max_size: int) -> DataFrame:
    """Directories that hold nothing more once files of at most ``max_size`` are gone.

    Files are counted per directory first, so only directories are spread
    over their ancestors.
    """
    counted = _by_directory(files, F.count_if(F.col("length") > max_size).alias("left"),
                            F.count(F.lit(1)).alias("files"))
    return (counted.select(F.explode_outer(_ancestors(F.col("dir"))).alias("dir"), "left", "files")
            .groupBy("dir").agg(F.sum("left").alias("left"), F.sum("files").alias("files"))
            .where("left = 0").select("dir", "files"))


def _with_best(files: DataFrame, group: str, exts: Sequence[str], path: str) -> DataFrame:
    ranks = [F.when(F.endswith(F.col(path), F.lit(ext)), i) for i, ext in enumerate(exts)]
    ranked = files.withColumn("_rank", F.coalesce(*ranks))
    best = ranked.groupBy(group).agg(F.min("_rank").alias("_best"))
    return lookup_join(ranked, best, [group], "left")


def best_format(files: DataFrame, group: str, exts: Sequence[str] = (".epub", ".mobi", ".txt"),
                path: str = "path") -> DataFrame:
    """All files of the first format in ``exts`` that a group has.

    Files that belong to no group (NULL) are kept as they are.
    """
    best = _with_best(files, group, exts, path)
    return best.where((F.col("_rank") == F.col("_best")) | F.col(group).isNull()).select(*files.columns)


def no_format(files: DataFrame, group: str, exts: Sequence[str] = (".epub", ".mobi", ".txt"),
              path: str = "path") -> DataFrame:
    """All files of the groups that have none of the formats."""
    best = _with_best(files, group, exts, path)
    return best.where(F.col("_best").isNull() & F.col(group).isNotNull()).select(*files.columns)


def _first_matches(files: DataFrame, group: str, name: str, patterns: Sequence[str]) -> DataFrame:
    number = F.coalesce(*[F.when(starts_with_match(F.col(name), p), i + 1)
                          for i, p in enumerate(patterns)])
    picked = F.min(F.when(number.isNotNull(), F.struct(number.alias("pattern_no"), F.col(name))))
    return files.groupBy(group).agg(picked.alias("_pick"), F.count(F.lit(1)).alias("files"))


def first_match(files: DataFrame, group: str, name: str, patterns: Sequence[str]) -> DataFrame:
    """One file per group: the first name under the first pattern that matches any file."""
    picks = _first_matches(files, group, name, patterns).where("_pick is not null")
    return picks.select(group, "_pick.pattern_no", f"_pick.{name}")


def unmatched_groups(files: DataFrame, group: str, name: str, patterns: Sequence[str]) -> DataFrame:
    """Groups in which no file matches any pattern, with their file count."""
    return _first_matches(files, group, name, patterns).where("_pick is null").select(group, "files")


def pair_by_pattern(left: DataFrame, right: DataFrame, lpat: str = r"([0-9]{3})",
                    rpat: str = r"第([0-9]{3})話 「(.*?)」", name: str = "name") -> DataFrame:
    """Pair two name lists by a key inside the names.

    The left key is the first match of ``lpat``; the right key and title are
    the groups of ``rpat``, at any place in the name. Each left name gets the
    first right name (in name order) with its key; left names without a
    partner are left out.
    """
    keyed = (left.select(F.col(name).alias("left_name"),
                         F.regexp_extract(name, lpat, 1).alias("key")).where("key <> ''"))
    keys = F.regexp_extract_all(F.col(name), F.lit(rpat), F.lit(1))
    titles = F.regexp_extract_all(F.col(name), F.lit(rpat), F.lit(2))
    found = right.select(F.col(name), F.posexplode_outer(F.arrays_zip(
        keys.alias("key"), titles.alias("title"))).alias("_at", "_m")).where("_at is not null")
    first = (found.groupBy(F.col("_m.key").alias("key"))
             .agg(F.min(F.struct(F.col(name), F.col("_at"), F.col("_m.title").alias("title"))).alias("_r")))
    paired = lookup_join(keyed, first, ["key"], "inner")
    return paired.select("left_name", F.col(f"_r.{name}").alias("right_name"), "key",
                         F.col("_r.title").alias("title"),
                         F.concat_ws(".", "key", "_r.title").alias("new_name"))


def without_existing(plan: DataFrame, existing: DataFrame, target: str = "target") -> DataFrame:
    """Plan rows whose target does not exist yet; ``existing`` has the same column name."""
    return lookup_join(plan, existing.select(target).distinct(), [target], "left_anti")


def existing_conflicts(plan: DataFrame, existing: DataFrame, target: str = "target") -> DataFrame:
    """Plan rows whose target exists already."""
    return lookup_join(plan, existing.select(target).distinct(), [target], "left_semi")


def claim_targets(plan: DataFrame, target: str = "target", order: str = "path") -> DataFrame:
    """Add ``granted``: true for the first row (by ``order``) that claims a target."""
    first = plan.groupBy(target).agg(F.min(order).alias("_first"))
    claimed = lookup_join(plan, first, [target], "left")
    return claimed.withColumn("granted", F.col(order) == F.col("_first")).select(*plan.columns, "granted")


def limit_plan(plan: DataFrame, n: int, order: str = "path") -> DataFrame:
    """The first ``n`` rows in the given order; all rows when ``n <= 0``."""
    return plan if n <= 0 else plan.orderBy(order).limit(n)


def depth_order(plan: DataFrame, path: str = "path") -> DataFrame:
    """Children before parents: deepest paths first, ``depth`` added."""
    deep = plan.withColumn("depth", F.size(F.split(path, "/")))
    return deep.orderBy(F.desc("depth"), path)


def copy_plan(files: DataFrame, patterns: Sequence[str], existing: DataFrame, kind: str = "kind", book: str = "book",
              file: str = "file") -> DataFrame:
    """Which file of each ``kind/book`` folder is copied to ``kind/``: (kind, book, file, path, target, action).

    One file per folder, the first name under the first pattern that matches any. ``action`` is ``copy``,
    ``target_exists`` (``existing`` has the target), ``target_claimed`` (an earlier folder takes it) or ``unmatched``,
    where no file fits (file, path and target are NULL then).
    """
    number = F.coalesce(*[F.when(starts_with_match(F.col(file), p), i + 1) for i, p in enumerate(patterns)])
    picks = files.groupBy(kind, book).agg(F.min(F.when(number.isNotNull(), F.struct(number.alias("no"), F.col(file)))).alias("_pick")) \
        .select(kind, book, F.col("_pick")[file].alias(file))
    named = picks.withColumns({"path": F.when(F.col(file).isNotNull(), F.concat_ws("/", kind, book, file)),
                               "target": F.when(F.col(file).isNotNull(), F.concat_ws("/", kind, file))})
    there = existing.select("target").distinct().withColumn("_there", F.lit(True))
    first = named.where("target is not null").groupBy("target").agg(F.min("path").alias("_first"))
    judged = lookup_join(lookup_join(named, there, ["target"], "left"), first, ["target"], "left")
    action = (F.when(F.col("target").isNull(), "unmatched").when(F.col("_there"), "target_exists")
              .when(F.col("path") == F.col("_first"), "copy").otherwise("target_claimed"))
    return judged.select(kind, book, file, "path", "target", action.alias("action"))


def rename_plan(files: DataFrame, rename: Callable[[DataFrame], DataFrame],
                limit: int = -1) -> DataFrame:
    """What a rename over an inventory would do, one row per matching file.

    ``rename`` adds ``target`` (see ``rename_full`` and ``rename_prefix``).
    ``action`` is ``rename``, ``target_exists`` or ``target_claimed`` (an
    earlier file takes it). With a limit only the first renames are kept.
    """
    named = rename(files)
    existing = files.select(F.col("path").alias("target"), F.lit(True).alias("_exists"))
    targets = (named.groupBy("target").agg(F.min("path").alias("_first"))
               .join(existing, "target", "left"))
    judged = lookup_join(named, targets, ["target"], "left")
    action = (F.when(F.col("_exists"), "target_exists")
              .when(F.col("path") == F.col("_first"), "rename").otherwise("target_claimed"))
    plan = judged.select(*files.columns, "target", action.alias("action"))
    return limit_plan(plan.where("action = 'rename'"), limit) if limit > 0 else plan
