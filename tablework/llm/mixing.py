"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.common import WORD, boxed, clear_names, running_sum, scratch


def word_count(text):
    """Number of runs of other characters than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``, each source's share of the sum of all sizes.

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at ``epochs`` times its
    source's size, and what is above goes to the others by weight until none is above. Sorted by size over
    weight, the sources that are stopped come first, so one pass of running sums finds them. The table has one
    row a source, and these windows read it in one task.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    shares = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * epochs) \
        .withColumn("_total", F.sum("source_size").over(everything).cast("double")) \
        .withColumn("_all", F.sum("_w").over(everything))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    cut = shares.withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) \
        .withColumn("_ws", F.coalesce(F.sum("_w").over(before), F.lit(0.0))) \
        .withColumn("_stopped", (F.col("_total") - F.col("_caps")) * F.col("_w") > F.col("_cap") * (F.col("_all") - F.col("_ws")))
    of_stopped = lambda c: F.sum(F.when(F.col("_stopped"), F.col(c)).otherwise(0.0)).over(everything)
    target = F.when(F.col("_stopped"), F.col("_cap")).otherwise(
        F.col("_w") * (F.col("_total") - of_stopped("_cap")) / (F.col("_all") - of_stopped("_w")))
    return cut.withColumn("target", target).select("source", "source_size", "target")


def mix_sizes(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: str = "mix") -> DataFrame:
    """Take from ``rows(id, source, size)`` the documents of a mix: source_size, target, copies and taken besides.

    Each source's documents are shuffled by an MD5 of seed and id and queue up ``epochs`` times one after
    the other. A copy's virtual finish time is the source's tokens up to and with it over the source's target. All
    copies of all sources are range-sorted by that time, and the mix takes them until the next would pass
    the total of all sizes. As each source has its target at time 1, its words come near the target, short or over
    by little more than a document.

    Rows equal in id, source and size stand together: they take the same number of copies. Empty documents
    take none. Every number is the same in each run, whatever the partitioning.
    """
    units = scratch(
        rows.groupBy("id", "source", "size").agg(F.count("*").alias("m"))
        .withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("source_size"))
    targets = scratch(source_targets(sizes, weights, epochs), "mix-targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    full = units.where("size > 0").withColumn("words", F.col("m") * F.col("size"))
    queued = running_sum(full, ["source"], ["key", "id", "size"], "words", "upto")
    t = targets.withColumnRenamed("source", "_source")
    queued = scratch(queued.join(t, queued["source"].eqNullSafe(t["_source"])).drop("_source"), "mix-queue")
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    place = lambda e: F.struct(finish(e).alias("finish"), F.col("source"), F.col("key"), F.col("id"),
                               F.col("size"), F.lit(e).alias("epoch"))
    copies = queued.select(F.explode(F.array(*[place(e) for e in range(epochs)])).alias("_place"), "words") \
        .select("_place.*", "words")
    order = ["finish", "source", "key", "id", "size", "epoch"]
    over = running_sum(copies, [], order, "words", "sum").where(F.col("sum") > F.lit(total)) \
        .agg(F.min(F.struct(*order)).alias("first")).select("first.*")
    first = over.first()
    if first["finish"] is None:  # nothing to take, or no copy left over
        n = F.lit(epochs if total else 0)
    else:
        end = F.struct(*[F.lit(first[c]).cast(over.schema[c].dataType).alias(c) for c in order])
        n = sum(((place(e) < end).cast("int") for e in range(epochs)), F.lit(0))
    taken = queued.select("id", "source", "size", n.alias("_copies"))
    out = units.alias("u").join(taken.alias("t"), [F.col("u.id").eqNullSafe(F.col("t.id")) & F.col("u.source").eqNullSafe(F.col("t.source"))
                                & (F.col("u.size") == F.col("t.size"))], "left") \
        .select("u.id", "u.source", "u.size", "u.m", F.coalesce("_copies", F.lit(0)).alias("copies"))
    out = out.join(t, out["source"].eqNullSafe(t["_source"])).drop("_source")
    return out.withColumn("taken", F.col("copies").cast("long") * F.col("size"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    Null and empty texts have size 0 and are never taken; a null source is a source. An empty table gives
    no rows. Other columns are not read.
    """
    rows = clear_names(docs, id_col, source_col, text_col).toDF("id", "source", "text") \
        .select("id", "source", word_count(F.col("text")).alias("size"))
    return mix_sizes(rows, weights, epochs) \
        .select(F.explode(F.sequence(F.lit(1), F.col("m"))).alias("_i"), "*") \
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """``docs`` as mixed: each row as many times as the mix takes it, with all its columns."""
    sized = boxed(docs, id=id_col, source=source_col, text=text_col).withColumn("size", word_count(F.col("text")))
    plan = mix_sizes(sized.select("id", "source", "size"), weights, epochs).where("copies > 0") \
        .select(F.col("id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size"), "copies")
    return sized.join(plan, F.expr("id <=> of_id and source <=> of_source and size = of_size")) \
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
