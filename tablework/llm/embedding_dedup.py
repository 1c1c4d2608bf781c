"""Near copies among embeddings: spherical k-means cells, blocked cosine products inside them, one kept per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import components, scratch

#: Residents of a cell that one block holds; a task multiplies two blocks, or one with a block of visitors.
BLOCK = 1024
VISITORS = 4096


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def vectors(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each vector in double precision; None for one that can't link: null, zero, or with null or other than finite components."""
    for x in column:
        v = None
        if x.is_valid and len(x.values) and not x.values.null_count:
            v = x.values.to_numpy().astype("<f8")
            v = v if np.isfinite(v).all() and v.any() else None
        yield v


def valid_rows(rows: DataFrame) -> DataFrame:
    """(id, raw, dim, d1, d2) of ``rows(id, embedding)``; all but the id are null for vectors that can't link.

    ``raw`` is the vector scaled so that its largest component is 1 in size, which keeps squares finite; d1 and
    d2 are a digest of it, so that exact copies are known.
    """
    schema = rows.select("id").withColumns({c: F.lit(None).cast(t) for c, t in (
        ("raw", "binary"), ("dim", "int"), ("d1", "long"), ("d2", "long"))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dim, d1, d2 = [], [], [], []
            for v in vectors(batch.column(1)):
                one = None if v is None else (v / np.abs(v).max()).tobytes()
                h = one and xxhash.xxh3_128_digest(one)
                raw.append(one)
                dim.append(one and len(v))
                d1.append(h and int.from_bytes(h[:8], "little", signed=True))
                d2.append(h and int.from_bytes(h[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(dim, pa.int32()),
                                              pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors. Starts from evenly spaced rows; a cell that gets none keeps its centroid."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        for i in range(0, len(x), 8192):
            part = x[i:i + 8192]
            np.add.at(sums, (part @ centres.T).argmax(1), part)
        size = np.sqrt((sums * sums).sum(1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def fit_cells(reps: DataFrame, cell_rows: int, most_cells: int, sample_rows: int) -> dict[int, np.ndarray]:
    """Centroids by dimension, from ``sample_rows`` vectors or so of each; about one cell for ``cell_rows`` vectors."""
    counts = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for dim, n in counts.items():
        share = F.when(F.col("dim") == dim, F.lit(min(1.0, sample_rows / n))).otherwise(share)

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["d1", "d2"])
        x = unit(np.stack([np.frombuffer(r, "<f8") for r in frame["raw"]]))
        k = min(max(1, math.ceil(counts[key[0]] / cell_rows)), most_cells, len(x))
        return pd.DataFrame({"dim": [key[0]], "centres": [k_means(x, k).tobytes()]})

    drawn = F.pmod("d1", F.lit(1 << 30)) < share * F.lit(float(1 << 30))
    fitted = reps.where(drawn).select("dim", "raw", "d1", "d2").groupBy("dim") \
        .applyInPandas(fit, "dim int, centres binary").collect()
    model = {r["dim"]: np.frombuffer(r["centres"], "<f8").reshape(-1, r["dim"]) for r in fitted}
    return {dim: model.get(dim, np.eye(1, dim)) for dim in counts}


def assign(reps: DataFrame, model: dict[int, np.ndarray], margin: float) -> DataFrame:
    """``reps`` with ``home``, the nearest cell, and ``visits``, the other cells where a partner may live.

    A vector with cosine t to x lies in cell c' rather than x's own cell c only if (c - c')x is at most
    sqrt(1 - t * t) * |c - c'|. ``margin`` stands in for sqrt(1 - t * t). The same holds for the partner, so of
    two cells only one sends visitors to the other, and each pair of vectors meets at most once.
    """
    schema = reps.withColumns({"home": F.lit(0), "visits": F.array(F.lit(0))}).schema
    shared = reps.sparkSession.sparkContext.broadcast(model)
    raw_at, dim_at = reps.columns.index("raw"), reps.columns.index("dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                dims = batch.column(dim_at).to_numpy()
                home, visits = np.zeros(len(dims), np.int32), [[]] * len(dims)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    centres = shared.value[int(dim)]
                    x = unit(np.stack([np.frombuffer(batch.column(raw_at)[int(j)].as_buffer(), "<f8") for j in at]))
                    near = x @ centres.T
                    own = near.argmax(1)
                    home[at] = own
                    apart = np.sqrt(np.maximum(2 - 2 * centres[own] @ centres.T, 0))
                    may = near[np.arange(len(at)), own][:, None] - near <= margin * apart + 1e-9
                    cells = np.arange(len(centres))
                    may &= (cells < own[:, None]) == ((cells + own[:, None]) % 2 == 0)  # the lower cell is host if both are even or odd
                    may[np.arange(len(at)), own] = False
                    for j, row in zip(at, may):
                        visits[j] = np.flatnonzero(row).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(visits, pa.list_(pa.int32()))], schema.names)

    return reps.mapInArrow(run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a[i] - b[i]: a root per node, the same for linked ones."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked_blocks(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one task: per row the number of vectors found, and another row of its group.

    The task has either the residents of blocks i and j of a cell, or those of block i and a block of visitors.
    """
    frame = frame.sort_values(["resident", "block", "id"], ignore_index=True)
    i, j, visit = (int(frame[c].iloc[0]) for c in ("i", "j", "visit"))
    x = unit(np.stack([np.frombuffer(r, "<f8") for r in frame["raw"]]))
    block, m, lives = (frame[c].to_numpy() for c in ("block", "m", "resident"))
    right = np.flatnonzero(lives & (block == (i if visit >= 0 else j)))
    left = np.flatnonzero(~lives if visit >= 0 else block == i)
    single = x.astype("<f4")
    slack = (x.shape[1] + 8) * 2.0 ** -23  # more than single precision can be off
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(left), 2048):
        part = left[at:at + 2048]
        near = single[part] @ single[right].T
        p, q = np.nonzero(near >= least - slack)
        ok = near[p, q] >= least + slack
        a, b = part[p], right[q]
        unsure = np.flatnonzero(~ok)
        for some in np.split(unsure, range(65_536, len(unsure), 65_536)):
            ok[some] = np.einsum("ij,ij->i", x[a[some]], x[b[some]]) >= least
        if i == j:
            ok &= a < b
        found_a.append(a[ok])
        found_b.append(b[ok])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    n = np.bincount(a, m[b], len(frame)) + np.bincount(b, m[a], len(frame))
    root = forest(len(frame), a, b)
    out = frame[["id"]].assign(n=n.astype("int64"), mate=frame["id"].to_numpy()[root])
    return out[out["n"] > 0]


def similar_groups(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95,
                   margin: float | None = None, cell_rows: int = 1024, most_cells: int = 4096, sample_rows: int = 50_000) -> DataFrame:
    """One row per row of ``rows``: id, n_links, component_id, kept.

    Two vectors link if their cosine, in double precision, is ``least`` or more. Exact copies (by digest, scaled) are
    compared once and counted. A vector is compared with all of its cell and of the cells within
    ``margin`` (see ``assign``). The default, sqrt(1 - least**2), finds every link for certain, for vectors in no
    clusters at the price of comparing nearly all; a smaller one loses links. What is found is never capped: blocks
    of a large cell are compared pair by pair in separate tasks, and each reports counts and a spanning forest, not pairs.

    Null, zero and non-finite vectors, those with null components, and rows of null id link with nothing and stay; vectors of
    different length don't link. ``kept`` marks the smallest id of a group. Other columns are not read.
    """
    if margin is None:  # a hair more, for rounding; below 0 any cell may hold a partner
        margin = math.sqrt(max(0.0, 1 - max(least - 1e-12, 0.0) ** 2))
    given = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("embedding"))
    all_rows = scratch(valid_rows(given), "vectors")
    able = all_rows.where("raw is not null and id is not null")
    groups = able.groupBy("dim", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    groups = scratch(groups, "vector-groups")
    reps = able.join(groups, (able["id"] == groups["rep"]) & (able["d1"] == groups["d1"]) & (able["d2"] == groups["d2"])) \
        .select(able["id"], able["raw"], able["dim"], able["d1"], able["d2"], "m").dropDuplicates(["id", "d1", "d2"])
    reps = scratch(reps, "vector-reps")
    model = fit_cells(reps, cell_rows, most_cells, sample_rows)
    placed = scratch(assign(reps, model, margin).select("id", "raw", "dim", "m", "home", "visits"), "vector-cells")

    stays = placed.withColumn("cell", F.explode(F.concat(F.array("home"), "visits"))) \
        .withColumn("resident", F.col("cell") == F.col("home"))
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    sizes = stays.groupBy("dim", "cell").agg(F.count_if("resident").alias("residents"), F.count_if(~F.col("resident")).alias("visitors")) \
        .where("residents > 0").select("dim", "cell", blocks(F.col("residents"), BLOCK).alias("r"), blocks(F.col("visitors"), VISITORS).alias("v"))
    up_to = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(
        F.array().cast("array<struct<i:int,j:int,visit:int>>"))
    task = lambda i, j, visit: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), visit.cast("int").alias("visit"))
    none, own = F.lit(-1), F.col("block")
    tasks = F.when(F.col("resident"), F.concat(
        up_to(F.col("r"), lambda other: task(F.least(own, other), F.greatest(own, other), none)),
        up_to(F.col("v"), lambda visit: task(own, none, visit)))) \
        .otherwise(up_to(F.col("r"), lambda other: task(other, none, own)))
    dealt = stays.join(sizes, ["dim", "cell"]) \
        .withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("resident"), F.col("r")).otherwise(F.col("v"))).cast("int")) \
        .withColumn("task", F.explode(tasks)) \
        .select("dim", "cell", "task.*", "id", "raw", "m", "block", "resident")
    kind = dict(reps.dtypes)["id"]
    found = scratch(dealt.groupBy("dim", "cell", "i", "j", "visit").applyInPandas(
        lambda frame: linked_blocks(frame, least), f"id {kind}, n long, mate {kind}"), "vector-links")
    n_links = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("id").alias("a"), F.col("mate").alias("b")))
    of_rep = groups.join(n_links, groups["rep"] == n_links["id"], "left").drop("id") \
        .join(parts, F.col("rep") == parts["node"], "left") \
        .select("dim", "d1", "d2", F.coalesce("component", "rep").alias("component_id"),
                (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = all_rows.select("id", F.when(F.col("id").isNotNull(), F.col("dim")).alias("dim"), "d1", "d2") \
        .join(of_rep, ["dim", "d1", "d2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id"),
                      F.coalesce("id", F.lit(0)).eqNullSafe(F.coalesce("component_id", "id", F.lit(0))).alias("kept"))
