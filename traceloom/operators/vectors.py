"""Nearest vectors by cosine: an inverted file of cells, probed and ranked by the exact cosine; and the exact search, in blocks.

Cells are the vectors nearest to centres, which are fitted on a bounded sample; every vector is in the one cell of its nearest centre. A query looks into the
cells whose centres are nearest to it. Cells and the queries sent to them are cut in blocks of bounded size, so a cell that holds a third
of all vectors is spread over tasks; each pair of blocks gives a query's best few, and a grouping keeps the best of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.sources.staging import Workspace

#: Rows that centres are fitted on at most, and rows of a block.
SAMPLE, BLOCK = 20_000, 4096
FOUND = "query long, vec_id long, cosine double"


def stacked(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a list column; a null, empty or zero vector is zeros, and one of another length raises."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        if v:
            out[i] = np.asarray(v, np.float64)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def fitted_centres(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centres of at most ``cells`` cells by spherical k-means on the first ``sample`` vectors in the order of a hash of their ids."""
    rows = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
    if rows.empty:
        return np.zeros((0, 0))
    x = np.stack(rows["embedding"].map(lambda v: np.asarray(v, np.float64)).tolist())
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    x = x[norms[:, 0] > 0] / norms[norms[:, 0] > 0]
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else np.zeros((0, rows["embedding"].map(len).max()))
    for _ in range(rounds if len(x) else 0):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def in_cells(vectors: DataFrame, centres: np.ndarray, probes: int, key: str) -> DataFrame:
    """key, cell, rank, unit: each vector with its ``probes`` nearest cells, the nearest at rank 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column("embedding"), centres.shape[1])
            n = min(probes, len(centres))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]
            units = pa.array(np.repeat(x, n, axis=0).tolist(), pa.list_(pa.float64()))
            ids = batch.column(key).take(pa.array(np.repeat(np.arange(len(x)), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(x))), units], [key, "cell", "rank", "unit"])

    return vectors.select(F.col(key).cast("long").alias(key), "embedding").mapInArrow(run, f"{key} long, cell int, rank int, unit array<double>")


def blocked(rows: DataFrame, key: str, name: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The rows with their block of the cell, dealt by a hash of the key, and the number of blocks of each cell: about BLOCK rows each."""
    sizes = work.stage(rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{name}s")), f"{name}-sizes")
    return rows.join(sizes, "cell").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), sizes


def best_of(queries: pd.DataFrame, members: pd.DataFrame, top: int) -> pd.DataFrame:
    """The ``top`` members of one block nearest to each query of another."""
    if queries.empty or members.empty:
        return pd.DataFrame({"query": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
    q, m = np.stack(queries["unit"].tolist()), np.stack(members["unit"].tolist())
    ids, own = members["vec_id"].to_numpy(), queries["query"].to_numpy()
    told = np.round(q @ m.T, 12)
    told[own[:, None] == ids[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, told.shape), -told), axis=1)[:, :top]
    cosine = np.take_along_axis(told, order, axis=1)
    rows = pd.DataFrame({"query": np.repeat(own, order.shape[1]), "vec_id": ids[order].ravel(), "cosine": cosine.ravel()})
    return rows[np.isfinite(rows["cosine"])]


def ranked(found: DataFrame, top: int) -> DataFrame:
    """query, rank (from 1), vec_id, cosine: the best of each query, equal cosines by id."""
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("query", "rank", "vec_id", "cosine")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, cells: int = 64, probes: int = 40, sample: int = SAMPLE) -> DataFrame:
    """query, rank, vec_id, cosine: the ``top`` vectors nearest to each query among those in its ``probes`` nearest cells of ``cells``; with probes = cells the search is exact.

    vectors, queries: vec_id, embedding. A query doesn't find its own id. Every vector is indexed; only the centres come from a sample.

    Edge cases: null and zero vectors have cosine 0 to all; equal cosines go by id; rows of one id are vectors each;
    without vectors there are no rows. On vectors that are mere noise, 40 of 64 cells hold 0.93 of the nearest ten or more; vectors that cluster need few probes. Of fewer than ``top`` vectors in the cells, all are found.
    """
    with Workspace(vectors.sparkSession, "nearest") as work:
        centres = fitted_centres(vectors, cells, sample)
        if not len(centres):
            centres = np.zeros((1, 1)) if centres.shape[1] == 0 else np.zeros((1, centres.shape[1]))
        members = work.stage(in_cells(vectors, centres, 1, "vec_id").drop("rank"), "members")
        asked = work.stage(in_cells(queries.select(F.col("vec_id").alias("query"), "embedding"), centres, probes, "query").drop("rank"), "asked")
        members, m_sizes = blocked(members, "vec_id", "mb", work)
        asked, q_sizes = blocked(asked, "query", "qb", work)
        # every block of a cell's queries meets every block of its members
        members = members.join(q_sizes, "cell").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1))).drop("qbs")
        asked = asked.join(m_sizes, "cell").withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("mbs") - 1))).drop("mbs")
        keys = ["cell", "mb", "qb"]
        found = asked.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(lambda q, m: best_of(q, m, top), FOUND)
        return work.keep(ranked(found, top), "nearest")
