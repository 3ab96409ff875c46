"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are put into the cells of pivots; a cell's summary is its pivot, its
number of vectors and its radius. No vector x of a cell of pivot p and radius r scores more than
q.p + |q| r against a query q. Queries are first solved within their own cell,
which gives each a score that its k-th best can't fall below; it is then sent to
those other cells only whose bound reaches that score. Cells are stored in chunks
of vectors, so a cell of any size is many rows; each chunk meets blocks of queries and
solves them by matrix products, and the k best of all chunks are merged.

Edge cases: vectors that are null, or hold null, non-finite or too large components
(over 2^28 after scaling), and rows without id take no part; shorter vectors count as ending in
zeros; an id's own rows are never its candidates; rows that repeat are candidates
each, and as queries are answered once; fewer than k candidates: all of them;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from runsift.llm.common import map_arrow, sample_ids, saved

#: Vectors of a chunk, queries of a block, and the most cells and sampled vectors for their pivots.
CHUNK, BLOCK, CELLS, SAMPLE = 4096, 512, 512, 8192
LARGEST = 1 << 28


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i4").reshape(-1, width).astype(np.float64)


def pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample of vectors, spread by Lloyd's rounds."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(3).permutation(len(centres))[:n]]
    for _ in range(rounds):
        cell = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        count = np.bincount(cell, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.rint(centres)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None] - 2 * rows @ centres.T, 1)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): components floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    found = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    sound = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e * scale) < LARGEST), F.lit(False)))
    return found.where(sound).select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("int")).alias("v"))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of each query with all other rows."""
    vectors = saved(integer_vectors(rows, id_col, vector_col, scale))
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(width or 0, 1)
    cells = int(min(CELLS, max(1, np.sqrt(n) / 2)))
    seen = sample_ids(vectors, "vec_id", min(SAMPLE, 20 * cells)).collect()
    sample = np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in seen], np.float64).reshape(-1, width)
    centres = pivots(sample, cells) if len(sample) else np.zeros((1, width))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.zeros((batch.num_rows, width))
        for i, v in enumerate(batch.column(1).to_pylist()):
            x[i, : len(v)] = v
        cell = nearest(x, centres)
        far = np.sqrt(((x - centres[cell]) ** 2).sum(1))
        raw = x.astype("<i4")
        return pa.record_batch([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(far), pa.array([r.tobytes() for r in raw], pa.binary())], ["vec_id", "cell", "far", "v"])

    placed = saved(map_arrow(vectors, place, "vec_id long, cell int, far double, v binary").withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    queries = placed.where("is_query").groupBy("vec_id", "v").agg(F.min("cell").alias("cell"))
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # a row for each cell
    chunks = np.zeros(len(centres), np.int64)
    radius = np.zeros(len(centres))
    for r in summary:
        chunks[r["cell"]], radius[r["cell"]] = -(-r["n"] // CHUNK), r["radius"]
    of_cell = F.element_at(F.array(*[F.lit(int(c)) for c in chunks]), F.col("cell") + 1)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        return pd.DataFrame({"cell": group["cell"].iloc[:1], "chunk": group["chunk"].iloc[:1], "ids": [group["vec_id"].to_numpy("<i8").tobytes()], "x": [b"".join(group["v"])]})

    chunked = placed.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), of_cell).cast("int").alias("chunk"))
    stored = saved(chunked.groupBy("cell", "chunk").applyInPandas(pack, "cell int, chunk int, ids binary, x binary"))

    def pack_queries(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": group["cell"].iloc[:1], "chunk": group["chunk"].iloc[:1], "q_ids": [group["vec_id"].to_numpy("<i8").tobytes()], "q": [b"".join(group["v"])], "q_least": [group["least"].to_numpy("<f8").tobytes()]})

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [])
        for q_ids, q, least, ids, x in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q", "q_least", "ids", "x"))):
            q_ids, ids, least = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(least, "<f8")
            raw, x, q = q, matrix([x], width), matrix([q], width)
            if np.sqrt((x**2).sum(1).max() * (q**2).sum(1).max()) < 2**52:
                scores = (q @ x.T).astype(np.int64)
            else:
                scores = q.astype(np.int64) @ x.T.astype(np.int64)
            for i, row in enumerate(scores):
                there = np.flatnonzero((row >= least[i]) & (ids != q_ids[i]))
                if len(there) > k:
                    edge = np.partition(row[there], len(there) - k)[len(there) - k]
                    there = there[row[there] >= edge]
                    there = there[np.lexsort((ids[there], -row[there]))[:k]]
                out[0].extend([int(q_ids[i])] * len(there))
                out[1].extend([raw[4 * width * i : 4 * width * (i + 1)]] * len(there))
                out[2].extend(ids[there].tolist())
                out[3].extend(row[there].tolist())
        return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["query_id", "qv", "vec_id", "score"])

    def solved(asked: DataFrame) -> DataFrame:
        """asked: vec_id, v, cell, least. The k best of each chunk of the cell."""
        spread = asked.select("vec_id", "v", "cell", "least", F.explode(F.sequence(F.lit(0), F.greatest(of_cell - 1, F.lit(0)).cast("int"))).alias("chunk"))
        sizes = saved(spread).groupBy("cell", "chunk").agg(F.count(F.lit(1)).alias("n"))
        blocks = F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / BLOCK))
        grouped = spread.join(saved(sizes), ["cell", "chunk"]).withColumn("block", blocks)
        grouped = grouped.groupBy("cell", "chunk", "block").applyInPandas(pack_queries, "cell int, chunk int, q_ids binary, q binary, q_least binary")
        return saved(map_arrow(grouped.join(stored, ["cell", "chunk"]).select("q_ids", "q", "q_least", "ids", "x"), solve, "query_id long, qv binary, vec_id long, score long"))

    at_home = solved(queries.select("vec_id", "v", "cell", F.lit(float("-inf")).alias("least")))
    kth = best(at_home, k).where(F.col("rank") == k).select("query_id", "qv", F.col("score").cast("double").alias("least"))
    known = queries.join(kth, (F.col("vec_id") == F.col("query_id")) & (F.col("v") == F.col("qv")), "left").select("vec_id", "v", "cell", F.coalesce("least", F.lit(float("-inf"))).alias("least"))

    def necessary(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = matrix(batch.column(1).to_pylist(), width)
        home, least = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        bound = q @ centres.T + np.sqrt((q**2).sum(1))[:, None] * radius[None]
        need = (bound * (1 + 1e-9 * np.sign(bound)) + 1 >= least[:, None]) & (chunks > 0)[None]
        need[np.arange(len(home)), home] = False
        i, cell = np.nonzero(need)
        at = pa.array(i)
        return pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.astype(np.int32)), batch.column(3).take(at)], ["vec_id", "v", "cell", "least"])

    away = solved(map_arrow(known, necessary, "vec_id long, v binary, cell int, least double"))
    return best(at_home.unionAll(away), k).select("query_id", "rank", "vec_id", "score")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "qv").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
