"""Hard-negative mining by exact scores in a residue number system.

Every anchor is scored against every row, block by block: rows are dealt to slices,
blocks of anchors are sent to each slice, and a slice multiplies residues modulo small
primes (`residues`). The first pass keeps each anchor's best rows of its own label, the
second each (anchor, positive)'s best rows of other labels within the positive's
window of scores. A slice gives at most so many rows for each of them as are
asked for, and these are ranked once more over all slices. Texts of blocks and slices
have a fixed number of vectors, however often a row or a label occurs.

Edge cases: rows without id, label or vector, or with a null or non-finite component
take no part; components beyond +-2^62 after scaling count as that, and a score beyond a
long's range as its end; shorter vectors count as ending in zeros, an empty vector
scores 0; an id's own rows are never its positives; rows that repeat are rows each,
and as anchors are answered once; fewer positives or negatives than asked for: all of
them; negative positive scores leave an empty window; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from runsift.llm.common import map_arrow, saved
from runsift.llm.residues import base, products, residues

#: Rows of a slice at most (and at least, while there are fewer slices than tasks at a time), and anchors of a block.
SLICE, LEAST_SLICE, BLOCK = 32_768, 2_048, 512
HIGHEST = float(1 << 62)


def integer_rows(rows: DataFrame, label: Column, is_anchor: Column, scale: float) -> DataFrame:
    """(vec_id, label, v, is_anchor): components floor(scale * x), as doubles."""
    sound = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    found = found.where("vec_id is not null and label is not null and x is not null").where(sound)
    # floor() of Spark gives a long; beyond its range every double is whole.
    whole = lambda e: F.when(F.abs(e) < HIGHEST, F.floor(F.when(F.abs(e) < HIGHEST, e)).cast("double")).otherwise(F.signum(e) * HIGHEST)
    return found.select("vec_id", "label", F.transform("x", lambda e: whole(e * scale)).alias("v"), "is_anchor")


def packed(rows: DataFrame, width: int) -> DataFrame:
    """(vec_id, label, v as bytes of `width` doubles, is_anchor)."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        v = np.zeros((batch.num_rows, width))
        v[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in v], pa.binary()), batch.column(3)], ["vec_id", "label", "v", "is_anchor"])

    return map_arrow(rows, pack, "vec_id long, label long, v binary, is_anchor boolean")


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), width)


def in_blocks(anchors: DataFrame, n: int) -> DataFrame:
    """Anchors put together in blocks of about BLOCK: (block, a_ids, a_labels, a_v, a_more), each a list in one order."""
    block = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(max(1, -(-n // BLOCK))))
    of_block = F.sort_array(F.collect_list(F.struct("vec_id", "label", "v", "more")))
    blocks = anchors.withColumn("block", block).groupBy("block").agg(of_block.alias("a"))
    return blocks.select("block", *[F.col(f"a.{c}").alias(f"a_{c}") for c in ("vec_id", "label", "v", "more")])


def scored(vectors: DataFrame, blocks: DataFrame, slices: int, width: int, primes: list[int], choose, schema: str) -> DataFrame:
    """Meets every block of anchors with every slice of rows; choose(scores, anchors, rows) gives the rows of the result.

    A task reads the rows of a slice first, then one block after the other.
    """
    row_side = vectors.select("slice", F.lit(0).alias("role"), F.array("vec_id").alias("ids"), F.array("label").alias("labels"), F.array("v").alias("v"), F.lit(None).cast("array<array<long>>").alias("more"))
    block_side = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(1).alias("role"), F.col("a_vec_id"), F.col("a_label"), F.col("a_v"), F.col("a_more"))
    both = row_side.union(block_side).repartitionById(slices, "slice").sortWithinPartitions("slice", "role", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, rows = None, [], None
        for batch in batches:
            for slice_, role, ids, labels, v, more in zip(*(c.to_pylist() for c in batch.columns)):
                if slice_ != now:
                    now, gathered, rows = slice_, [], None
                if role == 0:
                    gathered.append((ids[0], labels[0], v[0]))
                    continue
                if rows is None:
                    rows = (np.array([g[0] for g in gathered], np.int64), np.array([g[1] for g in gathered], np.int64), residues(matrix([g[2] for g in gathered], width), primes))
                    gathered = []
                if len(rows[0]):
                    mine = (np.array(ids, np.int64), np.array(labels, np.int64), residues(matrix(v, width), primes), v, more)
                    yield from choose(mine, rows)

    return both.mapInArrow(run, schema)


def best_columns(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k times: the rows of the matrix that still have an allowed column, and their best one; the first among equals."""
    lowest = np.iinfo(np.int64).min
    left = np.where(allowed, np.maximum(scores, lowest + 1), lowest)
    at = np.arange(len(scores))
    for _ in range(k):
        column = left.argmax(1) if left.shape[1] else None
        if column is None:
            return
        there = np.flatnonzero(left[at, column] > lowest)
        if not len(there):
            return
        yield there, column[there]
        left[at, column] = lowest


def window_of(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole n with low * score <= 100 * n <= high * score; percents, without leaving 64 bits."""
    whole, rest = np.floor_divide(score, 100), np.mod(score, 100)
    return whole * low - (-rest * low) // 100, whole * high + (rest * high) // 100


def hard_negatives(rows: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """rows(vec_id, embedding, ...) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The `positives` best rows of an anchor's label, and for each of them the
    `negatives` best rows of other labels whose score is `low` to `high` percent of its.
    """
    vectors = saved(integer_rows(rows, label, is_anchor, scale))
    n, width, n_anchors, largest = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if("is_anchor"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width, largest = max(width or 0, 1), int(largest or 0)
    primes = base(width * largest * largest)
    at_a_time = rows.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-n // SLICE), min(at_a_time, -(-n // LEAST_SLICE)))
    deal = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(slices)).cast("int")
    vectors = saved(packed(vectors, width).withColumn("slice", deal))
    anchors = vectors.where("is_anchor").select("vec_id", "label", "v").distinct()

    def same_label(mine, others) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, a, a_v, _ = mine
        ids, labels, x = others
        for one in np.unique(a_labels):
            i, j = np.flatnonzero(a_labels == one), np.flatnonzero(labels == one)
            scores = products([m[i] for m in a], [m[j] for m in x], primes)
            for there, column in best_columns(scores, ids[j][None] != a_ids[i][:, None], positives):
                yield pa.record_batch([pa.array(a_ids[i[there]]), pa.array(a_labels[i[there]]), pa.array([a_v[k] for k in i[there]], pa.binary()), pa.array(ids[j[column]]), pa.array(scores[there, column])], ["vec_id", "label", "v", "positive_id", "score"])

    plain = in_blocks(anchors.withColumn("more", F.lit(None).cast("array<long>")), n_anchors)
    found = scored(vectors, plain, slices, width, primes, same_label, "vec_id long, label long, v binary, positive_id long, score long")
    order = Window.partitionBy("vec_id", "label", "v").orderBy(F.desc("score"), "positive_id")
    found = saved(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))

    def other_labels(mine, others) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, a, a_v, wanted = mine
        ids, labels, x = others
        scores = products(a, x, primes)
        differs = labels[None] != a_labels[:, None]
        target = np.full((len(a_ids), positives), np.iinfo(np.int64).min)
        for i, of_one in enumerate(wanted):
            target[i, : len(of_one)] = of_one
        for place in range(positives):
            least, most = window_of(target[:, place], low, high)
            fits = differs & (scores >= least[:, None]) & (scores <= most[:, None]) & (target[:, place] >= 0)[:, None]
            asked = np.flatnonzero(fits.any(1))
            for there, column in best_columns(scores[asked], fits[asked], negatives):
                i = asked[there]
                yield pa.record_batch([pa.array(a_ids[i]), pa.array(a_labels[i]), pa.array([a_v[k] for k in i], pa.binary()), pa.array(np.full(len(i), place + 1, np.int32)), pa.array(ids[column]), pa.array(scores[i, column])], ["vec_id", "label", "v", "place", "negative_id", "negative_score"])

    targets = found.groupBy("vec_id", "label", "v").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda e: e["score"]).alias("more"))
    mined = scored(vectors, in_blocks(targets, n_anchors), slices, width, primes, other_labels, "vec_id long, label long, v binary, place int, negative_id long, negative_score long")
    order = Window.partitionBy("vec_id", "label", "v", "place").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = mined.join(found, ["vec_id", "label", "v", "place"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
