"""N-gram Jaccard join by a token-group matrix.

Documents with similar shingle sets are put into groups: documents with equal
sets are one node; nodes that share band keys are compared with a leader, and
what is close enough to it joins its group. The matrix holds each group's union
of shingles, as rows (token, group); only tokens can stand in it by which a link
may be found: the rarest ones of each set, chosen so that sets close enough to be
linked share at least `SHARED` of them. A set is compared with a group only if
the matrix gives it that many tokens of the group, and then with the group's
members exactly. Every link between different groups is found in this way, so
components are exact; nothing is capped or sampled.

Edge cases: a text without words, null or empty, has no shingles and is linked with
nothing; fewer words than a shingle are one shingle; repeated rows are copies
like any other (same component); rows that share an id are documents of their
own, and a component's id is the smallest id in it; null ids never name a
component that holds another id; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from runsift.llm.bitset import bitset, only_keys
from runsift.llm.common import Memo, Shelf, map_arrow, saved, values
from runsift.llm.graph import components

SHINGLE, NUMBER, OF = 5, 80, 100
#: Linked sets share this many of their chosen tokens, or all that the smaller needs.
SHARED = 4
BANDS, PER_BAND = 4, 2
#: Counters by which shingles are ordered; a wrong order costs time, not links.
COUNTERS = 1 << 18
#: Members of a group that a set is compared with before all others.
SCOUTS = 16
#: Turns in which sets are compared with one likely partner, before all.
TURNS = 3
#: Chosen tokens that one task compares at a time.
BUCKET = 400_000
WORDS_KEPT, SETS_SEEN = 100_000, 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(5).integers(1, 2**63, BANDS * PER_BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = Memo(xxhash.xxh3_64_intdigest, WORDS_KEPT, stays=True)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words: A-Z lower-cased, parted by ASCII white space."""
    words = text.encode().lower().split() if text else []
    return np.fromiter(map(_WORD.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The text's set of shingle hashes, sorted."""
    words = word_hashes(text)
    n = min(size, len(words))
    if not n:
        return words
    x = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        x = (x ^ (x >> np.uint64(29))) * _MIX + words[k : len(words) - n + 1 + k]
    return np.unique(mixed(x))


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """The least intersection of a set of size n with one it is linked to."""
    return -(-NUMBER * n // OF)


def chosen(n: int) -> int:
    """How many tokens of a set of size n stand for it in the matrix."""
    return min(n, n - needed(n) + SHARED)


def signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its set's size, signature and band keys; last, the counts of this task's shingles."""
    counts, waiting, size, seen = np.zeros(COUNTERS, np.int64), [], 0, set()
    for batch in batches:
        n, sig, keys = [], [], []
        for text in values(batch.column("text")):
            s = shingles(text)
            n.append(len(s))
            if not len(s):
                sig.append(0)
                keys.append(None)
                continue
            low = np.array([(s * a).min() for a in _SEEDS]).reshape(BANDS, PER_BAND)
            key = (mixed(low[:, 0]) + low[:, 1] * _MIX + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            sig.append(signature(s))
            keys.append(key.tolist())
            if sig[-1] not in seen:
                if len(seen) >= SETS_SEEN:
                    seen.clear()
                seen.add(sig[-1])
                waiting.append((s & np.uint64(COUNTERS - 1)).astype(np.int64))
                size += len(s)
                if size > 1_000_000:
                    counts += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                    waiting, size = [], 0
        none = pa.nulls(batch.num_rows, pa.binary())
        yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(keys, pa.list_(pa.int64())), none], _FIRST)
    if waiting:
        counts += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
    if seen:
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([counts.astype("<i8").tobytes()], pa.binary())], _FIRST)


_FIRST = ["doc_id", "th", "n", "sig", "keys", "counts"]
_FIRST_TYPES = "doc_id long, th long, n long, sig long, keys array<long>, counts binary"


def shingle_counts(first: DataFrame) -> np.ndarray:
    """The tasks' counters added up, in steps: 64 slices, each a small sum."""
    width = COUNTERS // 64

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = sum(np.frombuffer(x, "<i8") for x in batch.column(0).to_pylist())
        return pa.record_batch([pa.array(range(64), pa.int32()), pa.array([total[k * width : (k + 1) * width].tobytes() for k in range(64)], pa.binary())], ["slice", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in rows["counts"])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "counts": [total.tobytes()]})

    slices = map_arrow(first.where("counts is not null").select("counts"), cut, "slice int, counts binary")
    out = np.zeros(COUNTERS, np.int64)
    for r in slices.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():  # 64 rows of 32 KB
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], "<i8")
    return out


def matrix_tokens(docs: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """(token, sig) of chosen tokens that at least two different sets have."""
    counts = counts.astype(np.uint64)

    def blocks(waiting: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        tokens = np.concatenate([t for t, _ in waiting])
        sigs = np.repeat(np.array([s for _, s in waiting], np.int64), [len(t) for t, _ in waiting])
        bucket = (tokens >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        tokens, sigs, bucket = tokens[order].astype("<u4"), sigs[order], bucket[order]
        there, at = np.unique(bucket, return_index=True)
        ends = [*at[1:].tolist(), len(bucket)]
        return pa.record_batch([pa.array(there.astype(np.int32)), pa.array([tokens[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()), pa.array([sigs[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], ["bucket", "tokens", "sigs"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, seen = [], 0, set()
        for batch in batches:
            for text in values(batch.column(0)):
                s = shingles(text)
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                if len(seen) >= SETS_SEEN:
                    seen.clear()
                seen.add(sig)
                p = chosen(len(s))
                if p < len(s):
                    rank = (counts[s & np.uint64(COUNTERS - 1)] << np.uint64(34)) | (s >> np.uint64(30))
                    s = s[np.argsort(rank, kind="stable")[:p]] if np.count_nonzero(rank == (edge := np.partition(rank, p - 1)[p - 1])) > 1 else s[rank <= edge]
                waiting.append((s, sig))
                size += len(s)
                if size > 1_500_000:
                    yield blocks(waiting)
                    waiting, size = [], 0
        if waiting:
            yield blocks(waiting)

    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(x, "<u4") for x in rows["tokens"]])
        sigs = np.concatenate([np.frombuffer(x, "<i8") for x in rows["sigs"]])
        order = np.lexsort((sigs, tokens))
        tokens, sigs = tokens[order], sigs[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (sigs[1:] != sigs[:-1])
        tokens, sigs = tokens[new], sigs[new]
        start = np.ones(len(tokens), bool)
        start[1:] = tokens[1:] != tokens[:-1]
        run = np.cumsum(start) - 1
        keep = np.bincount(run)[run] > 1
        return pd.DataFrame({"token": tokens[keep].astype(np.int64) | (np.int64(rows["bucket"].iloc[0]) << 32), "sig": sigs[keep]})

    chosen_blocks = docs.select("text").mapInArrow(choose, "bucket int, tokens binary, sigs binary")
    return chosen_blocks.groupBy("bucket").applyInPandas(shared, "token long, sig long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of signatures whose sets are close enough, by their whole texts."""
    with Shelf() as shelf:
        pairs = shelf.saved(pairs.distinct())
        wanted = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select("b")).distinct()
        which = shelf.saved(nodes.select("sig", "rep").join(wanted, "sig").select("sig", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th")))
        texts = only_keys(docs.select("doc_id", "th", "text"), "th", bitset(which, "rep_th"))
        texts = texts.join(which, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("sig", "text")
        texts = shelf.saved(texts.groupBy("sig").agg(F.first("text").alias("text")))
        both = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a")
        both = both.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

        def close(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets: dict[int, np.ndarray] = {}  # of this batch

            def of(sig: int, text: str) -> np.ndarray:
                if sig not in sets:
                    sets[sig] = shingles(text)
                return sets[sig]

            keep = []
            for a, b, x, y in zip(*(values(batch.column(k)) for k in range(4))):
                x, y = of(a, x), of(b, y)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                keep.append(OF * both >= NUMBER * (len(x) + len(y) - both))
            return batch.select(["a", "b"]).filter(pa.array(keep))

        return saved(map_arrow(both, close, "a long, b long"))


def enough_shared(shared: str, n: str, nb: str) -> Column:
    """Whether sets of sizes n and nb that share so many of their chosen tokens can be linked.

    Of two linked sets let x be the one whose chosen tokens end first. What of
    these the other does not share, it does not hold at all; so the
    intersection is at most what they share and x's tokens beyond the chosen.
    """
    left = lambda n: F.greatest(F.ceil(F.col(n) * NUMBER / OF) - SHARED, F.lit(0))
    least = F.ceil((F.col(n) + F.col(nb)) * NUMBER / (OF + NUMBER))
    return similar_sizes(n, nb) & (F.col(shared) + F.greatest(left(n), left(nb)) >= least)


def least_shared(n: Column, nb: Column) -> Column:
    """How many of their chosen tokens linked sets of sizes n and nb share at least.

    Of two linked sets let x be the one whose chosen tokens end first. What of
    these the other does not share, it does not hold at all; so the
    intersection is at most what they share and x's tokens beyond the chosen.
    """
    left = lambda n: F.greatest(F.ceil(n * NUMBER / OF) - SHARED, F.lit(0))
    return F.ceil((n + nb) * NUMBER / (OF + NUMBER)) - F.greatest(left(n), left(nb))


def enough_shared(shared: str, n: str, nb: str) -> Column:
    """Whether sets of sizes n and nb that share so many of their chosen tokens can be linked."""
    return similar_sizes(n, nb) & (F.col(shared) >= least_shared(F.col(n), F.col(nb)))


def enough_for_some(shared: Column, n: str, low: str, high: str) -> Column:
    """Whether a set of size n that shares so many chosen tokens can be linked with any set of a size from low to high.

    What is needed grows up to the size n and falls beyond it, so it is least at an
    end; rounding can make it one less in between.
    """
    low = F.greatest(F.col(low), F.ceil(F.col(n) * NUMBER / OF))
    high = F.least(F.col(high), F.floor(F.col(n) * OF / NUMBER))
    least = F.least(least_shared(F.col(n), low), least_shared(F.col(n), high))
    return (low <= high) & (shared >= F.when(low < high, least - 1).otherwise(least))


def opened(met: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets in met with members of the groups they met, as far as sizes and shared tokens allow."""
    return met.join(members, "g").where(enough_shared("shared", "n", "nb")).select(F.col("sig").alias("a"), "b")


def placed_sets(tokens: DataFrame, grouped: DataFrame, nodes: DataFrame, save: Callable = saved) -> DataFrame:
    """(token, sig, grp, size, n, c): tokens with the size of the set's group, its own, and how many of its tokens cross groups.

    A set shares no other of its chosen tokens with sets of other groups; one with too few of them has no more links.
    """
    sizes = grouped.groupBy(F.col("root").alias("grp")).agg(F.count(F.lit(1)).alias("size"))
    own = tokens.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).join(nodes.select("sig", "n"), "sig")
    own = own.where(F.col("c") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * NUMBER / OF)))
    placed = tokens.join(own, "sig").join(sizes, "grp", "left")
    return save(placed.select("token", "sig", "grp", F.coalesce("size", F.lit(1)).alias("size"), "n", "c"))


def met_groups(placed: DataFrame) -> DataFrame:
    """(sig, n, g, shared): sets with larger groups of several sets whose unions hold enough of their tokens."""
    unions = placed.where("size > 1").groupBy("token", F.col("grp").alias("g"), F.col("size").alias("g_size"))
    unions = unions.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("c").alias("most"))
    met = placed.join(unions, "token").where("grp <> g and (size < g_size or (size = g_size and grp < g))")
    met = met.where(enough_for_some(F.least("c", "most"), "n", "low", "high"))
    met = met.groupBy("sig", "n", "g").agg(F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
    return met.where(enough_for_some(F.col("shared"), "n", "low", "high")).select("sig", "n", "g", "shared")


def met_alone(placed: DataFrame, whole: DataFrame, shelf: Shelf) -> DataFrame:
    """Pairs (a, b) of sets that were alone in their groups and are still in different ones, if they share enough tokens."""
    rows = placed.where("size = 1").select("token", "sig", "n").join(whole.withColumnRenamed("node", "sig"), "sig", "left")
    rows = rows.select("token", "sig", "n", F.coalesce("root", "sig").alias("grp"))
    apart = rows.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high")
    rows = shelf.saved(rows.join(apart.select("token"), "token", "left_semi"))
    rows = rows.join(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("c")), "sig").where(F.col("c") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * NUMBER / OF)))
    other = rows.select("token", F.col("sig").alias("b"), F.col("grp").alias("g"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    met = rows.join(other, "token").where("sig < b and grp <> g").withColumn("most", F.least("c", "cb")).where(enough_shared("most", "n", "nb"))
    met = met.groupBy("sig", "b", "n", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return met.where(enough_shared("shared", "n", "nb")).select(F.col("sig").alias("a"), "b")


def crossing(tokens: DataFrame, grouped: DataFrame, save: Callable = saved) -> DataFrame:
    """(token, sig, grp) of the tokens that stand in more than one group; stored by `save`."""
    with Shelf() as shelf:
        placed = tokens.select("token", "sig").join(grouped.withColumnRenamed("node", "sig"), "sig", "left")
        placed = shelf.saved(placed.select("token", "sig", F.coalesce("root", "sig").alias("grp")))
        apart = placed.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high")
        return save(placed.join(apart.select("token"), "token", "left_semi"))


def likely(tokens: DataFrame, grouped: DataFrame, nodes: DataFrame, turn: int, shelf: Shelf) -> DataFrame:
    """At most one likely link for each set, to merge large families before the whole matrix is searched.

    On each token one member of its largest group leads; a set is paired with
    the leader it meets most often. As many rows as tokens, however large groups are.
    """
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("root", "grp")
    placed = shelf.saved(tokens.join(sizes, "grp", "left").select("token", "sig", "grp", F.coalesce("size", F.lit(1)).alias("size")))
    cells = placed.groupBy("token", "grp", "size").agg(F.min_by("sig", F.hash("sig", F.lit(turn))).alias("pick"))
    leaders = cells.groupBy("token").agg(F.max(F.struct("size", "grp", "pick")).alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1")
    leaders = shelf.saved(leaders.select("token", F.col("lead.pick").alias("b"), F.col("lead.grp").alias("b_grp")))
    met = placed.join(leaders, "token").where("grp <> b_grp").groupBy("sig", "b").agg(F.count(F.lit(1)).alias("shared"))
    met = met.groupBy("sig").agg(F.max(F.struct("shared", "b")).alias("most")).select("sig", "most.shared", "most.b")
    sized = met.join(nodes.select("sig", "n"), "sig").join(nodes.select(F.col("sig").alias("b"), F.col("n").alias("nb")), "b")
    return sized.where(enough_shared("shared", "n", "nb")).select(F.col("sig").alias("a"), "b")


def similar_sizes(x: str, y: str):
    return (OF * F.least(x, y)) >= (NUMBER * F.greatest(x, y))


def linked_sets(docs: DataFrame, first: DataFrame, nodes: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root) of the sets that are linked with another one, on the shelf."""
    some = first.where("n > 0")

    # Groups: what a leader of the same band key is linked with.
    banded = nodes.select("sig", "n", F.explode("keys").alias("key"))
    leaders = shelf.saved(banded.groupBy("key").agg(F.min(F.struct("sig", "n")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("lead.sig").alias("b"), F.col("lead.n").alias("nb")))
    pairs = banded.join(leaders, "key").where((F.col("sig") != F.col("b")) & similar_sizes("n", "nb")).select(F.col("sig").alias("a"), "b")
    links = verified(pairs, nodes, docs)
    grouped = components(links, shelf.saved)

    # The matrix, of tokens that stand in different groups.
    total = some.agg(F.sum(F.least("n", F.col("n") - F.ceil(F.col("n") * NUMBER / OF) + SHARED))).first()[0] or 0
    with Shelf() as matrix:
        tokens = matrix.saved(matrix_tokens(docs, shingle_counts(first), max(1, -(-int(total) // BUCKET))))
        tokens = crossing(tokens, grouped, matrix.saved)
        matrix.only(tokens)
        for turn in range(TURNS):
            with Shelf() as step:
                found = verified(likely(tokens, grouped, nodes, turn, step), nodes, docs)
            if not found.take(1):
                break
            links = links.unionAll(found)
            grouped = components(links, shelf.saved)
            tokens = crossing(tokens, grouped, matrix.saved)
            matrix.only(tokens)
        # The smaller group's sets are the queries. Their tokens in the union of a group of several bound the overlap.
        placed = placed_sets(tokens, grouped, nodes, shelf.saved)
    met = shelf.saved(met_groups(placed))
    members = nodes.select(F.col("sig").alias("b"), F.col("n").alias("nb")).join(grouped.withColumnRenamed("node", "b"), "b").select("b", "nb", F.col("root").alias("g"))
    members = shelf.saved(members.withColumn("slot", F.pmod(F.hash("b"), F.lit(SCOUTS))))
    # First a few members of each group, as most sets that belong to a large one are linked with any of them; then all others.
    scouts = shelf.saved(members.groupBy("g", "slot").agg(F.min(F.struct("b", "nb")).alias("scout")).select("g", "slot", "scout.b", "scout.nb"))
    found = verified(opened(met, scouts), nodes, docs)
    joined = found.select(F.col("a").alias("sig"), "b").join(members.select("b", "g"), "b").select("sig", "g").distinct()
    apart = shelf.saved(met.join(joined, ["sig", "g"], "left_anti"))
    others = shelf.saved(members.join(scouts.select("g", "slot", "b"), ["g", "slot", "b"], "left_anti"))
    links = links.unionAll(found).unionAll(verified(opened(apart, others), nodes, docs))
    whole = components(links, shelf.saved)
    with Shelf() as step:
        more = verified(met_alone(placed, whole, step), nodes, docs)
    if more.take(1):
        whole = components(links.unionAll(more), shelf.saved)
    return whole


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, th (the text's hash), n_shingles, component_id and keep_th.

    The row with the smallest id of a component, and among these the smallest
    hash keep_th, stands for it.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    first = saved(docs.mapInArrow(_first_pass, _FIRST_TYPES))
    rows = first.where("counts is null")
    some = rows.where("n > 0")
    with Shelf() as shelf:
        nodes = shelf.saved(some.groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))
        whole = linked_sets(docs, first, nodes, shelf)
        named = nodes.select("sig", "rep").join(whole.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
        lowest = shelf.saved(named.groupBy("root").agg(F.min("rep").alias("keep")))
        of_sig = saved(named.join(lowest, "root").select("sig", "keep"))
    out = some.join(of_sig, "sig").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("keep.doc_id").alias("component_id"), F.col("keep.th").alias("keep_th"))
    return out.unionAll(rows.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("th").alias("keep_th")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents under links of Jaccard similarity >= 0.8 on five-word shingles.

    Returns doc_id, n_shingles, component_id: a row for each row of docs.
    """
    return classes(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, unchanged; rows without any word all stay, but for repeated ones.

    Only rows that may have to go, by a bit set of their keys, meet the decisions in a join.
    """
    shelf = Shelf()
    every = shelf.saved(classes(docs, id_col, text_col).groupBy("doc_id", "th").agg(F.first("component_id").alias("component_id"), F.first("keep_th").alias("keep_th"), F.count(F.lit(1)).alias("n")))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("keep_th"))
    touched = bitset(every.where(~stays | (F.col("n") > 1)), "th")
    kept = saved(every.where(stays).select(F.col("doc_id").alias("_kept_id"), F.col("th").alias("_kept_th")))
    shelf.only()
    rows = docs.withColumn("_kept_key", F.xxhash64(text_col))
    doubtful = only_keys(rows, "_kept_key", touched)
    out = doubtful.join(kept.hint("merge"), (F.col("_kept_key") == F.col("_kept_th")) & F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id")))
    out = out.dropDuplicates([id_col, "_kept_key"]).select(*docs.columns)
    return out.unionAll(only_keys(rows, "_kept_key", touched, among=False).select(*docs.columns))
