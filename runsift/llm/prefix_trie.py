"""The prefix trie of conversations, built as z-fast tries in batches.

Texts leave the plan in its first stage: a turn becomes a 128-bit digest and its number
of bytes, a conversation the digests of all its prefixes (each of the digest before and
the turn), 24 bytes a turn in one row. Copies are counted and one of them goes on.

Batches: a group of sequences (at first all) that is too large for one task inserts a
sample of them into a z-fast trie; every other sequence finds its exit node there by fat
binary search, in as many tasks as its group needs, and joins the group of those that
leave the trie at the same place by the same turn. Groups that fit a task are inserted
whole; large ones give the next batch. So no task holds more than a sample's trie or a
small group, however many conversations share a beginning. The places at which
sequences leave an edge become nodes of it. What holds for subtrees is summed over the
compacted nodes by pointer doubling, in about log2(nesting) rounds. Edges are expanded to one node
for each depth last, by the conversation that is an edge's smallest member.

Equal digests count as equal prefixes; at 128 bits, unequal ones don't meet in practice.

Edge cases: rows without conv_id take no part; null role or text is empty; turns of
one number, null (first) among them, go by role, then text; repeated rows are turns each;
conversations that have no turns once rebuilt count at the root; no conversations, no
rows; texts may have any length, a conversation about 80 million turns; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runsift.llm.common import map_arrow, saved
from runsift.llm.zfast import ROOT, WIDTH, ZFastTrie, digest

#: Sequences of a sample, and turns of a group that one task inserts whole.
SAMPLE, SMALL = 1_024, 8_192
#: Ids whose text is joined in one row before a list of ids is hashed.
ID_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(rows: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, turns as array of (digest, bytes)): the first h turns of the family's first conversation, then its own from there on."""
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    marked = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turn = F.struct(place.alias("place"), F.unhex(F.md5(marked.cast("binary"))).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    own = saved(turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")))
    first = F.col("conv_id") - F.col("conv_id") % family
    heads = own.where(first == F.col("conv_id")).select(F.col("conv_id").alias("first"), F.slice("own", 1, most - 1).alias("head"))
    joined = own.withColumn("first", first).join(heads, "first", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("own", h + 1, F.size("own"))).alias("turns"))


def chained(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The digests of all prefixes (x) and the bytes up to each depth (y, from depth 0)."""
    out: tuple[list, ...] = ([], [], [], [], [])
    for turns in batch.column(1).to_pylist():
        before, x, y = b"", [], [0]
        for turn in turns:
            before = hashlib.blake2b(before + turn["digest"], digest_size=WIDTH).digest()
            x.append(before)
            y.append(y[-1] + turn["bytes"])
        for column, value in zip(out, (before, len(x), y[-1], b"".join(x), np.array(y, "<i8").tobytes())):
            column.append(value)
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], ["conv_id", "id", "length", "bytes", "x", "y"])


POINT = "edge binary, depth int, id binary, upto long, top int, top_id binary, top_upto long"
SEQUENCE = "g binary, base int, sid long, length int, x binary, y binary"


def bytes_to(y: bytes, depth: int) -> int:
    return int.from_bytes(y[8 * depth : 8 * depth + 8], "little")


def before(x: bytes, depth: int) -> bytes:
    return digest(x, depth) if depth else ROOT


def point(edge: bytes, depth: int, top: int, x: bytes, y: bytes) -> tuple:
    return edge, depth, digest(x, depth), bytes_to(y, depth), top, before(x, top), bytes_to(y, top)


def points_of(trie: ZFastTrie) -> list[tuple]:
    return [point(digest(x, deep), deep, top, x, y) for top, deep, x, y in zip(trie.top, trie.deep, trie.kept, trie.label)]


def frozen(trie: ZFastTrie) -> bytes:
    kept = {x: i for i, x in enumerate(dict.fromkeys(trie.kept))}
    return pickle.dumps((trie.base, list(kept), [(top, deep, kept[x]) for top, deep, x in zip(trie.top, trie.deep, trie.kept)]))


def thawed(blob: bytes) -> ZFastTrie:
    base, kept, nodes = pickle.loads(blob)
    trie = ZFastTrie(base)
    for top, deep, i in nodes:
        trie.add(top, deep, kept[i], None)
    return trie


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


POINT_TYPES = [("edge", pa.binary()), ("depth", pa.int32()), ("id", pa.binary()), ("upto", pa.int64()), ("top", pa.int32()), ("top_id", pa.binary()), ("top_upto", pa.int64())]
SEQUENCE_TYPES = [("g", pa.binary()), ("base", pa.int32()), ("sid", pa.int64()), ("length", pa.int32()), ("x", pa.binary()), ("y", pa.binary())]
BOTH = pa.schema(POINT_TYPES + SEQUENCE_TYPES)
NO_POINT, NO_SEQUENCE = (None,) * 7, (None,) * 6


def sample_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences in order of g -> the points of each group's trie, and one row with the trie itself."""
    schema = pa.schema([*POINT_TYPES, ("g", pa.binary()), ("trie", pa.binary())])
    now, trie = None, None
    for batch in batches:
        rows: list[tuple] = []
        for g, base, x, y in zip(*(batch.column(c).to_pylist() for c in ("g", "base", "x", "y"))):
            if g != now:
                if trie is not None:
                    rows += [(*p, None, None) for p in points_of(trie)] + [(*NO_POINT, now, frozen(trie))]
                now, trie = g, ZFastTrie(base)
            trie.insert(x, y)
        if rows:
            yield as_batch(rows, schema)
    if trie is not None:
        yield as_batch([(*p, None, None) for p in points_of(trie)] + [(*NO_POINT, now, frozen(trie))], schema)


def place_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (g, salt), a sampled trie before its sequences -> points, and sequences of the next groups.

    Without a trie a small group is inserted into one of its own.
    """
    now, trie, own = None, None, False
    for batch in batches:
        rows: list[tuple] = []
        for g, salt, blob, large, base, sid, length, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            if (g, salt) != now:
                if own:
                    rows += [(*p, *NO_SEQUENCE) for p in points_of(trie)]
                now, own = (g, salt), blob is None and not large
                trie = thawed(blob) if blob is not None else ZFastTrie(base) if own else None
            if blob is not None:
                continue
            if own:
                trie.insert(x, y)
            elif trie is None:  # nothing of the group was drawn: it waits for the next batch
                rows.append((*NO_POINT, g, base, sid, length, x, y))
            else:
                node, depth = trie.exit(x)
                where = NO_POINT if node is None else point(digest(trie.kept[node], trie.deep[node]), depth, trie.top[node], x, y)
                on = (digest(x, depth + 1), depth, sid, length, x, y) if depth < length else NO_SEQUENCE
                if where is not NO_POINT or on is not NO_SEQUENCE:
                    rows.append((*where, *on))
        if rows:
            yield as_batch(rows, BOTH)
    if own:
        yield as_batch([(*p, *NO_SEQUENCE) for p in points_of(trie)], BOTH)


def compacted(sequences: DataFrame) -> DataFrame:
    """sequences(sid, length, x, y), distinct -> nodes(id, depth, upto, top, parent, top_upto), without the root."""
    active = sequences.select(F.lit(b"").alias("g"), F.lit(0).alias("base"), "sid", "length", "x", "y")
    n, turns = active.agg(F.count(F.lit(1)), F.sum("length")).first()
    active = active.withColumns({"n": F.lit(n), "turns": F.lit(turns or 0).cast("long")})
    points, batch = [], 0
    while n:
        large = F.col("turns") > SMALL
        drawn = large & (F.pmod(F.xxhash64(F.lit(batch), "sid"), F.lit(1 << 20)) * F.col("n") < F.lit(SAMPLE << 20))
        sampled = active.where(drawn).repartition("g").sortWithinPartitions("g", "sid").mapInArrow(sample_tries, f"{POINT}, g binary, trie binary")
        sampled = saved(sampled)
        tasks = F.when(large, F.ceil(F.col("turns") / SMALL)).otherwise(1).cast("int")
        rest = active.where(~drawn).withColumn("salt", F.pmod(F.xxhash64("sid"), tasks).cast("int"))
        sizes = active.where(drawn).groupBy("g").agg(F.max(tasks).alias("tasks"))
        tries = sampled.where("trie is not null").join(sizes, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), "trie", F.lit(True).alias("large"), *[F.lit(None).cast(t).alias(c) for c, t in (("base", "int"), ("sid", "long"), ("length", "int"), ("x", "binary"), ("y", "binary"))])
        both = tries.unionByName(rest.select("g", "salt", F.lit(None).cast("binary").alias("trie"), large.alias("large"), "base", "sid", "length", "x", "y"))
        placed = saved(both.repartition("g", "salt").sortWithinPartitions("g", "salt", F.col("trie").isNull(), "sid").mapInArrow(place_sequences, f"{POINT}, {SEQUENCE}"))
        names = [c for c, _ in POINT_TYPES]
        points += [sampled.where("edge is not null").select(names), placed.where("edge is not null").select(names)]
        active = placed.where("sid is not null").select("g", "base", "sid", "length", "x", "y")
        sizes = saved(active.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("turns")))
        n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        active = active.join(sizes, "g")
        batch += 1
    if not points:
        return sequences.sparkSession.createDataFrame([], POINT).select("id", "depth", "upto", "top", F.col("top_id").alias("parent"), "top_upto")
    every = points[0]
    for more in points[1:]:
        every = every.union(more)
    along = Window.partitionBy("edge").orderBy("depth")
    upper = {"top": F.coalesce(F.lag("depth").over(along), "top"), "parent": F.coalesce(F.lag("id").over(along), "top_id"), "top_upto": F.coalesce(F.lag("upto").over(along), "top_upto")}
    return every.distinct().select("id", "depth", "upto", *[c.alias(name) for name, c in upper.items()])


SUMS = ("n", "total", "leaves", "distinct")


def of_subtrees(nodes: DataFrame) -> DataFrame:
    """Sums SUMS and the least of `least` over each node's subtree, by pointer doubling.

    After k rounds a node has what lies less than 2^k levels below it, and points
    to its ancestor 2^k levels up, if there is one.
    """
    nodes = saved(nodes.withColumn("up", F.col("parent")))
    while nodes.where("up is not null").limit(1).count():
        given = nodes.where("up is not null").groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"more_{c}") for c in SUMS], F.min("least").alias("more_least"))
        nodes = nodes.join(given, "id", "left")
        nodes = nodes.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in SUMS} | {"least": F.least("least", "more_least")}).drop("more_least", *[f"more_{c}" for c in SUMS])
        # Those that point nowhere or to the root meet themselves, so that they stay spread.
        goes_on = F.coalesce(F.col("up") != ROOT, F.lit(False))
        upper = nodes.select(F.col("id").alias("meets"), F.col("up").alias("next"))
        nodes = nodes.withColumns({"goes_on": goes_on, "meets": F.when(goes_on, F.col("up")).otherwise(F.col("id"))}).join(upper, "meets")
        nodes = saved(nodes.withColumn("up", F.when(F.col("goes_on"), F.col("next"))).drop("meets", "next", "goes_on"))
    return nodes.drop("up")


def hashed_lists(members: DataFrame) -> DataFrame:
    """members(id, conv_id) -> (id, ends_sha256) of the ascending ids; a list streams through its task, joined in pieces beforehand."""
    pieces = members.groupBy("id", F.shiftright("conv_id", ID_BITS).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if id_ != now:
                    if state is not None:
                        done[0].append(now)
                        done[1].append(state.hexdigest())
                    now, state = id_, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done[0]:
                yield pa.record_batch([pa.array(done[0], pa.binary()), pa.array(done[1])], ["id", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    return pieces.repartition("id").sortWithinPartitions("id", "piece").mapInArrow(run, "id binary, ends_sha256 string")


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def expanded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each depth of the edges that a conversation is the smallest member of."""
    columns: dict[str, list] = {c: [] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")}
    for conv_id, y, edges in zip(*(c.to_pylist() for c in batch.columns)):
        y = np.frombuffer(y, "<i8")
        for e in edges:
            top, deep = e["top"], e["depth"]
            one_up, n = y[top:deep], deep - top
            below = e["total"] - e["n"] * one_up - (e["distinct"] - (e["upto"] - e["top_upto"]) + e["upto"] - one_up)
            columns["conv_id"] += [conv_id] * n
            columns["depth"] += range(top + 1, deep + 1)
            columns["parent_conv_id"] += [e["parent_least"]] + [conv_id] * (n - 1)
            columns["n_convs"] += [e["n"]] * n
            columns["n_children"] += [1] * (n - 1) + [e["children"]]
            columns["n_leaves"] += [e["leaves"]] * n
            columns["saved_tokens"] += below.tolist()
            columns["ends_sha256"] += [NOTHING] * (n - 1) + [e["ends_sha256"]]
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns.values(), kinds)], list(columns))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row for each distinct beginning of rebuilt conversations (RESULT)."""
    every = saved(map_arrow(rebuilt(rows), chained, "conv_id long, id binary, length int, bytes long, x binary, y binary"))
    ends = saved(every.groupBy("id").agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total")))
    # Of copies, the one with the smallest id goes on.
    distinct = saved(every.where("length > 0").join(ends.select(F.col("least").alias("conv_id")), "conv_id").select(F.col("conv_id").alias("sid"), "length", "x", "y"))
    nodes = saved(compacted(distinct))
    children = nodes.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    root = rows.sparkSession.createDataFrame([(ROOT, 0, 0, 0, None, 0)], "id binary, depth int, upto long, top int, parent binary, top_upto long")
    nodes = nodes.select(root.columns).union(root).join(ends, "id", "left").join(children, "id", "left").join(hashed_lists(every.select("id", "conv_id")), "id", "left")
    zero = F.lit(0).cast("long")
    nodes = nodes.withColumns({c: F.coalesce(c, zero) for c in ("n", "total", "children")} | {"ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING)), "distinct": F.col("upto") - F.col("top_upto")})
    nodes = of_subtrees(nodes.withColumn("leaves", (F.col("children") == 0).cast("long"))).where("n > 0")
    edges = nodes.where("parent is not null").join(nodes.select(F.col("id").alias("parent"), F.col("least").alias("parent_least")), "parent")
    owned = edges.groupBy(F.col("least").alias("sid")).agg(F.collect_list(F.struct("top", "depth", "upto", "top_upto", "n", "total", "distinct", "leaves", "children", "parent_least", "ends_sha256")).alias("edges"))
    below = map_arrow(owned.join(distinct.select("sid", "y"), "sid").select("sid", "y", "edges"), expanded, RESULT)
    at_root = nodes.where("parent is null").select(F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("total") - F.col("distinct")).alias("saved_tokens"), "ends_sha256")
    return below.union(at_root)
