"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is the hash of the tokens that a mask keeps of `SPAN` tokens in a row. The
two masks are such that 13 tokens in a row of which any two were exchanged still
hold a seed of theirs; so joining the seeds of documents and benchmark items
misses no such overlap. Every place where seeds meet is then compared token by
token: a document leaks an item if somewhere `WINDOW` aligned tokens agree in all
but `EXCHANGED`. Tokens are lower-cased runs of letters and digits.

Edge cases: null and empty texts hold no tokens, leak nothing and are kept;
items of fewer than SPAN tokens say too little and are ignored; items of fewer
than WINDOW tokens are compared whole, with exchanges in proportion; repeated
rows share their verdict; two rows of one item id are variants of that item; null ids are values
like any other; an empty table on either side gives an empty report; further
columns of the documents are passed through and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.binding import bind
from runsift.llm.common import saved

SPAN = 9
MASKS = ((0, 1, 5, 6, 7, 8), (0, 1, 2, 4, 5, 8))
WINDOW, EXCHANGED = 13, 2
#: Benchmark seeds up to this number are sent to every task, 16 bytes each; more meet the documents' by a shuffle.
SENT = 500_000
KEY = "_leak_key"


def token_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<long>"))


def seeds(tokens: Column) -> Column:
    """Hashes of all masks at all places: those of the first mask, in order, then the next."""

    def at(mask: tuple[int, ...], number: int):
        return lambda i: F.xxhash64(F.lit(number), *[F.get(tokens, i + k) for k in mask])

    places = F.sequence(F.lit(0), F.size(tokens) - SPAN)
    found = F.concat(*[F.transform(places, at(mask, n)) for n, mask in enumerate(MASKS)])
    return F.when(F.size(tokens) >= SPAN, found).otherwise(F.array().cast("array<long>"))


def seeded(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., place, seed) for rows with a column tokens."""
    found = bind(rows, *keep, "n_places", found=seeds(F.col("tokens")))
    return found.select(*keep, "n_places", F.posexplode("found").alias("at", "seed")).select(*keep, (F.col("at") % F.col("n_places")).alias("place"), "seed")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, matched, compared): the best window of each leaked item in each document."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    places = F.greatest(F.size("tokens") - (SPAN - 1), F.lit(1)).alias("n_places")
    items = bind(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "item_id", item_tokens=token_hashes(F.col("text")))
    items = saved(items.where(F.size("item_tokens") >= SPAN).select("item_id", F.xxhash64("item_id", "item_tokens").alias("variant"), "item_tokens").distinct())
    theirs = saved(seeded(items.select("variant", F.col("item_tokens").alias("tokens")).select("variant", "tokens", places), "variant").select("variant", F.col("place").alias("item_place"), "seed").distinct())
    if theirs.count() <= SENT:
        theirs = F.broadcast(theirs)

    tokens = bind(narrow, "doc_id", "text_hash", tokens=token_hashes(F.col("text"))).select("doc_id", "text_hash", "tokens", places)
    hits = seeded(tokens, "doc_id", "text_hash").join(theirs, "seed")
    hits = saved(hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("variant", (F.col("place") - F.col("item_place")).alias("shift"))).alias("hits")))

    same = F.col("n.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("n.text_hash") == F.col("h.text_hash"))
    held = narrow.alias("n").join(hits.alias("h"), same).select("n.doc_id", "n.text_hash", "n.text", "h.hits")
    held = bind(held, "doc_id", "text_hash", "hits", tokens=token_hashes(F.col("text")))
    #: Part of the document beside the item: at most as many tokens as the item has.
    placed = held.select("doc_id", "text_hash", "tokens", F.inline("hits")).join(items.select("variant", F.size("item_tokens").alias("n_item")).distinct(), "variant")
    start = F.greatest(F.col("shift"), F.lit(0))
    skipped = start - F.col("shift")
    length = F.greatest(F.least(F.size("tokens") - start, F.col("n_item") - skipped), F.lit(0))
    cut = placed.select("doc_id", "text_hash", "variant", "n_item", skipped.alias("skipped"), length.alias("length"), F.slice("tokens", start + 1, length).alias("part"))
    beside = cut.join(items, "variant")
    equal = F.zip_with("part", F.slice("item_tokens", F.col("skipped") + 1, F.col("length")), lambda a, b: (a == b).cast("int"))
    beside = bind(beside, "doc_id", "text_hash", "item_id", "n_item", equal=equal)
    window = F.least(F.col("n_item"), F.lit(WINDOW))
    sums = F.transform(F.sequence(F.lit(1), F.size("equal") - window + 1), lambda i: F.aggregate(F.slice("equal", i, window), F.lit(0), lambda x, y: x + y))
    beside = bind(beside.where(F.size("equal") >= window), "doc_id", "text_hash", "item_id", matched=F.array_max(sums), compared=window)
    best = beside.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("matched", "compared")).alias("best")).select("doc_id", "text_hash", "item_id", "best.matched", "best.compared")
    return best.where(F.col("compared") - F.col("matched") <= F.floor(F.col("compared") * EXCHANGED / WINDOW))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that leak no benchmark item, unchanged."""
    found = saved(leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.struct("doc_id", "text_hash").alias(KEY)).distinct())
    key = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"))
    return docs.join(found, key.eqNullSafe(F.col(KEY)), "left_anti")
