"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Texts are judged by all windows of `WINDOW` words in a row, as few words make a text toxic, wherever they stand.
Windows reach over the ends of a text, so each word of a short or long text is in `WINDOW` of them. The
lexicons (whole words, and word beginnings of several lengths, for languages that
inflect) are learned from at most `SAMPLE` labelled rows outside the held-out fold:
entries found far more often in toxic than in other documents. Twelve voters look at a window
through them: parts of the word lexicon, beginnings by length, and patterns
(two hits, four hits, disguised spelling, shouted hits). Their votes on all windows
of ALL documents are counted by pattern; the label model, a two-class mixture fitted by
expectation-maximisation, estimates every voter's hit rates in either class and the
correlations that remain within a class, by which voters that say the same thing
are weighed down; a voter that does not hit abstains, and a window that none hits
is a vote for the clean class. Its posteriors are the targets of a logistic
regression on hashed words and word beginnings, trained on windows (every `STEP` words) of at most `SAMPLE`
documents; a document's score is that of its worst window. Labels serve to find the lexicons, nothing else.

Edge cases: null and empty texts have no features and get the intercept's score;
labels that are null or of unknown documents are ignored; without a toxic label nothing can be learned and
all scores are 0; repeated rows are scored alike; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runsift.llm.common import Memo, fold, map_arrow, sample_ids
from runsift.llm.hashed import WIDTH, bare, ftrl
from runsift.llm.quality import FOLDS, labelled

THRESHOLD, SAMPLE = 0.5, 6000
BEGINNINGS = (4, 5, 6, 7, 8)
WORD_PARTS = 3
WINDOW = 25
#: Words between the windows that are used for training; votes and scores are of every window.
STEP = WINDOW // 2
#: Of windows without votes, one in so many is used for training, at most TRAINED windows in all.
CLEAN_IN, TRAINED = 6, 60_000
#: Updates in training, as far as 6 to 40 rounds make them.
STEPS = 240_000
VOTERS = WORD_PARTS + len(BEGINNINGS) + 4
#: An entry's likelihood ratio statistic, and its share of toxic among its documents.
EVIDENCE, SHARE = 27.0, 0.7
#: Digits and signs that stand for letters.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
WORDS_KEPT = 500_000


def entries_of(word: str) -> list[int]:
    """Hashes of the lexicon entries a word could be: itself, then its beginnings."""
    word = bare(word)
    if len(word) < 3 or not any(c.isalpha() for c in word):
        return []
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in (f"0{word}", *(f"{k}{word[:k]}" for k in BEGINNINGS if len(word) >= k))]


def lexicon(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the entries that tell toxic from other rows of the sample (id, text, toxic)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = Memo(entries_of, WORDS_KEPT)
        entry, toxic = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = {e for w in set((text or "").split()) for e in known[w]}
            entry += found
            toxic += [label] * len(found)
        return pa.record_batch([pa.array(entry, pa.int64()), pa.array(toxic, pa.int32())], ["entry", "toxic"])

    n, n_toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n_toxic:
        return np.zeros(0, np.int64)
    counts = map_arrow(sample.select("text", F.col("toxic").cast("int")), of, "entry long, toxic int").groupBy("entry").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    rate = n_toxic / n
    a, b = F.col("a"), F.col("n") - F.col("a")
    part = lambda x, r: F.when(x > 0, x * F.log(x / (F.col("n") * r))).otherwise(0.0)
    evidence = 2 * (part(a, rate) + part(b, max(1 - rate, 1e-9)))
    kept = counts.where((a >= 3) & (a >= SHARE * F.col("n")) & (evidence >= EVIDENCE))
    return np.sort(kept.select("entry").toPandas()["entry"].to_numpy(np.int64))


def window_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the values of each window, in order of the windows' last places: from the first on to WINDOW - 1 beyond the end."""
    total = np.cumsum(np.pad(values, (WINDOW, WINDOW - 1)))
    return total[WINDOW:] - total[:-WINDOW]


def votes(words: list[str], known: Memo) -> np.ndarray:
    """For each window the voters that hit, as bits."""
    if not words:
        return np.zeros(0, np.int64)
    hits = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    n, first = window_sums((hits > 0).astype(np.int64)), WORD_PARTS + len(BEGINNINGS)
    some, span = np.pad(hits, WINDOW - 1), 1
    while 2 * span <= WINDOW:  # some: of span words from each on
        some, span = some[:-span] | some[span:], 2 * span
    some = some[: len(n)] | some[WINDOW - span :]
    return some | ((n >= 2).astype(np.int64) << first) | ((n >= 4).astype(np.int64) << (first + 1))


def places(word: str) -> tuple[int, ...]:
    """Indices of the features of a word: itself, its first four and five characters."""
    word = bare(word)
    return tuple(xxhash.xxh3_64_intdigest(x) % WIDTH for x in (word, "4" + word[:4], "5" + word[:5])) if word else ()


def word_voters(entries: np.ndarray) -> Memo:
    """word -> bits of the voters it makes hit."""
    held = set(entries.tolist())

    def of(word: str) -> int:
        bits = 0
        for k, e in enumerate(entries_of(word)):
            if e in held:
                bits |= 1 << (WORD_PARTS + k - 1 if k else e % WORD_PARTS)
        first = WORD_PARTS + len(BEGINNINGS)
        if bits and len(word) > 3 and word.isupper():
            bits |= 1 << (first + 3)
        if not bits and any(c in "013457@$!" for c in word):
            plain = bare(word.translate(DISGUISE))
            if plain != bare(word) and any(e in held for e in entries_of(plain)[:1]):
                bits |= 1 << (first + 2)
        return bits

    return Memo(of, WORDS_KEPT)


def vote_counts(texts: DataFrame, entries: np.ndarray) -> pd.DataFrame:
    """votes, n: how many windows of all texts have each pattern of votes; 2^12 rows at most."""
    held = texts.sparkSession.sparkContext.broadcast(entries)  # bounded by the sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = word_voters(held.value), np.zeros(1 << VOTERS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen += np.bincount(votes(text.split(), known), minlength=len(seen))
        there = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(there.astype(np.int32)), pa.array(seen[there])], ["votes", "n"])

    return texts.mapInArrow(count, "votes int, n long").groupBy("votes").agg(F.sum("n").alias("n")).toPandas()


def training_windows(chosen: DataFrame, entries: np.ndarray) -> pd.DataFrame:
    """votes and features of windows of the chosen (id, text): all with votes, some without; at most TRAINED."""
    held = chosen.sparkSession.sparkContext.broadcast(entries)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, where, out = word_voters(held.value), Memo(places, WORDS_KEPT), ([], [], [], [])
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").split()
            for k, bits in zip(range(0, len(words), STEP), votes(words, known)[WINDOW - 1 :: STEP].tolist()):
                draw = xxhash.xxh3_64_intdigest(f"{i}:{k}") >> 1
                if bits or draw % CLEAN_IN == 0:
                    at, n = np.unique([p for w in words[k : k + WINDOW] for p in where[w]], return_counts=True)
                    for column, x in zip(out, (draw, bits, at.astype("<i4").tobytes(), n.astype("<f4").tobytes())):
                        column.append(x)
        return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["draw", "votes", "index", "value"])

    found = map_arrow(chosen, of, "draw long, votes int, index binary, value binary")
    return found.orderBy("draw").limit(TRAINED).toPandas()


def window_scores(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """(doc_id, score) of docs (doc_id, text): the highest window's."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.astype(np.float64)
        each = Memo(lambda word: float(sum(w[p] for p in places(word))), WORDS_KEPT)
        for batch in batches:
            out = np.full(batch.num_rows, intercept)
            for i, text in enumerate(batch.column(1).to_pylist()):
                if words := (text or "").split():
                    out[i] += window_sums(np.fromiter(map(each.__getitem__, words), np.float64, len(words))).max()
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


class LabelModel:
    """Two classes, voters that hit or not; within a class they may be correlated."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 60):
        """patterns: 0/1 rows of votes; counts: how often; start: a first guess of each pattern's posterior."""
        self.weight = np.ones(patterns.shape[1])
        q = np.clip(start, 0.01, 0.99)
        for _ in range(rounds):
            self.prior = float(np.clip((counts * q).sum() / counts.sum(), 1e-4, 0.5))
            self.hit = [((counts * p) @ patterns + 0.5 * r) / ((counts * p).sum() + 1) for p, r in ((1 - q, 0.01), (q, 0.5))]
            some = (patterns.sum(1) > 0) * counts
            self.any = [float((some * p).sum() / max((counts * p).sum(), 1e-9)) for p in (1 - q, q)]
            self.correlation = self._correlation(patterns, counts, q)
            self.weight = 1 / np.maximum(np.abs(self.correlation).sum(1), 1)
            q = self.posterior(patterns)

    def _correlation(self, patterns: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of the votes, within the classes."""
        cov = np.zeros((patterns.shape[1],) * 2)
        for p, hit in zip((1 - q, q), self.hit):
            x = patterns - hit
            cov += (x * (counts * p)[:, None]).T @ x
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        return cov / np.outer(sd, sd)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        clean, toxic = (np.clip(h, 1e-4, 1 - 1e-4) for h in self.hit)
        # A voter that does not hit abstains; only a text that no voter hits speaks for the clean class.
        silent = patterns.sum(1) == 0
        logit = np.log(self.prior / (1 - self.prior)) + (patterns * np.maximum(np.log(toxic / clean), 0)) @ self.weight
        logit += silent * np.log(max(1 - self.any[1], 1e-4) / max(1 - self.any[0], 1e-4))
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def unpacked(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(VOTERS)) & 1).astype(np.float64)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    entries = lexicon(labelled(docs, labels, "toxic", id_col, text_col, sample))
    held_out = (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out")
    if not len(entries):
        return narrow.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(int(0 >= threshold)).alias("predicted"))
    counted = vote_counts(narrow.select("text"), entries)
    bits, counts = counted["votes"].to_numpy(np.int64), counted["n"].to_numpy(np.float64)
    patterns = unpacked(bits)
    model = LabelModel(patterns, counts, np.where(patterns.sum(1) >= 1, 0.8, 0.01))

    picked = sample_ids(narrow.select(F.col("doc_id").alias("id")).where("id is not null").distinct(), "id", sample)
    rows = training_windows(narrow.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("id", "text").dropDuplicates(["id"]), entries)
    rows["target"] = model.posterior(unpacked(rows["votes"].to_numpy(np.int64)))
    weights, intercept = ftrl(rows, epochs=int(np.clip(STEPS // max(len(rows), 1), 6, 40)), alpha=0.1, l1=float(np.clip(len(rows) / 20_000, 0.05, 1)), l2=0.1)
    intercept -= float(np.log(CLEAN_IN))  # fewer clean windows were seen than there are, and a text has many: in doubt it is clean
    return window_scores(narrow, weights, intercept).select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
