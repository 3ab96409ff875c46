"""Language identification of words by a linear-chain conditional random field.

Every word of a text is a node with the languages as labels. A node's features
are the word itself (the lexicon), its beginnings and endings, and its character
n-grams, each with a learned weight per language; learned transitions say how
languages follow each other. Forward-backward gives each word's marginals, so
words of code-switched text get languages of their own; a text's language is
the one with the largest sum of marginals, and its score that sum's share.

The field is trained by stochastic gradient ascent on the conditional likelihood, on texts of at
most `SAMPLE` documents outside the held-out fold: half as they are, half spliced from pieces of
two documents, since single-language text says nothing about switching. All
languages of the training rows are learned (at most `LANGUAGES`, the commonest).

Edge cases: null texts and texts without a letter are `und` with score 0; so is everything
when there is nothing to learn from; words without letters take part in the chain without features; ties go to
the language first in the alphabet; repeated rows are scored alike; very long
texts are one chain, walked in step with others; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runsift.llm.common import fold, sample_ids
from runsift.llm.crf import Trainer, forward_backward

FOLDS, HELD_OUT = 4, 2
SAMPLE, LANGUAGES = 3000, 256
#: Words of a document that training sees: from its middle. Scoring sees all words.
TRAIN_WORDS = 60
WIDTH = 1 << 17
#: Distinct words whose features are found at a time.
WORDS_AT_ONCE = 20_000
LETTER = re.compile(r"[^\W\d_]")
MARKS = ".,;:!?\"'()[]{}<>*#$%&|=+~`“”‘’«»¿¡…-_/0123456789"
#: Chains of one walk in step, and rows labelled at a time.
CHAINS, STEP_ROWS = 4096, 4000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(at: np.ndarray, chars: np.ndarray, k: int, kind: int) -> np.ndarray:
    """Feature indices of the k characters from each place on."""
    x = np.full(len(at), kind, np.uint64)
    for i in range(k):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + chars[at + i])
    return (x % np.uint64(WIDTH)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words' features, and for each index its word's number; a word without a letter has none.

    The word, its first and last one to three characters, and its runs of two and
    three characters with its ends marked; whole words, however long.
    """
    bare = [w.strip(MARKS).lower() for w in words]
    lettered = [i for i, w in enumerate(bare) if w.isalpha() or LETTER.search(w)]
    if not lettered:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.array(lettered)
    text = "".join([f"<{bare[i]}>" for i in lettered])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(bare[i]) for i in lettered])
    first = np.cumsum(size + 2) - size - 1  # of each word, behind its opening mark
    of = np.repeat(np.arange(len(size)), size + 2)
    place = np.arange(len(chars)) - (first - 1)[of]
    whole = np.add.reduceat(mixed(chars * np.uint64(0xC2B2AE3D27D4EB4F) + place.astype(np.uint64)), first - 1)
    found, owner = [(mixed(whole) % np.uint64(WIDTH)).astype(np.int64)], [number]
    for k in (1, 2, 3):
        there = np.flatnonzero(size >= k)
        found += [runs_of(first[there], chars, k, 10 + k), runs_of(first[there] + size[there] - k, chars, k, 20 + k)]
        owner += [number[there]] * 2
    for k in (2, 3):
        there = np.flatnonzero(place + k <= size[of] + 2)
        found.append(runs_of(there, chars, k, k))
        owner.append(number[of[there]])
    return np.concatenate(found), np.concatenate(owner)


def by_word(words: list[str]) -> list[list[int]]:
    index, owner = features(words)
    order = np.argsort(owner, kind="stable")
    return [x.tolist() for x in np.split(index[order], np.searchsorted(owner[order], np.arange(1, len(words))))]


def potentials(words: list[str], weights: np.ndarray) -> np.ndarray:
    """(words, labels): exp of each word's scores, the largest of them 1."""
    score = np.zeros((len(words), weights.shape[1]))
    for at in range(0, len(words), WORDS_AT_ONCE):
        some = words[at : at + WORDS_AT_ONCE]
        index, owner = features(some)
        for c in range(weights.shape[1]):
            score[at : at + len(some), c] = np.bincount(owner, weights[index, c], len(some))
    return np.exp(np.maximum(score - score.max(1, keepdims=True), -60))


def train(texts: list[tuple[str, int]], labels: int, epochs: int = 4, rate: float = 0.5, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, labels) and transition scores (labels, labels) from (text, label) rows."""
    rng = np.random.default_rng(seed)
    cut = []
    for text, label in texts:
        words = text.split()
        a = max(0, (len(words) - TRAIN_WORDS) // 2)
        cut.append((by_word(words[a : a + TRAIN_WORDS]), label) if words else ([], label))
    cut = [(f, y) for f, y in cut if f]
    field = Trainer(WIDTH, labels, rate)
    for _ in range(epochs):
        chains = []
        order = rng.permutation(len(cut))
        for i, j in zip(order[::2], order[1::2]):
            (f, y), (g, z) = cut[i], cut[j]
            if rng.random() < 0.5:
                chains += [(f, [y] * len(f)), (g, [z] * len(g))]
            else:
                a, b = int(rng.integers(1, len(f) + 1)), int(rng.integers(0, len(g)))
                chains.append((f[:a] + g[b:], [y] * a + [z] * (len(g) - b)))
        for k in range(0, len(chains), 16):
            field.step(chains[k : k + 16])
    return field.weights, field.moves


def label_words(texts: list[str | None], weights: np.ndarray, moves: np.ndarray) -> list[np.ndarray | None]:
    """Marginals (words, labels) of each text; None for a text without words."""
    transition = np.exp(moves - moves.max())
    split = [(t or "").split() for t in texts]
    order = sorted((i for i, w in enumerate(split) if w), key=lambda i: -len(split[i]))
    out: list[np.ndarray | None] = [None] * len(texts)
    for k in range(0, len(order), CHAINS):
        part = order[k : k + CHAINS]
        lengths = np.array([len(split[i]) for i in part])
        # Every distinct word of these texts is scored once.
        distinct = list(set().union(*(split[i] for i in part)))
        place = dict(zip(distinct, range(len(distinct))))
        at = np.fromiter((p for i in part for p in map(place.__getitem__, split[i])), np.int64, int(lengths.sum()))
        marginal = forward_backward(potentials(distinct, weights)[at], lengths, transition)
        for i, m in zip(part, np.split(marginal, np.cumsum(lengths)[:-1])):
            out[i] = m
    return out


def training_texts(docs: DataFrame, sample: int) -> list[tuple[str, str]]:
    """(text, lang) of at most `sample` rows outside the held-out fold, each cut to the words that training sees."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    picked = F.broadcast(sample_ids(rows.select("doc_id").distinct(), "doc_id", sample))
    rows = rows.join(picked, "doc_id").dropDuplicates(["doc_id"])
    words = F.split(F.trim("text"), r"\s+")
    start = F.greatest(F.floor((F.size(words) - TRAIN_WORDS) / 2), F.lit(0)).cast("int") + 1
    cut = F.array_join(F.slice(words, start, TRAIN_WORDS), " ")
    found = rows.select("doc_id", cut.alias("cut"), "lang").collect()  # bounded by the sample
    return [(r["cut"], r["lang"]) for r in sorted(found, key=lambda r: r["doc_id"])]


def word_languages(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[str]]:
    """(doc_id, letters, sums, switches) and the languages: per document the sum of its words' marginals by language, and how often the likeliest language of lettered words changes."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    texts = training_texts(narrow, sample)
    counts: dict[str, int] = {}
    for _, lang in texts:
        counts[lang] = counts.get(lang, 0) + 1
    langs = sorted(sorted(counts, key=lambda x: (-counts[x], x))[:LANGUAGES])
    place = {x: i for i, x in enumerate(langs)}
    n = max(len(langs), 1)
    weights, moves = train([(t, place[x]) for t, x in texts if x in place], n)
    held = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), moves))  # 512 KB for each language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(at, STEP_ROWS)
                texts = batch.column(1).to_pylist()
                letters, sums, switches = [], [], []
                for text, marginal in zip(texts, label_words(texts, w, m)):
                    there = marginal is not None and any(c.isalpha() for c in text)
                    letters.append(there)
                    sums.append(marginal.sum(0).tolist() if there else [0.0] * n)
                    likeliest = marginal.argmax(1) if there else np.zeros(1, int)
                    switches.append(int((likeliest[1:] != likeliest[:-1]).sum()))
                yield pa.record_batch([batch.column(0), pa.array(letters), pa.array(sums, pa.list_(pa.float64())), pa.array(switches, pa.int64())], ["doc_id", "letters", "sums", "switches"])

    return narrow.select("doc_id", "text").mapInArrow(label, "doc_id long, letters boolean, sums array<double>, switches long"), langs


def language_id(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, switches for every document."""
    found, langs = word_languages(docs, sample, id_col, text_col, lang_col)
    known = F.col("letters") & F.lit(bool(langs))
    top = F.array_max("sums")
    pred = F.element_at(F.array(*map(F.lit, langs or ["und"])), F.array_position("sums", top).cast("int"))
    share = top / F.aggregate("sums", F.lit(0.0), lambda a, b: a + b)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.when(known, pred).otherwise("und").alias("lang_pred"), F.when(known, share).otherwise(0.0).alias("score"), "switches")
