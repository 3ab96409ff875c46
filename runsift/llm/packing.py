"""Best-fit packing: length patterns with repeat counts from non-negative least squares.

Documents become token pieces of at most `capacity` ids. Their lengths are
counted; patterns of one to three lengths that fill a sequence are enumerated,
and repeat counts x >= 0 are fitted so that the patterns use up the histogram
(least squares). Rounded down, the counts give the bulk of the sequences; the
lengths left over go best-fit, longest first, into what space there is. All of
this works on the histogram, whose size is bounded by the capacity, however many
documents there are. Pieces meet the plan by (length, number among the pieces of
that length).

Edge cases: a null or empty text is one piece that holds the end mark alone; rows
that repeat are packed once each; an empty table gives no rows; null ids pass
through; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runsift.llm.common import in_use, map_arrow, saved, values

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
#: Words of a generation, and the length from which a word is not kept.
WORDS_KEPT, LONG_WORD = 500_000, 100
# The settings of a tokenizer that lowers text, parts runs of letters from other signs, and takes a word's bytes for signs.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOWERS = ["NFC", "Replace", "Lowercase"]
#: Small letters that no step before the model changes.
SMALL = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
#: Marks that such a tokenizer never joins to letters before them.
SPLIT_OFF = b".,;:!?"
#: Texts whose words are taken up together, by bytes.
TOGETHER = 1 << 20
#: Pieces of one length are numbered in groups of about this many.
NUMBERED = 20_000
#: A pattern may leave this share of a sequence empty.
WASTE = 1 / 64
#: Shares at which what the longest piece leaves is split between two others.
SPLITS = (1 / 2, 2 / 5, 1 / 3, 1 / 4, 1 / 6, 1 / 10)


def parts_letters(settings: dict) -> bool:
    """Whether a tokenizer's settings are those."""
    normal = [n["type"] for n in (settings.get("normalizer") or {}).get("normalizers", [])]
    steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != LOWERS or [x["type"] for x in steps] != ["Split", "ByteLevel"] or settings["model"]["type"] != "BPE":
        return False
    split, signs = steps
    cut = split["pattern"].get("Regex") == LETTERS_APART and split["behavior"] == "Removed" and split["invert"]
    return bool(cut and not signs["add_prefix_space"] and not signs["use_regex"])


def settings_of(tokenizer) -> dict:
    """A tokenizer's steps before the model, and the model's kind: not its words and merges, which are most of its text."""
    steps = {name: json.loads(step.__getstate__()) for name in ("normalizer", "pre_tokenizer") if (step := getattr(tokenizer, name))}
    return {**steps, "model": {"type": type(tokenizer.model).__name__}}


def sign_of_byte() -> dict[int, str]:
    """Bytes that can't be seen stand as signs from 256 on, in order; all others as themselves."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_SIGNS = sign_of_byte()
PACKED = [struct.Struct(f"<{n}I") for n in range(32)]


def small_letters(word: bytes) -> str | None:
    """A word of small letters as the model sees it; None for all other words."""
    if word.isascii():
        return word.decode() if word.isalpha() and word.islower() else None
    return None if word.decode().strip(SMALL) else word.decode("latin-1").translate(_SIGNS)


class WordIds:
    """Token ids of words between ASCII white space, as little-endian bytes; words are UTF-8.

    Words are encoded many at a time, with a mark of its own id between them: a
    call of the tokenizer costs more than a word. The tokenizer drops white
    space and sees no further than a word, so a text's ids are its words' ids
    in order.

    Of a tokenizer that parts letters from other signs and lowers them, words that differ
    in these only are encoded once: their ids are those of the core and of the marks behind it.

    Two generations of words are kept: when the younger is full it becomes the older,
    and what was in the older only is forgotten, so frequent words stay.
    """

    MARK = b"\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = np.array(self.encode(self.MARK), "<u4")
        self.parts = parts_letters(settings_of(self.tokenizer))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, text: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids

    def clear(self) -> None:
        self.known, self.older = {}, {}

    def ids(self, words: list[bytes]) -> bytes:
        """Ids of a text's words, which were taken up before, but for odd ones."""
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            return b"".join([self.known.get(w) or np.array(self.encode(w), "<u4").tobytes() for w in words])

    def learn(self, words: set[bytes]) -> None:
        """Takes up the words of some texts; words with a mark or of some length are left to be encoded where they stand."""
        in_use(self)
        new = words.difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            self.older, self.known, new = self.known, {}, words
        if self.parts:
            shaped = self.shapes(new)
            wanted = set(new)
            wanted.difference_update(shaped)
            for core, tail in shaped.values():
                wanted.add(core)
                wanted.add(tail)
            self.take_up(wanted)
            known = self.known
            known.update([(w, known[core] + known[tail]) for w, (core, tail) in shaped.items() if core in known and tail in known])
        else:
            self.take_up(new)

    def shapes(self, words: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """word -> (core, marks behind it), for words of letters that are not all small or have such marks."""
        found = {}
        for word in words:
            core = word.rstrip(SPLIT_OFF)
            if core is word or len(core) == len(word):
                if word.islower() or not word.isascii() or not word.isalpha():
                    continue
                found[word] = word.lower(), b""
            elif core.isascii():
                if core.isalpha():
                    found[word] = core.lower(), word[len(core) :]
            elif core.decode().isalpha():
                found[word] = core, word[len(core) :]
        return found

    def take_up(self, words: set[bytes]) -> None:
        """Encodes words that are not known, many at a time."""
        new = words.difference(self.known)
        if self.older:
            older = self.older
            self.known.update([(w, older[w]) for w in new if w in older])
            new = new.difference(self.known)
        if b"" in new:
            self.known[b""] = b""
            new.discard(b"")
        if self.parts:  # letters need nothing of the tokenizer but its model
            tokenize, known, rest = self.tokenizer.model.tokenize, self.known, set()
            for word in new:
                text = small_letters(word) if len(word) < LONG_WORD else None
                if text is None:
                    rest.add(word)
                else:
                    ids = [t.id for t in tokenize(text)]
                    known[word] = PACKED[len(ids)].pack(*ids) if len(ids) < len(PACKED) else struct.pack(f"<{len(ids)}I", *ids)
            new = rest
        plain = [w for w in new if len(w) < LONG_WORD and self.MARK not in w] if len(self.mark) == 1 else []
        for k in range(0, len(plain), 256):
            part = plain[k : k + 256]
            ids = np.array(self.encode((b" " + self.MARK + b" ").join(part)), "<u4")
            cuts = np.flatnonzero(ids == self.mark[0]) * 4
            if len(cuts) == len(part) - 1:
                raw = ids.tobytes()
                self.known.update((w, raw[a:b]) for w, a, b in zip(part, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]))


_WORDS: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity ids: doc_id, piece, start, length, ids_crc32, row (a number of its own)."""
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = _WORDS.get(tokenizer) or _WORDS.setdefault(tokenizer, WordIds(tokenizer))
        where, piece, start, length, crc = [], [], [], [], []
        texts = values(batch.column(1).cast(pa.binary()))
        at = 0
        while at < batch.num_rows:
            some, read = [], 0
            for text in texts:
                read += len(text or b"")
                some.append(text.split() if text else [])
                if read >= TOGETHER:
                    break
            words.learn(set().union(*some))
            for i, split in enumerate(some, at):
                ids = words.ids(split) + end
                for n, first in enumerate(range(0, len(ids), width)):
                    part = ids[first : first + width]
                    where.append(i)
                    piece.append(n)
                    start.append(first // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at += len(some)
        ids = batch.column(0).take(pa.array(where, pa.int64()))
        return pa.record_batch([ids.cast(pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    found = map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), pieces, PIECES.rpartition(",")[0])
    return found.withColumn("row", F.monotonically_increasing_id())


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths, longest first, 0 for none, that nearly fill a sequence."""
    there = np.sort(np.asarray(lengths, np.int64))

    def below(most: np.ndarray) -> np.ndarray:
        """The longest of the lengths that fits, 0 if none does."""
        at = np.searchsorted(there, most, "right")
        return np.where(at > 0, there[np.maximum(at - 1, 0)], 0)

    zero = np.zeros(len(there), np.int64)
    found = [np.stack([there, zero, zero], 1), np.stack([there, below(capacity - there), zero], 1)]
    for share in SPLITS:
        third = below(((capacity - there) * share).astype(np.int64))
        second = below(capacity - there - third)
        found.append(np.stack([there, second, third], 1))
    rows = np.unique(np.sort(np.concatenate(found), 1)[:, ::-1], axis=0)
    return rows[capacity - rows.sum(1) <= capacity * WASTE]


def fit(rows: np.ndarray, histogram: np.ndarray, capacity: int, steps: int = 400) -> np.ndarray:
    """Counts x >= 0 with the least squares of (uses of each length - histogram), empty space costing a little.

    Accelerated projected gradient; each length is weighed by how often it occurs.
    """
    if not len(rows):
        return np.zeros(0)
    used = rows > 0
    scale = 1 / np.sqrt(np.maximum(histogram, 1.0))
    waste = (capacity - rows.sum(1)) / capacity

    def uses(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows[used], np.repeat(x, used.sum(1)), len(histogram))

    def back(r: np.ndarray) -> np.ndarray:
        return np.where(used, r[rows], 0).sum(1)

    weight = scale**2
    #: A step for each pattern, short enough for all that share its lengths.
    step = 1 / np.maximum(back(weight * uses(np.ones(len(rows)) * 3)), 1e-12)
    x = look = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, look - step * (back(weight * (uses(look) - histogram)) + 0.1 * waste))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, look = new, new + (before - 1) / t * (new - x)
    return x


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit, longest first, on counts of lengths: (pieces of each length in a sequence, number of such sequences)."""
    spaces: list[int] = []  # sorted
    bins: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)

    def put(content: dict[int, int], n: int, space: int) -> None:
        if n:
            if not bins[space]:
                bisect.insort(spaces, space)
            bins[space].append((content, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                content, n = bins[space].pop()
                if not bins[space]:
                    spaces.pop(at)
            else:
                space, content = capacity, {}
                n = -(-left // (capacity // length))
            each = space // length
            whole = min(n, left // each)
            put(content | {length: each}, whole, space - each * length)
            left -= whole * each
            if whole < n and left:  # fewer than `each` remain, for one sequence
                put(content | {length: left}, 1, space - left * length)
                whole, left = whole + 1, 0
            if content:
                put(content, n - whole, space)
    return [x for group in bins.values() for x in group]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences by content: (pieces of each length, number of such sequences), using up the histogram."""
    counts = np.zeros(capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    rows = patterns(np.flatnonzero(counts), capacity)
    repeat = np.floor(fit(rows, counts, capacity) + 1e-6).astype(np.int64)
    left = dict(histogram)
    out = []
    for j in np.argsort(-repeat, kind="stable"):
        if not repeat[j]:
            break
        content: dict[int, int] = {}
        for length in rows[j][rows[j] > 0].tolist():
            content[length] = content.get(length, 0) + 1
        n = min(int(repeat[j]), *(left[x] // k for x, k in content.items()))
        if n:
            out.append((content, n))
            for length, k in content.items():
                left[length] -= n * k
    return out + best_fit({k: n for k, n in left.items() if n}, capacity)


def placements(sequences: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Where the pieces of each length go, by their number: one row for each length and kind of sequence."""
    rows, taken, base = [], defaultdict(int), 0
    for content, n in sequences:
        offset = 0
        for length, k in sorted(content.items(), reverse=True):
            rows.append((length, taken[length], base, k, offset))
            taken[length] += n * k
            offset += k * length
        base += n
    return pd.DataFrame(rows, columns=["length", "first", "base", "each", "offset"]).sort_values(["length", "first"], ignore_index=True)


def numbered(pieces: DataFrame, largest: int) -> DataFrame:
    """Adds number: from 0 among the pieces of a length. A common length is counted in many groups."""
    groups = max(1, -(-largest // NUMBERED))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    return rows.withColumn("within", within).join(starts, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("within"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of all documents into as few sequences as the plan finds.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. The pieces, without their ids, are written once to the
    shared folder, as the histogram and the placement must see the same ones.
    """
    pieces = saved(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    if not histogram:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    at = placements(plan(histogram, capacity))
    shift = max(histogram.values()).bit_length() + 1
    keys = (at["length"].to_numpy(np.int64) << shift) + at["first"].to_numpy(np.int64)
    first, base, each, offset = (at[c].to_numpy(np.int64) for c in ("first", "base", "each", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, n = length.to_numpy(np.int64), number.to_numpy(np.int64)
        k = np.searchsorted(keys, (size << shift) + n, "right") - 1
        n = n - first[k]
        return pd.DataFrame({"sequence_id": base[k] + n // each[k], "offset": offset[k] + n % each[k] * size})

    placed = numbered(pieces, max(histogram.values())).withColumn("at", place("length", "number"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
