"""Secret scan with corpus-wide ownership frequency.

Texts are searched for three base kinds (assignments, access keys, hex runs) and
three more (private key blocks, credentials in URLs, mixed tokens). Over the
corpus, every value found is counted by distinct repositories and distinct
owners: a value of more than `COPIED_OWNERS` owners in more than `COPIED_REPOS` repositories is a
copied example; one that stays within few repositories, or with few owners, looks live. `spans` has
all findings, `copied_spans` the copied ones among those of the further kinds; n_copied and n_live
count all. n_repos is the largest number of repositories that hold one of the row's values, 0
without findings.

Edge cases: a null text counts as empty; offsets count code points; a null owner or repository
is no owner or repository; rows that repeat (same id and text) are one document
in the counts and each get a row; a text of many secrets is one row; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runsift.llm.common import map_arrow, saved

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "pem", "url", "mixed")
LEAST = {"assign": 6, "access": 20, "hex": 24}

PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----.*?-----END \1-----", re.DOTALL)
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:([^\s/:@]+)@")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
#: A mixed token has at least so many characters, all three classes, and so many bits a character.
MIXED, BITS = 32, 3.5
COPIED_OWNERS, COPIED_REPOS = 2, 2

Span = tuple[int, int, str, str]


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def base_spans(text: str) -> list[Span]:
    """(start, place of the kind, end, value) of the base kinds."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run in RUN.finditer(text):  # holds every access key and hex run that is long enough
        for k, pattern in ((1, ACCESS), (2, HEX)):
            found += [(m.start(), k, m.end(), m[0]) for m in pattern.finditer(text, run.start(), run.end()) if m.end() - m.start() >= LEAST[KINDS[k]]]
    return sorted(found)


def further_spans(text: str, base: list[Span]) -> list[Span]:
    """Findings of the further kinds that overlap no base span."""
    found = []
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), 3, m.end(), m[0]) for m in PEM.finditer(text)]
    if "://" in text:
        found += [(m.start(1), 4, m.end(1), m[1]) for m in URL.finditer(text)]
    for m in RUN.finditer(text):
        v = m[0]
        if len(v) >= MIXED and any(c.islower() for c in v) and any(c.isupper() for c in v) and any(c.isdigit() for c in v) and entropy(v) >= BITS:
            found.append((m.start(), 5, m.end(), v))
    return [x for x in sorted(found) if not any(x[0] < b[2] and b[0] < x[2] for b in base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


_FOUND = "doc_id long, text_hash long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,kind:int,end:long,value:long>>"


def findings(docs: DataFrame) -> DataFrame:
    """A row for each (doc_id, text_hash, repo, owner, text), with all spans and hashes of their values."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, found = ([], [], []), [], []
        for text in batch.column(4).to_pylist():
            text = text or ""
            base = base_spans(text)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            shas.append(hashlib.sha256(written(base).encode()).hexdigest())
            found.append([{"start": a, "kind": k, "end": b, "value": xxhash.xxh3_64_intdigest(v) - (1 << 63)} for a, k, b, v in [*base, *further_spans(text, base)]])
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())])
        return pa.record_batch([*(batch.column(k) for k in range(4)), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array(found, pa.list_(span))], ["doc_id", "text_hash", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return map_arrow(docs, scan, _FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners): in how many distinct repositories and with how many owners a value occurs."""
    seen = found.select("repo", "owner", F.explode("found.value").alias("value"))
    owners = seen.where("owner is not null").groupBy("value", "owner").agg(F.lit(1).alias("x")).groupBy("value").agg(F.count("x").alias("n_owners"))
    repos = seen.where("repo is not null").groupBy("value", "repo").agg(F.lit(1).alias("x")).groupBy("value").agg(F.count("x").alias("n_repos"))
    every = seen.select("value").distinct()
    counted = every.join(owners, "value", "left").join(repos, "value", "left")
    return counted.select("value", F.coalesce("n_repos", F.lit(0)).alias("n_repos"), F.coalesce("n_owners", F.lit(0)).alias("n_owners"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live, copied_spans, n_repos: a row for each row of docs."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    found = saved(findings(narrow))
    counted = saved(ownership(found))
    spans = found.select("doc_id", "text_hash", F.inline("found")).join(counted, "value")
    copied = (F.col("n_owners") > copied_owners) & (F.col("n_repos") > copied_repos)
    span = F.struct("start", "kind", "end", copied.alias("copied"))
    held = saved(spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("held"), F.max("n_repos").alias("n_repos")))
    same = F.col("f.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("f.text_hash") == F.col("h.text_hash"))
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    out = found.drop("found").alias("f").join(held.alias("h"), same, "left")
    number = lambda flag: F.coalesce(F.size(F.filter("h.held", lambda s: s["copied"] == flag)), F.lit(0)).cast("long")
    further = lambda s: (s["kind"] >= 3) & s["copied"]
    text = lambda keep: F.coalesce(F.array_join(F.transform(F.filter("h.held", keep), name), ","), F.lit(""))
    more = text(further).alias("copied_spans"), F.coalesce("h.n_repos", F.lit(0)).cast("long").alias("n_repos")
    return out.select("f.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text(lambda s: F.lit(True)).alias("spans"), number(True).alias("n_copied"), number(False).alias("n_live"), *more)
