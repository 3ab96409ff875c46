"""Line dedup, decontamination and packing, held against plain versions."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runsift.llm.common import BATCH_BYTES, map_arrow, saved
from runsift.llm.decontam import EXCHANGED, SPAN, WINDOW, decontaminated, leaks
from runsift.llm.line_dedup import without_shared_lines
from runsift.llm.packing import best_fit, pack, plan
from runsift.llm.secrets import secret_scan
from tests.llm.conftest import prose

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def test_line_dedup(frame):
    shared = "this line stands on many sites"
    rows = [(i, f"own words of {i}\n{shared}\nOf.\n  {shared} \nlast one here {i}", "en", f"s{i % 4}") for i in range(3, 12)]
    rows += [(20, shared, "en", "s1"), (21, "only two sites have this", "en", "s1"), (22, "only two sites have this", "en", "s2"), (23, "only two sites have this", "en", None)]
    rows += [(30, None, "en", "s1"), (31, "", "en", "s2"), (32, "a\n\n\nb", "en", "s3"), (None, shared, "en", "s2")]
    frame_ = frame(rows + rows[:1])
    out = without_shared_lines(frame_)
    assert set(frame_.columns) < set(out.columns)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.text, r._line_removed))
    assert got[3] == [(f"own words of 3\n{shared}\nOf.\nlast one here 3", 1)] * 2  # the first occurrence stays
    assert got[7] == [("own words of 7\nOf.\nlast one here 7", 2)]
    assert got[20] == [("", 1)] and got[None] == [("", 1)]
    assert got[21] == got[22] == [("only two sites have this", 0)]
    assert got[30] == [(None, 0)] and got[31] == [("", 0)] and got[32] == [("a\n\n\nb", 0)]
    assert without_shared_lines(frame([])).count() == 0


def test_line_dedup_near_the_threshold(frame):
    rows = [(i, f"a line on some {k} sites", "en", f"s{i}") for k in range(1, 9) for i in range(100 * k, 100 * k + k)]
    gone = {r.doc_id // 100 for r in without_shared_lines(frame(rows), min_sites=5).collect() if r.text == ""}
    assert gone == {5, 6, 7, 8}


def plain_leaks(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for d, text in docs:
        a = words(text)
        for item, other in items:
            b = words(other)
            if len(b) < SPAN:
                continue
            n = min(len(b), WINDOW)
            for shift in range(-len(b), len(a)):
                same = [int(a[k + shift] == b[k]) for k in range(max(0, -shift), min(len(b), len(a) - shift))]
                for k in range(len(same) - n + 1):
                    m = sum(same[k : k + n])
                    if n - m <= n * EXCHANGED // WINDOW:
                        out[d, item] = max(out.get((d, item), (0, 0)), (m, n))
    return sorted((d or 0, i, *m) for (d, i), m in out.items())


@pytest.fixture(scope="module")
def bench_case():
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice((5, 9, 10, 13, 20, 40)), 900)) for i in range(12)] + [(50, None), (51, ""), (None, prose(rng, 20, 900)), (3, prose(rng, 20, 900))]
    docs = []
    for d in range(1, 61):
        text = prose(rng, rng.choice((0, 5, 30, 80)), 900).split()
        if d % 2:
            piece = (rng.choice(items)[1] or "").split()
            if rng.random() < 0.5:
                a = rng.randrange(max(1, len(piece) - 12))
                piece = piece[a : a + rng.choice((8, 13, 16))]
            for _ in range(rng.choice((0, 1, 2, 3, 4))):
                if piece:
                    piece[rng.randrange(len(piece))] = "changed"
            at = rng.choice((0, len(text)))
            text[at:at] = piece
        docs.append((d, " ".join(text).replace("w1 ", "W1, ")))
    docs += [(70, None), (71, ""), (None, items[5][1]), (72, (prose(rng, 9000, 900) + " " + items[4][1]))]
    return docs + docs[:3], items


def test_leaks(spark, frame, bench_case):
    docs, items = bench_case
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, seed long")
    documents = frame([(d, t, "en", "a") for d, t in docs])
    got = leaks(documents, benchmark)
    named = sorted({(r.doc_id or 0, r.item_id, r.matched, r.compared) for r in got.collect()}, key=str)
    assert named == sorted(plain_leaks(docs, items), key=str)
    kept = decontaminated(documents, benchmark)
    assert kept.columns == documents.columns
    leaked = {d for d, *_ in named}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d, _ in docs if (d or 0) not in leaked)
    assert leaks(documents, benchmark.limit(0)).count() == 0 and leaks(frame([]), benchmark).count() == 0


def test_leaks_by_shuffle(spark, frame, bench_case, monkeypatch):
    monkeypatch.setattr("runsift.llm.decontam.SENT", 0)
    docs, items = bench_case
    got = leaks(frame([(d, t, "en", "a") for d, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id or 0, r.item_id) for r in got.collect()} == {x[:2] for x in plain_leaks(docs, items)}


def test_masks_miss_no_window():
    from itertools import combinations

    from runsift.llm.decontam import MASKS

    for gone in combinations(range(WINDOW), EXCHANGED):
        assert any(not {at + k for k in mask} & set(gone) for mask in MASKS for at in range(WINDOW - SPAN + 1))


def test_packing(odd, frame):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    more = [(100, "It's <|endoftext|> x y a\x1cb \x01 Σίσυφος é 日本語 " + "z" * 300, "en", "a"), (101, "tab\tand\r\nbreak", "en", "a")]
    texts += [(i, t) for i, t, *_ in more]
    expected = []
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        expected += [(i or 0, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    got = pack(odd.unionByName(frame(more)), TOKENIZER, 64).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(frame([]), TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_up_the_histogram(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 256): rng.choice((1, 3, 50, 2000)) for _ in range(rng.choice((3, 40, 200)))}
    for sequences in (plan(histogram, 256), best_fit(histogram, 256)):
        used = defaultdict(int)
        for content, n in sequences:
            assert sum(x * k for x, k in content.items()) <= 256
            for x, k in content.items():
                used[x] += n * k
        assert dict(used) == histogram
    total = sum(x * n for x, n in histogram.items())
    many = sum(n for x, n in histogram.items() if x > 128)
    assert sum(n for _, n in plan(histogram, 256)) <= 1.25 * max(-(-total // 256), many) + 1


def test_secrets(frame):
    own = [f"{random.Random(i).getrandbits(160):040x}" for i in range(8)]
    sample, mixed = "0123456789abcdef01234567", "Ab3dEf6hIj9kLm2nOp5qRs8tUv1wXy4zQ7"
    rows = [(i, f'é token = "{own[i]}" and {sample}\nSecret:abcdef AKIA{"A1" * 8} AKIA12 password: x', "en", f"s{i}") for i in range(5)]
    rows += [(10, f"key {mixed} end", "en", "s1"), (11, "https://user:hunter22@example.org/x", "en", "s1"), (12, None, "en", "s1"), (13, "", "en", None), (None, f"{own[7]}", "en", "s2")]
    rows += [(20 + i, f"copied {mixed}x", "en", f"s{i}") for i in range(4)]
    pem = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    rows += [(30, pem, "en", "s1")]
    got = {r.doc_id: r for r in secret_scan(frame(rows + rows[:2])).collect()}
    assert secret_scan(frame(rows + rows[:2])).count() == len(rows) + 2
    one = got[0]
    text = rows[0][1]
    base = [(text.index("token"), "assign", text.index('" and')), (text.index(own[0]), "hex", text.index('" and')), (text.index(sample), "hex", text.index("\nSecret")), (text.index("Secret"), "assign", text.index(" AKIA")), (text.index("AKIA"), "access", text.index(" AKIA12"))]
    written = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
    assert (one.n_assign, one.n_access, one.n_hex) == (2, 1, 2)
    assert one.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and one.spans == written
    assert one.n_copied == 3 and one.n_live == 2  # the sample, `abcdef` and the access key are everywhere
    assert got[10].spans == "mixed:4:38" and got[20].spans == "mixed:7:42" and got[11].spans == "url:13:21" and got[30].spans == f"pem:0:{len(pem)}"
    assert got[12].spans == got[13].spans == "" and got[12].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].n_hex == 1
    assert secret_scan(frame([])).count() == 0


def test_copied_secrets_of_further_kinds_are_kept(frame):
    pem = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    url = "https://user:hunter22@example.org/x"
    rows = [(i, f"{pem} {url}", "en", f"s{i}") for i in range(4)] + [(9, f"{url} {pem[:-1]}", "en", "s1"), (10, "none", "en", "s1")]
    rows.append((11, pem.replace("abc", "own"), "en", "s1"))
    got = {r.doc_id: r for r in secret_scan(frame(rows)).collect()}
    at = len(pem) + 1 + 13
    for i in range(4):
        assert got[i].spans == got[i].copied_spans  # all findings, whoever holds them
        assert (got[i].copied_spans, got[i].n_copied, got[i].n_live, got[i].n_repos) == (f"pem:0:{len(pem)},url:{at}:{at + 8}", 2, 0, 5)
    assert got[9].copied_spans == "url:13:21" and got[10].copied_spans == "" and got[10].n_repos == 0
    # A value of many owners in one repository is not widely copied.
    one = {r.doc_id: r for r in secret_scan(frame(rows), repo_col="lang").collect()}
    assert one[0].spans == got[0].spans and (one[0].copied_spans, one[0].n_copied, one[0].n_live) == ("", 0, 2)
    assert (got[11].spans, got[11].copied_spans, got[11].n_copied, got[11].n_live, got[11].n_repos) == (f"pem:0:{len(pem)}", "", 0, 1, 1)


def test_settings_of_a_tokenizer_are_read_without_its_words():
    from runsift.llm.packing import parts_letters, settings_of
    from runsift.llm.queries import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    whole = json.loads(tokenizer.to_str())
    got = settings_of(tokenizer)
    assert got["normalizer"] == whole["normalizer"] and got["pre_tokenizer"] == whole["pre_tokenizer"]
    assert got["model"] == {"type": whole["model"]["type"]} and parts_letters(got) == parts_letters(whole)
    tokenizer.normalizer = None
    assert "normalizer" not in settings_of(tokenizer)


def test_values_come_some_at_a_time():
    import pyarrow as pa

    from runsift.llm.common import AT_A_TIME, values

    taken = []

    class Column(list):
        def slice(self, first, n):
            taken.append(n)
            return pa.array(self[first : first + n])

    texts = [None if i % 7 == 0 else f"t{i}" for i in range(2 * AT_A_TIME + 3)]
    assert list(values(Column(texts))) == texts and list(values(pa.array([], pa.string()))) == []
    assert taken == [AT_A_TIME] * 3


def test_stored_tables_reach_workers_in_small_batches(spark):
    """Long texts come some at a time, and the session's setting is as before."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    texts = spark.range(0, 120, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    sizes = saved(map_arrow(texts, lambda b: pa.record_batch([pa.array([b.nbytes], pa.int64())], ["size"]), "size long"))
    assert sizes.agg(F.max("size")).first()[0] < 1.5 * BATCH_BYTES
    assert spark.conf.get(setting) == before
