"""The pipeline on a small corpus, each stage held against what it should do."""

import random
import sys
from pathlib import Path

import pytest

from tests.llm.conftest import prose

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    bench = [(i, prose(rng, 25, 4000)) for i in range(4)]
    docs, labels = [], []
    for i in range(160):
        text = prose(rng, rng.choice((40, 80, 200)), 4000)
        junk = i % 8 == 0
        if junk:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 10 == 3:
            text += "\nall rights are reserved by the site"
        if i in (21, 41):
            text += " " + bench[i % 4][1]
        docs.append((i, text, "en", f"s{(i + i // 10) % 5}", len(text)))
        labels.append((i, int(not junk), 0))
    near = [i for i in range(1, 160) if i % 8 and i % 10 != 3 and i not in (21, 41) and len(docs[i][1].split()) >= 80][:3]
    docs += [(1000 + i, "other " + docs[i][1].split(" ", 1)[1], "en", "s0", docs[i][4]) for i in near]
    docs += [(2000, docs[near[0]][1], "en", "s1", docs[near[0]][4]), (3000, None, "en", "s1", None), (3001, "", "en", None, 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def test_stages_in_turn(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "best_fit_packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r[0] for r in docs.select("doc_id").collect()})
    quality, lines, near, clean, packed = seen
    junk = {i for i in range(160) if i % 8 == 0}
    assert not quality & junk and {i for i in range(160)} - junk <= quality
    assert lines == quality
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/line_dedup").collect()}
    assert "rights" in texts[3].text and all("rights" not in texts[i].text and texts[i].n_chars == len(texts[i].text) for i in range(13, 160, 10) if i in texts)
    assert lines - near == {i for i in lines if 1000 <= i <= 2000}
    assert near - clean == {21, 41}
    assert packed == clean


def test_run_gives_the_same_as_the_stages(spark, folder):
    path, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert len({r.doc_id for r in rows}) > 130 and max(r.offset + r.length for r in rows) <= 2048


def test_empty_corpus(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
