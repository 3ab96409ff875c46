"""Trained operators: held-out accuracy, worked cases, and the field against brute force."""

import itertools
import random

import numpy as np
import pytest

from runsift.llm import html_pages
from runsift.llm.common import fold
from runsift.llm.crf import Trainer, forward_backward, viterbi
from runsift.llm.html_extract import blocks, extract, main_text, train
from runsift.llm.language import language_id
from runsift.llm.quality import of_quality, quality_scores
from runsift.llm.toxicity import WINDOW, LabelModel, places, toxicity_scores, votes, window_scores


def test_forward_backward_and_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    lengths, labels = np.array([5, 5, 3, 1]), 3
    scores, moves = rng.normal(size=(lengths.sum(), labels)), rng.normal(size=(labels, labels))
    got = forward_backward(np.exp(scores), lengths, np.exp(moves))
    at = 0
    for n in lengths:
        part = scores[at : at + n]
        paths = list(itertools.product(range(labels), repeat=n))
        total = np.array([sum(part[i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert viterbi(part, moves) == list(paths[int(total.argmax())])
        p = np.exp(total - total.max())
        p /= p.sum()
        plain = np.array([[sum(w for w, path in zip(p, paths) if path[i] == y) for y in range(labels)] for i in range(n)])
        assert np.allclose(got[at : at + n], plain)
        at += n


def test_a_field_learns_transitions():
    field = Trainer(4, 2)
    for _ in range(60):
        field.step([([[0], [3], [3], [3]], [0, 0, 0, 0]), ([[1], [3], [3], [3]], [1, 1, 1, 1])])
    scores = field.weights[[1, 3, 3, 3]]
    assert viterbi(scores, field.moves) == [1, 1, 1, 1]


@pytest.fixture(scope="module")
def corpus(spark, frame, odd):
    """English-like and other prose; junk of shouted words; some abuse; labels for most."""
    rng = random.Random(8)
    en, de = "the of and there where she which with this that from were have".split(), "der die und nicht auch sich wieder über schön haben werden einen".split()
    docs, labels = [], []
    for i in range(100, 700):
        lang = "de" if i % 3 == 0 else "en"
        words = [rng.choice(de if lang == "de" else en) for _ in range(rng.choice((6, 60, 300)))]
        quality, toxic = int(i % 7 > 0), int(i % 5 == 1)
        for _ in range(rng.choice((1, 2, 5)) * toxic):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["idiot", "Moron,", "worthless."] if lang == "en" else ["blödling", "blödheit", "blöderer."]))
        if not quality:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), lang, "s"))
        labels.append((i, quality, toxic))
    labels += [(100, None, None), (None, 1, 1), (5, None, 0), (99999, 1, 1)] + labels[:3]
    return frame(docs).unionByName(odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels[:600]}


@pytest.mark.parametrize(("scores", "which", "threshold"), [(quality_scores, 0, 0.3), (toxicity_scores, 1, 0.5)])
def test_held_out_accuracy(spark, corpus, frame, scores, which, threshold):
    docs, labels, truth = corpus
    rows = scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id][which] for r in held) >= 0.97 * len(held)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[4]) == 1 and len(by_id[6]) <= 2
    assert scores(frame([]), labels).count() == 0
    assert scores(docs.limit(5), labels.limit(0)).count() == 5


def test_labels_of_the_held_out_fold_are_not_read(spark, corpus):
    docs, labels, _ = corpus
    other = labels.withColumn("quality", (1 - labels.quality))
    mixed = labels.where(fold(labels.doc_id, 5) != 0).unionByName(other.where(fold(labels.doc_id, 5) == 0))
    one = lambda l: sorted((str(r.doc_id), r.score) for r in quality_scores(docs, l).collect())
    assert one(labels) == one(mixed)


def test_filter_by_quality_keeps_whole_rows(corpus):
    docs, labels, truth = corpus
    kept = of_quality(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    good = {d for d, (q, _) in truth.items() if q}
    assert len(ids & good) >= 0.98 * len(good) and len((ids & set(truth)) - good) <= 4


def test_label_model_finds_voters_and_weighs_copies_down():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.1
    vote = lambda hit, miss: np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < miss)
    a, b, c = vote(0.8, 0.01), vote(0.6, 0.02), vote(0.5, 0.02)
    patterns, counts = np.unique(np.stack([a, b, c, c], 1).astype(float), axis=0, return_counts=True)
    model = LabelModel(patterns, counts.astype(float), np.where(patterns.sum(1) > 0, 0.8, 0.05))
    assert model.hit[1][0] > model.hit[1][1] > 0.3 and model.hit[0].max() < 0.05
    assert model.correlation[2, 3] > 0.9 and model.weight[2] < 0.6 < model.weight[0]


def test_windows_start_at_every_word(spark):
    rng = random.Random(5)
    for n in (1, 2, 24, 25, 26, 49, 50, 51, 200):
        words = [rng.choice(("a", "b", "c", *"x" * 12)) for _ in range(n)]
        plain = []
        for at in range(1 - WINDOW, n):
            hits = [{"a": 1, "b": 2, "c": 128}[w] for w in words[max(0, at) : at + WINDOW] if w != "x"]
            plain.append(sum(set(hits)) | (len(hits) >= 2) << 8 | (len(hits) >= 4) << 9)
        assert votes(words, {"a": 1, "b": 2, "c": 128, "x": 0}).tolist() == plain
    weights = np.zeros(1 << 18, np.float32)
    weights[list(places("abuse"))] = 0.5
    texts = [["so"] * 60 for _ in range(3)]
    for words, at in zip(texts, ((23, 24, 25, 26), (1, 25), (0, 25))):
        for k in at:
            words[k] = "abuse"
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(3, "abuse"), (4, "")], "doc_id long, text string")
    found = {r.doc_id: np.log(r.score / (1 - r.score)) for r in window_scores(docs, weights, -2.0).collect()}
    assert np.allclose([found[i] for i in range(5)], [4.0, 1.0, -0.5, -0.5, -2.0])


def test_language(frame, corpus):
    docs, _, _ = corpus
    rows = language_id(docs).collect()
    assert len(rows) == docs.count()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id and r.doc_id >= 100]
    assert len(held) > 60 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert language_id(frame([])).count() == 0
    alone = language_id(frame([(1, "12 34", "en", "s"), (2, "abc", None, "s")])).collect()
    assert {r.lang_pred for r in alone} <= {"und", "en"} and next(r for r in alone if r.doc_id == 1).lang_pred == "und"


def test_switched_text_gets_both_languages(frame, corpus):
    docs, _, _ = corpus
    half = "the of and there where she which with this that " * 3 + "der die und nicht auch sich wieder über schön haben " * 3
    row = next(r for r in language_id(docs.unionByName(frame([(9000, half, None, "s")]))).collect() if r.doc_id == 9000)
    assert 0.4 < row.score < 0.7 and row.switches == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href=/x>Home</a><li><a href=/y>News &amp; more</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy this.</div>
<article><h1>A &quot;title&quot; of\tsome words</h1><p>First <b>bold</b> text,\n caf&eacute; &#233;&#x e; &am<br>and more of it.<p>Second, unclosed.<div>Third one here.</div></article>
<div class="comments"><p>What a fine article this is, I think.</p></div><footer>&copy; 2020 us</footer>"""


@pytest.fixture(scope="module")
def reader():
    return train(html_pages.labelled_pages(12))


def test_extraction(spark, reader):
    expected = 'A "title" of some words\nFirst bold text, café éx e; &am and more of it.\nSecond, unclosed.\nThird one here.'
    got = main_text(PAGE.replace("&#x e;", "x e;"), *reader)
    assert got == expected
    pages = [(1, "u", PAGE.replace("&#x e;", "x e;"), "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>", "x"), (4, "u", "<article><p>" + "many words of text. " * 20_000 + "</p></article>", "x")]
    frame_ = spark.createDataFrame(pages + pages[:2], "page_id long, url string, html string, text string")
    rows = extract(frame_).collect()
    assert len(rows) == 7 and all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in rows if r.page_id == 1] == [expected] * 2
    assert {r.text for r in rows if r.page_id in (2, 3, None)} == {""}
    assert next(r for r in rows if r.page_id == 4).n_chars == 20 * 20_000 - 1
    assert extract(frame_.limit(0)).count() == 0


def test_extraction_of_unseen_pages(reader):
    right = total = 0
    for page in html_pages.labelled_pages(3, seed=77):
        found = blocks(page)
        text = "\n".join(b[0] for b in found if b[3])
        right, total = right + (main_text(page, *reader) == text), total + 1
    assert right >= 0.95 * total


@pytest.mark.parametrize("page", ["<", "<a", "<p class='x", "</", "<script>", "<!--", "a < b & c > d", "<p>a<p>b</p></p></div>", "&", "<a href=\"x>y</a>", "<" * 500])
def test_broken_pages_are_read(page, reader):
    assert isinstance(main_text(page, *reader), str)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>one <svg class='icon'/> two</p><p>three</p>", ["one", "two", "three"]),
        ("<p>one<math/></p><p>two</p>", ["one", "two"]),
        ("<p>a</p><svg><text>no</text><svg><g/></svg><text>no</text></svg><p>b</p>", ["a", "b"]),
        ("<p>a <math><mi>x</mi></math> b</p><object data=x><p>other text</p></object>", ["a", "x", "b", "other text"]),
    ],
)
def test_foreign_tags_lose_no_text(page, texts):
    assert [b[0] for b in blocks(page)] == texts
