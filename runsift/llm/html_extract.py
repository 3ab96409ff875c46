"""Main text of web pages, by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text that no block-level tag interrupts,
each with its open ancestors. A block's features are its ancestors' tags, words of
their classes, ids and roles, and properties of its text (length, share of
links, marks, place in the page). The field labels blocks as main text or not; it
is trained once per job on labelled pages (html_pages.py, or a caller's own) and
decoded by Viterbi, page by page in the tasks.

Edge cases: a null or empty page has no blocks and gives empty text; a page cut
off anywhere is read as far as it goes, an unclosed script or comment swallowing the rest; text outside of any
tag is a block; repeated rows are read alike; very long pages are one chain; an
empty table gives no rows; null ids pass through; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runsift.llm.crf import Trainer, viterbi
from runsift.llm.html_pages import labelled_pages

WIDTH = 1 << 14
# Tag names by what they do.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template svg iframe noembed noframes xmp".split())
#: Tags that may be closed in themselves.
FOREIGN = frozenset(("svg", "math"))
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A tag that starts ends an open one of these, up to an enclosing one of those.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^'"<>])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([A-Za-z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

Path = tuple[tuple[str, str], ...]
Block = tuple[str, Path, float, int]


@lru_cache(20_000)
def described(tag: str, attributes: str) -> tuple[str, str]:
    """The tag, and the words of its class, id and role, with what hides it and what marks training pages."""
    words = []
    for name, *value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(value)
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words += [w.lower() for w in NAMED.findall(value)]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            words.append("(hidden)")
        elif name == "data-main":
            words.append("=" + value)
    return tag, " ".join(dict.fromkeys(words))


def after_svg(page: str, at: int) -> int:
    """Where the svg ends whose start tag ends at a place; those within it are counted."""
    depth = 1
    while m := TAG.search(page, at):
        at = m.end()
        if (m[2] or m[5] or "").lower() == "svg":
            if m[1] or m[4]:
                depth -= 1
            elif not SELF_CLOSED.search(m[3] or m[6] or ""):
                depth += 1
            if not depth:
                return at
    return len(page)


def blocks(page: str | None) -> list[Block]:
    """(text, ancestors, share of text in links, label by data-main) of the page's leaf blocks, in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    path: list[Path] = []
    linked = [0]

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                marks = [w for _, words in path[0] for w in words.split() if w[0] == "="]
                out.append((text, path[0], min(1.0, linked[0] / len(text)), int(bool(marks) and marks[-1] == "=1")))
            parts.clear()
            path.clear()
            linked[0] = 0

    def add(text: str) -> None:
        if text:
            if not text.isspace() and not path:
                path.append(tuple(x for x in stack if x[0] not in INLINE))
            if path or parts:
                parts.append(text)
                if any(t == "a" for t, _ in stack):
                    linked[0] += len(text)

    def close(names: set[str] | frozenset[str], until: set[str] | frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    page, at = page or "", 0
    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            add(" ")
        if m[1] or m[4]:
            close({tag})
        elif tag in FOREIGN and SELF_CLOSED.search(m[3] or m[6] or ""):
            continue
        elif tag == "svg":
            at = after_svg(page, at)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        else:
            if tag in CLOSES_P:
                close({"p"}, {"table", "td", "div", "article", "section", "main", "aside", "body"})
            if tag in ENDS:
                close(*ENDS[tag])
            if tag not in VOID:
                stack.append(described(tag, m[3] or m[6] or ""))
    add(page[at:])
    flush()
    return out


@lru_cache(20_000)
def path_features(path: Path) -> tuple[str, ...]:
    found = ["parent:" + (path[-1][0] if path else "")]
    for tag, words in path:
        if tag not in ("html", "body"):
            found.append("in:" + tag)
        for w in words.split():
            if w[0] != "=":
                found += ["word:" + w, f"word:{tag}:{w}"]
    return tuple(dict.fromkeys(found))


def features(page: list[Block]) -> list[list[int]]:
    """Feature indices of each block of a page."""
    out = []
    for i, (text, path, links, _) in enumerate(page):
        n = text.count(" ") + 1
        found = [
            *path_features(path),
            f"words:{min(n.bit_length(), 8)}",
            f"links:{int(links * 3.99)}",
            f"ends:{text[-1] if text[-1] in '.!?:,;|' else 'a'}",
            f"place:{i * 4 // len(page)}",
            f"commas:{min(text.count(','), 3)}",
        ]
        if any(mark in text for mark in "©®·»›"):
            found.append("sign")
        if i and path == page[i - 1][1]:
            found.append("as before")
        out.append([xxhash.xxh3_64_intdigest(x) % WIDTH for x in found])
    return out


def train(pages: list[str], epochs: int = 6, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores from pages whose main text is marked by data-main."""
    chains = [(features(page), [b[3] for b in page]) for page in map(blocks, pages) if page]
    field, rng = Trainer(WIDTH, 2), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for k in range(0, len(order), 16):
            field.step([chains[i] for i in order[k : k + 16]])
    return field.weights, field.moves


def main_text(page: str | None, weights: np.ndarray, moves: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    scores = np.array([weights[f].sum(0) for f in features(found)])
    return "\n".join(b[0] for b, keep in zip(found, viterbi(scores, moves)) if keep)


def extract(pages: DataFrame, labelled: list[str] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of pages."""
    model = train(labelled_pages() if labelled is None else labelled)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, *model) for page in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(read, "page_id long, url string, text string, n_chars long")
