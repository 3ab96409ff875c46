"""Labelled pages to train the extraction on.

Written for this purpose: page skeletons of many kinds, filled with words drawn
from a seeded generator. `data-main` marks what is main text (1) or not (0); it
holds for all below until marked otherwise, and is never a feature. In a
skeleton $h stands for a heading, $s for a sentence, $p for a paragraph, $w for
two or three words, $n for a number.
"""

from __future__ import annotations

import random
import re

NAV = '<nav><ul><li><a href="/a">$w</a></li><li><a href="/b">$w</a></li><li><a href="/c">$w</a></li></ul></nav>'
LINKS = "<ul><li><a href='/1'>$h</a></li><li><a href='/2'>$h</a></li><li><a href='/3'>$h</a></li></ul>"
BODY = "<h1>$h</h1><p>$p</p><p>$p</p><h2>$h</h2><p>$s</p><p>$p</p>"
FIGURES = "<h1>$h</h1><p>$p</p><ul><li>$s</li><li>$s</li></ul><blockquote><p>$s</p></blockquote><table><tr><th>$w</th><td>$n</td></tr><tr><td>$w</td><td>$n</td></tr></table><pre>$s</pre><ol><li>$w</li><li>$s</li></ol><p>$p</p>"
LOOSE = "<h1>$h</h1><p><b>$h<br><p>$p<p>$s<p>$p<h3>$h</h3>$p<br>$s<p>$w.</p>"
NOTE = '<div class="cookie-notice"><p>$s</p><button>$w</button></div>'
FORM = '<form action="/go"><label>$w</label><input name="q"><select><option>$w</option><option>$w</option></select><button>$w</button><p>$s</p></form>'
REMARKS = '<section class="comments" id="comments"><h2>$w</h2><div class="comment"><p class="author">$w</p><p>$p</p></div><div class="comment reply"><p>$s</p></div></section>'
FOOT = "<footer><p>&copy; $n $w &middot; $s</p><ul><li><a href='/x'>$w</a></li></ul></footer>"

SKELETONS = (
    f'{NAV}<div class="ad">$s</div><article data-main="1">{BODY}</article>{FOOT}',
    f'{NAV}<!-- ad --><div class="ad">$p</div><article data-main="1">{LOOSE}</article><footer>&copy; $w &middot; $s</footer>',
    f'<header><h1>$w</h1><p>$s</p>{NAV}</header><main data-main="1">{BODY}</main><aside><h3>$w</h3>{LINKS}<p>$p</p></aside>{FOOT}',
    f'<div id="header"><a href="/">$w</a><p>$s</p></div><div id="nav">{LINKS}</div><div id="content" data-main="1">{BODY}</div><div id="sidebar"><h3>$w</h3><p>$p</p>{LINKS}</div><div id="footer"><p>$s</p></div>',
    f'<div class="menu">{LINKS}</div><div class="post" data-main="1"><h1>$h</h1><p>$p</p><p>$p</p><p>$s</p></div>{REMARKS}<div class="footer">$s</div>',
    f'{NOTE}<header>{NAV}</header><article data-main="1">{FIGURES}<aside data-main="0"><p>$s</p></aside><p>$p</p></article>{REMARKS}{FOOT}',
    f'<div role="navigation">{LINKS}</div><div role="main" data-main="1">{FIGURES}</div><div role="complementary"><p>$p</p>{LINKS}</div><div role="contentinfo"><p>$s</p></div>',
    f'<div class="topbar"><span>$w</span></div>{FORM}<section class="entry-content" data-main="1">{LOOSE}</section><div class="related"><h2>$w</h2>{LINKS}</div>{FORM}{FOOT}',
    f'<table><tr><td class="left">{LINKS}</td><td class="main text" data-main="1">{BODY}</td><td class="right banner"><p>$p</p></td></tr></table><p class="copyright">$s</p>',
    f'{NAV}<div class="breadcrumb"><a href="/">$w</a> / <a href="/b">$w</a></div><article class="story" data-main="1"><header><h1>$h</h1><p>$s</p></header>{BODY}<div class="share" data-main="0"><a href="/t">$w</a><a href="/f">$w</a></div><footer data-main="0"><p>$s</p></footer></article><div class="sponsored advert"><h3>$h</h3><p>$p</p></div>{FOOT}',
    f'<div class="banner promo"><p>$p</p></div><div class="wrapper"><div class="article-body" data-main="1"><p>$p</p><div>$p</div><p>$s</p></div><div class="widget"><h4>$w</h4><p>$s</p>{LINKS}</div></div><div class="newsletter signup"><p>$s</p>{FORM}</div>{FOOT}',
    f'{NAV}<main><article data-main="1">{FIGURES}</article><section class="comment-list"><h2>$w</h2><article class="comment"><header><p>$w</p></header><p>$p</p></article><article class="comment"><p>$s</p><p>$p</p></article></section></main>{FOOT}',
    f'<div class="alert warning" role="alert"><p>$s</p></div><div id="main"><div class="toc"><h3>$w</h3>{LINKS}</div><div class="text" data-main="1">{BODY}{BODY}</div><div class="pagination"><a href="/2">$n</a><a href="/3">$w</a></div></div><div id="disqus_thread"><p>$p</p><p>$s</p></div>{FOOT}',
    f'<header role="banner"><p>$s</p></header><div class="page" data-main="1"><h1>$h</h1><div>$p</div><div>$p</div><dl><dt>$w</dt><dd>$s</dd></dl></div><aside class="sidebar"><div class="ads"><p>$p</p></div></aside><div class="notice"><p>$s</p></div><footer class="site-footer"><p>$p</p></footer>',
    f'<div class="site-header"><h2>$w</h2></div>{NAV}<div class="blog-post" data-main="1"><h2>$h</h2><p>$p</p><figure><img src="x"><figcaption>$s</figcaption></figure><p>$p</p></div><div class="user-comments responses"><ul><li><p>$p</p></li><li><p>$s</p></li></ul></div><div class="consent gdpr popup modal"><p>$p</p></div>{FOOT}',
    f'<article data-main="1"><p>$s</p></article>{FOOT}',
    f'{NAV}<article data-main="1"><h1>$h</h1></article><footer><p>$p</p></footer>',
    '<p data-main="1">$p</p><p data-main="1">$p</p>',
    f'<div class="nav">{LINKS}</div><p data-main="1">$p</p><h2 data-main="1">$h</h2><p data-main="1">$p</p><p data-main="1">$s</p><div class="foot">$s</div>',
)
SYLLABLES = "an be cor di en fa gu hal in jor ka lem mi no or pa qui ren sa tor un ver wi xe zu ér ou tsch ñó ção".split()


def labelled_pages(each: int = 24, seed: int = 5) -> list[str]:
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice(SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3))))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize()

    def sentences(low: int, high: int) -> str:
        marks = rng.choice((("", "", ","), ("", "", ","), ("!!",), ("###", "%%%", "&amp;&amp;&amp;"), (" |",)))
        return " ".join(" ".join(w + rng.choice(marks) for w in words(2, 18).split()) + rng.choice("...!?") for _ in range(rng.randint(low, high)))

    fill = {"h": lambda: words(2, 12), "s": lambda: sentences(1, 1), "p": lambda: sentences(1, 9), "w": lambda: words(1, 3), "n": lambda: str(rng.randint(1, 2030))}
    head = "<!DOCTYPE html><html><head><title>$h</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"
    return [re.sub(r"\$([hspwn])", lambda m: fill[m[1]](), head + s + "</body></html>") for _ in range(each) for s in SKELETONS]
