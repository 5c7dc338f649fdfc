"""HTML main text: the scanner case by case, and what pages share against plain window counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from basketry.llm.main_text import blocks_of, host_name, main_text

SCHEMA = "page_id long, url string, html string, text string, host string, slot string"


def kept(page):
    return [t for t, m in blocks_of(page) if m == b"k"]


@pytest.mark.parametrize("page, want", [
    ("<article><h1>T &amp; u</h1><p><b>One\n two.<br><p>Three&nbsp;four</article>", ["T & u", "One two.", "Three four"]),
    ("<nav>menu</nav><main>a<div class='ad x'>buy</div>b</main><footer>f</footer>", ["a", "b"]),
    ("<article>a<!-- <p>x</p> -->b<script>var t='</p><p>';</script>c<style>p{}</style></article>", ["abc"]),
    ("<article><ul><li>one<li>two <i>three</i></ul><table><tr><td>x<td>y<tr><td>z</table></article>",
     ["one", "two three", "x", "y", "z"]),
    ("<article>cut <p>off &am", ["cut", "off &am"]),
    ("<article>1 < 2 and <b>3</b> > 2 &copy &#x41;&#66;</article>", ["1 < 2 and 3 > 2 © AB"]),
    ("<div role='main'>m<form>f<input></form></div><div>other</div>", ["m"]),
    ("<article>x<section id='comments'><article>reply</article></section>y</article>", ["x", "y"]),
    ("<article class='has-sidebar'>x<p class=\"promo box\">no<p>y</article>", ["x", "y"]),
    ("<ARTICLE><P TITLE='a>b'>q</P></ARTICLE><p>after", ["q"]),
    ("<article><p title=\"open>t</article>", ["t"]),
    ("<aside><p>s</aside><article></div></p><div>t</div></article>", ["t"]),
    ("", []),
])
def test_blocks(page, want):
    assert kept(page) == want


def test_host():
    assert [host_name(u) for u in ("http://A.com/x", "x://Ü.Z?q", "none", None, "a://b://c")] == \
        ["a.com", "Ü.z", "", "", "b:"]


def brute(rows, k):
    """Every window of k words outside main containers, counted by host and page."""
    where = defaultdict(set)
    parsed = [(i, u, blocks_of(h or "")) for i, u, h in rows]
    for i, u, blocks in parsed:
        words = [w for t, m in blocks if m != b"k" for w in t.split()]
        for p in range(len(words) - k + 1):
            where[host_name(u), tuple(words[p:p + k])].add((i, u))
    out = []
    for i, u, blocks in parsed:
        words = [(w, n) for n, (t, m) in enumerate(blocks) if m != b"k" for w in t.split()]
        gone = set()
        for p in range(len(words) - k + 1):
            if len(where[host_name(u), tuple(w for w, _ in words[p:p + k])]) > 1:
                gone |= set(range(p, p + k))
        left = defaultdict(list)
        for p, (w, n) in enumerate(words):
            if p not in gone:
                left[n].append(w)
        lines = [t if m == b"k" else " ".join(left[n]) if m == b"u" else "" for n, (t, m) in enumerate(blocks)]
        text = "\n".join(x for x in lines if x)
        out.append((i, u, text, len(text)))
    return Counter(out)


def pages(seed=4):
    rng = random.Random(seed)
    def words(n):
        return " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    shared = [words(9) for _ in range(4)]
    rows = []
    for i in range(160):
        host = rng.choice(["a.com", "a.com", "b.net"])
        body = [f"<p>{words(rng.randrange(1, 25))}</p>" for _ in range(3)]
        body.insert(rng.randrange(4), f"<div>{rng.choice(shared)} {words(2)}</div>")
        page = "".join(body)
        if i % 4 == 0:
            page = f"<div>top {shared[0]}</div><article>{page}</article>"
        if i % 4 == 1:
            page = f"<nav>{shared[1]}</nav>{page}<footer>{shared[2]}</footer>"
        rows.append((i, f"http://{host}/{i}", page))
    rows += [(None, None, "<p>" + shared[0]), (None, "http://a.com/n", None), (7, None, ""), rows[3], rows[3],
             (900, "http://c.org/", "<p>" + words(30000))]
    return rows


def test_main_text_matches_window_counting(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "t", "h", "s") for r in rows], SCHEMA).repartition(4)
    got = Counter(map(tuple, main_text(df).collect()))
    assert got == brute(rows, 6)
    assert any(re.search("w", r[2]) is None for r in got)


def test_no_pages(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []
