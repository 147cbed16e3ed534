"""Lexical search, hard negatives and main texts against brute force."""

import html
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewatch.llm import catalogue, hard_negatives, lexical_search, main_text
from tests.llm.conftest import FOLDER, LONG

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked_plainly(docs, items, top=20):
    """Rows (item, rank, doc, score) from lists of (id, text), from the definitions alone."""
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    counted = [(key, Counter(terms(text))) for key, text in docs]
    counted = [(key, c, sum(c.values())) for key, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    rows = []
    for item, text in dict.fromkeys(items):
        scores = []
        own = Counter(terms(text))
        df = {t: sum(t in c for _, c, _ in counted) for t in own}
        for key, c, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in own.items() if c[t])
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        rows += [(item, k, key, -s) for k, (s, _, _, key) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return rows


def rows_of(frame):
    return Counter(map(tuple, frame.collect()))


def test_terms_are_the_runs_between_delimiters():
    draw = random.Random(5)
    pieces = ["a", "B", "9", "é", "İ", "ß", "漢", "😀", "\x85", " ", " ", "\x7f", "_", "-", "\x00", "\n", "\x1c", "~", "[", "`", "ſ", "K"]
    for _ in range(3000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 12)))
        found = [t.encode("latin-1").decode() for t in lexical_search.terms_of(text) if t]
        assert found == TERM.findall(text.translate(LOWER)), text


@pytest.mark.parametrize("block_bytes, tile", [(4 << 20, 1 << 20), (60, 7)])
def test_search_on_odd_rows(spark, odd, odd_rows, empty, monkeypatch, block_bytes, tile):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lexical_search, "TILE", tile)
    items = [(1, "three TWO two, once upon!"), (1, "three TWO two, once upon!"), (2, "naïve 漢字 😀"), (3, None), (4, ""), (None, "key mail"), (5, "absentee"), (6, "one two one"), (6, "café")]
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash")).withColumn("doc_id", F.lit("clash"))
    expected = ranked_plainly([(r[0], r[1]) for r in odd_rows], items, top=3)
    assert rows_of(lexical_search.search(odd, wanted, top=3)) == Counter(expected)
    assert lexical_search.search(empty, wanted).count() == 0
    found = lexical_search.search(odd, wanted.where("false"))
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_op11(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    expected = ranked_plainly([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert rows_of(catalogue.QUERIES["op11_lexical_search"](spark, FOLDER)) == Counter(expected)


def mined_plainly(rows):
    """Rows from a list of (id, label, vector), from the definitions alone."""
    sound = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and sound(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    found = []
    anchors = {(i, lab, tuple(v)) for i, lab, v in kept if i % 100 == 0}
    for anchor, lab, vector in anchors:
        scored = sorted(((-dot(vector, v), i, other) for i, other, v in kept if i != anchor))
        for minus, positive, _ in [s for s in scored if s[2] == lab][:5]:
            fits = [(-s, i) for s, i, other in scored if other != lab and -30 * minus <= -100 * s <= -90 * minus][:10]
            found += [(anchor, positive, k, i, -minus, s) for k, (s, i) in enumerate(fits, 1)]
    return found


def vectors_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(parts)


ODD_VECTORS = [
    (None, 1, [1.0, 2.0]), (1, None, [1.0, 2.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [math.nan, 1.0]), (5, 2, [math.inf, 1.0]),
    (100, 1, [1.0, 0.5]), (100, 1, [1.0, 0.5]), (6, 1, [1.0, 0.5]), (7, 2, [0.5, 0.5]), (8, 2, [0.5, 0.5]), (8, 2, [0.5, 0.5]), (9, 2, [0.25, 0.125, 7.0]), (10, 3, [0.5]),
    (11, 2, []), (200, 9, [1.0]), (300, 3, []), (12, 3, [0.0]), (13, 1, [-1.0, -1.0]), (0, 5, [-3.0] * 40), (14, 5, [-2.0] * 33), (15, 1, [-1.0] * 70), (16, 5, [2.0])]


@pytest.mark.parametrize("bundle, block", [(8 << 20, 512), (200, 2)])
def test_hard_negatives_on_odd_rows(spark, monkeypatch, bundle, block):
    monkeypatch.setattr(hard_negatives, "BUNDLE_BYTES", bundle)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    table = vectors_of(spark, ODD_VECTORS)
    for name in ("id", "slot", "score", "rank", "means", "vector"):
        table = table.withColumn(name, F.lit("clash"))
    expected = Counter(mined_plainly(ODD_VECTORS))
    assert expected and rows_of(hard_negatives.mine(table, F.col("id") % 100 == 0)) == expected
    assert hard_negatives.mine(table.where("false"), F.col("id") % 100 == 0).count() == 0


def test_large_components_stay_exact(spark):
    draw = random.Random(8)
    rows = [(k, k % 2, [float(draw.randint(-(1 << 14), 1 << 14)) * 16 + k % 3 for _ in range(20)]) for k in range(60)]
    assert rows_of(hard_negatives.mine(vectors_of(spark, rows), F.col("id") % 100 == 0)) == Counter(mined_plainly(rows))


def test_bounds_leave_out_pairs_and_lose_none(spark):
    """Vectors around few centres: most pairs go by their segments' summaries alone."""
    draw = random.Random(9)
    centres = [[draw.gauss(0, 1) for _ in range(64)] for _ in range(8)]
    rows = [(k, k % 3, [c + draw.gauss(0, 0.05) for c in centres[k % 8]]) for k in range(800)]
    seen = []
    kept = hard_negatives.refined

    def counting(left, right, wanted, low, high):
        found = kept(left, right, wanted, low, high)
        seen.append((int(wanted.sum()), len(found[0])))
        return found

    table = hard_negatives.summarised(hard_negatives.usable(vectors_of(spark, rows), "vec_id", F.col("label"), "embedding", 256)).toArrow()
    side = hard_negatives.Side(table, 64)
    import numpy as np

    low = np.full(800, 0.8 * 64 * 65536)
    r, c, scores = counting(side, side, np.ones((800, 800), bool), low, np.full(800, np.inf))
    exact = side.values @ side.values.T
    found = set(zip(r.tolist(), c.tolist()))
    assert {(a, b) for a, b in zip(*np.nonzero(exact >= low[0]))} <= found and (exact[r, c] == scores).all()
    assert seen[0][1] < 0.3 * seen[0][0]


def test_op13(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    moved = [(i, (lab + 1) % 10 if i is not None and lab is not None and i % 7 == 0 else lab, v) for i, lab, v in rows]
    assert rows_of(catalogue.QUERIES["op13_hard_negatives"](spark, FOLDER)) == Counter(mined_plainly(moved))


OTHER = [
    "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>About us and more</a></ul></nav>",
    "<header class=top><h1>The site of sites</h1><p>Slogan</p></header>",
    "<footer>&copy; someone</footer>",
    "<aside><h2>More</h2><p>Side text that goes on for a while and for a while more.</p></aside>",
    "<div class='sidebar left'><p>Another side text, long enough to look like prose, really.</p></div>",
    "<div id=cookie-notice><p>We use cookies to make the site better for all of us.</p></div>",
    "<div class=\"ad\">Buy now and save a lot of money with our offer</div>",
    "<form action=/s><label>Search</label><input name=q><button>Go</button></form>",
    "<script>var t = '</p><p>not text</p>';</script>",
    "<style>p{margin:0}</style><!-- a <p>comment</p> -->",
    "<section class=comments><div class=comment><p>First! A reader's comment that is longer than the text itself, with many words, and even more of them.</p></div></section>",
    "<div hidden><p>not to be seen</p></div>",
]


def page_of(draw, marked):
    """A page and its main text."""
    words = lambda: " ".join(draw.choices(["The", "fox's", "A&B", "é", "1 < 2", "word", "of", "prose,", "went", "on."], k=draw.randint(8, 30)))
    blocks, inner = [], ""
    for k in range(draw.randint(1, 6)):
        text = words()
        blocks.append(" ".join(text.split()))
        shown = html.escape(text, quote=False).replace("word", "<b>wo</b>rd").replace("of", "<i>of</i>").replace(" on.", "<br>on." if draw.random() < 0.5 else "\n\t on.")
        tag = "h1" if k == 0 and marked else "p"
        inner += f"<{tag}>{shown}" + (f"</{tag}>" if tag == "h1" or draw.random() < 0.5 else "")
        if draw.random() < 0.3:
            inner += draw.choice(OTHER[6:])
    around = [draw.choice(OTHER) for _ in range(draw.randint(0, 8))]
    cut = draw.randint(0, len(around))
    holder = ("<article>", "</article>") if marked else ("<div class=content>", "</div>")
    page = "<!DOCTYPE html><html><head><title>T &amp; x</title></head><body>" + "".join(around[:cut]) + holder[0] + inner + holder[1] + "".join(around[cut:]) + "</body></html>"
    return page, "\n".join(blocks)


@pytest.mark.parametrize("marked", [True, False])
def test_main_text_of_made_pages(marked):
    draw = random.Random(11)
    for _ in range(400):
        page, expected = page_of(draw, marked)
        assert main_text.main_text(page) == expected, page


def test_main_text_cases():
    text = main_text.main_text
    assert text("") == "" and text("<p>") == "" and text("<nav>menu</nav>") == ""
    assert text("plain &lt;only&gt; 3 < 5 <b>bold</b>!") == "plain <only> 3 < 5 bold!"
    assert text("<article><p>a&amp;amp;b&nbsp;c &#x41;<p>cut off<di") == "a&amp;b c A\ncut off"
    assert text("<body class=has-sidebar><div class='wrap sidebar-left'><article class='post category-social'><header class=entry-header><h1>Head</h1><span>by me</span></header><p>x</p></article></div>") == "Head\nx"
    assert text("<main><h1>T</h1><article><p>A.</p></article><div id=comments><article class=comment-body><p>" + "long " * 50 + "</article></div></main>") == "T\nA."
    assert text("<form><input><h1>T</h1><p>para</p><select><option>x</select></form>") == "T\npara"
    assert text("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></article>") == "a b\nc\nd\ne"
    assert text("<div>" * 50000 + "deep" + "<p>down" * 20000).split("\n")[:2] == ["deep", "down"]
    assert text("<p>" + LONG) == LONG.strip()


def test_main_text_frame(spark):
    rows = [(1, "u", "<article>a b</article>"), (1, "u", "<article>a b</article>"), (None, None, None), (2, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r["page_id"] or 0, r["text"]) for r in main_text.extract_main_text(pages).collect()) == [(0, ""), (1, "a b"), (1, "a b"), (2, "")]
    assert main_text.extract_main_text(pages.where("false")).count() == 0


def test_op12(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in catalogue.QUERIES["op12_main_text"](spark, FOLDER).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        bare = re.sub(r"</?b>|</?[a-z0-9]*$", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>|</?p$", "\0", inner)))
        expected = "\n".join(filter(None, (" ".join(html.unescape(part).split()) for part in bare.split("\0"))))
        assert (r["text"], r["n_chars"]) == (expected, len(expected))
