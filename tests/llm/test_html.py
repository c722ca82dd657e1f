from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

from attest.llm import html
from tests.llm.common import prose


def text(source):
    return html.Page(source).text()


def test_blocks_and_references():
    assert text("<p>a &amp; b&nbsp;c<br>d</p><div>e  \n f</div>") == "a & b c d\ne f"
    assert text("<h1>T</h1><ul><li>one<li>two</ul>") == "T\none\ntwo"
    assert text("<p>a<p>b") == "a\nb" and text("x &#233; &lt;b&gt; &unknown;") == "x é <b> &unknown;"
    assert text("<p>in<b>li</b>ne <i>text</i></p>") == "inline text"
    assert text("a < b and c > d") == "a < b and c > d"


def test_what_is_no_article_goes():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav>
      <div class="cookie-notice">We use cookies</div><div id="sidebar">side</div><article><h1>Title</h1><p>First.</p><script>var x = "<p>no</p>";</script>
      <p>Second<!-- no -->.</p><form>mail <input></form><div class="ad-banner">buy</div></article>
      <section class="comments"><p>reader says</p></section><aside>more</aside><footer>foot</footer></body></html>"""
    assert text(page) == "Title\nFirst.\nSecond."


def test_names_that_only_look_alike_stay():
    assert text('<div class="address">a</div><div class="heading">b</div><p class="download">c</p>') == "a\nb\nc"


def test_odd_sources():
    for source in (None, "", "   ", "<", "<>", "<!--", "<p", "</p>", "<script>", "<div" * 50):
        assert isinstance(text(source), str)
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_templates_of_a_host_go_and_others_stay(spark):
    rows = []
    for i in range(60):
        boxes = "<div class=x1><p>Read our other great stories</p></div>"
        rows.append((i, f"https://a.example/{i}", f"<body>{boxes}<div><p>Own text number {i}.</p></div></body>"))
    for i in range(5):
        rows.append((100 + i, f"https://b.example/{i}", f"<body><div><p>Read our other great stories</p></div><p>Text {i}</p></body>"))
    # Copies of one article don't make it a template.
    rows += [(200 + i, f"https://c.example/{i}", "<body><p>One article</p></body>") for i in range(40)]
    found = {r.page_id: r for r in html.query(pages(spark, rows)).collect()}
    assert all(found[i].text == f"Own text number {i}." for i in range(60))
    assert found[100].text == "Read our other great stories\nText 0"
    assert found[210].text == "One article" and found[210].n_chars == len("One article")


def test_odd_rows(spark):
    rows = [(None, None, "<p>a</p>"), (1, None, None), (2, "no scheme", ""), (3, "https://x.example/", "<p>b 😀</p>"), (3, "https://x.example/", "<p>b 😀</p>")]
    found = sorted(((r.page_id, r.text, r.n_chars) for r in html.query(pages(spark, rows)).collect()), key=str)
    assert found == [(1, "", 0), (2, "", 0), (3, "b 😀", 3), (3, "b 😀", 3), (None, "a", 1)]
    assert html.query(pages(spark, [])).count() == 0


def test_every_page_of_the_tables_is_answered(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    found = html.query(df).collect()
    assert len(found) == df.count() and sum(r.n_chars > 0 for r in found) > 0.9 * len(found)
    assert all("<p>" not in r.text and r.n_chars == len(r.text) and "\n\n" not in r.text for r in found)


def test_templates_of_a_section_and_of_small_hosts_go_and_prose_stays(spark):
    rows = []
    for i in range(400):  # a hot host: a menu on 10% of its pages, a notice on 40%, and a sentence that many articles end with
        menu = "<div><ul><li>All of sport</li><li>Results</li></ul></div>" if i % 10 == 0 else ""
        notice = "<section><p>Our terms have changed</p></section>" if i % 5 < 2 else ""
        last = "<p>More next week.</p>" if i % 4 == 0 else ""
        body = f"{menu}{notice}<p>Own text number {i}.</p>{last}"
        rows.append((i, f"https://hot.example/{i}", f"<body><main>{body}</main></body>" if i % 3 else f"<body>{menu}{notice}<p>Own text number {i}.</p></body>"))
    rows += [(1000 + i, f"https://small.example/{i}", f"<body><div><p>Small but loud</p></div><p>Text {i}</p></body>") for i in range(8)]
    found = {r.page_id: r.text for r in html.query(pages(spark, rows)).collect()}
    for i in range(400):
        assert found[i] == f"Own text number {i}." + ("\nMore next week." if i % 4 == 0 and i % 3 else "")
    assert all(found[1000 + i] == f"Text {i}" for i in range(8))


def test_names_that_hold_a_junk_word_and_mean_another_thing():
    assert text('<article class="post has-comments"><p>Article body.</p></article>') == "Article body."
    for name in ("content no-sidebar", "share-price", "withSidebar", "form-factor", "content sidebar-left", "menu-free_reading"):
        assert text(f'<div class="{name}"><p>a</p></div>') == text(f'<div id="{name}"><p>a</p></div>') == "a"
    for name in ("site-footer", "comment-list", "cookieConsentBanner", "main-nav", "ad-slot-3 ad", "sidebar", "reader-comments"):
        assert text(f'<div class="{name}"><p>a</p></div><p>b</p>') == "b"
    assert text('<div class="layout sidebar-right"><article><p>a</p></article></div>') == "a"
    assert text("<article><p>a</p><article class=comment><p>b</p></article></article>") == "a"


def test_paragraphs_beside_an_article_stay():
    assert text("<p>a</p><article>teaser</article><p>main</p>") == "a\nteaser\nmain"
    assert text("<div>Home</div><ul><li>Links</ul><main><div>a</div></main>") == "a"


def test_markup_that_is_not_well_formed():
    assert text("<p title=don't>a</p><p>it's</p>") == "a\nit's"
    assert text('<a title="x>y">l</a> m') == "l m" and text("<b><p>one</b> two</p>") == "one two"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>d") == "a\nb\nc\nd" and text("<p>x<y and z") == "x<y and z"
    assert text("a<!-- > b --> c<!d>e<!-- f") == "a c" + "e" and text("<div><span>a</div>b</span>c") == "a\nbc"


def test_long_pages_take_linear_time():
    n = 1_000_000
    for part in ("<a ", '<a "', "<a x='", "<", "<!--", "<!x ", "<script>", "&#", "<ul><li>x", "<div>x", "<b><p>", "<p a=b ", "<td>"):
        began = time.process_time()
        page = html.Page(part * (n // len(part)))
        page.text({h for h, _, _ in page.trees})
        page.shown()
        assert time.process_time() - began < 5, part
    for first, then in (("<div>", "</b>"), ("<span>", "<li>"), ("<span>", "<p>x"), ("<b><p>", "</b>")):
        began = time.process_time()
        html.Page(first * 80_000 + then * 80_000)
        assert time.process_time() - began < 5, (first, then)
    assert text("<p>" + "word " * 200_000 + "end</p>").endswith("word end")


def made(r, n_hosts=6):
    """Pages of hosts of many sizes, with unmarked templates on known shares of them, and the text that each should give."""
    rows, want = [], {}
    for h in range(n_hosts):
        size = (300, 120, 60, 30, 12, 8)[h % 6]
        boxes = [f"<div><div>Box {h} {k}</div><ul><li>{prose(3, 70 * h + k)}</li><li>{prose(2, 80 * h + k)}</li></ul></div>" for k in range(4)]
        for i in range(size):
            shares = (1.0, 0.6, 0.3, 0.1)
            tops = [b for b, s in zip(boxes, shares) if r.random() < s]
            own = [prose(r.randrange(5, 40), r.randrange(10**9)) for _ in range(r.randrange(1, 6))]
            html_of = "".join(tops[:2]) + "".join(f"<p>{x}</p>" for x in own) + "".join(tops[2:])
            page = len(rows)
            rows.append((page, f"https://h{h}.example/{i}", f"<body>{html_of}</body>"))
            want[page] = own
    return rows, want


def test_planted_templates_are_found_and_text_is_kept(spark):
    rows, want = made(random.Random(8))
    found = {r.page_id: r.text.split("\n") for r in html.query(pages(spark, rows)).collect()}
    lost = sum(x not in found[i] for i in want for x in want[i])
    left = sum(len(set(found[i]) - set(want[i])) for i in want)
    planted = sum(len(html.Page(r[2]).texts) - len(want[r[0]]) for r in rows)
    assert lost == 0 and left <= 0.1 * planted


def test_templates_against_plain_counts(spark):
    rows, _ = made(random.Random(9))
    rows += [(None, None, "<p>a</p>"), (5000, "https://h0.example/x", rows[0][2]), (5001, "https://h0.example/x", None)]
    by_host = defaultdict(dict)
    for _, url, source in rows:
        page = html.Page(source)
        host = url.split("/")[2] if url else ""
        mine = {h for h, _, _ in page.trees}
        old = by_host[host].setdefault(page.text(), sorted(mine))
        by_host[host][page.text()] = min(old, sorted(mine))
    often = {}
    for host, contents in by_host.items():
        total = len(contents)
        n = Counter(h for c in contents.values() for h in c)
        floor = max(min(html.LEAST, max(html.FEWEST, total / 2)), html.RARE * total)
        often[host] = {h for h, k in n.items() if k >= floor and (h % 2 == 0 or k >= html.SHARE * total)}
    want = Counter((i, html.Page(s).text(often[u.split("/")[2] if u else ""])) for i, u, s in rows)
    assert Counter((r.page_id, r.text) for r in html.query(pages(spark, rows)).collect()) == want


def test_other_columns_with_names_of_the_operator(spark):
    df = spark.createDataFrame([(1, "https://a.example/", "<p>x</p>", "h", b"k", 3, ["t"])], "page_id long, url string, html string, host string, key binary, content long, hashes array<string>")
    (r,) = html.query(df).collect()
    assert (r.page_id, r.text, r.n_chars) == (1, "x", 1)
