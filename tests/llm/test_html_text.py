import html as H
import math
import random
import re
import time
from collections import Counter

import pytest

from heatgrid.llm import html_text

PAGES = "page_id long, url string, html string, Text int, hashes int, host string"


def text(page, template=()):
    return html_text.main_text(html_text.parse(page), set(template))


def test_chrome_goes_and_blocks_stay():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page with-sidebar">
    <header><h1>Site</h1></header><nav><ul><li>a</ul></nav><div class="cookie-notice">We use</div><div class=ad>Buy</div>
    <main><article id="x"><header><h1>Head &amp; line</h1></header><p>One   <b>bo</b>ld&nbsp;x<br>y<p>Two &lt;b&gt; &copy;<div hidden>no</div>
    <ul><li>first<li>second</ul><form>f</form><script>if (a</p>b) "</article>"</script><table><tr><td>c1<td>c2</table></article>
    <section class="comments"><p>me too</p></section></main><aside>side</aside><!-- <p>no</p> --><footer>&copy; F</footer></body></html>"""
    assert text(page) == "Head & line\nOne bold x y\nTwo <b> ©\nfirst\nsecond\nc1\nc2"


def test_a_wrapper_with_a_telling_name_keeps_the_article():
    page = "<body><div class='layout with-sidebar'><div class='sidebar'><p>side</p></div><div id='comments-on'><main><p>Main</p></main></div><div class='comments'>c</div></div></body>"
    assert text(page) == "Main"
    assert text("<div class='menu'><p>m</p></div><p>rest</p>") == "rest"


def test_broken_pages_have_defined_texts():
    assert text(None) == text("") == text("<p></p> \n") == ""
    assert text("no tags < 3 &amp; &am &a") == "no tags < 3 & &am &a"
    assert text("<p>a</b></div><p>b<script>never closed <p>c") == "a\nb"
    assert text('<p title="a>b">x</p><a href="unclosed>y') == "x\ny"
    assert text("<div>" * 50_000 + "deep") == "deep"
    assert text("<p>" + "word " * 200_000).count("word") == 200_000


@pytest.mark.parametrize("unit", ["<a ", '<a t="x ', "<b>", "< ", '<a ">"', "<i><div><b>", "<b><div></div>", "<a '\"> ", "<td>", "&am", "<!", "<li><b>", "</i>"])
def test_long_broken_pages_take_time_in_proportion(unit):
    size = 1 << 20
    for page in (unit * (size // len(unit)), unit * (size // 2 // len(unit)) + "</i>" * (size // 8), "<i>" + unit * (size // len(unit)) + "'\">"):
        began = time.process_time()
        root = html_text.parse(page)
        assert time.process_time() - began < 8
        if unit in ("<a ", "< ", "&am"):
            html_text.main_text(root, set())


def plain_parse(page):
    """The tree's shape by one pattern for tags and plain searches, quadratic in bad cases."""
    tag_ = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
    root, at = ["html", []], 0
    stack = [root]

    def close(tags, within):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    while m := tag_.search(page, at):
        if m.start() > at:
            stack[-1][1].append(page[at : m.start()])
        at, tag = m.end(), (m[2] or m[5] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1] or m[4]:
            close({tag}, () if tag in html_text.BLOCK else html_text.BLOCK)
            continue
        if tag in html_text.CLOSES_P:
            close({"p"}, html_text.BLOCK - {"p"})
        if tag in html_text.SIBLINGS:
            close(*(x.split() for x in html_text.SIBLINGS[tag]))
        stack[-1][1].append([tag, []])
        if tag in html_text.RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
        elif tag not in html_text.VOID:
            stack.append(stack[-1][1][-1])
    stack[-1][1].append(page[at:])
    return root


def test_trees_of_random_pages_against_a_plain_parser():
    rng = random.Random(3)
    bits = ["<a ", "<p>", "</p>", "<b>", "</b>", "<div class='x'>", "</div>", '"', "'", ">", "<", "text", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<!--", "-->", "<!x", "<br/>", "<script>", "</script>", " t=", "</", "<i>", "</i>", "<dt>", "<dd>", "<dl>", "/"]
    shape = lambda n: n if isinstance(n, str) else [n.tag, [shape(k) for k in n.kids]]
    for _ in range(4000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert shape(html_text.parse(page)) == plain_parse(page), page


def plain_templates(rows):
    """Hashes counted by host in plain Python."""
    pages, found = Counter(host for host, _ in set(rows)), {}
    for host, html in rows:
        for h in {x for own in html_text.subtree_hashes(html_text.parse(html)).values() for x in own and [(h, 0, 0) for h, *_ in own]}:
            own = found.setdefault((host, h[0]), [0, 0, 0])
            own[0] += 1
        for own in html_text.subtree_hashes(html_text.parse(html)).values():
            for h, context, held in own:
                found[host, h][1] |= context
                found[host, h][2] |= held
    out = {host: {html_text.COUNTED} for host, n in pages.items() if n >= html_text.FEW}
    for (host, h), (n, contexts, held) in found.items():
        kind, total = h >> html_text.KIND_BIT, pages[host]
        least, part = html_text.LEAST[kind]
        share = n >= max(least, math.ceil(total * part))
        many = share or n >= max(html_text.MANY[0], math.ceil(total * html_text.MANY[1]))
        half = (1 - (1 - 1 / html_text.BITS) ** min(n, total)) * html_text.BITS / 2
        differ = contexts.bit_count() >= max(3, half)
        rule = {
            html_text.OUTSIDE: many, html_text.NAMED: share, html_text.MOST: share and differ, html_text.LOOSE: share and differ,
            html_text.BOX: many and differ, html_text.LOOSE_BOX: many and differ, html_text.ROTATING: many and differ and held.bit_count() <= half,
        }
        if rule[kind]:
            out.setdefault(host, set()).add(h)
    return out


def test_templates_against_plain_counts_and_they_do_the_work(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", html_text.host()).select("host", "html")
    rows = [(r.host, r.html) for r in frame.collect()]
    got = {r.host: set(r.hashes) for r in html_text.templates(frame).collect()}
    assert got == plain_templates(rows)
    counted = [(h, x) for h, x in rows if html_text.COUNTED in got.get(h, ())]
    changed = [html_text.main_text(html_text.parse(x), {html_text.COUNTED}) != html_text.main_text(html_text.parse(x), got[h]) for h, x in counted]
    assert counted and all(changed)  # where hosts have pages enough, the counts take something from every page


def pages(hosts):
    """Pages whose menu, advert and closing line have no telling names, and vary but for the closing line."""
    out = []
    for h, n in hosts:
        for i in range(n):
            body = f"<body><div class='q1'><a>go {h}{i}</a></div><article><h1>Title {i}</h1><p>Own text {i} of {h}.</p><p>A line that all share.</p></article><div class='q2'><span>Terms of {h}.</span></div></body>"
            out.append((len(out), f"https://{h}.org:80/p{i}", body))
    return out


def test_templates_are_found_by_host(spark):
    rows = [*pages([("a", 8), ("b", 2)]), (100, None, None), (101, "nonsense", "<p>kept</p>")]
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], PAGES).repartition(3)
    got = html_text.extract_text(frame)
    assert got.columns == ["page_id", "url", "hashes", "host", "text"] and {r.hashes for r in got.collect()} == {2}
    found = {r.page_id: r.text for r in got.collect()}
    for i in range(8):
        assert found[i] == f"Title {i}\nOwn text {i} of a.\nA line that all share."
    assert found[8] == "go b0\nTitle 0\nOwn text 0 of b.\nA line that all share.\nTerms of b."  # two pages tell nothing
    assert found[100] == "" and found[101] == "kept"
    assert html_text.extract_text(frame.limit(0)).count() == 0


def test_a_share_button_in_every_article_goes(spark):
    rows = [(i, "http://h/x", f"<article><p>Text {i}</p><div><p>Tell a friend</p></div></article>", 1, 2, "x") for i in range(12)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {i: f"Text {i}" for i in range(12)}


def test_shuffled_join_agrees(spark, monkeypatch):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in pages([("a", 5), ("c", 4)])], PAGES)
    one = sorted(html_text.extract_text(frame).collect())
    monkeypatch.setattr(html_text, "MAX_BROADCAST_ROWS", -1)
    assert sorted(html_text.extract_text(frame).collect()) == one


def test_articles_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in html_text.op9_html_extraction(spark, d).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_named_elements_are_counted_where_the_host_has_pages_enough(spark):
    own = "<div class='share'><p>The share of {i} in all, told once: {tags}</p></div>"
    body = "<body class='page-id-{i}'><nav><a>go {i}</a></nav>{own}<article><p>Text {i}</p></article><footer>Terms {i}</footer></body>"
    row = lambda i, h: (i, f"http://{h}/{i}", body.format(i=i, own=own.format(i=i, tags=f"<table id='t'><tr><td>{i}</table>") if i % 50 == 7 else ""), 1, 2, "x")
    rows = [*[row(i, "many") for i in range(12)], *[row(50 + i, "few") for i in range(9)]]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in (7, 57):  # nothing like it recurs on its host, of twelve pages or of nine
        assert found.pop(i) == f"The share of {i} in all, told once:\n{i}\nText {i}"
    assert found == {i: f"Text {i}" for i in (*range(7), *range(8, 12), *range(50, 57), 58)}


def test_a_host_that_grows_keeps_its_texts(spark):
    """From two pages on counts decide, so further pages change nothing in those that were there; one page goes by its names."""
    body = "<body><nav><a>go {i}</a></nav><div class='share'><p>Told once, {i}: {own}</p></div><article><p>Text {i}</p></article><footer>Terms {i}</footer></body>"
    row = lambda i, h: (i, f"http://{h}/{i}", body.format(i=i, own="<table id='t'><tr><td>x</table>" if i % 100 == 0 else ""), 1, 2, "x")
    sizes = [1, 2, 3, 9, 10, 11, 40]
    rows = [row(100 * k + i, f"h{n}") for k, n in enumerate(sizes) for i in range(n)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    for k, n in enumerate(sizes):
        once = f"Told once, {100 * k}:\nx\n" if n > 1 else ""
        assert found[100 * k] == f"{once}Text {100 * k}"
        # the plain form of the box is on two pages from three on
        assert all(found[100 * k + i] == f"Text {100 * k + i}" for i in range(1, n) if n > 2)


def test_words_in_ids_and_classes_do_not_tell_in_the_article(spark):
    kept = "<h2 id='related-work'>Related work</h2><section id='search-and-rescue'><p>Rescue {i}</p></section><p class='notice'>Note {i}</p><div id='social-history'>Once {i}</div><pre>x <span class='token comment'># {i}</span></pre>"
    gone = "<div class='ad-box'>Buy {i}</div><ul class='comment-list'><li id='comment-{i}'>me {i}</ul>"
    page = f"<div class='related links'>more</div><article><p>Text {{i}}</p>{kept}{gone}</article>"
    want = "Text {i}\nRelated work\nRescue {i}\nNote {i}\nOnce {i}\nx # {i}"
    assert text(page.format(i=1)) == want.format(i=1)
    rows = [(i, "http://h/x", page.format(i=i), 1, 2, "x") for i in range(9)] + [(i, "http://g/x", page.format(i=i), 1, 2, "x") for i in range(9, 29)]
    frame = spark.createDataFrame([(*r[:2], r[2].replace("<h2 id='related-work'>Related work</h2>", f"<h2 id='related-work'>Related work {r[0] // 2}</h2>"), *r[3:]) for r in rows], PAGES)
    found = {r.page_id: r.text for r in html_text.extract_text(frame).collect()}
    assert found == {i: want.format(i=i).replace("work", f"work {i // 2}") for i in range(29)}


def test_boxes_in_different_articles_go_and_copied_articles_stay(spark):
    own = lambda i: f"<p>Long text of its own that no other page has, number {i} of them all.</p>"
    box, quote = "<div class='z1'><b>Get our letter</b></div>", "<p>A quoted line.</p>"
    article = lambda i, extra: f"<article><h1>T {i}</h1>{own(i)}{extra}<p>End {i}</p></article>"
    bare = lambda i: f"<div class='c1'>{own(i)}<div class='z2'>Rotating {i % 3}</div><div class='z3'>Lead {i}</div><p>End {i}</p></div>"
    copied = "<article><p>The same long article on many pages of the host.</p><div class='z4'>Its inset</div></article>"
    rows = [(i, "http://small/x", article(i, box + quote)) for i in range(6)]
    rows += [(100 + i, "http://large/x", article(i, box + quote if i % 4 == 0 else "")) for i in range(240)]
    rows += [(400 + i, "http://bare/x", bare(i)) for i in range(30)]
    rows += [(500 + i, "http://copy/x", copied if i < 8 else article(i, "")) for i in range(16)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], PAGES)).collect()}
    line = lambda i: f"Long text of its own that no other page has, number {i} of them all."
    assert found[3] == f"T 3\n{line(3)}\nA quoted line.\nEnd 3"
    assert found[104] == f"T 4\n{line(4)}\nA quoted line.\nEnd 4" and found[105] == f"T 5\n{line(5)}\nEnd 5"
    assert found[405] == f"{line(5)}\nLead 5\nEnd 5"
    assert found[500] == "The same long article on many pages of the host.\nIts inset"


def test_repeated_pages_keep_their_text(spark):
    """However often a page was fetched, and under whatever other chrome an article stands."""
    chrome = "<div class='q{k}'><a>go {k}</a></div>"
    article = lambda i: f"<article><h1>Title {i}</h1><div class='body'><p>The long text of article {i}, as it stands.</p><p>More of {i}.</p></div></article>"
    bare = lambda i: f"<div class='m'><h1>Title {i}</h1><p>The long text of page {i}, as it stands.</p><p>More of {i}.</p></div>"
    page = lambda body, k=0: f"<body>{chrome.format(k=k)}{body}<footer>Terms</footer></body>"
    sets = {
        "twelve": [page(article(1))] * 12, "three": [page(bare(1))] * 3, "barely": [page(bare(1))] * 40, "mixed": [page(article(1))] * 27 + [page(article(i)) for i in (2, 3, 4)],
        "mirror": [page(article(1), k) for k in range(15)], "crowd": [page(article(1))] * 30 + [page(article(i)) for i in range(2, 32)],
    }
    rows = [(n, f"http://{h}/{n}", html, 1, 2, "x") for n, (h, html) in enumerate((h, x) for h, own in sets.items() for x in own)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    for n, _, html, *_ in rows:
        for block in re.findall(r"<(?:h1|p)>(.*?)</", html):
            assert block in found[n].split("\n"), (n, found[n])


def test_headings_and_lines_of_every_article_stay(spark):
    body = "<article><h1>T {i}</h1><p>Own text {i} at some length.</p><h2>Question</h2><p>Answer {i}</p><h3>References</h3><ul><li>See all</li><li>{i}</li></ul><p>CC BY 4.0</p></article>"
    rows = [(i, "http://h/x", f"<div class='q1'><a>go {i}</a></div>" + body.format(i=i), 1, 2, "x") for i in range(40)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {i: f"T {i}\nOwn text {i} at some length.\nQuestion\nAnswer {i}\nReferences\nSee all\n{i}\nCC BY 4.0" for i in range(40)}
