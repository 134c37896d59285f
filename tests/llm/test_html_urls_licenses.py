import re

import duckdb
import pytest

from casegrid.llm import html_text, licenses, url_filter
from casegrid.llm.queries import QUERIES, url_rules

TREE = html_text.grow_tree(html_text.LABELLED)


def main(page):
    return html_text.main_text(page, TREE)


def test_tree_learns_its_table():
    x, y = html_text.LABELLED[:, :-1], html_text.LABELLED[:, -1]
    assert (html_text.classify(TREE, x) == y).all()


def test_op3_against_the_generator_s_article(spark, sf):
    """All pages are of one kind: everything in the article, and nothing else."""
    import html

    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall())
    got = {r["page_id"]: r for r in QUERIES["op3_html_text"](spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<article>", ""), ("plain words only", ""),
    ("<article><p>A &amp; B &lt;i&gt;</p><p> two\n\t spaces </p></article>", "A & B <i>\n\ntwo spaces"),
    ("<body><header><p>Site name here</p></header><main><h1>T</h1><p>x <a href='#'>link</a> y</p></main>", "T\n\nx link y"),
    ("<article><p>a<aside><p>side</p></aside><p>b</p><form><label>Mail</label><input></form><p>c</article>", "a\n\nb\n\nc"),
    ("<article><p>a</p><div class='comments'><p>first!</p><div><p>second</p></div></div><p>z</p></article>", "a\n\nz"),
    ("<article><p>a</p><div id=cookie-notice><p>we use cookies</p></div><script>if(a<b)x='</p>'</script><p>z</p></article>", "a\n\nz"),
    ("<article><p title='a>b'>one</p><p title=\"x>y'z\">two</p><!-- <p>gone</p> --></article><footer>f</footer>", "one\n\ntwo"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one\n\ntwo\n\nc1\n\nc2"),
    ("<article><p>a < b and c</p><p>d<br>e</article>", "a < b and c\n\nd e"),
    ("<article><p>kept</p><style>p{}</style><noscript>no</noscript><textarea>t</textarea></article>", "kept"),
    ("<article><p>open <b>bold<p>next</article><p>after", "open bold\n\nnext"),
    ("<article><p>x</p><script>never closed <p>y</p>", "x"),
])
def test_pages(page, text):
    assert main(page) == text


def test_a_page_without_an_article():
    body = "These words are the running text of a page that has no article element at all, " * 4
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(9))
    page = f"<div><ul>{menu}</ul></div><div><p>{body}</p><p>{body}</p><p>{body}</p></div><div><a href=/>Imprint</a></div>"
    assert main(page) == "\n\n".join([" ".join(body.split())] * 3)


def test_hostile_pages_take_linear_time():
    for page in ("<a \"" * 200_000, "<" * 500_000, "<div>" * 200_000, "</div>" * 300_000, "<!--" * 200_000, "<script>" * 100_000,
                 "<article>" + "<p>w</p>" * 100_000, "&" * 500_000):
        html_text.blocks(page)


def test_page_rows_are_kept(spark):
    rows = [(1, "u", None), (None, None, "<article>x</article>"), (1, "u", None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [(1, "u", ""), (1, "u", ""), (None, None, "x")])) or len(got) == 3
    assert sorted(r["text"] for r in got) == ["", "", "x"]


def test_urls(spark):
    cases = [(1, "http://a.net/x", "a.net", "/x", "net/", "block"), (2, "HTTPS://Example.NET/en/1?q#f", "example.net", "/en/1", "example.net/en/", "allow"),
             (3, "x://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"), (4, None, "", "", None, "allow"),
             (5, "no scheme", "", "", None, "allow"), (6, "http://net", "net", "", None, "allow"), (7, "http://anet/x", "anet", "/x", None, "allow"),
             (8, "http://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"), (9, "http://?q", "", "", None, "allow"),
             (None, "http://a.net/x", "a.net", "/x", "net/", "block"), (1, "http://a.net/x", "a.net", "/x", "net/", "block"),
             (10, "http://" + "a." * 20000 + "net/" + "p" * 50000, "a." * 20000 + "net", "/" + "p" * 50000, "net/", "block"),
             (11, "http://b.net\n/x", "b.net\n", "/x", None, "allow"), (12, "http://ÄB.net/É", "Äb.net", "/É", "net/", "block")]
    pages = spark.createDataFrame([(i, u, "c", "d") for i, u, *_ in cases], "page_id long, url string, host string, keys string")
    got = url_filter.judge(pages, url_rules(spark)).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, [(i, *r) for i, _, *r in cases]))
    assert url_filter.judge(pages.limit(0), url_rules(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, url_rules(spark).limit(0)).collect()} == {"allow"}


def test_many_rules_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    word = lambda: rnd.choice("abcd")
    rules = {(".".join(word() for _ in range(rnd.randint(1, 3))), "/" + "".join(word() for _ in range(rnd.randint(0, 3)))): rnd.choice(["allow", "block"])
             for _ in range(300)}
    urls = [".".join(word() for _ in range(rnd.randint(1, 4))) + "/" + "".join(word() for _ in range(rnd.randint(0, 5))) for _ in range(600)]
    frame = spark.createDataFrame([(v, h, p) for (h, p), v in rules.items()], "verdict string, host string, path string")
    got = url_filter.judge(spark.createDataFrame([(i, "http://" + u) for i, u in enumerate(urls)], "page_id long, url string"), frame, "none")
    for r in got.collect():
        host, _, path = urls[r["page_id"]].partition("/")
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        best = max(fits, default=None)
        assert (r["rule"], r["verdict"]) == ((best[2], best[3]) if best else (None, "none"))


def test_licenses(spark, docs_of):
    mit, gpl = licenses.TEMPLATES[1][1], licenses.TEMPLATES[2][1]
    rows = [(1, f"Some text.\n{mit.upper()}\nmore"), (2, None), (3, ""), (4, gpl.replace("work", "small work")), (5, "released under the"),
            (None, f"{mit}\n{mit}\n{gpl}"), (6, "word " * 50000), (7, "released under the mit license " * 2000)]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(rows)).collect()}
    assert (got[1]["license"], got[1]["dice"], got[1]["line_no"], got[1]["n_lines"]) == ("MIT", 1.0, 2, 1)
    assert got[4]["license"] == "GPL-3.0" and licenses.THRESHOLD <= got[4]["dice"] < 1
    assert (got[None]["license"], got[None]["line_no"], got[None]["n_lines"]) == ("MIT", 1, 3)
    for i in (2, 3, 5, 6):
        assert got[i]["license"] is None and got[i]["dice"] == 0.0 and got[i]["n_lines"] == 0
    assert got[7]["license"] == "MIT"  # five bigrams, of which one is "license released"
    assert licenses.scan(docs_of([])).count() == 0


def test_size_bounds_cut_nothing():
    for n in range(1, 14):
        low, high = licenses.bounds(n, 0.8)
        for a in range(1, 40):
            assert (2.0 * min(a, n) / (a + n) >= 0.8) == (low <= a <= high)


def test_notices_inside_lines_across_lines_and_whole_texts(spark, docs_of):
    bsd = dict(licenses.TEXTS)["BSD-3-Clause"].replace("the copyright holder nor", "Doe Incorporated nor")
    wrapped = "\n * ".join(re.findall(r"(?:\S+\s*){1,9}", bsd))
    rows = [(1, "Copyright 2020 Jane Doe. Released under the MIT License."), (2, "x\nIt is released under the\nMIT License, as said."),
            (3, "Copyright (c) 2020 Jane Doe\n\n" + licenses.TEXTS[1][1] + "\nmore words " * 30), (4, "# a\n" + wrapped),
            (5, "We speak of the software, of the license and of the copyright. " * 200),
            (6, "A paragraph before. " + dict(licenses.TEXTS)["Apache-2.0"].replace("this file", "these files") + " A paragraph after.")]
    got = {r["doc_id"]: (r["license"], r["line_no"], r["n_lines"]) for r in licenses.scan(docs_of(rows)).collect()}
    assert got == {1: ("MIT", 1, 1), 2: ("MIT", 2, 1), 3: ("MIT", 3, 1), 4: ("BSD-3-Clause", 2, 1), 5: (None, None, 0),
                   6: ("Apache-2.0", 1, 1)}


def test_windows_against_all_windows(spark, docs_of):
    """Every window of every template's sizes, and every line, by brute force."""
    import random

    rnd = random.Random(7)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)})
    rows = []
    for i in range(150):
        words = [rnd.choice(pool) for _ in range(rnd.randint(0, 12))] + licenses.words_of(rnd.choice(licenses.TEMPLATES)[1])
        words = [w for w in words if rnd.random() < 0.93] + [rnd.choice(pool) for _ in range(rnd.randint(0, 12))]
        rows.append((i, "".join(w + rnd.choice([" ", " ", " ", "\n"]) for w in words)))
    sets = [(set(licenses.bigrams_of(t)), *licenses.bounds(len(licenses.bigrams_of(t)), 0.8)) for _, t in licenses.TEMPLATES]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(rows), licenses.TEMPLATES).collect()}
    for i, text in rows:
        w = licenses.words_of(text)
        grams = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        line_of = [n for n, x in enumerate(text.split("\n"), 1) for _ in licenses.words_of(x)]
        best = (0.8 - 1e-12, 0, 0, None)
        for no, (b, low, high) in enumerate(sets):
            spans = [(a, n) for a in range(len(grams)) for n in range(low, high + 1) if a + n <= len(grams)]
            spans += [(line_of.index(x), line_of.count(x) - 1) for x in set(line_of)]
            for a, n in spans:
                s = set(grams[a:a + n])
                best = max(best, (2 * len(s & b) / (len(s) + len(b)), -no, -a, no))
        if best[3] is None:
            assert got[i]["license"] is None and got[i]["n_lines"] == 0
        else:
            assert (got[i]["dice"], got[i]["license"]) == (best[0], licenses.TEMPLATES[best[3]][0]) and got[i]["n_lines"] >= 1


LONG = "These words are the running text of a page and go on for a while, as running text does in most places. " * 2
PARTS = f"<h1>The title</h1><p>{LONG}</p><h2>A part</h2><p>A short paragraph here.</p><p>{LONG}</p>"
WANT = f"The title\n\n{LONG.strip()}\n\nA part\n\nA short paragraph here.\n\n{LONG.strip()}"


@pytest.mark.parametrize("page", [
    "<div class='content has-sidebar'><article>{}</article></div>", "<div id='page' class='no-comments'><article>{}</article></div>",
    "<article class='post social'>{}</article>", "<main role=navigation><div class='post social'>{}</div></main>",
    "<div class='widget social'><article>{}</article></div><div class=sidebar><p>Some words about the people who write here.</p></div>",
    "<div id='page' class='no-comments'>{}</div>", "<div class='content sidebar-left'>{}</div><div><a href=/>Imprint</a></div>",
    "<article>{}</article><div class=comments><article class=comment><p>A reply with quite a few words of its own.</p></article></div>",
    "<article>{}<div class=related><article><h3>Other</h3><p>A teaser of a few words.</p></article></div></article>",
])
def test_names_of_wrappers_lose_no_article(page):
    assert main(page.format(PARTS)) == WANT


@pytest.mark.parametrize(("page", "text"), [
    (f"<h1>Title</h1><p>{LONG * 2}</p>", f"Title\n\n{(LONG * 2).strip()}"),
    (f"<a href=/>Home page</a><h2>Two words</h2><p>{LONG * 2}</p>", f"Two words\n\n{(LONG * 2).strip()}"),
    (f"<ul><li><a href=/>Home</a></ul><div>{PARTS}</div><h3>More</h3><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul>", WANT),
    (f"<h1>Title</h1><h2>Subtitle of it</h2><p>{LONG}</p>", f"Title\n\nSubtitle of it\n\n{LONG.strip()}"),
    (f"<div><h1>Site name</h1></div><article>{PARTS}</article>", WANT),
])
def test_headings_and_short_paragraphs_without_an_article(page, text):
    assert main(page) == text
