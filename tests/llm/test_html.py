"""Main text of pages whose parts are known."""

from __future__ import annotations

import pytest

from geomatch.llm import html_extraction as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu {k}</a></li></ul></nav><div class="cookie-notice">We use cookies {k}</div>
<div class="sidebar"><p>Side {k} text that is rather long, longer than the main one perhaps, and goes on</p></div>
<{tag}><h2>Head {k}</h2><p>First {k} &amp; <b>bold</b> caf&eacute;&nbsp;x.<p>Second
 <br>line {k}.<ul><li>one {k}<li>two {k}</ul><form><input><button>Send</button></form><div class="ads">Buy</div><aside>Aside</aside></{close}>
<section id="comments"><article class="comment"><p>Reader {k}</p></article></section><footer>&copy; host {k}</footer></body></html>"""


def page(k, tag="article"):
    return PAGE.format(k=k, tag=tag, close=tag.split(" ")[0])


def expected(k):
    return f"Head {k}\n\nFirst {k} & bold café x.\n\nSecond line {k}.\n\none {k}\n\ntwo {k}"


@pytest.mark.parametrize("tag", ["article", "main", 'div class="content"'])
def test_known_pages(spark, tag):
    rows = [(k, f"https://{'hot' if k % 3 else 'other'}.example/p/{k}", page(k, tag), 1) for k in range(9)]
    rows += [(20, None, None, 1), (21, None, "", 1), (22, "x", "plain <b>text", 1), (23, "https://alone.example/", page(23, tag), 1), (None, "u", page(24, tag), 1), (25, "https://hot.example/other", "<p>only this</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in h.extract(df).collect()}
    assert len(got) == len(rows)
    for k in [*range(9), 23]:
        assert got[k].text == expected(k)
        assert got[k].n_chars == len(got[k].text)
    assert got[None].text == expected(24)
    assert got[20].text == got[21].text == "" and got[22].text == "plain text" and got[25].text == "only this"
    assert h.extract(df.limit(0)).count() == 0


def test_templates_nest_classes(spark):
    df = spark.createDataFrame([(k, "https://a.example/", page(k)) for k in range(6)], "page_id long, url string, html string")
    (row,) = h.templates(df).collect()
    assert row.main == "/html/body/article"
    outer = [t.path for t in row.classes[0].tokens]
    assert row.classes[0].pages == 6 and "/html" in outer and "/html/body/article" in outer


@pytest.mark.parametrize("text", ["<", "<a", "</", "<!--", "<p title='>", "<script>x", "a < b & c > d", "<p>a</b></p></div>", "<" * 2000, "<a b=\"" * 500])
def test_broken_markup_does_not_fail(text):
    assert isinstance(h.text_of(text, None), str)
    assert isinstance(h.text_of("<body><article>" + text, "/body/article"), str)


WHOLE = {
    "mixed": ("<div class=story><h2>Top {k}</h2><p>Lead {k} of the story.</p><ul><li>item {k}</ul><table><tr><td>cell {k}</table><blockquote>quote {k}</blockquote><div class=inner><p>{long}</div></div>", "Top {k}|Lead {k} of the story.|item {k}|cell {k}|quote {k}|{long}"),
    "teaser": ("<main><h1>Head {k}</h1><p>{long}</p><article><p>Teaser {k}</p></article></main>", "Head {k}|{long}|Teaser {k}"),
    "two articles": ("<article><p>Part one {k}</p></article><p>Between {k}</p><article><p>{long}</p></article>", "Part one {k}|Between {k}|{long}"),
}


@pytest.mark.parametrize("kind", WHOLE)
def test_every_block_is_kept(spark, kind):
    markup, want = WHOLE[kind]
    fill = lambda t, k: t.format(k=k, long=f"Words {k} that go on and on. " * 9).replace(". |", ".|").strip()
    rows = [(k, f"https://{'many' if k < 6 else 'alone'}.example/{k}", f"<html><body><nav>menu</nav>{fill(markup, k)}<footer>foot</footer></body></html>") for k in range(7)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n\n".join(x.strip() for x in fill(want, k).split("|")) for k in range(7)}


def test_template_text_is_not_extracted(spark):
    top, foot = "<div class=oben><ul><li><a href=/>Start</a><li>Über uns</ul></div><p>Alle Nachrichten", "<div class=fusszeile><p>Impressum</p></div>"
    rows = [(k, f"https://de.example/{k}", f"<html><body>{top}<p>Text {k}<p>{'oft' if k < 4 else k}{foot}</body></html>") for k in range(6)]
    rows += [(10 + k, f"https://div.example/{k}", f"<html><body>{top}<div class=text><h2>Zutaten</h2><p>Text {k}</div>{foot}</body></html>") for k in range(6)]
    rows += [(20 + k, "https://copies.example/", f"<html><body>{top}<p>Gleich{foot}</body></html>") for k in range(6)]
    got = {r.page_id: r.text.split("\n\n") for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == [f"Text {k}", "oft" if k < 4 else str(k)]
        assert got[10 + k] == ["Zutaten", f"Text {k}"]
        assert got[20 + k] == ["Start", "Über uns", "Alle Nachrichten", "Gleich", "Impressum"]


def test_templates_have_no_limit_of_depth_or_number(spark):
    many = "".join(f"<div class=x{chr(97 + i // 26)}{chr(97 + i % 26)}><br></div>" for i in range(600))
    rows = [(k, "https://many.example/", f"<html><body>{many}{'<div>' * 300}<article><p>Text {k}") for k in range(4)]
    (row,) = h.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    tokens = [t for c in row.classes for t in c.tokens]
    assert row.main.endswith("/article") and max(t.depth for t in tokens) == 304 and len(tokens) == len({t.path for t in tokens}) == 2 + 1200 + 300 + 2


def test_repeated_sentence_in_the_article_goes_by_the_template(spark):
    rights = "All rights belong to the publisher of this site."
    rows = [(k, f"https://one.example/{k}", f"<html><body><article><h2>Story</h2><p>Text {k}</p><p>{rights}</p><p>{'often' if k < 6 else f'last {k}'}</p></article></body></html>") for k in range(7)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story\n\nText {k}\n\n{'often' if k < 6 else f'last {k}'}" for k in range(7)}
    assert h.text_of(rows[0][2], None) == f"Story\n\nText 0\n\n{rights}\n\noften"  # without the template nothing tells it


def test_vectors_equal_brute_force(spark):
    pages = [f"<html><body><div class=a><p>same</p><p>x{k}</p></div>{'<div class=b><p>seldom</p></div>' * (k % 3)}</body></html>" for k in range(8)]
    rows = [(k, "https://h.example/", p) for k, p in enumerate(pages)]
    frequent, _ = h.deduced(spark.createDataFrame(rows, "page_id long, url string, html string"))
    counts = {}
    for k, p in enumerate(pages):
        for node in h.walk(p)[0]:
            counts.setdefault(node.path, [0] * len(pages))[k] += 1
    classes = {}
    for path, v in counts.items():
        if sum(x > 0 for x in v) >= 4:
            classes.setdefault(tuple(v), set()).add(path)
    got = {}
    for r in frequent.collect():
        got.setdefault((r.v1, r.v2), set()).add(r.path)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_names_do_not_drop_blocks_of_the_article():
    blocks = '<div class="share-price"><p>Price</p></div><p id="reply-to-critics">Reply</p><section class="menu"><p>Menu</p></section><p class="lead-notice">Notice</p>'
    assert h.text_of(f"<body><article><h1>Title</h1>{blocks}<div class='ad-box'>Buy</div></article>", None) == "Title\n\nPrice\n\nReply\n\nMenu\n\nNotice"
    assert h.text_of(f"<body><div><h1>Title</h1>{blocks}</div>", None) == "Title\n\nPrice\n\nReply\n\nNotice"


def test_deep_and_long_pages_take_time_in_proportion():
    import time
    import tracemalloc

    began = time.time()
    tracemalloc.start()
    assert h.text_of("<div>" * 100_000 + "deep", None) == "deep"
    assert h.text_of("<h1>x" * 50_000, None).count("x") == 50_000
    assert h.text_of("<b>" * 100_000 + "<p>y</b>" * 1000, None).count("y") == 1000
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()
    assert len(h.text_of("<article>" + "<p>some words &amp; more\n" * 500_000, None)) > 9_000_000
    assert time.time() - began < 60


def test_slots_beside_the_main_one_go_in_any_language(spark):
    box = "<div class={}><p>{} {k}</p><p>mehr {k}</p></div>"
    rows, want = [], {}
    for k in range(6):
        parts = {name: box.format(name, name, k=k) for name in ("werbung", "kommentare", "fusszeile", "inhalt")}
        rows.append((k, "https://zeitung.example/", f"<html><body>{parts['werbung']}<div class=seite><div class=titel><h1>Titel {k}</h1></div><article><p>Anfang {k}</p>{parts['inhalt']}<p>Ende {k}</p></article><p>Nachsatz {k}</p>{parts['kommentare']}</div>{parts['fusszeile']}</body></html>"))
        want[k] = f"Titel {k}\n\nAnfang {k}\n\ninhalt {k}\n\nmehr {k}\n\nEnde {k}\n\nNachsatz {k}"
        # no article: nothing tells the boxes from the text; two of them: what lies between stays
        rows.append((10 + k, "https://ohne.example/", f"<html><body>{parts['werbung']}{parts['inhalt']}</body></html>"))
        want[10 + k] = f"werbung {k}\n\nmehr {k}\n\ninhalt {k}\n\nmehr {k}"
        rows.append((20 + k, "https://zwei.example/", f"<html><body><article><p>Eins {k}</p></article>{parts['inhalt']}<article><p>Zwei {k}</p></article></body></html>"))
        want[20 + k] = f"Eins {k}\n\ninhalt {k}\n\nmehr {k}\n\nZwei {k}"
    # a page of the host without the article, and one whose box holds an article of its own
    rows.append((30, "https://zeitung.example/", f"<html><body>{box.format('werbung', 'Preise', k=1)}</body></html>"))
    want[30] = "Preise 1\n\nmehr 1"
    rows.append((31, "https://zeitung.example/", "<html><body><div class=werbung><article><p>Eigenes</p></article></div><div class=seite><article><p>Text</p></article></div></body></html>"))
    want[31] = "Eigenes\n\nText"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(df).collect()} == want


def test_slots_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    names = ["aa", "bb", "cc", "dd"]

    def tree(depth, k):
        tags = [(rng.choice(["div", "section", "ul"]), rng.choice(names)) for _ in range(rng.randint(1, 3))]
        return "".join(f"<{t} class={c}><p>w{k}</p>{tree(depth - 1, k) if depth else ''}</{t}>" for t, c in tags for _ in range(rng.choice([1, 1, 1, 2])))

    rows = []
    for site in range(12):
        frame = [tree(1, "x") for _ in range(3)]
        for k in range(5):
            own = [x if rng.random() < 0.8 else tree(0, k) for x in frame]
            rows.append((len(rows), f"https://s{site}.example/{k}", f"<html><body>{own[0]}<div class=mid>{own[1]}<article><p>text {site} {k}</p></article>{'<article><p>more</p></article>' if site % 5 == 4 else ''}{own[2]}</div></body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: (r.anchor, r.slots) for r in h.deduced(df)[1].collect()}
    for site in range(12):
        counts, tag = {}, {}
        pages = [r[2] for r in rows if r[1].startswith(f"https://s{site}.example/")]
        for k, p in enumerate(pages):
            for x in h.walk(p)[0]:
                counts.setdefault(x.path, [0] * len(pages))[k] += 1
                tag[x.path] = x.tag
        often = {p: [n for n in v if n] for p, v in counts.items() if sum(n > 0 for n in v) >= max(2, len(pages) / 2)}
        main = "/html/body/div.mid/article"
        around = {"/html", "/html/body", "/html/body/div.mid"}
        slots = sorted(p for p, v in often.items() if tag[p] in h.BOXES and len(set(v)) == 1 and p not in around and p.rpartition("/")[0] in around)
        one = often.get(main) and set(often[main]) == {1}
        assert got[f"s{site}.example"] == ((main, slots) if one and slots else (None, [])), site


def test_template_tells_side_matter_of_the_given_pages_without_names(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    named = {r.page_id: r.text for r in h.extract(pages).collect()}
    hosts = {r.host: r for r in h.deduced(pages)[1].collect() if r.slots}
    monkeypatch.setattr(h, "SIDE_WORDS", frozenset())
    monkeypatch.setattr(h, "ASIDE_WORDS", frozenset())
    seen = [(h.text_of(r.html, t.main), h.text_of(r.html, t.main, frozenset(t.texts), t.anchor, frozenset(t.slots)), named[r.page_id]) for r in pages.withColumn("host", h.host_of(pages["url"])).collect() if (t := hosts.get(r.host))]
    assert len(seen) > 200 and all(plain != want and by_template == want for plain, by_template, want in seen)
