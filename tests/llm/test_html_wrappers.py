from skein.llm.html_wrappers import Page, host_wrappers, main_texts, merge, page_tree, regex

ARTICLE = """<!DOCTYPE html><HTML><head><title>T</title><style>p{x:y}</style><script>var t="</p>";</script></head><body>
<header class=top><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Big &amp; <i>bold</i></h1><p>First <b>para</b>graph&nbsp;one<br>two<p>Second{n}<div class="ad">Buy!</div><form><label>Mail</label></form></article>
<section id="comments"><p>Nice post</p></section></main><aside>Related</aside><footer>&copy; x</footer></body>"""
MAIN = "Big & bold First paragraph one two Second"

PLAIN = "<html><body><div class=top>Site name</div><div class=page><div class=body><p>Story {n} begins</p><p>and ends {n}.</p></div><div class=note>Read more</div></div></body></html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_main_text_of_articles(spark):
    rows = [(i, f"http://h.example.com/{i}", ARTICLE.replace("{n}", str(i))) for i in range(6)] + [(10, None, None), (11, "x", ""), (12, "http://h.example.com/z", "<p>loose text"), (13, "http://h.example.com/q", "a < b and <unclosed")]
    got = {r.page_id: (r.text, r.n_chars) for r in main_texts(pages(spark, rows)).collect()}
    assert [got[i] for i in range(6)] == [(MAIN + str(i), len(MAIN) + 1) for i in range(6)]
    assert got[10] == got[11] == ("", 0) and got[12][0] == "loose text" and got[13][0].startswith("a < b and")
    assert main_texts(pages(spark, [])).count() == 0


def test_constant_texts_outside_an_article_go(spark):
    rows = [(i, f"http://p.example.com/{i}", PLAIN.replace("{n}", f"number{i}" * 9)) for i in range(8)]
    got = {r.page_id: r.text for r in main_texts(pages(spark, rows)).collect()}
    assert got == {i: f"Story {f'number{i}' * 9} begins and ends {f'number{i}' * 9}." for i in range(8)}


def test_wrapper_has_options_repeats_and_slots(spark):
    one = page_tree(Page("<div><h1>A</h1><ul><li>x<li>y</ul></div>"))
    two = page_tree(Page("<div><h1>B</h1><p>new</p><ul><li>z</ul></div>"))
    assert regex(merge(one, two)) == "<div><h1>(.+)</h1>(<p>new</p>)?<ul>(<li>(.+)</li>)+</ul></div>"
    out = host_wrappers(pages(spark, [(1, "http://a.b/1", "<p>x"), (2, "http://a.b/2", "<p>y")])).collect()
    assert [(r.host, r.pages, r.wrapper) for r in out] == [("a.b", 2, "<p>(.+)</p>")]


def test_texts_of_single_pages_stay(spark):
    once = PLAIN.replace("</p></div>", "</p><blockquote>Said once</blockquote><h4>Odd <em>one</em></h4></div>")
    rows = [(i, f"http://p.example.com/{i}", (once if i == 3 else PLAIN).replace("{n}", f"number{i}" * 9)) for i in range(8)]
    got = {r.page_id: r.text for r in main_texts(pages(spark, rows)).collect()}
    assert got == {i: f"Story {f'number{i}' * 9} begins and ends {f'number{i}' * 9}." + " Said once Odd one" * (i == 3) for i in range(8)}


def test_equal_pages_keep_their_text(spark):
    same = "<html><body><div class=top>Site name</div><div class=page><h2>A story that all pages tell</h2><p>and its end.</p></div></body></html>"
    rows = [(i, "http://e.example.com/", same) for i in range(9)] + [(i, "http://f.example.com/", same.replace("name", "N" * (i % 3))) for i in range(20, 29)]
    assert all("A story that all pages tell and its end." in r.text for r in main_texts(pages(spark, rows)).collect())


def test_deep_wide_and_repeated_pages(spark):
    import time

    began = time.time()
    deep, wide = "<div>" * 100_000 + "deep end" + "</div>" * 50_000, "<article>" + "".join(f"<p class=c{'abcdefgh'[i % 7]}{'xyz'[i % 5 % 3]}>w{i}</p>" for i in range(20_000)) + "</article>"
    odd = "</x>" * 50_000 + "<p><td>" + "<div>" * 20_000 + "inner"
    rows = [(1, "http://d.example.com/1", deep), (2, "http://d.example.com/2", wide), (3, "http://d.example.com/3", wide), (4, "http://e.example.com/4", odd), (5, "http://d.example.com/5", deep)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, _host int")).collect()}
    assert got[1] == got[5] == "deep end" and got[4] == "inner" and got[2] == got[3] == " ".join(f"w{i}" for i in range(20_000))
    assert time.time() - began < 60
