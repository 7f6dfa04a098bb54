import html
import random
import re

from texts import prose

from marlstone.llm import html_extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head>
<body class="x"><header><h2>Site</h2></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">Accept</div>
{body}<aside><p>side</p></aside><div id="comments"><p>a reader wrote</p></div><form><label>Name</label><input name="q"></form>
<footer>&copy; here</footer></body></html>"""


def plain(page):
    inside = re.sub(r"<!--.*?-->", "", page[page.index("<article>") + 9 : page.index("</article>")])
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    wanted = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    rows = html_extraction.extract_pages(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == wanted
    assert all(r.n_chars == len(r.text) for r in rows)


def test_article_without_the_rest():
    body = "<article><h1>Title &amp; more</h1><p>One <b>two</b> <a href='x>y'>three</a><br>four<p>Five&nbsp;&lt;six&gt; 1 < 2<div class='ad'>buy</div><ul><li>a<li>b</ul><blockquote>said</blockquote><form>f</form></article>"
    assert html_extraction.extract_text(PAGE.format(body=body)) == "Title & more\n\nOne two three four\n\nFive <six> 1 < 2\n\na\n\nb\n\nsaid"


def test_pages_without_an_article_element():
    body = "<div class='wrap'><div class='story'><p>Long story text that goes on.</p><p>And on it goes.</p></div><div class='links'><p><a href='/'>other other other other other other</a></p></div></div>"
    assert html_extraction.extract_text(PAGE.format(body=body)) == "Long story text that goes on.\n\nAnd on it goes."
    assert html_extraction.extract_text(PAGE.format(body="<main><p>In main</p></main>")) == "In main"


def test_host_template_finds_the_changing_slot(spark):
    page = "<html><body><div class='box'><p>The same long words stand here on each and every page of this host, always.</p></div><div class='it'><p>{}</p></div></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(f"own text {k}" + " and more" * (k % 3))) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.extract_pages(pages).collect()} == {k: f"own text {k}" + " and more" * (k % 3) for k in range(6)}


def test_repeated_pages_of_a_host_keep_their_text(spark):
    page = PAGE.format(body="<article><h1>Copy</h1><p>Equal text.</p></article>")
    pages = spark.createDataFrame([(k, "http://h.example/a", page) for k in (1, 1, 2, 3)], "page_id long, url string, html string")
    assert {r.text for r in html_extraction.extract_pages(pages).collect()} == {"Copy\n\nEqual text."}


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


PLAIN = """<html><body><div class="a1"><p>The name of this place</p></div><table><tr><td><a href="/">one</a></td><td><a href="/b">two {k}</a></td></tr></table>
<div class="b2"><div class="c3"><h2>{title}</h2>{text}</div><div class="d4"><p><a href="/{k}">other story number {k} with a long title of its own</a></p></div></div><p>All rights are kept by the same people on all pages of it.</p></body></html>"""


def test_pages_without_telling_names(spark):
    """No article element, no class that says what it holds: only what changes from page to page tells."""
    texts = {k: [f"Story {k} goes on {prose(k, 30)}." for _ in range(1 + k % 4)] for k in range(40)}
    rows = [(k, f"https://x.example/{k}", PLAIN.format(k=k, title=f"Title {k}", text="".join(f"<p>{t}</p>" for t in texts[k]))) for k in texts]
    assert extracted(spark, rows) == {k: "\n\n".join([f"Title {k}", *texts[k]]) for k in texts}


def test_names_do_not_decide_alone(spark):
    """An article element that holds the site's fixed words only, and the story in a box called a widget."""
    page = "<html><body><article><p>About this site, always the same.</p></article><div class='widget'><p>{}</p></div></body></html>"
    rows = [(k, f"https://x.example/{k}", page.format(f"Told here is {prose(k, 40)}.")) for k in range(12)]
    assert extracted(spark, rows) == {k: f"Told here is {prose(k, 40)}." for k in range(12)}


def test_rare_paths_are_not_gathered_and_stay_in_the_text(spark):
    """Each page has a class of its own; adverts on several pages go, a word of theirs in one page's class does not."""
    page = "<html><body><div class='story'><p>{a}</p><div class='post-{slug}x'><p>{b}</p></div><figure><figcaption>{c}</figcaption></figure>{ad}</div></body></html>"
    slug = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))
    ad = lambda k: "<div class='promo'>Buy now</div>" if k % 3 == 0 else "<div class='share-prices'><p>Prices fell</p></div>" if k == 7 else ""
    rows = [(k, f"https://x.example/{k}", page.format(a=prose(k, 30), b=prose(k + 500, 20), c=f"Picture {k}", slug=slug(k), ad=ad(k))) for k in range(200)]
    wanted = {k: "\n\n".join([prose(k, 30), prose(k + 500, 20), f"Picture {k}", *(["Prices fell"] if k == 7 else [])]) for k in range(200)}
    assert extracted(spark, rows) == wanted
    parsed = html_extraction.parsed_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    template = html_extraction.host_templates(html_extraction.with_groups(parsed)).collect()
    assert len(template) == 1 and len(template[0].template) < 12


def test_deep_pages_do_not_grow_with_the_square(spark):
    assert extracted(spark, [(1, "http://h/", "<div class='x'>" * 20_000 + "deep")])[1] == "deep"


def test_edges(spark):
    rows = [(1, None, None, "a"), (2, "", "", "b"), (None, "no url", "just text", None), (4, "http://h/", "<article><p>cut <b>off", "c"), (5, "http://h/", "<article><p>cut</p><p cla", "c"), (6, "http://h/", "<p>" * 5000 + "deep", "d"), (7, "http://h/", "<article>" + "<p>word</p>" * 20_000, "e"), (8, "http://h/", "<<<>>> &am &#x41; &bogus;", "f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r.page_id: r.text for r in html_extraction.extract_pages(pages).collect()}
    assert len(found) == 8 and found[1] == found[2] == "" and found[4] == "cut off" and found[5] == "cut"
    assert found[7] == "\n\n".join(["word"] * 20_000) and found[None] == "just text"
    assert html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_prose_under_telling_class_words_stays(spark):
    """A class that only holds a word of menus and the like, and noscript, go if they repeat or are links, not else."""
    page = """<html><body><nav>menu</nav><article><p>{a}</p><div class='related-work'><p>{b}</p></div><div class='social-history'><h3>Past</h3><p>{c}</p></div><noscript><p>{d}</p></noscript>
<div class='share-us-now'><p>Tell all your friends about this</p></div><div class='related-reading'><p><a href='/{k}'>another story {k}</a></p></div><noscript>Please switch it on</noscript><div class='related-posts'><p>{e}</p></div></article></body></html>"""
    part = lambda k, n: prose(100 * k + n, 25)
    rows = [(k, f"https://x.example/{k}", page.format(k=k, **{x: part(k, n) for n, x in enumerate("abcde")})) for k in range(5)]
    assert extracted(spark, rows) == {k: "\n\n".join([part(k, 0), part(k, 1), "Past", part(k, 2), part(k, 3), "Please switch it on"]) for k in range(5)}
    fixed = [(k, u, h.replace(f"<noscript><p>{part(k, 3)}</p></noscript>", "")) for k, u, h in rows]
    assert extracted(spark, fixed) == {k: "\n\n".join([part(k, 0), part(k, 1), "Past", part(k, 2)]) for k in range(5)}


def test_headers_outside_an_article_go(spark):
    for page, own in (
        ("<html><body><header><h1>My Site</h1></header><p>{}</p><p>{}</p></body></html>", False),
        ("<html><body><div class='page'><header><h1>My Site</h1></header><p>{}</p><p>{}</p></div></body></html>", False),
        ("<html><body><div class='page'><header><h1>Own {n}</h1></header><p>{}</p><p>{}</p></div></body></html>", True),
        ("<html><body><header>My Site</header><article><header><h1>Own {n}</h1></header><p>{}</p><p>{}</p></article></body></html>", True),
    ):
        rows = [(k, f"https://x.example/{k}", page.format(prose(k, 30), prose(k + 50, 30), n=k)) for k in range(6)]
        assert extracted(spark, rows) == {k: "\n\n".join([*([f"Own {k}"] if own else []), prose(k, 30), prose(k + 50, 30)]) for k in range(6)}


def test_each_layout_of_a_host_has_its_own_template(spark):
    """A layout on one page in a hundred: its story stands where the other layout has its fixed words, and vice versa."""
    fixed = "The same long words stand here on each and every page of this host, always and at all times."
    usual = "<html><body><div class='u'><div class='pa'><p>{fixed}</p></div><div class='pb'><p>{text}</p></div></div></body></html>"
    other = "<html><body><div class='v'><div class='pc'><p>{text}</p></div><div class='pd'><p>{fixed}</p><p>{fixed} Really, {fixed}</p></div></div></body></html>"
    rows = [(k, f"https://x.example/{k}", (other if k % 100 == 3 else usual).format(fixed=fixed, text=prose(k, 12))) for k in range(600)]
    assert extracted(spark, rows) == {k: prose(k, 12) for k in range(600)}


def test_template_equals_that_of_plain_vectors(spark):
    """Occurrence vectors, their classes and the valid ones, recomputed from every page's parse."""
    r = random.Random(4)
    for trial in range(3):
        parts = ["<div class='a'><p>x{k}</p></div>", "<ul><li>one</li><li>two</li></ul>", "<div class='b'><section><p>y</p><p>z{k}</p></section></div>", "<table><tr><td>{k}</td></tr></table>", "<h2>t</h2>"]
        rows = [(k, "https://x.example/", "<html><body><div class='w'>" + "".join(r.choice(parts).format(k=k) for _ in range(r.randrange(1, 6))) + "<p>end</p></div></body></html>") for k in range(9)]
        pages = [html_extraction.parse(h) for _, _, h in rows]
        vectors, above, depth = {}, {}, {0: 0}
        for n, page in enumerate(pages):
            for k, i in enumerate(page.ids):
                vectors.setdefault(i, [0] * 9)[n] = page.counts[k]
                if k:
                    above[i] = page.ids[page.above[k]]
                    depth[i] = depth[above[i]] + 1
        kept = {i: tuple(v) for i, v in vectors.items() if i and sum(n > 0 for n in v) > 1}
        classes = {}
        for i, v in kept.items():
            classes.setdefault(v, []).append(i)
        valid = {0}
        for v, members in sorted(classes.items(), key=lambda c: (-sum(n > 0 for n in c[0]), min(depth[i] for i in c[1]))):
            if 2 * sum(n > 0 for n in v) > 9 or len(members) > 1:
                for i in sorted(members, key=depth.get):
                    if above[i] in valid:
                        valid.add(i)
        parsed = html_extraction.parsed_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
        found = html_extraction.host_templates(html_extraction.with_groups(parsed, 10)).collect()
        assert len(found) == 1 and set(found[0].template) == valid
