import hashlib

from loomspark.llm import pages as G
from loomspark.llm.html import page_blocks, parse_page


def texts(html):
    return [b.text for b in page_blocks(html)]


def test_blocks():
    assert texts("<body><p>One <b>two</b>\n <a href=x>three</a></p><p>a &amp; b<!-- c --> d</p></body>") == ["One two three", "a & b d"]
    assert texts("<html><head><title>T</title></head><body>x<script>var a='<p>';</script>y<noscript><p>no</p></noscript><template><p>t</p></template></body>") == ["x", "y"]
    assert texts("<ul><li>one<li>two</ul><P CLASS=a>three<br>four") == ["one", "two", "threefour"]
    assert texts(None) == [] and texts("") == [] and texts("<") == ["<"]
    assert texts("<p>" + "a " * 300_000 + "</p>") == [("a " * 300_000).strip()]
    assert parse_page("<title> a \n b </title><p>x")[1] == "a b"


def test_marks():
    b = page_blocks("<nav><p>menu</p></nav><h2>More</h2><ul><li><a href=1>One more</a></li></ul><p><span>Share</span> <span>Print</span></p><p><a href=a>Home</a> &gt; <a href=b>Shop</a> &gt; thing</p><p>Text with <a href=x>link</a> in it</p>")
    assert G.marks(b) == [True, True, True, True, True, False]


def test_unfilled_and_messages():
    for t in ("{{ title }}", "Price: ${price}", "%SHOP%", "__NAME__!", "<%= item.name %>", "[INSERT TITLE HERE]", "Lorem ipsum dolor sit amet", "text sample dummy text", "...", "null"):
        assert G.unfilled(t), t
    for t in ("Write {{ title }} in the template to print the name of the page.", "The lamp costs 40 dollars.", "Designers often use lorem ipsum as filler before the copy is ready."):
        assert not G.unfilled(t), t
    for t in ("404 – page not found", "Please enable JavaScript to view this page.", "Zugriff verweigert", "La página que busca ya no existe.", "Your text goes here."):
        assert G.message(t), t
    for t in ("An “access denied” note only means that the session has run out.", "Esta casa necesita muy poco mantenimiento.", "473 g"):
        assert not G.message(t), t


def page(i, body, lang="en", site="Shop"):
    return f'<html lang="{lang}"><head><title>Thing {i} | {site}</title></head><body><nav><a href=/>Home</a></nav><div>We use cookies on this site.</div>{body}<footer><p>Imprint</p></footer><div>© 2026 {site}. All rights reserved.</div></body></html>'


def fixture(spark):
    rows = []
    for i in range(60):
        rows.append(("pages", i, f"https://s{i}.example/x", page(i, f"<h1>Thing {i}</h1><p>Sentence of its own {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} stands here.</p>", site=f"Shop{i}")))
    rows.append(("pages", 100, "https://e.example/1", page(0, "<h1>404 – page not found</h1>")))
    rows.append(("pages", 101, "https://e.example/2", page(0, "<h1>Ordinary</h1><p>{{ body }}</p><p>Lorem ipsum dolor sit amet elit.</p>")))
    rows.append(("pages", 102, "https://e.example/3", page(0, "<h1>Ordinary</h1><p>{{ body }}</p><p>But this page has a sentence of its own.</p>")))
    rows.append(("pages", 103, "https://e.example/4", None))
    rows.append(("responses", 100, "https://e.example/5", page(0, "<h1>Response</h1><p>With a body.</p>")))
    rows.append(rows[0])
    return spark.createDataFrame(rows, "origin string, row_id bigint, url string, html string"), rows


def test_main_bodies(spark):
    df, rows = fixture(spark)
    got = {}
    for r in G.main_bodies(df).collect():
        got.setdefault((r[0], r[1]), set()).add(r[2])
    md5 = lambda *t: {hashlib.md5(x.encode()).hexdigest() for x in t}
    for i in range(60):
        assert got["pages", i] == md5(f"Thing {i}", f"Sentence of its own {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} stands here.")
    assert ("pages", 100) not in got and ("pages", 101) not in got and ("pages", 103) not in got
    assert got["pages", 102] == md5("Ordinary", "{{ body }}", "But this page has a sentence of its own.")
    assert got["responses", 100] == md5("Response", "With a body.")


def test_residue(spark):
    df, _ = fixture(spark)
    assert sorted(r[0] for r in G.residue_pages(df.filter("origin = 'pages'")).collect()) == [100, 101]


def test_error_templates_are_learned(spark):
    """A text on many pages that never stands beside others is an error template, whatever its wording."""
    rows = [("pages", i, f"https://s{i}.example/", f"<html lang=en><body><p>Zorp glitch {i} gone, call Bob</p>{'<p>Retry soon please</p>' if i % 2 else ''}</body></html>") for i in range(6)]
    rows += [("pages", 100 + i, f"https://t{i}.example/", f"<html lang=en><body><p>Thing {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} has a sentence</p><p>Retry soon please</p></body></html>") for i in range(3)]
    rows += [("pages", 200 + i, f"https://u{i}.example/", f"<html lang=en><body><p>Words {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]} of a page</p></body></html>") for i in range(200)]
    got = {r[0] for r in G.residue_pages(spark.createDataFrame(rows, "origin string, row_id bigint, url string, html string")).collect()}
    assert {0, 2, 4} <= got and not {100, 101, 102, 200} & got


def test_lines_of_one_site(spark):
    """A line on half of a site's pages is a template line, though few pages of the language have it."""
    rows = [("pages", i, "https://one.example/p", f"<html lang=en><body><p>We ship to you</p><p>Own words {'abcdefghij'[i]}{'klmnopqrst'[i]} here</p></body></html>") for i in range(6)]
    rows += [("pages", 100 + i, f"https://t{i}.example/", f"<html lang=en><body><p>Page {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]} of a site</p></body></html>") for i in range(300)]
    df = spark.createDataFrame(rows, "origin string, row_id bigint, url string, html string")
    got = {(r[1], r[2]) for r in G.main_bodies(df).collect()}
    line = hashlib.md5(b"We ship to you").hexdigest()
    assert len(got) == 306 and not any(m == line for _, m in got)


def test_ratios(spark):
    """Long lines beside short ones of many tags are the cluster of content; equal ratios are one cluster."""
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(8))
    html = f"<body><ul>{menu}</ul><p>{'A long sentence of the page. ' * 8}</p><p>{'Another long one stands here. ' * 8}</p><ul>{menu}</ul></body>"
    df = spark.createDataFrame([("pages", 1, "u", html), ("pages", 1, "u", html), ("pages", 2, "u", None), ("pages", 3, "u", ""), ("pages", 4, "u", "<p>one</p>")], "origin string, row_id bigint, url string, html string")
    got = {(r[1], r[2]) for r in G.ratio_bodies(df).collect()}
    md5 = lambda t: hashlib.md5(t.strip().encode()).hexdigest()
    assert {(1, md5("A long sentence of the page. " * 8)), (1, md5("Another long one stands here. " * 8)), (4, md5("one"))} == got


def test_empty(spark):
    df = spark.createDataFrame([], "origin string, row_id bigint, url string, html string")
    assert G.ratio_bodies(df).count() == 0
    assert G.main_bodies(df).count() == 0 and G.residue_pages(df).count() == 0
