import random
import re
from collections import Counter

import pytest

from plumbline.llm import html_extraction
from plumbline.llm.html_extraction import MIN_PAGES, content_key, extract_pages, main_text, page_tokens, parse, templates, token_hashes


def _page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


def test_article_without_what_is_around_it():
    page = _page(
        "<header>top</header><nav><ul><li><a href='/a'>menu</a></li></ul></nav><div class='ad'>buy</div><article><h1>Title &amp; more</h1><p><b>One  two<br><p>three</p>"
        "<div class='comments'><p>me too</p></div><aside>side</aside><form>mail</form><script>var t='</p>';</script><!-- <p>no</p> --></article><footer>&copy; end</footer>"
    )
    assert main_text(parse(page)[0]) == "Title & more One two three"


def test_inline_markup_adds_no_space_and_cut_pages_end():
    assert main_text(parse(_page("<article><p>a<b>b</b>c&#233;</p><p>d</p></article>"))[0]) == "abcé d"
    assert main_text(parse("<html><body><article><p>kept</p><p>cut of")[0]) == "kept cut of"
    assert main_text(parse("plain text")[0]) == "plain text"
    assert main_text(parse("")[0]) == ""


def test_template_text_of_pages_without_articles(spark):
    page = lambda i: _page(f"<div><div class='a'>Welcome to the site</div><div class='b'><p>Body number {i} has words of its own.</p></div><div class='c'>All the same</div></div>")
    rows = [(i, "http://h.example/" + str(i), page(i)) for i in range(6)] + [(9, None, None), (10, "http://other.example/", ""), (11, "http://h.example/5", page(5))]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Body number 3 has words of its own." and got[11].text == got[5].text
    assert got[9].text == got[10].text == "" and got[9].n_chars == 0 and len(got) == 9


def test_copies_on_a_host_keep_their_text(spark):
    page = _page("<article><p>Same article everywhere.</p></article>")
    rows = [(i, "http://h.example/x", page) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in extract_pages(df).select("text").distinct().collect()} == {"Same article everywhere."}
    assert extract_pages(df.where("page_id < 0")).count() == 0


def test_texts_of_an_article_stay_though_other_pages_share_them(spark):
    words = "red blue green amber white black brown pink".split()
    comment = lambda i, k: f"<li><b>Reply</b><i>{words[(i + k) % 8]} said {i * 10 + k}</i></li>"
    page = lambda i: _page(f"<nav>go</nav><article><h1>Daily weather {i}</h1><p>Skies will be clear.</p><p>The {words[i]} story is number {i} of all.</p><ul>{''.join(comment(i, k) for k in range(i + 1))}</ul></article>")
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)] + [(7, "http://one.example/", page(0))]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Daily weather 1 Skies will be clear. The blue story is number 1 of all. Replyblue said 10 Replygreen said 11"
    assert got[7] == got[0] == "Daily weather 0 Skies will be clear. The red story is number 0 of all. Replyred said 0"


def test_classes_cut_slots_that_nest_without_articles(spark):
    words = "red blue green amber white black brown pink".split()
    item = lambda i, k: f"<li><b>Reply</b><i>{words[(i + k) % 8]} said {i * 10 + k}</i></li>"
    page = lambda i: _page(f"<nav>go</nav><div><h1>On {words[i]}</h1><p>Read all of our stories.</p><p>The {words[i]} story is number {i} of all.</p><ul>{''.join(item(i, k) for k in range(i + 1))}</ul></div>")
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)] + [(7, "http://one.example/", page(0))]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "On blue The blue story is number 1 of all. blue said 10 green said 11"
    assert got[7] == "On red Read all of our stories. The red story is number 0 of all. Replyred said 0"


#: What stands inside an article, and whether it is of it.
INSIDE = [
    ("<div class='legal notice'><p>The court gave its notice on Monday.</p></div>", True),
    ("<section class='alert'><p>The storm reached the coast at noon.</p></section>", True),
    ("<div class='menu'><p>Soup of the day, bread and three sorts of cheese.</p></div>", True),
    ("<menu><li>Soup</li><li>Bread</li></menu>", True),
    ("<div class='menu'><a href='/a'>All stories</a> <a href='/b'>Sport</a></div>", False),
    ("<div class='body comment'><p>An editor explains the vote.</p></div>", True),
    ("<div class='comment'><p>first!</p></div><div class='comment'><p>me too</p></div>", False),
    ("<section id='comments'><p>nice read</p></section>", False),
    ("<p>Choose <select><option>the left door</option></select> now</p>", True),
    ("<object data='x.swf'>The film shows a door.</object>", True),
    ("<noscript><p>A picture of the door.</p></noscript>", True),
    ("<form><select><option>en</option></select></form>", False),
    ("<div class='ad'>Buy a door</div>", False),
    ("<div class='share-buttons social'>Share it</div>", False),
    ("<aside>More doors</aside>", False),
    ("<header><p>By our reporter</p></header>", True),
    ("<footer>Filed under doors</footer>", False),
    ("<div role='alert'>The bridge is closed.</div>", True),
    ("<div role='navigation'>Up</div>", False),
    ("<p><a href='/x'>The whole report can be read here.</a></p>", True),
    ("<script>var x = 1</script><style>p{}</style><iframe>no</iframe>", False),
]


@pytest.mark.parametrize(("part", "stays"), INSIDE)
def test_parts_of_articles(part, stays):
    got = main_text(parse(_page(f"<nav>top</nav><article><h1>Of doors</h1><p>There are many doors in the old town.</p>{part}<p>They are all shut.</p></article><div class='menu'>low</div>"))[0])
    words = re.sub(r"<[^>]*>", " ", part).split()
    assert got.split() == ["Of", "doors", *"There are many doors in the old town.".split(), *(words if stays else []), *"They are all shut.".split()]


def test_teasers_beside_the_article():
    teasers = "<div class='teasers'><article><h2>Another story</h2><p>Teaser text.</p></article></div>"
    story = "<article><h1>The story</h1><p>It has more words than what stands beside it.</p></article>"
    for body in (story + teasers, teasers + story, f"<main>{story}</main>{teasers}"):
        assert main_text(parse(_page(body))[0]) == "The story It has more words than what stands beside it."
    assert main_text(parse(_page("<div><article><p>one</p></article><article><p>two two</p></article></div>"))[0]) == "one two two"


def test_links_where_no_article_is():
    body = "<div><p>Some words before it.</p><p><a href='/x'>A paragraph that is one link.</a></p><p>Some words after.</p></div><ul><li><a href='/a'>a</a></li><li><a href='/b'>b</a></li></ul><p><a href='/c'>c</a></p>"
    assert main_text(parse(_page(body))[0]) == "Some words before it. A paragraph that is one link. Some words after."


def test_notices_of_a_template_go_from_articles(spark):
    page = lambda i: _page(f"<article><h1>Story {i}</h1><div class='notice'>We moved to a new house.</div><p>Text {i} of the story.</p><div class='notice'>Notice {i} was read aloud.</div></article>")
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(5)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Story 2 Text 2 of the story. Notice 2 was read aloud."


def test_templates_that_are_not_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.example/{i}", _layout(i, ["red", "blue", "green", "pink"])) for i in range(14)] + [(50, None, None), (51, "http://one.example", _layout(1, ["a"])), (52, "http://h0.example/0", _layout(0, ["red", "blue", "green", "pink"]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    near = sorted(map(tuple, extract_pages(df).collect()))
    monkeypatch.setattr(html_extraction, "BROADCAST_TOKENS", -1)
    assert sorted(map(tuple, extract_pages(df).collect())) == near


def test_articles_and_layouts_of_a_site_in_figures(spark):
    """60 pages of three layouts without an article element: words found of the expected texts, and found words that are of them."""
    rng, rows, want = random.Random(4), [], {}
    say = lambda n: " ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.randrange(40)}" for _ in range(n))
    for i in range(60):
        title, parts = say(4), [say(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6))]
        text = "".join(f"<p>{p}</p>" for p in parts)
        layout = [
            f"<div id='a1'>The Daily Door</div><div id='a2'><a href='/1'>Home</a> <a href='/2'>Sport</a></div><div id='a3'><h1>{title}</h1>{text}</div><div id='a4'>Printed in the old town</div>",
            f"<table><tr><td><ul><li><a href='/{say(1)}'>{say(2)}</a></li><li><a href='/x'>{say(2)}</a></li></ul></td><td><h1>{title}</h1>{text}<span>All rights with us</span></td></tr></table>",
            f"<div class='q'><div class='r'>Doors and more doors</div><h1>{title}</h1>{text}<div class='s'>Read on every day</div></div>",
        ][i % 3]
        want[i] = f"{title} {' '.join(parts)}".split()
        rows.append((i, f"http://h{i % 3}.example/{i}", _page(layout)))
    got = {r.page_id: r.text.split() for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    both = sum((Counter(want[i]) & Counter(got[i])).total() for i in want)
    assert both / sum(map(len, want.values())) == 1 and both / sum(map(len, got.values())) == 1


def test_copies_of_an_article_count_once(spark):
    page = lambda i: _page(f"<p class='top'>visit {i}</p><article><h1>One title</h1><p>The same long article under many addresses.</p></article>")
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in got.select("text").collect()} == {"One title The same long article under many addresses."}


def _layout(i, host_words):
    """A page without article: only the template tells its parts."""
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in host_words[i % 3 :])
    return _page(
        f"<div class='x1'>Our fine paper</div><div class='x2'><ul>{links}</ul></div><div class='x3'><h2>Story {i}</h2><p>Text {i} of many words {i * 7}.</p><p>More of {i}.</p></div>"
        f"<div class='x4'>Printed by us <b>each day</b></div>"
    )


def test_templates_equal_a_brute_force_builder(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", _layout(i, ["red", "blue", "green", "pink"])) for i in range(14)] + [(50, "http://h0.example/1", _layout(0, ["red", "blue", "green", "pink"])), (51, "http://one.example", _layout(1, ["a"]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {}
    for host in ("h0.example", "h1.example", "one.example"):
        pages = {}
        for _, url, html in rows:
            if f"//{host}" in url:
                texts, stream = parse(html)
                pages.setdefault(content_key(texts), stream)
        vectors, first, counts = {}, {}, {}
        for key, stream in pages.items():
            for i, t in enumerate(stream):
                vectors.setdefault(t, {})[key] = stream.count(t)
                first.setdefault(t, {}).setdefault(key, i)
                counts[t] = max(counts.get(t, 0), stream.count(t))
        classes = {}
        for t, v in vectors.items():
            if len(v) >= MIN_PAGES:
                classes.setdefault(tuple(sorted(v.items())), []).append(t)
        kept = []
        for v, own in classes.items():
            tags = [t for t in own if "\0" not in t]
            if (tags and len(own) > 1) or (not tags and max(counts[t] for t in own) == 1 and 2 * len(v) >= len(pages)):
                kept.append(sorted(own, key=lambda t: sum(first[t].values()) / len(v)))
        if kept:
            want[host] = {tuple(token_hashes(c)) for c in kept}
    got = {r.host: {tuple(t.t for t in c) for c in r.classes} for r in templates(page_tokens(df)).collect()}
    assert got == want and len(got) == 2
    texts = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert all(texts[i] == f"Story {i} Text {i} of many words {i * 7}. More of {i}." for i in range(14)) and texts[50] == texts[0]


def test_a_page_reads_the_same_on_hosts_of_any_size(spark):
    one = (0, "http://h.example/0", _layout(0, ["red", "blue", "green", "pink"]))
    for n in (3, 40, 400):
        rows = [one] + [(i, f"http://h.example/{i}", _layout(i, ["red", "blue", "green", "pink"])) for i in range(1, n)]
        got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got[0] == "Story 0 Text 0 of many words 0. More of 0." and len(got) == n


def test_odd_pages(spark):
    long = _page("<article>" + "<p>a long page of words</p>" * 30_000 + "</article>")
    rows = [(1, None, "<p>x</p>", 1), (1, None, "<p>x</p>", 1), (2, "http://h", long, 2), (None, "http://h", "", 3), (3, "not a url", "<<<>>><p", 4)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r.text for r in got.collect()}
    assert found[1] == "x" and len(found[2].split()) == 150_000 and found[None] == "" and got.count() == 5
