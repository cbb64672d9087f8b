"""Main text of pages."""

from __future__ import annotations

import html as entities
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import html_text as X

LONG = "Many words make this paragraph long enough to be the text of the page. " * 3


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize("source", [None, "", "   ", "<html></html>", "<script>x</script>", "<!-- only -->"])
def test_nothing_gives_nothing(source):
    assert X.main_text(source) == ""


def test_boilerplate_is_left_out():
    body = (
        "<nav><a href=/a>Home</a></nav><header><h2>Site name</h2></header><div class='cookie-notice'>We use cookies</div><form>Search <input></form>"
        f"<article><h1>Title</h1><p>{LONG}</p><aside>Related</aside><div class=\"ad\">Buy</div><p>Second &amp; last &#233;.</p></article>"
        "<section id='comments'><p>Great article, thank you very much for writing it!</p></section><div id=sidebar>Side</div><footer>(c)</footer>"
    )
    assert X.main_text(page(body)) == "\n\n".join(["Title", LONG.strip(), "Second & last é."])


def test_names_that_only_sound_like_boilerplate():
    body = f"<div class='layout no-sidebar has-comments'><article class='post with-ad'><p>{LONG}</p></article><article class='comment'><p>Me too</p></article></div>"
    assert X.main_text(f"<body class='menu'>{body}</body>") == LONG.strip()


def test_density_finds_unmarked_content():
    links = "".join(f"<li><a href='/{k}'>Link number {k}</a></li>" for k in range(30))
    body = f"<div><ul>{links}</ul></div><div><div><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div></div><div><ul>{links}</ul></div>"
    assert X.main_text(page(body)) == "\n\n".join([LONG.strip(), LONG.strip(), "Short."])


def test_unclosed_and_truncated_markup():
    assert X.main_text("<body><article><p><b>One<br><p>Two <i>x") == "One\n\nTwo x"
    assert X.main_text("<p>a<p>b<ul><li>c<li>d</ul>") == "a\n\nb\n\nc\n\nd"
    assert X.main_text("<div><p>cut <a href='x") == "cut"


def test_white_space_and_character_references():
    assert X.main_text("<p>a\n  b\t&nbsp;c&lt;d&gt; &am &amp</p>") == "a b c<d> &am &"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs", "Cc"]), min_size=1, max_size=40), min_size=1, max_size=6))
def test_round_trip_of_paragraphs(paragraphs):
    body = "".join(f"<p>{entities.escape(p)}</p>" for p in paragraphs)
    expected = [" ".join(entities.unescape(entities.escape(p)).split()) for p in paragraphs]
    assert X.main_text(page(f"<article>{body}</article>")) == "\n\n".join(e for e in expected if e)


def test_deep_and_large_pages():
    assert X.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(X.main_text(page("<article>" + f"<p>{LONG}</p>" * 2000 + "</article>"))) > 400_000


def test_query_against_plain_split(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in X.extract(rows).collect()}
    for row in rows.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.S)[1]
        parts = re.split(r"</?p>|</?h1>", article)
        texts = [" ".join(entities.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in parts]
        assert got[row["page_id"]] == "\n\n".join(t for t in texts if t)


def test_table_cases(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>é</p>", "y")], "page_id long, url string, html string, text string")
    made = X.extract(rows).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in made) == [("1", ""), ("1", ""), ("None", "é")]
    assert X.extract(rows.limit(0)).collect() == []


def test_attributes_are_read_as_browsers_do():
    assert X.main_text("<p class=it's>first</p><p>second isn't lost</p>") == "first\n\nsecond isn't lost"
    assert X.main_text('one <a href="foo>link') == "one link"
    found, end = X.attributes(" a=1 b = 'x y' c=\"<p>\" d e=&amp;/>rest", 0)
    assert found == [("a", "1"), ("b", "x y"), ("c", "<p>"), ("d", ""), ("e", "&/")] and end == 34


def test_names_of_article_parts_are_kept():
    body = f'<article><p>{LONG}</p><div class="notice-period"><p>Two weeks.</p></div><p>Press <label>Enter</label> now</p><div class="post-comments"><p>Nice</p></div></article>'
    assert X.main_text(page(body)) == "\n\n".join([LONG.strip(), "Two weeks.", "Press Enter now"])


def test_text_that_is_all_marked_is_still_found():
    assert X.main_text(page("<div class=widget><p>All there is.</p></div>")) == "All there is."


def test_hundred_thousand_nested_elements():
    for source in ("<div>" * 100_000 + "deep" + "</div>" * 100_000, "<p><button><div>" * 30_000 + "deep", "<b><p>" * 50_000 + "deep", "<ul><li>" * 50_000 + "deep"):
        begin = time.perf_counter()
        X.main_text(source)
        assert time.perf_counter() - begin < 20


def plain_sums(root):
    """Weighed density sums of all standing nodes below the body, from counts made anew for each node."""
    nodes = X.live(root)
    standing = [n for n in nodes if n.stands]
    body = next((n for n in standing if n.tag == "body"), root)

    def chain(node):
        while node is not None:
            yield node
            node = node.holder

    own = {id(n): 0 for n in standing}
    for n in nodes:
        own[id(n if n.stands else n.holder)] += sum(len(re.sub(r"\s", "", part)) for part in n.content if isinstance(part, str))
    below = lambda top: [n for n in standing if top in chain(n)]

    def counts(top):
        inside = below(top)
        linked = [n for n in inside if any(c.tag in X.LINKS for c in chain(n) if c in inside)]
        return sum(own[id(n)] for n in inside), len(inside) - 1, sum(own[id(n)] for n in linked), len(linked)

    chars, _, link_chars, _ = counts(body)
    value = lambda *c: X.density(*c, link_chars / max(chars, 1))
    sums = [(n, (value(own[id(n)], 1, 0, 0) + sum(value(*counts(c)) for c in standing if c.holder is n)) * (2 if any(c.article for c in chain(n)) else 1)) for n in below(body)]
    return body, sums


def random_page(rng):
    def part(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return f"<p>{' '.join('word' for _ in range(rng.randint(1, 40)))}<b>x</b></p>"
        if kind < 0.6:
            return f"<ul>{''.join(f'<li><a href=/{k}>link {k}</a></li>' for k in range(rng.randint(1, 5)))}</ul>"
        tag = rng.choice(["div", "section", "article", "span"])
        return f"<{tag}>loose {''.join(part(depth - 1) for _ in range(rng.randint(1, 4)))}</{tag}>"

    return page("".join(part(3) for _ in range(rng.randint(1, 4))))


@pytest.mark.parametrize("seed", range(25))
def test_the_densest_subtree_is_chosen(seed):
    root = X.parse(random_page(random.Random(seed)))
    body = X.measure(X.live(root))
    path, _ = X.choose(body)
    same, sums = plain_sums(root)
    assert body is same
    most = max(s for _, s in sums)
    assert next(s for n, s in sums if n is path[0]) == pytest.approx(most)


def test_density_decides_every_page(spark):
    """No page is cut out by its tags alone: each goes through the choice, and holds what is chosen."""
    decided = same = 0
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        root = X.parse(row["html"])
        body = X.measure(X.live(root))
        path, _ = X.choose(body)
        _, sums = plain_sums(root)
        decided += next(s for n, s in sums if n is path[0]) == pytest.approx(max(s for _, s in sums))
        # the same page without article tags
        plain = re.sub("(</?)article", r"\1div", row["html"])
        same += X.main_text(plain) == X.main_text(row["html"])
    n = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert decided == n and same >= 0.95 * n


@pytest.mark.parametrize("page", ['<div class="comments"><p>great</p></div>', '<div id="cookie-notice">We use cookies.</div>', "<nav><a href=a>Home</a></nav><footer>Contact</footer>"])
def test_pages_without_an_article_are_empty(page):
    assert X.main_text(f"<html><body>{page}</body></html>") == ""
