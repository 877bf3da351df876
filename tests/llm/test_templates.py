"""The template of a host against one deduced from occurrence vectors gathered in plain Python."""

import random
from collections import Counter, defaultdict

from curatrix.llm import html_text

SCHEMA = "page_id long, url string, html string"


def test_classes_nest_in_slots():
    tokens = [("root", 10, k, k / 10) for k in (1, 3, 5, 7)] + [("in", 8, 31, 0.32), ("in", 8, 33, 0.38), ("deep", 6, 320, 0.34), ("deep", 6, 321, 0.35), ("wide", 6, 60, 0.6), ("wide", 6, 20, 0.2)]
    tree = html_text.nested(tokens)
    assert tree[0] == (-1, 0, [1, 3, 5, 7])
    assert set(map(str, tree[1:])) == {"(0, 2, [31, 33])", "(1, 1, [320, 321])", "(0, 1, [20])", "(0, 3, [60])"}
    assert html_text.nested([]) == []
    assert html_text._rising([3, 1, 2, 0, 5, 4]) == [1, 2, 5]


def pages_of(rng, host, n):
    """Pages without article or main elements; what is written by hand into every page is its template."""
    rows = []
    for k in range(n):
        own = [f"{host} story {k} part {j} " + " ".join(rng.choice("abcdefgh") for _ in range(20)) for j in range(rng.randint(2, 5))]
        promo = "<p>Read our best pieces</p><p>Every week anew</p>" if rng.random() < 0.7 else ""
        body = "".join(f"<p>{t}</p>" for t in own)
        half = body.find("</p>") + 4
        html = f'<html><body><div class="top"><p>Welcome to {host}</p></div><div class="text">{body[:half]}{promo}{body[half:]}<p>Say it to {host}</p></div><div class="end"><p>All rights of {host}</p></div></body></html>'
        rows.append((len(rows), f"https://{host}.example.org/{k}", html))
    return rows


def plain_template(rows, support=5, share=0.5):
    """(template text tokens, main container) of one host from exact occurrence vectors."""
    vectors, chars, kinds = defaultdict(Counter), Counter(), {}
    for page, _, source in rows:
        parsed = html_text.Page(source)
        for path, *_ in parsed.tags:
            vectors["tag", path][page] += 1
        for text, container, *_ in parsed.blocks:
            path = parsed.containers[container][1]
            vectors["text", path, text][page] += 1
            chars[path] += len(text)
    vectors["page",] = Counter(r[0] for r in rows)
    classes = defaultdict(list)
    for token, vector in vectors.items():
        classes[tuple(sorted(vector.items()))].append(token)
    fixed = {t for vector, tokens in classes.items() if len(tokens) > 1 and len(vector) >= max(support, share * len(rows)) for t in tokens if t[0] == "text"}
    for _, path, text in fixed:
        chars[path] -= len(text) * sum(vectors["text", path, text].values())
    return fixed, max(chars, key=lambda p: (chars[p], p))


def around(parsed, container):
    """Tokens of a container and of all those around it."""
    while container >= 0:
        container, token, _ = parsed.containers[container]
        yield token


def test_template_equals_one_of_plain_vectors(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for host in ("one", "two"):
        own = [(len(rows) + k, url, html) for k, (_, url, html) in enumerate(pages_of(rng, host, 20))]
        rows += own
        fixed, main = plain_template(own)
        assert {t[2] for t in fixed} == {f"Welcome to {host}", f"Say it to {host}", f"All rights of {host}", "Read our best pieces", "Every week anew"}
        for page, _, source in own:
            parsed = html_text.Page(source)
            expected[page] = "\n".join(b[0] for b in parsed.blocks if main in around(parsed, b[1]) and ("text", parsed.containers[b[1]][1], b[0]) not in fixed)
            assert "story" in expected[page] and "Welcome" not in expected[page] and "Say it" not in expected[page]
    few = [(900 + k, "https://few.example.org/", f"<html><body><p>Top</p><p>text {k}</p></body></html>") for k in range(3)]
    pages = spark.createDataFrame(rows + few, SCHEMA)
    for frame in (pages.coalesce(1), pages.repartition(6, "html")):
        got = {r["page_id"]: r["text"] for r in html_text.extract_text(frame).collect()}
        assert {k: v for k, v in got.items() if k < 900} == expected
        assert got[901] == "Top\ntext 1"  # three pages make no template: the element rules alone
    plain = {r["page_id"]: r["text"] for r in html_text.extract_text(pages, support=10**6).collect()}
    assert all(plain[k] != got[k] for k in expected)  # the template decides every page of the two hosts


def test_blocks_out_of_order_stay(spark):
    """A text block of the template that stands in another slot than the template's is the page's own."""
    page = '<html><body><div class="w"><h2>Top</h2><p>Rule one</p><h3>Middle</h3><p>{x}</p><h4>End</h4></div></body></html>'
    rows = [(k, "http://h/", page.format(x=f"story {k} told at length")) for k in range(12)]
    odd = '<html><body><div class="w"><h2>Top</h2><h3>Middle</h3><p>a story</p><h4>End</h4><p>Rule one</p></div></body></html>'
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame([*rows, (99, "http://h/", odd)], SCHEMA)).collect()}
    assert got[3] == "story 3 told at length" and got[99] == "a story\nRule one"


def nested_hosts(levels, votes):
    """Eight pages of a host whose teaser and article lie side by side below many wrappers, some with names that vote against them."""
    wrapper = ["<div>"] * levels
    for k in range(votes):
        wrapper[k * levels // max(1, votes)] = f'<div class="sidebar{chr(97 + k % 26)}">'
    shut = "</div>" * levels
    page = "<html><body>{open}<div class='t'><p>Teaser of {k} with some words of its own</p></div><div class='a'><p>Story {k} " + "told at length " * 40 + "</p><p>End of {k}</p></div>{shut}</body></html>"
    return [(k, "http://deep/", page.format(open="".join(wrapper), shut=shut, k=k)) for k in range(8)]


def test_depth_of_nesting_changes_nothing(spark):
    read = lambda rows: {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    shallow = read(nested_hosts(2, 0))
    assert all("Teaser" not in t and "Story" in t and "End of" in t for t in shallow.values())
    assert read(nested_hosts(150, 0)) == read(nested_hosts(20_000, 0)) == shallow


def test_all_names_around_a_block_vote():
    for depth in (5, 600):
        parsed = html_text.Page("".join(f'<div class="sidebar x{chr(97 + k % 26) * (1 + k // 26)}">' for k in range(depth)) + "<p>1234567890</p>")
        assert len(parsed.votes) == depth and set(parsed.votes.values()) == {10}
