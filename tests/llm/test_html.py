"""Operator 9 against pages whose main text is known, and against plain sums over the tree."""

import random
import time

import pytest

from tallyrill.llm import html_text
from tallyrill.llm.html_text import extract

LINKS = "<ul>" + "".join(f"<li><a href=/{k}>link {k}</a>" for k in range(5)) + "</ul>"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) + r.choice(["", "", "", ","]) for _ in range(n)).strip(",") + "."


def page(r):
    """A page and the text of its article."""
    wrap = r.choice(["article", "main", "div class=post", "div"])
    tag, want, body = wrap.split()[0], [], []
    junk = ["<nav>" + LINKS + "</nav>", "<div class='ad banner'>" + words(r, 12) + "</div>", "<aside><p>" + words(r, 40) + "</aside>", "<form><label>a</label><input><button>b</button></form>", "<script>x = '</p>';</script>", "<!-- <p>no -->"]
    for _ in range(r.randint(2, 7)):
        kind = r.randrange(6)
        text = words(r, r.randint(60, 120))
        if kind == 0:
            title = words(r, 4)
            body.append(f"<h2>{title}</h2><p>{text}")
            want += [title, text]
        elif kind == 1:
            body.append(f"<section><p id=x{kind}>{text}</p></section>")
            want.append(text)
        elif kind == 2:
            a, b = words(r, 5), words(r, 6)
            body.append(f"<ul><li>{a}<li><em>{b}</em></ul><p>{text}</p>")
            want += [a, b, text]
        elif kind == 3:
            body.append(r.choice(junk) + f"<p>{text}</p>")
            want.append(text)
        elif kind == 4:
            cut = text.split()
            body.append("<p>" + " \n ".join(cut[:20]) + " <span class=ad>no <span>no</span> no</span> &amp; " + " ".join(cut[20:]) + "</p>")
            want.append(" ".join(cut[:20]) + " & " + " ".join(cut[20:]))
        else:
            body.append(f"<blockquote><p>{text}<br></blockquote><div id=comments><p>{words(r, 30)}</p></div>")
            want.append(text)
    html = f"<html><body>{r.choice(junk)}<header><p>{words(r, 9)}</header><{wrap}>{''.join(body)}</{tag}>{r.choice(junk)}<footer>&copy; {words(r, 9)}</footer></body></html>"
    return html, "\n\n".join(want)


def test_known_articles():
    r = random.Random(1)
    for _ in range(300):
        html, want = page(r)
        assert extract(html) == want, html


def test_sums_are_those_of_the_tree():
    """Points, characters and links of each container, by a walk for each block."""
    r = random.Random(2)
    for _ in range(60):
        html, _ = page(r)
        read = html_text.Reader(html).read()
        own = {id(x): (x.chars, x.linked) for x in read.nodes}
        points, chars, linked = {}, {}, {}
        for node, text in read.blocks:
            if node.bad:
                continue
            at = node
            while at:
                chars[id(at)] = chars.get(id(at), 0) + len(text)
                at = at.up
        for x in read.nodes:
            at, bad = x, x.bad
            while at and not bad:
                linked[id(at)] = linked.get(id(at), 0) + own[id(x)][1]
                at = at.up
        assert points == {}
        for node, text in read.blocks:
            node.scored |= not node.bad
        for x in reversed(read.nodes):
            if x.up and not x.bad:
                x.up.chars += x.chars
                x.up.linked += x.linked
        for x in read.nodes:
            if not x.bad:
                assert x.chars == chars.get(id(x), 0) and x.linked == linked.get(id(x), 0)


def test_attributes_and_inline_parts():
    assert extract("<article><p class=bob's>one two three</p><p>it's four</p><p>five</p></article>") == "one two three\n\nit's four\n\nfive"
    assert extract("<article><p>a <span class=ad>x<span>y</span>z</span>b</p></article>") == "a b"
    assert extract("<article><p>a <span class=ad>x<p>b</article>") == "a"
    assert extract("<p title='a > b' hidden>no</p><p data-x=\"</p>\">yes") == "yes"


@pytest.mark.parametrize("tag", ["main", "div"])
def test_link_lists_go(tag):
    assert extract(f"<{tag}><div>prose, of some length, and more</div><div>{LINKS}</div></{tag}>") == "prose, of some length, and more"


def test_sections_without_article():
    r = random.Random(3)
    texts = [words(r, 50) for _ in range(4)]
    assert extract("<body><section><p>{}</p><p>{}</p></section><section><p>{}</p><p>{}</p></section></body>".format(*texts)) == "\n\n".join(texts)


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a b=\"x' " * 100_000, "<div>" * 100_000 + "deep" + "</div>" * 100_000, "<div>" * 50_000 + "<p>x, y" * 50_000, "<ul><li>" * 50_000, "<" * 300_000, "<span class=ad>" * 50_000 + "x" + "</span>" * 50_000])
def test_time_grows_with_length(page):
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 3
