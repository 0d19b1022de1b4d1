"""Odd markup, linear time, and wrappers against a brute-force matcher."""

import random
import re
import time

import pytest

from ordergate.llm import html_wrapper as H


def text_of(source):
    return H.main_text(H.Page(source), set(), None)


@pytest.mark.parametrize("source, want", [
    ('<p>Alpha <svg class="i"/> beta</p><p>Gamma</p>', "Alpha beta Gamma"), ("<p>a<iframe/>b</p><p>c", "ab c"),
    ("<p>a <svg><text>no</text></svg> b", "a b"), ("<p title='a > b'>x</p>", "x"), ('<p title="a < b">x</p>', "x"),
    ('<p title="open>x</p><p>y', "x y"), ("<p>1 < 2 > 0 </ p>", "1 < 2 > 0 </ p>"), ("<a <p>x</p>", "x"), ("x<!-- a > b -->y<!---->z", "xyz"),
    ("<!doctype html><?xml a?>x", "x"), ("x<!-- never", "x"), ("x<! never", "x"), ("<p x='1' y=\"2\" z=3>q<br/>r", "q r")])
def test_odd_markup(source, want):
    assert text_of(source) == want


@pytest.mark.parametrize("source", [
    "<a " * 330_000, "<div>" * 100_000 + "x", "<div class=ad>" * 100_000 + "x" + "</div>" * 100_000, '<a "x"' * 150_000 + '">',
    "<a \"<'" * 150_000 + ">", "<p>x" * 100_000, "<b>x" * 100_000, "<li><a href=1>x</a>" * 50_000, "<!--" * 200_000, "<svg>" * 100_000])
def test_linear_time(source):
    start = time.process_time()
    page, wrapper = H.Page(source), H.Wrapper()
    wrapper.add(page)
    wrapper.add(H.Page(source.replace("x", "y")))
    H.main_text(page, wrapper.constants(page), wrapper.held)
    assert time.process_time() - start < 20


@pytest.mark.parametrize("name", "social navigation banner search promotion footer share alert".split())
def test_a_chapter_does_not_go_for_its_name(name):
    assert text_of(f"<article><h1>T</h1><section id={name}>Chapter.</section><p>End.</p></article>") == "T Chapter. End."
    assert text_of(f"<article><h1>T</h1><div class={name}><h2>H</h2><p>Chapter.</p></div></article>") == "T H Chapter."
    assert text_of(f"<article><h1>T</h1><div class={name}><p><a href=1>one</a> <a href=2>two</a></p></div></article>") == "T"
    assert text_of(f"<article><h1>T</h1><div class=ad><p>Buy</p></div><section class=comments><p>First!</p></section></article>") == "T"


def wrapped(sources):
    pages, wrapper = [H.Page(s) for s in sources], H.Wrapper()
    for p in pages:
        wrapper.add(p)
    wrapper = H.Wrapper(wrapper.state())
    return [H.main_text(p, wrapper.constants(p), wrapper.held) for p in pages], wrapper


def test_constants_of_the_host_decide_inside_an_article():
    """A named element whose text is the same on all pages goes, one in whose slots the pages differ stays; so do articles."""
    texts, _ = wrapped([f"<article><h1>T{i}</h1><div class=share><p>Tell your friends</p></div><div class=social><p>Life of {i}</p></div></article>"
                        "<article><p>Our mission</p></article>" for i in range(3)])
    assert texts == [f"T{i} Life of {i}" for i in range(3)]
    assert wrapped(["<article><p>same</p></article><article>as ever</article>"] * 3)[0] == ["same as ever"] * 3


def as_pattern(items):
    out = ""
    for x in items:
        out += (re.escape(x[1]) + " " if x[0] == "t" else "# " if x[0] == "s" else "(?:[^ ]+ )*" if x[0] == "*"
                else f"(?:{as_pattern(x[1])})" + x[0])
    return out


def random_page(rng):
    def block(depth):
        kind = rng.choice(["p", "p", "ul", "div", "hr", "span"])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{rng.choice('ab')}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind == "div" and depth:
            return "<div>" + "".join(block(depth - 1) for _ in range(rng.randint(0, 3))) + "</div>"
        return "<hr>" if kind == "hr" else f"<{kind}>{rng.choice('ab')}</{kind}>"
    return "<body><h1>t</h1>" + "".join(block(2) for _ in range(rng.randint(0, 5))) + "<footer>f</footer></body>"


@pytest.mark.parametrize("seed", range(30))
def test_the_expression_accepts_every_page_it_was_inferred_from(seed):
    """By a regular expression over token names, a matcher that knows nothing of alignment; in any order of pages and joined in parts."""
    rng = random.Random(seed)
    pages = [H.Page(random_page(rng)) for _ in range(6)]
    first, second = H.Wrapper(), H.Wrapper()
    for p in pages[:3]:
        first.add(p)
    for p in pages[3:]:
        second.add(p)
    first.join(H.Wrapper(second.state()))
    pattern = re.compile(as_pattern(first.items))
    for p in pages:
        assert pattern.fullmatch("".join(("#" if k == "s" else v) + " " for k, v in p.tokens)), H.shapes(first.items)


def test_longest_common_stretches_by_brute_force():
    """Stretches found are equal, in order and do not overlap; what both ends share is among them."""
    rng = random.Random(4)
    for _ in range(300):
        a, b = (rng.choices("abcdefg", k=rng.randint(0, 12)) for _ in range(2))
        got = H.matching(a, b)
        i = j = 0
        for x, y, n in got:
            assert x >= i and y >= j and a[x:x + n] == b[y:y + n]
            i, j = x + n, y + n
        if a and b and a[0] == b[0]:
            assert got[0][:2] == (0, 0)
        assert got[-1] == (len(a), len(b), 0)
    assert sum(n for _, _, n in H.matching(list("axbyc"), list("abc"))) == 3
