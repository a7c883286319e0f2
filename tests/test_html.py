import pytest

from tessera.functions.html import inner_html, parse
from tessera.functions.selectors import select


def body(src):
    return inner_html(parse(src).first("body"))


@pytest.mark.parametrize(
    "src, want",
    [
        ("<article><h1>T</h1><p><b>X<br><p>Y</p></article><footer>F</footer>", "<article><h1>T</h1><p><b>X<br/></b></p><p><b>Y</b></p></article><footer><b>F</b></footer>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<a>1<div>2<div>3</a>4</div>5</div>", "<a>1</a><div><a>2</a><div><a>3</a>4</div>5</div>"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b><b><b><b>x<p>y", "<b><b><b><b>x<p>y</p></b></b></b></b>"),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>d"),
        ("<table>x<tr><td>a</table>", "x<table><tbody><tr><td>a</td></tr></tbody></table>"),
        ("<table><thead><th>h<tbody><td>d<table><td>in</table></table>", "<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>d<table><tbody><tr><td>in</td></tr></tbody></table></td></tr></tbody></table>"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<p>a<div>b</div>c", "<p>a</p><div>b</div>c"),
        ("a</p>b", "a<p></p>b"),
        ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
        ("x<noscript><img src=x></noscript>", "x<noscript><img src=x></noscript>"),
        ("y<script>if (a<b) '</p>'</script>x", "y<script>if (a<b) '</p>'</script>x"),
        ("<p class='a' CLASS=b data-X=1 x>&amp;&lt;&copy &quot;</p>", '<p class="a" data-x="1" x="">&amp;&lt;© &#34;</p>'),
        ('<a href="?a=1&copy=2&amp;b">x</a>', '<a href="?a=1&amp;copy=2&amp;b">x</a>'),
        ("<pre>\n\nx</pre>", "<pre>\n\nx</pre>"),
        ("<!-- a -- b -->x<!>y<?php?>z", "x<!---->y<!--?php?-->z"),
        ("<select><option>1<option>2</select>", "<select><option>1</option><option>2</option></select>"),
        ("<textarea><b>x</textarea>y", "<textarea>&lt;b&gt;x</textarea>y"),
        ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ("<button>a<button>b", "<button>a</button><button>b</button>"),
        ("", ""),
        ("1 < 2 <3", "1 &lt; 2 &lt;3"),
        ("<p>x</body></html>y", "<p>xy</p>"),
    ],
)
def test_trees(src, want):
    assert body(src) == want


def test_head_and_attributes_of_html():
    doc = parse("<!doctype html><html lang=en><title>a &amp; b</title><meta x><link y><p>t")
    assert inner_html(doc) == '<!DOCTYPE html><html lang="en"><head><title>a &amp; b</title><meta x=""/><link y=""/></head><body><p>t</p></body></html>'
    assert inner_html(parse("<html a=1><body b=2><body c=3><html d=4>")) == '<html a="1" d="4"><head></head><body b="2" c="3"></body></html>'
    assert inner_html(parse("x<title>y</title>")).startswith("<html><head></head><body>x<title>")


PAGE = "<div id=m class='a b'><p>1</p><p class=x>2 <i>3</i></p><a href='/q.pdf' data-k='v w'>4</a><span></span></div><p>5</p>"


@pytest.mark.parametrize(
    "selector, want",
    [
        ("p", ["1", "2 3", "5"]), ("div p", ["1", "2 3"]), ("div > p.x", ["2 3"]), ("#m", ["12 34"]), (".a.b a", ["4"]), ("[data-k~='w']", ["4"]), ("a[href$='.pdf']", ["4"]),
        ("a[href^=\"/q\"], i", ["3", "4"]), ("p + p", ["2 3"]), ("p ~ a", ["4"]), ("p:first-child", ["1"]), ("div p:not(.x)", ["1"]), ("p:nth-child(2)", ["2 3", "5"]), ("p:last-of-type", ["2 3", "5"]),
        ("span:empty", [""]), ("p:has(i)", ["2 3"]), ("p:contains('5')", ["5"]), ("*[class*='x']", ["2 3"]), ("P", ["1", "2 3", "5"]), ("p[", []), ("", []), ("p >", []), ("::x", []), (">p", []),
    ],
)
def test_selectors(selector, want):
    assert [n.text() for n in select(parse(PAGE), selector)] == want
