"""The Markdown parser against examples of the published specification."""

import pytest

from foliospark.functions import markdown

EXAMPLES = [
("\tfoo\tbaz\t\tbim\n","<pre><code>foo\tbaz\t\tbim\n</code></pre>\n"),
("  - foo\n\n\tbar\n","<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n"),
("- foo\n\n\t\tbar\n","<ul>\n<li>\n<p>foo</p>\n<pre><code>  bar\n</code></pre>\n</li>\n</ul>\n"),
(">\t\tfoo\n","<blockquote>\n<pre><code>  foo\n</code></pre>\n</blockquote>\n"),
("-\t\tfoo\n","<ul>\n<li>\n<pre><code>  foo\n</code></pre>\n</li>\n</ul>\n"),
("    foo\n\tbar\n","<pre><code>foo\nbar\n</code></pre>\n"),
(" - foo\n   - bar\n\t - baz\n","<ul>\n<li>foo\n<ul>\n<li>bar\n<ul>\n<li>baz</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n"),
("***\n---\n___\n","<hr />\n<hr />\n<hr />\n"),
("- foo\n***\n- bar\n","<ul>\n<li>foo</li>\n</ul>\n<hr />\n<ul>\n<li>bar</li>\n</ul>\n"),
("Foo\n***\nbar\n","<p>Foo</p>\n<hr />\n<p>bar</p>\n"),
("Foo\n---\nbar\n","<h2>Foo</h2>\n<p>bar</p>\n"),
("* Foo\n* * *\n* Bar\n","<ul>\n<li>Foo</li>\n</ul>\n<hr />\n<ul>\n<li>Bar</li>\n</ul>\n"),
("- Foo\n- * * *\n","<ul>\n<li>Foo</li>\n<li>\n<hr />\n</li>\n</ul>\n"),
("# foo\n## foo ##\n### foo \\###\n#5 bolt\n","<h1>foo</h1>\n<h2>foo</h2>\n<h3>foo ###</h3>\n<p>#5 bolt</p>\n"),
("Foo *bar\nbaz*\n====\n","<h1>Foo <em>bar\nbaz</em></h1>\n"),
("> Foo\n---\n","<blockquote>\n<p>Foo</p>\n</blockquote>\n<hr />\n"),
("> foo\nbar\n===\n","<blockquote>\n<p>foo\nbar\n===</p>\n</blockquote>\n"),
("- Foo\n---\n","<ul>\n<li>Foo</li>\n</ul>\n<hr />\n"),
("Foo\nBar\n---\n","<h2>Foo\nBar</h2>\n"),
("    a simple\n      indented code block\n","<pre><code>a simple\n  indented code block\n</code></pre>\n"),
("    chunk1\n\n    chunk2\n  \n \n \n    chunk3\n","<pre><code>chunk1\n\nchunk2\n\n\n\nchunk3\n</code></pre>\n"),
("Foo\n    bar\n","<p>Foo\nbar</p>\n"),
("```\n<\n >\n```\n","<pre><code>&lt;\n &gt;\n</code></pre>\n"),
("~~~~\naaa\n~~~\n~~~~\n","<pre><code>aaa\n~~~\n</code></pre>\n"),
("```\n\n```\naaa\n","<pre><code>\n</code></pre>\n<p>aaa</p>\n"),
("> ```\n> aaa\n\nbbb\n","<blockquote>\n<pre><code>aaa\n</code></pre>\n</blockquote>\n<p>bbb</p>\n"),
("   ```\n   aaa\n    aaa\n  aaa\n   ```\n","<pre><code>aaa\n aaa\naaa\n</code></pre>\n"),
("```ruby\ndef foo(x)\n  return 3\nend\n```\n","<pre><code class=\"language-ruby\">def foo(x)\n  return 3\nend\n</code></pre>\n"),
("<table>\n  <tr>\n    <td>\n           hi\n    </td>\n  </tr>\n</table>\n\nokay.\n","<table>\n  <tr>\n    <td>\n           hi\n    </td>\n  </tr>\n</table>\n<p>okay.</p>\n"),
("<div>\n*foo*\n\n*bar*\n","<div>\n*foo*\n<p><em>bar</em></p>\n"),
("<!-- Foo\n\nbar\n   baz -->\nokay\n","<!-- Foo\n\nbar\n   baz -->\n<p>okay</p>\n"),
("[foo]: /url \"title\"\n\n[foo]\n","<p><a href=\"/url\" title=\"title\">foo</a></p>\n"),
("[Foo*bar\\]]:my_(url) 'title (with parens)'\n\n[Foo*bar\\]]\n","<p><a href=\"my_(url)\" title=\"title (with parens)\">Foo*bar]</a></p>\n"),
("[foo]: /url\n===\n[foo]\n","<p>===\n<a href=\"/url\">foo</a></p>\n"),
("[foo]\n\n> [foo]: /url\n","<p><a href=\"/url\">foo</a></p>\n<blockquote>\n</blockquote>\n"),
("aaa\n             bbb\n","<p>aaa\nbbb</p>\n"),
("> # Foo\n> bar\n> baz\n","<blockquote>\n<h1>Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>\n"),
("> bar\nbaz\n> foo\n","<blockquote>\n<p>bar\nbaz\nfoo</p>\n</blockquote>\n"),
("> - foo\n- bar\n","<blockquote>\n<ul>\n<li>foo</li>\n</ul>\n</blockquote>\n<ul>\n<li>bar</li>\n</ul>\n"),
(">     foo\n    bar\n","<blockquote>\n<pre><code>foo\n</code></pre>\n</blockquote>\n<pre><code>bar\n</code></pre>\n"),
("> foo\n\n> bar\n","<blockquote>\n<p>foo</p>\n</blockquote>\n<blockquote>\n<p>bar</p>\n</blockquote>\n"),
("1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.\n","<ol>\n<li>\n<p>A paragraph\nwith two lines.</p>\n<pre><code>indented code\n</code></pre>\n<blockquote>\n<p>A block quote.</p>\n</blockquote>\n</li>\n</ol>\n"),
("- one\n\n two\n","<ul>\n<li>one</li>\n</ul>\n<p>two</p>\n"),
("- foo\n\n\n  bar\n","<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n"),
("123456789. ok\n","<ol start=\"123456789\">\n<li>ok</li>\n</ol>\n"),
("-\n  foo\n-\n  ```\n  bar\n  ```\n-\n      baz\n","<ul>\n<li>foo</li>\n<li>\n<pre><code>bar\n</code></pre>\n</li>\n<li>\n<pre><code>baz\n</code></pre>\n</li>\n</ul>\n"),
("-\n\n  foo\n","<ul>\n<li></li>\n</ul>\n<p>foo</p>\n"),
("- foo\n-\n- bar\n","<ul>\n<li>foo</li>\n<li></li>\n<li>bar</li>\n</ul>\n"),
("> 1. > Blockquote\ncontinued here.\n","<blockquote>\n<ol>\n<li>\n<blockquote>\n<p>Blockquote\ncontinued here.</p>\n</blockquote>\n</li>\n</ol>\n</blockquote>\n"),
("- foo\n  - bar\n    - baz\n      - boo\n","<ul>\n<li>foo\n<ul>\n<li>bar\n<ul>\n<li>baz\n<ul>\n<li>boo</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n"),
("- - foo\n","<ul>\n<li>\n<ul>\n<li>foo</li>\n</ul>\n</li>\n</ul>\n"),
("- foo\n- bar\n+ baz\n","<ul>\n<li>foo</li>\n<li>bar</li>\n</ul>\n<ul>\n<li>baz</li>\n</ul>\n"),
("Foo\n- bar\n- baz\n","<p>Foo</p>\n<ul>\n<li>bar</li>\n<li>baz</li>\n</ul>\n"),
("- foo\n\n- bar\n\n\n- baz\n","<ul>\n<li>\n<p>foo</p>\n</li>\n<li>\n<p>bar</p>\n</li>\n<li>\n<p>baz</p>\n</li>\n</ul>\n"),
("- a\n - b\n  - c\n   - d\n    - e\n","<ul>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n<li>d\n- e</li>\n</ul>\n"),
("- a\n- b\n\n- c\n","<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>\n"),
("- a\n- ```\n  b\n\n\n  ```\n- c\n","<ul>\n<li>a</li>\n<li>\n<pre><code>b\n\n\n</code></pre>\n</li>\n<li>c</li>\n</ul>\n"),
("- a\n  - b\n\n    c\n- d\n","<ul>\n<li>a\n<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"),
("* a\n  > b\n  >\n* c\n","<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n</li>\n<li>c</li>\n</ul>\n"),
("* foo\n  * bar\n\n  baz\n","<ul>\n<li>\n<p>foo</p>\n<ul>\n<li>bar</li>\n</ul>\n<p>baz</p>\n</li>\n</ul>\n"),
("`hi`lo`\n","<p><code>hi</code>lo`</p>\n"),("`` foo ` bar ``\n","<p><code>foo ` bar</code></p>\n"),("`foo\\`bar`\n","<p><code>foo\\</code>bar`</p>\n"),
("*foo bar*\n","<p><em>foo bar</em></p>\n"),("a * foo bar*\n","<p>a * foo bar*</p>\n"),("foo*bar*\n","<p>foo<em>bar</em></p>\n"),("_foo bar_\n","<p><em>foo bar</em></p>\n"),("foo_bar_\n","<p>foo_bar_</p>\n"),
("*(**foo**)*\n","<p><em>(<strong>foo</strong>)</em></p>\n"),("**foo*bar**\n","<p><strong>foo*bar</strong></p>\n"),("***foo** bar*\n","<p><em><strong>foo</strong> bar</em></p>\n"),("*foo**bar**baz*\n","<p><em>foo<strong>bar</strong>baz</em></p>\n"),("*foo**bar*\n","<p><em>foo**bar</em></p>\n"),
("****foo****\n","<p><strong><strong>foo</strong></strong></p>\n"),("*foo _bar* baz_\n","<p><em>foo _bar</em> baz_</p>\n"),("foo***bar***baz\n","<p>foo<em><strong>bar</strong></em>baz</p>\n"),
("[link](/uri \"title\")\n","<p><a href=\"/uri\" title=\"title\">link</a></p>\n"),("[link](</my uri>)\n","<p><a href=\"/my%20uri\">link</a></p>\n"),("[link](foo(and(bar)))\n","<p><a href=\"foo(and(bar))\">link</a></p>\n"),
("[link [foo [bar]]](/uri)\n","<p><a href=\"/uri\">link [foo [bar]]</a></p>\n"),("[foo [bar](/uri)](/uri)\n","<p>[foo <a href=\"/uri\">bar</a>](/uri)</p>\n"),("*[foo*](/uri)\n","<p>*<a href=\"/uri\">foo*</a></p>\n"),("![foo](/url \"title\")\n","<p><img src=\"/url\" alt=\"foo\" title=\"title\" /></p>\n"),
("[foo][bar]\n\n[bar]: /url\n","<p><a href=\"/url\">foo</a></p>\n"),("[foo][]\n\n[foo]: /url1\n","<p><a href=\"/url1\">foo</a></p>\n"),("[foo][bar][baz]\n\n[baz]: /url\n","<p>[foo]<a href=\"/url\">bar</a></p>\n"),
("<http://foo.bar.baz>\n","<p><a href=\"http://foo.bar.baz\">http://foo.bar.baz</a></p>\n"),("<foo@bar.example.com>\n","<p><a href=\"mailto:foo@bar.example.com\">foo@bar.example.com</a></p>\n"),("foo  \nbaz\n","<p>foo<br />\nbaz</p>\n"),("foo\\\nbaz\n","<p>foo<br />\nbaz</p>\n"),
("&nbsp; &amp; &copy; &#35; &ngE; &x;\n","<p>\xa0 &amp; © # ≧̸ &amp;x;</p>\n"),("\\*not emphasized*\n","<p>*not emphasized*</p>\n"),("<a><bab><c2c>\n","<p><a><bab><c2c></p>\n"),
("| foo | bar |\n| --- | :-: |\n| baz | bim \\| x |\n","<table>\n<thead>\n<tr>\n<th>foo</th>\n<th align=\"center\">bar</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>baz</td>\n<td align=\"center\">bim | x</td>\n</tr>\n</tbody>\n</table>\n"),
("- [ ] foo\n- [x] bar\n","<ul>\n<li><input type=\"checkbox\" disabled=\"\" /> foo</li>\n<li><input type=\"checkbox\" disabled=\"\" checked=\"\" /> bar</li>\n</ul>\n"),("~~Hi~~ there\n","<p><del>Hi</del> there</p>\n"),
("| a | b |\n| - | - |\n| 1 | 2 |\n\nbar\n","<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td>2</td>\n</tr>\n</tbody>\n</table>\n<p>bar</p>\n"),
]


@pytest.mark.parametrize("text, html", EXAMPLES)
def test_example(text, html):
    assert markdown.to_html(markdown.parse(text)) == html


def test_rows():
    rows = markdown.block_rows("# A *b*\n\n1. x\n2. [x] y\n\n| a |\n| - |\n| `c` |\n")
    assert [(r[1], r[2], r[5]) for r in rows] == [(0, "heading", "A b"), (0, "list", ""), (1, "item", ""), (2, "paragraph", "x"), (1, "item", ""), (2, "paragraph", "y"), (0, "table", ""), (1, "row", "a"), (1, "row", "c")]
    assert rows[4][4] == "done" and rows[1][3] == 1
    assert markdown.block_rows(None) == markdown.block_rows("") == []


def test_long_and_hostile_texts_end():
    assert markdown.block_rows("*a " * 3000)
    assert markdown.block_rows("[" * 3000)
    assert markdown.block_rows("> " * 200 + "x")
    assert markdown.block_rows("`" + "``" * 2000)
