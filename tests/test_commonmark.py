"""Markdown by cases of the public CommonMark specification (its HTML without breaks between blocks), tables, and time on hard input."""

import time

import pytest

from scrivane.functions import commonmark

CASES = [
    ('', ''),
    ('# A #', '<h1>A</h1>'),
    ('a\nb', '<p>a\nb</p>'),
    ('a  \nb', '<p>a<br>\nb</p>'),
    ('T\n-', '<h2>T</h2>'),
    ('- a\n- b', '<ul><li>a</li><li>b</li></ul>'),
    ('- a\n\n- b', '<ul><li><p>a</p></li><li><p>b</p></li></ul>'),
    ('2) x\n3) y', '<ol start="2"><li>x</li><li>y</li></ol>'),
    ('- a\n  - b\n\n1. c', '<ul><li>a<ul><li>b</li></ul></li></ul><ol><li>c</li></ol>'),
    ('> a\n> > b', '<blockquote><p>a</p><blockquote><p>b</p></blockquote></blockquote>'),
    ('`a*b*` *c* **d** \\*e', '<p><code>a*b*</code> <em>c</em> <strong>d</strong> *e</p>'),
    ('[a](b "t") ![c](d)', '<p><a href="b" title="t">a</a> <img src="d" alt="c"></p>'),
    ('~~~\n```\n~~~', '<pre><code>```\n</code></pre>'),
    ('***', '<hr>'),
    ('snake_case_word', '<p>snake_case_word</p>'),
    ('\tfoo\tbaz\t\tbim', '<pre><code>foo\tbaz\t\tbim\n</code></pre>'),
    ('  - foo\n\n\tbar', '<ul><li><p>foo</p><p>bar</p></li></ul>'),
    ('- foo\n\n\t\tbar', '<ul><li><p>foo</p><pre><code>  bar\n</code></pre></li></ul>'),
    ('>\t\tfoo', '<blockquote><pre><code>  foo\n</code></pre></blockquote>'),
    ('-\t\tfoo', '<ul><li><pre><code>  foo\n</code></pre></li></ul>'),
    ('    foo\n\tbar', '<pre><code>foo\nbar\n</code></pre>'),
    ('- `one\n- two`', '<ul><li>`one</li><li>two`</li></ul>'),
    ('+++', '<p>+++</p>'),
    ('- - -', '<hr>'),
    ('_____________________________________', '<hr>'),
    ('- foo\n***\n- bar', '<ul><li>foo</li></ul><hr><ul><li>bar</li></ul>'),
    ('* Foo\n* * *\n* Bar', '<ul><li>Foo</li></ul><hr><ul><li>Bar</li></ul>'),
    ('####### foo', '<p>####### foo</p>'),
    ('#5 bolt', '<p>#5 bolt</p>'),
    ('# foo *bar* \\*baz\\*', '<h1>foo <em>bar</em> *baz*</h1>'),
    ('### foo \\###', '<h3>foo ###</h3>'),
    ('## \n#\n### ###', '<h2></h2><h1></h1><h3></h3>'),
    ('Foo *bar*\n=========', '<h1>Foo <em>bar</em></h1>'),
    ('Foo *bar\nbaz*\n====', '<h1>Foo <em>bar\nbaz</em></h1>'),
    ('> foo\n-----', '<blockquote><p>foo</p></blockquote><hr>'),
    ('> foo\nbar\n===', '<blockquote><p>foo\nbar\n===</p></blockquote>'),
    ('- Foo\n---', '<ul><li>Foo</li></ul><hr>'),
    ('    a simple\n      indented code block', '<pre><code>a simple\n  indented code block\n</code></pre>'),
    ('1.  foo\n\n    - bar', '<ol><li><p>foo</p><ul><li>bar</li></ul></li></ol>'),
    ('    chunk1\n\n    chunk2\n  \n \n \n    chunk3', '<pre><code>chunk1\n\nchunk2\n\n\n\nchunk3\n</code></pre>'),
    ('Foo\n    bar', '<p>Foo\nbar</p>'),
    ('```\naaa\n~~~\n```', '<pre><code>aaa\n~~~\n</code></pre>'),
    ('````\naaa\n```\n``````', '<pre><code>aaa\n```\n</code></pre>'),
    ('> ```\n> aaa\n\nbbb', '<blockquote><pre><code>aaa\n</code></pre></blockquote><p>bbb</p>'),
    ('  ```\naaa\n  aaa\naaa\n  ```', '<pre><code>aaa\naaa\naaa\n</code></pre>'),
    ('``` ruby startline=3 $%@#$\ndef foo(x)\nend\n```', '<pre><code class="language-ruby">def foo(x)\nend\n</code></pre>'),
    ('<table>\n  <tr>\n    <td>hi</td>\n  </tr>\n</table>\n\nokay.', '<table>\n  <tr>\n    <td>hi</td>\n  </tr>\n</table><p>okay.</p>'),
    ('<div>\n*hello*\n\n*world*', '<div>\n*hello*<p><em>world</em></p>'),
    ('<del>\n*foo*\n</del>', '<del>\n*foo*\n</del>'),
    ('<del>*foo*</del>', '<p><del><em>foo</em></del></p>'),
    ('<script>\n\nx*y*\n</script>\nokay', '<script>\n\nx*y*\n</script><p>okay</p>'),
    ('<!-- Foo\n\nbar -->\nokay', '<!-- Foo\n\nbar --><p>okay</p>'),
    ('Foo\n<div>\nbar\n</div>', '<p>Foo</p><div>\nbar\n</div>'),
    ('Foo\n<a href="bar">\nbaz', '<p>Foo\n<a href="bar">\nbaz</p>'),
    ('[foo]: /url "title"\n\n[foo]', '<p><a href="/url" title="title">foo</a></p>'),
    ("[Foo bar]:\n<my url>\n'title'\n\n[Foo bar]", '<p><a href="my%20url" title="title">Foo bar</a></p>'),
    ("[foo]: /url 'title\n\nwith blank line'\n\n[foo]", "<p>[foo]: /url 'title</p><p>with blank line'</p><p>[foo]</p>"),
    ('[foo]:\n\n[foo]', '<p>[foo]:</p><p>[foo]</p>'),
    ('[foo]: <bar>(baz)\n\n[foo]', '<p>[foo]: <bar>(baz)</p><p>[foo]</p>'),
    ('[foo]\n\n[foo]: first\n[foo]: second', '<p><a href="first">foo</a></p>'),
    ('[ΑΓΩ]: /φου\n\n[αγω]', '<p><a href="/%CF%86%CE%BF%CF%85">αγω</a></p>'),
    ('[foo]: /url "title" ok', '<p>[foo]: /url &quot;title&quot; ok</p>'),
    ('Foo\n[bar]: /baz\n\n[bar]', '<p>Foo\n[bar]: /baz</p><p>[bar]</p>'),
    ('[foo]: /url\nbar\n===\n[foo]', '<h1>bar</h1><p><a href="/url">foo</a></p>'),
    ('[foo]: /url\n===\n[foo]', '<p>===\n<a href="/url">foo</a></p>'),
    ('> # Foo\n> bar\n> baz', '<blockquote><h1>Foo</h1><p>bar\nbaz</p></blockquote>'),
    ('> bar\nbaz\n> foo', '<blockquote><p>bar\nbaz\nfoo</p></blockquote>'),
    ('> foo\n---', '<blockquote><p>foo</p></blockquote><hr>'),
    ('> - foo\n- bar', '<blockquote><ul><li>foo</li></ul></blockquote><ul><li>bar</li></ul>'),
    ('>     foo\n    bar', '<blockquote><pre><code>foo\n</code></pre></blockquote><pre><code>bar\n</code></pre>'),
    ('> ```\nfoo\n```', '<blockquote><pre><code>\n</code></pre></blockquote><p>foo</p><pre><code>\n</code></pre>'),
    ('> bar\n\nbaz', '<blockquote><p>bar</p></blockquote><p>baz</p>'),
    ('> > > foo\nbar', '<blockquote><blockquote><blockquote><p>foo\nbar</p></blockquote></blockquote></blockquote>'),
    ('1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.', '<ol><li><p>A paragraph\nwith two lines.</p><pre><code>indented code\n</code></pre><blockquote><p>A block quote.</p></blockquote></li></ol>'),
    ('- one\n\n two', '<ul><li>one</li></ul><p>two</p>'),
    ('   > > 1.  one\n>>\n>>     two', '<blockquote><blockquote><ol><li><p>one</p><p>two</p></li></ol></blockquote></blockquote>'),
    ('-one\n\n2.two', '<p>-one</p><p>2.two</p>'),
    ('1234567890. not ok', '<p>1234567890. not ok</p>'),
    ('- foo\n\n      bar', '<ul><li><p>foo</p><pre><code>bar\n</code></pre></li></ul>'),
    ('-\n  foo\n-\n  ```\n  bar\n  ```\n-\n      baz', '<ul><li>foo</li><li><pre><code>bar\n</code></pre></li><li><pre><code>baz\n</code></pre></li></ul>'),
    ('-\n\n  foo', '<ul><li></li></ul><p>foo</p>'),
    ('- foo\n-\n- bar', '<ul><li>foo</li><li></li><li>bar</li></ul>'),
    ('foo\n*\n\nfoo\n1.', '<p>foo\n*</p><p>foo\n1.</p>'),
    ('> 1. > Blockquote\ncontinued here.', '<blockquote><ol><li><blockquote><p>Blockquote\ncontinued here.</p></blockquote></li></ol></blockquote>'),
    ('- foo\n  - bar\n    - baz\n      - boo', '<ul><li>foo<ul><li>bar<ul><li>baz<ul><li>boo</li></ul></li></ul></li></ul></li></ul>'),
    ('10) foo\n    - bar', '<ol start="10"><li>foo<ul><li>bar</li></ul></li></ol>'),
    ('- - foo', '<ul><li><ul><li>foo</li></ul></li></ul>'),
    ('- # Foo\n- Bar\n  ---\n  baz', '<ul><li><h1>Foo</h1></li><li><h2>Bar</h2>baz</li></ul>'),
    ('- foo\n- bar\n+ baz', '<ul><li>foo</li><li>bar</li></ul><ul><li>baz</li></ul>'),
    ('The number\n14.  The', '<p>The number\n14.  The</p>'),
    ('The number\n1.  The', '<p>The number</p><ol><li>The</li></ol>'),
    ('- foo\n\n- bar\n\n\n- baz', '<ul><li><p>foo</p></li><li><p>bar</p></li><li><p>baz</p></li></ul>'),
    ('- a\n  - b\n\n    c\n- d', '<ul><li>a<ul><li><p>b</p><p>c</p></li></ul></li><li>d</li></ul>'),
    ('* a\n  > b\n  >\n* c', '<ul><li>a<blockquote><p>b</p></blockquote></li><li>c</li></ul>'),
    ('- a\n- ```\n  b\n\n\n  ```\n- c', '<ul><li>a</li><li><pre><code>b\n\n\n</code></pre></li><li>c</li></ul>'),
    ('a', '<p>a</p>'),
    ('`` foo ` bar ``', '<p><code>foo ` bar</code></p>'),
    ('` `` `', '<p><code>``</code></p>'),
    ('`foo   bar \nbaz`', '<p><code>foo   bar  baz</code></p>'),
    ('*foo`*`', '<p>*foo<code>*</code></p>'),
    ('```foo``', '<p>```foo``</p>'),
    ('foo\\\nbar', '<p>foo<br>\nbar</p>'),
    ('\\&nbsp; &nbsp;&copy; &#35; &#1234; &#0;', '<p>&amp;nbsp; \xa0© # Ӓ �</p>'),
    ('a * foo bar*', '<p>a * foo bar*</p>'),
    ('a*"foo"*', '<p>a*&quot;foo&quot;*</p>'),
    ('foo*bar*', '<p>foo<em>bar</em></p>'),
    ('_foo_bar_baz_', '<p><em>foo_bar_baz</em></p>'),
    ('foo-_(bar)_', '<p>foo-<em>(bar)</em></p>'),
    ('*(*foo*)*', '<p><em>(<em>foo</em>)</em></p>'),
    ('**foo bar **', '<p>**foo bar **</p>'),
    ('**Gomphocarpus (*Gomphocarpus physocarpus*, syn.)**', '<p><strong>Gomphocarpus (<em>Gomphocarpus physocarpus</em>, syn.)</strong></p>'),
    ('*foo**bar**baz*', '<p><em>foo<strong>bar</strong>baz</em></p>'),
    ('*foo**bar*', '<p><em>foo**bar</em></p>'),
    ('***foo** bar*', '<p><em><strong>foo</strong> bar</em></p>'),
    ('*foo **bar***', '<p><em>foo <strong>bar</strong></em></p>'),
    ('foo***bar***baz', '<p>foo<em><strong>bar</strong></em>baz</p>'),
    ('foo******bar*********baz', '<p>foo<strong><strong><strong>bar</strong></strong></strong>***baz</p>'),
    ('**foo*', '<p>*<em>foo</em></p>'),
    ('*foo**', '<p><em>foo</em>*</p>'),
    ('****foo*', '<p>***<em>foo</em></p>'),
    ('*foo _bar* baz_', '<p><em>foo _bar</em> baz_</p>'),
    ('*foo __bar *baz bim__ bam*', '<p><em>foo <strong>bar *baz bim</strong> bam</em></p>'),
    ('*[bar*](/url)', '<p>*<a href="/url">bar*</a></p>'),
    ('**a<https://foo.bar/?q=**>', '<p>**a<a href="https://foo.bar/?q=**">https://foo.bar/?q=**</a></p>'),
    ('[link](foo\\)\\:)', '<p><a href="foo):">link</a></p>'),
    ('[link](foo(and(bar)))', '<p><a href="foo(and(bar))">link</a></p>'),
    ('[link](<foo(and(bar)>)', '<p><a href="foo(and(bar)">link</a></p>'),
    ('[link](/my uri)', '<p>[link](/my uri)</p>'),
    ('[link]()', '<p><a href="">link</a></p>'),
    ('[link](/url "title \\"&quot;")', '<p><a href="/url" title="title &quot;&quot;">link</a></p>'),
    ('[link [foo [bar]]](/uri)', '<p><a href="/uri">link [foo [bar]]</a></p>'),
    ('[foo [bar](/uri)](/uri)', '<p>[foo <a href="/uri">bar</a>](/uri)</p>'),
    ('![[[foo](uri1)](uri2)](uri3)', '<p><img src="uri3" alt="[foo](uri2)"></p>'),
    ('[foo *bar](baz*)', '<p><a href="baz*">foo *bar</a></p>'),
    ('[foo`](/uri)`', '<p>[foo<code>](/uri)</code></p>'),
    ('[foo][bar]\n\n[bar]: /url "t"', '<p><a href="/url" title="t">foo</a></p>'),
    ('[foo][BaR]\n\n[bar]: /url', '<p><a href="/url">foo</a></p>'),
    ('[foo][]\n\n[foo]: /url', '<p><a href="/url">foo</a></p>'),
    ('[foo] bar\n\n[foo]: /u', '<p><a href="/u">foo</a> bar</p>'),
    ('[foo](not a link)\n\n[foo]: /url1', '<p><a href="/url1">foo</a>(not a link)</p>'),
    ('[foo][bar][baz]\n\n[baz]: /url', '<p>[foo]<a href="/url">bar</a></p>'),
    ('[bar][foo\\!]\n\n[foo!]: /url', '<p>[bar][foo!]</p>'),
    ('![foo *bar*][]\n\n[foo *bar*]: train.jpg "t"', '<p><img src="train.jpg" alt="foo bar" title="t"></p>'),
    ('<foo@bar.example.com>', '<p><a href="mailto:foo@bar.example.com">foo@bar.example.com</a></p>'),
    ('<https://example.com/\\[\\>', '<p><a href="https://example.com/%5C%5B%5C">https://example.com/\\[\\</a></p>'),
    ('<a  /><b2\ndata="foo" >', '<p><a  /><b2\ndata="foo" ></p>'),
    ('<33> <__>', '<p>&lt;33&gt; &lt;__&gt;</p>'),
    ('foo <!-- this is a --\ncomment - with hyphens -->', '<p>foo <!-- this is a --\ncomment - with hyphens --></p>'),
    ('foo     \n   baz', '<p>foo<br>\nbaz</p>'),
    ('foo  ', '<p>foo</p>'),
    ('~~a~~ ~b~ ~~~c~~~', '<p><del>a</del> ~b~ ~~~c~~~</p>'),
    ('|a|b|\n|-|-|\n|1|', '<table><thead><tr><th scope="col">a</th><th scope="col">b</th></tr></thead><tbody><tr><td>1</td><td></td></tr></tbody></table>'),
    ('a\\|b | c\n:-- | --:\n[x] | **y**\n\n[x]: /z', '<table><thead><tr><th scope="col">a|b</th><th scope="col">c</th></tr></thead><tbody><tr><td><a href="/z">x</a></td><td><strong>y</strong></td></tr></tbody></table>'),
    ('a | b\n- | -\n> q', '<table><thead><tr><th scope="col">a</th><th scope="col">b</th></tr></thead><tbody></tbody></table><blockquote><p>q</p></blockquote>'),
    ('- a\n\n      code\n\n  b\n1. c', '<ul><li><p>a</p><pre><code>code\n</code></pre><p>b</p></li></ul><ol><li>c</li></ol>'),
]


@pytest.mark.parametrize("text, html", CASES)
def test_case(text, html):
    assert commonmark.render(text) == html


def test_definitions_serve_texts_before_them_and_in_other_blocks():
    text = "> [a] and *x **[b][B c]** y*\n\n- [a][]\n\n[A]: <one two> 'T'\n\n> [b  C]: /b"
    assert commonmark.render(text) == '<blockquote><p><a href="one%20two" title="T">a</a> and <em>x <strong><a href="/b">b</a></strong> y</em></p></blockquote><ul><li><a href="one%20two" title="T">a</a></li></ul><blockquote></blockquote>'


@pytest.mark.parametrize("text", ["> " * 20_000 + "a", "- " * 3000 + "a", "[" * 20_000, "[a](" * 20_000, "*a " * 20_000 + "*" * 20_000, " ".join("`" * i for i in range(1, 600)), "\n".join("  " * i + "- x" for i in range(300)), "a**b" + "c* " * 20_000, "<" * 50_000, "<!--" * 5000, "_a" * 30_000, "![" * 10_000 + "](x)" * 10_000])
def test_hard_input_takes_little_time(text):
    began = time.process_time()
    assert commonmark.render(text)
    assert time.process_time() - began < 10
