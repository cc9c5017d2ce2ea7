"""Rows of tables alone: those of the blocks, and of plain tables without a tree."""

import random

import pytest

from scrivane.functions import markup as M


def of_blocks(html):
    return [b["rows"] for b in M.blocks(M.parse(html)) if b["type"] == "table"]


@pytest.mark.parametrize("html", [
    "", "text &lt;", "<table></table>", "a<table>b<tr>c</tr>d</table>e", "<table><tr><td>a<td> b &amp c\n</td>out<th>d</tr></table>", "<table><thead><tr><th>n<th>q</tr></thead><tbody><tr><td>1<td>2 | &lt;b&gt;</td></tr></table>",
    "<table><tr><td>a<tr><td>b</table>", "<table><tr><td>a</th>b</tr></table>", "<table><tr><td colspan=2>a</tr></table>", "<table hidden><tr><td>a</tr></table>", "<table><tr><td>a<table><tr><td>b</tr></table></tr></table>",
    "<table><tr><td>a<b>c</b>d</tr></table>", "<table><td>a</td></table>", "<table><tr><td>a</tr>", "<script><table><tr><td>a</tr></table></script>", "<TABLE><TR><TD>a</TR></TABLE>", "<table><tr><td>a < b</tr></table>", "<table><tr><td>&nbsp;a\x0b b&#10;c</tr></table>",
])
def test_rows_are_those_of_the_blocks(html):
    assert M.tables(html) == of_blocks(html)


def test_any_order_of_tags():
    random.seed(5)
    tags = [f"<{end}{t}>" for t in ("table", "tr", "td", "th", "thead", "tbody", "tfoot") for end in ("", "/")] + [" a ", "b &lt; c", "&amp", "\n", "<p>", "<td hidden>"]
    plain = lambda: "<table>" + "".join("<tr>" + "".join(f"<{(c := random.choice(('td', 'th')))}> x" + random.choice(("", f"</{c}>y")) for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
    for _ in range(2000):
        html = plain()
        at = random.randrange(len(html) + 1)
        for h in ("".join(random.choices(tags, k=10)), html, html[:at] + random.choice(tags) + html[at:]):
            assert M.tables(h) == of_blocks(h), h


def test_tables_of_the_query_need_no_tree(monkeypatch):
    """A tree, its locators and the other kinds of blocks were most of the time of each table."""
    monkeypatch.setattr(M, "parse", lambda html: pytest.fail("a tree was built"))
    assert len(M.tables("<table><thead><tr><th>n<th>q<th>f</tr></thead><tbody><tr><td>1<td>7 | &lt;b&gt;</td><td> A\n</td></tr></table>")[0]) == 2
