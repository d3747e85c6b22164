import html as H
import re
from html import unescape
from html.parser import HTMLParser

import pytest
from pixelloom.llm.html_text import extract, render

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br/>c</br>d", "a\nb\nc\nd"),
    ("<p>x <b>bold<i>both</b> tail</i>.</p>", "x boldboth tail."),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>after", "- a\n- b\n  - c\n- d\n\nafter"),
    ("<ol start=9><li>a<li>b<li value=3>c</ol>", "9. a\n10. b\n3. c"),
    ("<table><tr><td>a<td>long cell<tr><td>longer first<td>b</table>", "a             long cell\nlonger first  b"),
    ("<table><tr><td colspan=2>wide one<td>z<tr><td>1<td>2<td>3</table>", "wide one  z\n1  2      3"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><td>no row<td>x</table>", "no row  x"),
    ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<script>if (a<b) x='</p>'</script>t<style>p{}</style><!-- c > --><title>no</title>", "t"),
    ("<style>.ad, #x{display:none}</style><p class='big AD'>gone</p><p id=x>gone</p><p>here</p>", "here"),
    ("<div hidden>no</div><div style='display: none'>no</div><span style='VISIBILITY:hidden'>no</span>yes", "yes"),
    ("<pre>\n a  b\n  c</pre>x", " a  b\n  c\n\nx"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<blockquote><p>q</blockquote>", "  q"),
    ("a < b <3 &lt;c&gt; &nope; &copy", "a < b <3 <c> &nope; ©"),
    ('<a title="x > y" href=z>link</a><a href="never ends>tail', "link"),
    ("<h1>t</h1>text<hr>more", "t\n\ntext\n\nmore"),
    ("<head><meta charset=x><p>implied body", "implied body"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<p>a\n   b\t c</p>", "a b c"),
    ("<", "<"),
    ("<input type=submit value=Go><input type=hidden value=no>", "Go"),
    ("<textarea>\nx <b>y</textarea>", "x <b>y"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert render(page) == text


def test_depth_and_length():
    assert render("<div>" * 50_000 + "x") == "x"
    assert render("<b>" * 20_000 + "<li>y" * 50).count("y") == 50
    assert len(render("word " * 200_000)) == 999_999
    wide = "<table>" + "<tr><td>" + "x" * 5000 + "<td>y" * 1 + "</tr>" + "<tr><td>a<td>b" * 200 + "</table>"
    assert len(render(wide)) < 10_000


class Plain(HTMLParser):
    """All text outside script, style and title, by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.out.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_no_visible_text_is_lost(spark):
    """On the table's pages all words come out, in order, as the standard parser gives them."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html)
        p.close()
        want = re.sub(r"\s+", "", "".join(p.out))
        assert re.sub(r"\s+", "", re.sub(r"(?m)^ *- ", "", got[r.page_id])) == want, r.page_id
    assert H.unescape("&copy;") in got[0]


def test_columns_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "t", "x"), (1, "<p>a", None, "y"), (1, "<p>a", None, "y")], "page_id long, html string, text string, url string")
    out = extract(df)
    assert out.columns == ["page_id", "url", "text"] and sorted(r.text for r in out.collect()) == ["", "a", "a"]
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("sheet,seen", [
    ("@media print {.a {display:none}}", True),
    ("@media (max-width:600px) {.a {display:none}} .b {color:red}", True),
    ("@media screen and (max-width:600px) {.a {display:none}}", True),
    ("@media print {@supports (x:y) {.a {display:none}}}", True),
    ("@media print {p {color:red}} .a {display:none}", False),
    ("@media screen {.a {display:none}}", False),
    ("@media print, all {.a {display:none}}", False),
    ("@import 'x.css'; @charset 'utf-8'; .a {color:red; display:none}", False),
    (".a {display:none} .a {display:block}", True),
    (".a {display:block} .a {display:none}", False),
    (".a {display:none !important} .a {display:block}", False),
    (".a {display:none} p {display:block}", False),
    ("p {display:none} .a {display:block}", True),
    (".a {display:none} #i {display:block}", True),
    (".a {display:none} .a {visibility:visible}", False),
    (".a {display:none; display:block}", True),
    ("@font-face {font-family:x; src:url(y)} .a {display:none", False),
    (".a {content:'}'; display:none}", False),
])
def test_rules_in_context(sheet, seen):
    assert render(f"<style>{sheet}</style><p class=a id=i>text</p>end") == ("text\n\nend" if seen else "end")


def test_style_of_the_element_and_media_of_the_sheet():
    assert render("<style>.a{display:none}</style><p class=a style='display:block'>x") == "x"
    assert render("<style>.a{display:none!important}</style><p class=a style='display:block'>x") == ""
    assert render("<style media=print>.a{display:none}</style><p class=a>x") == "x"


def test_wide_cells_are_broken_and_stay_aligned():
    words = " ".join(f"word{i}" for i in range(200))
    lines = render(f"<table><tr><td>{words}<td>right</tr><tr><td>a<td>b</table>").split("\n")
    start = lines[0].index("right")
    assert start <= 122 and lines[-1].index("b") == start and max(map(len, lines)) < 130
    assert " ".join(" ".join(x[:start] for x in lines[:-1]).split()) == words
    narrow = render("<table><tr><td>one two three<td>x</table>", widest=7)
    assert narrow == "one two  x\nthree"
    assert render("<table><tr><td>" + "x" * 300 + " tail<td>y<tr><td>a<td>b</table>") == "x" * 300 + "  y\ntail\na" + " " * 5 + "b"


def plain_text(html):
    """A walk over the tags of pages without tables: marks of lists, line breaks, and what stands apart."""
    body = re.sub(r"(?is)<!--.*?-->|<head\b.*?</head>|<(script|style)\b.*?</\1>|<!doctype[^>]*>", "", html)
    lines, line, breaks, mark = [], "", 0, ""

    def open_line():
        nonlocal breaks, mark, line
        if lines and breaks > 1:
            lines.append("")
        breaks, line, mark = 0, mark or ("  " if inside else ""), ""

    inside = paragraph = False  # a paragraph ends with the next block at the latest
    for part in re.findall(r"<[^>]*>|[^<]+", body):
        tag = re.match(r"</?([a-z0-9]+)", part.lower())
        if not tag:
            words = unescape(part)
            if words.split():
                if not line:
                    open_line()
                elif words[0].isspace() and not line.endswith(" "):
                    line += " "
                line += " ".join(words.split()) + (" " if words[-1].isspace() else "")
            elif line and not line.endswith(" "):
                line += " "
        elif tag[1] == "br":
            if not line:
                open_line()
            lines.append(line.rstrip())
            line = ""
        elif tag[1] not in ("a", "b"):
            if line:
                lines.append(line.rstrip())
                line = ""
            breaks = max(breaks, 2 if tag[1] in ("p", "h1", "ul") or paragraph else 1)
            paragraph = part.lower().startswith("<p")
            if tag[1] == "li":
                inside = part[1] != "/"
                mark = "- " if inside else ""
    return "\n".join([*lines, line.rstrip()]).strip("\n")


def test_table_of_pages_against_a_plain_walk(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(rows) > 100 and all(got[r.page_id] == plain_text(r.html) for r in rows)
