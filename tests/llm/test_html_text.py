import pytest
from plumbline.llm import html_text
from plumbline.llm.html_text import extract_text, render

CASES = [
    ("<p>One<p>Two <b>bold</b>\n text", "One\n\nTwo bold text"),
    ("<h1>T</h1>a<br>b<br/>c", "T\n\na\nb\nc"),
    ("<ul><li>a<li>b<ol><li>x</li><li>y</ol></ul>", "- a\n- b\n  1. x\n  2. y"),
    ("<ol start=3><li>c<li>d</ol>", "3. c\n4. d"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>fig<td>12</table>", "Name   Qty\napple  3\nfig    12"),
    ("<table><caption>Cap</caption><tr><td colspan=2>wide<tr><td>a<td>b</table>", "Cap\nwide\na  b"),
    ("<script>var a='</p>';</script><style>p{}</style><!-- no --><p hidden>x<p style='display: none'>y<p>seen", "seen"),
    ("<head><title>t</title></head><body>b", "b"),
    ("a &amp; b &lt;c&gt; &eacute;", "a & b <c> é"),
    ("<pre>  x\n    y</pre>z", "  x\n    y\n\nz"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<a title='x > y'>link</a> <img alt=no>", "link"),
    ("</p></div>stray", "stray"),
    ("<blockquote>q</blockquote>r", "    q\n\nr"),
    ("", ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert render(page) == text


def test_hostile_pages_stay_cheap():
    assert render("<table><tr><td>" * 3000 + "deep").endswith("deep")
    assert render("<div>" * 50_000 + "x") == "x"
    render("<a '" * 20_000)
    render('<p class="' * 5_000)
    assert render("<p>" + "word " * 100_000).count("word") == 100_000


def test_quotes_of_any_length_and_number():
    for n in (100, 9_000, 11_000, 300_000):
        assert render(f'<div data-p="{"a " * (n // 2)}<b>secret</b>">shown</div>') == "shown"
        assert render(f"<p onclick='{'a' * n}>secret' hidden>gone</p>shown") == "shown"
    for n in (10, 230, 5_000):
        many = " ".join(f'a{k}="x > {k}"' for k in range(n))
        assert render(f'<p {many} t="p > q">shown</p>') == "shown"
    assert render('<p title="open>text') == "text" and render('1 <p title="no end') == '1 <p title="no end'
    assert render("a <b no end <!-- gone") == "a <b no end"
    # quotes that pair up to the end of the page and hide every '>' cost no more than the page is long
    assert render('<a ">"' * 100_000).count('"') == 100_000
    render("<a \">'" * 100_000)
    render("<a " * 300_000)


DRAWINGS = [
    ("a<svg><title>t</title><defs><text>no</text></defs><path d='M0'/><text x=1>Sales</text><g><text>20<tspan>24</tspan></text></g></svg>b", "a Sales 2024 b"),
    ("<svg><defs/><script/><desc>d</desc>loose<text display=none>x</text><foreignObject><p>html</p></foreignObject></svg>", "html"),
    ("<svg><path d=x/><p>after", "after"),
    ("<p>If <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math>.", "If x=1 2."),
    ("<pre>k <svg><text>in pre</text></svg></pre>", "k  in pre"),
    ("<desc>html</desc>", "html"),
]


@pytest.mark.parametrize(("page", "text"), DRAWINGS)
def test_drawings_and_formulas(page, text):
    assert render(page) == text


def test_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "<p>a", 0), (2, "<p>a", 0)], "page_id long, html string, text int")
    assert sorted((r.page_id, r.text) for r in extract_text(df).collect()) == [(1, ""), (2, "a"), (2, "a")]
    assert extract_text(df.limit(0)).count() == 0


def test_cells_over_several_rows_keep_their_columns():
    page = "<table><tr><td rowspan=2>aaaa<td>b<tr><td>c<tr><td>d<td>e</table>"
    assert html_text.render(page).split("\n") == ["aaaa  b", "      c", "d     e"]
    page = "<table><tbody><tr><td rowspan=0>x<td>y<tr><td>z</tbody><tbody><tr><td>u<td colspan=2>v w<tr><td>1<td>2<td>3</table>"
    assert html_text.render(page).split("\n") == ["x  y", "   z", "u  v w", "1  2  3"]


def test_tables_like_a_grid_filled_cell_by_cell():
    import random

    rng = random.Random(6)
    for _ in range(60):
        rows = [[(f"c{r}{k}" + "x" * rng.randrange(4), rng.choice([1, 1, 2]), rng.choice([1, 1, 2, 3])) for k in range(rng.randrange(1, 5))] for r in range(rng.randrange(1, 6))]
        taken, starts = set(), {}
        for r, row in enumerate(rows):
            column = 0
            for text, wide, deep in row:
                while (r, column) in taken:
                    column += 1
                starts[text, r] = column
                taken |= {(r + i, column + j) for i in range(deep) for j in range(wide)}
                column += wide
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={d}>{t}" for t, w, d in row) for row in rows) + "</table>"
        lines = html_text.render(page).split("\n")
        widths = {}
        for r, row in enumerate(rows):
            for text, wide, _ in row:
                if wide == 1:
                    widths[starts[text, r]] = max(widths.get(starts[text, r], 0), len(text))
        assert len(lines) == len(rows)
        for r, row in enumerate(rows):
            end = 0
            for text, _, _ in row:
                at = sum(widths.get(c, 0) + 2 for c in range(starts[text, r]))
                assert lines[r].index(text) == (at if end + 2 <= at or not end else end + 2)
                end = lines[r].index(text) + len(text)


def test_style_sheets_and_visibility():
    style = "<style>/* .a{} */ .x{display:none} p#y , em.q.r{ display : none } .v{visibility:hidden} @media print{.z{display:none}} @media screen{.s{display:none}} b.k{display:none} #n .m{display:none} .i{display:none!important}</style>"
    page = style + (
        "<div class='o x'>1</div><p id=y>2</p><p id=w>3</p><em class=q>4</em><em class='r q'>5</em><div class=v>6<i style='visibility:visible'>7</i></div>"
        "<div class=z>8</div><div class=s>9</div><b class=k style='display:inline'>A</b><div id=n><i class=m>B</i></div><u class=i style='display:inline'>C</u>"
    )
    assert "".join(html_text.render(page).split()) == "3478AB"
    assert html_text.render("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>") == "- b"
    assert html_text.render("<style media=print>p{display:none}</style><p>a<style>p{display:none}") == ""
    assert html_text.render("<p>a<style>{}} .x{ p{") == "a"


def test_line_breaks_leave_blank_lines():
    assert html_text.render("a<br>b<br><br>c<br> <br><br>d<br><p>e") == "a\nb\n\nc\n\n\nd\n\ne"
    assert html_text.render("<br><br>a<br><br>") == "a"


def test_extra_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "<p>a", "z"), (1, "<p>a", "z"), (None, None, None)], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract_text(rows).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert html_text.extract_text(rows.limit(0)).count() == 0
