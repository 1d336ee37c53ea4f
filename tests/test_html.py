"""HTML extraction on inline pages."""

from headline_signals.operators import extract as ex
from headline_signals.sources import html as hx

PAGE = """<html><head><title>T &amp; U</title><script>var x = "<table>";</script></head><body>
<table><tr><td>a</td></tr></table>
<table><tr><td>b</td><td>c</td></tr></table>
<table><tr><td>x</td></tr></table>
<table>
 <tr><td>1</td><td>01:58AM</td><td>Stocks &amp; bonds rally</td></tr>
 <tr><td>2</td><td>Aug-07</td><td>Loading…</td></tr>
 <tr><td>3</td><td>only two</td></tr>
</table>
<table><tr><td>4</td><td>2025-09-09 02:05PM</td><td>Fed holds</td></tr></table>
<ul><li><a href="/a">First</a></li><li>Second <b>item</b></li></ul>
<h1>Head  line</h1></body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, "<p>no tables</p>")], "page_id long, html string")


def test_tables_in_document_order(spark):
    t = hx.html_tables(pages(spark)).orderBy("table_idx", "row_idx").collect()
    assert [r["table_idx"] for r in t] == [0, 1, 2, 3, 3, 3, 4]
    assert t[3]["cells"] == ["1", "01:58AM", "Stocks & bonds rally"]


def test_headline_rows_pick_shape_placeholder(spark):
    rows = ex.headline_rows(hx.html_tables(pages(spark)), "2025-09-09").orderBy("table_idx", "row_idx")
    got = [(r["table_idx"], r["Time"], r["Headline"]) for r in rows.collect()]
    # both tables kept (union), the 2-cell row flagged out, the placeholder dropped
    assert got == [(3, "2025-09-09 01:58AM", "Stocks & bonds rally"), (4, "2025-09-09 02:05PM", "Fed holds")]


def test_missing_table_index_gives_no_rows(spark):
    assert ex.pick_tables(hx.html_tables(pages(spark)), [9]).count() == 0


def test_lists_and_headings(spark):
    items = hx.html_rows(pages(spark), kind="list").orderBy("row_idx").collect()
    assert [r["cells"][0] for r in items] == ["First", "Second item"]
    h = {r["page_id"]: r for r in hx.page_headings(pages(spark)).collect()}
    assert h[1]["title"] == "T & U" and h[1]["h1"] == "Head line" and h[2]["h1"] is None
