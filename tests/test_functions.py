"""Golden values and properties of the per-text helpers."""

import datetime as dt
import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions import decode, extract
from quillspark.functions import text as tx

TODAY = dt.date(2026, 5, 20)


@pytest.mark.parametrize(
    ("text", "order", "day"),
    [
        ("Sent 07/08/2024", "DMY", "2024-08-07"),
        ("Sent 07/08/2024", "MDY", "2024-07-08"),
        ("Host 154.127.37.204 answered", "DMY", None),
        ("Pay by 2031-01-01. Written 4. Mai 2026", "DMY", "2026-05-04"),
        ("31.02.2024 then 1.3.2024", "DMY", "2024-03-01"),
        ("March 3, 2020", "DMY", "2020-03-03"),
        ("12th of June 2019", "DMY", "2019-06-12"),
        ("on 25/12/99", "MDY", "1999-12-25"),
        ("", "DMY", None),
        (None, "DMY", None),
    ],
)
def test_dates(text, order, day):
    assert extract.document_date(text, TODAY, order) == (day and dt.date.fromisoformat(day))


@pytest.mark.parametrize(("printed", "amount"), [("2.750,5", "2750.50"), ("3,400", "3400"), ("0012,30", "12.30"), ("1'234.5", "1234.50"), ("7", "7")])
def test_amounts(printed, amount):
    assert extract.parse_amount(printed) == amount


@given(st.integers(0, 10**9), st.integers(0, 99))
def test_amount_round_trip(whole, cents):
    assert extract.parse_amount(f"{whole:,}.{cents:02d}") == f"{whole}.{cents:02d}"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Hafen Kiosk\nWasser 1,20\nSumme 1,20 EUR", ("Hafen Kiosk", "1.20", "EUR")),
        ("Corner Shop\nSubtotal 8.00\nTotal $8.64", ("Corner Shop", "8.64", None)),
        ("INVOICE\nAcme Tools\nGrand total\n£ 12.00", ("Acme Tools", "12.00", "GBP")),
        ("A letter without amounts", (None, None, None)),
        ("Total 12", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_receipts(text, found):
    assert tuple(extract.extract_receipt(text).values()) == found


def test_passages():
    assert tx.plain_passages("aa bb.\n\ncc dd.", 12) == ["aa bb.", "cc dd."]
    assert tx.heading_passages("# A\n### B\nx") == [("A › B", "x")]
    assert tx.heading_passages("---\na: 1\n---\n# A\n```\n# no\n```\n## C\ny") == [("A", "``` # no ```"), ("A › C", "y")]
    assert tx.row_passages('k;v\n1;"a\nb"') == [("k;v", '1;"a\nb"')]
    assert tx.row_passages("only") == [(None, "only")]
    assert tx.passages(None, None, None) == []


@settings(max_examples=60)
@given(st.text(alphabet="ab .!?\n", max_size=300), st.integers(5, 40))
def test_passages_keep_all_words_and_the_limit(text, most):
    found = tx.plain_passages(text, most)
    assert all(p.strip() and len(p) <= most for p in found)
    assert "".join("".join(found).split()) == "".join(text.split())


def test_decoding():
    assert decode.decode_text("héllo".encode()) == "héllo"
    assert decode.decode_text(b"\xff\xfe" + "hé".encode("utf-16-le")) == "hé"
    assert decode.decode_text("plain words here".encode("utf-16-be")) == "plain words here"
    assert decode.decode_text(b'<meta charset="iso-8859-1">caf\xe9', True).endswith("café")
    assert decode.decode_text(None) is None
    assert decode.decode_text(b"") == ""


def test_html():
    page = "<html><head><title>t</title></head><body><h1>Top</h1><p>one <b>two</b><br>three</p><script>x</script><h2></h2><p hidden>no</p><table><tr><td>a<td>b</tr></table></body>"
    assert decode.html_text(page) == "# Top\n\none two\nthree\n\na b"
    assert decode.html_text(None) is None


def test_epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/a.xhtml", "<html><body><h1>One</h1><p>x</p></body></html>")
        z.writestr("o/b.xhtml", "<html><body><p>y</p></body></html>")
    assert decode.read_epub(out.getvalue()) == [("One", 1, "x"), (None, 0, "y")]


def test_hash_embedding_is_a_unit_vector():
    v = tx.hash_embedding("Alpha beta alpha")
    assert abs(sum(x * x for x in v) - 1) < 1e-9
    assert tx.hash_embedding("") == [0.0] * 384
