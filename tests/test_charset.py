"""Bodies in the charsets of the web against Python's codecs."""

import pytest

from auditloom.sources import charset
from auditloom.sources.html import parse_pages

RU = "<title>Привет, мир</title>"


@pytest.mark.parametrize(
    ("body", "kind", "text", "label"),
    [
        (RU.encode(), "text/html", RU, "utf-8"),
        (b"\xef\xbb\xbf" + RU.encode(), None, RU, "utf-8"),
        (RU.encode("cp1251"), "text/html; charset=Windows-1251", RU, "windows-1251"),
        (RU.encode("koi8-r"), 'text/html; charset="KOI8-R"', RU, "koi8-r"),
        (("<meta charset=koi8-r>" + RU).encode("koi8-r"), "text/html", "<meta charset=koi8-r>" + RU, "koi8-r"),
        (("<META http-equiv='Content-Type' content='text/html; charset=windows-1251'>" + RU).encode("cp1251"), "", "<META http-equiv='Content-Type' content='text/html; charset=windows-1251'>" + RU, "windows-1251"),
        (("<meta charset=koi8-r>" + RU).encode("cp1251"), "text/html; charset=cp1251", "<meta charset=koi8-r>" + RU, "cp1251"),
        (RU.encode("cp1251"), "text/html; charset=utf-8", "<title>" + "�" * 6 + ", " + "�" * 3 + "</title>", "utf-8"),
        (b"a\xff\xc3\xe2\x82b\xf0\x9f", "text/html; charset=no-such", "a���b�", "utf-8"),
        (b"<meta charset=no-such>\xc3\xa9", None, "<meta charset=no-such>é", "utf-8"),
        (b"\x93quoted\x94 caf\xe9 \x81", "text/html; charset=iso-8859-1", "“quoted” café \x81", "iso-8859-1"),
        ("日本".encode("shift_jis"), "text/html; charset=Shift_JIS", "日本", "shift_jis"),
        ("中文".encode("gb2312"), "text/html; charset=gb2312", "中文", "gb2312"),
        ("été".encode("utf-16-le"), "text/html; charset=utf-16", "été", "utf-16"),
        (b" " * 5000 + b"<meta charset=koi8-r>\xc3\xa9", None, " " * 5000 + "<meta charset=koi8-r>é", "utf-8"),
        (b"x+AGE-", "text/html; charset=utf-7", "x+AGE-", "utf-8"),
        (b"", None, "", "utf-8"),
        (None, "text/html", None, None),
    ],
)
def test_bodies(body, kind, text, label):
    assert charset.decode_body(body, kind) == (text, label)


def test_every_known_charset_reads_what_its_codec_wrote():
    for name in charset.KNOWN:
        for text in ("plain", "é", "я", "日", "ß€"):
            try:
                sent = text.encode(name)
            except UnicodeEncodeError:
                continue
            assert charset.decode_body(sent, f"text/html; charset={name.replace('_', '-')}")[0] in (text, charset.decode_body(sent, None)[0])


def test_into_silver(spark):
    rows = [(1, "http://a.test/", RU.encode("cp1251"), "text/html; charset=windows-1251", "clash"), (2, "http://a.test/x", None, None, "clash")]
    bodies = spark.createDataFrame(rows, "page_id long, url string, body binary, content_type string, charset string")
    silver = {r.page_id: r for r in parse_pages(charset.decoded(bodies)).collect()}
    assert silver[1].title == "Привет, мир" and silver[1].charset == "windows-1251" and silver[2].title is None and silver[2].html is None
    back = bodies.where("page_id = 1").select(charset.encoded(charset.F.lit("мир ß"), charset.F.lit("windows-1251")).alias("b")).first().b
    assert bytes(back) == "мир ?".encode("cp1251")
    assert charset.decoded(bodies.limit(0)).collect() == []
