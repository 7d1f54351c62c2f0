"""Bodies as they were sent, decoded to text before they are parsed.

The charset of the Content-Type header counts; without one, UTF-8 is tried, and a charset that a meta tag in the first 4096 characters
names replaces it. Labels are the web's: iso-8859-1 and ascii mean windows-1252, gb2312 means gbk, and so on; a label the web doesn't
know means UTF-8 (from a header), or is passed over (from a tag). A byte order mark goes. What can't be decoded becomes U+FFFD; bytes
0x80 to 0x9F that a one-byte charset leaves open become the control characters of their number.

Null bodies have no text and no charset; empty ones are empty. One Arrow UDF; nothing is shuffled.
"""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META_CHARS = 4096
# Where a page declares its charset; charsets of the web by their Python names; labels that mean another charset.
_META = re.compile(r"""<meta[^>]+charset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.I)
_HEADER = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.I)
KNOWN = frozenset("utf-8 utf-16-le utf-16-be cp866 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 koi8-r koi8-u mac-roman mac-cyrillic cp874 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 gbk gb18030 big5hkscs euc_jp iso2022_jp cp932 cp949".split())
MEANS = {"iso8859-1": "cp1252", "ascii": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "tis-620": "cp874", "gb2312": "gbk", "big5": "big5hkscs", "shift_jis": "cp932", "euc_kr": "cp949", "utf-16": "utf-16-le"}
WEB_ONLY = {"unicode-1-1-utf-8": "utf-8", "x-cp1251": "cp1251", "x-cp1250": "cp1250", "x-cp1252": "cp1252", "x-gbk": "gbk", "x-sjis": "cp932", "windows-31j": "cp932", "x-mac-cyrillic": "mac-cyrillic", "macintosh": "mac-roman", "windows-949": "cp949", "ks_c_5601-1987": "cp949", "dos-874": "cp874", "windows-874": "cp874", "unicode": "utf-16-le", "koi": "koi8-r", "koi8": "koi8-r"}
# Letters that the query decoded_bodies puts for accented ones, of both charsets that it sends.
ACCENTED, CYRILLIC = "éèêçàùüäößñ", "иекзауюаожн"


def codec(label: str) -> str | None:
    """The Python codec of a label of the web, or None."""
    label = label.strip().lower()
    if label in WEB_ONLY:
        return WEB_ONLY[label]
    try:
        name = codecs.lookup(label).name
    except (LookupError, ValueError):
        return None
    name = MEANS.get(name, name)
    return name if name in KNOWN else None


def _open_byte(error: UnicodeError) -> tuple[str, int]:
    if not isinstance(error, UnicodeDecodeError):
        raise error
    one = error.object[error.start]
    return chr(one) if 0x80 <= one <= 0x9F else "�", error.start + 1


codecs.register_error("auditloom-open", _open_byte)


def _text(body: bytes, name: str) -> str:
    mark = {"utf-8": codecs.BOM_UTF8, "utf-16-le": codecs.BOM_UTF16_LE, "utf-16-be": codecs.BOM_UTF16_BE}.get(name, b"")
    if mark and body.startswith(mark):
        body = body[len(mark) :]
    one_byte = name.startswith(("cp1", "cp8", "iso8859", "koi8", "mac-"))
    text = body.decode(name, "auditloom-open" if one_byte else "replace")
    return re.sub("[\ud800-\udfff]", "�", text)


def decode_body(body: bytes | None, content_type: str | None) -> tuple[str | None, str | None]:
    """Text and the label by which it was decoded."""
    if body is None:
        return None, None
    said = _HEADER.search(content_type or "")
    label = said[1].lower() if said and codec(said[1]) else "utf-8"
    text = _text(body, codec(label) or "utf-8")
    if not said and (meta := _META.search(text[:META_CHARS])) and (name := codec(meta[1])) and meta[1].lower() != label:
        label, text = meta[1].lower(), _text(body, name)
    return text, label


def decoded(bodies: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """bodies with html and charset instead of the body; such columns are replaced. What parse_pages takes."""

    @F.arrow_udf("html string, charset string")
    def texts(sent: pa.Array, kinds: pa.Array) -> pa.Array:
        found = [decode_body(b.as_py(), k.as_py()) for b, k in zip(sent, kinds, strict=True)]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], ["html", "charset"])

    met = bodies.withColumn("__decoded", texts(F.col(body), F.col(content_type)))
    return met.withColumns({"html": F.col("__decoded.html"), "charset": F.col("__decoded.charset")}).drop("__decoded", *({body} - {"html"}))


def encoded(text: Column, charset: Column) -> Column:
    """Bytes of the text in a charset, with ? for what it lacks: the way back, for tests and made-up servers."""

    @F.arrow_udf("binary")
    def sent(texts: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else t.as_py().encode(codec(n.as_py() or "") or "utf-8", "replace") for t, n in zip(texts, names, strict=True)], pa.binary())

    return sent(text, charset)
