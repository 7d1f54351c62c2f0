"""Addresses and headers."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_INPUT = 2048
# File names that aren't pages.
FILE_EXT = r"(?i)\.(pdf|jpe?g|png|gif|webp|avif|svg|ico|zip|rar|7z|docx?|xlsx?|pptx?|mp4|mp3|avi|mov|webm|css|js|json|xml|txt|woff2?|ttf|eot|exe|dmg|apk)$"

_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]*://", re.I)


def _normalized(raw: str | None) -> tuple[str | None, str | None]:
    value = (raw or "").strip()
    if not value:
        return None, "empty"
    if len(value) > MAX_INPUT:
        return None, "too long"
    try:
        url = urlsplit(value if _SCHEME.match(value) else "https://" + value)
        host, port = url.hostname or "", url.port
        host = host.encode("idna").decode() if not host.isascii() else host
    except (ValueError, UnicodeError):
        return None, "not an address"
    if url.scheme.lower() not in ("http", "https"):
        return None, "other scheme"
    if not host or re.search(r"[\s<>^|%]", host):
        return None, "not an address"
    if url.username or url.password:
        return None, "credentials"
    try:
        ipaddress.ip_address(host)
        return None, "not public"
    except ValueError:
        pass
    if "." not in host or host.endswith(".local") or host == "localhost":
        return None, "not public"
    scheme = url.scheme.lower()
    shown = "" if port is None or port == {"http": 80, "https": 443}[scheme] else f":{port}"
    return f"{scheme}://{host}{shown}/", None


def normalize_input_url(raw: Column) -> Column:
    """STRUCT url, error: the root address of what a visitor typed (https by default, IDN as punycode), or why there is none. An Arrow UDF."""

    @F.arrow_udf("url string, error string")
    def normalize(values: pa.Array) -> pa.Array:
        found = [_normalized(v.as_py()) for v in values]
        return pa.StructArray.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["url", "error"])

    return normalize(raw)


def without_dots(path: Column) -> Column:
    """A path from / on without . and .. segments, escaped ones included; what .. leaves ends in /."""
    dot, up = (lambda x: F.lower(x).isin(".", "%2e")), (lambda x: F.lower(x).isin("..", ".%2e", "%2e.", "%2e%2e"))
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda acc, x: F.when(up(x), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(dot(x), acc).otherwise(F.concat(acc, F.array(x))))
    last = F.element_at(parts, -1)
    plain = F.concat(F.lit("/"), F.array_join(F.when(dot(last) | up(last), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))
    # most paths have no such segment
    return F.when(path.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)"), plain).otherwise(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def resolve(href: Column, base: Column) -> Column:
    """The http(s) address of a reference on a page at `base`, without its fragment, as browsers read it; null of others.

    Tabs and line ends within and blanks around go; backslashes before a query are slashes; the host is lower-cased, its default port
    dropped; . and .. segments are worked out, escaped ones too. Letters beyond ASCII and other escapes stay as they are. The
    same as auditloom.sources.html.absolute. Null of a null."""
    h = F.regexp_replace(F.regexp_replace(F.regexp_replace(href, "[\t\n\r]", ""), "^[\x00-\x20]+|[\x00-\x20]+$", ""), "(?s)#.*$", "")
    head = F.translate(F.regexp_extract(h, r"(?s)^([^?]*)", 1), "\\", "/")
    query = F.regexp_extract(h, r"(?s)(\?.*)$", 1)
    scheme_of, authority_of = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(base, r"://([^/?#]*)", 1)
    path_of, query_of = F.regexp_extract(base, r"://[^/?#]*([^?#]*)", 1), F.regexp_extract(base, r"(\?[^#]*)", 1)
    own = F.lower(F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(head, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    with_host = rest.startswith("//") | ((own != "") & (own != scheme_of))
    behind = F.regexp_replace(rest, "^/+", "")
    scheme = F.when(own != "", own).otherwise(scheme_of)
    authority = F.lower(F.when(with_host, F.regexp_extract(behind, "^([^/]*)", 1)).otherwise(authority_of))
    authority = F.regexp_replace(authority, F.when(scheme == "http", ":(80)?$").otherwise(":(443)?$"), F.lit(""))
    path = F.when(with_host, F.regexp_replace(behind, "^[^/]*", "")).when(rest == "", path_of).when(rest.startswith("/"), rest).otherwise(F.concat(F.regexp_replace(path_of, "[^/]*$", ""), rest))
    asked = F.when(~with_host & (rest == "") & (query == ""), query_of).otherwise(query)
    found = F.concat(scheme, F.lit("://"), authority, without_dots(path), asked)
    return F.when(scheme.isin("http", "https") & (F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1) != ""), found)


def is_private_ip(ip: Column) -> Column:
    """Whether an address is of a loopback, private, link-local, shared or reserved range; of an IPv4 address mapped into IPv6, that address counts."""
    v = F.regexp_replace(F.lower(ip), r"^::ffff:(?=[0-9.]+$)", "")
    part = lambda i: F.try_element_at(F.split(v, r"\."), F.lit(i)).try_cast("int")
    a, b = part(1), part(2)
    v4 = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return F.when(v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), v4).otherwise(v.isin("::1", "::") | v.rlike("^(fc|fd|fe80)"))


def short_url(url: Column) -> Column:
    """Host, path and query."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), F.concat(F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"(\?[^#]+)", 1))).otherwise(url)


def shortened(url: Column) -> Column:
    """Host and decoded path with its query (escapes of ;/?:@&=+$,# stay); of over 60 characters, the first 24 and the last 30."""
    at = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    raw = F.concat(F.when(at == "", "/").otherwise(at), F.regexp_extract(url, r"(\?[^#]+)", 1))
    path = F.coalesce(F.try_url_decode(F.regexp_replace(F.replace(raw, F.lit("+"), F.lit("%2B")), "(?i)%(3B|2F|3F|3A|40|26|3D|2B|24|2C|23)", "%25$1")), raw)
    path = F.replace(path, F.lit("%2B"), F.lit("+"))
    return F.concat(F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)), F.when(F.length(path) > 60, F.concat(F.left(path, F.lit(24)), F.lit("…"), F.right(path, F.lit(30)))).otherwise(path))


def is_file(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1).rlike(FILE_EXT)


def is_html(content_type: Column, body: Column) -> Column:
    """By the content type, or, without one, by the first 1000 characters."""
    kind = F.coalesce(content_type, F.lit(""))
    return kind.rlike("(?i)html") | ((kind == "") & F.left(F.coalesce(body, F.lit("")), F.lit(1000)).rlike("(?i)<html|<!doctype html"))


def header(headers: Column, name: str) -> Column:
    """'' without it. Names of headers are in lower case."""
    return F.coalesce(F.try_element_at(headers, F.lit(name.lower())), F.lit(""))


def charset_from_header(content_type: Column) -> Column:
    """Lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(content_type, r"""(?i)charset\s*=\s*["']?([A-Za-z0-9_-]+)""", 1)), F.lit(""))


def client_ip(forwarded_for: Column, real_ip: Column) -> Column:
    first = F.nullif(F.trim(F.split(F.coalesce(forwarded_for, F.lit("")), ",")[0]), F.lit(""))
    return F.coalesce(first, F.nullif(real_ip, F.lit("")), F.lit("local"))
