"""HTML pages to one typed row each: the silver table that every page check reads.

Parsing is the one step that Spark's functions can't express; it runs once, in Arrow batches, and all checks share it.
Text keeps no mark where a tag stood (`<li>a</li><li>b</li>` reads `ab`), as a DOM's text does. Null and empty pages give
empty fields; of a page that the parser gives up on, what came before is kept and parse_failed is true. noscript content is
parsed as elements. Marked sections (`<![...]>`) are comments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from auditloom.tables import small_batches

#: Runs of white space that aren't one space already.
RUNS = re.compile(r"(?:[^\S ]|\ufeff)[\s\ufeff]*| [\s\ufeff]+")
#: What a word holds from its first letter or digit on.
_FROM_LETTER = re.compile(r"[^\W_][^ ]*")
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
UNSEEN = frozenset("script style noscript svg template iframe".split())

_S, _B, _I = T.StringType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SILVER = _struct(
    title=_S, description=_S, keywords_meta=_S, viewport=_S, meta_robots=_S, meta_charset=_S, lang=_S, canonicals=T.ArrayType(_S),
    h1=T.ArrayType(_S), headings=T.ArrayType(_struct(level=_I, text=_S)), og=T.MapType(_S, _S), twitter=T.MapType(_S, _S),
    jsonld=T.ArrayType(_struct(error=_S, types=T.ArrayType(_S))),
    links=T.ArrayType(_struct(href=_S, abs=_S, text=_S, rel=_S, internal=_B, aria_label=_S, has_img_alt=_B, in_nav=_B, target=_S)),
    images=T.ArrayType(_struct(src=_S, abs=_S, alt=_S, width=_S, height=_S, srcset=_S, in_picture=_B, has_aspect_ratio=_B)),
    forms=T.ArrayType(_struct(is_search=_B, personal_fields=_I, unlabeled_fields=_I, consent_checkbox=_B, consent_prechecked=_B, consent_text=_B, spam_protected=_B)),
    text=_S, top_text=_S, words=_I, styles=_S, scripts=T.ArrayType(_S), stylesheets=T.ArrayType(_S), inline_chars=_I, has_main=_B, has_breadcrumbs=_B, has_icon=_B, nav_present=_B,
    nav_anchors=_I, nav_fake=_I, lists_3plus=_I, n_tables=_I, n_dl=_I, n_details=_I, n_flash=_I, has_apple_icon=_B, has_theme_color=_B, bare_table=_B,
    unnamed_buttons=_I, autoplay_sound=_B, has_referrer=_B, canonical_abs=T.ArrayType(_S), max_fixed_width=_I, tiny_font=_B, fluid_images=_B, parse_failed=_B,
)


class Node:
    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        todo = [k for k in reversed(self.kids) if not isinstance(k, str)]
        while todo:
            node = todo.pop()
            yield node
            todo += [k for k in reversed(node.kids) if not isinstance(k, str)]

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out, todo = [], list(reversed(self.kids))
        while todo:
            kid = todo.pop()
            if isinstance(kid, str):
                out.append(kid)
            elif kid.tag not in skip:
                todo += reversed(kid.kids)
        return "".join(out)

    def above(self) -> Iterator[Node]:
        node = self.up
        while node is not None:
            yield node
            node = node.up


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = ENDS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        while self.at.tag in ends:
            self.at = self.at.up
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        node = Node(tag, found, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)


def collapse(s: str) -> str:
    return RUNS.sub(" ", s).strip()


_DOT, _UP = re.compile(r"(?i)^(\.|%2e)$"), re.compile(r"(?i)^(\.|%2e){2}$")


def absolute(href: str, base: str) -> str | None:
    """The http(s) address of a reference, without its fragment; the same as functions.urls.resolve."""
    href = re.sub(r"[\t\n\r]", "", href).strip("".join(map(chr, range(33)))).partition("#")[0]
    head, mark, query = href.partition("?")
    head = head.replace("\\", "/")
    of = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*)([^?#]*)(\?[^#]*)?)?", base)
    scheme_of, authority_of, path_of, query_of = (of[1].lower(), of[2] or "", of[3] or "", of[4] or "") if of else ("", "", "", "")
    own = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", head)
    rest = head[own.end() :] if own else head
    scheme = own[1].lower() if own else scheme_of
    with_host = rest.startswith("//") or bool(own) and scheme != scheme_of
    authority, path = authority_of, path_of
    if with_host:
        authority, slash, path = rest.lstrip("/").partition("/")
        path = slash + path
    elif rest:
        path = rest if rest.startswith("/") else path_of[: path_of.rfind("/") + 1] + rest
    authority = re.sub(":(80)?$" if scheme == "http" else ":(443)?$", "", authority.lower())
    if scheme not in ("http", "https") or not re.match(r"(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", authority)[1]:
        return None
    parts, kept = path.removeprefix("/").split("/"), []
    for x in parts:
        if _UP.match(x):
            del kept[-1:]
        elif not _DOT.match(x):
            kept.append(x)
    if _UP.match(parts[-1]) or _DOT.match(parts[-1]):
        kept.append("")
    asked = mark + query if with_host or rest or mark else query_of
    return f"{scheme}://{authority}/{'/'.join(kept)}{asked}"


def site_of(url: str) -> str:
    try:
        return re.sub(r"^www\.", "", (urlsplit(url).hostname or "").lower())
    except ValueError:
        return ""


def _types(data: object) -> Iterator[str]:
    if isinstance(data, list):
        for x in data:
            yield from _types(x)
    elif isinstance(data, dict):
        own = data.get("@type")
        yield from ([own] if isinstance(own, str) else [x for x in own if isinstance(x, str)] if isinstance(own, list) else [])
        for v in data.values():
            if isinstance(v, dict | list):
                yield from _types(v)


def _no_constant(name: str) -> None:
    raise ValueError(f"not JSON: {name}")


def _jsonld(raw: str) -> dict:
    try:
        return {"error": None, "types": list(_types(json.loads(raw, parse_constant=_no_constant)))}
    except (ValueError, RecursionError) as e:
        return {"error": str(e), "types": []}


# Words by which a form's fields, consent and spam protection are known, and patterns over styles.
_CONSENT = re.compile(r"(соглас|персональн|обработк[A-Za-z0-9_]* данных|политик[A-Za-z0-9_]* конфиденц|consent|privacy)", re.I)
_PERSONAL = re.compile(r"(name|имя|фио|phone|tel|телефон|mail|почт|contact|fio)", re.I)
_CAPTCHA = re.compile(r"(smartcaptcha|captcha|recaptcha|hcaptcha|turnstile|honeypot|hp-field|cf-turnstile)", re.I)
_HONEYPOT_NAMES = ("website", "hp", "honeypot", "url_confirm")
_SEARCH_ACTION, _SEARCH_NAME = re.compile("search|поиск", re.I), re.compile("^(q|s|search|query|text)$", re.I)
_FLOW = re.compile(r"overflow|scroll|table-responsive|table-wrap", re.I)
_DESKTOP_MEDIA = re.compile(r"@media[^{]*min-width[^{]*\{", re.I)
_FIXED_WIDTH = re.compile(r"(?:^|[;{\s])width\s*:\s*([0-9]{3,5})px", re.I)
_TINY_FONT = re.compile(r"font-size\s*:\s*([0-9]+(?:\.[0-9]+)?)px", re.I)
_FLUID_IMAGES = re.compile(r"img[^{]*\{[^}]*max-width\s*:\s*100%", re.I)


def mobile_css(css: str) -> str:
    """css without its blocks for wide screens only, however deep they nest."""
    out, at = [], 0
    while m := _DESKTOP_MEDIA.search(css, at):
        out.append(css[at : m.start()])
        depth, at = 1, m.end()
        while depth and at < len(css):
            brace = min((x for x in (css.find("{", at), css.find("}", at)) if x >= 0), default=len(css))
            if brace == len(css):
                at = brace
                break
            depth += 1 if css[brace] == "{" else -1
            at = brace + 1
    return "".join([*out, css[at:]])


def css_facts(css: str | None) -> dict:
    """The widest fixed width outside of blocks for wide screens, a font of 0 to 12 pixels, and images that shrink."""
    css = css or ""
    return {
        "max_fixed_width": max((int(m) for m in _FIXED_WIDTH.findall(mobile_css(css))), default=0),
        "tiny_font": any(0 < float(m) < 12 for m in _TINY_FONT.findall(css)),
        "fluid_images": bool(_FLUID_IMAGES.search(css)),
    }


def _labelled(field: Node, labels: dict[str, str]) -> bool:
    a = field.attrs
    return bool(a.get("aria-label", "").strip() or a.get("aria-labelledby") or a.get("title", "").strip() or any(x.tag == "label" for x in field.above()) or a.get("id") and a["id"] in labels)


def _form(form: Node, labels: dict[str, str]) -> dict:
    inside = list(form.walk())
    kind = lambda x: x.attrs.get("type", "").lower()
    fields = [x for x in inside if x.tag in ("select", "textarea", "input") and (kind(x) or "text") not in ("hidden", "submit", "button", "image", "reset")]
    typed = [x for x in fields if kind(x) not in ("checkbox", "radio")]
    boxes = [x for x in inside if x.tag == "input" and kind(x) == "checkbox"]
    about = lambda x: " ".join(x.attrs.get(k, "") for k in ("name", "placeholder", "id"))

    def around(x: Node) -> str:
        label = next((y.text() for y in x.above() if y.tag == "label"), "")
        return " ".join([label, labels.get(x.attrs.get("id") or "", ""), x.up.text(), x.attrs.get("name", "")])

    consent = [x for x in boxes if _CONSENT.search(around(x))]
    a_search = any(_SEARCH_NAME.search(x.attrs.get("name", "")) or x.attrs.get("type") == "search" for x in typed)
    marks = " ".join(" ".join([x.tag, *x.attrs, *x.attrs.values(), *(k for k in x.kids if isinstance(k, str))]) for x in [form, *inside])
    return {
        "is_search": form.attrs.get("role") == "search" or bool(_SEARCH_ACTION.search(form.attrs.get("action", ""))) or len(typed) <= 1 and a_search,
        "personal_fields": sum(kind(x) in ("tel", "email") or bool(_PERSONAL.search(about(x))) for x in typed), "unlabeled_fields": sum(not _labelled(x, labels) for x in fields),
        "consent_checkbox": bool(consent), "consent_prechecked": any("checked" in x.attrs for x in consent), "consent_text": bool(_CONSENT.search(collapse(form.text()))),
        "spam_protected": bool(_CAPTCHA.search(marks)) or any(x.attrs.get("name", "").lower() in _HONEYPOT_NAMES for x in inside),
    }


def parse(page: str | None, url: str | None) -> dict:
    page, url = page or "", url or ""
    tree, failed = _Tree(), False
    try:
        tree.feed(page)
        tree.close()
    except (AssertionError, ValueError, IndexError):  # what html.parser raises over markup that it can't read
        failed = True
    every = list(tree.root.walk())
    by: dict[str, list[Node]] = {}
    for x in every:
        by.setdefault(x.tag, []).append(x)
    of = lambda *tags: [x for t in tags for x in by.get(t, ())]
    meta = {}
    for m in of("meta"):
        meta.setdefault(m.attrs.get("name", "").lower(), m.attrs.get("content", "").strip())
    site = site_of(url)
    body = by.get("body", [tree.root])[0]
    unseen = UNSEEN if "body" in by else UNSEEN | {"head", "title"}
    text = collapse(body.text(unseen))
    has_main = bool(by.get("main")) or any(x.attrs.get("role") == "main" for x in every)
    content = by.get("main", [body])[0]
    labels: dict[str, str] = {}
    for x in of("label"):
        if x.attrs.get("for"):
            labels[x.attrs["for"]] = labels.get(x.attrs["for"], "") + x.text()
    titles = [t for t in of("title") if any(a.tag == "head" for a in t.above())] or of("title")
    jsonld = [_jsonld(s.text().strip()) for s in of("script") if s.attrs.get("type", "").lower() == "application/ld+json"]
    headings = [x for x in every if x.tag in _HEADINGS]
    navs = [x for x in every if x.tag in ("nav", "header") or x.attrs.get("role") == "navigation"]
    in_nav = list({id(x): x for n in navs for x in n.walk()}.values())
    rels = [(x, x.attrs.get("rel", "").lower().split()) for x in of("link")]
    links = []
    for a in of("a"):
        if "href" in a.attrs:
            href = a.attrs["href"].strip()
            full = absolute(href, url)
            links.append({
                "href": href, "abs": full, "text": collapse(a.text()), "rel": a.attrs.get("rel", "").lower(), "internal": full is not None and site_of(full) == site,
                "aria_label": (a.attrs.get("aria-label") or a.attrs.get("title") or "").strip(), "has_img_alt": any(x.tag == "img" and x.attrs.get("alt", "").strip() for x in a.walk()),
                "in_nav": any(x.tag in ("nav", "header") or x.attrs.get("role") == "navigation" for x in a.above()), "target": a.attrs.get("target", "").lower(),
            })
    images = []
    for i in of("img"):
        src = (i.attrs.get("src") or i.attrs.get("data-src") or "").strip()
        images.append({
            "src": src, "abs": None if src.startswith("data:") or not src else absolute(src, url), "alt": i.attrs.get("alt"), "width": i.attrs.get("width"), "height": i.attrs.get("height"),
            "srcset": i.attrs.get("srcset") or i.attrs.get("data-srcset"), "in_picture": i.up.tag == "picture" and any(x.tag == "source" and "srcset" in x.attrs for x in i.up.walk()), "has_aspect_ratio": "aspect-ratio" in i.attrs.get("style", "").lower(),
        })
    charset = next((m.attrs["charset"] for m in of("meta") if "charset" in m.attrs), None)
    if charset is None:
        typed = next((m.attrs.get("content", "") for m in of("meta") if m.attrs.get("http-equiv", "").lower() == "content-type"), "")
        found = re.search(r"charset\s*=\s*[\"']?([\w-]+)", typed, re.I | re.A)
        charset = found[1] if found else None
    canonicals = [x.attrs.get("href", "").strip() for x, _ in rels if x.attrs.get("rel", "").lower() == "canonical"]
    styles = "\n".join([x.text() for x in of("style")] + [f"x{{{x.attrs['style']}}}" for x in every if "style" in x.attrs])
    html_lang = next((x.attrs.get("lang", "").strip() for x in of("html")), "")
    no_name = lambda b: not (collapse(b.text()) or any(b.attrs.get(k) for k in ("aria-label", "title", "aria-labelledby")) or any(x.tag == "img" and x.attrs.get("alt", "").strip() for x in b.walk()))
    lists = [x for x in content.walk() if x.tag in ("ul", "ol") and sum(not isinstance(k, str) and k.tag == "li" for k in x.kids) >= 3 and not any(a.tag in ("nav", "header", "footer") for a in x.above())]
    inner = list(content.walk())
    found = {
        "title": (titles[0].text().strip() or None) if titles else None, "description": meta.get("description"), "keywords_meta": meta.get("keywords"), "viewport": meta.get("viewport"),
        "meta_robots": ",".join(v for k in ("robots", "yandex", "googlebot") if (v := meta.get(k))).lower(), "meta_charset": None if charset is None else charset.lower(), "lang": html_lang or None,
        "canonicals": canonicals, "canonical_abs": [absolute(c, url) for c in canonicals], "h1": [collapse(x.text()) for x in of("h1")],
        "headings": [{"level": int(x.tag[1]), "text": collapse(x.text())} for x in headings],
        "og": [(m.attrs["property"].lower(), m.attrs.get("content", "").strip()) for m in {m.attrs["property"].lower(): m for m in of("meta") if m.attrs.get("property", "").startswith("og:")}.values()],
        "twitter": list({k.lower(): m.attrs.get("content", "").strip() for m in of("meta") for k in (m.attrs.get("name", ""), m.attrs.get("property", "")) if k.startswith("twitter:")}.items()),
        "jsonld": jsonld, "links": links, "images": images, "forms": [_form(f, labels) for f in of("form")], "text": text,
        "top_text": collapse(content.text(unseen | {"header", "nav", "footer"}))[:1500], "words": len(_FROM_LETTER.findall(text)),
        "styles": styles, **css_facts(styles), "parse_failed": failed,
        "stylesheets": [s for x, r in rels if "stylesheet" in r and "href" in x.attrs and (s := absolute(x.attrs["href"], url))],
        "scripts": [s for x in of("script") if x.attrs.get("src") and (s := absolute(x.attrs["src"], url))], "inline_chars": sum(len(x.text()) for x in of("script") if "src" not in x.attrs),
        "has_main": has_main, "has_breadcrumbs": any("breadcrumb" in f"{x.attrs.get('class', '')} {x.attrs.get('aria-label', '')}".lower() or "crumbs" in x.attrs.get("class", "").lower() or "BreadcrumbList" in x.attrs.get("itemtype", "") for x in every) or any("BreadcrumbList" in b["types"] for b in jsonld),
        "has_icon": any("icon" in r for _, r in rels), "nav_present": bool(navs), "nav_anchors": sum(x.tag == "a" and "href" in x.attrs and not re.match("#|javascript:", x.attrs["href"], re.I) for x in in_nav),
        "nav_fake": sum("onclick" in x.attrs or x.tag == "a" and x.attrs.get("href", "").startswith("javascript:") or x.tag in ("span", "div") and x.attrs.get("role") == "link" for x in in_nav), "lists_3plus": len(lists),
        "n_tables": sum(x.tag == "table" for x in inner), "n_dl": sum(x.tag == "dl" for x in inner), "n_details": sum(x.tag == "summary" and any(a.tag == "details" for a in x.above()) for x in every),
        "n_flash": sum(x.tag == "applet" or x.tag == "object" and ("flash" in x.attrs.get("type", "") or x.attrs.get("data", "").endswith(".swf")) or x.tag == "embed" and x.attrs.get("src", "").endswith(".swf") for x in every),
        "has_apple_icon": any("apple-touch-icon" in x.attrs.get("rel", "").lower() for x, _ in rels), "has_theme_color": "theme-color" in meta,
        "bare_table": any(not any(_FLOW.search(f"{a.attrs.get('class', '')} {a.attrs.get('style', '')}") for a in t.above()) for t in of("table")), "unnamed_buttons": sum(map(no_name, of("button"))),
        "autoplay_sound": any("autoplay" in x.attrs and (x.tag == "audio" or "muted" not in x.attrs) for x in of("video", "audio")), "has_referrer": "referrer" in meta,
    }
    for x in (tree.root, *every):  # a tree refers to itself in circles; without them it goes at once, not when the collector comes by
        x.kids = x.up = None
    return found


#: Bytes of html whose facts a Python worker holds at once; a longer page is held alone.
HELD_BYTES = 1 << 20


def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose second column (html) has HELD_BYTES together at most, or single rows beyond that."""
    first, held = 0, 0
    for i, size in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if i > first and held + (size or 0) > HELD_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size or 0
    if first < batch.num_rows:
        yield batch.slice(first)


def parse_pages(pages: DataFrame, homes: bool = True) -> DataFrame:
    """(page_id, url, html and more) to page_id, site, url, html, path, depth, is_home, the silver columns, and what else pages have
    (status, headers, bytes, ttfb_ms, say). The home page is the one of the least (depth, page_id) of its site, told from the urls alone.
    homes: whether to tell it, which takes a join; else is_home is left out."""
    kind = to_arrow_schema(SILVER)
    places = located(pages)
    base = places.select("url", "html", *[c for c in places.columns if c not in ("url", "html", "is_home", *SILVER.names)])
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if base.rdd.getNumPartitions() < cores:  # a small table in one file; parsing takes longer than dealing it out
        base = base.repartition(cores)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in bounded(batch)):
            found = [parse(h.as_py(), u.as_py()) for u, h in zip(part.column(0), part.column(1), strict=True)]
            fields = pa.RecordBatch.from_pylist(found, kind)
            del found
            yield pa.RecordBatch.from_arrays([*part.columns, *fields.columns], [*part.schema.names, *kind.names])

    small_batches(pages.sparkSession)
    out = base.mapInArrow(rows, T.StructType([*base.schema.fields, *SILVER.fields]))
    return with_home(out, places) if homes else out


def located(pages: DataFrame) -> DataFrame:
    """pages with url without its fragment, site, path and depth."""
    url = F.regexp_replace("url", "#.*$", "")
    site = F.regexp_replace(F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1)), r"^www\.", "")
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    return pages.withColumn("url", url).withColumns({"site": F.coalesce(site, F.lit("")), "path": path, "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != ""))})


def with_home(pages: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Adds is_home: a grouped minimum and a join on the site, whose hot sites Spark splits.

    places: the same pages where site, depth and page_id cost less to come by; else pages are worked out twice."""
    homes = (pages if places is None else places).groupBy("site").agg(F.min(F.struct("depth", "page_id")).alias("home")).select(F.col("site").alias("__site"), F.col("home.page_id").alias("__home"))
    return pages.join(homes, F.col("site") == F.col("__site")).withColumn("is_home", F.col("page_id").eqNullSafe(F.col("__home"))).drop("__site", "__home")
