"""Three made-up sites: one that passes whatever applies, one that fails whatever applies, and one page without anything.

Pages are built from parts, so that each planted defect stands alone and by name."""

from __future__ import annotations

import json

WORDS = "apple branch cellar dew elder fence grape harvest ivy juniper kernel ladder meadow nettle orchard pear quince ripe shade twig umber vine willow yarrow".split()


def prose(n: int, start: int = 0) -> str:
    """n words in sentences; other starts give other texts."""
    return " ".join(f"{WORDS[(start + i * (start + 2)) % len(WORDS)]}{'abcdefghijklmn'[i // len(WORDS)]}{'.' * (i % 9 == 8)}" for i in range(n))


def element(tag: str, inside: str = "", **attrs: str) -> str:
    shown = "".join(f' {k.rstrip("_").replace("_", "-")}="{v}"' for k, v in attrs.items())
    return f"<{tag}{shown}>" if tag in ("meta", "link", "img", "input") else f"<{tag}{shown}>{inside}</{tag}>"


def document(head: list[str], body: list[str], lang: str = "en") -> str:
    root = f' lang="{lang}"' if lang else ""
    return f"<!DOCTYPE html><html{root}><head>{''.join(head)}</head><body>{''.join(body)}</body></html>"


GOOD = "https://orchard.test"
_MENU = element("nav", "".join(element("a", name, href=f"/{path}/") for name, path in (("Visits", "visits"), ("Trees", "trees"), ("Cellar", "cellar"), ("Privacy policy", "privacy"), ("Season", "season"), ("Cider press", "trees/press"))))
_FOOTER = element("footer", "This orchard uses cookie files. " + element("a", "Call us", href="tel:+4312345") + element("a", "Growers", href="https://growers.test/", rel="noopener"))
_SCRIPT = element("script", "ym(4711, 'init');")


def _good(path: str, title: str, start: int, more: str = "", head: tuple[str, ...] = (), types: tuple[str, ...] = ("Product",)) -> str:
    about = f"{title}: what the season brings, how long a visit takes and what there is to taste afterwards."
    data = json.dumps([{"@type": t, "name": title} for t in types])
    return document(
        [
            element("meta", charset="utf-8"), element("title", title), element("meta", name="description", content=about), element("meta", name="viewport", content="width=device-width, initial-scale=1"),
            element("link", rel="canonical", href=GOOD + path), element("link", rel="icon", href="/favicon.ico"), *(element("meta", property=f"og:{k}", content=v) for k, v in (("title", title), ("description", about), ("image", "/o.webp"))),
            element("script", data, type="application/ld+json"), *head,
        ],
        [
            element("header", _MENU), element("main", element("h1", path.strip("/").rpartition("/")[2].title() or "Old trees") + (element("div", "Home / Trees", class_="breadcrumbs") if path.count("/") > 2 else "") + element("h2", "This year") + more + element("p", prose(260, start))),
            element("img", src="/trees.webp", alt="Old trees in bloom", width="400", height="300", srcset="/trees2.webp 2x"), _FOOTER, _SCRIPT,
        ],
    )


_ORDER = element("form", "".join([
    element("label", "Your name " + element("input", name="name")), element("label", "Mail " + element("input", type="email", name="mail")), element("label", element("input", type="checkbox", name="consent") + " I give consent"),
    element("input", type="hidden", name="captcha"), element("button", "Order"),
]), action="/order/")
_HOME = (
    element("p", "A visit takes 2 hours, from 1 200 ₽ a person, 10 people at most, in 2 groups.") + element("details", element("summary", "When?") + "In May.") + element("details", element("summary", "Where?") + "By the river.")
    + element("ul", "".join(element("li", x) for x in ("Apples", "Pears", "Quinces"))) + _ORDER
)
_HOME_HEAD = (
    *(element("meta", property=f"og:{k}", content=v) for k, v in (("url", GOOD + "/"), ("type", "website"))), *(element("meta", name=f"twitter:{k}", content=v) for k, v in (("card", "summary"), ("image", "/o.webp"))),
    element("link", rel="apple-touch-icon", href="/touch.png"), element("meta", name="theme-color", content="#335533"), element("link", rel="stylesheet", href="/main.css"),
)
GOOD_PAGES = {
    "/": _good("/", "Old orchard by the river: visits and tastings", 1, _HOME, _HOME_HEAD, ("Organization", "WebSite", "FAQPage")),
    "/visits/": _good("/visits/", "Visits to the orchard from May to October", 2),
    "/trees/": _good("/trees/", "Trees of the orchard and their ages and sorts", 3),
    "/cellar/": _good("/cellar/", "The cellar below the house and what it holds", 4),
    "/privacy/": _good("/privacy/", "What the orchard does with the data of guests", 5),
    "/season/": _good("/season/", "A year in the orchard, one month after another", 6),
    "/trees/press/": _good("/trees/press/", "The cider press, four hundred years of it here", 7, types=("BreadcrumbList",)),
}
GOOD_HEADERS = {
    "content-type": "text/html; charset=utf-8", "content-encoding": "gzip", "server": "nginx", "strict-transport-security": "max-age=63072000", "x-frame-options": "DENY", "x-content-type-options": "nosniff",
    "content-security-policy": "default-src 'self'", "referrer-policy": "no-referrer", "permissions-policy": "camera=()", "last-modified": "Mon, 02 Mar 2026 10:00:00 GMT",
}
#: What can't apply to a site without defects of its kind.
GOOD_NA: set[str] = set()

BAD, SECURE = "http://wreck.test", "https://wreck.test"
_STUFFED = "Scrap scrap SCRAP"
_BAD_FORM = element("form", element("input", name="phone") + element("input", name="mail"))
_PRECHECKED = element("form", element("input", name="phone") + element("p", element("input", type="checkbox", name="agree", checked="") + "consent") + element("button"))
BAD_PAGES = {
    BAD + "/": (503, document(
        [element("title", "Home"), element("meta", charset="windows-1251"), element("meta", name="viewport", content="user-scalable=no")],
        [element("nav", element("span", "Menu", role="link", onclick="go()")), element("div", "", id="app"), "Hello"], lang="")),
    BAD + "/Scrap%20Yard.php?id=7": (200, document(
        [element("title", _STUFFED), element("meta", name="description", content="Welcome to the site"), element("meta", name="keywords", content=",".join("abcdefghijklm")), element("meta", name="robots", content="noindex"),
         element("link", rel="canonical", href="//other.test/"), element("link", rel="canonical", href="/x"), element("script", "{'broken'", type="application/ld+json"), element("style", ".page { width: 900px; font-size: 8px }")],
        [element("h1", "scrap  scrap scrap"), element("h1", ""), element("h4", ""), element("img", src="IMG_001.jpg", alt="IMG_001.jpg", width="900"), element("img", src="x.png"), element("img", src=""), element("a", "", href="https://out.test/"),
         element("object", "", data="film.swf"), "<video autoplay></video>", "lorem ipsum", _BAD_FORM, _PRECHECKED, element("script", "", src="https://www.google-analytics.com/a.js"),
         *(element("a", f"w{i}", href=f"/w{i}" + "/" * (i % 2)) for i in range(6)), element("a", "gone", href="/gone"), element("a", "moved", href="/moved")])),
    SECURE + "/one/two/three/four/five/" + "x" * 100: (200, document(
        [element("title", _STUFFED), element("meta", name="description", content="Welcome to the site"), element("meta", charset="koi8-r")],
        [element("h1", ""), element("img", src="http://wreck.test/mixed.png"), element("p", prose(300, 2))])),
    BAD + "/кот": (200, document([element("title", "Untitled")], [element("h1", "x" * 80), element("p", prose(300, 2)), "<!--" + "." * 40_000 + "-->"])),
    BAD + "/naked?x=1": (200, document([element("meta", name="viewport", content="maximum-scale=1")], ["Bare words"], lang="")),
}
BAD_HEADERS = {"server": "Apache/2.4.1", "content-type": "text/html; charset=windows-1251", "x-robots-tag": "noindex"}
#: What needs a home on https, or a sitemap that the site hasn't.
BAD_NA = {"hsts-header", "http-redirects-to-https", "sitemap-valid-xml", "sitemap-covers-homepage", "sitemap-urls-same-host", "sitemap-covers-crawled-pages"}
#: What the lack of a robots.txt leaves open, and the presence of the broken JSON-LD.
BAD_PASSED = {"ai-bots-allowed", "robots-not-disallow-all", "jsonld-present"}

#: A page of nothing, whose robots.txt closes everything and whose sitemap is a page.
BARE = "https://bare.test/"
BARE_STATUS = {
    "failed": "hsts-header http-redirects-to-https ai-bots-allowed robots-not-disallow-all robots-declares-sitemap sitemap-valid-xml title-present h1-present html-lang-attribute text-length-min charset-utf8 contacts-present-on-site".split(),
    "passed": "https-enabled homepage-status-200 robots-txt-exists robots-txt-parseable sitemap-exists ttfb-under-600ms no-redirect-loop title-unique-across-site".split(),
    "na": "404-returns-404-code www-canonical-redirect sitemap-covers-homepage image-weight-limit jsonld-valid viewport-width-device-width a11y-form-labels compression-enabled nav-links-are-anchors schema-breadcrumb".split(),
}
