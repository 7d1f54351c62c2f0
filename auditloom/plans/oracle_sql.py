"""The same results in SQL, from the raw pages by regular expressions alone: what the queries are held against."""

from __future__ import annotations

from auditloom.sources.charset import ACCENTED, CYRILLIC

from .registry import CATEGORIES, PAGE_CHECKS, SEVERITIES

def _tag(tag: str, name: str) -> str:
    return f"""regexp_extract(seen, '(?is)<{tag}\\s[^>]*name=["'']?{name}["'']?[\\s>/][^>]*', 0)"""


def _content(tag: str) -> str:
    return f"""trim(regexp_extract({tag}, '(?is)content="([^"]*)"', 1))"""


_GONE = "script|style|noscript|svg|template|iframe"
_READ = f"regexp_replace(regexp_replace(html, '(?is)<({_GONE})[^>]*>.*?</({_GONE})>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_TOP = _READ  # the text at the top of a page lacks these parts of it
for _part in ("header", "nav", "footer"):
    _TOP = rf"regexp_replace({_TOP}, '(?is)<{_part}\b[^>]*>.*?</{_part}>', '', 'g')"
_BODY = "regexp_replace(regexp_replace({}, '(?s)^.*?<body[^>]*>', ''), '(?s)<[^>]*>', '', 'g')"
PAGES = rf"""
with recursive raw as (
  select page_id, regexp_replace(url, '#.*$', '') as url, coalesce(html, '') as html from pages),
cut as (
  select *, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') as site, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path,
         regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as t0, regexp_extract_all(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1>', 1) as h0,
         regexp_replace(html, '(?is)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>', '', 'g') as seen,
         {_BODY.format(_READ)} as b0, {_BODY.format(_TOP)} as b1
  from raw),
p0 as (
  select page_id, url, html, seen, site, path, len(list_filter(string_split(path, '/'), lambda s: s <> '')) as depth,
         nullif(trim({{t0}}), '') as title, list_transform(h0, lambda h: trim(regexp_replace(regexp_replace({{h}}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) as h1, trim(regexp_replace({{b0}}, '\s+', ' ', 'g')) as text, left(trim(regexp_replace({{b1}}, '\s+', ' ', 'g')), 1500) as top_text,
         {_tag('meta', 'description')} as m_description, {_tag('meta', 'keywords')} as m_keywords, {_tag('meta', 'viewport')} as m_viewport,
         regexp_extract_all(seen, '(?is)<img\s[^>]*>') as imgs, regexp_extract_all(seen, '(?is)<a\s[^>]*href=[^>]*>.*?</a>') as anchors, regexp_extract_all(seen, '(?is)<form\b.*?</form>') as forms,
         regexp_extract_all(seen, '(?is)<link\s[^>]*rel=.?canonical[^>]*>') as canonicals, regexp_extract_all(html, '(?is)<script[^>]*ld.json[^>]*>(.*?)</script>', 1) as jsonld,
         list_transform(regexp_extract_all(seen, '(?is)<h([1-6])\b', 1), lambda h: cast(h as integer)) as levels, regexp_extract_all(seen, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>', 1) as headings,
         array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), ' ') || ' ' || array_to_string(regexp_extract_all(seen, '(?is)\sstyle="([^"]*)"', 1), ' ') as styles
  from cut),
p1 as (
  select *, len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '[\p{{{{L}}}}\p{{{{N}}}}]'))) as words,
         row_number() over (partition by site order by depth, page_id) = 1 as is_home, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) as norm_title,
         nullif({_content('m_description')}, '') as description, nullif({_content('m_viewport')}, '') as viewport,
         list_transform(canonicals, lambda c: regexp_extract(c, '(?i)href="?([^" >]*)', 1)) as canon,
         list_transform(imgs, lambda i: struct_pack(tag := i, src := regexp_extract(i, '(?i)\ssrc="?([^" >]*)', 1), alt := case when regexp_matches(i, '(?i)\salt=') then trim(regexp_extract(i, '(?i)\salt="([^"]*)"', 1)) end)) as images,
         list_transform(anchors, lambda x: struct_pack(tag := x, href := regexp_extract(x, '(?i)href="?([^" >]*)', 1), label := trim(regexp_replace(regexp_replace(regexp_extract(x, '(?is)^<a[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')))) as links,
         len(regexp_extract_all(html, '<a href="/')) as n_links
  from p0),
e as (
  select distinct site, source, target from (
    select site, url as source, unnest(links).href as href, regexp_extract(url, '^[^/]+://[^/?#]*', 0) as origin from p1),
    lateral (select case when starts_with(href, '/') and not starts_with(href, '//') then origin || regexp_replace(href, '#.*$', '') end as target) where target is not null),
forms_of as (
  select distinct site, url, unnest([1, 2, 3]) as form, unnest([case when path = '' then url || '/' else url end, regexp_replace(url, '/$', ''), url || '/']) as target from p1),
inward as (
  select site, url, min(row(form, others)) as least from (
    select f.site, f.url, form, count(*) filter (source <> f.url) as others from forms_of f join e using (site, target) group by all) group by site, url),
grams as (
  select distinct site, url, array_to_string(w[i : i + 4], ' ') as g from (
    select site, url, w, unnest(range(1, len(w) - 3)) as i from (
      select site, url, list_filter(regexp_split_to_array(lower(top_text || ' ' || text), '[^\p{{{{L}}}}0-9]+'), lambda x: x <> '') as w from p1 where words >= 120) where len(w) >= 5)),
gram_counts as (select site, url, count(*) as n from grams group by site, url),
alike as (
  select distinct c.site, a as url from (select x.site, x.url as a, y.url as b, count(*) as k from grams x join grams y on x.site = y.site and x.g = y.g and x.url <> y.url group by all) c
  join gram_counts n on n.site = c.site and n.url = a join gram_counts m on m.site = c.site and m.url = b where 100 * k > 90 * (n.n + m.n - k)),
p as materialized (
  select p1.*, alike.url is not null as near_duplicate, coalesce(struct_extract_at(inward.least, 2), 0) > 0 as has_source, sum(len(imgs)) over (partition by p1.site) as site_images,
         bool_or(is_home and regexp_matches(styles, '(?i)img[^{{{{]*\{{{{[^}}}}]*max-width\s*:\s*100%')) over (partition by p1.site) as site_fluid,
         coalesce(list_max(list_transform(regexp_extract_all(styles, '(?i)(?:^|[;{{{{\s"])width\s*:\s*([0-9]{{{{3,5}}}})px', 1), lambda x: cast(x as integer))), 0) as fixed_width
  from p1 left join alike on alike.site = p1.site and alike.url = p1.url left join inward on inward.site = p1.site and inward.url = p1.url)
"""


def _plain(c: str) -> str:
    for pattern, to in (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&#39;", "''"), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


PAGES = PAGES.replace("{t0}", _plain("t0")).replace("{h}", _plain("h")).replace("{b0}", _plain("b0")).replace("{b1}", _plain("b1")).replace("{{", "{").replace("}}", "}")

_HAS = "regexp_matches(seen, '(?i){}')"
_LEAD = r"list_filter(forms, lambda f: not regexp_matches(f, '(?i)role=.?search|action=[^>]*(search|поиск)') and regexp_matches(f, '(?i)<(input|textarea|select)\b[^>]*(type=.?(tel|email)|(name|placeholder|id)=.?[^\">]*(name|имя|фио|phone|tel|телефон|mail|почт|contact|fio))'))"
_CONSENT = "(соглас|персональн|обработк[a-z0-9_]* данных|политик[a-z0-9_]* конфиденц|consent|privacy)"
_TYPE = "len(list_filter(jsonld, lambda j: json_valid(j) and regexp_matches(j, '\"@type\"\\s*:\\s*(\\[[^\\]]*)?\"({})\"'))) > 0"
_PRICE = r"'(?i)(?:от\s*)?[0-9][0-9\s]{0,9}(?:[.,][0-9]+)?\s?(?:₽|руб\.?|рублей|р\.)'"
_FOREIGN = r"regexp_matches(html, '(?i)googletagmanager\.com|google-analytics\.com|gtag\(|connect\.facebook\.net|fbq\(|static\.hotjar\.com|clarity\.ms')"
_LOCAL = r"regexp_matches(html, '(?i)mc\.yandex\.ru|ym\([0-9]+|top-fwz1\.mail\.ru|top\.mail\.ru|vk\.com/js/api/openapi|vk\.com/rtrg')"
_RASTER = r"list_filter(images, lambda i: i.src <> '' and not regexp_matches(i.src, '(?i)\.svg(\?|$)'))"
_CONTENT = r"list_filter(images, lambda i: i.src <> '' and not regexp_matches(i.src, '(?i)\.svg(\?|$)') and not starts_with(i.src, 'data:'))"
_FILE = r"regexp_matches(coalesce(i.alt, ''), '(?i)^[a-z0-9_-]+\.(jpe?g|png|gif|webp|avif|svg)$|^(img|image|dsc|photo|screenshot)[_-]?[0-9]+')"
_SOME = "len(list_filter({}, lambda {}: {})) > 0"
_INTERNAL = r"(starts_with(l.href, '/') and not starts_with(l.href, '//') or regexp_replace(lower(regexp_extract(l.href, '(?i)^https?://([^/?#:]*)', 1)), '^www\.', '') = site)"
#: cohort and test of each check.
_SQL: dict[str, tuple[str, str]] = {
    "https-enabled": ("true", "not starts_with(url, 'https://')"),
    "charset-utf8": ("true", "not " + _HAS.format('<meta charset="utf-?8"')),
    "no-mixed-content": ("true", r"starts_with(url, 'https://') and regexp_matches(html, '(?i)<(img|script|iframe|source|video|audio)\b[^>]*\ssrc=[\"'']http://|<link\b[^>]*href=[\"'']http://[^\"'']+\.css')"),
    "title-present": ("true", "title is null"),
    "title-not-default-placeholder": ("true", "coalesce(regexp_matches(lower(title), '^(главная|главная страница|home|homepage|untitled|без названия|новая страница|document|page|index|welcome|my site|мой сайт|test|тест)$'), false)"),
    "h1-present": ("true", "len(h1) = 0"),
    "title-length-range": ("title is not null", "length(title) < 30 or length(title) > 65"),
    "title-no-keyword-stuffing": ("true", r"exists (select 1 from (select unnest(regexp_split_to_array(norm_title, '[^\p{L}0-9]+')) as t) where length(t) >= 4 group by t having count(*) >= 3)"),
    "description-present": ("true", "description is null"),
    "h1-single": ("true", "len(h1) > 1"),
    "h1-not-empty": ("true", "len(h1) > 0 and len(list_filter(h1, lambda x: x <> '')) = 0"),
    "html-lang-attribute": ("true", "not " + _HAS.format('<html[^>]* lang="[^"]')),
    "title-not-duplicate-of-h1": ("true", "len(list_filter(h1, lambda x: lower(x) = norm_title)) > 0"),
    "description-length-range": ("description is not null", "length(description) not between 70 and 160"),
    "description-not-generic": ("true", r"coalesce(regexp_matches(description, '(?i)(добро пожаловать|welcome to|just another|описание сайта|описание страницы|lorem ipsum|официальный сайт\.?$)'), false)"),
    "h1-length-range": ("true", "len(list_filter(h1, lambda x: x <> '' and (length(x) < 3 or length(x) > 70))) > 0"),
    "meta-keywords-not-overused": ("true", f"len(list_filter(regexp_split_to_array({_content('m_keywords')}, '[,;]'), lambda x: trim(x) <> '')) > 10"),
    "no-noindex-on-crawled-pages": ("true", "regexp_matches(seen, '(?i)<meta[^>]+name=.?(robots|yandex|googlebot)[^>]*noindex')"),
    "canonical-not-pointing-elsewhere": ("true", _SOME.format("canon", "c", r"regexp_matches(c, '(?i)^(https?:)?//') and regexp_replace(lower(regexp_extract(c, '//([^/?#:]*)', 1)), '^www\.', '') <> site")),
    "canonical-single": ("true", "len(canon) > 1"),
    "canonical-present": ("true", "len(canon) = 0"),
    "url-no-uppercase-or-spaces": ("true", r"regexp_matches(url_decode(path), '[A-Z]|\s')"),
    "url-no-cyrillic": ("true", "regexp_matches(url_decode(path), '[а-яёА-ЯЁ]')"),
    "canonical-absolute-url": ("true", _SOME.format("canon", "c", "not regexp_matches(c, '(?i)^https?://')")),
    "ai-content-without-js": ("true", r"words < 60 and (regexp_matches(html, '(?i)<div[^>]+id=[\"''](root|app|__next|__nuxt)[\"''][^>]*>\s*</div>') or len(regexp_extract_all(html, '(?i)<script\s[^>]*src=')) >= 3 or list_sum(list_transform(regexp_extract_all(html, '(?is)<script>(.*?)</script>', 1), lambda x: length(x))) > 20000)"),
    "ai-jsonld-content-types": ("true", _TYPE.format("FAQPage|Product|Service|Offer|AggregateOffer|HowTo|Course|Event|Menu")),
    "ai-machine-structure": ("true", r"regexp_matches(seen, '(?i)<(table|dl)\b') or regexp_matches(regexp_replace(seen, '(?is)<(nav|header|footer)\b.*?</(nav|header|footer)>', '', 'g'), '(?is)<[uo]l\b[^>]*>\s*(<li\b[^<]*(<[^lu/][^<]*|</[^ulo][^<]*|</li>\s*)*){3}')"),
    "ai-answer-on-top": ("true", f"not (regexp_matches(top_text, {_PRICE}) or len(regexp_extract_all(top_text, '[0-9]+')) >= 3)"),
    "ai-prices-in-text": ("true", f"regexp_matches(text, {_PRICE})"),
    "ai-faq-block": ("true", _TYPE.format("FAQPage") + r" or len(regexp_extract_all(seen, '(?i)<summary')) >= 2 or len(list_filter(headings, lambda h: regexp_matches(h, '\?\s*$'))) >= 3 or regexp_matches(array_to_string(headings, ' '), '(?i)(faq|вопрос\S* и ответ|частые вопросы)')"),
    "no-placeholder-text": ("true", "regexp_matches(text, '(?i)(lorem ipsum|dolor sit amet|здесь будет текст|текст-заглушка|рыба текст|тут будет описание|sample text)')"),
    "images-have-alt": ("site_images > 0", _SOME.format("images", "i", "i.alt is null")),
    "h2-present": ("words >= 250", "not list_contains(levels, 2)"),
    "heading-hierarchy-no-skip": ("true", "len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] - levels[i - 1] > 1)) > 0"),
    "text-length-min": ("true", "words < 200"),
    "contacts-present-on-site": ("true", r"regexp_matches(html, '(?i)href=[\"''](tel:|mailto:)') or regexp_matches(text, '(\+7|8)[\s(-]*[0-9]{3}[\s)-]*[0-9]{3}[\s-]*[0-9]{2}[\s-]*[0-9]{2}') or regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+')"),
    "duplicate-content-across-pages": ("true", "near_duplicate"),
    "alt-not-just-filename": ("true", _SOME.format("images", "i", _FILE)),
    "no-empty-headings": ("true", r"len(list_filter(headings, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) = '')) > 0"),
    "text-to-html-ratio": ("true", "length(html) > 0 and length(text) / length(html) < 0.1"),
    "external-links-have-rel": ("true", _SOME.format("links", "l", f"regexp_matches(l.href, '(?i)^(https?:)?//') and not {_INTERNAL} and not regexp_matches(l.tag, '(?i)^<a[^>]* rel=.?[a-z]')")),
    "internal-links-per-page": ("true", f"len(list_filter(links, lambda l: {_INTERNAL})) < 3"),
    "image-dimensions-declared": ("true", f"len(list_filter({_CONTENT}, lambda i: (not regexp_matches(i.tag, '(?i) width=.?[^\" >]') or not regexp_matches(i.tag, '(?i) height=.?[^\" >]')) and not contains(lower(i.tag), 'aspect-ratio'))) > 0"),
    "friendly-urls": ("true", r"regexp_matches(regexp_extract(url, '://[^/?#]*(.*)$', 1), '(?i)\.(php|aspx?|jsp|cgi)(\?|$)|[?&](id|page_id|p|cat|option)=')"),
    "nav-links-are-anchors": (_HAS.format("<nav|<header|role=.?navigation"), r"not regexp_matches(seen, '(?is)<(nav|header)\b.*?<a\s[^>]*href=.?[^#j].*?</(nav|header)>') and regexp_matches(seen, '(?is)<(nav|header)\b.*?(onclick=|<(span|div)[^>]*role=.?link|href=.?javascript:).*?</(nav|header)>')"),
    "url-depth-max-4": ("true", "depth > 4"),
    "url-length-max-115": ("true", "length(url) > 115"),
    "breadcrumbs-present": ("depth >= 2", r"not (regexp_matches(seen, '(?i)(class=.?[^\">]*(breadcrumb|crumbs)|aria-label=.?[^\">]*breadcrumb|itemtype=.?[^\">]*BreadcrumbList)') or " + _TYPE.format("BreadcrumbList") + ")"),
    "no-orphan-crawled-pages": ("not is_home", "not has_source"),
    "no-query-string-duplicates": ("true", "regexp_matches(url, '\\?.') and not " + _SOME.format("canon", "c", "not contains(c, '?')")),
    "homepage-links-count": ("true", f"len(list_filter(links, lambda l: {_INTERNAL})) not between 5 and 200"),
    "anchor-text-not-empty": ("true", _SOME.format("links", "l", "l.label = '' and not regexp_matches(l.tag, '(?i)(^<a[^>]*(aria-label|title)=.?[^\" >]|<img[^>]*alt=.?[^\" >])')")),
    "jsonld-present": ("true", "len(jsonld) > 0"),
    "jsonld-valid": ("len(jsonld) > 0", _SOME.format("jsonld", "j", "not json_valid(j)")),
    "schema-organization-or-localbusiness": ("true", _TYPE.format("Organization|Corporation|[A-Za-z]*Business|Store|Restaurant|Dentist|MedicalClinic|MedicalOrganization|AutoRepair|LegalService|RealEstateAgent|EducationalOrganization|ProfessionalService|FinancialService|Hotel|FoodEstablishment|Physician|Hospital|Pharmacy|SportsActivityLocation")),
    "schema-breadcrumb": ("depth >= 2", "contains(html, 'BreadcrumbList')"),
    "schema-website": ("true", _TYPE.format("WebSite")),
    **{f"og-{x}-present": ("true", f"not regexp_matches(seen, '(?i)<meta[^>]*property=.?og:{x}[^>]*content=.?[^\" >]')") for x in ("title", "description", "image", "url", "type")},
    **{f"twitter-{x}-present": ("true", f"not regexp_matches(seen, '(?i)<meta[^>]*(name|property)=.?twitter:{x}[^>]*content=.?[^\" >]')") for x in ("card", "image")},
    "viewport-meta-present": ("true", "viewport is null"),
    "viewport-allows-zoom": ("true", r"coalesce(regexp_matches(viewport, '(?i)user-scalable\s*=\s*(no|0)|maximum-scale\s*=\s*1(\.0)?\b'), false)"),
    "viewport-width-device-width": ("viewport is not null", r"not regexp_matches(viewport, '(?i)width\s*=\s*device-width')"),
    "no-fixed-pixel-width-wrapper": ("true", "fixed_width > 480"),
    "no-horizontal-overflow-hint": ("true", r"fixed_width > 480 or len(list_filter(images, lambda i: not site_fluid and coalesce(try_cast(regexp_extract(i.tag, '(?i) width=.?([0-9.]+)', 1) as double), 0) > 480)) > 0 or (regexp_matches(seen, '(?i)<table\b') and not regexp_matches(seen, '(?is)(class|style)=.?[^\">]*(overflow|scroll|table-responsive|table-wrap)[^>]*>.*<table\b'))"),
    "no-flash-or-applet": ("true", _HAS.format(r"<applet|<object[^>]*(type=.?[^\">]*flash|data=.?[^\">]*\.swf)|<embed[^>]*src=.?[^\">]*\.swf")),
    "responsive-images-srcset": (f"len({_RASTER}) > 0", f"len(list_filter({_RASTER}, lambda i: not contains(lower(i.tag), 'srcset='))) > 0 and not regexp_matches(seen, '(?is)<picture\\b.*?<source[^>]*srcset.*?<img')"),
    "font-size-not-tiny": ("true", r"len(list_filter(regexp_extract_all(styles, '(?i)font-size\s*:\s*([0-9]+(?:\.[0-9]+)?)px', 1), lambda v: cast(v as double) > 0 and cast(v as double) < 12)) > 0"),
    "apple-touch-icon-present": ("true", "not " + _HAS.format("<link[^>]*apple-touch-icon")),
    "theme-color-present": ("true", "not " + _HAS.format("<meta[^>]*name=.?theme-color")),
    "privacy-policy-linked": ("true", _SOME.format("links", "l", "regexp_matches(l.label || ' ' || l.href, '(?i)политик|конфиденц|персональн|privacy|policy')")),
    "forms-have-consent": (f"len({_LEAD}) > 0", f"len(list_filter({_LEAD}, lambda f: not regexp_matches(regexp_replace(f, '<[^>]*>', ' ', 'g') || array_to_string(regexp_extract_all(f, '(?i)<input[^>]*checkbox[^>]*>'), ' '), '(?i){_CONSENT}'))) > 0"),
    "consent-not-prechecked": (_SOME.format("forms", "f", f"regexp_matches(f, '(?i)type=.?checkbox') and regexp_matches(f, '(?i){_CONSENT}')"), _SOME.format("forms", "f", "regexp_matches(f, '(?i)<input[^>]*(type=.?checkbox[^>]* checked| checked[^>]*type=.?checkbox)')")),
    "a11y-form-labels": ("len(forms) > 0", _SOME.format("forms", "f", r"regexp_matches(regexp_replace(f, '(?is)<label\b.*?</label>|<input[^>]*type=.?(hidden|submit|button|image|reset)[^>]*>|<[a-z]+[^>]*(aria-label|aria-labelledby|title)=.?[^\" >][^>]*>', '', 'g'), '(?i)<(input|textarea|select)\b')")),
    "forms-spam-protection": (f"len({_LEAD}) > 0", f"len(list_filter({_LEAD}, lambda f: not regexp_matches(f, '(?i)(captcha|turnstile|honeypot|hp-field|name=.(website|hp|honeypot|url_confirm).)'))) > 0"),
    "a11y-button-names": ("true", r"len(list_filter(regexp_extract_all(seen, '(?is)<button\b.*?</button>'), lambda b: trim(regexp_replace(b, '<[^>]*>', '', 'g')) = '' and not regexp_matches(b, '(?i)(^<button[^>]*(aria-label|title|aria-labelledby)=.?[^\" >]|<img[^>]*alt=.?[^\" >])'))) > 0"),
    "a11y-main-landmark": ("true", "not " + _HAS.format('<main|role="?main')),
    "a11y-no-autoplay-sound": ("true", r"len(list_filter(regexp_extract_all(seen, '(?i)<(?:video|audio)\b[^>]*>'), lambda v: regexp_matches(v, '(?i)\sautoplay') and (regexp_matches(v, '(?i)^<audio') or not regexp_matches(v, '(?i)\smuted')))) > 0"),
}
#: status of the checks of a whole site, over all its pages.
_SITE_SQL = {
    "cookie-notice-with-trackers": f"case when not bool_or({_FOREIGN} or {_LOCAL}) then 'na' when bool_or(regexp_matches(html, '(?i)cookie|куки')) then 'passed' else 'failed' end",
    "no-foreign-trackers": f"case when bool_or({_FOREIGN}) then 'failed' else 'passed' end",
    "alt-coverage-ratio": f"case when sum(len({_CONTENT})) = 0 then 'na' when floor(100 * sum(len(list_filter({_CONTENT}, lambda i: coalesce(i.alt, '') <> '' and not {_FILE}))) / sum(len({_CONTENT})) + 0.5) >= 90 then 'passed' else 'failed' end",
    "trailing-slash-consistency": "case when any_value(slashes.n) is null or any_value(slashes.n) < 5 then 'na' when any_value(slashes.few) / any_value(slashes.n) > 0.2 then 'failed' else 'passed' end",
}


def _row(c) -> str:
    if c.kind == "site":
        return f"select p.site, '{c.id}', 'site', true, 1, 0, {_SITE_SQL[c.id]} from p left join slashes on slashes.site = p.site group by p.site"
    cohort, test = _SQL[c.id]
    home = " and is_home" if c.kind == "home" else ""
    return f"select site, '{c.id}', '{c.kind}', {str(c.cohort == 'true').lower()}, count(*) filter (({cohort}){home}), count(*) filter (({cohort}){home} and ({test})), null from p group by site"


def _group(c) -> str:
    key = "norm_title" if c.id.startswith("title") else r"lower(trim(regexp_replace(description, '\s+', ' ', 'g')))"
    return f"select site, '{c.id}', 'group', true, cast(sum(n) as bigint), cast(coalesce(sum(n) filter (n > 1 and coalesce(key, '') <> ''), 0) as bigint), null from (select site, {key} as key, count(*) as n from p group by all) group by site"


RESULTS = (
    PAGES
    + r""", slashes as (
  select site, count(*) as n, least(count(*) filter (path like '%/'), count(*) filter (path not like '%/')) as few from (
    select distinct site, target, regexp_extract(target, '://[^/?#]*([^?#]*)', 1) as path from e) where path not in ('', '/') and not regexp_matches(path, '\\.[A-Za-z0-9_]{2,5}$') group by site),
c(site, check_id, kind, always, n_total, n_hit, own) as (
"""
    + "\nunion all ".join(_group(c) if c.kind == "group" else _row(c) for c in PAGE_CHECKS)
    + """),
r as (
  select site, check_id, n_total,
         case when kind = 'site' then own when kind = 'any' then case when n_total = 0 and not always then 'na' when n_hit > 0 then 'passed' else 'failed' end
              when kind = 'group' then case when n_hit > 0 then 'failed' else 'passed' end
              when n_total = 0 then 'na' when n_hit > 0 then 'failed' else 'passed' end as status,
         cast(case when kind = 'site' then (own = 'failed')::int when kind = 'any' then case when n_hit > 0 then 0 else n_total end else n_hit end as bigint) as n_bad,
         case when kind in ('any', 'site') and always then 1 else least(n_hit + case when kind = 'any' then n_total else 0 end, 200) end as listed
  from c),
dim(check_no, check_id, category, category_weight, severity, severity_weight) as (values """
    + ", ".join(f"({i}, '{c.id}', '{c.category}', {CATEGORIES[c.category]}::double, '{c.severity}', {SEVERITIES[c.severity]})" for i, c in enumerate(PAGE_CHECKS))
    + """),
g as (
  select site, category, any_value(category_weight) as category_weight,
         cast(floor(100.0::double * sum(case when status = 'passed' then severity_weight else 0 end) / sum(case when status <> 'na' then severity_weight end) + 0.5) as integer) as score,
         count(*) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'na') as na
  from r join dim using (check_id) group by site, category having coalesce(sum(case when status <> 'na' then severity_weight end), 0) > 0)
"""
)
SITE_CHECKS = RESULTS + "select site, check_id, status, n_bad, n_total from r"
CATEGORY_SCORES = RESULTS + "select site, category, category_weight, score, passed, failed, na from g"
SITE_SCORES = RESULTS + "select site, coalesce(cast(floor(sum(score * category_weight) / sum(category_weight) + 0.5) as integer), 0) as score from (select distinct site from p) left join g using (site) group by site"
ACTION_PLAN = RESULTS + """select site, cast(step as integer) as step, check_id, category, severity, n_bad from (
  select *, row_number() over (partition by site order by severity_weight desc, category_weight desc, listed desc, check_no) as step from r join dim using (check_id) where status = 'failed') where step <= 12"""
PAGE_FACTS = PAGES + "select page_id, site, url, title, cast(words as integer) as words, cast(depth as integer) as depth, is_home, cast(n_links as integer) as n_links from p"
SITE_STATS = RESULTS + """select site, count(*) filter (status <> 'na') as applicable, count(*) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed,
  count(*) filter (status = 'failed' and severity = 'critical') as critical, count(*) filter (status = 'failed' and severity = 'important') as important, count(*) filter (status = 'failed' and severity = 'advice') as advice,
  count(*) as check_count from r join dim using (check_id) group by site"""
WEAKEST = RESULTS + """select site, cast(rank as integer) as rank, category, score from (
  select g.*, row_number() over (partition by site order by score, place) as rank from g join (select category, min(check_no) as place from dim group by category) using (category)) where rank <= 3"""
LINK_EDGES = PAGES + "select site, source, target from e"
NEAR_DUPLICATES = PAGES + "select site, url from alike"
_EDITION = "select page_id * 4 + {0} as page_id, regexp_replace(url, '#.*$', '') || case when contains(regexp_replace(url, '#.*$', ''), '?') then '&' else '?' end || 'edition={0}' as url, {1} as html from pages"
_EDITIONS = f"""with recursive editions as (
  select page_id * 4 as page_id, url, html from pages
  union all {_EDITION.format(1, "replace(html, '</article>', '<p>This is an edition for printing</p></article>')")}
  union all {_EDITION.format(2, "regexp_replace(html, ' (of|the|de|und|la) ', ' by ', 'g')")}
  union all {_EDITION.format(3, "html")}),
"""
NEAR_DUPLICATE_EDITIONS = NEAR_DUPLICATES.replace("with recursive ", _EDITIONS, 1).replace("coalesce(html, '') as html from pages)", "coalesce(html, '') as html from editions)", 1)


def _bad(c) -> str:
    if c.kind == "site":
        return f"select site, '{c.id}' as check_id, page_id, url from p where is_home and site in (select site from r where check_id = '{c.id}' and status = 'failed')"
    if c.kind == "group":
        key = "norm_title" if c.id.startswith("title") else r"lower(trim(regexp_replace(description, '\s+', ' ', 'g')))"
        return f"select site, '{c.id}', page_id, url from (select *, count(*) over (partition by site, {key}) as same from p where coalesce({key}, '') <> '') where same > 1"
    cohort, test = _SQL[c.id]
    if c.kind == "any":
        who = "is_home" if c.cohort == "true" else f"({cohort})"
        return f"select site, '{c.id}', page_id, url from p where {who} and site in (select site from r where check_id = '{c.id}' and status = 'failed')"
    return f"select site, '{c.id}', page_id, url from p where ({cohort}) and ({test})" + (" and is_home" if c.kind == "home" else "")


_AFFECTED = RESULTS.rstrip() + ", bad as (\n" + "\nunion all ".join(map(_bad, sorted(PAGE_CHECKS, key=lambda c: c.kind != "site"))) + ")\n"
AFFECTED_PAGES = _AFFECTED + "select site, check_id, page_id, url from bad"
PAGE_SUMMARY = _AFFECTED + """select p.site, p.page_id, p.url, count(distinct check_id) as issues, count(distinct check_id) filter (severity = 'critical') as critical
from p left join (select bad.*, severity from bad join dim using (check_id)) b on b.page_id = p.page_id group by p.site, p.page_id, p.url"""
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"
SITE_REPORTS = _AFFECTED.rstrip() + f""",
sc as (select site, coalesce(cast(floor(sum(score * category_weight) / sum(category_weight) + 0.5) as integer), 0) as score from (select distinct site from p) left join g using (site) group by site),
st as (
  select site, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'failed' and severity = 'critical') as critical,
         count(*) filter (status = 'failed' and severity = 'important') as important, count(*) filter (status = 'failed' and severity = 'advice') as advice from r join dim using (check_id) group by site),
np as (select site, count(*) as pages from p group by site),
cats as (select g.*, place from g join (select category, min(check_no) as place from dim group by category) using (category)),
wk as (select site, string_agg(category || ' (' || score || ')', ', ' order by k) as weakest from (select *, row_number() over (partition by site order by score, place) as k from cats) where k <= 3 group by site),
cg as (select site, string_agg('<tr><td>' || category || '</td><td>' || score || '</td><td>' || passed || ' of ' || (passed + failed) || '</td></tr>', '' order by place) as t from cats group by site),
pl as (
  select site, string_agg('<li>' || check_id || '</li>', '' order by step) as t from (
    select *, row_number() over (partition by site order by severity_weight desc, category_weight desc, listed desc, check_no) as step from r join dim using (check_id) where status = 'failed') where step <= 12 group by site),
ls as (
  select site, check_id, string_agg('<li>' || {_ESC.format('url')} || '</li>', '' order by k) filter (k <= 20) || case when count(*) > 20 then '<li>and ' || (count(*) - 20) || ' more</li>' else '' end as t
  from (select *, row_number() over (partition by site, check_id order by page_id, url) as k from bad) group by site, check_id),
sv as (
  select site, severity, severity_weight, count(*) as n, string_agg('<h3>' || check_id || '</h3><p>' || category || '</p><ul>' || coalesce(ls.t, '') || '</ul>', '' order by check_no) as t
  from r join dim using (check_id) left join ls using (site, check_id) where status = 'failed' group by site, severity, severity_weight),
ck as (select site, string_agg('<h2>' || severity || ': ' || n || ' (' || cast(floor(100.0::double * n / failed + 0.5) as integer) || ' %)</h2>' || t, '' order by severity_weight desc) as t from sv join st using (site) group by site),
pg as (
  select p.site, p.page_id, p.url, count(distinct check_id) as issues, count(distinct check_id) filter (severity = 'critical') as critical
  from p left join (select bad.*, severity from bad join dim using (check_id)) b on b.page_id = p.page_id group by p.site, p.page_id, p.url),
pt as (
  select site, string_agg('<tr><td>' || {_ESC.format('url')} || '</td><td>' || issues || '</td><td>' || critical || '</td></tr>', '' order by k) as t
  from (select *, row_number() over (partition by site order by issues desc, critical desc, page_id, url) as k from pg) where k <= 200 group by site)
select site, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Audit of ' || {_ESC.format('site')} || '</title></head><body><h1>' || {_ESC.format('site')} || '</h1><p>The site scores ' || score || ' of 100.</p><p>'
  || case when critical > 0 then 'Critical problems: ' || critical || '.' else 'No critical problems.' end || '</p><p>Important: ' || important || ', advice: ' || advice || '.</p>'
  || coalesce('<p>Weakest: ' || weakest || '.</p>', '') || '<p>Pages checked: ' || pages || '.</p><table>' || coalesce(cg.t, '') || '</table><ol>' || coalesce(pl.t, '') || '</ol>' || coalesce(ck.t, '') || '<table>' || coalesce(pt.t, '') || '</table></body></html>' as html
from sc join st using (site) join np using (site) left join wk using (site) left join cg using (site) left join pl using (site) left join ck using (site) left join pt using (site)"""
URL_FUNCTIONS = r"""
with u as (
  select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '(\?[^#]+)', 1) as query, lower(regexp_extract(url, '^([^:]+):', 1)) as scheme from pages),
v as (select *, case when path = '' then '/' else path end as p from u)
select page_id, host || p || query as short,
       host || case when length(url_decode(p || query)) > 60 then left(url_decode(p || query), 24) || '…' || right(url_decode(p || query), 30) else url_decode(p || query) end as shortened,
       regexp_matches(path, '(?i)\.(pdf|jpe?g|png|gif|webp|avif|svg|ico|zip|rar|7z|docx?|xlsx?|pptx?|mp4|mp3|avi|mov|webm|css|js|json|xml|txt|woff2?|ttf|eot|exe|dmg|apk)$') as is_file,
       scheme || '://' || host || '/' as root from v
"""
REACHABLE = PAGES + """, walk(site, url, depth) using key (site, url) as (
  select distinct site, url, 0 from p where is_home
  union
  select c.site, c.target, c.depth from (select e.site, e.target, min(w.depth) + 1 as depth from walk w join e on e.site = w.site and e.source = w.url group by 1, 2) c
  left join recurring.walk r on r.site = c.site and r.url = c.target where r.depth is null or c.depth < r.depth)
select site, url, depth from walk"""
_KEYED = r"""case when regexp_matches(url, '^[^/?#]+://[^/?#]*(\?|$)') then regexp_replace(url, '^([^/?#]+://[^/?#]*)', '\1/') else url end"""
SITEMAP_URLS = rf"""
with k as (
  select page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') as site, regexp_replace(url, '#.*$', '') as url from pages)
select site, row_number() over (partition by site order by page_id) as "order", {_KEYED} as url from k"""
_FILE = r"""'(?i)://[^/?#]*[^?#]*\.(pdf|jpe?g|png|gif|webp|avif|svg|ico|zip|rar|7z|docx?|xlsx?|pptx?|mp4|mp3|avi|mov|webm|css|js|json|xml|txt|woff2?|ttf|eot|exe|dmg|apk)([?#]|$)'"""
CRAWL_PLAN = PAGES + rf""", kp as (select site, page_id, is_home, links, {_KEYED} as url, regexp_extract(url, '^[^/]+://[^/?#]*', 0) as origin from p),
stored as materialized (
  select *, row_number() over (partition by site order by page_id, url) - 1 as no, count(*) over (partition by site) as n
  from (select site, url, min(page_id) as page_id, bool_or(is_home) as is_home from kp group by site, url)),
home as (select site, url, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host from stored where is_home),
hrefs as (select site, url as source, origin, unnest(range(len(links))) as pos, unnest(links).href as href from kp),
asked as (
  select site, source, min(pos) as pos, target from (
    select site, source, pos, {_KEYED.replace('url', 't')} as target from (select *, origin || regexp_replace(href, '#.*$', '') as t from hrefs where starts_with(href, '/') and not starts_with(href, '//')))
  join home using (site) where lower(regexp_extract(target, '://([^/?#:]*)', 1)) = host and not regexp_matches(target, {_FILE}) group by site, source, target),
way as materialized (
  select a.site, a.source, s.url as target, min(a.pos)::integer as pos from asked a join (select distinct site, n from stored) using (site)
  join stored s on s.site = a.site and s.no = (length(a.target) + ascii(right(a.target, 1))) % s.n
  join home on home.site = a.site where lower(regexp_extract(s.url, '://([^/?#:]*)', 1)) = home.host and not regexp_matches(s.url, {_FILE}) group by all),
starts as materialized (
  select site, url, []::bigint[] as start from home
  union all
  select s.site, s.url, [min(rank)] from (select site, {_KEYED} as url, row_number() over (partition by site order by page_id) as rank from p) s
  join home using (site) where s.url <> home.url and lower(regexp_extract(s.url, '://([^/?#:]*)', 1)) = home.host and not regexp_matches(s.url, {_FILE})
    and not exists (select 1 from way w where w.site = s.site and w.source = home.url and w.target = s.url) group by s.site, s.url),
walk(site, url, place) using key (site, url) as (
  select site, url, struct_pack(start := start, depth := 0, way := []::integer[]) from starts
  union
  select c.site, c.url, c.place from (
    select w.site, l.target as url, min(struct_pack(start := w.place.start, depth := w.place.depth + 1, way := list_append(w.place.way, l.pos))) as place
    from walk w join way l on l.site = w.site and l.source = w.url where not exists (select 1 from starts s where s.site = w.site and s.url = l.target) group by 1, 2) c
  left join recurring.walk r on r.site = c.site and r.url = c.url where r.url is null or c.place < r.place),
ranked as (select site, url, place, row_number() over (partition by site order by place, url) as "order" from walk)
select site, "order", url, place.depth as depth, case when place.depth > 0 then 'link' when len(place.start) > 0 then 'sitemap' else 'home' end as via from ranked where "order" <= 20"""
WORK_LISTS = PAGES + rf""", kp as (select site, page_id, links, {_KEYED} as url, regexp_extract(url, '^[^/]+://[^/?#]*', 0) as origin from p),
hrefs as (select site, page_id, origin, unnest(range(len(links))) as pos, unnest(links).href as href from kp),
targets as (
  select site, {_KEYED.replace('url', 't')} as target, min(row(page_id, pos)) as place
  from (select *, origin || regexp_replace(href, '#.*$', '') as t from hrefs where starts_with(href, '/') and not starts_with(href, '//')) group by 1, 2)
select site, 'link' as kind, row_number() over (partition by site order by place, target) as "order", target as url from targets
where not regexp_matches(target, {_FILE}) and not exists (select 1 from kp where kp.site = targets.site and kp.url = targets.target)"""
DECODED_BODIES = f"""
with t as (
  select page_id, ((page_id % 5) + 5) % 5 as way, translate(case when page_id % 5 = 2 then '<meta charset=''koi8-r''>' || regexp_replace(html, '(?i)<meta charset[^>]*>', '', 'g') else html end, '{ACCENTED}', '{CYRILLIC}') as text from pages),
d as (
  select page_id, case way when 1 then 'windows-1251' when 2 then 'koi8-r' else 'utf-8' end as charset,
         case way when 0 then text when 1 then regexp_replace(text, '[^\\x00-\\x7F{CYRILLIC}]', '?', 'g') when 2 then regexp_replace(text, '[^\\x00-\\x7F{CYRILLIC}]', '?', 'g')
           when 3 then regexp_replace(regexp_replace(text, '[^\\x00-\\x7F{CYRILLIC}]', '?', 'g'), '[{CYRILLIC}]', chr(65533), 'g') else text || chr(65533) || 'A' || chr(65533) || chr(65533) end as html from t)
select page_id, charset, length(html)::integer as n_chars, md5(html) as html_md5 from d"""


def keywords_sql(stop: tuple[str, ...], zones: dict[str, float], words: int = 12, phrases: int = 10) -> str:
    heading = lambda n: f"list_transform(regexp_extract_all(seen, '(?is)<h{n}(?:\\s[^>]*)?>(.*?)</h{n}>', 1), lambda x: trim(regexp_replace(regexp_replace({_plain('x')}, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')))"
    texts = {"title": "[coalesce(title, '')]", "h1": "h1", "description": "[coalesce(description, '')]", "h2": heading(2), "h3": heading(3), "body": "[text]"}
    rows = " union all ".join(f"select site, page_id, {i} as zone_no, {w}::double as weight, unnest({texts[z]}) as t from p" for i, (z, w) in enumerate(zones.items()))
    no = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(stop)))
    return PAGES + rf""", z as ({rows}),
s as (select site, page_id, zone_no, weight, unnest(range(len(a))) as sentence, unnest(a) as t from (select *, regexp_split_to_array(t, '[.!?;:()«»"|•·—–\n]+') as a from z)),
k as (select site, page_id, zone_no, weight, sentence, list_filter(list_transform(regexp_split_to_array(replace(lower(t), 'ё', 'е'), '[^\p{{L}}0-9-]+'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: x <> '') as w from s),
g as (select site, page_id, zone_no, weight, sentence, n, i, w[i + 1 : i + n] as gram from (select k.*, unnest(range(len(w))) as i from k) cross join (values (1), (2), (3)) v(n) where i + n <= len(w)),
u as (select * from g where length(gram[1]) >= 3 and length(gram[n]) >= 3 and gram[1] not in ({no}) and gram[n] not in ({no}) and len(list_filter(gram, lambda x: regexp_matches(x, '^[0-9]+$'))) = 0),
t as (select site, array_to_string(gram, ' ') as term, n, sum(weight) as score, min(row(page_id, zone_no, sentence, n, i)) as first from u group by all),
r as (select site, case when n = 1 then 'word' else 'phrase' end as kind, term, score, first from t where n = 1 or score >= 3),
o as (select *, row_number() over (partition by site, kind order by score desc, first, term) as rank, max(score) over (partition by site, kind) as most from r)
select site, kind, cast(rank as integer) as rank, term, cast(floor(case when kind = 'word' then score else 100 * score / most end + 0.5) as integer) as score from o where rank <= case when kind = 'word' then {words} else {phrases} end"""


RATE_LIMITER = """
with recursive h as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
r(user_id, i, event_id, passed, times) as (
  select user_id, i, event_id, true, [us] from h where i = 1
  union all
  select user_id, i, event_id, len(y) < 10, case when len(y) < 10 then list_append(y, us) else y end from (
    select h.user_id, h.i, h.event_id, h.us, list_filter(r.times, lambda t: h.us - t < 3600000000) as y from r join h on h.user_id = r.user_id and h.i = r.i + 1))
select event_id, user_id, passed from r"""
