"""The page-level checks, declared: one row for each with a cohort and a predicate in Spark SQL over the silver table.

Kinds: `page` fails if any page of the cohort is bad and is na without a cohort; `home` is the same over home pages; `any`
passes if any page of the cohort is good, and is na without a cohort if it has a condition; `group` fails if two pages of a
site share the key, and passes without keys; `site` has a status expression over one row of facts of each site
(plans/crawl.py) in place of the test.

`needs` names the tables of a crawl (plans/crawl.py) that a check reads beside the pages; a check runs only if they are there.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame

# Patterns and thresholds that results depend on.
PLACEHOLDER_TITLE = r"(?iu)^(главная|главная страница|home|homepage|untitled|без названия|новая страница|document|page|index|welcome|my site|мой сайт|test|тест)$"
GENERIC_DESCRIPTION = r"(?iu)(добро пожаловать|welcome to|just another|описание сайта|описание страницы|lorem ipsum|официальный сайт\.?$)"
PLACEHOLDER_TEXT = r"(?iu)(lorem ipsum|dolor sit amet|здесь будет текст|текст-заглушка|рыба текст|тут будет описание|sample text)"
FILE_NAME = r"(?i)^[A-Za-z0-9_-]+\.(jpe?g|png|gif|webp|avif|svg)$|^(img|image|dsc|photo|screenshot)[_-]?[0-9]+"
PRICE = r"(?iu)(?:от[\s ]*)?[0-9][0-9\s ]{0,9}(?:[.,][0-9]+)?[\s ]?(?:₽|руб\.?|рублей|р\.)"
ORGANIZATION = "^(Organization|LocalBusiness|Corporation|.*Business|Store|Restaurant|Dentist|MedicalClinic|MedicalOrganization|AutoRepair|LegalService|RealEstateAgent|EducationalOrganization|HealthAndBeautyBusiness|ProfessionalService|HomeAndConstructionBusiness|FinancialService|Hotel|FoodEstablishment|Physician|Hospital|Pharmacy|SportsActivityLocation)$"
POLICY = r"(?iu)политик|конфиденц|персональн|privacy|policy"
CONTACT_HTML, CONTACT_PHONE, CONTACT_MAIL = r"(?i)href=[\"'](tel:|mailto:)", r"(\+7|8)[\s(-]*[0-9]{3}[\s)-]*[0-9]{3}[\s-]*[0-9]{2}[\s-]*[0-9]{2}", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+"
MIXED = r"(?i)<(?:img|script|iframe|source|video|audio)\b[^>]*\ssrc=[\"']http://|<link\b[^>]*href=[\"']http://[^\"']+\.css"
APP_SHELL = r"(?i)<div[^>]+id=[\"'](root|app|__next|__nuxt)[\"'][^>]*>\s*</div>"
TRACKERS = {
    "foreign": {
        "Google Analytics / Tag Manager": r"(?i)googletagmanager\.com|google-analytics\.com|gtag\(",
        "Meta Pixel": r"(?i)connect\.facebook\.net|fbq\(",
        "Hotjar": r"(?i)static\.hotjar\.com",
        "Microsoft Clarity": r"(?i)clarity\.ms",
    },
    "local": {
        "Яндекс Метрика": r"(?i)mc\.yandex\.ru|ym\([0-9]+",
        "Top@Mail.Ru": r"(?i)top-fwz1\.mail\.ru|top\.mail\.ru",
        "VK Пиксель": r"(?i)vk\.com/js/api/openapi|vk\.com/rtrg",
    },
}
FAQ_HEADING = r"(?iu)(faq|вопрос\S* и ответ|частые вопросы)"
RASTER = r"(?i)\.(jpe?g|png|gif|webp|avif|bmp)(\?|$)"
CONTENT_TYPES = "'FAQPage','Product','Service','Offer','AggregateOffer','HowTo','Course','Event','Menu'"


class Check(NamedTuple):
    id: str
    category: str
    severity: str
    kind: str
    cohort: str
    test: str  # bad for page and home, good for any, the key for group, the status for site
    needs: str = ""


def q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def first(pattern: str, column: str, *parts: str, folded: str | None = None) -> str:
    """column rlike pattern, asked only of texts that hold one of the parts, which any match holds: a search for a few letters costs a small share of a pattern's.

    folded: the column in lower case, which parts are then sought in. Parts of an (?iu) pattern may not hold letters that others fold to:
    i, k and s, and Cyrillic в, д, о, с, т and ъ."""
    held = "exists(array({}), t -> " + " or ".join(f"contains(t, {q(x)})" for x in parts) + ")"  # the text is folded once for all parts
    return f"({held.format(folded or column)} and {column} rlike {q(pattern)})"


def openings(pattern: str) -> list[str]:
    """In lower case, what the alternatives of an (?i) pattern begin with, up to the first sign that stands for something else."""
    alternatives = pattern.removeprefix("(?i)").split("|")
    return [re.sub(r"\\(.)", r"\1", re.match(r"(?:[a-z0-9/-]|\\[.(])+", x)[0]) for x in alternatives]


_TITLE, _TYPES, _LEAD = "coalesce(title, '')", "flatten(transform(jsonld, b -> b.types))", "filter(forms, f -> not f.is_search and f.personal_fields > 0)"
_IMAGES = "filter(images, i -> i.src != '' and not i.src rlike r'(?i)\\.svg(\\?|$)' and not startswith(i.src, 'data:'))"
_NORM = "lower(trim(regexp_replace({}, r'[\\s\\u00A0]+', ' ')))"
_PATH = "coalesce(try_url_decode(replace(path, '+', '%2B')), path)"
_RASTER = "filter(images, i -> i.src != '' and not i.src rlike r'(?i)\\.svg(\\?|$)')"
_HOST = "regexp_replace(lower(regexp_extract({}, r'://([^/?#:]*)', 1)), r'^www\\.', '')"
_TRIM = r"regexp_replace({}, r'^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$', '')"
#: Over html and its lower case, `low`.
_FOREIGN, _LOCAL = ("(" + " or ".join(first(p, "html", *openings(p), folded="low") for p in TRACKERS[k].values()) + ")" for k in ("foreign", "local"))
_COOKIE = first("(?iu)cookie|куки", "html", "coo", "куки", folded="low")
_PRICED = first(PRICE, "text", "₽", "р", folded="lower(text)")
_MIXED = first(MIXED, "html", "http://", folded="lower(html)")
_PLACEHOLDER = first(PLACEHOLDER_TEXT, "text", "lorem ", "t amet", " бу", "заглушка", "рыба ", "ample te", folded="lower(text)")
_CONTACTS = f"({first(CONTACT_HTML, 'html', 'tel:', 'mailto:', folded='lower(html)')} or {first(CONTACT_PHONE, 'text', '8', '+7')} or {first(CONTACT_MAIL, 'text', '@')})"
_HEADER = "coalesce(try_element_at(headers, '{}'), '')"
_CHARSET = "lower(regexp_extract(" + _HEADER.format("content-type") + r", r'(?i)charset\s*=\s*[\x22\x27]?([A-Za-z0-9_-]+)', 1))"
_UTF8 = "coalesce({} rlike '^utf-?8$', false)"
_ALT = _TRIM.format("coalesce(i.alt, '')")
_GOOD_ALT = f"({_ALT} != '' and not {_ALT} rlike {q(FILE_NAME)})"

PAGE_CHECKS = [Check(*c) for c in (
    ("https-enabled", "technical", "critical", "home", "true", "not startswith(url, 'https://')"),
    ("charset-utf8", "technical", "critical", "page", "true", "not coalesce(meta_charset rlike '^utf-?8$', false)"),
    ("no-mixed-content", "technical", "important", "page", "true", f"startswith(url, 'https://') and {_MIXED}"),
    ("title-present", "meta", "critical", "page", "true", f"{_TITLE} = ''"),
    ("title-not-default-placeholder", "meta", "critical", "page", "true", f"{_TRIM.format(_TITLE)} rlike {q(PLACEHOLDER_TITLE)}"),
    ("h1-present", "meta", "critical", "page", "true", "size(h1) = 0"),
    ("title-unique-across-site", "meta", "important", "group", "true", _NORM.format("title")),
    ("title-length-range", "meta", "important", "page", f"{_TITLE} != ''", "length(title) < 30 or length(title) > 65"),
    ("title-no-keyword-stuffing", "meta", "important", "page", "true", rf"exists(filter(split({_NORM.format(_TITLE)}, r'[^\p{{L}}0-9]+'), t -> length(t) >= 4), t -> size(filter(split({_NORM.format(_TITLE)}, r'[^\p{{L}}0-9]+'), u -> u = t)) >= 3)"),
    ("description-present", "meta", "important", "page", "true", "coalesce(description, '') = ''"),
    ("description-unique-across-site", "meta", "important", "group", "true", _NORM.format("description")),
    ("h1-single", "meta", "important", "page", "true", "size(h1) > 1"),
    ("h1-not-empty", "meta", "important", "page", "true", "size(h1) > 0 and forall(h1, x -> x = '')"),
    ("html-lang-attribute", "meta", "important", "page", "true", "lang is null"),
    ("title-not-duplicate-of-h1", "meta", "advice", "page", "true", f"exists(h1, x -> {_NORM.format('x')} = {_NORM.format('title')})"),
    ("description-length-range", "meta", "advice", "page", "coalesce(description, '') != ''", "length(description) < 70 or length(description) > 160"),
    ("description-not-generic", "meta", "advice", "page", "true", f"coalesce(description, '') rlike {q(GENERIC_DESCRIPTION)}"),
    ("h1-length-range", "meta", "advice", "page", "true", "exists(h1, x -> x != '' and (length(x) < 3 or length(x) > 70))"),
    ("meta-keywords-not-overused", "meta", "advice", "page", "true", "size(filter(split(coalesce(keywords_meta, ''), '[,;]'), x -> trim(x) != '')) > 10"),
    ("no-noindex-on-crawled-pages", "indexing", "critical", "page", "true", "contains(meta_robots, 'noindex')"),
    ("canonical-not-pointing-elsewhere", "indexing", "critical", "page", "true", f"exists(canonical_abs, c -> {_HOST.format('c')} != site)"),
    ("canonical-single", "indexing", "important", "page", "true", "size(canonicals) > 1"),
    ("canonical-present", "indexing", "important", "page", "true", "size(canonicals) = 0"),
    ("url-no-uppercase-or-spaces", "indexing", "advice", "page", "true", rf"{_PATH} rlike r'[A-Z]|\s'"),
    ("url-no-cyrillic", "indexing", "advice", "page", "true", f"{_PATH} rlike '(?iu)[а-яё]'"),
    ("canonical-absolute-url", "indexing", "advice", "page", "true", "exists(canonicals, c -> not c rlike '(?i)^https?://')"),
    ("ai-content-without-js", "ai", "important", "home", "true", f"words < 60 and (html rlike {q(APP_SHELL)} or size(scripts) >= 3 or inline_chars > 20000)"),
    ("ai-jsonld-content-types", "ai", "important", "any", "true", f"arrays_overlap({_TYPES}, array({CONTENT_TYPES}))"),
    ("ai-machine-structure", "ai", "important", "any", "true", "lists_3plus > 0 or n_tables > 0 or n_dl > 0"),
    ("ai-answer-on-top", "ai", "important", "home", "true", f"not (top_text rlike {q(PRICE)} or regexp_count(top_text, '[0-9]+') >= 3)"),
    ("ai-prices-in-text", "ai", "important", "any", "true", _PRICED),
    ("ai-faq-block", "ai", "advice", "any", "true", f"array_contains({_TYPES}, 'FAQPage') or n_details >= 2 or size(filter(headings, h -> endswith(h.text, '?'))) >= 3 or array_join(transform(headings, h -> h.text), ' ') rlike {q(FAQ_HEADING)}"),
    ("no-placeholder-text", "content", "critical", "page", "true", _PLACEHOLDER),
    ("images-have-alt", "content", "important", "page", "site_images > 0", "exists(images, i -> i.alt is null)"),
    ("h2-present", "content", "important", "page", "words >= 250", "not exists(headings, h -> h.level = 2)"),
    ("heading-hierarchy-no-skip", "content", "important", "page", "true", "exists(sequence(1, greatest(size(headings) - 1, 1)), i -> coalesce(get(headings, i).level - get(headings, i - 1).level > 1, false))"),
    ("text-length-min", "content", "important", "page", "true", "words < 200"),
    ("contacts-present-on-site", "content", "important", "any", "true", _CONTACTS),
    ("alt-not-just-filename", "content", "advice", "page", "true", f"exists(images, i -> {_ALT} != '' and {_ALT} rlike {q(FILE_NAME)})"),
    ("no-empty-headings", "content", "advice", "page", "true", "exists(headings, h -> h.text = '')"),
    ("text-to-html-ratio", "content", "advice", "page", "true", "length(html) > 0 and length(text) / length(html) < 0.1"),
    ("external-links-have-rel", "content", "advice", "page", "true", "exists(links, l -> l.abs is not null and not l.internal and l.rel = '')"),
    ("duplicate-content-across-pages", "content", "important", "page", "true", "near_duplicate"),
    ("alt-coverage-ratio", "content", "advice", "site", "", "case when content_images = 0 then 'na' when floor(100 * good_alts / content_images + 0.5) >= 90 then 'passed' else 'failed' end"),
    ("internal-links-per-page", "content", "advice", "page", "true", "size(filter(links, l -> l.internal)) < 3"),
    ("image-dimensions-declared", "content", "advice", "page", "true", f"exists({_IMAGES}, i -> (coalesce(i.width, '') = '' or coalesce(i.height, '') = '') and not i.has_aspect_ratio)"),
    ("friendly-urls", "structure", "important", "page", "true", r"regexp_extract(url, r'://[^/?#]*(.*)$', 1) rlike r'(?i)\.(php|aspx?|jsp|cgi)(\?|$)|[?&](id|page_id|p|cat|option)='"),
    ("nav-links-are-anchors", "structure", "important", "home", "nav_present", "nav_anchors = 0 and nav_fake > 0"),
    ("url-depth-max-4", "structure", "advice", "page", "true", "depth > 4"),
    ("url-length-max-115", "structure", "advice", "page", "true", "length(url) > 115"),
    ("breadcrumbs-present", "structure", "advice", "page", "depth >= 2", "not has_breadcrumbs"),
    ("no-orphan-crawled-pages", "structure", "advice", "page", "not is_home", "not has_source"),
    ("trailing-slash-consistency", "structure", "advice", "site", "", "case when slash + no_slash < 5 then 'na' when least(slash, no_slash) / (slash + no_slash) > 0.2 then 'failed' else 'passed' end"),
    ("no-query-string-duplicates", "structure", "advice", "page", "true", "url rlike r'\\?.' and not exists(canonical_abs, c -> not c rlike r'\\?.')"),
    ("homepage-links-count", "structure", "advice", "home", "true", "size(filter(links, l -> l.internal)) not between 5 and 200"),
    ("anchor-text-not-empty", "structure", "advice", "page", "true", "exists(links, l -> l.text = '' and l.aria_label = '' and not l.has_img_alt)"),
    ("jsonld-present", "markup", "important", "any", "true", "size(jsonld) > 0"),
    ("jsonld-valid", "markup", "important", "page", "size(jsonld) > 0", "exists(jsonld, b -> b.error is not null)"),
    ("schema-organization-or-localbusiness", "markup", "important", "any", "true", f"exists({_TYPES}, t -> t rlike {q(ORGANIZATION)})"),
    *((f"og-{x}-present", "markup", "important", "page", "true", f"coalesce(try_element_at(og, 'og:{x}'), '') = ''") for x in ("title", "description", "image")),
    ("schema-breadcrumb", "markup", "advice", "any", "depth >= 2", f"array_contains({_TYPES}, 'BreadcrumbList') or contains(html, 'BreadcrumbList')"),
    ("schema-website", "markup", "advice", "any", "true", f"array_contains({_TYPES}, 'WebSite')"),
    *((f"og-{x}-present", "markup", "advice", "home", "true", f"coalesce(try_element_at(og, 'og:{x}'), '') = ''") for x in ("url", "type")),
    *((f"twitter-{x}-present", "markup", "advice", "home", "true", f"coalesce(try_element_at(twitter, 'twitter:{x}'), '') = ''") for x in ("card", "image")),
    ("viewport-meta-present", "mobile", "critical", "page", "true", "coalesce(viewport, '') = ''"),
    ("viewport-allows-zoom", "mobile", "important", "page", "true", r"coalesce(viewport, '') rlike r'(?i)user-scalable\s*=\s*(no|0)|maximum-scale\s*=\s*1(\.0)?(?![0-9A-Za-z_])'"),
    ("viewport-width-device-width", "mobile", "important", "page", "coalesce(viewport, '') != ''", r"not viewport rlike r'(?i)width\s*=\s*device-width'"),
    ("no-fixed-pixel-width-wrapper", "mobile", "important", "page", "true", "greatest(max_fixed_width, css_width) > 480"),
    ("no-horizontal-overflow-hint", "mobile", "advice", "page", "true", "bare_table or (not site_fluid and exists(images, i -> coalesce(try_cast(i.width as double), 0) > 480)) or greatest(max_fixed_width, css_width) > 480"),
    ("no-flash-or-applet", "mobile", "important", "page", "true", "n_flash > 0"),
    ("responsive-images-srcset", "mobile", "advice", "page", f"size({_RASTER}) > 0", f"exists({_RASTER}, i -> coalesce(i.srcset, '') = '' and not i.in_picture)"),
    ("font-size-not-tiny", "mobile", "advice", "page", "true", "tiny_font or css_tiny"),
    ("apple-touch-icon-present", "mobile", "advice", "home", "true", "not has_apple_icon"),
    ("theme-color-present", "mobile", "advice", "home", "true", "not has_theme_color"),
    ("privacy-policy-linked", "trust", "critical", "any", "true", f"exists(links, l -> concat(l.text, ' ', l.href) rlike {q(POLICY)})"),
    ("forms-have-consent", "trust", "critical", "page", f"size({_LEAD}) > 0", f"exists({_LEAD}, f -> not f.consent_checkbox and not f.consent_text)"),
    ("consent-not-prechecked", "trust", "important", "page", "exists(forms, f -> f.consent_checkbox)", "exists(forms, f -> f.consent_prechecked)"),
    ("a11y-form-labels", "trust", "important", "page", "size(forms) > 0", "exists(forms, f -> f.unlabeled_fields > 0)"),
    ("cookie-notice-with-trackers", "trust", "important", "site", "", "case when not tracked then 'na' when cookie then 'passed' else 'failed' end"),
    ("no-foreign-trackers", "trust", "advice", "site", "", "if(foreign, 'failed', 'passed')"),
    ("forms-spam-protection", "trust", "advice", "page", f"size({_LEAD}) > 0", f"exists({_LEAD}, f -> not f.spam_protected)"),
    ("a11y-button-names", "trust", "advice", "page", "true", "unnamed_buttons > 0"),
    ("a11y-main-landmark", "trust", "advice", "page", "true", "not has_main"),
    ("a11y-no-autoplay-sound", "trust", "advice", "page", "true", "autoplay_sound"),
)]

#: Checks that read tables of a crawl beside its pages.
CRAWL_CHECKS = [Check(*c) for c in (
    ("no-redirect-loop", "technical", "critical", "site", "", "if(exists(chains, c -> c.loop), 'failed', 'passed')", "chains"),
    ("redirect-chain-max-1", "technical", "important", "site", "", "if(exists(chains, c -> size(c.hops) > 2), 'failed', 'passed')", "chains"),
    ("no-5xx-on-crawl", "technical", "critical", "site", "", "if(n_5xx > 0, 'failed', 'passed')", "link_status"),
    ("homepage-status-200", "technical", "critical", "home", "true", "status != 200", "responses"),
    ("ttfb-under-600ms", "technical", "advice", "home", "true", "ttfb_ms >= 600", "responses"),
    ("ttfb-under-1500ms", "technical", "critical", "home", "true", "ttfb_ms >= 1500", "responses"),
    ("charset-utf8", "technical", "critical", "page", "true", f"not {_UTF8.format(_CHARSET)} and not {_UTF8.format('meta_charset')}", "responses"),
    ("404-returns-404-code", "technical", "important", "site", "", "case when coalesce(not_found.status, 0) = 0 then 'na' when not_found.status in (404, 410) then 'passed' else 'failed' end", "probes"),
    ("404-page-is-custom", "technical", "advice", "site", "", r"case when coalesce(not_found.status, 0) = 0 then 'na' when regexp_count(not_found.body, r'(?i)<a\s[^>]*href=') >= 3 and length(not_found.body) > 1500 then 'passed' else 'failed' end", "probes"),
    ("www-canonical-redirect", "technical", "important", "site", "", "case when alt_host is null then 'na' when size(alt_host.hops) > 1 and lower(regexp_extract(alt_host.final_url, r'://([^/?#:]*)', 1)) = home_host then 'passed' when alt_host.final_status >= 400 then 'passed' else 'failed' end", "chains"),
    ("cache-headers-static", "technical", "advice", "site", "", "case when n_static = 0 then 'na' when n_uncached > 0 then 'failed' else 'passed' end", "assets"),
    ("no-server-version-disclosure", "technical", "advice", "home", "true", f"{_HEADER.format('server')} rlike '[0-9]' or {_HEADER.format('x-powered-by')} != '' or {_HEADER.format('x-aspnet-version')} rlike '[0-9]'", "responses"),
    ("favicon-exists", "technical", "advice", "site", "", "if(home_icon or coalesce(favicon.status = 200, false), 'passed', 'failed')", "probes"),
    ("page-size-under-2mb", "technical", "important", "page", "true", "bytes + image_bytes > 2 * 1024 * 1024", "responses"),
    ("compression-enabled", "technical", "important", "home", f"{_HEADER.format('content-encoding')} rlike '(?i)gzip|br|deflate|zstd' or bytes >= 1400", f"not {_HEADER.format('content-encoding')} rlike '(?i)gzip|br|deflate|zstd'", "responses"),
    ("hsts-header", "technical", "advice", "home", "startswith(url, 'https://')", f"{_HEADER.format('strict-transport-security')} = ''", "responses"),
    ("http-redirects-to-https", "technical", "important", "site", "", f"case when not startswith(home_url, 'https://') then 'na' when coalesce(http.final_status, 0) = 0 then 'passed' when startswith(http.final_url, 'https://') and {_HOST.format('http.final_url')} = site then 'passed' else 'failed' end", "chains"),
    ("response-consistent-encoding", "technical", "advice", "page", "true", f"{_CHARSET} != '' and coalesce(meta_charset, '') != '' and regexp_replace({_CHARSET}, '^([^-]*)-', '$1') != regexp_replace(meta_charset, '^([^-]*)-', '$1')", "responses"),
    ("robots-not-disallow-all", "indexing", "critical", "site", "", "if(arrays_overlap(closed_to, array('*', 'YandexBot', 'Googlebot')), 'failed', 'passed')", "robots"),
    ("no-x-robots-noindex-header", "indexing", "critical", "page", "true", f"{_HEADER.format('x-robots-tag')} rlike '(?i)noindex'", "responses"),
    ("sitemap-valid-xml", "indexing", "important", "site", "", "case when not sitemap_found then 'na' when sitemap_valid then 'passed' else 'failed' end", "sitemaps"),
    ("sitemap-exists", "indexing", "important", "site", "", "if(sitemap_found, 'passed', 'failed')", "sitemaps"),
    ("robots-txt-exists", "indexing", "important", "site", "", "if(robots_status = 200 and robots_is_text, 'passed', 'failed')", "robots"),
    ("robots-txt-parseable", "indexing", "important", "site", "", "case when robots_status != 200 then 'na' when n_directives > 0 then 'passed' else 'failed' end", "robots"),
    ("sitemap-covers-homepage", "indexing", "advice", "site", "", "case when not sitemap_valid then 'na' when sitemap_has_home then 'passed' else 'failed' end", "sitemaps"),
    ("sitemap-urls-same-host", "indexing", "advice", "site", "", "case when not sitemap_valid then 'na' when n_foreign_urls > 0 then 'failed' else 'passed' end", "sitemaps"),
    ("robots-declares-sitemap", "indexing", "advice", "site", "", "case when robots_status != 200 then 'na' when n_declared > 0 then 'passed' else 'failed' end", "robots"),
    ("ai-bots-allowed", "ai", "critical", "site", "", "if(size(ai_closed) > 0, 'failed', 'passed')", "robots"),
    ("ai-freshness", "ai", "advice", "home", "true", rf"not ({_HEADER.format('last-modified')} != '' or exists(array(year(current_date()), year(current_date()) - 1), y -> text rlike concat('(?<![A-Za-z0-9_])', y, '(?![A-Za-z0-9_])')) or html rlike 'datePublished|dateModified')", "responses"),
    ("image-weight-limit", "content", "important", "site", "", "case when n_images = 0 then 'na' when n_heavy > 0 then 'failed' else 'passed' end", "assets"),
    ("image-modern-format", "content", "advice", "site", "", "case when n_raster = 0 then 'na' when floor(100 * n_modern / n_raster + 0.5) >= 50 then 'passed' else 'failed' end", "assets"),
    ("no-broken-internal-links", "structure", "critical", "page", "true", "broken_targets > 0", "link_status"),
    ("no-broken-images", "structure", "important", "site", "", "case when n_broken_images > 0 or empty_images then 'failed' when n_images > 0 then 'passed' else 'na' end", "assets"),
    ("sitemap-covers-crawled-pages", "structure", "important", "page", "sitemap_valid", "not contains(meta_robots, 'noindex') and not in_sitemap", "sitemaps"),
    ("no-links-to-redirects", "structure", "advice", "page", "true", "redirecting_targets > 0", "link_status"),
    ("header-frame-protection", "trust", "important", "home", "true", f"{_HEADER.format('x-frame-options')} = '' and not {_HEADER.format('content-security-policy')} rlike '(?i)frame-ancestors'", "responses"),
    ("header-content-type-options", "trust", "important", "home", "true", f"not {_HEADER.format('x-content-type-options')} rlike '(?i)nosniff'", "responses"),
    ("header-csp-present", "trust", "advice", "home", "true", f"{_HEADER.format('content-security-policy')} = '' and {_HEADER.format('content-security-policy-report-only')} = ''", "responses"),
    ("header-referrer-policy", "trust", "advice", "home", "true", f"{_HEADER.format('referrer-policy')} = '' and not has_referrer", "responses"),
    ("header-permissions-policy", "trust", "advice", "home", "true", f"{_HEADER.format('permissions-policy')} = ''", "responses"),
)]


def checks_for(*tables: str) -> list[Check]:
    """The checks that pages and the named tables of a crawl can answer; one that reads more replaces its namesake."""
    more = {c.id: c for c in CRAWL_CHECKS if c.needs in tables}
    own = [more.pop(c.id, c) for c in PAGE_CHECKS]
    return own + list(more.values())


#: Category and severity weights.
CATEGORIES = {"technical": 20.0, "meta": 20.0, "indexing": 15.0, "ai": 7.5, "content": 7.5, "structure": 7.5, "markup": 7.5, "mobile": 7.5, "trust": 7.5}
SEVERITIES = {"critical": 5, "important": 3, "advice": 1}


def own_check(silver: DataFrame, id: str, category: str, severity: str, test: str, kind: str = "page", cohort: str = "true") -> Check:
    """A check of one's own, for run_checks and the like beside those of checks_for. kind: page, home, any or group; `test` and `cohort` are expressions over
    silver rows (bad for page and home, good for any, the key for group).

    What can be told at once is told at once: a known category and severity, an id that is still free, expressions that the silver table can
    answer, of the right type. A test that can't be worked out for a row takes that row out of its cohort and no other check with it:
    casts and functions that would raise give null instead (see tried(); of operators, write try_divide(a, b) for a / b)."""
    if category not in CATEGORIES or severity not in SEVERITIES or kind not in ("page", "home", "any", "group"):
        raise ValueError(f"unknown category, severity or kind: {category}, {severity}, {kind}")
    if not re.fullmatch("[a-z0-9]+(-[a-z0-9]+)*", id) or id in {c.id for c in (*PAGE_CHECKS, *CRAWL_CHECKS)}:
        raise ValueError(f"not a free id: {id}")
    for expression, kinds in ((cohort, ("boolean",)), (test, ("string",) if kind == "group" else ("boolean",))):
        found = silver.selectExpr(f"({expression}) as x").dtypes[0][1]  # an AnalysisException names what silver lacks
        if found not in kinds:
            raise ValueError(f"{id}: {expression} is {found}, not {kinds[0]}")
    return Check(id, category, severity, kind, f"({tried(cohort)}) and ({tried(test)}) is not null", tried(test))


def tried(expression: str) -> str:
    """The expression with casts and divisions that give null where they would raise."""
    return re.sub(r"\bcast\s*\(", "try_cast(", re.sub(r"\b(to_number|to_timestamp|to_date|element_at|url_decode|parse_json|divide|add|subtract|multiply)\s*\(", r"try_\1(", expression, flags=re.I), flags=re.I)
