"""Sites and their pages: kinds of pages by rules, routes, roll-ups, templates, technologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import urls as U

#: Words that name a section of a site, by the kind of its pages. A path segment must be the word itself.
SECTIONS = {
    "category": "category categories kategorie rubrique categoria collection collections shop store department departments catalog catalogue",
    "news": "news press newsroom presse noticias actualites aktuelles",
    "job": "job jobs career careers vacancy vacancies position positions karriere emploi empleo stellen",
    "event": "event events ticket tickets concert concerts conference conferences meetup meetups termine",
    "company": "company companies organisation organization about about-us imprint impressum",
    "review": "review reviews rating ratings testimonial testimonials bewertungen",
    "directory": "directory listing listings location locations dealer dealers branches",
    "documentation": "doc docs documentation reference manual manuals guide guides handbook wiki faq kb",
    "login": "login log-in signin sign-in sso auth account",
    "search": "search find results suche recherche buscar",
    "archive": "archive archives tag tags topic topics",
    "contact": "contact contact-us contacts kontakt contacto contatti",
}
#: Words before the name of a single page of the kind.
PARENTS = {
    "product": "product products item items p dp sku artikel produkt produit producto",
    "article": "blog article articles post posts story stories magazine",
    "profile": "user users profile profiles people member members author authors",
}
#: Names of query parameters by the kind of the page that reads them.
PARAMETERS = {"search": "q query search s keyword keywords term", "listing": "page p pg offset start"}
#: Kinds that refine another one, and the least convincing score.
REFINES = {"news": "article", "category": "listing", "search": "listing", "archive": "listing", "directory": "listing"}
LEAST_SCORE = 2.0
#: One section's name convinces by itself; names that sites hardly use for anything else weigh half as much again, a
#: page that can be nothing else twice; a word in the first segment names the site's section, deeper ones may be a topic.
NAMED, SURE, CERTAIN, DEEPER = 2.0, 3.0, 4.0, 0.5
_SURE = frozenset(("job", "documentation", "search", "contact"))
_CERTAIN = frozenset(("login",))


def _words(text: str) -> Column:
    return F.array(*[F.lit(w) for w in text.split()])


def _weight(kind: str) -> float:
    return CERTAIN if kind in _CERTAIN else SURE if kind in _SURE else NAMED


def url_evidence(url: Column) -> dict[str, Column]:
    """For each kind what the URL says for it, from its segments, the shape of the last one and its parameters."""
    path = F.lower(U.path_col(url))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    parents = F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))
    last = F.when(n > 0, F.element_at(parts, -1)).otherwise("")
    stem = F.regexp_replace(last, r"\.\w{1,5}$", "")
    named = F.transform(parts, lambda p: F.regexp_replace(p, r"\.\w{1,5}$", ""))
    number = lambda x: F.when(x, NAMED).otherwise(0.0)
    out: dict[str, Column] = {}
    for kind, words in SECTIONS.items():
        w = _weight(kind)
        out[kind] = F.when(F.array_contains(_words(words), F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(""))), w).when(F.arrays_overlap(named, _words(words)), w - DEEPER).otherwise(0.0)
    for kind, words in PARENTS.items():
        out[kind] = number(F.arrays_overlap(parents, _words(words)))
    out["product"] = out["product"] + number(stem.rlike(r"(?:^|[-_]p?)\d{5,}$"))
    dated = path.rlike(r"/(?:19|20)\d\d/\d\d?/")
    out["article"] = out["article"] + number(dated & ~stem.rlike(r"^\d{1,2}$|^$"))
    out["archive"] = out["archive"] + number(path.rlike(r"/(?:19|20)\d\d(?:/\d\d?)?/?$"))
    out["profile"] = out["profile"] + number(last.startswith("@"))
    out["homepage"] = F.when((n == 0) | ((n == 1) & stem.rlike("^(?:index|home|default|[a-z]{2}(?:-[a-z]{2})?)$")), CERTAIN).otherwise(0.0)
    names = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.lower(F.substring_index(x, "=", 1)))
    for kind, words in PARAMETERS.items():
        out[kind] = out.get(kind, F.lit(0.0)) + F.when(F.arrays_overlap(names, _words(words)), _weight(kind) if kind == "search" else 1.0).otherwise(0.0)
    return out


def classify_url(url: Column) -> Column:
    """struct<kind, confidence>: evidence added up per kind, JVM-side; kinds add what the kind they refine has."""
    out = url_evidence(url)
    for kind, parent in REFINES.items():
        if parent in out:
            out[kind] = F.when(out[kind] > 0, out[kind] + out[parent]).otherwise(0.0)
    ranked = F.sort_array(F.array(*[F.struct(s.alias("score"), F.lit(k).alias("kind")) for k, s in sorted(out.items())]), asc=False)
    # a lambda's variable is computed once, however often it is named
    return F.transform(F.array(ranked), _winner)[0]


def _winner(ranked: Column) -> Column:
    best = ranked[0]
    refined = F.array(*[F.lit(f"{k}>{p}") for k, p in REFINES.items()])
    rest = F.filter(ranked, lambda x: (x["kind"] != best["kind"]) & ~F.array_contains(refined, F.concat(best["kind"], F.lit(">"), x["kind"])))[0]
    sure = (1 - F.exp(-best["score"] / 4)) * (best["score"] - rest["score"]) / best["score"]
    hit = best["score"] >= LEAST_SCORE
    return F.struct(F.when(hit, best["kind"]).otherwise("unknown").alias("kind"), F.when(hit, F.round(F.greatest(sure, F.lit(0.0)), 4)).otherwise(0.0).alias("confidence"))


def path_prefixes(url: Column) -> Column:
    """``/``, ``/a``, ``/a/b`` of a URL, JVM-side."""
    parts = F.filter(F.split(U.path_col(url), "/"), lambda p: p != "")
    n = F.size(parts)
    return F.when(url.isNotNull(), F.concat(F.array(F.lit("/")), F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))))


def path_rollup(pages: DataFrame, depth: int = 3) -> DataFrame:
    """``(host, prefix, pages)`` for every prefix of at most ``depth`` segments; counted before it is spread."""
    per = pages.filter("url is not null").groupBy(U.host_col(F.col("url")).alias("host"), F.regexp_extract(U.path_col(F.col("url")), "^((?:/[^/]+){0,%d})" % depth, 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    prefixes = path_prefixes(F.concat(F.lit("http://x"), F.when(F.col("p") == "", "/").otherwise(F.col("p"))))
    return per.select("host", "n", F.explode(prefixes).alias("prefix")).groupBy("host", "prefix").agg(F.sum("n").alias("pages"))


def routes(pages: DataFrame) -> DataFrame:
    """``(template, pages)`` of URL templates."""
    return pages.filter("url is not null").groupBy(U.url_template_col(F.col("url")).alias("template")).agg(F.count(F.lit(1)).alias("pages"))


def orphans(listed: DataFrame, linked: DataFrame) -> DataFrame:
    """Listed urls that nothing links to."""
    return listed.select("url").distinct().join(linked.select(F.col("href").alias("url")).distinct(), "url", "left_anti")


def dead_ends(pages: DataFrame, links: DataFrame) -> DataFrame:
    return pages.select("url").distinct().join(links.select("url").distinct(), "url", "left_anti")


def duplicate_routes(pages: DataFrame, digest: str) -> DataFrame:
    """``(digest, urls, example)`` of contents found at several urls."""
    return pages.filter(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("digest")).agg(F.count_distinct("url").alias("urls"), F.min("url").alias("example")).filter("urls > 1")


def navigation_entries(links: DataFrame, pages: int, least: int = 2) -> DataFrame:
    """``(text, href, pages)`` of links on at least half of the pages."""
    return links.groupBy("text", "href").agg(F.count_distinct("url").alias("pages")).filter(F.col("pages") >= max(least, -(-pages // 2)))


def site_profile(pages: DataFrame) -> DataFrame:
    """Per host: pages, by class of status, errors, share of errors, mean seconds between fetches."""
    s = F.col("status")
    per = pages.groupBy(U.host_col(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count(F.when((s >= 200) & (s < 300), 1)).alias("ok"), F.count(F.when((s >= 300) & (s < 400), 1)).alias("redirects"), F.count(F.when(s >= 400, 1)).alias("errors"), F.min("fetched").alias("a"), F.max("fetched").alias("b"))
    return per.select("host", "pages", "ok", "redirects", "errors", F.round(F.col("errors") / F.col("pages"), 4).alias("error_rate"), F.round(F.try_divide(F.col("b") - F.col("a"), F.col("pages") - 1), 3).alias("seconds_apart"))


#: Marks of technologies in a page (name, literal that must be there, pattern, probability).
TECHNOLOGIES = [
    ("WordPress", "wp-", r"/wp-(?:content|includes)/", 0.95), ("WordPress", "generator", r"(?i)<meta[^>]+generator[^>]+WordPress", 0.99), ("Shopify", "shopify", r"cdn\.shopify\.com|Shopify\.theme", 0.95),
    ("WooCommerce", "woocommerce", r"(?i)woocommerce", 0.9), ("Drupal", "rupal", r"Drupal\.settings|/sites/default/files", 0.9), ("Magento", "age", r"Magento_|mage/cookies", 0.9), ("React", "react", r"data-reactroot|react(?:-dom)?(?:\.production)?\.min\.js", 0.85),
    ("Next.js", "_next", r"/_next/static|__NEXT_DATA__", 0.95), ("Vue.js", "data-v-", r"data-v-[0-9a-f]{6,}", 0.8), ("Angular", "ng-", r"ng-(?:version|app)=", 0.9), ("jQuery", "query", r"(?i)jquery[.\-\w]*\.js", 0.85), ("Bootstrap", "ootstrap", r"(?i)bootstrap[.\-\w]*\.(?:css|js)", 0.8), ("Google Analytics", "google", r"google-analytics\.com|gtag\(", 0.9), ("Google Tag Manager", "googletag", r"googletagmanager\.com", 0.95), ("Cloudflare", "cloudflare", r"(?i)cloudflare", 0.6),
]


def technologies(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(url, technology, confidence)``: 1 - product of (1 - p) over the marks found; a literal is looked for first."""
    marks = F.array(*[F.when(F.contains(html, F.lit(lit)) & F.col(html).rlike(p), F.struct(F.lit(n).alias("n"), F.lit(w).alias("w"))) for n, lit, p, w in TECHNOLOGIES])
    found = pages.select("url", F.explode(F.array_compact(marks)).alias("m"))
    return found.groupBy("url", F.col("m.n").alias("technology")).agg(F.round(1 - F.exp(F.sum(F.ln(1 - F.col("m.w")))), 4).alias("confidence"))


def fuse_candidates(candidates: DataFrame) -> DataFrame:
    """``(field, value, confidence)``: equal values agree (1 - product of (1 - p)), the runner-up costs confidence.

    ``candidates`` has record, field, value, p.
    """
    key = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    per = candidates.filter("value is not null").groupBy("record", "field", key.alias("k")).agg((1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("c"), F.max_by("value", "p").alias("value"))
    best = per.groupBy("record", "field").agg(F.max(F.struct("c", "k", "value")).alias("b"), F.sort_array(F.collect_list("c"), asc=False).alias("all"))
    second = F.coalesce(F.try_element_at("all", F.lit(2)), F.lit(0.0))
    return best.select("record", "field", "b.value", F.round(F.col("b.c") * (1 - 0.5 * second), 4).alias("confidence"))


def method_precision(results: DataFrame, least: int = 5) -> DataFrame:
    """``(method, precision)`` of extraction methods with enough samples, within 0.05 and 0.99."""
    return results.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("right").cast("double")).alias("p")).filter(F.col("n") >= least).select("method", F.round(F.least(F.greatest("p", F.lit(0.05)), F.lit(0.99)), 4).alias("precision"))
