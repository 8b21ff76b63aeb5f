"""Landed HTML to rows: list cards, detail pages, organisation pages.  Built-in expressions throughout."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import text as T
from tidemark.functions.patterns import S, all_matches, captured, filled, first_group, let, squeezed, trimmed

# The markup that is read.  Any character is a dot under (?s): a class like [\s\S] is two predicates, and of these
# Java 17 writes to memory that all threads of a machine share, so that eight of them search no faster than one.  White space around what is captured goes later.
CARD_HEAD = r"""(?s)^<li.*?<div[^>]*data-entity-urn="urn:li:jobPosting:([0-9]+)\""""
CARD = r"""(?s)<li(?>.*?<div[^>]*data-entity-urn="urn:li:jobPosting:([0-9]+)").*?</li>"""
#: A card, or all that is left where none follows: a failed search is not begun again at each list item and each card of the rest.
CARD_OR_REST = r"""(?s)<li(?>.*?<div[^>]*data-entity-urn="urn:li:jobPosting:[0-9]+"|.*+)(?>.*?</li>|.*+)"""
#: The id of the first card that begins in a text, or nothing; the text is read once.
CARD_ID = r"""(?s)<li(?>.*?<div[^>]*data-entity-urn="urn:li:jobPosting:([0-9]+)"|.*+)"""
MARKER = r'data-entity-urn="urn:li:jobPosting:[0-9]+"'
TITLE = r'class="base-search-card__title"[^>]*>([^<]*)<'
SUBTITLE = r'(?s)class="base-search-card__subtitle".*?<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
PLACE = r'class="job-search-card__location"[^>]*>([^<]*)<'
STAMP = r'<time[^>]*datetime="([^"]+)"'
FULL_LINK = r'<a[^>]*class="[^"]*base-card__full-link[^"]*"[^>]*href="([^"]+)"'
TRACKING = r'data-tracking-id="([^"]*)"'
PROMOTED = r"(?<!\w)(?:Promoted|Promoveret|Förderat)(?!\w)"
EASY_APPLY = r"(?<!\w)(?:Easy Apply|Hurtig ansøgning)(?!\w)"
#: Parts without a gap of any match of the two, and of one of BENEFIT: a plain search for them tells most cards apart.
PROMOTED_PARTS, EASY_APPLY_PARTS, BENEFIT_PART = ("Promoted", "Promoveret", "Förderat"), ("Easy", "Hurtig"), "job-posting-benefits__text"
BENEFIT = r'class="[^"]*job-posting-benefits__text[^"]*"[^>]*>([^<]*)<'
CRITERION = r'(?s)<li[^>]*class="[^"]*description__job-criteria-item[^"]*"[^>]*>(.*?)</li>'
CRITERION_LABEL = r'(?s)<h3[^>]*class="[^"]*description__job-criteria-subheader[^"]*"[^>]*>(.*?)</h3>'
CRITERION_VALUE = r'(?s)<span[^>]*class="[^"]*description__job-criteria-text[^"]*"[^>]*>(.*?)</span>'
DESCRIPTION = rf'(?is)<div[^>]*class="[^"]*show-more-less-html__markup[^"]*"[^>]*>(.*?)</div>{S}*(?:<button|</section)'
APPLICANTS = r'(?s)<figcaption[^>]*class="[^"]*num-applicants__caption[^"]*"[^>]*>(.*?)</figcaption>'
POSTED_AGO = r'(?s)<span[^>]*class="[^"]*posted-time-ago__text[^"]*"[^>]*>(.*?)</span>'
POSTER, POSTER_WINDOW = "message-the-recruiter", 2500
POSTER_LINK = r'class="[^"]*base-card__full-link[^"]*"[^>]*href="([^"]+)"'
POSTER_NAME = r'(?s)class="[^"]*base-main-card__title[^"]*"[^>]*>(.*?)</h3>'
POSTER_TITLE = r'(?s)class="[^"]*base-main-card__subtitle[^"]*"[^>]*>(.*?)</h4>'
POSTER_PHOTO = r'<img[^>]*data-delayed-url="([^"]+)"'
JSON_LD = r'(?s)<script type="application/ld\+json">(.*?)</script>'

PAGE_SIZE = 10
#: Levels of lists and @graph nodes that are searched for an organisation by expressions; what lies deeper is rare
#: and is searched by a helper in Python.
GRAPH_DEPTH = 3


def _plain(captured_text: Column) -> Column:
    return T.decode_entities(trimmed(F.regexp_replace(captured_text, "<[^>]+>", "")))


def card_blocks(html: Column) -> Column:
    """The matches of CARD.

    Where each list item that ends is a card or holds no other item's beginning, the matches are the items themselves, found by
    their ends.  On other pages a match may run over ends, and the pattern is searched; what is left behind the last match is
    found with them, once, and goes.
    """
    whole = lambda b: F.endswith(b, F.lit("</li>")) & F.regexp_like(b, F.lit(CARD_HEAD))
    searched = F.filter(all_matches(html, CARD_OR_REST), whole)
    first = lambda t: F.instr(t, "<li")
    item = lambda t: F.struct(t.alias("text"), first(t).alias("at"), (F.regexp_extract(t, CARD_ID, 1) != "").alias("card"))
    # What stands behind the last end is no item.
    ended = let(F.split(html, "</li>"), lambda t: F.transform(F.slice(t, F.lit(1), F.size(t) - 1), item))
    found = lambda items: F.transform(F.filter(items, lambda i: i["card"]), lambda i: F.concat(
        F.substr(i["text"], i["at"]), F.lit("</li>")))
    plain = lambda items: F.forall(items, lambda i: i["card"] | (i["at"] == 0))
    return F.coalesce(let(ended, lambda items: F.when(plain(items), found(items))), searched)


def card_fields(block: Column) -> list[Column]:
    """The twelve fields of a list card."""
    source_id = F.regexp_extract(block, CARD_HEAD, 1)
    benefits = let(F.filter(F.transform(all_matches(block, BENEFIT, 1), _plain), lambda b: b != ""), lambda b: F.when(F.size(b) > 0, b))
    has = lambda *parts: reduce(or_, (F.contains(block, F.lit(p)) for p in parts))
    # Spark computes first what two columns have in common, also behind an "and"; so words of other cards are null.
    words = F.regexp_replace(F.when(has(*PROMOTED_PARTS, *EASY_APPLY_PARTS), block), "<[^>]+>", " ")
    return [
        source_id.alias("sourceJobId"),
        F.concat(F.lit("urn:li:jobPosting:"), source_id).alias("urn"),
        _plain(captured(block, TITLE)).alias("title"),
        _plain(captured(block, SUBTITLE, 2)).alias("company"),
        T.without_query(first_group(block, SUBTITLE)).alias("companyUrl"),
        _plain(captured(block, PLACE)).alias("location"),
        captured(block, STAMP).alias("postedAtIso"),
        T.without_query(first_group(block, FULL_LINK)).alias("jobUrl"),
        captured(block, TRACKING).alias("trackingId"),
        (has(*PROMOTED_PARTS) & F.regexp_like(words, F.lit(PROMOTED))).alias("isPromoted"),
        (has(*EASY_APPLY_PARTS) & F.regexp_like(words, F.lit(EASY_APPLY))).alias("isEasyApplyOnCard"),
        F.when(has(BENEFIT_PART), benefits).alias("postingBenefits"),
    ]


def cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per card, in page order (pos), with the page's other columns."""
    others = [c for c in pages.columns if c != html]
    blocks = pages.select(*others, F.posexplode(card_blocks(F.col(html))).alias("pos", "block"))
    return blocks.select(*others, "pos", *card_fields(F.col("block")))


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Per page: n_cards, has_next, and drifted (cards in the markup that the pattern does not find)."""
    others, n = [c for c in pages.columns if c != html], F.col("n_cards")
    found = pages.select(*others, F.size(card_blocks(F.col(html))).alias("n_cards"), F.regexp_like(html, F.lit(MARKER)).alias("_marked"))
    return found.select(*others, n, (n == PAGE_SIZE).alias("has_next"), ((n == 0) & F.col("_marked")).alias("drifted"))


def criteria(html: Column) -> Column:
    """Label and value pairs of a detail page in order."""
    tidy = lambda c: squeezed(T.decode_entities(c))
    pairs = F.transform(
        all_matches(html, CRITERION, 1),
        lambda b: F.struct(tidy(first_group(b, CRITERION_LABEL)).alias("label"), tidy(first_group(b, CRITERION_VALUE)).alias("value")),
    )
    return F.filter(pairs, lambda p: (p["label"] != "") & (p["value"] != ""))


def _last_value(pairs: Column, label: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda p: p["label"] == label), F.lit(-1))["value"]


def _workplace(pairs: Column) -> Column:
    """By the first criterion that names a kind of workplace; a label's last value stands at its first place."""
    def kind(p: Column) -> Column:
        last = F.lower(F.element_at(F.filter(pairs, lambda q: q["label"] == p["label"]), -1)["value"])
        return let(last, lambda value: (
            F.when(F.contains(value, F.lit("remote")), "remote")
            .when(F.contains(value, F.lit("hybrid")), "hybrid")
            .when(F.contains(value, F.lit("on-site")) | F.contains(value, F.lit("onsite")), "onsite")
        ))

    return F.try_element_at(F.filter(F.transform(pairs, kind), lambda k: k.isNotNull()), F.lit(1))


def poster(html: Column) -> Column:
    """struct(name, title, url, photo) of the person who posted; null where neither name nor link is given."""
    at = F.instr(html, POSTER)

    def clean(c: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), "<[^>]+>", "")
        return T.decode_entities(squeezed(T.decode_entities(bare)))

    def parts(block: Column) -> Column:
        found = {"name": clean(first_group(block, POSTER_NAME)), "title": clean(first_group(block, POSTER_TITLE)), "url": first_group(block, POSTER_LINK),
                 "photo": T.decode_entities(first_group(block, POSTER_PHOTO))}
        return F.struct(*(let(c, filled).alias(n) for n, c in found.items()))

    given = lambda p: F.when(p["name"].isNotNull() | p["url"].isNotNull(), p)
    return F.when(at > 0, let(let(F.substring(html, at, F.lit(POSTER_WINDOW)), parts), given))


def details(pages: DataFrame, html: str = "html") -> DataFrame:
    """The eleven fields of each detail page, with the page's other columns."""
    others = [c for c in pages.columns if c != html]
    page, page_ = F.col(html), F.col("_page")
    # In steps, so that what is used more than once is computed once.
    first = pages.select(*others, page.alias("_page"), trimmed(first_group(page, DESCRIPTION)).alias("_inner"))
    first = first.select(*others, "_page", F.struct("_inner", T.strip_tags(F.col("_inner")).alias("_text")).alias("_found"))
    # Spark does not move a filter on what a generator brings below it.  A filter on descriptions would otherwise go down to the tables
    # that the pages come from, into a join's condition, and have each page made and read again for each place it names.
    first = first.select(*others, "_page", F.inline(F.array("_found")))
    first = first.select(*others, "_page", filled(F.col("_inner")).alias("descriptionHtml"), filled(F.col("_text")).alias("description"))
    first = first.select("*", criteria(page_).alias("_criteria"), squeezed(T.decode_entities(first_group(page_, APPLICANTS))).alias("_applicants"))
    pairs, text = F.col("_criteria"), F.col("description")
    count = F.replace(captured(F.col("_applicants"), "([0-9][0-9,]*)"), F.lit(","), F.lit(""))
    return first.select(
        *others, "description", "descriptionHtml",
        _last_value(pairs, "Seniority level").alias("seniorityLevel"),
        _last_value(pairs, "Employment type").alias("employmentType"),
        _last_value(pairs, "Job function").alias("jobFunction"),
        _last_value(pairs, "Industries").alias("industry"),
        count.try_cast("long").alias("applicantCount"),
        F.coalesce(_workplace(pairs), T.workplace_type(text)).alias("workplaceType"),
        filled(squeezed(T.decode_entities(first_group(page_, POSTED_AGO)))).alias("postedRelative"),
        T.salary(text).alias("salary"),
        poster(page_).alias("poster"),
    )


def _json(node: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(node, path, kind)


def _organisations(node: Column, depth: int) -> Column:
    """Organisation nodes among node, its elements and its @graph, in order, down to some depth."""
    kind = F.try_variant_get(node, "$['@type']", "string")
    kinds = F.try_variant_get(node, "$['@type']", "array<string>")
    own = (kind == "Organization") | F.array_contains(kinds, "Organization")
    here = F.when(own, F.array(node)).otherwise(F.array().cast("array<variant>"))
    if not depth:
        return here
    # Python callables of higher-order functions can't recurse over a lambda variable of unknown depth;
    # the nesting is unrolled instead.
    below = F.coalesce(_json(node, "$", "array<variant>"), _json(node, "$['@graph']", "array<variant>"),
                       F.array().cast("array<variant>"))
    deeper = F.flatten(F.transform(below, lambda n: _organisations(n, depth - 1)))
    return F.when(own, F.array(node)).otherwise(deeper)


@F.pandas_udf(StringType())
def _deep_organisation(scripts: pd.Series) -> pd.Series:
    """The first organisation node of JSON texts at any depth of lists and @graph nodes, as JSON."""
    def search(text: str) -> str | None:
        try:
            todo = [json.loads(text)]
        except (ValueError, RecursionError):
            return None
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                kind = node.get("@type")
                if kind == "Organization" or (isinstance(kind, list) and "Organization" in kind):
                    return json.dumps(node)
                node = node.get("@graph")
            if isinstance(node, list):
                todo += reversed(node)
        return None

    return scripts.map(lambda texts: None if texts is None else next(filter(None, map(search, texts)), None))


def organisations(pages: DataFrame, html: str = "html", depth: int = GRAPH_DEPTH) -> DataFrame:
    """The first organisation that each page declares as JSON-LD; all fields null where there is none."""
    others = [c for c in pages.columns if c != html]
    scripts = F.transform(all_matches(F.col(html), JSON_LD, 1), lambda s: F.try_parse_json(trimmed(s)))
    found = F.flatten(F.transform(scripts, lambda s: F.coalesce(_organisations(s, depth), F.array().cast("array<variant>"))))
    nodes = pages.select(*others, F.col(html).alias("_html"), F.try_element_at(found, F.lit(1)).alias("_org"))
    deep = F.col("_org").isNull() & F.contains("_html", F.lit("Organization"))
    deeper = _deep_organisation(F.when(deep, all_matches(F.col("_html"), JSON_LD, 1)))
    nodes = nodes.select(*others, F.coalesce("_org", F.try_parse_json(deeper)).alias("_org"))
    org = F.col("_org")
    is_kind = lambda path, *kinds: F.schema_of_variant(
        F.try_variant_get(org, path, "variant")).isin(*kinds)

    def text(path: str) -> Column:
        return F.when(is_kind(path, "STRING"), filled(_json(org, path, "string")))

    def whole(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(org, path, "variant"))
        number = (kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
        return F.when(number, _json(org, path, "double").cast("long"))

    address = F.struct(
        text("$.address.streetAddress").alias("street"), text("$.address.addressLocality").alias("city"),
        text("$.address.addressRegion").alias("region"), text("$.address.postalCode").alias("postalCode"),
        text("$.address.addressCountry").alias("country"),
    )
    has_address = F.startswith(F.schema_of_variant(F.try_variant_get(org, "$.address", "variant")), F.lit("OBJECT"))
    logo = F.when(is_kind("$.logo", "STRING"), _json(org, "$.logo", "string")).otherwise(text("$.logo.contentUrl"))
    return nodes.select(
        *others, text("$.name").alias("name"), T.decode_entities(text("$.description")).alias("description"),
        T.decode_entities(text("$.slogan")).alias("slogan"), text("$.sameAs").alias("website"),
        F.coalesce(whole("$.numberOfEmployees.value"), whole("$.numberOfEmployees")).alias("employeeCount"),
        logo.alias("logo"), F.when(has_address, address).alias("address"),
    )


def links(html: Column) -> Column:
    """The targets of a page's links, decoded."""
    return F.transform(all_matches(html, r"""(?i)<a\s[^>]*href="([^"]*)\"""", 1), T.decode_entities)
