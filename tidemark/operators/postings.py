"""Posting rows: projection of cards, enrichment, filters, shaping for output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import reference_data as ref
from tidemark.functions import text as T
from tidemark.functions.patterns import empty_strings, filled, literals

_ADDRESS = "struct<street:string,city:string,region:string,postalCode:string,country:string>"
_PROFILES = "struct<" + ",".join(f"{p}:array<string>" for p in T.SOCIAL_KEPT) + ">"
PORTAL_URL, SOURCE = "https://www.linkedin.com", "linkedin"

#: All columns of a posting and their types, in order.
POSTING_FIELDS = {
    **{c: "string" for c in ("scrapedAt", "portalUrl", "source", "jobId", "sourceJobId", "jobUrl", "title", "company",
                             "companyUrl", "companyId", "location", "country", "postedAt", "applyUrl", "applyType",
                             "description", "descriptionHtml", "descriptionMarkdown", "aiSummary")},
    "skills": "array<string>",
    **{c: "string" for c in ("seniorityLevel", "employmentType", "industry", "jobFunction", "workplaceType")},
    "applicantCount": "bigint", "easyApply": "boolean", "salaryMin": "bigint", "salaryMax": "bigint",
    "salaryCurrency": "string", "salaryPeriod": "string", "salarySource": "string", "salaryIsPredicted": "boolean",
    "companyLogo": "string", "companyDescription": "string", "companySlogan": "string", "companyEmployeeCount": "bigint",
    "companyWebsite": "string", "companyAddress": _ADDRESS,
    **{c: "string" for c in ("contactName", "recruiterName", "recruiterUrl", "recruiterTitle", "recruiterPhoto",
                             "contactEmail", "contactPhone", "companyLinkedIn")},
    "companySocialLinks": "array<string>", "applyEmail": "string", "extractedEmails": "array<string>",
    "extractedPhones": "array<string>", "extractedUrls": "array<string>", "socialProfiles": _PROFILES,
    **{c: "string" for c in ("changeType", "firstSeenAt", "lastSeenAt", "previousSeenAt", "expiredAt")},
    "isRepost": "boolean", "repostOfId": "string", "repostDetectedAt": "string", "language": "string",
    "contentHash": "string", "isPromoted": "boolean", "postingBenefits": "array<string>", "trackingId": "string",
}
#: Arrays that are empty and never null.
_NEVER_NULL = ("skills", "extractedEmails", "extractedPhones", "extractedUrls")
DESCRIPTION_COLUMNS = {"text": ("description", "descriptionText"), "html": ("descriptionHtml",), "markdown": ("descriptionMarkdown",)}


def as_postings(df: DataFrame, known: dict[str, Column], *extra: str) -> DataFrame:
    """Rows with all posting columns; what known does not give is null or empty."""
    def column(name: str, kind: str) -> Column:
        if name in known:
            return known[name].cast(kind).alias(name)
        if name in _NEVER_NULL:
            return empty_strings().alias(name)
        if name == "socialProfiles":
            return T.no_profiles().alias(name)
        return F.lit(None).cast(kind).alias(name)

    return df.select(*extra, *(column(n, k) for n, k in POSTING_FIELDS.items()))


def transform_cards(cards: DataFrame, scraped_at: str, *extra: str, source: str = H.SOURCE_NAME) -> DataFrame:
    """Cards (with countryHint) as postings."""
    c = F.col
    posted = T.date_of(c("postedAtIso"))
    none = F.lit(None).cast("string")
    return as_postings(cards, {
        "scrapedAt": F.lit(scraped_at), "portalUrl": F.lit(PORTAL_URL), "source": F.lit(SOURCE),
        "jobId": H.job_id(c("sourceJobId"), source), "sourceJobId": c("sourceJobId"), "jobUrl": c("jobUrl"),
        "title": c("title"), "company": c("company"), "companyUrl": c("companyUrl"),
        "companyId": T.company_segment(c("companyUrl")), "location": c("location"),
        "country": T.country(c("location"), c("countryHint")), "postedAt": posted, "applyUrl": c("jobUrl"),
        "applyType": F.when(c("isEasyApplyOnCard"), "onsite").otherwise("unknown"),
        "aiSummary": T.summary(c("title"), c("company"), c("location"), none), "skills": T.skills(c("title")),
        "easyApply": c("isEasyApplyOnCard"), "companyLinkedIn": T.company_page(c("companyUrl")),
        "applyEmail": T.mailto(c("jobUrl")),
        "contentHash": H.content_hash(c("title"), c("company"), c("location"), posted, none),
        "isPromoted": c("isPromoted"), "postingBenefits": c("postingBenefits"), "trackingId": c("trackingId"),
    }, *extra)


def with_details(items: DataFrame, details: DataFrame, phone_mode: str = "strict") -> DataFrame:
    """Postings with the fields of their detail pages (unique by sourceJobId); others stay as they are.

    To enrich some postings only, give only their pages: keys made null for the others would gather these in one task of
    the join.  The new values win over old ones where they are not null, and what is derived from the description is
    derived anew.
    """
    extra = [c for c in items.columns if c not in POSTING_FIELDS]
    d = details.select("sourceJobId", F.struct(*(c for c in details.columns if c != "sourceJobId")).alias("_d"))
    d = d.withColumnRenamed("sourceJobId", "_source")
    rows = items.join(d, F.col("sourceJobId") == F.col("_source"), "left")
    c, new = F.col, lambda f: F.col("_d")[f]
    rows = rows.withColumns({
        "_desc": F.coalesce(new("description"), c("description")),
        "_html": F.coalesce(new("descriptionHtml"), c("descriptionHtml")),
    })
    text, html = c("_desc"), c("_html")
    socials = F.array_distinct(F.concat(F.coalesce("companySocialLinks", empty_strings()), T.social_links(html)))
    words = F.concat_ws("\n", *(F.coalesce(x, F.lit("")) for x in (
        c("title"), text, new("seniorityLevel"), new("employmentType"), new("industry"), new("jobFunction"))))
    title_and_text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce(text, F.lit("")))
    profiles = T.social_profiles(text, T.OWN_HOSTS, T.SOCIAL_KEPT)
    nothing = empty_strings()
    distinct = lambda *a: F.array_distinct(F.concat(*(F.coalesce(x, nothing) for x in a)))
    fresh = {
        "description": text, "descriptionHtml": html, "descriptionMarkdown": T.markdown(text),
        "aiSummary": T.summary(c("title"), c("company"), c("location"), text),
        "skills": T.merged_skills(c("skills"), T.skills(words)),
        "extractedEmails": distinct(c("extractedEmails"), T.emails(text), T.emails(html)),
        "extractedPhones": distinct(c("extractedPhones"), T.phones(text, phone_mode)),
        "extractedUrls": F.array_sort(distinct(c("extractedUrls"), T.urls(text, T.OWN_HOSTS))),
        "socialProfiles": F.when(text.isNull(), c("socialProfiles")).otherwise(
            T.merged_profiles(c("socialProfiles"), profiles)),
        "companySocialLinks": F.when(F.size(socials) > 0, socials).otherwise(c("companySocialLinks")),
        **{f: F.coalesce(new("poster")[p], c(f)) for f, p in (("contactName", "name"), ("recruiterName", "name"), (
            "recruiterTitle", "title"), ("recruiterUrl", "url"), ("recruiterPhoto", "photo"))},
        **{f: F.coalesce(new(f), c(f)) for f in ("seniorityLevel", "employmentType", "industry", "jobFunction", "applicantCount")},
        "workplaceType": F.coalesce(new("workplaceType"), c("workplaceType"), T.workplace_type(title_and_text)),
        "salaryMin": F.coalesce(new("salary")["min"], c("salaryMin")),
        "salaryMax": F.coalesce(new("salary")["max"], c("salaryMax")),
        "salaryCurrency": F.coalesce(new("salary")["currency"], c("salaryCurrency")),
        "salaryPeriod": F.coalesce(new("salary")["period"], c("salaryPeriod")),
        "salarySource": F.when(new("salary").isNotNull(), "description_extract").otherwise(c("salarySource")),
        "contentHash": H.content_hash(c("title"), c("company"), c("location"), c("postedAt"), text),
    }
    matched = c("_d").isNotNull()
    return rows.select(*extra, *(
        F.when(matched, fresh[f]).otherwise(c(f)).cast(k).alias(f) if f in fresh else c(f) for f, k in POSTING_FIELDS.items()
    ))


COMPANY_COLUMNS = {
    "companyDescription": "description", "companySlogan": "slogan", "companyWebsite": "website",
    "companyEmployeeCount": "employeeCount", "companyLogo": "logo", "companyAddress": "address",
}


def with_companies(items: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings with the fields of their company's page (unique by slug), nulls included where a page matches.

    Spark broadcasts the companies if their size allows it, and sorts and merges them otherwise.
    """
    names = items.columns
    info = companies.select(F.col("slug").alias("_slug"), F.struct(*(c for c in companies.columns if c != "slug")).alias("_c"))
    rows = items.join(info, T.company_slug(F.col("companyUrl")) == F.col("_slug"), "left")
    found = F.col("_c").isNotNull()
    new = {to: F.when(found, F.col("_c")[of]).otherwise(F.col(to)) for to, of in COMPANY_COLUMNS.items()}
    new["company"] = F.when(filled(F.col("company")).isNull(), F.coalesce(filled(F.col("_c")["name"]), F.col("company"))
                            ).otherwise(F.col("company"))
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in names))


@dataclass(frozen=True)
class PostingFilters:
    """Row filters of a run."""

    remove_agency: bool = False
    exclude_keywords: tuple[str, ...] = ()
    exclude_companies: tuple[str, ...] = ()
    salary_min: int | None = None
    salary_max: int | None = None
    salary_include_unknown: bool = True


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(literals(*(w.lower() for w in words)), lambda w: F.contains(low, w))


def meaningful() -> Column:
    """Whether a row has an id and anything to show."""
    shown = [filled(F.col(c)).isNotNull() for c in ("title", "company", "jobUrl", "location")]
    return filled(F.col("sourceJobId")).isNotNull() & (shown[0] | shown[1] | shown[2] | shown[3])


def by_agency() -> Column:
    return _has_any(F.col("company"), ref.AGENCY_KEYWORDS)


def excluded(f: PostingFilters) -> Column:
    """Whether an excluded keyword is in the title, or an excluded company's name in the company."""
    out = F.lit(False)
    if f.exclude_keywords:
        out = out | _has_any(F.col("title"), f.exclude_keywords)
    if f.exclude_companies:
        out = out | _has_any(F.col("company"), f.exclude_companies)
    return out


def within_salary(f: PostingFilters) -> Column:
    """Whether the range of pay overlaps the asked one; an open end counts as the other end."""
    low, high = F.col("salaryMin"), F.col("salaryMax")
    if f.salary_min is None and f.salary_max is None:
        return F.lit(True)
    inside = F.lit(True)
    if f.salary_min is not None:
        inside = inside & (F.coalesce(high, low) >= f.salary_min)
    if f.salary_max is not None:
        inside = inside & (F.coalesce(low, high) <= f.salary_max)
    return F.when(low.isNull() & high.isNull(), F.lit(f.salary_include_unknown)).otherwise(inside)


def salary_step(amount: Column) -> Column:
    """The number of the highest step of the source's salary filter that an amount reaches, 0 below the first."""
    reached = F.filter(F.array(*(F.lit(float(s)) for s in ref.SALARY_STEPS)), lambda s: s <= amount)
    return F.size(reached).cast("long")


def as_searched(asked: dict, now: str) -> Column:
    """Whether a posting fits what a search asks of the source: age, workplace, experience, employment, region, pay and easy application.

    Landed pages come from searches that have asked this already; tables of other origin can be held to the same.
    A posting that does not say passes, as only its detail page would.  Regions are compared by country, pay by the source's
    steps.  Distance and numbers of companies are not on postings: pages are chosen by them (``sources.searched``).
    """
    c, out = F.col, F.lit(True)
    seconds = ref.DATE_POSTED_SECONDS.get(asked.get("datePosted") or "")
    if seconds:
        age = F.unix_seconds(F.try_to_timestamp(F.lit(now))) - F.unix_seconds(F.try_to_timestamp(c("postedAt")))
        out = out & F.coalesce(age <= seconds, F.lit(True))
    for name, column, labels in (("workType", "workplaceType", None), ("experienceLevel", "seniorityLevel", ref.EXPERIENCE_LABELS),
                                 ("jobType", "employmentType", ref.JOB_TYPE_LABELS)):
        wanted = [(labels or {}).get(v, v) for v in asked.get(name) or ()]
        if wanted:
            out = out & F.coalesce(F.lower(c(column)).isin(*(w.lower() for w in wanted)), F.lit(True))
    if asked.get("easyApply"):
        out = out & F.coalesce(c("easyApply"), F.lit(False))
    ids = {*(asked.get("geoIds") or ()), *([asked["geoId"]] if asked.get("geoId") else ())}
    countries = [code for code, geo in ref.GEO_IDS.items() if geo in ids]
    # An id that is no country's says nothing about one.
    if countries and len(countries) == len(ids):
        out = out & F.coalesce(c("country").isin(*countries), F.lit(True))
    reached = [s for s in ref.SALARY_STEPS if s <= (asked.get("salaryMin") or 0)]
    if reached:
        out = out & F.coalesce(F.coalesce(c("salaryMax"), c("salaryMin")) >= reached[-1], F.lit(True))
    return out


#: Days before this one are told apart in source_rank, with so many places of a scan each; their product fits a bigint.
_LAST_DAY, _PLACES = 32_000, 2**48


def source_order(asked: dict) -> list[Column]:
    """The order in which a search by date brings its postings: the newest day first, then as scanned."""
    return [F.col("scan_ordinal")] if asked.get("sortBy") == "relevant" else [F.desc_nulls_last(F.left("postedAt", F.lit(10))), F.col("scan_ordinal")]


def source_rank() -> Column:
    """A number that grows in the order by date of :func:`source_order`; postings without a date come last."""
    day = F.coalesce(F.unix_date(F.try_to_date(F.left("postedAt", F.lit(10)))), F.lit(0))
    return (F.lit(_LAST_DAY) - F.least(day, F.lit(_LAST_DAY))).cast("long") * _PLACES + F.col("scan_ordinal")


def filtered(items: DataFrame, f: PostingFilters, salary: bool = True) -> DataFrame:
    items = items.where(meaningful())
    if f.remove_agency:
        items = items.where(~by_agency())
    items = items.where(~excluded(f))
    return items.where(within_salary(f)) if salary else items


def truncated(items: DataFrame, length: int) -> DataFrame:
    """Descriptions of at most so many characters; Markdown and content hash follow, HTML does not. 0: as they are."""
    if length <= 0:
        return items
    long = F.length("description") > length
    short = F.substring("description", 1, length)
    hashed = H.content_hash(F.col("title"), F.col("company"), F.col("location"), F.col("postedAt"), short)
    return items.withColumns({
        "descriptionMarkdown": F.when(long, T.markdown(short)).otherwise(F.col("descriptionMarkdown")),
        "contentHash": F.when(long, hashed).otherwise(F.col("contentHash")),
        "description": F.when(long, short).otherwise(F.col("description")),
    })


def compact(items: DataFrame, *extra: str) -> DataFrame:
    return items.select(*extra, *(c for c in ref.COMPACT_FIELDS if c in items.columns))


def description_format(items: DataFrame, kind: str = "all") -> DataFrame:
    """Only the descriptions of one kind (text, html, markdown); anything else keeps all."""
    if kind not in DESCRIPTION_COLUMNS:
        return items
    return items.drop(*(c for k, names in DESCRIPTION_COLUMNS.items() if k != kind for c in names))


def _or_null(value: Column, kind) -> Column:
    """Null for an empty string, array or struct of nothing but such."""
    name = kind.typeName()
    if name == "string":
        return filled(value)
    if name == "array":
        return F.when(F.size(value) > 0, value)
    if name == "struct":
        parts = [_or_null(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        some = F.lit(False)
        for p in parts:
            some = some | p.isNotNull()
        return F.when(some, F.struct(*parts))
    return value


def without_empty(items: DataFrame) -> DataFrame:
    """Rows whose empty values are null, so that the JSON sink leaves them out; 0 and false stay."""
    return items.select(*(_or_null(F.col(f.name), f.dataType).alias(f.name) for f in items.schema.fields))


def shaped(items: DataFrame, compact_rows: bool = False, kind: str = "all", exclude_empty: bool = True) -> DataFrame:
    """The output form: columns first, then descriptions, then empty values."""
    items = compact(items) if compact_rows else items
    items = description_format(items, kind)
    return without_empty(items) if exclude_empty else items


def as_json(items: DataFrame) -> DataFrame:
    """One JSON text per row; nulls are left out."""
    return items.select(F.to_json(F.struct(*items.columns)).alias("json"))
