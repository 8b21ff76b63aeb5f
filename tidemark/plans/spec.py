"""The run spec: a dict of options made total, the searches it stands for, and the keys of its state.

All of it is small and lives on the driver; data never does.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from tidemark.functions import reference_data as ref

# Codes of the source's search parameters.
DATE_POSTED = {"lastHour": "r3600", "last24h": "r86400", "last7d": "r604800", "last30d": "r2592000"}
WORK_TYPE = {"onsite": "1", "remote": "2", "hybrid": "3"}
EXPERIENCE = {"internship": "1", "entry": "2", "associate": "3", "mid_senior": "4", "director": "5", "executive": "6"}
JOB_TYPE = {"fulltime": "F", "parttime": "P", "contract": "C", "temporary": "T", "internship": "I", "volunteer": "V", "other": "O"}
SALARY_STEPS = ref.SALARY_STEPS
QUERY_ALIASES = ("query", "keyword", "keywords", "searchQuery", "searchQueries", "queries", "searches", "search", "searchString")
START_URL_ALIASES = ("startUrls", "urls", "searchUrls", "links", "url")
LOCATION_ALIASES = ("location", "locations", "place", "city")
DEFAULT_LANGUAGE, DEFAULT_HOST, HOST_SUFFIX = "en-US,en;q=0.9", "www", "linkedin.com"
SEARCH_PATH = "/jobs-guest/jobs/api/seeMoreJobPostings/search"
LONGEST_KEY, READABLE = 256, 64
SECRET = re.compile(r"token|secret|password|api.?key|authorization|cookie|webhook|headers|session.?state|storage.?state|jwt", re.I)


def clean(value: Any) -> str | None:
    """A text without doubled white space; None if nothing is left."""
    return (" ".join(str(value).split()) or None) if value is not None else None


def clean_list(values: Any) -> list[str]:
    if not isinstance(values, (list, tuple)):
        return []
    return list(dict.fromkeys(v for v in map(clean, values) if v))


def numeric_list(values: Any) -> list[str]:
    return [v for v in clean_list(values) if re.fullmatch("[0-9]+", v)]


def first_alias(raw: dict, names: tuple[str, ...]) -> Any:
    """The value of the first name that is set; empty texts don't count, empty lists do."""
    return next((raw[n] for n in names if raw.get(n) is not None and raw[n] != ""), None)


def host_part(value: str | None) -> str:
    """The regional part of a host name."""
    host = re.sub(r"^https?://", "", (clean(value) or "").lower()).split("/")[0]
    if not host or host == HOST_SUFFIX:
        return DEFAULT_HOST
    return (host.removesuffix("." + HOST_SUFFIX) or DEFAULT_HOST) if host.endswith("." + HOST_SUFFIX) else host


@dataclass(frozen=True)
class RunSpec:
    """Every option of a run with its default."""

    keywords: str = ""
    location: str | None = None
    geoIds: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    regionPresets: str | None = None
    datePosted: str = "anytime"
    jobType: list[str] = field(default_factory=list)
    experienceLevel: list[str] = field(default_factory=list)
    workType: list[str] = field(default_factory=list)
    salaryMin: int | None = None
    salaryMax: int | None = None
    salaryIncludeUnknown: bool = True
    companies: list[str] = field(default_factory=list)
    excludeCompanies: list[str] = field(default_factory=list)
    excludeKeywords: list[str] = field(default_factory=list)
    easyApply: bool = False
    removeAgency: bool = False
    distance: float | None = None
    sortBy: str = "recent"
    startUrls: list[str] = field(default_factory=list)
    linkedinHost: str = DEFAULT_HOST
    outputLanguage: str = DEFAULT_LANGUAGE
    incrementalMode: bool = False
    stateKey: str | None = None
    allowNonIncrementalFallback: bool = False
    outputMode: str = "all"
    emitUnchanged: bool = False
    emitExpired: bool = False
    skipReposts: bool = False
    enrichDetails: bool = False
    scrapeCompany: bool = False
    discoverRelated: bool = False
    relatedSeedCount: int = 5
    notificationLimit: int = 5
    notifyOnlyChanges: bool = False
    compact: bool = False
    descriptionMaxLength: int = 0
    descriptionFormat: str = "all"
    excludeEmptyFields: bool = True
    phoneExtractionMode: str = "strict"
    maxResults: int = 100

    @staticmethod
    def from_dict(raw: dict) -> RunSpec:
        """Options as users give them: aliases, blanks and doubles are taken care of, unknown names ignored."""
        named = {f.name: raw[f.name] for f in fields(RunSpec) if raw.get(f.name) is not None}
        query = first_alias(raw, QUERY_ALIASES)
        if isinstance(query, (list, tuple)):
            query = next((q for q in query if isinstance(q, str) and q.strip()), None)
        urls = raw.get("startUrls") if isinstance(raw.get("startUrls"), list) else []
        urls = [u.get("url") if isinstance(u, dict) else None for u in urls]
        return replace(
            RunSpec(**named),
            keywords=(clean(query) if isinstance(query, str) else None) or "",
            location=clean(raw.get("location")),
            geoIds=numeric_list(raw.get("geoIds")),
            regions=list(dict.fromkeys(v.upper() for v in clean_list(raw.get("regions")))),
            companies=numeric_list(raw.get("companies")),
            excludeCompanies=clean_list(raw.get("excludeCompanies")),
            excludeKeywords=clean_list(raw.get("excludeKeywords")),
            startUrls=clean_list(urls),
            linkedinHost=host_part(raw.get("linkedinHost")),
            outputLanguage=clean(raw.get("outputLanguage")) or DEFAULT_LANGUAGE,
            relatedSeedCount=max(0, named.get("relatedSeedCount", 5)),
            descriptionFormat=raw.get("descriptionFormat") if raw.get("descriptionFormat") in ("text", "html", "markdown") else "all",
        )

    def has_target(self) -> bool:
        """Whether there is anything to search; a run without is a success of no rows."""
        return bool(self.keywords.strip() or self.geoIds or self.regions or self.regionPresets or self.location or self.startUrls)


def asked_of(spec: RunSpec) -> dict:
    """What a run asks of the source as one search, all its regions among the geo ids."""
    ids, _ = resolve_regions(spec.regions, spec.regionPresets)
    return asdict(spec) | {"geoIds": list(dict.fromkeys([*spec.geoIds, *ids]))}


def resolve_regions(regions: list[str], preset: str | None) -> tuple[list[str], list[str]]:
    """(geo ids, codes without one): the preset's codes first, then the regions, each once."""
    codes = dict.fromkeys([*ref.REGION_PRESETS.get(preset or "", ()), *(r.strip().upper() for r in regions if r.strip())])
    ids = dict.fromkeys(ref.GEO_IDS[c] for c in codes if c in ref.GEO_IDS)
    return list(ids), [c for c in codes if c not in ref.GEO_IDS]


def country_hint_of(geo_id: str | None, location: str | None) -> str | None:
    """ISO code of a search by its geo id, else by its place: names first, then states and provinces."""
    found = {v: k for k, v in ref.GEO_IDS.items()}.get(geo_id or "")
    tail = next((p for p in reversed([x.strip() for x in (location or "").split(",")]) if p), "")
    if found or not tail:
        return found
    code = tail.upper()
    return ref.COUNTRY_NAMES.get(tail.lower()) or ("US" if code in ref.US_STATES else "CA" if code in ref.CA_PROVINCES else None)


def salary_step(amount: float | None) -> int | None:
    """The number of the highest step that an amount reaches, None below the first."""
    return sum((amount or 0) >= s for s in SALARY_STEPS) or None


def search_url(params: dict, start: int) -> str:
    """The address of a result page."""
    codes = lambda name, table: ",".join(table[v] for v in params.get(name) or () if v in table)
    step = salary_step(params.get("salaryMin"))
    distance = params.get("distance")
    pairs = [
        ("keywords", params.get("keywords")), ("location", params.get("location")), ("geoId", params.get("geoId")),
        ("distance", None if distance is None else f"{distance:g}"), ("start", str(start)),
        ("sortBy", "R" if params.get("sortBy") == "relevant" else "DD"),
        ("f_TPR", DATE_POSTED.get(params.get("datePosted") or "")), ("f_WT", codes("workType", WORK_TYPE)),
        ("f_E", codes("experienceLevel", EXPERIENCE)), ("f_JT", codes("jobType", JOB_TYPE)),
        ("f_C", ",".join(params.get("companies") or ())), ("f_SB2", step and str(step)),
        ("f_AL", "true" if params.get("easyApply") else None),
    ]
    host = params.get("linkedinHost") or DEFAULT_HOST
    return f"https://{host}.{HOST_SUFFIX}{SEARCH_PATH}?" + urlencode([(k, v) for k, v in pairs if v])


def _named(raw: str | None, table: dict[str, str]) -> list[str] | None:
    back = {v: k for k, v in table.items()}
    return list(dict.fromkeys(back[p.strip()] for p in (raw or "").split(",") if p.strip() in back)) or None


def parse_search_url(raw: str, spec: RunSpec) -> dict:
    """The search that a pasted address stands for; what it does not say comes from the spec."""
    url = urlsplit(raw)
    host = (url.hostname or "").lower()
    if not re.search(r"(^|\.)" + re.escape(HOST_SUFFIX) + "$", host):
        raise ValueError("start URLs must be search addresses of the source")
    if not re.search(r"/jobs/search|" + re.escape(SEARCH_PATH), url.path, re.I):
        raise ValueError("only search addresses are supported as start URLs")
    p: dict[str, str] = {}
    for k, v in parse_qsl(url.query, keep_blank_values=True):
        p.setdefault(k, v)
    distance = re.fullmatch(r"-?[0-9]+(?:\.[0-9]+)?", p.get("distance", "").strip())
    step = p.get("f_SB2")
    salary = (SALARY_STEPS[int(step) - 1] if step in set("1234567") else None) if step is not None else spec.salaryMin
    posted = {v: k for k, v in DATE_POSTED.items()}
    return {
        "keywords": clean(p.get("keywords")) or spec.keywords or None, "location": clean(p.get("location")) or spec.location,
        "geoId": next(iter(numeric_list([p.get("geoId")])), None), "distance": float(distance[0]) if distance else spec.distance,
        "datePosted": posted.get(p.get("f_TPR", ""), spec.datePosted),
        "workType": _named(p.get("f_WT"), WORK_TYPE) or spec.workType or None,
        "experienceLevel": _named(p.get("f_E"), EXPERIENCE) or spec.experienceLevel or None,
        "jobType": _named(p.get("f_JT"), JOB_TYPE) or spec.jobType or None,
        "companies": numeric_list(p.get("f_C", "").split(",")) or spec.companies or None, "salaryMin": salary,
        "easyApply": p.get("f_AL") == "true" or spec.easyApply or None,
        "sortBy": "relevant" if p.get("sortBy") == "R" else spec.sortBy, "linkedinHost": host_part(host),
        "outputLanguage": spec.outputLanguage,
    }


def searches(spec: RunSpec) -> list[tuple[dict, str | None]]:
    """(search, country hint) pairs: one for each start URL, else for each geo id, else one by place."""
    if spec.startUrls:
        found = [parse_search_url(u, spec) for u in spec.startUrls]
    else:
        base = {n: getattr(spec, n) or None for n in ("distance", "datePosted", "workType", "experienceLevel", "jobType",
                "companies", "salaryMin", "easyApply", "sortBy", "linkedinHost", "outputLanguage", "keywords")}
        more, _ = resolve_regions(spec.regions, spec.regionPresets)
        ids = list(dict.fromkeys([*spec.geoIds, *more]))
        found = [base | {"geoId": i} for i in ids] or [base | {"location": spec.location}]
    return [(s, country_hint_of(s.get("geoId"), s.get("location"))) for s in found]


def canonical_url(raw: str) -> str:
    """A URL with its host in lower case and parameters sorted, without tracking parameters and fragment."""
    url = urlsplit(raw)
    if not url.scheme or not url.netloc:
        return raw
    kept = sorted(((k, v) for k, v in parse_qsl(url.query, keep_blank_values=True) if k not in ref.URL_TRACKING_PARAMS),
                  key=lambda p: (p[0].casefold(), p[0].swapcase()))
    return urlunsplit((url.scheme, url.netloc.lower(), url.path or "/", urlencode(kept), ""))


def _dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _normal(value: Any) -> Any:
    """Without unset parts; keys sorted, lists sorted (numbers by value, else as texts)."""
    if isinstance(value, dict):
        out = {k: _normal(value[k]) for k in sorted(value)}
        return {k: v for k, v in out.items() if v is not None} or None
    if isinstance(value, (list, tuple)):
        rest = [v for v in value if v is not None and v != ""]
        numbers = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in rest)
        return (sorted(rest) if numbers else sorted(map(str, rest))) or None
    return None if value == "" else value


def filter_fingerprint(dimensions: dict) -> str:
    """Eight hex digits for the set dimensions, in whatever order; nofilter for none."""
    normal = _normal(dimensions)
    return hashlib.sha256(_dump(normal).encode()).hexdigest()[:8] if normal else "nofilter"


def state_key(keyword: str | None, location: str | None, dimensions: dict | None = None, prefix: str = "incremental") -> str:
    """A readable key: what sanitises to the same words is told apart by the fingerprint."""
    def part(text: str | None) -> str:
        plain = re.sub("[^a-z0-9]+", "_", (text or "").lower().strip()).strip("_")
        return plain[:READABLE].rstrip("_")

    print_ = filter_fingerprint({**(dimensions or {}), "__keyword": keyword, "__location": location})
    return "_".join([prefix, *(p for p in (part(keyword), part(location)) if p), print_])


def _ordered(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _ordered(value[k]) for k in sorted(value, key=lambda k: (k.casefold(), k.swapcase()))}
    return [_ordered(v) for v in value] if isinstance(value, (list, tuple)) else value


def query_fingerprint(values: dict, names: list[str]) -> str:
    """sha256 of the named values; lists keep their order, so reordering starts a new state."""
    return hashlib.sha256(_dump([[n, _ordered(values.get(n))] for n in names]).encode()).hexdigest()


def storage_name(prefix: str, key: str) -> str:
    """A name for a key that is safe as a path; a long or odd one becomes a hash."""
    name = f"{prefix}_{key}"
    if len(name) <= LONGEST_KEY and re.fullmatch(r"[a-zA-Z0-9!\-_.'()]+", name):
        return name
    return f"{prefix}_h{hashlib.sha256(key.encode()).hexdigest()[:40]}"


def redacted(value: Any, depth: int = 0) -> Any:
    """A spec for logs: values of secret names are hidden, deep nesting is cut."""
    if depth > 6:
        return "[deep]"
    if isinstance(value, dict):
        return {k: "[redacted]" if SECRET.search(str(k)) and v else redacted(v, depth + 1) for k, v in value.items()}
    return [redacted(v, depth + 1) for v in value] if isinstance(value, (list, tuple)) else value
