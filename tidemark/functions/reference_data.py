"""Names, codes and word lists that results depend on, in their natural order."""

from __future__ import annotations

EMAIL_NOISE_DOMAINS = (
    "sentry.io", "wixpress.com", "googletagmanager.com", "google-analytics.com", "googleapis.com",
    "cloudflare.com", "facebook.com", "twitter.com", "linkedin.com", "example.com", "test.com",
)
EMAIL_NOISE_TLDS = (
    "png", "jpg", "jpeg", "gif", "svg", "css", "js",
)
SKILL_TERMS = (
    "aws", "azure", "gcp", "kubernetes", "docker", "terraform", "ansible", "javascript", "typescript",
    "node.js", "nodejs", "react", "vue", "angular", "python", "django", "flask", "java", "spring", "kotlin",
    "scala", "c#", ".net", "go", "golang", "rust", "php", "laravel", "ruby", "rails", "sql", "postgresql",
    "mysql", "mongodb", "redis", "elasticsearch", "snowflake", "databricks", "spark", "airflow", "dbt",
    "machine learning", "ml", "ai", "nlp", "llm", "data science", "excel", "power bi", "tableau", "looker",
    "salesforce", "hubspot", "sap", "servicenow", "figma", "ux", "ui", "seo", "sem", "ga4", "agile", "scrum",
    "kanban", "product management", "project management",
)
SKILL_LABELS = {
    "aws": "AWS", "gcp": "GCP", "sql": "SQL", "c#": "C#", ".net": ".NET", "nodejs": "Node.js",
    "node.js": "Node.js", "typescript": "TypeScript", "javascript": "JavaScript", "postgresql": "PostgreSQL",
    "mysql": "MySQL", "golang": "Go", "ml": "Machine Learning", "ai": "AI", "nlp": "NLP", "llm": "LLM",
    "ux": "UX", "ui": "UI", "seo": "SEO", "sem": "SEM", "ga4": "GA4", "dbt": "dbt",
}
COUNTRY_NAMES = {
    "argentina": "AR", "argentine": "AR", "argentína": "AR", "algeria": "DZ", "algerie": "DZ", "algérie": "DZ",
    "australia": "AU", "austria": "AT", "autriche": "AT", "österreich": "AT", "bahrain": "BH", "belgium": "BE",
    "belgique": "BE", "bolivia": "BO", "brazil": "BR", "brasil": "BR", "brunei": "BN", "bulgaria": "BG",
    "cambodia": "KH", "canada": "CA", "chile": "CL", "colombia": "CO", "colombie": "CO", "costa rica": "CR",
    "croatia": "HR", "cyprus": "CY", "czech republic": "CZ", "czechia": "CZ", "denmark": "DK", "danmark": "DK",
    "danemark": "DK", "dominican republic": "DO", "ecuador": "EC", "egypt": "EG", "estonia": "EE",
    "finland": "FI", "france": "FR", "frankrig": "FR", "frankreich": "FR", "germany": "DE", "allemagne": "DE",
    "deutschland": "DE", "tyskland": "DE", "greece": "GR", "grèce": "GR", "grecia": "GR", "guatemala": "GT",
    "guyana": "GY", "hungary": "HU", "iceland": "IS", "india": "IN", "indonesia": "ID", "ireland": "IE",
    "irlande": "IE", "israel": "IL", "italy": "IT", "italia": "IT", "italie": "IT", "jamaica": "JM",
    "japan": "JP", "jordan": "JO", "kuwait": "KW", "laos": "LA", "latvia": "LV", "lebanon": "LB",
    "lithuania": "LT", "luxembourg": "LU", "malaysia": "MY", "malta": "MT", "mexico": "MX", "méxico": "MX",
    "morocco": "MA", "maroc": "MA", "myanmar": "MM", "netherlands": "NL", "nederland": "NL", "pays-bas": "NL",
    "new zealand": "NZ", "norway": "NO", "norge": "NO", "oman": "OM", "panama": "PA", "paraguay": "PY",
    "peru": "PE", "philippines": "PH", "poland": "PL", "pologne": "PL", "portugal": "PT", "puerto rico": "PR",
    "qatar": "QA", "romania": "RO", "saudi arabia": "SA", "singapore": "SG", "slovakia": "SK", "slovenia": "SI",
    "spain": "ES", "españa": "ES", "espagne": "ES", "sweden": "SE", "sverige": "SE", "suède": "SE",
    "switzerland": "CH", "schweiz": "CH", "suisse": "CH", "thailand": "TH", "tunisia": "TN", "uruguay": "UY",
    "united arab emirates": "AE", "united kingdom": "GB", "uk": "GB", "united states": "US",
    "united states of america": "US", "usa": "US", "venezuela": "VE", "vietnam": "VN",
}
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA",
    "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK",
    "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
)
CA_PROVINCES = (
    "AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT",
)
GEO_IDS = {
    "AT": "103883259", "BE": "100565514", "BG": "105333783", "CH": "106693272", "CY": "105642983",
    "CZ": "104508036", "DE": "101282230", "DK": "104514075", "EE": "102974008", "ES": "105646813",
    "FI": "100456013", "FR": "105015875", "GB": "101165590", "GR": "104677530", "HR": "104688944",
    "HU": "100288700", "IE": "104738515", "IS": "105238872", "IT": "103350119", "LT": "101464403",
    "LU": "104042105", "LV": "104341318", "MT": "106659145", "NL": "102890719", "NO": "103819153",
    "PL": "105072130", "PT": "100364837", "RO": "106670623", "RS": "101855366", "SE": "105117694",
    "SI": "106137034", "SK": "103119917", "UA": "102264497", "AR": "100446943", "BO": "104379274",
    "BR": "106057199", "CA": "101174742", "CL": "104621616", "CO": "100876405", "CR": "101739942",
    "DO": "105057336", "EC": "106373116", "GT": "100877388", "GY": "105836293", "JM": "105126983",
    "MX": "103323778", "PA": "100808673", "PE": "102927786", "PR": "105245958", "PY": "104065273",
    "US": "103644278", "UY": "100867946", "VE": "101490751", "AU": "101452733", "BN": "103809722",
    "HK": "103291313", "ID": "102478259", "IN": "102713980", "JP": "101355337", "KH": "102500897",
    "KR": "105149562", "LA": "100664862", "MM": "104136533", "MY": "106808692", "NZ": "105490917",
    "PH": "103121230", "SG": "102454443", "TH": "105146118", "TW": "104187078", "VN": "104195383",
    "AE": "104305776", "BH": "100425729", "IL": "101620260", "KW": "103239229", "OM": "100620810",
    "QA": "104170880", "SA": "100459316", "TR": "102105699", "DZ": "106395874", "EG": "106155005",
    "KE": "100710459", "MA": "102787409", "NG": "105365761", "TN": "102134353", "ZA": "104035573",
    "JO": "103710677", "LB": "101834488",
}
REGION_PRESETS = {
    "nordic": ("DK", "SE", "NO", "FI", "IS"),
    "dach": ("DE", "AT", "CH"),
    "benelux": ("BE", "NL", "LU"),
    "uk-ireland": ("GB", "IE"),
    "eu-27": ("AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE",
               "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE"),
    "gcc": ("AE", "SA", "QA", "KW", "BH", "OM"),
    "mena": ("AE", "SA", "QA", "KW", "BH", "OM", "EG", "MA", "JO", "LB", "TN", "DZ", "IL"),
    "asean": ("SG", "MY", "TH", "ID", "PH", "VN", "BN", "LA", "KH", "MM"),
    "anglosphere": ("US", "CA", "GB", "AU", "NZ", "IE"),
    "latam": ("MX", "BR", "AR", "CO", "CL", "PE", "VE", "BO", "PY", "UY",
               "EC", "GY", "CR", "PA", "GT", "DO", "PR", "JM"),
    "nordics-extended": ("DK", "SE", "NO", "FI", "IS", "EE", "LV", "LT"),
}
AGENCY_KEYWORDS = (
    "recruitment", "staffing", "agency", "recruiters", "headhunter", "talent acquisition", "rekrutterings",
    "bemanning", "rekruttering", "personalvermittlung",
)
URL_TRACKING_PARAMS = (
    "refId", "trk", "trackingId", "position", "pageNum", "utm_source", "utm_medium", "utm_campaign", "utm_term",
    "utm_content",
)
COMPACT_FIELDS = (
    "jobId", "sourceJobId", "title", "company", "companyUrl", "location", "country", "postedAt", "applyUrl",
    "applyType", "workplaceType", "salaryMin", "salaryMax", "salaryCurrency", "salaryPeriod", "seniorityLevel",
    "employmentType", "jobFunction", "industry", "jobUrl", "changeType", "firstSeenAt", "lastSeenAt",
    "isPromoted", "isRepost", "contentHash", "scrapedAt", "source",
)
TRACKING_DOMAINS = (
    "sentry.io", "sentry-next.wixpress.com", "wixpress.com", "googletagmanager.com", "google-analytics.com",
    "googleapis.com", "cloudflare.com", "doubleclick.net", "gstatic.com", "fontawesome.com", "jsdelivr.net",
    "unpkg.com", "cdnjs.cloudflare.com", "bootstrapcdn.com", "jquery.com", "apify.com",
)
CURRENCY_PREFIXES = {
    "USD": "$", "GBP": "£", "EUR": "€", "AUD": "A$", "CAD": "C$", "NZD": "NZ$", "CHF": "CHF ", "INR": "₹",
    "PLN": "zł", "BRL": "R$", "MXN": "MX$", "SGD": "S$", "ZAR": "R", "SEK": "kr ", "DKK": "kr ", "NOK": "kr ",
}
SALARY_STEPS = (40_000, 60_000, 80_000, 100_000, 120_000, 140_000, 160_000)
DATE_POSTED_SECONDS = {"lastHour": 3_600, "last24h": 86_400, "last7d": 604_800, "last30d": 2_592_000}
EXPERIENCE_LABELS = {
    "internship": "Internship", "entry": "Entry level", "associate": "Associate", "mid_senior": "Mid-Senior level",
    "director": "Director", "executive": "Executive",
}
JOB_TYPE_LABELS = {
    "fulltime": "Full-time", "parttime": "Part-time", "contract": "Contract", "temporary": "Temporary",
    "internship": "Internship", "volunteer": "Volunteer", "other": "Other",
}
#: The fields of each layer of the source that postings are made of, and those that are left out on purpose.
LAYERS = {
    "apiJob": ("jobId", "urn", "title", "company", "companyUrl", "location", "postedAtIso", "jobUrl", "trackingId",
               "isPromoted", "isEasyApplyOnCard", "postingBenefits"),
    "detail": ("description", "descriptionHtml", "seniorityLevel", "employmentType", "jobFunction", "industry",
               "applicantCount", "workplaceType", "postedRelative", "salary", "poster"),
    "companyInfo": ("name", "description", "slogan", "website", "employeeCount", "logo", "address"),
}
LAYERS_IGNORED = {"apiJob": (), "detail": (), "companyInfo": ()}
#: Labels and fields of the rows of an export.
CONNECTOR_COLUMNS = (
    ("Job id", "jobId"), ("Linkedin job id", "linkedinJobId"), ("Title", "title"), ("Company", "company"),
    ("Company url", "companyUrl"), ("Location", "location"), ("Country", "country"), ("Posted at", "postedAt"),
    ("Apply url", "applyUrl"), ("Apply type", "applyType"), ("Workplace type", "workplaceType"), ("Salary min", "salaryMin"),
)
