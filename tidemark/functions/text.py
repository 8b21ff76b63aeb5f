"""Extraction from free text: functions from Column to Column, all of built-in expressions."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import reference_data as ref
from tidemark.functions.dates import date_of, iso_date  # noqa: F401
from tidemark.functions.patterns import BU, S, SPACES, WS, B, all_matches, captured, empty_strings, filled, let, literals, squeezed, trimmed, until_space
from tidemark.functions.urls import ascii_host, normal_url

# The patterns that define what is extracted.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\.[a-zA-Z]{2,})+"
LINK = "(?i)https?://" + until_space("<>\"'()")
URL = "(?i)https?://" + until_space(r"""<>"'`)\]""")
SOCIAL_ANYWHERE = (
    r"(?i)(?:linkedin\.com|twitter\.com|x\.com|facebook\.com|instagram\.com|youtube\.com|tiktok\.com|github\.com|xing\.com)"
)
SOCIAL_HOSTS = {
    "linkedin": r"(?:^|\.)linkedin\.com\z",
    "twitter": r"(?:^|\.)(?:twitter\.com|x\.com)\z",
    "instagram": r"(?:^|\.)instagram\.com\z",
    "facebook": r"(?:^|\.)(?:facebook\.com|fb\.com)\z",
    "youtube": r"(?:^|\.)(?:youtube\.com|youtu\.be)\z",
    "tiktok": r"(?:^|\.)tiktok\.com\z",
    "github": r"(?:^|\.)github\.com\z",
    "xing": r"(?:^|\.)xing\.com\z",
    "bluesky": r"(?:^|\.)bsky\.(?:app|social)\z",
    "threads": r"(?:^|\.)threads\.(?:net|com)\z",
    "mastodon": r"^(?:mastodon\.(?:social|online|world)|hachyderm\.io|fosstodon\.org|mas\.to|infosec\.exchange"
    r"|mstdn\.social|mastodon\.[a-z]{2,})\z",
}
#: Platforms that postings carry; the others are only classified.
SOCIAL_KEPT = ("linkedin", "twitter", "instagram", "facebook", "youtube", "tiktok", "github", "xing")
OWN_HOSTS = ("www.linkedin.com", "linkedin.com")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))

_BODY = rf"((?:\+|00)?[(]?[0-9][0-9{WS}.\-/()]{{6,20}}[0-9])"
_SEP = rf"[{WS}.\-/]"
PHONE_INTERNATIONAL = rf"\+[0-9]{{1,3}}{_SEP}?[0-9]{{1,4}}{_SEP}?[0-9]{{2,4}}{_SEP}?[0-9]{{2,5}}(?:{_SEP}?[0-9]{{1,5}})?"
PHONE_SCHEME = rf"(?i)(?=[tw])(?:tel:|wa\.me/|whatsapp://send\?phone=)([+0-9][0-9{WS}.\-/()]{{6,20}}[0-9])"
#: What stands before a number, by language; in all but the third a look at the first letter spares the rest.
PHONE_PREFIXES = (
    rf"(?iu:{BU}(?:Tel(?:ephone)?|Tel[ée]fon[oe]?|T[ée]l[ée]phone|Telefon|Telp|Tlp|Tlf|Mob(?:il(?:e)?)?|Cell(?:ular)?"
    rf"|Phone|Fon[e]?|Hotline|Direct|Office|Kontak[t]?|Contat[o]?|Contact|Cel(?:ular)?|R[üu]ckfragen|WhatsApp|GSM|Cep"
    rf"|İrtibat|Irtibat|Hubungi|Fale conosco){B}\.?{S}*:?{S}*)",
    rf"(?i:{BU}(?:call|contact|reach|dial|enquir(?:y|ies)|inquir(?:y|ies))(?:{S}+(?:us|on|at|out|me|to))?"
    rf"{S}*(?:at|on)?[{WS}:,.\-]+)",
    rf"(?<![^{WS}>(\[])(?:HP|WA|M|T){S}*[:：=]{S}*",
    rf"(?:טלפון|טל\.?|נייד|לפרטים|ליצירת קשר){S}*:?{S}*",
    rf"(?:联系电话|電話|电话|手机|手機|微信|咨询电话|諮詢電話|联系方式|聯繫方式){S}*[:：]?{S}*",
    rf"(?:هاتف|جوال|الجوال|التواصل|للتواصل|اتصل|للاستفسار|رقم الاتصال){S}*:?{S}*",
    rf"(?:تماس|تلفن|موبایل|همراه|شماره تماس|اطلاعات تماس){S}*:?{S}*",
    rf"(?iu:(?:Тел(?:ефон)?|Моб(?:ильный)?|Контакт|Связь|Звонить|Звоните)\.?{S}*:?{S}*)",
    rf"(?:전화|연락처|휴대폰|핸드폰|연락|문의){S}*[:：]?{S}*",
    rf"(?:電話|連絡先|携帯|お問い合わせ|お問合せ|問合せ){S}*[:：]?{S}*",
    rf"(?:फ़?ोन|मोबाइल|संपर्क|कॉल|कांटैक्ट){S}*:?{S}*",
    rf"(?:Đ[Tt]|SĐ[Tt]|Điện thoại|Liên hệ|Liên lạc|Số điện thoại)\.?{S}*[:：]?{S}*",
)
_INITIALS = "TMCPFHDOKRWGIEtmcpfhdokrwgieİıKטנל联電电手微咨諮聯هجاتلرمشТМКСЗтмксз전연휴핸문連携お問फमसकĐSL"
#: All prefixes in one pass.  Numbers have no letters, so a match can only overlap another one with the same number.
PHONE_PREFIXED = f"(?=[{_INITIALS}])(?:" + "|".join(PHONE_PREFIXES) + ")" + _BODY
#: No number has fewer digits in a row, with nothing but separators between them.
PHONE_DIGITS = rf"(?:[0-9][{WS}.\-/()]*+){{7}}"
PHONE_LOCAL = rf"0(?<![A-Za-z0-9_]0)[1-9][0-9][0-9{WS}.\-/]{{5,12}}[0-9](?![A-Za-z0-9_])"
PHONE_NOISE = (
    r"(?i)(?=[ABCDEFGHILMNPRS])(?<![A-Za-z0-9_])(?:ATU|DE|FR|IT|NL|BE|GB|PL|CZ|SK|HU|SE|DK|NO|FI|ES|PT|IE|LU|RO|BG|HR|SI|EE"
    r"|LT|LV|MT|CY|GR)[0-9]{8,12}(?![A-Za-z0-9_])",
    r"[0-9](?<![A-Za-z0-9_][0-9])[0-9]{3}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9_])",
    r"[0-9](?<![A-Za-z0-9_][0-9])[0-9]?\.[0-9]{1,2}\.[0-9]{2,4}(?![A-Za-z0-9_])",
)

_NUMBER, _SUFFIX = r"[0-9,]+(?:\.[0-9]{1,2})?", rf"{S}?([KkMm])?"
_PERIOD = (
    rf"(?:{S}*(?:/|per{S}+|a{S}+|an{S}+)?{S}*(yr|year|hr|hour|mo|month|wk|week|day|annum|annually|hourly))?"
)
SALARY_ONE = rf"(?i)([$£€]){S}?({_NUMBER}){_SUFFIX}{_PERIOD}"
SALARY_RANGE = rf"{SALARY_ONE}{S}*(?:-|–|—|to){S}*[$£€]?{S}?({_NUMBER}){_SUFFIX}{_PERIOD}"
CURRENCY_OF = (("$", "USD"), ("£", "GBP"), ("€", "EUR"))
PERIOD_TOKENS = (("hr|hour", "HOUR"), ("mo|month", "MONTH"), ("wk|week", "WEEK"), ("day|daily", "DAY"),
                 ("yr|year|annum|annual", "YEAR"))

SUMMARY_LENGTH = 280


def decode_entities(text: Column) -> Column:
    """Six entities; the ampersand first, so that doubly escaped text is decoded twice."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def without_query(url: Column) -> Column:
    """The URL up to its first question mark, decoded; null for an empty one."""
    return let(url, lambda u: F.when(u != "", decode_entities(F.substring_index(u, "?", 1))))


def strip_tags(html: Column) -> Column:
    """Readable text: tags become spaces, lines stay, at most one empty line in a row."""
    text = decode_entities(F.regexp_replace(html, r"<[^>]+>", " "))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def _under(host: Column, domains: tuple[str, ...]) -> Column:
    return F.regexp_like(host, F.lit(r"(?:^|\.)(?:" + "|".join(map(re.escape, domains)) + r")\z"))


def emails(text: Column) -> Column:
    """Distinct lower-case addresses in order, without assets and noise domains."""
    found = F.transform(all_matches(text, EMAIL), F.lower)

    def wanted(email: Column) -> Column:
        domain = F.element_at(F.split(email, "@"), 2)
        noise = F.array_contains(literals(*ref.EMAIL_NOISE_TLDS), F.substring_index(domain, ".", -1))
        return ~noise & ~_under(domain, ref.EMAIL_NOISE_DOMAINS)

    return F.array_distinct(F.filter(found, wanted))


def mailto(url: Column) -> Column:
    """The first mailto address of a link."""
    return F.lower(captured(url, rf"(?i)mailto:({EMAIL})"))


def social_links(text: Column) -> Column:
    """Distinct links that name a social host anywhere, without trailing punctuation."""
    found = F.filter(all_matches(text, LINK), lambda u: F.regexp_like(u, F.lit(SOCIAL_ANYWHERE)))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[).,;]+\z", "")))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _urls_in_order(text: Column, exclude: tuple[str, ...]) -> Column:
    found = F.transform(all_matches(text, URL), lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+\z", ""))
    pairs = F.transform(found, lambda u: F.struct(ascii_host(url_host(u)).alias("host"), normal_url(u).alias("url")))

    def wanted(p: Column) -> Column:
        own = F.array_contains(literals(*(h.lower() for h in exclude)), p["host"]) if exclude else F.lit(False)
        return (p["host"] != "") & ~_under(p["host"], ref.TRACKING_DOMAINS) & ~own

    def firsts(good: Column) -> Column:
        keys = F.transform(good, lambda p: F.lower(p["url"]))
        return let(keys, lambda k: F.filter(good, lambda p, i: F.array_position(k, F.lower(p["url"])) == i + 1))

    return let(F.filter(pairs, wanted), firsts)


def urls(text: Column, exclude: tuple[str, ...] = ()) -> Column:
    """Distinct URLs, sorted; tracking domains and excluded hosts are left out."""
    return F.array_sort(F.transform(_urls_in_order(text, exclude), lambda p: p["url"]))


def social_profiles(text: Column, exclude: tuple[str, ...] = (), platforms: tuple[str, ...] = tuple(SOCIAL_HOSTS)) -> Column:
    """A struct with the first URL of each platform as an array of one, or an empty array."""
    def first(found: Column, platform: str) -> Column:
        own = F.filter(found, lambda p: F.regexp_like(p["host"], F.lit("(?i)" + SOCIAL_HOSTS[platform])))
        return F.transform(F.slice(own, 1, 1), lambda p: p["url"]).alias(platform)

    return let(_urls_in_order(text, exclude), lambda found: F.struct(*(first(found, p) for p in platforms)))


def merged_profiles(a: Column, b: Column) -> Column:
    return F.struct(*(F.array_distinct(F.concat(a[p], b[p])).alias(p) for p in SOCIAL_KEPT))


def no_profiles() -> Column:
    return F.struct(*(empty_strings().alias(p) for p in SOCIAL_KEPT))


def _plausible(phone: Column) -> Column:
    digits = F.length(F.regexp_replace(phone, "[^0-9]", ""))
    return digits.between(7, 15) & ~F.regexp_like(phone, F.lit(r"^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\z"))


def phones(text: Column, mode: str = "strict") -> Column:
    """Distinct numbers, sorted: international ones, links, and after a word for telephone in many languages.

    ``lenient`` also takes bare local numbers.
    """
    def matches(t: Column) -> Column:
        found = [all_matches(t, PHONE_INTERNATIONAL), all_matches(t, PHONE_SCHEME, 1), all_matches(t, PHONE_PREFIXED, 1)]
        return F.concat(*found, *([all_matches(t, PHONE_LOCAL)] if mode == "lenient" else []))

    plain = text
    for noise in PHONE_NOISE:
        plain = F.regexp_replace(plain, noise, " ")
    tidy = F.transform(let(plain, matches), lambda p: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(p, SPACES, " "), r"^ | \z", ""), r"\.+\z", ""))
    found = F.array_sort(F.array_distinct(F.filter(tidy, _plausible)))
    return F.when(F.regexp_like(text, F.lit(PHONE_DIGITS)), found).otherwise(empty_strings())


def skill_label(term: str) -> str:
    return ref.SKILL_LABELS.get(term) or re.sub(r"\b\w", lambda m: m.group().upper(), term, flags=re.ASCII)


#: Terms in the order of their labels in a dictionary: case decides last, small letters first.
_SKILLS = sorted(((skill_label(t), t) for t in ref.SKILL_TERMS), key=lambda p: (p[0].casefold(), p[0].swapcase()))
_LABELS = tuple(dict.fromkeys(label for label, _ in _SKILLS))
#: Terms by their first character, so that a word is compared with those of its own only; no term is another one followed by a dot.
_SKILL_PATTERN = " (" + "|".join(
    re.escape(first) + "(?:" + "|".join(re.escape(t[1:]) for t in ref.SKILL_TERMS if t[0] == first) + ")" for first in dict.fromkeys(t[0] for t in ref.SKILL_TERMS)
) + ")(?=[ .])"
#: All but what terms consist of; letters and digits are written out, which Java looks up in one set.
_NO_SKILL = f"[^{string.ascii_letters}{string.digits}+#.]+"


def skills(text: Column) -> Column:
    """Labels of the known skills that stand in the text as whole words, in dictionary order."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _NO_SKILL, " "), F.lit(" "))
    # One pass over the text; the space before a term is part of its match, the one behind it is not.
    label = lambda t: _lookup(dict((term, label) for label, term in _SKILLS), t)
    return _in_dictionary_order(F.transform(all_matches(plain, _SKILL_PATTERN, 1), label))


def merged_skills(a: Column, b: Column) -> Column:
    """The labels of both, in dictionary order."""
    return F.coalesce(_in_dictionary_order(F.concat(a, b)), empty_strings())


def _in_dictionary_order(labels: Column) -> Column:
    """The known ones of some labels; these are computed once, where a filter of the known ones would compute them for each."""
    return F.array_intersect(literals(*_LABELS), labels)


def _amount(number: Column, suffix: Column) -> Column:
    factor = F.when(F.lower(suffix) == "k", 1e3).when(F.lower(suffix) == "m", 1e6).otherwise(1.0)
    value = F.regexp_replace(number, ",", "").try_cast("double")
    return F.floor(value * factor + 0.5).cast("long")


def _period(token: Column, amount: Column) -> Column:
    out = F.when(amount >= 1000, "YEAR").otherwise("HOUR")
    for words, name in reversed(PERIOD_TOKENS):
        out = F.when(F.regexp_like(F.lower(token), F.lit(words)), name).otherwise(out)
    return out


def _currency(symbol: Column) -> Column:
    out = F.lit("USD")
    for sign, code in CURRENCY_OF:
        out = F.when(symbol == sign, code).otherwise(out)
    return out


def salary(text: Column) -> Column:
    """struct(min, max, currency, period) of the first range of pay, else of the first amount; null if none."""
    def groups(found: Column, pattern: str, n: int, body: Callable[..., Column]) -> Column:
        # All groups in one search; none of them has a bar.
        parts = F.split(F.regexp_replace(found, pattern, "|".join(f"${i + 1}" for i in range(n))), r"\|")
        return let(parts, lambda g: body(*(g[i] for i in range(n))))

    def of_range(sign, low, low_suffix, period, high, high_suffix, other_period) -> Column:
        amounts = F.array(_amount(low, low_suffix), _amount(high, high_suffix))
        token = F.when(period != "", period).otherwise(other_period)
        return let(amounts, lambda a: let(F.greatest(a[0], a[1]), lambda most: F.struct(
            F.least(a[0], a[1]).alias("min"), most.alias("max"), _currency(sign).alias("currency"), _period(token, most).alias("period"))))

    def of_one(sign, number, suffix, period) -> Column:
        def single(value: Column) -> Column:
            out = F.struct(value.alias("min"), F.lit(None).cast("long").alias("max"), _currency(sign).alias("currency"), _period(period, value).alias("period"))
            return F.when((period != "") | (value >= 1000), out)

        return let(_amount(number, suffix), single)

    # The text is searched once for a range, and once more for an amount if there is none; groups come from the match.
    first = lambda pattern: F.regexp_extract(text, pattern, 0)
    pay = let(first(SALARY_RANGE), lambda r: F.when(r != "", groups(r, SALARY_RANGE, 7, of_range)).otherwise(
        let(first(SALARY_ONE), lambda o: F.when(o != "", groups(o, SALARY_ONE, 4, of_one)))))
    return F.when(F.regexp_like(text, F.lit("[$£€]")), pay)


def workplace_type(text: Column) -> Column:
    """hybrid, remote or onsite by the words of a text; hybrid beats remote, a negated remote is none."""
    def of(low: Column) -> Column:
        # Word boundaries are slow to search for; a plain search for a part of all matches comes first.
        has = lambda part, p: F.contains(low, F.lit(part)) & F.regexp_like(low, F.lit(p))
        negated = has("remote", rf"{B}(?:no|not|non|never|isn['’]?t|aren['’]?t|without){B}[{WS}A-Za-z0-9_]{{0,12}}{B}remote{B}")
        office = has("site", rf"{B}on[-{WS}]?site{B}") | has("office", rf"{B}in[-{WS}]office{B}") | has("office", rf"{B}work from (?:the )?office{B}")
        return (
            F.when(has("hybrid", rf"{B}hybrid{B}"), "hybrid")
            .when(has("remote", rf"{B}remote{B}") & ~negated, "remote")
            .when(office, "onsite")
        )

    return let(F.lower(text), of)


def first_sentence(text: Column) -> Column:
    first = F.regexp_replace(squeezed(text), r"(?s) (?<=[.!?] ).*+", "")
    return F.regexp_replace(first, rf"^[-•·–]{S}*", "")


def summary(title: Column, company: Column, location: Column, description: Column) -> Column:
    """title · company · location — first sentence; null if all are missing."""
    bits = filled(F.concat_ws(" · ", filled(title), filled(company), filled(location)))
    text = F.concat_ws(" — ", bits, let(first_sentence(description), filled))
    return F.substring(let(text, filled), 1, SUMMARY_LENGTH)


def markdown(text: Column) -> Column:
    """Lines as Markdown: headings from capitals or a final colon, bullets as dashes; null if empty."""

    def line(t: Column) -> Column:
        heading = F.concat(F.lit("## "), trimmed(F.regexp_replace(t, r":\z", "")))
        capitals = F.length(t).between(3, 60) & F.regexp_like(t, F.lit(rf"^[A-Z][A-Z{WS}0-9&/()\-',.]{{2,}}:?{S}*\z"))
        colon = F.regexp_like(t, F.lit(rf"^[A-Z][^.!?\n]{{2,48}}:{S}*\z"))
        dot, star = rf"^[•·–]{S}*(.+)\z", rf"^\*{S}+(.+)\z"
        return (
            F.when(t == "", "")
            .when(capitals | colon, heading)
            .when(F.regexp_like(t, F.lit(dot)), F.concat(F.lit("- "), F.regexp_extract(t, dot, 1)))
            .when(F.regexp_like(t, F.lit(star)), F.concat(F.lit("- "), F.regexp_extract(t, star, 1)))
            .otherwise(t)
        )

    joined = F.array_join(F.transform(F.transform(F.split(text, "\n"), trimmed), line), "\n")
    return let(trimmed(F.regexp_replace(joined, r"\n{3,}", "\n\n")), filled)


def _tail(location: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body of the last part that is not empty and whether there are others, of a place given as parts between commas."""
    core = F.regexp_replace(location, rf"^[{WS},]+|(?![!-+])(?![.-~])(?<![{WS},])[{WS},]+\z", "")
    parts = let(core, lambda c: F.struct(trimmed(F.substring_index(c, ",", -1)).alias("last"), F.contains(c, F.lit(",")).alias("others")))
    return let(parts, lambda p: body(filled(p["last"]), p["others"]))


def _lookup(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.try_element_at(table, key)


_STATES = tuple(dict.fromkeys(ref.US_STATES + ref.CA_PROVINCES))


def country(location: Column, hint: Column) -> Column:
    """ISO code of a posting's place; a hint wins, and a lone state code after other parts says nothing."""
    def of(tail: Column, others: Column) -> Column:
        up = F.upper(tail)
        code = F.regexp_like(tail, F.lit(r"(?i)^[A-Z]{2}\z"))
        vague = others & F.array_contains(literals(*_STATES), up)
        return (
            F.when(code & vague, F.lit(None).cast("string"))
            .when(code, up)
            .otherwise(_lookup(ref.COUNTRY_NAMES, F.lower(tail)))
        )

    return F.when(filled(hint).isNotNull(), F.upper(hint)).otherwise(_tail(location, of))


def country_hint(location: Column) -> Column:
    """ISO code of a search's place: country names first, then states and provinces."""
    def of(tail: Column, _: Column) -> Column:
        up = F.upper(tail)
        return F.coalesce(
            _lookup(ref.COUNTRY_NAMES, F.lower(tail)),
            F.when(F.array_contains(literals(*ref.US_STATES), up), "US"),
            F.when(F.array_contains(literals(*ref.CA_PROVINCES), up), "CA"),
        )

    return _tail(location, of)


def company_segment(url: Column) -> Column:
    """The part after /company/, decoded; a plus stays a plus."""
    segment = captured(url, r"(?i)/company/([^/?#]+)")
    return F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B")))


def company_page(url: Column) -> Column:
    """The canonical address of a company's page."""
    slug = filled(F.lower(company_segment(url)))
    return F.concat(F.lit("https://www.linkedin.com/company/"), slug, F.lit("/"))


def company_slug(url: Column) -> Column:
    """The part after /company/ as it stands, for lookups."""
    return captured(url, r"/company/([^/?#]+)")


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([_*\[\]`])", r"\\$1")


def escape_slack(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def money(amount: Column, currency: Column) -> Column:
    """An amount with the sign of its currency and grouped digits; a dash where there is none."""
    prefix = F.when(filled(currency).isNull(), "$").otherwise(
        F.coalesce(_lookup(ref.CURRENCY_PREFIXES, currency), F.concat(currency, F.lit(" ")))
    )
    return F.when(amount.isNull(), "—").otherwise(F.concat(prefix, F.format_number(amount.cast("double"), 0)))


def salary_range(low: Column, high: Column, currency: Column) -> Column:
    both = low.isNotNull() & high.isNotNull() & (low != high)
    one = F.coalesce(high, low)
    return F.when(both, F.concat(money(low, currency), F.lit("–"), money(high, currency))).when(
        one.isNotNull(), money(one, currency)
    )


def error_class(message: Column) -> Column:
    """rate_limit, server_error, timeout, network or other, by the text of an error."""
    low = F.lower(message)
    has = lambda p: F.regexp_like(low, F.lit(p))
    return (
        F.when(has(rf"{B}429{B}|too many requests|rate.?limit"), "rate_limit")
        .when(has(rf"{B}5[0-9]{{2}}{B}") & has(rf"{B}(?:http|api|server|status){B}"), "server_error")
        .when(has(rf"{B}timeout{B}|etimedout|abort"), "timeout")
        .when(has("econnreset|econnrefused|enotfound|fetch failed|network|socket"), "network")
        .otherwise("other")
    )


#: Code numbers of a run's failure, in the order they are tried.
RUN_ERRORS = (
    (r"(?i)monthly usage hard limit exceeded|platform-feature-disabled", "platform_usage"),
    (rf"(?i){B}(?:429|rate.?limit|too many requests){B}", "rate_limit"),
    (rf"(?i){B}(?:403|401|unauthori[sz]ed|forbidden|blocked|waf|cloudflare|akamai|challenge|captcha){B}", "auth_block"),
    (rf"(?i)(?=.*{B}(?:http|api|status|returned|failed){B}).*{B}5[0-9]{{2}}{B}", "http_5xx"),
    (rf"(?i)(?=.*{B}(?:http|api|status|returned|failed){B}).*{B}[1-5][0-9]{{2}}{B}", "http_other"),
    (rf"(?i){B}(?:unexpected|invalid|parse|json|shape|missing|endpoint may have changed|structure){B}", "parse_error"),
    (rf"(?i){B}(?:timeout|timed out|econnreset|econnrefused|enotfound|network|socket|fetch failed|abort){B}",
     "network_timeout"),
    (rf"(?i){B}(?:lock lost|state lock lost){B}", "lock_lost"),
)


def run_error(message: Column) -> Column:
    """The kind of a run's failure by its text; unknown where nothing fits."""
    out = F.lit("unknown")
    for pattern, name in reversed(RUN_ERRORS):
        out = F.when(F.regexp_like(message, F.lit("(?s)" + pattern)), name).otherwise(out)
    return out


def open_error(message: Column) -> Column:
    """permission, platform or other: why a state table could not be opened."""
    has = lambda p: F.regexp_like(message, F.lit("(?i)" + p))
    return (
        F.when(has(rf"insufficient permissions|{B}(?:403|forbidden|unauthori[sz]ed){B}"), "permission")
        .when((has(rf"{B}5[0-9]{{2}}{B}") & has(rf"{B}(?:http|status|server|api){B}"))
              | has("timeout|timedout|econn|enotfound|network|socket|fetch failed"), "platform")
        .otherwise("other")
    )
