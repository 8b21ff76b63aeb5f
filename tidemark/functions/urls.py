"""URLs as browsers write them: hosts in ASCII, paths without dot segments, other characters percent-encoded.

All of it is expressions.  The loops over characters are behind conditions, so a URL of plain ASCII costs a few searches.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.patterns import let
from tidemark.functions.reference_data import URL_TRACKING_PARAMS

#: Characters that stay as they are in each part; what is already percent-encoded stays too.
#: Letters and digits are written out: Java looks characters up in one set then, and asks a chain of predicates for ranges.
_WORD = string.ascii_letters + string.digits
PATH_KEPT = r"[!$%&'()*+,\-./:;=@\[\]\\_|~" + _WORD + "]"
QUERY_KEPT = r"[!$%&()*+,\-./:;=?@\[\]\\^_`{|}~" + _WORD + "]"
# Parameters of Punycode (RFC 3492).
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_N = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: So many digits hold any difference between code points times the length of a host.
MOST_DIGITS = 10
#: Signs that separate labels of a host like the full stop.
STOPS = "。．｡"


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def percent_encoded(text: Column, kept: str) -> Column:
    """The text with the UTF-8 bytes of all characters but the kept ones percent-encoded."""
    one = lambda c: F.when(F.regexp_like(c, F.lit(kept)), c).otherwise(
        F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", r"%$1"))
    return F.when(F.regexp_like(text, F.lit(f"^{kept}*+\\z")), text).otherwise(F.array_join(F.transform(_characters(text), one), ""))


def without_dots(path: Column) -> Column:
    """The path without segments of one or two dots, also where these are percent-encoded; two take the segment before them away."""
    one, two = r"(?i)^(?:\.|%2e)\z", r"(?i)^(?:\.|%2e){2}\z"
    like = lambda s, p: F.regexp_like(s, F.lit(p))
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, s: F.when(like(s, one), done).when(
        like(s, two), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    last = F.element_at(parts, -1)
    end = F.when(like(last, one) | like(last, two), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(F.regexp_like(path, F.lit(r"(?i)/(?:\.|%2e)")), F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))).otherwise(path)


def _digit(value: Column) -> Column:
    return F.substring(F.lit(DIGITS), (value + 1).cast("int"), F.lit(1))


def _variable_length(delta: Column, bias: Column) -> Column:
    """The digits of a difference under a bias."""
    long, state = (lambda c: c.cast("long")), F.struct(delta.alias("q"), F.lit("").alias("s"), F.lit(False).alias("done"))

    def step(a: Column, k: Column) -> Column:
        t = F.least(F.greatest(k - bias, F.lit(T_MIN).cast("long")), F.lit(T_MAX).cast("long"))
        stop = a["done"] | (a["q"] < t)
        return F.struct(
            long(F.when(stop, a["q"]).otherwise(_div(a["q"] - t, F.lit(BASE).cast("long") - t))).alias("q"),
            F.when(a["done"], a["s"]).when(a["q"] < t, F.concat(a["s"], _digit(a["q"]))).otherwise(
                F.concat(a["s"], _digit(t + (a["q"] - t) % (F.lit(BASE).cast("long") - t)))).alias("s"),
            stop.alias("done"))

    places = F.sequence(F.lit(BASE).cast("long"), F.lit(BASE * MOST_DIGITS).cast("long"), F.lit(BASE).cast("long"))
    return F.aggregate(places, state, step)["s"]


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a difference."""
    start = F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2))
    state = F.struct((start + _div(start, points)).cast("long").alias("d"), F.lit(0).cast("long").alias("k"))
    limit = (BASE - T_MIN) * T_MAX // 2

    def step(a: Column, _: Column) -> Column:
        over = a["d"] > limit
        return F.struct(F.when(over, _div(a["d"], BASE - T_MIN)).otherwise(a["d"]).cast("long").alias("d"),
                        (a["k"] + F.when(over, F.lit(BASE)).otherwise(F.lit(0))).cast("long").alias("k"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIGITS)), state, step)
    return F.element_at(F.transform(F.array(end), lambda e: e["k"] + _div(F.lit(BASE).cast("long") * e["d"], e["d"] + SKEW)), 1)


def punycode(label: Column) -> Column:
    """A label of other scripts in Punycode, without a prefix."""
    zero = F.lit(0).cast("long")

    def coded(points: Column) -> Column:
        basic = F.filter(points, lambda c: c < FIRST_N)
        plain = F.array_join(F.transform(basic, lambda c: F.chr(c)), "")
        b = F.size(basic).cast("long")
        others = F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= FIRST_N)))
        state = F.struct(F.lit(FIRST_N).cast("long").alias("n"), zero.alias("delta"), F.lit(FIRST_BIAS).cast("long").alias("bias"), b.alias("h"),
                         F.concat(plain, F.when(b > 0, "-").otherwise("")).alias("s"))

        def each(m: Column):
            def one(a: Column, c: Column) -> Column:
                hit = c == m
                return F.struct(
                    a["n"].alias("n"), F.when(hit, zero).when(c < m, a["delta"] + 1).otherwise(a["delta"]).cast("long").alias("delta"),
                    F.when(hit, _adapted(a["delta"], a["h"] + 1, a["h"] == b)).otherwise(a["bias"]).cast("long").alias("bias"),
                    F.when(hit, a["h"] + 1).otherwise(a["h"]).cast("long").alias("h"),
                    F.when(hit, F.concat(a["s"], _variable_length(a["delta"], a["bias"]))).otherwise(a["s"]).alias("s"))

            return one

        def turn(a: Column, m: Column) -> Column:
            begun = F.struct(m.alias("n"), (a["delta"] + (m - a["n"]) * (a["h"] + 1)).cast("long").alias("delta"), a["bias"].alias("bias"), a["h"].alias("h"), a["s"].alias("s"))
            done = F.aggregate(points, begun, each(m))
            return F.element_at(F.transform(F.array(done), lambda d: F.struct(
                (d["n"] + 1).alias("n"), (d["delta"] + 1).alias("delta"), d["bias"].alias("bias"), d["h"].alias("h"), d["s"].alias("s"))), 1)

        return F.aggregate(others, state, turn)["s"]

    points = F.transform(_characters(label), lambda c: F.ascii(c).cast("long"))
    return F.element_at(F.transform(F.array(points), coded), 1)


def ascii_host(host: Column) -> Column:
    """A host in lower case and ASCII; labels of other scripts in Punycode.

    Of the mappings of international names only lower case and the stops of other scripts are made; names are taken to be
    composed, as they are written.
    """
    other = r"[^\x00-\x7F]"
    def of(low: Column) -> Column:
        labels = F.split(F.translate(low, STOPS, "." * len(STOPS)), r"\.")
        coded = F.transform(labels, lambda x: F.when(F.regexp_like(x, F.lit(other)), F.concat(F.lit("xn--"), punycode(x))).otherwise(x))
        return F.when(F.regexp_like(low, F.lit(other)), F.array_join(coded, ".")).otherwise(low)

    return let(F.lower(host), of)


def _whole(url: Column, query_of) -> Column:
    """A URL as browsers write it, without fragment and default port, its query by a function of that; unchanged if it has no host."""
    whole = r"(?is)^(https?)://((?:[^/?#\\@]*@)?)([^/?#\\:]+)((?::[0-9]*)?)([^?#]*)((?:\?[^#]*)?)"

    def written(p: Column) -> Column:
        scheme, port = F.lower(p[0]), p[3]
        default = F.when(scheme == "http", ":80").otherwise(":443")
        port = F.when((port == default) | (port == ":"), "").otherwise(port)
        path = let(without_dots(F.replace(p[4], F.lit("\\"), F.lit("/"))), lambda c: F.when(c == "", "/").otherwise(percent_encoded(c, PATH_KEPT)))
        return F.concat(scheme, F.lit("://"), p[1], ascii_host(p[2]), port, path, query_of(p[5]))

    parts = F.array(*(F.regexp_extract(url, whole, i) for i in range(1, 7)))
    return let(parts, lambda p: F.when(p[0] != "", written(p)).otherwise(url))


def normal_url(url: Column) -> Column:
    """An http or https URL as browsers write it, without default port, fragment and slashes at the end.

    Backslashes in the path count as slashes.  What has no host is left as it is, but for slashes at its end.
    """
    return F.regexp_replace(_whole(url, lambda query: percent_encoded(query, QUERY_KEPT)), r"/+\z", "")


def canonical_url(url: Column, ignored: tuple[str, ...] = URL_TRACKING_PARAMS) -> Column:
    """A URL by which searches are told apart: parameters in dictionary order (ICU's), without ignored ones and fragment.

    Parameters of one name keep their order.  Names and values are decoded and encoded again, as forms do it; what
    can't be decoded stays as it is.
    """
    def decoded(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), text)

    def sorted_query(query: Column) -> Column:
        pairs = F.filter(F.split(F.substring(query, F.lit(2), F.length(query)), "&"), lambda p: p != "")

        def entry(p: Column, i: Column) -> Column:
            name = decoded(F.substring_index(p, "=", 1))
            value = F.when(F.contains(p, F.lit("=")), decoded(F.regexp_replace(p, r"(?s)^[^=]*=", ""))).otherwise("")
            return F.struct(F.collate(name, "UNICODE").alias("key"), i.alias("place"), name.alias("name"), value.alias("value"))

        kept = F.filter(F.transform(pairs, entry), lambda e: ~e["name"].isin(*ignored) if ignored else F.lit(True))
        text = F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(F.url_encode(e["name"]), F.lit("="), F.url_encode(e["value"]))), "&")
        return F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")

    return _whole(url, sorted_query)
