"""IP addresses in canonical form, by expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FOUR = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), body)[0]


def _six(col: Column) -> Column:
    """The canonical form of an IPv6 text, null if it is none: groups without leading zeros, the first of the longest runs
    of zero groups as ::, addresses that map IPv4 with dots, a zone as it is."""
    zone = F.regexp_extract(col, r"(?s)^[^%]*(%.*)$", 1)
    tail = rf"^(?:[0-9a-f:]*:){_FOUR}\z"

    def plain(low: Column) -> Column:
        """A dotted end is two groups."""
        part = lambda i: F.regexp_extract(low, tail, i).cast("int")
        pair = lambda i: F.lower(F.hex(part(i) * 256 + part(i + 1)))
        return F.when(low.rlike(tail), F.concat(F.regexp_extract(low, r"^(.*:)[^:]*$", 1), pair(1), F.lit(":"), pair(3))).otherwise(low)

    def groups(text: Column) -> Column:
        """The eight groups of an address without dots, null if it is none."""
        halves = F.split(text, "::")
        listed = lambda half: F.when(half == "", F.array().cast("array<string>")).when(half.rlike(rf"^{_GROUPS}\z"), F.split(half, ":"))
        both = F.array(listed(halves[0]), listed(F.get(halves, F.lit(1))))
        filled = lambda x: F.when(F.size(x[0]) + F.size(x[1]) <= 7, F.concat(x[0], F.array_repeat(F.lit("0"), 8 - F.size(x[0]) - F.size(x[1])), x[1]))
        return F.when(F.size(halves) == 2, _let(both, filled)).when(text.rlike(r"^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\z"), F.split(text, ":"))

    def written(every: Column) -> Column:
        return _let(F.array_join(F.transform(every, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"), lambda whole: _mapped(whole, _compressed(whole)))

    text = _let(F.lower(F.substring_index(col, "%", 1)), lambda low: _let(plain(low), lambda t: _let(groups(t), written)))
    return F.when(~col.contains("%") | zone.rlike(r"(?s)^%[^%]+\z"), F.concat(text, zone))


def _compressed(whole: Column) -> Column:
    short = whole
    for k in range(2, 9):  # the outermost, longest run is tried first
        run = rf"(?:^|:)0(?::0){{{k - 1}}}(?::|$)"
        short = F.when(whole.rlike(run), F.regexp_replace(whole, rf"^(.*?){run}(.*)$", "$1::$2")).otherwise(short)
    return short


def _mapped(whole: Column, short: Column) -> Column:
    """Addresses that map IPv4 end in dots."""
    group = lambda i: F.conv(F.get(F.split(whole, ":"), F.lit(i)), 16, 10).cast("int")
    four = F.concat_ws(".", *[x.cast("string") for i in (6, 7) for x in (F.floor(group(i) / 256), group(i) % 256)])
    return F.when(whole.rlike("^(?:0:){5}ffff:"), F.concat(F.lit("::ffff:"), four)).otherwise(short)


def canonical_ip(col: Column) -> Column:
    """The canonical IPv4 or IPv6 form, '' for '', null for null and anything else."""
    return _let(col, lambda x: F.when((x == "") | x.rlike(rf"^{_FOUR}\z"), x).when(x.contains(":"), _six(x)))
