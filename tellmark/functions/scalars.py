"""Scalar expressions with the null, rounding and normalisation rules the analytics rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def per_player(value: Column, players: Column) -> Column:
    """Whole units per player, half to even; null if the value is null or there are no players."""
    return F.when(value.isNotNull() & (players > 0), F.bround(value.cast("double") / players, 0).cast("int"))


def available(left: Column, spent: Column) -> Column:
    """left + spent with a null as 0, but null if both are."""
    return F.when(left.isNull() & spent.isNull(), F.lit(None)).otherwise(F.coalesce(left, F.lit(0)) + F.coalesce(spent, F.lit(0)))


def ladder(steps: list[int], place: Column) -> Column:
    """The step at a place, clamped to the ladder's ends."""
    at = F.greatest(F.lit(0), F.least(place, F.lit(len(steps) - 1)))
    return F.element_at(F.array(*map(F.lit, steps)), (at + 1).cast("int"))


def can_buy(money: Column, bonus: Column, most: int, least: int) -> Column:
    """How many players have at least ``least`` once the bonus is added and the balance capped."""
    return F.size(F.filter(money, lambda m: F.least(m + bonus, F.lit(most)) >= least))


def bucket_labels(edges: list[float]) -> list[str]:
    """Labels of left-closed buckets: 0-5, 5-10, 10+; equal labels are an error."""
    text = [f"{e:g}" for e in [0, *edges]]
    labels = [f"{a}-{b}" for a, b in zip(text, text[1:])] + [f"{text[-1]}+"]
    if len(set(labels)) < len(labels) or any(b <= a for a, b in zip([0, *edges], edges)):
        raise ValueError(f"edges {edges} don't make distinct buckets")
    return labels


def seconds_bucket(seconds: Column, edges: list[float]) -> Column:
    """The bucket of a time; null, NaN, infinite and negative times are unknown."""
    labels = bucket_labels(edges)
    value = seconds.cast("double")
    known = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    out = F.when(~F.coalesce(known, F.lit(False)), "unknown")
    for edge, label in zip(edges, labels):
        out = out.when(value < edge, label)
    return out.otherwise(labels[-1])


def blank_to_null(text: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def weapon_name(text: Column) -> Column:
    """Trimmed, lower case, without the weapon_ prefix; null if blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(text)), "^weapon_", ""), F.lit(""))


def slug(text: Column) -> Column:
    """Lower case with runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def match_of(unit: Column) -> Column:
    """A unit's match: the id without all trailing -<number>; an id of another form is its own match."""
    return F.coalesce(F.nullif(F.regexp_extract(unit, r"^(.*?)(?:-[0-9]+)+$", 1), F.lit("")), unit)


def unit_number(unit: Column) -> Column:
    """The number behind the last hyphen, null if there is none."""
    return F.nullif(F.regexp_extract(unit, r"^.+-([0-9]+)$", 1), F.lit("")).try_cast("int")


def sure_maps(best_of: Column) -> Column:
    """How many maps a best-of-n has for sure."""
    return F.floor(best_of / 2).cast("int") + 1


def finite_point(*axes: Column) -> Column:
    """Whether all coordinates are numbers: not null, not NaN, not infinite."""
    ok = F.lit(True)
    for a in axes:
        a = a.cast("double")
        ok = ok & F.coalesce(~F.isnan(a) & (F.abs(a) < float("inf")), F.lit(False))
    return ok


def utc_date(text: Column) -> Column:
    """The UTC date of an ISO time with an offset; null without an offset or if it can't be read."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}T.+(?:Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.to_date(F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())))


def moment(epoch: Column) -> Column:
    """Epoch seconds as a timestamp; null unless positive."""
    return F.when(epoch > 0, F.timestamp_seconds(epoch))


def best_of(value: Column) -> Column:
    """A whole number from 1 to 9, else null."""
    number = value.try_cast("int")
    return F.when(number.between(1, 9), number)


def is_steam_id(text: Column) -> Column:
    """17 digits in the individual-account range."""
    return F.coalesce(text.rlike("^[0-9]{17}$") & (text.try_cast("long") > 76561197960265728), F.lit(False))


def member_key(members: Column) -> Column:
    """A key of a set of ids: the first 16 hexadecimal digits of the SHA-256 of the sorted ids joined by commas."""
    return F.substring(F.sha2(F.concat_ws(",", F.array_sort(F.array_distinct(members))), 256), 1, 16)


def id_text(value: Column) -> Column:
    """A number-like id as text without a fraction and leading zeros, other ids as they are."""
    text = value.cast("string")
    whole = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9]+)(?:\.[0-9]*)?$", 1), "^(-?)0+(?=[0-9])", "$1")
    long = F.when(text.rlike(r"^-?[0-9.]+[eE][+-]?[0-9]+$"), text.try_cast("double").try_cast("bigint").cast("string"))
    return F.coalesce(F.nullif(whole, F.lit("")), long, text)


def recode(value: Column, names: dict[str, str]) -> Column:
    """Known values by name, others unchanged."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value) if pairs else value


def enum_rank(value: Column, order: list[str]) -> Column:
    """The place of a value in a fixed order, from 0; null if unknown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1


def strict_rank(value: Column, order: list[str]) -> Column:
    """The place of a value in a fixed order, from 0; another value is an error, null stays null."""
    wrong = F.raise_error(F.concat(F.lit("not in the order: "), value)).cast("int")
    return F.when(value.isNotNull(), F.coalesce(enum_rank(value, order).cast("int"), wrong))


def same_moment(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= tolerance


def params_key(params: Column) -> Column:
    """SHA-256 of a struct's JSON, a cache key of parameters."""
    return F.sha2(F.to_json(params), 256)
