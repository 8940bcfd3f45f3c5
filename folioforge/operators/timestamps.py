"""Problem 2: timestamps written in many formats, precisions and zones, as one UTC moment.

Method: each value is tokenised into a character-class shape mask; each distinct mask is
mapped to a parser (the places of year, month, ... among the tokens) once; all values of a
mask are then converted together with numpy, local times through zone transition tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.zones import ABBREVIATIONS, version, zone_table
from folioforge.plans.runtime import fan_out

# Month names, English and Swedish, full and short.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12, "januari": 1, "februari": 2, "mars": 3, "maj": 5, "juni": 6,
    "juli": 7, "augusti": 8, "oktober": 10, "okt": 10,
}
# Day names, English and Swedish; they add nothing to a full date.
WEEKDAYS = set(
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
    "måndag tisdag onsdag torsdag fredag lördag söndag mån tis ons tors fre lör sön".split()
)
_TOKEN = re.compile(r"[a-z]+(?:/[a-z][a-z0-9_+\-]*)+|\d+|[^\W\d_]+|\S|\s")
_DAYS = np.array([31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _kind(token: str) -> str:
    if token.isdecimal() and token.isascii():
        return "9" * len(token)
    if "/" in token and len(token) > 1:
        return "R"
    if token.isalpha():
        if token in ("t", "z", "kl"):
            return token
        if token in MONTHS:
            return "M"
        if token in WEEKDAYS:
            return "W"
        if token in ("am", "pm"):
            return "P"
        return "Z" if 2 <= len(token) <= 5 else "A"
    return token


def tokens_of(value: str) -> list[str]:
    """Lower-case tokens of a value, outer white space gone and inner runs one blank."""
    return _TOKEN.findall(" ".join(value.split()).lower())


def mask_of(tokens: list[str]) -> str:
    """Shape mask: digits 9 each, M month, W weekday, P am or pm, Z abbreviation, R region, else the character."""
    return "\x1f".join(map(_kind, tokens))


class _Reader:
    """Reads the kinds of a mask from left to right, noting token places."""

    def __init__(self, kinds: list[str]):
        self.kinds, self.at, self.slots, self.flags = kinds, 0, {}, set()

    def peek(self, k: int = 0) -> str:
        return self.kinds[self.at + k] if self.at + k < len(self.kinds) else ""

    def digits(self, low: int, high: int, k: int = 0) -> bool:
        x = self.peek(k)
        return bool(x) and x[0] == "9" and low <= len(x) <= high

    def take(self, *slots: str | None) -> None:
        for s in slots:
            if s:
                self.slots[s] = self.at
            self.at += 1

    def skip(self, *kinds: str) -> bool:
        if self.peek() in kinds and self.peek():
            self.at += 1
            return True
        return False


def _date(r: _Reader) -> bool:
    if r.peek() == "W":
        r.take(None)
        r.skip(",", ".")
        r.skip(" ")
    if r.digits(8, 8):
        r.take("ymd8")
    elif r.digits(4, 4) and r.peek(1) in ("-", "/", ".") and r.digits(1, 2, 2) and r.peek(3) == r.peek(1) and r.digits(1, 2, 4):
        r.take("year", None, "month", None, "day")
    elif r.digits(1, 2) and r.peek(1) in ("/", ".") and r.digits(1, 2, 2) and r.peek(3) == r.peek(1) and r.digits(4, 4, 4):
        if r.peek(1) == "/":
            r.take("part_a", None, "part_b", None, "year")
        else:
            r.take("day", None, "month", None, "year")
    elif r.digits(1, 2) and r.peek(1) in (" ", "-") and r.peek(2) == "M":
        r.take("day", None, "name")
        r.skip(".")
        if not r.skip(" ", "-") or not r.digits(4, 4):
            return False
        r.take("year")
    elif r.peek() == "M" and r.peek(1) == " " and r.digits(1, 2, 2):
        r.take("name", None, "day")
        r.skip(",")
        if not r.skip(" ") or not r.digits(4, 4):
            return False
        r.take("year")
    else:
        return False
    return True


def _time(r: _Reader) -> bool:
    if not r.peek():
        return True
    if r.peek() == "," and r.peek(1) == " ":
        r.take(None)
    if r.skip("t"):
        pass
    elif r.skip(" "):
        if r.skip("kl"):
            r.skip(".")
            r.skip(" ")
    else:
        return False
    if r.digits(6, 6):
        r.take("hms6")
    elif r.digits(4, 4):
        r.take("hm4")
    elif r.digits(1, 2) and r.peek(1) in (":", ".") and r.digits(2, 2, 2):
        mark = r.peek(1)
        r.take("hour", None, "minute")
        if r.peek() == mark and r.digits(2, 2, 1):
            r.take(None, "second")
    else:
        return False
    if ("second" in r.slots or "hms6" in r.slots) and r.peek() in (".", ",") and r.digits(1, 12, 1):
        r.take(None, "fraction")
    if r.peek() == "P" or r.peek() == " " and r.peek(1) == "P":
        r.skip(" ")
        r.take("half")
    return _zone(r)


def _zone(r: _Reader) -> bool:
    if r.peek() == " ":
        r.take(None)
    if r.skip("z"):
        r.flags.add("utc")
    elif r.peek() in ("+", "-", "−") or r.peek() == "Z" and r.peek(1) in ("+", "-"):
        r.skip("Z")
        r.take("sign")
        if r.digits(4, 4):
            r.take("off4")
        elif r.digits(1, 2):
            r.take("off_h")
            if r.peek() == ":" and r.digits(2, 2, 1):
                r.take(None, "off_m")
        else:
            return False
    elif r.peek() == "Z":
        r.take("abbreviation")
    elif r.peek() == "R":
        r.take("region")
    if r.peek() == "[" and r.peek(1) in ("R", "Z", "A", "z") and r.peek(2) == "]":
        if "region" in r.slots or {"sign", "abbreviation"} & set(r.slots) or "utc" in r.flags:
            r.take(None, None, None)
        else:
            r.take(None, "region", None)
    if r.peek() == " " and r.peek(1) == "(" and r.peek(2) in ("Z", "A", "R") and r.peek(3) == ")":
        r.take(None, None, None, None)
    return True


@cache
def parser_of(mask: str) -> tuple[dict[str, int], frozenset[str]] | None:
    """Slots of the mask's parser, or None if no moment is written that way. Made once per mask and worker."""
    kinds = mask.split("\x1f")
    if len(kinds) == 1 and len(kinds[0]) in (10, 13, 16) and kinds[0][0] == "9":
        return {"epoch": 0}, frozenset()
    r = _Reader(kinds)
    if _date(r) and _time(r) and r.at == len(kinds):
        return dict(r.slots), frozenset(r.flags)
    return None


def _civil_days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of Gregorian dates."""
    month_start = (y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1)
    return month_start.astype("datetime64[D]").astype(np.int64) + d - 1


def _convert(slots: dict[str, int], flags: frozenset[str], tokens: list[list[str]], zones: list[str], orders: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(micros, valid) of values that share one mask."""
    n = len(tokens)

    def column(slot: str) -> list[str]:
        at = slots[slot]
        return [t[at] for t in tokens]

    def number(slot: str, default: int = 0) -> np.ndarray:
        return np.array(list(map(int, column(slot))), dtype=np.int64) if slot in slots else np.full(n, default, dtype=np.int64)

    if "epoch" in slots:
        text = column("epoch")
        return np.array([int(x) for x in text], dtype=np.int64) * 10 ** (16 - len(text[0])), np.ones(n, dtype=bool)
    if "ymd8" in slots:
        whole = number("ymd8")
        year, month, day = whole // 10000, whole // 100 % 100, whole % 100
    else:
        year, day = number("year"), number("day")
        month = np.array([MONTHS[x] for x in column("name")], dtype=np.int64) if "name" in slots else number("month")
        if "part_a" in slots:
            a, b = number("part_a"), number("part_b")
            us = np.array([o == "mdy" for o in orders])
            month, day = np.where(us, a, b), np.where(us, b, a)
    hour, minute, second = number("hour"), number("minute"), number("second")
    if "hms6" in slots:
        whole = number("hms6")
        hour, minute, second = whole // 10000, whole // 100 % 100, whole % 100
    elif "hm4" in slots:
        whole = number("hm4")
        hour, minute = whole // 100, whole % 100
    micros = np.zeros(n, dtype=np.int64)
    if "fraction" in slots:
        micros = np.array([int((x + "000000")[:6]) for x in column("fraction")], dtype=np.int64)
    valid = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (minute < 60) & (second < 60)
    safe_month = np.where(valid, month, 1)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    valid &= day <= np.where((safe_month == 2) & ~leap, 28, _DAYS[safe_month - 1])
    if "half" in slots:
        valid &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * np.array([x == "pm" for x in column("half")])
    else:
        valid &= (hour < 24) | ((hour == 24) & (minute == 0) & (second == 0) & (micros == 0))
    local = _civil_days(np.where(valid, year, 1970), np.where(valid, month, 1), np.where(valid, day, 1)) * 86400 + hour * 3600 + minute * 60 + second
    seconds = local.copy()
    if "utc" in flags:
        pass
    elif "sign" in slots:
        off_h, off_m = number("off_h"), number("off_m")
        if "off4" in slots:
            off_h, off_m = number("off4") // 100, number("off4") % 100
        sign = np.array([1 if x == "+" else -1 for x in column("sign")])
        valid &= (off_h <= 18) & (off_m < 60)
        seconds = local - sign * (off_h * 3600 + off_m * 60)
    elif "abbreviation" in slots:
        for pair, rows in _groups(zip(column("abbreviation"), zones)):
            home = zone_table(pair[1])
            offset = home.abbreviations.get(pair[0]) if home else None
            if offset is None and pair[0] in ABBREVIATIONS:
                offset = ABBREVIATIONS[pair[0]] * 60
            if offset is None:
                named = zone_table(pair[0])
                valid[rows] &= named is not None
                if named:
                    seconds[rows] = named.to_utc(local[rows])
            else:
                seconds[rows] = local[rows] - offset
    else:
        for zone, rows in _groups(column("region") if "region" in slots else zones):
            found = zone_table(zone)
            if found:
                seconds[rows] = found.to_utc(local[rows])
            else:
                valid[rows] = False
    return seconds * 1_000_000 + micros, valid


def _groups(keys) -> list[tuple]:
    by: dict = {}
    for i, k in enumerate(keys):
        by.setdefault(k, []).append(i)
    return [(k, np.array(v)) for k, v in by.items()]


def to_micros(values: list[str | None], zones: list[str | None], orders: list[str | None]) -> tuple[list[int | None], list[str | None]]:
    """(UTC microseconds or None, mask or None) of values; zones and orders are those of their senders."""
    out: list[int | None] = [None] * len(values)
    masks: list[str | None] = [None] * len(values)
    by: dict[str, list[int]] = {}
    tokens: list[list[str]] = [[]] * len(values)
    for i, v in enumerate(values):
        if v is None:
            continue
        if len(v) > 200 and len(v.strip()) > 200:  # no moment is written at such length
            masks[i] = "long"
            continue
        tokens[i] = tokens_of(v)
        masks[i] = mask_of(tokens[i])
        by.setdefault(masks[i], []).append(i)
    for mask, rows in by.items():
        parser = parser_of(mask)
        if parser is None:
            continue
        micros, valid = _convert(*parser, [tokens[i] for i in rows], [zones[i] or "UTC" for i in rows], [orders[i] or "dmy" for i in rows])
        for i, m, ok in zip(rows, micros.tolist(), valid.tolist()):
            if ok:
                out[i] = m
    return out, [m if m is None else m.replace("\x1f", "") for m in masks]


def normalise_timestamps(df: DataFrame, record_col: str = "record_id", field_col: str = "field_name", value_col: str = "value", zone_col: str = "zone", order_col: str = "date_order") -> DataFrame:
    """(record_id, field_name, value, mask, utc_micros, zone_rules) of every row.

    utc_micros is null where the value is null, blank, not a date, or a moment that does not exist in the
    calendar (January 32, 24:60). A null zone means UTC, a null order dmy; an unknown zone gives
    null unless the value has its own. Repeated rows stay repeated; other columns are not read; an
    empty table gives an empty table. zone_rules names the release of the zone tables.
    """
    src = fan_out(df.select(*[F.col(c).cast("string").alias(a) for c, a in ((record_col, "record_id"), (field_col, "field_name"), (value_col, "value"), (zone_col, "zone"), (order_col, "date_order"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = version()
        for batch in batches:
            values, zones, orders = (batch.column(k).to_pylist() for k in (2, 3, 4))
            micros, masks = to_micros(values, zones, orders)
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(masks, pa.string()), pa.array(micros, pa.int64()), pa.array([rules] * len(values), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["record_id", "field_name", "value", "mask", "utc_micros", "zone_rules"])

    return src.mapInArrow(run, "record_id string, field_name string, value string, mask string, utc_micros bigint, zone_rules string")


FIELDS = ("created_at_source", "updated_at_source", "retrieved_at")


def _key(c: Column) -> Column:
    """Publisher names compare without case and outer blanks; a blank one is none."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def source_values(records: DataFrame, id_col: str, version_col: str, publishers: DataFrame) -> DataFrame:
    """One row per record and field: the value with its sender's zone and date order.

    Of a record delivered or rewritten several times the latest row (by ``version_col``) counts; among
    equally late ones the greatest values. ``publishers`` is broadcast: it has one row per site in a fixed list.
    """
    newest = F.max(F.struct(F.col(version_col).alias("v_"), *[F.col(c).alias(c) for c in FIELDS], F.col("publisher").alias("publisher"), F.col("origin").alias("origin"))).alias("n_")
    latest = records.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("record_id")).agg(newest).select("record_id", "n_.*")
    home = publishers.select(F.col("home_zone").alias("z_"), F.col("date_order").alias("o_"), _key(F.col("publisher")).alias("p_"), F.trim("origin").alias("g_"))
    by_name = F.broadcast(home.where("p_ is not null").groupBy("p_").agg(F.min(F.struct("z_", "o_")).alias("named_")))
    by_origin = F.broadcast(home.where("g_ is not null").groupBy("g_").agg(F.min(F.struct("z_", "o_")).alias("sited_")))
    joined = latest.withColumn("key_", _key(F.col("publisher"))).join(by_name, F.col("key_") == F.col("p_"), "left")
    joined = joined.join(by_origin, F.col("key_").isNull() & (F.trim("origin") == F.col("g_")), "left")
    place = F.coalesce("named_", "sited_")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in FIELDS])).alias("f_")
    zone, order = F.coalesce(place["z_"], F.lit("UTC")).alias("zone"), F.coalesce(place["o_"], F.lit("dmy")).alias("date_order")
    return joined.select("record_id", zone, order, pairs).select("record_id", "f_.field_name", "f_.value", "zone", "date_order").where("value is not null")


def all_source_values(requests: DataFrame, manifests: DataFrame, publishers: DataFrame) -> DataFrame:
    """The three source times of article requests and of source manifests."""
    return source_values(requests, "request_id", "received_at", publishers).unionByName(source_values(manifests, "source_id", "updated_at", publishers))


def found_moments(requests: DataFrame, manifests: DataFrame, publishers: DataFrame) -> DataFrame:
    """(record_id, field_name, utc_micros) of each value that names a real moment."""
    out = normalise_timestamps(all_source_values(requests, manifests, publishers))
    return out.where("utc_micros is not null").select("record_id", "field_name", "utc_micros")


def to_pandas_moments(values: pd.Series, zone: str = "UTC", order: str = "dmy") -> pd.Series:
    """UTC microseconds of a series, for use outside Spark."""
    micros, _ = to_micros([None if pd.isna(v) else v for v in values], [zone] * len(values), [order] * len(values))
    return pd.Series(micros, index=values.index, dtype="Int64")
