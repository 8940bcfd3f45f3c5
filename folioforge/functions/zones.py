"""Versioned zone transition tables and vectorised local-to-UTC conversion."""

from __future__ import annotations

import hashlib
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import cache
from pathlib import Path

import numpy as np

#: Years for which transitions are tabulated; outside them the nearest offset holds.
FIRST_YEAR, LAST_YEAR = 1900, 2100
_STEP = 7 * 86400

# Offsets in minutes of zone abbreviations in common use, taken where the
# home zone itself does not use the abbreviation.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "bst": 60, "eet": 120, "eest": 180, "msk": 180, "sast": 120, "pkt": 300, "ist": 330, "npt": 345,
    "ict": 420, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "acdt": 630,
    "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "nst": -210, "ndt": -150, "ast": -240, "adt": -180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600,
}


@cache
def version() -> str:
    """Release of the zone rules in use; where the machine's files do not name theirs, a hash of the files, which tells them from any others."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        pass
    digest = hashlib.sha256()
    for folder in map(Path, zoneinfo.TZPATH):
        for name, mark in (("+VERSION", ""), ("tzdata.zi", "# version ")):
            if (f := folder / name).exists():
                return f.read_text(encoding="utf-8").splitlines()[0].removeprefix(mark).strip()
        for f in sorted(p for p in folder.rglob("*") if p.is_file()):
            digest.update(f.relative_to(folder).as_posix().encode() + f.read_bytes())
    return f"files-{digest.hexdigest()[:12]}"


@cache
def names() -> dict[str, str]:
    """Zone names by their lower-case form."""
    return {n.lower(): n for n in zoneinfo.available_timezones()}


def _load(name: str) -> zoneinfo.ZoneInfo:
    try:
        import importlib.resources

        import tzdata  # noqa: F401

        package, _, key = ("tzdata.zoneinfo/" + name).rpartition("/")
        with importlib.resources.files(package.replace("/", ".")).joinpath(key).open("rb") as f:
            return zoneinfo.ZoneInfo.from_file(f, key=name)
    except (ImportError, FileNotFoundError, ModuleNotFoundError):
        return zoneinfo.ZoneInfo(name)


class ZoneTable:
    """Transitions of one zone: where each offset begins in UTC and on the local clock."""

    def __init__(self, name: str):
        zone = _load(name)
        self.abbreviations: dict[str, int] = {}

        def at(seconds: int) -> tuple[int, str]:
            moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)
            local = moment.astimezone(zone)
            return int(local.utcoffset().total_seconds()), local.tzname() or ""

        low = int((datetime(FIRST_YEAR, 1, 1) - datetime(1970, 1, 1)).total_seconds())
        high = int((datetime(LAST_YEAR, 1, 1) - datetime(1970, 1, 1)).total_seconds())
        starts, offsets = [], [at(low)[0]]
        before = low
        for now in range(low + _STEP, high, _STEP):
            offset, label = at(now)
            if label.isalpha() and now > 0:
                self.abbreviations[label.lower()] = offset
            if offset != offsets[-1]:
                a, b = before, now
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if at(mid)[0] == offsets[-1] else (a, mid)
                starts.append(b)
                offsets.append(at(b)[0])
                if at(b)[0] != offset:  # two changes within a step
                    a = b
                    c = now
                    while c - a > 1:
                        mid = (a + c) // 2
                        a, c = (mid, c) if at(mid)[0] == offsets[-1] else (a, mid)
                    starts.append(c)
                    offsets.append(offset)
            before = now
        self.utc = np.array(starts, dtype=np.int64)
        self.offsets = np.array(offsets, dtype=np.int64)
        # A local clock shows the new offset from the later of its two readings of the change:
        # doubled times thereby mean the first occurrence, skipped ones the offset before.
        self.local = self.utc + np.maximum(self.offsets[:-1], self.offsets[1:])

    def to_utc(self, local_seconds: np.ndarray) -> np.ndarray:
        """UTC seconds of local clock readings."""
        return local_seconds - self.offsets[np.searchsorted(self.local, local_seconds, side="right")]


@cache
def zone_table(name: str) -> ZoneTable | None:
    """The table of a zone by any spelling of its case; None if there is no such zone."""
    known = names().get(name.strip().lower())
    return ZoneTable(known) if known else None
