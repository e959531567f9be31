"""Resolution tiers from their text form ``5s:1d,15s:1w`` (resolution:lifetime, fine to coarse)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..errors import TidemarkError, require
from .interval import parse_interval


@dataclass(frozen=True)
class Tier:
    """Rows of one resolution and how long they live, in milliseconds."""

    res_ms: int
    ttl_ms: int


def _ordered(tiers: list[Tier], res_code: str, ttl_code: str) -> list[Tier]:
    for fine, coarse in zip(tiers, tiers[1:], strict=False):
        require(fine.res_ms <= coarse.res_ms, res_code, "resolutions go from fine to coarse")
        require(fine.ttl_ms <= coarse.ttl_ms, ttl_code, "lifetimes don't fall from fine to coarse")
    return tiers


def parse_retention(text: str) -> list[Tier]:
    require(isinstance(text, str) and bool(text.strip()), "TBL_RETENTION_STRING", "text such as 5s:1d,1m:1mon")
    parts = [p.strip() for p in text.split(",") if p.strip()]
    require(bool(parts), "TBL_RETENTION_EMPTY", "one tier at least")
    out = []
    for part in parts:
        sides = part.split(":")
        require(len(sides) == 2, "TBL_RETENTION_TIER_FORMAT", "resolution:lifetime", part=part)
        values = []
        for side, code in zip(sides, ("TBL_RETENTION_RES", "TBL_RETENTION_TTL"), strict=True):
            try:
                values.append(parse_interval(side))
            except TidemarkError as e:
                raise TidemarkError(code, str(e), part=part) from e
            require(values[-1] > 0, f"{code}_POS", "must be above 0", part=part)
        out.append(Tier(*values))
    return _ordered(out, "TBL_RETENTION_RES_ASC", "TBL_RETENTION_TTL_ASC")


def check_tiers(tiers: Iterable[Tier | tuple[int, int]]) -> list[Tier]:
    out = [t if isinstance(t, Tier) else Tier(*t) for t in tiers]
    require(bool(out), "TBL_TIERS_EMPTY", "one tier at least")
    for t in out:
        require(t.res_ms > 0, "TBL_TIERS_RES_POS", "must be above 0")
        require(t.ttl_ms > 0, "TBL_TIERS_TTL_POS", "must be above 0")
    return _ordered(out, "TBL_TIERS_RES_ASC", "TBL_TIERS_TTL_ASC")
