"""Options of the queries. The defaults of limits, exponents, names and digits, which users of such tools expect.

path_limit keeps a pair's shortest routes only; None, the default, keeps all."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SessionOptions:
    entry_id: str = "fid"
    edge_id: str = "fid"
    len_col: str | None = None
    len_r_col: str | None = None
    weight_col: str | None = None
    edge_cost: str | None = None
    entry_reach: float = 100.0
    digits: int = 3
    tolerance: float | None = None
    epsg: int | None = None
    segment: bool = False


@dataclass(frozen=True)
class ReachOptions:
    limit: float = 1200.0
    weight: str = "weight"
    exponent: float = 0.35
    compound: float = 0.6
    result: str = "Reach"


@dataclass(frozen=True)
class StraightnessOptions:
    limit: float = 1500.0
    weight: str = "weight"
    exponent: float = 0.35
    result: str = "Straightness"


@dataclass(frozen=True)
class BetweennessOptions:
    limit: float = 1200.0
    origin_weight: str = "weight"
    dest_weight: str = "weight"
    detour: float = 1.0
    alpha: float = 0.0
    path_limit: int | None = None
    true_paths: bool = False
    singular: bool = False
    result: str = "PatronBtwns"


@dataclass(frozen=True)
class BetweennessBatchOptions:
    limit: float = 700.0
    detour: float = 1.2
    alpha: float = 0.35
    path_limit: int | None = None
    prefix: str = ""
    suffix: str = ""


@dataclass(frozen=True)
class ReachBatchOptions:
    mode: str = "ND"
    exponent: float = 0.35
    compound: float = 0.6
    prefix: str = ""
    suffix: str = ""
