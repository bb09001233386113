"""Settings of an index and of a search, with the rules that make them valid."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

METRICS = ("l2", "ip", "cosine")
MAX_ID = 2**32 - 1


def need(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


@dataclass(frozen=True)
class IndexConfig:
    """dimension: of the vectors; groups: code positions of 4 bits; metric: l2, ip or cosine; centering: mean or none;
    grouping: uniform or uneven; transform: none, pca or balanced_pca; init: kmeans (seeded) or first_rows (the rows
    with the smallest ids, so a model can be told in SQL); nlist: lists of the router; router: exact or pq4 (each
    coordinate of a centroid on 16 levels); page_bytes: of a page of exact records; payload_bytes: of a record's vector."""

    dimension: int
    groups: int
    metric: str = "l2"
    centering: str = "mean"
    grouping: str = "uniform"
    transform: str = "none"
    init: str = "kmeans"
    nlist: int = 16
    router: str = "exact"
    max_group_dims: int = 0
    page_bytes: int = 4096
    payload_bytes: int = 0
    max_train_rows: int = 200_000
    seed: int = 42

    def __post_init__(self):
        d, m = self.dimension, self.groups
        need(d > 0 and m > 0, "dimension and groups must be positive")
        need(m <= d and m % 2 == 0, "groups must be even and no more than the dimension")
        need(self.metric in METRICS, f"unknown metric {self.metric}")
        need(self.centering in ("mean", "none"), f"unknown centering {self.centering}")
        need(self.grouping in ("uniform", "uneven"), f"unknown grouping {self.grouping}")
        need(self.transform in ("none", "pca", "balanced_pca"), f"unknown transform {self.transform}")
        need(self.init in ("kmeans", "first_rows"), f"unknown init {self.init}")
        need(self.router in ("exact", "pq4"), f"unknown router {self.router}")
        need(self.grouping != "uniform" or d % m == 0, "uniform grouping needs a dimension divisible by groups")
        need(self.grouping != "uneven" or d % 2 == 0, "uneven grouping needs an even dimension")
        need(self.metric != "cosine" or self.centering == "none", "cosine needs centering none")
        need(self.max_group_dims == 0 or self.max_group_dims >= math.ceil(d / m), "max_group_dims is too small")
        need(self.nlist >= 16, "nlist must be at least 16")
        need(self.page_bytes > 0 and self.page_bytes & (self.page_bytes - 1) == 0, "page_bytes must be a power of two")
        need(self.record_bytes <= self.page_bytes, "a record must fit in a page")

    @property
    def record_bytes(self) -> int:
        """An id of 4 bytes and the vector."""
        return 4 + (self.payload_bytes or 4 * self.dimension)

    @property
    def records_per_page(self) -> int:
        return self.page_bytes // self.record_bytes

    @property
    def code_bytes(self) -> int:
        return self.groups // 2

    @property
    def encoded_bytes(self) -> int:
        """Code and three metadata bytes."""
        return self.code_bytes + 3

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class SearchParams:
    """k: neighbours; nprobe: lists probed; z: width of the interval in uncertainties; limit: most candidates refined,
    0 for all that the interval leaves; query_block: queries answered in one pass; lut: exact, or uint8 for dot products
    rounded to bytes."""

    k: int = 10
    nprobe: int = 4
    z: float = 1.0
    limit: int = 100
    query_block: int = 2_048
    lut: str = "exact"

    def __post_init__(self):
        need(self.lut in ("exact", "uint8"), f"unknown lut {self.lut}")
        need(self.k > 0, "k must be positive")
        need(self.nprobe > 0, "nprobe must be positive")
        need(math.isfinite(self.z) and self.z >= 0, "z must be finite and not negative")
        need(self.limit == 0 or self.limit >= self.k, "limit must be 0 or at least k")
        need(self.query_block > 0, "query_block must be positive")
