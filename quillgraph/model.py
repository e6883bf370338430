"""Run parameters, taxonomy and settings of the citation analytics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The field taxonomy's groups, its names and the identity of the external sentinel.
GROUPS = {
    1: ("Mathematics and Computer Science", (17, 26)),
    2: ("Physical Sciences and Engineering", (15, 16, 21, 22, 25, 31)),
    3: ("Life and Earth Sciences", (11, 13, 19, 23, 24)),
    4: ("Biomedical and Health Sciences", (27, 28, 29, 30, 34, 35, 36)),
    5: ("Social Sciences and Humanities", (12, 14, 18, 20, 32, 33)),
}
SENTINEL = 1
MAX_AUTHORS = 29
MASKS = {"1000": ("ss",), "0001": ("ii",), "0110": ("si", "is"), "1111": ("ss", "si", "is", "ii")}


@dataclass(frozen=True)
class Corpus:
    """Which works form the corpus."""

    years: tuple[int, int]
    work_types: tuple[str, ...]
    source_types: tuple[str, ...]
    institution_types: tuple[str, ...] = ()
    max_authors: int = MAX_AUTHORS


@dataclass(frozen=True)
class Run:
    """One ranking run. Thresholds are per year of the census window, which is the works' years on both ends. sentinel is the number of the
    unit that stands for all outside; no unit of the data may have it."""

    group_col: str = "field_idx"
    members: tuple[int, ...] = ()
    window: tuple[int, int] = (2020, 2024)
    tau_s: float = 10.0
    tau_u: float = 10.0
    mask: str = "0110"
    alpha: float = 1.0
    rho: int = 0
    omega: int = 0
    beta: int = 0
    epsilon: int = 0
    chi: float = -1.0
    prior: str = "uniform"
    bloc: frozenset[str] = field(default_factory=frozenset)
    sentinel: int = SENTINEL

    def __post_init__(self) -> None:
        if self.mask not in MASKS:
            raise ValueError(f"mask {self.mask} is none of {', '.join(MASKS)}")
        if not 0 <= self.alpha <= 1 or self.window[0] > self.window[1]:
            raise ValueError("alpha lies in 0 to 1, and a window ends after it begins")

    @property
    def years(self) -> int:
        return self.window[1] - self.window[0] + 1

    @property
    def least_s(self) -> float:
        return self.tau_s * self.years

    @property
    def least_u(self) -> float:
        return self.tau_u * self.years


def group_of(field_idx: Column) -> tuple[Column, Column]:
    """Group number and name of a field; null outside the taxonomy."""
    number = name = F.lit(None)
    for k, (text, members) in GROUPS.items():
        number = F.when(field_idx.isin(*members), F.lit(k).cast("long")).otherwise(number)
        name = F.when(field_idx.isin(*members), F.lit(text)).otherwise(name)
    return number, name
