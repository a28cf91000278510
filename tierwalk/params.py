"""Query parameters and the type dictionaries of the known domains."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values of the scoring model.
ALPHA = 0.9
BETA = 0.8
TOP_K = 5

# Scores are compared on this many decimals, so that the order in which a
# distributed sum adds its terms cannot decide between equal answers.
RANK_DIGITS = 9


@dataclass(frozen=True)
class ScoreParams:
    """How to score, how far to walk and how many answers to keep.

    ``max_hops``   bound on the number of hops, None for no bound
    ``stop``       "fixpoint" walks until nothing new is reached; "coverage" ends a
                   star as soon as its visited nodes stop growing, cover the graph,
                   or every wanted node is complete
    ``early_stop`` end a star once no other node can enter its top k (exact)
    ``prune``      "bound" suppresses nodes below the current thresholds (lossy)
    ``hierarchy``  False switches inheritance off for every seed
    ``star_k``     answers handed from each star to the chain, ``k`` when None
    """

    alpha: float = ALPHA
    beta: float = BETA
    k: int = TOP_K
    star_k: int | None = None
    max_hops: int | None = None
    stop: str = "fixpoint"
    prune: str | None = None
    early_stop: bool = False
    hierarchy: bool = True
    distinct_nodes: bool = False

    def __post_init__(self):
        if self.stop not in ("fixpoint", "coverage"):
            raise ValueError(f"unknown stop rule: {self.stop}")
        if self.prune not in (None, "bound"):
            raise ValueError(f"unknown prune rule: {self.prune}")
        if not 0 < self.alpha < 1 or not 0 <= self.beta <= 1:
            raise ValueError("alpha must lie between 0 and 1, beta from 0 to 1: other values void the caps")
        if self.max_hops is not None and self.max_hops < 0:
            raise ValueError("max_hops must not be negative")
        if self.k < 1 or (self.star_k is not None and self.star_k < 1):
            raise ValueError("k must be at least 1")
        if self.early_stop and self.prune:
            raise ValueError("early_stop is exact, prune is not: choose one")
        if self.early_stop and self.stop != "fixpoint":
            raise ValueError("early_stop replaces the coverage rule: choose one")

    @property
    def norm(self) -> float:
        """Factor of the single-path cap: alpha to the power of minus alpha."""
        return self.alpha ** (-self.alpha)

    def with_(self, **changes) -> "ScoreParams":
        return replace(self, **changes)


@dataclass(frozen=True)
class Domain:
    """Type names by id, and the type pairs between which hierarchy is inherited.

    A rule ``(a, b)`` holds in both directions; ``b`` None stands for any type.
    """

    domain_id: int
    name: str
    type_names: tuple[str, ...]
    rules: tuple[tuple[int, int | None], ...]

    def type_id(self, type_name: str) -> int:
        return self.type_names.index(type_name)


# Type dictionaries and inheritance pairs.
PRODUCT = Domain(
    0,
    "product",
    ("PRODUCT", "VULNERABILITY", "BUGID", "WORKAROUND", "TECHNOLOGY", "WORKGROUP", "PRODUCTSITE"),
    ((0, 1),),
)
BIBLIOGRAPHY = Domain(
    1,
    "bibliography",
    (
        "DUMMY",
        "PEOPLE",
        "PAPER",
        "TOPIC",
        "DATE",
        "ARTICLE",
        "BOOK",
        "INCOLLECTION",
        "INPROCEEDING",
        "MASTERSTHESIS",
        "PHDTHESIS",
        "PROCEEDINGS",
        "WWW",
    ),
    ((3, None),),
)
SYNTHETIC = Domain(
    2,
    "synthetic",
    (
        "TYPE0HIER",
        "TYPE1HIER",
        "TYPE0INHERIT",
        "TYPE1INHERIT",
        "TYPE0GENERIC",
        "TYPE1GENERIC",
        "TYPE2GENERIC",
    ),
    ((2, None), (3, None)),
)
COMMERCE = Domain(
    3,
    "commerce",
    ("PART", "SUPPLIER", "BRAND", "CUSTOMER", "ORDER", "NATION", "REGION"),
    ((2, 0), (5, None), (6, None)),
)

DOMAINS = {d.name: d for d in (PRODUCT, BIBLIOGRAPHY, SYNTHETIC, COMMERCE)}
