"""What a run of queries needs to know."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Parameters of the analytical queries on the fixture tables.
DEFAULTS: dict[str, Any] = {
    "region_prefix": "EUROP",
    "nation": "NATION_3",
    "other_nation": "NATION_7",
    "state_prefix": "A",
    "item_suffix": "t",
    "item_suffix_long": "lt",
    "promo_prefix": "PR",
    "excluded_prefix": "ST",
    "surplus_prefix": "EC",
    "order_share": 0.001,
    "carrier_over": 3,
    "order_amount_over": 200_000,
    "idle_since": "2001-01-01",
    "balance_over": -20,
}


@dataclass(frozen=True)
class EngineConfig:
    """A data folder, the epoch that queries read (None: the newest) and query parameters over ``DEFAULTS``."""

    sf_dir: str
    as_of: int | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Any:
        return {**DEFAULTS, **self.params}[name]
