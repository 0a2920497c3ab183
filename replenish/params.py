"""Planning parameters (one frozen value object per run or scenario)."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PlanParams:
    horizon_days: int = 30
    service_level: float = 0.95
    order_cost: float = 35.0
    holding_cost_rate: float = 0.22
    demand_multiplier: float = 1.0
    lead_time_delay_days: float = 0.0
    # Length of the trailing demand window ending at the latest sale date.
    window_days: int = 90
    # Reference date for defaults that the original tool took from the wall
    # clock (missing expected dates, RFQ delivery dates, PO breach checks).
    as_of: _dt.date | None = None
    # Column resolution: 'compat' reproduces substring matching, 'exact'
    # accepts only exact normalised names.
    match: str = "compat"
    # Seed the literal demo bill of materials when none is given.
    demo_bom: bool = False
    # Levels of dependent-demand propagation through the BOM (1 = original, 0 = all).
    bom_levels: int = 1
    # Alert caps by group; None means no cap (the original keeps 40 / 20 / 20,
    # see ``functions.planning.ALERT_CAPS``).
    stockout_alert_cap: int | None = None
    supplier_alert_cap: int | None = None
    dead_stock_alert_cap: int | None = None

    def with_(self, **kw) -> "PlanParams":
        return replace(self, **kw)

    @property
    def alert_caps(self) -> tuple[int | None, int | None, int | None]:
        return self.stockout_alert_cap, self.supplier_alert_cap, self.dead_stock_alert_cap
