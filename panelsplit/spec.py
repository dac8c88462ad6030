"""Column roles of a keyed flow/stock panel.

A panel is ``(keys..., period DATE, measures...)`` with one row per entity and
period. Every operator takes the entity ``keys`` explicitly (possibly empty) and
a ``PanelSpec`` naming the measure roles, so the same operators serve the
fixture series, a TPC-H fact panel keyed by supplier, or anything else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

FLOW, STOCK, RATE = "flow", "stock", "rate"


@dataclass(frozen=True)
class MeasureSpec:
    """A measure and its semantic kind.

    flow  - period total; a longer period is the SUM of its sub-periods.
    stock - observed at period end; a longer period is the AVERAGE of period
            ends (or the last one, 'year-end'); never summed.
    rate  - never summed; averaged for display or recomputed flow / avg stock.
    """

    name: str
    kind: str

    def __post_init__(self):
        if self.kind not in (FLOW, STOCK, RATE):
            raise ValueError(f"unknown measure kind {self.kind!r}")


@dataclass(frozen=True)
class PanelSpec:
    period: str = "period"
    loss: str = "write_offs"            # flow W: the quantity whose change is explained
    balance: str = "rollover"           # stock R: the base the loss is measured against
    billings: str = "billings"          # flow B
    principal: str = "principal"        # stock count (entities of the first kind)
    supplementary: str = "supplementary"  # stock count (entities of the second kind)
    rate: str = "rate_pct"              # published per-period rate, in percent
    extra: tuple = field(default_factory=tuple)

    def measures(self) -> list[MeasureSpec]:
        return [
            MeasureSpec(self.principal, STOCK),
            MeasureSpec(self.supplementary, STOCK),
            MeasureSpec(self.billings, FLOW),
            MeasureSpec(self.balance, STOCK),
            MeasureSpec(self.loss, FLOW),
            MeasureSpec(self.rate, RATE),
        ]

    def measure_names(self) -> list[str]:
        return [m.name for m in self.measures()]

    def counts(self) -> list[str]:
        return [self.principal, self.supplementary]

    def money(self) -> list[str]:
        return [self.billings, self.balance, self.loss]


DEFAULT = PanelSpec()
