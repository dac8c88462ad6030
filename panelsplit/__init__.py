"""panelsplit: keyed flow/stock panels and exact change decomposition on Spark.

Build a ``(keys..., period)`` panel from facts or wide files, gate it with
data-quality and accounting checks, aggregate with explicit flow/stock
semantics, split each change exactly into volume and rate parts, reconcile
against an independent annual source, and report how the split moves across
windows, bases and weights. Every operator takes and returns DataFrames.
"""

from .spec import DEFAULT, FLOW, RATE, STOCK, MeasureSpec, PanelSpec

__all__ = ["DEFAULT", "FLOW", "RATE", "STOCK", "MeasureSpec", "PanelSpec"]
