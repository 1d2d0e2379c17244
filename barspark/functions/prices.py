"""Price, cost and lot-size columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUDGE = 1e-9


def round_price(x: Column, digits: int = 2) -> Column:
    """Half away from zero at the given digits, with a nudge that takes binary fractions up."""
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5 + NUDGE).cast("double") / scale + 0.0  # no minus zero


def entry_price(bid: Column, spread: Column, direction: Column, slippage: Column, point: float = 0.01, digits: int = 2) -> Column:
    """A buy pays the spread and the slippage; a sell gives the slippage. A negative spread gives null."""
    buy = bid + spread * point + slippage * point
    price = round_price(F.when(direction == 1, buy).otherwise(bid - slippage * point), digits)
    return F.when((spread >= 0) & direction.isin(1, -1), price)


def exit_price(bid: Column, spread: Column, direction: Column, slippage: Column, point: float = 0.01, digits: int = 2) -> Column:
    """A long sells at the bid less slippage; a short buys at the ask and pays slippage."""
    price = F.when(direction == 1, bid - slippage * point).otherwise(bid + spread * point + slippage * point)
    return F.when((spread >= 0) & direction.isin(1, -1), round_price(price, digits))


def floor_to_step(value: Column, step: float) -> Column:
    return F.round(F.floor(value / step + 1e-12) * step, 10)


def lot_for_stop(entry: Column, stop: Column, preferred_risk: Column, hard_risk: Column, max_lot: Column, contract: float = 1.0, lot_min: float = 0.01, lot_max: float = 100.0, lot_step: float = 0.01) -> Column:
    """Lot that risks the preferred amount, floored to the step; the least lot if its risk is within the hard cap; null if infeasible."""
    per_lot = F.nullif(F.abs(entry - stop), F.lit(0.0)) * contract
    cap = F.least(max_lot, F.lit(lot_max))
    wanted = floor_to_step(F.least(preferred_risk / per_lot, cap), lot_step)
    lot = floor_to_step(F.least(F.when(preferred_risk / per_lot < lot_min, F.lit(lot_min)).otherwise(F.greatest(wanted, F.lit(lot_min))), cap), lot_step)
    return F.when((per_lot > 0) & (cap >= lot_min) & (lot >= lot_min) & (per_lot * lot <= hard_risk + 1e-12), lot)
