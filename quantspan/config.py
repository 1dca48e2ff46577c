"""Settings of a simulation: immutable, passed explicitly, never read from the session."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Costs:
    """Percentages as a trader states them; ``account`` and ``position`` in dollars."""

    account: float = 100_000.0
    position: float = 2_500.0
    fee_pct: float = 0.02
    slippage_pct: float = 0.03
    funding_pct: float = 0.01
    stop_pct: float = 1.0
    target_pct: float = 3.0
    use_stop: bool = True
    use_target: bool = True
    clamp: bool = False
    max_hold: int = 0
    mute_bars: int = 0
    #: Set for currency pairs: stops and targets are pips, results are multiples of the risk taken.
    pip: float = 0.0

    @classmethod
    def forex(cls, pip: float = 0.0001, **changes) -> Costs:
        return cls(account=1.0, position=1.0, funding_pct=0.0, pip=pip).with_(**changes)

    @property
    def fee(self) -> float:
        return self.fee_pct / 100

    @property
    def slip(self) -> float:
        return self.slippage_pct * (self.pip or 0.01)

    @property
    def funding(self) -> float:
        return self.funding_pct / 100

    def with_(self, **changes) -> Costs:
        return replace(self, **changes)


#: Of each robustness flag, its label and the names it goes by.
SCENARIO_FLAGS = {
    "fee": ("FEE", ("fee_shock", "fee", "fees")),
    "slippage": ("SLI", ("slippage_shock", "slippage", "slip")),
    "news": ("NWS", ("news_candles_injection", "news")),
    "drift": ("ENT", ("entry_drift", "drift")),
    "variance": ("IND", ("indicator_variance", "variance", "lb_variance")),
}
#: Weights of the five segments of the consistency score, oldest first.
SEGMENT_WEIGHTS = (0.0117, 0.0317, 0.0861, 0.2341, 0.6364)
