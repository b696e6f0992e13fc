"""Configuration from JSON: one table says which keys there are, of what type, and what must hold."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from pathlib import Path
from types import MappingProxyType
from typing import Any


class ConfigError(ValueError):
    pass


def _number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _whole(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _yes_no(v: Any) -> bool:
    return isinstance(v, bool)


def _text(v: Any) -> bool:
    return isinstance(v, str)


def _text_or_none(v: Any) -> bool:
    return v is None or isinstance(v, str)


def _always(_: Any) -> bool:
    return True


#: Key to (type, what its value must satisfy). The names are those of the JSON format.
KEYS: dict[str, tuple[Callable[[Any], bool], Callable[[Any], bool]]] = {
    "indicators.sma_fast_window": (_whole, lambda v: v > 0),
    "indicators.sma_slow_window": (_whole, lambda v: v > 0),
    "indicators.sma_trend_filter": (_yes_no, _always),
    "indicators.support_resistance_window": (_whole, lambda v: v > 0),
    "indicators.wavelet_mode_count": (_whole, lambda v: v > 0),
    "indicators.wavelet_signal_mode": (_whole, lambda v: v >= 0),
    "indicators.wavelet_threshold": (_number, lambda v: v >= 0),
    "indicators.wavelet_window_size": (_whole, lambda v: v > 0),
    "system.account": (_text_or_none, _always),
    "system.client_id": (_whole, _always),
    "system.host": (_text, _always),
    "system.paper_only": (_yes_no, lambda v: v),
    "system.port": (_whole, lambda v: 0 < v < 1 << 16),
    "system.submit_orders": (_yes_no, lambda v: not v),
    "trading_rules.allow_odd_lots": (_yes_no, _always),
    "trading_rules.max_break_even_bps": (_number, lambda v: v >= 0),
    "trading_rules.order_slippage_bps": (_number, lambda v: v >= 0),
    "trading_rules.reference_turnover": (_number, lambda v: v > 0),
    "trading_rules.stop_loss_pct": (_number, lambda v: 0 < v < 1),
    "trading_rules.unit_shares": (_whole, lambda v: v > 0),
}
#: What must hold between two keys, the first being the lesser; and whether they may be equal.
ORDER = [("sma_fast_window", "sma_slow_window", False), ("wavelet_mode_count", "wavelet_window_size", True), ("wavelet_signal_mode", "wavelet_mode_count", False)]
#: Sections whose keys are free.
FREE = {"risk", "data_store", "orchestration"}


def _checked(raw: Any) -> Mapping[str, Any]:
    """The sections, read-only; every fault at once is an error."""
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be an object")
    sections = {k.partition(".")[0] for k in KEYS} | FREE
    faults = [f"{k}: unknown or missing section" for k in sorted((set(raw) ^ sections) - {"schema_version"})]
    faults += ["schema_version: missing"] * ("schema_version" not in raw)
    faults += [f"{k}: must be an object" for k in sorted(sections & set(raw)) if not isinstance(raw[k], dict)]
    if faults:
        raise ConfigError("; ".join(faults))
    given = {f"{s}.{k}": v for s in sections - FREE for k, v in raw[s].items()}
    faults = [f"{k}: unknown or missing" for k in sorted(set(given) ^ set(KEYS))]
    faults += [f"{k}: {v!r} is not allowed" for k, v in sorted(given.items()) if k in KEYS and not (KEYS[k][0](v) and KEYS[k][1](v))]
    if not faults:
        for low, high, equal in ORDER:
            a, b = given[f"indicators.{low}"], given[f"indicators.{high}"]
            faults += [f"indicators.{low}: must be less than {high}"] * (not (a < b or equal and a == b))
    if faults:
        raise ConfigError("; ".join(faults))
    return MappingProxyType({k: MappingProxyType(v) if isinstance(v, dict) else v for k, v in raw.items()})


class Config:
    """Settings by dotted path."""

    def __init__(self, raw: Any):
        self._values = _checked(raw)

    def get(self, path: str, *default: Any) -> Any:
        """A value; without a default, a missing one is an error."""
        at: Any = self._values
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                if default:
                    return default[0]
                raise ConfigError(f"no setting {path}")
            at = at[part]
        return at


def load(path: str | Path) -> Config:
    return Config(json.loads(Path(path).read_text()))
