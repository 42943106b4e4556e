"""Settings with defaults and bounds; a value below 1 means the default."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: name: (default, least, most); times in seconds
BOUNDS = {
    "concurrent_keys": (250, 1, 5000),
    "per_key_buffer": (16, 1, 64),
    "poll_timeout": (0.1, 0.02, 2),
    "auto_commit_interval": (5, 0.25, 15),
    "drain_timeout": (20, 2, 55),
    "await_assignments_timeout": (50, 5, 300),
    "acquire_timeout": (60, 15, 900),
    "worker_shards": (16, 2, 64),
}
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


def seconds(text: str | float) -> float:
    """Seconds of texts like 1m30s or 250ms."""
    if isinstance(text, int | float):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


@dataclass(frozen=True)
class Config:
    concurrent_keys: int = 0
    per_key_buffer: int = 0
    poll_timeout: float | str = 0
    auto_commit_interval: float | str = 0
    drain_timeout: float | str = 0
    await_assignments_timeout: float | str = 0
    acquire_timeout: float | str = 0
    worker_shards: int = 0
    validate: bool = True

    def __post_init__(self) -> None:
        for name, (default, least, most) in BOUNDS.items():
            value = getattr(self, name)
            value = seconds(value) if isinstance(value, str) else value
            value = default if value <= 0 or isinstance(default, int) and name in ("concurrent_keys", "per_key_buffer", "worker_shards") and value < 1 else value
            if self.validate and not least <= value <= most:
                raise ValueError(f"{name} = {value} is outside {least} to {most}")
            object.__setattr__(self, name, value)
        n = self.worker_shards
        if n < 2 or n & (n - 1):  # never optional: the shard index is a mask
            raise ValueError("worker_shards is a power of two, 2 or more")

    def trigger(self) -> str:
        return f"{int(self.auto_commit_interval * 1000)} milliseconds"
