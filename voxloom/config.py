"""Parameters of a run, from the environment or as given."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Defaults that the operators share; an environment variable VOXLOOM_<NAME> sets another."""

    threshold: float = 0.8
    temperature: float = 0.1
    seed: int = 42
    batch_size: int = 150
    split_share: float = 0.1
    histogram_scale: float = 1.0

    @classmethod
    def load(cls, environment: Mapping[str, str] | None = None, **given) -> Settings:
        env = os.environ if environment is None else environment
        found = {f.name: type(f.default)(env[k]) for f in fields(cls) if (k := f"VOXLOOM_{f.name.upper()}") in env}
        return cls(**(found | {k: v for k, v in given.items() if v is not None}))
