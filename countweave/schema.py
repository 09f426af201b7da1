"""Column roles and settings of a binned-count model."""

from __future__ import annotations

import sys
import warnings
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_COLUMNS = ("count", "bin", "parent", "child", "ran")
NO_RANDOM_EFFECT = "none"
REFERENCE = "ref"
#: The level of rows that name none.
MISSING_LEVEL = "NA"
#: Names of the library's own columns; fixed effects so called are stored with the prefix below.
OWN_COLUMNS = frozenset(("treatment", "replicate", "total", "n_tokens", "count_log", "observed", "pred", "pred_log", "level",
                         "factor", "effect", "sign", "component", "k", "name", "value", "kind", "draw_id", "param_idx"))
EFFECT_PREFIX = "fx_"
COMPONENTS = ("Rt", "tslope", "tpoint")
WARPS = ("point", "rate", "slope")


@dataclass(frozen=True)
class Variables:
    """Which user column plays which role.

    ``fixed_effects`` left empty means "every column not named otherwise".
    ``token_id`` names a column that identifies one observation; only the
    bootstrap needs it.
    """

    count: str = "count"
    bin: str = "bin"
    parent: str = "parent"
    child: str = "child"
    ran: str = "ran"
    fixed_effects: tuple[str, ...] = ()
    token_id: str | None = None

    @classmethod
    def from_dict(cls, named: dict) -> "Variables":
        known = [f.name for f in fields(cls)]
        unknown = sorted(set(named) - set(known))
        if unknown:
            raise ValueError(f"unknown variable roles {unknown}; allowed: {known}")
        named = dict(named)
        if "fixed_effects" in named:
            named["fixed_effects"] = tuple(named["fixed_effects"])
        return cls(**named)

    def fixed_effects_of(self, columns: list[str]) -> list[str]:
        """Fixed-effect columns in the order they have in the data."""
        used = {self.count, self.bin, self.parent, self.child, self.ran, self.token_id}
        if self.fixed_effects:
            missing = [c for c in self.fixed_effects if c not in columns]
            if missing:
                raise ValueError(f"fixed-effect columns not found: {missing}")
            return [c for c in columns if c in self.fixed_effects]
        return [c for c in columns if c not in used]


def select_model_columns(df: DataFrame, variables: Variables | dict | None = None) -> DataFrame:
    """Rename and order user columns: the five roles, the fixed effects, the token id."""
    if variables is None:
        variables = Variables()
    elif isinstance(variables, dict):
        variables = Variables.from_dict(variables)
    roles = [(getattr(variables, role), role) for role in MODEL_COLUMNS]
    missing = [user for user, _ in roles if user not in df.columns]
    if variables.token_id is not None and variables.token_id not in df.columns:
        missing.append(variables.token_id)
    if missing:
        raise ValueError(f"columns not found: {missing}")
    effects = variables.fixed_effects_of(df.columns)
    if not effects:
        raise ValueError("no fixed effects found")
    clash = [c for c in effects if c in MODEL_COLUMNS or c == "token_id"]
    if clash:
        raise ValueError(f"fixed-effect columns carry reserved names: {clash}")
    casts = {"count": "double", "bin": "int", "parent": "string", "child": "string", "ran": "string"}
    chosen = [F.col(user).cast(casts[role]).alias(role) for user, role in roles]
    stored = [stored_effect(c) for c in effects]
    twice = sorted({c for c in stored if stored.count(c) > 1})
    if twice:
        raise ValueError(f"fixed-effect columns whose stored names coincide: {twice}")
    chosen += [F.col(c).cast("string").alias(s) for c, s in zip(effects, stored)]
    if variables.token_id is not None:
        chosen.append(F.col(variables.token_id).alias("token_id"))
    return name_missing(df.select(*chosen), stored)


def stored_effect(column: str) -> str:
    """The name a fixed effect has in the library's tables."""
    return EFFECT_PREFIX + column if column in OWN_COLUMNS else column


def name_missing(tokens: DataFrame, effects: list[str]) -> DataFrame:
    """Groups and effects that are NULL become a level of their own, so no token is lost or counted twice."""
    grouped = {"parent", "child", "ran", *effects}
    return tokens.select(*[F.coalesce(c, F.lit(MISSING_LEVEL)).alias(c) if c in grouped else F.col(c) for c in tokens.columns])


def fixed_effects_in(tokens: DataFrame) -> list[str]:
    """Fixed effects of a frame made by :func:`select_model_columns`."""
    return [c for c in tokens.columns if c not in MODEL_COLUMNS and c != "token_id"]


def require_model_columns(tokens: DataFrame) -> list[str]:
    """Check the five leading columns and at least one fixed effect; return the effects."""
    for place, name in enumerate(MODEL_COLUMNS):
        if place >= len(tokens.columns) or tokens.columns[place] != name:
            raise ValueError(f"missing or misplaced column: {name}")
    effects = fixed_effects_in(tokens)
    if not effects:
        raise ValueError("no fixed effects found")
    return effects


@dataclass(frozen=True)
class ModelSettings:
    # Documented defaults of the model.
    buffer_factor: float = 0.05
    ctol: float = 1e-6
    max_penalty_at_distance_factor: float = 0.01
    cutoff: float = 2.0
    window_factor: float = 1.25
    rise_threshold_factor: float = 0.8
    max_evals: int = 1000
    rng_seed: int = 42
    warp_precision: float = 1e-7
    min_initial_slope: float = field(default=0.25)

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise TypeError(f"{f.name} must be a number")
            if not value > 0:
                raise ValueError(f"{f.name} must be positive")
            if f.type == "int":
                object.__setattr__(self, f.name, int(value))
        if not self.buffer_factor < 1:
            raise ValueError("buffer_factor must be between 0 and 1")
        for name in ("ctol", "max_penalty_at_distance_factor", "rise_threshold_factor", "warp_precision"):
            if getattr(self, name) > 1:
                warnings.warn(f"{name} should be less than 1", stacklevel=3)

    @classmethod
    def from_dict(cls, named: dict) -> "ModelSettings":
        return _from_dict(cls, named)

    @property
    def unbounded(self) -> float:
        """Stand-in for infinity when warping a value that has no upper bound."""
        return self.warp_precision / sys.float_info.epsilon

    def window(self, n_bins: int) -> int:
        """Running-window length; halves round away from zero."""
        return int(self.window_factor * n_bins * self.buffer_factor + 0.5)

    def buffer(self, n_bins: int) -> float:
        return n_bins * self.buffer_factor


@dataclass(frozen=True)
class ChainSettings:
    # Documented defaults of the draw chain.
    burnin: int = 0
    steps: int = 1000
    step_size: float = 1.0
    prior: float = 1.0
    neighbor_filter: int = 2

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise TypeError(f"{f.name} must be a number")
            if not value >= 0:
                raise ValueError(f"{f.name} must be >= 0")
        if self.steps < 100:
            warnings.warn("steps should be at least 100", stacklevel=3)
        if self.step_size >= 2.0:
            warnings.warn("consider a step_size below 2.0", stacklevel=3)

    @classmethod
    def from_dict(cls, named: dict) -> "ChainSettings":
        return _from_dict(cls, named)


def _from_dict(cls, named: dict):
    if not isinstance(named, dict):
        raise TypeError("settings must be a dict")
    known = [f.name for f in fields(cls)]
    unknown = sorted(set(named) - set(known))
    if unknown:
        raise ValueError(f"unknown settings {unknown}; allowed: {known}")
    return cls(**named)
