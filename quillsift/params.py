"""Parameters of scoring and tokenizing, their file form and their checks."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

# The parameters' defaults are the dataclass's; these are the bounds outside which a value is refused.
BOUNDS = {
    "strength": (0.0, 100.0),
    "unknown_prob": (0.0, 1.0),
    "max_interesting": (1, 10_000),
    "threshold": (0.0, 1.0),
    "good_bias": (0.0, 100.0),  # 0 itself is refused
    "min_word_count": (0, 1_000_000),
    "new_word_score": (0.0, 1.0),
    "min_distance": (0.0, 0.5),
    "min_array_size": (0, 10_000),
    "train_max_reps": (1, 25),
    "rail_min_spam": (1, 1_000_000),
    "rail_strong_spam": (1, 1_000_000),
    "rail_floor": (0.5, 1.0),
}
COMBINERS = {"fisher": "fisher", "geometric": "geometric", "geo": "geometric", "robinson": "geometric"}
TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}
#: What the tuner writes; every other line of a file is left as it is.
MANAGED = ("strength", "unknown_prob", "max_interesting", "threshold", "good_bias", "min_word_count")
GATE = 0.2


@dataclass(frozen=True)
class ScoreParams:
    strength: float = 1.0
    unknown_prob: float = 0.5
    max_interesting: int = 150
    threshold: float = 0.5
    good_bias: float = 1.0
    min_word_count: int = 0
    combine_mode: str = "fisher"
    new_word_score: float = 0.5
    min_distance: float = 0.0
    min_array_size: int = 0
    train_max_reps: int = 1
    rail: bool = False
    rail_min_spam: int = 2
    rail_strong_spam: int = 15
    rail_floor: float = 0.95
    rail_require_coflag: bool = True


@dataclass(frozen=True)
class TokenizerConfig:
    min_len: int = 3
    max_len: int = 40
    expanded_headers: bool = False
    tld_feature: bool = False
    homoglyph_fold: bool = False
    brand_mismatch: bool = False
    auth_tokens: bool = False
    #: Raw body tokens of a message that are taken, before duplicates are dropped; None takes all.
    max_raw_tokens: int | None = 50_000

    @staticmethod
    def from_env(get: Callable[[str], str | None] = os.environ.get, prefix: str = "QUILLSIFT_") -> TokenizerConfig:
        """Switches from the environment: ``1`` or ``true`` turns one on."""
        names = {"EXPANDED_HEADERS": "expanded_headers", "TLD": "tld_feature", "FOLD": "homoglyph_fold", "BRAND": "brand_mismatch", "AUTH": "auth_tokens"}
        return TokenizerConfig(**{f: True for k, f in names.items() if (get(prefix + k) or "").lower() in ("1", "true")})


def _value(name: str, text: str):
    """The value of a parameter, or a reason against it."""
    if name == "combine_mode":
        return COMBINERS.get(text.strip("\"'").lower()), "unknown combiner"
    if name in ("rail", "rail_require_coflag"):
        t = text.strip("\"'").lower()
        return (True if t in TRUE else False if t in FALSE else None), "not a truth value"
    kind = {f.name: type(f.default) for f in fields(ScoreParams)}[name]
    try:
        v = kind(text)
    except ValueError:
        return None, "not a number"
    low, high = BOUNDS[name]
    if not low <= v <= high or (name == "good_bias" and v <= 0):
        return None, "out of range"
    return v, ""


def read_params(text: str, base: ScoreParams | None = None, warn: Callable[[str], None] = warnings.warn) -> ScoreParams:
    """Parameters from ``key = value`` lines. A value out of range is refused with a warning and the default kept."""
    out = base or ScoreParams()
    for no, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        key, eq, value = (x.strip() for x in line.partition("="))
        if not eq:
            warn(f"line {no}: no value: {raw!r}")
        elif key not in ScoreParams.__dataclass_fields__:
            warn(f"line {no}: unknown key {key!r}")
        else:
            v, why = _value(key, value)
            if v is None:
                warn(f"line {no}: {key}: {why}: {value!r}")
            else:
                out = replace(out, **{key: v})
    return out


def write_params(text: str, params: ScoreParams) -> str:
    """``text`` with the managed keys set in place, those missing at the end and every other line kept."""
    lines, left = [], list(MANAGED)
    for raw in text.splitlines():
        key = raw.split("#", 1)[0].partition("=")[0].strip()
        if key in MANAGED and "=" in raw.split("#", 1)[0]:
            raw = f"{key} = {getattr(params, key):g}"
            if key in left:
                left.remove(key)
        lines.append(raw)
    if not text.strip():
        lines = ["# parameters written by the tuner"]
    lines += [f"{k} = {getattr(params, k):g}" for k in left]
    return "\n".join(lines) + "\n"


def resolve_threshold(file: ScoreParams | None = None, env: str | None = None, flag: float | None = None) -> float:
    """Default, then environment, then file, then flag: the later wins."""
    t = ScoreParams().threshold
    if env:
        try:
            t = float(env) if 0 <= float(env) <= 1 else t
        except ValueError:
            pass
    if file is not None:
        t = file.threshold
    return flag if flag is not None else t
