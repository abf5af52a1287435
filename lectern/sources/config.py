"""Configuration as a nested mapping, its rows, overrides and checks."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load(path: str) -> dict:
    import yaml

    got = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(got, Mapping):
        raise ValueError(f"{path} must hold a mapping")
    return dict(got)


def typed(value: str) -> Any:
    import yaml

    return yaml.safe_load(value)


def overrides(args: list[str]) -> dict[str, Any]:
    """``--a.b=value`` arguments as dotted keys with typed values."""
    out = {}
    for a in args:
        m = re.fullmatch(r"--([^=\s]+)=(.*)", a, re.S)
        if not m:
            raise ValueError(f"not an override: {a}")
        out[m[1]] = typed(m[2])
    return out


def require(config: Mapping, section: str, keys: list[str]) -> Mapping:
    part = config.get(section)
    if not isinstance(part, Mapping):
        raise ValueError(f"section {section} is missing")
    if missing := [k for k in keys if k not in part]:
        raise ValueError(f"{section} lacks {', '.join(missing)}")
    return part


def check_split(test: float, train: float, evaluation: float) -> None:
    if not all(0 <= x <= 1 for x in (test, train, evaluation)) or abs(test + train + evaluation - 1) > 1e-6:
        raise ValueError("split shares must lie in 0 to 1 and sum to 1")


# The settings that must be there, by section, and those of training that every method needs.
REQUIRED = {
    "global": ["model_name", "train_data_path", "max_length", "train_size", "eval_size", "test_size", "seed", "output_dir", "tensorboard_logdir", "logging_steps", "test_eval_epochs", "save_steps", "save_total_limit"],
    "LoRA": ["rank", "alpha", "scaling_type", "dropout_rate", "target_modules", "init_lora_weights"],
    "PrefixFT": ["num_virtual_tokens", "prefix_projection", "init_weights"],
    "AdapterFinetuning": ["target_modules", "adapter_len", "adapter_layers"],
}
TRAINING = ["num_epochs", "batch_size", "gradient_accumulation_steps", "learning_rate"]
#: Settings with the range their number must lie in: section, key, least, whether the least itself is allowed, most.
RANGES = [
    ("global", "test_eval_epochs", 0, True, None), ("global", "train_size", 0, False, 1), ("global", "eval_size", 0, False, 1), ("global", "test_size", 0, True, 1),
    ("LoRA", "rank", 0, False, None), ("LoRA", "alpha", 0, False, None), ("LoRA", "dropout_rate", 0, True, None),
    ("PrefixFT", "num_virtual_tokens", 0, False, None), ("AdapterFinetuning", "adapter_len", 0, False, None), ("AdapterFinetuning", "adapter_layers", 0, False, None),
    *[(s, k, 1, True, None) for s in ("LoRA", "PrefixFT", "AdapterFinetuning") for k in TRAINING[:3]], *[(s, TRAINING[3], 0, False, None) for s in ("LoRA", "PrefixFT", "AdapterFinetuning")],
]
SIDES = {"": None, "all": None, "none": None, "input": 1, "front": 1, "first": 1, "output": 1, "back": 1, "last": 1}


def problems(config: Mapping) -> list[str]:
    """Everything that is wrong with a training configuration, in order; empty for a valid one."""
    out = []
    for section, keys in REQUIRED.items():
        part = config.get(section)
        if not isinstance(part, Mapping):
            out.append(f"section {section} is missing")
            continue
        out += [f"{section}.{k} is missing" for k in keys + (TRAINING if section != "global" else []) if k not in part]
    value = lambda s, k: config[s][k] if isinstance(config.get(s), Mapping) and k in config[s] else None
    for section, k, least, closed, most in RANGES:
        if (x := value(section, k)) is None:
            continue
        try:
            x = float(x)
        except (TypeError, ValueError):
            out.append(f"{section}.{k} must be a number")
            continue
        if x < least or (x == least and not closed) or (most is not None and x > most):
            out.append(f"{section}.{k} is out of range")
    shares = [value("global", k) for k in ("test_size", "train_size", "eval_size")]
    try:
        if None not in shares:
            check_split(*map(float, shares))
    except (TypeError, ValueError):
        out.append("the split shares must sum to 1")
    if (x := value("LoRA", "dropout_rate")) is not None and _number(x, 0) >= 1:
        out.append("LoRA.dropout_rate must be under 1")
    modules = value("LoRA", "target_modules")
    if modules is not None and (not isinstance(modules, list) or not modules or any(not str(m).strip() for m in modules)):
        out.append("LoRA.target_modules must be a list of names")
    if (x := value("LoRA", "scaling_type")) is not None and str(x) not in ("r/a", "r/sqrta"):
        out.append("LoRA.scaling_type must be r/a or r/sqrta")
    if (x := value("AdapterFinetuning", "target_modules")) is not None and not str(x).strip():
        out.append("AdapterFinetuning.target_modules must not be blank")
    side, count = str(value("LoRA", "target_layer_side") or "all").strip().lower(), value("LoRA", "target_layer_count")
    count = _number(0 if count in (None, "") else count, -1)
    if side not in SIDES:
        out.append("LoRA.target_layer_side must be all, input or output")
    elif count < 0 or count != int(count) or (SIDES[side] is None) != (count == 0):
        out.append("LoRA.target_layer_count does not fit the side")
    return out


def _number(x: Any, otherwise: float) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return otherwise


def check(config: Mapping, method: str) -> None:
    found = problems(config)
    if method not in REQUIRED or method == "global":
        found.append(f"unknown method {method}")
    if found:
        raise ValueError("; ".join(found))


def check_columns(df: DataFrame, *names: str) -> None:
    """An error that names the columns a data set lacks and those it has."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def resolved(value: str | None, folder: str) -> str | None:
    """A path as an absolute one, relative ones counting from the configuration's folder."""
    if value is None:
        return None
    p = Path(str(value)).expanduser()
    return str((p if p.is_absolute() else Path(folder) / p).resolve())


def model_path(name: str, folder: str, models: str) -> str:
    """The folder of a model: as given, else below the configuration's folder, else below that of all models."""
    p = Path(name).expanduser()
    places = [p] if p.is_absolute() else [Path(folder) / p, Path(models) / name]
    for x in places:
        if x.is_dir():
            return str(x.resolve())
    raise FileNotFoundError(f"no model folder at {', '.join(map(str, places))}")


def check_thresholds(qa_lower: float | None = None, qq_upper: float | None = None, score: int | None = None, length: int | None = None) -> None:
    for name, x in (("qa_lower", qa_lower), ("qq_upper", qq_upper)):
        if x is not None and not 0 <= x <= 1:
            raise ValueError(f"{name} must lie in 0 to 1")
    if score is not None and (score != int(score) or not 0 <= score <= 5):
        raise ValueError("score must be a whole number of 0 to 5")
    if length is not None and length <= 0:
        raise ValueError("length must be positive")


def flat(config: Mapping, prefix: str = "") -> list[tuple[str, str | None]]:
    out: list[tuple[str, str | None]] = []
    for k, v in config.items():
        out += flat(v, f"{prefix}{k}.") if isinstance(v, Mapping) else [(f"{prefix}{k}", None if v is None else str(v))]
    return out


def overridden(config: DataFrame, changes: DataFrame) -> DataFrame:
    """(key_path, value): update-only merge; :func:`unknown_keys` holds the changes without a target."""
    new = changes.select("key_path", F.col("value").alias("__new"), F.lit(True).alias("__set"))
    return config.join(new, "key_path", "left").select("key_path", F.when(F.col("__set"), F.col("__new")).otherwise(F.col("value")).alias("value"))


def unknown_keys(config: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(config, "key_path", "left_anti")


def nearest_config(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config): the configuration file in the nearest folder above each path, matched by folder, not by scanning pairs."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = paths.select("path", F.explode(up).alias("folder"))
    found = configs.select(F.col("path").alias("config"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    return above.join(found, "folder").groupBy("path").agg(F.max_by("config", F.length("folder")).alias("config"))
