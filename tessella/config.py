"""Typed configuration, read from YAML or given as mappings.

A record declares its fields with the checks that their values have to pass; `Checked` runs them for every record, however it was made.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path
from typing import Any

# Names that files of configuration use (fixed values).
POOLS = ("patch_score_max", "raw_feature_max", "raw_feature_mean", "raw_feature_mean_max")
NORMALISATIONS = ("none", "row_zscore", "row_l2")
TASKS = ("single-label", "multi-label", "retrieval")

#: A check says what is wrong with a value, or None.
Check = Callable[[Any], str | None]


def one_of(*allowed: Any) -> Check:
    return lambda v: None if v in allowed else f"{v!r} is none of {', '.join(map(str, allowed))}"


def within(low: float, high: float = math.inf) -> Check:
    def check(v: Any) -> str | None:
        values = v if isinstance(v, tuple) else (v,)
        return None if all(math.isfinite(x) and low <= x <= high for x in values) else f"has to be finite and in [{low}, {high}]"

    return check


def some(v: Any) -> str | None:
    return None if v else "must not be empty"


def unique(v: Sequence[Any]) -> str | None:
    return None if len(set(v)) == len(v) else "has repeated values"


def mapping(v: Any) -> str | None:
    return None if isinstance(v, Mapping) else "has to be a mapping"


def value(*checks: Check, key: str | None = None, make: Callable[[Any], Any] = lambda v: v, default: Any = MISSING) -> Any:
    """A field of a record: its checks, its key in a file where that isn't its name, and what makes its value of that in the file."""
    kinds = {} if default is MISSING else {"default_factory": (lambda: default)}
    return field(metadata={"checks": checks, "key": key, "make": make}, **kinds)


class Checked:
    """A record whose fields are checked; problems() adds what takes several of them."""

    def __post_init__(self):
        for f in fields(self):
            for check in f.metadata.get("checks", ()):
                if problem := check(getattr(self, f.name)):
                    raise ValueError(f"{type(self).__name__}: {f.name} {problem}")
        for problem in self.problems():
            raise ValueError(f"{type(self).__name__}: {problem}")

    def problems(self) -> Iterator[str]:
        return iter(())

    @classmethod
    def of(cls, raw: Mapping[str, Any], **known: Any):
        """The record in a mapping; keys that it doesn't know are left alone, those without a default must be there. known: fields that don't come from the file."""
        found, missing = dict(known), []
        for f in fields(cls):
            key = f.metadata.get("key") or f.name
            if f.name in found:
                continue
            if raw.get(key) is not None:
                found[f.name] = f.metadata.get("make", lambda v: v)(raw[key])
            elif f.default is MISSING and f.default_factory is MISSING:
                missing.append(key)
        if missing:
            raise ValueError(f"{cls.__name__} lacks {', '.join(missing)}")
        return cls(**found)


def read_yaml(path: str | Path) -> dict[str, Any]:
    import yaml  # only needed here

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if problem := mapping(raw):
        raise ValueError(f"{path} {problem}")
    return raw


@dataclass(frozen=True)
class DataProfile(Checked):
    """Classes, regions and settings of a data set."""

    name: str
    classes: tuple[str, ...] = value(some, unique, make=tuple)
    regions: Mapping[str, Mapping[str, Any]] = value(mapping, some)
    split: Mapping[str, Any] = value(mapping)
    features: Mapping[str, Any] = value(mapping, key="osm")
    imagery: Mapping[str, Any] = value(mapping)
    schema_version: int = value(one_of(1), make=int)

    def problems(self) -> Iterator[str]:
        if unknown := sorted({r for rs in self.splits().values() for r in rs} - set(self.regions)):
            yield f"split names unknown regions {unknown}"

    @staticmethod
    def load(path: str | Path) -> DataProfile:
        return DataProfile.of(read_yaml(path))

    def region(self, name: str) -> Mapping[str, Any]:
        return self.regions[self.select([name])[0]]

    def select(self, requested: Sequence[str] | None) -> list[str]:
        """The regions in a list of names and of names between commas, in that order, repeats included; all regions where none is asked for."""
        if not requested:
            return list(self.regions)
        wanted = [name for name in (part.strip() for part in ",".join(map(str, requested)).split(",")) if name]
        for name in wanted:
            if name not in self.regions:
                raise ValueError(f"unknown region {name}")
        return wanted

    def splits(self) -> dict[str, list[str]]:
        return {k: list(self.split.get(f"{k}_regions", ())) for k in ("train", "valid", "test")}


@dataclass(frozen=True)
class FusionConfig(Checked):
    """How two score groups are fused."""

    input_group: str
    output_group: str
    pool: str = value(one_of(*POOLS), default="raw_feature_max")
    normalisation: str = value(one_of(*NORMALISATIONS), default="row_zscore")
    weight: float = value(within(0, 1), default=0.0)


@dataclass(frozen=True)
class EvaluationConfig(Checked):
    """A zero-shot or transfer evaluation: classes, prompts, budget, paths (relative ones against the folder above the file's)."""

    root: Path
    classes: tuple[str, ...] = value(some, unique, make=tuple)
    task: str = value(one_of(*TASKS))
    templates: tuple[str, ...] = value(make=tuple, default=())
    topk: int = value(within(0, 100), make=int, default=12)
    residual_gain: float = value(within(-math.inf), make=float, default=0.075)
    samples: int | None = None
    fusion: FusionConfig | None = value(make=lambda raw: FusionConfig(**raw), default=None)
    paths: Mapping[str, str | Path] = value(mapping, default={})

    @staticmethod
    def load(path: str | Path) -> EvaluationConfig:
        at = Path(path).expanduser().resolve()
        return EvaluationConfig.of(read_yaml(at), root=at.parent.parent)

    def path(self, name: str) -> Path:
        return (self.root / Path(self.paths[name]).expanduser()).resolve()


def _floats(v: Sequence[Any]) -> tuple[float, ...]:
    return tuple(map(float, v))


@dataclass(frozen=True)
class RobustStatistics(Checked):
    """Parameters and per-class statistics of the robust tail fusion."""

    classes: tuple[str, ...] = value(make=tuple, key="class_names")
    hr_mad: tuple[float, ...] = value(within(-math.inf), make=_floats)
    lr_median: tuple[float, ...] = value(within(-math.inf), make=_floats)
    lr_mad: tuple[float, ...] = value(within(-math.inf), make=_floats)
    positive: float = value(within(0), make=float, key="positive_weight")
    negative: float = value(within(0), make=float, key="negative_weight")
    threshold: float = value(within(0), make=float, key="tail_threshold")
    pooling: str = "mean"

    def problems(self) -> Iterator[str]:
        if {len(self.hr_mad), len(self.lr_median), len(self.lr_mad)} != {len(self.classes)}:
            yield "one number for each class is needed"

    @staticmethod
    def load(path: str | Path) -> RobustStatistics:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        if problem := one_of("robust_mad_tail")(raw.get("method")):
            raise ValueError(f"method {problem}")
        return RobustStatistics.of(raw | raw["statistics"])

    def table(self, spark):
        """(class_id, hr_mad, lr_median, lr_mad): one row per class, so it may be broadcast."""
        return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(self.hr_mad, self.lr_median, self.lr_mad, strict=True))], "class_id int, hr_mad double, lr_median double, lr_mad double")


@dataclass(frozen=True)
class Policy(Checked):
    """How many tiles to observe for each class."""

    classes: tuple[str, ...]
    counts: tuple[int, ...] = value(within(0, 100))
    default: int = value(within(0, 100), default=12)

    def problems(self) -> Iterator[str]:
        if len(self.classes) != len(self.counts):
            yield "one count for each class is needed"

    @staticmethod
    def of(raw: Mapping[str, Any], classes: Sequence[str]) -> Policy:
        """From {per_class: [{name, Pc}], default_pc}; the order of classes is part of it."""
        names = tuple(r["name"] for r in raw["per_class"])
        if names != tuple(classes):
            raise ValueError("the policy has other classes, or another order")
        return Policy(names, tuple(int(r["Pc"]) for r in raw["per_class"]), int(raw.get("default_pc", 12)))

    def resolve(self, query: int | str) -> int:
        """The count of a class by number, where it has to be one, or by name, where an unknown one gets the default."""
        if isinstance(query, str):
            return dict(zip(self.classes, self.counts, strict=True)).get(query, self.default)
        if query not in range(len(self.counts)):
            raise ValueError(f"class {query} is out of range")
        return self.counts[query]

    @property
    def ratio(self) -> float:
        return sum(self.counts) / (100 * len(self.counts))

    def table(self, spark):
        return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(zip(self.classes, self.counts, strict=True))], "class_id int, name string, pc int")
