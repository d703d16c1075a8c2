"""Settings, verticals, rubric and source policies from YAML files; values that are not given have defaults."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError
from .functions.vocabulary import BANDS, FEATURES, RIGHT_NAMES, WEIGHTS

EFFORTS = ("low", "medium", "high", "xhigh", "max")


@dataclass(frozen=True)
class Settings:
    """What a run may vary; `load` reads a file of sections and then the environment."""

    language: str = "en"
    results_per_query: int = 10
    provider: str = "local"
    model: str = ""
    effort: str = "high"
    claims_per_run: int = 24
    claims_per_batch: int = 6
    embedding_batch: int = 16
    embedding_dim: int = 1024
    semantic_threshold: float = 0.97
    cluster_threshold: float = 0.72
    dense_clusters: bool = False
    use_model_claims: bool = True
    sources: tuple[str, ...] = ("searxng",)
    reports_dir: str = "reports"
    ideas_dir: str = "ideas"

    def __post_init__(self):
        if self.effort not in EFFORTS:
            raise ConfigError(f"effort is one of {', '.join(EFFORTS)}, not {self.effort!r}")
        if not 1 <= self.results_per_query <= 30:
            raise ConfigError(f"results_per_query lies between 1 and 30, not at {self.results_per_query}")
        for name in ("semantic_threshold", "cluster_threshold"):
            if not 0 < getattr(self, name) <= 1:
                raise ConfigError(f"{name} lies between 0 and 1, not at {getattr(self, name)}")

    @classmethod
    def load(cls, path: str | None = None, env: Mapping[str, str] = os.environ, prefix: str = "OREMILL_") -> "Settings":
        """Fields by name, in any section of the file; then OREMILL_<FIELD> of the environment, which goes before."""
        given = {k: x for section in (_yaml(path) if path else {}).values() if isinstance(section, dict) for k, x in section.items()}
        values = {}
        for f in dataclasses.fields(cls):
            raw = env.get(prefix + f.name.upper(), given.get(f.name))
            if raw is not None:
                values[f.name] = _typed(f.name, raw, f.default)
        return cls(**values)


def _typed(name: str, raw, default):
    try:
        if isinstance(default, bool):
            return raw if isinstance(raw, bool) else {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}[str(raw).lower()]
        if isinstance(default, tuple):
            return tuple(x.strip() for x in raw.split(",")) if isinstance(raw, str) else tuple(raw)
        return type(default)(raw)
    except (KeyError, ValueError, TypeError) as e:
        raise ConfigError(f"{name} cannot be {raw!r}") from e


def _yaml(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        held = yaml.safe_load(f) or {}
    if not isinstance(held, dict):
        raise ConfigError(f"{path} holds no sections")
    return held


# ---------------------------------------------------------------- verticals
@dataclass(frozen=True)
class Vertical:
    slug: str
    name: str
    queries: tuple[str, ...] = ()
    personas: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()


def load_verticals(path: str) -> dict[str, Vertical]:
    """By slug; names default to slugs."""
    held = _yaml(path).get("verticals") or {}
    of = lambda v, k: tuple(map(str, v.get(k) or ()))
    return {slug: Vertical(slug, str(v.get("name") or slug), of(v, "queries"), of(v, "personas"), of(v, "sources")) for slug, v in held.items()}


def find_vertical(known: Mapping[str, Vertical], slug: str) -> Vertical:
    if slug not in known:
        raise KeyError(f"no vertical {slug!r}; there are {', '.join(sorted(known))}")
    return known[slug]


def chosen(known: Mapping[str, Vertical], slug: str | None, all_of_them: bool) -> list[Vertical]:
    """Exactly one of a slug and all of them is asked for."""
    if (slug is None) != all_of_them:
        raise ConfigError("name one vertical, or ask for all")
    return list(known.values()) if all_of_them else [find_vertical(known, slug)]


def seed_queries(spark: SparkSession, verticals: list[Vertical]) -> DataFrame:
    rows = [(v.slug, q, i) for v in verticals for i, q in enumerate(v.queries)]
    return spark.createDataFrame(rows, "vertical string, text string, ord int")


# ---------------------------------------------------------------- rubric
@dataclass(frozen=True)
class Rubric:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    bands: tuple[tuple[str, float], ...] = BANDS


def load_rubric(path: str) -> Rubric:
    """Weights by dimension and floors by band; an unknown dimension is refused."""
    held = _yaml(path)
    weights = {k: float(v["weight"] if isinstance(v, dict) else v) for k, v in (held.get("dimensions") or WEIGHTS).items()}
    if set(weights) != set(WEIGHTS):
        raise ConfigError(f"the rubric weighs {sorted(set(weights) ^ set(WEIGHTS))}")
    floors = held.get("bands") or dict(BANDS)
    return Rubric(weights, tuple(sorted(((k, float(x)) for k, x in floors.items()), key=lambda b: -b[1])))


# ---------------------------------------------------------------- policies and adapters
POLICY = "source string, enabled boolean, " + ", ".join(f"{n} boolean" for n in RIGHT_NAMES) + ", authorised boolean, retention_days int, policy_version int, disabled_reason string"


def load_policies(spark: SparkSession, path: str) -> DataFrame:
    """One row a source; every right that the file does not grant is denied."""
    held = _yaml(path)
    version, rows = int(held.get("version") or 0), []
    for source, p in (held.get("sources") or {}).items():
        rights = p.get("rights") or {}
        granted = [bool(rights.get(n, False)) for n in RIGHT_NAMES]
        days = p.get("retention_days")
        rows.append((source, bool(p.get("enabled", False)), *granted, bool(p.get("authorised", False)), None if days is None else int(days), version, p.get("disabled_reason")))
    return spark.createDataFrame(sorted(rows), POLICY)


class Adapters:
    """Readers by source: a reader takes (spark, queries) and returns payload rows."""

    def __init__(self, readers: Mapping[str, Callable[[SparkSession, DataFrame], DataFrame]] | None = None):
        self.readers = dict(readers or {})

    def build(self, policy: DataFrame, names: list[str] | None = None) -> dict[str, Callable]:
        """Readers of sources that have a policy; others are left out."""
        known = {r["source"] for r in policy.select("source").collect()}  # a row a source
        return {n: r for n, r in self.readers.items() if n in known and (names is None or n in names)}

    def missing(self, requests: DataFrame) -> DataFrame:
        """`requests` (query, source) to sources without a reader, as runs that ended in an error."""
        rows = requests.filter(~F.col("source").isin(*self.readers)) if self.readers else requests
        return rows.select("query", "source", F.lit("error").alias("status"), F.lit("no adapter registered").alias("reason"), F.lit(0).alias("record_count"))

    def collect(self, spark: SparkSession, requests: DataFrame, policy: DataFrame) -> DataFrame:
        """Payload rows of all built readers, each given its own requests."""
        out = None
        for name, reader in self.build(policy).items():
            rows = reader(spark, requests.filter(F.col("source") == name))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out


# ---------------------------------------------------------------- learned weights
def save_model(model: dict, path: str, at: str) -> str:
    """The model as JSON, put in place at once, and a copy that carries the time `at`; returns the copy's path."""
    stem, text = path.removesuffix(".json"), json.dumps(model, indent=1, sort_keys=True)
    copy = f"{stem}-{at.replace(':', '').replace('-', '')}.json"
    for target in (copy, path):
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        with open(f"{target}.new", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{target}.new", target)
    return copy


def load_model(path: str) -> dict | None:
    """A saved model, or None if there is none or it is not one."""
    try:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
    except (OSError, ValueError):
        return None
    good = isinstance(model, dict) and isinstance(model.get("weights"), dict) and isinstance(model.get("features"), list)
    return model if good and set(model["features"]) <= set(FEATURES) | set(model["weights"]) else None
