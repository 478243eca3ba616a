"""Run configuration: datasets, models, methods and their sample-count sweeps."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from evalscale.functions.prompts import STYLES
from evalscale.operators.compare import Comparison
from evalscale.operators.select import STRATEGIES

# Fixed names: the reasoning language that a style implies.
STYLE_LANGUAGE = {"yoruba_cot": "yo", "english_cot": "en", "best_of_n_cot": "en", "translate_pivot": "en_pivot"}


class ConfigError(ValueError):
    pass


def _optional(kind, value):
    return None if value is None else kind(value)


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    task: str | None = None
    source_dataset: str | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Model:
    name: str
    backend: str = "transformers"
    model: str | None = None
    size_label: str = "unknown"
    cost_per_1k_tokens: float = 0.0
    request_timeout_s: float | None = None
    options: Mapping[str, Any] = field(default_factory=dict)


#: Fixed name: the backend that may have several requests in flight; what generates within the process may not.
SERVED = "openai_compatible"


@dataclass(frozen=True)
class Method:
    name: str
    prompt_style: str
    selection: str = "first"
    n: int = 1
    temperature: float | None = None
    max_tokens: int | None = None
    top_p: float | None = None
    reasoning_language: str = "en"
    group: str | None = None
    group_max_n: int | None = None

    @property
    def is_greedy_arm(self) -> bool:
        """one sample of a sweep that is decoded greedily, apart from the pool."""
        return self.n == 1 and self.selection == "first" and (self.temperature is None or self.temperature <= 0)


@dataclass(frozen=True)
class RunConfig:
    run_id: str
    output_dir: str
    datasets: tuple[Dataset, ...]
    models: tuple[Model, ...]
    methods: tuple[Method, ...]
    seed: int | None = None
    request_timeout_s: float = 120.0
    continue_on_error: bool = False
    max_concurrent: int = 1

    def requests_of(self, model: Model) -> tuple[int, float]:
        """How many requests of a model a task may have in flight, and how long each may take."""
        own = model.request_timeout_s
        return self.max_concurrent if model.backend == SERVED else 1, self.request_timeout_s if own is None else own


def method(row: Mapping[str, Any]) -> Method:
    style, selection, n = str(row["prompt_style"]), str(row.get("selection", "first")), int(row.get("n", 1))
    if style not in STYLES:
        raise ConfigError(f"prompt_style {style!r} is none of {', '.join(STYLES)}")
    if selection not in STRATEGIES:
        raise ConfigError(f"selection {selection!r} is none of {', '.join(sorted(STRATEGIES))}")
    if n < 1:
        raise ConfigError(f"method {row.get('name')!r} has n = {n}")
    language = row.get("reasoning_language")
    return Method(
        name=str(row["name"]),
        prompt_style=style,
        selection=selection,
        n=n,
        temperature=_optional(float, row.get("temperature")),
        max_tokens=_optional(int, row.get("max_tokens")),
        top_p=_optional(float, row.get("top_p")),
        reasoning_language=STYLE_LANGUAGE.get(style, "en") if language is None else str(language),
        group=_optional(str, row.get("nested_group_id")),
        group_max_n=_optional(int, row.get("nested_max_n")),
    )


def expand_methods(rows: Iterable[Mapping[str, Any]]) -> list[Method]:
    """one method per sample count; counts of a nested sweep share a group and its largest n."""
    out = []
    for row in rows:
        counts = row.get("n_values", [row.get("n", 1)])
        if counts is None:
            counts = [row.get("n", 1)]
        if not isinstance(counts, list):
            raise ConfigError(f"method {row.get('name')!r}: n_values is no list")
        counts = [int(n) for n in counts]
        sweep = len(counts) > 1
        nested = sweep and bool(row.get("nested_n", row.get("nested", False)))
        for n in counts:
            one = dict(row) | {"n": n, "name": f"{row['name']}_n{n}" if sweep else str(row["name"])}
            if nested:
                one |= {"nested_group_id": str(row["name"]), "nested_max_n": max(counts)}
            if n == 1:
                if row.get("greedy_n1", sweep):
                    one |= {"temperature": row.get("temperature_n1", 0.0), "top_p": row.get("top_p_n1"), "selection": "first"}
                else:
                    one |= {k: row[f"{k}_n1"] for k in ("temperature", "top_p") if f"{k}_n1" in row}
            out.append(method(one))
    return out


def run_config(row: Mapping[str, Any]) -> RunConfig:
    known = {f.name for f in fields(Dataset)}
    datasets = tuple(
        Dataset(**{k: v for k, v in d.items() if k in known} | {"name": str(d["name"]), "path": str(d["path"]), "limit": _optional(int, d.get("limit"))}) for d in row.get("datasets", [])
    )
    models = tuple(
        Model(
            str(m["name"]), str(m.get("backend", "transformers")), str(m.get("model", m["name"])), str(m.get("size_label", "unknown")), float(m.get("cost_per_1k_tokens", 0.0)),
            _optional(float, m.get("request_timeout_s")), dict(m.get("backend_kwargs", {})),
        )
        for m in row.get("models", [])
    )
    methods = tuple(expand_methods(row.get("methods", [])))
    for name, found in (("dataset", datasets), ("model", models), ("method", methods)):
        if not found:
            raise ConfigError(f"at least one {name} is needed")
    concurrent = int(row.get("max_concurrent", 1))
    if concurrent < 1:
        raise ConfigError(f"max_concurrent is {concurrent}")
    return RunConfig(
        str(row.get("run_id", "run")), str(row.get("output_dir", "runs")), datasets, models, methods, _optional(int, row.get("seed")),
        float(row.get("default_request_timeout_s", 120.0)), bool(row.get("continue_on_error", False)), concurrent,
    )


def load_run_config(path: str | Path) -> RunConfig:
    return run_config(json.loads(Path(path).read_text(encoding="utf-8")))


def comparison_config(path: str | Path | None = None, **overrides: Any) -> Comparison:
    """Defaults, then the file if it exists, then overrides that are not None; an empty method matches any."""
    row: dict[str, Any] = {"small_model": "small", "large_model": "large"}
    if path is not None and Path(path).exists():
        row |= json.loads(Path(path).read_text(encoding="utf-8"))
    row |= {k: v for k, v in overrides.items() if v is not None}
    known = {f.name for f in fields(Comparison)}
    lists = {k: tuple(row[k]) for k in ("include_models", "datasets") if row.get(k) is not None}
    return Comparison(**{k: v for k, v in (row | lists).items() if k in known and not (k == "include_models" and v is None)})


def named(items: Sequence[Any], wanted: Iterable[str] | None) -> list[Any]:
    """The items of these names; a name that none has is an error."""
    if wanted is None:
        return list(items)
    names = set(wanted)
    missing = names - {x.name for x in items}
    if missing:
        raise ConfigError(f"unknown: {', '.join(sorted(missing))}")
    return [x for x in items if x.name in names]


def name_set(text: str | None) -> set[str] | None:
    """A comma list as a set; blank is no restriction."""
    found = {x.strip() for x in (text or "").split(",") if x.strip()}
    return found or None


def partition_methods(methods: Iterable[Method]) -> tuple[list[Method], dict[str, list[Method]]]:
    """Methods of their own, and sweeps by group in the order of n."""
    alone, groups = [], {}
    for m in methods:
        (groups.setdefault(m.group, []) if m.group else alone).append(m)
    return alone, {g: sorted(own, key=lambda m: m.n) for g, own in groups.items()}


def split_group(group: Iterable[Method]) -> tuple[list[Method], list[Method]]:
    greedy = [m for m in group if m.is_greedy_arm]
    return greedy, [m for m in group if not m.is_greedy_arm]


def pool_method(group: Sequence[Method], pool_n: int) -> Method:
    """The method that samples the pool: the one with n = pool_n, else the largest."""
    if not group or pool_n < 1:
        raise ConfigError("a pool needs a method and a size")
    chosen = next((m for m in group if m.n == pool_n), max(group, key=lambda m: m.n))
    return replace(chosen, n=pool_n, name=f"{chosen.group or chosen.name}_pool_n{pool_n}")
