"""Named programs, run by name with arguments and a declared parallelism."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..profile import section


class AdmissionError(ValueError):
    """More parallel tasks were asked for than are allowed."""


#: What the declared type of an argument or a result admits.
TYPES = {"int": int, "float": (int, float), "string": str, "bool": bool, "ints": list, "frame": DataFrame}


@dataclass(frozen=True)
class Program:
    name: str
    run: Callable[..., Mapping[str, Any] | None]
    parallel: bool
    arguments: Mapping[str, str] | None = None
    results: Mapping[str, str] | None = None


def _typed(what: str, declared: Mapping[str, str] | None, values: Mapping[str, Any]) -> None:
    """Names and types must be the declared ones; without a declaration anything goes."""
    if declared is None:
        return
    if set(declared) != set(values):
        raise TypeError(f"{what}: {sorted(values)} given, {sorted(declared)} declared")
    for name, kind in declared.items():
        value = values[name]
        if not isinstance(value, TYPES[kind]) or (isinstance(value, bool) and kind != "bool"):
            raise TypeError(f"{what} {name}: {kind} declared, {type(value).__name__} given")


def _parsed(text: str) -> dict[str, dict[str, Any]]:
    """name -> entry from YAML; without the library, from its plain form of two or three levels of ``name: value``."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        out: dict = {}
        path: list[tuple[int, dict]] = [(-1, out)]
        for line in text.splitlines():
            if line.strip() and not line.strip().startswith("#"):
                depth = len(line) - len(line.lstrip())
                name, _, value = line.strip().partition(":")
                while path[-1][0] >= depth:
                    path.pop()
                if value.strip():
                    path[-1][1][name] = value.strip().strip("\"'")
                else:
                    path[-1][1][name] = {}
                    path.append((depth, path[-1][1][name]))
        return out


@dataclass
class Engine:
    """A registry of programs ``(spark, **arguments) -> results``.

    max_parallelism: the most tasks of one call; the cluster's own elasticity decides how
    many run at once.
    """

    spark: SparkSession
    max_parallelism: int = 10
    programs: dict[str, Program] = field(default_factory=dict)

    def register(self, name: str, run: Callable, kind: str = "single", arguments: Mapping[str, str] | None = None, results: Mapping[str, str] | None = None) -> None:
        """arguments, results: name -> type (a key of TYPES) of what a call takes and gives; unchecked if None."""
        if kind not in ("single", "multi"):
            raise ValueError(f"kind {kind!r}: single or multi")
        if name in self.programs:
            raise ValueError(f"{name} is registered already")
        for kinds in (arguments, results):
            if wrong := set((kinds or {}).values()) - set(TYPES):
                raise ValueError(f"unknown types {sorted(wrong)}")
        self.programs[name] = Program(name, run, kind == "multi", arguments, results)

    def load(self, entries: str | Mapping[str, Mapping[str, Any]]) -> None:
        """Register from YAML text, or the mapping that it parses to: name -> {function: "module:attribute", kind: single
        or multi, arguments and results: name -> type}."""
        from importlib import import_module

        for name, entry in (_parsed(entries) if isinstance(entries, str) else entries).items():
            module, _, attribute = entry["function"].partition(":")
            self.register(name, getattr(import_module(module), attribute), entry.get("kind", "single"), entry.get("arguments"), entry.get("results"))

    def run(self, name: str, arguments: Mapping[str, Any] | None = None, parallelism: int = 1, per_task: tuple[str, Sequence[Any]] | None = None) -> dict[str, Any]:
        """Results of all tasks, merged in task order, later ones winning. The first error is raised once all have ended."""
        program = self.programs[name]
        if parallelism > self.max_parallelism:
            raise AdmissionError(f"{parallelism} tasks asked for, {self.max_parallelism} allowed")
        if parallelism < 1 or (parallelism > 1 and not program.parallel):
            raise ValueError(f"{name} can't run as {parallelism} tasks")
        if per_task and len(per_task[1]) != parallelism:
            raise ValueError(f"{len(per_task[1])} values of {per_task[0]} for {parallelism} tasks")
        calls = [dict(arguments or {}) | ({per_task[0]: per_task[1][i]} if per_task else {}) for i in range(parallelism)]
        for call in calls:
            _typed(f"argument of {name}", program.arguments, call)
        with section(name, parallelism), ThreadPoolExecutor(parallelism) as pool:
            tasks = [pool.submit(program.run, self.spark, **c) for c in calls]
        return merged(*(self._result(program, task.result()) for task in tasks))

    @staticmethod
    def _result(program: Program, made: Mapping[str, Any] | None) -> Mapping[str, Any]:
        if program.results is not None:
            _typed(f"result of {program.name}", {k: v for k, v in program.results.items() if k in (made or {})}, made or {})
        return made or {}


def merged(*results: Mapping[str, Any]) -> dict[str, Any]:
    """The results of all tasks in one mapping; of those of one name the last task's counts."""
    out: dict[str, Any] = {}
    for r in results:
        out |= r
    return out
