"""Declarative pipelines: a list of stages, from code or from a file."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomspark.operators.stages import STAGES, FunctionStage, Stage

FORMAT = "loomspark/pipeline/v1"


class Pipeline:
    """Stages in order. ``run`` is lazy; ``report`` needs an action on the result first."""

    def __init__(self, stages: list[Stage] | None = None, name: str = "pipeline") -> None:
        self.name, self.stages = name, []
        self._seen: list[tuple[str, Observation]] = []
        for s in stages or []:
            self.add(s)

    def add(self, stage: Stage, name: str | None = None) -> Pipeline:
        """Adds a stage; a second one of a name gets ``#2``."""
        name = name or stage.kind
        n = sum(x == name or x.startswith(name + "#") for x, _ in self.stages)
        self.stages.append((name if not n else f"{name}#{n + 1}", stage))
        return self

    def run(self, df: DataFrame, count: bool = False) -> DataFrame:
        """The lazy result. ``count`` observes how many rows leave each stage, in the same job."""
        self._seen = []
        if count:
            df = self._count(df, "input")
        for name, stage in self.stages:
            df = stage.apply(df) if isinstance(stage, Stage) else df.transform(stage)
            if count:
                df = self._count(df, name)
        return df

    def _count(self, df: DataFrame, name: str) -> DataFrame:
        o = Observation(f"{self.name}:{len(self._seen)}")
        self._seen.append((name, o))
        return df.observe(o, F.count(F.lit(1)).alias("rows"))

    def report(self) -> list[dict]:
        """Rows in, out and dropped of every stage of the last counted run."""
        rows = [(name, o.get["rows"]) for name, o in self._seen]
        return [{"stage": b[0], "in": a[1], "out": b[1], "dropped": a[1] - b[1]} for a, b in zip(rows, rows[1:])]

    def describe(self) -> str:
        return "\n".join(f"{i + 1}. {name}: {json.dumps(stage.config(), default=str)}" for i, (name, stage) in enumerate(self.stages))

    def to_config(self) -> dict:
        return {"format": FORMAT, "name": self.name, "stages": [s.config() for _, s in self.stages]}

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_config(), indent=2, default=str))

    @classmethod
    def from_config(cls, config: dict, tables: dict[str, DataFrame] | None = None, functions: dict | None = None) -> Pipeline:
        """``tables`` are the reference tables that lookups name, ``functions`` what function stages name.

        Code is never imported from a configuration.
        """
        from loomspark.operators.schema import Rule, Schema

        if config.get("format") != FORMAT:
            raise ValueError(f"not a {FORMAT} file")
        out = cls(name=config.get("name", "pipeline"))
        for i, entry in enumerate(config.get("stages", [])):
            if not isinstance(entry, dict) or len(entry) != 1:
                raise ValueError(f"stage {i + 1} must be one kind with its options")
            kind, options = next(iter(entry.items()))
            if kind not in STAGES:
                raise ValueError(f"stage {i + 1}: there is no stage {kind!r}; there are {', '.join(sorted(STAGES))}")
            options = dict(options or {})
            if kind == "lookup":
                options["table"] = (tables or {})[options["table"]]
            if kind in ("function", "enrich"):
                options["function"] = (functions or {})[options["function"]]
            if isinstance(options.get("schema"), dict):
                options["schema"] = Schema.from_config(options["schema"])
            if kind == "validate":
                options["rules"] = [r if isinstance(r, Rule) else Rule(**r) for r in options.get("rules", [])]
            try:
                out.add(STAGES[kind](**options))
            except TypeError as e:
                raise ValueError(f"stage {i + 1} ({kind}): {e}") from e
        return out

    @classmethod
    def load(cls, path: str, **context) -> Pipeline:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_config(yaml.safe_load(text), **context)
        if path.endswith(".toml"):
            import tomllib

            return cls.from_config(tomllib.loads(text), **context)
        return cls.from_config(json.loads(text), **context)


def pipeline(*stages) -> Pipeline:
    return Pipeline([s if isinstance(s, Stage) else FunctionStage(s) for s in stages])
