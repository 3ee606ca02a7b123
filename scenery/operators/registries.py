"""What a run may add: tools, tasks, names, extractors and scores, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

from scenery.functions.vocabulary import REGION_OBJECTS, REGION_PHRASES, REJECTED_TASKS, TASK_ALIASES
from scenery.operators import rules
from scenery.operators.questions import SCOPES


class Registry:
    """Functions from a DataFrame and keywords to a DataFrame, by name; a taken name is an error, an unknown one too."""

    def __init__(self, kind: str):
        self.kind, self.of = kind, {}

    def add(self, name: str, run: Callable[..., DataFrame]) -> Registry:
        if not isinstance(name, str) or not name.strip():
            raise ValueError(f"a {self.kind} needs a name")
        if name.strip() in self.of:
            raise ValueError(f"{self.kind} {name.strip()} is taken")
        self.of[name.strip()] = run
        return self

    def remove(self, name: str) -> Registry:
        self.of.pop(name, None)
        return self

    def run(self, name: str, rows: DataFrame, **options) -> DataFrame:
        if name not in self.of:
            raise KeyError(f"no {self.kind} named {name}: {', '.join(sorted(self.of))}")
        return self.of[name](rows, **options)


class Tasks:
    """The tasks of a run with their modes, other names, refusals and regions; starts from those that are there."""

    def __init__(self):
        from scenery.plans.q_etl import TASKS

        self.modes = {t: m for m, t in TASKS}
        self.aliases = dict(TASK_ALIASES)
        self.refused = tuple(REJECTED_TASKS)
        self.scopes = dict(SCOPES)
        self.objects = {k: list(v) for k, v in REGION_OBJECTS.items()}
        self.phrases = {k: list(v) for k, v in REGION_PHRASES.items()}

    def add_task(self, name: str, mode: str, scope: str = "frame_only") -> Tasks:
        self.modes[name], self.scopes[name] = mode, scope
        return self

    def remove_task(self, name: str) -> Tasks:
        self.modes.pop(name, None)
        self.aliases = {a: t for a, t in self.aliases.items() if t != name}
        return self

    def add_alias(self, alias: str, name: str) -> Tasks:
        if name not in self.modes:
            raise KeyError(f"no task named {name}")
        self.aliases[alias] = name
        return self

    def add_refusal(self, name: str) -> Tasks:
        self.refused = (*self.refused, name)
        return self

    def add_region(self, region: str, objects: Iterable[str] = (), phrases: Iterable[str] = ()) -> Tasks:
        self.objects[region] = [*self.objects.get(region, []), *objects]
        self.phrases[region] = [*self.phrases.get(region, []), *phrases]
        return self

    def names(self, known: Iterable[str] = ()):
        from scenery.functions.fuzzy import Names

        return Names(known, self.objects, self.phrases)

    def resolve(self, name: Column) -> Column:
        return rules.resolve_task(name, list(self.modes), self.aliases, self.refused)


def scored(rows: DataFrame, score: Callable[[pd.DataFrame], pd.Series], into: str = "score") -> DataFrame:
    """Adds a score of the caller's own, a function of a batch of rows."""
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{into: score(b)})

    return rows.mapInPandas(run, f"{fields}, `{into}` double")


def dispatch(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunks: int) -> DataFrame:
    """A function of a batch applied to every chunk of the rows, in as many tasks; the results are put together in no order."""

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield run(b)

    return rows.repartition(chunks).mapInPandas(each, schema)
