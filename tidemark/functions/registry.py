"""Users' own functions by name: pipelines, frame builders, views."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import DataFrame


@dataclass
class Registry:
    what: str
    known: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def register(self, name: str):
        def keep(f):
            if name in self.known:
                raise ValueError(f"{self.what} {name} is registered")
            self.known[name] = f
            return f

        return keep

    def get(self, name: str) -> Callable[[DataFrame], DataFrame]:
        if name not in self.known:
            near = difflib.get_close_matches(name, self.known)
            raise KeyError(f"unknown {self.what} {name}" + (f"; did you mean {near[0]}?" if near else ""))
        return self.known[name]

    def build(self, names, base: DataFrame) -> dict[str, DataFrame]:
        """Only the frames that are asked for; each is a lazy plan over base."""
        return {n: self.get(n)(base) for n in names}


PIPELINES, FRAMES, VIEWS = Registry("pipeline"), Registry("frame"), Registry("view")


#: New columns by the function that made them.
LINEAGE: dict[str, tuple[str, ...]] = {}


def new_columns(*names: str):
    """For a function of a frame that adds these columns and keeps all others as they are."""

    def mark(f):
        LINEAGE[f.__qualname__] = names

        @wraps(f)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            out = f(df, *args, **options)
            if lost := [c for c in df.columns if c not in out.columns]:
                raise ValueError(f"{f.__name__} loses {lost}")
            if missing := [c for c in names if c not in out.columns]:
                raise ValueError(f"{f.__name__} does not make {missing}")
            return out

        run.columns = names
        return run

    return mark


def rows_text(df: DataFrame, n: int = 20, columns=None, width: int = 20) -> str:
    """The first n rows as a table of text, values cut at width; no more rows come to the driver."""
    own = [c for c in df.columns if columns is None or c in columns]
    one = lambda v: ("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v))[:width]
    rows = [[one(v) for v in r] for r in df.select(*own).limit(n).collect()]
    wide = [max(len(x) for x in column) for column in zip(own, *rows, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in [own, *rows])
