"""What a trade over a condition path makes under a model of entry and exit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F



def _entry(model: str, up: bool) -> Column:
    return {
        "best": lambda: F.col("first_low") if up else F.col("first_high"),
        "mid": lambda: (F.col("first_high") + F.col("first_low")) / 2,
        "worst": lambda: F.col("first_high") if up else F.col("first_low"),
    }[model]()


def execute(paths: DataFrame, up: bool, entry: Column, exit_: Column) -> DataFrame:
    """entry, exit, pnl, and the greatest adverse and favourable move on the way."""
    sign = 1 if up else -1
    paths = paths.withColumns({"entry": entry, "exit": exit_})
    adverse, favourable = ("min_low", "max_high") if up else ("max_high", "min_low")
    move = lambda c: sign * (F.col(c) - F.col("entry")) + F.lit(0.0)  # noqa: E731  no negative zero
    return paths.withColumns({"pnl": move("exit"), "mae": move(adverse), "mfe": move(favourable)})


CUSTOM: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, model: Callable[[DataFrame], DataFrame]) -> None:
    if name in CUSTOM:
        raise ValueError(f"{name} is registered")
    CUSTOM[name] = model


def summary(paths: DataFrame, model: str | tuple[str, str], up: bool = True) -> DataFrame:
    """Entry at the best, mid or worst price of the first bar and exit on the last close, or ("diy", name) of a registered model."""
    if isinstance(model, tuple):
        return CUSTOM[model[1]](paths)
    return execute(paths, up, _entry(model, up), F.col("last_close"))
