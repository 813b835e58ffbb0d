"""How a query and its SQL are registered, and how both sides present amounts, ratios and times alike."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlake.sources.commerce import VIEWS, Commerce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Named SQL relations that oracles may refer to, beside the source views; later ones may use earlier ones.
RELATIONS: dict[str, str] = dict(VIEWS)


def relation(name: str, sql: str) -> None:
    RELATIONS[name] = sql


def _used(sql: str) -> list[str]:
    """The relations that a statement needs, each after those that it needs itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in RELATIONS.items():
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit(body)
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def query(name: str, sql: str | None = None, *, money: Iterable[str] = (), ratio: Iterable[str] = (), stamps: Iterable[str] = (), dates: Iterable[str] = ()):
    """Registers a function of the commerce entities; amounts show as doubles of 2 and ratios of 6 places, times as text."""

    def add(build: Callable[[Commerce], DataFrame]) -> Callable[[Commerce], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Commerce(spark, sf_dir))
            shown = {c: F.round(F.col(c).cast("double"), places) for cs, places in ((money, 2), (ratio, 6)) for c in cs}
            shown |= {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in stamps} | {c: F.date_format(c, "yyyy-MM-dd") for c in dates}
            return df.withColumns(shown) if shown else df

        QUERIES[name] = run
        if sql is not None:
            shown = [f"round(cast({c} as double), {places}) as {c}" for cs, places in ((money, 2), (ratio, 6)) for c in cs]
            shown += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}" for c in stamps] + [f"strftime({c}, '%Y-%m-%d') as {c}" for c in dates]
            body = f"select * replace ({', '.join(shown)}) from ({sql}) shown" if shown else sql
            parts = ",\n".join(f"{r} as ({RELATIONS[r]})" for r in _used(sql))
            ORACLES[name] = (f"with {parts}\n" if parts else "") + body
        return build

    return add
