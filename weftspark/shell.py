"""Interactive shell with spark, lines(path), objects(path) and cached(n) at hand.

A line that ends in a backslash goes on in the next one; the whole block runs.
"""

from __future__ import annotations

import code
from typing import Any

from weftspark.dataset import MISSING, Dataset
from weftspark.session import session
from weftspark.sources import readers


def names(spark) -> dict[str, Any]:
    return {
        "spark": spark,
        "Dataset": Dataset,
        "MISSING": MISSING,
        "lines": lambda path, **how: readers.lines(spark, path, **how),
        "objects": lambda path: readers.objects(spark, path),
        "cached": lambda number, **how: readers.cached(spark, number, **how),
        "random_ints": lambda count, **how: readers.random_ints(spark, count, **how),
        "delimited": lambda path, **how: readers.delimited(spark, path, **how),
    }


class Shell(code.InteractiveConsole):
    def __init__(self, spark):
        super().__init__(names(spark))
        self._held: list[str] = []

    def push(self, line: str, *args: Any, **how: Any) -> bool:
        if line.endswith("\\"):
            self._held.append(line[:-1])
            return True
        whole, self._held = "".join([*self._held, line]), []
        return super().push(whole, *args, **how)


def run(master: str | None = None) -> None:
    Shell(session(master)).interact("weftspark shell: spark, lines, objects, cached, random_ints, delimited", "")
