"""Reports that are made when they are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class Reports(Mapping[str, DataFrame]):
    """Tables by name; one that nobody reads costs nothing, one that is read again is not made again."""

    def __init__(self, **makers: Callable[[], DataFrame]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)
