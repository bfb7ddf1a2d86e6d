"""Named results of a pipeline, each built when first asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class Results(Mapping[str, DataFrame]):
    """A mapping from names to DataFrames. Plans that nobody asks for are never analysed."""

    def __init__(self, makers: dict[str, Callable[["Results"], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def without(self, *names: str) -> "Results":
        return Results({k: (lambda _, k=k: self[k]) for k in self._makers if k not in names})
