"""Summaries kept on disk, so that one that was asked before is read instead of counted again."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from tallyframe.meta import Dataset
from tallyframe.operators.measures import Measure
from tallyframe.operators.summarise import _flat, _Op, condcol
from tallyframe.sources.store import Store


def _told(x: Any) -> Any:
    """What a part of a summary says, as plain values; a function says nothing that could be compared."""
    if isinstance(x, condcol):
        return [x.name, [_told(o) for o in x.ops]]
    if isinstance(x, _Op):
        return [type(x).__name__, [_told(v) for v in x.values], {k: _told(v) for k, v in sorted(x.options.items())}]
    if isinstance(x, Measure):
        return [x.name(), x.weight, x.exclude, x.conflev, {k: _told(v) for k, v in sorted(x.options.items())}]
    if isinstance(x, (list, tuple)):
        return [_told(v) for v in x]
    if callable(x):
        raise TypeError("a summary with a function cannot be kept")
    return [type(x).__name__, str(x)]


class SummaryCache:
    """Summaries of stored datasets by what they were asked for; a new generation of the dataset is asked anew."""

    def __init__(self, data: Store, kept: Store) -> None:
        self.data, self.kept = data, kept

    def name_of(self, ds: Dataset, generation: int, *args: Any, **options: Any) -> str:
        asked = [ds.name, generation, list(ds.filtered_by), ds.weight, [_told(a) for a in _flat(args)], {k: _told(v) for k, v in sorted(options.items())}]
        return "summ_" + hashlib.sha256(json.dumps(asked).encode()).hexdigest()[:40]

    def summ(self, name: str, *args: Any, filters: tuple[str, ...] = (), **options: Any) -> Dataset:
        """The summary of a stored dataset under filters: read if it is kept, else made, kept and read. Rows are not ordered."""
        generation = max(self.data.generations(self.data.find(name)[1], self.data.find(name)[0]))
        ds = self.data.load(name, generation)
        for f in filters:
            ds = ds.filter(f)
        key = self.name_of(ds, generation, *args, **options)
        if key not in self.kept.available():
            from dataclasses import replace

            self.kept.save(replace(ds.summ(*args, ordered=False, **options), name=key), keep=1)
        return self.kept.load(key)
