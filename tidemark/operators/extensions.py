"""Extension points: features that declare what they read, and named methods, added without touching the library.

A registry holds formulas by name with their inputs, each a statistic the base aggregate offers or another entry. levels()
puts entries in dependency order and needs() names the statistics that some entries really use, so that a plan computes no
others. A name that is taken, an input nothing offers and a cycle raise ValueError when they are added or resolved.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable


class Registry:
    """entries: name -> (value, rules...), as in profile.DAILY, shared with whoever reads that table."""

    def __init__(self, entries: dict[str, tuple], offered: Callable[[], set[str]]):
        self.entries, self.offered = entries, offered
        self.inputs: dict[str, tuple[str, ...]] = {}
        words = lambda entry: {w for part in entry for text in ([part] if isinstance(part, str) else part) for w in re.findall(r"[a-z_]\w*", text)}
        known = {*offered(), *entries}
        self.inputs = {name: tuple(sorted((words(e) & known) - {name})) for name, e in entries.items()}

    def add(self, name: str, value: str, *rules: tuple[str, str], inputs: Iterable[str]) -> None:
        """A formula (SQL), the rules that null it (condition, reason), and the names it reads. Inputs may be added later; resolving checks them."""
        if name in self.entries or name in self.offered():
            raise ValueError(f"{name} is registered already")
        self.entries[name], self.inputs[name] = (value, *rules), tuple(inputs)

    def remove(self, name: str) -> None:
        del self.entries[name], self.inputs[name]

    def levels(self, names: Iterable[str] | None = None) -> list[list[str]]:
        """The entries that names need, names included, in stages: each reads statistics and entries of the stages before."""
        depth: dict[str, int] = {}
        open_: list[str] = []

        def visit(name: str) -> int:
            if name in depth:
                return depth[name]
            if name in open_:
                raise ValueError("cycle: " + " -> ".join([*open_[open_.index(name) :], name]))
            if name not in self.entries:
                raise ValueError(f"{name} is not registered")
            open_.append(name)
            below = [visit(i) for i in self.inputs[name] if i not in self.offered()]
            open_.pop()
            depth[name] = 1 + max(below, default=-1)
            return depth[name]

        for name in self.entries if names is None else names:
            visit(name)
        return [[n for n in self.entries if depth.get(n) == k] for k in range(max(depth.values(), default=-1) + 1)]

    def needs(self, names: Iterable[str] | None = None) -> set[str]:
        """The statistics that these entries and the entries below them read."""
        return {i for level in self.levels(names) for n in level for i in self.inputs[n] if i not in self.entries}


class Methods:
    """Functions by name."""

    def __init__(self, entries: dict[str, Callable]):
        self.entries = entries

    def add(self, name: str, method: Callable) -> None:
        if name in self.entries:
            raise ValueError(f"{name} is registered already")
        self.entries[name] = method

    def remove(self, name: str) -> None:
        del self.entries[name]

    def items(self):
        return self.entries.items()
