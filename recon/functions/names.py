"""Column choice and pairing: works on the few names of a schema, never on rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field


def like(pattern: str, names: Iterable[str]) -> list[str]:
    """Names matching a pattern where % is any text and ? is one character."""
    parts = [".*" if ch == "%" else "." if ch == "?" else re.escape(ch) for ch in pattern]
    rx = re.compile("".join(parts))
    return [n for n in names if rx.fullmatch(n)]


def expand_columns(
    wanted: Sequence[str], left: Sequence[str], right: Sequence[str], *, keys: Sequence[str] = (), update: str | None = None
) -> list[str]:
    """explicit names or patterns over the mutual columns, without keys and update column."""
    mutual = [c for c in left if c in set(right)]
    out: list[str] = []
    for item in wanted:
        found = like(item, mutual)
        if not found:
            raise ValueError(f"no mutual column matches {item!r}")
        out += [c for c in found if c not in out]
    reserved = set(keys) | {update}
    return [c for c in out if c not in reserved]


def include_exclude(
    names: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), retyped: Iterable[str] = ()
) -> list[str]:
    """case-insensitive inclusion and exclusion; columns whose type changed drop out."""
    keep, drop, gone = {i.upper() for i in include}, {e.upper() for e in exclude}, set(retyped)
    return [n for n in names if n not in gone and n.upper() not in drop and (not keep or n.upper() in keep)]


@dataclass(frozen=True)
class Remapping:
    """F8: source-to-target column names; unmapped columns pair by equal name."""

    mapping: Mapping[str, str] = field(default_factory=dict)
    case_sensitive: bool = True

    @classmethod
    def parse(cls, text: str, case_sensitive: bool = True) -> "Remapping":
        """Read 'source:target,source:target'."""
        pairs = {}
        for part in filter(None, (p.strip() for p in text.split(","))):
            source, sep, target = (s.strip() for s in part.partition(":"))
            if not sep or not source or not target:
                raise ValueError(f"bad column mapping {part!r}; expected source:target")
            pairs[source] = target
        return cls(pairs, case_sensitive)

    def _fold(self, name: str) -> str:
        return name if self.case_sensitive else name.lower()

    def pairs(self, source: Sequence[str], target: Sequence[str]) -> list[tuple[str, str]]:
        """Pairs to compare, in source order; mapped pairs first claim their target."""
        available = {self._fold(t): t for t in target} | {t: t for t in target}
        wanted = {self._fold(s): t for s, t in self.mapping.items()}
        chosen: dict[str, str] = {}
        for s in source:
            t = wanted.get(self._fold(s))
            hit = t is not None and (available.get(t) or available.get(self._fold(t)))
            if hit:
                chosen[s] = hit
        taken = set(chosen.values())
        for s in source:
            hit = available.get(s) or available.get(self._fold(s))
            if s not in chosen and hit and hit not in taken:
                chosen[s] = hit
                taken.add(hit)
        return [(s, chosen[s]) for s in source if s in chosen]

    def warnings(self, source: Sequence[str], target: Sequence[str]) -> list[str]:
        """Mapping entries that name no existing column."""
        have_s, have_t = {self._fold(s) for s in source}, {self._fold(t) for t in target}
        out = []
        for s, t in self.mapping.items():
            if self._fold(s) not in have_s:
                out.append(f"mapping {s}:{t} is not used: side A has no column {s}")
            if self._fold(t) not in have_t:
                out.append(f"mapping {s}:{t} is not used: side B has no column {t}")
        return out
