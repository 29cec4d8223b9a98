"""A rule is data: what to look for, where, and how to report it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    severity: str
    title: str
    description: str
    suggestion: str | None = None
    suggestion_code: str | None = None
    families: tuple[str, ...] | None = None  # None: every language family
    pattern: str | None = None  # portable spelling, see functions.text
    flags: str = ""  # "i" ignore ASCII case, "m" line-anchored ^
    needs: tuple[str, ...] = ()  # literals a match cannot do without; "a|b" means either
    # Same matches in linear time: also consumes attempts that fail, so that no text is
    # scanned once per attempt.  Group 1 takes part in real matches only.
    linear: str | None = None
    drop: str | None = None  # a match whose text starts like this is no finding
    suppress: bool = True  # skip lines that define a pattern themselves
    around: int = 1  # lines of context on each side
    detector: str | None = None  # name in operators.detectors instead of a pattern
    cap: int | None = None  # most findings of a detector per file; None: all
    group: str = ""  # rules queried together
    rix: int = field(default=-1)  # position in the profile
    ord: int = field(default=-1)  # emission order; records of one rule share it
    tkey: int = field(default=-1)  # number of the title: equal titles are duplicates


def number(rules: list[Rule]) -> list[Rule]:
    """Give each rule its position, emission order and title number."""
    titles: dict[str, int] = {}
    out: list[Rule] = []
    for i, r in enumerate(rules):
        same = bool(out) and out[-1].id == r.id
        out.append(replace(r, rix=i, ord=out[-1].ord if same else i, tkey=titles.setdefault(r.title, len(titles))))
    return out
