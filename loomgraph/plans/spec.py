"""Definitions: named steps, conditional edges, joins, inputs and outputs; read from JSON, validated as a whole."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_args, get_type_hints

REQUIRED = object()


class InvalidDefinition(ValueError):
    """All problems of a definition."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass
class Input:
    name: str
    type: str = "any"
    default: Any = None


@dataclass
class Output:
    name: str
    variable: str = ""
    branch: str = "main"


@dataclass
class Edge:
    step: str
    condition: str = ""
    branch: str = ""


@dataclass
class Each:
    items: Any
    as_: str = "item"


@dataclass
class Join:
    branches: list[str] = field(default_factory=list)
    count: int = 0
    mappings: dict[str, str] = field(default_factory=dict)


@dataclass
class Retry:
    errors: list[str] = field(default_factory=list)
    max_retries: int = 0
    base_delay: float = 1.0
    backoff_rate: float = 2.0
    max_delay: float = 0.0
    jitter: bool = False
    timeout: float = 0.0


@dataclass
class Catch:
    errors: list[str] = field(default_factory=list)
    next: str = ""
    store: str = ""


@dataclass
class WaitSignal:
    topic: str
    timeout: float = 0.0
    store: str = ""
    on_timeout: str = ""


@dataclass
class Step:
    name: str
    activity: str = ""
    parameters: dict[str, Any] = field(default_factory=dict)
    store: str = ""
    each: Each | None = None
    join: Join | None = None
    wait_signal: WaitSignal | None = None
    sleep: float | None = None
    pause: bool = False
    next: list[Edge] = field(default_factory=list)
    edge_matching: str = "all"
    retry: list[Retry] = field(default_factory=list)
    catch: list[Catch] = field(default_factory=list)

    @property
    def kind(self) -> str:
        for k in ("join", "wait_signal"):
            if getattr(self, k):
                return k
        return "sleep" if self.sleep is not None else "pause" if self.pause else "activity" if self.activity else ""


@dataclass
class Definition:
    name: str
    steps: list[Step]
    inputs: list[Input] = field(default_factory=list)
    outputs: list[Output] = field(default_factory=list)
    state: dict[str, Any] = field(default_factory=dict)
    start: str = ""
    description: str = ""

    def step(self, name: str) -> Step:
        return next(s for s in self.steps if s.name == name)

    @property
    def first(self) -> Step:
        return self.step(self.start) if self.start else self.steps[0]

    def names(self) -> list[str]:
        return sorted(s.name for s in self.steps)

    def problems(self) -> list[str]:
        out = []
        names = [s.name for s in self.steps]
        known = set(names)
        if not self.name:
            out.append("a definition needs a name")
        if not self.steps:
            out.append("a definition needs a step")
        out += [f"step {n!r} is there {c} times" for n, c in Counter(names).items() if c > 1]
        out += [f"input {n!r} is there {c} times" for n, c in Counter(i.name for i in self.inputs).items() if c > 1]
        out += [f"output {n!r} is there {c} times" for n, c in Counter(o.name for o in self.outputs).items() if c > 1]
        if self.start and self.start not in known:
            out.append(f"there is no step {self.start!r} to start at")
        branches = Counter(e.branch for s in self.steps for e in s.next if e.branch)
        out += [f"branch {n!r} is begun {c} times" for n, c in branches.items() if c > 1]
        if "main" in branches:
            out.append("'main' is the first branch's name")
        for s in self.steps:
            at = f"step {s.name!r}"
            kinds = [k for k in ("activity", "join", "wait_signal") if getattr(s, k)] + ["sleep"] * (s.sleep is not None) + ["pause"] * s.pause
            if not s.name:
                out.append("a step needs a name")
            if len(kinds) > 1:
                out.append(f"{at} is of several kinds: {', '.join(kinds)}")
            if s.edge_matching not in ("all", "first"):
                out.append(f"{at}: edge_matching is 'all' or 'first'")
            out += [f"{at} leads to {e.step!r}, which isn't there" for e in s.next if e.step not in known]
            if (s.retry or s.catch or s.each) and s.kind not in ("activity", ""):
                out.append(f"{at}: each, retry and catch are for activities")
            out += [f"{at} catches to {c.next!r}, which isn't there" for c in s.catch if c.next not in known]
            out += [f"{at}: max_retries can't be negative" for r in s.retry if r.max_retries < 0]
            if s.sleep is not None and s.sleep <= 0:
                out.append(f"{at}: sleep needs a positive duration")
            if s.pause and (len(s.next) != 1 or s.next[0].branch):
                out.append(f"{at}: pause needs one next step without a branch")
            if s.wait_signal:
                if not s.wait_signal.topic:
                    out.append(f"{at}: wait_signal needs a topic")
                if s.wait_signal.on_timeout and s.wait_signal.on_timeout not in known:
                    out.append(f"{at}: on_timeout leads to {s.wait_signal.on_timeout!r}, which isn't there")
            if s.join:
                out += [f"{at} joins {b!r}, which no edge begins" for b in s.join.branches if b not in branches and b != "main"]
                if s.join.count < 0:
                    out.append(f"{at}: count can't be negative")
                out += [f"{at}: two mappings lead to {d!r}" for d, c in Counter(s.join.mappings.values()).items() if c > 1]
            for store in filter(None, [s.store, s.wait_signal.store if s.wait_signal else "", *(c.store for c in s.catch)]):
                if not re.fullmatch(r"[A-Za-z_]\w*", store):
                    out.append(f"{at}: {store!r} isn't a bare variable name")
        out += [f"output {o.name!r} is of branch {o.branch!r}, which no edge begins" for o in self.outputs if o.branch != "main" and o.branch not in branches]
        return out

    def warnings(self) -> list[str]:
        return [f"step {s.name!r}: count is of no effect beside branches" for s in self.steps if s.join and s.join.branches and s.join.count]

    def validate(self) -> Definition:
        if found := self.problems():
            raise InvalidDefinition(found)
        return self

    def bind(self, given: dict[str, Any]) -> dict[str, Any]:
        """The inputs with their defaults. A default of None makes an input required; unknown names are errors."""
        known = {i.name: i.default for i in self.inputs}
        problems = [f"unknown input {k!r}" for k in sorted(set(given) - set(known))]
        problems += [f"input {k!r} is required" for k, d in known.items() if d is None and k not in given]
        if problems:
            raise InvalidDefinition(problems)
        return {k: given.get(k, d) for k, d in known.items()}


def _make(kind, value):
    if value is None or not (is_dataclass(kind) and isinstance(value, dict)):
        return value
    hints = get_type_hints(kind)
    known = {f.name.rstrip("_"): f.name for f in fields(kind)}
    if unknown := sorted(set(value) - set(known)):
        raise InvalidDefinition([f"unknown key {k!r} of {kind.__name__.lower()}" for k in unknown])
    out = {}
    for k, v in value.items():
        hint = hints[known[k]]
        args = [a for a in get_args(hint) if is_dataclass(a)]
        if is_dataclass(hint):
            v = _make(hint, v)
        elif args and isinstance(v, list):
            v = [_make(args[0], x) for x in v]
        elif args:
            v = _make(args[0], v)
        out[known[k]] = v
    try:
        return kind(**out)
    except TypeError as e:
        raise InvalidDefinition([f"{kind.__name__.lower()}: {e}"]) from None


def from_dict(d: dict[str, Any]) -> Definition:
    return _make(Definition, d).validate()


def load(path: str) -> Definition:
    """The definition of a JSON file."""
    with open(path, encoding="utf-8") as f:
        return from_dict(json.load(f))


class Definitions:
    """Definitions by name; a later one takes the place of an earlier one."""

    def __init__(self) -> None:
        self._all: dict[str, Definition] = {}

    def register(self, d: Definition) -> None:
        self._all[d.validate().name] = d

    def get(self, name: str) -> Definition:
        if name not in self._all:
            raise KeyError(f"no definition {name!r}")
        return self._all[name]

    def list(self) -> list[str]:
        return sorted(self._all)
