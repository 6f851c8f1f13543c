"""Pipelines: named nodes that turn DataFrames into DataFrames, checked and then composed lazily.

A node is a function of its inputs' merged frame; running a pipeline only builds plans, which Spark
optimises as a whole. The rules that are checked: names are unique, inputs exist, every source is
used, no node is alone, the upstream nodes of a node agree on the alignment, and there is no cycle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of a run, with the defaults of the command line."""

    data_source: str = "synthetic"
    start_date: str = "2015-01-01"
    seed: int = 42
    precision: int = 2
    noise_ratio: float = 0.3
    n_times: int = 1024
    n_stocks: int = 64
    max_stocks: int | None = None
    fwd: int = 20
    model_window: int = 200
    loss: str = "mse"
    ensemble: tuple[str, ...] = ("ridge",)
    initial_cash: float = 1e8
    num_groups: int = 10
    include_star: bool = False
    slip_ticks: int = 1
    snapshot_interval: int = 250
    retrain_every: int = 20
    commission_rate: float = 0.0005
    min_commission: float = 5.0
    trim: float = 0.01
    label_clip: float = 0.01
    code_prefixes: tuple[str, ...] = ()

    def __post_init__(self):
        if self.data_source not in ("synthetic", "vendor"):
            raise ValueError("data_source is synthetic or vendor")
        if self.fwd < 2 or self.num_groups < 1 or not 0 <= self.trim < 0.5:
            raise ValueError("fwd must be 2 at least, num_groups 1 at least, trim below 0.5")


@dataclass
class Node:
    name: str
    fn: Callable[..., DataFrame] | None
    inputs: tuple[str, ...] = ()
    align: str = "right"
    keep: list[str] | None = None
    exclude: list[str] | None = None
    output: list[str] | None = None
    context: dict = field(default_factory=dict)


class Pipeline:
    def __init__(self):
        self.nodes: list[Node] = []

    def add_source(self, name: str, fn: Callable[[], DataFrame]) -> str:
        self.nodes.append(Node(name, fn))
        return name

    def add_node(self, name: str, fn: Callable[..., DataFrame], inputs, **settings) -> str:
        """``fn`` takes (frame) or (frame, context)."""
        self.nodes.append(Node(name, fn, (inputs,) if isinstance(inputs, str) else tuple(inputs), **settings))
        return name

    def problems(self) -> list[str]:
        out = []
        names = [n.name for n in self.nodes]
        by = {n.name: n for n in self.nodes}
        out += [f"name used twice: {n}" for n in sorted({n for n in names if names.count(n) > 1})]
        used = {i for n in self.nodes for i in n.inputs}
        out += [f"{n.name}: unknown input {i}" for n in self.nodes for i in n.inputs if i not in by]
        out += [f"{n.name}: nothing reads this source" for n in self.nodes if not n.inputs and n.name not in used and len(self.nodes) > 1]
        for n in self.nodes:
            kinds = {by[i].align for i in n.inputs if i in by and by[i].inputs}
            if len(kinds) > 1:
                out.append(f"{n.name}: inputs are aligned in different ways")
        state: dict[str, int] = {}

        def visit(name: str) -> bool:
            if state.get(name) == 1:
                return True
            if state.get(name) == 2 or name not in by:
                return False
            state[name] = 1
            found = any([visit(i) for i in by[name].inputs])
            state[name] = 2
            return found

        if any([visit(n) for n in names]):
            out.append("the nodes form a cycle")
        return out

    def run(self) -> dict[str, DataFrame]:
        """The frame of every node, as plans."""
        problems = self.problems()
        if problems:
            raise ValueError("; ".join(problems))
        done: dict[str, DataFrame] = {}
        left = list(self.nodes)
        while left:
            for n in [n for n in left if all(i in done for i in n.inputs)]:
                if n.inputs:
                    frame = columns(merged([done[i] for i in n.inputs]), n.keep, n.exclude)
                    frame = n.fn(frame, n.context) if n.fn.__code__.co_argcount > 1 else n.fn(frame)
                else:
                    frame = n.fn()
                if n.output is not None:
                    frame = columns(frame, n.output, None, text=False)
                done[n.name] = frame
                left.remove(n)
        return done

    def __repr__(self) -> str:
        return "\n".join(f"{n.name} <- {', '.join(n.inputs) or 'source'} ({n.align})" for n in self.nodes)


def merged(frames: list[DataFrame]) -> DataFrame:
    """Frames side by side by (key, code); a numeric column in two of them raises."""
    seen = set(frames[0].columns)
    out = frames[0]
    for f in frames[1:]:
        twice = [c for c in f.columns if c in seen and c not in ("key", "code")]
        numeric = [c for c in twice if c != "stock_name"]
        if numeric:
            raise ValueError(f"columns appear twice: {numeric}")
        out = out.join(f.drop(*twice), ["key", "code"])
        seen |= set(f.columns)
    return out


def columns(frame: DataFrame, keep: list[str] | None, exclude: list[str] | None, text: bool = True) -> DataFrame:
    names = frame.columns
    unknown = (set(keep or ()) | set(exclude or ())) - set(names)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    if set(keep or ()) & set(exclude or ()):
        raise ValueError("columns both kept and dropped")
    strings = {n for n, kind in frame.dtypes if kind == "string"} if text else set()
    return frame.select(*(c for c in names if c in ("key", "code") or ((keep is None or c in keep or c in strings) and c not in (exclude or ()))))


def inner_on_day(frames: list[DataFrame], day: str = "day_idx") -> list[DataFrame]:
    """Frames cut down to the days that all of them have."""
    days = reduce(lambda a, b: a.join(b, day), [f.select(day).distinct() for f in frames])
    return [f.join(F.broadcast(days) if days.count() < 100_000 else days, day, "left_semi") for f in frames]
