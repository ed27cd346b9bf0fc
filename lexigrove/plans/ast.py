"""Nodes of the query language. Frozen, so that equal subtrees are equal keys."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    pass


# Unscored: sets of extents.


@dataclass(frozen=True)
class Term(Node):
    text: str
    verbatim: bool = False


@dataclass(frozen=True)
class Wildcard(Node):
    prefix: str


@dataclass(frozen=True)
class Syn(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class WSyn(Node):
    weights: tuple[float, ...]
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Ordered(Node):
    width: int  # -1: unlimited
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Unordered(Node):
    width: int
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Both(Node):
    """Extents in which all children overlap."""

    children: tuple[Node, ...]


@dataclass(frozen=True)
class Inside(Node):
    inner: Node
    outer: Node


@dataclass(frozen=True)
class AnyField(Node):
    name: str


@dataclass(frozen=True)
class Compare(Node):
    """Extents of a numeric field with low <= number <= high; None is open."""

    field: str
    low: int | None
    high: int | None


@dataclass(frozen=True)
class Path(Node):
    """Fields `name` that are children, descendants or parents of the extents of `outer`, or inside them."""

    axis: str
    name: str
    outer: Node | None = None


@dataclass(frozen=True)
class Empty(Node):
    """A term that occurs nowhere or is stopped."""


# Scored.


@dataclass(frozen=True)
class Leaf(Node):
    extents: Node
    context: Node | None = None


@dataclass(frozen=True)
class Weighted(Node):
    """weight, wand and combine: the weighted mean of logs; `sum`: the log of the weighted mean."""

    kind: str
    weights: tuple[float, ...]
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    child: Node


@dataclass(frozen=True)
class Max(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Prior(Node):
    name: str


@dataclass(frozen=True)
class LengthPrior(Node):
    exponent: float
    child: Node


@dataclass(frozen=True)
class Filter(Node):
    """child where the condition has an extent (keep) or has none."""

    keep: bool
    condition: Node
    child: Node


@dataclass(frozen=True)
class Restrict(Node):
    """child scored in each extent of `to` instead of in whole documents."""

    to: Node
    child: Node


@dataclass(frozen=True)
class Passages(Node):
    width: int
    step: int
    child: Node


@dataclass(frozen=True)
class Include(Node):
    """Results of `inner`, a restriction, inside extents of `outer`, in which `context` is scored."""

    outer: Node
    context: Node
    inner: Node


@dataclass(frozen=True)
class Plus(Node):
    """Baseline: the plain sum of term scores, with the terms' frequencies in the query."""

    frequencies: tuple[float, ...]
    children: tuple[Node, ...]


def children(node: Node) -> list[Node]:
    out = []
    for v in node.__dict__.values():
        if isinstance(v, Node):
            out.append(v)
        elif isinstance(v, tuple):
            out += [x for x in v if isinstance(x, Node)]
    return out


def rebuild(node: Node, change) -> Node:
    """node with change() applied to every node, children first."""
    new = {}
    for k, v in node.__dict__.items():
        if isinstance(v, Node):
            v = rebuild(v, change)
        elif isinstance(v, tuple):
            v = tuple(rebuild(x, change) if isinstance(x, Node) else x for x in v)
        new[k] = v
    return change(type(node)(**new))
