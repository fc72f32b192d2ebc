"""Currency paths: a small graph of reference streams, searched on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice


@dataclass(frozen=True, order=True)
class Edge:
    to: str
    stream_id: str
    source: str
    inverse: bool


def graph(instruments: list[tuple[str, str, str]]) -> dict[str, list[Edge]]:
    """Edges of (stream, base, quote): base to quote at the price, quote to base at its inverse."""
    out: dict[str, list[Edge]] = {}
    for stream, base, quote in instruments:
        out.setdefault(base, []).append(Edge(quote, stream, base, False))
        out.setdefault(quote, []).append(Edge(base, stream, quote, True))
    return {k: sorted(v) for k, v in out.items()}


class TooManyPaths(ValueError):
    """More paths than the limit: the search is refused, none is left out."""


def _walk(edges: dict[str, list[Edge]], path: tuple[Edge, ...], seen: frozenset[str], at: str, target: str, hops: int) -> Iterator[tuple[Edge, ...]]:
    for e in edges.get(at, []) if hops else []:
        if e.to == target:
            yield (*path, e)
        elif e.to not in seen:
            yield from _walk(edges, (*path, e), seen | {e.to}, e.to, target, hops - 1)


def paths(edges: dict[str, list[Edge]], source: str, target: str, max_hops: int = 3, limit: int = 32) -> list[tuple[Edge, ...]]:
    """Simple paths depth first, neighbours by (to, stream): the first that has prices decides a rate. Over ``limit`` it refuses."""
    if source == target:
        return [()]
    found = list(islice(_walk(edges, (), frozenset([source]), source, target, max_hops), limit + 1))
    if len(found) > limit:
        raise TooManyPaths(f"more than {limit} paths from {source} to {target}")
    return found
