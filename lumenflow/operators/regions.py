"""Structure of control flow: nested regions found by reducing each method's graph, pattern by pattern."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOPS = ("self_loop", "while_loop", "do_while_loop", "natural_loop")
SCHEMA = "method long, region long, kind string, header long, blocks array<long>, parent long"


class Reduction:
    """One method's graph while it shrinks. Regions take ids below zero, blocks keep theirs."""

    def __init__(self, follow: dict[int, list[int]], handlers: dict[int, set[int]], entry: int):
        self.follow, self.handlers, self.entry = {entry: []}, {}, entry
        work = [entry]
        while work:  # what no way leads to is left out
            n = work.pop()
            self.follow[n], self.handlers[n] = [m for m in dict.fromkeys(follow.get(n, ()))], set(handlers.get(n, ()))
            work += [m for m in [*self.follow[n], *self.handlers[n]] if m not in self.follow and not self.follow.setdefault(m, [])]
        self.before: dict[int, set[int]] = {n: set() for n in self.follow}
        for n in self.follow:
            for m in [*self.follow[n], *self.handlers[n]]:
                self.before[m].add(n)
        self.found: list[tuple[int, str, int, list[int], set[int]]] = []
        self.blocks, self.head, self.kind = {n: {n} for n in self.follow}, {n: n for n in self.follow}, {}

    def merge(self, kind: str, first: int, others: list[int], caught: int | None = None) -> int:
        """Replace ``first`` and ``others`` by a region. A way back to ``first`` stays, as a way to itself, unless a loop is made."""
        members = [first, *others]
        inside, r = set(members), -len(self.found) - 1
        out = [m for n in members for m in self.follow[n] if m not in inside]
        if kind not in LOOPS and any(first in self.follow[n] for n in members):
            out.append(r)
        self.follow[r] = list(dict.fromkeys(out))
        self.handlers[r] = {h for n in members for h in self.handlers[n] if h not in inside and h != caught}
        self.before[r] = {n for n in self.before[first] | set().union(*(self.before[o] for o in others)) if n not in inside}
        for n in self.before[r]:
            self.follow[n] = list(dict.fromkeys(r if m in inside else m for m in self.follow[n]))
            self.handlers[n] = {r if m in inside else m for m in self.handlers[n]}
        for m in {*self.follow[r], *self.handlers[r]}:
            self.before[m] = (self.before[m] - inside) | {r}
        self.blocks[r], self.head[r], self.kind[r] = set().union(*(self.blocks[n] for n in members)), self.head[first], kind
        self.found.append((r, kind, self.head[r], members, self.blocks[r]))
        if self.entry in inside:
            self.entry = r
        for n in members:
            del self.follow[n], self.handlers[n], self.before[n]
        return r

    def match(self, n: int, exits: bool) -> tuple[str, list[int], int | None] | None:
        """The pattern that begins at ``n``: its kind, the other members, a handler it uses up.

        Sides that end the method count only with ``exits``, when no loop is left: before that they may leave a loop.
        """
        to, held = self.follow[n], self.handlers[n]
        only = lambda m: m != n and m != self.entry and self.before[m] == {n}
        same = lambda *ms: all(self.handlers[m] == held for m in ms)
        ends = lambda *ms: {x for m in ms for x in self.follow[m]}
        if len(held) == 1:
            h = next(iter(held))
            if only(h) and h not in to and not self.handlers[h] and n not in to and len(ends(n, h)) <= 1 and n not in ends(h):
                return "try_catch", [h], h
        if n in to:
            return ("do_while_loop" if self.kind.get(n) == "block" else "self_loop"), [], None
        if len(to) == 1 and only(to[0]) and same(to[0]):
            return "block", [to[0]], None
        if len(to) == 2:
            for a, b in (to, to[::-1]):
                if only(a) and same(a) and self.follow[a] == [n]:
                    return "while_loop", [a], None
            a, b = to
            if only(a) and only(b) and same(a, b) and len(ends(a, b)) <= 1 and (self.follow[a] == self.follow[b]) and not ends(a, b) & {n, a, b}:
                return "if_else", [a, b], None
            for a, b in (to, to[::-1]):
                if only(a) and same(a) and self.follow[a] == [b]:
                    return "if", [a], None
            for a, _ in (to, to[::-1]) if exits else ():
                if only(a) and same(a) and not self.follow[a]:
                    return "if_exit", [a], None
        if len(to) > 2:
            arms = [m for m in to if only(m) and (exits or self.follow[m])]
            after = ends(*arms) | {m for m in to if m not in arms}
            if arms and same(*arms) and len(after) <= 1 and n not in after:
                return "switch", arms, None
        return None

    def order(self) -> list[int]:
        """Reachable nodes, each behind all it leads to but for ways back."""
        out, seen, stack = [], {self.entry}, [(self.entry, iter([*self.follow[self.entry], *self.handlers[self.entry]]))]
        while stack:
            n, rest = stack[-1]
            m = next(rest, None)
            if m is None:
                out.append(n)
                stack.pop()
            elif m not in seen:
                seen.add(m)
                stack.append((m, iter([*self.follow[m], *self.handlers[m]])))
        return out

    def loop(self) -> tuple[int, list[int]] | None:
        """The smallest natural loop: header and the rest. Its header is on every way from the entry into it."""
        best = None
        for h in self.follow:
            body: set[int] = set()
            for m in self.before[h] - {h}:
                got, work = {m}, [m]
                while work and (self.entry not in got or h == self.entry):
                    for q in self.before[work.pop()]:
                        if q != h and q not in got:
                            got.add(q)
                            work.append(q)
                if self.entry not in got:
                    body |= got
            if body and (best is None or (len(body), self.head[h]) < best[0]):
                best = (len(body), self.head[h]), h, sorted(body, key=self.head.get)
        return best and best[1:]

    def run(self) -> list[tuple[int, str, int, list[int], int | None]]:
        """(region, kind, header, blocks, parent), inner regions first."""
        exits = False
        while len(self.follow) > 1 or self.follow[self.entry]:
            moved = False
            for n in self.order():
                while n in self.follow and (hit := self.match(n, exits)):
                    n, moved = self.merge(hit[0], n, *hit[1:]), True
            if moved:
                exits = False
            elif cycle := self.loop():
                self.merge("natural_loop", *cycle)
            elif not exits:
                exits = True
            else:
                self.merge("abstract", self.entry, [n for n in reversed(self.order()) if n != self.entry])
        parent = {m: r for r, _, _, members, _ in self.found for m in members if m < 0}
        return [(-r, kind, head, sorted(blocks), -parent[r] if r in parent else None) for r, kind, head, _, blocks in self.found]


def regions(edges: DataFrame) -> DataFrame:
    """method, region, kind, header, blocks, parent: regions numbered from 1 a method, inner before outer.

    edges: (method, src, succ_idx, dst, exceptional); methods begin in block 0. Kinds: block (a sequence), if, if_else,
    if_exit (the side ends the method), switch, self_loop, while_loop, do_while_loop, natural_loop (whatever else a
    loop of one header is), try_catch, and abstract for the rest, which has several entries or no pattern. A method of
    a single block has none. A method's graph is small; methods run in parallel.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        follow: dict[int, list[int]] = {}
        handlers: dict[int, set[int]] = {}
        for a, _, b, thrown in sorted(zip(frame["src"], frame["succ_idx"], frame["dst"], frame["exceptional"])):
            if thrown:
                handlers.setdefault(int(a), set()).add(int(b))
            else:
                follow.setdefault(int(a), []).append(int(b))
        handlers = {n: hs - set(follow.get(n, ())) for n, hs in handlers.items()}
        rows = [(int(frame["method"].iloc[0]), *r) for r in Reduction(follow, handlers, 0).run()]
        return pd.DataFrame(rows, columns=["method", "region", "kind", "header", "blocks", "parent"]).astype({"parent": "Int64"})

    return edges.select("method", "src", "succ_idx", "dst", F.coalesce("exceptional", F.lit(False)).alias("exceptional")).groupBy("method").applyInPandas(one, SCHEMA)
