"""Choosing bridges: connected groups of candidates, matched each in a task (blossoms, then exchanges), larger ones by tiles; phases, crossing checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.operators.cells import boxes_meet
from tesselar.operators.endpoints import unique_pairs, without_used
from tesselar.operators.graph import KEY, linked_groups
from tesselar.operators.state import Steps

COLUMNS = [*KEY, "distance", "cost", "profile"]
#: Ends of a connected group of candidates up to which all its matchings are weighed; how deep exchanges go in larger ones.
EXACT = 12
DEPTH = 5
#: Candidates of a group that one task matches, and the side of the squares by which larger groups are measured.
LARGEST = 400_000
COARSE = 2000
#: Cheapest candidates of an end by which larger groups are matched first, and candidates of a tile in which what stays free meets all of them.
FEW, WHOLE = 8, 50_000


def mutual_pairs(candidates: DataFrame) -> DataFrame:
    """Rounds: every end names its best candidate (profile first, then cost, then points); a pair named from both ends is taken.

    The best remaining candidate of all is always taken, so every round makes progress; drawings without one drop out. A round is one job:
    it writes what is taken and what stays open, and counts the latter.
    """
    steps = Steps(candidates.sparkSession)
    profile = F.col("profile") if "profile" in candidates.columns else F.lit(False)
    flags = [F.lit(False).alias("taken"), F.lit(True).alias("open")]
    left, n = steps.cut_and_count(candidates.select(*KEY, "distance", "cost", profile.alias("profile"), *flags), F.lit(True))
    out = left.where("taken")
    while n:
        rank = F.struct((~F.col("profile")).alias("p"), F.round("cost", 9).alias("c"), *KEY[1:])
        sides = [left.select("drawing_id", F.col(f"{s}x").alias("x"), F.col(f"{s}y").alias("y"), rank.alias("r")) for s in "ab"]
        best = sides[0].unionByName(sides[1]).groupBy("drawing_id", "x", "y").agg(F.min("r").alias("best"))
        named = best.groupBy("drawing_id", *(F.col(f"best.{c}").alias(c) for c in KEY[1:])).count().where("count = 2").drop("count")
        used = named.select("drawing_id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select("drawing_id", "e.x", "e.y", F.lit(True).alias("u"))
        now = left.drop("taken", "open").join(named.withColumn("taken", F.lit(True)), KEY, "left")
        for p in "ab":
            now = now.join(used.withColumnsRenamed({"x": f"{p}x", "y": f"{p}y", "u": f"u{p}"}), ["drawing_id", f"{p}x", f"{p}y"], "left")
        now = now.withColumns({"taken": F.coalesce("taken", F.lit(False)), "open": F.col("ua").isNull() & F.col("ub").isNull()}).where("taken or open")
        now, n = steps.cut_and_count(now.select(*COLUMNS, "taken", "open"), F.col("open"))
        out = out.unionByName(now.where("taken"))
        left = now.where("open")
    return out.select(*COLUMNS)


def best_matching(edges: list[tuple[int, int, bool, float]], n: int) -> list[int]:
    """Places of the edges (end, end, profile, cost) of the best matching of n ends: most pairs, then most profiles, then least cost, then first places."""
    at: list[list[int]] = [[] for _ in range(n)]
    for k, (a, b, _, _) in enumerate(edges):
        at[a].append(k)
        at[b].append(k)

    @lru_cache(maxsize=None)
    def best(free: int) -> tuple[int, int, float, tuple[int, ...]]:
        if not free:
            return 0, 0, 0.0, ()
        low = (free & -free).bit_length() - 1
        top = best(free & ~(1 << low))
        for k in at[low]:
            a, b, profile, cost = edges[k]
            other = b if a == low else a
            if free >> other & 1:
                pairs, profiles, less, chosen = best(free & ~(1 << low) & ~(1 << other))
                mine = (pairs + 1, profiles + profile, round(less - cost, 9), tuple(sorted((*chosen, k))))
                if mine[:3] > top[:3] or (mine[:3] == top[:3] and mine[3] < top[3]):
                    top = mine
        return top

    return list(best((1 << n) - 1)[3])


# ---- matching of a group inside a task ----------------------------------------------------------


class Graph:
    """Ends 0..n-1 and edges (end, end, profile, cost) in a fixed order; a matching as each end's partner."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, profile: np.ndarray, cost: np.ndarray):
        self.n = n
        #: A profile pair outweighs any sum of costs.
        heavy = 1.0 + 2.0 * sum(np.abs(cost).tolist())
        low, high, w = np.minimum(a, b), np.maximum(a, b), np.where(profile, cost - heavy, cost)
        order = np.lexsort((w, high, low))
        low, high, w = low[order], high[order], w[order]
        once = np.ones(len(w), bool)
        once[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        low, high, w = low[once], high[once], w[once]
        self.weight: dict[tuple[int, int], float] = dict(zip(zip(low.tolist(), high.tolist(), strict=True), w.tolist(), strict=True))
        order = np.lexsort((high, low, w))
        self.cheapest = list(zip(low[order].tolist(), high[order].tolist(), strict=True))
        at, to, w = np.concatenate([low, high]), np.concatenate([high, low]), np.concatenate([w, w])
        order = np.lexsort((to, w, at))
        pairs = list(zip(w[order].tolist(), to[order].tolist(), strict=True))
        first = np.searchsorted(at[order], np.arange(n + 1)).tolist()
        self.near: list[list[tuple[float, int]]] = [pairs[i:j] for i, j in zip(first, first[1:], strict=False)]
        self.mate = [-1] * n

    def greedy(self) -> None:
        for a, b in self.cheapest:
            if self.mate[a] < 0 and self.mate[b] < 0:
                self.mate[a], self.mate[b] = b, a

    def augment(self) -> None:
        """As many pairs as possible: a search tree from every free end, odd cycles (blossoms) taken together as they are found.

        A tree that reaches no other free end is left out of all later searches: no augmenting path meets it.
        """
        left_out = [False] * self.n
        for root in range(self.n):
            if self.mate[root] < 0 and self.near[root] and not left_out[root]:
                for v in self._search(root, left_out):
                    left_out[v] = True

    def _search(self, root: int, left_out: list[bool]) -> list[int]:
        mate, near = self.mate, self.near
        before = {root: -1}  # how an end was reached, for odd ends and for ends of blossoms
        up = {root: root}  # the base of the blossom that an end of the tree is in, by pointers
        even = {root}
        queue = [root]

        def base(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        def common(a: int, b: int) -> int:
            """The first base that both ends' ways to the root meet in, found by steps on both ways in turn."""
            seen = set()
            a, b = base(a), base(b)
            while True:
                if a >= 0:
                    if a in seen:
                        return a
                    seen.add(a)
                    a = base(before[mate[a]]) if mate[a] >= 0 else -1
                a, b = b, a

        def shrink(v: int, to: int, child: int) -> None:
            while base(v) != to:
                other = mate[v]
                before[v] = child
                if other not in even:
                    even.add(other)
                    queue.append(other)
                for x in (base(v), base(other)):
                    up[x] = to
                child, v = other, before[other]

        for v in queue:
            for _, to in near[v]:
                if left_out[to] or mate[v] == to:
                    continue
                if to not in up:
                    before[to] = v
                    up[to] = to
                    if mate[to] < 0:  # an augmenting path
                        while to >= 0:
                            back = before[to]
                            ahead = mate[back]
                            mate[to], mate[back] = back, to
                            to = ahead
                        return []
                    other = mate[to]
                    up[other] = other
                    even.add(other)
                    queue.append(other)
                elif to in even and base(v) != base(to):
                    top = common(v, to)
                    shrink(v, top, to)
                    shrink(to, top, v)
        return list(up)

    def improve(self, depth: int, first: list[int] | None = None) -> None:
        """Exchanges along alternating cycles of up to ``2 * depth`` edges, and alternating paths from free ends, while they make pairs cheaper.

        A cycle that gains has a place to start from where every partial sum gains, so others are not followed. ``first``: ends to start from, all if not given.
        """
        mate, near = self.mate, self.near
        todo = list(range(self.n)) if first is None else first
        while todo:
            queue, todo = todo, []
            for u in queue:
                if near[u] and (ends := self._exchange(u, depth)):
                    todo += [x for e in ends for x in ((e,) if mate[e] < 0 else (e, mate[e]))]
            todo = sorted(set(todo))

    def _exchange(self, u: int, depth: int) -> list[int]:
        mate, near, weight = self.mate, self.near, self.weight
        get = lambda a, b: weight.get((a, b) if a < b else (b, a))
        free = mate[u] < 0
        least = 1e-7

        def follow(v: int, gain: float, path: list[int]) -> list[int]:
            """``v`` has lost its partner, the sum so far is ``gain``; path: ends to be paired, two by two."""
            for w, x in near[v]:
                if not free and w >= gain - least:
                    break
                y = mate[x]
                if y < 0 or x == u or x in path or x == v:
                    continue
                now = gain - w + get(x, y)
                way = [*path, v, x]
                if free:
                    if now > least:
                        return [*way, y, -1]
                elif (last := get(y, u)) is not None and now - last > least:
                    return [*way, y, u]
                if len(way) < 2 * (2 if free else depth - 1) and (found := follow(y, now, way)):
                    return found
            return []

        found = follow(u, 0.0, []) if free else follow(mate[u], get(u, mate[u]), [])
        for a, b in zip(found[::2], found[1::2], strict=True):
            if b < 0:
                mate[a] = -1
            else:
                mate[a], mate[b] = b, a
        return [x for x in found if x >= 0]


def solve_group(edges: list[tuple[int, int, bool, float]], n: int, depth: int = DEPTH, start: list[tuple[int, int]] | None = None, fresh: list[int] | None = None) -> list[int]:
    """Places of the edges chosen: most pairs in a group of any size; of these the best up to EXACT ends, beyond that one that no exchange of up to
    ``2 * depth`` edges makes better (more profiles, then less cost).

    ``start``: pairs of a matching that is as good as exchanges make it without the edges of the ends ``fresh``; only what these and free ends change is done."""
    columns = zip(*edges, strict=True) if edges else ((), (), (), ())
    return _solve(*(np.array(c, t) for c, t in zip(columns, (np.int64, np.int64, bool, float), strict=True)), n, depth, start, fresh)


def _solve(a: np.ndarray, b: np.ndarray, profile: np.ndarray, cost: np.ndarray, n: int, depth: int = DEPTH, start: list | None = None, fresh: list | None = None) -> list[int]:
    if n <= EXACT:
        return best_matching(list(zip(a.tolist(), b.tolist(), profile.tolist(), cost.tolist(), strict=True)), n)
    g = Graph(n, a, b, profile, cost)
    for u, v in start or []:
        g.mate[u], g.mate[v] = v, u
    g.greedy()
    g.improve(depth, fresh)
    before = list(g.mate)
    g.augment()
    g.improve(depth, None if fresh is None else [k for k in range(n) if g.mate[k] != before[k]])
    place: dict[tuple[int, int], int] = {}
    for k in np.flatnonzero(np.array(g.mate, np.int64)[a] == b).tolist():
        key = (int(min(a[k], b[k])), int(max(a[k], b[k])))
        if key not in place or (not profile[k], cost[k]) < (not profile[place[key]], cost[place[key]]):
            place[key] = k
    return sorted(place.values())


#: Rows of a tile: candidates, pairs chosen before that lie within it, and pairs chosen before that stay as they cross its border.
CANDIDATE, CHOSEN, STAYS = 0, 1, 2


def _numbered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of points in the order of their first places."""
    order = np.lexsort((y, x))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    group = np.empty(len(x), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]  # the sort is stable
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[group]


def _solved(rows: pa.Table, flags: bool) -> pa.Table:
    """Candidates of one group: those of the general matching, with ``flags`` also those of the phased one (column ``phase``). Tiles have a ``kind`` of their rows,
    and whether a candidate is ``fresh``: in no earlier tile."""
    get = lambda c: rows.column(c).to_numpy()
    tiles = "kind" in rows.schema.names
    kind = get("kind") if tiles else np.zeros(len(rows), np.int64)
    order = np.lexsort((get("by"), get("bx"), get("ay"), get("ax"), kind))
    n = int((kind == CANDIDATE).sum())
    number = _numbered(*(np.concatenate([get(f"a{c}")[order], get(f"b{c}")[order]]) for c in "xy"))
    a, b = number[: len(rows)], number[len(rows) :]
    start, ends = [], None
    if tiles:
        kind = kind[order]
        stays = np.zeros(len(number), bool)
        stays[np.concatenate([a[kind == STAYS], b[kind == STAYS]])] = True
        start = list(zip(a[kind == CHOSEN].tolist(), b[kind == CHOSEN].tolist(), strict=True))
        order, a, b = order[:n], a[:n], b[:n]
        open_ = ~stays[a] & ~stays[b]
        order, a, b = order[open_], a[open_], b[open_]
        inner, small = np.unique(np.concatenate([a, b, np.array(start, np.int64).ravel()]), return_inverse=True)
        fresh = get("fresh")[order]
        n, count = len(a), len(inner)
        a, b, pairs = small[:n], small[n : 2 * n], small[2 * n :].reshape(-1, 2)
        start = [tuple(p) for p in pairs.tolist()]
        ends = np.unique(np.concatenate([a[fresh], b[fresh]])).tolist() if start else None
    else:
        count = int(number.max()) + 1 if len(number) else 0
    profile, cost = get("profile")[order].astype(bool), get("cost")[order].astype(float)
    chosen = [(k, "general") for k in _solve(a, b, profile, cost, count, DEPTH, start, ends)]
    if flags:
        used = np.zeros(count, bool)
        for name in ("profile", "micro"):
            open_ = np.flatnonzero(get(name)[order].astype(bool) & ~used[a] & ~used[b])
            times = np.bincount(np.concatenate([a[open_], b[open_]]), minlength=count)
            lone = open_[(times[a[open_]] == 1) & (times[b[open_]] == 1)]
            used[a[lone]] = used[b[lone]] = True
            chosen += [(k, "phased") for k in lone.tolist()]
        rest = np.flatnonzero(~used[a] & ~used[b])
        again: dict[int, int] = {}
        left = [[again.setdefault(e, len(again)) for e in pair] for pair in zip(a[rest].tolist(), b[rest].tolist(), strict=True)]
        left = np.array(left, np.int64).reshape(-1, 2)
        chosen += [(int(rest[k]), "phased") for k in _solve(left[:, 0], left[:, 1], profile[rest], cost[rest], len(again))]
    out = rows.take(order[np.array([k for k, _ in chosen], np.int64)]).select(COLUMNS)
    return out.append_column("phase", pa.array([p for _, p in chosen], pa.string()))


def _by_group(rows: DataFrame, group: list[str], flags: bool, tasks: int) -> DataFrame:
    """Every group solved in a task; groups come one after another, none is held but the one that is read."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            keys = list(zip(*(whole.column(c).to_pylist() for c in group), strict=True))
            start = 0
            for k in range(len(keys) + 1):
                if k < len(keys) and keys[k] == now:
                    continue
                if k > start:
                    held.append(whole.slice(start, k - start))
                if k == len(keys):
                    break
                if held:
                    yield from _solved(pa.concat_tables(held).combine_chunks(), flags).to_batches()
                held, now, start = [], keys[k], k
        if held:
            yield from _solved(pa.concat_tables(held).combine_chunks(), flags).to_batches()

    more = [c for c in ("micro", "kind", "fresh") if c in rows.columns and (c != "micro" or flags)]
    columns = [*group, *(c for c in [*COLUMNS, *more] if c not in group)]
    return rows.select(*columns).repartition(tasks, *group).sortWithinPartitions(*group).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in COLUMNS), "phase string"]))


# ---- groups over a table ------------------------------------------------------------------------


def close_ones(rows: pa.Table, a: np.ndarray, b: np.ndarray, few: int = FEW) -> np.ndarray:
    """Which candidates are profiles, micro gaps, or among the ``few`` cheapest of one of their ends in these rows (so those of all rows are among them)."""
    get = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
    close = get("profile").astype(bool)
    if "micro" in rows.schema.names:
        close = close | get("micro").astype(bool)
    at = np.concatenate([a, b])
    order = np.lexsort((np.tile(get("cost").astype(float), 2), at))
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    near = np.zeros(len(order), bool)
    near[order] = rank < few
    return close | near[: len(a)] | near[len(a) :]


def _side(candidates: DataFrame, most: int) -> int:
    """Side of tiles with about so many candidates where they are densest."""
    fine = candidates.select("drawing_id", *(F.floor(F.col(c) / COARSE).alias(k) for c, k in (("ax", "i"), ("ay", "j")))).groupBy("drawing_id", "i", "j").count()
    densest = fine.agg(F.max("count")).first()[0] or 1
    return COARSE * max(1, int((most / densest) ** 0.5))


def tiled(candidates: DataFrame, largest: int, steps: Steps, used: DataFrame | None = None) -> DataFrame:
    """A matching of groups too large for a task, without the ends of the pairs ``used``: by tiles of ``in_tiles``.

    Where candidates are marked ``close``, these alone are matched first: a dense drawing has some fifty candidates for each end, and few of them are ever chosen.
    Then all candidates of the tiles that still have a free end are matched on from that, so no end is left alone for want of a candidate.
    """
    marked = "close" in candidates.columns
    near = candidates.where("close") if marked else candidates
    if used is not None:
        near = without_used(near, used)
    near = steps.cut(near)
    chosen = in_tiles(near, _side(near, largest), steps)
    if not marked:
        return chosen
    ends = lambda df: df.select("drawing_id", F.explode(F.array(*(F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab"))).alias("e")).select("drawing_id", "e.x", "e.y")
    taken = ends(chosen if used is None else chosen.select(*KEY).unionByName(used.select(*KEY)))
    free = steps.cut(ends(candidates).distinct().join(taken, ["drawing_id", "x", "y"], "left_anti"))
    return chosen if free.isEmpty() else in_tiles(candidates, _side(candidates, min(WHOLE, largest)), steps, chosen, free, used)


def in_tiles(candidates: DataFrame, side: int, steps: Steps, chosen: DataFrame | None = None, free: DataFrame | None = None, used: DataFrame | None = None) -> DataFrame:
    """A matching by square tiles of the plane, and again by tiles moved half a side in either direction.

    In every round a tile has the candidates that lie within it, but for ends paired across its border; these pairs stay. The pairs inside are where the next
    round starts: it follows what candidates that no earlier tile had, and free ends, change. So a round never loses pairs. What may be missing are
    augmenting paths that leave a tile in all four positions. ``chosen``: a matching of the close candidates to start from; then only tiles with a point of ``free``
    are asked, moved by a quarter, as they may hold ways that all earlier ones have cut.
    """
    moved = 0 if chosen is None else side // 4
    tile = lambda c, d: F.floor((F.col(c) + d * (side // 2) + moved) / side).cast("bigint")
    within = lambda d: (tile("ax", d[0]) == tile("bx", d[0])) & (tile("ay", d[1]) == tile("by", d[1]))
    at = ["drawing_id", "ti", "tj"]
    placed = lambda df, p, d: df.withColumns({"ti": tile(f"{p}x", d[0]), "tj": tile(f"{p}y", d[1])})
    kind = lambda df, k, fresh: df.select(*COLUMNS, F.lit(k).cast("long").alias("kind"), fresh.alias("fresh"), "ti", "tj")
    seen = F.lit(False) if chosen is None else F.col("close")
    for d in ((0, 0), (1, 1), (1, 0), (0, 1)):
        asked = None if free is None else steps.cut(free.select("drawing_id", tile("x", d[0]).alias("ti"), tile("y", d[1]).alias("tj")).distinct())
        of = lambda df: df if asked is None else df.join(asked, at, "left_semi")  # noqa: B023, E731
        rows = of(placed(candidates.where(within(d)), "a", d))
        rows = kind(rows if used is None else without_used(rows, used), CANDIDATE, ~seen)
        kept = None
        if chosen is not None:
            inside, across = placed(chosen.where(within(d)), "a", d), chosen.where(~within(d))
            kept = across if asked is None else across.unionByName(inside.join(asked, at, "left_anti").select(*COLUMNS))
            rows = rows.unionByName(kind(of(inside), CHOSEN, F.lit(False)))
            for p in "ab":
                rows = rows.unionByName(kind(of(placed(across, p, d)), STAYS, F.lit(False)))
        found = _by_group(rows, at, False, steps.tasks()).drop("phase")
        chosen = steps.cut(found if kept is None else found.unionByName(kept.select(*COLUMNS)))
        seen = seen | within(d)
    return chosen


def grouped(candidates: DataFrame, steps: Steps, largest: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidates with their connected group (gx, gy: its smallest end): those of groups of up to ``largest`` candidates, and the others, ``close`` marked, if there are any."""
    named = linked_groups(candidates, steps, mark=close_ones)
    group = ["drawing_id", "gx", "gy"]
    large = steps.cut(named.groupBy(*group).count().where(F.col("count") > largest).select(*group))
    if large.isEmpty():
        return named, None
    few = F.broadcast(large)  # at most a row for every ``largest`` candidates
    return named.join(few, group, "left_anti"), steps.cut(named.join(few, group, "left_semi").drop("gx", "gy"))


def match_general(candidates: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Most pairs, of these the most profiles, of these the cheapest: see ``solve_group`` for groups of up to ``largest`` candidates, ``tiled`` beyond."""
    steps = Steps(candidates.sparkSession)
    every, rest = grouped(candidates.select(*COLUMNS), steps, largest)
    small = _by_group(every, ["drawing_id", "gx", "gy"], False, steps.tasks()).drop("phase")
    return small if rest is None else small.unionByName(tiled(rest, largest, steps))


def match_adopt(candidates: DataFrame, largest: int = LARGEST) -> DataFrame:
    """By drawing the phased pairs if they are at least as many as the general ones. Both are found in one pass over the groups: what a phase takes
    depends on its own group alone."""
    steps = Steps(candidates.sparkSession)
    every, rest = grouped(candidates.select(*COLUMNS, "micro"), steps, largest)
    both = _by_group(every, ["drawing_id", "gx", "gy"], True, steps.tasks())
    if rest is not None:
        one = steps.cut(unique_pairs(rest.where("profile")))
        two = unique_pairs(without_used(rest.where("micro"), one))
        lone = steps.cut(one.unionByName(two).select(*COLUMNS))
        both = both.unionByName(tiled(rest, largest, steps).withColumn("phase", F.lit("general")))
        both = both.unionByName(tiled(rest, largest, steps, lone).unionByName(lone).withColumn("phase", F.lit("phased")))
    both = steps.cut(both)
    counts = both.groupBy("drawing_id").agg(F.count_if(F.col("phase") == "phased").alias("p"), F.count_if(F.col("phase") == "general").alias("g"))
    wanted = counts.select("drawing_id", F.when(F.col("p") >= F.col("g"), "phased").otherwise("general").alias("phase"))
    return both.join(wanted, ["drawing_id", "phase"], "left_semi").select(*COLUMNS)


def not_crossing(bridges: DataFrame, segments: DataFrame, cell: float = 1000.0) -> DataFrame:
    """Bridges that no segment crosses away from the bridge's ends."""
    box = lambda df, p, x1, y1, x2, y2: df.withColumns({f"{p}x0": F.least(x1, x2) - 1, f"{p}y0": F.least(y1, y2) - 1, f"{p}x1": F.greatest(x1, x2) + 1, f"{p}y1": F.greatest(y1, y2) + 1})
    a = box(bridges.select("drawing_id", *(F.col(c).alias(f"p{c}") for c in KEY[1:])), "a", "pax", "pay", "pbx", "pby")
    b = box(segments.select("drawing_id", F.col("x1").alias("sx"), F.col("y1").alias("sy"), F.col("x2").alias("ex"), F.col("y2").alias("ey")), "b", "sx", "sy", "ex", "ey")
    near = boxes_meet(a, b, cell)
    c = {k: F.col(k).cast("double") for k in ("pax", "pay", "pbx", "pby", "sx", "sy", "ex", "ey")}
    turn = lambda px, py, qx, qy, rx, ry: F.signum((c[qx] - c[px]) * (c[ry] - c[py]) - (c[qy] - c[py]) * (c[rx] - c[px]))
    proper = (turn("pax", "pay", "pbx", "pby", "sx", "sy") * turn("pax", "pay", "pbx", "pby", "ex", "ey") < 0) & (turn("sx", "sy", "ex", "ey", "pax", "pay") * turn("sx", "sy", "ex", "ey", "pbx", "pby") < 0)
    bad = near.where(proper).select("drawing_id", *(F.col(f"p{k}").alias(k) for k in KEY[1:])).distinct()
    return bridges.join(bad, KEY, "left_anti")
