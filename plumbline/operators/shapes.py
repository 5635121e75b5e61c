"""The shape of a graph, names aside: canonical forms by refinement and individualisation, and what follows from them.

A graph is taken apart into its components. Colours start from node kinds and are refined by the colours of the neighbours, by direction
and relation, until no cell of equal colours falls apart, for many graphs at once; what changed is told on and nothing else. A node that has a colour to itself is settled:
a component of settled nodes is told by its colours and those at the ends of its edges. In other components the edges of settled nodes, and those
that every node of a cell has to every node of a cell, are told by the colours; without them the rest falls into components, which are brought into
canonical form one by one, and looked up where seen before. A component all of whose nodes are tied is split by giving one node of its smallest class a colour of its own, for
each node of that class in turn; branches that do not refine to the least histogram are dropped, nodes that a symmetry
found on the way makes equal to one that was tried are skipped, and the least form counts. Two graphs have the same form
just when they are isomorphic (up to equal 64-bit hashes, and mappings are checked edge by edge before they are used).

Every snapshot gets its form once, whatever its size, in a task that holds graph after graph; which snapshots are
compared is then a window or a join over one value a snapshot.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources import lineage

#: Rows of whole graphs that a worker takes together.
TOGETHER = 300_000

_U = np.uint64


def _mix(x):
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _digest(*parts) -> int:
    """One number for arrays of numbers, in order."""
    out = np.zeros(1, _U)
    for part in parts:
        part = np.atleast_1d(np.asarray(part, _U))
        place = np.arange(len(part), dtype=_U) * _U(0x9E3779B97F4A7C15)
        out = _mix(out + _mix(part + place).sum(dtype=_U) + _U(len(part)))
    return int(out[0])


class _Undecided(Exception):
    pass


class _Edges:
    """Edges by either end, to tell nodes what colours their neighbours have."""

    def __init__(self, n: int, src, dst, way):
        self.src, self.dst, self.way, self.sides = src, dst, way, []
        for near, far, salt in ((src, dst, _U(3)), (dst, src, _U(5))):
            by = np.argsort(far, kind="stable")
            self.sides.append((np.searchsorted(far[by], np.arange(n + 1)), near[by], far[by], way[by] * salt))

    def told(self, colour, changed):
        """(node, what it is told) along the edges of the nodes whose colour changed; along all edges where that is None."""
        nodes, said = [], []
        for starts, near, far, way in self.sides:
            at = slice(None)
            if changed is not None:
                many = starts[changed + 1] - starts[changed]
                at = np.repeat(starts[changed] - np.cumsum(many) + many, many) + np.arange(many.sum())
            nodes.append(near[at])
            said.append(_mix(_mix(colour[far[at]]) + way[at]))
        return np.concatenate(nodes), np.concatenate(said)

    def seen(self, colour):
        """What each edge says of the colours of its ends."""
        loop = (self.src == self.dst).astype(_U)
        return _mix(_mix(colour[self.src] * _U(3)) + _mix(colour[self.dst] * _U(5) + _mix(self.way + loop * _U(43))))


def _starts(*columns) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _refined(colour, cell, edges: _Edges, changed=None) -> tuple[np.ndarray, np.ndarray]:
    """(colour, cell): cells are split until all nodes of a cell have the same neighbours by colour.

    Only what changed is told on, so a round costs what it touches. Where a cell falls apart, the nodes that were told nothing keep its colour,
    or else those of the largest group; the numbers of neighbours in what is left follow from those in the rest.
    """
    colour, cell, turn, used = colour.copy(), cell.copy(), 0, int(cell.max(initial=-1)) + 1
    size = np.zeros(used + len(colour), np.int64)
    size[:used] = np.bincount(cell, minlength=used)
    while True:
        node, said = edges.told(colour, changed)
        if not len(node):
            return colour, cell
        turn += 1
        by = np.argsort(node, kind="stable")
        node = node[by]
        first = _starts(node)
        node, sign = node[first], _mix(np.add.reduceat(said[by], first) + _U(turn))
        by = np.lexsort((sign, cell[node]))
        node, sign = node[by], sign[by]
        start = _starts(cell[node], sign)
        count, of = np.diff(np.append(start, len(node))), cell[node[start]]
        cells = _starts(of)
        left = size[of[cells]] - np.add.reduceat(count, cells)
        stays = np.lexsort((sign[start], count, of))[np.append(cells[1:], len(of)) - 1]
        moves = np.ones(len(of), bool)
        moves[stays[left == 0]] = False
        new = np.flatnonzero(moves)
        if not len(new):
            return colour, cell
        moved = np.repeat(moves, count)
        changed = node[moved]
        np.subtract.at(size, of[new], count[new])
        size[used : used + len(new)] = count[new]
        cell[changed] = np.repeat(np.arange(used, used + len(new)), count[new])
        used += len(new)
        colour[changed] = _mix(colour[changed] + _mix(sign[moved]))


class Shapes:
    """Canonical forms of graphs; small components seen before are looked up. ``branches``, where given, is the most refinements of a component."""

    def __init__(self, branches: int | None = None, remembered: int = 20_000, small: int = 400):
        self.branches, self.remembered, self.small, self.left = branches, remembered, small, branches
        self.known: dict[tuple, tuple[int, np.ndarray]] = {}

    def form(self, kind: np.ndarray, src: np.ndarray, dst: np.ndarray, relation: np.ndarray) -> tuple[int, np.ndarray] | None:
        """(form, nodes in canonical order), None where the branches run out; kinds and relations are hashes."""
        self.left = self.branches
        try:
            return self._form(_mix(kind.astype(_U)), src, dst, _mix(relation.astype(_U) + _U(1)))
        except _Undecided:
            return None

    def _refined(self, *state):
        if self.left is not None:
            self.left -= 1
            if self.left < 0:
                raise _Undecided
        return _refined(*state)

    def _form(self, colour, src, dst, relation):
        if len(colour) > self.small:
            return self._worked_out(colour, src, dst, relation)
        key = (colour.tobytes(), src.tobytes(), dst.tobytes(), relation.tobytes())
        if key not in self.known:
            found = self._worked_out(colour, src, dst, relation)
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[key] = found
        return self.known[key]

    def _worked_out(self, colour, src, dst, relation):
        edges = _Edges(len(colour), src, dst, relation)
        colour, cell = self._refined(colour, np.unique(colour, return_inverse=True)[1], edges)
        values, inverse, count = np.unique(colour, return_inverse=True, return_counts=True)
        seen = _digest(values, count, edges.seen(colour).sum(dtype=_U))
        settled = np.flatnonzero(count[inverse] == 1)
        settled = settled[np.argsort(colour[settled])]
        rest = np.flatnonzero(count[inverse] > 1)
        if not len(rest):
            return seen, settled
        s, d, r, told = _telling(inverse, count, edges)
        parts = list(_components(rest, s, d, r, len(colour)))
        if len(parts) > 1 or len(settled) or told:
            forms = []
            for nodes, s, d, r in parts:
                if len(nodes) == 1:
                    forms.append((_digest(colour[nodes], r), nodes))
                else:
                    form, order = self._form(colour[nodes], s, d, r)
                    forms.append((form, nodes[order]))
            forms.sort(key=lambda x: x[0])
            return _digest(seen, [f for f, _ in forms]), np.concatenate([settled, *(o for _, o in forms)])
        return self._split(colour, cell, edges, seen, np.flatnonzero(inverse == np.lexsort((values, count))[0]))

    def _split(self, colour, cell, edges: _Edges, seen, tied):
        group = np.arange(len(colour))  # nodes that symmetries make equal have one number
        least, best, tried, pairs = None, None, [], []
        for node in tied:
            if (group[tried] == group[node]).any():
                continue
            one, cells = colour.copy(), cell.copy()
            one[node] = _mix(one[node : node + 1] + _U(13))[0]
            cells[node] = cells.max() + 1
            one, cells = self._refined(one, cells, edges, np.array([node]))
            tried.append(node)
            trace = _digest(*np.unique(one, return_counts=True))
            if least is not None and trace > least:
                continue
            if least is None or trace < least:
                least, best, leaves = trace, None, {}
            look, line = self._leaf(one, cells, edges)
            if look in leaves:  # a symmetry, and so the form of one that was worked out
                pairs.append((leaves[look], line))
                group = self._equal(len(colour), pairs)
                continue
            leaves[look] = line
            form, order = self._form(one, edges.src, edges.dst, edges.way)
            if best is None or form < best[0]:
                best = form, order
            elif form == best[0]:
                pairs.append((best[1], order))
                group = self._equal(len(colour), pairs)
        return _digest(seen, best[0]), best[1]

    def _equal(self, n: int, pairs: list) -> np.ndarray:
        """Nodes in one number that the symmetries, given as two orders of the nodes, make equal."""
        return _labels(n, *(np.concatenate(side) for side in zip(*pairs, strict=True)))

    def _leaf(self, colour, cell, edges: _Edges) -> tuple[int, np.ndarray]:
        """(what the graph looks like, nodes in order) after one tied node after another was given a colour of its own, no other tried."""
        while True:
            values, inverse, count = np.unique(colour, return_inverse=True, return_counts=True)
            tied = np.flatnonzero(count > 1)
            if not len(tied):
                return _digest(values, edges.seen(colour).sum(dtype=_U)), np.argsort(colour)
            node = np.flatnonzero(inverse == tied[np.argmin(count[tied])])[:1]
            colour, cell = colour.copy(), cell.copy()
            colour[node], cell[node] = _mix(colour[node] + _U(13)), cell.max() + 1
            colour, cell = self._refined(colour, cell, edges, node)


def _telling(cell, size, edges: _Edges) -> tuple:
    """(src, dst, way) of edges that colours do not tell, and whether others were left out or turned: where more than half of all pairs from a cell to a cell have an
    edge, the pairs without one tell the same."""
    here, there, loop = cell[edges.src], cell[edges.dst], edges.src == edges.dst
    rest = (size[here] > 1) & (size[there] > 1)
    src, dst, way, here, there, loop = (x[rest] for x in (edges.src, edges.dst, edges.way, here, there, loop))
    by = np.lexsort((loop, way, there, here))
    start = _starts(here[by], there[by], way[by], loop[by])
    count, at = np.diff(np.append(start, len(by))), by[start]
    a, b, same = size[here[at]], size[there[at]], here[at] == there[at]
    full = np.where(loop[at], a, a * np.where(same, b - 1, b))
    out = [by[np.repeat(count * 2 <= full, count)]]
    turned = []
    members = np.argsort(cell, kind="stable")
    first = np.searchsorted(cell[members], np.arange(len(size) + 1))
    place = np.empty(len(cell), np.int64)
    place[members] = np.arange(len(cell)) - first[cell[members]]
    for g in np.flatnonzero((count * 2 > full) & (count < full)):
        mine = by[start[g] : start[g] + count[g]]
        x, y = (members[first[c] : first[c + 1]] for c in (here[at[g]], there[at[g]]))
        without = np.ones((len(x), len(y)), bool)
        if loop[at[g]]:
            without[:] = False
            np.fill_diagonal(without, True)
        elif same[g]:
            np.fill_diagonal(without, False)
        without[place[src[mine]], place[dst[mine]]] = False
        i, j = np.nonzero(without)
        turned.append((x[i], y[j], np.repeat(_mix(way[at[g : g + 1]] + _U(47)), len(i))))
    kept = [(src[o], dst[o], way[o]) for o in out] + turned
    return *(np.concatenate(c) for c in zip(*kept, strict=True)), bool((count * 2 > full).any())


def _components(nodes: np.ndarray, src, dst, relation, n: int) -> Iterator[tuple]:
    """(nodes, src, dst, relation) of the weakly connected parts among ``nodes``, ends numbered within a part."""
    inside = np.zeros(n, bool)
    inside[nodes] = True
    kept = inside[src] & inside[dst]
    src, dst, relation = src[kept], dst[kept], relation[kept]
    label = _labels(n, src, dst)
    of = label[nodes]
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    place = np.empty(n, np.int64)
    edge_of = label[src]
    by = np.argsort(edge_of, kind="stable")
    for mine in np.split(nodes[order], cuts):
        place[mine] = np.arange(len(mine))
        a, b = np.searchsorted(edge_of[by], label[mine[0]], "left"), np.searchsorted(edge_of[by], label[mine[0]], "right")
        edges = by[a:b]
        yield mine, place[src[edges]], place[dst[edges]], relation[edges]


def _numbered(rows: int, graph, edge, a, b, way) -> tuple:
    """Rows of whole graphs, graph by graph, as one graph: (place among the rows, graph, kind) of distinct nodes, (src, dst, way) of distinct edges between nodes,
    (graphs' number of edges, with an edge to no node, with a node named twice)."""
    codes = pa.array(np.concatenate([a, b])).dictionary_encode()
    wide = len(codes.dictionary) + 1
    codes = codes.indices.to_numpy().astype(np.int64)
    key, far = graph * wide + codes[: len(a)], graph * wide + codes[len(a) :]
    row = np.flatnonzero(~edge)
    row = row[np.lexsort((way[row], key[row]))]
    row = np.sort(row[_starts(key[row], way[row])])  # nodes stay in the order in which they came
    by = np.lexsort((way[row], key[row]))
    line = key[row][by]
    twice = np.zeros(rows, bool)
    twice[graph[row[by[1:][line[1:] == line[:-1]]]]] = True
    at = np.flatnonzero(edge)
    at = at[np.lexsort((way[at], far[at], key[at]))]
    at = at[_starts(key[at], far[at], way[at])]
    ends, whole = [], np.ones(len(at), bool)
    for k in (key[at], far[at]):
        found = np.searchsorted(line, k, "right") - 1
        whole &= (found >= 0) & (line[found] == k) if len(line) else False
        ends.append(by[found] if len(line) else found)
    loose = np.zeros(rows, bool)
    loose[graph[at[~whole]]] = True
    src, dst = (e[whole] for e in ends)
    return row, graph[row], way[row].view(_U), src, dst, way[at[whole]].view(_U), np.bincount(graph[at], minlength=rows), loose, twice


def _labels(n: int, src, dst) -> np.ndarray:
    """The least node of each node's weakly connected part."""
    label = np.arange(n)
    while len(src):
        low = np.minimum(label[src], label[dst])
        new = label.copy()
        np.minimum.at(new, src, low)
        np.minimum.at(new, dst, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _sums(at, values, n: int) -> np.ndarray:
    out = np.zeros(n, _U)
    np.add.at(out, at, values)
    return out


def _batch_forms(shapes: Shapes, rows: int, graph, kind, src, dst, way) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, undecided) of every graph of a batch, and all nodes in canonical order: colours are refined for all graphs at once, parts with ties that look the same are worked out once."""
    label = _labels(len(graph), src, dst)
    nodes = np.argsort(label, kind="stable")  # part by part, and so graph by graph
    starts = _starts(label[nodes])
    size = np.diff(np.append(starts, len(nodes)))
    parts, place = len(starts), np.empty(len(nodes), np.int64)
    place[nodes] = np.arange(len(nodes))
    part = np.repeat(np.arange(parts), size)
    src, dst, way = place[src], place[dst], _mix(way + _U(1))
    by = np.lexsort((way, dst, src))  # part by part as well
    src, dst, way = src[by], dst[by], way[by]
    given = _mix(kind[nodes])
    by = np.lexsort((given, part))
    cell = np.empty(len(nodes), np.int64)
    new = np.zeros(len(nodes), np.int64)
    new[_starts(part[by], given[by])] = 1
    cell[by] = np.cumsum(new) - 1
    edges = _Edges(len(nodes), src, dst, way)
    colour, cell = _refined(given, cell, edges)
    form = _sums(part, _mix(colour + _U(17)), parts) + _mix(_sums(part[src], edges.seen(colour), parts) + size.astype(_U))
    by = np.lexsort((colour, part))
    order = np.empty(len(nodes), np.int64)  # a node's place in its part
    order[by] = np.arange(len(nodes)) - starts[part[by]]
    tied = np.zeros(parts, bool)
    tied[part[by][1:][(colour[by][1:] == colour[by][:-1]) & (part[by][1:] == part[by][:-1])]] = True
    local = (np.arange(len(nodes)) - starts[part]).astype(_U)
    looks = _sums(part, _mix(given + _mix(local + _U(19))), parts)
    looks = _mix(looks) + _sums(part[src], _mix(_mix(local[src] + _U(23)) + _mix(_mix(local[dst] + _U(29)) + way)), parts) + size.astype(_U)
    cuts = np.searchsorted(part[src], np.arange(parts + 1))
    again, unsure = np.flatnonzero(tied), np.zeros(parts, bool)
    again = again[np.argsort(looks[again], kind="stable")]
    first = _starts(looks[again])
    for these in np.split(again, first[1:]) if len(again) else ():
        p = these[0]
        i, n, e = starts[p], size[p], slice(cuts[p], cuts[p + 1])
        shapes.left = shapes.branches
        try:
            found, line = shapes._form(given[i : i + n], src[e] - i, dst[e] - i, way[e])
        except _Undecided:
            unsure[these] = True
            continue
        form[these] = _mix(np.array([found], _U) + _U(31))
        where = np.empty(n, np.int64)
        where[line] = np.arange(n)
        order[(starts[these][:, None] + np.arange(n)).ravel()] = np.tile(where, len(these))
    of = graph[nodes[starts]]
    undecided = np.zeros(rows, bool)
    undecided[of[unsure]] = True
    rank = np.empty(parts, np.int64)
    rank[np.lexsort((form, of))] = np.arange(parts)
    whole = _mix(_sums(of, _mix(form + _U(37)), rows) + np.bincount(of, minlength=rows).astype(_U))
    return whole, undecided, nodes[np.lexsort((order, rank[part]))]


def _forms(shapes: Shapes, table: pa.Table, most: int | None, names: bool) -> pa.RecordBatch:
    """What ``measured`` says of the graphs in a table of whole graphs."""
    first = _new_graphs(table)
    rows = len(first)
    graph = np.repeat(np.arange(rows), np.diff(np.append(first, table.num_rows)))
    column = lambda c: table.column(c).combine_chunks()
    edge = column("edge").to_numpy(zero_copy_only=False)
    row, graph, kind, src, dst, way, n_edges, loose, twice = _numbered(rows, graph, edge, *(column(c).to_numpy() for c in ("a", "b", "way")))
    n_nodes = np.bincount(graph, minlength=rows)
    some = np.ones(rows, bool) if most is None else n_nodes <= most
    kinds = _sums(graph, _mix(_mix(kind) + _U(41)), rows)
    if not some.all():  # graphs that are not wanted have no edges to look at
        kept = some[graph[src]]
        src, dst, way = src[kept], dst[kept], way[kept]
    forms, undecided, order = _batch_forms(shapes, rows, graph, kind, src, dst, way)
    said = [None if no else f"{f:016x}" for f, no in zip(forms.tolist(), undecided | ~some | (n_nodes == 0), strict=True)]
    at = pa.array(first)
    out = [column("project").take(at), column("version").take(at), pa.array(n_nodes), pa.array(n_edges), pa.array([f"{k:016x}" for k in kinds.tolist()]), pa.array(said)]
    if names:
        offsets = np.append(0, np.cumsum(n_nodes))
        place = np.empty(len(graph), np.int64)
        place[order] = np.arange(len(order)) - offsets[graph[order]]
        ends = np.stack([(place[src] << 32) | place[dst], way.view(np.int64)], axis=1)
        ends = ends[np.lexsort((ends[:, 1], ends[:, 0], graph[src]))]
        cuts = np.searchsorted(np.sort(graph[src]), np.arange(rows + 1))
        ends = [None if said[g] is None or (twice[g] and cuts[g] < cuts[g + 1]) else ends[cuts[g] : cuts[g + 1]].tobytes() for g in range(rows)]
        out += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), column("name").take(pa.array(row[order]))), pa.array(ends, pa.binary()), pa.array(loose)]
    return pa.RecordBatch.from_arrays(out, ["project", "version", "n_nodes", "n_edges", "kinds", "shape", "node", "ends", "loose"][: len(out)])


def _new_graphs(table: pa.Table) -> np.ndarray:
    """The rows at which another graph begins."""
    codes = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("project", "version")]
    return _starts(*codes)


def _graphs(nodes: DataFrame, edges: DataFrame, most: int | None, branches: int | None, names: bool) -> DataFrame:
    """(project, version, n_nodes, n_edges, kinds, shape[, node, ends, loose]) of all graphs with nodes or edges.

    ``node`` lists a graph's nodes in canonical order, ``ends`` its edges by the places of their ends, and ``loose`` tells of an edge that ends at no node.
    Nodes and edges go through one shuffle by graph, and workers get names as hashes; repeated rows are dropped where they meet.
    """
    keys = ["project", "version"]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is in the graphs and not in their bytes
    named = dict(nodes.dtypes)["node"]
    own = nodes.select(*keys, F.lit(False).alias("edge"), F.col("node").alias("src"), F.lit(None).cast(named).alias("dst"), F.xxhash64("kind").alias("way"))
    rows = own.unionByName(edges.select(*keys, F.lit(True).alias("edge"), F.col("src").cast(named), F.col("dst").cast(named), F.xxhash64("relation").alias("way")))
    rows = rows.repartition(parts, *keys)  # names take less room than hashes there: those of neighbouring rows are nearly the same
    rows = rows.select(*keys, "edge", F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"), "way", *([F.when(~F.col("edge"), F.col("src")).alias("name")] if names else []))
    rows = rows.sortWithinPartitions(*keys, *(["name"] if names else []))
    shapes = Shapes(branches)  # each worker has its own, for as many graphs as it is given

    def work(batches):
        sys.setrecursionlimit(1_000_000)  # a level for every node that is given a colour of its own
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many >= TOGETHER:
                table = pa.Table.from_batches(held)
                last = int(_new_graphs(table)[-1])  # the last graph may go on
                if last:
                    yield _forms(shapes, table.slice(0, last), most, names)
                held, many = table.slice(last).to_batches(), 0 if last == 0 else many - last
        if sum(b.num_rows for b in held):
            yield _forms(shapes, pa.Table.from_batches(held), most, names)

    kinds = dict(rows.dtypes)
    more = f", node array<{named}>, ends binary, loose boolean" if names else ""
    return rows.mapInArrow(work, f"project {kinds['project']}, version {kinds['version']}, n_nodes bigint, n_edges bigint, kinds string, shape string{more}")


def measured(nodes: DataFrame, edges: DataFrame, most: int | None = None, branches: int | None = None, versions: DataFrame | None = None, names: bool = False) -> DataFrame:
    """(project, version, n_nodes, n_edges, kinds, shape) of every snapshot; ``versions`` names snapshots that may be empty.

    Where ``most`` is given, graphs of more nodes have no shape (NULL), and where ``branches`` is, those where these run out. Null kinds and relations are values
    of their own; repeated rows count once; edges that end at no node of the snapshot have no part in its shape. With ``names``, also what
    ``renamed`` needs: ``node``, the nodes in canonical order, ``ends``, the edges by places, and ``loose``.
    """
    keys = ["project", "version"]
    out = _graphs(nodes, edges, most, branches, names)
    if versions is None:
        return out.where("n_nodes > 0")
    out = versions.select(*keys).distinct().join(out, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_nodes", "n_edges")})


def alike(a: str, b: str):
    """Whether the snapshots measured in two structs are isomorphic: true, false, or NULL where that is not decided."""
    a, b = F.col(a), F.col(b)
    differ = (a["n_nodes"] != b["n_nodes"]) | (a["n_edges"] != b["n_edges"])
    return (
        F.when(differ, False).when(a["n_nodes"] == 0, True)
        .when(~a["kinds"].eqNullSafe(b["kinds"]), False).otherwise(a["shape"] == b["shape"])
    )


def same_as_before(
    nodes: DataFrame, edges: DataFrame, most: int | None = None, branches: int | None = None, versions: DataFrame | None = None, found: DataFrame | None = None
) -> DataFrame:
    """(project, version, isomorphic) against the version before; the first of a project has none and is left out. ``found`` is ``measured``'s result where it is at hand."""
    now = F.struct("n_nodes", "n_edges", "kinds", "shape")
    rows = (measured(nodes, edges, most, branches, versions) if found is None else found).select("project", "version", now.alias("now"))
    before = F.lag("now").over(Window.partitionBy("project").orderBy("version"))
    rows = rows.withColumn("before", before).where("before IS NOT NULL")
    return rows.select("project", "version", alike("before", "now").alias("isomorphic"))


def renamed(nodes: DataFrame, edges: DataFrame, most: int | None = None, branches: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """(project, version, node, new_node): nodes of the version before whose name changed, where both are isomorphic.

    Nodes are matched by their places in the canonical orders, and a mapping is used only if it carries all edges both ways: if the edges,
    by the places of their ends, are the same. ``found`` is ``measured``'s result with names where it is at hand.
    """
    keys = ["project", "version"]
    found = lineage.cut(measured(nodes, edges, most, branches, names=True)) if found is None else found
    order = Window.partitionBy("project").orderBy("version")
    steps = found.select(*keys, "shape").withColumns({"old_version": F.lag("version").over(order), "old_shape": F.lag("shape").over(order)}).where("shape = old_shape").select(*keys, "old_version")
    old = found.select("project", F.col("version").alias("old_version"), F.col("node").alias("old_node"), F.col("ends").alias("old_ends"))
    pairs = found.where("NOT loose").select(*keys, "node", "ends").join(steps, keys).join(old, ["project", "old_version"]).where("ends = old_ends")
    each = pairs.select(*keys, F.explode(F.arrays_zip(F.col("old_node").alias("node"), F.col("node").alias("new_node"))).alias("n"))
    return each.select(*keys, "n.*").toDF(*keys, "node", "new_node").where("node <> new_node")
