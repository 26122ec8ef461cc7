"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Random projection trees deal the vectors to blocks of about `block`: each inner node splits at the median
between two of its sample's vectors. The trees are fitted on at most `SAMPLE` vectors (so they have at most
`SAMPLE` / 8 leaves; where that leaves blocks too large, each tree splits them on by a hash of the id that is its
own, so that no class of vectors is cut off from the others), all vectors are dealt.
Each vector starts with its best neighbours within its block of each of `TREES` trees, so that blocks of
one tree are joined by those of the others. Then rounds join neighbours of neighbours, wherever they are: a
vector's neighbours, forward and a sample of reverse, are compared with each other, and each keeps its best. Rounds go
on until less than `settled` of all edges are new. Comparisons run where the first tree puts the vector in
the middle, so that most of what they need is there; every other vector is sent there once.

Queries walk the graph from their own neighbours: a round expands the best unexpanded nodes of each query's
beam, where those nodes are, until no beam has an unexpanded node. The best of the final beam are rescored in
double precision on the original vectors.

Equal vectors are one node that remembers its smallest ids, as many as a query can ask for, so any number
of copies is one step of the walk and every copy that can rank is returned.

Defined results: vectors that are null, zero, of another length than most, or hold a null or a non-finite
component take no part, nor do rows without id; components may be as small or large as doubles are; fewer candidates
than asked give shorter lists; ties go to the smaller id; an id that comes with several vectors is several
candidates, so a list may hold it more than once; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import mix

GRAPH = "part long, id long, near array<long>, sims array<float>, fresh array<boolean>"
STATE = "part long, id long, beam array<long>, sims array<float>, done array<boolean>"

TREES, SAMPLE = 3, 8192
#: A node's id has its block of the first tree above so many bits; 32 neighbouring blocks are a part.
_BLOCK_BITS, _PART_BITS = 32, 37


def _part(ids: np.ndarray) -> np.ndarray:
    return ids >> _PART_BITS


class Tree:
    """Splits of a complete binary tree, each by a hyperplane at the median of the sample that reaches it."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth, self.seed = depth, seed
        self.normal = np.zeros(((1 << depth) - 1, sample.shape[1]), np.float32)
        self.middle = np.zeros(len(self.normal), np.float32)
        held = {0: np.arange(len(sample))}
        for at in range(len(self.normal)):
            own = held.pop(at)
            if len(own) > 1:
                one, two = sample[rng.choice(own, 2, replace=False)]
                self.normal[at] = one - two
                far = sample[own] @ self.normal[at]
                self.middle[at] = np.median(far)
                right = far > self.middle[at]
                own, other = own[~right], own[right]
            else:
                other = own
            held[2 * at + 1], held[2 * at + 2] = own, other

    def leaves(self, ids: np.ndarray, held: np.ndarray) -> np.ndarray:
        at = np.zeros(len(held), np.int64)
        toss = mix(ids.view(np.uint64) + np.uint64(self.seed))
        for level in range(self.depth):
            gap = np.einsum("ij,ij->i", held, self.normal[at]) - self.middle[at]
            at = 2 * at + 1 + np.where(gap == 0, (toss >> np.uint64(level)) & np.uint64(1), gap > 0).astype(np.int64)
        return at - len(self.normal)


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat, kind))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(held, pa.ChunkedArray):
        held = pa.concat_arrays(held.chunks) if held.num_chunks else pa.array([], column.type)
    return held.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors, sorted by id."""
    ids = table["id"].to_numpy()
    held = np.frombuffer(b"".join(table["vec"].to_pylist()), np.float32).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), np.float32)
    order = np.argsort(ids, kind="stable")
    return ids[order], held[order]


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, flag: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """For each owner its `most` best distinct others, best first; of a repeated pair the unflagged stays."""
    order = np.lexsort((flag, other, -sim, owner))
    owner, other, sim, flag = owner[order], other[order], sim[order], flag[order]
    seen = np.lexsort((flag, other, owner))
    new = np.ones(len(owner), bool)
    new[seen[1:]] = (owner[seen[1:]] != owner[seen[:-1]]) | (other[seen[1:]] != other[seen[:-1]])
    owner, other, sim, flag = owner[new], other[new], sim[new], flag[new]
    if not len(owner):
        return owner, other, sim, flag
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    top = place < most
    return owner[top], other[top], sim[top], flag[top]


def _graph_rows(part: int, ids: np.ndarray, best: tuple[np.ndarray, ...], names: list[str]) -> pa.Table:
    owner, other, sim, flag = best
    counts = np.bincount(np.searchsorted(ids, owner), minlength=len(ids)) if len(owner) else np.zeros(len(ids), np.int64)
    return pa.table([np.full(len(ids), part), ids, _lists(other, counts, pa.int64()), _lists(sim.astype(np.float32), counts, pa.float32()), _lists(flag.astype(bool), counts, pa.bool_())], names=names)


_G = ["part", "id", "near", "sims", "fresh"]
_S = ["part", "id", "beam", "sims", "done"]


def _sampled(table: pa.Table, degree: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a block sorted by v: all forward, at most `degree` reverse, each neighbour once."""
    v, u, back = table["v"].to_numpy(), table["u"].to_numpy(), table["back"].to_numpy()
    chance = (mix((u ^ (v << 20)).view(np.uint64) + np.uint64(salt)) >> np.uint64(40)).astype(np.float64) / (1 << 25)
    owner, other, _, stale = _best(v, u, np.where(back, chance, 1.0), ~table["fresh"].to_numpy(), 2 * degree)
    return owner, other, ~stale


def _best_within(ids: np.ndarray, held: np.ndarray, degree: int, block: int, seed: int) -> tuple[np.ndarray, ...]:
    """owner, other, sim: the best of each vector's block. Blocks far larger than meant are cut up at random."""
    cuts = np.array_split(np.random.default_rng(seed).permutation(len(ids)), max(1, len(ids) // (4 * block)))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for cut in cuts:
        k = min(degree, len(cut) - 1)
        for a in range(0, len(cut) if k > 0 else 0, 512):
            own = cut[a : a + 512]
            sim = held[own] @ held[cut].T
            sim[np.arange(len(own)), np.arange(a, a + len(own))] = -np.inf
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            out.append((np.repeat(ids[own], k), ids[cut[top]].reshape(-1), np.take_along_axis(sim, top, 1).reshape(-1)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Graph:
    """Nodes (part, id, own, vec), where `own` is the id a vector came with, the neighbour lists, and the adjacency that searches walk."""

    def __init__(self, vectors: DataFrame, scratch: Scratch, degree: int = 24, block: int = 256, settled: float = 0.15, trees: int = TREES):
        self.scratch, self.degree, self.block = scratch, degree, block
        total = vectors.count()
        depth = 0
        while (total >> depth) > block and (8 << depth) < SAMPLE:
            depth += 1
        cuts = max(1, -(-(total >> depth) // (2 * block)))
        sample = vectors.sample(min(1.0, 1.2 * SAMPLE / max(total, 1)), 1).limit(SAMPLE) if depth else vectors.limit(0)
        sample = _vectors(sample.toArrow())[1]
        grown = vectors.sparkSession.sparkContext.broadcast([Tree(sample, depth, 7 + t) for t in range(trees)])

        def deal(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, held = batch["own"].to_numpy(), np.frombuffer(b"".join(batch["vec"].to_pylist()), np.float32).reshape(batch.num_rows, -1)
                # each tree cuts its large leaves by a hash of its own, so that the parts of one are joined by those of the others
                cut = [(mix(mix(ids.view(np.uint64)) + np.uint64(t.seed)) % np.uint64(cuts)).astype(np.int64) for t in grown.value]
                leaves = np.stack([t.leaves(ids, held) * cuts + c for t, c in zip(grown.value, cut, strict=True)], axis=1)
                yield pa.RecordBatch.from_arrays([batch["own"], batch["vec"], pa.array(leaves[:, 0]), _lists(leaves[:, 1:].reshape(-1), np.full(len(ids), trees - 1), pa.int64())], names=["own", "vec", "block", "others"])

        def number(key, table):
            ids = (key[0].as_py() << _BLOCK_BITS) + np.arange(table.num_rows)
            return pa.table([_part(ids), ids, table["own"], table["vec"], table["others"]], names=["part", "id", "own", "vec", "others"])

        dealt = vectors.withColumnRenamed("id", "own").mapInArrow(deal, "own long, vec binary, block long, others array<long>")
        self.nodes = scratch.keep(dealt.groupBy("block").applyInArrow(number, "part long, id long, own long, vec binary, others array<long>"), "nodes")
        graph = scratch.keep(self._start(), "graph-0")
        for k in count(1):
            graph = scratch.keep(self._round(graph, k), f"graph-{k}")
            edges = graph.agg(F.sum(F.size("near")).alias("all"), F.sum(F.size(F.filter("fresh", lambda x: x))).alias("new")).first()
            if (edges["new"] or 0) <= settled * (edges["all"] or 0):
                break
        self.rounds = k
        self.adjacency = scratch.keep(self._adjacency(graph), "adjacency")

    def _start(self) -> DataFrame:
        degree, block = self.degree, self.block

        def within(key, table):
            owner, other, sim = _best_within(*_vectors(table), degree, block, key[0].as_py())
            return pa.table({"part": _part(owner), "id": owner, "other": other, "sim": sim})

        def gather(key, nodes, found):
            flag = np.ones(found.num_rows, bool)
            best = _best(found["id"].to_numpy(), found["other"].to_numpy(), found["sim"].to_numpy(), flag, degree)
            return _graph_rows(key[0].as_py(), np.sort(nodes["id"].to_numpy()), best, _G)

        blocks = F.concat(F.array(F.shiftright("id", _BLOCK_BITS)), "others")
        dealt = self.nodes.select("id", "vec", F.posexplode(blocks).alias("tree", "block"))
        found = dealt.groupBy("tree", "block").applyInArrow(within, "part long, id long, other long, sim float")
        return self.nodes.select("part", "id").groupBy("part").cogroup(found.groupBy("part")).applyInArrow(gather, GRAPH)

    def _edges(self, graph: DataFrame, salt: int) -> DataFrame:
        """Both directions of every edge, at the block of `v`: part, v, u, fresh, back. A hub keeps `degree` reverse edges a batch."""
        degree = self.degree

        def edges(batches):
            for batch in batches:
                u, row = _flat(batch["near"])
                fresh, _ = _flat(batch["fresh"])
                v = batch["id"].to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(batch["part"].to_numpy()[row]), pa.array(v), pa.array(u), pa.array(fresh.astype(bool)), pa.array(np.zeros(len(v), bool))], names=["part", "v", "u", "fresh", "back"])
                order = np.lexsort((mix((u ^ (v << 20)).view(np.uint64) + np.uint64(salt)), u))
                new = np.ones(len(u), bool)
                new[1:] = u[order][1:] != u[order][:-1]
                first = np.flatnonzero(new)
                place = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
                keep = order[place < degree]
                yield pa.RecordBatch.from_arrays([pa.array(_part(u[keep])), pa.array(u[keep]), pa.array(v[keep]), pa.array(fresh.astype(bool)[keep]), pa.array(np.ones(len(keep), bool))], names=["part", "v", "u", "fresh", "back"])

        return graph.mapInArrow(edges, "part long, v long, u long, fresh boolean, back boolean")

    def _round(self, graph: DataFrame, k: int) -> DataFrame:
        degree = self.degree
        edges = self.scratch.keep(self._edges(graph, k), f"edges-{k}")
        worst = graph.select("id", F.when(F.size("sims") >= degree, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        where = edges.select("part", F.col("u").alias("id")).distinct().groupBy("id").agg(F.collect_set("part").alias("parts"))

        def pack(batches):
            """Vectors for each part that wants them, in one row a batch."""
            for batch in batches:
                at, row = _flat(batch["parts"])
                order = np.argsort(at, kind="stable")
                at, row = at[order], row[order]
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
                ids, worst, vec = batch["id"].to_numpy(), batch["worst"].to_numpy(), batch["vec"].to_pylist()
                own = [row[a:b] for a, b in zip(first, [*first[1:], len(at)], strict=True)]
                packed = [pa.array([f(x) for x in own], pa.binary()) for f in (lambda x: ids[x].tobytes(), lambda x: worst[x].tobytes(), lambda x: b"".join(vec[i] for i in x))]
                yield pa.RecordBatch.from_arrays([pa.array(at[first], pa.int64()), *packed], names=["at", "ids", "worst", "vecs"])

        wanted = self.nodes.select("id", "vec").join(worst, "id").join(where, "id").mapInArrow(pack, "at long, ids binary, worst binary, vecs binary")

        def reduced(found):
            a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
            return _best(a, b, s, np.zeros(len(a), bool), degree)[:3]

        def join(key, edge, vector):
            ids, worst, held = (np.frombuffer(b"".join(vector[c].to_pylist()), t) for c, t in (("ids", np.int64), ("worst", np.float32), ("vecs", np.float32)))
            order = np.argsort(ids, kind="stable")
            held = held.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 1), np.float32)
            ids, worst = ids[order], worst[order]
            v, u, fresh = _sampled(edge, degree, k)
            at = np.searchsorted(ids, u)
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(v)))
            width = 2 * degree
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
            for a in range(0, len(first), 256):
                inside = np.arange(width) < size[a : a + 256, None]
                pick = np.where(inside, first[a : a + 256, None] + np.arange(width), 0)
                node = at[pick]
                vec = held[node]
                sim = vec @ vec.transpose(0, 2, 1)
                ok = inside[:, :, None] & inside[:, None, :] & (fresh[pick][:, :, None] | fresh[pick][:, None, :]) & (node[:, :, None] != node[:, None, :])
                ok &= sim > worst[node][:, :, None]
                x, y, z = np.nonzero(ok)
                found.append((node[x, y], node[x, z], sim[x, y, z]))
                if sum(len(x[0]) for x in found[1:]) > 1 << 20:
                    found = [reduced(found)]
            a, b, s = reduced(found)
            return pa.table({"part": _part(ids[a]) if len(a) else np.zeros(0, np.int64), "id": ids[a] if len(a) else np.zeros(0, np.int64), "other": ids[b] if len(b) else np.zeros(0, np.int64), "sim": s.astype(np.float32)})

        def merge(key, old, found):
            ids = old["id"].to_numpy()
            near, row = _flat(old["near"])
            sims, _ = _flat(old["sims"])
            owner = np.concatenate((ids[row], found["id"].to_numpy()))
            flag = np.concatenate((np.zeros(len(near), bool), np.ones(found.num_rows, bool)))
            best = _best(owner, np.concatenate((near, found["other"].to_numpy())), np.concatenate((sims, found["sim"].to_numpy())), flag, degree)
            return _graph_rows(key[0].as_py(), np.sort(ids), best, _G)

        found = edges.groupBy("part").cogroup(wanted.groupBy("at")).applyInArrow(join, "part long, id long, other long, sim float")
        return graph.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(merge, GRAPH)

    def _adjacency(self, graph: DataFrame) -> DataFrame:
        degree = self.degree

        def gather(key, table):
            v, u, _ = _sampled(table, degree, 0)
            ids, counts = np.unique(v, return_counts=True)
            return pa.table([np.full(len(ids), key[0].as_py()), ids, _lists(u, counts, pa.int64())], names=["part", "id", "near"])

        return self._edges(graph, 0).groupBy("part").applyInArrow(gather, "part long, id long, near array<long>")

    def search(self, queries: DataFrame, beam: int = 224, step: int = 224) -> DataFrame:
        """For the vectors in `queries` (own): id, beam, sims, best first, from a walk that starts at their own neighbours."""
        scratch = self.scratch
        own = self.nodes.join(queries.select("own").distinct(), "own", "left_semi")
        vec = own.select(F.col("id").alias("query"), F.col("vec").alias("aim"))

        def ask(batches):
            """The block of each node to expand: part, query, ids."""
            for batch in batches:
                node, row = _flat(batch["beam"])
                done = _flat(batch["done"])[0].astype(bool)
                open_at = np.flatnonzero(~done)
                place = np.arange(len(open_at)) - np.searchsorted(row[open_at], row[open_at])
                yield grouped(batch["id"].to_numpy()[row[open_at[place < step]]], node[open_at[place < step]])

        def grouped(query: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            part = _part(node)
            order = np.lexsort((node, part, query))
            query, node, part = query[order], node[order], part[order]
            new = np.ones(len(query), bool)
            new[1:] = (query[1:] != query[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), pa.array(query[first], pa.int64()), _lists(node, np.diff(np.append(first, len(node))), pa.int64())], names=["part", "query", "ids"])

        def expand(key, asked, held):
            """Neighbours of the asked nodes, by their blocks."""
            ids = held["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            near, row = _flat(held["near"])
            bound = np.searchsorted(row, np.arange(len(ids) + 1))
            want, by = _flat(asked["ids"])
            if not len(ids) or not len(want):
                return pa.Table.from_batches([grouped(np.zeros(0, np.int64), np.zeros(0, np.int64))])
            at = order[np.minimum(np.searchsorted(ids[order], want), len(ids) - 1)]
            by, at = by[ids[at] == want], at[ids[at] == want]
            size = bound[at + 1] - bound[at]
            pick = np.arange(size.sum()) + np.repeat(bound[at] - (np.cumsum(size) - size), size)
            pairs = np.unique(np.stack((np.repeat(asked["query"].to_numpy()[by], size), near[pick])), axis=1)
            return pa.Table.from_batches([grouped(pairs[0], pairs[1])])

        def score(key, asked, held):
            ids, vectors = _vectors(held)
            out = []
            for query, vec, want in zip(asked["query"].to_pylist(), asked["aim"].to_pylist(), asked["ids"], strict=True):
                want = np.unique(want.values.to_numpy())
                sim = vectors[np.searchsorted(ids, want)] @ np.frombuffer(vec, np.float32)
                top = np.argsort(-sim, kind="stable")[:beam]
                out.append((query, want[top], sim[top]))
            return pa.table({"query": pa.array([o[0] for o in out], pa.int64()), "ids": pa.array([o[1] for o in out], pa.list_(pa.int64())), "sims": pa.array([o[2] for o in out], pa.list_(pa.float32()))})

        def merge(key, state, found):
            ids = state["id"].to_numpy()
            node, row = _flat(state["beam"])
            new, by = _flat(found["ids"])
            owner = np.concatenate((ids[row], found["query"].to_numpy()[by]))
            other = np.concatenate((node, new))
            done = np.concatenate((_flat(state["done"])[0].astype(bool), np.zeros(len(new), bool)))
            # what was asked for in this round is done now: the first `step` that were open
            open_at = np.flatnonzero(~done[: len(node)])
            place = np.arange(len(open_at)) - np.searchsorted(row[open_at], row[open_at])
            done[open_at[place < step]] = True
            sim = np.concatenate((_flat(state["sims"])[0], _flat(found["sims"])[0]))
            mine = owner != other
            best = _best(owner[mine], other[mine], sim[mine], ~done[mine], beam)
            best = (*best[:3], ~best[3])
            return _graph_rows(key[0].as_py(), np.sort(ids), best, _S)

        state = own.select("part", "id", F.array("id").alias("beam"), F.array(F.lit(2.0).cast("float")).alias("sims"), F.array(F.lit(False)).alias("done"))
        state = scratch.keep(state, "walk-0")
        for k in count(1):
            asked = state.mapInArrow(ask, "part long, query long, ids array<long>")
            near = asked.groupBy("part").cogroup(self.adjacency.groupBy("part")).applyInArrow(expand, "part long, query long, ids array<long>")
            scored = near.join(vec, "query").groupBy("part").cogroup(self.nodes.select("part", "id", "vec").groupBy("part")).applyInArrow(score, "query long, ids array<long>, sims array<float>")
            home = state.select(F.col("part").alias("at"), F.col("id").alias("query"))
            state = state.groupBy("part").cogroup(scored.join(home, "query").groupBy("at")).applyInArrow(merge, STATE)
            state = scratch.keep(state, f"walk-{k}")
            if k > 1:
                scratch.drop(f"walk-{k - 1}")
            if not state.where(F.exists("done", lambda d: ~d)).head(1):
                break
        return state.select("id", "beam", "sims")


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _pack(batches):
    for batch in batches:
        flat, row = _flat(batch["vector"])
        held = flat.astype(np.float64).reshape(batch.num_rows, -1)
        held = held / np.abs(held).max(axis=1, keepdims=True)
        unit = (held / np.linalg.norm(held, axis=1, keepdims=True)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([x.tobytes() for x in unit], pa.binary())], names=["id", "vec"])


def _scaled(vector: Column) -> Column:
    """The vector times a power of two, which keeps its digits, where squares would vanish or overflow."""
    most = F.array_max(F.transform(vector, F.abs))
    return F.when(most < 1e-100, F.transform(vector, lambda x: x * F.lit(2.0**600))).when(most > 1e100, F.transform(vector, lambda x: x * F.lit(2.0**-600))).otherwise(vector)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = 24, block: int = 256, settled: float = 0.15, beam: int = 224, salts: int = 64) -> DataFrame:
    """For the rows where `queries` holds: query_id, rank, vec_id, score of the k nearest others found, by cosine."""
    scratch = Scratch(vectors.sparkSession, "nearest")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("is_query")).where(usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    rows = rows.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))
    nodes = scratch.keep(rows.groupBy("vector").agg(F.min("vec_id").alias("id")), "distinct")
    rows = scratch.keep(rows.join(nodes, "vector").select("id", "vec_id", "is_query").distinct(), "rows")
    salted = Window.partitionBy("id", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).orderBy("vec_id")
    ids = rows.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("n") <= k + 1).select("id", "vec_id")

    graph = Graph(nodes.mapInArrow(_pack, "id long, vec binary"), scratch, degree, block, settled)
    walked = graph.search(rows.where("is_query").select(F.col("id").alias("own")), beam)
    found = walked.select(F.col("id").alias("query"), F.explode(F.array_distinct(F.concat(F.array("id"), F.slice("beam", 1, 4 * k)))).alias("id"))
    names = graph.nodes.select("id", "own")
    found = found.join(names, "id").join(names.toDF("query", "asks"), "query").select(F.col("asks").alias("query"), F.col("own").alias("id"))
    scaled = nodes.select(_scaled(F.col("vector")).alias("vector"), "id")
    a, b = scaled.toDF("a", "query"), scaled.toDF("b", "id")

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    scored = found.join(a, "query").join(b, "id").select("query", "id", (dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))).alias("score"))
    asked = rows.where("is_query").select(F.col("id").alias("query"), F.col("vec_id").alias("query_id"))
    listed = scored.join(ids, "id").join(asked, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
