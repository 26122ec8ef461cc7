"""MinHash near-dedup with SuperMinHash signatures.

Every distinct shingle draws a permutation of the slots and fractional ranks: the slot that comes k-th gets
k plus a fraction, and a signature keeps each slot's minimum. Ranks are laid level by level over all shingles
of a batch of texts; a text is done as soon as no slot is above the level, because later levels cannot lower
it. Bands of signature rows propose links, which are confirmed on the full shingle sets, and the confirmed
links are grouped by union-find.

Texts with the same shingle set are one class, so copies are never paired. Classes that share a band key are
not paired with each other either:

* Each is compared with the pivot of its key, the member that collides most or, for a large key, the one that
  collides most among the pivots of its members. Those that link to it are one group, which settles nearly all keys.
* In a key that is still in several groups, at least one of any two members that are to be told apart is not
  linked to the pivot. If two such members link, what they differ from the pivot in has to overlap by a number
  of shingles that follows from the three sizes, so both hold a shared difference among their first few, rarest
  first (a prefix filter on differences). Those differences are the keys of the next round. What a whole
  group has in common is no difference, and an edit of one member alone is no key.
* A key of at most `small` members is settled by comparing members of different groups directly. After
  `rounds` rounds that holds for every key, which is exact, whatever its size.

With 40 bands of 6 rows a link at similarity 0.8 goes unproposed five times in a million, and one at 0.3 is
proposed three times in a hundred. `exact` takes the rarest shingles of each whole set for keys instead of
bands (the same filter against an empty pivot), by which no link is lost. Band keys that one class alone has are told
apart by packed exchange before any row is made of a key.

Defined results: a null text or one without words has 0 shingles and no link; fewer words than a shingle are
one shingle; whole texts of any length are compared; other columns are ignored. Where ids repeat or are missing, every row is a node of its own while links are looked for, and
rows that share a doc_id are then tied together. `near_duplicates` gives a row without doc_id no component and
does not mark it kept, for it has no id to be named by; `one_of_each` keeps one row of every group, also of
groups without any id, and of repeated rows; a text without words that has no id is a group of its own.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange
from .components import components, joined
from .scratch import Scratch
from .textkit import LOWER, U64, WHITESPACE, Words, mix, pieces, text_bytes, windows

BANDS, ROWS = 40, 6
_GOLDEN = U64(0x9E3779B97F4A7C15)


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints, sorted within each document, and len+1 bounds."""
    h = w.hashes()
    short = (w.counts > 0) & (w.counts < size)
    at = np.concatenate((w.window_starts(size), w.first[:-1][short]))
    many = np.concatenate((np.full(len(at) - short.sum(), size), w.counts[short]))
    keys = windows(h, at, many) + many.astype(U64)
    doc = np.searchsorted(w.first, at, "right") - 1
    doc = np.maximum(doc, 0)
    order = np.argsort(at, kind="stable")
    keys, doc = keys[order], doc[order]
    bound = np.searchsorted(doc, np.arange(len(w.counts) + 1))
    new = np.ones(len(keys), bool)
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        if b - a > 1:
            keys[a:b].sort()
            new[a + 1 : b] = keys[a + 1 : b] != keys[a : b - 1]
    return keys[new], np.concatenate(([0], np.cumsum(new)))[bound]


def signatures(keys: np.ndarray, bound: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each set: (sets, slots), rank in the high half and fraction in the low half of each value."""
    n = len(bound) - 1
    out = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(bound))
    place = None
    for level in range(slots):
        drawn = mix(keys + U64((int(_GOLDEN) * (level + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = level + ((drawn & U64(0xFFFFFFFF)) * U64(slots - level) >> U64(32)).astype(np.int64)
        rank = (U64(level) << U64(32)) | (drawn >> U64(32))
        row = np.arange(len(keys))
        slot = pick if place is None else place[row, pick].astype(np.int64)
        np.minimum.at(out.reshape(-1), doc * slots + slot, rank)
        open_doc = (out >= U64(level + 1) << U64(32)).any(axis=1)
        going = open_doc[doc]
        if not going.any():
            break
        if place is None:
            place = np.tile(np.arange(slots, dtype=np.uint8), (int(going.sum()), 1))
        else:
            place = place[going]
        keys, doc, pick = keys[going], doc[going], pick[going]
        row = np.arange(len(keys))
        moved = place[row, pick]
        place[row, pick] = place[:, level]
        place[:, level] = moved
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]) * _GOLDEN
    for k in range(ROWS):
        key = mix(key ^ rows[:, :, k])
    return key


def _sketch(size: int):
    def sketch(batches):
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                data, offsets = text_bytes(piece["text"])
                keys, bound = shingle_sets(Words(LOWER[data], offsets, WHITESPACE), size)
                n = np.diff(bound)
                sums = [np.concatenate((np.zeros(1, U64), np.cumsum(mix(keys ^ U64(salt)), dtype=U64))) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                d1, d2 = (s[bound[1:]] - s[bound[:-1]] for s in sums)
                signature = signatures(keys, bound, BANDS * ROWS)
                bands = _bands(signature).view(np.int64)
                at = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"], pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(bands.reshape(-1)))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return sketch


def _sets(size: int):
    def sets(batches):
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                data, offsets = text_bytes(piece["text"])
                keys, bound = shingle_sets(Words(LOWER[data], offsets, WHITESPACE), size)
                held = [keys[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(held, pa.binary())], names=["doc_id", "held"])

    return sets


def _confirm(percent: int):
    def confirm(batches):
        for batch in batches:
            a, b = (batch[c].to_pylist() for c in ("held_a", "held_b"))
            ok = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


_DIFFERENCE = "rep long, pivot long, n long, n_pivot long, d long, token long"


def _differences(batches):
    """A row for each shingle that only one of the sets held_a (rep) and held_b (pivot) has."""
    for batch in batches:
        rows, n, m, d, token = [np.zeros(0, np.int64)], [], [], [], [np.zeros(0, np.uint64)]
        for k, (x, y) in enumerate(zip(batch["held_a"].to_pylist(), batch["held_b"].to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            one = np.setxor1d(x, y, assume_unique=True)
            rows.append(np.full(len(one), k))
            token.append(one)
            n.append(len(x)), m.append(len(y)), d.append(len(one))
        at = np.concatenate(rows)
        counts = [pa.array(np.array(c, np.int64)[at]) for c in (n, m, d)]
        yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(at)), batch["b"].take(pa.array(at)), *counts, pa.array(np.concatenate(token).view(np.int64))], names=["rep", "pivot", "n", "n_pivot", "d", "token"])


def _members(reps: DataFrame) -> DataFrame:
    """For (rep, n, bands): rep, n and key for every band key that another class has too."""
    parts = exchange.bucket_count(reps, F.lit(8 * BANDS + 16))
    dealt = exchange.bucketed(reps, parts, "rep").groupBy("bucket")

    def flat(column: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)])

    def send(key, table):
        return exchange.send(flat(table["bands"]).view(np.uint64)[:, None], key[0].as_py(), parts)

    def rows(key, table, repeated):
        found = np.sort(exchange.unpack(exchange.rows(repeated, "found"), 1)[:, 0].view(np.int64))
        own = flat(table["bands"])
        hit = np.flatnonzero(found[np.minimum(np.searchsorted(found, own), len(found) - 1)] == own) if len(found) else np.zeros(0, np.int64)
        at = pa.array(hit // BANDS)
        return pa.table([table["rep"].take(at), table["n"].take(at), pa.array(own[hit])], names=["rep", "n", "key"])

    shared = exchange.repeated(dealt.applyInArrow(send, exchange.SENT), 1)
    return dealt.cogroup(shared.groupBy("bucket")).applyInArrow(rows, "rep long, n long, key long")


def _difference_keys(rows: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """rep, n, key, role, d and common for differences from a pivot (see `_DIFFERENCE`): links among members that are not both linked to it share a key.

    A and B link if d_A + d_B - 2 |overlap of their differences| <= q (n_A + n_B), where q is (1 - similarity) /
    (1 + similarity). If B is not linked to the pivot P, twice the overlap thus exceeds d_A + q (n_P - n_A); and if
    A is linked to P, it is at least d_B - q (n_B + n_P). So many fewer of the differences, rarest first, have to
    meet: `core` by the first bound, `long` by the second. Role 2: core and linked; 1: core and not linked; 0: only
    long. Roles of a pair that may link sum to 2 or more. The overlap is at most `common`, the differences that any
    other member has too, so a key is only kept for A if one of its members could be near enough.
    """
    up, down = 100 + percent, 100 - percent
    shared = rows.join(rows.groupBy("pivot", "token").agg(F.count("*").alias("df")).where("df > 1"), ["pivot", "token"])
    own = Window.partitionBy("pivot", "rep")
    # a difference that no other member has comes first and is no key
    placed = shared.withColumn("common", F.count("*").over(own)).withColumn("at", F.expr("d - common") + F.row_number().over(own.orderBy("df", "token")))
    first = F.expr(f"floor(({up} * d + {down} * (n_pivot - n)) / {2 * up}D) + 1")
    second = F.expr(f"greatest(1, ceil(({up} * d - {down} * (n + n_pivot)) / {2 * up}D))")
    linked = F.expr(f"{up} * d <= {down} * (n + n_pivot)")
    core, long = F.col("at") <= F.col("d") - first + 1, F.col("at") <= F.col("d") - second + 1
    placed = placed.withColumn("role", F.when(core, F.when(linked, 2).otherwise(1)).when(long & ~linked, 0)).where("role is not null")
    placed = placed.withColumn("away", F.expr(f"{up} * d - {down} * n")).withColumn("reach", F.expr(f"{up} * (2 * common - d) + {down} * n"))
    placed = scratch.keep(placed.select("pivot", "token", "rep", "n", "d", "common", "role", "away", "reach"), f"{name}-placed")
    held = placed.groupBy("pivot", "token").agg(F.max("reach").alias("farthest"))
    placed = placed.join(held, ["pivot", "token"]).where("away <= farthest")
    placed = scratch.keep(placed, f"{name}-near")
    held = placed.groupBy("pivot", "token").agg(F.expr("count_if(role = 2)").alias("linked"), F.expr("count_if(role = 1)").alias("loose"), F.expr("count_if(role < 2)").alias("all"))
    held = held.where("(linked > 0 and all > 0) or loose > 1")
    placed = placed.join(held, ["pivot", "token"]).where("role = 1 or (role = 2 and all > 0) or (role = 0 and linked > 0)")
    return scratch.keep(placed.select("rep", "n", F.xxhash64("pivot", "token").alias("key"), "role", "d", "common"), f"{name}-keys")


def _with_pivots(members: DataFrame, small: int, scratch: Scratch, name: str) -> DataFrame:
    """Members of keys that two or more have, with the key's `size` and its `pivot`.

    The pivot is the member that meets most others in all its keys. A key of more than `small` members takes the
    best pivot that any member has in any of its keys, so that a large group has few pivots.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sized = scratch.keep(members.join(sizes, "key"), f"{name}-sized")
    meets = sized.groupBy("rep").agg(F.sum("size").alias("meets"))
    best = sized.join(meets, "rep").groupBy("key").agg(F.min(F.struct((-F.col("meets")).alias("order"), F.col("rep"))).alias("first"))
    large = scratch.keep(sized.join(best, "key"), f"{name}-firsts")
    of_rep = large.where(F.col("size") > small).groupBy("rep").agg(F.min("first").alias("known"))
    better = large.where(F.col("size") > small).join(of_rep, "rep").groupBy("key").agg(F.min("known").alias("known"))
    pivot = F.coalesce("known.rep", "first.rep").alias("pivot")
    return scratch.keep(large.join(better, "key", "left").select(*sized.columns, pivot), f"{name}-pivots")


def _paired(a: Column | str, b: Column | str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _near(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", small: int = 32, rounds: int = 3, exact: bool = False) -> DataFrame:
    """`near_duplicates` of documents whose ids are all there and all different."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = scratch.keep(base.mapInArrow(_sketch(shingle), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "sketches")
    some = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "n_shingles", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands")

    def sets_of(ids: DataFrame) -> DataFrame:
        """The texts meet the wanted ids by a shuffle at every size; only sets of the wanted are written."""
        wanted = base.join(ids.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
        return scratch.keep(wanted.mapInArrow(_sets(shingle), "doc_id long, held binary"), "sets")

    if exact:
        sets = sets_of(reps)
        whole = sets.select(F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("held").alias("held_a"), F.lit(b"").alias("held_b"))
        rows = scratch.keep(whole.mapInArrow(_differences, _DIFFERENCE).withColumn("pivot", F.lit(-1)), "shingles")
        members = _difference_keys(rows, percent, scratch, "round-0")
    else:
        members = scratch.keep(_members(reps), "members").withColumns({"role": F.lit(1), "d": F.lit(0).cast("long"), "common": F.lit(0).cast("long")})
        sets = sets_of(members)

    def with_sets(pairs: DataFrame) -> DataFrame:
        left = sets.toDF("a", "held_a").join(pairs.hint("merge"), "a")
        return left.join(sets.toDF("b", "held_b").hint("merge"), "b").select("a", "b", "held_a", "held_b")

    fit = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {100 + percent} * (d_a + d_b - 2 * least(common_a, common_b)) <= {100 - percent} * (n_a + n_b)")
    live = _with_pivots(members, small, scratch, "round-0")
    direct, tested, groups = None, None, None
    for k in count(1):
        ways = ([] if direct is None else [direct]) + ([] if live is None else [live.where("rep <> pivot").select(*_paired("rep", "pivot"))])
        pairs = reduce(DataFrame.union, ways).distinct()
        pairs = scratch.keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), f"pairs-{k}")
        tested = pairs if tested is None else tested.union(pairs)
        links = scratch.keep(with_sets(pairs).mapInArrow(_confirm(percent), "a long, b long"), f"links-{k}")
        groups = joined(groups, links, scratch, f"groups-{k}")
        if live is None:
            break
        now = live.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        apart = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        now = scratch.keep(now.join(apart.select("key"), "key", "left_semi"), f"apart-{k}")
        if not now.head(1):
            break
        few = F.col("size") <= small if k < rounds else F.lit(True)
        sides = [now.where(few).select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "component", "role", "d", "common"))) for s in "ab"]
        direct = sides[0].join(sides[1], "key").where("rep_a > rep_b and component_a <> component_b and role_a + role_b >= 2").where(fit)
        direct = direct.select(*_paired("rep_a", "rep_b"))
        live = None
        if not now.where(~few).head(1):
            continue
        many = now.where(~few & (F.col("rep") != F.col("pivot"))).select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
        rows = scratch.keep(with_sets(many).mapInArrow(_differences, _DIFFERENCE), f"differences-{k}")
        live = _with_pivots(_difference_keys(rows, percent, scratch, f"round-{k}"), small, scratch, f"round-{k}")
    placed = sketches.drop("bands").join(classes, ["d1", "d2", "n_shingles"], "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")))
    return placed.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _ids_are_nodes(docs: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own."""
    n, distinct = docs.select(F.col(id_col).cast("long").alias("id")).agg(F.count("*"), F.countDistinct("id")).first()
    return n == distinct


def _grouped(docs: DataFrame, id_col: str, text_col: str, **how) -> tuple[DataFrame, DataFrame]:
    """For any ids: `docs` with a number `_near_row` for each row, and row, doc_id, n_shingles and group of each."""
    scratch = Scratch(docs.sparkSession, "near-groups")
    numbered = scratch.keep(docs.withColumn("_near_row", F.monotonically_increasing_id()), "numbered")
    found = _near(numbered.select("_near_row", text_col), id_col="_near_row", text_col=text_col, **how)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("node"))
    ids = numbered.select(F.col("_near_row").alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    placed = scratch.keep(found.join(ids, "row"), "placed")
    least = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"))
    ties = placed.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    tied = components(scratch.keep(ties, "ties"), scratch, "tied")
    return numbered, placed.join(tied, "node", "left").select("row", "doc_id", "n_shingles", F.coalesce("component", "node").alias("group"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept. Links have a Jaccard similarity of at least `percent` hundredths."""
    how |= {"shingle": shingle, "percent": percent, "id_col": id_col, "text_col": text_col}
    if _ids_are_nodes(docs, id_col):
        return _near(docs, **how)
    _, placed = _grouped(docs, **how)
    low = placed.groupBy("group").agg(F.min("doc_id").alias("low"))
    out = placed.join(low, "group").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("low")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of `docs` for each group of near copies: that with the smallest id, the first without ids."""
    how |= {"shingle": shingle, "percent": percent, "id_col": id_col, "text_col": text_col}
    if _ids_are_nodes(docs, id_col):
        kept = _near(docs, **how).where("kept").select(F.col("doc_id").alias(id_col))
        return docs.join(kept, id_col, "left_semi").select(*docs.columns)
    numbered, placed = _grouped(docs, **how)
    best = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    return numbered.join(best.select(F.col("best.row").alias("_near_row")), "_near_row", "left_semi").select(*docs.columns)
