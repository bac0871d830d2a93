"""N-gram Jaccard self-join of documents under several global token orders.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least ``percent`` / 100.
The result is one row per document with its component, so no group of copies is ever expanded into its pairs.

1. *Support*: a linked document shares at least ``percent`` / 100 of its shingles with others. Blocks of documents send each
   distinct shingle once (four bytes and its bucket), already marked where the block itself holds it twice; a bucket finds the
   shingles that one document alone has. Documents with too many of those can have no link and leave.
2. *Copies*: equal sets collapse to the smallest id and take no part in what follows; at the end each copy looks up its set's
   component. Under each global order (a random permutation of all shingles) documents with the same first token meet in blocks of
   about ``MEET`` and all pairs of a block are verified at once; a block gives at most one link a document, so near copies fall
   into components.
3. *Support across components*: a shingle found in one component only can't link to another. Documents left with less than
   the threshold of shared shingles leave again; all links between components lie among the rest.
4. *Orders*: the rest is joined by prefix tokens. Each global order sorts by document frequency and breaks ties by its own
   permutation; two documents of different components are candidates only if their prefixes meet under *every* order and the
   shingles that either has alone leave room for the threshold. Candidates are verified exactly. Where more than ``MEET_ROWS``
   rows share a prefix token, they are verified in blocks instead of pairs; only blocks whose set sizes may reach the threshold meet.

Nothing is sampled or capped: every stage only drops pairs that can't reach the threshold or lie in one component already.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import common
from codeweave.llm.common import U64, mix64
from codeweave.llm.components import connected_components
from codeweave.plans.joins import counted, dealt_join, frequent, looked_up
from codeweave.session import materialize

BLOCK = 500_000
MEET = 512
#: Rows that share a prefix token are paired by a join up to this number; beyond it they are verified in blocks.
MEET_ROWS = 64
#: Up to so many ids or hashes go to each executor as one array (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_SEEDS = [U64(0x243F6A8885A308D3), U64(0x13198A2E03707344), U64(0xA4093822299F31D0), U64(0x082EFA98EC4E6C89)]

_SENT = pa.schema([("bucket", pa.int32()), ("pres", pa.binary()), ("res", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("own", pa.binary()), ("sizes", pa.binary())])
_SENT_SQL = "bucket int, pres binary, res binary, ids binary, counts binary, own binary, sizes binary"


def _squeeze(ids: np.ndarray) -> bytes:
    """int64 ids as their first value and small differences, which compress well on the wire."""
    steps = np.diff(ids)
    if len(ids) and (not len(steps) or (np.abs(steps).max() < 1 << 31)):
        return b"\x01" + ids[:1].tobytes() + steps.astype(np.int32).tobytes()
    return b"\x00" + ids.tobytes()


def _unsqueeze(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\x00":
        return np.frombuffer(raw[1:], np.int64)
    first = np.frombuffer(raw[1:9], np.int64)
    return np.concatenate([first, first + np.cumsum(np.frombuffer(raw[9:], np.int32), dtype=np.int64)])


def _support_sender(bits: int):
    buckets = 1 << bits

    def flush(sets: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        ids_a, sizes = np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64)
        h = np.concatenate(sets) if sets else np.zeros(0, U64)
        doc = np.repeat(np.arange(len(ids_a)), sizes)
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.zeros(0, np.int64)
        run = np.diff(np.append(edge, len(h)))
        twice = ordered[edge[run > 1]]
        alone = np.sort(order[edge[run == 1]])
        bucket = (h[alone] >> U64(64 - bits)).astype(np.int64)
        alone = alone[np.argsort(bucket, kind="stable")]
        at = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
        at2 = np.searchsorted((twice >> U64(64 - bits)).astype(np.int64), np.arange(buckets + 1))
        low = lambda x: (x >> U64(32 - bits)).astype(np.uint32).tobytes()
        rows = []
        for b in range(buckets):
            part = alone[at[b] : at[b + 1]]
            docs, counts = np.unique(doc[part], return_counts=True)
            own = slice(b, None, buckets)
            rows.append((b, low(twice[at2[b] : at2[b + 1]]), low(h[part]), _squeeze(ids_a[docs]), counts.astype(np.uint32).tobytes(), _squeeze(ids_a[own]), sizes[own].astype(np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, ids, held = [], [], 0
        for batch in common.by_bytes(batches):
            data, offsets = common.text_buffer(batch.column(1))
            for i, s in zip(batch.column(0).to_pylist(), common.shingle_sets(data, offsets)):
                sets.append(s)
                ids.append(i)
                held += len(s) + 8
                if held >= BLOCK:
                    yield flush(sets, ids)
                    sets, ids, held = [], [], 0
        if ids:
            yield flush(sets, ids)

    return send


def _support_receiver(table: pa.Table) -> pa.Table:
    common.starts("jaccard")
    ids, lone, sizes = [], [], []
    pres = [np.frombuffer(x, np.uint32) for x in table["pres"].to_pylist()]
    res = [np.frombuffer(x, np.uint32) for x in table["res"].to_pylist()]
    every = np.sort(np.concatenate([*pres, *res]))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    for r, own_docs, counts, own, n in zip(res, table["ids"].to_pylist(), table["counts"].to_pylist(), table["own"].to_pylist(), table["sizes"].to_pylist()):
        counts = np.frombuffer(counts, np.uint32)
        if len(counts):
            at = np.searchsorted(again, r)
            single = (again[np.minimum(at, len(again) - 1)] != r) if len(again) else np.ones(len(r), bool)
            ids.append(_unsqueeze(own_docs))
            lone.append(np.bincount(np.repeat(np.arange(len(counts)), counts)[single], minlength=len(counts)))
            sizes.append(np.zeros(len(counts), np.int64))
        n = np.frombuffer(n, np.int64)
        if len(n):
            ids.append(_unsqueeze(own))
            lone.append(np.zeros(len(n), np.int64))
            sizes.append(n)
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    out, at = np.unique(cat(ids), return_inverse=True)
    total = np.bincount(at, weights=cat(lone), minlength=len(out)).astype(np.int64)
    largest = np.zeros(len(out), np.int64)
    np.maximum.at(largest, at, cat(sizes))
    del pres, res, every, again, lone
    common.give_back()
    return pa.table({"doc_id": out, "lone": total, "n": largest})


def shingle_support(docs: DataFrame) -> DataFrame:
    """(doc_id, n, lone): size of each document's shingle set, and how many of them no other row has."""
    parts = max(1, docs.rdd.getNumPartitions())
    bits = min(16, max(6, (2 * parts - 1).bit_length()))
    sent = docs.select("doc_id", "text").mapInArrow(_support_sender(bits), _SENT_SQL)
    found = sent.groupBy("bucket").applyInArrow(_support_receiver, "doc_id long, lone long, n long")
    return found.groupBy("doc_id").agg(F.sum("lone").alias("lone"), F.max("n").alias("n"))


def _sets(orders: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("grams", pa.binary()), ("firsts", pa.list_(pa.int64()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in common.by_bytes(batches):
            data, offsets = common.text_buffer(batch.column(1))
            rows = []
            for i, s in zip(batch.column(0).to_pylist(), common.shingle_sets(data, offsets)):
                raw = s.tobytes()
                rows.append((i, len(s), hashlib.blake2b(raw, digest_size=16).digest(), raw, [int(mix64(s ^ seed).min().view(np.int64)) if len(s) else 0 for seed in _SEEDS[:orders]]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return make


def _verify(percent: int):
    """Keep the pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.starts("jaccard")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            kept = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept
            common.give_back()

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rows of sets(row, doc_id, grams) that reach the threshold, as pairs of documents."""
    left = sets.select(F.col("row").alias("a"), F.col("doc_id").alias("da"), F.col("grams").alias("ga"))
    right = sets.select(F.col("row").alias("b"), F.col("doc_id").alias("db"), F.col("grams").alias("gb"))
    full = pairs.select("a", "b").join(left, "a").join(right, "b").select("da", "db", "ga", "gb")
    return full.mapInArrow(_verify(percent), "a long, b long")


def link_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest (index, index) of the links among all pairs of the sets."""
    sizes = np.array([len(s) for s in sets])
    tokens, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    kept = df[at] > 1
    row, column = row[kept], (np.cumsum(df > 1) - 1)[at[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((df > 1).sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    both = np.rint(both).astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    out, free = [], np.ones(len(sets), bool)
    for root in range(len(sets)):
        if free[root]:
            free[root] = False
            todo = [root]
            while todo:
                new = np.flatnonzero(linked[todo].any(0) & free)
                free[new] = False
                todo = new.tolist()
                out += [(i, root) for i in todo]
    return out


def _meet(percent: int):
    """Rows (k, h, block, doc_id, grams) sorted by the first three to links (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(ids[i], ids[j]) for i, j in link_forest(sets, percent)] if len(ids) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.starts("jaccard")
        key, ids, sets, out = None, [], [], []
        for batch in batches:
            for k, h, block, i, grams in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if (k, h, block) != key:
                    out += solve(ids, sets)
                    key, ids, sets = (k, h, block), [], []
                ids.append(i)
                sets.append(np.frombuffer(grams, U64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out := solve(ids, sets):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], schema=schema)
        common.give_back()

    return run


def first_token_links(reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among sets(row, doc_id, n, grams, firsts) whose first tokens agree under an order; at most one a row and order."""
    keyed = counted(reps.select("row", "doc_id", F.posexplode("firsts").alias("k", "h")), ["k", "h"], "rows")
    met = keyed.where("rows > 1").withColumn("block", F.expr(f"pmod(xxhash64(row, k), cast(ceil(rows / {MEET}) as bigint))"))
    full = met.select("row", "doc_id", "k", "h", "block").join(reps.select("row", "grams"), "row")
    dealt = full.select("k", "h", "block", "doc_id", "grams").repartition("k", "h", "block").sortWithinPartitions("k", "h", "block")
    return dealt.mapInArrow(_meet(percent), "a long, b long")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, grams) to (h, comp), each hash once in a batch and component; hashes as signed longs."""
    common.starts("jaccard")
    for batch in batches:
        comps, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        grams = [np.frombuffer(x.as_buffer(), U64) for x in batch.column(1)]
        h, owner = np.concatenate(grams), np.repeat(at, [len(g) for g in grams])
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
        h, owner = h[new], owner[new]
        for i in range(0, len(h), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 200_000].view(np.int64)), pa.array(comps[owner[i : i + 200_000]])], ["h", "comp"])
        common.give_back()


def _shared_counter(broadcast, percent: int):
    """Keep rows (…, grams last) of which the threshold's part lies in the broadcast sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.starts("jaccard")
        shared = np.frombuffer(broadcast.value, U64)
        for batch in batches:
            keep = []
            for x in batch.column(batch.num_columns - 1):
                g = np.frombuffer(x.as_buffer(), U64)
                hits = int((shared[np.minimum(np.searchsorted(shared, g), len(shared) - 1)] == g).sum()) if len(shared) else 0
                keep.append(hits * 100 >= percent * len(g))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.starts("jaccard")
    for batch in batches:
        for i, n, comp, x in zip(*(batch.column(k) for k in range(4))):
            g = np.frombuffer(x.as_buffer(), np.int64)
            m = len(g)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, v.as_py(), np.int64)) for v in (i, n, comp)] + [pa.array(g)], ["row", "n", "comp", "h"])


def _prefixes(percent: int, orders: int):
    def run(table: pa.Table) -> pa.Table:
        common.starts("jaccard")
        h, df = table["h"].to_numpy(), table["df"].to_numpy()
        n = int(table["n"][0].as_py())
        length = n - -(-percent * n // 100) + 1
        parts = [h[np.lexsort((mix64(h.view(U64) ^ seed), df))[:length]] for seed in _SEEDS[:orders]]
        m = sum(map(len, parts))
        whole = {k: np.full(m, int(table[k][0].as_py()), np.int64) for k in ("row", "n", "comp")}
        whole["most"] = np.full(m, n - int((df == 1).sum()), np.int64)
        return pa.table(whole | {"k": np.repeat(np.arange(orders, dtype=np.int32), [len(p) for p in parts]), "h": np.concatenate(parts)})

    return run


def order_prefixes(rest: DataFrame, percent: int, orders: int) -> DataFrame:
    """Prefix tokens (row, n, comp, most, k, h, rows) of rest(row, n, comp, grams) under each order k.

    An order sorts by the number of rows of rest that hold the shingle, rarest first, then by its own permutation; a linked pair
    shares a token among the first n - ceil(n * percent / 100) + 1 under any such order. most: shingles that any other row of
    rest has; rows: rows that have the token in their prefix.
    """
    spread = rest.select("row", "n", "comp", "grams").mapInArrow(_spread, "row long, n long, comp long, h long")
    prefix = counted(spread, ["h"], "df").groupBy("row").applyInArrow(_prefixes(percent, orders), "row long, n long, comp long, most long, k int, h long")
    prefix = materialize(prefix, "prefixes")
    return materialize(counted(prefix, ["k", "h"], "rows"), "prefixes")


def order_candidates(prefix: DataFrame, percent: int, orders: int) -> DataFrame:
    """Pairs (a, b) of rows of different components that share a token of at most MEET_ROWS rows and whose prefixes may meet under every order.

    Under an order where both have tokens of more rows, they are taken to meet. Pairs that share such tokens only are left to
    ``crowd_links``.
    """
    crowded = prefix.where(f"rows > {MEET_ROWS}").groupBy("row").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("crowded"))
    few = prefix.where(f"rows <= {MEET_ROWS}").join(crowded, "row", "left").withColumn("crowded", F.coalesce("crowded", F.lit(0)))
    side = lambda x: few.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}"), F.col("most").alias(f"m{x}"), F.col("crowded").alias(f"w{x}"), "k", "h")
    # An intersection is no larger than the shingles of either that another row has.
    near = F.least("ma", "mb") * 100 >= percent * (F.col("na") + F.col("nb") - F.least("ma", "mb"))
    met = side("a").join(side("b"), ["k", "h"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near)
    seen = met.groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("seen"), F.first(F.col("wa").bitwiseAND(F.col("wb"))).alias("crowded"))
    return seen.where(F.col("seen").bitwiseOR(F.col("crowded")) == (1 << orders) - 1).select("a", "b")


def crowd_links(prefix: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among documents that share prefix tokens of more than MEET_ROWS rows under the first order.

    Rows whose crowded tokens hang together form a crowd. It is cut by set size into bands of ratio percent / 100, so that a link's
    ends lie in one band or in neighbours, and each band into blocks, large components into blocks of their own. Each pair of blocks
    that may link different components is verified in one piece; only a spanning forest comes out.
    """
    own = prefix.where(f"k = 0 and rows > {MEET_ROWS}").select("row", "n", "comp", "h")
    first = own.groupBy("row", "n", "comp").agg(F.min("h").alias("first"))
    ties = own.join(first.select("row", "first"), "row").select(F.col("first").alias("a"), F.col("h").alias("b")).distinct()
    crowds = connected_components(ties).select(F.col("vertex").alias("first"), F.col("component").alias("found"))
    first = materialize(first.withColumn("band", F.expr(f"cast(floor(ln(n) / (1.000001 * ln(100.0 / {percent}))) as int)")), "crowds")
    member = looked_up(first, crowds, ["first"], frequent(first, ["first"]))
    member = materialize(member.select("row", "comp", "band", F.coalesce("found", "first").alias("crowd")), "crowds")
    sizes = member.groupBy("crowd", "comp", "band").agg(F.count("*").alias("rows")).withColumn("large", F.expr(f"rows > {MEET // 2}"))
    smalls = sizes.where("not large").groupBy("crowd", "band").agg(F.sum("rows").alias("small_rows"))
    sized = sizes.join(smalls, ["crowd", "band"], "left")
    sized = looked_up(member, sized, ["crowd", "comp", "band"], frequent(member, ["crowd", "comp", "band"]))
    large = f"xxhash64(comp, pmod(xxhash64(row), cast(ceil(rows / {MEET}) as bigint)))"
    small = f"pmod(xxhash64(comp), cast(ceil(small_rows / {MEET}) as bigint))"
    placed = sized.select("row", "crowd", "band", F.expr("if(large, comp, null)").alias("owner"), F.expr(f"if(large, {large}, {small})").alias("part"))
    placed = materialize(placed, "placed")
    blocks = placed.select("crowd", "band", "owner", "part").distinct()
    left = blocks.select("crowd", F.col("band").alias("ba"), F.col("owner").alias("oa"), F.col("part").alias("pa"), F.explode(F.array("band", F.col("band") + 1)).alias("bb"))
    right = blocks.select("crowd", F.col("band").alias("bb"), F.col("owner").alias("ob"), F.col("part").alias("pb"))
    rank = lambda b, o, p: F.struct(F.col(b), F.col(o).isNotNull(), F.coalesce(o, F.lit(0)), p)
    pairs = left.join(right, ["crowd", "bb"]).where((rank("ba", "oa", "pa") <= rank("bb", "ob", "pb")) & ~F.coalesce(F.col("oa") == F.col("ob"), F.lit(False)))
    pairs = materialize(pairs.withColumn("h", F.xxhash64("crowd", "ba", "oa", "pa", "bb", "ob", "pb")), "block-pairs")
    block = lambda x: F.xxhash64("crowd", f"b{x}", f"o{x}", f"p{x}").alias("block")
    ends = materialize(pairs.select(block("a"), "h").union(pairs.select(block("b"), "h")).distinct(), "block-ends")
    dealt = dealt_join(ends, placed.select("row", F.xxhash64("crowd", "band", "owner", "part").alias("block")), ["block"]).select("row", "h")
    full = dealt.join(rest.select("row", "doc_id", "grams"), "row").select(F.lit(0).alias("k"), "h", F.lit(0).alias("block"), "doc_id", "grams")
    return full.repartition("h").sortWithinPartitions("h").mapInArrow(_meet(percent), "a long, b long")


@common.in_small_batches
def jaccard_components(docs: DataFrame, percent: int = 80, orders: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per distinct doc_id of docs(doc_id, text, ...).

    Null and empty texts have no shingles and link with nothing; rows with a null doc_id are not documents and have no row; rows
    that repeat a doc_id are one document, which links as any of its texts does (n_shingles: the largest); other columns are
    ignored whatever their names; an empty table gives an empty result. Ties need no rule: a component's id is its smallest
    doc_id.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    support = materialize(shingle_support(docs), "support")
    able = support.where(f"n > 0 and (n - lone) * 100 >= {percent} * n").select("doc_id")
    # A repeated doc_id adds up the lone shingles of its rows, so it is never left out.
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    able = able.union(repeated).distinct()
    small = able.count() <= BROADCAST_ROWS
    chosen = docs.join(F.broadcast(able) if small else able, "doc_id", "left_semi")
    sets = chosen.mapInArrow(_sets(orders), "doc_id long, n long, sig binary, grams binary, firsts array<long>").where("n > 0")
    sets = materialize(sets.withColumn("row", F.monotonically_increasing_id()), "sets")

    groups = sets.groupBy("sig", "n").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count("*").alias("rows"))
    groups = materialize(groups.select("sig", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.row").alias("row"), "rows"), "groups")
    reps = sets.join(groups.select("row"), "row", "left_semi")
    copies = materialize(dealt_join(sets.select("doc_id", "sig", "n"), groups.where("rows > 1").select("sig", "n", "rep"), ["sig", "n"]), "copies")
    # Different sets of one document hang together by its id, a copy of another's set by its representative's.
    again = looked_up(copies.select("doc_id", "rep"), repeated.withColumn("again", F.lit(True)), ["doc_id"], None).where("again and doc_id <> rep")
    links = materialize(again.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).union(first_token_links(reps, percent)), "links")
    comps = connected_components(links)

    owned = reps.join(comps.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").select("row", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"), "grams")
    owned = materialize(owned, "owned")
    spread = owned.select("comp", "grams").mapInArrow(_explode, "h long, comp long")
    across = spread.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
    across = materialize(across, "across")
    if across.count() <= BROADCAST_ROWS:
        shared = np.sort(across.toArrow()["h"].to_numpy().view(U64))
        shared = spark.sparkContext.broadcast(shared.tobytes())
        rest = owned.mapInArrow(_shared_counter(shared, percent), owned.schema)
    else:
        hit = materialize(owned.select("row", "n", "comp", "grams").mapInArrow(_spread, "row long, n long, comp long, h long").select("row", "n", "h"), "spread")
        hit = dealt_join(hit, across, ["h"], "left_semi")
        enough = hit.groupBy("row").agg(F.count("*").alias("hits"), F.first("n").alias("n")).where(f"hits * 100 >= {percent} * n")
        rest = owned.join(enough.select("row"), "row", "left_semi")
    rest = materialize(rest, "rest")
    if rest.limit(1).count():
        prefix = order_prefixes(rest, percent, orders)
        more = verified(order_candidates(prefix, percent, orders), rest, percent)
        if prefix.where(f"rows > {MEET_ROWS}").limit(1).count():
            more = more.union(crowd_links(prefix, rest, percent))
        more = materialize(more, "more")
        if more.limit(1).count():
            comps = connected_components(links.union(more))
    own = comps.withColumnRenamed("vertex", "doc_id").withColumnRenamed("component", "own")
    of_rep = comps.select(F.col("vertex").alias("rep"), "component")
    through = looked_up(copies.where("doc_id <> rep").select("doc_id", "rep").distinct(), of_rep, ["rep"], frequent(copies, ["rep"]))
    through = through.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("through"))
    named = support.join(own, "doc_id", "left").join(through, "doc_id", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.least("doc_id", F.coalesce("own", "doc_id"), F.coalesce("through", "doc_id")).alias("component_id"))


#: Every pair that shares a shingle, then all that the links reach; documents of one shingle set are first told by their smallest id.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(w)]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4])))) END AS g FROM d),
r AS (SELECT min(doc_id) AS rep, g FROM s WHERE len(g) > 0 GROUP BY g),
t AS (SELECT rep, len(g) AS n, unnest(g) AS h FROM r),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.h = b.h AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS v, least(a, b) AS low FROM both_ways UNION SELECT b.b, r.low FROM reach r JOIN both_ways b ON b.a = r.v WHERE r.low < b.b),
comp AS (SELECT v, min(low) AS low FROM reach GROUP BY v)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(comp.low, r.rep, s.doc_id) AS component_id
FROM s LEFT JOIN r ON s.g = r.g LEFT JOIN comp ON comp.v = r.rep
"""
