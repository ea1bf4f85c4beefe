"""Conversation prefix trie: what conversations share from their first turn on, summed from the leaves up.

A turn is known by 128 bits of its role and text, a prefix by two sums modulo 2^64 of its turns' halves times
powers of a fixed odd number, which can be added up over parts of a conversation, moved by some turns and taken
apart again. So turns are dealt by ranges of (conversation, turn), however long a conversation is, and only
a few numbers a turn are ever shuffled. Two prefixes are one with a probability of some 2^-100 a pair of them.

Nodes with the same members lie on one path, so those runs of nodes are one node (smallest member,
number of members) of a smaller tree. There, leaves are peeled: a node holds the count of children that haven't
reported yet; a node at zero is done and sends its totals to its parent, until the root is done. A round costs
one join of the nodes that are left, and there are as many rounds as member sets lie inside each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ._scratch import materialize, ship, tidy
from ._skew import salted_join

#: The odd numbers whose powers weigh the turns, for either half of a turn's 128 bits, and their inverses modulo 2^64.
BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in BASES], np.uint64)
#: Bytes of conversation ids that one row carries to the digest of its node.
CHUNK_BYTES = 1 << 20
#: Finished rounds that are read side by side before they are written as one table.
ROUNDS_AT_ONCE = 24

PREFIX = "conv_id long, part int, depth long, a long, b long, pa long, pb long, chars_to long, chars long"


def powers(bases: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """(exponents, 2): each of both bases to each exponent, not negative, modulo 2^64."""
    out = np.ones((len(exponents), 2), np.uint64)
    base, left = bases.copy(), exponents.astype(np.int64)
    while left.any():
        out = np.where((left & 1)[:, None] == 1, out * base, out)
        base = base * base
        left = left >> 1
    return out


def _pair(batch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(first).to_numpy().view(np.uint64), batch.column(first + 1).to_numpy().view(np.uint64)])


def _longs(pair: np.ndarray) -> list:
    import pyarrow as pa

    return [pa.array(np.ascontiguousarray(pair[:, i]).view(np.int64)) for i in range(2)]


def prefixes(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth (from 1), the prefix that ends with this turn (a, b), that before it (pa, pb), code points up to this turn and of its text.

    Turns are ordered by ``turn``, null first; those that tie are ordered by the digest of role and text, so any
    input order gives one result. A null role or text is empty. Rows without conv_id are left out.
    """
    spark = conversations.sparkSession
    ship(spark)
    said, by = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text, role))
    digest = F.unhex(F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said)))
    turns = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.length(said).cast("long").alias("chars"))
    turns = materialize(turns.filter("conv_id is not null"), "turns")
    dealt = turns.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest").select("conv_id", "digest", "chars")

    def summed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, n, sums, chars_to = TaskContext.get().partitionId(), None, 0, np.zeros(2, np.uint64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, chars = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            halves = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, 2)
            first = np.concatenate([[True], np.diff(ids) != 0])
            starts, run = np.flatnonzero(first), np.cumsum(first) - 1
            depth = np.arange(1, len(ids) + 1) - starts[run]
            if ids[0] == last:
                depth[run == 0] += n
            terms = halves * powers(BASES, depth)
            total, chars_total = np.cumsum(terms, axis=0, dtype=np.uint64), np.cumsum(chars)
            offset, chars_offset = (total - terms)[starts], (chars_total - chars)[starts]
            if ids[0] == last:
                offset[0] -= sums
                chars_offset[0] -= chars_to
            own, chars_own = total - offset[run], chars_total - chars_offset[run]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(depth), *_longs(own), *_longs(own - terms), pa.array(chars_own), batch.column(2)], schema=_schema())
            last, n, sums, chars_to = ids[-1], int(depth[-1]), own[-1], int(chars_own[-1])

    local = materialize(dealt.mapInArrow(tidy(summed), PREFIX), "prefixes")
    # A conversation that goes on in another range: at most one for each border between ranges.
    across = local.groupBy("conv_id").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("conv_id")
    ends = local.join(F.broadcast(across), "conv_id").groupBy("conv_id", "part").agg(F.max_by(F.struct("depth", "a", "b", "chars_to"), "depth").alias("e"))
    following: dict[int, tuple] = {}
    before: dict[int, tuple] = {}
    for r in sorted(ends.select("conv_id", "part", "e.*").collect(), key=lambda r: (r["conv_id"], r["part"])):  # two rows for each border at most
        n, sums, chars_to = before.get(r["conv_id"], (0, np.zeros(2, np.uint64), 0))
        if n:
            following[r["part"]] = (r["conv_id"], n, sums, chars_to)
        own = np.array([r["a"], r["b"]], np.int64).view(np.uint64)
        before[r["conv_id"]] = (n + r["depth"], sums + own * powers(BASES, np.array([n]))[0], chars_to + r["chars_to"])
    if not following:
        return local.drop("part")

    def moved(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, parts, depth = (batch.column(i).to_numpy().copy() for i in range(3))
            own, prior, chars_to = _pair(batch, 3), _pair(batch, 5), batch.column(7).to_numpy().copy()
            for part in np.unique(parts).tolist():
                if part not in following:
                    continue
                conv, n, sums, chars = following[part]
                here = (parts == part) & (ids == conv)
                power = powers(BASES, np.array([n]))[0]
                own[here], prior[here] = own[here] * power + sums, prior[here] * power + sums
                depth[here] += n
                chars_to[here] += chars
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(depth), *_longs(own), *_longs(prior), pa.array(chars_to), batch.column(8)], schema=_schema())

    return materialize(local.mapInArrow(tidy(moved), PREFIX).drop("part"), "prefixes")


def _schema():
    import pyarrow as pa

    return pa.schema([(name, pa.int32() if kind == "int" else pa.int64()) for name, kind in (x.split() for x in PREFIX.split(", "))])


def graft(found: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int) -> DataFrame:
    """The prefixes (and ``ends``) of conversations rebuilt from those of ``found``: the first ``head(conv_id)`` turns, at most ``most``, of conversation ``base(conv_id)``, then the conversation's own after so many.

    Where the base has fewer turns all of them are taken, where it is absent none. A conversation that is left
    without turns stays, as a member of the root alone. Each has a row of depth 0, without parent.
    """
    spark = found.sparkSession
    ship(spark)
    c, at = F.col("conv_id"), F.struct("a", "b", "chars_to")
    none = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("chars_to"))
    own = found.withColumn("h", head(c).cast("int"))
    own = own.groupBy("conv_id", "h").agg(F.max("depth").alias("turns"), F.max(F.when(F.col("depth") == F.col("h"), at)).alias("cut"))
    heads = found.filter(F.col("depth") <= most).groupBy(c.alias("base")).agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "pa", "pb", "chars_to", "chars"))).alias("heads"))  # at most ``most`` turns each
    own = own.withColumn("base", base(c)).join(heads, "base", "left").withColumn("heads", F.slice(F.coalesce("heads", F.array()), F.lit(1), F.col("h")))
    own = own.withColumn("k", F.greatest(F.size("heads"), F.lit(0))).withColumn("joint", F.coalesce(F.get(F.transform("heads", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["chars_to"].alias("chars_to"))), F.col("k") - 1), none)).withColumn("cut", F.coalesce("cut", none))
    own = materialize(own, "rebuilt-conversations")
    narrow = own.select("conv_id", "turns", "h", "k", "cut", "joint").withColumnRenamed("conv_id", "c")
    rest = found.join(narrow, (found["conv_id"] == F.col("c")) & (F.col("depth") > F.col("h")))
    rest = rest.select("conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), (F.col("h") - F.col("k")).cast("long").alias("back"), "a", "b", "pa", "pb", "cut.a", "cut.b", "joint.a", "joint.b", (F.col("chars_to") - F.col("cut.chars_to") + F.col("joint.chars_to")).alias("chars_to"), "chars", (F.col("depth") == F.col("turns")).alias("ends"))
    rest = rest.toDF("conv_id", "depth", "back", "a", "b", "pa", "pb", "ca", "cb", "ja", "jb", "chars_to", "chars", "ends")

    def joined(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            back = powers(INVERSES, batch.column(2).to_numpy())
            cut, joint = _pair(batch, 7), _pair(batch, 9)
            own, prior = ((_pair(batch, i) - cut) * back + joint for i in (3, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_longs(own), *_longs(prior), *(batch.column(i) for i in (11, 12, 13))], names=columns)

    columns = ["conv_id", "depth", "a", "b", "pa", "pb", "chars_to", "chars", "ends"]
    rest = rest.mapInArrow(tidy(joined), "conv_id long, depth long, a long, b long, pa long, pb long, chars_to long, chars long, ends boolean")
    short = F.col("turns") <= F.col("h")
    shared = own.select("conv_id", "k", short.alias("short"), F.inline("heads")).withColumn("ends", F.col("short") & (F.col("depth") == F.col("k"))).select(columns)
    zero = [F.lit(0).cast("long").alias(x) for x in ("depth", "a", "b")]
    root = own.select("conv_id", *zero, *[F.lit(None).cast("long").alias(x) for x in ("pa", "pb")], *[F.lit(0).cast("long").alias(x) for x in ("chars_to", "chars")], (short & (F.col("k") == 0)).alias("ends"))
    return materialize(rest.unionByName(shared).unionByName(root), "rebuilt-prefixes")


def whole(found: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that ``graft`` gives."""
    return graft(found, lambda c: c, lambda c: F.lit(0), 0)


def subtree_totals(chains: DataFrame) -> DataFrame:
    """``chains`` (conv_id, n_convs, their parent's parent_conv_id and parent_n, remaining, leaves, saved) with leaves and saved summed over subtrees.

    ``remaining`` is the number of children that have yet to report; leaves of the tree have 0.
    """
    left, done = materialize(chains, "open-nodes", small=True), []
    while not left.isEmpty():
        ready = left.filter("remaining = 0")
        done.append(ready.select("conv_id", "n_convs", "leaves", "saved"))
        if len(done) > ROUNDS_AT_ONCE:
            part = done[0]
            for x in done[1:]:
                part = part.unionByName(x)
            done = [materialize(part, "closed-nodes")]
        sent = ready.groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_n").alias("n_convs")).agg(F.count("*").alias("k"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        heard = left.filter("remaining > 0").join(sent, ["conv_id", "n_convs"], "left")
        left = materialize(heard.select("conv_id", "n_convs", "parent_conv_id", "parent_n", (F.col("remaining") - F.coalesce("k", F.lit(0))).alias("remaining"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "open-nodes", small=True)
    out = done[0] if done else left.select("conv_id", "n_convs", "leaves", "saved")
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def id_digests(rows: DataFrame) -> DataFrame:
    """depth, a, b and sha256 of a node's conv_ids, ascending and joined by commas; ``rows`` are (depth, a, b, conv_id).

    Ids are dealt by ranges of (node, id) and joined there; a node's chunks then pass one after another through its digest.
    """
    ship(rows.sparkSession)
    node = ["depth", "a", "b"]
    dealt = rows.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id").select(*node, "conv_id")

    def chunked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, ids, size = None, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*key, ids[0])] + [pa.array([",".join(map(str, ids))])], names=[*node, "first", "ids"])

        for batch in batches:
            for *at, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (at != key or size > CHUNK_BYTES):
                    yield closed()
                    ids, size = [], 0
                key = at
                ids.append(conv)
                size += len(str(conv)) + 1
        if ids:
            yield closed()

    def digested(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, sha = None, None
        closed = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in key] + [pa.array([sha.hexdigest()])], names=[*node, "sha256"])
        for batch in batches:
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    if sha:
                        yield closed()
                    key, sha = at, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha:
            yield closed()

    chunks = dealt.mapInArrow(tidy(chunked), "depth long, a long, b long, first long, ids string")
    return chunks.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(tidy(digested), "depth long, a long, b long, sha256 string")


def trie(rebuilt: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    ``rebuilt`` is what ``graft`` or ``whole`` gives. No conversations give no node, not even the root.
    """
    node, prior = ["depth", "a", "b"], ["depth", "pa", "pb"]
    nodes = rebuilt.groupBy(*node).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("chars_to").alias("chars_to"), F.min("chars").alias("chars"))
    nodes = materialize(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"), F.col("n_children").alias("asked"))
    below = salted_join(nodes.filter("depth > 0"), parents, prior, "asked", "a").drop("asked")
    root = nodes.filter("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "parent_n": F.lit(None).cast("long")})
    tree = materialize(below.unionByName(root).drop("pa", "pb"), "trie")
    chains = tree.groupBy("conv_id", "n_convs").agg(
        F.min_by(F.struct("parent_conv_id", "parent_n"), "depth").alias("parent"), F.max_by("n_children", "depth").alias("remaining"), F.max("chars_to").alias("upto"), F.min(F.col("chars_to") - F.col("chars")).alias("since")
    )
    chains = materialize(chains, "chains")
    leaf = (F.col("remaining") == 0).cast("long")
    saved = (F.col("n_convs") - 1) * (F.col("upto") - F.col("since"))
    totals = subtree_totals(chains.select("conv_id", "n_convs", "parent.parent_conv_id", "parent.parent_n", "remaining", leaf.alias("leaves"), saved.alias("saved")))
    totals = totals.filter("n_convs > 1").join(chains.select("conv_id", "n_convs", "since"), ["conv_id", "n_convs"])
    # Below a node of one member stand only that conversation's further turns.
    single = tree.filter("n_convs = 1").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    several = tree.filter("n_convs > 1").join(totals, ["conv_id", "n_convs"]).withColumn("n_leaves", F.col("leaves")).withColumn("saved_tokens", F.col("saved") - (F.col("n_convs") - 1) * (F.col("chars_to") - F.col("chars") - F.col("since")))
    columns = [*node, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    found = single.select(columns).unionByName(several.select(columns))
    ends = id_digests(rebuilt.filter("ends").select(*node, "conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(ends, node, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", empty).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of ``conversations`` as they are; nulls, ties and rows without conv_id as in ``prefixes``. Other columns are never read."""
    return trie(whole(prefixes(conversations, conv_id, turn, role, text)))
