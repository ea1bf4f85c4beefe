"""Near-duplicate documents by MinHash over word shingles.

One permutation: a shingle's hash names its bin by its high bits and the smallest hash of a bin is its
value; an empty bin borrows from the first filled bin in a fixed random order of its own (optimal
densification). Bins are grouped into bands, and documents that agree in a band share a bucket.

1. One pass over the texts gives each document's set size, a digest of its set, and its bins.
   Documents with equal sets are one node from here on, named by the smallest doc_id.
2. Candidates are stars: each bucket links its members to one centre, so a bucket of n gives n - 1
   pairs, not n * n / 2. Each member's star is confirmed on the full sets of both texts.
3. Components of confirmed links are found. Where a bucket's members are still in several components,
   its members outside the largest one are held against all members of other components, within the
   task that streams the bucket: first on bins alone, which rules out pairs that agree in too few of them
   and tells which members are needed in which bucket; then on the full sets, in the task that a
   needed member's text is sent to. A pair counts in one bucket only, the largest that both share, so a
   text travels to few buckets. So stars lose no link, and no task emits a bucket's pairs.

Bands are so many that a pair at the threshold shares none of them with probability 5e-6, and the
agreement that rules a pair out has a like probability at the threshold. ``rows`` = 1 and
``least_agreeing`` = 0 turn both off: then only a pair without one equal bin of 128 is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ._scratch import materialize, ship, tidy

SHINGLE = 5
PERCENT = 75
BINS = 128
ROWS = 4
#: Members that are compared with a centre in one task; larger stars are split by salts.
STAR_ROWS = 256
#: Bins that must agree, of BINS, for a pair to be compared on its sets: 4.4 standard deviations below the threshold's mean.
LEAST_AGREEING = 74
#: Sets of fewer shingles are always compared: their bins borrow too much to be counted.
FEW_SHINGLES = 32
#: Partners of a member that are compared in one pass.
PARTNERS_AT_ONCE = 128
#: Members of a bucket that one task holds, and shingles of their sets; larger buckets are held in several parts.
BLOCK_ROWS = 8192
BLOCK_SHINGLES = 4_000_000
#: So many ids may be broadcast to filter texts or sketches (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(20260101)
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For each bin the order in which it looks for a filled one, itself first.
_WALK = np.stack([np.concatenate([[b], (p := _RNG.permutation(BINS))[p != b]]) for b in range(BINS)])
_BOUNDS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of an Arrow array; nulls are empty.

    Words are what stands between ASCII white space, A-Z in lower case. With fewer words than
    ``size`` the whole sequence is one shingle; without words the set is empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    offsets, words = lists.offsets.to_numpy(), lists.flatten()
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
    coded = pc.dictionary_encode(words)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    w = hashes[coded.indices.to_numpy()[there]] if len(words) else hashes
    ends = np.concatenate([[0], np.cumsum(there)])[offsets - offsets[0]]
    n = max(0, len(w) - size + 1)
    full = np.zeros(n, np.uint64)
    for i in range(size):
        full += w[i : i + n] * _MULT[i]
    full = _mixed(full)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(_mixed((w[a:b] * _MULT[size + 1 : size + 1 + b - a]).sum(keepdims=True) + _MULT[size : size + 1] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The BINS values of a set that isn't empty, given sorted."""
    at = np.searchsorted(hashes, _BOUNDS)
    first = hashes[np.minimum(at, len(hashes) - 1)]
    filled = (at < len(hashes)) & (first >> np.uint64(64 - BINS.bit_length() + 1) == np.arange(BINS, dtype=np.uint64))
    empty = np.flatnonzero(~filled)
    if len(empty):
        walks = _WALK[empty]
        first[empty] = first[walks[np.arange(len(empty)), filled[walks].argmax(axis=1)]]
    return first


def bucket_numbers(bins: Column, rows: int = ROWS) -> Column:
    """An array of structs (band, bucket) of a signature's 16-bit bins; a bucket number belongs to one band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // rows - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring(bins, i * (2 * rows) + 1, F.lit(2 * rows)), i).alias("bucket")))


def sketches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest (of the set) and bins (16 bits of each bin); the last two are null if the set is empty."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        from plumbline.llm._tokens import GROUP_BYTES, balanced

        for batch in batches:
            for a, b in balanced(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), GROUP_BYTES):
                sets = shingle_sets(batch.column(1).slice(a, b - a), size)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary()),
                ], names=["doc_id", "n_shingles", "digest", "bins"])

    return narrow.mapInArrow(tidy(sketch), "doc_id long, n_shingles long, digest binary, bins binary")


def having(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is among ``ids`` (one column of that name): by broadcast if they are few enough."""
    ids = ids.distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def _texts(docs: DataFrame, text: str, doc_id: str, key: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias("t"))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets, not both empty, have 100 * intersection >= ``percent`` * union."""
    small, large = sorted((a, b), key=len)
    if not len(small):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def similar_to(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """``similar`` of one set, not empty, to each of others, none of them empty, in one pass over all of them."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return (both > 0) & (100 * both >= percent * (sizes + len(one) - both))


def confirm(pairs: DataFrame, docs: DataFrame, text: str, doc_id: str, size: int, percent: int) -> DataFrame:
    """The ``pairs`` (member, centre) whose full sets are that similar; of an id with several texts, any.

    Each centre's text is sent once for STAR_ROWS of its members; tasks stream through stars.
    """
    ship(docs.sparkSession)
    stars = pairs.groupBy("centre").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("salts"))
    members = pairs.join(stars, "centre").select("centre", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("member").alias("id"))
    centres = stars.select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("centre").alias("id"))
    asked = materialize(members.unionByName(centres), "asked-texts", small=True)
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
    rows = _texts(docs, text, doc_id, "id").join(asked, "id").repartition("centre", "salt").sortWithinPartitions("centre", "salt", "kind").select("centre", "kind", "id", "t")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        from plumbline.llm._tokens import GROUP_BYTES, balanced

        of, own = None, []
        for batch in batches:
            for a, b in balanced(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_pylist(), GROUP_BYTES):
                part = batch.slice(a, b - a)
                out = []
                for centre, kind, member, s in zip(*(c.to_pylist() for c in part.columns[:3]), shingle_sets(part.column(3), size), strict=True):
                    if centre != of:
                        of, own = centre, []
                    if kind == 0:
                        own.append(s)
                    elif any(similar(s, c, percent) for c in own):
                        out.append((member, centre))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["member", "centre"])

    return rows.mapInArrow(tidy(compare), "member long, centre long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Alternating large and small stars, with narrow rows, grouped minima and joins only.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars", small=True)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        now = materialize(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars", small=True)


def open_buckets(active: DataFrame, percent: int, size: int, rows: int, least_agreeing: int, exact: bool) -> DataFrame:
    """What buckets with several components still need: one narrow row a member, or the links that are found.

    ``active``: bucket, band, id, n, component, bins and ks (for each band the members of its bucket), and the text t if
    ``exact``. Each member outside its bucket's largest component is held against the members of other
    components whose bins agree enough. If not ``exact``, the result is (bucket, id) of the members that
    such a pair has; else their full sets are compared and the result is (a, b), components to be joined.
    """
    ship(active.sparkSession)
    bands = BINS // rows
    crowds = active.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n").alias("s")).groupBy("bucket").agg(F.max(F.struct("k", "component"))["component"].alias("largest"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    parts = F.ceil(F.greatest(F.col("k") / BLOCK_ROWS, F.col("s") / BLOCK_SHINGLES if exact else F.lit(0.0))).cast("int")
    placed = active.join(crowds.select("bucket", "largest", parts.alias("parts")), "bucket").withColumn("outside", F.col("component") != F.col("largest"))
    columns = ["bucket", "part", "kind", "band", "id", "n", "component", "outside", "ks", "bins"] + ["t"] * exact
    held = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("kind", F.lit(0)).select(columns)
    asking = placed.filter("outside").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(1)).select(columns)
    streamed = held.unionByName(asking).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, gathered, own, needed, joined = None, [], None, None, set()
        out: list[tuple[int, int]] = []

        def made() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["a", "b"] if exact else ["bucket", "id"])
            out.clear()
            return got

        def closed() -> None:
            if needed is not None:
                out.extend((int(key[0]), i) for i in own[0][needed].tolist())

        for batch in batches:
            bucket, part, kind, band, ids, n, component = (batch.column(i).to_numpy() for i in range(7))
            outside = batch.column(7).to_numpy(zero_copy_only=False)
            sizes = batch.column(8).flatten().to_numpy().reshape(len(ids), bands)
            bins = np.frombuffer(b"".join(batch.column(9).to_pylist()), "<u2").reshape(len(ids), BINS)
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            sets = np.empty(len(ids), object)
            if exact:
                sets[:] = shingle_sets(batch.column(10), size)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if (bucket[a], part[a]) != key:
                    closed()
                    key, gathered, own, needed, joined = (bucket[a], part[a]), [], None, None, set()
                if kind[a] == 0:
                    gathered.append((ids[a:b], n[a:b], component[a:b], outside[a:b], bins[a:b], sets[a:b]))
                    continue
                if gathered:
                    own, gathered = [np.concatenate(x) for x in zip(*gathered, strict=True)], []
                    needed = None if exact else np.zeros(len(own[0]), bool)
                if own is None:
                    continue
                for i in range(a, b):
                    fit = (own[2] != component[i]) & (~own[3] | (own[0] > ids[i])) & (100 * np.minimum(own[1], n[i]) >= percent * np.maximum(own[1], n[i]))
                    some = np.flatnonzero(fit)
                    if not len(some):
                        continue
                    same = own[4][some] == bins[i]
                    agreeing = same.sum(axis=1)
                    agreeing[np.minimum(own[1][some], n[i]) < FEW_SHINGLES] += BINS
                    shared = same.reshape(len(some), bands, rows).all(axis=2)
                    here = (agreeing >= least_agreeing) & (np.where(shared, sizes[i], -1).argmax(axis=1) == band[i]) & shared[:, band[i]]
                    if not here.any():
                        continue
                    if not exact:
                        needed[some[here]] = True
                        out.append((int(key[0]), int(ids[i])))
                        continue
                    partners, mine = some[here][np.argsort(-agreeing[here], kind="stable")], int(component[i])
                    for at in range(0, len(partners), PARTNERS_AT_ONCE):
                        chunk = [j for j in partners[at : at + PARTNERS_AT_ONCE].tolist() if (mine, int(own[2][j])) not in joined]
                        for j in np.array(chunk)[similar_to(sets[i], [own[5][j] for j in chunk], percent)].tolist() if chunk else []:
                            if (mine, int(own[2][j])) not in joined:
                                joined.add((mine, int(own[2][j])))
                                out.append((mine, int(own[2][j])))
            if len(out) > 10_000:
                yield made()
        closed()
        yield made()

    return streamed.mapInArrow(tidy(run), "a long, b long" if exact else "bucket long, id long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, least_agreeing: int = LEAST_AGREEING) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets.
    component_id is the smallest doc_id reachable, kept marks that document. Empty or null texts are
    linked with nothing. Rows that repeat a doc_id are one document, which is linked where one of its
    texts is. Without doc_id a row is linked with nothing: component_id is null and it is kept. An empty
    table gives an empty one; other columns are never read.
    """
    sketched = materialize(sketches(docs, text, doc_id, size), "sketches", small=True)
    there = sketched.filter("doc_id is not null and digest is not null")
    nodes = materialize(there.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bins").alias("bins"), F.first("n_shingles").alias("n"), F.count("*").alias("rows")), "nodes", small=True)
    dealt = nodes.select("id", F.inline(bucket_numbers(F.col("bins"), rows)))
    buckets = dealt.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("k")).filter("k > 1")
    members = materialize(dealt.join(buckets, "bucket").select("bucket", "band", "id", "centre", F.col("k").cast("int").alias("k")), "buckets", small=True)
    sizes = materialize(having(nodes.select("id", "n", "bins"), members.select("id"), "id"), "member-sketches", small=True)
    # A member is first compared with the centre that it meets most often; the rest is left to the buckets below.
    met = members.filter("id <> centre").groupBy(F.col("id").alias("member"), "centre").agg(F.count("*").alias("k"))
    of = sizes.select("id", "n")
    met = met.join(of.withColumnsRenamed({"id": "member", "n": "x"}), "member").join(of.withColumnsRenamed({"id": "centre", "n": "y"}), "centre").filter(f"100 * least(x, y) >= {percent} * greatest(x, y)")
    pairs = met.groupBy("member").agg(F.max(F.struct("k", (-F.col("centre")).alias("c")))["c"].alias("c")).select("member", (-F.col("c")).alias("centre"))
    links = confirm(materialize(pairs, "pairs", small=True), docs, text, doc_id, size, percent).select(F.col("member").alias("a"), F.col("centre").alias("b"))
    # A document with several texts stands in several nodes.
    several = there.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("doc_id")
    own = having(there.select("doc_id", "digest"), several, "doc_id").join(nodes.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = materialize(components(links.unionByName(own)), "components", small=True)
    # Buckets whose members are apart still.
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    placed = materialize(placed.join(apart, "bucket"), "open-buckets", small=True)
    ks = placed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("m"))  # one entry a band at most
    ks = ks.select("id", F.transform(F.sequence(F.lit(0), F.lit(BINS // rows - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("ks"))
    active = placed.select("bucket", "band", "id", "component").join(ks, "id").join(sizes, "id")
    needed = materialize(open_buckets(active, percent, size, rows, least_agreeing, exact=False), "needed-texts", small=True)
    texts = having(_texts(docs, text, doc_id, "id"), needed.select("id"), "id")
    joined = open_buckets(active.join(needed, ["bucket", "id"]).join(texts, "id"), percent, size, rows, least_agreeing, exact=True)
    merged = materialize(components(joined), "components", small=True).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    classes = nodes.select("digest", "id", "rows").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")).join(merged, "component", "left")
    classes = classes.withColumn("component_id", F.coalesce("whole", "component")).filter("rows > 1 or component_id <> id or whole is not null").select(F.col("digest").alias("_digest"), "component_id")
    out = sketched.select("doc_id", "n_shingles", "digest").join(classes, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def drop_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component, all columns as they were.

    Rows that repeat both doc_id and text leave one of them, that which sorts first by all other columns that
    can be sorted; rows of one doc_id with other texts stay. Rows without doc_id stay. A table without repeated
    ids isn't shuffled for it. Columns may have any names; an empty table gives an empty one.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows, key, body = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()]), inner[doc_id], inner[text]
    found = near_duplicates(docs, text, doc_id, size, percent).select("doc_id", "kept").filter("doc_id is not null")
    found = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")), "kept-ids", small=True)
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    by_id = lambda condition, how: rows.join(few(found.filter(condition).select(F.col("doc_id").alias("found_id"))), F.col(key).cast("long") == F.col("found_id"), how)
    single = by_id("not kept or n > 1", "left_anti")  # rows without id too
    repeated = by_id("kept and n > 1", "left_semi")
    rest = [c for c in rows.columns if c not in (key, body)]
    sortable = [c for c in rest if rows.schema[c].dataType.typeName() not in ("map", "variant")]
    first = F.min_by(F.struct(*rest), F.struct(*sortable)) if sortable else F.first(F.struct(*rest)) if rest else F.lit(None)
    repeated = repeated.groupBy(key, body).agg(first.alias("r")).select(key, body, *[F.col(f"r.{c}").alias(c) for c in rest])
    kept = single.unionByName(repeated)
    return kept.select(*[F.col(i).alias(c) for c, i in inner.items()])
