"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, made of the XXH64 values of a text's three-word shingles. Two fingerprints
are linked when they differ in at most three bits. ``covering_masks`` gives 15 bit masks such that any
two fingerprints within that radius agree on all bits of at least one mask: give every bit position a
non-zero vector of four bits, and let mask ``v`` hold the positions whose vector has an odd product
with ``v``. Three differing positions span at most three dimensions of the four, so some non-zero ``v``
is orthogonal to all of them and its mask holds none of the positions that differ.

Buckets of equal masked bits are searched as a whole, in blocks, and give a forest of links, never all
pairs. A bucket over ``BUCKET`` fingerprints is split again by a covering of the bits its mask leaves
open, so no link within it is lost; after two splits at most about 2**8 fingerprints can share a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import cut, map_batches, map_rows, utf8

RADIUS = 3
BITS = 64
BUCKET = 512
SEED = 42
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def covering_masks(bits: Iterable[int], radius: int = RADIUS) -> list[int]:
    """2**(radius+1)-1 masks over the positions ``bits`` that cover all pairs within ``radius``."""
    vectors = 2 ** (radius + 1) - 1
    given = {b: 1 + i % vectors for i, b in enumerate(bits)}
    return [sum(1 << b for b, x in given.items() if (x & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(data: bytes | None) -> int:
    """The unsigned fingerprint of one UTF-8 text; 0 when it has no word."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-3])).tolist()
        stops = (ends[2:] - 1).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    n = len(hashes)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 256:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of ``docs``; a null or wordless text has fingerprint 0."""
    return map_rows(
        docs.select(F.col(id_col).cast("long"), utf8(text_col)),
        lambda i, data: (i, _signed(fingerprint(data))),
        "id long, fp long",
    )


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Star links (least member, member) of the components of ``fps`` (uint64, distinct) within RADIUS."""
    n, out, left = len(fps), [], np.ones(len(fps), bool)
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        edge, members = [i], []
        while edge:
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = (np.bitwise_count(fps[rest][:, None] ^ fps[edge][None, :]) <= RADIUS).any(axis=1)
            edge = rest[near].tolist()
            left[edge] = False
            members += edge
        out += [(i, j) for j in members]
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets that arrive as sorted arrays of fingerprints."""
    for batch in batches:
        column = batch.column(0)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(column.offsets.to_numpy())
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        two = lengths == 2
        a, b = flat[starts[two]], flat[starts[two] + 1]
        near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= RADIUS
        left, right = [a[near]], [b[near]]
        for s, n in zip(starts[~two].tolist(), lengths[~two].tolist(), strict=True):
            own = flat[s : s + n]
            if found := _forest(own.view(np.uint64)):
                i, j = np.array(found).T
                left.append(own[i])
                right.append(own[j])
        u, v = np.concatenate(left), np.concatenate(right)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64())], ["u", "v"]
        )


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints ``fps`` (fp) just as all pairs within RADIUS do."""
    keyed = [_keys(covering_masks(range(BITS)))]
    first = fps.select("fp", F.explode(F.array(*keyed[0])).alias("k")).select("fp", "k.t", "k.key")
    found, level, rows = [], 0, first
    while True:
        sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = cut(sizes)
        small = sizes.filter(F.col("n") <= bucket) if level < 2 else sizes
        large = sizes.filter(F.col("n") > bucket).select("t", "key")
        # Grouping by a hash of the key asks for its own exchange, so that AQE may split the join's hot keys.
        groups = (
            rows.join(small.select("t", "key"), ["t", "key"])
            .select("fp", F.xxhash64("t", "key").alias("g"))
            .groupBy("g")
            .agg(F.collect_set("fp").alias("fps"))
            .select(F.array_sort("fps").alias("fps"))
        )
        found.append(map_batches(groups, _bucket_links, "u long, v long"))
        if level == 2 or large.isEmpty():
            break
        rows = _split(rows.join(large, ["t", "key"]), level)
        level += 1
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct()


def _keys(masks: list[int], base: int = 0) -> list:
    return [F.struct(F.lit(base + i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]


def _path_masks(level: int) -> dict[int, tuple[int, list[int]]]:
    """For each table of ``level``: the bits it fixes, and the masks that split it further."""
    fixed = {i: m for i, m in enumerate(covering_masks(range(BITS)))}
    for _ in range(level):
        fixed = {15 * t + i: m | x for t, m in fixed.items() for i, x in enumerate(_cover_open(m))}
    return {t: (m, _cover_open(m)) for t, m in fixed.items()}


def _cover_open(fixed: int) -> list[int]:
    return covering_masks([b for b in range(BITS) if not fixed >> b & 1])


def _split(rows: DataFrame, level: int) -> DataFrame:
    """Rows of large buckets, dealt anew by the bits their table leaves open."""
    paths = _path_masks(level)
    table = F.array(*[F.array(*[F.lit(_signed(m | x)) for x in sub]) for m, sub in (paths[t] for t in sorted(paths))])
    deeper = F.posexplode(F.element_at(table, F.col("t") + 1))
    return rows.select("fp", "t", deeper.alias("i", "mask")).select(
        "fp", (F.col("t") * 15 + F.col("i")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for the nodes that ``edges`` (u, v) name.

    Large-star and small-star steps alternate until the links no longer change, however many rounds that
    takes (their number grows with the logarithm of the nodes); every node then links to its root. Each
    round's links go to the shared folder, so neither lineage nor driver memory grows.
    """
    edges, before = cut(edges.select("u", "v").filter("u != v")), None
    # The least neighbours are written before they are joined: then both sides of the join have an
    # exchange of their own and AQE may split the links of a node that has very many.
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u != v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _rooted(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp and more, one row for each fp) with ``root``, the least fingerprint of its component."""
    roots = cut(components(links(distinct.select("fp"))))
    return cut(distinct.join(roots, distinct.fp == roots.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): one row per row of ``docs``.

    ``component_id`` is the least id among all rows whose fingerprints are reachable over links of at
    most RADIUS bits. Null and wordless texts share fingerprint 0 and are linked like any other; rows
    with a null id count for no minimum and get the component of their fingerprint (null if no row of
    it has an id). Repeated rows stay repeated; an empty table gives an empty result; further columns
    of ``docs`` are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    joined = _rooted(cut(fps.groupBy("fp").agg(F.min("id").alias("least"))))
    ids = cut(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = cut(joined.select("fp", "root").join(ids, "root").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select("id", "fp", "component_id")


#: Bits of the map that tells which rows may be copies: 8 MB on the driver and each worker, whatever the table's size.
MAP_BITS = 1 << 26


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns kept: that with the least (id, hash of the text), null ids last.

    Decided row by row: an id that stands in several components with different texts loses only the rows
    that are not their component's first. Of rows equal in id and text any one stays. A row alone in its
    component always stays, so null and wordless texts, which share a fingerprint, leave one row. An
    empty table gives an empty result; columns of any name pass through.

    Whole texts are shuffled only for rows in components of several rows: those rows' keys set bits of a
    map of fixed size, and a row whose bit is not set cannot be one of them. The others are joined with
    the exact verdicts, so a full map costs time and changes nothing.
    """
    spark, names = docs.sparkSession, docs.columns
    i, t = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))])
    rows = cut(
        map_rows(
            numbered.select(F.col(i).cast("long"), F.xxhash64(t), utf8(t)),
            lambda i, h, data: (i, h, _signed(fingerprint(data))),
            "id long, hash long, fp long",
        )
    )
    key = F.struct(F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0)).alias("id"), "hash")
    joined = _rooted(cut(rows.groupBy("fp").agg(F.min(key).alias("best"), F.count("*").alias("n"))))
    groups = cut(joined.groupBy("root").agg(F.min("best").alias("first"), F.sum("n").alias("n")).filter("n > 1"))
    crowded = cut(joined.join(groups.select("root", "first"), "root").select("fp", "first"))
    verdict = cut(rows.join(crowded, "fp").select("id", "hash", (key != F.col("first")).alias("goes")).distinct())

    place = lambda i, h: F.pmod(F.xxhash64(i, h), F.lit(MAP_BITS))
    at = place(F.col("id"), F.col("hash"))
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = verdict.select(at.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def marked(places: pd.Series) -> pd.Series:
        p = places.to_numpy()
        return pd.Series((shared.value[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    keyed = numbered.withColumns({"id": F.col(i).cast("long"), "hash": F.xxhash64(t)})
    keyed = keyed.withColumn("maybe", marked(place(F.col("id"), F.col("hash"))))
    doubtful = keyed.filter("maybe").alias("d").join(verdict.alias("v"), F.expr("d.id <=> v.id and d.hash = v.hash"), "left")
    doubtful = doubtful.filter(~F.coalesce("v.goes", F.lit(False))).select("d.*").dropDuplicates(["id", "hash"])
    return keyed.filter("not maybe").unionByName(doubtful).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
