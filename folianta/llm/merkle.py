"""A Merkle manifest of a document table: roots, proofs and a check against tampering.

A leaf is the digest of a document's fields. In each language the leaves ascend by ``doc_id``; every eight neighbours become the digest of their hex texts, up to one digest, the language's
subroot; the subroots, ordered by language, give the root in the same way.

Work goes by aligned blocks of 8^4 = 4,096 nodes, one row each. In a task a block's digests are one contiguous numpy matrix of 64 bytes a row: it is reshaped to eight digests a row and
hashed level by level, and the siblings of all leaves on all levels are found by index arithmetic on these matrices. A block's top is a node of the floor above, whose blocks are built in
the same way, so a floor has 1/4,096 of the rows of the one below. On the way down each block gets the siblings above its top, one row a block; no row of a leaf is sent again.

Cases: null fields are ``-``, an empty text is ``0:``; rows with one ``doc_id`` are ordered by their leaves; a null ``doc_id`` comes first and isn't tampered with; a null language is a group
of its own, before the others; other columns of the input are left alone, whatever their names; an empty table gives no rows. ``doc_id`` may be of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import met, numbered
from .shared import Tables

FANOUT = 8
#: Levels of one block.
BLOCK_LEVELS = 4
SPAN = FANOUT**BLOCK_LEVELS
#: The fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column) -> Column:
    """The digest of a document with this text."""
    return F.sha2(F.concat(*(field(text if name == "text" else F.col(name)) for name in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and ``changed``: the leaf after tampering, where it is another one."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    own = docs.select(*FIELDS).select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(F.translate("text", UPPER, LOWER))).alias("other"))
    return own.select("doc_id", "lang", "leaf", F.when(F.col("other") != F.col("leaf"), F.col("other")).alias("changed"))


def repeated(column: pa.Array, i: int, n: int) -> pa.Array:
    """The i-th value n times."""
    return column.take(pa.array(np.full(n, i)))


def height(among: int) -> int:
    """Levels of a block in a row of so many nodes: all, or as many as lead to one node."""
    up = 0
    while up < BLOCK_LEVELS and FANOUT**up < among:
        up += 1
    return up


def hashed(rows: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """(n, 64): the hex digest of the first so many bytes of each row of a contiguous matrix."""
    hexes = "".join(sha256(row[:n]).hexdigest() for row, n in zip(rows, n_bytes.tolist(), strict=True))
    return np.frombuffer(hexes.encode(), np.uint8).reshape(-1, 64)


def matrices(digests: str, among: int) -> list[np.ndarray]:
    """The digests of a block's levels, lowest first, as contiguous (n, 64) matrices."""
    out = [np.frombuffer(digests.encode(), np.uint8).reshape(-1, 64)]
    for _ in range(height(among)):
        n = len(out[-1])
        wide = np.zeros((-(-n // FANOUT), FANOUT * 64), np.uint8)
        wide.reshape(-1, 64)[:n] = out[-1]
        out.append(hashed(wide, np.minimum(FANOUT, n - np.arange(len(wide)) * FANOUT) * 64))
    return out


def kin(mats: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level below a block's top: (n, 8) places of the run that holds each leaf's ancestor, which of them exist, and which of the eight is the ancestor."""
    at = np.arange(len(mats[0]))
    for m in mats[:-1]:
        run = at[:, None] // FANOUT * FANOUT + np.arange(FANOUT)
        yield np.minimum(run, len(m) - 1), run < len(m), at % FANOUT
        at = at // FANOUT


def paths(mats: list[np.ndarray]) -> list[list[tuple[str, str]]]:
    """For each node of the lowest level the digests left and right of its ancestor on each level of the block."""
    out: list[list[tuple[str, str]]] = [[] for _ in range(len(mats[0]))]
    for m, (run, there, own) in zip(mats, kin(mats), strict=False):
        flat = m.tobytes().decode()
        first, last = run[:, 0], run[:, 0] + there.sum(1)
        for path, a, x, b in zip(out, (first * 64).tolist(), ((first + own) * 64).tolist(), (last * 64).tolist(), strict=True):
            path.append((flat[a:x], flat[x + 64 : b]))
    return out


def siblings(mats: list[np.ndarray], above: bytes) -> list[bytes]:
    """For each leaf the hex digests of all its siblings in the block and of those above it, one after another, lowest level first."""
    bases = np.cumsum([0, *(len(m) for m in mats)])
    every = np.concatenate(mats)
    places, wanted = [], []
    for base, (run, there, own) in zip(bases, kin(mats), strict=False):
        places.append(run + base)
        wanted.append(there & (np.arange(FANOUT) != own[:, None]))
    if not places:
        return [above] * len(mats[0])
    place, want = np.concatenate(places, 1), np.concatenate(wanted, 1)
    flat = memoryview(np.ascontiguousarray(every[place[want]])).cast("B") if want.any() else b""
    ends = np.cumsum(want.sum(1)) * 64
    return [bytes(flat[a:b]) + above for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def folded(mats: list[np.ndarray], leaf_digests: np.ndarray, above: list[tuple[bytes, bytes]]) -> list[str]:
    """For each leaf the root that follows from the given digest in its place and from its siblings."""
    now, each = leaf_digests, np.arange(len(leaf_digests))
    for m, (run, there, own) in zip(mats, kin(mats), strict=False):
        wide = m[run]
        wide[each, own] = now
        now = hashed(np.ascontiguousarray(wide).reshape(len(each), -1), there.sum(1) * 64)
    tops = [bytes(row) for row in now]
    for left, right in above:
        tops = [sha256(left + top + right).hexdigest().encode() for top in tops]
    return [top.decode() for top in tops]


PATH = "array<struct<left:string,right:string>>"


def _packed(nodes: DataFrame, group: list[str]) -> DataFrame:
    """One row a block of at most 4,096 nodes: its digests one after another, ``ids`` and ``changed`` in the same order where there are any."""
    kept = [c for c in ("doc_id", "changed") if c in nodes.columns]
    one = F.array_sort(F.collect_list(F.struct("nth", "digest", *kept))).alias("n")
    rows = nodes.withColumn("block", F.expr(f"nth div {SPAN}")).groupBy(*group, "block").agg(one, F.first("among").alias("among"))
    return rows.select(*group, "block", "among", F.array_join("n.digest", "").alias("digests"), *(F.col(f"n.{c}").alias(c) for c in kept))


def _tops(blocks: DataFrame) -> DataFrame:
    """Adds ``top``, the digest to which a block comes."""
    schema = T.StructType([*blocks.schema.fields, T.StructField("top", T.StringType())])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [matrices(d, n)[-1].tobytes().decode() for d, n in zip(batch.column("digests").to_pylist(), batch.column("among").to_pylist(), strict=True)]
            yield batch.append_column("top", pa.array(tops, pa.string()))

    return blocks.mapInArrow(up, schema)


def climb(nodes: DataFrame, group: list[str], tables: Tables) -> tuple[list[DataFrame], DataFrame]:
    """The floors of blocks over the nodes (group, nth, among, digest), lowest first, and the last node of each group."""
    floors = []
    while True:
        blocks = tables.keep(_tops(_packed(nodes, group)))
        floors.append(blocks)
        nodes = blocks.select(*group, F.col("block").alias("nth"), F.ceil(F.col("among") / SPAN).alias("among"), F.col("top").alias("digest"))
        if nodes.where(F.col("among") > 1).isEmpty():
            return floors, nodes.select(*group, "digest")


def _under(blocks: DataFrame, above: DataFrame, group: list[str]) -> DataFrame:
    """Blocks with what is ``above`` (group, nth, ...) their tops."""
    return met(blocks, above, {c: c for c in group} | {"block": "nth"})


def descend(floors: list[DataFrame], above: DataFrame, group: list[str], tables: Tables) -> DataFrame:
    """(group, nth, path and other columns of ``above``) of the nodes under these floors; ``above`` has the paths of the last node of each group, as number 0."""
    for blocks in reversed(floors):
        under = _under(blocks, above, group)
        more = [c for c in above.columns if c not in (*group, "nth", "path")]
        schema = T.StructType([*(above.schema[c] for c in (*group, "nth", *more)), above.schema["path"]])

        def down(batches: Iterator[pa.RecordBatch], names=(*group, *more)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, row in enumerate(batch.select(["digests", "among", "block", "path"]).to_pylist()):
                    up = [(p["left"], p["right"]) for p in row["path"]]
                    found = [[{"left": a, "right": b} for a, b in own + up] for own in paths(matrices(row["digests"], row["among"]))]
                    n = len(found)
                    cols = {name: repeated(batch.column(name), i, n) for name in names}
                    cols["nth"] = pa.array(np.arange(n) + row["block"] * SPAN, pa.int64())
                    cols["path"] = pa.array(found, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
                    yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], [f.name for f in schema.fields])

        above = tables.keep(under.mapInArrow(down, schema))
    return above


def manifest(docs: DataFrame, with_siblings: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang: one row a document; with ``siblings``, the proof's digests, if wanted."""
    tables = Tables(docs.sparkSession)
    rows = tables.keep(leaves(docs).withColumn("row", F.monotonically_increasing_id()))
    nodes = numbered(rows, ["lang"], ["doc_id", "leaf", "row"], tables).withColumnRenamed("leaf", "digest")
    floors, subroots = climb(nodes, ["lang"], tables)
    subroots = tables.keep(subroots.withColumn("tree", F.lit(0)))
    over = numbered(subroots, ["tree"], ["lang"], tables)
    upper, roots = climb(over.select("tree", "nth", "among", "digest"), ["tree"], tables)
    whole = roots.select("tree", F.lit(0).cast("long").alias("nth"), F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = descend(upper, whole, ["tree"], tables)
    subs = met(over, tops, {"tree": "tree", "nth": "nth"}).select("lang", F.lit(0).cast("long").alias("nth"), F.col("digest").alias("subroot"), "root", "path")
    return _proved(_under(floors[0], descend(floors[1:], subs, ["lang"], tables), ["lang"]), with_siblings)


def _proved(blocks: DataFrame, with_siblings: bool) -> DataFrame:
    """The rows of the documents of the lowest blocks, which know what is above them."""
    kinds = {"doc_id": blocks.schema["doc_id"].dataType.elementType, "verified": T.BooleanType(), "lang": blocks.schema["lang"].dataType}
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lang", *(["siblings"] if with_siblings else []))
    kinds["siblings"] = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("digests", "among", "path", "root", "changed")}
                above = [(p["left"].encode(), p["right"].encode()) for p in row["path"]]
                mats = matrices(row["digests"], row["among"])
                n, now = len(mats[0]), mats[0].copy()
                for k, changed in enumerate(row["changed"]):
                    if changed is not None:
                        now[k] = np.frombuffer(changed.encode(), np.uint8)
                folds = folded(mats, now, above)
                ids = batch.column("doc_id")
                own = row["digests"]
                kept = siblings(mats, b"".join(a + b for a, b in above))
                apart = [[k[j : j + 64].decode() for j in range(0, len(k), 64)] for k in kept] if with_siblings else None
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, 1).flatten(),
                        pa.array([own[64 * k : 64 * k + 64] for k in range(n)], pa.string()),
                        repeated(batch.column("subroot"), i, n),
                        repeated(batch.column("root"), i, n),
                        pa.array([sha256(k).hexdigest() for k in kept], pa.string()),
                        pa.array(folds, pa.string()),
                        pa.array([f == row["root"] for f in folds], pa.bool_()),
                        repeated(batch.column("lang"), i, n),
                        *([pa.array(apart, pa.list_(pa.string()))] if with_siblings else []),
                    ],
                    list(names),
                )

    return blocks.mapInArrow(prove, schema)
