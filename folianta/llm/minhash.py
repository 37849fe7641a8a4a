"""Near-duplicates by b-bit MinHash over five-word shingles, confirmed on whole sets.

1. Each document's distinct shingles give ``BANDS * ROWS`` minima. Of each only the low ``BITS`` bits are kept, packed side by side into longs; a band's key hashes the whole
   minima of its rows. Documents with equal shingle sets form one class, and only classes go on.
2. Classes that share a band's key are candidates. Of a bucket, only pairs with its first member are made, however large it is. First is the member that meets the most others in all its buckets: among
   near copies, the text that the others were made from.
3. A candidate's similarity is estimated from the packed signatures by bit counts, corrected for low bits that agree by chance; pairs far below the threshold
   go. The others are confirmed on their whole sets; only the texts of these are fetched.
4. Where a bucket's other members are not all in one component by then, they are looked at again, together: those that can reach the threshold by their rarest shingles are paired (prefix and place filters,
   which lose no pair), however large a bucket is. So no link between members of a bucket is missed, and a bucket of copies never gets all its pairs.
   Pairs found this way need not share a bucket; they are confirmed like all others.

At similarity 0.75, no band of a pair agrees with a chance of 2.4e-8 (32 bands of 3); estimates below ``0.75 - 6`` standard deviations are dropped.

Shingles and sets are told apart by 64-bit hashes. What is written on the way lies in the shared folder as Parquet and goes as soon as it is used up.

Cases: a text without words, or null, has an empty set, its own component, and stays; fewer than five words make one shingle of the whole sequence; repeated rows share a class
(``kept`` holds for each row with the component's id, :func:`keep_first` keeps one row of each component, also where one doc_id has several texts); rows without a doc_id count as members of their class, link
others, and take their component's id; an empty table gives no rows; other columns are carried by :func:`keep_first`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .components import components, forest_roots
from .shared import Tables, small

WORDS, PERCENT = 5, 75
BANDS, ROWS, BITS = 32, 3, 4
N_MINIMA = BANDS * ROWS
#: Least estimate that is confirmed on whole sets.
ESTIMATE = PERCENT / 100 - 6 * 0.046
#: Packed low bits of a signature: so many longs of so many minima each.
LONGS, PER_LONG = N_MINIMA * BITS // 64, 64 // BITS
#: Places of the table in which shingles are counted for their order; a fixed size, whatever the input.
COUNTED = 1 << 18


def _odd(n: int, salt: int) -> np.ndarray:
    return tc.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


FACTORS, MASKS = _odd(N_MINIMA, 1), _odd(N_MINIMA, 2)


def shingles(data: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document of a part, in document order, and their documents."""
    low = tc.LOWER[data]
    starts, ends, doc = tc.words(low, offs)
    hashes = tc.span_hashes(low, starts, ends)
    h, whole = tc.grams(hashes, doc, k)
    at = np.flatnonzero(whole)
    h, of = h[at], doc[at]
    n_words = tc.per_doc(doc, len(offs) - 1)
    first = np.cumsum(n_words) - n_words
    for n in range(1, k):
        short = np.flatnonzero(n_words == n)
        if len(short):
            one = np.full(len(short), n, np.uint64)
            for i in range(n):
                one = tc.mix64(one * np.uint64(0x9E3779B97F4A7C15) + hashes[first[short] + i])
            h, of = np.concatenate([h, one]), np.concatenate([of, short])
    if not len(h):
        return h, of
    order = np.argsort(h ^ tc.mix64(of.astype(np.uint64) + np.uint64(1)))
    hs, ds = h[order], of[order]
    new = order[np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])]
    new = new[np.argsort(of[new], kind="stable")]
    return h[new], of[new]


def class_of(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each document's whole set, from all its shingles (in document order, n of each); 0 for an empty one."""
    out, has = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(has):
        at, m = (np.cumsum(n) - n)[has], tc.mix64(h)
        out[has] = tc.mix64(np.add.reduceat(m, at) ^ tc.mix64(np.bitwise_xor.reduceat(m, at) + n[has].astype(np.uint64)))
    return out


def _signed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_shingles and class of each text, and its band keys and packed low bits (0 for an empty set)."""
    sizes, classes, keys, packed = [], [], [], []
    for a, b, data, offs in tc.parts(column):
        h, of = shingles(data, offs)
        n = np.bincount(of, minlength=b - a)
        sizes.append(n)
        has = np.flatnonzero(n)
        out = class_of(h, n)
        sig_keys, sig_bits = np.zeros((b - a, BANDS), np.uint64), np.zeros((b - a, LONGS), np.uint64)
        if len(has):
            at = (np.cumsum(n) - n)[has]
            minima = np.empty((len(has), N_MINIMA), np.uint64)
            for k in range(N_MINIMA):
                minima[:, k] = np.minimum.reduceat((h ^ MASKS[k]) * FACTORS[k], at)
            minima = tc.mix64(minima)
            band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(has), BANDS)).copy()
            for r in range(ROWS):
                band = tc.mix64(band * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
            low = (minima & np.uint64(2**BITS - 1)).reshape(len(has), LONGS, PER_LONG)
            sig_keys[has] = band
            sig_bits[has] = np.bitwise_or.reduce(low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=2)
        classes.append(out)
        keys.append(sig_keys)
        packed.append(sig_bits)
    none = np.zeros(0, np.uint64)
    return np.concatenate([*sizes, none.astype(np.int64)]), np.concatenate([*classes, none]), np.concatenate([*keys, none.reshape(0, BANDS)]), np.concatenate([*packed, none.reshape(0, LONGS)])


def _lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists of longs."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel().view(np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (null for an empty set), bands, and the packed longs p0, p1, ... of each document."""
    id_type = docs.schema["doc_id"].dataType
    kind = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), *(T.StructField(p, T.LongType()) for p in PACKED)]
    )

    def sign(batches):
        for b in batches:
            n, cls, keys, packed = _signed(b.column(1))
            own = pa.array(cls.view(np.int64), pa.int64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), own, _lists(keys), *(pa.array(packed[:, i].view(np.int64)) for i in range(LONGS))], kind.names)

    return docs.select("doc_id", "text").mapInArrow(sign, kind)


PACKED = [f"p{i}" for i in range(LONGS)]


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity from the low bits of minima that agree; of different minima 1 in 2 ** BITS agree by chance."""
    ones = sum(1 << (BITS * i) for i in range(PER_LONG))
    ones = F.lit(ones if ones < 1 << 63 else ones - (1 << 64)).cast("long")
    differ = F.lit(0)
    for x, y in zip(a, b, strict=True):
        bits = x.bitwiseXOR(y)
        two = bits.bitwiseOR(F.shiftright(bits, 1))
        differ = differ + F.bit_count(two.bitwiseOR(F.shiftright(two, 2)).bitwiseAND(ones))
    chance = 0.5**BITS
    return (1 - differ / N_MINIMA - chance) / (1 - chance)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and whole shingle set of the classes in ``wanted`` (cls, doc_id; a class without a doc_id is found among the rows that have none)."""

    def build(batches):
        for b in batches:
            texts, cls = b.column(1), b.column(0)
            for a, _, data, offs in tc.parts(texts):
                h, of = shingles(data, offs)
                n = np.bincount(of, minlength=len(offs) - 1)
                own, ends = class_of(h, n).view(np.int64), np.cumsum(n)
                here = cls.slice(a, len(n))
                named = here.fill_null(0).to_numpy(zero_copy_only=False)
                some = np.flatnonzero((n > 0) & ((own == named) | here.is_null().to_numpy(zero_copy_only=False)))
                keep = np.repeat(np.isin(np.arange(len(n)), some), n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[some])]), pa.int32()), pa.array(h[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own[some]), lists], ["cls", "shingles"])

    kind = "cls long, shingles array<long>"
    named = docs.join(small(wanted.where("doc_id is not null")), "doc_id").select("cls", "text").mapInArrow(build, kind)
    loose = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("cls"), "text").mapInArrow(build, kind)
    return named.unionByName(loose.join(wanted.where("doc_id is null").select("cls"), "cls", "left_semi")).dropDuplicates(["cls"])


def _with(pairs: DataFrame, table: DataFrame, column: str, **names: str) -> DataFrame:
    """Joins columns of a table by class to one side of pairs, under new names."""
    return pairs.join(table.select(F.col("cls").alias(column), *(F.col(x).alias(y) for y, x in names.items())), column)


def _likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate doesn't rule them out, with the doc_id of each side's class."""
    both = _with(_with(pairs, signed, "b", doc_b="doc_id", **{f"b{p}": p for p in PACKED}), signed, "a", doc_a="doc_id", **{f"a{p}": p for p in PACKED})
    kept = both.where(estimate([F.col(f"a{p}") for p in PACKED], [F.col(f"b{p}") for p in PACKED]) >= ESTIMATE)
    return kept.select(*pairs.columns, "doc_a", "doc_b")


def _members(likely: DataFrame) -> DataFrame:
    """The distinct classes (cls, doc_id) of pairs."""
    return likely.select(F.col("a").alias("cls"), F.col("doc_a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("cls"), F.col("doc_b").alias("doc_id"))).distinct()


def _confirmed(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that reach the threshold on their whole sets."""
    both = F.size(F.array_intersect("sa", "sb"))
    return _with(_with(likely, sets, "b", sb="shingles"), sets, "a", sa="shingles").where(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).drop("sa", "sb", "doc_a", "doc_b")


def _buckets(signed: DataFrame) -> DataFrame:
    """(cls, weight, key): the members of each bucket of two classes or more; a class weighs as much as it meets members in all its buckets."""
    keyed = signed.select("cls", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = keyed.join(shared, "key").groupBy("cls").agg(F.sum("n").alias("weight"), F.collect_list("key").alias("keys"))
    return own.select("cls", "weight", F.explode("keys").alias("key"))


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame, Tables]:
    """(doc_id, n_shingles, cls) of each document, (cls, doc_id, root) of each class, and the tables that hold them."""
    tables = Tables(docs.sparkSession)
    keep, drop = tables.keep, tables.drop
    every = keep(signatures(docs))
    with_bands = keep(every.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), *(F.first(p).alias(p) for p in PACKED)))
    rows = keep(every.select("doc_id", "n_shingles", "cls"))
    signed = with_bands.drop("bands")
    weighed = keep(_buckets(with_bands))
    drop(every)
    top = weighed.groupBy("key").agg(F.max("weight").alias("top"), F.max_by("cls", F.struct("weight", "cls")).alias("first"))
    buckets = keep(weighed.join(top, "key").where("cls <> first").select("key", "cls", "first", "top"))
    drop(weighed)
    stars = buckets.groupBy(F.col("first").alias("a"), F.col("cls").alias("b")).agg(F.first("top").alias("weight"))
    likely = keep(_likely(stars, signed))
    sets = keep(_sets(docs.select("doc_id", "text"), keep(_members(likely))))
    edges = keep(_confirmed(likely, sets))
    roots = forest_roots(edges, tables)
    named = buckets.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    open_ = keep(named.join(mixed, "key", "left_semi").select("cls", "root").distinct())
    drop(buckets)
    missing = keep(open_.join(sets, "cls", "left_anti").join(signed.select("cls", "doc_id"), "cls").select("cls", "doc_id"))
    sets = sets.unionByName(keep(_sets(docs.select("doc_id", "text"), missing)))
    more = keep(_likely(_rare_pairs(open_, sets, tables), signed))
    new = _confirmed(more, sets).select("root_a", "root_b")
    second = components(new, "root_a", "root_b", tables)
    classes = signed.select("cls", "doc_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    classes = classes.join(second.select(F.col("node").alias("root"), F.col("root").alias("_last")), "root", "left").select("cls", "doc_id", F.coalesce("_last", "root").alias("root"))
    return rows, classes, tables


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall on each place of a table of fixed size."""
    counts = sets.select(F.explode("shingles").alias("x")).groupBy(F.pmod("x", F.lit(COUNTED)).alias("place")).count().toArrow()
    out = np.zeros(COUNTED, np.int64)
    out[counts.column("place").to_numpy()] = counts.column("count").to_numpy()
    return out


def _rare_pairs(members: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """Pairs of classes (a, b, root_a, root_b) of different components that may reach the threshold; none that does is left out.

    With each set's shingles in one order for all, two sets that reach it share one of the first ``n - ceil(1.5 n / 1.75) + 1`` of the smaller set and one of the first ``m - ceil(0.75 m) + 1`` of the larger
    one, and from the first that they share at places i and j they have at most ``1 + min(n - i, m - j)`` in common. Any order does; this one puts shingles that the table of :func:`_frequencies` has seldom
    first, so copies that have drifted too far from each other and documents that share a common passage meet in few pairs. Shingles are joined by component first, so members of one component never meet.
    """
    order = members.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def spread(batches):
        for b in batches:
            cls, root = b.column(0).to_numpy(), b.column(1).to_numpy()
            h, ends = b.column(2).flatten().to_numpy(), np.cumsum(b.column(2).value_lengths().to_numpy())
            n = np.diff(np.concatenate([[0], ends])) if len(ends) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(n)), n)
            by = np.lexsort((h, order.value[np.mod(h, COUNTED)], of))
            place = np.arange(len(h)) - np.repeat(ends - n, n) + 1
            size = n[of]
            keep = place <= size - (size * PERCENT + 99) // 100 + 1
            short = place <= size - (size * 2 * PERCENT + 99 + PERCENT) // (100 + PERCENT) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h[by], cls[of], root[of], size, place, short)], ["shingle", "cls", "root", "n", "place", "short"])

    rows = members.join(sets, "cls").select("cls", "root", "shingles").mapInArrow(spread, "shingle long, cls long, root long, n long, place long, short boolean")
    prefix = tables.keep(rows)
    order.unpersist()
    shared = prefix.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("shingle")
    some = tables.keep(prefix.join(shared, "shingle", "left_semi"))
    tables.drop(prefix)
    larger, smaller = ([F.col(c).alias(f"{c}_{s}") if c != "shingle" else F.col(c) for c in ("shingle", "cls", "root", "n", "place")] for s in "ba")
    large, less = some.select(*larger), some.where("short").select(*smaller)
    meet = large.select("shingle", "root_b").distinct().join(less.select("shingle", "root_a").distinct(), "shingle").where("root_a <> root_b")
    pairs = large.join(meet, ["shingle", "root_b"]).join(less, ["shingle", "root_a"])
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cls_a") < F.col("cls_b")))
    fits = once & (100 * F.col("n_a") >= PERCENT * F.col("n_b")) & ((100 + PERCENT) * most >= PERCENT * (F.col("n_a") + F.col("n_b")))
    return pairs.where(fits).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), "root_a", "root_b").distinct()


def _placed(docs: DataFrame) -> tuple[DataFrame, Tables]:
    """doc_id, n_shingles, cls, root and component_id of each document."""
    rows, classes, tables = link(docs)
    classes = tables.keep(classes)
    least = tables.keep(classes.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    named = classes.join(least, "root").select("cls", "root", "component_id")
    return rows.join(named, "cls", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")), tables


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    out, _ = _placed(docs)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, with all the input's columns. Rows without a doc_id have no place in a component and stay.

    Only the ids that go, or that come several times, meet the texts: rows of all other ids are not moved.
    """
    placed, tables = _placed(docs)
    marked = tables.keep(placed.where("doc_id is not null").select("doc_id", "cls", "root", (F.col("doc_id") == F.col("component_id")).alias("stays")))
    looked = tables.keep(marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("stays").alias("stays")).where("n > 1 or not stays"))
    out = docs.join(small(looked.select("doc_id")), "doc_id", "left_anti")
    again = looked.where("n > 1 and stays").select("doc_id")
    if not again.take(1):
        return out.select(*docs.columns)
    name = "_cls"
    while name in docs.columns:
        name += "_"
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def classed(batches):
        for b in batches:
            n, cls, _, _ = _signed(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cls.view(np.int64), pa.int64(), mask=n == 0)], names)

    some = docs.join(small(again), "doc_id", "left_semi").select(*docs.columns).mapInArrow(classed, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    firsts = marked.where("stays").join(small(again), "doc_id", "left_semi").groupBy("doc_id", "root").agg(F.min("cls").alias(name)).drop("root")
    firsts = firsts.select(F.col("doc_id").alias("_id"), F.col(name).alias("_own"))
    some = some.join(firsts, (F.col("doc_id") == F.col("_id")) & F.col(name).eqNullSafe(F.col("_own")), "left_semi").dropDuplicates(["doc_id", name])
    return out.select(*docs.columns).unionByName(some.select(*docs.columns))
