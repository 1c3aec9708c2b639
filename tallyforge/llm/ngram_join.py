"""N-gram Jaccard self-join by vertical partitioning, and the groups that its links form.

The global order of all n-grams is cut into fragments.  A task that holds a fragment counts in how many texts each
of its n-grams occurs; a pair's overlap is counted fragment by fragment and summed.  Texts with the same set of
n-grams are one class; only texts whose n-grams are mostly shared can have a partner, and candidates share an
n-gram among the rarest of both (the prefix filter), which is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tallyforge.llm.components import components
from tallyforge.llm.shared import named, numbered, table, with_id, written
from tallyforge.llm.shingles import batch_shingles, mix, slices

#: Texts link when LINK[1] * overlap >= LINK[0] * union.
LINK = (3, 4)
#: Text in a slice and in a fragment of the n-gram order, up to INPUT_BYTES of text in all. A slice gives a row to
#: each fragment, so beyond that both grow with the root of the input, to 110 MB at 100 TB.
SLICE_BYTES, FRAGMENT_BYTES, INPUT_BYTES = 4 << 20, 4 << 20, 1 << 37
#: Bits of an n-gram's number that count: two n-grams are mistaken for one another with a chance of 2**-48.
BITS = 48
#: Fragments in which the overlap of a pair is counted.
PAIR_FRAGMENTS = 4
#: Rounds in which each text is compared to one leader per rare n-gram before the remaining pairs are tested.
LEADER_ROUNDS = 2
#: Texts in a block of the remaining pairs' test, and n-grams whose overlaps it counts at a time.
BLOCK_TEXTS = 192
BLOCK_GRAMS = 4096
#: Parts of one shuffle, at most; a part holds several fragments beyond that.
SHUFFLE_PARTS = 1 << 15


def _pack(numbers: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _owners(of: np.ndarray) -> tuple[bytes, bytes]:
    """Rising 16-bit owners as runs, or as they are where runs would be longer; the second part is empty then."""
    cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    if len(cut) * 2 > len(of):
        return of.astype("<u2").tobytes(), b""
    return of[cut].astype("<u2").tobytes(), np.diff(np.append(cut, len(of))).astype("<u4").tobytes()


def _owners_back(a: bytes, b: bytes) -> np.ndarray:
    of = np.frombuffer(a, dtype="<u2").astype(np.int64)
    return np.repeat(of, np.frombuffer(b, dtype="<u4")) if b else of


def _short_slices(texts: pa.Array, slice_bytes: int):
    for a, b in slices(texts, slice_bytes):
        for i in range(a, b, 1 << 16):
            yield i, min(b, i + (1 << 16))


def _cut(parts: int, slice_bytes: int):
    """Texts to rows by fragment, and one row with each slice's set sizes, set numbers and ids (fragment < 0)."""

    def run(batches):
        task, serial = TaskContext.get().partitionId(), 0
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            for a, b in _short_slices(batch.column(1), slice_bytes):
                me = (task << 24) + serial
                serial += 1
                numbers, doc = batch_shingles(batch.column(1).slice(a, b - a))
                size = np.bincount(doc, minlength=b - a)
                with np.errstate(over="ignore"):
                    sums = np.concatenate(([0], np.cumsum(mix(numbers ^ np.uint64(0x5851F42D4C957F2D))))).astype(np.uint64)
                    stops = np.cumsum(size)
                    sets = sums[stops] - sums[stops - size]
                rows = [(-1 - me, me, size.astype("<i8").tobytes(), b"", sets.astype("<u8").tobytes())]
                fragment = ((numbers >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint32)
                order = np.argsort(fragment, kind="stable")
                grams, of = numbers[order] >> np.uint64(64 - BITS), doc[order]
                edges = np.flatnonzero(np.diff(fragment[order], prepend=np.uint32(parts), append=np.uint32(parts)))
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    rows.append((int(fragment[order[i]]), me, *_owners(of[i:j]), _pack(grams[i:j])))
                ids = batch.column(0).slice(a, b - a)
                owned = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(rows), pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), owned], ["fragment", "slice", "a", "b", "grams", "ids"])

    return run


def _count(data: pa.Table) -> pa.Table:
    """A fragment's n-grams that occur in two texts or more, by slice, with the log of how many they occur in."""
    names, kinds = ["slice", "a", "b", "grams", "df", "ids"], (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    if data.column("fragment")[0].as_py() < 0:
        return pa.table([*(data.column(n) for n in names[:4]), pa.nulls(data.num_rows, pa.binary()), data.column("ids")], names)
    grams = [_unpack(x) for x in data.column("grams").to_pylist()]
    of = [_owners_back(a, b) for a, b in zip(data.column("a").to_pylist(), data.column("b").to_pylist())]
    where = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
    grams, of = np.concatenate(grams), np.concatenate(of).astype(np.uint16)
    order = np.argsort(grams)
    ordered = grams[order]
    cut = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    times = np.diff(np.append(cut, len(ordered)))
    df = np.zeros(len(grams), dtype=np.uint8)
    df[order] = np.repeat(np.minimum(np.ceil(np.log2(times) * 8), 255).astype(np.uint8), times)  # 0 only for once
    kept = df > 0
    grams, of, where, df = grams[kept], of[kept], where[kept], df[kept]
    names_of = data.column("slice").to_pylist()
    edges = np.searchsorted(where, np.arange(len(names_of) + 1))
    rows = [(names_of[r], *_owners(of[i:j]), _pack(grams[i:j]), df[i:j].tobytes()) for r, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if i < j]
    return pa.table([*(pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 5, kinds)), pa.nulls(len(rows), data.schema.field("ids").type)], names)


SETS = "row long, n long, number long, alone long, grams binary"


def _assemble(data: pa.Table) -> pa.Table:
    """A slice's texts: set size and number and, if enough n-grams are shared to have a partner, those, rarest first."""
    head, grams, of, df = None, [], [], []
    for a, b, g, d in zip(*(data.column(n).to_pylist() for n in ("a", "b", "grams", "df"))):
        if d is None:
            head = np.frombuffer(a, "<i8"), np.frombuffer(g, "<u8")
        else:
            grams.append(_unpack(g))
            of.append(_owners_back(a, b))
            df.append(np.frombuffer(d, np.uint8))
    size, sets = head
    ids = data.column("ids").combine_chunks().flatten()  # only the slice's first row has any
    rows = (data.column("slice")[0].as_py() << 16) + np.arange(len(size))
    if grams:
        grams, of, df = np.concatenate(grams), np.concatenate(of), np.concatenate(df)
        order = np.lexsort((grams, df, of))
        grams, of = grams[order], of[order]
    edges = np.searchsorted(of, np.arange(len(size) + 1)) if len(of) else np.zeros(len(size) + 1, dtype=np.int64)
    shared = np.diff(edges)
    can = (size > 0) & (shared * LINK[1] >= size * LINK[0])
    blobs = [_pack(grams[edges[i] : edges[i + 1]]) if ok else None for i, ok in enumerate(can.tolist())]
    return pa.table([ids, pa.array(rows), pa.array(size), pa.array(sets.view(np.int64)), pa.array(size - shared), pa.array(blobs, pa.binary())], ["id", "row", "n", "number", "alone", "grams"])


def gram_sets(docs: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """``id, row, n, number, alone, grams``: see ``_assemble``; ``row`` is a number of each row's own, ``alone``
    counts n-grams of no other text.  ``parts`` is the number of fragments; by default the size of all texts tells it."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    grown = max(1.0, size / INPUT_BYTES) ** 0.5
    parts = parts or max(1, math.ceil(size / (FRAGMENT_BYTES * grown)))
    dealt = min(parts, SHUFFLE_PARTS)
    ids = StructField("ids", ArrayType(docs.schema[id_col].dataType))
    cut = rows.mapInArrow(_cut(parts, int(SLICE_BYTES * grown)), StructType.fromDDL("fragment long, slice long, a binary, b binary, grams binary").add(ids))
    counted = cut.repartition(dealt, "fragment").groupBy("fragment").applyInArrow(_count, StructType.fromDDL("slice long, a binary, b binary, grams binary, df binary").add(ids))
    return counted.repartition(dealt, "slice").groupBy("slice").applyInArrow(_assemble, with_id(docs, id_col, SETS))


def _needed(n: np.ndarray) -> np.ndarray:
    """The overlap that a text of n n-grams needs with any partner."""
    return -(-n * LINK[0] // LINK[1])


def _prefixes(batches):
    """The n-grams by which a text can find partners, with the size of the largest partner that it can have.

    A link of sizes n and m needs an overlap of 3/7 (n + m), and no overlap is above the n-grams that a text shares.
    """
    for batch in batches:
        ids, n, alone = (np.asarray(batch.column(i)) for i in range(3))
        grams = [_unpack(x)[: max(0, int(k))] for x, k in zip(batch.column(3).to_pylist(), n - _needed(n) + 1 - alone)]
        size = [len(g) for g in grams]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)]).astype(np.uint64)
        most = (n - alone) * (LINK[0] + LINK[1]) // LINK[0] - n
        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *(pa.array(np.repeat(x, size)) for x in (ids, n, most))], ["gram", "id", "n", "most"])


def _pieces(batches):
    """Each set cut into fragments of the n-gram order, sorted within."""
    for batch in batches:
        rows = []
        for id_, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            grams = np.sort(_unpack(raw))
            edges = np.searchsorted(grams >> np.uint64(BITS - 16), np.arange(PAIR_FRAGMENTS + 1) * (1 << 16) // PAIR_FRAGMENTS)
            rows += [(id_, f, n, _pack(grams[i:j])) for f, (i, j) in enumerate(zip(edges[:-1], edges[1:]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["id", "f", "n", "grams"])


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def _linked(overlap: Column, a: Column, b: Column) -> Column:
    return overlap * LINK[1] >= (a + b - overlap) * LINK[0]


def _can_link(n_a: Column, most_a: Column, n_b: Column, most_b: Column) -> Column:
    """Whether sizes and shared n-grams of two texts leave room for a link."""
    return (n_a <= most_b) & (n_b <= most_a)


def true_links(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The ``a, b`` of ``pairs`` that link: overlaps counted in each fragment by itself, then summed per pair."""
    overlap = F.pandas_udf(_overlap, "long")
    a = pieces.select(F.col("id").alias("a"), "f", F.col("n").alias("na"), F.col("grams").alias("ga"))
    b = pieces.select(F.col("id").alias("b"), "f", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    each = pairs.join(a, "a").join(b, ["b", "f"]).select("a", "b", "na", "nb", overlap("ga", "gb").alias("o"))
    return each.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o")).where(_linked(F.col("o"), F.col("na"), F.col("nb"))).select("a", "b")


PAIR = ["field", "band", "i", "band2", "j"]
PAIR_DDL = "field long, band int, i long, band2 int, j long"


def _sides(data: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the rows of the two blocks of a pair, each by id, and whether the pair is one block with itself."""
    side, ids = np.asarray(data.column("side")), np.asarray(data.column("id"))
    order = np.argsort(ids, kind="stable")
    first, second = order[side[order] == 0], order[side[order] == 1]
    same = data.column("band")[0].as_py() == data.column("band2")[0].as_py() and data.column("i")[0].as_py() == data.column("j")[0].as_py()
    return first, (first if same else second), same


def _hopeful(data: pa.Table) -> pa.Table:
    """The rows of a pair of blocks that can link with some row of the other block in another component."""
    a, b, _ = _sides(data)
    n, most, comp = (np.asarray(data.column(c)) for c in ("n", "most", "comp"))
    can = (n[a][:, None] <= most[b][None, :]) & (n[b][None, :] <= most[a][:, None]) & (comp[a][:, None] != comp[b][None, :])
    kept = np.unique(np.concatenate((a[can.any(axis=1)], b[can.any(axis=0)])))
    return data.take(pa.array(kept)).select([*PAIR, "side", "id", "n", "comp"])


def _partial(data: pa.Table) -> pa.Table:
    """The overlaps of all pairs of two blocks within one fragment of the n-gram order, as one row."""
    a, b, _ = _sides(data)
    grams = data.column("grams").to_pylist()
    overlap = np.zeros((len(a), len(b)), dtype=np.float32)
    left, right = ([_unpack(grams[k]) for k in x] for x in (a, b))
    kinds = np.intersect1d(np.concatenate([*left, np.zeros(0, np.uint64)]), np.concatenate([*right, np.zeros(0, np.uint64)]))

    def marks(sets):
        row = np.repeat(np.arange(len(sets)), [len(g) for g in sets])
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        at = np.searchsorted(kinds, flat)
        held = at < len(kinds)
        held[held] = kinds[at[held]] == flat[held]
        row, at = row[held], at[held]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (row_a, at_a), (row_b, at_b) = marks(left), marks(right)
    for begin in range(0, len(kinds), BLOCK_GRAMS):
        parts = []
        for row, at, size in ((row_a, at_a, len(a)), (row_b, at_b, len(b))):
            i, j = np.searchsorted(at, (begin, begin + BLOCK_GRAMS))
            part = np.zeros((size, BLOCK_GRAMS), dtype=np.float32)
            part[row[i:j], at[i:j] - begin] = 1
            parts.append(part)
        overlap += parts[0] @ parts[1].T
    n, comp = np.asarray(data.column("n")).astype("<i8"), np.asarray(data.column("comp")).astype("<i8")
    blobs = [n[a].tobytes(), comp[a].tobytes(), n[b].tobytes(), comp[b].tobytes(), overlap.astype("<i4").tobytes()]
    return pa.table([*(data.column(c).slice(0, 1) for c in PAIR), *(pa.array([x], pa.binary()) for x in blobs)], [*PAIR, "na", "ca", "nb", "cb", "overlap"])


def _sum_blocks(data: pa.Table) -> pa.Table:
    """Links between components, from a pair of blocks' overlaps summed over the fragments: enough to join what is linked."""
    na, ca, nb, cb = (np.frombuffer(data.column(c)[0].as_py(), "<i8") for c in ("na", "ca", "nb", "cb"))
    overlap = np.zeros((len(na), len(nb)), dtype=np.int64)
    for raw in data.column("overlap").to_pylist():
        overlap += np.frombuffer(raw, "<i4").reshape(overlap.shape)
    link = overlap * LINK[1] >= (na[:, None] + nb[None, :] - overlap) * LINK[0]
    link &= ca[:, None] != cb[None, :]
    x, y = np.nonzero(link)
    out, root = [], {}

    def end(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    for p, q in np.unique(np.stack((np.minimum(ca[x], cb[y]), np.maximum(ca[x], cb[y]))), axis=1).T.tolist():
        p, q = end(p), end(q)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((p, q))
    a, b = zip(*out) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (``id, comp``) after joining the components that ``edges`` between them connect."""
    found = components(edges).select(F.col("id").alias("comp"), "component")
    return written(labels.join(found, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component``, the smallest id that links lead to.

    Sets are the distinct 5-word shingles of the whole text (see ``shingles``); two texts link when their Jaccard
    similarity is 0.75 or more.  Null, empty and blank texts have no shingle and no link.  Rows are told apart by
    numbers of their own, so rows that repeat an id take part each; rows without an id do too, and a group of
    such rows only has the component null.  Ids keep their type; other columns are not read.  An empty table gives
    an empty result.

    1. Shingles go to ``parts`` fragments of their order as packed blocks, are counted there, and those that occur
       twice or more come back; texts with too few of them to have a partner are done.
    2. Equal sets become one class. Each class puts its rarest shared shingles into buckets.
    3. In each bucket all are compared to one leader, in a few rounds; links join components.
    4. What buckets still hold in different components is tested against each other in blocks, in full.
       Components, not pairs, leave a block, so no group's pairs are ever written out.
    """
    sets = written(gram_sets(docs, id_col, text_col, parts))
    name = F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("id"))
    classes = written(sets.where("n > 0").groupBy("number", "n").agg(F.min("row").alias("rep"), F.min(name).alias("name")))
    able = written(sets.where("grams IS NOT NULL").join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "n", "alone", "grams"))
    pieces = written(able.select("id", "n", "grams").mapInArrow(_pieces, "id long, f int, n long, grams binary"))
    rare = written(able.mapInArrow(_prefixes, "gram long, id long, n long, most long"))
    labels = able.select("id", F.col("id").alias("comp"))
    for turn in range(LEADER_ROUNDS):
        lead = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "most", "comp")
        now = rare.join(labels, "id")
        leaders = now.groupBy("gram").agg(F.min(lead).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram", "lead")
        meet = now.join(leaders, "gram").where((F.col("comp") != F.col("lead.comp")) & _can_link(F.col("n"), F.col("most"), F.col("lead.n"), F.col("lead.most")))
        pairs = meet.select(F.col("id").alias("a"), F.col("lead.id").alias("b")).distinct()
        links = written(true_links(pairs, pieces))
        a, b = labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        labels = _merge(labels, links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    labels = _merge(labels, _rest(rare, pieces, labels)).withColumnRenamed("id", "rep")
    leading = labels.join(classes.select("rep", "name"), "rep").groupBy("comp").agg(F.min("name").alias("lead"))
    known = classes.join(labels.join(leading, "comp").select("rep", "lead"), "rep", "left").select("number", "n", F.coalesce("lead.id", "name.id").alias("component"))
    own = sets.select("id", "number", "n").join(known, ["number", "n"], "left")
    return own.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def _rest(rare: DataFrame, pieces: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between components from testing all that still meet in a bucket, block against block.

    Texts that meet, directly or through others, form a field; a field's texts go by size into bands a third apart,
    since no link reaches further than the next band, and a band is cut into blocks.  Each pair of blocks of one
    or of neighbouring bands is a group of its own, so a field that holds a large part of all texts is spread over
    many tasks.  Ids and sizes are dealt first; sets follow only for texts whose size and shared n-grams leave
    room for a link with some text of the other block, and only their overlaps per fragment come back to be summed.
    """
    now = rare.join(labels, "id")
    buckets = now.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("first"), F.min("n").alias("least"), F.max("most").alias("largest"))
    buckets = buckets.where("lo <> hi").select("gram", "first", "least", "largest")
    live = written(now.join(buckets, "gram").where("least <= most AND n <= largest").select("id", "n", "most", "comp", "first").distinct())
    fields = components(live.select(F.col("id").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "field")
    band = F.floor(F.log("n") / math.log(LINK[1] / LINK[0])).cast("int")
    members = live.select("id", "n", "most", "comp").distinct().join(fields, "id", "left")
    members = written(members.select("id", "n", "most", "comp", F.coalesce("field", "id").alias("field"), band.alias("band")))
    sizes = written(members.groupBy("field", "band").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("long").alias("blocks")))
    members = members.join(sizes, ["field", "band"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    facts = ["id", "n", "most", "comp"]
    other = lambda step: sizes.select("field", (F.col("band") + step).alias("band"), "blocks")
    inside = members.withColumn("other", numbers)
    low = F.col("mine") <= F.col("other")
    inside = inside.select("field", "band", F.least("mine", "other").alias("i"), F.col("band").alias("band2"), F.greatest("mine", "other").alias("j"), F.when(low, 0).otherwise(1).alias("side"), *facts)
    upper = members.drop("blocks").join(other(-1), ["field", "band"]).withColumn("j", numbers).select("field", "band", F.col("mine").alias("i"), (F.col("band") + 1).alias("band2"), "j", F.lit(0).alias("side"), *facts)
    lower = members.drop("blocks").join(other(1), ["field", "band"]).withColumn("i", numbers).select("field", (F.col("band") - 1).alias("band"), "i", F.col("band").alias("band2"), F.col("mine").alias("j"), F.lit(1).alias("side"), *facts)
    dealt = inside.unionByName(upper).unionByName(lower)
    hopeful = written(dealt.groupBy(*PAIR).applyInArrow(_hopeful, f"{PAIR_DDL}, side int, id long, n long, comp long"))
    sets = hopeful.join(pieces.select("id", "f", "grams"), "id")
    counted = sets.groupBy(*PAIR, "f").applyInArrow(_partial, f"{PAIR_DDL}, na binary, ca binary, nb binary, cb binary, overlap binary")
    return counted.groupBy(*PAIR).applyInArrow(_sum_blocks, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """``docs`` with one row of each group of similar texts, all columns: the smallest id's, missing ids last, then
    the first stored (``stored`` as in ``numbered``).  Rows are told apart by numbers of their own, so rows without an id and rows that repeat one
    take part each; texts without words are no group and stay.  The list of rows that go is stored first: where it
    is small it is sent to the texts, which then do not move."""
    rows, row = numbered(docs, stored)
    found = similar_groups(rows.select(named(id_col, row).alias("name"), F.col(text_col).alias("text")), "name", "text")
    gone = written(found.where("id.row <> component.row").select(F.col("id.row").alias(row)))
    return rows.join(gone, row, "left_anti").select(*[rows[c] for c in docs.columns])


def op7_ngram_join(spark, sf_dir):
    found = similar_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


QUERIES = {"op7_ngram_join": op7_ngram_join}
ORACLES: dict[str, str] = {}
