"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints that differ in at most two of 64 bits agree on two of any four blocks of bits, so each goes to six
tables by two of its four blocks; what agrees there is a group.  A group's fingerprints are sorted by Gray rank, so
neighbours share most bits.  Runs of neighbours become nodes that hold the bits all of them share, less those that
the node above holds already; a search adds up differences on the way down and leaves a node with all below it as
soon as there are more than two.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import components
from tallyforge.llm.shared import table, with_id, written
from tallyforge.llm.shingles import _LOWER

SHINGLE, SEED, APART = 3, 42, 2
#: Bytes of a text that are cut into words at a time.
PART_BYTES = 1 << 20
#: A group with more fingerprints is cut again by two of the four blocks of its other bits; as fingerprints are
#: distinct, 2**16 of them can be in such a smaller group.
CROWD = 4096
FAN = 8
#: Fingerprints that search at a time.
AT_ONCE = 1 << 13

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _parts(raw: bytes):
    """A text in parts of about PART_BYTES that end at white space."""
    start = 0
    while len(raw) - start > PART_BYTES:
        gap = _GAP.search(raw, start + PART_BYTES)
        if gap is None:
            break
        yield raw[start : gap.start()]
        start = gap.end()
    yield raw[start:] if start else raw


def fingerprint(raw: bytes | None) -> int:
    """The fingerprint of one text in UTF-8."""
    from xxhash import xxh64_intdigest

    count, n, before = np.zeros(64, dtype=np.int64), 0, []
    for part in _parts((raw or b"").translate(bytes(_LOWER))):
        words = before + part.split()
        hashes = [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:]))]
        before = words[-2:]
        if hashes:
            bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.int64)
            n += len(hashes)
    if not n:
        return xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, code``: each row's fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            codes = [fingerprint(x) for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(codes, dtype=np.uint64).view(np.int64))], ["id", "code"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, with_id(docs, id_col, "code long"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the order in which neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks() -> list[tuple[int, list[int]]]:
    """For each table the bits that count, and those of the smaller tables that a crowded group is cut into."""
    blocks = [0xFFFF << (16 * b) for b in range(4)]
    out = []
    for a, b in combinations(range(4), 2):
        free = [c for c in range(4) if c not in (a, b)]
        eighths = [0xFF << (16 * c + 8 * half) for c in free for half in (0, 1)]
        own = blocks[a] | blocks[b]
        out.append((own, [own | x | y for x, y in combinations(eighths, 2)]))
    return out


class GrayIndex:
    """The nodes over many groups of codes: codes sorted by group and Gray rank, runs of FAN become a node of the next level."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), group))
        self.codes, self.group = codes[order], group[order]
        place = np.arange(len(codes))
        shared = np.full(len(codes), np.uint64(2**64 - 1))
        self.levels = [(self.codes, shared, place, place + 1, place)]  # pattern, shared bits, first child, end of children, last code
        of = self.group
        while len(of) > len(np.unique(of)):
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            at = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
            cut = np.flatnonzero(at % FAN == 0)
            pattern, shared, _, _, last = self.levels[-1]
            ones, noughts = np.bitwise_and.reduceat(pattern & shared, cut), np.bitwise_and.reduceat(~pattern & shared, cut)
            end = np.append(cut[1:], len(of))
            self.levels.append((ones, ones | noughts, cut, end, last[end - 1]))
            of = of[cut]
        self.roots = np.searchsorted(of, self.group)

    def links(self):
        """``(i, j)``, places of codes of a group, i < j, that differ in at most APART bits, some at a time."""
        for begin in range(0, len(self.codes), AT_ONCE):
            seek = np.arange(begin, min(begin + AT_ONCE, len(self.codes)))
            node = self.roots[seek]
            pattern, shared, first, end, last = self.levels[-1]
            apart = np.bitwise_count((self.codes[seek] ^ pattern[node]) & shared[node]).astype(np.int64)
            for below in reversed(self.levels[:-1]):
                n = end[node] - first[node]
                child = np.repeat(first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                seek, apart, above = np.repeat(seek, n), np.repeat(apart, n), np.repeat(shared[node], n)
                pattern, shared, first, end, last = below
                apart = apart + np.bitwise_count((self.codes[seek] ^ pattern[child]) & shared[child] & ~above)
                kept = (apart <= APART) & (last[child] > seek)
                seek, node, apart = seek[kept], child[kept], apart[kept]
            yield seek, node

    def tied(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of codes that join what links join, fewer than there are codes."""
        root = np.arange(len(self.codes))
        for i, j in self.links():
            while len(i):
                a, b = root[i], root[j]
                apart = a != b
                if not apart.any():
                    break
                low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
                i, j = i[apart], j[apart]
        moved = np.flatnonzero(root != np.arange(len(root)))
        return self.codes[moved], self.codes[root[moved]]


def _search(batches):
    """Links within groups; rows come sorted by group, of which the last of a batch goes on with the next batch."""

    def found(kind, key, codes):
        if not len(codes):
            return None
        fresh = np.concatenate(([True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(fresh) - 1
        many = np.bincount(group)[group] > 1
        a, b = GrayIndex(group[many], codes[many]).tied() if many.any() else (codes[:0], codes[:0])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in batches:
        now = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)).view(np.uint64)]
        held = [np.concatenate(x) for x in zip(held, now)]
        kind, key, _ = held
        if not len(kind):
            continue
        last = int(np.argmax((kind == kind[-1]) & (key == key[-1])))
        if last:
            yield found(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if len(held[0]):
        yield found(*held)


def near_codes(codes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, b``: links between the distinct ``code`` s, enough of them to join all that links of at most APART bits join.

    Groups of more than ``crowd`` codes are cut again by more bits, so none ever holds more than 2**16.
    """
    masks = _masks()
    code = F.col("code")
    tables = [F.struct(F.lit(i).alias("kind"), code.bitwiseAND(F.lit(_signed(m))).alias("key")) for i, (m, _) in enumerate(masks)]
    dealt = codes.select("code", F.inline(F.array(*tables)))
    crowded = dealt.groupBy("kind", "key").count().where(F.col("count") > crowd).select("kind", "key", F.lit(True).alias("crowded"))
    dealt = dealt.join(crowded, ["kind", "key"], "left")
    smaller = F.lit(None)
    for i, (_, own) in enumerate(masks):
        cut = [F.struct(F.lit(len(masks) * (1 + i) + j).alias("kind"), code.bitwiseAND(F.lit(_signed(m))).alias("key")) for j, m in enumerate(own)]
        smaller = F.when(F.col("kind") == i, F.array(*cut)).otherwise(smaller)
    groups = F.when(F.col("crowded"), smaller).otherwise(F.array(F.struct("kind", "key")))
    dealt = dealt.select("code", F.inline(groups)).select("kind", "key", "code")
    return dealt.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(_search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: ``id, code, component``, the smallest id that links lead to.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased; a text of fewer than
    three words has its whole sequence as its only shingle.  Null, empty and blank texts have the fingerprint zero and
    link like any other.  Repeated rows take part each.  Rows without an id do too; a group of such rows only has the
    component null.  Ids keep their type, other columns are not read, long texts are read in parts.  An empty table
    gives an empty result.
    """
    seen = written(fingerprints(docs, id_col, text_col))
    name = F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("id"))
    classes = written(seen.groupBy("code").agg(F.min(name).alias("name")))
    labels = components(near_codes(classes.select("code"), crowd)).withColumnRenamed("id", "code")
    leading = labels.join(classes, "code").groupBy("component").agg(F.min("name").alias("lead"))
    led = labels.join(leading, "component").select("code", "lead")
    known = classes.join(led, "code", "left").select("code", F.coalesce("lead", "name")["id"].alias("component"))
    return seen.join(known, "code").select("id", "code", "component")


def op13_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op13_simhash": op13_simhash}
ORACLES: dict[str, str] = {}
