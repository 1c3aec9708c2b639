"""Alignment of two tokenizers: which tokens of the one overlap which of the other, and how often in the whole corpus.

Texts are cut where no token of either tokenizer can reach across, and each distinct stretch is aligned once per task.
A task keeps, for each pair of token ids, compressed bitmaps of the documents of its slice: one of the documents that
hold the pair, and one plane per binary digit of how often each holds it beyond the first time.  Bitmaps of one slice
are OR-merged as they come in; counts of set bits, summed over slices, give documents and links of a pair.  The
bitmaps are the postings by which a pair's score goes back to the documents that hold it.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.llm.shared import table, with_id, written
from tallyforge.llm.shingles import slices

#: Text and documents in a slice, and text and stretches that are aligned at a time.
SLICE_BYTES, SLICE_DOCS = 16 << 20, 1 << 16
CHUNK_BYTES, CHUNK_STRETCHES = 1 << 20, 1 << 17
#: Stretches that a task remembers; beyond it forgets all and goes on.
REMEMBERED = 1 << 19
BLANK = "▁"
#: A blank between two signs that are no white space: tokens of neither side reach across the place before it.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: The plane of the documents that hold a pair; the others are numbered by the digit of what is beyond once.
HELD = -1

COUNTS = ("n_a", "n_b", "n_groups", "n_links")

def _byte_signs() -> dict[str, int]:
    """The sign by which byte-level vocabularies write each byte: itself where it can be printed, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the aligned stretches that a task remembers."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        signs = _byte_signs()
        self.bytes_a = {i: bytes(signs[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in signs for c in t)}
        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("models that change characters before segmenting are not supported")
        self.bytes_b = [bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        self.bytes_a = [self.bytes_a.get(i, b"") for i in range(max(self.bytes_a) + 1)]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.said = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.width = len(self.bytes_b)
        self.cut = CUT if not any(re.search(f"[^{BLANK}]{BLANK}", p.piece) for p in model.pieces if p.type != p.BYTE) else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.fine, self.counts = bytearray(), array("q")
        self.pairs, self.ends = array("q"), array("q", [0])

    def stretches(self, text: str):
        """Lists of stretches of a text that isn't empty, each list with about CHUNK_BYTES characters at most."""
        whole = " " + text
        if self.cut is None:
            yield [whole]
            return
        start = 0
        while len(whole) - start > CHUNK_BYTES:
            at = self.cut.search(whole, start + CHUNK_BYTES)
            if at is None:
                break
            yield self.cut.split(whole[start : at.start()])
            start = at.start()
        yield self.cut.split(whole[start:] if start else whole)

    def codes(self, stretches: list[str]) -> np.ndarray:
        """The place of each stretch among those known; new ones are aligned."""
        fresh = [s for s in dict.fromkeys(stretches) if s not in self.known]
        for begin in range(0, len(fresh), 8192):
            some = fresh[begin : begin + 8192]
            a = [e.ids for e in self.a.encode_batch(some, add_special_tokens=False)]
            self._align(some, a, self.b.encode([s[1:] for s in some], num_threads=1))
        return np.fromiter(map(self.known.__getitem__, stretches), dtype=np.int64, count=len(stretches))

    def _spelt(self, raws: list[bytes], ids: list[list[int]], flat: list[int], spell: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether each stretch is what its tokens' bytes spell."""
        if b"".join(map(spell.__getitem__, flat)) == b"".join(raws):
            places = np.concatenate(([0], np.cumsum(size[np.array(flat, dtype=np.int64)])))
            stops = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            if (places[stops] == np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))).all():
                return np.ones(len(raws), dtype=bool)
        return np.array([b"".join([spell[x] for x in own]) == raw for raw, own in zip(raws, ids)])

    def _align(self, stretches: list[str], left: list[list[int]], right: list[list[int]]) -> None:
        """Aligns many stretches at a time: their tokens' ends are places in one line of bytes, which all stretches share as cuts."""
        raws, flat = [s.encode() for s in stretches], [list(chain.from_iterable(t)) for t in (left, right)]
        fine = self._spelt(raws, left, flat[0], self.bytes_a, self.size_a) & self._spelt(raws, right, flat[1], self.bytes_b, self.size_b)
        if not fine.all():
            left, right = ([x if ok else [] for x, ok in zip(t, fine)] for t in (left, right))
            flat = [list(chain.from_iterable(t)) for t in (left, right)]
        n_a, n_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (left, right))
        a, b = (np.array(t, dtype=np.int64) for t in flat)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        first = np.searchsorted(end_b, end_a - self.size_a[a], side="right")
        last = np.searchsorted(end_b, end_a, side="left")
        each = last - first + 1  # the tokens of B that a token of A overlaps
        at = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
        pairs = np.repeat(a, each) * self.width + b[at]
        of_a, of_b = np.repeat(np.arange(len(fine)), n_a), np.repeat(np.arange(len(fine)), n_b)
        closes_a, closes_b = end_b[last] == end_a if len(a) else fine[:0], np.isin(end_b, end_a, assume_unique=True)
        n_groups, n_links = np.bincount(of_a, closes_a, len(fine)).astype(np.int64), np.bincount(of_a, each, len(fine)).astype(np.int64)
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        final = np.zeros(len(a) + len(b), dtype=bool)
        final[len(a) + np.cumsum(n_b)[n_b > 0] - 1] = True
        order = np.argsort(np.concatenate((group_a * 2, group_b * 2 + 1)), kind="stable")
        mark = np.where(final, 3, np.where(np.concatenate((closes_a, closes_b)), np.concatenate((np.ones(len(a), int), np.full(len(b), 2))), 0))[order]
        said = self.said
        parts = [said[x] + ",|; "[m] for x, m in zip(np.concatenate((a, b))[order].tolist(), mark.tolist())]
        stops = np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(parts[i:j])[:-1] for i, j in zip([0, *stops], stops)]
        self.known.update(zip(stretches, range(len(self.known), len(self.known) + len(stretches))))
        self.fine.extend(fine.astype(np.uint8).tobytes())
        self.counts.frombytes(np.stack((n_a, n_b, n_groups, n_links), axis=1).astype(np.int64).tobytes())
        self.pairs.frombytes(pairs.astype(np.int64).tobytes())
        self.ends.frombytes((len(self.pairs) - n_links.sum() + np.cumsum(n_links)).astype(np.int64).tobytes())


@functools.cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Slice:
    """Documents of one slice, numbered from 0, with their counts and the pairs that they hold."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.ids, self.bytes = aligner, [], 0
        self.counts, self.digests, self.odd = [], [], set()
        self.keys, self.times, self.waiting = [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        first = sum(map(len, self.ids))
        self.ids.append(ids)
        self.counts.append(np.zeros((len(ids), len(COUNTS)), dtype=np.int64))
        self.digests += [hashlib.sha256() for _ in range(len(ids))]
        self.begun = [False] * len(ids)
        self.first, stretches, owners = first, [], []
        for i, text in enumerate(texts.to_pylist()):
            if text:
                for some in self.aligner.stretches(text):
                    stretches += some
                    owners.append((i, len(some)))
                    if len(stretches) > CHUNK_STRETCHES:
                        self._count(stretches, owners)
                        stretches, owners = [], []
        if stretches:
            self._count(stretches, owners)

    def _count(self, stretches: list[str], owners: list[tuple[int, int]]) -> None:
        al = self.aligner
        codes = al.codes(stretches)
        doc = np.repeat([i for i, _ in owners], [n for _, n in owners]).astype(np.int64)
        self.odd.update((np.unique(doc[np.frombuffer(bytes(al.fine), np.uint8)[codes] == 0]) + self.first).tolist())
        np.add.at(self.counts[-1], doc, np.array(al.counts).reshape(-1, len(COUNTS))[codes])
        at, said = 0, codes.tolist()
        for i, n in owners:
            groups = ";".join([al.groups[c] for c in said[at : at + n]])
            self.digests[self.first + i].update((";" + groups if self.begun[i] else groups).encode())
            self.begun[i], at = True, at + n
        held, often = np.unique(doc * len(al.groups) + codes, return_counts=True)
        doc, codes = np.divmod(held, len(al.groups))
        ends = np.array(al.ends)
        n = ends[codes + 1] - ends[codes]
        at = np.repeat(ends[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())
        self._merge((np.array(al.pairs)[at] << 16) | np.repeat(doc + self.first, n), np.repeat(often, n))
        if len(al.known) > REMEMBERED:
            al.forget()

    def _merge(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.keys.append(keys)
        self.times.append(times)
        self.waiting += len(keys)
        if self.waiting > 1 << 22:
            self._settle()

    def _settle(self) -> None:
        """All (pair, document) keys so far, each once."""
        keys, times = np.concatenate([*self.keys, np.zeros(0, np.int64)]), np.concatenate([*self.times, np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.times, self.waiting = [keys[fresh]], [np.add.reduceat(times, fresh) if len(fresh) else times], 0

    def heads(self) -> list[pa.Array]:
        counts = np.concatenate(self.counts)
        odd = sorted(self.odd)
        counts[odd] = 0
        digests = [d.hexdigest() if n else "" for d, n in zip(self.digests, counts[:, 2].tolist())]
        return [pa.concat_arrays(self.ids), pa.array(np.arange(len(counts), dtype=np.int32)), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(digests)]

    def planes(self):
        """``(plane, pairs, sizes, containers, dense)``: bitmaps of each plane, sparse ones as rising 16-bit numbers."""
        self._settle()
        keys, times = self.keys[0], self.times[0]
        if self.odd:
            fine = ~np.isin(keys & 0xFFFF, sorted(self.odd))
            keys, times = keys[fine], times[fine]
        if not len(keys):
            return
        beyond = times - 1
        for plane in range(HELD, int(beyond.max()).bit_length()):
            own = keys if plane == HELD else keys[(beyond >> plane) & 1 == 1]
            if not len(own):
                continue
            pairs, docs = own >> 16, (own & 0xFFFF).astype("<u2")
            cut = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            size = np.diff(np.append(cut, len(own)))
            dense = size * 16 > len(self.digests)
            sparse = np.repeat(~dense, size)
            if not dense.all():
                ends = np.concatenate(([0], np.cumsum(size[~dense]) * 2)).astype(np.int32)
                yield plane, pairs[cut[~dense]], size[~dense], pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(docs[sparse].tobytes())]), False
            if dense.any():
                maps = []
                for begin, n in zip(cut[dense].tolist(), size[dense].tolist()):
                    bits = np.zeros(len(self.digests), dtype=bool)
                    bits[docs[begin : begin + n]] = True
                    maps.append(np.packbits(bits).tobytes())
                yield plane, pairs[cut[dense]], size[dense], pa.array(maps, pa.binary()), True


def _encode(path_a: str, path_b: str, slice_bytes: int, names: list[str]):
    def run(batches):
        task, serial, now = TaskContext.get().partitionId(), 0, None
        aligner = _aligner(path_a, path_b)

        def out(done: Slice, me: int):
            heads = done.heads()
            n = len(heads[0])
            gone = lambda kind, n: pa.nulls(n, kind)
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, me)), *heads, *(gone(k, n) for k in kinds)], names)
            for plane, pairs, size, maps, dense in done.planes():
                n = len(pairs)
                mine = [pa.array(np.full(n, plane, np.int32)), pa.array(pairs), pa.array(size.astype(np.int32)), pa.array(np.full(n, dense)), maps]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, me)), *(gone(h.type, n) for h in heads), *mine], names)

        for batch in batches:
            for a, b in slices(batch.column(1), CHUNK_BYTES):
                for i in range(a, b, 1 << 12):
                    part = slice(i, min(b, i + (1 << 12)))
                    texts = batch.column(1)[part]
                    if now is None:
                        now = Slice(aligner)
                    now.add(batch.column(0)[part], texts)
                    now.bytes += texts.nbytes
                    if now.bytes >= slice_bytes or len(now.digests) > SLICE_DOCS - (1 << 12):
                        yield from out(now, (task << 24) + serial)
                        now, serial = None, serial + 1
        if now is not None:
            yield from out(now, (task << 24) + serial)

    return run


def pair_postings(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Two kinds of rows: documents (``pair`` null) and bitmaps (``at`` null).

    Documents: ``slice, at`` (place in the slice), ``id``, COUNTS and ``groups_sha256``.  Bitmaps: ``slice, plane, pair,
    n`` (set bits), ``dense`` and ``bits``; a pair is A's id times B's number of pieces plus B's id.
    """
    ddl = "slice long, at int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, plane int, pair long, n int, dense boolean, bits binary"
    fields = with_id(docs, id_col, ddl)
    fields = StructType([fields["slice"], fields["id"], *fields.fields[2:]])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(path_a, path_b, slice_bytes, fields.names), fields)


def pair_scores(postings: DataFrame, width: int) -> DataFrame:
    """``pair, docs, links, best``: documents and links of each pair in all slices, and whether no pair of its B id has more links.

    ``width`` is the number of B's pieces; an id of B has at most as many rows as A has tokens.
    """
    weight = F.when(F.col("plane") == HELD, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, greatest(plane, 0))"))
    held = F.when(F.col("plane") == HELD, F.col("n"))
    pairs = postings.groupBy("pair").agg(F.coalesce(F.sum(held), F.lit(0)).alias("docs"), F.sum(F.col("n") * weight).alias("links"))
    most = F.max("links").over(Window.partitionBy(F.col("pair") % width))
    return pairs.withColumn("best", F.col("links") == most)


def _return(data: pa.Table) -> pa.Table:
    """Scores of the pairs of a slice, added up for each of its documents by their bitmaps."""
    plane, links, best, n, dense = (np.asarray(data.column(c)) for c in ("plane", "links", "best", "n", "dense"))
    times = np.left_shift(np.int64(1), np.maximum(plane, 0))
    bits = data.column("bits").to_pylist()
    total = {}
    sparse = np.flatnonzero(~dense)
    docs = [np.frombuffer(b"".join([bits[i] for i in sparse.tolist()]), "<u2").astype(np.int64)]
    row = [np.repeat(sparse, n[sparse])]
    for i in np.flatnonzero(dense).tolist():
        docs.append(np.flatnonzero(np.unpackbits(np.frombuffer(bits[i], np.uint8))))
        row.append(np.full(len(docs[-1]), i))
    docs, row = np.concatenate(docs), np.concatenate(row)
    for name, each in (("n_best", times * best), ("count_sum", times * links)):
        total[name] = np.zeros(1 << 16, dtype=np.int64)
        np.add.at(total[name], docs, each[row])
    at = np.flatnonzero(total["count_sum"])
    return pa.table([pa.array(np.full(len(at), data.column("slice")[0].as_py())), pa.array(at.astype(np.int32)), *(pa.array(total[c][at]) for c in ("n_best", "count_sum"))], ["slice", "at", "n_best", "count_sum"])


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id``, tokens of A and of B, groups, links, links whose pair no other pair of its B
    id exceeds, the sum of the links' counts, and the digest of the groups.

    A reads a blank and the text, B the text, to which it adds the blank; special strings are plain text for both.
    Null and empty texts, and those that either side does not give back byte by byte, have zeros and an empty digest,
    and take no part in counts.  Repeated rows count each.  Ids keep their type and may be missing; other columns are
    not read.  Long texts are aligned in parts.  An empty table gives an empty result.
    """
    stored = written(pair_postings(docs, path_a, path_b, id_col, text_col, slice_bytes))
    postings = stored.where("pair IS NOT NULL").select("slice", "plane", "pair", "n", "dense", "bits")
    scored = postings.join(pair_scores(postings, _aligner(path_a, path_b).width).select("pair", "links", "best"), "pair")
    back = scored.groupBy("slice").applyInArrow(_return, "slice long, at int, n_best long, count_sum long")
    heads = stored.where("pair IS NULL").select("slice", "at", "id", *COUNTS, "groups_sha256")
    sums = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return heads.join(back, ["slice", "at"], "left").select("id", *COUNTS, *sums, "groups_sha256")


def op11_alignment(spark, sf_dir):
    import public_tokenizers

    found = aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {"op11_alignment": op11_alignment}
ORACLES: dict[str, str] = {}
