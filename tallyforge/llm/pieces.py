"""SentencePiece encoding and decoding with N-best segmentations.

Forward Viterbi scores of the piece lattice are exact heuristics for a backward A* search: the n-th complete
path taken from its queue is the n-th best segmentation.
"""

from __future__ import annotations

import functools
import heapq
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.pretokens import _BASE, _letters
from tallyforge.llm.shared import table, with_id
from tallyforge.llm.shingles import _power_table, mix, slices, stretch_numbers

BLANK = "▁"
N_BEST = 3
UNKNOWN_PENALTY = 10.0
CHUNK_BYTES = 2 << 20
#: Segments up to this length are searched many at a time, longer ones one by one.
TOGETHER = 40
AT_ONCE = 4096
NORMAL, USER, BYTE = 1, 4, 6
NONE = -(1 << 30)
SLOTS = 1 << 19
#: Stretches that a task remembers; beyond it forgets all and goes on.
REMEMBERED = 1 << 18


def _number(codes: np.ndarray) -> np.ndarray:
    """Numbers of equally long rows of code points."""
    with np.errstate(over="ignore"):
        return mix((_letters()[codes] * _power_table(_BASE, codes.shape[1])[: codes.shape[1]]).sum(axis=1, dtype=np.uint64))


@dataclass(frozen=True)
class PieceTable:
    """A model's pieces: ids and scores by text, and what the search needs of them as arrays."""

    texts: tuple[str, ...]
    known: dict
    byte_ids: tuple[int, ...]
    high: frozenset  # ids of bytes that are no character by themselves
    unknown: float
    prefix: bool
    longest: int
    slots: np.ndarray  # the pieces' numbers, each at its last bits' place or soon after, 0 where free
    ids: np.ndarray  # the ids and scores of the same pieces
    scores: np.ndarray
    char: np.ndarray  # code point -> its row in joined, 0 for characters of no longer piece
    joined: np.ndarray  # which characters stand side by side in some piece


@functools.cache
def piece_table(path: str) -> PieceTable:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    known = {p.piece: (i, float(p.score)) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
    by_byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == BYTE}
    byte_ids = tuple(by_byte.get(f"<0x{b:02X}>", -1) for b in range(256))
    numbers, ids, scores = [], [], []
    for size in {len(t) for t in known}:
        same = [t for t in known if len(t) == size]
        numbers.append(_number(np.array([[ord(c) for c in t] for t in same], dtype=np.uint32)))
        ids += [known[t][0] for t in same]
        scores += [known[t][1] for t in same]
    numbers = np.concatenate(numbers)
    slots, slot_ids, slot_scores = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32), np.full(SLOTS, -np.inf)
    for number, id_, score in zip(numbers.tolist(), ids, scores):
        at = number % SLOTS
        while slots[at]:
            at = (at + 1) % SLOTS
        slots[at], slot_ids[at], slot_scores[at] = number, id_, score
    chars = sorted({c for t in known if len(t) > 1 for c in t})
    row = {c: i + 1 for i, c in enumerate(chars)}
    char = np.zeros(0x110000, dtype=np.int32)
    char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    joined = np.zeros((len(chars) + 1,) * 2, dtype=bool)
    for t in known:
        for a, b in zip(t, t[1:]):
            joined[row[a], row[b]] = True
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
        raise ValueError("models that change characters before segmenting are not supported")
    texts = [p.piece for p in model.pieces]
    for b, i in enumerate(byte_ids[:128]):
        texts[i] = chr(b) if i >= 0 else ""
    return PieceTable(tuple(texts), known, byte_ids, frozenset(byte_ids[128:]), min(s for _, s in known.values()) - UNKNOWN_PENALTY, spec.add_dummy_prefix, max(map(len, known)), slots, slot_ids, slot_scores, char, joined)


def _arcs(t: PieceTable, codes: np.ndarray):
    """For l = 1, 2, ...: ids and scores of the pieces of l characters that end at each place of each row."""
    m, n = codes.shape
    with np.errstate(over="ignore"):
        power, inverse = _power_table(_BASE, n + 1), _power_table(pow(_BASE, -1, 2**64), n + 1)
        sums = np.zeros((m, n + 1), dtype=np.uint64)
        np.cumsum(_letters()[codes] * power[:n], axis=1, out=sums[:, 1:])
        ids, scores = [], []
        for size in range(1, min(t.longest, n) + 1):
            number = mix((sums[:, size:] - sums[:, :-size]) * inverse[: n + 1 - size])
            at = (number & np.uint64(SLOTS - 1)).astype(np.int64)
            there = t.slots[at]
            found = there == number
            taken = np.nonzero((there != 0) & ~found)
            while len(taken[0]):
                at[taken] = (at[taken] + 1) % SLOTS
                there = t.slots[at[taken]]
                found[taken] = there == number[taken]
                taken = tuple(x[(there != 0) & ~found[taken]] for x in taken)
            id_, score = np.full((m, n + 1), -1, dtype=np.int32), np.full((m, n + 1), -np.inf)
            id_[:, size:], score[:, size:] = np.where(found, t.ids[at], -1), np.where(found, t.scores[at], t.unknown if size == 1 else -np.inf)
            ids.append(id_)
            scores.append(score)
    return np.stack(ids), np.stack(scores)


def _search_together(t: PieceTable, codes: np.ndarray, n_best: int):
    """``(scores, ids)`` of equally long rows: scores is rows x n_best (-inf where there are fewer paths), ids is
    rows x n_best x length: each path's pieces from the left, then NONE; ~c stands for a character c that is no piece."""
    m, n = codes.shape
    piece, arc = _arcs(t, codes)
    width = len(arc)
    best = np.full((m, n + 1), -np.inf)
    best[:, 0] = 0
    for j in range(1, n + 1):
        best[:, j] = np.max([best[:, j - size] + arc[size - 1][:, j] for size in range(1, min(width, j) + 1)], axis=0)
    # A place is opened at most n_best times: its k-th opening is its k-th best path to the end, and no segmentation
    # of the n best needs a worse one. That bounds what is ever held, however many paths are equally good.
    cap = 1 + n_best * (n + 1) * width
    opened = np.zeros((m, n + 1), dtype=np.int64)
    hope = np.full((m, cap), -np.inf)
    place, gone, parent, used = (np.empty((m, cap), dtype=kind) for kind in (np.int16, np.float64, np.int32, np.int16))
    gone[:, 0] = 0
    hope[:, 0], place[:, 0] = best[:, n], n
    held = np.ones(m, dtype=np.int64)
    found = np.zeros(m, dtype=np.int64)
    scores = np.full((m, n_best), -np.inf)
    goal = np.zeros((m, n_best), dtype=np.int64)
    active = np.arange(m)
    while len(active):
        upto = held[active].max()
        top = upto - 1 - hope[active, :upto][:, ::-1].argmax(axis=1)  # of equal ones the last found, which lies further left
        live = hope[active, top] > -np.inf
        active, top = active[live], top[live]
        hope[active, top] = -np.inf
        at, g = place[active, top].astype(np.int64), gone[active, top]
        done = at == 0
        rows = active[done]
        scores[rows, found[rows]] = g[done]
        goal[rows, found[rows]] = top[done]
        found[rows] += 1
        more = ~done & (opened[active, at] < n_best)
        rows, tops, at, g = active[more], top[more], at[more], g[more]
        opened[rows, at] += 1
        for size in range(1, width + 1):
            can = at >= size
            step = np.full(len(rows), -np.inf)
            step[can] = arc[size - 1][rows[can], at[can]]
            ok = step > -np.inf
            ok[ok] = opened[rows[ok], at[ok] - size] < n_best
            r = rows[ok]
            c = held[r]
            to, cost = at[ok] - size, g[ok] + step[ok]
            place[r, c], gone[r, c], parent[r, c], used[r, c] = to, cost, tops[ok], size
            hope[r, c] = cost + best[r, to]
            held[r] += 1
        active = active[found[active] < n_best]
    ids = np.full((m * n_best, n), NONE, dtype=np.int32)
    here, paths, at = goal.ravel(), np.arange(m * n_best), np.zeros(m * n_best, dtype=np.int64)
    for i in range(n):
        going = here > 0
        paths, here, at = paths[going], here[going], at[going]
        if not len(paths):
            break
        rows = paths // n_best
        size = used[rows, here].astype(np.int64)
        id_ = piece[size - 1, rows, at + size]
        ids[paths, i] = np.where(id_ >= 0, id_, ~codes[rows, at].astype(np.int32))
        here, at = parent[rows, here], at + size
    return scores, ids.reshape(m, n_best, n)


def search_one(t: PieceTable, text: str, n_best: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of one string as ``(score, piece lengths from the left)``.

    Of equally promising paths the one that is nearer to the left end goes first, and each place is opened at most
    ``n_best`` times, so the search takes at most ``n_best`` steps a character, however many paths are equally good.
    """
    n = len(text)

    def arcs(j: int):
        """Lengths and scores of the pieces that end at place j; looked up again rather than held for a long text."""
        for size in range(1, min(t.longest, j) + 1):
            piece = t.known.get(text[j - size : j])
            if piece:
                yield size, piece[1]
            elif size == 1:
                yield size, t.unknown

    best = array("d", bytes(8 * (n + 1)))
    for j in range(1, n + 1):
        best[j] = max(best[j - size] + score for size, score in arcs(j))
    queue: list = [(-best[n], n, 0, 0.0, None)]
    opened = [0] * (n + 1)
    out, serial = [], 0
    while queue and len(out) < n_best:
        _, at, _, g, path = heapq.heappop(queue)
        if at and opened[at] == n_best:
            continue
        opened[at] += 1
        if at == 0:
            lengths = []
            while path:
                lengths.append(path[0])
                path = path[1]
            out.append((g, lengths))
            continue
        for size, score in arcs(at):
            if opened[at - size] < n_best:
                serial += 1
                heapq.heappush(queue, (-(g + score + best[at - size]), at - size, serial, g + score, (size, path)))
    return out


def _ids(t: PieceTable, text: str, lengths) -> list[int]:
    """Piece ids of a segmentation; a character that is no piece gives the ids of its bytes."""
    out, at = [], 0
    for size in lengths:
        part = text[at : at + size]
        at += size
        piece = t.known.get(part)
        out += [piece[0]] if piece else [t.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
    return out


def decode(t: PieceTable, ids) -> str:
    """The text of piece ids; bytes that form no character become the replacement character."""
    if t.high.isdisjoint(ids):
        text = "".join(map(t.texts.__getitem__, ids)).replace(BLANK, " ")
        return text[1:] if t.prefix and text.startswith(" ") else text
    out, raw = [], bytearray()
    first = {i: b for b, i in enumerate(t.byte_ids)}
    for i in ids:
        if i in first:
            raw.append(first[i])
            continue
        if raw:
            out.append(raw.decode(errors="replace"))
            raw.clear()
        out.append(t.texts[i])
    if raw:
        out.append(raw.decode(errors="replace"))
    text = "".join(out).replace(BLANK, " ")
    return text[1:] if t.prefix and text.startswith(" ") else text


def _segments(t: PieceTable, texts: list[str]):
    """``(numbers, doc, starts, ends, codes)`` of the stretches that no piece reaches across.

    Between two characters that stand side by side in no piece, every segmentation has a border, so a text's
    n best segmentations follow from those of its stretches.
    """
    marked = [(BLANK if t.prefix and x else "") + x.replace(" ", BLANK) for x in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    stops = np.cumsum(np.fromiter(map(len, marked), dtype=np.int64, count=len(marked)))
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, codes
    char = t.char[codes]
    border = np.zeros(n, dtype=bool)
    border[0] = True
    border[1:] = ~t.joined[char[:-1], char[1:]]
    border[stops[stops < n]] = True
    starts = np.flatnonzero(border)
    ends = np.append(starts[1:], n)
    numbers = stretch_numbers(_letters()[codes], starts, ends, _BASE)
    return numbers, np.searchsorted(stops, starts, side="right"), starts, ends, codes


def _best_of_distinct(t: PieceTable, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_best: int):
    """``(scores, sizes, ids)`` of distinct stretches: scores is stretches x n_best; path k of stretch r has sizes[r * n_best + k]
    pieces, 0 where there is none; ids has those of all paths in a row."""
    count = len(starts)
    scores = np.full((count, n_best), -np.inf)
    found: dict[int, np.ndarray] = {}
    size = ends - starts
    parts, order = [], []
    for n in np.unique(size[size <= TOGETHER]).tolist():
        rows = np.flatnonzero(size == n)
        for a in range(0, len(rows), AT_ONCE):
            some = rows[a : a + AT_ONCE]
            scores[some], ids = _search_together(t, codes[starts[some][:, None] + np.arange(n)], n_best)
            ids, some = ids.reshape(-1, n), (some[:, None] * n_best + np.arange(n_best)).ravel()
            odd = ((ids < 0) & (ids != NONE)).any(axis=1)
            for i in np.flatnonzero(odd).tolist():
                found[int(some[i])] = np.array([x for j in ids[i].tolist() if j != NONE for x in ([j] if j >= 0 else [t.byte_ids[b] for b in chr(~j).encode("utf-8", "surrogatepass")])], dtype=np.int32)
            ids, some = ids[~odd], some[~odd]
            kept = ids != NONE
            order.append(np.repeat(some, kept.sum(axis=1)))
            parts.append(ids[kept])
    for r in np.flatnonzero(size > TOGETHER).tolist():
        text = codes[starts[r] : ends[r]].tobytes().decode("utf-32-le", "surrogatepass")
        for k, (score, lengths) in enumerate(search_one(t, text, n_best)):
            scores[r, k] = score
            found[r * n_best + k] = np.array(_ids(t, text, lengths), dtype=np.int32)
    for path, ids in found.items():
        order.append(np.full(len(ids), path))
        parts.append(ids)
    of, flat = np.concatenate([*order, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*parts, np.zeros(0, np.int32)])
    return scores, np.bincount(of, minlength=count * n_best), flat[np.argsort(of, kind="stable")].astype(np.int32)


class Memory:
    """Distinct stretches that were searched before, by number: scores and ids of the n best."""

    def __init__(self, t: PieceTable, n_best: int):
        self.t, self.n_best = t, n_best
        self.forget()

    def forget(self):
        self.numbers, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted numbers and their rows
        self.scores, self.sizes, self.flat = np.zeros((0, self.n_best)), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.offset = np.zeros(1, np.int64)

    def rows_of(self, numbers, starts, ends, codes) -> np.ndarray:
        """Where each of these distinct stretches is remembered; searches those that are not."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.numbers, numbers)
        held = at < len(self.numbers)
        held[held] = self.numbers[at[held]] == numbers[held]
        out = np.empty(len(numbers), dtype=np.int64)
        out[held] = self.rows[at[held]]
        new = ~held
        if new.any():
            scores, sizes, flat = _best_of_distinct(self.t, codes, starts[new], ends[new], self.n_best)
            out[new] = np.arange(len(scores)) + len(self.scores)
            numbers_all = np.concatenate((self.numbers, numbers[new]))
            rows = np.concatenate((self.rows, out[new]))
            order = np.argsort(numbers_all)
            self.numbers, self.rows = numbers_all[order], rows[order]
            self.scores, self.sizes, self.flat = np.concatenate((self.scores, scores)), np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))
            self.offset = np.concatenate(([0], np.cumsum(self.sizes)))
        return out

    def path(self, row: int, k: int) -> list[int]:
        """Ids of a remembered stretch's segmentation k, 0 the best."""
        at = row * self.n_best + k
        return self.flat[self.offset[at] : self.offset[at + 1]].tolist()


def _combine(losses: list[tuple[int, list[float]]], n_best: int) -> list[tuple[float, dict[int, int]]]:
    """The n smallest sums of one loss per stretch: ``(loss, {stretch: which alternative})``.

    Only the n - 1 stretches with the smallest first losses can take part in them.
    """
    sums: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    for where, own in heapq.nsmallest(max(n_best - 1, 0), losses, key=lambda x: (x[1][0], x[0])):
        more = [(s + loss, {**chosen, where: k + 1}) for s, chosen in sums for k, loss in enumerate(own)]
        sums = heapq.nsmallest(n_best, sums + more, key=lambda x: x[0])
    return sums


def segmentations(ids: list[int], edits: list) -> list[list[int]]:
    """The piece ids of all n best segmentations, best first, from the best one's and the others' edits."""
    out = [list(ids)]
    for edit in edits:
        changed = list(ids)
        for first, taken, new in sorted(edit, key=lambda e: e[0], reverse=True):
            changed[first : first + taken] = new
        out.append(changed)
    return out


def encode_texts(memory: Memory, texts: list[str | None], with_edits: bool = True):
    """For each text: ``(ids, scores, edits)``.

    ``ids`` is the best segmentation; ``scores`` are those of the n best, best first; ``edits`` says for each of
    the others which pieces it changes: ``(first piece, pieces taken out, ids put in)``.
    """
    t, n_best = memory.t, memory.n_best
    numbers, doc, starts, ends, codes = _segments(t, [x or "" for x in texts])
    which, kinds = pd.factorize(numbers)
    first = np.zeros(len(kinds), dtype=np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    rows = memory.rows_of(kinds, starts[first], ends[first], codes)[which]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in range(len(texts)):
        own = rows[cut[d] : cut[d + 1]]
        if not len(own):
            yield np.zeros(0, dtype=np.int32), [0.0], []
            continue
        n = memory.sizes[own * n_best]
        at = np.cumsum(n) - n
        ids = memory.flat[np.repeat(memory.offset[own * n_best] - at, n) + np.arange(n.sum())]
        total = float(memory.scores[own, 0].sum())
        others = []
        if n_best > 1:
            loss = memory.scores[own, 0] - memory.scores[own, 1]
            near = np.argpartition(loss, n_best - 2)[: n_best - 1] if len(own) >= n_best else np.arange(len(own))
            others = [(int(i), [float(memory.scores[own[i], 0] - s) for s in memory.scores[own[i], 1:] if s > -np.inf]) for i in np.sort(near) if loss[i] < np.inf]
        combos = _combine(others, n_best)
        edits = []
        for _, chosen in combos[1:] if with_edits else ():
            edit = [(int(at[i]), int(n[i]), memory.path(own[i], k)) for i, k in sorted(chosen.items())]
            edits.append(edit)
        yield ids, [total - s for s, _ in combos], edits


RESULT = "n_pieces int, scores array<double>, ids array<int>, edits array<array<struct<first:int,out:int,ids:array<int>>>>, exact boolean"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n_best: int = N_BEST, with_ids: bool = True, with_edits: bool = True) -> DataFrame:
    """One row per row of ``docs``: its best segmentation into the pieces of the model at ``path``, the scores of
    the ``n_best`` best (fewer where there are fewer), what the others change, and whether decoding the best ids
    gives the text back (U+2581 in a text comes back as a blank, as the model has it).

    The pieces' own scores are summed, whatever kind of model they come from; a character that is no piece costs
    the lowest score and ten more and becomes its bytes.  Blanks are marked and one is put before the text, as
    the model asks for.  Null and empty texts have no pieces and one segmentation of score 0; of equally good
    segmentations any may come first; repeated rows are encoded each; ids keep their type; other columns are not
    read.  Without ``with_ids`` ids are null, without ``with_edits`` edits.  Each task searches
    its distinct stretches once, as long as it remembers them; nothing is shuffled.
    """
    edit = pa.list_(pa.list_(pa.struct([("first", pa.int32()), ("out", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def encode_batches(batches):
        t = piece_table(path)
        memory = Memory(t, n_best)
        for batch in batches:
            for a, b in slices(batch.column(1), CHUNK_BYTES):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                rows = []
                for text, (ids, scores, edits) in zip(texts, encode_texts(memory, texts, with_edits)):
                    exact = decode(t, ids.tolist()) == (text or "").replace(BLANK, " ")
                    rows.append((len(ids), scores, ids if with_ids else None, [[{"first": f, "out": o, "ids": x} for f, o, x in e] for e in edits] if with_edits else None, exact))
                n, scores, ids, edits, exact = zip(*rows)
                arrays = [batch.column(0).slice(a, b - a), pa.array(n, pa.int32()), pa.array(scores, pa.list_(pa.float64())), pa.array(ids, pa.list_(pa.int32())), pa.array(edits, edit), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_pieces", "scores", "ids", "edits", "exact"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode_batches, with_id(docs, id_col, RESULT))


def op2_sentencepiece(spark, sf_dir):
    import public_tokenizers

    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_pieces", "scores", "ids", "edits", "exact")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLES: dict[str, str] = {}
