"""Phrases whose words occur together far more often than apart, counted in hashed tries.

A task reads texts as word ids and counts phrases in a trie that is shallow: a node per first word, below it a hash
table of all that follows, which bursts into a node of its own when it grows large.  When a task's trie is full, the
largest subtrees leave it whole as sorted runs, cut by a hash of each phrase's first words, and all tasks' runs of one
such prefix partition are merged.  A phrase can only be frequent where all words and word pairs in it are, so words,
pairs and longer phrases are counted in turn, each time within what the counts before leave; how they are told to the
tasks is a bitmap of bounded size that may let more through, never less.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import table, written
from tallyforge.llm.shingles import _LOWER, batch_words, mix, slices

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
CHUNK_BYTES = 4 << 20
#: Entries of a hash table before it bursts, and of a task's trie before its largest subtrees leave it.
BURST, ROOM = 4096, 1 << 20
#: Text in a prefix partition, up to INPUT_BYTES of text in all; beyond that it grows with the root of the input.
PART_BYTES, INPUT_BYTES = 8 << 20, 1 << 37
#: Bits of the bitmap of frequent words or pairs: 32 for each of them, and no more than these (64 MB).
MOST_BITS = 1 << 29
BUCKET = 1 << 15
#: Parts of one language's candidates that are ranked apart before the best of each are ranked together.
RANK_PARTS = 64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _words(texts: pa.Array, langs: list[str]):
    """``(numbers, together, doc, starts, ends, data)``: words by a number of their own in their language, and whether each is followed by a word of its piece."""
    from xxhash import xxh64_intdigest

    numbers, doc, starts, ends, data = batch_words(texts, _LOWER, _GAP)
    salt = np.array([xxh64_intdigest(x.encode()) for x in langs], dtype=np.uint64)
    numbers = np.maximum(mix(numbers ^ salt[doc]) if len(doc) else numbers, np.uint64(1))
    breaks = np.concatenate(([0], np.cumsum(_BREAK[data]))) if len(data) else np.zeros(1, np.int64)
    together = (doc[1:] == doc[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return numbers, together, doc, starts, ends, data


def _texts(batches):
    """Some texts at a time with their languages."""
    for batch in batches:
        langs = [UNKNOWN if x is None else x for x in batch.column(0).to_pylist()]
        for a, b in slices(batch.column(1), CHUNK_BYTES):
            yield batch.column(1).slice(a, b - a), langs[a:b]


def _count_words(batches):
    """Words with how often they occur; rows without a word count all words of a language."""
    names = ["number", "lang", "word", "f"]
    for texts, langs in _texts(batches):
        numbers, _, doc, starts, ends, data = _words(texts, langs)
        if not len(numbers):
            continue
        which, kinds = pd.factorize(numbers)
        first = np.zeros(len(kinds), dtype=np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        raw = data.tobytes()
        found = [raw[s:e].decode() for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        of = pa.array(langs).take(pa.array(doc[first]))
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), of, pa.array(found, pa.string()), pa.array(np.bincount(which))], names)
        at, some = pd.factorize(np.array(langs, dtype=object))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int64)), pa.array(list(some), pa.string()), pa.nulls(len(some), pa.string()), pa.array(np.bincount(at[doc], minlength=len(some)))], names)


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """``number, lang, word, f`` of words that occur ``least`` times, and a row with number 0 and no word for each language."""
    found = rows.mapInArrow(_count_words, "number long, lang string, word string, f long")
    return found.groupBy("number", "lang", "word").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("word").isNull())


def pair_number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def bitmap(numbers: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A bitmap, as bytes, of the last bits of the column ``number``; 64 MB at most, whatever there is to mark."""
    bits = min(most_bits, max(BUCKET, 1 << (32 * numbers.count()).bit_length()))
    place = F.col("number").bitwiseAND(F.lit(bits - 1))
    marked = numbers.groupBy(F.shiftright(place, 15).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(BUCKET - 1))).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in marked.toLocalIterator():  # buckets of 4 KB
        out[row["bucket"] * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _pair_numbers(batches):
    for batch in batches:
        words = np.asarray(batch.column(0).flatten()).view(np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pair_number(words[:, 0], words[:, 1]).view(np.int64))], ["number"])


def _marked(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    place = numbers & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


class HatTrie:
    """Counts of phrases of up to ``longest`` word numbers; shorter phrases end in zeros."""

    def __init__(self, longest: int, burst: int = BURST):
        self.longest, self.burst, self.size = longest, burst, 0
        self.root: dict = {}
        self.sizes: dict[int, int] = {}  # entries below each first word

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct phrases, sorted, one a row."""
        first = phrases[:, 0]
        cut = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        ends, words, counts = np.append(cut[1:], len(first)).tolist(), first[cut].tolist(), counts.tolist()
        keys = self._keys(phrases, 1)
        for word, i, j in zip(words, cut.tolist(), ends):
            self.sizes[word] = self.sizes.get(word, 0) + self._put(self.root, word, 1, phrases, keys, counts, i, j)

    def _keys(self, phrases: np.ndarray, depth: int) -> list:
        rest = np.ascontiguousarray(phrases[:, depth:])
        return rest.ravel().tolist() if rest.shape[1] == 1 else rest.view(f"V{rest.shape[1] * 8}").ravel().tolist()

    def _put(self, node: dict, word: int, depth: int, phrases, keys, counts, i: int, j: int) -> int:
        """Adds rows i to j, which all have ``word`` at ``depth - 1``, below ``node``; returns how many are new."""
        below = node.get(word)
        if isinstance(below, _Node):
            seconds = phrases[i:j, depth]
            cut = np.flatnonzero(np.concatenate(([True], seconds[1:] != seconds[:-1])))
            deeper = [None] * i + self._keys(phrases[i:j], depth + 1)
            return sum(self._put(below, w, depth + 1, phrases, deeper, counts, i + a, i + b) for w, a, b in zip(seconds[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), j - i]))
        if below is None:
            node[word] = dict(zip(keys[i:j], counts[i:j]))
            new = j - i
        else:
            before = len(below)
            get = below.get
            for k in range(i, j):
                below[keys[k]] = get(keys[k], 0) + counts[k]
            new = len(below) - before
        self.size += new
        if len(node[word]) > self.burst and depth < self.longest - 1:
            node[word] = self._split(node[word], depth)
        return new

    def _split(self, held: dict, depth: int) -> _Node:
        """A hash table of the words from ``depth`` on as a node with a table for each word there."""
        node = _Node()
        for key, n in held.items():
            rest = key[8:] if len(key) > 16 else int.from_bytes(key[8:], "little")
            node.setdefault(int.from_bytes(key[:8], "little"), {})[rest] = n
        return node

    def _rows(self, below: dict, head: tuple[int, ...], phrases: list, counts: list) -> None:
        if isinstance(below, _Node):
            for word, deeper in below.items():
                self._rows(deeper, (*head, word), phrases, counts)
            return
        rest = self.longest - len(head)
        keys = np.fromiter(below, np.uint64, len(below)) if rest == 1 else np.frombuffer(b"".join(below), np.uint64)
        block = np.empty((len(below), self.longest), dtype=np.uint64)
        block[:, : len(head)] = head
        block[:, len(head) :] = keys.reshape(-1, rest)
        phrases.append(block)
        counts.append(np.fromiter(below.values(), np.int64, len(below)))

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes out whole subtrees, the largest first, until at most ``keep`` entries are left; their phrases and counts."""
        phrases, counts = [np.zeros((0, self.longest), np.uint64)], [np.zeros(0, np.int64)]
        for word in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.size <= keep:
                break
            self._rows(self.root.pop(word), (word,), phrases, counts)
            self.size -= self.sizes.pop(word)
        return np.concatenate(phrases), np.concatenate(counts)


class _Node(dict):
    """Words to what follows them."""


def _in_order(phrases: np.ndarray, *first: np.ndarray) -> np.ndarray:
    return np.lexsort((*phrases.T[::-1], *first))


def _changes(phrases: np.ndarray) -> np.ndarray:
    """How many leading words each row shares with the row before, as the first column that differs; 0 for the first row."""
    differ = np.ones((len(phrases), phrases.shape[1] + 1), dtype=bool)
    differ[1:, :-1] = phrases[1:] != phrases[:-1]
    out = differ.argmax(axis=1)
    out[:1] = 0
    return out


def _runs(sent, parts: int, shortest: int, longest: int, room: int):
    """Sorted runs (``part, phrases, counts``) of the windows of ``shortest`` to ``longest`` words that ``sent`` bitmaps leave."""

    def cut(phrases: np.ndarray, counts: np.ndarray):
        head = np.zeros(len(phrases), dtype=np.uint64)
        for k in range(shortest):
            head = pair_number(head, phrases[:, k])
        part = ((head >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = _in_order(phrases, part)
        phrases, counts, part = phrases[order], counts[order], part[order]
        edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        blobs = [(phrases[i:j].tobytes(), counts[i:j].astype("<u4").tobytes()) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
        kinds = [pa.array(part[edge[:-1]].astype(np.int32)), *(pa.array([b[k] for b in blobs], pa.binary()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(kinds, ["part", "phrases", "counts"])

    def run(batches):
        words, pairs = sent.value
        trie = HatTrie(longest)
        for texts, langs in _texts(batches):
            numbers, together, *_ = _words(texts, langs)
            if len(numbers) < shortest:
                continue
            if pairs is None:
                fine = _marked(words, numbers)
                together &= fine[1:] & fine[:-1]
            else:
                together &= _marked(pairs, pair_number(numbers[:-1], numbers[1:]))
            reach, on = np.ones(len(numbers), dtype=np.int64), np.append(together, False)
            so_far = np.ones(len(numbers), dtype=bool)
            for k in range(1, longest):
                so_far = so_far & np.append(on[k - 1 :], np.zeros(k - 1, dtype=bool))
                reach += so_far
            at = np.flatnonzero(reach >= shortest)
            if not len(at):
                continue
            numbers = np.append(numbers, np.zeros(longest, np.uint64))
            phrases = numbers[at[:, None] + np.arange(longest)]
            phrases[np.arange(longest) >= reach[at, None]] = 0
            phrases = phrases[_in_order(phrases)]
            fresh = np.flatnonzero(_changes(phrases) < longest)
            trie.add(phrases[fresh], np.diff(np.append(fresh, len(phrases))))
            if trie.size > room:
                yield cut(*trie.spill(room // 2))
        if trie.size:
            yield cut(*trie.spill(0))

    return run


def _merged(shortest: int, longest: int, least: int):
    """Runs of one prefix partition to its phrases that occur ``least`` times: a window counts for each of its beginnings."""

    def run(data: pa.Table) -> pa.Table:
        phrases = np.frombuffer(b"".join(data.column("phrases").to_pylist()), np.uint64).reshape(-1, longest)
        counts = np.frombuffer(b"".join(data.column("counts").to_pylist()), "<u4").astype(np.int64)
        order = _in_order(phrases)
        phrases, counts = phrases[order], counts[order]
        changed = _changes(phrases)
        words, times = [], []
        for size in range(shortest, longest + 1):
            first = np.flatnonzero(changed < size)
            total = np.add.reduceat(counts, first)
            kept = (phrases[first, size - 1] != 0) & (total >= least)
            words += phrases[first[kept], :size].view(np.int64).tolist()
            times += total[kept].tolist()
        return pa.table([pa.array(words, pa.list_(pa.int64())), pa.array(times, pa.int64())], ["words", "f"])

    return run


def phrase_counts(rows: DataFrame, words: np.ndarray, pairs: np.ndarray | None, shortest: int, longest: int, least: int, size: int, room: int = ROOM) -> DataFrame:
    """``words`` (word numbers), ``f`` of the phrases of ``shortest`` to ``longest`` words that occur ``least`` times."""
    grown = max(1.0, size / INPUT_BYTES) ** 0.5
    parts = max(1, math.ceil(size / (PART_BYTES * grown)))
    sent = rows.sparkSession.sparkContext.broadcast((words, pairs))
    runs = rows.mapInArrow(_runs(sent, parts, shortest, longest, room), "part int, phrases binary, counts binary")
    return runs.repartition(min(parts, 1 << 15), "part").groupBy("part").applyInArrow(_merged(shortest, longest, least), "words array<long>, f long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, room: int = ROOM) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases of two to ``longest`` words.

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words at blanks and tabs.  A phrase occurs ``a``
    times, all of its language's words ``n`` times; of its cuts in two, which occur ``l`` and ``r`` times, the one
    with the lowest floor(1000 * a * n / (l * r)) counts, then the first.  Phrases below ``least`` are no candidates,
    nor are those that a longer candidate holds whenever they occur.  Null texts are empty, a null language is
    ``und``; repeated rows count each; other columns are not read.  An empty table gives an empty result.

    Words are known by 64-bit numbers; products are decimals of 38 digits.  That a longer phrase covers a shorter one
    shows in a phrase of one more word, since counts only fall with each word added.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    counted = written(word_counts(rows, least))
    words = counted.where("word IS NOT NULL")
    of_words = bitmap(words.select("number"))
    pairs = written(phrase_counts(rows, of_words, None, 2, 2, least, size, room))
    phrases = pairs
    if longest > 2:
        longer = written(phrase_counts(rows, of_words, bitmap(pairs.select("words").mapInArrow(_pair_numbers, "number long")), 3, longest, least, size, room))
        phrases = pairs.union(longer)
    known = words.select(F.array("number").alias("words"), "f").union(phrases)

    part = lambda name, n: known.select(F.col("words").alias(name), F.col("f").alias(n))
    cuts = phrases.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", 1, F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")

    own = phrases.select("words", F.posexplode("words").alias("at", "number")).join(words.select("number", "lang", "word"), "number")
    spelt = own.groupBy("words", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    spelt = spelt.select("words", "lang", F.array_join(F.col("spelt.word"), " ").alias("phrase"))
    totals = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    spelt = spelt.join(totals, "lang")

    exact = "CAST(1000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"
    scored = cuts.join(spelt, "words").withColumn("score", F.expr(exact))
    lowest = scored.groupBy("words", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = phrases.where(F.size("words") > 2).select("f", F.explode(F.array(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1))).alias("words"))
    cover = inner.groupBy("words").agg(F.max("f").alias("cover"))
    kept = lowest.join(cover, "words", "left").where("cover IS NULL OR cover < a").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    best = "row_number() OVER (PARTITION BY lang{} ORDER BY score DESC, a DESC, phrase)"
    kept = kept.withColumn("rank", F.expr(best.format(", part"))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.expr(best.format(""))).where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {
    "op12_collocations": r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
    sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS size),
    grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*)::BIGINT AS f FROM starts, sizes WHERE i + size - 1 <= len(w) GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang),
    cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 100),
    cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
    scored AS (
      SELECT c.lang, c.size, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.k,
             (1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts c
      JOIN grams x ON x.lang = c.lang AND x.size = c.k AND x.phrase = array_to_string(c.w[1:c.k], ' ')
      JOIN grams y ON y.lang = c.lang AND y.size = c.size - c.k AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')
      JOIN totals t ON t.lang = c.lang),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    kept AS (
      SELECT * FROM lowest s WHERE NOT EXISTS (
        SELECT 1 FROM cand b WHERE b.lang = s.lang AND b.size > s.size AND 100 * b.a >= 100 * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept QUALIFY rank <= 2000"""
}
