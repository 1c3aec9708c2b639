"""Token alignment, collocations and SimHash groups against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import alignment, collocations, simhash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [None, "", " ", "\n\t ", "a", "One two", "one  TWO", "x " * 900, "long" * 3000, "<|endoftext|> a </s> <unk> <s>", "tab\tand blank   wide", "▁ lower ▁block", "漢字 漢字かな 😀 é é", "it's we'll don't 'S", "\x00 \x1c a\x1cb \x85 c", "a, b. c; d: e! f? g"]
CLASH = ", id string, code string, component int, pair long, at long, slice string, word string, f long, n long"
PAD = (None, "c", 1, 2, 3, None, "w", None, 4)


def table(spark, texts, langs=None, ids=None, parts=3):
    rows = [(i if ids is None else ids[i], t, "en" if langs is None else langs[i], *PAD) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string" + CLASH).repartition(parts)


def invented(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "Ünter", "día", "house", "RIVER", "stone", "it's", "42", "漢字", "na"]
    return [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "\n", ""]) for _ in range(rng.randint(1, words))) for _ in range(n)]


# Alignment


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    byte = alignment._byte_signs()
    pairs, links = Counter(), []
    out = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = left.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        raw_a = [bytes(byte[c] for c in left.id_to_token(x)) for x in a]
        raw_b = [bytes([int(p[1:-1], 16)]) if re.fullmatch("<0x..>", p := right.id_to_piece(x)) else p.replace("▁", " ").encode() for x in b]
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        starts_a, starts_b = ends_a - [len(x) for x in raw_a], ends_b - [len(x) for x in raw_b]
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, own = [], []
        for i, x in enumerate(a):
            own += [(x, b[j]) for j in range(len(b)) if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]]
        begin = 0
        for cut in cuts:
            inside = lambda ids, s, e: ",".join(str(x) for x, p, q in zip(ids, s, e) if begin <= p and q <= cut)  # noqa: B023, E731
            groups.append(f"{inside(a, starts_a, ends_a)}|{inside(b, starts_b, ends_b)}")
            begin = cut
        pairs.update(own)
        links.append(own)
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return [(na, nb, ng, len(own), sum(pairs[p] == most[p[1]] for p in own), sum(pairs[p] for p in own), sha) for (na, nb, ng, sha), own in zip(out, links)]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 2000])
def test_alignment_against_brute_force(spark, slice_bytes):
    texts = [t if t is None or len(t) < 2500 else t[:2500] for t in ODD] + invented(1, 60) + ["the house"] * 40
    found = {r.id: r for r in alignment.aligned(table(spark, texts), A, B, slice_bytes=slice_bytes).collect()}
    assert len(found) == len(texts)
    for i, want in enumerate(brute_alignment(texts)):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, texts[i]
    assert alignment.aligned(table(spark, texts).where("false"), A, B).count() == 0


def test_alignment_of_pairs(spark):
    """Documents and links of each pair, from bitmaps of several planes, dense and sparse; unnamed and repeated rows."""
    texts = ["the the the the the the a"] * 30 + ["b the"] * 3 + invented(2, 20)
    docs = table(spark, texts, ids=[None if i % 2 else i // 4 for i in range(len(texts))])
    width = alignment._aligner(A, B).width
    postings = alignment.pair_postings(docs, A, B, slice_bytes=400).where("pair IS NOT NULL")
    assert {r.dense for r in postings.select("dense").distinct().collect()} == {True, False} and postings.agg(F.max("plane")).first()[0] >= 2
    held, times = Counter(), Counter()
    al = alignment._aligner(A, B)
    for text in texts:
        own = Counter()
        for some in al.stretches(text):
            for c in al.codes(some).tolist():
                own.update(al.pairs[al.ends[c] : al.ends[c + 1]])
        held.update(own.keys())
        times.update(own)
    found = {r.pair: (r.docs, r.links) for r in alignment.pair_scores(postings, width).collect()}
    assert found == {p: (held[p], times[p]) for p in times}


def test_alignment_of_long_texts():
    """Parts of a long text give what the whole gives; a task that forgets stretches does too."""
    import pyarrow as pa

    text = " ".join(invented(3, 1, 3000)) + "  " + "é" * 500
    al = alignment.Aligner(A, B)
    results = []
    for size, remembered in ((1 << 20, 1 << 17), (300, 20)):
        before = alignment.CHUNK_BYTES, alignment.CHUNK_STRETCHES, alignment.REMEMBERED
        alignment.CHUNK_BYTES, alignment.CHUNK_STRETCHES, alignment.REMEMBERED = size, size, remembered
        try:
            al.forget()
            part = alignment.Slice(al)
            part.add(pa.array([1, 2]), pa.array([text, "short"]))
            heads = [h.to_pylist() for h in part.heads()]
            results.append((heads, sorted((p, *x) for p, pairs, n, *_ in part.planes() for x in zip(pairs.tolist(), n.tolist()))))
        finally:
            alignment.CHUNK_BYTES, alignment.CHUNK_STRETCHES, alignment.REMEMBERED = before
    assert results[0] == results[1]


# Collocations


def brute_collocations(texts, langs, least, top, longest=5):
    f, n = Counter(), Counter()
    for text, lang in zip(texts, langs):
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    found = defaultdict(list)
    for (lang, *words), a in cand.items():
        score, k = min((1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words)))
        inside = lambda b: any(list(b[i : i + len(words)]) == words for i in range(1, len(b) - len(words) + 1))  # noqa: B023, E731
        if not any(b[0] == lang and len(b) > len(words) + 1 and 100 * c >= 100 * a and inside(b) for b, c in cand.items()):
            found[lang].append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("room, top", [(1 << 20, 2000), (40, 7)])
def test_collocations_against_brute_force(spark, monkeypatch, room, top):
    rng = random.Random(5)
    texts = invented(4, 150) + ODD + ["to be or not to be"] * 9 + ["A a a a a a a, a a"] * 4
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    monkeypatch.setattr(collocations, "BURST", 16)
    found = collocations.collocations(table(spark, texts, langs), least=4, top=top, room=room).collect()
    assert sorted(tuple(r) for r in found) == brute_collocations(texts, langs, 4, top)
    assert collocations.collocations(table(spark, texts).where("false")).count() == 0


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    trie, want = collocations.HatTrie(4, burst=8), Counter()
    spilt = Counter()
    for _ in range(30):
        block = rng.integers(1, 5, (200, 4)).astype(np.uint64)
        block[rng.random(200) < 0.3, 3] = 0
        phrases, counts = np.unique(block, axis=0, return_counts=True)
        trie.add(phrases, counts)
        want.update({tuple(p): c for p, c in zip(phrases.tolist(), counts.tolist())})
        if trie.size > 150:
            firsts = set(trie.root)
            phrases, counts = trie.spill(100)
            assert not {w for w in trie.root} & set(phrases[:, 0].tolist()) and firsts == set(trie.root) | set(phrases[:, 0].tolist())
            spilt.update({tuple(p): c for p, c in zip(phrases.tolist(), counts.tolist())})
    phrases, counts = trie.spill(0)
    spilt.update({tuple(p): c for p, c in zip(phrases.tolist(), counts.tolist())})
    assert spilt == want and trie.size == 0


def test_scores_beyond_64_bits(spark):
    exact = "CAST(1000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"
    rows = [(10**11 + 7, 10**12 + 3, 10**11 + 9, 10**11 + 10), (100, 10**13, 101, 103), (99999999977, 10**14 - 1, 99999999977, 99999999999)]
    found = spark.createDataFrame(rows, "a long, n long, l long, r long").selectExpr("a", "n", "l", "r", f"{exact} AS score").collect()
    assert all(r.score == 1000 * r.a * r.n // (r.l * r.r) for r in found)


def test_bitmap_marks_all(spark):
    numbers = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000)
    frame = spark.createDataFrame([(int(x),) for x in numbers], "number long")
    for most in (1 << 29, 1 << 15):
        bits = collocations.bitmap(frame, most)
        assert collocations._marked(bits, numbers.view(np.uint64)).all()
    assert collocations._marked(collocations.bitmap(frame), np.arange(10000, dtype=np.uint64) * np.uint64(2654435761)).mean() < 0.1
    assert not collocations.bitmap(frame.where("false")).any()


# SimHash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words] if words else []
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(codes, apart=2):
    """Each code's group as the smallest place in it."""
    root = list(range(len(codes)))

    def end(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= apart:
                a, b = end(i), end(j)
                root[max(a, b)] = min(a, b)
    return [end(i) for i in range(len(codes))]


def near_texts(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(300)] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def test_simhash_against_brute_force(spark):
    texts = near_texts(7) + ODD + invented(6, 60, 12)
    found = {r.id: (r.code % 2**64, r.component) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    codes = [brute_fingerprint(t) for t in texts]
    groups = brute_groups(codes)
    assert [found[i] for i in range(len(texts))] == list(zip(codes, groups))
    assert len(set(groups[:96])) < 90 and max(Counter(groups[:96]).values()) > 1
    assert simhash.near_duplicates(table(spark, texts).where("false")).count() == 0


def test_simhash_query(spark, tmp_path):
    texts = ["One two three four", "one TWO three\nfour", None, "", "a", "b c"]
    table(spark, texts, ids=[7, 3, 9, 8, None, None]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.op13_simhash(spark, str(tmp_path)).collect()}
    name = lambda t: f"{brute_fingerprint(t):016x}"
    assert found == {(7, name(texts[0])): 3, (3, name(texts[0])): 3, (9, "0" * 16): 8, (8, "0" * 16): 8, (None, name("a")): None, (None, name("b c")): None}


@pytest.mark.parametrize("crowd", [4096, 5])
def test_crowded_groups_of_codes(spark, crowd):
    """Codes that share 32 bits and more, cut again where a group is crowded: the same groups as by all pairs."""
    rng = random.Random(8)
    base = rng.getrandbits(64)
    codes = {base ^ rng.getrandbits(16) for _ in range(120)} | {base ^ (rng.getrandbits(24) << 20) for _ in range(150)} | {rng.getrandbits(64) for _ in range(150)}
    codes |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in list(codes)[:150]} | {0, 2**64 - 1, 2**63, 3}
    codes = sorted(codes)
    frame = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "code long").repartition(4)
    root = {c: c for c in codes}

    def end(c):
        while root[c] != c:
            c = root[c]
        return c

    for r in simhash.near_codes(frame, crowd).collect():
        a, b = r.a % 2**64, r.b % 2**64
        assert (a ^ b) and (x := end(a)) is not None
        root[max(x, end(b))] = min(x, end(b))
    want = brute_groups(codes)
    assert [end(c) for c in codes] == [codes[g] for g in want]


def test_gray_order():
    codes = np.arange(1 << 10, dtype=np.uint64)
    order = np.argsort(simhash.gray_rank(codes))
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in zip(order, order[1:]))


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(near_texts(9)[:3])
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PART_BYTES", 50)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)
