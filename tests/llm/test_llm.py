"""Every text operator against a brute-force version on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import decontaminate, kernels, near_dup, packing, quality_rules, run_length_index, sharding, substring_dedup, tokens, url_filters, warc, wavelet
from weftline.llm.common import components, rank_within

WORD = r"[^\x20\x09-\x0D]+"
EXTRA = "doc_id long, text string, n long, cid string, spans string, c long, shard long, n_chars int"


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = ["the", "of", "And", "é", "x9", "lorem", "ipsum.", "dolor", "sit", "amet?", "日本", "a,b", "q", "zz", "tion"]
    passage = " ".join(rng.choice(words) + str(i % 7) for i in range(130))
    docs: list[tuple[int | None, str | None]] = []
    for i in range(n):
        kind = rng.randrange(6)
        body = " ".join(rng.choice(words) + rng.choice(["", str(rng.randrange(99))]) for _ in range(rng.randrange(1, 150)))
        if kind == 0 and docs and docs[-1][1]:
            body = docs[-1][1]
        elif kind == 1 and docs and docs[-1][1]:
            w = docs[-1][1].split(" ")
            w[rng.randrange(len(w))] = "edited"
            body = " ".join(w)
        elif kind == 2:
            body = body + "\n" + passage + " " + body[::-1]
        docs.append((i, body))
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "one"), (n + 5, "x " * 2000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "z", "s", 1, 2, -1) for i, t in corpus()]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def shingles(text: str | None, width: int) -> set:
    w = re.findall(WORD, lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked(rows: list[tuple], width: int) -> dict:
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dups(docs, width):
    want = linked([(r["doc_id"], r["text"]) for r in docs.collect()], width)
    got = by_id(near_dup.near_dups(docs, width=width))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_dups_of_a_family_and_long_sets(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(4000)}" for _ in range(900)]
    rows = []
    for i in range(40):
        w = list(base) if i < 20 else [f"u{i}_{k}" for k in range(30)]
        for _ in range(i * 4 if i < 20 else 0):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = by_id(near_dup.near_dups(spark.createDataFrame(rows, "doc_id long, text string"), width=2, k=64))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == linked(rows, 2)


def test_near_dups_of_truncated_copies_around_the_sketch_size(spark):
    """Contained pairs whose shared values are fewer than the overlap that sketches of a union beyond k have."""
    rows = []
    for n in [*range(400, 521, 12), 410, 454, 456, 512, 513]:
        for kind, m in (("at", -(-4 * n // 5)), ("under", -(-4 * n // 5) - 1)):
            w = [f"{kind}{n}_{i}" for i in range(n + 4)]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: m + 4]))]
    got = by_id(near_dup.near_dups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == linked(rows, 5)


def test_near_dups_corner_cases(spark, empty):
    assert near_dup.near_dups(empty).count() == 0
    rows = near_dup.near_dups(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"]) == [(3, 3), (3, 3)] and len(rows) == 4


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 3)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_rank_within(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").union(spark.createDataFrame([(None, 5)], "k long, id long"))
    got = rank_within(df, ["k"], ["id"], "r", 7).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["k"]].append(r["r"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 4


def units(text: str) -> list[tuple[int, int, str]]:
    b, out, at = text.encode(), [], 0
    for i in range(len(b)):
        if i + 1 == len(b) or b[i] == 10 or (b[i] in b" \t\x0b\x0c\r" and i and b[i - 1] in b".!?"):
            out.append((at, i + 1, " ".join(re.findall(WORD, lower(b[at : i + 1].decode())))))
            at = i + 1
    return out


def lines_deduped(rows: list[tuple], min_words: int = 8) -> dict:
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        spans = []
        for s, e, norm in units(t or ""):
            if len(norm.split(" ")) >= min_words and norm:
                if norm in seen:
                    spans.append((s, e))
                seen.add(norm)
        out[i] = (spans, substring_dedup.cut(b, spans))
    return out


def test_line_dedup(docs, empty, spark):
    want = lines_deduped([(r["doc_id"], r["text"]) for r in sorted(docs.collect(), key=lambda r: r["doc_id"])])
    got = by_id(substring_dedup.dedup(docs))
    for i, (spans, kept) in want.items():
        r = got[i]
        assert (r["spans"], r["kept_text"].encode(), r["n_spans"], r["kept_sha256"]) == ("".join(f"{s}-{e}," for s, e in spans), kept, len(spans), hashlib.sha256(kept).hexdigest())
    assert sum(len(s) for s, _ in want.values()) > 5
    assert substring_dedup.dedup(empty).count() == 0 and substring_dedup.without_repeats(empty).count() == 0
    cutdown = by_id(substring_dedup.without_repeats(docs))
    assert set(cutdown) == {i for i, (_, k) in want.items() if k.strip()} and cutdown[0]["n_chars"] == len(want[0][1].decode()) and cutdown[0]["spans"] == "s"


def test_pipeline_removes_repeated_runs_of_short_units(spark):
    import corpus_pipeline

    rng = random.Random(7)
    words = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
    short = [words(rng.randrange(1, 7)) + "." for _ in range(20)]
    passage = " ".join(short[:10]) + "\n\n" + "\n".join(short[10:])
    alone = "Read more."
    texts = {1: f"{words(9)}.\n{passage}\n{words(9)}.\n{alone}\n", 2: f"{words(3)}.\n\n{passage}\n{words(3)}.\n{alone}\n", 3: f"{alone}\n{words(2)}.\n \n{words(2)}.\n"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {i: r["text"] for i, r in by_id(corpus_pipeline.substring_dedup_stage(spark, frame, "")).items()}
    assert got == {1: texts[1], 2: texts[2].replace(passage + "\n", ""), 3: texts[3]}


def test_pipeline_removes_repeated_passages_inside_a_line(spark):
    import corpus_pipeline

    rng = random.Random(12)
    words = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
    passages = [words(60) for _ in range(20)]
    texts = {}
    for k, passage in enumerate(passages):
        texts[2 * k] = f"{words(rng.randrange(9))}x{passage}y{words(9)}"
        texts[2 * k + 1] = f"{words(rng.randrange(30))}z{passage} {words(9)}"
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {i: r["text"] for i, r in by_id(corpus_pipeline.substring_dedup_stage(spark, frame, "")).items()}
    assert all(got[i] == texts[i] for i in range(0, 40, 2))
    left = [len(set(p.split()) & set(got[2 * k + 1].split())) for k, p in enumerate(passages)]
    assert max(left) < 40 and sum(left) < 20 * 22
    assert all(set(texts[2 * k + 1].split()) - set(got[2 * k + 1].split()) <= set(p.split()) for k, p in enumerate(passages))


def test_pipeline_keeps_the_least_occurrence_of_every_unit(spark):
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["", "a", "b c", "c b a", f"d{rng.randrange(60)}"]) + rng.choice([". ", ".\n", ".\n\n"]) for _ in range(rng.randrange(200)))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: r["text"] for i, r in by_id(corpus_pipeline.substring_dedup_stage(spark, frame, "")).items()}
    norms = lambda ts: {u for t in ts for _, _, u in units(t) if u}
    assert norms(got.values()) >= norms(t for _, t in rows) and sum(map(len, got.values())) < sum(len(t) for _, t in rows)


def suffixes_deduped(rows: list[tuple], least: int) -> dict:
    seen = collections.Counter(b[i : i + least] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - least + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), len(b) - len(kept), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("block", "most"), [(run_length_index.BLOCK, run_length_index.MOST), (3000, 2500), (10, 10)])
def test_run_length_index_dedup(docs, empty, block, most):
    """Large blocks, several blocks with large fingerprints dealt again, and every string of those counted singly."""
    want = suffixes_deduped([(r["doc_id"], r["text"]) for r in docs.collect()], 60)
    got = by_id(run_length_index.dedup(docs, least=60, gram=16, block=block, most=most, step=7))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 1000
    if block == 10:
        assert run_length_index.dedup(empty).count() == 0


def test_run_length_index_matching_statistics():
    rng = random.Random(5)
    for _ in range(20):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        index = run_length_index.RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)]))
        text = [(k, i) for k, s in enumerate(strings) for i in range(len(s) + 1)]
        best = []
        for k, i in text:
            a, most = strings[k][i:], 0
            for m, j in text:
                b = strings[m][j:]
                if (k, i) != (m, j):
                    most = max(most, next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))))
            best.append(most)
        assert index.matching().tolist() == best
        assert index.run_sizes.sum() == index.n
        other = bytes(rng.choice(b"abc") for _ in range(rng.randrange(60)))
        assert index.against(other).tolist() == [max(n for n in range(len(other) - i + 1) if any(other[i : i + n] in s for s in strings)) for i in range(len(other))]


def test_run_length_index_of_a_hot_passage(spark):
    """One passage in many different surroundings: its fingerprint is dealt again, and no string is lost or added."""
    rng = random.Random(21)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = noise(130)
    rows = [(i, noise(rng.randrange(90)) + passage[rng.randrange(30) : 130 - rng.randrange(30)] + noise(rng.randrange(90))) for i in range(60)]
    want = suffixes_deduped(rows, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (800, 3000):
        got = by_id(run_length_index.dedup(frame, least=60, gram=16, block=1000, most=most, step=8))
        assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_unlike_long_words_have_unlike_hashes(spark, empty):
    """Words and word sequences that agree in any polynomial modulo a power of two are told apart by every operator."""
    pairs = [(thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")), (" ".join(thue_morse(2048, "a", "b")), " ".join(thue_morse(2048, "b", "a")))]
    h, _ = kernels.word_hashes(*kernels.flat(pa.array(pairs[0])))
    assert h[0] != h[1]
    for x, y in pairs:
        docs = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
        assert [r["n_removed"] for r in substring_dedup.dedup(docs, min_words=1).collect()] == [0, 0]
        assert decontaminate.leaks(docs.where("doc_id = 1"), docs.where("doc_id = 2").select(F.col("doc_id").alias("item_id"), "text"), width=5, least=1.0).count() == int(" " in x)
    docs = spark.createDataFrame([(1, pairs[0][0]), (2, pairs[0][1])], "doc_id long, text string")
    assert all(r["kept"] for r in near_dup.near_dups(docs, width=2).collect())
    want = suffixes_deduped([(1, pairs[0][0]), (2, pairs[0][1])], 600)
    got = by_id(run_length_index.dedup(docs, least=600, gram=64))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


def text_statistics(text: str | None) -> tuple:
    t = text or ""
    w = re.findall(WORD, t)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)


def test_quality_statistics(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = by_id(quality_rules.statistics(docs))
    for i, t in texts.items():
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == text_statistics(t)


def test_quality_rules_learn_and_reject(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" + ("$$$" if bad else "") for _ in range(40))))
        if i < 300:
            labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, None), (5, 9)], "doc_id long, quality int")
    got = by_id(quality_rules.judged(docs, lab))
    assert all(got[i]["kept"] == (i % 4 != 0) for i in range(300, 400))
    kept = quality_rules.passing(docs.withColumn("w", F.lit(1)).withColumn("n_words", F.lit("x")), lab)
    assert kept.columns == ["doc_id", "text", "w", "n_words"] and kept.count() == 300
    assert quality_rules.judged(empty, lab).count() == 0 and quality_rules.judged(docs, lab.limit(0)).where("kept").count() == 400


def pieces_of(path: str, texts: list[str | None]) -> list[list[int]]:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


ODD = ["", None, " a", "a ", "a  b", "a\n b", "x\ty", "it's don't 'S  z", "<|endoftext|> hi", "a\x01b c", "Ünï\nİ x", "12 45,6", "\n", "a\n\nb", "a b", "x y z", "n't\n't", "﻿a b", "c\u0085d e", "l' 's", "ΑΣ Σα ΌΣΟΣ.", "İstanbul Éa ǅ", "e\u0301a é", "don't. rock'n'roll, l'eau", "x_y a-b (c) [d]. \"e\" f%%% $$$ '", "ª º ⅷ ² ½ ٣", "naïve—dash …", "ﬁ Ω K Å", "\u0301 a", "ß ẞ ŉ", "a\u200bb c\u00adD"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_cache_equals_the_library(name):
    path = tokens.vocabulary(name)
    texts = [*ODD, *(t for _, t in corpus())]
    for most in (10, tokens.CACHE):
        ids, n = tokens.WordCache(path, most)(pa.array([*texts, *texts]))
        at = kernels.ragged(n)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == pieces_of(path, texts) * 2


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", ["Señal", " señal", " Señal", " x9,"]), ("word_bpe_49k.json", ["señal", "x9,"])])
def test_word_cache_holds_a_word_once_whatever_marks_follow(name, words):
    path = tokens.vocabulary(name)
    texts = ["Señal señal, señal. Señal!? señal;", "señal", "", "Señal...\nSeñal x9,", None]
    cache = tokens.WordCache(path)
    ids, n = cache(pa.array(texts))
    at = kernels.ragged(n)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == pieces_of(path, [t or "" for t in texts])
    assert set(cache.known) - {"", "\n"} == {*words, *(["señal"] if cache.spaced else [])}


def test_packing(docs, empty):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = dict(zip(texts, pieces_of(tokens.vocabulary("byte_bpe_50k.json"), list(texts.values())), strict=True))
    rows = packing.pack(docs, capacity=packing.Capacity(tokens=256)).collect()
    held = collections.defaultdict(list)
    for r in rows:
        mine = [*ids[r["doc_id"]], 2][r["start"] : r["start"] + r["length"]]
        assert len(mine) == r["length"] <= 256 and r["ids_crc32"] == zlib.crc32(np.array(mine, "<u4").tobytes()) and (r["piece"] == 0 or r["length"] == 256)
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 256
    total = sum(len(v) + 1 for v in ids.values())
    assert sum(r["length"] for r in rows) == total and len(held) <= total / 256 * 1.1 + 1
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    rng = random.Random(4)
    histogram = {n: rng.randrange(1, 40) for n in range(1, 65)}
    cap = packing.Capacity(tokens=64, documents=5, attention=64 * 64, rule=rule)
    bins = collections.defaultdict(list)
    done = collections.Counter()
    for n, rank, count, first, per, offset in packing.plan(histogram, cap):
        assert rank == done[n]
        done[n] += count
        for k in range(count):
            bins[first + k // per].append((offset + k % per * n, n))
    assert dict(done) == histogram
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64 and len(spans) <= 5 and sum(n * n for _, n in spans) <= 4096
    with pytest.raises(ValueError, match="fits no"):
        packing.plan({10: 1}, packing.Capacity(tokens=64, attention=50))


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50000, 3000)
    x[::7] = 5
    m, ids, has, at = wavelet.load(wavelet.dump(x, np.array([4, 0]), np.array([True, False]), np.array([0, 100, 3000])))
    assert (m.tokens() == x).all() and ids.tolist() == [4, 0] and has.tolist() == [True, False] and at.tolist() == [0, 100, 3000]
    assert all(m.access(k) == x[k] for k in range(0, 3000, 31))
    assert m.count(5) == (x == 5).sum() and m.count(5, 1000) == (x[:1000] == 5).sum() and m.count(60000) == 0
    assert [m.occurrence(5, k) for k in range(40)] == np.flatnonzero(x == 5)[:40].tolist()
    with pytest.raises(IndexError):
        m.occurrence(5, 10**6)


@pytest.mark.parametrize("n", [0, 1, 512, 70_000, 200_001])
def test_shard_file_answers_from_the_file(n):
    """Access, rank, select, count and occurrence without the whole file, at and around the borders of blocks and groups."""

    class Counted(io.BytesIO):
        bytes_read = 0

        def read(self, size=-1):
            out = super().read(size)
            Counted.bytes_read += len(out)
            return out

    rng = np.random.default_rng(n)
    x = np.minimum(rng.zipf(1.3, n), 49_407)
    data = wavelet.dump(x, np.array([9]), np.array([True]), np.array([0, n]))
    file = wavelet.ShardFile(Counted(data))
    assert (file.matrix().tokens() == x).all() and [a.tolist() for a in file.documents()] == [[9], [True], [0, n]]
    with pytest.raises(ValueError, match="not a wavelet"):
        wavelet.ShardFile(io.BytesIO(b"x" * 100))
    if not n:
        assert file.count(1) == 0
        return
    Counted.bytes_read = 0
    places = sorted({0, n - 1, *(p for b in range(0, n, 65_536) for p in (b - 1, b, b + 511, b + 512) if 0 <= p < n)})
    assert [file.access(p) for p in places] == x[places].tolist()
    for token in (1, int(x[-1]), 49_000):
        at = np.flatnonzero(x == token)
        assert file.count(token) == len(at) and file.count(token, n // 2) == (x[: n // 2] == token).sum()
        assert [file.occurrence(token, k) for k in range(min(3, len(at)))] == at[:3].tolist()
    file = wavelet.ShardFile(Counted(data))
    Counted.bytes_read = 0
    assert file.access(n // 2) == x[n // 2] and (n < 10**5 or Counted.bytes_read < len(data) / 2)


def test_lookup_over_shards(docs, spark, tmp_path):
    manifest = wavelet.write(docs, f"file://{tmp_path}/shards", shard_tokens=500).persist()
    want = collections.Counter(t for ids in pieces_of(tokens.vocabulary("word_bpe_49k.json"), [r["text"] for r in docs.collect()]) for t in [*ids, 2])
    ask = [2, *[t for t, _ in want.most_common(3)], 49_000]
    got = wavelet.lookup(manifest, ask).groupBy("token").agg(F.sum("count").alias("n")).collect()
    assert manifest.count() > 1 and {r["token"]: r["n"] for r in got} == {t: want[t] for t in ask}


def test_wavelet_round_trip(docs, empty):
    texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    got = by_id(wavelet.round_trip(docs))
    at = 0
    for (i, _), ids in zip(texts, pieces_of(tokens.vocabulary("word_bpe_49k.json"), [t for _, t in texts]), strict=True):
        want = [*ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert wavelet.round_trip(empty).count() == 0


@pytest.mark.parametrize("n", [3, 40])
def test_sharding(docs, empty, n):
    rows = sharding.shard(docs, n=n).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    shards = collections.defaultdict(list)
    for r in rows:
        b = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 16, zlib.crc32(b), "rows", None)
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and len(rows) == len(texts)
    counts = [len(shards.get(k, [])) for k in range(n)]
    assert max(counts) - min(counts) <= 1 and set(shards) <= set(range(n))
    if n == 3:
        groups = collections.defaultdict(set)
        for r in rows:
            if texts[r["doc_id"]] is not None:
                groups[texts[r["doc_id"]]].add(r["shard"])
        assert all(len(s) == 1 for s in groups.values())
        assert sharding.shard(empty).count() == 0


def test_sharding_splits_a_group_beyond_the_quota(spark):
    docs = spark.createDataFrame([(i, "same" if i < 60 else f"t{i}") for i in range(100)], "doc_id long, text string")
    rows = sharding.shard(docs, n=5).collect()
    assert set(collections.Counter(r["shard"] for r in rows).values()) == {20}
    assert len({r["shard"] for r in rows if r["doc_id"] < 60}) <= 4


def shards_of(rows: list, texts: list[str]) -> dict:
    out = collections.defaultdict(set)
    for r in rows:
        out[texts[r["doc_id"]]].add(r["shard"])
    return out


def test_sharding_gathers_groups_where_every_row_is_linked(spark):
    texts = [f"t{i % 200}" for i in range(400)]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=8).collect()
    assert set(collections.Counter(r["shard"] for r in rows).values()) == {50} and len({r["shard"] for r in rows}) == 8
    assert all(len(s) == 1 for s in shards_of(rows, texts).values())


def test_sharding_splits_hot_groups_over_the_fewest_shards(spark):
    texts = ["hot"] * 400 + ["warm"] * 45 + [f"p{i // 2}" for i in range(200)] + [f"u{i}" for i in range(555)]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=40).collect()
    assert set(collections.Counter(r["shard"] for r in rows).values()) == {30} and len({r["shard"] for r in rows}) == 40
    held = shards_of(rows, texts)
    assert len(held.pop("hot")) == 14 and len(held.pop("warm")) == 2 and all(len(s) == 1 for s in held.values())


def test_sharding_exchanges_between_full_shards(spark):
    assert sorted(sharding._exchange({(0, 1): 5, (1, 0): 3, (2, 0): 4}, [0, 0, 0])) == [(0, 1, 3), (1, 0, 3)]
    rows = spark.createDataFrame([(i, 16, 0, bytes([i // 4]), int(i % 4 == 3) ^ (i // 4 % 2)) for i in range(40)], "doc_id long, size long, text_crc32 long, gid binary, shard long")
    got = sharding.propagate(rows, [20, 20], 4).collect()
    assert collections.Counter(r["shard"] for r in got) == {0: 20, 1: 20} and len({(r["gid"], r["shard"]) for r in got}) == 10


def test_url_filters(spark):
    rng = random.Random(6)
    hosts = ["org", "example.org", "www.example.org", "badexample.org", "com", "a.com", "A.B.com", "x.y.z.net", ""]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12", "/fr/", "/fr/q?x=/de/", "/de/#a", "/e"]
    rules = [(rng.choice(hosts[:8]).lower(), rng.choice(paths[1:6]), rng.choice(["allow", "block"])) for _ in range(15)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [rng.choice(["http://", "https://", ""]) + rng.choice(hosts) + rng.choice(paths) for _ in range(200)] + [None, "", "://", "http://h\nx/y"]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "h", "k", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, key string, range long")
    got = url_filters.judged(pages, rules, ranges=7).collect()
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: (f[0], len(f[1])), default=None)
        want.append((i if i % 9 else None, host, path, best[1] + best[2] if best else None, best[3] if best else "allow"))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert url_filters.judged(pages.limit(0), rules).count() == 0 and url_filters.judged(pages, rules[:0]).where("rule IS NOT NULL").count() == 0


def test_url_filters_deal_a_hot_host_evenly(spark):
    """One host, and one url a third of the time: no range gets twice its share, and none is lost."""
    pages = spark.range(24_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.example.org/"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string"))).alias("url"))
    urls = url_filters.with_host_path(pages).select("page_id", "host", "path", F.lit("org.example.hot.").alias("key"), F.xxhash64("page_id", "url").alias("salt"))
    rules = spark.createDataFrame([("org", "/", "block", "org.")], "host string, path string, verdict string, key string")
    dealt = url_filters._dealt(urls, rules, 16, 5_000)
    sizes = collections.Counter(r["range"] for r in dealt.where("kind = 1").collect())
    assert len(sizes) == 16 and max(sizes.values()) <= 2 * 24_000 / 16
    assert sorted(r["range"] for r in dealt.where("kind = 0").collect()) == list(range(16))
    got = url_filters.judged(pages, [("org", "/", "block"), ("example.org", "/same", "allow")], ranges=16)
    assert {(r["rule"], r["count"]) for r in got.groupBy("rule").count().collect()} == {("org/", 16_000), ("example.org/same", 8_000)}


def test_tiles_by_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        a, b, w = [rng.randrange(3) for _ in range(rng.randrange(2, 30))], [rng.randrange(3) for _ in range(rng.randrange(2, 12))], 2
        seeds = [(i, j) for i in range(len(a) - w + 1) for j in range(len(b) - w + 1) if a[i : i + w] == b[j : j + w]]
        if not seeds:
            continue
        i, j = map(np.array, zip(*seeds, strict=True))
        used_a, used_b, want = set(), set(), []
        while True:
            best = None
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n] and x + n not in used_a and y + n not in used_b:
                        n += 1
                    if n >= w and (best is None or n > best[0]):
                        best = (n, x, y)
            if best is None:
                break
            want.append(best)
            used_a |= set(range(best[1], best[1] + best[0]))
            used_b |= set(range(best[2], best[2] + best[0]))
        assert decontaminate.tiles(i, j, w) == want
        assert sum(t[0] for t in decontaminate.tiles(i, j, w, words=len(b))) == sum(t[0] for t in want)


def test_decontamination_in_bounded_blocks_of_seed_pairs(monkeypatch):
    """Documents that repeat an item's words over and over: the same tiles in small blocks of pairs, and a million pairs at once never."""
    rng = random.Random(3)
    items = decontaminate.Items([1, 2, 3], ["a b a b a b c d e f", "x " * 50, " ".join(f"w{k}" for k in range(30))], 5)
    texts = ["a b " * 40 + "c d e f", "x " * 300, "y x " * 20, " ".join(f"w{k}" for k in [*range(15, 30), 99, *range(15)]), " ".join(rng.choice("abx") for _ in range(200))]
    found = lambda: list(items.covered(*kernels.word_hashes(*kernels.flat(pa.array(texts))), 0.5))
    whole = found()
    assert {(d, q) for d, q, _, _ in whole} >= {(0, 0), (1, 1), (3, 2)}
    monkeypatch.setattr(decontaminate, "PAIRS", 7)
    assert found() == whole
    monkeypatch.setattr(decontaminate, "PAIRS", 200_000)
    long = kernels.word_hashes(*kernels.flat(pa.array(["x " * 60_000])))
    assert list(items.covered(*long, 0.8)) == [(0, 1, 50, 1)]


def test_decontamination(spark, empty):
    item = " ".join(f"w{i}" for i in range(40))
    parts = item.split(" ")
    rows = [(1, "noise before " + item.upper() + " after"), (2, " ".join(parts[20:] + ["x", "y"] + parts[:20])), (3, " ".join(parts[:20])), (4, "nothing here"), (5, None), (6, ""), (7, "two words")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "two words"), (10, "")], "item_id long, text string")
    for words in (10, 10**6):
        got = {(r["doc_id"], r["item_id"]): (r["covered"], r["n_tiles"]) for r in decontaminate.leaks(docs, bench, block_words=words).collect()}
        assert got == {(1, 7): (40, 1), (2, 7): (40, 2), (7, 9): (2, 1)}
        assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench, block_words=words).collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big = "é" * 3_000_000
    rows = [(1, "http://a\r\nX: y", "x" * 1000), (2, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", big), (9, "u", big), (None, "u", big), (None, "u", "solo"), (2, None, "x" * 1000)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    top = {h: max(i for i, _, g in rows if g == h and i is not None) for h in ("x" * 1000, big)}
    want = sorted(str((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h in top and i != top[h] else "response", top[h] if h in top and i != top[h] else None)) for i, _, h in rows)
    got = sorted(str(tuple(r)) for r in warc.round_trip(spark, pages).collect())
    assert got == want
    manifest = warc.write(warc.planned(pages), f"file://{tmp_path}/w", file_bytes=1).persist()
    chunks = warc.read(manifest).collect()
    assert max(len(r["chunk"] or b"") for r in chunks) <= warc.CHUNK and max(r["chunk_no"] for r in chunks) >= 5
    whole = [bytes(r["chunk"]) for r in sorted((r for r in chunks if r["page_id"] == 9), key=lambda r: r["chunk_no"])]
    assert b"".join(whole) == big.encode()
    file = next(r["file"] for r in manifest.collect()).removeprefix("file://")
    assert gzip.decompress(open(file, "rb").read()).startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_reader_refuses_a_changed_payload():
    head = warc._heads(1, "u", 3, hashlib.sha1(b"abc").hexdigest(), None)
    stream = io.BytesIO(gzip.compress(head + b"abc\r\n\r\n") + gzip.compress(head + b"abd\r\n\r\n"))
    digests = []
    for _, pieces, state in warc.records(stream):
        b"".join(pieces)
        digests.append(state["digest"])
    assert digests == [hashlib.sha1(b"abc").hexdigest(), hashlib.sha1(b"abd").hexdigest()]


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    rng = random.Random(11)
    item = " ".join(f"bench{rng.randrange(10**6)}" for _ in range(30))
    body = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    shared = body(12) + "."
    rows = [(i, body(60)) for i in range(30)]
    rows += [(30, rows[0][1]), (31, rows[1][1] + " more"), (32, body(5)), (33, body(20) + " " + item + " " + body(9)), (34, body(30) + "\n" + shared + "\n" + body(9)), (35, body(30) + "\n" + shared + "\n" + body(9)), (36, None)]
    at = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    texts = dict(rows)
    kept = [i for i, t in rows if len((t or "").split()) >= 10]
    comp = linked([(i, texts[i]) for i in kept], 5)
    kept = [i for i in kept if comp[i][1] == i]
    cut = lines_deduped([(i, texts[i]) for i in kept])
    kept = [i for i in kept if i != 33]
    got = corpus_pipeline.run(spark, at).collect()
    ids = dict(zip(kept, pieces_of(tokens.vocabulary("byte_bpe_50k.json"), [cut[i][1].decode() for i in kept]), strict=True))
    assert {30, 31, 32, 33, 36}.isdisjoint(kept) and len(cut[35][0]) == 1
    assert sorted((r["doc_id"], r["piece"]) for r in got) == [(i, 0) for i in sorted(kept)]
    assert all(r["ids_crc32"] == zlib.crc32(np.array([*ids[r["doc_id"]], 2], "<u4").tobytes()) for r in got)


LONG = " ".join(f"word{i % 9973}x{i % 7}" for i in range(120_000)) + "."


def test_texts_longer_than_a_slice_and_rows_without_an_id(spark):
    """A text of more than a megabyte, null ids, and one id with two texts, through every operator of documents."""
    import corpus_pipeline

    assert len(LONG) > 1_300_000
    rows = [(1, LONG), (2, LONG + " and more"), (None, "one two three four five six seven eight nine ten eleven"), (None, "é " * 500), (None, None), (7, "a b c d e f g h i j k l é"), (7, LONG[:3000]), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = {t: len((t or "").encode()) for _, t in rows}
    assert sorted(r["n_bytes"] for r in substring_dedup.dedup(docs).collect()) == sorted(size[t] for _, t in rows)
    got = {(r["doc_id"], r["n_bytes"]): r["kept_sha256"] for r in run_length_index.dedup(docs).collect()}
    assert len(got) == 8 and got[7, 3000] == hashlib.sha256(b"").hexdigest() and got[7, 26] == hashlib.sha256("a b c d e f g h i j k l é".encode()).hexdigest()
    near = near_dup.near_dups(docs).collect()
    assert len(near) == 8 and {r["component_id"] for r in near if r["doc_id"] in (1, 2)} == {1}
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:9]) for r in near_dup.deduplicated(docs).collect())
    assert kept == sorted((str(i), (t or "")[:9]) for i, t in rows if i != 2)
    assert sorted(r["length"] for r in packing.pack(docs).collect() if r["piece"] and r["doc_id"] in (1, 2))[0] == 1024
    tokens_of = {r["doc_id"]: r["n_tokens"] for r in wavelet.round_trip(docs.where("doc_id < 3")).collect()}
    assert tokens_of[2] == tokens_of[1] + len(pieces_of(tokens.vocabulary("word_bpe_49k.json"), [" and more"])[0]) and wavelet.round_trip(docs).count() == 8
    assert len(sharding.shard(docs, n=3).collect()) == 8
    bench = spark.createDataFrame([(1, " ".join(LONG.split(" ")[60_000:60_040])), (2, "one two three four five six")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 1), (2, 1), (None, 2)}
    stats = quality_rules.statistics(docs).collect()
    assert sorted(r["n_words"] for r in stats) == sorted(text_statistics(t)[0] for _, t in rows)
    staged = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.substring_dedup_stage(spark, corpus_pipeline.near_dedup(spark, staged, ""), "")
    assert cut.columns == staged.columns and {r["doc_id"] for r in cut.collect()} == {1, None, 7}
