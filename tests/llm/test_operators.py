"""Each operator against a plain version, and on odd inputs."""

from __future__ import annotations

import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import _stats, covertree, licenses, minhash, mixing, packing, ppm, quality, rules, sharding, toxicity
from tarnwell.llm import _text as tx
from tarnwell.llm._common import written

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [
    (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "   \n\t", "en", "a", 5), (4, "one", None, "b", 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3),
    (None, "no id here at all", "en", "c", 17), (6, LONG, "en", "c", len(LONG)), (7, None, "en", "a", 0), (8, "x" * 30_000, "en", "a", 30_000), (9, "naïve ünïcode   text", "fr", "b", 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return written(spark.createDataFrame(ODD, SCHEMA), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return written(spark.createDataFrame([], SCHEMA), "empty")


def words(text):
    return [w for w in "".join(c if c not in "\t\n\v\f\r" else " " for c in (text or "")).split(" ") if w]


# Shared text functions


def test_word_and_shingle_hashes_agree_with_strings():
    import pyarrow as pa

    texts = ["a b  a\nb a", "", "b", "a b a b a", None, "ü b\x0ba"]
    data, at = tx.text_buffer(pa.array(texts))
    starts, ends, counts = tx.words(data, at - at[0])
    own = [w for t in texts for w in words(t)]
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)] == own
    assert counts.tolist() == [len(words(t)) for t in texts]
    hashes = tx.span_hash(data, starts, ends)
    assert len(set(zip(own, hashes.tolist(), strict=True))) == len(set(own)) == len(set(hashes.tolist()))
    grams, number = tx.shingles(hashes, counts, 5)
    assert number.tolist() == [1, 0, 1, 1, 0, 1]
    assert grams[0] == grams[2] and grams[1] != grams[0]


# 1


def brute_top(x, ids, k):
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), int(s[j])) for j in order]
    return out


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, (150, 8)) for c in rng.normal(0, 1, (4, 8))] + [np.tile([0.5] * 8, (120, 1))])
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = np.floor(256 * np.array([r for _, r in rows])).astype(np.int64)
    for sizes in ({"block_rows": 64, "chunk_rows": 4}, {}):
        got = defaultdict(list)
        for r in covertree.top_k(df, F.col("vec_id") % 50 == 0, **sizes).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert dict(got) == brute_top(ints, np.arange(len(x)), 5)


def test_top_k_leaves_out_what_is_no_vector(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]), (6, []), (50, [0.0, -1.0]), (7, [1.0, 1.0, 1.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("score", "row", "place", "cell", "q", "_metadata"):
        df = df.withColumn(name, F.lit("clash"))
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in covertree.top_k(df, F.col("vec_id") % 50 == 0).collect())
    s = 65536  # the repeated row is a candidate twice
    assert got == Counter([(0, 1, 5, 3 * s), (0, 2, 5, 3 * s), (0, 3, 50, -2 * s), (50, 1, 5, -s), (50, 2, 5, -s), (50, 3, 0, -2 * s)])
    twice = df.where("vec_id = 0").union(df.where("vec_id = 0"))  # each of two equal query rows has the other as its candidate
    assert [(r["vec_id"], r["score"]) for r in covertree.top_k(twice, F.col("vec_id") % 50 == 0).collect()] == [(0, 5 * s)] * 2
    assert covertree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_cover_trees_reach_small_leaves_and_prune(spread):
    """Clusters: nearly all pairs of nodes go; vectors without any structure: trees as deep, and nothing is lost."""
    rng = np.random.default_rng(6)
    x = np.floor(256 * (rng.normal(0, 1, (60, 16))[rng.integers(0, 60, 3000)] + rng.normal(0, spread, (3000, 16))))
    tree, ids = covertree.CoverTree(x), np.arange(3000)
    leaves = [n for n in range(len(tree.centre)) if tree.first[n] == tree.last[n]]
    assert max(tree.end[n] - tree.start[n] for n in leaves) <= covertree.LEAF and len(leaves) > 90
    assert sorted(p for n in leaves for p in tree.points(n)) == list(range(3000))
    for n in range(len(tree.centre)):
        assert np.linalg.norm(x[tree.points(n)] - tree.at[n], axis=1).max() <= tree.radius[n] + 1e-6
    queries, counts = np.arange(0, 3000, 10), covertree.Counts()
    best, got = covertree.search(covertree.CoverTree(x[queries]), queries, tree, ids, 5, np.full(300, -np.inf), counts=counts)
    for row, i in enumerate(queries):
        s = x @ x[i]
        want = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        assert got[row].tolist() == want and best[row].tolist() == s[want].tolist()
    if spread < 1:
        assert counts.dropped > 0.5 * counts.pairs and counts.met < 0.2 * 300 * 3000


# 2


def test_folding_undoes_disguises():
    assert toxicity.fold("ІDI0T, M0r0n! 5tup1d ѕсum 2018") == ["idiot", "moron", "stupid", "scum", "2018"]


def test_lexicon_matches_like_a_plain_scan():
    lex = toxicity.Lexicon({" idiot ": 3.0, " achl": 1.0, " achlich ": 2.0}, ("trash can",), curve=(-2.0, 2.0))
    assert lex.sums("An IDI0T achlichen achlich idiotic") == (6.0, 5)
    full = toxicity.Lexicon({" trash ": 3.0}, ("trash can",))
    assert full.sums("trash can trash") == (3.0, 3)
    assert full.score(None) == full.score("") < full.score("trash")


def test_toxicity_learns_exceptions_from_clean_pairs(spark):
    rows = [(i, f"du gruk mensch nummer{i}", 1) for i in range(40)] + [(100 + i, f"der gruk fisch schwimmt tag{i}" if i < 6 else f"ein ruhiger tag{i} am see", 0) for i in range(200)]
    rows += [(400 + i, f"gruk boot{i % 2}", 0) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lex = toxicity.learn(df.drop("toxic"), df.drop("text"))
    assert " gruk " in lex.entries and " gruk fisch " in lex.exceptions and " gruk mensch " not in lex.exceptions
    assert lex.sums("Ein GRUK Fisch")[0] == 0 < lex.sums("gruk mensch")[0]
    assert lex.sums("gruk boot1")[0] > 0  # in too few clean rows


def plain_toxicity(train):
    """Weights of entries, exceptions, and a function for the sum of a text, from (label, text) rows, word by word."""
    hits, rows = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    pairs, words_of, n_rows = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}, {0: 0, 1: 0}
    entries_of = lambda w: [f" {w} "] + [f" {w[:n]}" for n in (4, 5, 6, 7) if len(w) > n]
    for label, t in train:
        ws = toxicity.fold(t or "")
        words_of[label] += len(ws)
        n_rows[label] += 1
        own = Counter(e for w in ws for e in entries_of(w))
        hits[label].update(own)
        rows[label].update(own.keys())
    found = {}
    for e in hits[1]:
        weight = math.log((hits[1][e] + 0.1) / words_of[1]) - math.log((hits[0][e] + 0.5) / words_of[0])
        spread = math.log((rows[1][e] + 0.5) / (n_rows[1] + 1)) - math.log((rows[0][e] + 0.5) / (n_rows[0] + 1))
        off = 2.0 * math.sqrt(1 / (rows[1][e] + 0.5) + 1 / (rows[0][e] + 0.5))
        if weight > max(1.2, off) and spread > off:
            found[e] = weight - off
    entries = {e: w for e, w in found.items() if not any(w <= found.get(e[: n + 1], -1.0) + 0.05 for n in (4, 5, 6, 7) if n + 1 < len(e))}
    for label, t in train:
        ws = toxicity.fold(t or "")
        pairs[label].update({f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False) if any(e in entries for w in (a, b) for e in entries_of(w))})
    clean = {f" {p} " for p, n in pairs[0].items() if n >= 4 and p not in pairs[1]} | {" " + " ".join(toxicity.fold(x)) + " " for x in toxicity.EXCEPTIONS}

    def total(text):
        ws = toxicity.fold(text or "")
        got = 0.0
        for i, w in enumerate(ws):
            around = [" " + " ".join(ws[i - back : i - back + n]) + " " for n in (1, 2, 3) for back in range(n) if i - back >= 0 and i - back + n <= len(ws)]
            if not any(x in clean for x in around):
                got += max(entries.get(e, 0.0) for e in [f" {w} ", *[f" {w[:n]}" for n in (4, 5, 6, 7)]])  # a word begins with itself
        return got, len(ws)

    return entries, clean, total


def test_toxicity_like_a_plain_version(spark):
    big = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    train = [(y, docs[i]) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2 and i in docs]
    entries, clean, total = plain_toxicity(train)
    seen = spark.read.parquet(f"{big}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    lex = toxicity.learn(seen, spark.read.parquet(f"{big}/labels.parquet"))
    assert lex.entries == pytest.approx(entries) and set(lex.exceptions) == clean and len(entries) > 5
    a, b = lex.curve
    for r in toxicity.op2_toxicity(spark, big).collect():
        s, n = total(docs[r["doc_id"]])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(a + b * math.log1p(s / (1 + n / 40))))), abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_words_of_any_length_and_many_entries_are_learnt(spark):
    long = "schimpf" * 12
    rows = [(i, f"du {long} tag{i}", 1) for i in range(40)] + [(100 + i, f"ein ruhiger tag{i} am see", 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert any(e.strip() in long for e in toxicity.learn(df.drop("toxic"), df.drop("text")).entries)
    marks = [f"{a}{b}{c}{d}" for a in "bdfgklmnpr" for b in "aeiou" for c in "bdfgklmnpr" for d in "aeiouxyzqw"]
    rows = [(i, " ".join(marks), 1) for i in range(12)] + [(100 + i, "ein ruhiger tag am see " * 400, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert len(toxicity.learn(df.drop("toxic"), df.drop("text")).entries) == 5000


def test_toxicity_on_held_out_rows(spark, docs):
    big = "/root/testdata/sf0.01"
    got = toxicity.op2_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = [r for r in got if r["toxic"] == 1]
    assert sum(r["predicted"] for r in hit) >= 0.6 * len(hit)
    assert sum(r["predicted"] for r in got if r["toxic"] == 0) <= 0.05 * len(got)


def test_toxicity_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for d in (odd, empty):
        lex = toxicity.learn(d, labels)
        assert toxicity.score(d.withColumn("score", F.lit("x")), lex).count() == d.count()
    assert toxicity.learn(odd, labels.limit(0)).curve[1] == 0.0


# 3


def test_packing_is_a_gapless_exact_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    cut = written(packing.pieces(docs.select("doc_id", "text"), with_ids=True), "pieces")
    got = packing.pack(cut, per_task=60, open_bins=4).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[r["doc_id"]], key=lambda x: x["piece"])
        assert b"".join(bytes(x["ids"]) for x in own) == ids.tobytes()
        assert [x["ids_crc32"] for x in own] == [zlib.crc32(ids[i : i + 4096].tobytes()) for i in range(0, len(ids), 4096)]
        assert [x["start"] for x in own] == list(range(0, len(ids), 4096))
    total = sum(r["length"] for r in got)
    for places in by_seq.values():
        end = 0
        for off, n in sorted(places):
            assert off == end
            end += n
        assert end <= 4096
    assert len(by_seq) <= 1.15 * total / 4096 + 4


def coded(coder, texts):
    data, at = tx.text_buffer(pa.array(texts, pa.string()))
    ids, ends = coder.encode(data, at)
    return [ids[a:z].tolist() for a, z in zip(ends[:-1], ends[1:], strict=True)]


def test_packing_ids_are_those_of_the_tokenizer():
    coder = packing.Coder(packing.VOCABULARY)
    texts = [None, "", " \n", "A, b.c...  d", "don't 's '.s we'll!", "le\u00e8, \u00d7. \u00c9T\u00c9-x (a\u2026,b)", "1,234.5% e@f.g/h?i=j", "x<|endoftext|>, <|ENDOFTEXT|>Y <| z"]
    texts += ["H\u0331 W\u030a x", "T\u0308. J\u030c", "H\u0323\u0331 A\u030a", "a\u0331, B=\u0338", "\u0130 \u212a \u03a3\u03c2", "\u0085a\u00a0b\u3000c\x1cd"]  # small letters compose, or not
    rng = np.random.default_rng(3)
    signs = [*"abTHJs019.,'$|<> \t\n", "\u0308", "\u0331", "\u00e9", "\u00c9", "\u00d7", "\u00bd", "\u2019", "\u4e2d", "<|endoftext|>"]
    texts += ["".join(rng.choice(signs, rng.integers(0, 20))) for _ in range(2000)]
    want = [coder.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert coded(coder, texts) == want
    coder.forget()
    coder.closes[:] = False  # a vocabulary without ids that end a unit
    assert coded(coder, texts) == want


def test_packing_composes_accents_before_case(spark):
    texts = ["H\u0331ello W\u030a x", "T\u0308. J\u030c"]
    t = packing._tokenizer(packing.VOCABULARY)
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == {k: [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in enumerate(texts)}


def test_packing_encodes_a_part_once_and_plain_ones_by_merges_alone(monkeypatch):
    seen = []
    for name in ("_plain", "_any"):
        own = getattr(packing.Coder, name)
        monkeypatch.setattr(packing.Coder, name, lambda self, parts, own=own, name=name: seen.append((name, sorted(parts))) or own(self, parts))
    coder = packing.Coder(packing.VOCABULARY)
    first = coded(coder, ["The cat, the hat\u00e9.", "cat 7"])
    assert seen == [("_plain", [",", ".", "cat", "hat\u00e9", "the"]), ("_any", ["7"])]
    assert coded(coder, ["CAT 7", "new"])[0] == first[1]
    assert seen[2:] == [("_plain", ["new"]), ("_any", [])]
    monkeypatch.setattr(packing, "PARTS_HELD", 2)
    assert coded(coder, ["cat 7"])[0] == first[1] and len(coder.held) == 2


def test_bins_choose_the_tightest_and_close_the_fullest():
    b = packing.Bins(10, 2)
    assert [b.put(6), b.put(5), b.put(4), b.put(5)] == [(0, 0), (1, 0), (0, 6), (1, 5)]
    assert b.closed == [0, 1] and b.open == 0
    b = packing.Bins(10, 2)
    b.put(9), b.put(8), b.put(7)
    assert b.closed == [0]


def test_packing_of_odd_rows(spark, odd, empty):
    got = packing.pack(written(packing.pieces(odd.select("doc_id", "text", F.lit(1).alias("length"), F.lit(2).alias("bin"))), "p")).collect()
    lengths = Counter()
    for r in got:
        lengths[r["doc_id"]] += r["length"]
    assert lengths[1] == lengths[2] == lengths[3] == lengths[7] == 1 and lengths[5] == 2 * lengths[4]
    assert packing.pack(written(packing.pieces(empty.select("doc_id", "text")), "p")).count() == 0


# 4


def plain_licence(text, t):
    def grams(s):
        w = "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in s).split()
        return Counter(zip(w, w[1:], strict=False))

    lines = (text or "").split("\n")
    found = None
    for segment in [*lines, text or ""]:
        g = grams(segment)
        for name, template in licenses.TEMPLATES.items():
            a = grams(template)
            dice = 2 * sum((a & g).values()) / (a.total() + g.total()) if g else 0
            if dice >= t and (found is None or (dice, a.total()) > found[:2]):
                found = (dice, a.total(), name)
    return found and (found[2], round(found[0], 9))


def test_licences_like_a_plain_scan(spark, docs):
    noisy = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "x\nReleased under the MIT License\ny"), (-2, licenses.TEMPLATES["MIT-text"].replace("deal in", "deal with")), (-3, "released under")], "doc_id long, text string"))
    got = {r["doc_id"]: r["license"] and (r["license"], round(r["dice"], 9)) for r in licenses.scan(noisy).collect()}
    assert got == {r["doc_id"]: plain_licence(r["text"], 0.85) for r in noisy.collect()}
    assert sum(v is not None for v in got.values()) > 2


def test_licences_inside_other_text(spark):
    """Templates in their standard layout between other paragraphs, inside a line, wrapped, and several in one document."""
    code, t = " ".join(f"word{i}" for i in range(120)), licenses.TEMPLATES
    laid = {n: s.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS").replace(" Unless", "\n\nUnless").replace(" You should", "\n\nYou should") for n, s in t.items()}
    texts = [f"{code}\n\n{s}\n\n{code}" for s in laid.values()] + [f"é {code} {s.replace(' ', chr(10), 2)} {code}" for s in t.values()]
    texts.append(f"{code} {laid['MIT-text']} {code}\n{t['GPL-3.0']} {code} {t['GPL-3.0']}\n{code} {t['CC-BY-SA-4.0']}")
    got = {r["i"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()}
    for i, name in enumerate([*t, *t]):
        (w,) = got[i]["licenses"]
        assert (w["license"], w["dice"]) == (got[i]["license"], got[i]["dice"]) == (name, 1.0)
        inside = texts[i].encode()[w["start_byte"] : w["end_byte"]].decode()
        assert re.findall(r"\w+", inside) == re.findall(r"\w+", t[name])
    assert [w["license"] for w in got[len(texts) - 1]["licenses"]] == ["MIT-text", "GPL-3.0", "GPL-3.0", "CC-BY-SA-4.0"]


def test_licence_windows_like_all_windows():
    """Every window of random texts over a template's words against the search from starts."""
    import numpy as np

    rng, template = np.random.default_rng(1), "a b c a b d e a b"
    scan = licenses.Templates({"T": template}, 0.7)
    bag = Counter(zip(template.split(), template.split()[1:], strict=False))
    for _ in range(300):
        ws = rng.choice(list("aabbcdex"), rng.integers(2, 30)).tolist()
        pairs = list(zip(ws, ws[1:], strict=False))
        dice = [2 * sum((bag & Counter(pairs[i:j])).values()) / (8 + j - i) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1)]
        part = np.frombuffer(" ".join(ws).encode(), np.uint8)
        got = licenses._scan(part, np.array([0, len(part)]), scan).get(0, [])
        assert max((w[0] for w in got), default=0.0) == pytest.approx(max(dice) if max(dice) >= 0.7 else 0.0)


def test_licences_of_odd_rows(odd, empty):
    got = licenses.scan(odd.withColumn("license", F.lit("x"))).collect()
    assert len(got) == len(ODD) and all(r["license"] is None for r in got)
    assert licenses.scan(empty).count() == 0


# 5


def water_filled(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        t = {s: most * sizes[s] if s in capped else left * w[s] / free for s in names}
        new = {s for s in names if s not in capped and t[s] > most * sizes[s]}
        if not new:
            return t
        capped |= new


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix_hits_its_targets(spark, request, which):
    rows = request.getfixturevalue(which)
    got = mixing.copies(mixing.sized_rows(rows, ["doc_id"]), ["doc_id"]).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3 and (r["size"] > 0 or r["copies"] == 0)
    assert sum(sizes.values()) == sum(len(words(r["text"])) for r in rows.collect()) and len(got) == rows.count()
    want = water_filled(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        if which == "docs":
            assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 100


@pytest.mark.parametrize("rate", [0.45, 0.6, 1.4])
def test_mix_rounds_heavy_documents_well(spark, rate):
    """Ten documents hold 43 % of a source's words; a null source brings the rate about."""
    sizes = [20 + i * 7919 % 23 for i in range(6000)]
    sizes += [sum(sizes) * 43 // 570] * 10
    other = round((3 * rate - 1) * sum(sizes)) // 40
    rows = [("a", n) for n in sizes] + [(None, 30 + i % 21) for i in range(other)]
    sized = spark.createDataFrame([(i, s, n, i) for i, (s, n) in enumerate(rows)], "doc_id long, source string, size long, row long")
    got = mixing.copies(written(sized.withColumn("turn", F.xxhash64("row")), "heavy"), ["doc_id"]).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    for s in ("a", None):
        taken = sum(r["size"] * r["copies"] for r in got if r["source"] == s)
        target = next(r["target"] for r in got if r["source"] == s)
        assert abs(taken - target) <= 30
    assert next(r["target"] for r in got if r["source"] == "a") == pytest.approx(rate * sum(sizes), rel=0.02)


def test_mix_of_nothing(empty):
    assert mixing.copies(mixing.sized_rows(empty, ["doc_id"]), ["doc_id"]).count() == 0


@pytest.mark.parametrize("target", [0.05, 0.7, 1.0, 1.9, 2.999])
def test_newton_solves_the_dual(spark, target):
    """Against bisection: rates min(3, exp(m n / mean)) of the sizes 1 to 2000 take the target's words."""
    n = np.arange(1, 2001)
    targets = spark.createDataFrame([("a", int(n.sum()), len(n), float(target * n.sum())), ("full", 10, 2, 30.0), ("none", 0, 2, 0.0)], "source string, source_size long, documents long, target double")
    sizes = written(spark.createDataFrame([("a", int(x), 1) for x in n] + [("full", 5, 2)], "source string, size long, n long"), "sizes")
    got = {r["source"]: r["multiplier"] for r in mixing.multipliers(sizes, targets).collect()}
    low, high = -500.0, 5000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (n * np.minimum(3, np.exp(np.minimum(mid * n / n.mean(), 9)))).sum() < target * n.sum() else (low, mid)
    assert got == {"a": pytest.approx(mid, rel=1e-6, abs=1e-7), "full": None, "none": None}


def test_a_dual_that_is_not_solved_is_an_error(spark):
    targets = spark.createDataFrame([("a", 5050, 100, 4000.0)], "source string, source_size long, documents long, target double")
    sizes = written(spark.createDataFrame([("a", x, 1) for x in range(1, 101)], "source string, size long, n long"), "sizes")
    with pytest.raises(ArithmeticError):
        mixing.multipliers(sizes, targets, steps=1).collect()


def test_rows_that_repeat_everything_are_spread(spark):
    """A third of all rows have one id, source and text: many groups, and targets are met."""
    rows = [(7, "one two three", "a")] * 2000 + [(i, "word " * (1 + i % 50), "ab"[i % 2]) for i in range(4000)]
    sized = mixing.sized_rows(written(spark.createDataFrame(rows, "doc_id long, text string, source string"), "rows"), ["doc_id"])
    assert sized.where("doc_id = 7 and size = 3").select("turn").distinct().count() > 1900
    got = mixing.copies(sized, ["doc_id"]).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 60 for r in got)


def test_mix_does_not_depend_on_how_files_are_split(spark):
    seen = []
    for most in ("4m", "40k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = mixing.op5_entropy_mix(spark, "/root/testdata/sf0.01").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        seen.append(Counter((r["doc_id"], r["size"], r["target"], r["taken"]) for r in got))
    assert seen[0] == seen[1] and seen[0].total() > 900


# 6


@pytest.mark.parametrize("most", [64, 4096])
@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_shards_balance_and_number_their_rows(spark, request, which, most):
    """With all groups in one round, and in several rounds of blocks of 30."""
    rows = request.getfixturevalue(which)
    got = sharding.shard(rows, ["doc_id"], most=most, block_items=30, cell_rows=7).collect()
    assert len(got) == rows.count()
    slots, load, groups = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if which == "docs":
        assert max(load.values()) - min(load.values()) <= (0.02 if most > 64 else 0.1) * sum(load.values()) / 8
        assert all(len(s) == 1 for s in groups.values())
        want = Counter((r["doc_id"], len(r["text"].encode()) + 1, zlib.crc32(r["text"].encode())) for r in rows.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_many_groups_stay_whole_in_rounds_of_blocks(spark):
    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.lit("x"), (F.col("id") % 4001 % 97).cast("int")), F.pmod("id", F.lit(4001)).cast("string")).alias("text"))
    got = sharding.shard(rows, ["doc_id"], most=256, block_items=200).toPandas()
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1 and len(got) == 12_000
    for c in ("size", "tokens"):
        load = got.groupby("shard")[c].sum()
        assert load.max() - load.min() <= (0.03 if c == "size" else 0.05) * load.mean()


def test_a_hot_group_is_split(spark):
    rows = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(600)], "doc_id long, text string")
    load = Counter()
    for r in sharding.shard(rows, ["doc_id"], most=128).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) <= 1.1 * min(load.values())
    whole = sharding.shard(rows, ["doc_id"], split_above=None).where("size = 10")
    assert whole.where("doc_id % 3 = 0").select("shard").distinct().count() == 1


@pytest.mark.parametrize(("heavy", "split"), [([0.9], 0), ([0.9, 0.8, 0.7], 0), ([0.7] * 9, 1), ([1.2, 0.9], 1)])
def test_groups_up_to_a_shard_stay_whole(spark, heavy, split):
    """Only what fits nowhere is torn apart, and bytes are near equal all the same."""
    shard_bytes, rows = 16_000, []
    for g, share in enumerate(heavy):
        rows += [f"group {g} ".ljust(99, "x")] * int(share * shard_bytes / 100)
    rest = 8 * shard_bytes - sum(len(t) + 1 for t in rows)
    rows += [f"text {i}".ljust(49, "y") for i in range(rest // 50)]
    got = sharding.shard(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), ["doc_id"]).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() <= 0.03 * load.mean()
    at = got[got["size"] == 100].groupby("text_crc32")["shard"].nunique()
    assert len(at) == len(heavy) and (at > 1).sum() == split


def plain_shards(groups, bins):
    """Largest first, to the bin whose residual capacity has the highest dot product with the group; where none has room, the emptiest."""
    totals = [sum(g[k] for g in groups) for k in range(3)]
    left, out = [[1 / bins] * 3 for _ in range(bins)], [0] * len(groups)
    for i in sorted(range(len(groups)), key=lambda i: (-groups[i][0], i)):
        share = [x / t for x, t in zip(groups[i], totals, strict=True)]
        room = [b for b in range(bins) if left[b][0] >= share[0]]
        best = max(room, key=lambda b: (2 * left[b][0] * share[0] + left[b][1] * share[1] + left[b][2] * share[2], -b)) if room else max(range(bins), key=lambda b: (left[b][0], -b))
        out[i] = best
        left[best] = [x - y for x, y in zip(left[best], share, strict=True)]
    return out


def test_placement_like_a_plain_greedy_one(spark):
    """The numbers of a whole round, and the shards of all documents: groups by hash, in one round."""
    rng = np.random.default_rng(4)
    items = rng.integers(1, 1000, size=(200, 3))
    assert sharding.place(items.astype(float), 8)[0].tolist() == plain_shards(items.tolist(), 8)
    texts = [f"w{i} " * int(rng.integers(1, 40)) for i in range(120)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = df.select("doc_id", F.xxhash64(F.col("text").isNull(), F.md5(F.col("text").cast("binary"))).alias("group")).collect()
    groups = sorted({r["group"] for r in keyed})
    loads = [[sum(f(texts[r["doc_id"]]) for r in keyed if r["group"] == g) for f in (lambda t: len(t) + 1, lambda t: len(words(t)), lambda t: 1)] for g in groups]
    want = dict(zip(groups, plain_shards(loads, 8), strict=True))
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(df, ["doc_id"]).collect()}
    assert got == {r["doc_id"]: want[r["group"]] for r in keyed}


# 7 and 10


def plain_counts(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = [x for x in text.split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_text_counts_like_plain_ones(request, which):
    rows = request.getfixturevalue(which)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    got = sorted(_stats.with_counts(rows.select("doc_id", "text")).collect(), key=key)
    want = sorted(rows.collect(), key=key)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(r[c] for c in names) for r in got] == [plain_counts(r["text"]) for r in want]


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    accuracy = np.array([0.9, 0.95, 0.8, 0.85, 0.97])
    votes = np.where(rng.random((20_000, 5)) < accuracy, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    got = rules.estimate(patterns, n)
    assert got["good"] == pytest.approx(0.8, abs=0.02) and got["accuracy"] == pytest.approx(accuracy, abs=0.02)


def plain_posteriors(votes, start=0.8, prior=0.01, steps=200):
    """The same model, document by document: votes is a list of lists of -1, 0 and 1."""
    n = len(votes[0])
    cast = [[v[r] for v in votes if v[r] >= 0] for r in range(n)]
    overall = [(sum(x == 0 for x in c) + prior) / (len(c) + 2 * prior) for c in cast]
    drop, good = [[min(0.95, o * (1 - 0.2 * start) / (1 - start)) for o in overall], [0.2 * o for o in overall]], start
    post = [0.5] * len(votes)
    for _ in range(steps):
        new = []
        for v in votes:
            odds = math.log((1 - good) / good) + sum(math.log((drop[0][r] if x == 0 else 1 - drop[0][r]) / (drop[1][r] if x == 0 else 1 - drop[1][r])) for r, x in enumerate(v) if x >= 0)
            new.append(1 / (1 + math.exp(max(-700, min(700, odds)))))
        change, post = max(abs(a - b) for a, b in zip(new, post, strict=True)), new
        if change < 1e-9:
            break
        good = min(1 - 1e-6, max(1e-6, sum(post) / len(post)))
        for c in (0, 1):
            w = [p if c else 1 - p for p in post]
            drop[c] = [(sum(x for x, v in zip(w, votes, strict=True) if v[r] == 0) + prior) / (sum(x for x, v in zip(w, votes, strict=True) if v[r] >= 0) + 2 * prior) for r in range(n)]
    return post


def test_rule_verdicts_equal_plain_ones(spark, docs):
    counted = written(_stats.with_counts(docs.select("doc_id", "text")), "c")
    voted = {r["doc_id"]: list(r)[1:] for r in counted.select("doc_id", *[v.alias(n) for n, v in rules.rules().items()]).collect()}
    want = dict(zip(voted, plain_posteriors(list(voted.values())), strict=True))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = rules.op10_weak_rules(spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        plain = plain_counts(texts[r["doc_id"]])
        failed = plain[0] < 10 or 100 * plain[4] > 20 * plain[0]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain
        assert r["posterior"] == pytest.approx(want[r["doc_id"]], abs=1e-6)
        assert r["base_failed"] == failed and r["kept"] == (not failed and want[r["doc_id"]] >= 0.5)


def plain_quality(text, w, bias):
    """Score of one text by the linear model, from strings."""
    ws, shapes = words(text or ""), Counter()
    kinds = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else b
    for x in ws:
        k = [kinds(b) for b in x.encode()]
        shapes[bytes(v for i, v in enumerate(k) if i == 0 or v != k[i - 1])] += 1
    at = lambda data: int(tx.span_hash(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0]) % (1 << 14)
    total = bias + sum(w[at(s)] * math.sqrt(n / len(ws)) for s, n in shapes.items())
    data = np.frombuffer((text or "").encode(), np.uint8)
    c = {k: int(v[0]) for k, v in _stats.text_counts(data, np.array([0, len(data)])).items()}
    steps = [int(min(20 * c[a] // max(c[b], 1), 20)) + 64 * (k + 1) for k, (a, b) in enumerate(quality._STEPS)] + [int(min(math.log2(c["n_words"] + 1), 20))]
    for x in steps:
        total += 0.5 * w[int(tx.mix(np.array([x], np.uint64) + tx.BASE)[0]) % (1 << 14)]
    return 1 / (1 + math.exp(-max(-40, min(40, total))))


def test_quality_like_a_plain_version(spark, docs):
    """Labels by the plain model, weights by a plain gradient check, scores from strings."""
    model = quality.learn(docs.select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in quality.op7_weak_quality(spark, DIR).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert got[i]["quality"] == pytest.approx(plain_quality(t, *model), abs=1e-9) and got[i]["kept"] == (got[i]["quality"] >= 0.5)
    counted = written(_stats.with_counts(docs.select("doc_id", "text")), "c")
    voted = {r["doc_id"]: list(r)[1:] for r in counted.select("doc_id", *[v.alias(n) for n, v in rules.rules().items()]).collect()}
    y = dict(zip(voted, plain_posteriors(list(voted.values())), strict=True))
    loss = lambda bias: -sum(y[i] * math.log(plain_quality(t, model[0], bias)) + (1 - y[i]) * math.log(1 - plain_quality(t, model[0], bias)) for i, t in texts.items())
    assert loss(model[1]) < min(loss(model[1] - 0.5), loss(model[1] + 0.5)) and loss(model[1]) < 0.25 * len(texts)


def test_quality_against_labels(spark):
    big = "/root/testdata/sf0.01"
    got = quality.op7_weak_quality(spark, big).withColumnRenamed("quality", "p").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    assert got.loc[got["quality"] == 1, "kept"].mean() > 0.95 and got.loc[got["quality"] == 0, "kept"].mean() < 0.15


def test_quality_and_rules_of_odd_rows(odd, empty):
    for d in (odd, empty):
        assert quality.score(d.withColumn("quality", F.lit("x")), quality.learn(d)).count() == d.count()
        own = d.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("pattern", "__pattern", "posterior", "code")])
        got = rules.judged(written(_stats.with_counts(own), "c")).collect()
        assert len(got) == d.count() and all(r["pattern"] == r["__pattern"] == r["code"] == "x" and 0 <= r["posterior"] <= 1 for r in got)


# 8


@functools.cache
def shingle_bag(text):
    w = words(text.translate({c: c + 32 for c in range(65, 91)}))
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def plain_similarity(t, u):
    """The greater of the plain and the weighted similarity of two texts' shingles."""
    a, b = shingle_bag(t), shingle_bag(u)
    both = a.keys() & b.keys()
    c = sum(min(a[x], b[x]) for x in both)
    return max(len(both) / max(1, len(a) + len(b) - len(both)), c / max(1, a.total() + b.total() - c))


def plain_classes(rows, threshold=0.8):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sizes = {i: len(words(t)) for i, t in rows}
    for k, (i, t) in enumerate(rows):
        for j, u in rows[:k]:
            if t is not None and u is not None and (t == u or min(sizes[i], sizes[j]) > 0.5 * max(sizes[i], sizes[j]) - 9 and plain_similarity(t, u) >= threshold - 1e-9):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, _ in rows:
        members[find(i)].append(i)
    return {i: min(m) for m in members.values() for i in m}


def edited_copies(rng, base, n, most):
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        yield " ".join(copy)


def test_near_duplicate_classes_like_all_pairs(spark, docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").where("length(text) < 2000").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(edited_copies(rng, base, 80, 4))]
    rows += [(20_000, "short text"), (20_001, "short text"), (20_002, ""), (20_003, ""), (20_004, None), (20_005, None), (20_006, "Short  text")]
    line = " ".join(f"v{i}" for i in range(20))  # texts that repeat themselves: alike by set, by weight, by neither
    rows += [(30_000, " ".join([line] * 9)), (30_001, " ".join([line] * 5)), (30_002, " ".join([*[line] * 8, "a b c d e f g h i j", line])), (30_003, " ".join([line.replace("v3", "q")] * 9))]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()
    want = plain_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert want[30_001] == want[30_002] == 30_000 != want[30_003]


@pytest.mark.parametrize("pivots", [0, 2])
def test_links_of_a_large_group_are_found_whatever_the_pivots(spark, pivots):
    """A group in which many pairs are just below or above the threshold; the last round alone has to find what pivots don't."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = list(enumerate(edited_copies(rng, base, 220, 9)))
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", pivots=pivots).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == plain_classes(rows)


def test_banding_finds_nine_of_ten_links_alone(spark):
    """Pairs of similarity 0.8 to 0.85, each pair of its own text: what the bands miss no later step finds."""
    rng, rows = random.Random(9), []
    while len(rows) < 600:
        base = [f"w{rng.randrange(50_000)}" for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(5, 195), 4):
            copy[at] = f"x{rng.randrange(10_000)}"
        if 0.8 <= plain_similarity(" ".join(base), " ".join(copy)) <= 0.85:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, len(rows), 2)) >= 0.99 * len(rows) / 2


def test_parity_bits_never_tell_more_than_the_texts_differ():
    rng = np.random.default_rng(4)
    e = rng.integers(1, 1 << 62, 500).astype(np.uint64)
    for n, m in ((300, 280), (64, 64), (500, 400), (1, 1)):
        a, b = e[:n], e[-m:]
        bits, size = minhash.parity(np.concatenate([a, b]), np.array([n, m]))
        x, y = bits[: size[0]], bits[size[0] :]
        while len(x) != len(y):
            x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
        assert np.unpackbits((x ^ y).view(np.uint8)).sum() <= len(np.setxor1d(a, b))


def test_a_path_of_links_contracts_in_few_rounds(spark):
    labels = written(spark.range(300).select(F.col("id").alias("node"), F.col("id").alias("label")), "labels")
    links = written(spark.range(299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), "links")
    assert [r["label"] for r in minhash.contract(links, labels).select("label").distinct().collect()] == [0]


def test_weighted_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    e = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    wa, wb = rng.uniform(0.1, 3, 400), rng.uniform(0.1, 3, 400)
    sig = minhash.dart_signatures(np.concatenate([e, e]), np.concatenate([wa, wb]), np.array([400, 400]), 2048)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.05)


def test_near_duplicates_of_odd_rows(odd, empty):
    for name in ("n", "node", "bucket", "row_number", "_metadata", "at", "key", "__row"):
        odd = odd.withColumn(name, F.lit("x"))
    got = minhash.deduplicated(odd).collect()
    assert all(r["row_number"] == r["_metadata"] == r["__row"] == "x" for r in got)
    assert Counter(r["doc_id"] for r in got) == Counter([1, 2, 3, 4, 6, 7, 8, 9, None])
    assert minhash.deduplicated(empty).count() == 0 and minhash.deduplicated(empty).columns == empty.columns


# 9


def plain_ppm(train, text, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        s = bytes([254] * order) + (t or "").encode() + b"\xff"
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[j][s[i - j : i]][s[i]] += 1
    s, total = bytes([254] * order) + (text or "").encode() + b"\xff", 0.0
    for i in range(order, len(s)):
        gone = set()
        for j in range(order, -1, -1):
            node = counts[j].get(s[i - j : i])
            if node is None:
                continue
            live = {k: n for k, n in node.items() if k not in gone}
            room = sum(live.values())
            if s[i] in live:
                total += math.log10((live[s[i]] - 0.5) / room)
                break
            if live:
                total += math.log10(0.5 * len(live) / room)
            gone |= set(node)
        else:
            total -= math.log10(max(256 - len(gone), 1))
    return total


def plain_base(train, text):
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    c = Counter(w for t in train for w in words(low(t)))
    n, v = c.total() + len(train), len(c) + bool(train)
    own = words(low(text))
    return sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(train) + 1) / (n + v + 1)), len(own) + 1, sum(c[w] > 0 for w in own) + bool(train), n


def test_ppm_like_a_plain_model(spark, docs):
    rows = [(r["doc_id"], r["text"][:300]) for r in docs.orderBy("doc_id").limit(60).collect()] + [(1000, None), (1001, ""), (1002, "ééé   unseen"), (1003, "unseen rare")]
    train = [t for i, t in rows if i % 5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = ppm.train(df.where("doc_id % 5 <> 0"), order=3, common=0.01)
    got = {r["doc_id"]: r for r in ppm.score(df.withColumn("score", F.lit("clash")), model).collect()}
    for i, t in rows:
        base, n, known, tokens = plain_base(train, t)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, tokens)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] == pytest.approx(plain_ppm(train, t, 3), rel=1e-5, abs=1e-4)


def test_ppm_keeps_rare_paths_of_a_large_corpus(spark):
    """Of 24 MB, a path met once is a share of 4e-8: known all the same, so each byte after the first costs one bit."""
    rare, n = "QWERTYUIOPASDFGHJKLZ", 2000
    df = spark.range(n).select("id", F.repeat(F.lit("abc def gh. "), 1000).alias("text")).unionByName(spark.createDataFrame([(-1, rare)], "id long, text string"))
    got = ppm.score(df.where("id < 0"), ppm.train(df)).first()
    assert got["score"] == pytest.approx(math.log10(0.5 / (n + 1)) + len(rare) * math.log10(0.5), rel=1e-6)


def test_ppm_beats_the_base_on_held_out_rows(spark):
    got = ppm.op9_ppm_lm(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_ppm_of_odd_rows(odd, empty):
    for train, rows in ((odd, odd), (empty, odd), (empty, empty)):
        for name in ("__row", "__known", "__base", "__text", "c0", "key", "score"):
            rows = rows.withColumn(name, F.lit("x"))
        got = ppm.score(rows, ppm.train(train)).collect()
        assert len(got) == rows.count() and all(r["__row"] == r["c0"] == "x" for r in got)
        assert len(got) == rows.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
