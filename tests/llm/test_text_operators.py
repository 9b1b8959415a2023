"""BPE, ORC ids, decontamination, quality trees and sharding against the library or brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfkin.llm import bpe, fm_decontam, jump_shards, orc_ids, quality_gbdt
from shelfkin.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n=3000):
    random.seed(1)
    bits = ["a", "b", " ", "  ", "\n", "\t", " \n", "'s", "'ll", "1", "²", "½", "é", "́", "漢", "字", "一", "Ⅷ", " ", " ", "\x1c", "\x85", "_", "--"]
    bits += ["!!", "<|endoftext|>", "<|endof", "😀", "the", "ing", "THE", "İ", "ǅ", "٣", "​", "﻿", "𝟘", "ɐ", "\x0b"]
    return ["".join(random.choice(bits) for _ in range(random.randint(0, 40))) for _ in range(n)]


def test_speculative_bpe_equals_library(library):
    table, texts = bpe.Bpe(PATH), odd_texts()
    texts += ["".join(random.choice("etaoinshr") for _ in range(random.randint(1, 30))) for _ in range(3000)]
    texts += ["ab" * 20_000, "x" * 5_000, "", " ", "the " * 3000]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = table.encode(texts)
    assert [g.tolist() for g in got] == expected
    assert 0 < table.stats["merged"] < table.stats["chunks"]
    assert [table.decode(g) for g in got] == library.decode_batch(expected, skip_special_tokens=False)


def test_pair_check_equals_merging():
    table = bpe.Bpe(PATH)
    random.seed(4)
    pairs = [(random.randrange(50256), random.randrange(50256)) for _ in range(3000)]
    pairs += [(a, b) for (a, b) in list(table.rank_of)[:300]]
    exact = [m == [a, b] for (a, b), m in zip(pairs, table.merge([table.token_bytes[a] + table.token_bytes[b] for a, b in pairs]), strict=True)]
    assert table.compatible(*np.array(pairs).T).tolist() == exact
    words = ["".join(random.choice("abcab ") for _ in range(random.randint(1, 60))).encode() for _ in range(300)]
    assert table.merge(words) == [table.merge_long(w) for w in words]


def test_ids_that_are_no_text(library):
    table = bpe.Bpe(PATH)
    random.seed(5)
    ids = [[random.randrange(50257) for _ in range(random.randint(0, 8))] for _ in range(500)]
    assert [table.decode(np.array(i, int)) for i in ids] == library.decode_batch(ids, skip_special_tokens=False)


def test_round_trip_rows(spark, library):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "ü" * 90_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = bpe.round_trip_digests(df, PATH).drop("text").collect()
    for row, (doc, text, _) in zip(got, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert tuple(row) == (doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0
    both = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH).select("text", "decoded").collect()
    assert all((r["text"] or "") == r["decoded"] for r in both)


def test_rank_encoder_equals_library(library):
    texts = [*odd_texts(), "ab" * 20_000, "x" * 30_000, " " * 5000, "a" * 100 + "\n" * 3000, ""]
    got = orc_ids.RankEncoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_orc_files(spark, library, tmp_path):
    rows = [(5, "five five"), (1, "one <|endoftext|> x"), (None, "none"), (3, None), (2, ""), (9, "long  text\n\n " * 3000), (5, "again")]
    path = str(tmp_path / "ids")
    orc_ids.write_ids(spark.createDataFrame(rows, DOCS), PATH, path)
    got = {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in orc_ids.file_report(spark, path).collect()}
    start, expected = 0, set()
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        expected.add((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    assert {r["doc_id"] for r in orc_ids.find_ids(spark, path, [3, 9, 77]).collect()} == {3, 9}
    assert {r["doc_id"] for r in orc_ids.read_ids(spark, path, 2, 5).collect()} == {2, 3, 5}
    orc_ids.write_ids(spark.createDataFrame([], DOCS), PATH, str(tmp_path / "empty"))
    assert orc_ids.file_report(spark, str(tmp_path / "empty")).count() == 0


def test_orc_plan_pushes_ids_down(spark, tmp_path):
    path = str(tmp_path / "ids")
    orc_ids.write_ids(spark.createDataFrame([(k, "text") for k in range(100)], DOCS), PATH, path)
    plan = orc_ids.find_ids(spark, path, [7])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "doc_id" in plan.split("PushedFilters")[1].split("]")[0]


def test_orc_query_equals_library(spark, sf, library):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    start, expected = 0, {}
    for doc, text in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        expected[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op7_orc_token_ids"](spark, sf).collect()} == expected


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items):
    windows = {}
    for item, text in items:
        words = split_words(text)
        for k in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[k : k + 13]), set()).add(item)
    out = []
    for text in docs:
        words, hit, found = split_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if (w := tuple(words[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[w]
        out.append((len(words), hit, sorted(found)))
    return out


def test_fm_index_equals_brute_force():
    random.seed(3)
    for _ in range(60):
        letters = "abcd"[: random.randint(1, 4)]
        items = [(str(i), " ".join(random.choice(letters) for _ in range(random.randint(0, 20)))) for i in range(5)]
        docs = [" ".join(random.choice(letters + "e" * random.randint(0, 1)) for _ in range(random.choice([0, 1, 5, 200]))) for _ in range(20)]
        counts, spans, found = fm_decontam.scan_shard([d.encode() for d in docs], fm_decontam.Windows(items, 13))
        got = [(c, {k for a, b in s for k in range(a, b)}, i) for c, s, i in zip(counts, spans, found, strict=True)]
        assert got == brute_hits(docs, items)
        assert all(a[1] < b[0] for s in spans for a, b in zip(s, s[1:], strict=False))


CASES = [
    (1, "alpha BETA gamma, delta! " + "filler " * 60),
    (2, None),
    (3, ""),
    (4, "x " + " ".join(f"w{k}" for k in range(14)) + " y"),
    (4, "x " + " ".join(f"w{k}" for k in range(14)) + " y"),
    (None, "alpha beta gamma delta"),
    (6, "!!! ???"),
    (7, "word " * 30_000 + " ".join(f"w{k}" for k in range(13))),
    (8, "ß é alpha"),
]
ITEMS = [("9", "alpha beta gamma delta"), ("10", " ".join(f"w{k}" for k in range(15))), ("10", "ß é"), (None, "gamma delta"), ("e", ""), ("n", None)]


@pytest.mark.parametrize("block_words", [1_000_000, 8])
def test_decontamination_rows(spark, block_words):
    docs = spark.createDataFrame([(i, t, "x") for i, t in CASES], "doc_id bigint, text string, spans string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = fm_decontam.contamination_report(fm_decontam.find_contamination(docs, items, block_words=block_words)).collect()
    named = [(i or "", t) for i, t in ITEMS]
    expected = []
    for (doc, _), (n, hit, found) in zip(CASES, brute_hits([t for _, t in CASES], named), strict=True):
        expected.append((doc, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= n))
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_decontamination_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id string, text string")
    assert fm_decontam.find_contamination(docs, items).count() == 0
    some = fm_decontam.contamination_report(fm_decontam.find_contamination(spark.createDataFrame([(1, "a b")], DOCS), items)).first()
    assert (some["n_words"], some["n_hit"], some["contaminated"]) == (2, 0, False)
    kept = fm_decontam.remove_contaminated(spark.createDataFrame([(1, "a", "z"), (2, "b c", None)], "doc_id bigint, text string, n_words string"), spark.createDataFrame([("i", "a")], "item_id string, text string"))
    assert [tuple(r) for r in kept.collect()] == [(2, "b c", None)] and kept.columns == ["doc_id", "text", "n_words"]


def test_decontamination_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").cast("string"), "text").collect()]
    expected = {d: (n, len(hit), len(found)) for (d, _), (n, hit, found) in zip(docs, brute_hits([t for _, t in docs], items), strict=True)}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in QUERIES["op2_decontaminate"](spark, sf).collect()}
    assert got == expected and any(h for _, h, _ in got.values())


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_shards(spark):
    random.seed(2)
    rows = [(random.randrange(-(2**63), 2**63), "é" * (k % 5)) for k in range(500)] + [(None, None), (0, ""), (7, "same"), (7, "same"), (7, "other"), (2**63 - 1, "x" * 100_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, shard string")
    got = jump_shards.shard_rows(df, 24).collect()
    assert len(got) == len(rows)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    slots = {}
    for r in got:
        key = -(2**63) if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"], r["law"]) == (jump(key, 24), jump(key, 25), "key")
        assert r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert jump_shards.shard_rows(df.limit(0), 24).count() == 0
    one = spark.range(50).select(jump_shards.jump_shards(F.col("id"), 1).alias("j")).select("j.*").collect()
    assert {r["shard"] for r in one} == {0} and {r["grown_shard"] for r in one} == {0, 1}
    with pytest.raises(ValueError):
        jump_shards.jump_shards(F.lit(1), 0)


def test_shards_plan_is_native(spark, sf):
    df = QUERIES["op8_jump_shards"](spark, sf)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_statistics():
    names = dict(zip(quality_gbdt.FEATURES, quality_gbdt.features([b"A b b B.\nA b b B.\nc"])[0], strict=True))
    assert names["distinct_words"] == 4 / 9 and names["top_word"] == 4 / 9
    assert names["repeated_word"] == 2 / 9 and names["longest_repeat"] == 2 / 9
    assert names["distinct_lines"] == 2 / 3 and names["top_line"] == 2 / 3
    assert names["words_a_line"] == 3 and names["kind_1"] == 4 / 19 and names["kind_4"] == 2 / 19
    many = [b"", b"x", b" \n", "ü".encode() * 40_000, b"the " * 9000]
    each = np.concatenate([quality_gbdt.features([t]) for t in many])
    assert np.allclose(quality_gbdt.features(many), each) and not each[0].any()
    assert quality_gbdt.features([]).shape == (0, len(quality_gbdt.FEATURES))


def test_trees_learn_and_stay_defined():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality_gbdt.fit_trees(x[:1500], y[:1500])
    assert ((trees.scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    for part in (y[:0], np.ones(5), np.zeros(5)):
        scores = quality_gbdt.fit_trees(x[: len(part)], part).scores(x[:3])
        assert ((scores >= 0) & (scores <= 1)).all()


def test_quality_rows(spark):
    good = [f"The {a} house of {b} stands near the {c} river, and nobody lives there." for a in ("old", "new", "red") for b in ("stone", "wood", "glass") for c in ("wide", "dark", "cold", "long")]
    bad = [f"BUY {a}!!! BUY {a}!!! BUY {a}!!! $$$ {b}%%%" for a in ("NOW", "IT", "HERE") for b in ("A", "B", "C", "D", "E", "F", "G", "H", "I", "J", "K", "L")]
    rows = list(enumerate(good * 2 + bad * 2)) + [(900, None), (901, ""), (None, "z"), (901, ""), (902, "w " * 50_000)]
    labels = [(k, int(k < 72)) for k in range(144)] + [(None, 1), (5, None), (7, 1), (4000, 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality_gbdt.train(docs, marks)
    got = quality_gbdt.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 144 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all((r["score"] >= 0.3) == (r["doc_id"] < 72) for r in held)
    kept = quality_gbdt.keep_good(docs, marks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(72))
    none = quality_gbdt.train(docs, marks.limit(0))
    assert {r["score"] for r in quality_gbdt.score_documents(docs, none).collect()} == {0.5}
    assert quality_gbdt.score_documents(docs.limit(0), none).count() == 0


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in got])
    assert len(got) > 100 and right > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
