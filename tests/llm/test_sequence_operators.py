"""Periodic runs, languages and token alignment against brute force, gradients and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfkin.llm import gru_language, suffix_runs, token_alignment
from shelfkin.llm.queries import QUERIES

DOCS = "doc_id bigint, text string"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain_runs(words):
    """Every run by comparing each pair of words a period apart."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            part = words[i : i + size]
            if j > i and size >= max(6, 4 * q) and not any(part[d:] == part[: size - d] for d in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for start, size, q in runs for k in range(start + q, start + size)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_texts(n, seed):
    random.seed(seed)
    out = []
    for _ in range(n):
        k, words = random.choice([1, 2, 2, 3, 5]), []
        for _ in range(random.randint(0, 6)):
            base = [random.randrange(k) for _ in range(random.randint(1, 7))]
            words += (base * random.randint(1, 9))[: random.randint(1, 50)] if random.random() < 0.5 else base
        out.append(random.choice([" ", "\n", " \t"]).join(f"w{w}" for w in words))
    return out


@pytest.mark.parametrize("tree_words", [1, 50, 60_000])
def test_runs_equal_brute_force(monkeypatch, tree_words):
    monkeypatch.setattr(suffix_runs, "TREE_WORDS", tree_words)
    texts = [plain_words(t) for t in periodic_texts(300, tree_words)]
    number = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    begins = np.cumsum([0, *map(len, texts)])
    got = suffix_runs.find_runs(np.array([number[w] for t in texts for w in t]), begins)
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


def test_tree_extensions_equal_comparing():
    random.seed(8)
    for _ in range(40):
        symbols = [random.randrange(3) for _ in range(random.randint(1, 60))] + [-1]
        tree = suffix_runs.SuffixTree(symbols)
        suffixes, passed = tree.tour()
        assert suffixes.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
        common = suffix_runs.Extensions(suffixes, passed)
        pairs = [(i, j) for i in range(len(symbols)) for j in range(len(symbols)) if i != j]
        got = common(*np.array(pairs).T)
        for (i, j), n in zip(pairs, got.tolist(), strict=True):
            same = next((k for k in range(len(symbols)) if max(i, j) + k >= len(symbols) or symbols[i + k] != symbols[j + k]), 0)
            assert n == same


def test_run_rows(spark):
    long = " ".join(f"x{k % 997}" for k in range(30_000))
    texts = [None, "", "  \n ", "a a a a a a", "a a a a a b", "a b a b a b a b c", "a b a b a b a", "ü ü ü ü ü ü ü", long]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "a a a a a a"), (None, "b b b b b b b")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"runs": F.lit("mine"), "N_RUNS": F.lit(1)})
    found = suffix_runs.word_runs(df.drop("N_RUNS"))
    got = {(r["doc_id"], r["text"]): r for r in found.collect()}
    assert found.count() == len(rows)
    for (_, text), r in got.items():
        words = plain_words(text)
        expected = plain_runs(words) if text != long else [(0, 30_000, 997)]
        assert [tuple(x) for x in r["runs"]] == expected and r["n_runs"] == len(expected)
        assert r["collapsed"] == collapsed(words, expected)
    assert got[None, "b b b b b b b"]["best"] == (0, 7, 1) and got[0, None]["best"] is None
    assert suffix_runs.word_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_run_query(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(documents)
    planted = 0
    for doc in documents:
        words = plain_words(doc["text"])
        h = zlib.crc32(str(doc["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if len(words) > 1500:
            continue
        runs, row = plain_runs(words), got[doc["doc_id"]]
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row["collapsed_sha256"] == sha(collapsed(words, runs))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert planted


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = gru_language.new_network(["a", "b", "c"], 3)
    for name in ("table", "state", "inner", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    buffer = rng.integers(0, 5, 60).astype(np.uint8)
    lengths = np.array([10, 7, 1, 12])
    steps, labels = gru_language.both_ways(buffer, np.array([0, 10, 25, 40]), lengths), np.array([0, 2, 1, 1])
    grads = gru_language.gradients(net, steps, lengths, labels)[1]
    for weight, grad in zip(net.weights(), grads, strict=True):
        for _ in range(8):
            at = tuple(int(rng.integers(0, n)) for n in weight.shape)
            at = (*at[:-1], at[-1] % 5) if weight.shape[-1] == 256 else at
            own, losses = weight[at], []
            for step in (1e-2, -1e-2):
                weight[at] = own + step
                losses.append(gru_language.gradients(net, steps, lengths, labels)[0])
            weight[at] = own
            assert abs((losses[0] - losses[1]) / 2e-2 - grad[at]) < 2e-3


def plain_probabilities(net, text):
    """One byte after the other, without blocks, in double precision."""
    size, total = net.inner.shape[1], np.zeros(len(net.languages))
    gate = lambda x: 1 / (1 + np.exp(-x))
    for at in range(0, len(text), gru_language.SEGMENT):
        part = text[at : at + gru_language.SEGMENT]
        states = []
        for d, order in ((0, part), (1, part[::-1])):
            h, out = np.zeros(size), []
            for byte in order:
                x, s = net.table[d][:, byte].astype(float), net.state[d].astype(float) @ h
                z, r = gate(x[:size] + s[:size]), gate(x[size : 2 * size] + s[size : 2 * size])
                n = np.tanh(x[2 * size :] + r * (s[2 * size :] + net.inner[d, :, 0]))
                h = (1 - z) * n + z * h
                out.append(h)
            states.append(out if d == 0 else out[::-1])
        for a, b in zip(*states, strict=True):
            p = np.exp(net.out[:, 0] @ a + net.out[:, 1] @ b + net.bias[:, 0])
            total += p / p.sum()
    return total / max(1, len(text))


def test_blocks_equal_single_steps(monkeypatch):
    monkeypatch.setattr(gru_language, "BLOCK", 3)
    net = gru_language.new_network(["a", "b", "c"], 4)
    texts = [b"", b"x", "ünï cödé".encode(), b"abc " * 100, bytes(range(256)), b"y" * 128, b"z" * 129]
    got = gru_language.probabilities(net, texts)
    for text, p in zip(texts, got, strict=True):
        assert np.allclose(p, plain_probabilities(net, text), atol=1e-4)


def test_language_rows(spark):
    one = "der die das und nicht ein kurzer satz "
    two = "the and this is not a short phrase "
    rows = [(k, one * 3, "de") if k % 2 else (k, two * 3, "en") for k in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", "de"), (103, two * 3000, None), (None, one, "en"), (3, one * 3, "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("mine"))
    got = gru_language.language_report(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == ("de" if k % 2 else "en") and 0.5 < by[k]["score"] <= 1 for k in range(60))
    assert [(by[k]["lang_pred"], by[k]["score"]) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[103]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and by[None]["held_out"]
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert gru_language.language_report(empty).count() == 0
    untaught = spark.createDataFrame([(1, "word", None)], "doc_id bigint, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in gru_language.language_report(untaught).collect()] == [("und", 0.0)]
    single = spark.createDataFrame([(k, "word", "xx") for k in range(9)], "doc_id bigint, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in gru_language.language_report(single).collect()} == {("xx", 1.0)}


def test_language_query_on_documents_never_seen(spark, sf):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_language"](spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]["lang"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]
    assert len(held) > 10 and sum(right) / len(right) > 0.93


def plain_alignment(first, second, vocabulary, text):
    """Groups and links of a whole text by comparing the byte ranges of all pairs of tokens near each other."""
    if not text:
        return 0, 0, 0, "", Counter()
    whole = (" " + text).encode()
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    bytes_a = [vocabulary[first.id_to_token(i)] for i in a]
    bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return 0, 0, 0, "", Counter()
    ends_a, ends_b = ([sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (bytes_a, bytes_b))
    links = Counter()
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if ends_a[i] > ends_b[j] - len(bytes_b[j]) and ends_b[j] > ends_a[i] - len(bytes_a[i]):
                links[x, y] += 1
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        i, j = i2, j2
    return len(a), len(b), len(groups), ";".join(groups), links


@pytest.fixture(scope="module")
def libraries():
    from shelfkin.llm.bpe import byte_characters

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    bytes_of = byte_characters()
    vocabulary = {w: w.encode() if w == "<|endoftext|>" else bytes(bytes_of[c] for c in w) for w in first.get_vocab()}
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), vocabulary


def odd_texts(n):
    random.seed(5)
    bits = ["a", "b", " ", "  ", "\n", "\t", " \n", "'s", "'ll", "1", "²", "é", "́", "漢", "字", "\x1c", "\x85", "_", "--", "\x00", "▁", "\xa0", " ", "　"]
    bits += ["!!", "<|endoftext|>", "<s>", "<unk>", "<0x0A>", "😀", "the", "ing", "THE", "İ", "٣", "​", "﻿", "𝟘", "ɐ", "\x0b"]
    return ["".join(random.choice(bits) for _ in range(random.randint(0, 20))) for _ in range(n)]


@pytest.mark.parametrize("together, remembered", [(64, 200_000), (1, 20)])
def test_alignment_equals_whole_texts(monkeypatch, libraries, together, remembered):
    monkeypatch.setattr(token_alignment, "ENCODED_TOGETHER", together)
    monkeypatch.setattr(token_alignment, "REMEMBERED", remembered)
    table = token_alignment.Aligner(*PATHS)
    texts = odd_texts(1200) + ["x" * 2000, " " * 300 + "a" + " " * 99, "the end\n", "a b", "a  b ", " "]
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        columns = [c.to_pylist() for c in table.align(part)]
        for text, n_a, n_b, n_groups, n_links, groups, links in zip(part, *columns, strict=True):
            expected = plain_alignment(*libraries, text)
            assert (n_a, n_b, n_groups, groups) == expected[:4], text
            assert {(x["a"], x["b"]): x["times"] for x in links} == expected[4] and n_links == sum(expected[4].values())


def plain_report(libraries, texts):
    aligned = [plain_alignment(*libraries, t) for t in texts]
    holding = Counter(pair for x in aligned for pair in x[4])
    most = {}
    for (a, _), n in holding.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for n_a, n_b, n_groups, groups, links in aligned:
        best = sum(n for (a, b), n in links.items() if holding[a, b] == most[a])
        total = sum(n * holding[pair] for pair, n in links.items())
        out.append((n_a, n_b, n_groups, sum(links.values()), best, total, sha(groups) if n_groups else ""))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_rows(spark, libraries):
    texts = [None, "", "a▁b", "hello world", "hello worlds", "HELLO  world\n", "hello world"] + ["common words here"] * 40
    rows = [(k if k != 4 else None, t) for k, t in enumerate(texts)] + [(3, "hello world")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"links": F.lit(1), "documents": F.lit(2)})
    got = token_alignment.alignment_report(df, *PATHS).collect()
    expected = plain_report(libraries, [t for _, t in rows])
    assert sorted(str((r["doc_id"], *(r[c] for c in NAMES))) for r in got) == sorted(str((k, *e)) for (k, _), e in zip(rows, expected, strict=True))
    assert token_alignment.alignment_report(spark.createDataFrame([], DOCS), *PATHS).count() == 0


def test_alignment_query(spark, sf, libraries):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op13_token_alignment"](spark, sf).collect()}
    assert len(got) == len(documents)
    # The whole table, token by token: ranges are compared through their ends.
    first, second, vocabulary = libraries
    rows, holding = [], Counter()
    for doc in documents:
        text = doc["text"]
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        size_a = [len(vocabulary[first.id_to_token(i)]) for i in a]
        size_b = [1 if second.is_byte(i) else len(second.id_to_piece(i).replace("▁", " ").encode()) for i in b]
        owner_a, owner_b = ([k for k, n in enumerate(s) for _ in range(n)] for s in (size_a, size_b))
        assert len(owner_a) == len(owner_b) == len((" " + text).encode())
        links = Counter((a[x], b[y]) for x, y in set(zip(owner_a, owner_b, strict=True)))
        holding.update(links.keys())
        rows.append((doc["doc_id"], len(a), len(b), links))
    most = {}
    for (x, _), n in holding.items():
        most[x] = max(most.get(x, 0), n)
    for doc_id, n_a, n_b, links in rows:
        row = got[doc_id]
        assert (row["n_a"], row["n_b"], row["n_links"]) == (n_a, n_b, sum(links.values()))
        assert row["count_sum"] == sum(n * holding[pair] for pair, n in links.items())
        assert row["n_best"] == sum(n for pair, n in links.items() if holding[pair] == most[pair[0]])
