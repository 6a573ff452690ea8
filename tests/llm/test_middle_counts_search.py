"""Fill-in-middle, token counts and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cantus.llm import dualtree, lengths
from cantus.llm.dualtree import Best, Block, ranked_search, search
from cantus.llm.lengths import fragments, token_counts
from cantus.llm.middle import Exceptions, fill_in_middle, restore

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "\n \t", "one", " one", "one ", "é", "日本 語です。 ", "a\x1cb\x85c d e　f", "😀 x 😀😀", "<P> a b", "a <S>", "x<M", "<<P", "P> <", "a\x00b \x0b\x0c", "tab\tand\nline\r\n", "<|endoftext|> a<|endoftext|>b", "don't we'll 's '  x", "１２ ⅷ ٣ 12", "x" * 3000, "né " * 4000]


def texts(seed=0, n=120):
    r = random.Random(seed)
    letters = "abcABC xyz  \n\té日😀'.,<>PSM0189"
    return [*ODD, *("".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(n))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", -1, "f") for i, t in rows] + [(None, "no id é <", "z", 7, "g")], "doc_id long, text string, output string, n_tokens long, form string").repartition(3)


def cut(i, t, unit, rate, spm):
    units = list(t) if unit == "char" else UNIT.findall(t)
    h = [int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), out


@pytest.mark.parametrize("unit,rate,spm", [("token", 50, 80), ("token", 100, 50), ("char", 100, 50)])
def test_fill_in_middle(spark, unit, rate, spm):
    rows = list(enumerate(texts()))
    got = restore(fill_in_middle(frame(spark, [*rows, (5, "again é")]), unit, rate, spm)).collect()
    want = Counter((i, *cut(i, t or "", unit, rate, spm), t or "") for i, t in [*rows, (5, "again é"), (None, "no id é <")])
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert rate < 100 or {r.form for r in got} == {"plain", "psm", "spm"}


def test_exceptions_convert_both_ways():
    for t in (t or "" for t in texts(3)):
        index = Exceptions(np.frombuffer(t.encode(), np.uint8))
        chars = np.arange(len(t) + 1)
        places = np.array([len(t[:k].encode()) for k in chars])
        assert index.bytes(chars).tolist() == places.tolist() and index.chars(places).tolist() == chars.tolist()


def test_fill_in_middle_of_empty_tables_long_texts_and_bad_sentinels(spark):
    long = "ab é\n" * 300_000 + " "
    r = restore(fill_in_middle(spark.createDataFrame([(3, long)], "doc_id int, text string"), rate=100)).first()
    assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (3, *cut(3, long, "token", 100, 80)) and r.restored == long
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert fill_in_middle(spark.createDataFrame([("k", "a b")], "doc_id string, text string")).first().doc_id == "k"
    for bad in (("a", "ab", "c"), ("xy", "yx", "z"), ("", "a", "b"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), sentinels=bad)
    docs = spark.createDataFrame([(k, f"w{k} \\E.* (x|y)") for k in range(40)], "doc_id long, text string")
    assert all(r.restored == f"w{r.doc_id} \\E.* (x|y)" for r in restore(fill_in_middle(docs, rate=100, sentinels=("[a|", "\\Q", "♥+")), ("[a|", "\\Q", "♥+")).collect())


def long_texts():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeXYZé日本'.,1 ") for _ in range(r.randint(1, 9)))
    many = " ".join(word() for _ in range(60_000))
    return [many, many.replace(" ", "<|endoftext|>"), "日本語です。" * 30_000, "語" * 20_000, "a" * 70_000 + " b", " " * 70_000 + "x", "'s " * 40_000, ("x " * 32_767) + "<|endoftext|> y"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    rows = list(enumerate([*texts(2), *long_texts()[: 8 if name.startswith("byte") else 3]]))
    got = token_counts(frame(spark, [*rows, (5, "again é")]), path, limit=100).collect()
    assert set(got[0].asDict()) == {"doc_id", "output", "form", "n_bytes", "n_tokens", "over_limit"}
    want = Counter((i, len((t or "").encode()), count(t or ""), count(t or "") > 100) for i, t in [*rows, (5, "again é"), (None, "no id é <")])
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_fragments_are_cut_outside_special_strings(spark):
    special = ["<|endoftext|>"]
    for t in long_texts():
        found = fragments(t, lengths.SAFE, special, 1000)
        assert "".join(found) == t
        assert sum(x.count(special[0]) for x in found) == t.count(special[0])
    assert max(map(len, fragments("word " * 10_000, lengths.SAFE, special, 1000))) < 1100
    assert [len(b) for b in lengths.balanced(["a" * 60] * 10, 100)] == [2] * 5
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    with pytest.raises(Exception):
        token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "/nowhere/x.bin").collect()


def ranked(docs, items, k):
    terms = {n: Counter(TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))) for n, (i, t) in enumerate(docs) if i is not None}
    terms = {n: c for n, c in terms.items() if c}
    total, n_docs = sum(sum(c.values()) for c in terms.values()), len(terms)
    df = Counter(t for c in terms.values() for t in c)
    out = []
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, set()).update(TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")))
    for i, q in queries.items():
        scored = []
        for n, c in terms.items():
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                scored.append((-s, docs[n][0]))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def search_rows(seed=0, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["É", "日本", "Ab", "ab", "0", "１", "x" * 40, "y_z"]
    text = lambda most: " ".join(vocabulary[min(int(r.expovariate(0.02)), len(vocabulary) - 1)] for _ in range(r.randint(1, most)))
    docs = [(7 * k % 1009, text(60)) for k in range(n)]
    docs += [(2000 + k, docs[3][1]) for k in range(40)] + [(5000, None), (5001, ""), (5002, " .,; "), (5003, "w1 " * 3000), (5004, docs[5][1]), (5004, docs[5][1]), (None, docs[3][1])]
    items = [(k, text(12)) for k in range(30)] + [(40, docs[3][1]), (41, "nowhere else"), (42, None), (43, ""), (44, "w1 W1"), (45, "ab É 日本 " + "x" * 40), (45, "w7"), (None, "w1")]
    return docs, items


@pytest.mark.parametrize("k,block", [(10, 1 << 20), (3, 40), (1, 1 << 20)])
def test_ranked_search(spark, k, block):
    docs, items = search_rows()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(5)
    bench = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    got = ranked_search(df, bench, k, block=block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == ranked(docs, items, k)


def test_ranked_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("q", "a b")], "item_id string, text string")
    assert ranked_search(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranked_search(docs, items.where("false")).collect() == []
    assert [tuple(r) for r in ranked_search(docs.unionByName(spark.createDataFrame([(2, "c"), (3, "d")], docs.schema)), items).collect()] == [(*x,) for x in ranked([(1, "a"), (2, "c"), (3, "d")], [("q", "a b")], 10)]


def test_the_trees_prune_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(dualtree, "SLICE", 64)
    r = np.random.default_rng(0)
    n_items, n_docs, width, k = 40, 4000, 500, 5
    own = [np.unique(r.integers(0, width, r.integers(2, 12))) for _ in range(n_items)]
    block = Block(list(range(n_items)), np.arange(width, dtype=np.uint64), r.integers(0, 9000, width), np.repeat(np.arange(n_items), [len(x) for x in own]), np.concatenate(own), n_docs, n_docs * 30)
    best = Best(block, k)
    impacts, scored = {}, 0
    for b in range(0, n_docs, 1000):
        rows = [np.unique(r.integers(0, width, r.integers(0, 20))) for _ in range(1000)]
        for d in range(10, 200, 10):
            rows[d] = rows[0]  # copies
        ptr = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        impact = r.integers(1, 3, ptr[-1]) * 1000
        for d in range(0, 200, 10):
            impact[ptr[d] : ptr[d + 1]] = 1000
        for d, x in enumerate(rows):
            impacts[b + d] = dict(zip(x.tolist(), impact[ptr[d] : ptr[d + 1]].tolist()))
        scored += search(block, best, np.arange(b, b + 1000), ptr, np.concatenate(rows), impact)
    for place, item in enumerate(block.ids):
        want = sorted((-sum(int(block.weights[t]) * f for t, f in d.items() if t in set(own[item].tolist())), i) for i, d in impacts.items())
        want = [(i, -s) for s, i in want if s < 0][:k]
        got = [(int(d), int(s)) for d, s in zip(best.doc[place], best.score[place]) if s > 0]
        assert got == want
    assert scored < n_items * n_docs / 2
