"""Quality rules, URL filters, packing and decontamination against brute force."""

import fnmatch
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tideflow.llm import common, decontaminate, packing, quality, queries, url_filter


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_measures(documents, odd_docs):
    texts = documents.text.tolist() + [r.text for r in odd_docs.collect()] + ["a b c d e a b c d e f", "x\nx\n\n \n \nx", "a " * 7]
    for t in texts:
        assert quality.measure(t or "")[:5] == brute_measures(t)


def test_quality_query(spark, sf_dir, documents):
    got = queries.QUERIES["op6_quality_rules"](spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(documents)
    for r in documents.itertuples():
        want = brute_measures(r.text)
        g = got.loc[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (g.base_failed and g.kept)


def test_quality_fences_follow_their_group(spark):
    """Two sources with different habits: what is usual in one is an outlier in the other."""
    def text(i, marks):
        return " ".join(f"word{i}x{j}" + ("!!" if j < marks else "") for j in range(40))

    rows = [(i, text(i, 0), "en", "plain") for i in range(300)] + [(1000 + i, text(i, 30), "en", "loud") for i in range(300)]
    rows.append((5000, text(5000, 30), "en", "plain"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = quality.quality(docs).toPandas().set_index("doc_id")
    assert got.kept.drop(5000).all() and not got.kept[5000]
    assert sorted(r.doc_id for r in quality.filter_quality(docs).collect()) == sorted(set(got.index) - {5000})


def test_quality_fences_have_no_top(spark):
    """Long words are usual in the group; much longer ones are outliers."""
    text = lambda i, n: " ".join(f"{i}x{j}".ljust(n, "y") for j in range(40))
    rows = [(i, text(i, 30 + i % 3), "zz", "long") for i in range(300)] + [(5000, text(5000, 300), "zz", "long")]
    got = quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert got.kept.drop(5000).all() and not got.kept[5000]
    m = spark.range(1).selectExpr("named_struct('n_symbols', 32767L, 'n_words', 1000L, 'n_marks', 32769L, 'n_capitals', 0L, 'word_chars', 1000017L, 'n_dup_lines', 0L, 'n_lines', 0L, 'n_repeat_words', 0L) m")
    assert m.select(quality.buckets("m").alias("b")).first().b == [32767, 32768, 0, 1000000, 0, 0]


def test_quality_fences_do_not_switch_by_size(spark):
    """The same outlier in groups of the same habits, just under and just over 200 documents, in a language with other habits."""
    def text(i, marks):
        return " ".join(f"word{i}x{j}" + ("!" * (2 if j < marks else 0)) for j in range(40))

    sizes = {"small": 150, "under": 198, "over": 202}
    rows = [(1000 * k + i, text(i, 0), "en", source) for k, (source, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(10_000 + i, text(i, 30), "en", "loud") for i in range(550)]
    rows += [(5000 + k, text(k, 40), "en", source) for k, source in enumerate(sizes)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).toPandas().set_index("doc_id")
    outliers = [5000 + k for k in range(len(sizes))]
    assert got.kept.drop(outliers).all() and not got.kept[outliers].any()


def test_quality_odd_rows(odd_docs, no_docs):
    out = quality.quality(odd_docs)
    assert out.count() == odd_docs.count() and {"n", "k", "length"} <= set(out.columns)
    assert quality.filter_quality(odd_docs).columns == odd_docs.columns
    assert quality.quality(no_docs).count() == 0 and quality.filter_quality(no_docs).count() == 0


def test_globs_against_fnmatch():
    rng = random.Random(5)
    globs = ["", "*", "?", "a", "a*", "*a", "*a*b*", "a?b", "**a", "ab*ba", "?*?"] + ["".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    strings = ["", "a", "b", "ab", "aab", "abba"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    got = url_filter.GlobSet(globs).matches([s.encode() for s in strings])
    for i, s in enumerate(strings):
        for k, g in enumerate(globs):
            assert got[i, k] == fnmatch.fnmatchcase(s, g), (s, g)
    assert url_filter.GlobSet([url_filter.escape("a*?\\b")]).matches([b"a*?\\b", b"axxxb"])[:, 0].tolist() == [True, False]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://example.net/fr", "example.net", "/fr", "net/", "block"),
    ("https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
    ("http://example.com/x.net/", "example.com", "/x.net/", None, "allow"),
    ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://net", "net", "", None, "allow"),
    ("http://cheap-pills.com?a/b", "cheap-pills.com", "", None, "block"),
    ("net/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://a\x1fb.net\x1f/q", "a\x1fb.net\x1f", "/q", None, "allow"), ("a://b://c.net/d", "b:", "//c.net/d", None, "allow"),
    ("http://é.NET/ü\n/x", "é.net", "/ü\n/x", "net/", "block"),
])
def test_url_cases(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "clash")], "page_id bigint, url string, hits string")
    r = url_filter.judge(pages).first()
    assert (r.host, r.path, r.rule, r.verdict, r.hits) == (host, path, rule, verdict, "clash")


def test_url_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def one_by_one(lengths, capacity):
    """Best fit decreasing, a piece at a time; the fill of the bins (which of equally full ones gets a piece is open)."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [b for b in bins if sum(b) + n <= capacity]
        if fitting:
            max(fitting, key=sum).append(n)
        else:
            bins.append([n])
    return sorted(map(sum, bins))


def test_best_fit_is_the_sequential_one():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([7, 16, 50])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 120))]
        placements, n = packing.best_fit_decreasing(Counter(lengths), capacity)
        bins = [[] for _ in range(n)]
        for p in placements:
            for r in range(p.count):
                bins[p.sequence + r // p.each].append((p.offset + r % p.each * p.length, p.length))
        for b in bins:
            end = 0
            for offset, length in sorted(b):
                assert offset == end
                end += length
            assert end <= capacity
        assert sorted(sum(x for _, x in b) for b in bins) == one_by_one(lengths, capacity)


def test_tree_finds_the_tightest():
    tree, there, rng = packing.CapacityTree(100), set(), random.Random(1)
    for _ in range(2000):
        c = rng.randrange(0, 101)
        tree.set(c, c not in there)
        there ^= {c}
        n = rng.randrange(0, 101)
        assert tree.tightest(n) == min((x for x in there if x >= n), default=None)


def test_tokenizer_equals_the_library(documents):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = documents.text.tolist()[:100] + [
        "", " \n", "ΣΑΣ ΟΔΟΣ. İstanbul", "e\u0301 x \u0301y a\u0301", "<|endoftext|>a <|ENDOFTEXT|> b<|startoftext|>", "a\u00a0b\u2003c\x0bd\x1ce\x85f",
        "don't I'LL we've ''s 1234 ½ x²", "ﬁ ﬀ Å K ſ ẞ", "汉字 テスト 🙂👍🏽 !!??.", "a.b,c; word... ?! ;: x!?", "ﷺ\u200d\u0000z", "A.B. C.,. é.. 12.,",
    ]
    got = [np.frombuffer(b, "<u4").tolist() for b in own.encode_batch(texts)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_tokenizer_on_random_texts(monkeypatch):
    """Odd letters, and a memory so small that its generations change all the time."""
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    own, rng = packing.WordTokenizer(packing.default_tokenizer()), random.Random(3)
    assert own.simple
    letters = "abzAZ019éÉßñÇĐİıſŉǅ'’\"<|>.,;-_#  ́²½中Ωςσ\x1c\x0b\t\n ×÷ªº\x85\ufeff\xad𝐀😀한"
    for _ in range(4000):
        t = "".join(rng.choice(letters) if rng.random() < 0.8 else rng.choice(["'s ", "'RE", "<|endoftext|>", "İstanbul "]) for _ in range(rng.randrange(0, 25)))
        want = own.tokenizer.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == np.array(want, "<u4").tobytes(), t
    assert len(own.chunks) <= 3 and len(own.chunks.old) <= 3


def test_packing_clashing_names(spark):
    items = spark.createDataFrame([(i, 5, i, i, i) for i in range(9)], "doc_id bigint, length bigint, _l int, _s int, _rank int")
    out = packing.pack(items, ["doc_id"], capacity=10)
    assert out.columns == [*items.columns, "sequence_id", "offset"] and out.select("sequence_id").distinct().count() == 5


def test_packing_query(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    got = queries.QUERIES["op8_best_fit_packing"](spark, sf_dir).toPandas()
    want = []
    for r in documents.itertuples():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((r.doc_id, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[names].itertuples(index=False, name=None)) == sorted(want)
    check_sequences(got)
    assert got.sequence_id.nunique() == len(one_by_one(got.length.tolist(), 4096))


def check_sequences(got):
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= 4096


def test_packing_odd_rows(odd_docs, no_docs):
    got = packing.pack_documents(odd_docs).toPandas()
    assert len(got[got.doc_id == 1]) == 1 and got[got.doc_id == 1].length.iloc[0] == 1
    assert len(got[(got.doc_id == 4)]) == 3
    check_sequences(got)
    assert packing.pack_documents(no_docs).count() == 0
    ids = packing.pieces(odd_docs, with_ids=True)
    assert {"n", "k"} <= set(ids.columns) and all(len(r.ids) == r.length for r in ids.select("ids", "length").collect())


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        size = min(10, len(x))
        windows = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if size else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def check_contamination(out, docs, items):
    for r in out:
        n, hits, found = brute_contamination(docs[r.doc_id], items)
        c = r.contamination
        assert (c.n_words, c.n_hit, list(c["items"])) == (n, hits, found)


@pytest.mark.parametrize("bits", [decontaminate.FILTER_BITS, common.ROW_BITS])
def test_decontamination(spark, documents, sf_dir, monkeypatch, bits):
    """Also with a filter so small that it lets more windows through."""
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    bench = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    items = [*bench.itertuples(index=False, name=None), (9001, "two Words"), (9002, "the"), (9003, ""), (9004, None), (9001, "again same id"), (9005, bench.text[0])]
    texts = documents.text.tolist()[:80]
    texts += ["x " + bench.text[0].upper() + " y", bench.text[1][5:], "Two words", "two\u00a0words", "two-words the END", "", None, " ".join(bench.text[:3])]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, "z") for i, t in docs.items()], "doc_id bigint, text string, items string")
    got = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len(got) == len(docs)
    check_contamination(got, docs, items)


def test_decontamination_query(spark, documents, sf_dir):
    bench = list(pd.read_parquet(f"{sf_dir}/benchmark.parquet").itertuples(index=False, name=None))
    got = queries.QUERIES["op9_decontamination"](spark, sf_dir).toPandas().set_index("doc_id")
    for r in documents.itertuples():
        n, hits, found = brute_contamination(r.text, bench)
        g = got.loc[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, hits, len(found), hits > 0)
        assert g.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_decontamination_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(no_docs, none).count() == 0
    assert all(r.contamination.n_hit == 0 for r in decontaminate.decontaminate(odd_docs, none).collect())
