"""Near-duplicates against brute force, the parts of the method, and the pipeline."""

import itertools
import random

import numpy as np
import pytest

import zlib
from collections import defaultdict

import corpus_pipeline
from tideflow.llm import near_dedup, packing, quality, queries

from .test_native_and_warc import brute_gone
from .test_text_rules import brute_contamination


def shingles(t):
    w = (t or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def lcs(a, b, band):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + 1 if x == y and abs(i - j) <= band else 0)
    return int(t[-1, -1])


def test_banded_lcs():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 30))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.9]
        d = len(a) + len(b)
        assert near_dedup.banded_lcs(a, b, d) == lcs(a, b, d)
        n = lcs(a, b, d)
        band = d - 2 * n  # no fewer indels align all matches
        assert near_dedup.banded_lcs(a, b, band) == n


def test_similarity_threshold():
    base = [f"w{i}" for i in range(300)]
    text = " ".join(base)
    assert near_dedup.similarity(text, text) == 1.0
    for edits in (0, 1, 5, 30, 59, 60, 61, 90):
        other = list(base)
        for e in range(edits):
            other[e * 3] = f"x{e}"
        assert (near_dedup.similarity(text, " ".join(other)) >= 0.8) == (edits <= 60)
    turned = " ".join(base[150:] + base[:150])
    assert near_dedup.similarity(text, turned) >= 0.8  # the order alone was changed
    assert near_dedup.similarity("", "a b") == 0.0


def test_links_need_shingle_similarity():
    base = [f"w{i}" for i in range(300)]
    text = " ".join(base)
    for edits in range(0, 12):
        other = list(base)
        for e in range(edits):
            other[10 + e * 25] = f"x{e}"
        other = " ".join(other)
        assert (near_dedup.shingle_similarity(text, other) >= 0.8) == (jaccard(shingles(text), shingles(other)) >= 0.8)
    repeats = " ".join(base[:40] * 9)
    assert near_dedup.shingle_similarity(" ".join(base[:40] * 2), repeats) == 1.0
    assert near_dedup.shingle_similarity(repeats + " a b c d e f g h i j k l m n o p", repeats) >= 0.8 > jaccard(shingles(repeats + " a b c d e f g h i j k l m n o p"), shingles(repeats))
    assert near_dedup.shingle_similarity("", "a b") == 0.0 and near_dedup.shingle_similarity("", "") == 1.0


def edited_copies(rng):
    """Copies of one text with up to 12 edits, copies of those, and a passage in many texts."""
    word = lambda: f"q{rng.randrange(10**6)}"
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    docs = []
    for i in range(160):
        copy = list(base) if i < 120 or not docs else list(rng.choice(docs))
        for _ in range(rng.randrange(0, 13 if i < 120 else 3)):
            copy[rng.randrange(len(copy))] = word()
        docs.append(copy)
    docs += [[word() for _ in range(20)] + passage + [word() for _ in range(20)] for _ in range(40)]
    docs += [passage * rng.randrange(1, 5) + [word() for _ in range(rng.randrange(0, 40))] for _ in range(40)]
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("crowded", [0, 2, near_dedup.CROWDED])
def test_edited_copies_link_by_shingles(spark, monkeypatch, crowded):
    """The classes of the rule itself, with and without leaders in the prefix buckets."""
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    texts = edited_copies(random.Random(12))
    pairs = itertools.combinations(range(len(texts)), 2)
    want = partition(len(texts), [(i, j) for i, j in pairs if near_dedup.shingle_similarity(texts[i], texts[j]) >= 0.8])
    assert len(set(want)) > 60
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r.id: r.class_id for r in near_dedup.near_duplicates(frame).collect()} == dict(enumerate(want))


def test_sketches_depend_on_order_and_labels():
    a = [f"w{i}" for i in range(40)]
    one, again = near_dedup.sketches(near_dedup.kmers(a)), near_dedup.sketches(near_dedup.kmers(list(a)))
    assert (one == again).all() and len(one) == near_dedup.SKETCHES
    agree = []
    for t in range(20):  # some sketches lie in one half of the text and do not see that the halves change places
        w = [f"w{t}x{i}" for i in range(40)]
        agree.append((near_dedup.sketches(near_dedup.kmers(w)) == near_dedup.sketches(near_dedup.kmers(w[20:] + w[:20]))).mean())
    assert 0 < np.mean(agree) < 0.3
    assert len(set(near_dedup.kmers(["x"] * 30).tolist())) == 26
    assert len(near_dedup.sketches(near_dedup.kmers([]))) == 0
    long = [f"v{i % 5000}" for i in range(70000)]
    assert len(near_dedup.sketches(near_dedup.kmers(long))) == near_dedup.SKETCHES


def families(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    passage, docs = text(60), []
    for _ in range(25):
        base = text(rng.randrange(30, 200))
        docs.append(base)
        for _ in range(rng.randrange(0, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
    docs += [text(20) + passage + text(30) for _ in range(30)]
    chain = text(400)
    for i in range(12):
        docs.append(chain[i * 12 : i * 12 + 250])
    texts = [" ".join(d) for d in docs]
    return texts + texts[:5] + ["", " ", None, "", "one two", "one two", "One  two", "three"]


def partition(n, links):
    """Smallest member of each item's component."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_classes_against_brute_force(spark):
    texts = families(random.Random(9))
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, node string").repartition(4)
    got = {r.id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert sorted(got) == list(range(len(texts)))
    sets, pairs = [shingles(t) for t in texts], list(itertools.combinations(range(len(texts)), 2))
    same = [(i, j) for i, j in pairs if (texts[i] or "") == (texts[j] or "")]
    must = partition(len(texts), same + [(i, j) for i, j in pairs if jaccard(sets[i], sets[j]) >= 0.8])
    may = partition(len(texts), same + [(i, j) for i, j in pairs if sets[i] and near_dedup.similarity(texts[i], texts[j] or "") >= 0.8])
    assert all(got[i] == got[must[i]] for i in got) and all(may[i] == may[got[i]] for i in got)
    assert all(got[i] <= i for i in got)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_reordered_and_repeated_copies(spark):
    """Shingle sets alike, but order and counts are not."""
    rng = random.Random(31)
    docs = []
    for _ in range(12):
        parts = [[f"p{rng.randrange(10**6)}" for _ in range(40)] for _ in range(10)]
        docs += [parts, parts[::-1], rng.sample(parts, 10)]
        docs += [[parts[0]] * 2, [parts[0]] * 9]
    texts = [" ".join(w for part in d for w in part) for d in docs]
    sets, pairs = [shingles(t) for t in texts], list(itertools.combinations(range(len(texts)), 2))
    want = partition(len(texts), [(i, j) for i, j in pairs if jaccard(sets[i], sets[j]) >= 0.8])
    assert sum(i != c for i, c in enumerate(want)) == 36
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.id: r.class_id for r in near_dedup.near_duplicates(frame).collect()} == dict(enumerate(want))


def test_recall_of_candidates():
    """Of linkable pairs, edited or reordered ones, nearly all share a sketch or a band."""
    rng, linkable, found = random.Random(17), 0, 0
    for n in (40, 120, 300, 1000):
        for rate in (0.002, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03):
            for _ in range(25):
                a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
                b = [f"x{rng.randrange(10**6)}" if rng.random() < rate else w for w in a]
                if rng.random() < 0.3:
                    cut = rng.randrange(n)
                    b = b[cut:] + b[:cut]
                if near_dedup.shingle_similarity(" ".join(a), " ".join(b)) >= 0.8:
                    keys = [set(np.concatenate((near_dedup.sketches(near_dedup.kmers(w)), near_dedup.bands(near_dedup.distinct(w)))).tolist()) for w in (a, b)]
                    linkable, found = linkable + 1, found + bool(keys[0] & keys[1])
    assert linkable > 400 and found >= 0.99 * linkable


def brute_classes(texts):
    pairs = itertools.combinations(range(len(texts)), 2)
    return partition(len(texts), [(i, j) for i, j in pairs if texts[i] == texts[j] or near_dedup.shingle_similarity(texts[i], texts[j]) >= 0.8])


def test_query_against_brute_force(spark, sf_dir, documents):
    docs = documents.sort_values("doc_id")
    ids = docs.doc_id.tolist()
    want = {ids[i]: ids[c] for i, c in enumerate(brute_classes(docs.text.fillna("").tolist()))}
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op10_near_dedup"](spark, sf_dir).collect()}
    assert got == want and any(i != c for i, c in want.items())


def brute_kept(docs):
    """Verdicts of the quality rules: rows (lang, source, text)."""
    rows, metrics = [], list(quality.METRICS.values())
    for lang, source, text in docs:
        m = dict(zip(quality.MEASURES, quality.measure(text or ""), strict=True))
        ratio = lambda a, b: m[a] * 1000 // max(m[b], 1)
        raw = [ratio("n_symbols", "n_words"), ratio("n_marks", "n_words"), ratio("n_capitals", "word_chars"), ratio("word_chars", "n_words"), ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words")]
        failed = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        rows.append((lang, source, failed, [x - x % (1 << max(x.bit_length() - quality.BITS, 0)) for x in raw]))

    def quartiles(values):
        s = sorted(values)
        at = lambda q: next(x for i, x in enumerate(s) if 100 * (i + 1) >= q * len(s))
        return len(s), at(25), at(75)

    groups = defaultdict(list)
    for lang, source, failed, b in rows:
        if not failed:
            for key in ((), (lang,), (lang, source)):
                groups[key].append(b)
    out = []
    for lang, source, failed, b in rows:
        over = False
        for k, margin in enumerate(metrics if not failed else ()):
            _, lo, hi = quartiles([x[k] for x in groups[()]])
            for key in ((lang,), (lang, source)):
                n, a, z = quartiles([x[k] for x in groups[key]])
                lo, hi = ((n * own + quality.PRIOR * up) / (n + quality.PRIOR) for own, up in ((a, lo), (z, hi)))
            over |= b[k] > hi + max(quality.SPREAD * (hi - lo), margin)
        out.append(not failed and not over)
    return out


def test_quality_verdicts_against_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: r.kept for r in queries.QUERIES["op6_quality_rules"](spark, sf_dir).collect()}
    want = brute_kept(documents[["lang", "source", "text"]].itertuples(index=False, name=None))
    assert got == dict(zip(documents.doc_id.tolist(), want, strict=True)) and 0 < sum(want) < len(want)
    han = [("zh", "s", " ".join(["漢" * (28 + i % 5)] * 3 + [f"字{j}" * 15 + str(i) for j in range(12)])) for i in range(300)]
    han.append(("zh", "s", " ".join(f"長{i}" * 900 for i in range(12))))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(han)], "doc_id bigint, lang string, source string, text string")
    assert {r.doc_id for r in quality.filter_quality(frame).select("doc_id").collect()} == {i for i, k in enumerate(brute_kept(han)) if k} and not brute_kept(han)[-1]


def test_pipeline_against_brute_force(spark, sf_dir, documents):
    """All stages by plain Python: the same pieces of the same texts."""
    import pandas as pd

    docs = documents.sort_values("doc_id")
    kept = brute_kept(docs[["lang", "source", "text"]].itertuples(index=False, name=None))
    rows = [(i, t or "") for i, t, k in zip(docs.doc_id.tolist(), docs.text.tolist(), kept, strict=True) if k]
    gone = brute_gone(rows)
    rows = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])) for i, t in rows]
    classes = brute_classes([t for _, t in rows])
    rows = [r for n, r in enumerate(rows) if classes[n] == n]
    bench = list(pd.read_parquet(f"{sf_dir}/benchmark.parquet").itertuples(index=False, name=None))
    rows = [(i, t) for i, t in rows if not brute_contamination(t, bench)[1]]
    tokenizer, want = packing.WordTokenizer(packing.default_tokenizer()), []
    for i, t in rows:
        ids = tokenizer.encode(t) + (1).to_bytes(4, "little")
        want += [(i, p, zlib.crc32(ids[at : at + 4 * 4096])) for p, at in enumerate(range(0, len(ids), 4 * 4096))]
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_stages_on_odd_tables(spark, sf_dir, odd_docs, no_docs):
    """Empty tables, and null, empty and repeated rows with columns whose names operators might use."""
    names = ["_url", "_new", "_gone", "_hash", "_failed", "_fence", "_k", "_n", "_l", "_s", "_id", "_y", "_ranges", "base_failed", "kept", "contamination", "node", "component", "h"]
    wide = odd_docs.withColumn("n_chars", near_dedup.F.length("text").cast("bigint"))
    for c in names:
        wide = wide.withColumn(c, near_dedup.F.lit(c))
    for docs in (no_docs, wide):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count() and all(r[c] == c for r in out.collect() for c in names if c in docs.columns), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_query_covers_all_rows(spark, sf_dir, documents):
    got = queries.QUERIES["op10_near_dedup"](spark, sf_dir).toPandas()
    assert sorted(got.doc_id) == sorted(documents.doc_id)
    same = documents.merge(got, on="doc_id").groupby("text").class_id.nunique()
    assert (same == 1).all()


def test_odd_rows(spark, odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs).toPandas()
    assert len(got) == odd_docs.count()
    by = got.dropna(subset=["id"]).set_index("id").class_id
    assert by[1] == by[2] == 1 and by[5] == by[6] == 5
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 4").count() == 2 and kept.where("doc_id = 6 or doc_id = 2").count() == 0
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.keep_one(no_docs).count() == 0


def test_pipeline(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.columns == names and 0.5 * rows < docs.count() <= rows, name
        rows = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert sorted(packed.doc_id.unique()) == sorted(r.doc_id for r in docs.collect())
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(whole[["doc_id", "piece", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(packed[["doc_id", "piece", "ids_crc32"]].itertuples(index=False, name=None))
