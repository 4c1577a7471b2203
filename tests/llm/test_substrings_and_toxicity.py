"""Substring dedup against brute force; the toxicity classifier on held-out rows."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from tideflow.llm import queries, suffix_dedup, toxicity


def brute_repeats(docs, n=100):
    """docs: (id, text) in any order; to (n_bytes, n_removed, n_spans, sha256 of the rest) by id."""
    seen, out = set(), {}
    for id, text in sorted(docs, key=lambda d: d[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w in seen:
                gone[i : i + n] = True
            seen.add(w)
        gone = gone[:-1]
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[id] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def check(out, docs):
    want = brute_repeats(docs)
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        x = r.repeats
        kept = bytes(x.kept)
        got = (x.n_bytes, x.n_bytes - len(kept), len(x.spans), hashlib.sha256(kept).hexdigest())
        assert got == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("group_limit", [suffix_dedup.GROUP, 3])
def test_substrings(spark, group_limit):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60), text(25), text(14), "é" * 55, "x" * 400, "ab" * 90]
    docs = [text(300)]
    for _ in range(60):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            at = rng.randrange(0, max(1, len(p) - 60))
            parts += [p[at:], text(rng.randrange(0, 20))]
        docs.append(" ".join(parts))
    docs += [docs[3], docs[3] + "!", docs[5][1:], None, "", "short", "z" * 99, "z" * 100, "z" * 101, passages[0][:100], docs[0] * 4]
    docs += [text(400_000)]
    docs += [docs[-1][700_000:1_300_000]]
    numbered = list(enumerate(docs))
    rng.shuffle(numbered)
    df = spark.createDataFrame([(*d, "clash") for d in numbered], "doc_id bigint, text string, hash string").repartition(5)
    check(suffix_dedup.dedup_substrings(df, group_limit=group_limit), numbered)


def test_substrings_of_hot_triggers(spark, monkeypatch):
    """Phrases that share a trigger and no string are not taken apart into suffixes; those that share strings still lose them."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    made, table = [], suffix_dedup.Workspace.table

    def counted(self, df):
        out = table(self, df)
        if "suffix" in out.columns:
            made.append(out.where("suffix is not null").count())
        return out

    monkeypatch.setattr(suffix_dedup.Workspace, "table", counted)
    common, passage = text(60), text(160)
    alone = [f"{text(90)}{common}{text(90)}" for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(alone)), "doc_id bigint, text string").repartition(4)
    check(suffix_dedup.dedup_substrings(df, group_limit=30), list(enumerate(alone)))
    assert sum(made) < len(alone)
    edited = [passage[:i] + "#" + passage[i + 1 :] for i in range(0, 160, 3)]
    docs = alone + [f"{text(90)}{p}{text(90)}" for p in [passage] * 60 + edited + edited[:9]] + [alone[7], text(30) + alone[8]]
    numbered = list(enumerate(docs))
    rng.shuffle(numbered)
    df = spark.createDataFrame(numbered, "doc_id bigint, text string").repartition(4)
    check(suffix_dedup.dedup_substrings(df, group_limit=30), numbered)
    assert sum(made) > 0  # some strings are still compared one by one


def test_pieces_of_phrases():
    """Every string of a phrase lies in one piece, and equal strings lie in pieces of equal keys."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abcd") for _ in range(400)) for _ in range(8)]
    texts += [t[20 + i : 200 + 9 * i] + t[:150] for i, t in enumerate(texts)]
    keys = {}
    for t in texts:
        places = []
        for first, last, at, *_ in zip(*suffix_dedup.phrases(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)])), strict=True):
            for key, begin, piece in suffix_dedup.pieces_of(t[first : last + 100], int(at - first), int(last - first)):
                for i in range(len(piece) - 99):
                    places.append(int(first) + begin + i)
                    assert piece[i : i + 100] == t[places[-1] : places[-1] + 100]
                    assert keys.setdefault(piece[i : i + 100], key) == key
        assert sorted(places) == list(range(len(t) - 99))


def test_substrings_odd_rows(spark, odd_docs, no_docs):
    out = suffix_dedup.dedup_substrings(odd_docs)
    assert out.count() == odd_docs.count()
    by = {(r.doc_id, r.text): len(r.repeats.kept) for r in out.collect()}
    assert by[(1, None)] == by[(2, "")] == 0
    assert len({str(r.repeats) for r in out.where("doc_id = 4 and text like 'same%'").collect()}) == 1
    six = out.where("doc_id = 6").first()
    assert len(six.repeats.kept) == 0
    assert suffix_dedup.dedup_substrings(no_docs).count() == 0


def test_substrings_of_string_ids_and_clashing_names(spark):
    passage = "a passage that is longer than one hundred bytes " * 4
    rows = [("x1", "first " + passage, "a", "b"), ("x2", "second " + passage, "a", "b"), (None, "no copy", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _ranges string, _hash string")
    out = suffix_dedup.dedup_substrings(docs)
    assert out.columns == [*docs.columns, "repeats"]
    got = {r.doc_id: r.repeats.n_bytes - len(r.repeats.kept) for r in out.collect()}
    assert got[None] == 0 and sum(n > 90 for n in got.values()) >= 1 and all(r._hash == "b" for r in out.collect())


def test_substrings_without_repeats(spark):
    """Texts that share a trigger and no string of 100 bytes."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    common = text(90)
    docs = [(i, f"{text(150)}{common}{text(150)}") for i in range(3)]
    check(suffix_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id bigint, text string")), docs)


def test_substrings_query(spark, sf_dir, documents):
    want = brute_repeats(list(documents[["doc_id", "text"]].itertuples(index=False, name=None)))
    got = queries.QUERIES["op5_suffix_dedup"](spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id]


def test_toxicity_query(spark, documents):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op3_toxicity"](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert len(got) == len(pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id"]))
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    m = got[got.held_out].merge(labels, on="doc_id")
    assert (m.predicted == m.toxic).mean() > 0.93
    assert m[m.toxic == 1].score.mean() > m[m.toxic == 0].score.mean() + 0.5
    hit = ((m.predicted == 1) & (m.toxic == 1)).sum()
    precision, recall = hit / (m.predicted == 1).sum(), hit / (m.toxic == 1).sum()
    assert precision > 0.8 and recall > 0.5, (precision, recall)


def test_toxicity_learns_shared_ngrams():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 9)))
    bad = ["gruntfuzz", "blorpwit", "snarglebex"]
    texts, labels = [], []
    for i in range(400):
        w = [word() for _ in range(80)]
        if i % 4 == 0:
            w[rng.randrange(80)] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels)
    score = lambda t: 1 / (1 + np.exp(-model.logit(model.values(toxicity.words(t)))))
    plain = " ".join(word() for _ in range(100))
    assert score(plain) < 0.5
    for misspelt in ("gruntfuz", "bblorpwit", "snarglebexx", "Gruntfuzz!"):
        assert score(f"{plain} {misspelt} {plain}") > 0.7, misspelt


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.score for r in toxicity.classify(odd_docs, none).collect()] == [0.5] * odd_docs.count()
    some = spark.createDataFrame([(1, 1), (None, 1), (5, 0), (5, None), (6, 1), (99, 1)], "doc_id bigint, toxic int")
    out = toxicity.classify(odd_docs, some)
    assert out.count() == odd_docs.count() and set(odd_docs.columns) <= set(out.columns)
    assert toxicity.classify(no_docs, some).count() == 0
