"""The pipeline's stages against brute force, each on its own input."""

import os
import re
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(FOLD))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    tables = [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            rows = docs.collect()
            assert all(r.n_chars == len(r.text) for r in rows) or k != 2
            tables.append({r.doc_id: r.text for r in rows})
    source, known, apart, cut, clean = tables
    assert known == {i: t for i, t in source.items() if t and any(c.isalpha() for c in t)}

    root = {i: i for i in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t) for i, t in known.items()}
    for a, b in combinations(sorted(known), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert set(apart) == {i for i in known if find(i) == i}

    seen: set[bytes] = set()
    for i in sorted(apart):
        raw = apart[i].encode()
        gone = np.zeros(len(raw), bool)
        own = [raw[k : k + 50] for k in range(len(raw) - 49)]
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = True
        seen.update(own)
        assert cut[i] == bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")

    items = [words_of(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    runs = {tuple(w[i : i + 3]) for w in items for i in range(len(w) - 2)}
    for i, text in cut.items():
        words = words_of(text)
        joined = f" {' '.join(words)} "
        if any(f" {' '.join(w)} " in joined for w in items):
            assert i not in clean
        elif not any(tuple(words[k : k + 3]) in runs for k in range(len(words) - 2)):
            assert i in clean
    packed = docs.toPandas()
    assert set(packed["doc_id"]) == set(clean)
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_stages_leave_other_columns_alone(spark):
    """Nulls, empty texts, repeated rows and columns named as the stages' own."""
    line = "many words stand in this long line of text that comes again in the second document of the table"
    own = ["score", "lang_pred", "kept", "_sha", "_gone", "_may", "_lead", "_id", "_edited", "_found", "found", "part", "bits", "sha", "place"]
    texts = [f"first {line}", f"second one begins in quite another way and with rather more words of its own before it has {line}", None, "", "12 34", "a short clean one", "a short clean one"]
    rows = [(i, t, None if i % 2 else "en", "s", None if t is None else len(t), *(f"{c}{i}" for c in own)) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "a text without id", None, None, None, *("x" for _ in own))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in own)).repartition(3)
    before = {r.doc_id: r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        for r in docs.collect():
            assert all(r[c] == before[r.doc_id][c] for c in own)
    kept = docs.collect()
    assert {r.doc_id for r in kept} == {None, 0, 1, 5}
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()} == {None, 0, 1, 5}
