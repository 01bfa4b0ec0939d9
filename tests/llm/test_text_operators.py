"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellflow.llm import chat_format, decontamination, embedding_dedup, language_id, licenses, ngram_join, packing, repeat_removal, token_counts, toxicity
from cellflow.llm._graph import components
from cellflow.llm._suffixes import equal_windows, suffix_array

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way".split()
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    for i in range(20):  # near copies: a few words changed
        words = out[i * 2].split()
        for _ in range(len(words) // 25):
            words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    passage = prose(rng, 70)
    out += [f"{prose(rng, 5)} {passage} {prose(rng, 9)}" for _ in range(6)]
    out += [out[3]] * 5 + [out[3].upper()] + ["", None, "   \n\t", "one two", "One  Two", "é" * 90, "ab" * 80, "ab" * 80 + "c", prose(rng, 3000), "a\nb c d e f"]
    out += ["don't  stop\n\n now\t ", "<|endoftext|> x <|startoftext|>", "zażółć gęślą jaźń İstanbul ΣΊΣΥΦΟΣ", "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved. cc by", "cc  BY, all\nrights reserved"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", 1.0, 2, "s") for i, t in enumerate(texts)] + [(3, texts[3], "again", 0.0, 1, "s"), (3, "another text of the same id", "again", 0.0, 1, "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string, score double, bucket int, sha string").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def classes(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_ngram_join(docs, empty):
    rows = docs.collect()
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    want = classes({r.doc_id for r in rows}, links)
    got = ngram_join.link_documents(docs).collect()
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(s)) for i, s in sets)
    assert {r.doc_id: r.component_id for r in got} == want
    assert ngram_join.link_documents(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_ngram_join_with_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST", 3)
    rng = random.Random(9)
    base = prose(rng, 60).split()
    texts = []
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = prose(rng, 1) + "x"
        texts.append(" ".join(words))
    texts += [" ".join(base[:40]) + " " + prose(rng, 60) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [(i, shingles(t)) for i, t in enumerate(texts)]
    want = classes(range(len(texts)), [(a, b) for (a, x), (b, y) in combinations(sets, 2) if 100 * len(x & y) >= 75 * len(x | y)])
    assert {r.doc_id: r.component_id for r in ngram_join.link_documents(docs).collect()} == want


def test_index_keys_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    frequent = rng.random(1 << ngram_join.COUNTER_BITS) < 0.5
    for _ in range(300):
        n = int(rng.integers(1, 160))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = x[rng.random(len(x)) < 0.9]
        y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, max(0, len(x) - len(y)), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if len(y) and 100 * shared >= 75 * (len(x) + len(y) - shared):
            assert len(np.intersect1d(ngram_join.keys_of(x, frequent, 75), ngram_join.keys_of(y, frequent, 75)))
            assert ngram_join.may_link(len(x), ngram_join.sketch(x), len(y), ngram_join.sketch(y), 75)


def test_repeat_removal(docs, empty):
    rows = docs.collect()
    spans = {}
    starts: dict[bytes, int] = {}
    for r in rows:
        raw = (r.text or "").encode()
        for k in range(len(raw) - 49):
            w = raw[k : k + 50]
            starts[w] = min(starts.get(w, r.doc_id), r.doc_id)
    for r in rows:
        raw = (r.text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if starts[raw[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans.setdefault(r.doc_id, []).append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    got: dict[int, list] = {}
    for r in repeat_removal.measure_repeats(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in spans.items()}
    assert repeat_removal.measure_repeats(empty).count() == 0
    edited = repeat_removal.without_repeats(docs)
    assert edited.columns == docs.columns
    assert edited.count() == len(rows)
    assert {r.doc_id: r.text for r in edited.collect()}[80] is not None


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(300):
        text = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    runs = equal_windows([b"abcabcab", b"xxabca", b"abc"], 4)
    assert {tuple(sorted(r)) for r in runs} == {((0, 0), (1, 2)), ((0, 1), (0, 4))} or {tuple(sorted(r)) for r in runs} == {((0, 0), (0, 3), (1, 2)), ((0, 1), (0, 4))}


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_token_counts(docs, empty, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect())
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, path, frequent=50, cache_bits=6).collect())
    assert got == want
    assert token_counts.count_tokens(empty, path).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=64).collect()
    pieces: dict[int, list] = {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        pieces.setdefault(r.doc_id, []).extend((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    got: dict[int, list] = {}
    filled: dict[int, list] = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in pieces.items()}
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(filled) <= 1.05 * sum(r.length for r in rows) / 64 + 1
    assert packing.pack_documents(empty, path).count() == 0


def fewest(items, capacity):
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.randint(6, 30)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {k: items.count(k) for k in items}
        fixed, left = packing.dominance_reduction(counts, capacity)
        rest = sorted((k for k, n in left.items() for _ in range(n)), reverse=True)
        assert sum(t for t, _ in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)
        assert sorted([k for t, s in fixed for _ in range(t) for k in s] + rest, reverse=True) == items


def test_licenses(docs, empty):
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(FOLD))
        at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        labels = {label for _, label in at}
        for line in (r.text or "").translate(FOLD).split("\n"):
            own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
            labels |= {label for t, label in licenses.TEMPLATES.items() if len(own & set(t.split())) >= 0.9 * len(set(t.split()))}
        want = (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)))
        assert want in [(g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels) for g in got[r.doc_id]]
    assert licenses.scan(empty).count() == 0


def sellers(item, words):
    before, out = list(range(len(item) + 1)), []
    for w in words:
        now = [0]
        for i in range(1, len(item) + 1):
            now.append(min(before[i - 1] + (item[i - 1] != w), before[i] + 1, now[-1] + 1))
        out.append(now[-1])
        before = now
    return out


def test_edit_distances():
    rng = random.Random(2)
    for _ in range(300):
        item, words = ([rng.randint(0, 3) for _ in range(rng.randint(1, n))] for n in (12, 20))
        assert decontamination.edit_distances(item, words) == sellers(item, words)


def test_decontamination(spark, docs, empty):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 40)))) for i in range(30)] + [(90, ""), (91, None), (92, "! ?")]
    rows, planted = [], set()
    for i in range(120):
        words = prose(rng, 40).split()
        if i % 2:
            k, text = rng.choice(items[:30])
            part = text.split()
            for _ in range(len(part) // 8):
                part[rng.randrange(len(part))] = f"new{rng.randrange(99)}"
            at = rng.randrange(40)
            words[at:at] = part
            planted.add((i, k))
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.find_items(table, benchmark, block_bytes=800).collect()}
    assert len(planted - set(got)) <= 0.02 * len(planted)
    exact = dict(items)
    for (doc, k), edits in got.items():
        item = exact[k].split()
        assert edits == min(sellers(item, rows[doc][1].split()))
        assert edits <= len(item) / 4
    kept = {r.doc_id for r in decontamination.without_items(table, benchmark).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    assert decontamination.find_items(docs, benchmark.where("false")).count() == 0
    assert decontamination.find_items(empty, benchmark).count() == 0
    assert decontamination.without_items(docs, benchmark).columns == docs.columns


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((40, 16))
    x = np.concatenate([centers + 0.05 * rng.standard_normal((40, 16)) for _ in range(6)] + [rng.standard_normal((200, 16)), np.repeat(centers[:1], 50, 0)]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [], 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [float("inf")] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    for tile in (2048, 16):
        got = {r.vec_id: r for r in embedding_dedup.deduplicate(table, leaf=32, tile=tile).collect()}
        assert len(got) == len(rows)
        counts = np.array([got[i].n_links for i in range(len(x))])
        assert (counts <= near.sum(1)).all()
        assert counts.sum() >= 0.97 * near.sum()
        want = classes(range(len(x)), zip(*np.nonzero(near), strict=True))
        assert sum(got[i].component_id == want[i] for i in range(len(x))) >= 0.99 * len(x)
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904, 907))
        assert (got[905].n_links, got[906].component_id, got[906].kept) == (1, 905, False)
    assert embedding_dedup.deduplicate(table.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)] + [(700, 700)]
    want = {i: c for i, c in classes({i for p in links for i in p}, links).items() if i != c}
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == want


def test_language_id(spark, empty):
    rng = random.Random(7)
    stems = {"a": ["tha", "the", "wh", "ing"], "b": ["ö", "sch", "ung", "keit"], "c": ["é", "eau", "oux", "ai"]}
    rows = []
    for i in range(240):
        lang = "abc"[i % 3]
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang if i % 5 else None, "s"))
    rows += [(900, None, "a", "s"), (901, "", "a", "s"), (902, "12 34 !!", "b", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1
        assert (got[i].lang_pred == "und") == (not text or not any(c.isalpha() for c in text))
    assert sum(got[i].lang_pred == "abc"[i % 3] for i in range(240)) >= 230
    assert language_id.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 240


def test_network_gradients():
    rng = np.random.default_rng(0)
    codes, truth = rng.integers(97, 123, (5, 3)), np.array([0, 1, 0])
    seen = []

    def loss(model):
        p, _ = language_id.probabilities(model, codes)
        return -np.log(p[:, truth, np.arange(3)]).mean()

    model = {"ahead": {"w": rng.standard_normal((6, 256)) * 0.3, "u": rng.standard_normal((6, 2)) * 0.3}, "back": {"w": rng.standard_normal((6, 256)) * 0.3, "u": rng.standard_normal((6, 2)) * 0.3}, "out": {"v": rng.standard_normal((2, 4)), "c": np.zeros((2, 1))}}
    model = {p: {k: v.astype(np.float32) for k, v in d.items()} for p, d in model.items()}
    kept = ([], [])
    p, states = language_id.probabilities(model, codes, kept)
    p[:, truth, np.arange(3)] -= 1
    slope = (p / 15).astype(np.float32)
    into = np.matmul(model["out"]["v"].T, slope)
    grads = language_id.scan_back(model["ahead"], codes, kept[0], into[:, :2])
    for i, j in ((0, 0), (3, 1), (5, 0)):
        step = 1e-2
        high, low = (loss({**model, "ahead": {**model["ahead"], "u": model["ahead"]["u"] + s * step * (np.arange(6)[:, None] == i) * (np.arange(2)[None] == j)}}) for s in (1, -1))
        seen.append(abs((high - low) / (2 * step) - grads["u"][i, j]))
    assert max(seen) < 2e-3


def test_toxicity(spark, empty):
    rng = random.Random(11)
    rude = ["nasty", "rotten", "wretch", "vermin"]
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, rng.randint(5, 60)).split()
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 0, int(bad)))
    rows += [(900, None, "s"), (901, "", "s"), (902, "you n.a.s.t.y rot-ten thing", "s"), (903, "what a w r e t c h you are with verrmin", "s"), (904, "a clean text about time", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    table = spark.createDataFrame([*labels, (5, 0, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, table).collect()}
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert sum(got[i].predicted == int(i % 4 == 0) for i in range(400)) >= 395
    assert min(got[902].score, got[903].score) > max(got[900].score, got[901].score, got[904].score)
    assert toxicity.score_documents(docs.where("false"), table).count() == 0
    assert {r.predicted for r in toxicity.score_documents(docs, table.where("false")).collect()} == {0}


def test_string_kernel():
    def brute(s, t, k=toxicity.ORDER, decay=toxicity.DECAY):
        def parts(w):
            out: dict[str, float] = {}
            for at in combinations(range(len(w)), k):
                key = "".join(w[i] for i in at)
                out[key] = out.get(key, 0) + decay ** (at[-1] - at[0] + 1)
            return out

        x, y = parts(s), parts(t)
        return sum(v * y.get(u, 0) for u, v in x.items())

    pairs = [("idiot", "idiot"), ("idiot", "idxiot"), ("abc", "abc"), ("abcab", "bcabc"), ("ab", "abc")]
    got = toxicity.kernel(toxicity.letters([a for a, _ in pairs]), toxicity.letters([b for _, b in pairs]))
    assert np.allclose(got, [brute(a, b) for a, b in pairs], rtol=1e-4)


def test_kernels_of_words_are_exact():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(3, 16))) for _ in range(60)]
    marks = toxicity.Landmarks(words[:12])
    a, b = toxicity.letters(words), toxicity.letters(words[:12])
    want = np.stack([toxicity.kernel(a, np.repeat(b[m : m + 1], len(a), 0)) for m in range(12)], 1)
    want = want / np.sqrt(toxicity.kernel(a, a))[:, None] / np.sqrt(toxicity.kernel(b, b))[None]
    assert np.allclose(marks.compare(words), np.minimum(want, 1) ** 2, atol=1e-5)
    assert marks.compare(["", "a", "x" * 3]).max() == 0
    long = "abcdefgh" * 5  # the sum of its windows
    assert np.allclose(marks.compare([long])[0], marks.compare([long[k : k + 16] for k in range(0, 32, 8)]).sum(0), atol=1e-5)


def test_toxicity_scores_against_a_plain_rewrite():
    words, beta = ["stupid", "wretch", "rotten"], np.array([1.0, 0.5, -0.25])
    texts = ["a stuxpid thing. you wretch\nrotten day", "s t u p i d", "ж ш ы", "", "w.r.e.t.c.h and st0pid. rot-ten!", " ".join(["rotten"] * 70)]
    marks = toxicity.Landmarks(words)

    def value(text):
        sums = []
        for line in re.split(r"(?<=[.!?])\s+|\n", text):
            own = line.split()
            parts = [own[k : k + 64] for k in range(0, len(own), 64)]
            if len(own) > 2 and all(len(w) == 1 for w in own):
                parts = [["".join(own)]]
            sums += [float((marks.compare(p) @ beta).sum()) for p in parts if p]
        return max(sums, default=0)

    got = toxicity.Reader(words, beta).margins(pa.array(texts))
    assert np.allclose(got, [value(t) for t in texts], atol=1e-4)
    assert got[1] > 0.9


def test_inserted_letters_count(spark):
    rng = random.Random(12)
    rude = ["stupid", "wretched", "vermin", "rotten"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randint(8, 40)).split()
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    odd = ["stuxpid", "s t u p i d", "s.t.u.p.i.d", "stup1d", "verrmin", "wretchxed", "rot-ten"]
    rows += [(1000 + k, f"they said it was a {w} thing") for k, w in enumerate(odd)] + [(2000, "they said it was a good thing")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert all(got[1000 + k] > max(0.2, 5 * got[2000]) for k in range(len(odd))), {w: got[1000 + k] for k, w in enumerate(odd)}
    assert got[2000] < 0.1


def test_repeated_rows_still_teach_languages(spark):
    docs = spark.createDataFrame([(8, "the same words again and again", "a")] * 3500 + [(9, "schön übung größe straße", "b"), (9, "schön übung größe", "b")], "doc_id bigint, text string, lang string")
    model, langs = language_id.fit(docs)
    assert langs == ["a", "b"]
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs).collect()}
    assert "und" not in {p for _, p in got}


def test_states_against_a_plain_network():
    rng = np.random.default_rng(1)
    w = {"w": rng.standard_normal((6, 256)).astype(np.float32), "u": rng.standard_normal((6, 2)).astype(np.float32)}
    codes = rng.integers(97, 123, (7, 3))
    got = language_id.scan(w, codes)
    for row in range(3):
        h = np.zeros(2)
        for t in range(7):
            x, p = w["w"][:, codes[t, row]], w["u"] @ h
            z, r = np.clip(0.25 * (x[:2] + p[:2]) + 0.5, 0, 1), np.clip(0.25 * (x[2:4] + p[2:4]) + 0.5, 0, 1)
            h = z * h + (1 - z) * np.tanh(x[4:] + r * p[4:])
            assert np.allclose(got[t, :, row], h, atol=1e-4)


def test_pooled_probabilities_against_a_plain_mean():
    rng = np.random.default_rng(3)
    part = lambda: {"w": rng.standard_normal((6, 256)).astype(np.float32), "u": rng.standard_normal((6, 2)).astype(np.float32)}
    model = {"ahead": part(), "back": part(), "out": {"v": rng.standard_normal((3, 4)).astype(np.float32), "c": rng.standard_normal((3, 1)).astype(np.float32)}}
    texts = ["one 12 two", "é" * 100, "x"]
    got = language_id.pool(model, pa.array(texts))
    for text, mean in zip(texts, got, strict=True):
        raw = text.encode() + b"\n"
        sums = []
        for k in range(0, len(raw), 64):
            codes = np.full((64, 1), 10)
            codes[: len(raw[k : k + 64]), 0] = list(raw[k : k + 64])
            p, _ = language_id.probabilities(model, codes)
            sums += [p[t, :, 0] for t in range(64) if language_id.COUNTS[codes[t, 0]]]
        assert np.allclose(np.mean(sums, 0), mean, atol=1e-5)


def test_items_without_id(spark):
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, f"and {item} then"), (None, f"{item} too")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(None, item), (4, "quite other words stand here in this line")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_items(docs, benchmark).collect()} == {(1, None), (None, None)}


def test_ids_at_any_white_space(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    some = [" ", " ", "\t", "\n", "\u00a0", "\u2003", "\u3000", "\u0085", "\u1680", "\u2028", "\x1c", "\x1f", "\u200b", "a", "B", "7", "é", "'s", "-", "the"]
    texts = ["a \u00a0 \u00a0 b", *("".join(rng.choice(some) for _ in range(rng.randint(0, 24))) for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.token_pieces(docs, path).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(text)


def test_ids_of_another_kind_of_tokenizer(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(0, "The  Cat\nsat"), (1, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.ids_crc32 for r in packing.token_pieces(docs, path).collect()}
    assert got == {i: zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in enumerate(("The  Cat\nsat", ""))}


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes <|end|>"), (0, 2, "user", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", None), (4, 0, "user", "alone"), (6, 0, "system", "s"), (7, 0, "user", "u"), (None, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, prompt string")
    got = {r.pair_id: r for r in chat_format.format_preferences(turns, chat_format.neighbour_pairs(turns)).collect()}
    assert set(got) == {0, 1, 3}
    first = got[0]
    assert (first.prompt_turns, first.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert first.chosen == "<|assistant|>\nyes < |end|><|end|>\n<|user|>\nmore<|end|>\n"
    assert [first.chosen[a:b] for a, b in [map(int, s.split("-")) for s in first.chosen_mask.split(",")]] == ["yes < |end|><|end|>\n"]
    assert [first.rejected[a:b] for a, b in [map(int, s.split("-")) for s in first.rejected_mask.split(",")]] == ["no<|end|>\n"]
    assert (got[1].prompt_turns, got[1].chosen, got[1].rejected) == (1, "", "<|assistant|>\n<|end|>\n")
    assert (got[3].prompt_turns, got[3].prompt) == (0, "")
    assert chat_format.format_preferences(turns.where("false"), chat_format.neighbour_pairs(turns)).count() == 0
