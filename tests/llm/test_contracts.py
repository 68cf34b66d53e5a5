"""Each query's operator against a brute-force version of its contract, on awkward rows and on the smallest tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lodestar.llm import decontaminate, embeddings, language, licenses, lines, minhash, packing, pii, substrings, token_files
from lodestar.llm.queries import vocabulary
from lodestar.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, node long, label string, bucket string"


def corpus():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, base = text(70), text(120).split()
    docs = [None, "", "  \n\t ", "one", "One two\x0bthree", "one TWO three", "é ßa 中文  x", "a b c d", "A b\nc d", "!!! ??? 123", " x y"]
    docs += [text(rnd.randint(1, 150)) for _ in range(12)]
    docs += [f"{text(rnd.randint(0, 40))} {passage} {text(rnd.randint(0, 40))}" for _ in range(6)]
    docs += [passage, passage, " ".join(passage.split()[:49]), " ".join(passage.split()[5:60])]
    for _ in range(14):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        docs.append(" ".join(w))
    docs += [text(3000) + " " + passage, "ab " * 300, "ab " * 61, docs[12], docs[12]]
    docs += ["same line\nshared boiler\nother " + text(3) for _ in range(7)] + ["  shared boiler \n\n\nown"]
    rnd.shuffle(docs)
    out = [(t, i * 3 + 1, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", None]), 1, 7, "x", "b") for i, t in enumerate(docs)]
    return [*out, out[3], out[3], (out[5][0], None, "en", "s0", 1, 7, "x", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def real(sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"]) for r in t]


def rows_of(df, key=None):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- near-duplicate texts


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_near(rows, width=4):
    sets = [(d, shingles(t, width)) for d, t in rows]
    known = [(d, s) for d, s in sets if d is not None]
    links = [(a, b) for i, (a, s) in enumerate(known) for b, t in known[:i] if s and t and a != b and 100 * len(s & t) >= 80 * len(s | t)]
    root = roots({d for d, _ in known}, links)
    return sorted(((d, len(s), root.get(d), d is None or root[d] == d) for d, s in sets), key=lambda r: tuple((x is not None, x) for x in r))


def test_minhash_is_brute_force(docs):
    assert rows_of(minhash.minhash_near_duplicates(docs, width=4)) == brute_near([(r.doc_id, r.text) for r in docs.collect()])


def test_minhash_on_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(minhash.minhash_near_duplicates(df, width=4)) == brute_near(real(sf))


def test_minhash_links_across_a_bucket(spark):
    """A chain whose least member is near to one neighbour only still becomes one group."""
    w = [f"w{i}" for i in range(120)]
    chain = [(100 - k, " ".join(w[k * 4 : k * 4 + 80])) for k in range(10)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert rows_of(minhash.minhash_near_duplicates(df, width=4)) == brute_near(chain)


# --- passages


def brute_passages(rows, width=50):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("width", [50, 12])
def test_passages_are_brute_force(docs, width):
    assert rows_of(substrings.repeated_passages(docs, width)[0]) == brute_passages([(r.doc_id, r.text) for r in docs.collect()], width)


def test_passages_on_table(spark, sf):
    assert rows_of(substrings.repeated_passages(spark.read.parquet(f"{sf}/documents.parquet"))[0]) == brute_passages(real(sf))


def test_covers_are_difference_covers():
    for v, d in substrings.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


# --- tokens


ODD = ["a \xa0b", " \t\n x  y\x1c z\x85 q　　k", "don't I'LL it's <|endoftext|> hi", "é ́x ΑΣ. İ ﬁ", "१२ 3²½ _a_ --\n\n\n", "🙂🙂 👍🏽x\r\n\r\n y", "ends in space ", "  two  ", "É's ça, (x)|"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_ids_of_whole_texts(name, sf):
    enc, rnd = Encoder(vocabulary(name), memo_pieces=50), random.Random(2)
    texts = ODD + ["".join(rnd.choice("a b\n\t\xa0　\x1c'sS.éΣ1² \r\x85,|)ÀßX") for _ in range(40)) for _ in range(400)] + [t for _, t in real(sf)[:60]]
    for t in texts:
        assert enc.encode(t.encode()) == enc.whole(t), t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library_as_it_is(name):
    """Against a tokenizer that nothing has touched, special strings included; one text passes 65,536 pieces."""
    library, enc, rnd = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name), memo_pieces=50), random.Random(8)
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "<|endoftext|><|endoftext|>"]
    texts = ODD + ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|> ", "x<|startoftext|>y\n<|endoftext|>  z"]
    texts += ["".join(rnd.choice([*special, "a", "B c", " ", "\n", "it's", "É", "1 2", ","]) for _ in range(12)) for _ in range(300)]
    texts.append(" ".join(rnd.choice(["word", "Other", "x1", "-"]) for _ in range(140_000)))
    for t in texts:
        assert np.frombuffer(enc.encode(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:200]


def ids_of(enc, text, end):
    return np.append(np.frombuffer(enc.whole(text) if text else b"", "<u4"), end).astype("<u4")


def test_packing(docs):
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    got = packing.pack_sequences(docs, vocabulary("byte_bpe_50k.json"), size=256, group_docs=40).toPandas()
    by_doc, bins = {}, {}
    for r in got.itertuples():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id if r.doc_id == r.doc_id else None), []).append(r)
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert set(texts) == set(by_doc)
    for d, t in texts.items():
        ids = ids_of(enc, t[0], 0)
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert sum(r.length for r in parts) == len(ids) * len(t)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.length == 256 or r.piece == 0
    assert len(bins) <= np.ceil(got.length.sum() / 256) + 4


def test_best_two_fit_is_tight():
    rnd = np.random.default_rng(3)
    lengths = np.clip(rnd.lognormal(6, 1, 5000).astype(int), 1, 2047).tolist()
    where, offset, bins = packing.best_two_fit(lengths, 2048)
    fill = np.bincount(where, weights=lengths)
    assert fill.max() <= 2048 and len(fill) == bins and bins <= np.ceil(sum(lengths) / 2048) + 4
    assert packing.best_two_fit([], 10)[2] == 0 and packing.best_two_fit([6, 5, 5, 4], 10)[2] == 2


def test_token_files_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, vocabulary("word_bpe_49k.json"), shard_tokens=500)
    got = rows_of(token_files.read_token_files(spark, path))
    enc, at, want = Encoder(vocabulary("word_bpe_49k.json")), 0, []
    for d, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = ids_of(enc, t, 2)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_damaged_blocks_are_noticed():
    from lodestar.llm.rans import Table, checkpoints, decode_blocks, encode_shard

    ids = np.random.default_rng(1).integers(0, 300, 150_000)
    table = Table(np.bincount(ids))
    data = encode_shard(ids, table)
    assert (decode_blocks(data, table) == ids).all() and len(checkpoints(data)) == 5
    assert (decode_blocks(data, table, range(2, 4)) == ids[2 * 32_768 : 4 * 32_768]).all()
    with pytest.raises(ValueError):
        decode_blocks(data[:-5] + b"\0" + data[-4:], table)
    with pytest.raises(ValueError):
        decode_blocks(data, Table(np.ones(5)))


# --- vectors


def brute_vectors(rows, cosine):
    good = {}
    for i, (v, e, label) in enumerate(rows):
        if v is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        good[i] = np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64))
    links = [(i, j) for i in good for j in good if i < j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine]
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    ids = {r[0] for r in rows if r[0] is not None}
    root = roots(ids, [(rows[i][0], rows[j][0]) for i, j in links])
    return sorted(((r[0], n[i], root.get(r[0]), r[0] is None or root[r[0]] == r[0]) for i, r in enumerate(rows)), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("block", [2048, 40])
def test_vectors_are_brute_force(spark, block):
    rnd = np.random.default_rng(4)
    heart = rnd.normal(size=16)
    rows = [(i, rnd.normal(size=16).tolist(), int(rnd.integers(0, 2))) for i in range(150)]
    rows += [(1000 - i, (heart + rnd.normal(size=16) * 0.12 * rnd.random()).tolist(), 0) for i in range(120)]
    rows += [(2000 + i, (heart * (i + 1)).tolist(), i % 3) for i in range(9)] + [(3000 + i, rows[4][1], rows[4][2]) for i in range(6)]
    rows += [(4000, None, 0), (4001, [0.0] * 16, 0), (4002, [float("nan")] * 16, 0), (4003, [None] * 16, 0), (4004, heart.tolist(), None), (4005, [1.0, 2.0], 0), (4006, [], 0), (4007, [float("inf"), 1.0], 0), (None, rows[5][1], 1)]
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], "vec_id long, embedding array<double>, label int, w long, grp string").repartition(3)
    assert rows_of(embeddings.embedding_near_duplicates(df, 0.98, block)) == brute_vectors(rows, 0.98)


def test_vectors_on_table(spark, sf):
    t = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    assert rows_of(embeddings.embedding_near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))) == brute_vectors(t, 0.98)


# --- benchmark items


def least_edits(item, text):
    prev = list(range(len(item) + 1))
    best = prev[-1]
    for c in text:
        row = [0]
        for i, x in enumerate(item, 1):
            row.append(min(prev[i] + 1, row[-1] + 1, prev[i - 1] + (x != c)))
        prev = row
        best = min(best, prev[-1])
    return best


def test_decontamination_is_brute_force(spark):
    rnd = random.Random(8)
    words = ["alpha", "bet", "gamma", "delta", "eps", "zeta"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(8))) for i in range(6)] + [(50, None), (51, " "), (52, "Tiny")]
    docs = []
    for i in range(60):
        t = list(rnd.choice(items[:6])[1])
        for _ in range(rnd.randint(0, 9)):
            t[rnd.randrange(len(t))] = rnd.choice("abcdefg  \n")
        docs.append((i, "x " * rnd.randint(0, 9) + "".join(t).upper() + " y" * rnd.randint(0, 9)))
    docs += [(90, None), (91, ""), (92, "a tiny thing")]
    got = decontaminate.contaminated(spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, item_id long"), spark.createDataFrame([(*i, "t") for i in items], "item_id long, text string, lang string"), rate=0.1, block_chars=60)
    want = set()
    for d, t in docs:
        for i, x in items:
            a, b = decontaminate.normalise(x or ""), decontaminate.normalise(t or "")
            if a and b and (n := least_edits(a, b)) <= int(0.1 * len(a)):
                want.add((d, i, n))
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == want and len(want) > 20


def first_best(item, text, most):
    """(distance, end) by an edit table whose first row is 0: the least distance, and where it is met first."""
    col = np.arange(len(item) + 1)
    best, it = None, np.array([ord(c) for c in item])
    for at, c in enumerate(text, 1):
        new = np.empty_like(col)
        new[0] = 0
        new[1:] = np.minimum(col[:-1] + (it != ord(c)), col[1:] + 1)
        new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        col = new
        if col[-1] <= most and (best is None or col[-1] < best[0]):
            best = (int(col[-1]), at)
    return best


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.2])
def test_decontamination_of_repeated_words(rate):
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "omega", "a", "be"]
    met = 0
    for _ in range(120):
        items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14)))) for i in range(6)]
        matcher = decontaminate.Matcher(items, rate)
        for _ in range(5):
            t = []
            for _ in range(rnd.randint(1, 3)):
                x = list(rnd.choice(items)[1])
                for _ in range(rnd.randint(0, 1 + int(2 * rate * len(x)))):
                    at = rnd.randrange(len(x))
                    x[at] = rnd.choice(["", "a", x[at] + rnd.choice("abeg "), " "])
                t += [rnd.choice(words), " ", *x, " "]
            text = decontaminate.normalise("".join(t))
            want = [(i, *b) for i, x in items if (b := first_best(decontaminate.normalise(x), text, int(rate * len(x))))]
            assert matcher.find(text) == sorted(want), (items, text)
            met += len(want)
    assert met > 500


def test_decontamination_finds_what_starts_left_of_an_earlier_hit():
    item = "gamma delta beta beta gamma delta gamma omega alpha omega delta beta"
    text = "zz gamma dlta betabatac gamma delt gamma omega alpha omega delta bea yy"
    assert decontaminate.Matcher([(1, item)], 0.1).find(text)[0][:2] == (1, 6)


def test_decontamination_edges(spark, none):
    long = "w x " * 100_000 + "the needle of the test stands here" + " y z" * 100_000
    docs = spark.createDataFrame([(1, long), (2, "ab"), (3, None), (2, "the needle of the test stands here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "The needle of the  test stands here"), (2, "b"), (3, None)], "item_id long, text string")
    meet = lambda **o: sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, **o).collect())
    assert meet() == [(1, 1), (2, 1), (2, 2)] == meet(block_chars=1) and meet(least_chars=2) == [(1, 1), (2, 1)]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 == decontaminate.contaminated(none, items).count()


# --- ids that stand for several rows, ties and clashing names


def test_repeated_vector_ids_keep_their_own_links(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 1), (3, [1.0, 1e-4, 0.0], 1), (5, b, 1), (2, [1e-4, 1.0, 0.0], 1), (5, b, 1)]
    out = embeddings.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in out) == [(2, 2, 2, True), (3, 1, 3, True), (5, 1, 3, False), (5, 2, 2, False), (5, 2, 2, False)]


def test_equally_distant_vectors(spark):
    rnd = np.random.default_rng(2)
    vectors = np.zeros((600, 40))
    for v in vectors:
        v[rnd.choice(40, 2, replace=False)] = 1.0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.embedding_near_duplicates(df, block=50).collect()}
    same = (vectors @ vectors.T) == 2
    for i in range(len(rows)):
        assert got[i].n_links == same[i].sum() - 1 and got[i].component_id == int(np.flatnonzero(same[i])[0])


def test_repeated_document_ids_with_other_texts(spark):
    word = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    a, p, tail, head = word("a", 60), word("p", 55), word("t", 20), word("h", 30)
    rows = [(1, a), (5, a), (5, p + " " + tail), (9, head + " " + p), (5, a), (9, a + " " + head)]
    got = sorted(tuple(r) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, 60, 0, sha(a)), (5, 60, 60, sha("")), (5, 60, 60, sha("")), (5, 75, 0, sha(p + " " + tail)), (9, 85, 55, sha(head)), (9, 90, 60, sha(head))])


def test_lines_with_clashing_names_and_long_lists(spark):
    rows = [(i, "s" if i else None, f"top\nown {i}\n" + "long " * 20_000, 7, 8, 9, 10, "h") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, __bad int, __lines int, __kept int, `__DROPPED` int, __host string")
    for most in (1_000_000, 0):
        out = lines.drop_boilerplate(df, ratio=0.1, min_pages=2, send_lines=most).collect()
        assert [(r["__bad"], r["__kept"], r["__host"], r["__lines"]) for r in out] == [(7, 9, "h", 3)] * 12
        assert all(r.text == (f"own {r.doc_id}" if r.doc_id else rows[0][2]) and r["__dropped"] == (2 if r.doc_id else 0) for r in out)


def test_hot_bucket_with_an_outsider_lists_no_pairs_inside_it(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(100)]
    texts = []
    for i in range(300):  # many near copies, each with changes of its own
        t = list(base)
        t[rnd.randrange(100)] = f"x{i}"
        texts.append(" ".join(t))
    for cut in (60, 70, 80, 85, 90):
        texts.append(" ".join(base[:cut]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = roots(range(len(sets)), links)
    got = minhash.minhash_near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(root.items() if isinstance(root, dict) else enumerate(root))


# --- languages


def test_language_held_out_accuracy(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    model = language.fit(df.where(~language.held_out(F.col("doc_id"))))
    out = language.predict(df, model, F.col("doc_id"), F.col("lang"), language.held_out(F.col("doc_id")).alias("held_out")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in test) >= 0.93 * len(test)


def brute_language(train, texts, max_n=5):
    """The model with plain dictionaries: train is (text, lang) rows."""
    words_of = lambda t: ["".join(g) for letter, g in itertools.groupby((t or "").lower(), str.isalpha) if letter]
    grams_of = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    langs = sorted({lang for t, lang in train if words_of(t)})
    counts = {n: {} for n in range(max_n + 1)}
    for t, lang in train:
        for w in words_of(t):
            for n in range(max_n + 1):
                for x in grams_of(w, n) if n else [w]:
                    counts[n].setdefault(x, dict.fromkeys(langs, 0))[lang] += 1
    logs = {}
    for n, c in counts.items():
        c = {x: v for x, v in c.items() if sum(v.values()) >= 2}
        add = 0.5 if n else 1.0
        total = {x: sum(v[x] for v in c.values()) + add * len(c) for x in langs}
        for x, v in c.items():
            p = [math.log((v[y] + add) / total[y]) for y in langs]
            logs[n, x] = [(y - sum(p) / len(p)) * (0.4 ** (max_n - n) if n else 1) for y in p]
    out = []
    for t in texts:
        words, z = words_of(t), [0.0] * len(langs)
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        for w in words:
            if (0, w) in logs:
                e = logs[0, w]
            else:
                s = f" {w} "
                hits = [next((logs[n, s[i : i + n]] for n in range(min(max_n, len(s) - i), 0, -1) if (n, s[i : i + n]) in logs), None) for i in range(len(s))]
                hits = [h for h in hits if h]
                e = [sum(h[k] for h in hits) / max(1, len(hits)) for k in range(len(langs))]
            z = [a + b for a, b in zip(z, e, strict=True)]
        z = [a * min(len(words), 20) / len(words) for a in z]
        p = [math.exp(a - max(z)) for a in z]
        out.append((langs[z.index(max(z))], max(p) / sum(p)))
    return out


def test_language_is_brute_force(spark, docs, sf):
    from pyspark.sql import functions as F

    mine = docs.where("lang is not null and text is not null").select("text", "lang", "doc_id").distinct().collect()
    texts = [r.text for r in docs.collect()] + ["x\u00bd", "\u00bd \u00b2 \u2460 7_", "\u4e00\u4e8c", "word " * 70_000 + "ende", "a1b2\u00b2c", "\u0130stanbul STRASSE Stra\u00dfe"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = language.fit(docs)
    want = brute_language([(r.text, r.lang) for r in mine], texts)
    got = sorted(language.predict(df, model, "doc_id").collect())
    assert sum(w[0] != "und" for w in want) > 40
    for r, (lang, score) in zip(got, want, strict=True):
        assert abs(r.score - score) < 1e-4 and (r.lang_pred == lang or abs(score - 0.5) < 1e-4), (texts[r.doc_id][:80], r, lang, score)
    assert got[len(texts) - 5].lang_pred == "und"
    # equal whatever the batches and the memo
    model.memo = 5
    assert [x[0] for x in model.predict(texts, chunk=7)] == [r.lang_pred for r in got]
    # the sample is the rows of least hash, whole and each once
    big = docs.union(docs)
    picked = language.sample(big, 3).collect()
    ranked = big.where("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text", "lang").alias("h")).distinct().collect()
    want = sorted((x, t) for x in ("de", "en") for _, t in sorted((r.h, r.text) for r in ranked if r.lang == x)[:3])
    assert sorted((r.lang, r.text) for r in picked) == want


def test_language_edges(docs, none):
    model = language.fit(docs)
    out = language.predict(docs, model, "doc_id", "text").collect()
    for r in out:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert {r.lang_pred for r in language.predict(docs, language.fit(none), "text").collect()} == {"und"}
    assert language.predict(none, model, "doc_id").count() == 0


# --- lines, licenses


def test_lines(docs):
    got = lines.drop_boilerplate(docs, host="source", ratio=0.08, min_pages=3).collect()
    rows, strip = docs.collect(), "\t\n\x0b\x0c\r "
    pages, seen = {}, {}
    for r in rows:
        pages[r.source] = pages.get(r.source, 0) + 1
        for x in {y.strip(strip) for y in (r.text or "").split("\n")} - {""}:
            seen[r.source, x] = seen.get((r.source, x), 0) + 1
    want = []
    for r in rows:
        keep = None if r.text is None else [y for y in r.text.split("\n") if not (n := seen.get((r.source, y.strip(strip)), 0)) >= 3 or not n / pages[r.source] > 0.08]
        want.append((r.doc_id, None if r.text is None else "\n".join(keep), 0 if r.text is None else r.text.count("\n") + 1 - len(keep)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r["__dropped"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 5


def test_host_of(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("https://u:p@Blog.Ex.com:8080/a?b#c",), ("http://x.y",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in df.select(lines.host_of(F.col("u"))).collect()] == ["blog.ex.com", "x.y", None, None]


def test_licenses(spark):
    mit = licenses.TEMPLATES[4][1]
    broken = mit.replace("person", "human").replace("without limitation", "with limits", 1)
    docs = [(1, "x. Released under the MIT License. y"), (2, "é " + mit + " tail"), (3, broken), (4, None), (5, ""), (6, "the license of nothing at all"), (7, "Licensed under CC\nBY-NC 4.0. " * 2), (8, "w " * 5000 + "released UNDER the mit-license")]
    got = licenses.license_notices(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, template int")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {d: sorted(r.license for r in v) for d, v in by.items()} == {1: ["MIT"], 2: ["MIT"], 3: ["MIT"], 7: ["CC-BY-NC-4.0"] * 2, 8: ["MIT"]}
    assert docs[0][1][by[1][0].start : by[1][0].end] == "Released under the MIT License" and by[2][0].coverage == 1.0
    assert 0.8 <= by[3][0].coverage < 1 and by[2][0].start == 2


def common_words(a, b):
    """Length of the longest common subsequence, by the whole table."""
    row = np.zeros(len(b) + 1, int)
    for x in a:
        hit = np.array([x == y for y in b])
        new = np.maximum(row[1:], np.where(hit, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def test_planted_licenses_are_recalled():
    rnd = random.Random(9)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, 0.1)
    noise = [f"word{i}" for i in range(50)] + ["the", "of", "license", "and", "software"]
    planted = found = 0
    for _ in range(400):
        k = rnd.randrange(len(licenses.TEMPLATES))
        words = re.findall("[A-Za-z0-9]+", licenses.TEMPLATES[k][1])
        changed = list(words)
        for _ in range(rnd.randint(0, len(words) // 12)):
            at = rnd.randrange(len(changed))
            changed[at : at + 1] = rnd.choice(([], ["other"], [changed[at], "more"]))
        before, after = ([rnd.choice(noise) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        text = " ".join([*before, *changed, *after])
        got = scanner.scan(text.encode())
        planted += 1
        # this template, or one that covers its place with as many words
        n = common_words([w.lower() for w in words], [w.lower() for w in changed])
        mine = [r for r in got if r[4] <= len(" ".join(before)) + 25 and r[3] >= min(n, 0.8 * len(words))]
        found += bool(mine)
        for name, j, coverage, n, a, b in got:  # what is reported is true
            have = [w.lower() for w in re.findall("[A-Za-z0-9]+", text[a:b])]
            want = [w.lower() for w in re.findall("[A-Za-z0-9]+", licenses.TEMPLATES[j][1])]
            assert n <= common_words(want, have) and n >= 0.8 * len(want) and abs(coverage - n / len(want)) < 1e-9 and name == licenses.TEMPLATES[j][0]
    assert found >= 0.95 * planted
    assert not any(scanner.scan(" ".join(rnd.choice(noise) for _ in range(300)).encode()) for _ in range(50))


def test_many_notices_in_one_text():
    import time

    text = ("Released under the MIT License. x y. " * 8_000 + licenses.TEMPLATES[4][1]).encode()
    began = time.monotonic()
    assert len(licenses.Scanner(licenses.TEMPLATES, 0.8, 0.1).scan(text)) == 8_001 and time.monotonic() - began < 20


def test_whole_texts_from_a_folder(tmp_path):
    (tmp_path / "Mine").write_text("a license of my own " + " ".join(f"clause{i}" for i in range(200)))
    scanner = licenses.Scanner(licenses.read_templates(str(tmp_path)), 0.8, 0.1)
    assert [r[:2] for r in scanner.scan(b"x " + (tmp_path / "Mine").read_bytes().replace(b"clause50 ", b""))] == [("Mine", 0)]


# --- personal data


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_pii(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "", re.ASCII) if ok(m[0])]


PII = [None, "", "mail a.b+c@x-y.co.uk, then é🙂 j@k.l_m@n.o", "a@b.c@d.e@f.g %@-.- x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 5", "+49 (30) 123.456-78 x +1 2 +123456789012345678 +1-800-555-0199- ++44 20 7946 0958", "5 " * 9000 + "x", "1" * 30000, "a" * 50000 + "@b.c", "." * 3000 + "1.1.1.1", "card 4111 1111 1111 1112 please, call (030) 1234 5678 or mail jo (at) ex (dot) com", "+" * 3000 + "12 345 67 89", "1-2-3-4" * 4000]


def test_pii(spark, sf):
    rnd = random.Random(3)
    texts = PII + ["".join(rnd.choice("0123456789....@@ab-- ++() _%é🙂,") for _ in range(rnd.randint(1, 120))) for _ in range(1500)] + ["".join(rnd.choice("0041111 - .+") for _ in range(80)) for _ in range(500)]
    texts += [t for _, t in real(sf)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, c string").repartition(4)
    got = {r.doc_id: r for r in pii.pii_report(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_pii(t)
        s = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(s.encode()).hexdigest(), (t, s, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in pii.BASE]
        spans = r.spans.split(",") if r.spans else []
        assert set(s.split(",") if s else []) <= set(spans) and len(set(spans)) == len(spans)
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))


def test_pii_estimates_which_labelers_to_trust():
    rows = [(3, 1, 1, 0, 0, 1, 1, 900), (3, 1, -1, 0, 0, -1, 1, 800), (3, 0, 1, 0, 0, 1, 1, 50), (3, 0, -1, 1, 0, 0, 1, 60)]
    reliable, weights = pii.estimate(rows)
    assert reliable["phone"]["words"] > 0.7 and weights["phone"][VOTE_WORDS] > 0


def test_pii_added_spans_against_planted_ones(spark):
    rnd = random.Random(6)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    prose = lambda: " ".join(rnd.choice("der die and the of to casa le Donaudampfschifffahrtsgesellschaft 7 und river 1999 en".split()) for _ in range(rnd.randint(3, 20)))
    plant = {
        "secret": lambda: ("token = \"", hexes(40), "\""),
        "secret ": lambda: ("api_key: ", "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(12)) + digits(4), ""),
        "secret  ": lambda: ("Authorization: Bearer ", "eyJ" + "".join(rnd.choice("abcdXYZ0123456789_") for _ in range(40)), ""),
        "email": lambda: ("contact ", f"jo.{digits(2)} (at) host{digits(1)}.com", ""),
        "phone": lambda: ("call ", f"(0{rnd.randint(10, 99)}) {rnd.randint(100, 999)} {rnd.randint(1000, 9999)}", ""),
    }
    other = [lambda: f"commit {hexes(40)}", lambda: f"sha256 {hexes(64)}", lambda: f"ISBN 978 {digits(4)} {digits(3)}", lambda: f"pages {digits(3)}-{digits(3)}", lambda: f"version {digits(2)}.{digits(3)}.{digits(3)}",
             lambda: "path/to/some/long/file/name/of/the/tree", lambda: f"order {digits(3)} {digits(4)} {digits(4)}", lambda: "x" * 40, lambda: f"mail a{digits(2)}@b.org", lambda: f"+49 30 {digits(8)}", lambda: "4111 1111 1111 1111"]
    docs, want = [], set()
    for i in range(1200):
        text = prose() + " "
        if i % 3 == 0:
            kind, make = rnd.choice(list(plant.items()))
            before, what, after = make()
            want.add((i, f"{kind.strip()}:{len(text) + len(before)}:{len(text) + len(before) + len(what)}"))
            text += before + what + after
        elif i % 3 == 1:
            text += rnd.choice(other)()
        docs.append((i, text + " " + prose()))
    got = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string"))
    added = {(r.doc_id, x) for r in got.select("doc_id", pii.span_text(pii.F.array_except("spans", "base")).alias("s")).collect() for x in r.s.split(",") if x}
    assert len(added & want) >= 0.9 * len(want) and len(added & want) >= 0.9 * len(added), (sorted(want - added)[:9], [(x, docs[x[0]][1]) for x in sorted(added - want)][:9])


def test_pii_many_matches_in_one_text(spark):
    import time

    texts = ["+49 30 123456 x " * 32_000, "a@b.c " * 20_000 + "jo (at) ex.com " * 5_000, "(030) 123 4567, " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    out = {r.doc_id: r for r in pii.pii_report(df).collect()}
    assert out[0].n_phone == 32_000 and out[1].n_email == 20_000 and time.monotonic() - began < 60
    assert out[0].base_sha256 == hashlib.sha256(",".join(f"phone:{16 * i}:{16 * i + 13}" for i in range(32_000)).encode()).hexdigest()


VOTE_WORDS = pii.VOTES.index("words")


# --- empty tables


def test_empty_tables(spark, none, tmp_path):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert minhash.minhash_near_duplicates(none).count() == 0
    assert substrings.repeated_passages(none)[0].count() == 0
    assert packing.pack_sequences(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert embeddings.embedding_near_duplicates(vectors).count() == 0
    assert lines.drop_boilerplate(none).count() == 0
    assert licenses.license_notices(none).count() == 0
    assert pii.pii_report(none).count() == 0
    assert decontaminate.contaminated(none, none.selectExpr("doc_id as item_id", "text")).count() == 0
    path = str(tmp_path / "ids")
    token_files.write_token_files(none, path, vocabulary("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, path).count() == 0


def test_language_model_reads_whole_texts_and_keeps_rare_languages(spark):
    rows = [(i, "the cat sat on the mat " * 50, "en") for i in range(5)] + [(5, "xxxx " * 2_000 + "zorgle zorgle", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.langs == ["aa", "en"]
    texts = spark.createDataFrame([(1, "zorgle"), (2, "the cat"), (3, "zorgles")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.predict(texts, model, "doc_id").collect()}
    # the word stands after 10,000 characters of the one text of its language, and an unseen form backs off to its n-grams
    assert got == {1: "aa", 2: "en", 3: "aa"}
