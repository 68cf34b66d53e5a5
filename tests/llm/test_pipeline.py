"""The pipeline's stages, each judged on its own input."""

import gc
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402
from lodestar.llm import decontaminate, language, minhash, tokens  # noqa: E402
from lodestar.llm.queries import vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the words of text number {i} and some more of the same kind {i * 7}", "en", "s", 1, "e") for i in range(30)]
    rows += [(100 + i, f"der die das und nicht {i} ein kleines wort von mir {i * 3}", "de", "s", 1, "e") for i in range(30)]
    rows += [(200, None, "en", "s", 1, "e"), (201, "", None, None, None, None), (202, "123 !!!", "en", "s", 1, "e"), (None, "the words of no number", "en", "s", 1, "e")]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_keep_columns_and_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_language_stage(spark, docs, sf):
    out = cp.language_stage(spark, docs, sf)
    assert out.columns == list(cp.COLUMNS)
    kept = {r.doc_id for r in out.collect()}
    assert not kept & {200, 201, 202} and None in kept and len(kept) == 61
    assert cp.language_stage(spark, docs.limit(0), sf).count() == 0


def test_near_duplicate_and_decontamination_stages(spark, docs, sf):
    item = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()[0]["text"]
    more = spark.createDataFrame([(500, "x y " * 9 + item + " tail", "en", "s", 1, "e"), (501, "the words of text number 0 and some more of the same kind 0", "en", "s", 1, "e"), (502, "The  words of text number 0 and some more of the same kind 0", "en", "s", 1, "e")], SCHEMA)
    all_ = docs.union(more)
    near = cp.near_duplicate_stage(spark, all_, sf)
    assert {r.doc_id for r in all_.collect()} - {r.doc_id for r in near.collect()} == {501, 502}
    clean = cp.decontamination_stage(spark, all_, sf)
    assert {r.doc_id for r in all_.collect()} - {r.doc_id for r in clean.collect()} == {500}
    assert near.columns == clean.columns == list(cp.COLUMNS)


def test_line_stage(spark, sf):
    rows = [(i, f"own line {i}\ncommon footer", "en", "a", 1, "e") for i in range(20)] + [(50 + i, f"common footer\nother {i}", "en", "b", 1, "e") for i in range(3)] + [(90, None, None, None, None, None), (91, "", "en", "a", 0, "e")]
    out = {r.doc_id: r for r in cp.line_stage(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()}
    assert len(out) == len(rows) and out[90].text is None and out[91].text == ""
    assert all(out[i].text == f"own line {i}" and out[i].n_chars == len(out[i].text) for i in range(20))
    assert all(out[50 + i].text == f"common footer\nother {i}" for i in range(3))  # three pages are too few to call a line boilerplate


def test_packing_stage(spark, docs, sf):
    out = cp.packing_stage(spark, docs, sf).toPandas()
    assert len(out) == docs.count() and out.length.sum() == sum(len(tokens.Encoder(vocabulary("byte_bpe_50k.json")).encode((r.text or "").encode())) // 4 + 1 for r in docs.collect())
    assert out.groupby("sequence_id").length.sum().max() <= 2048


def test_run_on_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_run(spark, sf):
    out = cp.run(spark, sf).toPandas()
    source = {r["doc_id"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    assert 0.5 * len(source) < out.doc_id.nunique() <= len(source) and set(out.doc_id) <= source


# --- memory of the workers, which serve one stage after the other


class Sent:
    """Stands for a broadcast."""

    def __init__(self, value):
        self.value = value


def model():
    keys = np.unique(language.word_keys(["the", "und", "les"]))
    return language.Model(["de", "en", "fr", "nl"], {0: (keys, np.array([[4, 0, 0, 1], [0, 5, 0, 0], [0, 0, 3, 2]], float)), 2: (np.arange(9, dtype=np.uint64), np.ones((9, 4)))}, 5)


def test_a_later_stage_lets_go_of_the_encoders_memo():
    doc = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "the words of a text", "lang": "en"}])
    texts = doc.select(["text", "lang"])
    for name, run in (("predict", lambda: language._predict(Sent(model()), 1, False)([doc])), ("count", lambda: language._count(5)([texts])), ("sketch", lambda: minhash._sketcher(5, 4, 2)([doc])), ("sets", lambda: minhash._set_maker(5)([doc])), ("matches", lambda: decontaminate._search(Sent([(1, "an item of the benchmark")]), 0.05, 1)([doc]))):
        memo = weakref.ref(tokens.encoder(vocabulary("byte_bpe_50k.json")))
        assert memo().encode(b"the words of a text") and tokens.encoder(vocabulary("byte_bpe_50k.json")) is memo()
        list(run())
        gc.collect()
        assert memo() is None, name


def test_language_of_many_new_words_in_bounded_memory():
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}wordsofmanyletters{chr(97 + i // 17576 % 26)}" for i in range(60_000)]
    m, other = model(), model()
    tracemalloc.start()
    got = m._evidence(words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    assert np.array_equal(got, other.of_words(words))


def test_language_returns_rows_in_small_batches():
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": None if i % 7 == 0 else f"the und {'les ' * (i % 5)}"} for i in range(5000)])
    out = list(language._predict(Sent(model()), 1, False)([batch, batch.slice(0, 0), batch.slice(3, 1)]))
    assert max(b.num_rows for b in out) <= 1024
    rows = pa.Table.from_batches(out)
    assert rows.column("doc_id").to_pylist() == [*range(5000), 3]
    assert list(zip(*(rows.column(c).to_pylist()[:5000] for c in ("lang_pred", "score")), strict=True)) == model().predict(batch.column(1).to_pylist())
