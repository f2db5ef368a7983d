"""The pipeline against a brute-force version of its stages on a small table."""

import random

import pytest

import corpus_pipeline
from lectern.llm import decontaminate
from tests.conftest import SF


def make(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rnd = random.Random(11)
    word = lambda g: f"{g}{rnd.randrange(3000)}x"
    passage = [word("p") for _ in range(60)]
    item = [word("b") for _ in range(30)]
    texts = {}
    for i in range(40):
        texts[i] = [word("w") for _ in range(rnd.randint(80, 160))]
    for i in (40, 41):  # a near copy and a copy
        texts[i] = list(texts[5])
    texts[40][10] = "changed"
    for i in (42, 43, 44):  # one passage in three documents
        texts[i] = [word("w") for _ in range(100)] + passage + [word("w") for _ in range(100)]
    texts[45] = [word("w") for _ in range(100)] + item
    texts[46] = ["short", "text"]
    rows = {i: " ".join(t) for i, t in texts.items()}
    table = pa.table({"doc_id": pa.array(list(rows), pa.int64()), "text": list(rows.values()), "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(t) for t in rows.values()], pa.int64())})
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [" ".join(item)]}), tmp_path / "benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = make(tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        left.append(docs.toPandas())
    assert all(list(x.columns) == columns for x in left[:-1])
    assert set(left[0].doc_id) == set(rows) - {46}
    assert set(left[1].doc_id) == set(rows) - {46, 40, 41}
    cut = left[2].set_index("doc_id")
    assert set(cut.index) == set(left[1].doc_id)
    assert cut.text[42] == rows[42] and len(cut.text[43].split()) == 200 and len(cut.text[44].split()) == 200 and all(cut.text[i] == rows[i] for i in range(40))
    assert (cut.n_chars == cut.text.str.len()).all()
    assert set(left[3].doc_id) == set(left[2].doc_id) - {45}
    packed = left[4].groupby("doc_id").length.sum()
    assert set(packed.index) == set(left[3].doc_id) and (left[4].groupby("sequence_id").length.sum() <= 4096).all()
    assert decontaminate.WINDOW == 13


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty(spark, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, SF).count() == 0
