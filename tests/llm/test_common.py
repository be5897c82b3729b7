import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracery.llm import bpe_codec, common


def test_slices_hold_all_rows_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["x"]) for n in (0, 1, 5, 6)]
    found = list(common.sliced(iter(batches), 2))
    assert max(b.num_rows for b in found) == 2
    assert [x for b in found for x in b.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]


def test_tables_are_written_and_discarded(spark, tmp_path, monkeypatch):
    assert common.shared_dir(spark).startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/")
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/app")
    table = common.written(spark.range(5), "five")
    assert table.count() == 5 and list(tmp_path.glob("*/five-*"))
    common.discard(table)
    assert not list(tmp_path.glob("*/five-*"))


def test_the_session_keeps_its_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    common.map_texts(common.texts(spark.createDataFrame([(1, "a")], "doc_id long, text string")), lambda d: {"n": [len(x) for x in d]}, "n long").collect()
    assert spark.conf.get(key) == before


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = lambda self: {}

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_words_in_use_survive_a_full_cache(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe_codec, "CACHED", 2)
    own, fresh = (bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json")) for _ in range(2))
    data = [f"some common words and number {k} again" for k in range(20)]
    assert [own.encode_batch([t])[0] for t in data] == fresh.encode_batch(data)


def test_a_filter_holds_all_its_keys_and_few_others(spark):
    r = np.random.default_rng(3)
    keys, others = (r.integers(-(2**63), 2**63, 5000) for _ in range(2))
    own = common.Filter.of(spark.createDataFrame([(int(k),) for k in keys], "key long"), "key")
    assert own.passes(keys).all() and own.passes(others).mean() < 0.02
    frame = spark.createDataFrame([(int(k),) for k in others], "key long")
    assert frame.where(own.column(spark, F.col("key"))).count() == own.passes(others).sum()
    empty = common.Filter.of(frame.limit(0), "key")
    assert not empty.passes(keys).any() and empty.passes(keys[:0]).shape == (0,)
