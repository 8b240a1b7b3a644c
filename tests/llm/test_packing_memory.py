"""What packing holds in memory: words met once aren't kept, and few rows are read at once."""

import zlib

import pytest

from radiograph.llm import common, packing
from radiograph.llm.queries import tokenizer_path


@pytest.mark.parametrize("most", [packing.CACHED_WORDS, 50])
def test_words_met_once_are_not_kept(monkeypatch, most):
    monkeypatch.setattr(packing, "CACHED_WORDS", most)
    tokens = packing.WordTokenizer(tokenizer_path())
    words = [f"{zlib.crc32(str(i).encode()):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(20_000)]
    once = " ".join(words)
    assert tokens.ids(once) == tokens._encoded(once)
    assert len(tokens.known) + len(tokens.older) < 1_000
    again = " ".join(words[:300] * 2 + ["Größe, naïve!", "new-word", "日本語 text"] * 3)
    for _ in range(3):
        assert tokens.ids(again) == tokens._encoded(again)
    assert most == 50 or len(tokens.known) >= 300


def test_few_rows_are_read_at_once(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    try:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
        common.small_batches(spark)
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == common.READ_ROWS
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "64")  # less is left alone
        common.small_batches(spark)
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == 64
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
