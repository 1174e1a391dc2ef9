"""What a worker holds of a batch of texts follows a bound, not the batch."""

import tracemalloc

import public_tokenizers
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from sparklines.llm.sentencepiece_codec import encode_documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_of_a_batch_are_written_as_they_come(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, fn, schema: taken.append(fn) or self)
    encode_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PIECES)
    texts = ["the cat sat on a mat " * 200, "", "ab " * 1000] * 1000
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    [fn], rows, most, peak = taken, 0, 0, 0
    list(fn(iter([batch.slice(0, 3)])))  # the model
    tracemalloc.start()
    try:
        for out in fn(iter([batch])):
            assert out.column(0).to_pylist() == list(range(rows, rows + out.num_rows))
            rows, most = rows + out.num_rows, max(most, out.nbytes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and most < 3e6 and peak < 10e6, (rows, most, peak)
    assert list(fn(iter([batch.slice(0, 0)]))) == []
