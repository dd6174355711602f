"""What Python workers keep between tasks."""

from linemetry.llm import bpe
from linemetry.llm._memory import tidied
from linemetry.llm.queries import vocabulary_path


def test_another_operator_gives_back_a_workers_tokenizer(spark):
    rows = spark.range(8, numPartitions=4)

    def held(batches):
        """A row for each task: how many tokenizers its worker has."""
        import pyarrow as pa

        from linemetry.llm import bpe

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(bpe._tokenizers)], pa.int64())], ["n"])

    find = lambda *operator: [r.n for r in rows.mapInArrow(tidied(held, *operator), "n long").collect()]
    docs = rows.selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    first = bpe.encode_documents(docs, vocabulary_path()).orderBy("doc_id").collect()
    assert any(find("bpe"))  # a next task of the same operator finds it
    assert not any(find())
    assert bpe.encode_documents(docs, vocabulary_path()).orderBy("doc_id").collect() == first
