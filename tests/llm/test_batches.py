import pyarrow as pa

from threadloom.llm.batches import parts


def test_parts_keep_order_and_bounds():
    texts = [None, "", "a" * 10, "b" * 3, "c" * 25, "d", None, "e" * 9] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["i", "t"])
    got = list(parts(batch, [1], 4, 12))
    assert [i for p in got for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 12) for p in got)
    assert [p.num_rows for p in parts(batch.slice(0, 0), [1], 4)] == [0]
