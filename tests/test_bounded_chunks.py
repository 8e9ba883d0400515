import pandas as pd

from quillspan.operators import chunking


def test_chunks_are_handed_over_in_small_frames(monkeypatch):
    """what a batch or a long text gives is not held at once."""
    frame = pd.DataFrame({"source_id": ["a", "b", "c"], "unit_id": "u", "start_char": [0, 5, 0], "unit_text": ["word. " * 400, "", "字" * 90]})
    policy = chunking.ChunkPolicy(100, 20)
    whole = list(chunking.chunk_frames(iter([frame]), policy))
    monkeypatch.setattr(chunking, "FRAME_CHARACTERS", 300)
    parts = list(chunking.chunk_frames(iter([frame]), policy))
    assert len(whole) == 1 and len(parts) > 5 and max(p.length.sum() for p in parts) < 400
    assert pd.concat(parts, ignore_index=True).equals(whole[0])


def test_batches_of_texts_are_small(spark):
    units = spark.createDataFrame([("a", "u", 0, "text")], "source_id string, unit_id string, start_char long, unit_text string")
    assert chunking.chunks(units).count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
