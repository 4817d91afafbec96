import pyarrow as pa

from personweave.llm.batches import checkpointed, free_names, quoted, remove, scratch, shared_folder, slices


def test_slices_hold_all_rows_within_the_bound():
    texts = ["a" * 10, None, "", "b" * 100, "c" * 5, "d" * 5, "é" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [p.column("text").to_pylist() for p in slices(batch, "text", 20, 3)]
    assert sum(parts, []) == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 20 for p in parts) and max(map(len, parts)) <= 3


def test_shared_folder(spark):
    folder = f"{shared_folder(spark)}/x"
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).count() == 3
    remove(spark, folder)
    assert not any("/x" in p for p in map(str, __import__("pathlib").Path(shared_folder(spark).removeprefix("file:")).glob("x")))


def test_names():
    assert free_names(["__ID", "x"], "__id", "__id", "y") == ["__id_", "__id__", "y"]
    assert quoted("a.b`c") == "`a.b``c`"


def test_scratch_is_removed(spark):
    folder = f"{shared_folder(spark)}/scratch"
    with scratch(spark, folder):
        assert checkpointed(spark.range(3)).count() == 3
        place = __import__("pathlib").Path(folder.removeprefix("file:"))
        assert len(list(place.iterdir())) == 1
    assert not place.exists()
