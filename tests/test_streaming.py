from pyspark.sql import functions as F

from personweave.schemas import EMAILS, extracted, record
from personweave.streaming.incremental import fuse_stream


def test_only_touched_entities_are_fused_anew(spark, tmp_path):
    def land(n, keys):
        df = spark.createDataFrame([(k,) for k in keys], "k string")
        mail = F.array(record(EMAILS, address=F.concat(F.col("k"), F.lit(f"{n}@x.co")), is_primary=F.lit(True)))
        extracted(df, entity_key="k", src_ord=F.lit(n), source_type=F.lit("csv"), source_id=F.lit(f"s{n}"), emails=mail).write.mode("append").parquet(str(tmp_path / "in"))

    land(0, ["a", "b"])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    run = lambda: fuse_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), *[str(tmp_path / n) for n in ("store", "out", "check")], as_of="2024-01-01").awaitTermination()
    run()
    land(1, ["b"])
    run()
    first, second = ({r["entity_key"]: len(r["emails"]) for r in spark.read.parquet(str(tmp_path / "out" / f"batch={n}")).collect()} for n in (0, 1))
    assert first == {"a": 1, "b": 1} and second == {"b": 2}


def test_a_batch_reads_the_buckets_of_its_entities_alone(spark, tmp_path, monkeypatch):
    from personweave.streaming import incremental

    def land(n, keys):
        df = spark.createDataFrame([(k,) for k in keys], "k string")
        extracted(df, entity_key="k", src_ord=F.lit(n), source_type=F.lit("csv"), source_id=F.concat(F.lit(f"s{n}"), F.col("k"))).write.mode("append").parquet(str(tmp_path / "in"))

    read = []
    real = incremental.fuse

    def spy(sources, as_of):
        read.append(set(sources[0].inputFiles()))
        return real(sources, as_of)

    monkeypatch.setattr(incremental, "fuse", spy)
    land(0, [f"k{i}" for i in range(200)])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    run = lambda: fuse_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), *[str(tmp_path / n) for n in ("store", "out", "check")], as_of="2024-01-01", buckets=64).awaitTermination()
    run()
    land(1, ["k7"])
    run()
    second = spark.read.parquet(str(tmp_path / "out" / "batch=1")).collect()
    assert [(r["entity_key"], r["merged_from"]) for r in second] == [("k7", ["s0k7", "s1k7"])]
    own = spark.createDataFrame([("k7",)], "entity_key string").select(incremental.bucket_of(buckets=64)).first()[0]
    assert len(read[0]) >= 50 and read[1] and all(f"__bucket={own}/" in f for f in read[1])
