from pyspark.sql import functions as F

from sextant.operators import grounding as G
from sextant.operators import orphans as O
from sextant.streaming import grading
from tests import schemas as S
from tests.test_orphans import D


def test_stream_equals_batch(spark, tmp_path):
    text = "The provider shall test the model. It is late."
    a = [(f"a{i}", "succeeded", ("s", ("m", "x", "r", "end_turn", [("text", text, None)], None)), None, D(2024, 1, 1 + i)) for i in range(3)]
    req = spark.createDataFrame([(f"a{i}", None, None, None, None, "Extracts:\n\n[d:art_1] Article 1\nThe provider shall test the model.\n\nQuestion: x?", None) for i in range(3)], S.REQUESTS)
    src = spark.createDataFrame(a + a[:1], S.ANSWERS).withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    grading.graded_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), req, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    want = G.answer_grading(G.unit_verdicts(src.dropDuplicates(["custom_id"]), req)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["n_grounded"] for r in got} == {1}


def test_orphan_state_stream(spark, tmp_path):
    s = "key string, n_references int, n_existing int"
    for i, rows in enumerate([[("k", 1, 0)], [("k", 0, 1), ("z", 2, 0)]]):
        spark.createDataFrame(rows, s).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(s).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    grading.orphan_stream(stream, str(tmp_path / "st"), str(tmp_path / "cp")).awaitTermination()
    state = spark.read.parquet(str(tmp_path / "st" / "state=1"))
    assert sorted(tuple(r) for r in O.current_orphans(state).collect()) == [("z", 2, 0)]
