import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1


def test_without_the_corpus_package():
    """The rest imports and registers when featurescope.llm and corpus_pipeline are not there."""
    code = """
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("featurescope.llm"):
                    raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        q = e.queries()
        assert "neighborhood_summary" in q and not any(x.startswith("op") or x == "pipeline" for x in q)
        assert not any(m.startswith("featurescope.llm") for m in sys.modules)
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_streamed_counts(spark, tmp_path):
    from pyspark.sql import functions as F

    from featurescope.streaming.audit import class_counts

    rows = spark.range(300).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"))
    rows.write.parquet(f"{tmp_path}/in")
    late = rows.select((F.col("ts") + F.expr("interval 2 days")).alias("ts"), "kind").limit(1)
    late.write.parquet(f"{tmp_path}/late")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = class_counts(stream, time="ts", label="kind").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").start()
    q.processAllAvailable()
    late.write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from counts").collect()
    assert len(got) == 15 and all(r.n == 20 for r in got)


def test_oracle_is_sql():
    import __spark_entry__ as e

    assert all(isinstance(sql, str) for sql in e.oracle_sql().values())
