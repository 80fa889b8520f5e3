"""Workers need not have the package: what they get is rebuilt from plain data."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
docs = spark.createDataFrame([(i, "some words of text " * (i % 4 + 1) + str(i), "en" if i % 2 else "de", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
docs.write.parquet({data!r} + "/documents.parquet")
spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet({data!r} + "/labels.parquet")
spark.createDataFrame([(i * 25, [10.0 + i % 4, 1.0], i % 2) for i in range(40)], "vec_id long, embedding array<double>, label int").write.parquet({data!r} + "/embeddings.parquet")
spark.createDataFrame([(i // 3, i % 3, "user", "hello" if i % 3 else str(i % 2)) for i in range(40)], "conv_id long, turn long, role string, text string").write.parquet({data!r} + "/conversations.parquet")
def seen(_):
    try:
        import loomquery
        return True
    except ImportError:
        return False
assert not any(spark.sparkContext.range(4).map(seen).collect())
for name in ("op2_lm_score", "op4_quality_grade", "op5_exact_topk", "op6_sentencepiece", "op8_language_id", "op9_simhash_near_dedup", "op10_best_fit_packing", "op11_hard_negatives", "op12_prefix_trie", "op13_token_files"):
    assert __spark_entry__.queries()[name](spark, {data!r}).count() > 0, name
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("data", "elsewhere"):
        os.mkdir(tmp_path / name)
    script = SCRIPT.format(repo=repo, shared=f"file://{tmp_path}/shared", data=f"{tmp_path}/data")
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK_", "SPARK_"))}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-3000:]
