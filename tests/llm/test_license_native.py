import os
import subprocess
import sys


def test_the_scan_starts_no_python_worker():
    """The whole scan, its fit included, in a session whose Python workers cannot start."""
    code = """
from pyspark.sql import SparkSession, functions as F
from folio.llm.license_scan import license_scan
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
text = F.concat(F.lit("line "), "id", F.lit("\\nReleased under the MIT License.\\nend"))
docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, text).otherwise("He went home.").alias("text"))
print("found", license_scan(docs).where("family = 'mit'").count())
"""
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYSPARK_PYTHON": "/bin/false", "PYSPARK_DRIVER_PYTHON": sys.executable}, capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert "found 20" in run.stdout, run.stderr[-3000:]
