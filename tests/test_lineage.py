"""Files of an application go when its session stops."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false"){conf}.getOrCreate()
from posetrail.operators import lineage
df = lineage.cut(spark.range(100))
df.write.parquet(lineage.scratch(spark, "made"))
assert df.count() == 100
print("ROOT", lineage.root(spark), flush=True)
{end}
"""


def left(conf: str, end: str) -> tuple[str, list[Path]]:
    code = CODE.format(repo=str(Path(__file__).resolve().parents[1]), conf=conf, end=end)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout
    root = next(x.split()[1] for x in out.splitlines() if x.startswith("ROOT"))
    return root, [p for p in Path(root).rglob("*") if p.is_file()] if Path(root).exists() else []


def test_nothing_stays_after_a_stop(tmp_path):
    assert left(f'.config("spark.checkpoint.dir", {str(tmp_path)!r})', "spark.stop()") == (str(tmp_path), [])


def test_nothing_stays_after_an_exit(tmp_path):
    assert left(f'.config("spark.checkpoint.dir", {str(tmp_path)!r})', "") == (str(tmp_path), [])
