"""Files of many videos: their number goes with the rows, not with the videos, and what is read back is what was written."""

from pyspark.sql import functions as F

from posetrail.sources import annotations as T
from posetrail.sources import projects as J

VIDEOS = 40
MAP = {"other": ("o", "#000"), "run": ("r", "#fff")}


def files(path):
    return list(path.rglob("part-*"))


def labels(spark):
    rows = spark.range(VIDEOS * 6).select((F.col("id") % VIDEOS - 1).alias("video_id"), F.expr("id div 40").alias("frame"))
    return rows.withColumn("label", F.expr("cast(pmod(video_id + frame, 2) as int)"))


def test_onehot(spark, tmp_path):
    a, path = labels(spark), tmp_path / "onehot"
    T.write_onehot(a, str(path), ["other", "run"], MAP, a.groupBy("video_id").agg((F.max("frame") + 1).alias("total")))
    assert len(files(path)) < VIDEOS
    got = sorted(tuple(r) for r in T.read_onehot(spark, str(path), f"{path}.json").collect())
    assert got == sorted((v, f, ("other", "run")[(v + f) % 2]) for v in range(-1, VIDEOS - 1) for f in range(6))


def test_annotation_text(spark, tmp_path):
    path = tmp_path / "text"
    bouts = labels(spark).select("video_id", F.col("frame").alias("start"), F.col("frame").alias("end"), F.when(F.col("label") == 1, "run").otherwise("other").alias("category"))
    T.write_annotation(bouts, str(path), MAP)
    assert len(files(path)) < VIDEOS
    got = sorted(tuple(r) for r in T.read_annotation(spark, str(path)).collect())
    assert got == sorted((v, f, ("other", "run")[(v + f) % 2]) for v in range(-1, VIDEOS - 1) for f in range(6))
    assert {n: k for n, (k, _) in T.read_categories(spark, str(path)).items()} == {"other": "o", "run": "r"}
    lines = T.read_lines(spark, str(path)).where("video_id = 7").collect()
    assert [r["value"] for r in lines if r["value"].startswith("\t")] == [f"\t{f}\t{f}\t{('other', 'run')[(7 + f) % 2]}" for f in range(6)]


def test_annotation_text_of_one_file_each(spark, tmp_path):
    """Folders that name the video, with a form feed inside of a text, are read as before."""
    for v in (3, 4):
        (tmp_path / f"video_id={v}").mkdir()
        (tmp_path / f"video_id={v}" / "a.txt").write_text(f"Tool\fpage\nConfiguration file:\nrun\tr\n\nS1:\tstart\tend\ttype\n\t{v}\t{v}\trun\n")
    assert sorted(tuple(r) for r in T.read_annotation(spark, str(tmp_path)).collect()) == [(3, 3, "run"), (4, 4, "run")]


def test_workspace(spark, tmp_path):
    a = labels(spark).repartition(8)
    J.save_workspace({"labels": a}, str(tmp_path))
    assert len(files(tmp_path / "labels")) < VIDEOS
    whole = J.load_workspace(spark, str(tmp_path), ["labels"])["labels"]
    assert sorted(tuple(r) for r in whole.select(*a.columns).collect()) == sorted(tuple(r) for r in a.collect())
    one = J.load_workspace(spark, str(tmp_path), ["labels"], video=5)["labels"]
    assert sorted(tuple(r) for r in one.select("video_id", "frame", "label").collect()) == [(5, f, (5 + f) % 2) for f in range(6)]
    # the filter reaches the files' statistics
    assert "PushedFilters: [IsNotNull(video_id), EqualTo(video_id,5)]" in one._jdf.queryExecution().toString()
