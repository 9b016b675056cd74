"""Projects, workspaces and catalogues."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posetrail.operators.numbers import small


@dataclass(frozen=True)
class Project:
    """What poses of a project hold. Without individuals there is one animal."""

    keypoints: tuple[str, ...]
    individuals: tuple[str, ...] = ()
    scorer: str | None = None
    multi_animal: bool = False
    skeleton: tuple[tuple[str, str], ...] = field(default=())

    @property
    def animals(self) -> int:
        return len(self.individuals) or 1


def whole_text(spark: SparkSession, path: str) -> str:
    """The text of a small side file."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one file is expected at {path}")
    return rows[0][0]


def read_project(spark: SparkSession, path: str) -> Project:
    """A project's YAML (or JSON) file: scorer, multianimalproject, bodyparts or multianimalbodyparts, individuals, skeleton."""
    text = whole_text(spark, path)
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no project")
    many = bool(found.get("multianimalproject", False))
    return Project(
        keypoints=tuple(found.get("multianimalbodyparts" if many else "bodyparts") or ()), individuals=tuple(map(str, found.get("individuals") or ())),
        scorer=found.get("scorer"), multi_animal=many, skeleton=tuple((str(a), str(b)) for a, b in found.get("skeleton") or ()),
    )


def project_table(spark: SparkSession, project: Project) -> DataFrame:
    """(keypoint, name, bones) of a project, bones being the keypoints that it is tied to."""
    at = {n: i for i, n in enumerate(project.keypoints)}
    bones: dict[int, set[int]] = {i: set() for i in at.values()}
    for a, b in project.skeleton:
        if a in at and b in at:
            bones[at[a]].add(at[b])
            bones[at[b]].add(at[a])
    return spark.createDataFrame([(i, n, sorted(bones[i])) for n, i in at.items()], "keypoint int, name string, bones array<int>")


def save_workspace(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below path, dealt and sorted by video_id, so that one video's state lies together and is read alone by the files'
    statistics. A file holds many videos, and a large video may have several, so files grow with the rows and not with the videos."""
    for name, table in tables.items():
        table.hint("rebalance", "video_id").sortWithinPartitions("video_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_workspace(spark: SparkSession, path: str, names: list[str], video: int | None = None) -> dict[str, DataFrame]:
    """The tables of a workspace, or those of one video."""
    out = {n: spark.read.parquet(f"{path.rstrip('/')}/{n}").withColumn("video_id", F.col("video_id").cast("bigint")) for n in names}
    return out if video is None else {n: t.where(F.col("video_id") == video) for n, t in out.items()}


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(date, cage, type) of a CSV without a header, whose first column begins with the date; of repeated keys the greatest type."""
    rows = spark.read.schema("day string, cage string, type string").csv(path)
    return rows.groupBy(F.split(F.trim("day"), " ")[0].alias("date"), F.trim("cage").alias("cage")).agg(F.max(F.trim("type")).alias("type"))


def output_names(paths: DataFrame, catalogue: DataFrame, marker: str = "Marathon") -> DataFrame:
    """(path, type, role, day_num, name) of files like ``20240103 Marathon/0105/A01x_cam.joblib``; null where a part is missing.

    The folder with the marker begins with the project's day; a folder of four digits below it is the recording's month and day. The
    subject is the file name up to the first underscore, less its last character; its first character is the cage. Of type L, subject
    01 is subordinate and others are dominant; of other types it is the other way round.
    """
    parts = F.split(F.regexp_replace("path", r"\\", "/"), "/")
    at = F.array_position(F.transform("parts", lambda p: p.contains(marker)), F.lit(True)).cast("int")
    p = paths.withColumn("parts", parts).withColumn("at", F.when(at > 0, at))
    p = p.withColumn("date", F.split(F.get("parts", F.col("at") - 1), " ")[0]).withColumn("sub", F.when(F.size("parts") > F.col("at") + 1, F.get("parts", F.col("at"))))
    p = p.withColumn("subject", F.regexp_extract(F.element_at("parts", -1), r"^([^_]*)._", 1)).withColumn("subject", F.nullif("subject", F.lit("")))
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date")
    later = F.when(F.col("sub").rlike(r"^\d{4}$"), F.datediff(day(F.concat(F.substring("date", 1, 4), F.col("sub"))), day(F.col("date"))) + 1)
    p = p.withColumn("day_num", F.coalesce(later, F.lit(1)).cast("int")).withColumn("cage", F.substring("subject", 1, 1))
    j = p.join(F.broadcast(catalogue) if small(catalogue) else catalogue, ["date", "cage"], "left")
    first = F.substring(F.col("subject"), -2, 2) == "01"
    role = F.when(F.col("type").isNull() | F.col("subject").isNull(), F.lit(None)).when((F.col("type") == "L") == first, "sub").otherwise("dom")
    j = j.withColumn("role", role)
    name = F.concat(F.substring("date", 5, 4), F.lit("_"), F.col("role"), F.lit("_day"), F.col("day_num").cast("string"), F.lit("_"), F.col("subject"), F.lit(".csv"))
    return j.select("path", "type", "role", "day_num", name.alias("name"))
