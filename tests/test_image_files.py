"""Files of pages."""

from pyspark.sql import functions as F

from seqlattice.plans import queries as core
from seqlattice.sources import io


def test_pages_lie_in_one_folder_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A table of one split is dealt to many tasks, each page to a file of its own, without a folder for each; a page without text keeps its row."""
    spark.range(40).select(F.col("id").alias("page_id"), F.when(F.col("id") != 7, F.repeat(F.lit("\u00e9 <b>"), F.col("id").cast("int"))).alias("html")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    seen, read = [], io.read_images
    monkeypatch.setattr(io, "read_images", lambda s, path, glob=None: seen.append(read(s, path, glob)) or seen[-1])
    got = {r["page_id"]: r["length"] for r in core.QUERIES["s14_read_images"](spark, str(tmp_path)).collect()}
    assert got == {i: None if i == 7 else 6 * i for i in range(40)}
    paths = [r["path"] for r in seen[0].select("path").collect()]
    assert len(paths) == 40 and len({p.rpartition("/")[0] for p in paths}) == 1
    assert len({p.rpartition("/")[2][:10] for p in paths}) > 1
