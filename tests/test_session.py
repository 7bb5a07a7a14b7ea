import os

import pytest

from docloom import session


class Other:
    """A session of a cluster, as far as the folder is concerned."""

    def __init__(self, spark, master, folder):
        self.folder, self.conf = folder, self
        self.sparkContext = type("C", (), {"master": master, "_jsc": spark.sparkContext._jsc, "setCheckpointDir": lambda *_: None})()

    def get(self, key, default):
        return self.folder or default


def test_checkpoint_folder_is_the_session_s(spark):
    assert session.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.checkpoint_dir(Other(spark, "spark://x", "file:///shared")) == "file:///shared"
    for master in ("spark://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.checkpoint_dir(Other(spark, master, None))
    own = session.checkpoint_dir(Other(spark, "local[2]", None))
    assert os.path.isdir(own) and own == session.checkpoint_dir(Other(spark, "local", None))


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    cut = session.cut_lineage(df)
    assert cut.columns == ["n"] and sorted(r.n for r in cut.collect()) == list(range(10))
