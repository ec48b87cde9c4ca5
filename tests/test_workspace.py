"""Tables of a run: written, read back, removed."""

import os

from railloom.workspace import Workspace, close_opened, opened, shared_dir


def test_tables_are_removed_when_closed(spark):
    before = opened()
    kept, gone = Workspace(spark, "kept"), Workspace(spark, "gone")
    tables = [w.table(spark.range(3), "t") for w in (kept, gone)]
    assert [t.count() for t in tables] == [3, 3] and opened() == before + 2
    close_opened(before + 1)
    assert os.path.exists(f"{kept.root}/t") and not os.path.exists(gone.root) and opened() == before + 1
    kept.drop("t")
    assert not os.path.exists(f"{kept.root}/t")
    close_opened(before)
    assert not os.path.exists(kept.root) and kept.root.startswith(shared_dir(spark))
