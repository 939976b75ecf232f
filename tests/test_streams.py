"""Bounded streams leave their rows and their state in files, none in the driver."""

import pytest

from foliant import plans


@pytest.mark.parametrize("name", ["stream_dedup", "stream_progress", "stream_segment_text"])
def test_rows_come_from_files(spark, tiny, name, monkeypatch, tmp_path):
    from foliant.plans import registry

    root = tmp_path / name
    monkeypatch.setattr(registry, "_shared", lambda b, what: str(root), raising=False)
    df = plans.queries()[name](spark, tiny)
    files = df.inputFiles()
    assert files and all(str(root / "out") in f for f in files)
    assert (root / "checkpoint" / "offsets").is_dir() and list((root / "checkpoint" / "commits").iterdir())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("stream_")]
