"""The content store writes few parts, and none where nothing is new."""

from __future__ import annotations

from tidemark.sources import content_store
from tidemark.sources.content_store import ContentStore, scan_files


def test_a_prefix_is_one_part_and_what_is_known_is_not_written(spark, tmp_path, monkeypatch):
    raw = tmp_path / "raw"
    for folder in ("a", "b"):
        (raw / folder).mkdir(parents=True)
        for k in range(400):
            (raw / folder / f"{k}.bin").write_bytes(b"x%d" % (k if k % 2 else k + 1000 * (folder == "b")))
    store, parts = ContentStore(spark, f"file://{tmp_path}/store"), lambda: sorted((tmp_path / "store").rglob("*.parquet"))
    assert store.add(scan_files(spark, str(raw))).where("cache_status = 'written'").count() == 800  # equal files of one name are told alike
    assert store.read().count() == store.read().select("sha256").distinct().count() == 600
    first = parts()
    assert len(first) == len({p.parent for p in first}) > 200
    (tmp_path / "store" / "_SUCCESS").unlink()
    assert store.add(scan_files(spark, str(raw))).where("cache_status = 'already-exists'").count() == 800
    assert parts() == first and not (tmp_path / "store" / "_SUCCESS").exists()
    monkeypatch.setattr(content_store, "PART_BYTES", 1)  # several tasks a prefix
    large = ContentStore(spark, f"file://{tmp_path}/large")
    large.add(scan_files(spark, str(raw)))
    assert large.read().count() == large.read().select("sha256").distinct().count() == 600
