"""The folder source: every file once, in tasks, whatever the shape of the tree."""

from __future__ import annotations

import os

import pytest

from trialweave.sources import listing, manifests


@pytest.fixture
def tree(tmp_path):
    for pid in range(20):
        for date in ("2020-01-02", "2021-03-04")[: 1 + pid % 2]:
            folder = tmp_path / "ct" / f"pid {pid}" / date
            folder.mkdir(parents=True)
            for n in range(pid % 4):
                (folder / f"{n}.dcm").write_bytes(b"x" * n)
    (tmp_path / "ct" / "empty").mkdir()
    (tmp_path / "ct" / "top.txt").write_text("top")
    (tmp_path / "ct" / "pid 1" / ".hidden").write_text("h")
    return tmp_path / "ct"


@pytest.mark.parametrize("tasks, depth", [(1, 1), (7, 1), (7, 2), (50, 3), (3, 9)])
def test_every_file_once(spark, tree, tasks, depth):
    rows = listing.list_folder(spark, str(tree), tasks, depth).collect()
    want = {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tree) for f in names}
    assert {r.path: r.length for r in rows} == want and len(rows) == len(want)
    assert all(r.name == os.path.basename(r.path) and r.modified is not None for r in rows)


def test_the_tree_is_shared_among_tasks(spark, tree):
    frame = listing.list_folder(spark, f"file://{tree}", tasks=8)
    sizes = frame.rdd.glom().map(len).collect()
    assert len(sizes) == 8 and sum(n > 0 for n in sizes) > 3


def test_manifest_of_a_tree(spark, tree):
    files = manifests.manifest(spark, str(tree), r"/([^/]+)/(\d{4}-\d\d-\d\d)/[^/]+\.dcm$", ["pid", "scan_date"], tasks=4)
    scans = manifests.with_suffix(manifests.skip_hidden(files), ".dcm").select("pid", "scan_date").distinct().collect()
    assert {(r.pid, r.scan_date) for r in scans} == {(f"pid {p}", d) for p in range(20) if p % 4 for d in ("2020-01-02", "2021-03-04")[: 1 + p % 2]}


def test_an_empty_folder_and_one_that_is_not_there(spark, tree):
    assert listing.list_folder(spark, str(tree / "empty"), tasks=3).count() == 0
    with pytest.raises(Exception, match="not"):
        listing.list_folder(spark, str(tree / "absent"), tasks=3).count()
