"""Files that come in are handed on once, changed ones again; members of archives; a step that fails."""

from __future__ import annotations

import io
import os
import tarfile
import zipfile

import pytest

from ragframe.sources.incoming import Incoming, members
from ragframe.sources.versioned import ChunkStore


def put(root, name, text, when):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(path, (when, when))


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(f"deep/{name}.md", text)
    return out.getvalue()


def test_each_file_once(spark, tmp_path):
    root, seen = tmp_path / "in", []
    box = Incoming(spark, str(root), f"{tmp_path}/ledger")
    take = lambda: box.take(lambda df: seen.append(sorted((r["store"], r["file_name"], r["text"]) for r in df.collect())))
    put(root, "a/x.md", "one", 1000)
    put(root, "a/empty.md", "", 1000)
    put(root, "b/deep/y.md", "two \xe9", 2000)
    put(root, "b/all.zip", archive(p="in zip", q=""), 500)
    assert take() == 3 and seen.pop() == [("a", "x.md", "one"), ("b", "p.md", "in zip"), ("b", "q.md", ""), ("b", "y.md", "two \xe9")]
    assert take() == 0 and not seen
    put(root, "a/x.md", "other", 1000)  # the same time, another length
    put(root, "b/old.md", "came late, looks old", 10)
    put(root, "a/empty.md", "no more", 1000)
    assert take() == 3 and seen.pop() == [("a", "empty.md", "no more"), ("a", "x.md", "other"), ("b", "old.md", "came late, looks old")]
    put(root, "a/x.md", "OTHER", 1001)  # the same length, another time
    again = Incoming(spark, str(root), f"{tmp_path}/ledger")  # after a restart
    assert again.take(lambda df: seen.append([r["text"] for r in df.collect()])) == 1 and seen.pop() == ["OTHER"] and take() == 0


def test_a_failed_step_is_repeated_and_the_store_has_it_once(spark, tmp_path):
    root, store = tmp_path / "in", ChunkStore(spark, f"{tmp_path}/store")
    box = Incoming(spark, str(root), f"{tmp_path}/ledger")
    put(root, "s/a.md", "# A\nfirst", 1000)

    def dies_late(df):
        store.ingest(df)
        raise RuntimeError("after the commit")

    with pytest.raises(RuntimeError):
        box.take(dies_late)
    assert box.take(store.ingest) == 1 and store.latest() == 1
    put(root, "s/a.md", "# A\nsecond", 1001)
    put(root, "s/b.zip", archive(c="# C\nzipped"), 1001)
    assert box.take(store.ingest) == 2 and box.take(store.ingest) == 0
    assert sorted(r["text"] for r in store.chunks().collect()) == ["# A\nsecond", "# C\nzipped"]


def test_members():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in (("d/a.md", b"aa"), ("b.md", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    assert list(members("x/t.tar.gz", out.getvalue())) == [("x/t.tar.gz!/d/a.md", b"aa"), ("x/t.tar.gz!/b.md", b"")]
    assert list(members("x/t.zip", b"broken")) == [("x/t.zip", b"broken")] and list(members("x/t.tgz", b"")) == [("x/t.tgz", b"")]
    assert list(members("x/plain.md", b"text")) == [("x/plain.md", b"text")]
