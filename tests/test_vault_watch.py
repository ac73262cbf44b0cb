"""The vault's stream: new, changed and deleted files, restarts, batches that are read again."""

from __future__ import annotations

import os

from lodestone.plans import jobs
from lodestone.streaming import vault_watch


def test_changes_between_listings(tmp_path):
    root = tmp_path / "vault"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("one")
    (root / "sub" / "b.md").write_text("two")
    (root / "c.txt").write_text("no note")
    reader = vault_watch._Reader(str(root), str(tmp_path / "listings"), ".md")
    rows, first = reader.read(reader.initialOffset())
    assert [(p, s) for p, s, *_ in rows] == [("a.md", "new"), ("sub/b.md", "new")] and first == {"listing": 1}
    assert [list(reader.read(first)[0]), reader.read(first)[1]] == [[], first]
    (root / "a.md").write_text("longer")
    os.remove(root / "sub" / "b.md")
    rows, second = reader.read(first)
    changes = [(p, s) for p, s, *_ in rows]
    assert changes == [("a.md", "changed"), ("sub/b.md", "deleted")] and [(p, s) for p, s, *_ in reader.readBetweenOffsets(first, second)] == changes
    reader.commit(second)
    assert os.listdir(tmp_path / "listings") == ["2.json"]


def test_stream_brings_the_index_up_to_date(spark, tmp_path, monkeypatch):
    root, store, checkpoint = tmp_path / "vault", str(tmp_path / "store"), str(tmp_path / "checkpoint")
    root.mkdir()
    (root / "a.md").write_text("# A\nred fox\n")
    (root / "b.md").write_text("# B\nhen\n")
    runs, real = [], jobs.index_vault
    monkeypatch.setattr(jobs, "index_vault", lambda *a, **k: runs.append(real(*a, **k)))

    def watch():
        query = vault_watch.watch_vault(spark, str(root), store, checkpoint, once=True)
        assert query.awaitTermination(120) and query.exception() is None

    watch()
    assert runs == [{"new": 2}]
    watch()  # nothing has changed since
    assert runs == [{"new": 2}]
    (root / "a.md").write_text("# A\nblue whale\n")
    os.remove(root / "b.md")
    watch()
    assert runs[1:] == [{"changed": 1, "deleted": 1}] and sorted(r.rel_path for r in jobs.vault_tables(spark, store)["files"].collect()) == ["a.md"]
