"""The segmented text index: against the scan of all texts after every kind of change, after merges and after broken runs."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.operators.segments import SegmentedIndex
from lodestone.operators.textindex import TextIndex
from lodestone.plans import jobs

SCHEMA = "file_id string, chunk_hash string, mtime_ns long, rel_path string, start_byte long, heading_path string, text string"


def as_chunks(spark, notes):
    """notes: by path a time and texts, one for each chunk."""
    rows = [(f"{p}#{k}", t, at, p, 10 * k, "red", t) for p, (at, texts) in notes.items() for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def same(index, chunks, queries=("red", "red fox", "nowhere", "")):
    for q in queries:
        got = [tuple(r) for r in index.topk(q, 6).select("file_id", "mtime_ns", "hits", F.round("bm25", 9)).collect()]
        want = [tuple(r) for r in search.bm25_topk(chunks, q, 6).select("file_id", "mtime_ns", "hits", F.round("bm25", 9)).collect()]
        assert got == want, q


def test_index_equals_the_scan_after_changes(spark, tmp_path):
    rnd = random.Random(3)
    write = lambda: [" ".join(rnd.choice(["red", "fox", "hen", "a", "the"]) for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 4))]
    notes = {f"n{k}.md": (k, write()) for k in range(6)}
    store = SegmentedIndex(spark, str(tmp_path / "index"), most=2)
    assert store.index().topk("red", 3).count() == 0
    store.add(as_chunks(spark, notes))
    same(store.index(), as_chunks(spark, notes))
    for step in range(2):
        changed = {p: (100 + step, write()) for p in rnd.sample(sorted(notes), 2)} | {f"m{step}.md": (50 + step, write())}
        gone, touched = [sorted(set(notes) - set(changed))[step]], [sorted(set(notes) - set(changed))[-1]]
        notes = {p: v for p, v in notes.items() if p not in gone} | changed
        notes |= {p: (1000 + step, notes[p][1]) for p in touched}
        paths = lambda ps: spark.createDataFrame([(p,) for p in ps], "rel_path string")
        before = store.generation()
        now = store.add(as_chunks(spark, changed), paths(gone), paths(touched).withColumn("mtime_ns", F.lit(1000 + step)))
        assert len(now.segments) == len(before.segments) + 1 and now.chunks == sum(len(t) for _, t in notes.values())
        same(store.index(), as_chunks(spark, notes), ("red fox",))
    merged = store.merge()
    assert len(merged.segments) <= 3 and merged.number == now.number + 1
    same(store.index(), as_chunks(spark, notes))
    whole = store.merge(everything=True)
    assert list(whole.segments.values()) == [whole.chunks] and whole.changes == []
    same(store.index(), as_chunks(spark, notes), ("red fox",))
    counts = lambda i: sorted(map(tuple, i.token_counts().collect()))
    assert counts(store.index()) == counts(TextIndex.build(as_chunks(spark, notes)))


def test_a_broken_run_leaves_the_generation_in_force(spark, tmp_path, monkeypatch):
    store = SegmentedIndex(spark, str(tmp_path / "index"))
    first, second = as_chunks(spark, {"a.md": (1, ["red fox"]), "b.md": (2, ["red hen"])}), as_chunks(spark, {"a.md": (3, ["blue fox"])})
    store.add(first)

    def broken(self, now):
        raise OSError("between the writes")

    with monkeypatch.context() as patch:
        patch.setattr(SegmentedIndex, "_finish", broken)
        with pytest.raises(OSError):
            store.add(second)
    assert os.path.exists(tmp_path / "index" / "segments" / "seg=2") and store.generation().number == 1
    same(store.index(), first, ("red", "blue"))
    store.add(second)
    same(store.index(), as_chunks(spark, {"a.md": (3, ["blue fox"]), "b.md": (2, ["red hen"])}), ("red", "blue", "fox"))
    # A caller that never named the second generation follows the first.
    store.add(as_chunks(spark, {"c.md": (4, ["red"])}), after=1)
    assert store.generation().number == 2 and store.index().topk("blue", 3).count() == 0


def test_an_index_may_be_written_over_itself(spark, tmp_path):
    path = str(tmp_path / "index")
    first, second = as_chunks(spark, {"a.md": (1, ["red fox"]), "b.md": (2, ["hen"])}), as_chunks(spark, {"a.md": (3, ["red red fox"]), "c.md": (2, ["fox"])})
    TextIndex.build(first).write(path)
    TextIndex.read(spark, path).updated(second).write(path)
    same(TextIndex.read(spark, path), second)


def test_old_segments_are_deleted(spark, tmp_path):
    store = SegmentedIndex(spark, str(tmp_path / "index"))
    for k in range(4):
        store.add(as_chunks(spark, {"a.md": (k, [f"red {k}"])}))
        store.merge(everything=True)
    kept = [n for n in os.listdir(tmp_path / "index" / "segments") if n.startswith("seg=")]
    assert len(kept) <= 3 and store.generation().chunks == 1


def test_vault_is_asked_without_reading_texts(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "vault"), str(tmp_path / "store")
    os.makedirs(root)
    for k in range(12):
        (tmp_path / "vault" / f"n{k}.md").write_text(f"# N{k}\nthe {'red fox' if k % 3 == 0 else 'grey hen'} number {k} sees [[n{(k + 1) % 12}]]\n")
    jobs.index_vault(spark, root, store, segments=2)
    hits = jobs.vault_hits(spark, store, "red fox", top_k=3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "token" in plan and hits.count() > 3
    for k in range(3):
        (tmp_path / "vault" / f"n{k}.md").write_text(f"# N{k}\nthe blue whale {k}\n")
        assert jobs.index_vault(spark, root, store, segments=2) == {"changed": 1, "unchanged": 11}
        assert f"whale {k}" in jobs.ask_vault(spark, store, f"blue whale {k}", top_k=1).first().answer
    run, text = jobs._state(spark, store)
    now = SegmentedIndex(spark, f"{store}/text").generation(text)
    assert run == 4 and len(now.segments) <= 3 and now.chunks == 12

    # The job breaks off after the text index: the old state stays whole, and the next run mends it.
    (tmp_path / "vault" / "n9.md").write_text("# N9\nthe green newt\n")
    def broken(*_):
        raise OSError("before the pointer")

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_put_in_force", broken)
        with pytest.raises(OSError):
            jobs.index_vault(spark, root, store, segments=2)
    assert "newt" not in jobs.ask_vault(spark, store, "green newt", top_k=2).first().answer.split("Evidence")[1]
    assert jobs.index_vault(spark, root, store, segments=2) == {"changed": 1, "unchanged": 11}
    assert "green newt" in jobs.ask_vault(spark, store, "green newt", top_k=1).first().answer.split("Evidence")[1]


def test_a_vault_is_read_once(spark, tmp_path):
    """What a run parses is what it read at its start: files are scanned in one plan, the one that writes the run's own table."""
    root, store = str(tmp_path / "vault"), str(tmp_path / "store")
    os.makedirs(root)
    (tmp_path / "vault" / "a.md").write_text("# A\nred\n")
    scans = []
    real = jobs.vault.read_vault
    jobs.vault.read_vault = lambda *a, **k: scans.append(a) or real(*a, **k)
    try:
        write = jobs.markdown.parse_files

        def later(work):
            (tmp_path / "vault" / "a.md").write_text("# B\nblue\n")  # the file changes while the job runs
            return write(work)

        jobs.markdown.parse_files = later
        jobs.index_vault(spark, root, store)
    finally:
        jobs.vault.read_vault, jobs.markdown.parse_files = real, write
    assert len(scans) == 1
    texts = [r.text for r in jobs.vault_tables(spark, store)["chunks"].collect()]
    assert texts == ["# A\nred\n"] and jobs.index_vault(spark, root, store) == {"changed": 1}


def test_stored_rows_stay_in_proportion(spark, tmp_path):
    """Runs that still count for little are merged, without parsing a file again; the state before stays readable."""
    root, store = str(tmp_path / "vault"), str(tmp_path / "store")
    os.makedirs(root)
    for k in range(6):
        (tmp_path / "vault" / f"n{k}.md").write_text(f"# N{k}\nold {k} [[n0]]\n")
    jobs.index_vault(spark, root, store)
    for k in range(4):
        (tmp_path / "vault" / f"n{k}.md").write_text(f"# N{k}\nnew {k} [[n1]]\n")
        jobs.index_vault(spark, root, store)
    before = jobs.vault_tables(spark, store)
    want = {t: sorted(map(repr, df.drop("made").collect())) for t, df in before.items()}
    assert jobs.compact_vault(spark, store, most_runs=3) == [1, 2, 3, 4, 5] and jobs.compact_vault(spark, store) == []
    assert {t: sorted(map(repr, df.drop("made").collect())) for t, df in jobs.vault_tables(spark, store).items()} == want
    assert {t: sorted(map(repr, df.drop("made").collect())) for t, df in before.items()} == want  # a reader that began earlier
    assert "new 3" in jobs.ask_vault(spark, store, "new 3", top_k=1).first().answer
    (tmp_path / "vault" / "n5.md").write_text("# N5\nlast\n")
    assert jobs.index_vault(spark, root, store) == {"changed": 1, "unchanged": 5}
    kept = sorted(n for n in os.listdir(f"{store}/chunks") if n.startswith("made="))
    stored = spark.read.parquet(f"{store}/chunks").count()
    assert kept == ["made=6", "made=7"] and stored <= 2 * jobs.vault_tables(spark, store)["chunks"].count()
