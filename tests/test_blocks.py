"""Samples of whole blocks, and what they read."""

import pyarrow as pa
import pyarrow.parquet as pq
from lustra.operators import sample
from lustra.sources import blocks
from lustra.sources import snapshot as snapshots
from lustra.sources.tables import Source


def table(tmp_path, files, groups, rows=100):
    folder = tmp_path / "src/t.parquet"
    folder.mkdir(parents=True)
    for f in range(files):
        ids = [f * groups * rows + k for k in range(groups * rows)]
        pq.write_table(pa.table({"id": ids, "s": [f"text {k}" for k in ids], "n": pa.array([None if k % 3 else k for k in ids], pa.int32())}), folder / f"part-{f:03}.parquet", row_group_size=rows)
    return Source(str(tmp_path / "src"))


def test_row_groups(spark, tmp_path):
    source = table(tmp_path, 3, 100)
    shot = snapshots.take(spark, source, "t", str(tmp_path / "s"))
    whole = shot.read(spark)
    got = sample.page_sample(whole, 0.1, 5, snapshot=shot)
    ids = sorted(r["id"] for r in got.collect())
    drawn = {k // 100 for k in ids}
    assert len(ids) == 100 * len(drawn) and 15 <= len(drawn) <= 50  # of 300 groups, each read whole
    assert got.schema == whole.schema and got.exceptAll(whole).count() == 0
    assert sorted(r["id"] for r in sample.page_sample(whole, 0.1, 5, snapshot=shot).collect()) == ids
    assert {r["id"] // 100 for r in sample.page_sample(whole, 0.1, 6, snapshot=shot).collect()} != drawn
    assert got.select("s").distinct().count() == len(ids)


def test_only_the_drawn_groups_are_read(spark, tmp_path, monkeypatch):
    source = table(tmp_path, 1, 200)
    shot = snapshots.take(spark, source, "t", str(tmp_path / "s"))
    path = shot.check(spark)[0]
    read = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def read(self, n=-1):
            data = self.inner.read(n)
            read.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.inner.close()

    plain = blocks._opened
    monkeypatch.setattr(blocks, "_opened", lambda p: pa.PythonFile(Counting(plain(p)), mode="r"))
    sizes = {}
    for share in (0.1, 1.0):
        read.clear()
        reader = blocks._Reader(shot.empty(spark).schema, {"paths": f'["{path}"]', "seed": "3", "fraction": str(share)})
        rows = sum(b.num_rows for b in reader.read(blocks._File(path)))
        sizes[share] = rows, sum(read)
    assert sizes[1.0][0] == 20_000 and abs(sizes[0.1][0] / 20_000 - 0.1) < 0.06
    footer = pq.ParquetFile(path.removeprefix("file:")).metadata.serialized_size
    assert sizes[0.1][1] < 0.2 * sizes[1.0][1] + 3 * footer


def test_files_are_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "FILES", 5)
    source = table(tmp_path, 40, 1, 10)
    shot = snapshots.take(spark, source, "t", str(tmp_path / "s"))
    got = sample.page_sample(shot.read(spark), 0.25, snapshot=shot)
    drawn = {r["id"] // 10 for r in got.collect()}
    assert got.count() == 10 * len(drawn) and 3 <= len(drawn) <= 20 and len(got.inputFiles()) == len(drawn)


def test_fallbacks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/c.csv").write_text("k,s\n" + "\n".join(f"{k},x" for k in range(1000)))
    shot = snapshots.take(spark, Source(str(tmp_path / "src"), "csv", (("c", "k"),)), "c", str(tmp_path / "s"))
    assert blocks.block_sample(spark, shot, 0.1) is None
    assert 50 < sample.page_sample(shot.read(spark), 0.1, snapshot=shot).count() < 160
    source = table(tmp_path / "p", 1, 2)
    shot = snapshots.take(spark, source, "t", str(tmp_path / "s2"))
    assert sample.page_sample(shot.read(spark), 1e-12, rows=7, snapshot=shot).count() == 7  # nothing was drawn
    assert [r["id"] for r in sample.first_rows(shot.read(spark), 3, "id").collect()] == [0, 1, 2]
