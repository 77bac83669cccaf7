"""Sets that change all at once, and tables as rows."""

import pytest

from leafline.operators import tables
from leafline.sources import manifest


def test_no_reader_sees_half_a_set(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = lambda name: sorted(r[0] for r in manifest.read(spark, root, name).collect())
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    with pytest.raises(KeyError):
        manifest.read(spark, root, "pages")
    assert manifest.publish(frame(1, 2), root, "pages") == 1 and rows("pages") == [1, 2]
    # between the write and the commit readers go on with what they had
    new = {"pages": manifest.write(frame(3), root, "pages"), "notes": manifest.write(frame(9), root, "notes")}
    assert rows("pages") == [1, 2] and len(manifest.unnamed(spark, root)) == 2
    before = manifest.read(spark, root, "pages")
    assert manifest.commit(spark, root, new) == 2
    assert rows("pages") == [3] and rows("notes") == [9]
    # who has resolved a set before goes on reading it whole
    assert sorted(r[0] for r in before.collect()) == [1, 2] and len(manifest.unnamed(spark, root)) == 1
    assert manifest.publish(frame().limit(0), root, "notes") == 3 and rows("notes") == [] and rows("pages") == [3]


def test_two_writers_make_two_manifests(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([(1,)], "v int")
    manifest.publish(one, root, "a")
    # a writer that still believes in the manifest of another time does not take its place
    folder = manifest.write(one, root, "b")
    manifest.publish(one, root, "c")
    seen = iter([(1, {"a": "old"})])
    real = manifest.current
    monkeypatch.setattr(manifest, "current", lambda s, r: next(seen, None) or real(s, r))
    assert manifest.commit(spark, root, {"b": folder}) == 3
    assert set(real(spark, root)[1]) == {"a", "b", "c"}


def test_tables_as_rows(spark):
    pages = [
        (1, "<p>x</p><table><tr><th>a &amp; b</th><td><b>bo</b>ld</td></tr><tr><td> 1\n 2 </td></tr></table><TABLE><tr><td>z</td></tr></TABLE>"),
        (2, "no table"), (3, None), (4, "<table></table>"), (5, "<table><tr><td>open"), (1, "<table><tr><td></td><td>v</td></tr></table>"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id int, html string, cell string")
    got = sorted(tuple(r) for r in tables.cells(df, ["page_id"], "html").collect())
    assert got == [(1, 0, 0, 0, ""), (1, 0, 0, 0, "a & b"), (1, 0, 0, 1, "bold"), (1, 0, 0, 1, "v"), (1, 0, 1, 0, "1 2"), (1, 1, 0, 0, "z")]
    assert tables.cells(df.limit(0), ["page_id"], "html").count() == 0
