"""The stored annotation table."""

import glob
import random

import pytest

from polylabel.schema import DEFAULT_LABELS as L
from polylabel.sources import annotation_store as AS

N = L.names


def table(spark, rows):
    """Rows (annotator, text_id, seq, first label)."""
    full = [(a, t, f"text {t}", s, x, 0, 0, 0, 1 - x) for a, t, s, x in rows]
    return spark.createDataFrame(full, "annotator_id string, text_id long, text string, ingest_seq int, " + ", ".join(f"{n} int" for n in N))


def stored(spark, path):
    return sorted(((r.annotator_id, r.text_id, r.ingest_seq, r[N[0]]) for r in AS.read_store(spark, path).collect()), key=str)


def test_appends_in_any_order_and_repeated(spark, tmp_path):
    rng = random.Random(3)
    parts = [[(rng.choice(["A1", "007", "7", None, "x y/z"]), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), rng.randint(0, 1)) for _ in range(12)]
             for _ in range(3)]
    best = {}
    for a, t, s, x in sum(parts, []):
        best[a, t] = max(best.get((a, t), (-1, -1)), (-1 if s is None else s, x))
    want = sorted(((a, t, None if s < 0 else s, x) for (a, t), (s, x) in best.items()), key=str)
    for order in ([0, 1, 2], [2, 0, 1, 0, 2]):
        path = f"{tmp_path}/{len(order)}"
        for k in order:
            AS.ingest(table(spark, parts[k]), path, files=2)
        assert stored(spark, path) == want


def test_other_annotators_are_not_touched(spark, tmp_path):
    path = f"{tmp_path}/t"
    AS.ingest(table(spark, [("A1", 1, 1, 0), ("A2", 1, 1, 0)]), path)
    before = glob.glob(f"{path}/annotator_id=A2/*.parquet")
    AS.ingest(table(spark, [("A1", 2, 1, 1), ("A1", 1, 2, 1)]), path)
    assert glob.glob(f"{path}/annotator_id=A2/*.parquet") == before
    assert stored(spark, path) == [("A1", 1, 2, 1), ("A1", 2, 1, 1), ("A2", 1, 1, 0)]
    assert {r.annotator_id for r in AS.read_store(spark, path, annotators=["A1"]).collect()} == {"A1"}


def test_a_failed_append_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    AS.ingest(table(spark, [("A1", 1, 1, 0)]), path)
    cut, calls = AS.cut_lineage, []

    def dies(df, name):
        calls.append(name)
        if name == "merged":
            raise RuntimeError("killed")
        return cut(df, name)
    monkeypatch.setattr(AS, "cut_lineage", dies)
    with pytest.raises(RuntimeError):
        AS.ingest(table(spark, [("A1", 1, 2, 1)]), path)
    monkeypatch.undo()
    assert calls == ["arriving", "merged"] and stored(spark, path) == [("A1", 1, 1, 0)]
    AS.ingest(table(spark, [("A1", 1, 2, 1)]), path)
    assert stored(spark, path) == [("A1", 1, 2, 1)]


def test_empty_tables_empty_ids_extra_columns(spark, tmp_path):
    from pyspark.sql import functions as F
    path = f"{tmp_path}/t"
    assert AS.read_store(spark, path).count() == 0
    AS.ingest(table(spark, []), path)
    assert AS.read_store(spark, path).count() == 0
    AS.ingest(table(spark, [("", 1, 1, 0), (None, 1, 2, 1)]).withColumns({"who": F.lit("z"), "r": F.lit(1)}), path)
    assert stored(spark, path) == [(None, 1, 2, 1)]
    with pytest.raises(ValueError):
        AS.ingest(table(spark, []).drop("ingest_seq"), path)


def test_worklist_goes_on_from_the_store(spark, tmp_path):
    path = f"{tmp_path}/t"
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, text string")
    todo = lambda: sorted((r.annotator_id, r.text_id) for r in AS.worklist(texts, path, ["A1", "A2"]).collect())
    assert todo() == [("A1", 1), ("A1", 2), ("A2", 1), ("A2", 2)]
    AS.ingest(table(spark, [("A1", 2, 1, 0), ("A2", 1, 1, 0)]), path)
    assert todo() == [("A1", 1), ("A2", 2)]


def test_large_annotators_are_written_in_parts(spark, tmp_path, monkeypatch):
    """No task writes all rows of an annotator that has many."""
    monkeypatch.setattr(AS, "FILE_BYTES", 4000)
    labels = AS.DEFAULT_LABELS
    rows = [("A" if i % 8 else None, i, f"text {i}" * 5, 1, *([i % 2] * len(labels))) for i in range(400)]
    df = spark.createDataFrame(rows, "annotator_id string, text_id long, text string, ingest_seq long, " + ", ".join(f"{n} int" for n in labels.names))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        AS.ingest(df, f"{tmp_path}/s", labels)
        AS.ingest(df, f"{tmp_path}/s", labels)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list(tmp_path.glob("s/annotator_id=A/*.parquet"))) > 3
    got = AS.read_store(spark, f"{tmp_path}/s", labels).select(*df.columns).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in df.collect())


def test_appends_leave_nothing_behind(spark, tmp_path, monkeypatch):
    """What an append makes for itself goes, slices of large annotators are
    as good as all at once, and a repeated append writes no file."""
    from polylabel.session import ensure_checkpoint_dir
    monkeypatch.setattr(AS, "FILE_BYTES", 150)
    made = lambda: set(glob.glob(f"{ensure_checkpoint_dir(spark)}/tables/*"))
    before, path = made(), f"{tmp_path}/t"
    first = table(spark, [("A1", i, 1, 0) for i in range(60)] + [("A2", i, 1, 0) for i in range(9)] + [(None, None, 1, 0)])
    again = table(spark, [("A1", i, 2, 1) for i in range(0, 60, 2)] + [("A2", 3, 1, 1), (None, None, 1, 1)]).coalesce(1)
    AS.ingest(first, path)
    AS.ingest(again, path)
    want = [("A1", i, 1 + (i + 1) % 2, (i + 1) % 2) for i in range(60)] + [("A2", i, 1, int(i == 3)) for i in range(9)] + [(None, None, 1, 1)]
    assert stored(spark, path) == sorted(want, key=str)
    files = sorted(glob.glob(f"{path}/*/*.parquet"))
    assert len(files) > AS.PARTS_AT_ONCE and len(files) < 60
    AS.ingest(first, path)
    assert sorted(glob.glob(f"{path}/*/*.parquet")) == files and stored(spark, path) == sorted(want, key=str)
    assert made() == before and not glob.glob(f"{path}/.m*")


def test_equal_rows_with_other_texts_are_a_change(spark, tmp_path):
    """Of equal ones the greatest text wins, whichever came first."""
    row = lambda text: spark.createDataFrame([("A1", 1, text, 1, 0, 0, 0, 0, 0)], "annotator_id string, text_id long, text string, ingest_seq int, " + ", ".join(f"{n} int" for n in N))
    for k, order in enumerate((["a", "c", None], [None, "c"])):
        for text in order:
            AS.ingest(row(text), f"{tmp_path}/{k}")
        assert [r.text for r in AS.read_store(spark, f"{tmp_path}/{k}").collect()] == ["c"]
