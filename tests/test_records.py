import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline.sources import records, tasks


def folder(tmp_path, kind, parts=5, n=10):
    for k in range(parts):
        rows = [{"query_id": 10 * k + i, "query": f"q{k}-{i}", "answers": ["a", ""], "passages": {"is_selected": [0, 1], "passage_text": ["x", "y"], "url": ["u", "v"]}} for i in range(n)]
        at = tmp_path / f"part-{k}.{kind}"
        if kind == "parquet":
            pq.write_table(pa.Table.from_pylist(rows), at)
        else:
            at.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    return str(tmp_path)


@pytest.mark.parametrize("kind", ["parquet", "jsonl"])
def test_a_limit_opens_no_more_files_than_it_needs(spark, tmp_path, kind):
    path = folder(tmp_path, kind)
    whole = spark.read.format("parquet" if kind == "parquet" else "json").load(path)
    spark.dataSource.register(records.Records)
    assert spark.read.format("records").load(path).count() == 50
    for name in sorted(os.listdir(tmp_path))[2:]:
        (tmp_path / name).write_bytes(b"this is no file of records")  # whoever reads it fails
    for n, parts in ((0, 1), (1, 1), (10, 1), (13, 2), (20, 2)):
        got = records.first_records(spark, path, n)
        assert sorted(r["query_id"] for r in got.collect()) == list(range(n)) and got.rdd.getNumPartitions() == parts
    got = records.first_records(spark, path, 13)
    assert {f.name for f in got.schema.fields} == {f.name for f in whole.schema.fields}
    mapped = tasks.map_msmarco(got)
    assert mapped.count() == 13 and mapped.first()["answers"] == ["a"]


def test_columns_that_a_file_has_not(spark, tmp_path):
    pq.write_table(pa.table({"a": [1, 2], "b": ["x", "y"]}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"a": [3]}), tmp_path / "2.parquet")
    got = records.first_records(spark, str(tmp_path), 5).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, "y"), (3, None)]
    with pytest.raises(Exception, match="no records"):
        (tmp_path / "empty").mkdir()
        records.first_records(spark, str(tmp_path / "empty"), 5)
    with pytest.raises(Exception, match="negative"):
        records.first_records(spark, str(tmp_path), -1).count()


def test_a_dataset_task_reads_its_limit(spark, tmp_path):
    path = folder(tmp_path, "jsonl")
    for name in sorted(os.listdir(tmp_path))[2:]:
        (tmp_path / name).write_text("no record")
    task = tasks.get_task("msmarco-1k", raw_path=path, max_items=15)
    assert task.items(spark, "all").count() == 15 and task.corpus(spark).count() == 30
    assert task.items(spark, "holdout").count() == 3
