"""The digest index outlives the application that wrote it."""

import subprocess
import sys
from pathlib import Path

import pytest

from shapelake.llm import exact_dedup

REPO = Path(__file__).resolve().parents[2]
EARLIER = """
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from shapelake.llm import exact_dedup
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').config('spark.sql.warehouse.dir', {where!r}).getOrCreate()
docs = s.createDataFrame([(0, 'a b'), (1, 'ab'), (2, 'c')], 'doc_id long, text string')
exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(s, 'earlier_index', {path!r}, buckets=4)).count()
"""


def test_second_application_meets_the_texts_of_the_first(spark, tmp_path):
    path = f"file://{tmp_path}/it's an index"
    code = EARLIER.format(repo=str(REPO), where=str(tmp_path / "warehouse"), path=path)
    first = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert first.returncode == 0, first.stderr[-2000:]
    index = exact_dedup.DigestIndex(spark, "earlier_index", path)  # the folder tells that there are 4 buckets
    more = spark.createDataFrame([(10, "a  b"), (11, "d")], "doc_id long, text string")
    rows = exact_dedup.deduplicate(more, index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows} == {(10, 0, False), (11, 11, True)}
    assert index.buckets == 4 and sorted(r.keep_id for r in index.table().collect()) == [0, 2, 11]
    assert sorted(r.keep_id for r in exact_dedup.DigestIndex(spark, "earlier_index").table().collect()) == [0, 2, 11]
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, "earlier_index", f"file://{tmp_path}/elsewhere")
    spark.sql("DROP TABLE earlier_index")
