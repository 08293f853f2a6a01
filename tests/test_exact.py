import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from kinfold import schemas
from kinfold.operators import exact, numbering
from kinfold.operators.numbering import number_rows
from kinfold.sources.scratch import materialize
from tests.makers import START, cleaned_rows


def test_number_rows_is_a_global_place(spark):
    numbers = list(range(0, 5000, 3))
    random.Random(1).shuffle(numbers)
    rows = spark.createDataFrame([("same", n, n % 7) for n in numbers], "k string, n int, w int").repartition(13)
    out = {r.n: (r.place, r.before) for r in number_rows(rows, ["k", "n"], "place", ("w", "before")).collect()}
    total = 0
    for place, n in enumerate(sorted(numbers)):
        assert out[n] == (place, total)
        total += n % 7


def test_groups_ranks_and_statuses(spark):
    rows = cleaned_rows(
        spark,
        [
            {"path": "/z", "content_md5": "b", "size_bytes": 5},
            {"path": "/y", "content_md5": "b", "size_bytes": 5},
            {"path": "/x", "content_md5": "b", "size_bytes": 5, "created_at": START + timedelta(hours=1)},
            {"path": "/other-size", "content_md5": "b", "size_bytes": 6},
            {"path": "/p", "content_md5": "a", "size_bytes": 9},
            {"path": "/q", "content_md5": "a", "size_bytes": 9, "created_at": START - timedelta(hours=1)},
        ],
    )
    out = {r.path: (r.n_copies, r.copy_rank, r.exact_group_id, r.dup_status) for r in exact.exact_duplicates(rows).collect()}
    assert out == {
        "/y": (3, 1, 1, "Original"),
        "/z": (3, 2, 1, "Doublon #1"),
        "/x": (3, 3, 1, "Doublon #2"),
        "/other-size": (1, 1, -1, "Unique"),
        "/q": (2, 1, 0, "Original"),
        "/p": (2, 2, 0, "Doublon #1"),
    }


def test_hot_group_is_spread_over_tasks(spark, monkeypatch):
    """One content holds most rows, with equal dates: ranks stay exact and no task gets the whole group."""
    n = 4000
    rows = [{"path": f"/f{i:05d}", "content_md5": "hot" if i % 4 else f"c{i % 400}"} for i in range(n)]
    cleaned = cleaned_rows(spark, rows).repartition(16)
    written = []

    def keep(df, name):
        written.append(materialize(df, name))
        return written[-1]

    monkeypatch.setattr(numbering, "materialize", keep)
    # so small a table would be merged into one task
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    groups = exact.numbered_groups(cleaned)
    ranked = exact.rank_copies(cleaned, groups)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    hot = sorted(r["path"] for r in rows if r["content_md5"] == "hot")
    got = ranked.filter("content_md5 = 'hot'").orderBy("copy_rank").select("path", "copy_rank").collect()
    assert [r.path for r in got] == hot
    assert [r.copy_rank for r in got] == list(range(1, len(hot) + 1))
    ranged = written[-1].filter("content_md5 = 'hot'")
    sizes = [r["count"] for r in ranged.groupBy(F.shiftright("_seq", 33)).count().collect()]
    assert len(sizes) > 4 and max(sizes) < len(hot) / 3
    flagged = exact.exact_duplicates(cleaned).groupBy("is_exact_dup").count().collect()
    assert sum(r["count"] for r in flagged) == n


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_windows(spark, seed):
    draw = random.Random(seed)
    rows = cleaned_rows(
        spark,
        [
            {
                "path": f"/f{i}",
                "content_md5": f"c{draw.randrange(60)}",
                "size_bytes": draw.randrange(3),
                "created_at": START + timedelta(minutes=draw.randrange(5)),
            }
            for i in range(300)
        ],
    )
    exact.exact_duplicates(rows).createOrReplaceTempView("ours")
    rows.createOrReplaceTempView("cleaned")
    wrong = spark.sql(
        """
        WITH plain AS (
          SELECT path, count(*) OVER (PARTITION BY content_md5, size_bytes) AS n,
            row_number() OVER (PARTITION BY content_md5, size_bytes ORDER BY created_at, path) AS place,
            content_md5, size_bytes FROM cleaned),
        keyed AS (SELECT *, IF(n > 1, dense_rank() OVER (PARTITION BY n > 1 ORDER BY content_md5, size_bytes) - 1, -1)
          AS g FROM plain)
        SELECT * FROM keyed FULL JOIN ours USING (path)
        WHERE NOT (n <=> n_copies AND place <=> copy_rank AND g <=> exact_group_id)
        """
    )
    assert wrong.isEmpty()


def test_empty(spark):
    out = exact.exact_duplicates(spark.createDataFrame([], schemas.CLEANED))
    assert out.schema.names == schemas.EXACT.names and out.isEmpty()
