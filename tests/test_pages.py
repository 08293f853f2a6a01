import pytest
from pyspark.sql import functions as F

from kinfold.operators import pages
from kinfold.sources.scratch import new_location

N = 5000


@pytest.fixture(scope="module")
def rows(spark):
    ids = spark.range(N).select((F.col("id") * 7919 % N).alias("k"))
    return ids.select(F.floor(F.col("k") / 3).alias("g"), (F.col("k") % 3).alias("r"), F.concat(F.lit("p"), "k").alias("path"))


@pytest.fixture(scope="module")
def table(spark, rows):
    location = new_location(spark, "pages")
    pages.store(rows, ["g", "r"], location, file_rows=100)
    return pages.stored(spark, location, rows.schema)


def numbers(df):
    return [r.position for r in df.collect()]


def test_pages_are_the_listing_in_order(table, rows):
    every = [r.path for r in table.orderBy("position").collect()]
    assert every == [f"p{k}" for k in range(N)]
    for number, size in ((0, 10), (77, 10), (9, 500), (499, 10)):
        assert numbers(pages.page(table, number, size)) == list(range(number * size, (number + 1) * size))
    assert numbers(pages.page(table, 10, 499)) == list(range(4990, N))
    assert numbers(pages.page(table, 500, 10)) == []
    for number, size in ((-1, 10), (0, 0)):
        with pytest.raises(ValueError):
            pages.page(table, number, size)


def scanned_rows(df):
    """Rows that the scan of an executed plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.getClass().getSimpleName()
    plan = plan.executedPlan() if text == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaf_rows(leaves.apply(i)) for i in range(leaves.size()))


def leaf_rows(leaf):
    if not leaf.metrics().contains("numOutputRows"):  # a stage of adaptive execution
        inner = leaf.plan().collectLeaves()
        return sum(leaf_rows(inner.apply(i)) for i in range(inner.size()))
    return leaf.metrics().apply("numOutputRows").value()


def test_a_far_page_reads_few_rows(table):
    assert scanned_rows(pages.page(table, 1, 40)) <= 200
    assert scanned_rows(pages.page(table, 110, 40)) <= 200


def test_pages_of_a_selection(table):
    def tens(rows):
        return rows.filter("path LIKE '%0'")

    def last(rows):
        return rows.filter("path = 'p4999'")

    assert numbers(pages.page_from(table, 95, tens, 4)) == [100, 110, 120, 130]
    assert numbers(pages.page_from(table, 131, tens, 4)) == [140, 150, 160, 170]
    assert numbers(pages.page_from(table, 4985, tens, 4)) == [4990]
    assert numbers(pages.page_from(table, 0, last, 2)) == [4999]
    assert numbers(pages.page_from(table, N, tens, 4)) == []
    assert scanned_rows(pages.page_from(table, 2000, tens, 4)) <= 400


def test_listing_of_nothing(spark, rows):
    location = new_location(spark, "pages")
    pages.store(rows.limit(0), ["g", "r"], location)
    table = pages.stored(spark, location, rows.schema)
    assert pages.page(table, 0).collect() == [] and pages.page_from(table, 0, lambda r: r).collect() == []
