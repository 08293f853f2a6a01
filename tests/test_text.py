import os
import random

from pyspark.sql import functions as F

from kinfold.functions import dates, text


def test_suffix_is_that_of_splitext(values):
    names = ["a.tar.gz", ".bashrc", "..x", "a.", "noext", ".a.b", "", "a.b\nc", "x..y"]
    assert values(text.suffix, names, "string") == [os.path.splitext(n)[1] for n in names]


def test_strip_removes_unicode_blanks(values):
    texts = ["\t x ", "x", "", " \u3000a b\x1c", "\x85a\xa0", "a\n", "\u200ba"]
    assert values(text.strip, texts, "string") == [t.strip() for t in texts]


def test_backslashes(values):
    assert values(text.forward_slashes, ["C:\\a\\\\b", "/x"], "string") == ["C:/a//b", "/x"]


def test_name_key(values):
    key = lambda c: text.alphanumeric(text.without_extension(c))
    assert values(key, ["été-1.v2.txt", "___.txt", "noext", ".bashrc"], "string") == ["t1v2", "", "noext", ""]


def test_parent_and_depth(values):
    paths = ["/a//b/c.txt", "c.txt", "/c.txt", "a/b/c"]
    assert values(text.parent_dir, paths, "string") == ["/a//b", "", "", "a/b"]
    assert values(lambda c: text.depth(text.parent_dir(c)), paths, "string") == [2, 0, 0, 2]


def test_segments(values):
    assert values(lambda c: text.segment(c, 0), ["/a.txt", "//x/y"], "string") == ["a.txt", "x"]
    assert values(lambda c: text.segment(c, 1), ["/a.txt", "//x/y"], "string") == ["Inconnu", "y"]


def test_size_class(values):
    sizes = [999_999, 1_000_000, 99_999_999, 100_000_000]
    assert values(text.size_class, sizes, "bigint") == ["Petit", "Moyen", "Moyen", "Grand"]


def test_size_label_prints_like_a_float(values):
    sizes = [0, 131072, 131073, 393216, 655360, 1048576, 10**14, 104857, 1]
    sizes += [random.Random(5).randrange(10**15) for _ in range(300)]
    assert values(text.size_label, sizes, "bigint") == [f"{round(s / 1048576, 2)} MB" for s in sizes]


def test_score_label_rounds_the_binary_value(values):
    scores = [None, 0.12345, 1.0, -0.0004, 0.0625, 0.1875, 0.9995, 0.0005, 0.0]
    scores += [k / 10000 for k in range(-9995, 10000, 10)]
    expected = ["—" if s is None else f"{s:.3f}" for s in scores]
    assert values(text.score_label, scores, "double") == expected


def test_spaced_thousands(values):
    assert values(text.spaced_thousands, [0, 999, 1234567], "bigint") == ["0", "999", "1 234 567"]


def test_whole_days_floor_in_any_zone(spark):
    now = dates.ntz("2024-01-01 00:00:00")
    moments = ["2023-12-31 06:00:00", "2024-01-01 06:00:00", "2024-01-02 00:00:00", "2023-12-30 00:00:00"]
    for zone in ("UTC", "Europe/Paris", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = spark.createDataFrame([(m,) for m in moments], "m string")
            ages = [r[0] for r in rows.select(dates.whole_days(now, dates.parsed(F.col("m")))).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert ages == [0, -1, -1, 2]


def test_impossible_dates_are_null(values):
    out = values(lambda c: dates.parsed(c).isNull(), ["2023-02-30 00:00:00", "x", "2023-02-28 00:00:00"], "string")
    assert out == [True, True, False]
