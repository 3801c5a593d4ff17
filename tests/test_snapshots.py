"""One day of a table replaced, again and again."""

from lotlens.sources import snapshots


def test_only_the_written_days_change(spark, tmp_path):
    path, schema = str(tmp_path / "days"), "k long, v string, day date"
    rows = lambda *r: spark.createDataFrame([(k, v, __import__("datetime").date.fromisoformat(d)) for k, v, d in r], schema)
    read = lambda: sorted((r.k, r.v, str(r.day)) for r in snapshots.days(spark, path, schema).collect())
    snapshots.replace_days(rows((1, "a", "2024-01-01"), (2, "b", "2024-01-02"), (3, "c", "2024-01-02")), path)
    for _ in range(2):
        snapshots.replace_days(rows((4, "d", "2024-01-02")), path)
        assert read() == [(1, "a", "2024-01-01"), (4, "d", "2024-01-02")]
    snapshots.replace_days(rows((5, "e", "2024-01-03")), path)
    assert len(read()) == 3
