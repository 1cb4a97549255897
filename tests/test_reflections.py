import datetime as dt

import pytest

from lectern.sources import reflections

SCHEMA = "day date, title string, tags array<string>, content string, saved long, extra int"


def entry(day, title, tags, content, saved):
    return (dt.date(2024, 1, day), title, tags, content, saved, 0)


def test_round_trip_replaces_by_day_and_title(spark, tmp_path):
    folder = str(tmp_path / "reflections")
    first = [
        entry(1, "plain", ["a", "b"], "text\nof two lines\n", 1), entry(1, "a/b: c=d%é", None, "odd name", 2),
        entry(2, None, [], None, 3), entry(3, "twice", [], "old", 4), entry(3, "twice", [], "new", 5), entry(3, "alpha", ["t"], "x", 6),
    ]
    reflections.save(spark.createDataFrame(first, SCHEMA), folder)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "reflections" / "day=2024-01-01").rglob("*.txt")}
    reflections.save(spark.createDataFrame([entry(3, "alpha", ["t"], "y", 7)], SCHEMA), folder)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "reflections" / "day=2024-01-01").rglob("*.txt")}
    got = {r.file_name: r.text for r in reflections.stored(spark, folder).collect()}
    head = lambda day, tags: f"---\ndate: 2024-01-0{day}\ntags: [{tags}]\ntype: reflection\n---\n\n"
    assert got == {
        "2024-01-01_plain.md": head(1, "a, b") + "text\nof two lines\n", "2024-01-01_a/b: c=d%é.md": head(1, "") + "odd name",
        "2024-01-02_.md": head(2, ""), "2024-01-03_twice.md": head(3, "") + "new", "2024-01-03_alpha.md": head(3, "t") + "y",
    }
    assert len([*(tmp_path / "reflections").rglob("part-*.txt")]) == 5
    assert [r.file_name for r in reflections.latest(spark, folder).collect()] == ["2024-01-03_twice.md"]


def test_an_entry_without_a_day_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="needs a day"):
        reflections.save(spark.createDataFrame([(None, "t", [], "c", 1, 0)], SCHEMA), str(tmp_path / "r"))
