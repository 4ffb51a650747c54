import os

import pytest

from sluice.operators import walk

PAGES = "source string, page int, url string, html string"
DECLARED = "source string, pages int, total int"


def page(*names):
    return "".join(f"<li class=card><a href=/{n}>{n}</a></li>" for n in names)


def walked(spark, rows, declared, path):
    walk.write(spark.createDataFrame(rows, PAGES), spark.createDataFrame(declared, DECLARED), "li.card", {"ref": "a@href", "name": "a"}, 2, path)


WHOLE = [("s", 1, "u1", page("a", "b")), ("s", 2, "u2", page("c")), ("t", 1, "u1", page("d"))]


def test_a_whole_walk_is_the_union_of_its_pages(spark, tmp_path):
    walked(spark, WHOLE, [("s", 2, 4), ("t", None, None)], str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["source"], r["page"], r["place"], r["fields"]["ref"], r["fields"]["name"]) for r in rows) == [("s", 1, 0, "/a", "a"), ("s", 1, 1, "/b", "b"), ("s", 2, 0, "/c", "c"), ("t", 1, 0, "/d", "d")]


@pytest.mark.parametrize(
    ("rows", "declared", "says"),
    [
        (WHOLE[:1] + WHOLE[2:], [("s", 2, None)], "s: 1 pages lost"),
        ([*WHOLE[:1], ("s", 2, "u2", None)], [("s", 2, None)], "s: 1 pages lost"),
        ([*WHOLE[:1], ("s", 2, "u2", "<p>try later")], [("s", 2, None)], "1 empty"),
        (WHOLE, [("s", 2, 5)], "1 cards missing"),
        (WHOLE, [("s", 2, 3), ("u", 1, None)], "u: 1 pages lost"),
    ],
)
def test_a_lost_page_writes_nothing(spark, tmp_path, rows, declared, says):
    with pytest.raises(walk.BrokenWalk, match=says):
        walked(spark, rows, declared, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")
