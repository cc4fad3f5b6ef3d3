"""Which open meetings the scoring jobs take."""

from matchup.plans import jobs


def test_open_slate_leaves_out_completed_meetings_and_the_excluded_class(spark):
    rows = [(1, False, "A"), (2, True, "A"), (3, None, "R"), (4, False, "N"), (5, False, None), (6, True, "N")]
    m = spark.createDataFrame(rows, "id int, completed boolean, flag string")
    assert sorted(r.id for r in jobs.open_slate(m).collect()) == [1, 3, 5]
