"""Arrays inside scripts: nested, escaped, cut off."""

from swissline.sources import team_pages

PAGES = [
    (1, """x = [1, [2, "a]b"], '[']; y = [3]""", """[1, [2, "a]b"], '[']"""),
    (2, """x = ["a \\\\" ] b", 'it\\\\'s ]'] ]""".replace("\\\\", "\\"), """["a \\\\" ] b", 'it\\\\'s ]']""".replace("\\\\", "\\")),
    (3, "x = [1, [2]", None), (4, "x = ['open ]", None), (5, "z = [1]", None), (6, "x = 1", None), (7, None, None), (8, "", None), (9, "x =\n [\n[]\n]\n]", "[\n[]\n]"), (10, "x=[" + "[1]," * 3000 + "2]", "[" + "[1]," * 3000 + "2]"),
    (11, 'x = ["' + "y" * 200_000 + '"]', '["' + "y" * 200_000 + '"]'),
]


def test_arrays_end_with_their_bracket(spark):
    df = spark.createDataFrame([p[:2] for p in PAGES], "page_id long, html string")
    got = {r.page_id: r.found for r in team_pages.with_script_array(df, "html", "x", "found").collect()}
    assert got == {i: want for i, _, want in PAGES}


def test_status_and_rows(spark):
    rows = [(1, """a = [{id: 1, 'n': 'q'}, {"id": 2}]"""), (2, "acw_sc__v2 a = [{id: 1}]"), (3, "a = [{id: 1}"), (4, None), (5, "a = []")]
    read = team_pages.read_pages(spark.createDataFrame(rows, "page_id long, html string"), "a =", "id: bigint, n: string")
    got = {r.page_id: (r.status, [tuple(x) for x in r.rows or []]) for r in read.collect()}
    assert got == {1: ("ok", [(1, "q"), (2, None)]), 2: ("blocked", []), 3: ("unparsed", []), 4: ("unparsed", []), 5: ("ok", [])}
    assert {r.status: (r.pages, r.n_rows) for r in team_pages.status_counts(read).collect()} == {"ok": (2, 2), "blocked": (1, 0), "unparsed": (2, 0)}
