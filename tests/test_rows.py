from lexigrove.operators.row_checks import check_rows, load_rows

GOOD = "2011-10-01T00:09:36.696Z 302 82181 ftp://h/a LLX http://h/ text/html #038 2011+84 sha1:J - -"


def reasons(spark, lines, **kw):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_id long, line string")
    return {r.line_id: r.reason for r in check_rows(df, **kw).collect()}


def line(**change):
    names = ["time", "result", "size", "url", "hoppath", "refer", "mime", "thread", "dltime", "sha1", "sourcetag", "annot"]
    parts = GOOD.split(" ")
    for k, v in change.items():
        parts[names.index(k)] = v
    return " ".join(parts)


CASES = [
    (GOOD, None),
    ("\t " + GOOD.replace(" ", " \t ") + "  ", None),
    (GOOD + "\r\n", None),
    (line(time="20111001000816722"), None),
    (line(mime='"text/html; charset=utf-8"'), None),
    (line(annot='"note ""x y"" kept"'), None),
    (line(annot='""'), None),
    (line(annot='""""'), None),
    (line(size="-"), None),
    (line(result="-404"), None),
    (None, "too_few_fields"),
    ("", "too_few_fields"),
    (" \t ", "too_few_fields"),
    (GOOD + " more", "too_many_fields"),
    (GOOD.rsplit(" ", 1)[0], "too_few_fields"),
    (line(annot='"open'), "broken_quote"),
    (line(annot='"a"b'), "broken_quote"),
    (line(annot='a"b"'), "broken_quote"),
    (line(annot='"a" "b"'), "too_many_fields"),
    (line(annot='"a""b'), "broken_quote"),
    ('x"', "broken_quote"),
    (line(time="2011-02-30T00:09:36.696Z"), "bad_time"),
    (line(time="2011-10-01T24:09:36.696Z"), "bad_time"),
    (line(time="2011100100081672"), "bad_time"),
    (line(time="x", result="y"), "bad_time"),
    (line(result="40a"), "bad_result"),
    (line(size="-1"), "bad_size"),
    (line(url="-"), "bad_url"),
    (line(url="http:///x"), "bad_url"),
    (line(url="http://h"), "bad_url"),
    (line(url="http://h:80"), None),
]


def test_reasons(spark):
    got = reasons(spark, [c for c, _ in CASES])
    assert got == {i: r for i, (_, r) in enumerate(CASES)}


def test_large_dictionary_is_joined_by_shuffle(spark):
    lines = [c for c, _ in CASES] * 3
    assert reasons(spark, lines, limit=0) == reasons(spark, lines)


def test_columns_with_clashing_names_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, GOOD, "a", "b", "c"), (None, GOOD, None, None, None), (1, GOOD, "a", "b", "c")], "line_id long, line string, reason string, time string, why_time string")
    assert [(r.line_id, r.reason) for r in check_rows(df).orderBy("line_id").collect()] == [(None, None), (1, None), (1, None)]
    assert check_rows(df.limit(0)).count() == 0


def test_very_long_lines(spark):
    long = ["a " * 300_000, '"' * 200_000, '"' * 200_001, "x" * 1_000_000, line(annot='"' + '""' * 100_000 + '"')]
    assert [reasons(spark, long)[i] for i in range(5)] == ["too_many_fields", "too_few_fields", "broken_quote", "too_few_fields", None]


def test_load(spark):
    df = spark.createDataFrame([(1, line(annot='"note ""x y"" kept"', size="-")), (2, "bad")], "line_id long, line string")
    (row,) = load_rows(df).collect()
    assert (row.line_id, row.result, row["size"], row.annot) == (1, 302, None, 'note "x y" kept')
    assert str(row.time) == "2011-10-01 00:09:36.696000"
