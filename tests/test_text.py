import pytest
from pyspark.sql import functions as F

from lexigrove.functions import analysis as N
from lexigrove.functions.markup import Markup, normal_url, parse
from lexigrove.sources import readers, sinks


@pytest.mark.parametrize(
    "word,stem",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("electriciti", "electr"), ("hopefulness", "hope"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("sky", "sky"), ("be", "be")],
)
def test_porter(word, stem):
    assert N.porter(word) == stem


def test_dictionary_stemmer():
    s = N.dictionary_stemmer(frozenset({"city", "run", "hope", "bus"}), {"went": "go"})
    assert [s(w) for w in ("cities", "running", "hoping", "went", "bus", "xyzs")] == ["city", "run", "hope", "go", "bus", "xyzs"]
    with pytest.raises(ValueError):
        N.stemmer("x")
    assert N.arabic_light("والكتاب") == "كتاب"


def test_tokens():
    assert [t for t, _, _ in N.tokenize("U.S. won't <b>pay</b> -3 &amp; 1,000 <!-- no -->café")] == ["U.S.", "won't", "pay", "-3", "1,000", "café"]
    assert N.normalise("U.S.") == "us" and N.normalise("U.S.", frozenset({"US"})) == "US" and N.normalise("O'Neil") == "oneil"


def test_columns(spark):
    df = spark.createDataFrame([("Hello, fooBar baz-qux", "http://a.b/c?d=1", "12-30 x")], "t string, u string, n string")
    row = df.select(
        N.split_cases(F.col("t")).alias("cases"), N.phrases(F.col("t")).alias("phrases"), N.url_tokens(F.col("u")).alias("url"), N.first_number(F.col("n")).alias("number"), N.ngrams(N.simple_tokens(F.col("t")), 2).alias("grams"),
        N.term_frequencies(F.array(F.lit("a"), F.lit("b"), F.lit("a"))).alias("tf"), N.log_factorial(F.lit(4)).alias("lf"), N.log_factorial(F.lit(0)).alias("l0"), N.characters(F.lit("a 中")).alias("chars"),
    ).first()
    assert row.cases == ["hello", "foo", "bar", "baz", "qux"] and row.phrases == ["hello", "foobar baz-qux"]
    assert row.url == ["http", "a", "b", "c", "d", "1"] and row.number == 12 and row.grams == ["hello foobar", "foobar baz", "baz qux"]
    assert row.tf == {"a": 2, "b": 1} and abs(row.lf - 3.1780538) < 1e-6 and row.l0 == 0 and row.chars == ["a", "中"]


def test_markup():
    got = parse("<html><head><title>T one</title></head><body><script>no</script><h1>Head</h1><p>see <a href='../x/./y'>link text</a> <p>open</body></html>", url="http://Host/a/b/")
    words = [t[0] for t in got["tokens"]]
    assert words == ["t", "one", "head", "see", "link", "text", "open"]
    spans = {(f, b, e) for f, b, e, *_ in got["extents"]}
    assert ("title", 0, 2) in spans and ("h1", 2, 3) in spans and ("a", 4, 6) in spans and ("document", 0, 7) in spans
    assert got["links"] == [("http://host/a/x/y", 4, 6)] and got["metadata"]["title"] == "T one"
    assert parse(None)["tokens"] == [] and parse("")["extents"] == [("document", 0, 0, None, 1, 0)]
    kept = parse("<a class='k'>x</a><b>y</b>", Markup(index=frozenset({"key"}), conflate={("a", "class", "k"): "key"}, include=frozenset({"key"})))
    assert [t[0] for t in kept["tokens"]] == ["x"] and kept["extents"][1][0] == "key"
    assert parse("<y>12 30</y>", Markup(numeric=frozenset({"y"})))["extents"][1][3] == 12
    assert normal_url("HTTP://A.b:80/x//../y/#f") == "http://a.b/y/"


def test_readers(spark, tmp_path):
    (tmp_path / "a.trecweb").write_text("<DOC>\n<DOCNO>d1</DOCNO>\n<DOCHDR>\nhttp://x/\n</DOCHDR>\n<html>body one</html>\n</DOC>\n<DOC><DOCNO> d2 </DOCNO><DOCHDR>\n</DOCHDR>two</DOC>\n")
    rows = {r.docno: r for r in readers.documents(spark, str(tmp_path / "a.trecweb")).collect()}
    assert set(rows) == {"d1", "d2"} and rows["d1"].metadata["url"] == "http://x/" and rows["d2"].content == "two"
    (tmp_path / "m.mbox").write_text("From x\nMessage-ID: <1>\nSubject: Hi\n\nhello\n\nFrom y\nMessage-ID: <2>\n\nbye\n")
    assert {r.docno: r.content.strip() for r in readers.documents(spark, str(tmp_path / "m.mbox")).collect()} == {"<1>": "hello", "<2>": "bye"}
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>hi</p>"
    (tmp_path / "w.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-TREC-ID: w1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\nWARC/1.0\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n" % (len(body), body))
    assert [(r.docno, r.text) for r in readers.documents(spark, str(tmp_path / "w.warc")).collect()] == [("w1", "<p>hi</p>")]
    import gzip

    many = b"".join(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-TREC-ID: r%d\r\nContent-Length: 40\r\n\r\n%s\r\n\r\n" % (k, b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 21) for k in range(2500))
    (tmp_path / "z.warc.gz").write_bytes(gzip.compress(many[:1000]) + gzip.compress(many[1000:] + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut"))
    assert {(r.docno, r.text) for r in readers.documents(spark, str(tmp_path / "z.warc.gz")).collect()} == {(f"r{k}", "x" * 21) for k in range(2500)}
    news = "<DOC><DOCNO>n1</DOCNO><HL>Red Fox</HL><TEXT>ab cd</TEXT></DOC>"
    (tmp_path / "n.trectext").write_text(news)
    fields = lambda kind: {(r.field, r.begin, r.end) for r in readers.collection(spark, str(tmp_path / "n.trectext"), kind).fields.collect()}
    assert fields("trectext") == {("document", 0, 4), ("headline", 0, 2), ("text", 2, 4)}
    assert fields("trecalt") == {("document", 0, 2), ("text", 0, 2)}
    assert fields("trecchar") == {("document", 0, 10), ("headline", 0, 6), ("text", 6, 10)}
    (tmp_path / "d.xyz").write_bytes(b"\x01two words")
    readers.register("xyz", lambda data: (data[1:].decode(), {"title": "t"}))
    assert [(r.text, r.metadata["title"]) for r in readers.documents(spark, str(tmp_path / "d.xyz"), "xyz").collect()] == [("two words", "t")]
    (tmp_path / "f").write_text("what is the\n\nwhat is\n")
    assert readers.frames(spark, str(tmp_path / "f")) == ["what is the", "what is"]
    (tmp_path / "h").write_text("Run\nrunning run\n \nran run\n")
    assert {(r.word, r.stem) for r in readers.headwords(spark, str(tmp_path / "h")).collect()} == {("run", "run"), ("running", "run"), ("ran", "run")}
    (tmp_path / "t.txt").write_text("plain")
    assert readers.documents(spark, str(tmp_path / "t.txt")).first().text == "plain"
    with pytest.raises(ValueError):
        readers.documents(spark, "x.pdf")
    (tmp_path / "n.nt").write_text('<a> <p> "v \\" w"@en .\nbroken\n<a> <q> <b> .\n')
    t = readers.triples(spark, str(tmp_path / "n.nt"))
    assert {(r.s, r.p, r.o) for r in t.collect()} == {("a", "p", 'v \\" w'), ("a", "q", "b")} and readers.objects(t, "a", "q").count() == 1
    q = readers.parameter_queries("<parameters><query><number>7</number><text>#1(a b)</text><workingSetDocno>d</workingSetDocno></query></parameters>")
    assert q[0]["number"] == "7" and q[0]["working_set"] == ["d"]
    assert readers.topics('<t><topic number="1" type="faceted"><query>q</query><subtopic number="1" type="nav">s</subtopic></topic></t>')[0]["subtopics"][0]["text"] == "s"


def test_sinks(spark):
    r = spark.createDataFrame([("d1", 1.5), ("d2", 2.0)], "ext_id string, score double")
    assert [x.line for x in sinks.trec_run(r, "9", "run").orderBy("rank").collect()] == ["9 Q0 d2 1 2.000000 run", "9 Q0 d1 2 1.500000 run"]
