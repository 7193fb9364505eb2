"""On DataFrames: native expressions equal the kernel, modes and failures, sources, streams, SQL, the command line."""

import io
import os
import subprocess
import sys

import pytest

from textloom import compile
from textloom.__main__ import main
from textloom.operators.extract import remembered
from textloom.operators.sql import register
from textloom.plans import native
from textloom.sources import text as sources
from textloom.streaming.records import read_records, write_records

LOWERED = [
    ("TEXT = '{\"k\": ' k:INT '}' WHERE NUM(k) >= 50 AS { 'k': NUM(k) }", ['{"k": 5}', '{"k": 99}', "x"]),
    ("TEXT = kind:WORD '#' id:INT", ["Customer#0001", "x#", "é#12"]),
    ("TEXT = code:INT '-' name:(1 TO n ANY)", ["3-NOT SPEC", "3-"]),
    ("TEXT = 1 TO n w:WORD SPLITBY ' ' AS { 'first': FIRST(w), 'last': LAST(w), 'n': COUNT(w), 'j': JOIN(w, '+'), 'u': [UPPER(w) FOR w] }", ["ab c", "x", "a  b"]),
    ("TEXT = scheme:(ANY UNTIL '://') host:(ANY UNTIL '/') lang:WORD '/' id:INT 0 TO n ANY", ["https://a.b/en/12?x", "http://a/fr/7", "q"]),
    ("TEXT = p:(ANY UNTILBEFORE ('?' OR EOF)) 0 TO 1 ('?' q:(1 TO n ANY UNTILBEFORE ('#' OR EOF))) 0 TO 1 ('#' 0 TO n ANY)", ["/a?x=1#t", "/a", "/a?"]),
    ("TEXT = a:WORD 0 TO 1 (' ' b:INT)", ["x 5", "x", "x "]),
    ("TEXT = 0 TO n w:WORD SKIPPING ANY AS COUNT(w)", ["a1 b,c", " ", "é2 x", ""]),
    ("big = n:INT WHERE NUM(n) > 10 AS NUM(n)\nTEXT = 0 TO n big SKIPPING ANY", ["5 20 x 11", "7", ""]),
    ("TEXT = 0 TO n FLOAT SKIPPING ANY", ["1.2.3 x 4", "a"]),
    ("TEXT = 1 TO n (l:LINE) SPLITBY NL", ["a\r\nb\n\nc", "", "x\n"]),
    ("TEXT = (n:INT OR w:WORD) '!' AS [n, w]", ["12!", "ab!"]),
    ("pair = k:WORD '=' v:INT AS { 'k': k, 'v': NUM(v) }\nTEXT = 1 TO n pair SPLITBY '&'", ["a=1&b=2", "a=1&", "q=5"]),
    ("stop = name:WORD ': ' lines NL AS { 'name': name, 'lines': lines }\nlines = 1 TO n INT SPLITBY (', ' OR ' & ')\nTEXT = 1 TO n stop", ["Harbour: 4, 12 & 7\nMill: 3\n", "Mill: 3"]),
    ("TEXT = i'Ab' ' ' x:(2 TO 3 DIGIT)", ["aB 12", "AB 1234"]),
    ("TEXT = k:(ANY UNTIL (NL OR EOF))", ["abc\n", "abc", "a\nb"]),
    ("TEXT = 1 TO n x:(a:WORD ':' b:(1 TO n DIGIT)) SPLITBY ';'", ["a:1;b:23", "a:"]),
    ("TEXT = a:WORD ' ' b:IPV4 WHERE a STARTSWITH 'x' AND NOT b = '1.1.1.1'", ["xy 1.2.3.4", "y 1.2.3.4", "x 1.1.1.1", "x 256.1.1.1"]),
    ("TEXT = '[' 0 TO n item SPLITBY ', ' ']'\nitem = w:WORD 0 TO 1 (':' n:INT) AS { 'w': w, 'n': NUM(n) }", ["[]", "[a, b:2]", "[a:1, b]", "[a:]"]),
]


def rows(df):
    return [(r.i, r.value, r.value_error is None) for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("source,given", LOWERED)
def test_native_equals_kernel(spark, source, given):
    query = compile(source)
    df = spark.createDataFrame(list(enumerate([*given, None])), "i int, text string")
    assert query.explain() == "native"
    own, other = (rows(query.extract(df, on_error="null", engine=e)) for e in ("native", "kernel"))
    assert [x[:2] for x in own] == [x[:2] for x in other] and [x[2] for x in own] == [x[2] for x in other]


def test_what_is_not_proven_goes_to_the_kernel():
    for source in (
        "TEXT = 1 TO n a:DIGIT 1 TO n b:DIGIT", "TEXT = l\nl = '(' 0 TO 1 l ')'", "TEXT = x:('1' OR '1' '2')", "TEXT = a:WORD '.' b:FLOAT '.' c:FLOAT", "TEXT = IPV6",
        "TEXT = l:(1 TO n ANY) '/' r:(0 TO n ANY)", "r = x:WORD WHERE x = 'a'\nTEXT = r", "TEXT = x:WORD AS { x: 1 }",
    ):
        assert compile(source).explain().startswith("kernel: "), source


def test_native_plan_stays_in_the_jvm(spark):
    df = compile("TEXT = '{\"k\": ' k:INT '}' AS { 'k': NUM(k) }").extract(spark.createDataFrame([("x",)], "text string"), on_error="drop")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_modes_and_failures(spark):
    df = spark.createDataFrame([(1, "b_2"), (2, "!"), (3, None)], "i int, text string")
    query = compile("TEXT = w:WORD '_' n:INT AS { w: NUM(n), 'z': null }")
    got = query.extract(df, mode="json", on_error="null").orderBy("i").collect()
    assert [r.value for r in got] == ['{"b":2,"z":null}', None, None]
    assert got[1].value_error.code == "loom::input::no_parse" and got[2].value_error is None
    assert query.extract(df, mode="variant", on_error="drop").selectExpr("try_variant_get(value, '$.b', 'int') b").collect()[0].b == 2
    for engine in ("native", "kernel"):
        with pytest.raises(Exception, match="no_parse"):
            compile("TEXT = w:WORD '_' INT").extract(df, engine=engine).collect()
    with pytest.raises(native.Cannot):
        query.extract(df, engine="native")
    empty = spark.createDataFrame([], "text string, value string, value_error string")
    assert compile("TEXT = WORD").extract(empty, on_error="null").count() == 0


def test_documents_lines_and_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"k = 1\r\nnoise\nq = 2\n")
    (tmp_path / "b.txt").write_bytes(b"ok \xff")
    assert sources.documents(spark, str(tmp_path / "a.txt")).collect()[0].text == "k = 1\r\nnoise\nq = 2\n"
    got = {os.path.basename(r.path): (r.text is None, r.invalid_at) for r in sources.valid_documents(spark, str(tmp_path), "null").collect()}
    assert got == {"a.txt": (False, None), "b.txt": (True, 3)}
    with pytest.raises(Exception, match="byte 3"):
        sources.valid_documents(spark, str(tmp_path)).collect()
    query = compile("rec = k:WORD ' = ' v:INT NL AS { 'k': k, 'v': NUM(v) }\nTEXT = 1 TO n rec SKIPPING (LINE NL)")
    assert [tuple(r.record) for r in query.lines(sources.lines(spark, str(tmp_path / "a.txt"))).collect()] == [("k", 1), ("q", 2)]
    assert query.run("k = 1\r\nnoise\nq = 2\n").value == [{"k": "k", "v": 1}, {"k": "q", "v": 2}]
    with pytest.raises(native.Cannot):
        compile("rec = k:(ANY UNTIL ';') NL\nTEXT = 1 TO n rec").record_rule()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("k = 1\nnoise\nq = 2\n")
    query = compile("rec = k:WORD ' = ' v:INT NL AS { 'k': k, 'v': NUM(v) }\nTEXT = 1 TO n rec SKIPPING (LINE NL)")
    write_records(read_records(spark, str(tmp_path / "in"), query), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("k", 1), ("q", 2)]


def test_sql(spark):
    register(spark, "pull")
    spark.createDataFrame([("a_1",), ("!",)], "t string").createOrReplaceTempView("pulled")
    got = spark.sql("SELECT e.value, e.code FROM pulled, LATERAL pull(t, 'TEXT = w:WORD \"_\" INT') e").collect()
    assert sorted(map(tuple, got), key=str) == [('{"w":"a"}', None), (None, "loom::input::no_parse")]


def test_command_line(capsys, monkeypatch, tmp_path):
    def run(arguments, given=b""):
        monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": io.BytesIO(given)})())
        code = main(arguments)
        return (code, *capsys.readouterr())

    (tmp_path / "q").write_text("TEXT = 1 TO n a:DIGIT 1 TO n b:DIGIT AS [COUNT(a), COUNT(b)]")
    assert run(["--compact", str(tmp_path / "q"), "-"], b"123")[:2] == (0, "[2,1]\n")
    assert run(["-e", "TEXT = w:WORD"], "é".encode())[:2] == (0, '{\n  "w": "é"\n}\n')
    assert run(["run", "--strict", str(tmp_path / "q")], b"123")[0] == 1
    assert run(["check", str(tmp_path / "q")])[:2] == (0, "query OK (1 rules)\n")
    assert run(["check", str(tmp_path / "q"), "-"], b"123")[0] == 2
    assert run(["-e", "TEXT = WORD"], b"\xff")[2].startswith("error[loom::io::utf8]")
    assert run(["-e", "TEXT = "])[0] == 1 and run([str(tmp_path / "none")])[0] == 1


def test_closed_pipe_is_success():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(f"printf abc | {sys.executable} -m textloom -e 'TEXT = WORD'; echo $?", shell=True, cwd=root, capture_output=True, text=True)
    assert done.stdout.split()[-1] == "0"


def test_numbers_beyond_64_bits_in_conditions(spark):
    texts = ["99999999999999999999 5 18446744073709551616 11", "5 9", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for source, wanted in (
        ("big = n:INT WHERE NUM(n) > 10\nTEXT = 0 TO n big SKIPPING ANY AS COUNT(big)", [3, 0, 0]),
        ("some = n:INT WHERE NUM(n)\nTEXT = 0 TO n some SKIPPING ANY AS COUNT(some)", [4, 2, 0]),
        ("v = n:INT AS NUM(n)\nTEXT = v ' ' 0 TO n ANY WHERE v >= 6 AS COUNT(['a'])", [1, None, None]),
    ):
        own, other = (rows(compile(source).extract(df, on_error="null", engine=e)) for e in ("native", "kernel"))
        assert own == other and [x[1] for x in own] == wanted


def test_kernel_rows_of_one_split_are_shared_among_tasks(spark):
    df = spark.range(400).selectExpr("id i", "concat('Customer#', lpad(cast(id as string), 9, '0')) text").coalesce(1)
    query = compile("TEXT = WORD '#' a:(1 TO n DIGIT) b:(1 TO n DIGIT) WHERE b = '1' OR b = '77' AS { 'a': a, 'b': b }")
    got = query.extract(df, on_error="drop")
    tasks = [len(rows) for rows in got.rdd.glom().collect()]
    assert len([n for n in tasks if n]) >= 8 and sum(tasks) == len([i for i in range(400) if str(i)[-1] == "1" or f"{i:09}"[-2:] == "77"])
    assert {r.value.a + r.value.b for r in got.collect()} == {f"{i:09}" for i in range(400) if i % 10 == 1 or i % 100 == 77}
    again = compile("TEXT = WORD").extract(query.extract(df, on_error="null"), on_error="null", engine="kernel")  # spread once
    assert str(again._jdf.queryExecution().optimizedPlan()).count("Repartition") == 1


def test_repeated_characters_are_one_step():
    query = compile("TEXT = WORD '#' a:(1 TO n DIGIT) b:(1 TO n DIGIT) WHERE b = '1' OR b = '77'")
    out = query.run("Customer#" + "0" * 40 + "77")
    assert out.value == {"a": "0" * 40, "b": "77"} and out.steps < 700  # each end of each repetition explored: above 1,000
    assert [a.advice for a in out.ambiguities] == [] and query.run("C#11").value == {"a": "1", "b": "1"}
    assert compile("TEXT = 0 TO 2 LAZY a:DIGIT b:(1 TO 3 LAZY DIGIT) 0 TO n c:DIGIT").run("12345").value == {"a": [], "b": "1", "c": ["2", "3", "4", "5"]}


def test_a_text_that_comes_again_is_read_once(spark):
    read: list = []
    get = remembered(lambda x: read.append(x) or [x], 400)
    assert [get(x) for x in ["a", "b", "a", "b", "long" * 10, "long" * 10]] == [[x] for x in ["a", "b", "a", "b", "long" * 10, "long" * 10]]
    assert read == ["a", "b", "long" * 10, "long" * 10]
    assert all(get(str(n)) == [str(n)] for n in range(100)) and get("a") == ["a"] and read.count("a") == 2  # few are kept
    texts = ["red widget", "small blue gear", "x", None, "9"] * 100
    query = compile("TEXT = a:WORD 0 TO 1 (' ' b:WORD) 0 TO 1 (' ' c:WORD) WHERE c")
    got = query.extract(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), on_error="null").orderBy("i").collect()
    assert [r.value and tuple(r.value) for r in got] == [("red", None, "widget"), ("small", "blue", "gear"), None, None, None] * 100
    assert [r.value_error and r.value_error.code for r in got] == [None, None, "loom::input::no_parse", None, "loom::input::no_parse"] * 100


@pytest.mark.parametrize("source", ["TEXT = 0 TO n w:WORD SKIPPING ANY AS COUNT(w)", "TEXT = 1 TO n w:WORD SKIPPING ANY AS { 'first': FIRST(w), 'last': LAST(w) }"])
def test_a_search_tries_each_character_once(spark, source):
    texts = ["éa b", "́x", "a" + "́" * 40 + "b c", "1a‍b2 \U0001d49c", " 9 ", "", "x\ny\r\nz"]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string")
    query = compile(source)
    own, other = (rows(query.extract(df, on_error="null", engine=e)) for e in ("native", "kernel"))
    assert own == other
    plan = str(query.extract(df, on_error="drop")._jdf.queryExecution().optimizedPlan())
    assert "(?<!" not in plan and "(?s:.)" not in plan and "lambda" not in plan
