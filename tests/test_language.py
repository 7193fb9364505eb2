"""Syntax, static checks, values and readings, by tables."""

import pytest

from textloom import QueryError, RunError, compile
from textloom.functions.json_text import number_text, to_json
from textloom.functions.values import EvalError, call, compare, to_number, truthy
from textloom.plans import syntax

READINGS = [  # query, text, JSON, ambiguities
    # several readings: each repetition takes what it can, earlier branches and longer ends first, unless LAZY
    ("TEXT = street:(1 TO n (LETTER OR ' ')) number:(1 TO n (DIGIT OR ' '))", "Oak Lane 12", '{"street":"Oak Lane ","number":"12"}', 1),
    ("TEXT = 1 TO n LAZY tens:DIGIT 2 TO 3 unit:DIGIT", "98765", '{"tens":["9","8"],"unit":["7","6","5"]}', 0),
    ("TEXT = 0 TO 1 sign:'-' 0 TO 1 LAZY dash:'-' v:INT", "-7", '{"sign":"-","dash":null,"v":"7"}', 1),
    ("TEXT = 0 TO 1 LAZY sign:'-' 0 TO 1 dash:'-' v:INT", "-7", '{"sign":null,"dash":"-","v":"7"}', 0),
    ("TEXT = code:(2 TO 2 LETTER OR 3 TO 3 LETTER) 0 TO n more:LETTER", "abcde", '{"code":["a","b","c"],"more":["d","e"]}', 1),
    ("TEXT = 1 TO n size:('4' OR '40' OR '0')", "404", '["40","4"]', 1),
    ("flat = INT 'm2' AS 'area'\nTEXT = 1 TO n (flat OR INT OR LETTER OR ' ')", "ok 30m2 x", '["o","k"," ","area"," ","x"]', 1),
    # what labels hold
    ("TEXT = city:WORD ', ' zip:(5 TO 5 DIGIT) 0 TO 1 ('-' box:INT)", "Bergen, 50031", '{"city":"Bergen","zip":"50031","box":null}', 0),
    ("TEXT = city:WORD ', ' zip:(5 TO 5 DIGIT) 0 TO 1 ('-' box:INT)", "Bergen, 50031-77", '{"city":"Bergen","zip":"50031","box":"77"}', 0),
    ("TEXT = whole:(day:INT '/' month:INT)", "24/12", '{"whole":{"day":"24","month":"12"}}', 0),
    ("TEXT = box:(middle:(inner:INT 'px'))", "12px", '{"box":{"middle":{"inner":"12"}}}', 0),
    ("TEXT = 1 TO n (k:WORD '=' v:(INT OR WORD)) SPLITBY ';'", "depth=3;unit=cm", '[{"k":"depth","v":"3"},{"k":"unit","v":"cm"}]', 0),
    ("TEXT = (yes:'on' OR no:'off') AS { 'state': yes, 'missing': no }", "off", '{"state":null,"missing":"off"}', 0),
    ("reading = at:INT 'h ' deg:FLOAT 'C'\nTEXT = 1 TO n reading SPLITBY ', '", "6h 11.5C, 18h 9C", '[{"at":"6","deg":"11.5"},{"at":"18","deg":"9"}]', 0),
    ("TEXT = title:LINE NL body:(0 TO n ANY)", "Note\nbuy milk\nand eggs", '{"title":"Note","body":"buy milk\\nand eggs"}', 0),
    ("TEXT = h:HEX ' ' b:BIN ' ' a:IPV6 TAB e:EOF", "c0ffee 1011 fe80::17\t", '{"h":"c0ffee","b":"1011","a":"fe80::17","e":""}', 0),
    # repetition, separators, what is skipped, stops
    ("TEXT = 1 TO n (side:LETTER no:INT) SPLITBY (', ' OR ',')", "A1,B12, C3", '[{"side":"A","no":"1"},{"side":"B","no":"12"},{"side":"C","no":"3"}]', 0),
    ("TEXT = 0 TO n w:WORD SPLITBY 1 TO n ' '", "many   gaps here", '["many","gaps","here"]', 0),
    ("item = '- ' what:WORD NL\nTEXT = 1 TO n item SKIPPING (LINE NL)", "list\n- tea\n\n- rice\nend\n", '[{"what":"tea"},{"what":"rice"}]', 0),
    ("TEXT = 0 TO n hit:IPV4 SKIPPING ANY", "from 10.0.0.7 to 10.0.0.300 via 192.168.1.1.", '["10.0.0.7","192.168.1.1"]', 0),
    ("TEXT = key:(ANY UNTIL '=>') val:(ANY UNTILBEFORE EOF)", "a=b=>c", '{"key":"a=b","val":"c"}', 0),
    ("TEXT = head:(ANY UNTILBEFORE (DIGIT OR '(')) rest:(1 TO n ANY)", "size (12)", '{"head":"size ","rest":"(12)"}', 0),
    ("TEXT = letters:LETTER UNTILBEFORE '!' '!!'", "hey!!", '{"letters":["h","e","y"]}', 0),
    # rules that call themselves
    ("TEXT = tree\ntree = name:WORD 0 TO 1 ('[' 1 TO n tree SPLITBY ' ' ']')", "oak[leaf twig[bud]]",
     '{"name":"oak","tree":[{"name":"leaf","tree":null},{"name":"twig","tree":[{"name":"bud","tree":null}]}]}', 0),
    ("sum = sum '-' part OR part\npart = INT\nTEXT = sum", "9-4-3", '{"sum":{"sum":"9","part":"4"},"part":"3"}', 0),
    ("box = '<' 0 TO n box '>' AS COUNT(box)\nTEXT = box", "<<><<>>>", "2", 0),
    ("TEXT = pal\npal = c:LETTER pal c2:LETTER OR '|'", "no|on", '{"c":"n","pal":{"c":"o","pal":"|","c2":"o"},"c2":"n"}', 0),
    # conditions choose the next reading
    ("TEXT = 1 TO n a:DIGIT 1 TO n b:DIGIT WHERE COUNT(a) < COUNT(b)", "12345", '{"a":["1","2"],"b":["3","4","5"]}', 1),
    ("TEXT = first:(1 TO n LETTER) last:(1 TO n LETTER) WHERE last = 'son'", "Johnson", '{"first":"John","last":"son"}', 0),
    ("price = amount:FLOAT ' EUR' WHERE amount >= 10 AS NUM(amount)\nTEXT = 1 TO n (big:price OR small:(FLOAT ' EUR')) SPLITBY '; '", "4 EUR; 10 EUR; 99.5 EUR",
     '[{"small":"4 EUR"},{"big":10},{"big":99.5}]', 2),
    ("TEXT = 1 TO n kv SPLITBY ' '\nkv = k:WORD ':' v:(0 TO 1 WORD) WHERE v != '' AND NOT (k = 'pin') OR k = 'x'", "a:b x: c:d", '[{"k":"a","v":"b"},{"k":"x","v":""},{"k":"c","v":"d"}]', 0),
    ("TEXT = a:WORD 0 TO 1 (' ' b:WORD) WHERE b", "left right", '{"a":"left","b":"right"}', 0),
    ("TEXT = n:INT WHERE n != 5 AND n > 3 AND n <= 10", "10", '{"n":"10"}', 0),
    # templates
    ("TEXT = 1 TO n w:WORD SPLITBY ' ' AS { 'first': FIRST(w), 'last': LAST(w), 'n': COUNT(w), 'joined': JOIN(w, '+'), 'up': [UPPER(x) FOR x IN w] }", "red green blue",
     '{"first":"red","last":"blue","n":3,"joined":"red+green+blue","up":["RED","GREEN","BLUE"]}', 0),
    ("ware = name:WORD ',' qty:INT NL\nTEXT = 1 TO n ware AS { 'total': COUNT(ware), 'rows': [{ 'n': name, 'q': NUM(qty) } FOR ware] }", "nails,40\nscrews,7\n",
     '{"total":2,"rows":[{"n":"nails","q":40},{"n":"screws","q":7}]}', 0),
    ("p = street:WORD ' ' no:INT\nTEXT = who:WORD ': ' home:p AS { 'who': who, 'no': home.no, 'street': LOWER(home.street) }", "Ada: Elm 9", '{"who":"Ada","no":"9","street":"elm"}', 0),
    ("TEXT = 1 TO n w:WORD SPLITBY ' ' AS { 'letters': LISTOF x FOR x IN w }", "x y", '{"letters":["x","y"]}', 0),
    ("TEXT = head:cells NL 1 TO n cells SPLITBY NL AS [ZIP(head.c, c) FOR cells]\ncells = 1 TO n c:WORD SPLITBY ',' AS { 'c': c }", "id,name\na,Bo\nb,Cy", '[{"id":"a","name":"Bo"},{"id":"b","name":"Cy"}]', 0),
    ("m = k:WORD '=' v:INT AS { k: NUM(v) }\nTEXT = 1 TO n m SPLITBY '&' AS { 'x': 0, m }", "b=2&x=5", '{"x":5,"b":2}', 0),
    ("TEXT = s:(0 TO n ANY) AS { 't': TRIM(s), 'l': LOWER(s), 'u': UPPER(s) }", "  Straße ", '{"t":"Straße","l":"  straße ","u":"  STRASSE "}', 0),
    ("TEXT = at:ROW 1 TO n rec\nrec = w:WORD r:ROW c:COL NL", "ab\nc\n", '{"at":1,"rec":[{"w":"ab","r":1,"c":3},{"w":"c","r":2,"c":2}]}', 0),
    ("TEXT = INT AS { 'a': [null, true, -0.5, 'q'], 'a': 1, 'b': LISTOF 1, 'b': LISTOF 2 }", "1", '{"a":1,"b":[1,2]}', 0),
    ("TEXT = v:INT AS NUM(v)", "00012", "12", 0),
]


@pytest.mark.parametrize("query,text,wanted,ambiguities", READINGS)
def test_readings(query, text, wanted, ambiguities):
    out = compile(query).run(text)
    assert to_json(out.value) == wanted
    if ambiguities is not None:
        assert len(out.ambiguities) == ambiguities and out.ambiguity_check_complete


ACCEPTED = [  # query, accepted texts, rejected texts
    ("TEXT = WORD '/' WORD", ["und/oder", "åæ/ø", "x/y"], ["a1/b", "/b", "a b/c"]),
    ("TEXT = '#' 0 TO n ANY WORD", ["#end", "#7 days", "#"+"-"*3+"z"], ["#9", "#"]),
    ("TEXT = INT 'x' INT", ["3x4", "007x0"], ["x4", "3x", "3.0x4"]),
    ("TEXT = FLOAT '%'", ["99%", "0.25%"], [".5%", "5.%", "1.2.3%"]),
    ("TEXT = '0x' HEX", ["0xBEEF", "0x0"], ["0xBEEFY", "0xG", "0x"]),
    ("TEXT = 'b' BIN", ["b0110"], ["b012", "b"]),
    ("TEXT = 'ip=' IPV4 0 TO 1 ';'", ["ip=8.8.4.4", "ip=010.000.1.255;"], ["ip=8.8.4", "ip=8.8.4.4.4", "ip=8.8.4.444"]),
    ("TEXT = '[' IPV6 ']'", ["[::]", "[2001:db8::1]", "[::ffff:10.0.0.1]", "[a:b:c:d:e:f:1:2]"], ["[a:b]", "[::1::2]", "[12345::]", "[:1]"]),
    ("TEXT = 2 TO 2 PUNCT", ["?!", "→★", "$-"], ["a!", "! ", "12"]),
    ("TEXT = 1 TO 3 LETTER", ["q", "éß", "日本語"], ["", "abcd", "a-"]),
    ("TEXT = WORD NL WORD", ["up\ndown", "up\r\ndown", "up\rdown"], ["up down", "up\n\ndown"]),
    ("TEXT = 'a' TAB 'b' EOF", ["a\tb"], ["a b", "a\tb "]),
    ("TEXT = 1 TO n LINE SPLITBY NL", ["", "one", "one\ntwo\n\nfour", "\r\n"], []),
    ("TEXT = i'Müll' ANY", ["MÜLL!", "müll."], ["mull!", "Müll"]),
    ("TEXT = 2 TO 3 'ha' 0 TO 1 '!'", ["haha", "hahaha!"], ["ha", "hahahaha", "haha!!"]),
    ("TEXT = (0 TO n DIGIT UNTILBEFORE 'kg') 'kg'", ["kg", "12kg"], ["12", "1k2kg"]),
    ("TEXT = 1 TO n 'o' UNTIL 'x' '.'", ["oox."], ["oo.", "x."]),
    ("TEXT = 1 TO n (WORD ':' INT) SPLITBY ', ' 0 TO 1 NL", ["a:1", "a:1, b:22\n"], ["a:1,b:2", "a:1, "]),
]


@pytest.mark.parametrize("query,accepted,rejected", ACCEPTED)
def test_patterns(query, accepted, rejected):
    compiled = compile(query)
    for text in accepted:
        compiled.run(text, check_ambiguity=False)
    for text in rejected:
        with pytest.raises(RunError):
            compiled.run(text, check_ambiguity=False)


CODES = [
    ("page = LINE", "check::missing_root"), ("TEXT = header NL", "check::undefined_rule"), ("TEXT = day\nday = INT\nday = WORD", "check::duplicate_rule"), ("ALIAS TEXT = INT ':' INT", "check::root_is_alias"),
    ("TEXT = null:INT", "check::reserved_name"), ("TEXT = WORD '' INT", "check::empty_literal"), ("TEXT = 7 TO 3 DIGIT", "check::bad_bounds"), ("TEXT = 0 TO 50000 LETTER", "check::bound_too_large"),
    ("TEXT = 'red' OR 'blue' OR 'red'", "check::duplicate_branch"), ("TEXT = ANY UNTIL mark\nmark = '%'", "check::bad_stop"), ("TEXT = LETTER UNTILBEFORE (0 TO 3 ' ')", "check::empty_stop"),
    ("ALIAS up = down\nALIAS down = up\nTEXT = up", "check::alias_cycle"), ("ALIAS pair = left:INT ',' INT\nTEXT = pair", "check::label_in_alias"), ("TEXT = 1 TO n (0 TO 1 'z')", "check::empty_loop"),
    ("TEXT = loop\nloop = loop OR '.'", "check::empty_cycle"), ("TEXT = n:INT ' ' n:WORD", "check::duplicate_capture"), ("TEXT = name:WORD AS { 'n': nme }", "check::unknown_capture"),
    ("TEXT = one:INT AS [one FOR one]", "check::not_repeated"), ("TEXT = w:WORD ' ' INT AS { w }", "check::not_mergeable"), ("TEXT = w:WORD AS SHOUT(w)", "check::unknown_function"),
    ("TEXT = 1 TO n w:WORD SPLITBY ' ' AS COUNT(w, w)", "check::arity"), ("spot = x:INT ',' y:INT\nTEXT = spot AS spot.z", "check::unknown_field"), ("TEXT = WORD & INT", "parse::unexpected_char"),
    ("TEXT = WORD 'open", "parse::unterminated_string"), ("TEXT = 'tab\\y'", "parse::bad_escape"), ("TEXT = INT OR", "parse::unexpected_end"), ("TEXT INT", "parse::unexpected_token"),
    ("TEXT = " + "(" * 130 + "INT" + ")" * 130, "parse::too_deep"), ("TEXT = INT AS 123456789012345678901234567890", "parse::bad_number"),
]


@pytest.mark.parametrize("query,code", CODES)
def test_static_errors(query, code):
    with pytest.raises(QueryError) as error:
        compile(query)
    assert [p.code for p in error.value.problems if p.severity == "error"] == [f"loom::{code}"]


def test_lints():
    found = compile("ALIAS sep = ','\nunused = WORD\nTEXT = 1 TO n 1 TO n LETTER OR INT ':' TEXT").warnings
    assert [p.code for p in found] == ["loom::lint::unused_alias", "loom::lint::unused_rule", "loom::lint::nested_repetition", "loom::lint::right_recursion"]
    assert "did you mean `weekday`" in pytest.raises(QueryError, compile, "weekday = WORD\nTEXT = wekday").value.problems[0].help


def test_printed_queries_read_back():
    source = (
        "TEXT = 'x\\n' OR i'y' (2 TO 3 LAZY a:(b:WORD OR c:INT) SPLITBY (', ' OR ',') SKIPPING TAB UNTIL (NL OR EOF)) WHERE NOT (a = 'x' OR b.c >= -2.5) AND COUNT(a) > 1 "
        "AS { 'k': LISTOF x FOR x IN a, a, b: [1e-8, true, null, y FOR y] }\nSTRICT s = l:(1 TO n INT)\nALIAS q = 'it''' ".replace("''' ", "\\''")
    )
    tree = syntax.parse(source)
    assert syntax.parse(syntax.show(tree)) == tree


FAILURES = [
    ("TEXT = n:WORD AS NUM(n)", "seven", "eval::error"), ("TEXT = who:WORD WHERE who = 'root'", "guest", "input::no_parse"), ("TEXT = 1 TO n n:INT SPLITBY '+' AS JOIN([false FOR n], '-')", "4+5", "eval::error"),
    ("TEXT = 1 TO n w:WORD SPLITBY '.' AS ZIP(['only'], w)", "a.b.c", "eval::error"), ("TEXT = 1 TO n d:DIGIT WHERE d >= 3", "345", "eval::error"),
]


@pytest.mark.parametrize("query,text,code", FAILURES)
def test_run_failures(query, text, code):
    with pytest.raises(RunError) as error:
        compile(query).run(text)
    assert error.value.code == f"loom::{code}"


def test_limits_and_strictness():
    two = compile("TEXT = 1 TO n left:LETTER 1 TO n right:LETTER")
    assert pytest.raises(RunError, two.run, "abc", strict=True).value.code == "loom::input::ambiguous"
    assert pytest.raises(RunError, two.run, "z" * 60, max_steps=25).value.code == "loom::input::too_expensive"
    assert not two.run("abc", check_ambiguity=False).ambiguity_check_complete
    assert not compile("TEXT = 1 TO n 1 TO n x:LETTER").run("q" * 70, ambiguity_steps=60).ambiguity_check_complete
    strict = compile("STRICT tag = 1 TO n p:PUNCT 1 TO n q:PUNCT\nfree = 1 TO n r:DIGIT 1 TO n s:DIGIT\nTEXT = tag ' ' free")
    assert [p.message.split("`")[1] for p in pytest.raises(RunError, strict.run, "#!? 204").value.problems] == ["tag"]
    assert len(strict.run("#! 204").ambiguities) == 1
    deep = compile("TEXT = nest\nnest = '{' 0 TO 1 nest '}'")
    assert pytest.raises(RunError, deep.run, "{" * 40 + "}" * 40, max_depth=12).value.code == "loom::input::too_deep"
    assert to_json(deep.run("{" * 3000 + "}" * 3000, check_ambiguity=False).value).count('"nest"') == 3000
    flat = compile("chain = DIGIT 0 TO 1 chain\nTEXT = plain:(1 TO n DIGIT) OR linked:chain").run("31415926", max_depth=3)
    assert "more than 3" in flat.ambiguities[0].failure and to_json(flat.value) == '{"plain":"31415926"}'
    keys = compile("TEXT = INT AS ZIP(['up', 'down', 'up'], [true, null, 'x'])")
    out = keys.run("0")
    assert [k.key for k in out.repeated_keys] == ["up"] and to_json(out.value) == '{"up":"x","down":null}'
    assert pytest.raises(RunError, keys.run, "0", strict=True).value.code == "loom::eval::repeated_key"


def test_explanations():
    problem = pytest.raises(RunError, compile("TEXT = WORD ' costs ' FLOAT NL").run, "bread cost 3\n").value.problems[0]
    assert (problem.start, problem.label) == (5, "expected ' costs '")
    problem = pytest.raises(RunError, compile("TEXT = INT ';'").run, "1024").value.problems[0]
    assert problem.start == 3 and "after this" in problem.label
    assert "empty" in pytest.raises(RunError, compile("TEXT = 1 TO n DIGIT").run, "").value.problems[0].message
    problem = pytest.raises(RunError, compile("TEXT = '# ' LINE").run, "# top").value.problems[0]
    assert "UNTILBEFORE NL" in problem.help
    entry = compile("TEXT = 1 TO n entry\nentry = user:(ANY UNTIL ' -> ') host:(ANY UNTIL '!') NL")
    problem = pytest.raises(RunError, entry.run, "eve -> db1!\nbob -> db2\nann -> db3\n").value.problems[0]
    assert "line 2" in problem.help and problem.related


def test_linear_work():
    query = compile("TEXT = 1 TO n setting\nsetting = name:WORD ': ' on:('yes' OR 'no') NL AS { name: on }")
    steps = [query.run("light: yes\n" * n).steps for n in (100, 400)]
    assert steps[1] / steps[0] < 6


def test_numbers_and_values():
    for value, text in ((12.0, "12.0"), (1e16, "1e16"), (1e15, "1000000000000000.0"), (1e-5, "0.00001"), (1e-7, "1e-7"), (-0.0, "-0.0"), (1.5e300, "1.5e300"), (3, "3"), (0.1, "0.1"), (123456.789, "123456.789")):
        assert number_text(value) == text
    assert [to_number(x) for x in ("007", "3.50", " 5 ", "inf", "1_0", "0x1", "٣", "1e3", ".5", "5.", "+7", "9223372036854775808")] == [7, 3.5, 5, None, None, None, None, 1000.0, 0.5, 5.0, 7, 9223372036854775808.0]
    assert compare("42", "=", 42) and not compare("10", "=", "10.0") and compare("9", "<", "10") and compare("b", ">", "a") and not compare(["42"], "CONTAINS", 42)
    assert compare({"a": 1}, "CONTAINS", "a") and not compare(None, "STARTSWITH", "a") and compare("abc", "ENDSWITH", "bc")
    assert [truthy(x) for x in (None, False, "", [], {}, 0, "a", True)] == [False] * 5 + [True] * 3
    assert call("JOIN", [["a", None, 2], "+"]) == "a+2" and call("COUNT", [None]) == 0 and call("FIRST", [[]]) is None and call("TRIM", ["\u3000a\u3000"]) == "a"
    for name, arguments in (("LOWER", [1]), ("COUNT", ["x"]), ("FIRST", ["x"]), ("JOIN", [["a"], None]), ("ZIP", [["a"], ["b", "c"]])):
        with pytest.raises(EvalError):
            call(name, arguments)
