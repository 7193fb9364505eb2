"""The engine's own queries on the test tables, each with DuckDB SQL for the same rows where SQL can say it.

Every query extracts with a grammar; the relational part around it is ordinary DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.extract import compile
from .sources.text import text_lines

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def _fields(name: str, table: str, key: str, column: str, source: str, out: list[str], sql: str | None, on_error: str = "drop", engine: str = "auto") -> None:
    """Register a query that extracts ``source`` from ``column`` and returns the key and fields of the value (``value`` itself for no fields)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key), F.col(column).alias("_text"))
        got = compile(source).extract(df, "_text", "_value", on_error=on_error, engine=engine)
        return got.select(key, *([F.col("_value").alias("value")] if not out else [F.col("_value")[c].alias(c) for c in out]))

    _add(name, run, sql)


# ---- one record a text

_fields("props_num", "events", "event_id", "props", "TEXT = '{\"k\": ' k:INT '}' AS { 'k': NUM(k) }", ["k"], "select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
_fields("props_where", "events", "event_id", "props", "TEXT = '{\"k\": ' k:INT '}' WHERE NUM(k) >= 50 AS { 'k': NUM(k) }", ["k"], "select * from (select event_id, cast(json_extract(props, '$.k') as bigint) k from events) where k >= 50")
_fields("cust_split", "customer", "c_custkey", "c_name", "TEXT = kind:WORD '#' id:INT", ["kind", "id"], "select c_custkey, regexp_extract(c_name, '^([^#]*)#([0-9]+)$', 1) kind, regexp_extract(c_name, '^([^#]*)#([0-9]+)$', 2) id from customer")
_fields("supp_num", "supplier", "s_suppkey", "s_name", "TEXT = 'Supplier#' id:INT AS { 'id': NUM(id) }", ["id"], "select s_suppkey, cast(regexp_extract(s_name, '#([0-9]+)$', 1) as bigint) id from supplier")
_fields("brand_num", "part", "p_partkey", "p_brand", "TEXT = i'brand#' id:INT AS { 'id': NUM(id) }", ["id"], "select p_partkey, cast(regexp_extract(p_brand, '#([0-9]+)$', 1) as bigint) id from part")
_fields("nation_num", "nation", "n_nationkey", "n_name", "TEXT = 'NATION_' id:INT AS { 'id': NUM(id), 'even': COUNT(['a', 'b']) }", ["id", "even"], "select n_nationkey, cast(regexp_extract(n_name, '_([0-9]+)$', 1) as bigint) id, cast(2 as bigint) even from nation")
_fields("prio_split", "orders", "o_orderkey", "o_orderpriority", "TEXT = code:INT '-' name:(1 TO n ANY)", ["code", "name"], "select o_orderkey, split_part(o_orderpriority, '-', 1) code, substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) name from orders")
_fields("prio_high", "orders", "o_orderkey", "o_orderpriority", "TEXT = code:INT '-' name:(1 TO n ANY) WHERE NUM(code) <= 2 AND NOT name = 'X' AS { 'code': NUM(code), 'name': LOWER(name) }", ["code", "name"], "select o_orderkey, cast(split_part(o_orderpriority, '-', 1) as bigint) code, lower(substr(o_orderpriority, strpos(o_orderpriority, '-') + 1)) name from orders where cast(split_part(o_orderpriority, '-', 1) as bigint) <= 2")
_fields("first_last_join", "part", "p_partkey", "p_name", "TEXT = 1 TO n w:WORD SPLITBY ' ' AS { 'first': FIRST(w), 'last': LAST(w), 'n': COUNT(w), 'joined': JOIN(w, '+') }", ["first", "last", "n", "joined"], "select p_partkey, l[1] as first, l[-1] as last, len(l) n, array_to_string(l, '+') joined from (select p_partkey, string_split(p_name, ' ') l from part)")
_fields("upper_lower_trim", "part", "p_partkey", "p_name", "TEXT = t:(1 TO n ANY) AS { 'up': UPPER(t), 'low': LOWER(t), 'trimmed': TRIM(t) }", ["up", "low", "trimmed"], "select p_partkey, upper(p_name) up, lower(p_name) low, trim(p_name) trimmed from part")
_fields("each_upper", "part", "p_partkey", "p_name", "TEXT = 1 TO n w:WORD SPLITBY ' ' AS { 'joined': JOIN([UPPER(w) FOR w], '-') }", ["joined"], "select p_partkey, upper(replace(p_name, ' ', '-')) joined from part")
_fields("token_class", "part", "p_partkey", "p_type", "TEXT = (n:INT OR w:WORD) AS { 'n': n, 'w': w }", ["n", "w"], "select p_partkey, case when regexp_matches(p_type, '^[0-9]+$') then p_type end n, case when regexp_matches(p_type, '^[A-Za-z]+$') then p_type end w from part where regexp_matches(p_type, '^([0-9]+|[A-Za-z]+)$')")
_fields("bounded_digits", "customer", "c_custkey", "c_name", "TEXT = 'Customer#' head:(2 TO 2 DIGIT) rest:(1 TO n DIGIT)", ["head", "rest"], "select c_custkey, substr(c_name, 10, 2) head, substr(c_name, 12) rest from customer where regexp_matches(c_name, '^Customer#[0-9]{3,}$')")

_URL = "regexp_extract(url, '^(.*?)://(.*?)/([a-z]+)/([0-9]+)', {})"
_fields("url_parts", "pages", "page_id", "url", "TEXT = scheme:(ANY UNTIL '://') host:(ANY UNTIL '/') lang:WORD '/' id:INT 0 TO n ANY AS { 'scheme': scheme, 'host': host, 'lang': lang, 'id': NUM(id) }", ["scheme", "host", "lang", "id"], f"select page_id, {_URL.format(1)} scheme, {_URL.format(2)} host, {_URL.format(3)} lang, cast({_URL.format(4)} as bigint) id from pages where regexp_matches(url, '^.*?://.*?/[a-z]+/[0-9]+')")
_fields("url_query_opt", "pages", "page_id", "url", "TEXT = path:(ANY UNTILBEFORE ('?' OR '#' OR EOF)) 0 TO 1 ('?' q:(1 TO n ANY UNTILBEFORE ('#' OR EOF))) 0 TO 1 ('#' 0 TO n ANY) AS { 'path': path, 'q': q }", ["path", "q"], r"select page_id, regexp_extract(url, '^[^?#]*') path, nullif(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '') q from pages where not regexp_matches(url, '^[^?#]*\?(#|$)')")
_fields("url_greedy", "pages", "page_id", "url", "TEXT = l:(1 TO n ANY) '/' r:(0 TO n ANY)", ["l", "r"], "select page_id, regexp_extract(url, '^(.*)/(.*)$', 1) l, regexp_extract(url, '^(.*)/(.*)$', 2) r from pages", engine="kernel")
_fields("url_lazy", "pages", "page_id", "url", "TEXT = l:(1 TO n LAZY ANY) '/' r:(0 TO n ANY)", ["l", "r"], "select page_id, regexp_extract(url, '^(.*?)/(.*)$', 1) l, regexp_extract(url, '^(.*?)/(.*)$', 2) r from pages", engine="kernel")
_fields("url_contains", "pages", "page_id", "url", "TEXT = u:(1 TO n ANY) WHERE u CONTAINS 'page=' AS { 'u': u }", ["u"], "select page_id, url u from pages where contains(url, 'page=')")
_fields("url_starts", "pages", "page_id", "url", "TEXT = u:(1 TO n ANY) WHERE u STARTSWITH 'https' AS { 'u': u }", ["u"], "select page_id, url u from pages where starts_with(url, 'https')")
_fields("url_ends", "pages", "page_id", "url", "TEXT = u:(1 TO n ANY) WHERE u ENDSWITH '.html' OR u ENDSWITH '#top' AS { 'u': u }", ["u"], "select page_id, url u from pages where ends_with(url, '.html') or ends_with(url, '#top')")
_fields("host_labels", "pages", "page_id", "url", "ALIAS scheme = ('https' OR i'file') '://'\nTEXT = scheme 1 TO n label:(1 TO n (LETTER OR DIGIT OR '-')) SPLITBY '.' '/' 0 TO n ANY AS { 'n': COUNT(label), 'last': LAST(label) }", ["n", "last"], "select page_id, len(h) n, h[-1] as last from (select page_id, string_split(regexp_extract(url, '^https://([A-Za-z0-9.-]+)/', 1), '.') h from pages where regexp_matches(url, '^https://[A-Za-z0-9.-]+/'))")
_fields("html_title", "pages", "page_id", "html", "TEXT = ANY UNTIL '<title>' t:(ANY UNTIL '</title>') 0 TO n ANY AS { 't': t }", ["t"], "select page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') t from pages where regexp_matches(html, '<title>.*?</title>', 's')")
_fields("doc_first_sentence", "documents", "doc_id", "text", "TEXT = s:(ANY UNTIL '.') 0 TO n ANY AS { 's': s }", ["s"], "select doc_id, substr(text, 1, strpos(text, '.') - 1) s from documents where contains(text, '.')")

# ---- searches over a text


def _found(name: str, source: str, regex: str, table: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    _fields(name, table, key, column, source, [], f"select {key}, cast(len(regexp_extract_all({column}, '{regex}')) as bigint) as value from {table} where {column} is not null")


_found("doc_words", "TEXT = 0 TO n w:WORD SKIPPING ANY AS COUNT(w)", r"\p{L}+")
_found("doc_ints", "TEXT = 0 TO n w:INT SKIPPING ANY AS COUNT(w)", "[0-9]+")
_found("doc_floats", "TEXT = 0 TO n w:FLOAT SKIPPING ANY AS COUNT(w)", r"[0-9]+(\.[0-9]+)?")
_found("doc_letters", "TEXT = 0 TO n w:LETTER SKIPPING ANY AS COUNT(w)", r"\p{L}")
_found("doc_digits", "TEXT = 0 TO n w:DIGIT SKIPPING ANY AS COUNT(w)", "[0-9]")
_found("doc_punct", "TEXT = 0 TO n w:PUNCT SKIPPING ANY AS COUNT(w)", r"[^\p{L}\p{N}\s\x{85}\x{A0}]")
_fields("doc_big_nums", "documents", "doc_id", "text", "big = n:INT WHERE NUM(n) > 10\nTEXT = 0 TO n big SKIPPING ANY AS COUNT(big)", [], "select doc_id, cast(len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: try_cast(x as double) > 10)) as bigint) as value from documents where text is not null")
_fields("doc_edge_words", "documents", "doc_id", "text", "TEXT = 1 TO n w:WORD SKIPPING ANY AS { 'first': FIRST(w), 'last': LAST(w) }", ["first", "last"], r"select doc_id, l[1] as first, l[-1] as last from (select doc_id, regexp_extract_all(text, '\p{L}+') l from documents) where len(l) > 0")


def _doc_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = compile("TEXT = 1 TO n a:IPV4 SKIPPING ANY AS { 'n': COUNT(a), 'first': FIRST(a) }").extract(df, on_error="drop")
    return got.select("doc_id", F.col("value.n").alias("n"), F.col("value.first").alias("first"))


_OCTET = "(?:0{0,2}[0-9]|0?[0-9]{2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_add("doc_ipv4", _doc_ipv4, rf"""with f as (select doc_id, regexp_extract_all(regexp_replace(text, '[0-9.]+', '|\0|', 'g'), '\|[0-9.]+\|') l from documents),
    g as (select doc_id, list_transform(list_filter(l, lambda x: regexp_matches(x, '^\|(?:[0-9]*[.])?\|$') or regexp_matches(x, '^\|{_OCTET}(\.{_OCTET}){{3}}\.?\|$')), lambda x: regexp_extract(x, '[0-9]+(\.[0-9]+){{3}}')) h from f),
    k as (select doc_id, list_filter(h, lambda x: x <> '') h from g) select doc_id, cast(len(h) as bigint) n, h[1] as first from k where len(h) > 0""")


# ---- lists as rows


def _rows(name: str, table: str, key: str, column: str, source: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key), F.col(column).alias("_text"))
        got = compile(source).extract(df, "_text", "_value", on_error="drop")
        return got.select(key, F.posexplode("_value").alias("pos", "item")).select(key, (F.col("pos") + 1).cast("bigint").alias("pos"), "item")

    _add(name, run, sql)


_rows("pname_words", "part", "p_partkey", "p_name", "TEXT = 1 TO n WORD SPLITBY ' '", "select p_partkey, unnest(range(1, len(l) + 1)) pos, unnest(l) item from (select p_partkey, string_split(p_name, ' ') l from part)")
_rows("doc_lines", "documents", "doc_id", "text", "TEXT = 1 TO n LINE SPLITBY NL", r"select doc_id, unnest(range(1, len(l) + 1)) pos, unnest(l) item from (select doc_id, string_split_regex(text, '\r\n|\n|\r') l from documents)")
_rows("name_digits", "nation", "n_nationkey", "n_name", "TEXT = 'NATION_' d AS d\nd = 1 TO n DIGIT", "select n_nationkey, unnest(range(1, len(d) + 1)) pos, unnest(d) item from (select n_nationkey, string_split(substr(n_name, 8), '') d from nation)")


def _url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    source = """pair = k:(1 TO n (LETTER OR DIGIT)) '=' v:(0 TO n (LETTER OR DIGIT)) AS { 'k': k, 'v': v }
        pairs = 1 TO n pair SPLITBY '&'
        TEXT = ANY UNTIL '?' pairs ANY UNTILBEFORE EOF AS pairs"""
    got = compile(source).extract(df, "url", on_error="drop")
    return got.select("page_id", F.explode("value").alias("p")).select("page_id", F.col("p.k").alias("k"), F.col("p.v").alias("v"))


_add("url_params", _url_params, r"""select page_id, split_part(p, '=', 1) k, split_part(p, '=', 2) v from (select page_id, unnest(string_split(regexp_extract(url, '\?([A-Za-z0-9]+=[A-Za-z0-9]*(&[A-Za-z0-9]+=[A-Za-z0-9]*)*)', 1), '&')) p from pages where regexp_matches(url, '\?([A-Za-z0-9]+=[A-Za-z0-9]*(&[A-Za-z0-9]+=[A-Za-z0-9]*)*)'))""")


def _html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    source = """link = '<li><a href="' h:(ANY UNTILBEFORE '"') '">' ANY UNTIL '</a></li>' AS h
        TEXT = ANY UNTIL '<nav><ul>' 1 TO n link '</ul>' ANY UNTILBEFORE EOF AS link"""
    got = compile(source).extract(df, "html", on_error="drop")
    return got.select("page_id", F.explode("value").alias("href"))


_add("html_links", _html_links, "select page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href=\"([^\"]*)', 1)) href from pages")


# ---- relational forms of template operators


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    got = compile("TEXT = 1 TO n WORD SPLITBY ' '").extract(df, "p_name", on_error="drop")
    return got.select("p_partkey", F.posexplode("value").alias("pos", "word"))


_LETTERS = "w = k:LETTER r:(0 TO n LETTER)\nTEXT = 1 TO n w SPLITBY ' ' AS { k: %s FOR w }"


def _by_letter(collect: bool) -> Run:
    """Words of a name by their first letter: all with LISTOF, or the last, as a repeated key keeps the later value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
        got = compile(_LETTERS % ("LISTOF r" if collect else "r")).extract(df, "p_name", on_error="drop")
        return got.select("p_partkey", F.explode("value").alias("letter", "own")).select("p_partkey", "letter", (F.array_join("own", ",") if collect else F.col("own")).alias("words"))

    return run


_BY_LETTER = "select p_partkey, substr(w, 1, 1) letter, %s words from (select p_partkey, unnest(range(1, len(l) + 1)) pos, unnest(l) w from (select p_partkey, string_split(p_name, ' ') l from part)) group by 1, 2"


def _type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "props")
    got = compile("TEXT = '{\"k\": ' k:INT '}' WHERE NUM(k) > 5 AS { 'k': NUM(k) }").extract(df, "props", on_error="drop")
    return got.groupBy("event_type").agg(F.sum("value.k").alias("total"), F.count("*").alias("n"), F.max("value.k").alias("most"))


_add("listof_words", _by_letter(True), _BY_LETTER % "string_agg(substr(w, 2), ',' order by pos)")
_add("last_wins", _by_letter(False), _BY_LETTER % "arg_max(substr(w, 2), pos)")
_add("type_totals", _type_totals, "select event_type, cast(sum(k) as bigint) total, count(*) n, max(k) most from (select event_type, cast(json_extract(props, '$.k') as bigint) k from events) where k > 5 group by 1")


def _word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


_add("word_counts", _word_counts, "select word, count(*) n, count(distinct p_partkey) parts from (select p_partkey, unnest(string_split(p_name, ' ')) word from part) group by 1")


def _zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP of a header and a row, in the kernel (keys depend on data)."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    source = "TEXT = 1 TO 2 w:WORD SPLITBY ' ' AS ZIP(['a', 'b', 'c'], w)"
    got = compile(source).extract(df, "p_name", on_error="drop")
    return got.select("p_partkey", *(F.col("value")[k].alias(k) for k in "abc"))


_add("zip_rows", _zip_rows, "select p_partkey, l[1] a, l[2] b, cast(null as varchar) c from (select p_partkey, string_split(p_name, ' ') l from part) where len(l) <= 2")


def _merge_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    source = "left = k:WORD AS { 'kind': k, 'id': 'none' }\nright = i:INT AS { 'id': i }\nTEXT = left '#' right AS { left, right }"
    got = compile(source).extract(df, "c_name", on_error="drop", engine="kernel")
    return got.select("c_custkey", F.col("value.kind").alias("kind"), F.col("value.id").alias("id"))


_add("merge_objects", _merge_objects, "select c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#', 1) kind, regexp_extract(c_name, '#([0-9]+)$', 1) id from customer")


def _json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    return compile("TEXT = name:WORD '_' id:INT AS { name: NUM(id), 'list': [1, true, null, id] }").extract(df, "n_name", mode="json", on_error="drop").select("n_nationkey", "value")


_add("json_text", _json_text, "select n_nationkey, '{\"NATION\":' || cast(regexp_extract(n_name, '([0-9]+)$', 1) as bigint) || ',\"list\":[1,true,null,\"' || regexp_extract(n_name, '([0-9]+)$', 1) || '\"]}' as value from nation")


def _json_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    got = compile("TEXT = name:WORD '_' id:INT AS { name: NUM(id) }").extract(df, "n_name", mode="variant", on_error="drop")
    return got.select("n_nationkey", F.try_variant_get("value", "$.NATION", "bigint").alias("id"))


_add("json_variant", _json_variant, "select n_nationkey, cast(regexp_extract(n_name, '([0-9]+)$', 1) as bigint) id from nation")


# ---- lines


def _conv_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role")
    got = compile("TEXT = r:('user' OR 'assistant' OR 'system') AS { 'r': UPPER(r) }").extract(df, "role", on_error="drop")
    return got.groupBy(F.col("value.r").alias("role")).agg(F.count("*").alias("n"))


_add("conv_roles", _conv_roles, "select upper(role) as role, count(*) n from conversations where role in ('user', 'assistant', 'system') group by 1")


def _line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one line among other lines, without the kernel: lines that hold a single sentence."""
    df = text_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "line", "value")
    source = "rec = first:WORD ' ' rest:(ANY UNTILBEFORE NL) NL AS { 'first': LOWER(first), 'rest': rest }\nTEXT = 0 TO n rec SKIPPING (LINE NL)"
    got = compile(source).lines(df)
    return got.select("doc_id", F.col("line").cast("bigint").alias("line"), F.col("record.first").alias("first"), F.length("record.rest").cast("bigint").alias("rest_chars"))


_add("line_records", _line_records, r"""with l as (select doc_id, unnest(range(1, len(x) + 1)) line, unnest(x) v from (select doc_id, string_split_regex(text, '\r\n|\n|\r') x from documents))
    select doc_id, line, lower(regexp_extract(v, '^(\p{L}+) ', 1)) as first, cast(length(v) - length(regexp_extract(v, '^\p{L}+ ')) as bigint) rest_chars from l where regexp_matches(v, '^\p{L}+ ')""")


def _row_of_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line with a word, by ROW; a line whose WHERE fails has another reading, as any line."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = compile("hit = r:ROW t:LINE WHERE t CONTAINS 'icense' AS r\nTEXT = 1 TO n (h:hit OR LINE) SPLITBY NL AS h").extract(df, "text", on_error="drop", check_ambiguity=False)
    return got.where(F.size("value") > 0).select("doc_id", F.col("value")[0].cast("bigint").alias("row"))


_add("row_of_match", _row_of_match, r"select doc_id, cast(list_position(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: contains(x, 'icense')), true) as bigint) as row from documents where contains(text, 'icense')")


# ---- kernel only: recursion, ambiguity, strictness, failures


def _row_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    got = compile("TEXT = WORD '#' r:ROW c:COL INT").extract(df, "c_name", on_error="drop")
    return got.select("c_custkey", F.col("value.r").alias("r"), F.col("value.c").alias("c"))


_add("row_col", _row_col, "select c_custkey, cast(1 as bigint) r, cast(strpos(c_name, '#') + 1 as bigint) c from customer")


def _recursion_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested lists of a generated text: as deep as the key's last digit."""
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat(F.expr("repeat('(', n_nationkey % 10 + 1)"), F.lit("x"), F.expr("repeat(')', n_nationkey % 10 + 1)")).alias("text"))
    got = compile("TEXT = list\nlist = '(' (list OR w:WORD) ')'").extract(df, mode="json")
    return got.select("n_nationkey", (F.length("value") - F.length(F.regexp_replace("value", "list", "lis"))).cast("bigint").alias("depth"))


_add("recursion_depth", _recursion_depth, "select n_nationkey, cast(n_nationkey % 10 as bigint) depth from nation")


def _ambiguity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    got = compile("TEXT = 'NATION_' 1 TO n a:DIGIT 0 TO n b:DIGIT").extract(df, "n_name", diagnostics=True, on_error="null")
    return got.select("n_nationkey", F.size("value_ambiguities").cast("bigint").alias("n"), F.col("value_complete").alias("complete"))


_add("ambiguity_count", _ambiguity_count, "select n_nationkey, cast(case when length(n_name) > 8 then 1 else 0 end as bigint) n, true complete from nation")


def _strict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    got = compile("STRICT TEXT = 'NATION_' 1 TO n a:DIGIT 0 TO n b:DIGIT").extract(df, "n_name", on_error="null")
    return got.select("n_nationkey", F.col("value_error.code").alias("code"))


_add("strict_errors", _strict_errors, "select n_nationkey, case when length(n_name) > 8 then 'loom::input::ambiguous' end code from nation")


def _no_parse_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    got = compile("TEXT = WORD '#' INT '!'").extract(df, "c_name", on_error="null", engine="kernel")
    return got.select("c_custkey", F.col("value_error.code").alias("code"), F.col("value_error.start").alias("at"))


_add("no_parse_pos", _no_parse_pos, "select c_custkey, 'loom::input::no_parse' code, cast(length(c_name) - 1 as bigint) as at from customer")


def _repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    got = compile("TEXT = 1 TO n w:WORD SPLITBY ' ' AS { 'k': x FOR x IN w }").extract(df, "p_name", on_error="drop", diagnostics=True)
    return got.select("p_partkey", F.col("value")["k"].alias("k"), F.size("value_repeated_keys").cast("bigint").alias("reports"))


_add("repeated_keys", _repeated_keys, "select p_partkey, l[-1] k, cast(case when len(l) > 1 then 1 else 0 end as bigint) reports from (select p_partkey, string_split(p_name, ' ') l from part)")


# ---- tokens, paths, conditions and limits on made texts


def _token_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HEX, BIN, IPV6, TAB and EOF, a path, and a label on a label."""
    text = F.concat(F.bin("c_custkey"), F.lit(" "), F.lower(F.hex("c_custkey")), F.lit("\t2001:db8::"), F.lower(F.hex(F.col("c_custkey") % 65536)), F.lit("/"), F.col("c_custkey").cast("string"))
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.alias("text"))
    source = "at = a:IPV6 '/' k:(n:INT)\nTEXT = b:BIN ' ' h:HEX TAB at e:EOF AS { 'b': b, 'h': h, 'a': at.a, 'n': NUM(at.k.n), 'e': e }"
    got = compile(source).extract(df, on_error="drop")
    return got.select("c_custkey", *(F.col("value")[c].alias(c) for c in "bhane"))


_add("token_mix", _token_mix, "select c_custkey, bin(c_custkey) b, lower(hex(c_custkey)) h, '2001:db8::' || lower(hex(c_custkey % 65536)) a, cast(c_custkey as bigint) n, '' e from customer")


def _token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for HEX, BIN and TAB."""
    text = F.concat(F.lit("id x"), F.bin("s_suppkey"), F.lit("\t"), F.lower(F.hex("s_suppkey")), F.lit("\tg1"))
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", text.alias("text"))
    out = df
    for name, kind in (("h", "HEX"), ("b", "BIN"), ("t", "TAB")):
        out = compile(f"TEXT = 0 TO n {kind} SKIPPING ANY").extract(out, "text", name, on_error="drop")
    return out.select("s_suppkey", F.array_join("h", ",").alias("h"), F.array_join("b", ",").alias("b"), F.size("t").cast("bigint").alias("t"))


_add("token_search", _token_search, """select s_suppkey, 'd,' || bin(s_suppkey) || ',' || lower(hex(s_suppkey)) || ',1' h,
    bin(s_suppkey) || case when regexp_matches(lower(hex(s_suppkey)), '^[01]+$') then ',' || lower(hex(s_suppkey)) when regexp_matches(lower(hex(s_suppkey)), '[^01][01]+$') then ',' || regexp_extract(lower(hex(s_suppkey)), '[01]+$') else '' end || ',1' b,
    cast(2 as bigint) t from supplier""")
_fields("where_truthy", "part", "p_partkey", "p_name", "TEXT = a:WORD 0 TO 1 (' ' b:WORD) 0 TO 1 (' ' c:WORD) WHERE c", ["a", "b", "c"], "select p_partkey, l[1] a, case when len(l) = 3 then l[2] end b, l[-1] c from (select p_partkey, string_split(p_name, ' ') l from part) where len(l) in (2, 3)")
_fields("where_not_equal", "orders", "o_orderkey", "o_orderpriority", "TEXT = n:INT '-' p:(1 TO n ANY) WHERE p != 'LOW' AND n != 2", ["n", "p"], "select o_orderkey, split_part(o_orderpriority, '-', 1) n, regexp_extract(o_orderpriority, '-(.*)$', 1) p from orders where o_orderpriority not like '%-LOW' and o_orderpriority not like '2-%'")
_fields("next_reading", "customer", "c_custkey", "c_name", "TEXT = WORD '#' a:(1 TO n DIGIT) b:(1 TO n DIGIT) WHERE b = '1' OR b = '77' AS { 'a': a, 'b': b }", ["a", "b"], "select c_custkey, d[:-len(b)-1] a, b from (select c_custkey, d, case when d like '%77' and length(d) > 2 then '77' when d like '%1' and length(d) > 1 then '1' end b from (select c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) d from customer)) where b is not null")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """max_depth, max_steps, and a value that cannot be computed, as error codes."""
    nested = F.expr("concat(repeat('(', 1 + s_suppkey % 20), repeat(')', 1 + s_suppkey % 20))")
    long = F.expr("repeat('7', case when s_suppkey % 2 = 0 then 3 else 3000 end)")
    word = F.when(F.col("s_suppkey") % 3 == 0, "seven").otherwise("7")
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", nested.alias("nested"), long.alias("long"), word.alias("word"))
    out = compile("TEXT = l\nl = '(' 0 TO 1 l ')'").extract(df, "nested", "d", mode="json", on_error="null", max_depth=10)
    out = compile("TEXT = 1 TO n a:DIGIT 1 TO n b:DIGIT").extract(out, "long", "s", on_error="null", max_steps=1000)
    out = compile("TEXT = x:(1 TO n ANY) AS NUM(x)").extract(out, "word", "e", on_error="null", engine="kernel")
    return out.select("s_suppkey", *(F.col(f"{c}_error.code").alias(c) for c in ("d", "s", "e")))


_add("limits", _limits, """select s_suppkey, case when s_suppkey % 20 + 2 > 10 then 'loom::input::too_deep' end d, case when s_suppkey % 2 <> 0 then 'loom::input::too_expensive' end s,
    case when s_suppkey % 3 = 0 then 'loom::eval::error' end e from supplier""")


def _ambiguity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reported: not what LAZY settles or what leaves the output alone; readings that fail; the advice; and a budget of its own."""
    out = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    number = "TEXT = 'NATION_' (a:INT OR b:(1 TO n DIGIT))"
    kinds = {
        "lazy": ("TEXT = 'NATION_' 1 TO n LAZY a:DIGIT 0 TO n b:DIGIT", {}), "same": ("TEXT = 'NATION_' 1 TO n a:DIGIT 0 TO n b:DIGIT AS 'same'", {}),
        "failing": (f"{number} AS COUNT(b)", {}), "branch": (number, {}), "budget": (number, {"ambiguity_steps": 1}),
    }
    for name, (source, how) in kinds.items():
        out = compile(source).extract(out, "n_name", name, diagnostics=True, on_error="null", **how)
    return out.select(
        "n_nationkey", F.size("lazy_ambiguities").alias("n_lazy"), F.size("same_ambiguities").alias("n_same"), F.col("failing").alias("chosen"), F.col("failing_ambiguities")[0]["failure"].isNotNull().alias("fails"),
        F.col("branch_ambiguities")[0]["advice"].alias("advice"), F.col("budget_complete").alias("complete"), F.get_json_object("budget", "$.a").alias("value"),
    )


_add("ambiguity_kinds", _ambiguity_kinds, "select n_nationkey, cast(0 as integer) n_lazy, cast(0 as integer) n_same, cast(0 as bigint) chosen, true fails, 'branch_order' advice, false complete, regexp_extract(n_name, '([0-9]+)$', 1) as value from nation")


def _sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.sql import register

    register(spark, "textloom_extract")
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("textloom_nation")
    return spark.sql("SELECT n.n_nationkey, e.value FROM textloom_nation n, LATERAL textloom_extract(n.n_name, 'TEXT = WORD \"_\" id:INT AS NUM(id)') e")


_add("sql_function", _sql_function, "select n_nationkey, cast(cast(regexp_extract(n_name, '([0-9]+)$', 1) as bigint) as varchar) as value from nation")
