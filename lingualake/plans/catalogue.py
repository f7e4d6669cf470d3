"""Queries over the test tables: each builds files from rows, runs the sources and operators on them, and has its SQL.

The SQL derives what is expected from the rows themselves; it parses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compiling, json_compiling, syncing, translating, validating
from ..sources import json_files, markdown, office, plaintext, po, subtitles, xml_files, yaml_files
from ..streaming.parsing import parse_stream
from . import json_plans, markdown_plans, office_plans, other_plans, po_plans, xml_plans, yaml_plans  # noqa: F401  they register their queries
from .building import QUERIES, SQL, XML, brand_files, customers, documents, file_rows, filled, part_files, parts, query, suppliers, table
from ..storing import new_folder

_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, trim(line, ' ' || chr(9) || chr(13)) AS text FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '')"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(ord AS INT) AS ord, CAST(ord AS VARCHAR) AS key, text, md5(ord || ':') AS string_hash, md5(ord || ':') || '_tr' AS placeholder FROM u")
def q01_plaintext_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plaintext.units(documents(spark, sf_dir))


@query(f"WITH {_LINES} SELECT doc_id, md5('  ' || string_agg(md5(ord || ':') || '_tr', chr(13) || chr(10) || ' ' || chr(13) || chr(10) ORDER BY ord) || chr(9)) AS template FROM u GROUP BY doc_id")
def q02_plaintext_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units stand between blank lines and white space, in DOS files."""
    units = plaintext.units(documents(spark, sf_dir))
    files = file_rows(units, F.col("doc_id"), "ord", F.col("text"), "\r\n \r\n", "  ", "\t")
    return compiling.plaintext_template(plaintext.segments(files)).select("doc_id", F.md5(F.col("content").cast("binary")).alias("template"))


@query("SELECT doc_id, md5(text) AS content FROM documents")
def q03_plaintext_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = plaintext.segments(documents(spark, sf_dir))
    same = segments.filter("text is not null").select("doc_id", "placeholder", "ord", "text")
    return compiling.compile_plaintext(segments, same).select("doc_id", F.md5(F.col("content").cast("binary")).alias("content"))


@query("SELECT p_partkey, md5(p_name || ':' || p_brand) AS string_hash, md5(p_name || ':' || p_brand) || CASE WHEN p_size % 2 = 0 THEN '_pl' ELSE '_tr' END AS placeholder FROM part")
def q04_string_hash_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = T.string_hash(F.col("p_name"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", hashed.alias("string_hash"), T.placeholder(hashed, F.col("p_size") % 2 == 0).alias("placeholder"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND contains(text, chr(10)) THEN 'DOS' ELSE 'UNIX' END AS newline, md5(text) AS unix, md5(CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END) AS again, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents")
def q05_newline_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("doc_id") % 2 == 0, F.replace("content", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("content"))
    rows = documents(spark, sf_dir).withColumn("content", content).select("doc_id", T.newline_type(F.col("content")).alias("newline"), T.to_unix(F.col("content")).alias("text"))
    md5 = lambda c: F.md5(c.cast("binary"))
    return rows.select("doc_id", "newline", md5(F.col("text")).alias("unix"), md5(T.with_newlines(F.col("text"), F.col("newline"))).alias("again"), T.line_number(F.col("text"), F.length("text")).cast("bigint").alias("lines"))


def _srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.col("turn") + 1)
    return file_rows(rows, F.col("conv_id"), "turn", filled("<<n>>\n0:0:<<turn>>,5 --> 00:01:<<turn>>,25\n<<text>>", n="n", turn="turn", text="text"), "\n\n")


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS VARCHAR) AS key, CAST(turn + 1 AS INT) AS ord, text, '00:00:0' || turn || '.500,00:01:0' || turn || '.250' AS occurrences, md5((turn + 1) || ':') AS string_hash FROM conversations")
def q06_srt_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.srt_units(_srt(spark, sf_dir)).drop("seg", "placeholder")


@query("SELECT conv_id AS doc_id, md5(string_agg(CASE WHEN role = 'system' THEN '' ELSE (turn + 1) || chr(10) || '0:0:' || turn || ',5 --> 00:01:' || turn || ',25' || chr(10) || 'el:' || text END, chr(10) || chr(10) ORDER BY turn)) AS content FROM conversations GROUP BY conv_id")
def q07_srt_compile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _srt(spark, sf_dir)
    units = subtitles.srt_units(files)
    roles = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("ord"), "role")
    told = units.join(roles, ["doc_id", "ord"]).filter("role <> 'system'").select("doc_id", "placeholder", "ord", F.concat(F.lit("el:"), "text").alias("text"))
    done = compiling.compile_sections(subtitles.template_parts(files, units), told)
    return done.select("doc_id", F.md5(F.col("content").cast("binary")).alias("content"))


def _vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled("cue <<turn>>\n00:<<turn>>.5 --> 1:02:<<turn>>.250\n<<text>>", turn="turn", text="text")
    return file_rows(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", part, "\n\n", "WEBVTT\n\nNOTE a --> sign needs more\n\n")


@query("SELECT conv_id AS doc_id, '00:' || turn || '.5 --> 1:02:' || turn || '.250' AS key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ord, text, '00:00:0' || turn || '.500,01:02:0' || turn || '.250' AS occurrences FROM conversations")
def q08_vtt_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.vtt_units(_vtt(spark, sf_dir)).select("doc_id", "key", "ord", "text", "occurrences")


@query("SELECT conv_id AS doc_id, md5('WEBVTT' || chr(10) || chr(10) || 'NOTE a --> sign needs more' || chr(10) || chr(10) || string_agg('cue ' || turn || chr(10) || '00:' || turn || '.5 --> 1:02:' || turn || '.250' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS content FROM conversations GROUP BY conv_id")
def q09_vtt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _vtt(spark, sf_dir)
    units = subtitles.vtt_units(files)
    done = compiling.compile_sections(subtitles.template_parts(files, units), units.select("doc_id", "placeholder", "ord", "text"))
    return done.select("doc_id", F.md5(F.col("content").cast("binary")).alias("content"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    return file_rows(rows, F.col("c_nationkey"), "c_custkey", filled('"<<k>>.x": "<<v>>"', k="c_name", v="c_mktsegment"), ", ", "{", ', "blank": " ", "n": 1.5}')


@query("SELECT c_nationkey AS doc_id, c_name || '\\.x' AS key, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS ord, c_mktsegment AS value, md5(c_name || '\\.x:') || '_tr' AS placeholder FROM customers")
def q10_json_units_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_files.key_value_units(_customers(spark, sf_dir)).select("doc_id", "key", "ord", "value", "placeholder")


@query("SELECT o_orderkey AS doc_id, 'status' AS key, o_orderstatus AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey, 'items..' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1) || '...flag', l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def q11_json_units_nested_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    items = file_rows(lines, F.col("l_orderkey"), "o", filled('{"flag": "<<f>>", "n": <<n>>}', f="l_returnflag", n="l_linenumber"), ", ")
    files = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("doc_id")).select("doc_id", filled('{"status": "<<s>>", "items": [<<i>>]}', s="o_orderstatus", i="content").alias("content"))
    return json_files.key_value_units(files).select("doc_id", "key", "value")


@query(r"SELECT event_id AS doc_id, 'dict' AS kind, NULL AS path, '{' AS value, 1 AS line FROM events UNION ALL SELECT event_id, 'scalar', 'k', regexp_extract(props, ':\s*([^}\s]+)', 1), 1 FROM events")
def q12_json_props_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("content"))
    return json_files.nodes(files).select("doc_id", "kind", "path", "value", "line")


@query("""WITH x AS (SELECT p_brand AS doc_id, p_partkey AS k, CASE p_partkey % 3
        WHEN 0 THEN '"k' || p_partkey || '": {"a": "x:' || p_name || ', , [, {", "b": ["x:' || p_type || '"], "c": 1}'
        WHEN 1 THEN '"k' || p_partkey || '": {"a": "x:' || p_name || ', , [, {", "c": 1}'
        ELSE '"k' || p_partkey || '": {"c": 1}' END AS part FROM part)
    SELECT doc_id, '{"l": ["x:" , 2], "e": {}, ' || string_agg(part, ', ' ORDER BY k) || '}' AS content FROM x GROUP BY doc_id""")
def q13_json_compile_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts hold commas and brackets; emptied lists and objects go at seven levels."""
    files = file_rows(table(spark, sf_dir, "part"), F.col("p_brand"), "p_partkey", filled('"k<<k>>": {"a": "<<n>>, , [, {", "b": ["<<t>>", {"z": [[{"y": {"x": "gone"}}]]}], "c": 1}', k="p_partkey", n="p_name", t="p_type"), ", ", '{"l": ["gone", "" , 2, "gone"], "e": {}, "f": {"g": ["gone"]}, ', "}")
    files = files.withColumn("content", F.replace("content", F.lit('"gone", "" , 2'), F.lit('"gone", "." , 2')))
    units = json_files.key_value_units(files)
    number = F.regexp_extract("key", r"^k(\d+)", 1).try_cast("bigint") % 3
    told = units.filter("value <> 'gone'").filter(number.isNull() | (number == 0) | ((number == 1) & F.col("key").endswith(".a")))
    said = told.select("doc_id", "placeholder", "ord", "pluralized", F.create_map(F.lit(5), F.when(F.col("value") == ".", "x:").otherwise(F.concat(F.lit("x:"), "value"))).alias("strings"))
    return json_compiling.compile_members(compiling.compile_slots(files, json_files.slots(units)), said, clean=True)


@query("SELECT p_brand AS doc_id, md5(p_partkey || ':') || '_tr' AS placeholder, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'keep' WHEN p_partkey % 2 = 0 THEN 'remove' ELSE 'add' END AS action FROM parts WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def q14_sync_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select(F.col("p_brand").alias("doc_id"), "p_partkey", T.placeholder(T.string_hash(F.col("p_partkey").cast("string"))).alias("placeholder"))
    return syncing.sync_set(rows.filter("p_partkey % 2 = 0"), rows.filter("p_partkey % 3 = 0"))


@query("""WITH s AS (SELECT p_brand AS doc_id, p_partkey AS k FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0)
    SELECT doc_id, CAST(row_number() OVER w - 1 AS INT) AS place, md5(k || ':') || '_tr' AS placeholder, CASE WHEN bool_or(k % 2 = 1) OVER w THEN 'add' ELSE 'keep' END AS action FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def q15_sync_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("seg"), F.col("p_partkey").alias("ord"), T.placeholder(T.string_hash(F.col("p_partkey").cast("string"))).alias("placeholder"))
    return syncing.sync_ordered(rows.filter("seg % 2 = 0"), rows.filter("ord % 2 = 0 or ord % 3 = 0"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace('"' || text || chr(9), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't')) AS escaped, md5('"' || text || chr(9)) AS again FROM documents""")
def q16_json_escape_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = T.escape_json(F.concat(F.lit('"'), "content", F.lit("\t")))
    return documents(spark, sf_dir).select("doc_id", F.md5(escaped.cast("binary")).alias("escaped"), F.md5(T.unescape_json(escaped).cast("binary")).alias("again"))


_ICU = '"k<<k>>": "{n, plural, one {one <<name>>} other {<<size>> {x} <<type>>}}", "p<<k>>": "{n, plural, =1 {<<name>>} other {y}}"'


@query("""SELECT p_brand AS doc_id, 'k' || p_partkey AS key, true AS pluralized, 'one ' || p_name AS one, p_size || ' {x} ' || p_type AS other FROM parts
    UNION ALL SELECT p_brand, 'p' || p_partkey, false, NULL, '{n, plural, =1 {' || p_name || '} other {y}}' FROM parts""")
def q17_icu_plural_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = json_files.key_value_units(part_files(spark, sf_dir, _ICU))
    return units.select("doc_id", "key", "pluralized", F.try_element_at("strings", F.lit(1)).alias("one"), F.try_element_at("strings", F.lit(5)).alias("other"))


@query("SELECT p_partkey, 'other {x} one {' || p_name || '} few {' || p_type || '}' AS text FROM part")
def q18_icu_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = F.create_map(F.lit(5), F.lit("x"), F.lit(1), F.col("p_name"), F.lit(3), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", compiling.serialize_plural(strings).alias("text"))


@query("""SELECT p_brand AS doc_id, 'k' || p_partkey AS key, p_type AS context, 'about ' || p_size AS developer_comment, p_name AS value, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS ord FROM parts WHERE p_size % 5 <> 0""")
def q19_arb_units_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 5 == 0, "image").otherwise("text")
    rows = parts(spark, sf_dir)
    part = filled('"k<<k>>": "<<name>>", "@k<<k>>": {"type": "<<kind>>", "context": "<<type>>", "description": "about <<size>>"}', k="p_partkey", name="p_name", kind=kind, type="p_type", size="p_size")
    return json_files.arb_units(file_rows(rows, F.col("p_brand"), "p_partkey", part, ", ", '{"@@locale": "en", ', "}")).select("doc_id", "key", "context", "developer_comment", "value", "ord")


@query("SELECT p_brand AS doc_id, 'k' || p_partkey AS key, p_type AS context, 'c' || p_size AS developer_comment, p_size AS character_limit, p_name AS value FROM parts")
def q20_structured_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_files(spark, sf_dir, '"k<<k>>": {"string": "<<name>>", "context": "<<type>>", "developer_comment": "c<<size>>", "character_limit": <<size>>}')
    return json_files.structured_units(files).select("doc_id", "key", "context", "developer_comment", "character_limit", "value")


@query("SELECT s_nationkey AS doc_id, 's' || s_suppkey || '.message' AS key, s_name AS value, 'd' || s_suppkey AS developer_comment FROM supplier")
def q22_chrome_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled('"s<<k>>": {"message": "<<n>>", "description": "d<<k>>"}', k="s_suppkey", n="s_name")
    return json_files.chrome_units(file_rows(table(spark, sf_dir, "supplier"), F.col("s_nationkey"), "s_suppkey", part, ",\n", "{", "}")).select("doc_id", "key", "value", "developer_comment")


@query("SELECT s_nationkey AS doc_id, 's.' || s_suppkey AS key, s_name AS value, 'd' || s_suppkey AS developer_comment FROM suppliers")
def q23_chrome_v3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled('"s.<<k>>": {"message": "<<n>>", "description": "d<<k>>"}, "t<<k>>": "no", "u<<k>>": {"message": 1}', k="s_suppkey", n="s_name")
    return json_files.chrome_v3_units(file_rows(suppliers(spark, sf_dir), F.col("s_nationkey"), "s_suppkey", part, ", ", "{", "}")).select("doc_id", "key", "value", "developer_comment")


@query("SELECT p_brand AS doc_id, 'k' || p_partkey AS key, p_type AS context, p_name AS text, CASE WHEN p_size % 2 = 0 THEN 'about ' || p_size ELSE '' END AS developer_comment, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS ord FROM part")
def q24_android_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = F.when(F.col("p_size") % 2 == 0, filled("<!-- about <<s>> -->\n", s="p_size")).otherwise("")
    part = filled('<<c>><string name="k<<k>>" product="<<t>>"><<n>></string>\n<string name="x<<k>>" translatable="false"><<n>></string>', c=about, k="p_partkey", t="p_type", n="p_name")
    files = file_rows(table(spark, sf_dir, "part"), F.col("p_brand"), "p_partkey", part, *XML)
    return xml_files.android_units(files).select("doc_id", "key", "context", F.element_at("strings", 5).alias("text"), "developer_comment", "ord")


@query("SELECT n_regionkey AS doc_id, 'n' || n_nationkey || '[' || i || ']' AS key, CASE i WHEN 0 THEN n_name ELSE n_name || ' two' END AS text FROM nation, (VALUES (0), (2)) v(i)")
def q25_android_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled('<string-array name="n<<k>>"><item><<n>></item><item> </item><item><<n>> two</item></string-array>', k="n_nationkey", n="n_name")
    units = xml_files.android_units(file_rows(table(spark, sf_dir, "nation"), F.col("n_regionkey"), "n_nationkey", part, *XML))
    keys = F.replace("key", F.lit("\\["), F.lit("["))
    return units.select("doc_id", keys.alias("key"), F.element_at("strings", 5).alias("text"))


def _plurals(rows: DataFrame) -> DataFrame:
    one = F.when(F.col("p_size") % 10 == 0, " ").otherwise(F.col("p_name"))
    part = filled('<plurals name="k<<k>>"><item quantity="one"><<one>></item><item quantity="other"><<n>>s</item></plurals>', k="p_partkey", one=one, n="p_name")
    return file_rows(rows, F.col("p_brand"), "p_partkey", part, *XML)


@query("SELECT p_brand AS doc_id, 'k' || p_partkey AS key, CASE WHEN p_size % 10 = 0 THEN ' ' ELSE p_name END AS one, p_name || 's' AS other, md5('k' || p_partkey || ':') || '_pl' AS placeholder FROM part")
def q26_android_plurals(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = xml_files.android_units(_plurals(table(spark, sf_dir, "part")))
    return units.select("doc_id", "key", F.element_at("strings", 1).alias("one"), F.element_at("strings", 5).alias("other"), "placeholder")


@query("""SELECT p_partkey, chr(92) || '@' || p_name || chr(92) || '" <b id=' || chr(92) || '"x' || chr(92) || '">' || p_type || chr(92) || '''</b> <x y=' || chr(92) || '"z' || chr(92) || '">' AS escaped, '@' || p_name || '" <b id="x">' || p_type || '''</b> <x y="z">' AS again FROM part""")
def q28_android_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = T.escape_android(F.concat(F.lit("@"), "p_name", F.lit('" <b id="x">'), "p_type", F.lit("'</b> <x y=\"z\">")))
    return table(spark, sf_dir, "part").select("p_partkey", escaped.alias("escaped"), T.unescape_android(escaped).alias("again"))


@query("SELECT p_brand AS doc_id, 'k' || p_partkey AS key, p_name AS one, p_name || 's' AS other FROM parts WHERE p_size % 10 <> 0")
def q29_beta_android_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = xml_files.android_units(_plurals(parts(spark, sf_dir)), beta=True)
    return units.select("doc_id", "key", F.element_at("strings", 1).alias("one"), F.element_at("strings", 5).alias("other"))


@query("SELECT p_brand AS doc_id, 'k' || p_partkey AS key, 'n' AS context, 'You have ' || p_name || '.' AS one, 'You have ' || p_size || ' ' || p_type || '.' AS other FROM part")
def q30_stringsdict_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = "<key>k<<k>></key><dict><key>NSStringLocalizedFormatKey</key><string>You have %#@n@.</string><key>n</key><dict><key>NSStringFormatSpecTypeKey</key><string>NSStringPluralRuleType</string><key>one</key><string><<name>></string><key>other</key><string><<size>> <<type>></string></dict></dict>"
    units = xml_files.stringsdict_units(brand_files(spark, sf_dir, part, "\n", '<plist version="1.0">\n<dict>\n', "\n</dict>\n</plist>\n"))
    return units.select("doc_id", "key", "context", F.element_at("strings", 1).alias("one"), F.element_at("strings", 5).alias("other"))


@query("SELECT n_regionkey AS doc_id, 'n' || n_nationkey || s AS key, 'r' || n_regionkey AS context, n_name || t AS text FROM nation, (VALUES ('', ''), ('::v', ' variant')) v(s, t)")
def q31_custom_xml_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled('<string key="n<<k>>"><base><<n>></base><variant context="v"><<n>> variant</variant><variant context="w"> </variant></string>', k="n_nationkey", n="n_name")
    sections = file_rows(table(spark, sf_dir, "nation"), F.col("n_regionkey"), "n_nationkey", part, "")
    whole = sections.select("doc_id", filled('<strings><section name="r<<r>>"><<c>></section></strings>', r="doc_id", c="content").alias("content"))
    return xml_files.custom_units(whole).select("doc_id", "key", "context", F.element_at("strings", 5).alias("text"))


_HEADER = 'msgid ""\nmsgstr ""\n"Content-Type: text/plain\\n"\n\n'


@query("""SELECT c_nationkey AS doc_id, c_name AS key, c_mktsegment AS context, CASE WHEN c_custkey % 2 = 0 THEN 'el:' || c_name ELSE '' END AS text, 'PO' AS file_type, c_custkey % 7 = 0 AS fuzzy, 'src/a.c:' || c_custkey AS occurrences, 'note' || chr(10) AS developer_comment FROM customers c
    WHERE c_nationkey IN (SELECT c_nationkey FROM customers WHERE c_custkey % 2 = 0)
    UNION ALL SELECT c_nationkey, c_name, c_mktsegment, c_name, 'POT', c_custkey % 7 = 0, 'src/a.c:' || c_custkey, 'note' || chr(10) FROM customers WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customers WHERE c_custkey % 2 = 0)""")
def q32_po_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("el:"), "c_name")).otherwise("")
    flag = F.when(F.col("c_custkey") % 7 == 0, "#, fuzzy\n").otherwise("")
    part = filled('#. note\n#: src/a.c:<<k>>\n<<f>>msgctxt "<<x>>"\nmsgid ""\n"<<n>>"\nmsgstr "<<t>>"\n', k="c_custkey", f=flag, x="c_mktsegment", n="c_name", t=told)
    units = po.units(file_rows(customers(spark, sf_dir), F.col("c_nationkey"), "c_custkey", part, "\n", _HEADER))
    return units.select("doc_id", "key", "context", F.element_at("strings", 5).alias("text"), "file_type", "fuzzy", "occurrences", "developer_comment")


@query("SELECT c_nationkey AS doc_id, c_name || ':' || c_name || 's' AS key, c_name AS one, c_name || 's' AS other, md5(c_name || ':' || c_name || 's:') || '_pl' AS placeholder, 'POT' AS file_type FROM customers")
def q33_po_pot_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled('msgid "<<n>>"\nmsgid_plural "<<n>>s"\nmsgstr[0] ""\nmsgstr[1] ""\n', n="c_name")
    units = po.units(file_rows(customers(spark, sf_dir), F.col("c_nationkey"), "c_custkey", part, "\n", _HEADER))
    return units.select("doc_id", "key", F.element_at("strings", 0).alias("one"), F.element_at("strings", 1).alias("other"), "placeholder", "file_type")


@query("SELECT p_brand AS doc_id, p_name AS key, 'duplicate msgid' AS rule, count(*) - 1 AS places FROM part GROUP BY p_brand, p_name HAVING count(*) > 1")
def q34_po_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = brand_files(spark, sf_dir, 'msgid "<<name>>"\nmsgstr "<<k>>"\n', "\n", _HEADER, "")
    return po.problems(files).groupBy("doc_id", "key", "rule").agg(F.count("*").alias("places"))


@query("SELECT n_regionkey AS doc_id, 'r.' || replace(lower(n_name), '.', '<TX_DOT>') || '.name' AS key, n_name AS text, '' AS context FROM nation UNION ALL SELECT n_regionkey, 'r.' || lower(n_name) || '.list.[1]', n_name || ' b', 'tag' FROM nation")
def q36_yaml_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled("  <<l>>:\n    name: \"<<n>>\"\n    number: 5\n    flag: true\n    list:\n      - 1\n      - !tag '<<n>> b'", l=F.lower("n_name"), n="n_name")
    files = file_rows(table(spark, sf_dir, "nation"), F.col("n_regionkey"), "n_nationkey", part, "\n", "# top\nr:\n", "\n")
    return yaml_files.units(files).select("doc_id", "key", "text", "context")


@query("SELECT n_regionkey AS doc_id, 'en' AS language, 'n' || n_nationkey || '.count' AS key, true AS pluralized, 'one ' || n_name AS one, n_name || 's' AS other FROM nation UNION ALL SELECT n_regionkey, 'en', 'n' || n_nationkey || '.title', false, NULL, n_name FROM nation")
def q37_i18n_yaml_plurals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled('  n<<k>>:\n    count:\n      one: "one <<n>>"\n      other: "<<n>>s"\n    title: "<<n>>"', k="n_nationkey", n="n_name")
    units = yaml_files.i18n_units(file_rows(table(spark, sf_dir, "nation"), F.col("n_regionkey"), "n_nationkey", part, "\n", "en:\n", "\n"))
    return units.select("doc_id", "language", "key", "pluralized", F.try_element_at("strings", F.lit(1)).alias("one"), F.try_element_at("strings", F.lit(5)).alias("other"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        t AS (SELECT doc_id, i, 'x' || trim(regexp_replace(line, '[^a-zA-Z ]', '', 'g')) AS text FROM l)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS ord, text, CASE WHEN i % 2 = 0 THEN 'heading' ELSE 'paragraph' END AS kind FROM t""")
def q39_markdown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, their letters only, as paragraphs and headings."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    words = F.concat(F.lit("x"), F.trim(F.regexp_replace("line", "[^a-zA-Z ]", "")))
    files = file_rows(lines, F.col("doc_id"), "i", F.concat(F.when(F.col("i") % 2 == 1, "## ").otherwise(""), words), "\n\n")
    return markdown.units(files).select("doc_id", "ord", "text", "kind")


def _package(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return office.packages(rows.select("doc_id", F.col("place").cast("int").alias("place"), "part", "xml"))


def _docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled('<w:p><w:r><w:t>Turn <<t>> &amp;</w:t></w:r><w:r><w:t xml:space="preserve"> by <<r>></w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p>', t="turn", r="role")
    body = file_rows(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", part, "", '<?xml version="1.0"?><w:document><w:body>', "</w:body></w:document>")
    types = body.select("doc_id", F.lit(0).alias("place"), F.lit("[Content_Types].xml").alias("part"), F.lit("<Types/>").alias("xml"))
    return _package(spark, types.unionByName(body.select("doc_id", F.lit(1).alias("place"), F.lit("word/document.xml").alias("part"), F.col("content").alias("xml"))))


@query("SELECT conv_id AS doc_id, '<tx>Turn ' || turn || ' &</tx><tx> by ' || role || '</tx>' AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ord FROM conversations")
def q40_docx_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.docx_units(_docx(spark, sf_dir)).select("doc_id", "text", "ord")


@query("SELECT conv_id AS doc_id, 'Turn ' || turn || ': ' || text AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ord FROM conversations")
def q42_pptx_order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides in order of their numbers, with the whole texts."""
    rows = table(spark, sf_dir, "conversations")
    slide = rows.select(F.col("conv_id").alias("doc_id"), (100 - F.col("turn")).alias("place"), filled("ppt/slides/slide<<t>>.xml", t="turn").alias("part"), filled("<p:sld><p:sp><a:p><a:r><a:t>Turn <<t>>: <<x>></a:t></a:r></a:p></p:sp></p:sld>", t="turn", x=T.escape_xml(F.col("text"))).alias("xml"))
    return office.pptx_units(_package(spark, slide)).select("doc_id", "text", "ord")


@query("""WITH c AS (SELECT p_brand AS doc_id, p_size % 2 + 1 AS sheet, p_name AS text, p_partkey AS k FROM parts)
    SELECT doc_id, text, array_to_string(list_transform(list_sort(list(DISTINCT sheet)), lambda x: 'S' || x), ', ') AS developer_comment FROM c GROUP BY doc_id, text UNION ALL SELECT DISTINCT doc_id, 'S' || sheet, 'S' || sheet FROM c""")
def q43_xlsx_distinct_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).withColumn("sheet", F.col("p_size") % 2 + 1)
    indexed = rows.withColumn("idx", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_name")) - 1)
    distinct = indexed.select("p_brand", "idx", "p_name").distinct()
    shared = file_rows(distinct, F.col("p_brand"), "idx", filled("<si><t><<n>></t></si>", n="p_name"), "", "<sst>", "</sst>").select("doc_id", F.lit(0).alias("place"), F.lit("xl/sharedStrings.xml").alias("part"), F.col("content").alias("xml"))
    cells = file_rows(indexed, F.struct("p_brand", "sheet"), "p_partkey", filled('<c r="A<<k>>" t="s"><v><<i>></v></c><c r="B<<k>>"><v>7</v></c>', k="p_partkey", i="idx"), "", "<sheetData>", "</sheetData>")
    sheets = cells.select(F.col("doc_id.p_brand").alias("doc_id"), F.col("doc_id.sheet").alias("place"), filled("xl/worksheets/sheet<<s>>.xml", s=F.col("doc_id.sheet").cast("string")).alias("part"), F.col("content").alias("xml"))
    used = file_rows(sheets, F.col("doc_id"), "place", filled('<sheet name="S<<s>>"/>', s="place"), "", "<workbook>", "</workbook>").select("doc_id", F.lit(9).alias("place"), F.lit("xl/workbook.xml").alias("part"), F.col("content").alias("xml"))
    return office.xlsx_units(_package(spark, shared.unionByName(sheets).unionByName(used))).select("doc_id", "text", "developer_comment")


@query(f"WITH {_LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i % 2, i // 2) - 1 AS INT) AS ord, 'x' || replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || 'x' AS text FROM l")
def q44_idml_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines of documents in two stories, of which the map lists the even one last; marks, numbers and blanks alone are none."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)
    words = F.concat(F.lit("x"), T.escape_xml(F.col("line")), F.lit("x"))
    rows = lines.select(F.struct("doc_id", (F.col("i") % 2).alias("s")).alias("k"), "i", F.concat(F.lit("<Content> "), words, F.lit(" </Content><Content>12</Content><Content><?ACE 18?></Content>")).alias("c"))
    stories = file_rows(rows, F.col("k"), "i", F.col("c"), "", "<Story>", "</Story>").select("doc_id.doc_id", F.col("doc_id.s").alias("s"), "content")
    stories = stories.select("doc_id", F.lit(1).alias("place") + F.col("s"), filled("Stories/Story_u<<s>>.xml", s=F.col("s").cast("string")).alias("part"), F.col("content").alias("xml")).toDF("doc_id", "place", "part", "xml")
    design = stories.select("doc_id").distinct().select("doc_id", F.lit(0).alias("place"), F.lit("designmap.xml").alias("part"), F.lit('<Document StoryList="u0 u1"/>').alias("xml"))
    return office.idml_units(_package(spark, design.unionByName(stories))).select("doc_id", "text", "ord")


@query(f"WITH {_LINES}, d AS (SELECT DISTINCT n_name AS s FROM nation UNION SELECT DISTINCT text FROM u WHERE doc_id % 2 = 0) SELECT doc_id, CAST(ord AS INT) AS ord, CASE WHEN text IN (SELECT s FROM d) THEN 'gr ' || text ELSE 'el:' || text END AS translation FROM u")
def q46_translate_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = plaintext.units(documents(spark, sf_dir))
    phrases = units.filter("doc_id % 2 = 0").select(F.col("text").alias("source"), F.concat(F.lit("gr "), "text").alias("target"))
    return translating.translate(units, phrases, "el").select("doc_id", "ord", "translation")


@query(f"WITH {_LINES} SELECT text, count(*) AS units, count(DISTINCT doc_id) AS documents FROM u GROUP BY text")
def q47_stringset_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translating.distinct_strings(plaintext.units(documents(spark, sf_dir)))


@query("""WITH b AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'order is not a positive number' WHEN 2 THEN 'timings don''t follow the pattern' WHEN 3 THEN 'start is malformed' END AS rule FROM conversations)
    SELECT conv_id AS doc_id, rule, count(*) AS places FROM b WHERE rule IS NOT NULL GROUP BY conv_id, rule""")
def q48_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("turn") % 4 == 1, "x").otherwise((F.col("turn") + 1).cast("string"))
    arrow = F.when(F.col("turn") % 4 == 2, "->").otherwise("-->")
    start = F.when(F.col("turn") % 4 == 3, "soon").otherwise("00:00:01,000")
    part = filled("<<n>>\n<<s>> <<a>> 00:00:02,000\n<<t>>", n=number, s=start, a=arrow, t="text")
    return validating.srt_report(file_rows(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", part, "\n\n"))


@query("SELECT p_brand AS doc_id, 'k' || p_partkey AS key FROM parts WHERE p_size % 10 = 0")
def q49_plural_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validating.plural_gaps(xml_files.android_units(_plurals(parts(spark, sf_dir)))).select("doc_id", "key")


@query(SQL["q01_plaintext_units"])
def q50_streaming_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = new_folder(spark, "stream")
    documents(spark, sf_dir).write.parquet(f"{work}/in")
    return parse_stream(spark, f"{work}/in", "doc_id bigint, content string", plaintext.units, f"{work}/out", f"{work}/state")


@query("SELECT p_brand AS doc_id, 'partly blank plural' AS rule, 'k' || p_partkey AS key, CAST(2 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS line FROM parts QUALIFY p_size % 10 = 0")
def q51_android_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml_files.android_problems(_plurals(parts(spark, sf_dir)))


@query("SELECT c_nationkey AS doc_id, 'a' AS key, count(*) - 1 AS places FROM customers GROUP BY c_nationkey HAVING count(*) > 1")
def q52_json_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_rows(customers(spark, sf_dir), F.col("c_nationkey"), "c_custkey", filled('"a": "<<n>>"', n="c_name"), ",\n", "{", "}")
    return validating.duplicate_json_keys(files).groupBy("doc_id", "key").agg(F.count("*").alias("places"))


@query("""WITH t AS (SELECT p_name, min('t' || p_size || ' ' || p_name) AS target FROM parts WHERE p_size % 7 = 0 GROUP BY p_name)
    SELECT p_brand AS doc_id, md5('{' || string_agg('"k' || p_partkey || '": "' || coalesce(target, 'el:' || p_name) || '"', ', ' ORDER BY p_partkey) || '}') AS content FROM parts LEFT JOIN t USING (p_name) GROUP BY p_brand""")
def q53_json_translate_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_files(spark, sf_dir, '"k<<k>>": "<<name>>"')
    units = json_files.key_value_units(files)
    phrases = parts(spark, sf_dir).filter("p_size % 7 = 0").select(F.col("p_name").alias("source"), filled("t<<s>> <<n>>", s="p_size", n="p_name").alias("target"))
    told = translating.translate(units.withColumnRenamed("value", "text"), phrases, "el")
    done = compiling.compile_slots(files, json_files.slots(units), told.select("doc_id", "placeholder", "ord", F.col("translation").alias("text")))
    return done.select("doc_id", F.md5(F.col("content").cast("binary")).alias("content"))
