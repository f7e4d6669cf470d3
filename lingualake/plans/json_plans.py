"""Queries over JSON string files: compiling, synchronising, error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compiling, json_compiling
from ..sources import json_files
from .building import brand_files, file_rows, filled, part_files, parts, query, stored, table


def _template(files: DataFrame, units: DataFrame) -> DataFrame:
    return stored(compiling.compile_slots(files, json_files.slots(units)))


def _told(units: DataFrame, keep=None, *extra: str) -> DataFrame:
    rows = units if keep is None else units.filter(keep)
    said = F.transform_values("strings", lambda k, v: F.concat(F.lit("el:"), v))
    return rows.select("doc_id", "placeholder", "ord", "pluralized", said.alias("strings"), *extra)


def _number():
    return F.regexp_extract("key", r"^\D*(\d+)", 1).cast("bigint")


@query("""WITH x AS (SELECT p_brand AS doc_id, p_partkey AS k, '"k' || p_partkey || '": {"string": "el:' || p_name || '", "context": "new \\"' || p_type || '", "n": 1' || CASE WHEN p_partkey % 2 = 0 THEN ', "character_limit": 7, "developer_comment": "c' || p_size || '"' ELSE '' END || '}' AS part FROM part)
    SELECT doc_id, '{' || string_agg(part, ', ' ORDER BY k) || '}' AS content FROM x GROUP BY doc_id""".replace('\\\\"', '\\"'))
def q21_structured_compile_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and contexts are replaced, limits and comments of every other object added."""
    files = brand_files(spark, sf_dir, '"k<<k>>": {"string": "<<name>>", "context": "<<type>>", "n": 1}')
    units = json_files.structured_units(files)
    even = _number() % 2 == 0
    told = _told(units.withColumns({"context": F.concat(F.lit('new "'), "context"), "character_limit": F.when(even, 7), "developer_comment": F.when(even, F.lit("c"))}), None, "key", "context", "character_limit", "developer_comment")
    sizes = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), "p_partkey").alias("key"), "p_size", F.col("p_brand").alias("doc_id"))
    told = told.join(sizes, ["doc_id", "key"]).withColumn("developer_comment", F.concat("developer_comment", "p_size"))
    return json_compiling.compile_structured(_template(files, units), told)


@query("""WITH x AS (SELECT p_brand AS doc_id, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '"k' || p_partkey || '": "el:' || p_name || '"' ELSE '' END || ', ' || CASE WHEN p_partkey % 3 = 0 THEN '"p' || p_partkey || '": "{n, plural, one {el:a} other {el:' || p_type || '}}"' ELSE '' END AS part FROM part)
    SELECT doc_id, '{' || string_agg(part, ', ' ORDER BY k) || '}' AS content FROM x GROUP BY doc_id""")
def q58_json_compile_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members without a translation go, their commas stay; plurals keep what is around their forms."""
    files = brand_files(spark, sf_dir, '"k<<k>>": "<<name>>", "p<<k>>": "{n, plural, one {a} other {<<type>>}}"')
    units = json_files.key_value_units(files)
    return json_compiling.compile_members(_template(files, units), _told(units, F.when(F.col("pluralized"), _number() % 3 == 0).otherwise(_number() % 2 == 0)))


@query("""WITH x AS (SELECT p_brand AS doc_id, p_partkey AS k, '"k' || p_partkey || '": "' || CASE WHEN p_partkey % 2 = 0 THEN 'el:' || p_name ELSE md5('k' || p_partkey || ':') || '_tr' END || '"' AS part FROM part)
    SELECT doc_id, '{"@@locale": "el", ' || string_agg(part, ', ' ORDER BY k) || '}' AS content FROM x GROUP BY doc_id""")
def q59_arb_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = brand_files(spark, sf_dir, '"k<<k>>": "<<name>>"', ", ", '{"@@locale": "en", ', "}")
    units = json_files.arb_units(files)
    return json_compiling.compile_arb(_template(files, units), _told(units, _number() % 2 == 0), "el")


@query("""WITH x AS (SELECT s_nationkey AS doc_id, s_suppkey AS k, '"s' || s_suppkey || '": {"message": "' || CASE WHEN s_suppkey % 2 = 0 THEN 'el:' || s_name ELSE md5('s' || s_suppkey || '.message:') || '_tr' END || '", "description": "d"}' AS part FROM supplier)
    SELECT doc_id, '{' || string_agg(part, ', ' ORDER BY k) || '}' AS content FROM x GROUP BY doc_id""")
def q60_chrome_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled('"s<<k>>": {"message": "<<n>>", "description": "d"}', k="s_suppkey", n="s_name")
    files = file_rows(table(spark, sf_dir, "supplier"), F.col("s_nationkey"), "s_suppkey", part, ", ", "{", "}")
    units = json_files.chrome_units(files)
    template = json_compiling.sync_chrome(_template(files, units), units)
    return json_compiling.compile_kept(template, _told(units, _number() % 2 == 0))


@query("""WITH x AS (SELECT s_nationkey AS doc_id, s_suppkey AS k, '"s' || s_suppkey || '": {"message": "el:' || s_name || '"}' AS part FROM supplier WHERE s_suppkey % 3 > 0)
    SELECT n.s_nationkey AS doc_id, '{"x": 1' || coalesce(', ' || string_agg(part, ', ' ORDER BY k), '') || '}' AS content FROM (SELECT DISTINCT s_nationkey FROM supplier) n LEFT JOIN x ON x.doc_id = n.s_nationkey GROUP BY 1""")
def q61_chrome_v3_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = filled('"s<<k>>": {"message": "<<n>>"}', k="s_suppkey", n="s_name")
    files = file_rows(table(spark, sf_dir, "supplier"), F.col("s_nationkey"), "s_suppkey", part, ", ", '{"x": 1, ', "}")
    units = json_files.chrome_v3_units(files)
    return json_compiling.compile_chrome_v3(_template(files, units), _told(units, _number() % 3 > 0))


def _strings(rows: DataFrame, doc: str, key: str, *extra) -> DataFrame:
    hashed = T.string_hash(F.col(key), F.lit(""))
    return rows.select(F.col(doc).alias("doc_id"), F.col("p_partkey").alias("ord"), F.col(key).alias("key"), T.placeholder(hashed).alias("placeholder"), *extra)


_SYNCED = """WITH x AS (SELECT p_brand AS doc_id, p_partkey AS k, bool_or(p_partkey % 2 = 1) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS added FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0)"""


@query(f"""{_SYNCED} SELECT doc_id, CASE WHEN bool_and(added) THEN '{{' || chr(10) || '  ' || string_agg('"k.' || k || '": "' || md5('k' || chr(92) || '.' || k || ':') || '_tr"', ',' || chr(10) || '  ' ORDER BY k) || chr(10) || '}}' || chr(10)
    ELSE '{{' || string_agg('"k.' || k || '": "' || md5('k' || chr(92) || '.' || k || ':') || '_tr"', ', ' ORDER BY k) || '}}' END AS content FROM x GROUP BY doc_id""")
def q62_json_sync_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of even parts meet the strings of parts that 2 or 3 divides: up to the first new one they stay, the rest is added."""
    rows = table(spark, sf_dir, "part").withColumn("key", F.concat(F.lit("k\\."), "p_partkey"))
    files = file_rows(rows.filter("p_partkey % 2 = 0"), F.col("p_brand"), "p_partkey", filled('"k.<<k>>": "<<n>>"', k="p_partkey", n="p_name"), ", ", "{", "}")
    templates = _template(files, json_files.key_value_units(files))
    return json_compiling.sync_template(templates, _strings(rows.filter("p_partkey % 2 = 0 or p_partkey % 3 = 0"), "p_brand", "key"))


@query("""WITH x AS (SELECT p_brand AS doc_id, p_partkey AS k, p_partkey % 2 = 1 AS added,
        CASE WHEN p_partkey % 2 = 0 THEN '"g' || p_partkey || '": {"k": {"string": "' || md5('g' || p_partkey || '.k:') || '_tr"}}'
        ELSE '"k' || p_partkey || '": {' || chr(10) || chr(9) || '  "string": "' || md5('k' || p_partkey || ':') || '_tr",' || chr(10) || chr(9) || '  "developer_comment": "c",' || chr(10) || chr(9) || '  "character_limit": 5' || chr(10) || chr(9) || '}' END AS part
        FROM part WHERE p_partkey % 3 = 0)
    SELECT doc_id, '{' || chr(10) || '  "v": 1' || coalesce(string_agg(',' || chr(10) || '  ' || part, '' ORDER BY added, k), '') || chr(10) || '}' AS content FROM x GROUP BY doc_id""")
def q63_structured_sync_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose string is gone go with what held them; others are added with their metadata."""
    rows = table(spark, sf_dir, "part")
    part = filled('"g<<k>>": {"k": {"string": "<<n>>"}}', k="p_partkey", n="p_name")
    files = file_rows(rows.filter("p_partkey % 2 = 0"), F.col("p_brand"), "p_partkey", part, ",\n  ", '{\n  "v": 1,\n  ', "\n}")
    templates = _template(files, json_files.structured_units(files))
    keyed = rows.filter("p_partkey % 3 = 0").withColumn("key", F.when(F.col("p_partkey") % 2 == 0, filled("g<<k>>.k", k="p_partkey")).otherwise(filled("k<<k>>", k="p_partkey")))
    strings = _strings(keyed, "p_brand", "key", F.lit("").alias("context"), F.lit("c").alias("developer_comment"), F.lit(5).alias("character_limit"))
    return json_compiling.sync_structured(templates, strings, ordered=False).join(keyed.select(F.col("p_brand").alias("doc_id")).distinct(), "doc_id")


@query("""WITH m AS (SELECT p_brand AS doc_id, p_partkey AS k, '"k' || p_partkey || '": "' || md5('k' || p_partkey || ':') || '_tr"' AS member FROM parts)
    SELECT doc_id, '{' || string_agg(member, ', ' ORDER BY k) || '}' AS kept, string_agg(member, ', ' ORDER BY k) FILTER (k % 2 = 0) AS members FROM m GROUP BY doc_id HAVING bool_or(k % 2 = 0)""")
def q73_arb_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By default nothing goes; otherwise the strings that don't stay do."""
    files = part_files(spark, sf_dir, '"k<<k>>": "<<name>>"')
    units = json_files.arb_units(files)
    templates = _template(files, units)
    some = units.filter(_number() % 2 == 0)
    whole = json_compiling.sync_arb(templates, some).withColumnRenamed("content", "kept")
    fewer = json_compiling.remove_strings(templates, some, ordered=False)
    return whole.join(fewer, "doc_id").filter("content <> '{}'").select("doc_id", "kept", F.regexp_replace("content", r"^\{|\}$", "").alias("members"))


_BAD_JSON = ["}", '{"a": 1,\n b}', '"text"', '{"a": "b"}', "[1, 2", "7"]


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 6 IN (2, 5) THEN 'not a container' ELSE 'no JSON' END AS rule, CASE WHEN p_partkey % 6 = 1 THEN 2 ELSE 1 END AS line FROM part WHERE p_partkey % 6 <> 3""")
def q64_json_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no JSON, or hold no object or list, end as rows beside sound ones."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.get(F.array(*map(F.lit, _BAD_JSON)), (F.col("p_partkey") % 6).cast("int")).alias("content"))
    return json_files.errors(files).select("doc_id", "rule", "line")


@query("""SELECT p_brand AS doc_id, 'k' || p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN 'invalid plural format' ELSE 'invalid plural rule' END AS rule, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS line FROM parts QUALIFY p_partkey % 3 < 2""")
def q65_icu_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text after the last form, and rules that there are not; braces nest five deep elsewhere."""
    form = F.get(F.array(F.lit("one {a} other {b} junk"), F.lit("one {a} odd {b}"), F.lit("one {{g, select, m {he {x {y} z}} other {it}}} other {b}")), (F.col("p_partkey") % 3).cast("int"))
    part = filled('"k<<k>>": "{n, plural, <<f>>}"', k="p_partkey", f=form)
    return json_files.icu_problems(file_rows(parts(spark, sf_dir), F.col("p_brand"), "p_partkey", part, ",\n", "{", "}"))


@query("""SELECT p_brand AS doc_id, 'k' || p_partkey AS key, 'string is no text' AS rule, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS line FROM parts QUALIFY p_size % 2 = 0""")
def q74_structured_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("p_size") % 2 == 0, "[1]").otherwise('"x"')
    return json_files.structured_problems(file_rows(parts(spark, sf_dir), F.col("p_brand"), "p_partkey", filled('"k<<k>>": {"string": <<v>>}', k="p_partkey", v=value), ",\n", "{", "}"))


@query("""SELECT c_nationkey AS doc_id, 'a' AS key, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS line FROM customer QUALIFY line > 1""")
def q75_json_duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later occurrence of a key with its line."""
    files = file_rows(table(spark, sf_dir, "customer"), F.col("c_nationkey"), "c_custkey", filled('"a": "<<n>>"', n="c_name"), ",\n", "{", "}")
    return json_files.duplicate_keys(files)


@query("""SELECT p_partkey, replace(replace(key, chr(92), chr(92) || chr(92)), '.', chr(92) || '.') AS json_key, key AS json_again, replace(replace(key, chr(92), chr(92) || chr(92)), ':', chr(92) || ':') AS po_key, replace(replace(key, chr(92), chr(92) || chr(92)), '[', chr(92) || '[') AS android_name, replace(key, '.', '<TX_DOT>') AS yaml_key, key AS yaml_again,
    replace(replace(replace(key, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml, key AS xml_again FROM (SELECT p_partkey, p_name || '.:[<&>' || p_type AS key FROM part)""")
def q76_key_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("p_name", F.lit(".:[<&>"), "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", T.escape_json_key(key).alias("json_key"), T.escape_po_key(key).alias("po_key"), T.escape_android_name(key).alias("android_name"), T.escape_yaml_key(key).alias("yaml_key"), T.escape_xml(key).alias("xml"))
    return rows.select("*", T.unescape_json_key(F.col("json_key")).alias("json_again"), T.unescape_yaml_key(F.col("yaml_key")).alias("yaml_again"), T.unescape_xml(F.col("xml")).alias("xml_again"))
