"""Queries over YAML files: compiling with and without a template, comments, error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import yaml_compiling
from ..sources import yaml_files
from .building import file_rows, filled, query, stored, table


def _nations(spark: SparkSession, sf_dir: str, template: str, head: str = "r:\n") -> DataFrame:
    return file_rows(table(spark, sf_dir, "nation"), F.col("n_regionkey"), "n_nationkey", filled(template, k="n_nationkey", n="n_name"), "\n", head, "\n")


_ALL = "  n<<k>>:\n    # about <<k>>\n    plain: <<n>>\n    single: '<<n>> ''s'\n    double: \"<<n>> \\\"x\\\"\"\n    literal: |\n      <<n>>\n      two\n    folded: >\n      <<n>>\n      one\n    number: 5\n    anchored: &a<<k>> held <<n>>\n    alias: *a<<k>>\n    tagged: !t '<<n>>'\n    flow: [x<<k>>, \"y\"]"


@query("""SELECT n_regionkey AS doc_id, 'r.n' || n_nationkey || '.' || name AS key, replace(text, '#', n_name) AS text, tag AS context, style AS flags, CASE name WHEN 'plain' THEN 'about ' || n_nationkey ELSE '' END AS developer_comment,
        CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, i) - 1 AS INT) AS ord
    FROM nation, (VALUES (0, 'plain', '#', '', 'block:block:'), (1, 'single', '# ''s', '', 'block:block:'''), (2, 'double', '# "x"', '', 'block:block:"'), (3, 'literal', '#' || chr(10) || 'two' || chr(10), '', 'block:block:|'), (4, 'folded', '# one' || chr(10), '', 'block:block:>'),
        (5, 'anchored', 'held #', '', 'block:block:'), (6, 'tagged', '#', 't', 'block:block:'''), (7, 'flow.[0]', NULL, '', 'block:block:flow:'), (8, 'flow.[1]', 'y', '', 'block:block:flow:"')) v(i, name, text, tag, style)
    WHERE text IS NOT NULL UNION ALL SELECT n_regionkey, 'r.n' || n_nationkey || '.flow.[0]', 'x' || n_nationkey, '', 'block:block:flow:', '', CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) * 9 - 2 AS INT) FROM nation""".replace("WHERE text IS NOT NULL", "WHERE i <> 7").replace("ORDER BY n_nationkey, i) - 1", "ORDER BY n_nationkey, i) - 1 + CASE i WHEN 8 THEN 1 ELSE 0 END + (dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)"))
def q81_yaml_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every style with comments and flags; anchors, tags and aliases are left out of the text."""
    return yaml_files.units(_nations(spark, sf_dir, _ALL)).select("doc_id", "key", "text", "context", "flags", "developer_comment", "ord")


@query("""WITH e AS (SELECT n_regionkey AS doc_id, n_nationkey AS k, '  n' || n_nationkey || ':' || chr(10) || '    # about ' || n_nationkey || chr(10) || '    plain: "el: ' || n_name || '"' || chr(10) || '    single: ''el: ' || n_name || ' ''''s''' || chr(10)
        || '    double: "el: ' || n_name || ' ' || chr(92) || '"x' || chr(92) || '""' || chr(10) || '    literal: |' || chr(10) || '      el: ' || n_name || chr(10) || '      two' || chr(10) || '    folded: >' || chr(10) || '      el: ' || n_name || ' one' || chr(10)
        || '    number: 5' || chr(10) || '    anchored: &a' || n_nationkey || ' "el: held ' || n_name || '"' || chr(10) || '    alias: *a' || n_nationkey || chr(10) || '    tagged: !t ''el: ' || n_name || '''' || chr(10) || '    flow: ["el: x' || n_nationkey || '", "el: y"]' AS part FROM nation)
    SELECT doc_id, 'r:' || chr(10) || string_agg(part, chr(10) ORDER BY k) || chr(10) AS content FROM e GROUP BY doc_id""")
def q82_yaml_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations in the styles of their sources; plain ones that would read otherwise are quoted."""
    files = _nations(spark, sf_dir, _ALL)
    units = yaml_files.units(files)
    told = units.select("doc_id", "placeholder", "key", "flags", F.lit(False).alias("pluralized"), F.create_map(F.lit(5), F.concat(F.lit("el: "), "text")).alias("strings"))
    return yaml_compiling.compile_yaml(stored(yaml_compiling.template(files, units)), told)


@query("""WITH e AS (SELECT n_regionkey AS doc_id, n_nationkey AS k, '  n' || n_nationkey || ':' || chr(10) || '    count:' || chr(10) || '      one: ''el one ' || n_name || '''' || chr(10) || '      few: "el few"' || chr(10) || '      other: "el ' || n_name || 's"' || chr(10) || '    title: el ' || n_name AS part FROM nation)
    SELECT doc_id, 'en:' || chr(10) || string_agg(part, chr(10) ORDER BY k) || chr(10) AS content FROM e GROUP BY doc_id""")
def q83_i18n_yaml_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plurals get the forms of the other language in the style of `other`."""
    files = _nations(spark, sf_dir, '  n<<k>>:\n    count:\n      one: \'one <<n>>\'\n      other: "<<n>>s"\n    title: <<n>>', "en:\n")
    units = yaml_files.i18n_units(files)
    el = lambda c: F.concat(F.lit("el "), c)
    said = F.when(F.col("pluralized"), F.create_map(F.lit(1), el(F.try_element_at("strings", F.lit(1))), F.lit(3), F.lit("el few"), F.lit(5), el(F.try_element_at("strings", F.lit(5))))).otherwise(F.create_map(F.lit(5), el(F.try_element_at("strings", F.lit(5)))))
    told = units.select("doc_id", "placeholder", "key", "flags", "pluralized", said.alias("strings"))
    return yaml_compiling.compile_yaml(stored(yaml_compiling.template(files, units)), told, above=1)


@query("""WITH e AS (SELECT n_regionkey AS doc_id, n_nationkey AS k, '    n' || n_nationkey || ':' || chr(10) || '      a.b: ' || n_name || chr(10) || '      list:' || chr(10) || '        - "' || n_name || '"' || chr(10) || '        - !t ''x''' || chr(10) || '      7: |-' || chr(10) || '        two' || chr(10) || '        ' || n_name AS part FROM nation)
    SELECT doc_id, 'el:' || chr(10) || '  r:' || chr(10) || string_agg(part, chr(10) ORDER BY k) || chr(10) AS content FROM e GROUP BY doc_id""".replace("'    n'", "'    n'"))
def q38_yaml_without_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from keys and styles alone, under a language."""
    files = _nations(spark, sf_dir, "  n<<k>>:\n    a.b: <<n>>\n    list:\n    - \"<<n>>\"\n    - !t 'x'\n    7: |-\n      two\n      <<n>>")
    return yaml_compiling.compile_without_template(yaml_files.units(files), "el")


_BAD = ["a: [1, 2", "a: x\nb: y\na: z\n", "a: x\nb: y\n", "a: &x y\nb: !!binary aGk=\n", "a: *nowhere", "a: x"]


@query("""SELECT p_partkey AS doc_id, rule, line FROM part, (VALUES (0, 'no YAML', 1), (1, 'duplicate key', 3), (2, 'several roots', 1)) v(n, rule, line) WHERE p_partkey % 6 = n""")
def q84_yaml_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files end as rows beside sound ones; a file of binary leaves alone has no root."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.get(F.array(*map(F.lit, _BAD)), (F.col("p_partkey") % 6).cast("int")).alias("content"))
    return yaml_files.problems(files, one_root=True).select("doc_id", "rule", "line")


@query("""SELECT p_partkey, p_name AS plain, '''' || p_name || ' ''''x''''''' AS single, '"' || p_name || ': #"' AS unsafe, '"true"' AS typed, '|-' || chr(10) || '  ' || p_name || chr(10) || chr(10) || '  x' AS literal, '>+' || chr(10) || '    ' || p_name || chr(10) || chr(10) || '    y' || chr(10) AS folded FROM part""")
def q85_yaml_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda text, style, indent=2: yaml_compiling.styled(text, F.lit(style), F.lit(indent))
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", one(name, "").alias("plain"), one(F.concat(name, F.lit(" 'x'")), "'").alias("single"), one(F.concat(name, F.lit(": #")), "").alias("unsafe"), one(F.lit("true"), "").alias("typed"), one(F.concat(name, F.lit("\n\nx")), "|").alias("literal"), one(F.concat(name, F.lit("\ny\n\n")), ">", 4).alias("folded"))


@query("""SELECT p_partkey, replace(p_name, ' ', '_') || chr(10) || '  ' || p_brand AS plain, '''' || p_name || chr(10) || chr(10) || '  ' || p_type || '''' AS single, '>-' || chr(10) || '  ' || p_name || chr(10) || '    ' || p_type || chr(10) || '  ' || p_brand AS folded,
        '"' || p_name || chr(92) || 'u0085' || chr(92) || 'u0007"' AS special, '"' || p_brand || chr(92) || chr(10) || '  ' || chr(92) || ' ' || chr(92) || 'nx"' AS "double" FROM part""")
def q121_yaml_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends of each style: at spaces beyond the width, between lines, beside indented lines; and characters that stand in double quotes only."""
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    one = lambda text, style, width=None: yaml_compiling.styled(text, F.lit(style), F.lit(2), width)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        one(F.concat_ws(" ", F.replace(name, F.lit(" "), F.lit("_")), brand), "", 1).alias("plain"),
        one(F.concat(name, F.lit("\n"), kind), "'").alias("single"),
        one(F.concat(name, F.lit("\n  "), kind, F.lit("\n"), brand), ">").alias("folded"),
        one(F.concat(name, F.lit("\u0085\u0007")), "").alias("special"),
        one(F.concat(brand, F.lit(" \nx")), '"', 4).alias("double"),
    )


@query("""SELECT d.doc_id, length(text) AS n_chars, sha256(text) AS text_sha256, style FROM documents d, (VALUES (0, 'single'), (1, 'double'), (2, 'literal'), (3, 'folded')) v(n, style) WHERE length(text) > 0""")
def q122_yaml_folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as scalars of 80 characters a line in each style, read back."""
    docs = table(spark, sf_dir, "documents").filter("length(text) > 0")
    names = {"single": "'", "double": '"', "literal": "|", "folded": ">"}
    part = F.concat(*(x for n, s in names.items() for x in (F.lit(f"  {n}: "), yaml_compiling.styled(F.col("text"), F.lit(s), F.lit(4), 80), F.lit("\n"))))
    read = yaml_files.units(docs.select("doc_id", F.concat(F.lit("t:\n"), part).alias("content")))
    return read.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.substring_index("key", ".", -1).alias("style"))
