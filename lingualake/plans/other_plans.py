"""Queries over formats by extension, subtitle rules and small functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import formats
from ..functions import text as T
from ..operators import compiling, validating
from ..sources import json_files, plaintext, subtitles
from ..storing import new_folder
from .building import documents, file_rows, filled, parts, query, table

_KINDS = (("txt", "<<n>>"), ("json", '{"k": "<<n>>"}'), ("po", 'msgid "<<n>>"\nmsgstr ""\n'), ("yml", "k: <<n>>\n"), ("md", "# <<n>>\n"), ("doc", "<<n>>"))


@query("""SELECT p_partkey AS doc_id, format, CASE format WHEN 'Plaintext' THEN '0' WHEN 'Github_Markdown_v2' THEN '0' WHEN 'PO' THEN p_name ELSE 'k' END AS key, CASE format WHEN 'KEYVALUEJSON' THEN NULL WHEN 'PO' THEN NULL ELSE p_name END AS text
    FROM part, (VALUES (0, 'Plaintext'), (1, 'KEYVALUEJSON'), (2, 'PO'), (3, 'Yaml'), (4, 'Github_Markdown_v2')) v(n, format) WHERE p_partkey % 6 = n""")
def q100_formats_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many formats in one table, each read by its extension; units come as JSON."""
    rows = table(spark, sf_dir, "part")
    pick = lambda parts: F.get(F.array(*parts), (F.col("p_partkey") % 6).cast("int"))
    files = rows.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("dir.x/f."), pick([F.lit(k) for k, _ in _KINDS])).alias("path"), pick([filled(t, n="p_name") for _, t in _KINDS]).cast("binary").alias("content"))
    found = formats.parse_by_extension(files)
    return found.select("doc_id", "format", "key", F.get_json_object("unit", "$.text").alias("text"))


@query("""SELECT p_partkey AS doc_id, 'dir.x/f.doc' AS path FROM part WHERE p_partkey % 6 = 5""")
def q101_unknown_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return formats.unknown(rows.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("dir.x/f."), F.get(F.array(*(F.lit(k) for k, _ in _KINDS)), (F.col("p_partkey") % 6).cast("int"))).alias("path")))


@query("""SELECT conv_id AS doc_id, rule, count(*) AS places FROM conversations, (VALUES (1, 'timings don''t follow the pattern'), (2, 'start is malformed'), (3, 'end is malformed')) v(n, rule) WHERE turn % 4 = n GROUP BY conv_id, rule
    UNION ALL SELECT DISTINCT conv_id, 'no WEBVTT at the start', 1 FROM conversations WHERE conv_id % 2 = 0""")
def q102_vtt_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.get(F.array(*map(F.lit, ("00:01.5 --> 00:02", "00:01.5 -->", "soon --> 00:02.0", "00:01.5 --> late"))), (F.col("turn") % 4).cast("int"))
    files = file_rows(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", filled("<<c>>\n<<t>>", c=times, t="text"), "\n\n", "WEBVTT\n\n")
    return subtitles.vtt_problems(files.withColumn("content", F.when(F.col("doc_id") % 2 == 0, F.substring("content", 9, 1 << 30)).otherwise(F.col("content"))))


@query("""SELECT conv_id AS doc_id, rule, count(*) AS places FROM conversations, (VALUES (1, 'order is not ascending'), (2, 'not enough lines'), (3, 'end is malformed')) v(n, rule) WHERE turn % 4 = n GROUP BY conv_id, rule""")
def q103_srt_order_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("turn") % 4 == 1, 1).otherwise(F.col("turn") + 1)
    body = F.when(F.col("turn") % 4 == 2, "").when(F.col("turn") % 4 == 3, "\n00:00:01,000 --> then\nx").otherwise("\n00:00:01,000 --> 00:00:02,000\nx")
    return validating.srt_report(file_rows(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", filled("<<n>><<b>>", n=number.cast("string"), b=body), "\n\n"))


@query("""SELECT conv_id AS doc_id, CAST(row_number() OVER w - 1 AS INT) AS seg, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def q104_subtitle_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each block starts: the lengths before it and their blank lines."""
    files = file_rows(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", F.col("text"), "\n\n")
    return subtitles.blocks(files).select("doc_id", "seg", F.col("start").cast("bigint").alias("start"))


@query("""SELECT p_partkey, p_size % 6 AS number, ['zero', 'one', 'two', 'few', 'many', 'other'][p_size % 6 + 1] AS name, p_size % 3 AS numeric_rule,
    '=1 {' || md5(p_name) || '_pl_0} few {' || md5(p_name) || '_pl_1} other {' || md5(p_name) || '_pl_2}' AS forms, '%s|%1$d|%5.2f' AS specifiers, p_name AS decoded FROM part""")
def q105_rules_and_specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("p_size") % 6).cast("int")
    forms = T.plural_placeholders(F.md5(F.col("p_name").cast("binary")), F.array(F.lit(1), F.lit(3), F.lit(5)), F.create_map(F.lit(1), F.lit("=1")))
    text = F.concat(F.lit("%s "), "p_name", F.lit(" %1$d 5%! %5.2f"))
    return table(spark, sf_dir, "part").select("p_partkey", T.known_rule(T.rule_name(number)).alias("number"), T.rule_name(number).alias("name"), T.known_rule(F.concat(F.lit("="), (F.col("p_size") % 3).cast("string"))).alias("numeric_rule"), forms.alias("forms"), F.array_join(T.specifiers(text), "|").alias("specifiers"), T.decoded(F.col("p_name").cast("binary")).alias("decoded"))


@query("""SELECT doc_id, '7' AS placeholder FROM documents WHERE doc_id % 3 = 0""")
def q106_extra_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations that the template has no place for are rows; without any, compiling goes on."""
    segments = plaintext.segments(documents(spark, sf_dir).select("doc_id", F.regexp_replace("content", "7", "").alias("content")))
    template = compiling.plaintext_template(segments).withColumn("content", F.when(F.col("doc_id") % 3 == 0, "").otherwise("7"))
    told = template.select("doc_id", F.lit("7").alias("placeholder"))
    compiling.without_extra(template, told.filter("doc_id % 3 <> 0")).count()
    return compiling.extra_strings(template, told)


@query("""SELECT p_brand AS doc_id, p_type AS a, p_size::VARCHAR AS b FROM part""")
def q107_json_find_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of objects by name: of repeated ones the last, null for missing ones."""
    rows = table(spark, sf_dir, "part")
    files = file_rows(rows, F.col("p_brand"), "p_partkey", filled('{"a": "<<n>>", "b": <<s>>, "a": "<<t>>"}', n="p_name", s="p_size", t="p_type"), ", ", "[", "]")
    return json_files.find_children(json_files.nodes(files), "a", "b", "c").filter("c is null").select("doc_id", "a", "b")


@query("""SELECT n_nationkey AS doc_id FROM nation WHERE n_nationkey % 2 = 1""")
def q108_files_without_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.when(F.col("n_nationkey") % 2 == 0, '{"a": {"string": "x"}}').otherwise('{"a": {"string": " "}, "b": 1}').alias("content"))
    return validating.without_units(files, json_files.structured_units(files))


_FOLDER = {
    "txt": ("<<n>>\n\n <<t>> \n", "el:<<n>>\n\n el:<<t>> \n", "{0}\n\n {1} \n"),
    "json": ('{"a": "<<n>>", "b": ["<<t>>"]}', '{"a": "el:<<n>>", "b": ["el:<<t>>"]}', '{"a": "{a}", "b": ["{b..0..}"]}'),
    "xml": ('<resources>\n<string name="a"><<n>></string>\n</resources>', '<resources>\n<string name="a">el:<<n>></string>\n</resources>', '<resources>\n<string name="a">{a}</string>\n</resources>'),
    "yml": ("a:\n  b: <<n>>\n", 'a:\n  b: el:<<n>>\n', "a:\n  b: {a.b}\n"),
    "srt": ("1\n00:00:01,000 --> 00:00:02,000\n<<n>>\n\n2\n00:00:03,000 --> 00:00:04,000\n<<t>>\n", "1\n00:00:01,000 --> 00:00:02,000\nel:<<n>>\n\n2\n00:00:03,000 --> 00:00:04,000\nel:<<t>>\n", "1\n00:00:01,000 --> 00:00:02,000\n{1}\n\n2\n00:00:03,000 --> 00:00:04,000\n{2}\n"),
    "po": ('msgid ""\nmsgstr ""\n\nmsgid "<<n>>"\nmsgstr ""\n', 'msgid ""\nmsgstr ""\n\nmsgid "<<n>>"\nmsgstr "el:<<n>>"\n', 'msgid ""\nmsgstr ""\n\nmsgid "<<n>>"\nmsgstr "{<<n>>}"\n'),
    "md": ("# <<n>>\n\n<<t>>\n", "# el:<<n>>\n\nel:<<t>>\n", "# {0}\n\n{1}\n"),
    "doc": ("<<n>>", None, None),
}


def _folder_sql() -> str:
    """What each file of the folder becomes: `{key}` stands for the placeholder of a key."""

    def text(pattern: str) -> str:
        out, rest = [], pattern
        quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        for piece in re.split(r"(\{[^{}\s\"]+\}|\{<<n>>\}|<<[nt]>>)", rest):
            column = {"<<n>>": "p_name", "<<t>>": "p_type", "{<<n>>}": "md5(p_name || ':') || '_tr'"}.get(piece)
            key = re.fullmatch(r"\{([^{}]+)\}", piece)
            out.append(column or (f"md5('{key[1]}:') || '_tr'" if key else quoted(piece)))
        return " || ".join(out)

    each = []
    for k, (ext, (_, result, template)) in enumerate(_FOLDER.items()):
        for kind, mark, pattern in (("result", "el", result), ("template", "tpl", template)):
            if pattern:
                each.append(f"SELECT p_partkey AS doc_id, 'a/f_{mark}.{ext}' AS path, '{kind}' AS kind, {text(pattern)} AS content FROM part WHERE p_partkey % {len(_FOLDER)} = {k}")
    return " UNION ALL ".join(each)


@query(_folder_sql())
def q113_convert_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of mixed files, read once, becomes templates and translated results by the formats' names."""
    pick = lambda parts: F.get(F.array(*parts), (F.col("p_partkey") % len(_FOLDER)).cast("int"))
    rows = table(spark, sf_dir, "part")
    files = rows.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("a/f_en."), pick([F.lit(k) for k in _FOLDER])).alias("path"), pick([filled(t, n="p_name", t="p_type") for t, _, _ in _FOLDER.values()]).cast("binary").alias("content"))
    said = lambda units: units.withColumn("strings", F.transform_values("strings", lambda k, v: F.concat(F.lit("el:"), v)))
    done = formats.convert(files, said, new_folder(spark, "converted"))
    return done.select("doc_id", "path", "kind", F.decode("content", "UTF-8").alias("content"))


@query("""SELECT p_partkey AS doc_id, kind, path, CASE kind WHEN 'string' THEN p_name WHEN 'scalar' THEN p_size::VARCHAR ELSE CASE WHEN path IS NULL THEN '{' ELSE '[' END END AS value FROM part, (VALUES ('dict', NULL), ('list', 'a'), ('string', 'a..0..'), ('scalar', 'b')) v(kind, path)
    UNION ALL SELECT p_partkey, 'po', '0', p_name FROM part UNION ALL SELECT p_partkey, 'xml', v.tag, CASE v.tag WHEN 'b' THEN p_type END FROM part, (VALUES ('a'), ('b')) v(tag)""")
def q114_table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files walked in SQL by the registered table functions."""
    formats.register_functions(spark)
    rows = table(spark, sf_dir, "part")
    rows.select("p_partkey", filled('{"a": ["<<n>>"], "b": <<s>>}', n="p_name", s="p_size").alias("json"), filled('msgid "<<n>>"\nmsgstr ""\n', n="p_name").alias("po"), filled("<a><b><<t>></b></a>", t="p_type").alias("xml")).createOrReplaceTempView("_walked")
    return spark.sql("""SELECT p_partkey AS doc_id, n.kind, n.path, n.value FROM _walked, LATERAL json_nodes(json) n
        UNION ALL SELECT p_partkey, 'po', CAST(e.seq AS STRING), e.msgid FROM _walked, LATERAL po_entries(po) e UNION ALL SELECT p_partkey, 'xml', x.tag, x.inner FROM _walked, LATERAL xml_nodes(xml) x""")


_STRUCTURE = '{"a": {"b.c": {"string": "old"}}, "a": {"b.c": {"string": "<<n>>", "context": "<<t>>", "character_limit": <<s>>}, "d": {"string": "x\\ty"}}, "q\\"r": {"developer_comment": "\\u00e9"}, "l": [{"string": "no"}]}'


@query("""SELECT p_partkey AS doc_id, key, CASE i WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'x' || chr(9) || 'y' ELSE '' END AS string, CASE WHEN i < 2 THEN p_type ELSE '' END AS context, CASE i WHEN 3 THEN 'é' ELSE '' END AS developer_comment, CASE WHEN i < 2 THEN p_size END AS character_limit
    FROM part, (VALUES (0, 'a.b' || chr(92) || '.c'), (1, 'a."b.c"'), (2, 'a.d'), (3, '"q""r"')) v(i, key)""")
def q115_json_structures_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found by keys with escaped and quoted parts; what is not there, is under a list or was overwritten has no row."""
    rows = table(spark, sf_dir, "part")
    files = rows.select(F.col("p_partkey").alias("doc_id"), filled(_STRUCTURE, n="p_name", t="p_type", s="p_size").alias("content"))
    keys = rows.select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(*map(F.lit, ("a.b\\.c", 'a."b.c"', "a.d", '"q""r"', "a.b", "l.0", "a.d.string", "z")))).alias("key"))
    return json_files.structure_of(files, keys)


_ARB = ['{"a": "x", "@a": {"type": "text"}, "a": "<<n>>"}', '[{"a": "<<n>>"}]', '{"@b": {}, "a": "<<n>>"}', '{"a": "<<n>>", "@a": "text"}', '{"@@locale": "en", "a": "<<n>>"}']


@query("""SELECT p_partkey AS doc_id, rule, message FROM part, (VALUES (0, 'duplicate key', 'a'), (1, 'the root is no object', 'a list'), (2, 'attributes of no key', '@b'), (3, 'attributes are no object', '@a')) v(n, rule, message) WHERE p_partkey % 5 = n""")
def q116_arb_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.get(F.array(*(filled(t, n="p_name") for t in _ARB)), (F.col("p_partkey") % 5).cast("int")).alias("content"))
    return json_files.arb_problems(files).select("doc_id", "rule", "message")
