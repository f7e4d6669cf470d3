"""Queries over PO files: templates, compiling, synchronising, error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import po_compiling
from ..sources import po
from .building import customers, file_rows, filled, parts, query, stored, table

HEADER = 'msgid ""\nmsgstr ""\n"Content-Type: text/plain\\n"\n\n'
_HEAD_SQL = """'msgid ""' || chr(10) || 'msgstr "Content-Type: text/plain' || chr(92) || 'n"' || chr(10)"""


def _customers(spark: SparkSession, sf_dir: str, template: str, **columns) -> DataFrame:
    return file_rows(customers(spark, sf_dir), F.col("c_nationkey"), "c_custkey", filled(template, k="c_custkey", n="c_name", x="c_mktsegment", **columns), "\n", HEADER)


@query(f"""WITH e AS (SELECT c_nationkey AS doc_id, c_custkey AS k, '#. note' || chr(10) || '#: src/a.c:' || c_custkey || chr(10) || 'msgctxt "' || c_mktsegment || '"' || chr(10) || 'msgid "' || c_name || '"' || chr(10)
        || CASE WHEN c_custkey % 2 = 0 THEN 'msgid_plural "' || c_name || 's"' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'msgstr[0] "' || md5(c_name || ':' || c_name || 's:' || c_mktsegment) || '_pl"' ELSE 'msgstr[0] "el:' || c_name || '"' || chr(10) || 'msgstr[1] "el:' || c_name || 's"' END
           ELSE 'msgstr ' || CASE WHEN c_custkey % 3 = 0 THEN '"' || md5(c_name || ':' || c_mktsegment) || '_tr"' ELSE '""' || chr(10) || '"el:' || chr(92) || 'n"' || chr(10) || '"' || c_name || '"' END END || chr(10) AS part FROM customers)
    SELECT doc_id, {_HEAD_SQL} || chr(10) || string_agg(part, chr(10) ORDER BY k) AS content FROM e GROUP BY doc_id""")
def q77_po_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated entries get their texts, plurals each form and texts of several lines their breaks; others keep the placeholder."""
    plural = F.when(F.col("c_custkey") % 2 == 0, filled('msgid_plural "<<n>>s"\nmsgstr[0] ""\nmsgstr[1] ""\n', n="c_name")).otherwise(F.lit('msgstr ""\n'))
    files = _customers(spark, sf_dir, '#. note\n#: src/a.c:<<k>>\nmsgctxt "<<x>>"\nmsgid ""\n"<<n>>"\n<<p>>', p=plural)
    units = po.units(files)
    number = F.regexp_extract("occurrences", r":(\d+)", 1).cast("bigint")
    said = F.transform_values("strings", lambda k, v: F.concat(F.when(F.col("pluralized"), F.lit("el:")).otherwise(F.lit("el:\n")), v))
    told = units.filter(number % 3 != 0).select("doc_id", "placeholder", "ord", said.alias("strings"))
    return po_compiling.compile_po(stored(po_compiling.template(files)), told)


@query(f"""WITH s AS (SELECT c_nationkey AS doc_id, c_custkey AS k, c_name AS n, bool_or(c_custkey % 2 = 1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS added FROM customers WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0),
    e AS (SELECT doc_id, k, added, CASE WHEN added THEN '#. new' || chr(10) || '#: b.c:' || k || chr(10) || '#, c-format' || chr(10) ELSE '' END || 'msgid "' || n || '"' || chr(10) || 'msgstr "' || md5(n || ':') || '_tr"' || chr(10) AS part FROM s)
    SELECT e.doc_id, {_HEAD_SQL} || chr(10) || string_agg(part, chr(10) ORDER BY added, k) AS content FROM e JOIN (SELECT DISTINCT c_nationkey AS doc_id FROM customers WHERE c_custkey % 2 = 0) USING (doc_id) GROUP BY e.doc_id""")
def q35_po_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of even customers meet the strings of those that 2 or 3 divides: from the first new one on strings are added."""
    rows = customers(spark, sf_dir)
    files = file_rows(rows.filter("c_custkey % 2 = 0"), F.col("c_nationkey"), "c_custkey", filled('msgid "<<n>>"\nmsgstr ""\n', n="c_name"), "\n", HEADER)
    key = T.escape_po_key(F.col("c_name"))
    strings = rows.filter("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("ord"), key.alias("key"), F.lit("").alias("context"), F.lit(False).alias("pluralized"), T.placeholder(T.string_hash(key)).alias("placeholder"), F.lit("c-format").alias("flags"), filled("b.c:<<k>>", k="c_custkey").alias("occurrences"), F.lit("new").alias("developer_comment"))
    return po_compiling.sync_template(stored(po_compiling.template(files)), strings)


@query("""SELECT c_nationkey AS doc_id, c_name AS key, 'el' AS text, c_custkey % 5 = 0 AS fuzzy, CASE WHEN c_custkey % 5 <> 0 THEN CAST(count(*) FILTER (c_custkey % 5 <> 0) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) END AS ord FROM customers WHERE c_custkey % 2 = 0""")
def q78_po_translation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of translated files empty entries are none, fuzzy ones have no order, and obsolete ones are left out."""
    flag = F.when(F.col("c_custkey") % 5 == 0, "#, fuzzy\n").otherwise("")
    told = F.when(F.col("c_custkey") % 2 == 0, "el").otherwise("")
    files = _customers(spark, sf_dir, '<<f>>msgid "<<n>>"\nmsgstr "<<t>>"\n\n#~ msgid "old <<n>>"\n#~ msgstr "x"\n', f=flag, t=told)
    return po.units(files, is_source=False).select("doc_id", "key", F.element_at("strings", 5).alias("text"), "fuzzy", F.col("ord").cast("bigint").alias("ord"))


_BAD = ['msgid ""\nmsgstr "h"\n\nmsgid ""\nmsgstr "x"\n', 'msgid "a"\nmsgid_plural "b"\nmsgstr[0] "x"\nmsgstr[1] ""\n', 'msgid "a"\nmsgstr "x"\n\nmsgid "b"\nmsgstr ""\n\nmsgid "c"\nmsgstr ""\n', 'msgid "a"\nmsgstr ""\n\nmsgid "b"\nmsgstr "x"\n', 'msgid "a"\nmsgstr[0] "x"\n', "msgid a\n", 'msgid "a"\nmsgid_plural "b"\nmsgstr "x"\nmsgstr[0] ""\n', 'msgid "a"\nmsgstr " "\n\nmsgid "b"\nmsgstr "x"\n']


@query("""SELECT p_partkey AS doc_id, rule, key FROM part, (VALUES (0, 'empty msgid', ''), (1, 'incomplete plurals', 'a'), (2, 'empty msgstr', 'b'), (3, 'filled msgstr', 'b'), (4, 'msgstr[*] without a plural', 'a'), (5, 'syntax', 'line 1: neither a keyword nor a quoted text'), (6, 'msgstr of a plural', 'a')) v(n, rule, key) WHERE p_partkey % 8 = n""")
def q79_po_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files end as rows beside sound ones."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.get(F.array(*map(F.lit, _BAD)), (F.col("p_partkey") % 8).cast("int")).alias("content"))
    return po.problems(files).select("doc_id", "rule", "key")


@query("""SELECT p_partkey, p_name || ':' || p_type AS msgid, p_brand || chr(92) AS msgid_plural, p_name || ':' AS alone FROM part""")
def q80_po_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are cut at the first colon without a backslash."""
    key = F.concat(T.escape_po_key(F.concat("p_name", F.lit(":"), "p_type")), F.lit(":"), T.escape_po_key(F.concat("p_brand", F.lit("\\"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", po_compiling.split_key(key).alias("s"), po_compiling.split_key(T.escape_po_key(F.concat("p_name", F.lit(":")))).alias("t"))
    return rows.filter("t.msgid_plural is null").select("p_partkey", "s.msgid", "s.msgid_plural", F.col("t.msgid").alias("alone"))


_LONG = '#| msgctxt "old"\n#| msgid "was <<n>>"\n# <<c>>\nmsgid "<<n>> <<w>>"\nmsgstr ""\n'


@query("""WITH e AS (SELECT p_brand AS doc_id, p_partkey AS k, p_name || ' ' || repeat(p_type || ' ', 8) || '.' AS text, p_name AS n, repeat('x', 80) AS c FROM parts),
    w AS (SELECT *, string_split(text, ' ') AS words FROM e),
    l AS (SELECT *, list_reduce(list_prepend({'done': '', 'line': ''}, list_transform(words, lambda x: {'done': '', 'line': x})), lambda a, x: CASE WHEN a.line = '' THEN {'done': a.done, 'line': x.line}
            WHEN length(a.line) + 1 + length(x.line) <= 76 AND x.line <> '' THEN {'done': a.done, 'line': a.line || ' ' || x.line}
            WHEN length(a.line) + 1 <= 76 THEN {'done': a.done || '"' || a.line || ' "' || chr(10), 'line': x.line} ELSE {'done': a.done || '"' || a.line || '"' || chr(10), 'line': ' ' || x.line} END) AS folded FROM w),
    p AS (SELECT doc_id, k, '# ' || c || chr(10) || '#| msgctxt "old"' || chr(10) || '#| msgid "was ' || n || '"' || chr(10) || CASE WHEN length(text) <= 70 THEN 'msgid "' || text || '"' ELSE 'msgid ""' || chr(10) || folded.done || '"' || folded.line || '"' END || chr(10) || 'msgstr "' || md5(text || ':') || '_tr"' || chr(10) AS part FROM l)
    SELECT doc_id, 'msgid ""' || chr(10) || 'msgstr "Content-Type: text/plain' || chr(92) || 'n"' || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY k) AS content FROM p GROUP BY doc_id
    UNION ALL SELECT 'broken', ''""")
def q112_po_wrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts are wrapped, what entries had before stays, and a file with an error comes out empty."""
    rows = parts(spark, sf_dir)
    words = F.concat(F.repeat(F.concat("p_type", F.lit(" ")), F.lit(8)), F.lit("."))
    files = file_rows(rows, F.col("p_brand"), "p_partkey", filled(_LONG, n="p_name", w=words, c=F.repeat(F.lit("x"), F.lit(80))), "\n", HEADER)
    broken = rows.limit(1).select(F.lit("broken").alias("doc_id"), F.lit("msgid a\n").alias("content"))
    return po_compiling.template(files.unionByName(broken))
