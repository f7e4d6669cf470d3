"""Queries over XML string files: compiling, error reports, walking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import validating, xml_compiling
from ..sources import xml_files, xml_walk
from .building import XML, brand_files, file_rows, filled, part_files, parts, query, stored, table


def _told(units: DataFrame, keep=None) -> DataFrame:
    """Translations `el:text` of the units that `keep` holds for."""
    rows = units if keep is None else units.filter(keep)
    said = F.transform_values("strings", lambda k, v: F.concat(F.lit("el:"), v))
    return rows.select("doc_id", "placeholder", "ord", "pluralized", said.alias("strings"))


def _number():
    return F.regexp_extract("key", r"^\D+(\d+)", 1).cast("bigint")


@query("""WITH p AS (SELECT p_brand AS doc_id, p_partkey AS k,
        CASE WHEN p_partkey % 3 <> 0 THEN '<!-- c' || p_partkey || ' -->' || chr(10) || '<string name="s' || p_partkey || '">el:' || p_name || '</string>' || chr(10) ELSE '' END
        || CASE WHEN p_partkey % 4 <> 0 THEN '<plurals name="p' || p_partkey || '">' || chr(10) || '  <item quantity="one">el:' || p_name || '</item>' || chr(10) || '  <item quantity="other">el:' || p_type || '</item>' || chr(10) || '</plurals>' || chr(10) ELSE '' END AS part FROM parts)
    SELECT doc_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<resources>' || chr(10) || string_agg(part, '' ORDER BY k) || '</resources>' || chr(10) AS content FROM p GROUP BY doc_id""")
def q27_android_compile_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings and plurals through the template; what isn't translated goes with its comment, what may not be translated too."""
    part = '<!-- c<<k>> -->\n<string name="s<<k>>"><<name>></string>\n<string name="x<<k>>" translatable="false">no</string>\n<plurals name="p<<k>>">\n  <item quantity="one"><<name>></item>\n  <item quantity="other"><<type>></item>\n</plurals>'
    files = part_files(spark, sf_dir, part, *XML)
    units = stored(xml_files.android_units(files))
    told = _told(units, F.when(F.col("pluralized"), _number() % 4 != 0).otherwise(_number() % 3 != 0))
    return xml_compiling.compile_android(stored(xml_compiling.android_template(files, units)), told, is_source=False)


@query("""WITH p AS (SELECT n_regionkey AS doc_id, n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE '<string-array name="n' || n_nationkey || '"><item>el:' || n_name || '</item>' || CASE WHEN n_nationkey % 3 = 1 THEN ' <item>el:two</item>' ELSE '' END || '</string-array>' || chr(10) END
        || '<string name="f' || n_nationkey || '" translatable="false">same</string>' || chr(10) AS part FROM nation)
    SELECT doc_id, '<resources tools:locale="el">' || chr(10) || string_agg(part, '' ORDER BY k) || '</resources>' AS content FROM p GROUP BY doc_id""")
def q54_android_arrays_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays lose items or go whole; the language is written and fixed strings stay in source files."""
    part = filled('<string-array name="n<<k>>"><item><<n>></item> <item>two</item></string-array>\n<string name="f<<k>>" translatable="false">same</string>', k="n_nationkey", n="n_name")
    files = file_rows(table(spark, sf_dir, "nation"), F.col("n_regionkey"), "n_nationkey", part, "\n", '<resources tools:locale="en">\n', "\n</resources>")
    units = xml_files.android_units(files)
    told = _told(units, (_number() % 3 == 1) | ((_number() % 3 == 2) & F.col("key").endswith("[0]")))
    return xml_compiling.compile_android(stored(xml_compiling.android_template(files, units)), told, True, "el")


_BETA = '<!-- a<<k>> -->\n<string name="x<<k>>"> </string>\n<string name="s[<<k>>"><<name>></string>\n<string-array name="n<<k>>">\n  <item><<name>></item> <item><<type>></item>\n</string-array>\n<plurals name="p<<k>>">\n  <item quantity="one"><<name>></item>\n  <item quantity="other"><<type>></item>\n</plurals><plurals name="q<<k>>"><item quantity="other">q</item></plurals>'


@query("""WITH u AS (SELECT p_brand AS doc_id, p_partkey AS k, i, CASE i WHEN 0 THEN 's[' || p_partkey WHEN 1 THEN 'n' || p_partkey || '[0]' WHEN 2 THEN 'n' || p_partkey || '[1]' WHEN 3 THEN 'p' || p_partkey ELSE 'q' || p_partkey END AS key,
        CASE i WHEN 3 THEN p_name || '|' || p_type WHEN 2 THEN p_type WHEN 4 THEN 'q' ELSE p_name END AS text FROM parts, range(5) r(i))
    SELECT doc_id, key, text, '' AS developer_comment, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS ord FROM u""")
def q109_beta_android_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older Android parser: a comment goes to the next element even if that has no string; keys are names as they stand."""
    units = xml_files.android_units(part_files(spark, sf_dir, _BETA, *XML), beta=True)
    return units.select("doc_id", "key", F.array_join(F.map_values("strings"), "|").alias("text"), "developer_comment", F.col("ord").cast("bigint").alias("ord"))


@query("""WITH p AS (SELECT p_brand AS doc_id, '<!-- a' || p_partkey || ' -->' || chr(10) || chr(10) || CASE WHEN p_partkey % 3 <> 0 THEN '<string name="s[' || p_partkey || '">el:' || p_name || '</string>' ELSE '' END || chr(10)
        || CASE p_partkey % 4 WHEN 0 THEN '' ELSE '<string-array name="n' || p_partkey || '">' || chr(10) || '  ' || CASE WHEN p_partkey % 4 = 1 THEN '' ELSE '<item>el:' || p_name || '</item>' END || ' <item>el:' || p_type || '</item>' || chr(10) || '</string-array>' END || chr(10)
        || CASE WHEN p_partkey % 5 <> 0 THEN '<plurals name="p' || p_partkey || '">' || chr(10) || '  <item quantity="one">el:' || p_name || '</item>' || chr(10) || '  <item quantity="other">el:' || p_type || '</item>' || chr(10) || '</plurals><plurals name="q' || p_partkey || '"><item quantity="other">el:q</item></plurals>' ELSE '' END AS part, p_partkey AS k FROM parts)
    SELECT doc_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<resources>' || chr(10) || string_agg(part, chr(10) ORDER BY k) || chr(10) || '</resources>' || chr(10) AS content FROM p GROUP BY doc_id""")
def q110_beta_android_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older Android compiler: comments and white space stay where elements go, and arrays without an item go in a second step."""
    files = part_files(spark, sf_dir, _BETA, *XML)
    units = stored(xml_files.android_units(files, beta=True))
    n = F.regexp_extract("key", r"(\d+)", 1).cast("bigint")
    keep = F.when(F.col("key").startswith("s"), n % 3 != 0).when(F.col("key").endswith("[0]"), ~(n % 4).isin(0, 1)).when(F.col("key").endswith("[1]"), n % 4 != 0).otherwise(n % 5 != 0)
    return xml_compiling.compile_beta_android(stored(xml_compiling.android_template(files, units)), _told(units, keep))


_NESTED = ["""<b>"<<n>>" <i x=">'">it's</i></b> \"""", """<b>"<<n>>" <i>it's</b></i>""", '"a" < <<n>>', "<br/>'<<n>>' <z k='v'>@y</z>"]


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '<b>' || b || '"' || p_name || b || '" <i x=">''">it' || b || '''s</i></b> ' || b || '"' WHEN 1 THEN '<b>' || b || '"' || p_name || b || '" <i>it' || b || '''s</b></i>'
        WHEN 2 THEN b || '"a' || b || '" < ' || p_name ELSE '<br/>' || b || '''' || p_name || b || ''' <z k=' || b || '''v' || b || '''>' || b || '@y</z>' END AS escaped FROM part, (SELECT chr(92) AS b)""")
def q111_android_tag_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes are escaped in texts and in tags that are not inline; if tags don't nest, everywhere."""
    text = F.get(F.array(*(filled(t, n="p_name") for t in _NESTED)), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.escape_android(text).alias("escaped"))


_DICT = "<key>k<<k>></key><dict><key>NSStringLocalizedFormatKey</key><string>%#@n@ & more</string><key>n</key><dict><key>NSStringFormatSpecTypeKey</key><string>NSStringPluralRuleType</string> <key>one</key> <string><<name>></string> <key>other</key> <string><<size>> <<type>></string></dict></dict>"
_PLIST = ("\n", '<plist version="1.0">\n<dict>\n', "\n</dict>\n</plist>\n")


@query("""WITH p AS (SELECT p_brand AS doc_id, p_partkey AS k, '<key>k' || p_partkey || '</key><dict><key>NSStringLocalizedFormatKey</key><string>%#@n@ &amp; more</string>'
        || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<key>n</key><dict><key>NSStringFormatSpecTypeKey</key><string>NSStringPluralRuleType</string> <key>one</key><string>el:' || p_name || ' &amp; more</string><key>other</key><string>el:' || p_size || ' ' || p_type || ' &amp; more</string></dict>' END || '</dict>' AS part FROM part)
    SELECT doc_id, '<plist version="1.0">' || chr(10) || '<dict>' || chr(10) || string_agg(part, chr(10) ORDER BY k) || chr(10) || '</dict>' || chr(10) || '</plist>' || chr(10) AS content FROM p GROUP BY doc_id""")
def q55_stringsdict_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = brand_files(spark, sf_dir, _DICT.replace("&", "&amp;"), *_PLIST)
    units = stored(xml_files.stringsdict_units(files))
    return xml_compiling.compile_stringsdict(stored(xml_compiling.stringsdict_template(files, units)), _told(units, _number() % 3 != 0))


@query("""WITH p AS (SELECT n_regionkey AS doc_id, n_nationkey AS k, '<string key="n' || n_nationkey || '"><base>el:' || n_name || '</base><variant context="v">el:' || n_name || ' variant</variant><variant context="w"></variant></string>' AS part FROM nation)
    SELECT doc_id, '<strings><section name="s">' || string_agg(part, '' ORDER BY k) || '</section></strings>' AS content FROM p GROUP BY doc_id""")
def q56_custom_xml_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations are put in by place."""
    part = filled('<string key="n<<k>>"><base><<n>></base><variant context="v"><<n>> variant</variant><variant context="w"></variant></string>', k="n_nationkey", n="n_name")
    files = file_rows(table(spark, sf_dir, "nation"), F.col("n_regionkey"), "n_nationkey", part, "", '<strings><section name="s">', "</section></strings>")
    units = xml_files.custom_units(files)
    return xml_compiling.compile_custom(stored(xml_compiling.android_template(files, units)), _told(units))


_BAD_XML = ["</wrong>", "tail", '<string name="a">2</string>', "<string>x</string>", '<plurals name="p"><item quantity="one">x</item><item quantity="odd">y</item></plurals>', '<string name=\'<<k>>\'><![CDATA[x </string> y]]></string>', '<plurals name="q"><item quantity="one"> </item><item quantity="other">y</item><b/></plurals>', "<open>", '<plurals name="q"><item>y</item></plurals>']


def _bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part, with one of _BAD_XML."""
    rows = table(spark, sf_dir, "part")
    bad = F.get(F.array(*(filled(x, k="p_partkey") if "<<" in x else F.lit(x) for x in _BAD_XML)), (F.col("p_partkey") % len(_BAD_XML)).cast("int"))
    return rows.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit('<resources>\n<string name="a">1</string>\n'), bad, F.lit("\n</resources>")).alias("content"))


@query("""SELECT p_partkey AS doc_id, rule, key, CAST(line AS INT) AS line FROM part, (VALUES
    (0, 'not well formed', 'closing tag of wrong where resources is open', 3), (1, 'trailing text', 'a', 2), (2, 'duplicate name', 'a', 3), (3, 'missing name', NULL, 3),
    (4, 'bad quantity', 'p', 3), (4, 'missing other', 'p', 3), (6, 'wrong tag', 'q', 3), (6, 'partly blank plural', 'q', 3), (7, 'not well formed', 'closing tag of resources where open is open', 4), (8, 'missing quantity', 'q', 3), (8, 'missing other', 'q', 3)) v(n, rule, key, line) WHERE p_partkey % 9 = n""")
def q57_android_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files end as rows beside sound ones."""
    return xml_files.android_problems(_bad_files(spark, sf_dir))


@query("""SELECT p_partkey AS doc_id, CAST(p_partkey AS VARCHAR) AS key, '<![CDATA[x </string> y]]>' AS text FROM part WHERE p_partkey % 9 = 5""")
def q66_android_cdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDATA may hold closing tags, and attributes stand in single quotes."""
    units = xml_files.android_units(_bad_files(spark, sf_dir)).filter("key <> 'a'").filter(F.col("doc_id") == F.expr("try_cast(key as bigint)"))
    return units.select("doc_id", "key", F.element_at("strings", 5).alias("text"))


@query("""SELECT p_brand AS doc_id, 'k' || p_partkey AS key, CASE t WHEN 'string' THEN '' ELSE 'plurals' END AS context, CASE t WHEN 'string' THEN 'about' ELSE '' END AS developer_comment FROM parts, (VALUES ('string'), ('plurals')) v(t) WHERE p_size % 10 <> 0
    UNION ALL SELECT p_brand, 'k' || p_partkey, '', 'about' FROM parts WHERE p_size % 10 = 0""")
def q67_android_clashing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plural of a string's name gets its tag as context; a blank string leaves its comment to what follows."""
    first = F.when(F.col("p_size") % 10 == 0, " ").otherwise(F.col("p_name"))
    part = filled('<!-- about --><string name="k<<k>>"><<f>></string><plurals name="k<<k>>"><item quantity="other"><<n>></item></plurals>', k="p_partkey", f=first, n="p_name")
    units = xml_files.android_units(file_rows(parts(spark, sf_dir), F.col("p_brand"), "p_partkey", part, *XML))
    return units.select("doc_id", "key", "context", "developer_comment")


@query("""SELECT p_partkey, 'x' || replace(replace(p_name, ' ', chr(92) || 'n'), 'a', chr(92) || '@') || '&amp;' || chr(92) || '" <b x="?">' || chr(92) || '?</b><![CDATA[&' || chr(92) || '"]]>' AS escaped, true AS again FROM part""")
def q68_android_raw_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("x"), F.replace(F.replace("p_name", F.lit(" "), F.lit("\n")), F.lit("a"), F.lit("@")), F.lit('&" <b x="?">?</b><![CDATA[&"]]>'))
    done = table(spark, sf_dir, "part").select("p_partkey", own.alias("own"), T.escape_android_raw(own).alias("escaped"))
    return done.select("p_partkey", "escaped", (T.unescape_android_raw(F.col("escaped")) == F.col("own")).alias("again"))


@query("""SELECT p_brand AS doc_id, 'k' || p_partkey AS key, 'unescaped quote' AS rule FROM parts WHERE p_size % 2 = 0""")
def q69_android_unescaped_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("p_size") % 2 == 0, "'").otherwise("\\'")
    part = filled('<string name="k<<k>>"><<n>><<q>> <a href="x">y</a></string>', k="p_partkey", n="p_name", q=mark)
    return xml_files.unescaped_problems(xml_files.android_units(file_rows(parts(spark, sf_dir), F.col("p_brand"), "p_partkey", part, *XML)))


@query("""SELECT doc_id, key, rule, CASE n WHEN 2 THEN place + 2 END AS line FROM (SELECT p_brand AS doc_id, 'k' || p_partkey AS key, p_partkey AS k, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS place FROM parts), (VALUES (0, 'bad rule'), (1, 'missing other'), (2, 'value is no dict')) v(n, rule) WHERE k % 4 = n""")
def q70_stringsdict_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = [f"<dict><key>n</key><dict><key>{a}</key><string>x</string><key>{b}</key><string>y</string></dict></dict>" for a, b in (("odd", "other"), ("one", "two"))] + ["<string>x</string>", "<dict><key>n</key><dict><key>other</key><string>x</string></dict></dict>"]
    part = filled("<key>k<<k>></key><<b>>", k="p_partkey", b=F.get(F.array(*map(F.lit, bad)), (F.col("p_partkey") % 4).cast("int")))
    return xml_files.stringsdict_problems(file_rows(parts(spark, sf_dir), F.col("p_brand"), "p_partkey", part, *_PLIST))


@query("""SELECT n_nationkey AS doc_id, rule, key, line FROM nation, (VALUES (0, 'root not found', 'other', 1), (1, 'missing key', 'x', 3), (2, 'missing section id', NULL, 2)) v(n, rule, key, line) WHERE n_nationkey % 4 = n""")
def q71_custom_xml_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = '\n<section name="s">\n<string{}><base>x</base></string></section>'
    kinds = [f"<other>{inside.format(' key="k"')}</other>", f"<strings>{inside.format('')}</strings>", f"<strings>{inside.format(' key="k"').replace(' name="s"', '')}</strings>", f"<strings>{inside.format(' key="k"')}</strings>"]
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.get(F.array(*map(F.lit, kinds)), (F.col("n_nationkey") % 4).cast("int")).alias("content"))
    return xml_files.custom_problems(files)


@query("""SELECT n_regionkey AS doc_id, 'n' || n_nationkey AS id, n_name AS text, 2 AS depth, 'a&amp;b' AS tail, CAST(position('<i' IN content) AS INT) - 1 + CAST(sum(length(part)) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - length(part) AS INT) AS start FROM (
    SELECT *, '<root><!-- <i/> --><g>' AS head, '<i id="n' || n_nationkey || '">' || n_name || '</i>a&amp;b' AS part, '<root><!-- -i/> --><g><i' AS content FROM nation)""")
def q45_xml_tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements at any depth with their places; those in comments are none."""
    part = filled('<i id="n<<k>>"><<n>></i>a&amp;b', k="n_nationkey", n="n_name")
    files = file_rows(table(spark, sf_dir, "nation"), F.col("n_regionkey"), "n_nationkey", part, "", "<root><!-- <i/> --><g>", "</g></root>")
    found = xml_walk.nodes(files)
    own = xml_walk.children(found, xml_walk.descendants(found, "g"), "i").join(files, "doc_id")
    tail = F.substring("content", F.col("end") + 1, F.col("tail_end") - F.col("end"))
    return own.select("doc_id", F.col("attrs")["id"].alias("id"), F.col("inner").alias("text"), "depth", tail.alias("tail"), "start")


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 9 IN (0, 7) THEN 'broken' ELSE 'sound' END AS state FROM part""")
def q72_files_with_and_without_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _bad_files(spark, sf_dir)
    bad = xml_walk.errors(xml_walk.nodes(files))
    validating.failfast(bad.filter("false")).count()  # no file, no failure
    return files.select("doc_id").join(bad.select("doc_id", F.lit("broken").alias("state")), "doc_id", "left").select("doc_id", F.coalesce("state", F.lit("sound")).alias("state"))
