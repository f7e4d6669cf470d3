"""Queries over Markdown files: blocks, front matter, compiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markdown_compiling
from ..sources import markdown
from .building import file_rows, filled, query, stored, table

_TURN = "# Turn <<t>> #\n\nIt says\n<<t>> by <<r>>.\n\n> quoted <<r>>\n> again\n\n* item <<t>>\n  * inner <<r>>\n* ```\n  no\n  ```\n\nHead | Cell <<t>>\n---- | ----\n<<r>> | 7\n\n```\ncode <<t>>\n\nmore\n```\n\n    indented <<t>>\n\n[name<<t>>]: http://x\n[8]: http://y\n\n{% liquid %}\n\n12.5\n\n<div>html <<t>></div>\n\nTitle <<t>>\n======"
_TEXTS = ("Turn # #", "It says\n# by @.", "> quoted @\n> again", "item #", "inner @", "Head", "Cell #", "@", "```\ncode #\n\nmore\n```", "    indented #", "name#", "<div>html #</div>", "Title #\n======")
_KINDS = ("heading", "paragraph", "quote", "list", "list", "table", "table", "table", "code", "code", "reference", "html", "heading")
_VALUES = ", ".join(f"({k}, '{t.replace(chr(10), '~')}', '{kind}')" for k, (t, kind) in enumerate(zip(_TEXTS, _KINDS, strict=True)))
_SAID = "replace(replace(replace(said, '~', chr(10)), '#', CAST(turn AS VARCHAR)), '@', role)"


def _conversations(spark: SparkSession, sf_dir: str, head: str = "", newline: str = "\n") -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    files = file_rows(rows, F.col("conv_id"), "turn", filled(_TURN, t="turn", r="role"), "\n\n", head)
    return files.withColumn("content", F.replace("content", F.lit("\n"), F.lit(newline))) if newline != "\n" else files


@query(f"""SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS INT) AS ord, CASE i WHEN 0 THEN 'Turn ' || turn || ' #' ELSE {_SAID} END AS text, kind FROM conversations, (VALUES {_VALUES}) v(i, said, kind)""")
def q86_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of block in DOS files; fences in lists, liquid tags and numbers are none."""
    return markdown.units(_conversations(spark, sf_dir, newline="\r\n")).select("doc_id", "ord", "text", "kind")


_HEAD = '---\ntitle: About it\nintro: "quoted: x"\nn: 5\ntext: |\n  two\n  lines\n---\n'


@query(f"""WITH m AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) + 2 AS INT) AS ord, CASE i WHEN 0 THEN 'Turn ' || turn || ' #' ELSE {_SAID} END AS text, kind FROM conversations, (VALUES {_VALUES}) v(i, said, kind))
    SELECT doc_id, CAST(ord AS VARCHAR) AS key, ord, text, kind FROM m UNION ALL
    SELECT DISTINCT conv_id, key, ord, said, 'yaml' FROM conversations, (VALUES ('title', 0, 'About it'), ('intro', 1, 'quoted: x'), ('text', 2, 'two' || chr(10) || 'lines')) v(key, ord, said)""")
def q87_front_matter_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML leaves by path come first, the blocks' order goes on."""
    return markdown.front_matter_units(_conversations(spark, sf_dir, _HEAD)).select("doc_id", "key", "ord", "text", "kind")


@query(f"""WITH s AS (SELECT conv_id AS doc_id, turn, '# el:Turn ' || turn || ' #~~el:It says~' || turn || ' by ' || role || '.~~el:> quoted ' || role || '~> again~~* el:item ' || turn || '~  * el:inner ' || role || '~* ```~  no~  ```~~el:Head | el:Cell ' || turn || '~---- | ----~el:' || role || ' | 7~~el:```~code ' || turn || '~~more~```~~el:    indented ' || turn || '~~[el:name' || turn || ']: http://x~[8]: http://y~~{{% liquid %}}~~12.5~~el:<div>html ' || turn || '</div>~~el:Title ' || turn || '~======' AS part FROM conversations)
    SELECT doc_id, replace('---~title: "el:About it"~intro: "el:quoted: x"~n: 5~text: |~el:two~lines~---~' || string_agg(part, '~~' ORDER BY turn), '~', chr(10)) AS content FROM s GROUP BY doc_id""")
def q88_markdown_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string translated; header strings are quoted, block ones begin on a line of their own."""
    files = _conversations(spark, sf_dir, _HEAD)
    units = markdown.front_matter_units(files)
    told = units.select("doc_id", "placeholder", F.concat(F.lit("el:"), "text").alias("text"), F.when(F.col("kind") == "yaml", F.col("flags")).alias("flags"))
    return markdown_compiling.compile_markdown(stored(markdown_compiling.template(files, units)), told)


@query("""SELECT p_partkey AS doc_id, ord, text FROM (SELECT p_partkey, 0 AS ord, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, '  ' || p_type || chr(10) || '  two' FROM part UNION ALL SELECT p_partkey, 2, 'Body ' || p_brand FROM part)""")
def q89_markdown_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older reading of headers: values line by line, block values whole."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), filled("---\n# no: x\ntitle: <<n>>\ntext: |\n  <<t>>\n  two\nnumber: 5\n---\n\nBody <<b>>\n", n="p_name", t="p_type", b="p_brand").alias("content"))
    return markdown.units(files).select("doc_id", "ord", "text")


@query("""SELECT p_partkey, '"' || p_name || ': x"' AS colon, p_name AS plain, chr(39) || '"' || p_name || chr(39) AS opened, '"' || chr(92) || '"a' || chr(92) || '""' AS flagged, p_name || chr(92) || 'u0008' AS printed, p_name || chr(8) AS again, 2 AS start, 2 + length(p_name) + 4 AS end FROM part""")
def q90_header_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = lambda text, flags="": markdown_compiling.wrapped(text, markdown_compiling.quote_for(text, F.lit(flags)))
    name = F.col("p_name")
    printed = markdown_compiling.escape_unprintable(F.concat(name, F.lit("\x08")))
    span = markdown_compiling.fuzzy_span(F.concat(name, F.lit(" x")), F.concat(F.lit("> "), F.replace(name, F.lit(" "), F.lit("\n")), F.lit("\n  x y")))
    return table(spark, sf_dir, "part").select("p_partkey", quoted(F.concat(name, F.lit(": x"))).alias("colon"), quoted(name).alias("plain"), quoted(F.concat(F.lit('"'), name)).alias("opened"), quoted(F.lit('"a"'), '"').alias("flagged"), printed.alias("printed"), markdown_compiling.unescape_unprintable(printed).alias("again"), span["start"].alias("start"), span["end"].alias("end"))
