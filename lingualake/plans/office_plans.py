"""Queries over Office and InDesign packages: links, runs, writing back, error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import office_compiling
from ..sources import office
from .building import file_rows, filled, query, stored, table


def _part(rows: DataFrame, place: int | Column, part: str | Column, xml: Column) -> DataFrame:
    return rows.select("doc_id", (F.lit(place) if isinstance(place, int) else place).cast("int").alias("place"), (F.lit(part) if isinstance(part, str) else part).alias("part"), xml.alias("xml"))


def _told(units: DataFrame, text: Column) -> DataFrame:
    return units.select("doc_id", "string_hash", "ord", text.alias("text"))


_RELS = '<Relationships><Relationship Id="rId7" Type="styles" Target="styles.xml"/><Relationship Id="rId8" Type="x/hyperlink" Target="http://a.b/?x&amp;y" TargetMode="External"/></Relationships>'
_PARAGRAPH = '<w:p><w:pPr/><w:r><w:t>Turn <<t>></w:t></w:r><w:r><w:t> </w:t></w:r><w:r><w:t>bold &amp; <<r>></w:t></w:r><w:hyperlink r:id="rId8"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:t>end</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p>'


def _docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = file_rows(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", filled(_PARAGRAPH, t="turn", r="role"), "", '<?xml version="1.0"?><w:document><w:body>', "</w:body></w:document>")
    return stored(office.packages(_part(body, 0, "[Content_Types].xml", F.lit("<Types/>")).unionByName(_part(body, 1, "word/document.xml", F.col("content"))).unionByName(_part(body, 2, "word/_rels/document.xml.rels", F.lit(_RELS)))))


_RUNS = """'Turn ' || turn || '<tx> bold & ' || role || '</tx><tx href="http://a.b/?x&y">link</tx>end'"""


@query(f"""SELECT conv_id AS doc_id, {_RUNS} AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ord FROM conversations""")
def q91_docx_runs_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and links are marked, blank runs give their width to the next."""
    return office.docx_units(_docx(spark, sf_dir)).select("doc_id", "text", "ord")


@query("""WITH p AS (SELECT conv_id AS doc_id, turn, '<w:p><w:pPr/><w:r><w:t>el ' || turn || '</w:t></w:r>' || CASE WHEN turn % 2 = 0 THEN '<w:r><w:t> </w:t></w:r><w:r><w:t>fett</w:t></w:r><w:hyperlink r:id="rId8"><w:r><w:t>there</w:t></w:r></w:hyperlink><w:r><w:t>ende &lt; more</w:t></w:r></w:p>'
        ELSE '<w:r></w:r><w:hyperlink r:id="rId' || CAST(8 + row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS INT) || '"><w:r><w:t>fett</w:t></w:r></w:hyperlink><w:r><w:t>plain</w:t></w:r><w:r></w:r></w:p>' END || '<w:p><w:r><w:t> </w:t></w:r></w:p>' AS part FROM conversations)
    SELECT doc_id, '<?xml version="1.0"?><w:document><w:body>' || string_agg(part, '' ORDER BY turn) || '</w:body></w:document>' AS xml, CAST(count(*) FILTER (turn % 2 = 1) AS BIGINT) AS added, bool_or(turn % 2 = 0) AS moved FROM p GROUP BY doc_id""")
def q41_docx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations with as many parts and a new target, and with fewer parts whose link is another run."""
    files = _docx(spark, sf_dir)
    turn = F.regexp_extract("text", r"^Turn (\d+)", 1)
    more = F.concat(F.lit("el "), turn, F.lit('<tx> fett</tx><tx href="http://new">there</tx>ende < more'))
    fewer = F.concat(F.lit("el "), turn, F.lit('<tx href="http://other">fett</tx>plain'))
    told = _told(office.docx_units(files), F.when(turn.cast("int") % 2 == 0, more).otherwise(fewer))
    done = office.parts(office_compiling.compile_docx(files, told))
    rels = office.relations(done).groupBy("doc_id").agg(F.sum((F.col("target") == "http://other").cast("bigint")).alias("added"), F.bool_or(F.col("target") == "http://new").alias("moved"))
    return done.filter("part = 'word/document.xml'").select("doc_id", "xml").join(rels, "doc_id")


@query("""SELECT conv_id AS doc_id, count(*) AS paragraphs, 1 AS tables FROM (SELECT conv_id FROM conversations UNION ALL SELECT conv_id FROM conversations) GROUP BY conv_id""")
def q92_docx_right_to_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = file_rows(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", filled(_PARAGRAPH.replace("<w:pPr/>", "<w:pPr></w:pPr>"), t="turn", r="role"), "", "<w:document><w:body><w:tbl></w:tbl>", "</w:body></w:document>")
    files = stored(office.packages(_part(body, 0, "word/document.xml", F.col("content"))))
    done = office.parts(office_compiling.compile_docx(files, _told(office.docx_units(files), F.col("text")), rtl=True))
    return done.select("doc_id", F.regexp_count("xml", F.lit('<w:pPr><w:bidi w:val="1"/></w:pPr>')).cast("bigint").alias("paragraphs"), F.regexp_count("xml", F.lit("<w:tblPr><w:bidiVisual/></w:tblPr>")).alias("tables"))


_SLIDE = '<p:sld><p:sp><a:p><a:r><a:t>Turn <<t>></a:t></a:r><a:r><a:t>by <<r>></a:t></a:r></a:p></p:sp><p:pic><a:p><a:r><a:t>no</a:t></a:r></a:p></p:pic></p:sld>'


def _pptx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slide for each turn, numbered from behind, and notes that the slide's relationships name."""
    rows = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id"))
    slides = _part(rows, 100 - F.col("turn"), filled("ppt/slides/slide<<t>>.xml", t="turn"), filled(_SLIDE, t="turn", r="role"))
    notes = _part(rows, 200 + F.col("turn"), filled("ppt/notesSlides/notesSlide<<t>>.xml", t=(90 - F.col("turn")).cast("string")), filled("<p:notes><p:sp><a:p><a:r><a:t>Note <<t>></a:t></a:r></a:p></p:sp></p:notes>", t="turn"))
    rels = _part(rows, 300 + F.col("turn"), filled("ppt/slides/_rels/slide<<t>>.xml.rels", t="turn"), filled('<Relationships><Relationship Id="rId2" Type="t/notesSlide" Target="../notesSlides/notesSlide<<t>>.xml"/></Relationships>', t=(90 - F.col("turn")).cast("string")))
    return stored(office.packages(slides.unionByName(notes).unionByName(rels)))


@query("""SELECT conv_id AS doc_id, CASE n WHEN 0 THEN '<tx>Turn ' || turn || '</tx><tx>by ' || role || '</tx>' ELSE 'Note ' || turn END AS text, n = 1 AS notes, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) - 1 AS INT) AS ord FROM conversations, (VALUES (0), (1)) v(n)""")
def q93_pptx_notes_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = office.pptx_units(_pptx(spark, sf_dir))
    return units.select("doc_id", "text", F.coalesce(F.array_contains("tags", "notes"), F.lit(False)).alias("notes"), "ord")


@query("""SELECT conv_id AS doc_id, 'ppt/slides/slide' || turn || '.xml' AS part, '<p:sld><p:sp><a:p><a:r><a:t>el ' || turn || '</a:t></a:r><a:r><a:t>von</a:t></a:r></a:p></p:sp><p:pic><a:p><a:r><a:t>no</a:t></a:r></a:p></p:pic></p:sld>' AS xml FROM conversations
    UNION ALL SELECT conv_id, 'ppt/notesSlides/notesSlide' || (90 - turn) || '.xml', '<p:notes><p:sp><a:p><a:r><a:t>Note ' || turn || '</a:t></a:r></a:p></p:sp></p:notes>' FROM conversations""")
def q94_pptx_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _pptx(spark, sf_dir)
    units = office.pptx_units(files).filter("tags is null")
    told = _told(units, F.concat(F.lit("<tx>el "), F.regexp_extract("text", r"Turn (\d+)", 1), F.lit("</tx><tx>von</tx>")))
    return office.parts(office_compiling.compile_pptx(files, told)).filter("not part like '%.rels'").select("doc_id", "part", "xml")


@query("""SELECT conv_id AS doc_id, '<tx>a' || turn || '</tx><tx> </tx><tx>b</tx>' AS text FROM conversations""".replace("<tx>a' || turn || '</tx>", "a' || turn || '").replace("<tx>b</tx>", "b"))
def q95_pptx_blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other reading of blank runs: they are texts."""
    rows = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id"))
    slides = _part(rows, F.col("turn"), filled("ppt/slides/slide<<t>>.xml", t="turn"), filled("<p:sld><p:graphicFrame><a:p><a:r><a:t>a<<t>></a:t></a:r><a:r><a:t> </a:t></a:r><a:r><a:t>b</a:t></a:r></a:p></p:graphicFrame></p:sld>", t="turn"))
    return office.pptx_units(office.packages(slides), blank_texts=True).select("doc_id", "text")


_SHEET_RELS = '<Relationships><Relationship Id="rId1" Type="t/hyperlink" Target="http://x" TargetMode="External"/></Relationships>'


def _xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation a workbook of a sheet: shared, rich, inline and linked strings, a link formula and numbers."""
    rows = table(spark, sf_dir, "nation").withColumn("doc_id", F.col("n_nationkey"))
    name = {"n": "n_name"}
    cells = '<c r="A1" t="s"><v>0</v></c><c r="A2" t="s"><v>1</v></c><c r="A3" t="inlineStr"><is><t>in <<n>></t></is></c><c r="A4" t="s"><v>0</v></c><c r="A5" t="str"><f>HYPERLINK(&quot;http://y&quot;,&quot;to <<n>>&quot;)</f><v>to <<n>></v></c><c r="A6"><v>1</v></c><c r="A7" t="s"><v>0</v></c>'
    sheet = _part(rows, 3, "xl/worksheets/sheet1.xml", filled(f'<worksheet><sheetData>{cells}</sheetData><hyperlinks><hyperlink ref="A7" r:id="rId1"/></hyperlinks></worksheet>', **name))
    book = _part(rows, 1, "xl/workbook.xml", filled('<workbook><sheets><sheet name="S &amp; <<n>>" sheetId="1"/></sheets></workbook>', **name))
    shared = _part(rows, 2, "xl/sharedStrings.xml", filled("<sst><si><t><<n>></t></si><si><r><t>rich</t></r><r><t>run <<n>></t></r></si></sst>", **name))
    return stored(office.packages(book.unionByName(shared).unionByName(sheet).unionByName(_part(rows, 4, "xl/worksheets/_rels/sheet1.xml.rels", F.lit(_SHEET_RELS)))))


@query("""SELECT n_nationkey AS doc_id, ord, replace(said, '#', n_name) AS text, 'S & ' || n_name AS developer_comment FROM nation, (VALUES (0, 'S & #'), (1, '#'), (2, '<tx>rich</tx><tx>run #</tx>'), (3, 'in #'), (4, '<tx href="http://y">to #</tx>'), (5, '<tx href="http://x">#</tx>')) v(ord, said)""")
def q96_xlsx_links_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.xlsx_units(_xlsx(spark, sf_dir)).select("doc_id", "ord", "text", "developer_comment")


@query("""SELECT n_nationkey AS doc_id, 'xl/workbook.xml' AS part, '<workbook><sheets><sheet name="el S &amp; ' || n_name || '" sheetId="1"/></sheets></workbook>' AS xml FROM nation
    UNION ALL SELECT n_nationkey, 'xl/sharedStrings.xml', '<sst><si><t>el ' || n_name || '</t></si><si><r><t>reich</t></r><r><t>lauf und mehr</t></r></si></sst>' FROM nation
    UNION ALL SELECT n_nationkey, 'xl/worksheets/sheet1.xml', '<worksheet><sheetData><c r="A1" t="s"><v>0</v></c><c r="A2" t="s"><v>1</v></c><c r="A3" t="inlineStr"><is><t>el in ' || n_name || '</t></is></c><c r="A4" t="s"><v>0</v></c><c r="A5" t="str"><f>HYPERLINK(&quot;http://z&quot;,&quot;zu&quot;)</f><v>zu</v></c><c r="A6"><v>1</v></c><c r="A7" t="inlineStr"><is><t>own</t></is></c></sheetData><hyperlinks><hyperlink ref="A7" r:id="rId1"/></hyperlinks></worksheet>' FROM nation""")
def q97_xlsx_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _xlsx(spark, sf_dir)
    said = F.when(F.col("text").startswith("<tx>rich"), "<tx>reich</tx><tx>lauf</tx> und mehr").when(F.col("text").contains("http://y"), '<tx href="http://z">zu</tx>').when(F.col("text").contains("http://x"), '<tx href="http://x">own</tx>').otherwise(F.concat(F.lit("el "), "text"))
    done = office.parts(office_compiling.compile_xlsx(files, _told(office.xlsx_units(files), said)))
    return done.filter("not part like '%.rels'").select("doc_id", "part", "xml")


@query("""SELECT n_nationkey AS doc_id, '<Story><Content> el ' || n_name || ' &amp; &lt;x <Br/> </Content><Content>12</Content><Content></Content></Story>' AS xml, 1 AS listed FROM nation
    UNION ALL SELECT n_nationkey, '<Story><Content>el rest</Content></Story>', 0 FROM nation""")
def q98_idml_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories get their texts; what has none becomes empty, and a story that the map doesn't list comes last."""
    rows = table(spark, sf_dir, "nation").withColumn("doc_id", F.col("n_nationkey"))
    stories = _part(rows, 2, "Stories/Story_b.xml", filled("<Story><Content> <<n>> </Content><Content>12</Content><Content>gone</Content></Story>", n="n_name")).unionByName(_part(rows, 1, "Stories/Story_a.xml", F.lit("<Story><Content>rest</Content></Story>")))
    files = office.packages(_part(rows, 0, "designmap.xml", F.lit('<Document StoryList="b"/>')).unionByName(stories))
    units = office.idml_units(files)
    told = units.filter("text <> 'gone'").select("doc_id", "placeholder", F.concat(F.lit("el "), "text", F.when(F.col("ord") == 0, " & <x <Br/>").otherwise("")).alias("text"))
    done = office.parts(office_compiling.compile_idml(stored(office_compiling.idml_template(files, units)), told)).filter("part like 'Stories/%'")
    return done.select("doc_id", "xml", F.col("part").contains("_b").cast("int").alias("listed"))


@query("""SELECT n_nationkey AS doc_id, CASE n_nationkey % 3 WHEN 0 THEN 'no package' ELSE 'missing part' END AS rule FROM nation WHERE n_nationkey % 3 < 2""")
def q99_office_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is no package, or lacks its document, ends as a row beside sound ones."""
    rows = table(spark, sf_dir, "nation").withColumn("doc_id", F.col("n_nationkey"))
    sound = office.packages(_part(rows, 0, F.when(F.col("doc_id") % 3 == 1, "other.xml").otherwise("word/document.xml"), F.lit("<w:document/>")))
    files = sound.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(b"no zip")).otherwise(F.col("content")).alias("content"))
    return office.problems(files, "word/document.xml").select("doc_id", "rule")


def _package(rows: DataFrame, **parts: str) -> DataFrame:
    """Packages of the parts, given by number of place: a name and, after a blank, a template over the nation's name."""
    out = None
    for place, text in enumerate(parts.values()):
        name, _, xml = text.partition(" ")
        one = _part(rows, place, name, filled(xml, n="n_name"))
        out = one if out is None else out.unionByName(one)
    return stored(office.packages(out))


def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").withColumn("doc_id", F.col("n_nationkey"))


_MAIN = '_rels/.rels <Relationships><Relationship Id="r1" Type="http://x/officeDocument" Target="/doc/main.xml"/></Relationships>'


@query("""SELECT n_nationkey AS doc_id, 'doc/main.xml' AS part, '<w:p><w:hyperlink r:id="rId8"><w:r><w:t>el:' || n_name || '</w:t></w:r></w:hyperlink></w:p>' AS xml FROM nation
    UNION ALL SELECT n_nationkey, 'word/document.xml', '<w:p><w:r><w:t>decoy</w:t></w:r></w:p>' FROM nation UNION ALL SELECT n_nationkey, 'target', 'http://new' FROM nation""")
def q117_docx_by_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document lies where the package's relationships say, with its own relationships beside it."""
    paragraph = '<w:p><w:hyperlink r:id="rId8"><w:r><w:t><<n>></w:t></w:r></w:hyperlink></w:p>'
    files = _package(_by_nation(spark, sf_dir), a=_MAIN, b=f"doc/main.xml {paragraph}", c=f"doc/_rels/main.xml.rels {_RELS}", d="word/document.xml <w:p><w:r><w:t>decoy</w:t></w:r></w:p>")
    units = office.docx_units(files)
    told = _told(units, F.concat(F.lit('<tx href="http://new">el:'), F.regexp_extract("text", ">(.*)<", 1), F.lit("</tx>")))
    done = office.parts(office_compiling.compile_docx(files, told))
    moved = office.relations(done).filter("external").select("doc_id", F.lit("target").alias("part"), F.col("target").alias("xml"))
    return done.filter("part in ('doc/main.xml', 'word/document.xml')").select("doc_id", "part", "xml").unionByName(moved)


_TYPES = "".join(f'<Override PartName="/book/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{t}+xml"/>' for p, t in (("wb.xml", "sheet.main"), ("strings.xml", "sharedStrings"), ("s/first7.xml", "worksheet"), ("s/other.xml", "worksheet")))


@query("""SELECT n_nationkey AS doc_id, ord, replace(said, '#', n_name) AS text, about AS developer_comment FROM nation, (VALUES (0, 'one', 'one'), (1, 'two', 'two'), (2, '#', 'one, two'), (3, 'in #', 'two')) v(ord, said, about)""")
def q118_xlsx_by_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook, strings and sheets lie where the content types say; a sheet without a number comes last, a decoy is not read."""
    sheet = "<worksheet><sheetData>{}</sheetData></worksheet>"
    shared = '<c r="A1" t="s"><v>0</v></c>'
    files = _package(
        _by_nation(spark, sf_dir), a=f"[Content_Types].xml <Types>{_TYPES}</Types>", b='book/wb.xml <workbook><sheets><sheet name="one"/><sheet name="two"/></sheets></workbook>', c="book/strings.xml <sst><si><t><<n>></t></si></sst>", d=f"book/s/first7.xml {sheet.format(shared)}",
        e=f"book/s/other.xml {sheet.format(shared + '<c r=@A2@ t=@inlineStr@><is><t>in <<n>></t></is></c>'.replace('@', chr(34)))}", f="xl/sharedStrings.xml <sst><si><t>decoy</t></si></sst>",
    )
    return office.xlsx_units(files).select("doc_id", "ord", "text", "developer_comment")


@query("""SELECT n_nationkey AS doc_id, '<w:document><w:p><w:hyperlink r:id="rId9"><w:r><w:rPr><w:color/></w:rPr><w:t>el:' || n_name || '</w:t></w:r></w:hyperlink><w:r><w:rPr><w:b/></w:rPr><w:t>plain</w:t></w:r></w:p>'
    || '<w:p><w:hyperlink r:id="rId10"><w:r><w:rPr><w:i/></w:rPr><w:t>x</w:t></w:r></w:hyperlink><w:hyperlink r:id="rId11"><w:r><w:rPr><w:i/></w:rPr><w:t>y</w:t></w:r></w:hyperlink><w:r><w:t>z</w:t></w:r></w:p></w:document>' AS xml, 3 AS added FROM nation""")
def q119_docx_swapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link that moves to another run takes the look of the run it leaves; of two texts that gain it and one that loses it the last look serves both."""
    one = '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t><<n>></w:t></w:r><w:hyperlink r:id="rId8"><w:r><w:rPr><w:color/></w:rPr><w:t>link</w:t></w:r></w:hyperlink></w:p>'
    two = '<w:p><w:r><w:t>a</w:t></w:r><w:r><w:rPr><w:u/></w:rPr><w:t>b</w:t></w:r><w:hyperlink r:id="rId8"><w:r><w:rPr><w:i/></w:rPr><w:t>c</w:t></w:r></w:hyperlink></w:p>'
    files = _package(_by_nation(spark, sf_dir), a=f"word/document.xml <w:document>{one}{two}</w:document>", b=f"word/_rels/document.xml.rels {_RELS}")
    name = F.regexp_extract("text", "^<tx>(.*?)</tx>", 1)
    said = F.when(F.col("text").startswith("<tx>"), F.concat(F.lit('<tx href="http://new">el:'), name, F.lit("</tx>plain"))).otherwise('<tx href="http://n2">x<tx>y</tx></tx>z')
    done = office.parts(office_compiling.compile_docx(files, _told(office.docx_units(files), said)))
    added = office.relations(done).filter(F.col("target").isin("http://new", "http://n2")).groupBy("doc_id").agg(F.count("*").cast("int").alias("added"))
    return done.filter("part = 'word/document.xml'").select("doc_id", "xml").join(added, "doc_id")


@query("""SELECT n_nationkey AS doc_id, '<p:sld><p:sp><a:p><a:r><a:rPr><a:hlinkClick r:id="rId1"/></a:rPr><a:t>el:' || n_name || '</a:t></a:r><a:r><a:rPr b="1"></a:rPr><a:t>plain</a:t></a:r></a:p><a:p><a:r><a:rPr lang="en"><a:hlinkClick r:id="rId3"/></a:rPr><a:t>p2</a:t></a:r></a:p></p:sp></p:sld>' AS xml,
    'rId1=http://new rId2=n rId3=http://p2' AS relations FROM nation""")
def q120_pptx_new_and_moved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link that moves within a paragraph keeps its relationship, with the new target; a new link gets one of its own."""
    slide = '<p:sld><p:sp><a:p><a:r><a:rPr b="1"></a:rPr><a:t><<n>></a:t></a:r><a:r><a:rPr><a:hlinkClick r:id="rId1"/></a:rPr><a:t>link</a:t></a:r></a:p><a:p><a:r><a:rPr lang="en"/><a:t>only</a:t></a:r></a:p></p:sp></p:sld>'
    rels = '<Relationships><Relationship Id="rId1" Type="x/hyperlink" Target="http://old" TargetMode="External"/><Relationship Id="rId2" Type="x/layout" Target="n"/></Relationships>'
    files = _package(_by_nation(spark, sf_dir), a=f"ppt/slides/slide1.xml {slide}", b=f"ppt/slides/_rels/slide1.xml.rels {rels}")
    name = F.regexp_extract("text", "^<tx>(.*?)</tx>", 1)
    said = F.when(F.col("text") == "only", '<tx href="http://p2">p2</tx>').otherwise(F.concat(F.lit('<tx href="http://new">el:'), name, F.lit("</tx>plain")))
    done = office.parts(office_compiling.compile_pptx(files, _told(office.pptx_units(files), said)))
    listed = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "id", "target"))), " ").alias("relations")
    return done.filter("part = 'ppt/slides/slide1.xml'").select("doc_id", "xml").join(office.relations(done).groupBy("doc_id").agg(listed), "doc_id")
