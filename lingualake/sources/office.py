"""Office and InDesign packages: zip parts become rows, their XML node rows, and paragraphs, cells and stories plans over these.

Part rows are (doc_id, place, part, xml). In a paragraph's text `<tx>` marks runs, with `href` runs of an outside
link. Units have the text as key, so equal paragraphs share a hash.

Cases: a content that is null or no zip archive gives one part without a name, which problems() reports. A part that
is no XML has no paragraphs. Parts that are not text, pictures for one, are kept as bytes. An empty table gives no rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.joins import dealt
from ..storing import stored
from . import xml_walk

_PARTS = pa.schema([("place", pa.int32()), ("part", pa.string()), ("xml", pa.string()), ("raw", pa.binary())])


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owners, rows = [], []
        for i, data in enumerate(batch.column("content").to_pylist()):
            own: list[tuple] = []
            try:
                with zipfile.ZipFile(io.BytesIO(data or b"")) as package:
                    for k, name in enumerate(package.namelist()):
                        raw = package.read(name)
                        try:
                            own.append((k, name, raw.decode(), None))
                        except UnicodeDecodeError:
                            own.append((k, name, None, raw))
            except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, RuntimeError) as e:
                own = [(0, None, str(e), None)]
            owners += [i] * len(own)
            rows += own
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owners, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, _PARTS, strict=True))], ["doc_id", *_PARTS.names])


def all_parts(files: DataFrame) -> DataFrame:
    """Rows (doc_id, place, part, xml, raw) of each package of `files` (doc_id, content binary); `raw` has the bytes of parts that are no text."""
    return files.select("doc_id", "content").mapInArrow(_unzip, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, place int, part string, xml string, raw binary")


def parts(files: DataFrame) -> DataFrame:
    """Rows (doc_id, place, part, xml) of the text parts of sound packages."""
    return all_parts(files).filter("part is not null and xml is not null").drop("raw")


def problems(files: DataFrame, *needed: str) -> DataFrame:
    """Rows (doc_id, rule, message) of contents that are no zip archive, or lack a part named in `needed`."""
    found = all_parts(files)
    bad = found.filter("part is null").select("doc_id", F.lit("no package").alias("rule"), F.col("xml").alias("message"))
    names = found.filter("part is not null").groupBy("doc_id").agg(F.collect_set("part").alias("names"))
    lacking = names.select("doc_id", F.explode(F.array_except(F.array(*map(F.lit, needed)).cast("array<string>"), "names")).alias("message"))
    return bad.unionByName(lacking.select("doc_id", F.lit("missing part").alias("rule"), "message"))


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for entries in batch.column("parts").to_pylist():
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as package:
                for entry in entries:
                    package.writestr(zipfile.ZipInfo(entry["part"]), entry["xml"] if entry["xml"] is not None else entry["raw"])
            out.append(held.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "content"])


def packages(rows: DataFrame) -> DataFrame:
    """Packages (doc_id, content) of parts (doc_id, place, part, xml, and raw for bytes), in order of place."""
    rows = rows if "raw" in rows.columns else rows.withColumn("raw", F.lit(None).cast("binary"))
    grouped = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "part", "xml", "raw"))).alias("parts"))
    return grouped.mapInArrow(_zip, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content binary")


def nodes(found: DataFrame, *whole: str) -> DataFrame:
    """The node rows of part rows, with place and part."""
    keyed = found.select(F.struct("doc_id", "place", "part").alias("doc_id"), F.col("xml").alias("content"))
    return xml_walk.nodes(keyed, *whole).select("doc_id.*", *(c.split()[0] for c in xml_walk.NODES.split(", ") if "<" not in c), "attrs", "up", "above").filter("kind <> 'error'")


def rels_path(part: Column) -> Column:
    """Where a part's relationships are."""
    return F.regexp_replace(part, r"([^/]+)$", "_rels/$1.rels")


def relations(found: DataFrame) -> DataFrame:
    """Rows (doc_id, rels, id, target, type, external) of all relationships; `rels` is the part they stand in."""
    rows = nodes(found.filter(F.col("part").endswith(".rels"))).filter("tag = 'Relationship'")
    return rows.select("doc_id", F.col("part").alias("rels"), F.col("attrs")["Id"].alias("id"), T.unescape_xml(F.col("attrs")["Target"]).alias("target"), F.col("attrs")["Type"].alias("type"), F.coalesce(F.col("attrs")["TargetMode"] == "External", F.lit(False)).alias("external"))


_DOCX = {"p": "w:p", "r": "w:r", "t": "w:t"}
_PPTX = {"p": "a:p", "r": "a:r", "t": "a:t"}


def _around(tag: str) -> Column:
    """The seq of the innermost element `tag` around a node."""
    return F.when(F.array_contains("above", tag), F.get("up", F.size("above") - F.array_position(F.reverse("above"), tag).cast("int")))


def runs(found: DataFrame, links: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows of the texts of each paragraph: p, index, count, text, url, run, link and the places; `links` has (doc_id, place, run, link, rid)."""
    every = nodes(found)
    texts = every.filter(F.col("tag") == names["t"]).withColumns({"p": _around(names["p"]), "run": _around(names["r"]), "text": T.unescape_xml(F.coalesce("inner", F.lit("")))}).filter("p is not null")
    order = Window.partitionBy("doc_id", "place", "p")
    texts = texts.withColumns({"index": F.row_number().over(order.orderBy("seq")) - 1, "count": F.count("*").over(order)})
    outside = relations(found).filter("external").select("doc_id", "rels", F.col("id").alias("rid"), F.col("target").alias("url"))
    rows = texts.withColumn("rels", rels_path(F.col("part"))).join(dealt(links), ["doc_id", "place", "run"], "left").join(dealt(outside), ["doc_id", "rels", "rid"], "left")
    return rows.select("doc_id", "place", "part", "rels", "p", "index", "count", "text", "url", "rid", "run", "link", "seq", "start", "open_end", "close_start", "end", "up", "above")


def docx_links(found: DataFrame) -> DataFrame:
    """Runs right inside of a hyperlink, with its seq and relationship."""
    every = nodes(found)
    inside = every.filter("tag = 'w:r'").select("doc_id", "place", F.col("seq").alias("run"), F.col("parent").alias("link"))
    return inside.join(dealt(every.filter("tag = 'w:hyperlink'").select("doc_id", "place", F.col("seq").alias("link"), F.col("attrs")["r:id"].alias("rid"))), ["doc_id", "place", "link"])


def pptx_links(found: DataFrame) -> DataFrame:
    """Runs whose properties have a link to click, with its seq and relationship."""
    clicks = nodes(found).filter("tag = 'a:hlinkClick' and size(up) > 1")
    return clicks.select("doc_id", "place", F.get("up", F.size("up") - 2).alias("run"), F.col("seq").alias("link"), F.col("attrs")["r:id"].alias("rid"))


def paragraphs(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, place, part, p, text) of each filled paragraph: the texts of its runs with `<tx>` marks.

    Blank texts give their width to the text after them. Texts between the first and last, and both of two, are
    marked, and what an outside link covers.
    """
    key = ("doc_id", "place", "p")
    before = Window.partitionBy(*key).orderBy("index")
    filled = T.strip(F.col("text")) != ""
    rows = texts.withColumn("filled", filled).withColumn("island", F.coalesce(F.sum(F.col("filled").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("spaces", F.sum(F.when(F.col("filled"), 0).otherwise(F.length("text"))).over(Window.partitionBy(*key, "island")))
    rows = rows.filter("filled and run is not null").withColumns({"open": F.lag("url").over(before), "next": F.lead("index").over(before)})
    body = F.concat(F.repeat(F.lit(" "), F.col("spaces").cast("int")), "text")
    same = F.col("url").isNull() | F.col("url").eqNullSafe(F.col("open"))
    marked = F.when(((F.col("count") == 2) | ((F.col("index") > 0) & (F.col("index") < F.col("count") - 1))) & same, F.concat(F.lit("<tx>"), body, F.lit("</tx>"))).otherwise(body)
    starts = F.concat(F.lit('<tx href="'), "url", F.lit('">'))
    head = F.when(F.col("url").isNotNull() & F.col("open").isNull(), starts).when(F.col("url").isNull() & F.col("open").isNotNull(), "</tx>").when(F.col("url") != F.col("open"), F.concat(F.lit("</tx>"), starts)).otherwise("")
    tail = F.when(F.col("next").isNull() & F.col("url").isNotNull(), "</tx>").otherwise("")
    listed = rows.groupBy("doc_id", "place", "part", "p").agg(F.sort_array(F.collect_list(F.struct("index", F.concat(head, marked, tail).alias("x")))).alias("xs"))
    return listed.select("doc_id", "place", "part", "p", F.array_join(F.transform("xs", lambda x: x["x"]), "").alias("text")).filter(T.strip(F.col("text")) != "")


def _units(rows: DataFrame, order: tuple[str, ...], *extra: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    hashed = T.string_hash(F.col("text"))
    return rows.select("doc_id", F.col("text").alias("key"), "text", number.alias("ord"), hashed.alias("string_hash"), T.placeholder(hashed).alias("placeholder"), *extra)


def renamed(found: DataFrame, names: DataFrame) -> DataFrame:
    """Parts by the names that the rest of this module knows: `names` has (doc_id, part, name).

    In packages that `names` has rows of, other parts get names that nothing looks for; packages without keep theirs.
    """
    told = names.groupBy("doc_id", "part").agg(F.min("name").alias("_name"))
    rows = found.join(dealt(told), ["doc_id", "part"], "left").join(dealt(names.select("doc_id", F.lit(True).alias("_told")).distinct()), "doc_id", "left")
    return rows.withColumn("part", F.coalesce("_name", F.when(F.col("_told"), F.concat(F.lit("-/"), "part")), "part")).select("doc_id", "place", "part", "xml")


def _base(part: Column) -> Column:
    return F.substring_index(part, "/", -1)


def with_relations(names: DataFrame) -> DataFrame:
    """`names` with those of the parts that hold their relationships."""
    return names.unionByName(names.select("doc_id", rels_path(F.col("part")).alias("part"), rels_path(F.col("name")).alias("name")))


def main_parts(found: DataFrame, name: str) -> DataFrame:
    """`name` for the part that a package's relationships say is its document."""
    main = relations(found.filter("part = '_rels/.rels'")).filter(F.col("type").endswith("/officeDocument"))
    return with_relations(main.select("doc_id", F.regexp_replace("target", r"^(\./|/)+", "").alias("part"), F.lit(name).alias("name")))


def typed_parts(found: DataFrame, **folders: str) -> DataFrame:
    """Names for the parts whose content type, as the package lists it, ends in one of `folders` and `+xml`; a folder's end is kept or is the name."""
    listed = nodes(found.filter("part = '[Content_Types].xml'")).filter("tag = 'Override'")
    listed = listed.select("doc_id", F.regexp_replace(F.col("attrs")["PartName"], "^/", "").alias("part"), F.regexp_extract(F.col("attrs")["ContentType"], r"([A-Za-z.]+)\+xml$", 1).alias("type"))
    name = F.coalesce(*(F.when(F.col("type").endswith(f".{kind.replace('_', '.')}"), F.concat(F.lit(to), _base(F.col("part"))) if to.endswith("/") else F.lit(to)) for kind, to in folders.items()))
    return with_relations(listed.select("doc_id", "part", name.alias("name")).filter("name is not null"))


def docx_parts(files: DataFrame) -> DataFrame:
    """The document, wherever the package's relationships say it lies, and its relationships."""
    found = parts(files)
    return renamed(found, main_parts(found, "word/document.xml")).filter("part in ('word/document.xml', 'word/_rels/document.xml.rels')")


def docx_units(files: DataFrame) -> DataFrame:
    """One unit for each filled paragraph; its text is its key."""
    found = stored(docx_parts(files))
    return _units(paragraphs(runs(found, docx_links(found), _DOCX)), ("place", "p"))


def pptx_parts(files: DataFrame) -> DataFrame:
    """Slides, notes and their relationships."""
    found = parts(files)
    return renamed(found, typed_parts(found, slide="ppt/slides/", notesSlide="ppt/notesSlides/")).filter(F.col("part").rlike(r"^ppt/(slides|notesSlides)/(_rels/)?[A-Za-z]+\d+\.xml(\.rels)?$"))


def slide_order(found: DataFrame) -> DataFrame:
    """Rows (doc_id, part, slide, notes): slides by their number, each with the first notes that its relationships name."""
    number = F.regexp_extract("part", r"ppt/slides/slide(\d+)\.xml$", 1)
    slides = found.filter(number != "").select("doc_id", "part", number.cast("int").alias("slide"))
    notes = relations(found).filter(F.col("type").endswith("/notesSlide")).select("doc_id", "rels", "id", F.concat(F.lit("ppt/notesSlides/"), _base(F.col("target"))).alias("to"))
    first = notes.groupBy("doc_id", "rels").agg(F.min_by("to", F.expr("try_cast(regexp_extract(id, '[0-9]+', 0) as int)")).alias("to"))
    noted = slides.withColumn("rels", rels_path(F.col("part"))).join(dealt(first), ["doc_id", "rels"]).select("doc_id", F.col("to").alias("part"), "slide")
    return slides.withColumn("notes", F.lit(False)).unionByName(noted.withColumn("notes", F.lit(True)))


def pptx_texts(files: DataFrame) -> DataFrame:
    """The runs of the paragraphs in shapes and frames of slides and notes."""
    found = stored(pptx_parts(files))
    return runs(found, pptx_links(found), _PPTX).filter(F.array_contains("above", "p:sp") | F.array_contains("above", "p:graphicFrame"))


def pptx_units(files: DataFrame, blank_texts: bool = False) -> DataFrame:
    """Paragraphs of the slides by slide number, each slide's notes after it, tagged so.

    With `blank_texts` blank runs are texts like others instead of leading space.
    """
    texts = pptx_texts(files)
    texts = texts.withColumn("text", F.when(T.strip(F.col("text")) == "", F.concat(F.lit(""), "text")).otherwise(F.col("text"))) if blank_texts else texts
    rows = (with_blanks(texts) if blank_texts else paragraphs(texts)).join(dealt(slide_order(pptx_parts(files))), ["doc_id", "part"])
    return _units(rows.withColumn("tags", F.when(F.col("notes"), F.array(F.lit("notes")))), ("slide", "notes", "p"), "tags")


def with_blanks(texts: DataFrame) -> DataFrame:
    """As paragraphs(), but blank runs are marked like others; a paragraph of blank runs alone is none."""
    rows = texts.filter("run is not null")
    order = Window.partitionBy("doc_id", "place", "p").orderBy("index")
    rows = rows.withColumns({"open": F.lag("url").over(order), "next": F.lead("index").over(order)})
    same = F.col("url").isNull() | F.col("url").eqNullSafe(F.col("open"))
    marked = F.when(((F.col("count") == 2) | ((F.col("index") > 0) & (F.col("index") < F.col("count") - 1))) & same, F.concat(F.lit("<tx>"), "text", F.lit("</tx>"))).otherwise(F.col("text"))
    starts = F.concat(F.lit('<tx href="'), "url", F.lit('">'))
    head = F.when(F.col("url").isNotNull() & F.col("open").isNull(), starts).when(F.col("url").isNull() & F.col("open").isNotNull(), "</tx>").when(F.col("url") != F.col("open"), F.concat(F.lit("</tx>"), starts)).otherwise("")
    tail = F.when(F.col("next").isNull() & F.col("url").isNotNull(), "</tx>").otherwise("")
    listed = rows.groupBy("doc_id", "place", "part", "p").agg(F.sort_array(F.collect_list(F.struct("index", F.concat(head, marked, tail).alias("x")))).alias("xs"))
    return listed.select("doc_id", "place", "part", "p", F.array_join(F.transform("xs", lambda x: x["x"]), "").alias("text")).filter(T.strip(F.regexp_replace("text", "</?tx[^>]*>", "")) != "")


def wrapped(text: Column, url: Column | None = None) -> Column:
    """A part of a cell's text in `<tx>`, with the link it has."""
    return F.concat(F.lit("<tx>") if url is None else F.concat(F.lit('<tx href="'), url, F.lit('">')), text, F.lit("</tx>"))


def xlsx_parts(files: DataFrame) -> DataFrame:
    """The workbook, shared strings and sheets, wherever the package's content types say they lie, and their relationships."""
    found = parts(files)
    names = typed_parts(found, sheet_main="xl/workbook.xml", sharedStrings="xl/sharedStrings.xml", worksheet="xl/worksheets/")
    return renamed(found, names).filter(F.col("part").rlike(r"^xl/(workbook|sharedStrings|worksheets/[^/]+|worksheets/_rels/[^/]+)\.xml(\.rels)?$|^xl/worksheets/_rels/"))


def xlsx_nodes(found: DataFrame) -> DataFrame:
    """The node rows of a package's parts, written once, as several plans read them."""
    return stored(nodes(found, "si", "c"))


def xlsx_sheets(found: DataFrame, every: DataFrame) -> DataFrame:
    """Rows (doc_id, part, sheet, name): worksheets by number, those without one last, with the workbook's names in order."""
    number = F.expr(r"try_cast(regexp_extract(part, '(\\d+)\\.xml$', 1) as int)")
    sheets = found.filter(F.col("part").rlike(r"^xl/worksheets/[^/]+\.xml$")).select("doc_id", "part", number.alias("_n"))
    sheets = sheets.withColumn("sheet", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("_n").asc_nulls_last(), "part"))).drop("_n")
    named = every.filter("part = 'xl/workbook.xml' and tag = 'sheet'")
    named = named.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).alias("sheet"), T.unescape_xml(F.col("attrs")["name"]).alias("name"))
    return sheets.join(dealt(named), ["doc_id", "sheet"], "left").withColumn("name", F.coalesce("name", F.col("sheet").cast("string")))


def xlsx_texts(found: DataFrame, every: DataFrame) -> DataFrame:
    """Rows (doc_id, text, sheet, name, seq, url, at, owner): what cells show; `at` is the part and `owner` the element whose `t` texts hold it.

    Cells refer to shared strings, hold inline strings, or show a link's text by formula. An outside link of a
    cell covers its whole text.
    """
    ts = every.filter("tag = 't'").select("doc_id", "part", F.coalesce(_around("si"), _around("c")).alias("owner"), "seq", T.unescape_xml(F.coalesce("inner", F.lit(""))).alias("t"))
    texts = ts.filter("owner is not null").groupBy("doc_id", "part", "owner").agg(F.sort_array(F.collect_list(F.struct("seq", "t"))).alias("ts"))
    joined = F.array_join(F.transform("ts", lambda x: F.when(F.size("ts") > 1, wrapped(x["t"])).otherwise(x["t"])), "")
    texts = texts.select("doc_id", F.col("part").alias("at"), "owner", joined.alias("text"))
    shared = every.filter("part = 'xl/sharedStrings.xml' and tag = 'si'").select("doc_id", F.col("seq").alias("owner"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).alias("idx"))
    cells = every.filter("tag = 'c'").filter(F.col("attrs")["t"].isin("s", "inlineStr", "str")).select("doc_id", "part", F.col("seq").alias("cell"), F.col("attrs")["r"].alias("ref"), F.col("attrs")["t"].alias("kind"))
    held = every.filter("tag in ('v', 'f')").groupBy("doc_id", "part", F.col("parent").alias("cell")).agg(F.max(F.when(F.col("tag") == "v", F.col("inner"))).alias("v"), F.max(F.when(F.col("tag") == "f", F.col("inner"))).alias("f"))
    cells = cells.join(dealt(held), ["doc_id", "part", "cell"], "left")
    links = every.filter("tag = 'hyperlink'").select("doc_id", "part", F.col("attrs")["ref"].alias("ref"), F.col("attrs")["r:id"].alias("id"), rels_path(F.col("part")).alias("rels"))
    links = links.join(dealt(relations(found).filter("external")), ["doc_id", "rels", "id"]).select("doc_id", "part", "ref", F.col("target").alias("url"))
    cells = cells.join(dealt(links), ["doc_id", "part", "ref"], "left").join(dealt(xlsx_sheets(found, every)), ["doc_id", "part"])
    by_index = cells.filter("kind = 's'").withColumn("idx", F.expr("try_cast(v as int)")).join(dealt(shared), ["doc_id", "idx"]).withColumn("at", F.lit("xl/sharedStrings.xml")).drop("idx")
    own = cells.filter("kind = 'inlineStr' or (kind = 'str' and f is null)").withColumns({"owner": F.col("cell"), "at": F.col("part")})
    plain = by_index.unionByName(own).join(dealt(texts), ["doc_id", "at", "owner"]).withColumn("text", F.when(F.col("url").isNotNull(), wrapped(F.col("text"), F.col("url"))).otherwise(F.col("text")))
    formula = r'HYPERLINK\("(.*?)","(.*?)"\)'
    shown = cells.filter("kind = 'str' and f is not null").withColumns({"f": T.unescape_xml(F.replace("f", F.lit("&quot;"), F.lit('"'))), "owner": F.col("cell"), "at": F.col("part")})
    shown = shown.filter(F.regexp_extract("f", formula, 2) != "").withColumn("text", wrapped(F.regexp_extract("f", formula, 2), F.regexp_extract("f", formula, 1)))
    columns = ("doc_id", "text", "sheet", "name", F.col("cell").alias("seq"), "url", "at", "owner", "part", "kind")
    return plain.select(*columns).unionByName(shown.select(*columns)).filter("text <> ''")


def xlsx_units(files: DataFrame) -> DataFrame:
    """One unit for each distinct text of sheet names and cells, with the names of the sheets it is on, in order of first sight."""
    found = stored(xlsx_parts(files))
    every = xlsx_nodes(found)
    named = every.filter("part = 'xl/workbook.xml' and tag = 'sheet'")
    names = named.select("doc_id", T.unescape_xml(F.col("attrs")["name"]).alias("text"), F.lit(0).alias("sheet"), "seq").withColumn("name", F.col("text"))
    rows = names.unionByName(xlsx_texts(found, every).select("doc_id", "text", "sheet", "seq", "name"))
    merged = rows.groupBy("doc_id", "text").agg(F.min(F.struct("sheet", "seq")).alias("first"), F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "seq", "name"))), lambda x: x["name"])), ", ").alias("developer_comment"))
    return _units(merged, ("first",), "developer_comment")


def idml_texts(files: DataFrame) -> DataFrame:
    """Rows (doc_id, place, part, rank, seq, raw, text, start) of all contents of the stories: listed ones in the map's order, then the others by name."""
    found = parts(files)
    listed = found.filter("part = 'designmap.xml'").select("doc_id", F.posexplode(F.split(F.regexp_extract("xml", r'StoryList="([^"]*)"', 1), r"\s+")).alias("rank", "story"))
    stories = found.withColumn("story", F.regexp_extract("part", r"^Stories/Story_(.*)\.xml$", 1)).filter("story <> ''")
    ranked = stories.join(dealt(listed), ["doc_id", "story"], "left").withColumn("rank", F.coalesce("rank", F.lit(1 << 30)))
    whole = F.regexp_extract_all("xml", F.lit(r"(?s)(?:(?!<Content>).)*(?:<Content>(?:(?!</Content>).)*</Content>)?"), F.lit(0))
    pieces = ranked.select("doc_id", "place", "part", "rank", F.posexplode(F.filter(whole, lambda x: x != "")).alias("seq", "piece"))
    before = Window.partitionBy("doc_id", "place").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    raw = F.regexp_extract("piece", r"(?s)<Content>(.*)</Content>$", 1)
    rows = pieces.filter(F.col("piece").endswith("</Content>")).withColumn("raw", raw)
    text = T.strip(F.col("raw"))
    lead = F.length(F.regexp_extract("raw", r"(?U)^\s*", 0))
    start = F.col("at") + F.length("piece") - F.length(F.lit("</Content>")) - F.length("raw") + lead
    return rows.select("doc_id", "place", "part", "rank", "seq", "raw", text.alias("text"), start.cast("int").alias("start"))


def idml_units(files: DataFrame) -> DataFrame:
    """The contents in order; marks, numbers and blanks alone are none."""
    texts = idml_texts(files)
    bare = F.regexp_replace("text", r"<\?ACE \d+\?>|<Br\s*/>", "")
    real = texts.filter(bare.rlike(r"[\p{L}\p{P}\p{S}]") & F.expr("try_cast(text as double) is null"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "part", "seq")) - 1
    rows = real.withColumns({"ord": number, "key": number.cast("string")})
    return rows.select("doc_id", "key", "text", "ord", T.string_hash(F.col("key")).alias("string_hash"), T.placeholder(T.string_hash(F.col("key"))).alias("placeholder"), "place", "start", (F.col("start") + F.length("text")).alias("end"))
