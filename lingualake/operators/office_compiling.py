"""Writing translations back into Office and InDesign packages: edits by place in their parts, which are zipped again in order.

Translations are (doc_id, string_hash, ord, text) for texts that are their own key, of repeated ones the last counts.

Cases: paragraphs without a translation stay as they are. A translation with fewer parts than the paragraph has texts
drops the rest of these, one with more has the rest in the last text. Parts that are no XML stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..functions.joins import dealt
from ..sources import office
from ..storing import stored
from .compiling import apply_edits

_TX = r'(?s)<tx(?:\s+href="[^"]*")?\s*>|</tx>|(?:(?!</?tx[\s>]).)+'
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"
_PART = "array<struct<text:string,href:string>>"


def translation_parts(text: Column) -> Column:
    """The (text, href) structs between a text's `<tx>` marks; href is that of the innermost link around, else null."""
    top = lambda s: F.try_element_at(s["stack"], F.lit(-1))

    def step(state: Column, piece: Column) -> Column:
        href = F.regexp_extract(piece, r'href="([^"]*)"', 1)
        opened = F.concat(state["stack"], F.array(F.when(href != "", href).otherwise(top(state))))
        stack = F.when(piece.rlike(r"^<tx[\s>]"), opened).when(piece == "</tx>", F.slice(state["stack"], F.lit(1), F.greatest(F.size(state["stack"]) - 1, F.lit(0)))).otherwise(state["stack"])
        found = F.when(piece.rlike(r"^</?tx[\s>]"), state["parts"]).otherwise(F.concat(state["parts"], F.array(F.struct(piece.alias("text"), top(state).alias("href")))))
        return F.struct(stack.alias("stack"), found.alias("parts"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast(_PART).alias("parts"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(_TX), F.lit(0)), start, step, lambda s: s["parts"])


def _last_told(translations: DataFrame) -> DataFrame:
    return translations.groupBy("doc_id", "string_hash").agg(F.max_by("text", "ord").alias("told"))


def _rewritten(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Packages with the edits (doc_id, place, start, end, text) of their parts."""
    every = office.all_parts(files).filter("part is not null")
    keyed = every.filter("xml is not null").select(F.struct("doc_id", "place").alias("doc_id"), F.col("xml").alias("content"))
    done = apply_edits(keyed, edits.select(F.struct("doc_id", "place").alias("doc_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text")).select("doc_id.doc_id", "doc_id.place", F.col("content").alias("new"))
    rows = every.join(dealt(done), ["doc_id", "place"], "left")
    return office.packages(rows.select("doc_id", "place", "part", F.coalesce("new", "xml").alias("xml"), "raw"))


def _spread(texts: DataFrame, found: DataFrame, translations: DataFrame) -> DataFrame:
    """The filled texts of translated paragraphs with `said` and `href`, null for those beyond the translation, and `gone`, the blank text before that the translation has no room for."""
    told = found.withColumn("string_hash", T.string_hash(F.col("text"))).join(dealt(_last_told(translations)), ["doc_id", "string_hash"]).select("doc_id", "place", "p", translation_parts(F.col("told")).alias("parts"))
    key = Window.partitionBy("doc_id", "place", "p")
    filled = T.strip(F.col("text")) != ""
    last = F.last(F.when(~filled, F.struct("index", F.length("text").alias("n"), "start", "end")), ignorenulls=True).over(key.orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    before = F.max(F.when(filled, F.col("index"))).over(key.orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    rows = texts.withColumns({"blank": last, "previous": before}).filter(filled & F.col("run").isNotNull())
    rows = rows.withColumn("blank", F.when(F.col("blank.index") > F.coalesce("previous", F.lit(-1)), F.col("blank")))
    rows = rows.withColumns({"i": F.row_number().over(key.orderBy("index")), "m": F.count("*").over(key)}).join(dealt(told), ["doc_id", "place", "p"])
    own = F.get("parts", F.col("i") - 1)
    rest = F.array_join(F.transform(F.slice("parts", F.col("m"), F.greatest(F.size("parts"), F.lit(1))), lambda x: x["text"]), "")
    said = F.when(F.col("i") > F.size("parts"), None).when((F.col("i") == F.col("m")) & (F.size("parts") > F.col("m")), rest).otherwise(own["text"])
    rows = rows.withColumns({"said": said, "href": own["href"]})
    room = T.strip(F.substring(F.col("said"), F.lit(1), F.col("blank.n"))) == ""
    return rows.withColumns({"gone": F.when(F.col("said").isNotNull() & ~room, F.col("blank")), "said": F.when(F.col("blank").isNotNull() & room, F.substring("said", F.col("blank.n") + 1, F.length("said"))).otherwise(F.col("said"))})


def _edit(rows: DataFrame, start: Column, end: Column, text: Column | None = None) -> DataFrame:
    return rows.select("doc_id", "place", start.alias("start"), end.alias("end"), (F.lit("") if text is None else text).alias("text"))


def _text_edits(rows: DataFrame) -> DataFrame:
    told = _edit(rows.filter("said is not null"), F.col("open_end"), F.col("close_start"), T.escape_xml(F.col("said")))
    blank = _edit(rows.filter("gone is not null"), F.col("gone.start"), F.col("gone.end"))
    return told.unionByName(blank)


def _opening(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Node rows with their opening tag as `_opening`."""
    key = F.struct("doc_id", "part").alias("_key")
    return spans.with_text(rows.select("*", key), found.select(key, "xml"), F.col("start"), F.col("open_end"), "_opening", "_key", "xml").drop("_key")


def _relation_edits(rows: DataFrame, every: DataFrame, found: DataFrame, added: DataFrame) -> DataFrame:
    """Edits of relationships: new targets of links that stay links, and `added` (doc_id, rels, id, href) at the end."""
    moved = rows.filter("url is not null and href is not null and url <> href").groupBy("doc_id", F.col("rels").alias("part"), "rid").agg(F.max("href").alias("href"))
    tags = every.filter("tag = 'Relationship'").withColumn("rid", F.col("attrs")["Id"]).join(dealt(moved), ["doc_id", "part", "rid"])
    tags, tag = _opening(tags, found), F.col("_opening")
    before, after = F.regexp_extract(tag, r'(?s)^(.*?\sTarget=")', 1), F.regexp_extract(tag, r'(?s)^.*?\sTarget="[^"]*(".*)$', 1)
    changed = _edit(tags, F.col("start"), F.col("open_end"), F.concat(before, T.escape_xml(F.col("href")), after))
    new = F.concat(F.lit('<Relationship Id="'), "id", F.lit(f'" Type="{_LINK}" Target="'), T.escape_xml(F.col("href")), F.lit('" TargetMode="External"/>'))
    listed = added.groupBy("doc_id", F.col("rels").alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", new.alias("x")))), lambda x: x["x"]), "").alias("new"))
    ends = every.filter("tag = 'Relationships'").join(dealt(listed), ["doc_id", "part"])
    return changed.unionByName(_edit(ends, F.col("close_start"), F.col("close_start"), F.col("new")))


def _added(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Texts that become links with the `id` of their new relationship: numbers after the greatest there is."""
    number = F.expr("try_cast(regexp_extract(id, '[0-9]+', 0) as int)")
    most = office.relations(found).groupBy("doc_id", "rels").agg(F.max(number).alias("most"))
    order = F.row_number().over(Window.partitionBy("doc_id", "rels").orderBy("place", "seq"))
    new = rows.filter("url is null and href is not null").join(dealt(most), ["doc_id", "rels"]).withColumn("n", F.col("most") + order)
    return new.withColumn("id", F.concat(F.lit("rId"), "n"))


def _elements(every: DataFrame, seq: str) -> DataFrame:
    """The places of all elements, named for a join with the column `seq`."""
    return every.select("doc_id", "place", F.col("seq").alias(seq), *(F.col(c).alias(f"{seq}_{c}") for c in ("start", "open_end", "close_start", "end")))


def _properties(every: DataFrame, tag: str, name: str) -> DataFrame:
    """The places of the run properties `tag`, for a join with the column `name` of runs."""
    return every.filter(F.col("tag") == tag).select("doc_id", "place", F.col("parent").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("start", "open_end", "close_start", "end")))


def _swapped(rows: DataFrame, every: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """Texts of paragraphs that lose as many links as they gain, with the run properties that they take over.

    The n-th target that is gained meets the n-th that is lost, by first text; their texts swap properties one by one, the
    last one of the shorter side serving the rest. Columns: doc_id, place, run, t_start, added, to (the new target), rels and
    rid (of the lost link), own_* (the places of their own properties, if any) and taken (the other's text, null for none).
    """
    said = rows.filter("said is not null")

    def side(test: str, target: str, name: str) -> DataFrame:
        key = ["doc_id", "place", "p"]
        each = said.filter(test).groupBy(*key, F.col(target).alias(f"{name}_to")).agg(F.min("index").alias("_first"), F.sort_array(F.collect_list(F.struct("index", "run", F.col("start").alias("at"), "rels", "rid"))).alias(name))
        own = Window.partitionBy(*key)
        return each.withColumns({"g": F.row_number().over(own.orderBy("_first")), f"{name}_n": F.count("*").over(own)}).drop("_first")

    gained, lost = side("url is null and href is not null", "href", "a"), side("url is not null and href is null", "url", "d")
    both = gained.join(dealt(lost), ["doc_id", "place", "p", "g"]).filter("a_n = d_n")
    pair = lambda x, y, added: F.struct(x["run"].alias("run"), x["at"].alias("t_start"), y["run"].alias("other"), F.lit(added).alias("added"), (y if added else x)["rels"].alias("rels"), (y if added else x)["rid"].alias("rid"))
    ends = lambda mine, theirs, added: F.transform(mine, lambda x, i: pair(x, F.get(theirs, F.least(i, F.size(theirs) - 1)), added))
    each = both.select("doc_id", "place", F.col("a_to").alias("to"), F.explode(F.concat(ends("a", "d", True), ends("d", "a", False))).alias("x")).select("doc_id", "place", "to", "x.*")
    own = stored(each.join(dealt(_properties(every, tag, "run")), ["doc_id", "place", "run"], "left").join(dealt(_properties(every, tag, "other")), ["doc_id", "place", "other"], "left"))
    key = F.struct("doc_id", "place").alias("_key")
    return spans.with_text(own.select("*", key), found.select(key, "xml"), F.col("other_start"), F.col("other_end"), "taken", "_key", "xml").drop("_key")


def _swap_edits(swapped: DataFrame) -> DataFrame:
    """Edits that replace run properties, or put them before a text whose run has none."""
    own = F.col("run_start").isNotNull()
    rows = swapped.filter(own | F.col("taken").isNotNull())
    return _edit(rows, F.when(own, F.col("run_start")).otherwise(F.col("t_start")), F.when(own, F.col("run_end")).otherwise(F.col("t_start")), F.coalesce("taken", F.lit("")))


def compile_docx(files: DataFrame, translations: DataFrame, rtl: bool = False) -> DataFrame:
    """DOCX packages with translations in their paragraphs.

    Links follow the translation: their targets change, they go, or runs become links of new relationships; runs that
    lose and gain links swap their properties. With `rtl` paragraphs and runs are marked as right to left, and tables as mirrored.
    """
    found = stored(office.docx_parts(files))
    every = stored(office.nodes(found))
    texts = office.runs(found, office.docx_links(found), office._DOCX)
    rows = stored(_spread(texts, office.paragraphs(texts), translations))
    linked = rows.join(dealt(_elements(every, "link")), ["doc_id", "place", "link"])
    dropped = rows.filter("said is null")
    cut = _edit(dropped.filter("link is null"), F.col("start"), F.col("end")).unionByName(_edit(linked.filter("said is null"), F.col("link_start"), F.col("link_end")))
    bare = linked.filter("said is not null and url is not null and href is null").groupBy("doc_id", "place", "link_start", "link_open_end", "link_close_start", "link_end").count()
    bare = _edit(bare, F.col("link_start"), F.col("link_open_end")).unionByName(_edit(bare, F.col("link_close_start"), F.col("link_end")))
    new = _added(rows.filter("said is not null"), found).join(dealt(_elements(every, "run")), ["doc_id", "place", "run"])
    wrap = _edit(new, F.col("run_start"), F.col("run_start"), F.concat(F.lit('<w:hyperlink r:id="'), "id", F.lit('">'))).unionByName(_edit(new, F.col("run_end"), F.col("run_end"), F.lit("</w:hyperlink>")))
    swapped = _swapped(rows, every, found, "w:rPr")
    if rtl:
        mark = '<w:rtl w:val="1"/>'
        marked = F.when(F.col("taken").endswith("</w:rPr>") & ~F.contains("taken", F.lit("<w:rtl")), F.regexp_replace("taken", "</w:rPr>$", f"{mark}</w:rPr>")).otherwise(F.col("taken"))
        swapped = swapped.withColumn("taken", marked)
    edits = _text_edits(rows).unionByName(cut).unionByName(bare).unionByName(wrap).unionByName(_relation_edits(rows, every, found, new)).unionByName(_swap_edits(swapped))
    return _rewritten(files, edits.unionByName(_rtl_edits(every, swapped)) if rtl else edits)


def _rtl_edits(every: DataFrame, swapped: DataFrame) -> DataFrame:
    """Marks in what no edit of `swapped` replaces."""
    replaced = swapped.filter("run_start is not null").select("doc_id", "place", F.col("run_start").alias("start")).distinct()
    held = lambda tag: every.filter(F.col("tag") == tag).select("doc_id", "place", F.col("parent").alias("seq")).distinct()

    def marked(owner: str, inside: str, mark: str) -> DataFrame:
        """`mark` at the end of each `inside` that has none."""
        own = every.filter((F.col("tag") == inside) & (F.col("close_start") < F.col("end"))).join(dealt(held(mark.strip("</>").split()[0])), ["doc_id", "place", "seq"], "left_anti")
        own = own.join(dealt(replaced), ["doc_id", "place", "start"], "left_anti")
        return _edit(own, F.col("close_start"), F.col("close_start"), F.lit(mark))

    bidi, rtl, mirrored = '<w:bidi w:val="1"/>', '<w:rtl w:val="1"/>', "<w:bidiVisual/>"
    plain = every.filter("tag = 'w:p' and close_start < end").join(dealt(held("w:pPr")), ["doc_id", "place", "seq"], "left_anti")
    tables = every.filter("tag = 'w:tbl' and close_start < end").join(dealt(held("w:tblPr")), ["doc_id", "place", "seq"], "left_anti")
    out = marked("w:p", "w:pPr", bidi).unionByName(marked("w:r", "w:rPr", rtl)).unionByName(marked("w:tbl", "w:tblPr", mirrored))
    out = out.unionByName(_edit(plain, F.col("close_start"), F.col("close_start"), F.lit(f"<w:pPr>{bidi}</w:pPr>")))
    return out.unionByName(_edit(tables, F.col("open_end"), F.col("open_end"), F.lit(f"<w:tblPr>{mirrored}</w:tblPr>")))


def compile_pptx(files: DataFrame, translations: DataFrame, blank_texts: bool = False) -> DataFrame:
    """PPTX packages with translations in the paragraphs of slides and notes.

    Targets of links change, links go, or runs become links of new relationships; runs that lose and gain links swap
    their properties, and with these the link.
    """
    found = stored(office.pptx_parts(files))
    every = stored(office.nodes(found))
    texts = office.pptx_texts(files)
    rows = stored(_spread(texts, office.with_blanks(texts) if blank_texts else office.paragraphs(texts), translations))
    cut = _edit(rows.filter("said is null"), F.col("start"), F.col("end"))
    swapped = _swapped(rows, every, found, "a:rPr")
    alone = rows.filter("said is not null").join(dealt(swapped.select("doc_id", "place", "run")), ["doc_id", "place", "run"], "left_anti")
    linked = alone.filter("url is not null and href is null").join(dealt(_elements(every, "link")), ["doc_id", "place", "link"])
    bare = _edit(linked, F.col("link_start"), F.col("link_end"))
    new = _opening_of(_added(alone, found).join(dealt(_properties(every, "a:rPr", "run")), ["doc_id", "place", "run"], "left"), found)
    click = F.concat(F.lit('<a:hlinkClick r:id="'), "id", F.lit('"/>'))
    empty = F.col("run_close_start") == F.col("run_end")
    filled = F.when(F.col("run_start").isNull(), F.concat(F.lit("<a:rPr>"), click, F.lit("</a:rPr>"))).when(empty, F.concat(F.regexp_replace("_opening", r"\s*/>$", ">"), click, F.lit("</a:rPr>"))).otherwise(click)
    at = F.when(F.col("run_start").isNull(), F.col("start")).when(empty, F.col("run_start")).otherwise(F.col("run_close_start"))
    clicks = _edit(new, at, F.when(empty, F.col("run_end")).otherwise(at), filled)
    moved = swapped.filter("added").select("doc_id", "rels", "rid", F.lit("").alias("url"), F.col("to").alias("href"))
    relations = _relation_edits(rows.select("doc_id", "rels", "rid", "url", "href").unionByName(moved), every, found, new)
    return _rewritten(files, _text_edits(rows).unionByName(cut).unionByName(bare).unionByName(clicks).unionByName(relations).unionByName(_swap_edits(swapped)))


def _opening_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` with the opening tag of their run properties as `_opening`."""
    key = F.struct("doc_id", "place").alias("_key")
    return spans.with_text(rows.select("*", key), found.select(key, "xml"), F.col("run_start"), F.col("run_open_end"), "_opening", "_key", "xml").drop("_key")


def spread_parts(parts: Column, n: Column) -> Column:
    """`n` texts from a translation's parts: blank ones are left out, more than `n` join the last, missing ones are empty."""
    kept = F.filter(F.transform(parts, lambda x: x["text"]), lambda x: T.strip(x) != "")
    return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.when(i == n, F.array_join(F.slice(kept, i, F.greatest(F.size(kept), F.lit(1))), "")).otherwise(F.coalesce(F.get(kept, i - 1), F.lit(""))))


def compile_xlsx(files: DataFrame, translations: DataFrame) -> DataFrame:
    """XLSX packages with translations in shared and inline strings, link formulas and sheet names; linked cells of shared strings get their own text."""
    found = stored(office.xlsx_parts(files))
    places = found.select("doc_id", F.col("part").alias("at"), F.col("place").alias("at_place"))
    every = office.xlsx_nodes(found)
    told = _last_told(translations)
    hashed = stored(office.xlsx_texts(found, every)).withColumn("string_hash", T.string_hash(F.col("text"))).join(dealt(told), ["doc_id", "string_hash"]).withColumn("parts", translation_parts(F.col("told")))
    direct = hashed.filter("not (kind = 's' and url is not null)").groupBy("doc_id", "at", "owner").agg(F.first("parts").alias("parts"), F.first("kind").alias("kind"))
    ts = every.filter("tag = 't' and close_start < end").withColumn("owner", F.coalesce(office._around("si"), office._around("c"))).select("doc_id", F.col("part").alias("at"), "place", "owner", "seq", "open_end", "close_start")
    order = Window.partitionBy("doc_id", "at", "owner")
    ts = ts.withColumns({"i": F.row_number().over(order.orderBy("seq")), "n": F.count("*").over(order)}).join(dealt(direct), ["doc_id", "at", "owner"])
    texts = _edit(ts, F.col("open_end"), F.col("close_start"), T.escape_xml(F.get(spread_parts(F.col("parts"), F.col("n")), F.col("i") - 1)))
    cells = every.filter("tag = 'c'").select("doc_id", F.col("part"), "place", F.col("seq"), "start", "open_end", "end")
    own = _opening(hashed.filter("kind = 's' and url is not null").join(dealt(cells), ["doc_id", "part", "seq"]), found)
    tag = F.regexp_replace("_opening", r'\st="s"', ' t="inlineStr"')
    alone = F.array_join(F.transform("parts", lambda x: x["text"]), "")
    inline = _edit(own, F.col("start"), F.col("end"), F.concat(tag, F.lit("<is><t>"), T.escape_xml(alone), F.lit("</t></is></c>")))
    first = F.get("parts", 0)
    quoted = lambda x: F.replace(T.escape_xml(x), F.lit('"'), F.lit("&quot;"))
    link = F.concat(F.lit("HYPERLINK(&quot;"), quoted(F.coalesce(first["href"], F.lit(""))), F.lit("&quot;,&quot;"), quoted(alone), F.lit("&quot;)"))
    values = every.filter("tag in ('f', 'v')").select("doc_id", "part", "place", F.col("parent").alias("seq"), "tag", "open_end", "close_start")
    shown = hashed.filter("kind = 'str' and at = part").join(dealt(values), ["doc_id", "part", "seq"]).filter(first["href"].isNotNull())
    formulas = _edit(shown, F.col("open_end"), F.col("close_start"), F.when(F.col("tag") == "f", link).otherwise(T.escape_xml(alone)))
    named = every.filter("part = 'xl/workbook.xml' and tag = 'sheet'").withColumn("string_hash", T.string_hash(T.unescape_xml(F.col("attrs")["name"]))).join(dealt(told), ["doc_id", "string_hash"])
    named, opening = _opening(named, found), F.col("_opening")
    names = _edit(named, F.col("start"), F.col("open_end"), F.concat(F.regexp_extract(opening, r'(?s)^(.*?\sname=")', 1), quoted(F.col("told")), F.regexp_extract(opening, r'(?s)^.*?\sname="[^"]*(".*)$', 1)))
    return _rewritten(files, texts.unionByName(inline).unionByName(formulas).unionByName(names))


def idml_template(files: DataFrame, units: DataFrame) -> DataFrame:
    """IDML packages with placeholders in their stories."""
    return _rewritten(files, units.select("doc_id", "place", "start", "end", F.col("placeholder").alias("text")))


def escape_idml(text: Column) -> Column:
    """Ampersands and smaller signs as entities, but for those of entities and of the marks that stories may hold."""
    return F.regexp_replace(T.escape_ampersands(text), r"<(?!\?ACE \d+\?>|Br\s*/>)", "&lt;")


def compile_idml(templates: DataFrame, translations: DataFrame) -> DataFrame:
    """IDML packages with the translations (doc_id, placeholder, text); placeholders without one become nothing."""
    mark = r"[0-9a-f]{32}_tr"
    stories = office.parts(templates).filter(F.col("part").startswith("Stories/"))
    pieces = stories.select("doc_id", "place", F.posexplode(F.regexp_extract_all("xml", F.lit(rf"(?s){mark}|(?:(?!{mark}).)+"), F.lit(0))).alias("seq", "piece"))
    at = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("doc_id", "place").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = pieces.withColumn("start", at).filter(F.col("piece").rlike(f"^{mark}$")).withColumnRenamed("piece", "placeholder")
    told = slots.join(dealt(translations.groupBy("doc_id", "placeholder").agg(F.first("text").alias("told"))), ["doc_id", "placeholder"], "left")
    return _rewritten(templates, _edit(told, F.col("start"), F.col("start") + F.length("placeholder"), F.coalesce(escape_idml(F.col("told")), F.lit(""))))
