"""The formats by name: what reads a file, makes its template, compiles and synchronises it, escapes its texts and reports its problems.

A unit, whatever its format, is (doc_id, key, context, pluralized, strings, ord, flags, developer_comment, character_limit,
occurrences, string_hash, placeholder); a translation is the same with other `strings`. parse(), template(), compile(),
sync() and problems() take a format's name; convert() writes templates and results of a folder of mixed files, each of
which is read once.

Cases: a file whose extension no format has gives no units; unknown() lists it. A null content gives no units and comes
out as null. Formats without a template of their own (the Office ones) have their file as template; formats that can't be
synchronised keep their template.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import spans
from .functions import text as T
from .operators import compiling, json_compiling, markdown_compiling, office_compiling, po_compiling, validating, xml_compiling, yaml_compiling
from .sources import json_files, markdown, office, plaintext, po, subtitles, xml_files, xml_walk, yaml_files
from .storing import new_folder, stored

Files = Callable[[DataFrame], DataFrame]
Both = Callable[[DataFrame, DataFrame], DataFrame]
_NEITHER = lambda c: c


@dataclass(frozen=True)
class Format:
    """What a format can do.

    `units` maps files (doc_id, content) to string units, `template` files and units to templates, `compile` templates and
    translations to files, `sync` templates and strings to templates, `problems` files to rows that have a doc_id and a rule.
    `extension` is None where a name must be given.
    """

    units: Files
    extension: str | None = None
    binary: bool = False
    template: Both = lambda files, units: files.select("doc_id", "content")
    compile: Both | None = None
    sync: Both = lambda templates, strings: templates.select("doc_id", "content")
    problems: Files | None = None
    escape: Callable[[Column], Column] = _NEITHER
    unescape: Callable[[Column], Column] = _NEITHER


def uniform(units: DataFrame) -> DataFrame:
    """Units of any format with the columns that all have; texts are under rule 5."""
    own = set(units.columns)
    kept = lambda name, kind, default=None: (F.col(name).cast(kind) if name in own else F.lit(default).cast(kind)).alias(name)
    flags = F.when(F.col("kind") == "yaml", F.col("flags")) if {"kind", "flags"} <= own else F.col("flags") if "flags" in own else F.lit(None)
    strings = F.col("strings") if "strings" in own else F.create_map(F.lit(5), F.col("text"))
    return units.select(
        "doc_id", "key", kept("context", "string", ""), F.coalesce(kept("pluralized", "boolean", False), F.lit(False)).alias("pluralized"), strings.cast("map<int,string>").alias("strings"), kept("ord", "int"), flags.cast("string").alias("flags"),
        kept("developer_comment", "string", ""), kept("character_limit", "int"), kept("occurrences", "string"), "string_hash", "placeholder",
    )


def _by_text(translations: DataFrame) -> DataFrame:
    return translations.withColumn("text", F.element_at("strings", 5))


def _slots_template(files: DataFrame, units: DataFrame) -> DataFrame:
    return compiling.compile_slots(files, units.select("doc_id", "start", "end", "placeholder"))


def _compile_marks(templates: DataFrame, translations: DataFrame) -> DataFrame:
    """Templates with each placeholder replaced by its text; those without a translation stay."""
    found = compiling.told(spans.marks(templates), _by_text(translations).select("doc_id", "placeholder", "ord", "text"), how="inner")
    return compiling.apply_edits(templates, found.select("doc_id", "start", "end", "text"))


def _subtitles(read: Files) -> tuple[Both, Both]:
    none = "doc_id {}, placeholder string, ord int, text string"

    def template(files: DataFrame, units: DataFrame) -> DataFrame:
        nothing = files.sparkSession.createDataFrame([], none.format(files.schema["doc_id"].dataType.simpleString()))
        return compiling.compile_sections(subtitles.template_parts(files, units), nothing, "keep")

    def compiled(templates: DataFrame, translations: DataFrame) -> DataFrame:
        slots = read(templates).filter(F.col("text").rlike(f"^{spans.MARK}$")).withColumn("placeholder", F.col("text"))
        return compiling.compile_sections(subtitles.template_parts(templates, slots), _by_text(translations))

    return template, compiled


def _json_problems(files: DataFrame) -> DataFrame:
    repeated = json_files.duplicate_keys(files).select("doc_id", F.lit("duplicate key").alias("rule"), F.col("key").alias("message"), "line")
    return json_files.errors(files).unionByName(repeated)


def _office(write: Both) -> Both:
    return lambda files, translations: write(files, _by_text(translations).select("doc_id", "string_hash", "ord", "text"))


def _json(units: Files, write: Both, sync: Both | None = None, problems: Files = _json_problems, extension: str | None = None) -> Format:
    rest = {"sync": sync} if sync else {}
    return Format(units, extension, template=_slots_template, compile=write, problems=problems, escape=T.escape_json, unescape=T.unescape_json, **rest)


def _yaml(units: Files, above: int, one_root: bool, extension: str | None = None) -> Format:
    return Format(units, extension, template=yaml_compiling.template, compile=lambda t, s: yaml_compiling.compile_yaml(t, s, above, strict=False), problems=lambda f: yaml_files.problems(f, one_root))


def _markdown(units: Files, compose: bool, extension: str | None = None) -> Format:
    return Format(units, extension, template=lambda f, u: markdown_compiling.template(f, u, compose), compile=lambda t, s: markdown_compiling.compile_markdown(t, _by_text(s), strict=False))


def _package(units: Files, write: Both, part: str, extension: str | None = None, template: Both | None = None) -> Format:
    rest = {"template": template} if template else {}
    return Format(units, extension, True, compile=write, problems=lambda f: office.problems(f, part), escape=T.escape_xml, unescape=T.unescape_xml, **rest)


def _bare_android_problems(files: DataFrame) -> DataFrame:
    """The problems of Android files, quotes that no backslash escapes among them."""
    return xml_files.android_problems(files).select("doc_id", "rule").unionByName(xml_files.unescaped_problems(xml_files.android_units(files)).select("doc_id", "rule"))


_SRT, _VTT = _subtitles(subtitles.srt_units), _subtitles(subtitles.vtt_units)
_android = {"template": xml_compiling.android_template, "problems": xml_files.android_problems, "escape": T.escape_android, "unescape": T.unescape_android}
_idml = lambda t, s: office_compiling.compile_idml(t, _by_text(s).select("doc_id", "placeholder", "text"))

FORMATS: dict[str, Format] = {
    "Plaintext": Format(plaintext.units, "txt", template=lambda files, units: compiling.plaintext_template(plaintext.segments(files)), compile=_compile_marks),
    "SRT": Format(subtitles.srt_units, "srt", template=_SRT[0], compile=_SRT[1], problems=validating.srt_report),
    "VTT": Format(subtitles.vtt_units, "vtt", template=_VTT[0], compile=_VTT[1], problems=subtitles.vtt_problems),
    "PO": Format(po.units, "po", template=lambda files, units: po_compiling.template(files), compile=po_compiling.compile_po, sync=po_compiling.sync_template, problems=po.problems),
    "KEYVALUEJSON": _json(json_files.key_value_units, json_compiling.compile_members, json_compiling.sync_template, extension="json"),
    "ARB": _json(json_files.arb_units, json_compiling.compile_arb, json_compiling.sync_arb, json_files.arb_problems, "arb"),
    "STRUCTURED_JSON": _json(json_files.structured_units, json_compiling.compile_structured, json_compiling.sync_structured, json_files.structured_problems),
    "CHROME": _json(json_files.chrome_units, json_compiling.compile_kept, json_compiling.sync_chrome, json_files.object_problems),
    "CHROME_V3": _json(json_files.chrome_v3_units, json_compiling.compile_chrome_v3, None, json_files.object_problems),
    "ANDROID": Format(xml_files.android_units, "xml", compile=xml_compiling.compile_android, **_android),
    "BETA_ANDROID": Format(lambda files: xml_files.android_units(files, beta=True), compile=xml_compiling.compile_beta_android, **_android),
    "ANDROID_UNESCAPED": Format(xml_files.android_units, template=xml_compiling.android_template, compile=xml_compiling.compile_android, problems=_bare_android_problems, escape=T.escape_android_raw, unescape=T.unescape_android_raw),
    "STRINGSDICT": Format(xml_files.stringsdict_units, "stringsdict", template=xml_compiling.stringsdict_template, compile=xml_compiling.compile_stringsdict, problems=xml_files.stringsdict_problems, escape=T.escape_xml, unescape=T.unescape_xml),
    "CUSTOM_XML": Format(xml_files.custom_units, template=_slots_template, compile=lambda t, s: xml_compiling.compile_custom(t, s, "keep"), problems=xml_files.custom_problems),
    "Yaml": _yaml(yaml_files.units, 0, False, "yml"),
    "Yaml (Internationalization)": _yaml(yaml_files.i18n_units, 1, True),
    "Github_Markdown": _markdown(markdown.units, False),
    "Github_Markdown_v2": _markdown(markdown.front_matter_units, True, "md"),
    "Markdown_JSX": _markdown(markdown.front_matter_units, True, "mdx"),
    "DOCX": _package(office.docx_units, _office(office_compiling.compile_docx), "_rels/.rels", "docx"),
    "PPTX": _package(office.pptx_units, _office(office_compiling.compile_pptx), "_rels/.rels", "pptx"),
    "PPTX_V2": _package(lambda files: office.pptx_units(files, blank_texts=True), _office(lambda f, s: office_compiling.compile_pptx(f, s, blank_texts=True)), "_rels/.rels"),
    "XLSX_UNSTRUCTURED": _package(office.xlsx_units, _office(office_compiling.compile_xlsx), "[Content_Types].xml", "xlsx"),
    "InDesign": _package(office.idml_units, _idml, "designmap.xml", "idml", office_compiling.idml_template),
}


def register_format(name: str, units: Files, extension: str | None = None, binary: bool = False, **rest) -> None:
    """Adds a format, or puts it in the place of one; `rest` are further fields of Format."""
    FORMATS[name] = Format(units, extension, binary, **rest)


def parse(files: DataFrame, name: str) -> DataFrame:
    """The units of files (doc_id, content) of one format, by its name."""
    return FORMATS[name].units(files)


def template(files: DataFrame, name: str) -> DataFrame:
    """The templates of files of one format."""
    return FORMATS[name].template(files, FORMATS[name].units(files))


def compile(templates: DataFrame, translations: DataFrame, name: str) -> DataFrame:
    """Files of one format with the translations, rows as uniform() makes them, in the templates' slots."""
    if FORMATS[name].compile is None:
        raise ValueError(f"{name} can't be compiled")
    return FORMATS[name].compile(templates, translations)


def sync(templates: DataFrame, strings: DataFrame, name: str) -> DataFrame:
    """Templates of one format that have the slots of `strings`."""
    return FORMATS[name].sync(templates, strings)


def problems(files: DataFrame, name: str) -> DataFrame:
    """Rows (doc_id, rule) of what breaks the rules of one format; none for formats without rules."""
    own = FORMATS[name].problems
    return own(files).select("doc_id", "rule") if own else files.select("doc_id", F.lit(None).cast("string").alias("rule")).filter("false")


def _extension() -> Column:
    return F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))


def _format_of() -> Column:
    """The name of the format that has a path's extension, null if none has."""
    return F.coalesce(*(F.when(_extension() == k.extension, F.lit(n)) for n, k in FORMATS.items() if k.extension))


def by_format(files: DataFrame) -> dict[str, DataFrame]:
    """Files (doc_id, path, content binary) by their format, content as the format takes it.

    They are read once: written in a folder for each format, from which each format reads its own.
    """
    folder = new_folder(files.sparkSession, "formats")
    kinds = files.select("doc_id", "path", "content", _format_of().alias("format")).filter("format is not null")
    kinds.write.partitionBy("format").parquet(folder)
    every = files.sparkSession.read.schema(kinds.schema).parquet(folder)
    there = {r["format"] for r in every.select("format").distinct().collect()}  # at most one row for each format
    own = lambda n: every.filter(F.col("format") == n).select("doc_id", "path", F.col("content") if FORMATS[n].binary else T.decoded(F.col("content")).alias("content"))
    return {n: own(n) for n in FORMATS if n in there}


_PARSED = "doc_id {}, format string, key string, unit string"


def parse_by_extension(files: DataFrame) -> DataFrame:
    """Rows (doc_id, format, key, unit) of files (doc_id, path, content binary) of any formats; `unit` is the whole unit as JSON."""
    out = files.sparkSession.createDataFrame([], _PARSED.format(files.schema["doc_id"].dataType.simpleString()))
    for name, own in by_format(files).items():
        rows = FORMATS[name].units(own.select("doc_id", "content"))
        out = out.unionByName(rows.select("doc_id", F.lit(name).alias("format"), "key", unit_json(rows).alias("unit")))
    return out


def unit_json(rows: DataFrame) -> Column:
    """A unit's row as JSON text."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != "doc_id")))


def unknown(files: DataFrame) -> DataFrame:
    """Rows (doc_id, path) of the files that no format reads."""
    return files.filter(_format_of().isNull()).select("doc_id", "path")


def _renamed(path: Column, mark: str) -> Column:
    """A path with `mark` before its extension, in the place of `_en` if it has that."""
    return F.regexp_replace(path, r"(?:_en)?(\.[^./]+)$", f"_{mark}$1")


def convert(files: DataFrame, translate: Callable[[DataFrame], DataFrame], out: str, language: str = "el") -> DataFrame:
    """Writes the template and the translated result of each of the files (doc_id, path, content binary) to `out`.

    `translate` maps units, as uniform() makes them, to translations. The table at `out` has (doc_id, path, kind, content binary)
    in a folder for each format, `kind` being template or result; it is also returned. A file's path is that of its source with
    `_tpl` or the language at the end.
    """
    spark: SparkSession = files.sparkSession
    schema = f"doc_id {files.schema['doc_id'].dataType.simpleString()}, path string, kind string, content binary, format string"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("format").parquet(out)
    for name, own in by_format(files).items():
        kind = FORMATS[name]
        if kind.compile is None:
            continue
        units = kind.units(own.select("doc_id", "content"))
        templates = stored(kind.template(own.select("doc_id", "content"), units).select("doc_id", F.col("content").cast("binary").alias("content")))
        readable = templates if kind.binary else templates.select("doc_id", T.decoded(F.col("content")).alias("content"))
        results = kind.compile(readable, translate(uniform(units))).select("doc_id", F.col("content").cast("binary").alias("content"))
        both = templates.withColumn("kind", F.lit("template")).unionByName(results.withColumn("kind", F.lit("result")))
        mark = F.when(F.col("kind") == "template", _renamed(F.col("path"), "tpl")).otherwise(_renamed(F.col("path"), language))
        rows = both.join(own.select("doc_id", "path"), "doc_id").select("doc_id", mark.alias("path"), "kind", "content", F.lit(name).alias("format"))
        rows.write.mode("append").partitionBy("format").parquet(out)
    return spark.read.schema(schema).parquet(out)


def register_functions(spark: SparkSession) -> None:
    """Registers table functions that walk one file's content in SQL: json_nodes, xml_nodes, po_entries, yaml_leaves and markdown_blocks.

    `SELECT f.doc_id, n.* FROM files f, LATERAL json_nodes(f.content) n` gives a row for each node.
    """
    walks = {"json_nodes": json_files.rows_of, "xml_nodes": xml_walk.rows_of, "po_entries": po.rows_of, "yaml_leaves": yaml_files.rows_of, "markdown_blocks": markdown.rows_of}
    schemas = {"json_nodes": json_files.NODES, "xml_nodes": xml_walk.NODES, "po_entries": po.ENTRIES, "yaml_leaves": yaml_files.LEAVES, "markdown_blocks": markdown.BLOCKS}
    for name, walk in walks.items():
        spark.udtf.register(name, F.udtf(_table_function(walk), returnType=schemas[name]))


def _table_function(walk):
    class Walk:
        def eval(self, content: str):
            yield from walk(content)

    return Walk
