"""Compiling: templates meet translations, and parts are joined again in order.

What happens to a slot without a translation is the join's policy: `keep` leaves the placeholder, `blank`
leaves nothing, `drop` takes the whole section away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..functions.joins import dealt


def _joined(rows: DataFrame, part: Column, separator: str, *carry: Column) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(F.col("seg").alias("seg"), part.alias("part"))))
    return rows.groupBy("doc_id", *carry).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), separator).alias("content"))


def told(slots: DataFrame, translations: DataFrame, order: str = "start", how: str = "left") -> DataFrame:
    """`slots` (doc_id, placeholder) with the columns of their translation: of repeated placeholders the n-th slot takes the n-th.

    Translations are ordered by `ord`, or where they have none by their key.
    """
    nth = Window.partitionBy("doc_id", "placeholder")
    by = "ord" if "ord" in translations.columns else "key"
    texts = translations.withColumn("_nth", F.row_number().over(nth.orderBy(by))).drop("ord")
    return slots.withColumn("_nth", F.row_number().over(nth.orderBy(order))).join(dealt(texts), ["doc_id", "placeholder", "_nth"], how).drop("_nth")


def with_translations(rows: DataFrame, translations: DataFrame) -> DataFrame:
    """`rows` (doc_id, seg, placeholder) with `translation`, the text that told() finds."""
    return told(rows, translations.select("doc_id", "placeholder", "ord", F.col("text").alias("translation")), "seg")


def plaintext_template(segments: DataFrame) -> DataFrame:
    """The template text of each document of plain text segments."""
    rows = _joined(segments, F.concat("lead", F.coalesce("placeholder", F.lit("")), "tail"), "\n", F.col("newline"))
    return rows.select("doc_id", T.with_newlines(F.col("content"), F.col("newline")).alias("content"))


def compile_plaintext(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Documents with the translations (doc_id, placeholder, ord, text) in place; slots without one keep the placeholder."""
    rows = with_translations(segments, translations)
    part = F.concat("lead", F.coalesce("translation", "placeholder", F.lit("")), "tail")
    return _joined(rows, part, "\n", F.col("newline")).select("doc_id", T.with_newlines(F.col("content"), F.col("newline")).alias("content"))


def compile_sections(parts: DataFrame, translations: DataFrame, missing: str = "drop", separator: str = "\n\n") -> DataFrame:
    """Subtitle documents of parts (doc_id, seg, head, tail, placeholder); of a dropped section the blank lines around it stay."""
    rows = with_translations(parts, translations)
    slot = F.col("placeholder").isNotNull()
    if missing == "drop":
        part = F.when(slot & F.col("translation").isNull(), "").otherwise(F.concat("head", F.coalesce("translation", F.lit("")), "tail"))
    else:
        part = F.concat("head", F.when(slot, F.coalesce("translation", F.col("placeholder") if missing == "keep" else F.lit(""))).otherwise(""), "tail")
    return _joined(rows, part, separator)


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents (doc_id, content) with the spans of `edits` (doc_id, start, end, text) replaced; spans may touch, not overlap.

    The time grows with a document's length and its number of edits, not with their product.
    """
    slot = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(slot)).alias("_slots"))
    both = files.select("doc_id", "content").join(dealt(listed), "doc_id", "left")
    rows = both.select("doc_id", "content", "_slots", spans.blocks(F.when(F.col("_slots").isNotNull(), F.col("content"))).alias("_blocks"))
    # the text behind each edit reaches to the next one's start
    after = F.concat(F.transform(F.slice("_slots", F.lit(2), F.greatest(F.size("_slots") - 1, F.lit(0))), lambda s: s["start"]), F.array(F.length("content")))
    first = spans.piece(F.col("_blocks"), F.lit(0), F.get("_slots", 0)["start"])
    rest = F.zip_with("_slots", after, lambda s, end: F.concat(s["text"], spans.piece(F.col("_blocks"), s["end"], end)))
    return rows.select("doc_id", F.when(F.col("_slots").isNull(), F.col("content")).otherwise(F.concat(first, F.array_join(rest, ""))).alias("content"))


def compile_slots(files: DataFrame, slots: DataFrame, translations: DataFrame | None = None, missing: str = "keep") -> DataFrame:
    """Documents (doc_id, content) with the text at each slot (start, end, placeholder) replaced by its translation."""
    rows = slots.withColumn("seg", F.col("start"))
    rows = with_translations(rows, translations) if translations is not None else rows.withColumn("translation", F.lit(None).cast("string"))
    text = F.coalesce("translation", F.lit("") if missing == "blank" else F.col("placeholder"))
    return apply_edits(files, rows.select("doc_id", "start", "end", text.alias("text")))


def serialize_plural(strings: Column, delimiter: str = " ") -> Column:
    """`rule {text}` forms of a plural map, in the order they were put in."""
    names = F.create_map(*(x for k, v in T.RULES.items() for x in (F.lit(v), F.lit(k))))
    return F.array_join(F.transform(F.map_entries(strings), lambda e: F.concat(F.element_at(names, e["key"]), F.lit(" {"), e["value"], F.lit("}"))), delimiter)


def _in_template(templates: DataFrame, translations: DataFrame) -> DataFrame:
    """`translations` with whether their template has their placeholder; those that look like no placeholder are searched for one by one."""
    usual = F.coalesce(F.col("placeholder").rlike(f"^{spans.MARK}$"), F.lit(False))
    known = spans.marks(templates).select("doc_id", "placeholder", F.lit(True).alias("_known")).distinct()
    listed = translations.filter(usual).join(known, ["doc_id", "placeholder"], "left")
    other = translations.filter(~usual).join(templates.select("doc_id", F.col("content").alias("_content")), "doc_id", "left")
    both = listed.unionByName(other.withColumn("_known", F.contains("_content", "placeholder")).drop("_content"))
    return both.withColumn("_known", F.coalesce("_known", F.lit(False)))


def extra_strings(templates: DataFrame, translations: DataFrame) -> DataFrame:
    """The translations whose placeholder is not in their template."""
    return _in_template(templates, translations).filter("not _known").select(*translations.columns)


def without_extra(templates: DataFrame, translations: DataFrame) -> DataFrame:
    """`translations`, as they are; one whose placeholder is not in its template ends the query, whatever is asked for."""
    found = T.checked(_in_template(templates, translations), F.col("_known"), F.concat(F.lit("not in the template: "), F.coalesce("placeholder", F.lit("null"))))
    return found.select(*translations.columns)


def complete(templates: DataFrame, translations: DataFrame) -> DataFrame:
    """`templates`, as they are; a translation that their slots lack ends the query, whatever is asked for."""
    extra = extra_strings(templates, translations).groupBy("doc_id").agg(F.min("placeholder").alias("_extra"))
    both = templates.join(extra, "doc_id", "full")
    return T.checked(both, F.col("_extra").isNull(), F.concat(F.lit("not in the template: "), F.coalesce("_extra", F.lit("null")))).select(*templates.columns)
