"""Templates of Markdown files and compiling them; strings of the YAML header are quoted where they must be.

Cases: placeholders without a translation stay. A translation whose placeholder the template lacks ends the query
if `strict`. Line ends come out as they were in the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..sources import markdown
from .compiling import apply_edits, complete, told

#: Characters that YAML can't print.
_UNPRINTABLE = r"[^\x09\x0A\x0D\x20-\x7E\x85 -퟿-�\x{10000}-\x{10FFFF}]"


def template(files: DataFrame, units: DataFrame, compose: bool = True) -> DataFrame:
    """Files with placeholders in place of the units' texts, with the line ends of the source."""
    prepared = markdown.normalised(files, compose)
    marked = apply_edits(prepared, units.select("doc_id", "start", "end", F.col("placeholder").alias("text"))).join(prepared.select("doc_id", "newline"), "doc_id")
    return marked.select("doc_id", T.with_newlines(F.col("content"), F.col("newline")).alias("content"))


def fuzzy_span(pattern: Column, text: Column) -> Column:
    """The struct (start, end) of the first place where `text` has the words of `pattern` with any white space between them, null if none."""
    words = F.filter(F.split(pattern, r"\s+"), lambda w: w != "")
    expression = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"\s+")
    found = F.regexp_substr(text, expression)
    start = F.position(found, text) - 1
    return F.when((F.size(words) > 0) & found.isNotNull(), F.struct(start.alias("start"), (start + F.length(found)).alias("end")))


def quote_for(text: Column, flags: Column) -> Column:
    """The quote that a header's string is wrapped in, null for none: that of its flags, or one that its characters ask for."""
    bare = T.strip(text)
    both = lambda q: bare.startswith(q) & bare.endswith(q)
    special = F.contains(F.regexp_replace(text, r"(?s).$", ""), F.lit("\n")) | bare.rlike(r"[:#]") | bare.rlike(r"^[*&@-]") | (bare.startswith("[") & ~bare.endswith("]"))
    return (
        F.when(F.contains(flags, F.lit("|")), None)
        .when(flags.isin("'", '"'), flags)
        .when(both('"') | both("'"), None)
        .when(bare.startswith('"'), "'")
        .when(bare.startswith("'"), '"')
        .when(special, '"')
    )


def wrapped(text: Column, quote: Column) -> Column:
    """`text` in the quote, with the quotes inside escaped; as it is for no quote."""
    inside = F.when(quote == '"', F.replace(text, F.lit('"'), F.lit('\\"'))).otherwise(F.replace(text, F.lit("'"), F.lit("''")))
    return F.when(quote.isNull(), text).otherwise(F.concat(quote, inside, quote))


def escape_unprintable(text: Column) -> Column:
    r"""Characters that YAML can't print as \u and four hexadecimal digits."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){_UNPRINTABLE}|(?:(?!{_UNPRINTABLE}).)+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^{_UNPRINTABLE}$"), F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(x)), 4, "0")))).otherwise(x)), "")


def unescape_unprintable(text: Column) -> Column:
    r"""The characters of \u and \x escapes that YAML can't print, but for the null character; other escapes stay."""
    escape = r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}"
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){escape}|(?:(?!{escape}).)+"), F.lit(0))
    code = lambda x: F.conv(F.substring(x, F.lit(3), F.lit(4)), 16, 10).cast("int")
    plain = lambda x: F.when(code(x).between(1, 127), F.char(code(x)))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^(?:{escape})$") & plain(x).rlike(f"^{_UNPRINTABLE}$"), plain(x)).otherwise(x)), "")


def compile_markdown(templates: DataFrame, translations: DataFrame, strict: bool = True) -> DataFrame:
    """Files with the translations (doc_id, placeholder, text, and for YAML strings flags) in place; `flags` null marks Markdown strings."""
    templates = complete(templates, translations) if strict else templates
    unix = templates.select("doc_id", T.to_unix(F.col("content")).alias("content"))
    last = F.coalesce(F.element_at(F.split("flags", ":"), -1), F.lit(""))
    block = F.when(last.isin("|", ">"), F.concat(last, F.lit("\n"), F.col("text")))
    header = F.when(last.isin("|", ">"), block).otherwise(wrapped(F.col("text"), quote_for(F.col("text"), last)))
    text = F.when(F.col("flags").isNull(), F.col("text")).otherwise(escape_unprintable(header))
    by = translations if {"ord", "key"} & set(translations.columns) else translations.withColumn("ord", F.lit(0))
    edits = told(spans.marks(unix), by, how="inner").select("doc_id", "start", "end", text.alias("text"))
    done = apply_edits(unix, edits).join(templates.select("doc_id", T.newline_type(F.col("content")).alias("newline")), "doc_id")
    return done.select("doc_id", T.with_newlines(F.col("content"), F.col("newline")).alias("content"))
