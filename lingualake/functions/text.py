"""String functions as column expressions: hashes, newlines, escapes, timings, plural rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Plural rules by number.
RULES = {"zero": 0, "one": 1, "two": 2, "few": 3, "many": 4, "other": 5}


def strip(text: Column) -> Column:
    """Without the Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def string_hash(key: Column, context: Column | None = None) -> Column:
    """The md5 of key and context, joined by a colon as they are."""
    return F.md5(F.concat_ws(":", key, F.coalesce(context, F.lit("")) if context is not None else F.lit("")).cast("binary"))


def placeholder(hashed: Column, pluralized: Column | None = None) -> Column:
    return F.concat(hashed, F.when(pluralized, "_pl").otherwise("_tr") if pluralized is not None else F.lit("_tr"))


def newline_type(text: Column) -> Column:
    """DOS or UNIX, by the first line end alone."""
    at = F.locate("\n", text)
    return F.when((at > 1) & (F.substring(text, at - 1, F.lit(1)) == "\r"), "DOS").otherwise("UNIX")


def to_unix(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def with_newlines(text: Column, kind: Column) -> Column:
    """UNIX text with the line ends of `kind`."""
    return F.when(kind == "DOS", F.replace(to_unix(text), F.lit("\n"), F.lit("\r\n"))).otherwise(to_unix(text))


def line_number(text: Column, at: Column) -> Column:
    """The line, from 1, of the code point at 0-based `at`."""
    before = F.substring(text, F.lit(1), at.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_json_key(key: Column) -> Column:
    return _replaced(key, ("\\", "\\\\"), (".", "\\."))


def unescape_json_key(key: Column) -> Column:
    """Double backslashes first: two before a dot end as the dot alone."""
    return _replaced(key, ("\\\\", "\\"), ("\\.", "."))


def escape_po_key(key: Column) -> Column:
    return _replaced(key, ("\\", "\\\\"), (":", "\\:"))


def unescape_po_key(key: Column) -> Column:
    return _replaced(key, ("\\:", ":"), ("\\\\", "\\"))


def escape_android_name(name: Column) -> Column:
    return _replaced(name, ("\\", "\\\\"), ("[", "\\["))


def escape_yaml_key(key: Column) -> Column:
    return _replaced(key, (".", "<TX_DOT>"))


def unescape_yaml_key(key: Column) -> Column:
    return _replaced(key, ("<TX_DOT>", "."))


def escape_json(text: Column) -> Column:
    return _replaced(text, ("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


_JSON_ESCAPE = r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'


def unescape_json(text: Column) -> Column:
    """The value of escaped text; a backslash that starts no escape stands for itself, quotes and control characters may stand bare."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){_JSON_ESCAPE}|\\|[^\\]+"), F.lit(0))
    fixed = F.transform(parts, lambda x: F.when(x.rlike(f"^{_JSON_ESCAPE}$"), x).otherwise(escape_json(x)))
    return F.get(F.from_json(F.concat(F.lit('["'), F.array_join(fixed, ""), F.lit('"]')), "array<string>"), 0)


def escape_xml(text: Column) -> Column:
    return _replaced(text, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def unescape_xml(text: Column) -> Column:
    return _replaced(text, ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def escape_ampersands(text: Column) -> Column:
    """Ampersands that don't start an entity become entities."""
    return F.regexp_replace(text, r"&(?!(lt|gt|amp|apos|quot|#\d+|#x[0-9a-fA-F]+);)", "&amp;")


# The inline tags that Android strings may hold.
_INLINE_TAGS = "xliff:g|a|annotation|b|em|i|cite|dfn|big|small|font|tt|s|strike|del|u|sup|sub|ul|li|br|div|span|p"
#: An opening, closing or empty inline tag.
INLINE = rf"(?s)</?(?:{_INLINE_TAGS})(?:\s[^<>]*)?/?>"
_CDATA = r"(?s)<!\[CDATA\[.*?\]\]>"


def _outside(text: Column, kept: str, change) -> Column:
    """`text` with `change` applied to each part between the places that match `kept`."""
    bare = kept.removeprefix("(?s)")
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){bare}|(?:(?!{bare}).)+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(rf"(?s)^(?:{bare})$"), x).otherwise(change(x))), "")


def _quotes(text: Column) -> Column:
    return _replaced(text, ('"', '\\"'), ("'", "\\'"))


def _unquotes(text: Column) -> Column:
    return _replaced(text, ("\\'", "'"), ('\\"', '"'))


#: Any tag, whose attributes may hold greater signs in their quotes, a comment, or a stretch of text.
_TAG = r"""</?[A-Za-z_][\w:.\-]*(?:\s+[\w:.\-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*/?>"""
_MARKUP = rf"(?s){_TAG}|<!--.*?-->|[^<]+|<"


def _nested(tokens: Column) -> Column:
    """Whether every opening tag among the tokens has its closing one, properly nested, and no bare `<` stands between them."""
    name = lambda x: F.regexp_extract(x, r"^</?([A-Za-z_][\w:.\-]*)", 1)

    def step(state: Column, x: Column) -> Column:
        stack = state["stack"]
        closes, single = x.startswith("</"), x.endswith("/>") | x.startswith("<!--") | ~x.startswith("<")
        fits = F.coalesce(F.try_element_at(stack, F.lit(-1)) == name(x), F.lit(False))
        after = F.when(single, stack).when(closes, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(name(x))))
        return F.struct(after.alias("stack"), (state["fine"] & (x != "<") & (single | ~closes | fits)).alias("fine"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(True).alias("fine"))
    return F.aggregate(tokens, start, step, lambda s: s["fine"] & (F.size(s["stack"]) == 0))


def escape_around_tags(text: Column, change) -> Column:
    """`text` with `change` applied to each stretch of text and to each tag that is no inline tag.

    Where tags don't close in the order in which they open, it is applied to the text as a whole.
    """
    tokens = F.regexp_extract_all(text, F.lit(_MARKUP), F.lit(0))
    kept = lambda x: x.rlike(rf"^</?(?:{_INLINE_TAGS})(?![\w:.\-])") & x.endswith(">")
    return F.when(_nested(tokens), F.array_join(F.transform(tokens, lambda x: F.when(kept(x), x).otherwise(change(x))), "")).otherwise(change(text))


def escape_android(text: Column) -> Column:
    """Quotes outside of inline tags and a leading at sign that names no string, escaped; quotes in all tags if these don't nest."""
    return escape_around_tags(text, lambda x: F.regexp_replace(_quotes(x), "^@(?!string/)", r"\\@"))


def unescape_android(text: Column) -> Column:
    """Without the backslash of a leading at sign and those of quotes; a text in double quotes loses these and keeps single quotes' backslashes."""
    bare = F.regexp_replace(text, r"^\\@", "@")
    return F.when(bare.rlike(r'(?s)^".*"$'), F.replace(F.regexp_replace(bare, r'(?s)^"|"$', ""), F.lit('\\"'), F.lit('"'))).otherwise(_unquotes(bare))


_SPECIAL = (("&", "&amp;"), (">", "&gt;"), ("\n", "\\n"), ("\t", "\\t"), ("@", "\\@"), ("?", "\\?"))


def escape_android_special(text: Column) -> Column:
    return _replaced(text, *_SPECIAL)


def escape_android_raw(text: Column) -> Column:
    """Quotes and special characters escaped; inline tags stay, in CDATA only quotes are escaped."""
    plain = lambda x: _outside(x, INLINE, lambda y: escape_android_special(escape_android(y)))
    parts = F.regexp_extract_all(text, F.lit(rf"{_CDATA}|(?:(?!<!\[CDATA\[).)+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("<![CDATA["), _quotes(x)).otherwise(plain(x))), "")


def unescape_android_raw(text: Column) -> Column:
    """The inverse of escape_android_raw() for what it escapes."""
    pairs = (("\\?", "?"), ("\\@", "@"), ("\\t", "\t"), ("\\n", "\n"), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"))
    parts = F.regexp_extract_all(text, F.lit(rf"{_CDATA}|(?:(?!<!\[CDATA\[).)+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("<![CDATA["), _unquotes(x)).otherwise(_replaced(unescape_android(x), *pairs))), "")


def timing(text: Column, separator: str) -> Column:
    """`[h:]m:s<separator>ms` as `HH:MM:SS.mmm`; missing milliseconds are 000, short ones are padded on the right."""
    part = lambda k: F.regexp_extract(text, rf"^(?:(\d+):)?(\d+):(\d+)(?:[{separator}](\d+))?$", k)
    two = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    millis = F.when(F.length(part(4)) < 3, F.rpad(part(4), 3, "0")).otherwise(part(4))
    return F.when(text.rlike(rf"^(\d+:)?\d+:\d+([{separator}]\d+)?$"), F.concat(two(part(1)), F.lit(":"), two(part(2)), F.lit(":"), two(part(3)), F.lit("."), millis))


def rule_number(name: Column) -> Column:
    """The number of a plural rule's name; `=0`, `=1` and `=2` are zero, one and two; null for others."""
    pairs = [x for k, v in (RULES | {"=0": 0, "=1": 1, "=2": 2}).items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), name)


def plural_map(entries: Column) -> Column:
    """A map of (rule, text) structs, the last of equal rules winning."""
    last = F.aggregate(entries, F.array().cast("array<struct<rule:int,text:string>>"), lambda acc, e: F.concat(F.filter(acc, lambda a: a["rule"] != e["rule"]), F.array(F.struct(e["rule"].cast("int").alias("rule"), e["text"].alias("text")))))
    return F.map_from_entries(last)


def known_rule(name: Column) -> Column:
    """rule_number(), but a name that is none ends a query that asks for the number; with_known_rule() ends any."""
    return F.coalesce(rule_number(name), F.raise_error(F.concat(F.lit("no plural rule: "), F.coalesce(name, F.lit("null")))).cast("int"))


def checked(rows: DataFrame, test: Column, message: Column) -> DataFrame:
    """`rows` as they are; one that `test` doesn't hold for ends the query, even if no column of it is asked for."""
    return rows.filter(F.when(F.coalesce(test, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def with_known_rule(rows: DataFrame, name: Column, number: str) -> DataFrame:
    """`rows` with the number of the plural rule `name` as column `number`; a name that is none ends the query."""
    return checked(rows, rule_number(name).isNotNull(), F.concat(F.lit("no plural rule: "), F.coalesce(name, F.lit("null")))).withColumn(number, rule_number(name))


def rule_name(number: Column) -> Column:
    """The name of a plural rule's number; a number that is none ends the query."""
    names = F.create_map(*(x for k, v in RULES.items() for x in (F.lit(v), F.lit(k))))
    return F.coalesce(F.try_element_at(names, number), F.raise_error(F.concat(F.lit("no plural rule: "), F.coalesce(number.cast("string"), F.lit("null")))).cast("string"))


def plural_placeholders(hashed: Column, rules: Column, syntax: Column) -> Column:
    """`rule {hash_pl_i}` forms for a language's rule numbers in order; rules that the map `syntax` has are written as it says."""
    form = lambda rule, i: F.concat(F.coalesce(F.try_element_at(syntax, rule), rule_name(rule)), F.lit(" {"), hashed, F.lit("_pl_"), i.cast("string"), F.lit("}"))
    return F.array_join(F.transform(rules, form), " ")


# The letters of printf's conversions, of its lengths and of its flags.
_CONVERSIONS, _LENGTHS, _FLAGS = "diufFeEgGxXaAoscpn%", ("hh", "h", "ll", "l", "j", "z", "t", "L"), "+#- 0"


def _optional(*either: str) -> str:
    return f"(?:{'|'.join(either)})?"


_NUMBER = r"\d+"
#: A conversion: which argument, by number or name, flags, width, precision, length and letter.
_SPECIFIER = "%" + _optional(rf"{_NUMBER}\$", r"\(\w+\)") + f"[{_FLAGS.replace('-', chr(92) + '-')}]*" + _optional(_NUMBER) + _optional(rf"\.{_NUMBER}") + _optional(*_LENGTHS) + f"[{_CONVERSIONS}]"


def specifiers(text: Column) -> Column:
    """The printf conversions in a text, in order."""
    return F.regexp_extract_all(text, F.lit(_SPECIFIER), F.lit(0))


def decoded(data: Column) -> Column:
    """Bytes in UTF-8 as text; texts as they are."""
    return F.decode(data.cast("binary"), "UTF-8")
