"""Android, Apple and custom XML string files as plans over node rows.

Cases: a file that is not well formed, or has another root, gives no units; xml_walk.errors() and the problem
reports name it. Blank strings are no units. Repeated rows of a file are separate files only if their ids differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..functions.joins import dealt
from ..storing import stored
from . import xml_walk

_KINDS = ("string", "string-array", "plurals")


def _blank(text: Column) -> Column:
    return T.strip(F.coalesce(text, F.lit(""))) == ""


def _numbered(rows: DataFrame, context: Column, pluralized: Column, comment: Column) -> DataFrame:
    hashed = T.string_hash(F.col("key"), context)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "item")) - 1
    return rows.select("doc_id", "key", context.alias("context"), pluralized.alias("pluralized"), "strings", order.alias("ord"), comment.alias("developer_comment"), hashed.alias("string_hash"), T.placeholder(hashed, pluralized).alias("placeholder"), "seq", "start", "end")


def android_nodes(files: DataFrame) -> DataFrame:
    return xml_walk.nodes(files, *_KINDS, "item")


def android_elements(found: DataFrame, beta: bool = False) -> DataFrame:
    """String elements below the root: name, product, comment, items (node structs in order) and whether they are left out.

    A comment goes to the next element that has a string; an element left out takes it away, one without a
    string leaves it to the next. If `beta` it goes, as it stands, to the next element whatever that is.
    """
    own = F.struct("seq", "tag", F.col("attrs")["quantity"].alias("quantity"), "start", "open_end", "close_start", "end", "tail_end", "text", "inner", "line")
    top = F.col("depth") == 1
    below = found.filter((F.get("above", F.lit(0)) == "resources") & (top | ((F.col("depth") == 2) & (F.col("kind") == "element"))) & F.col("doc_id").isNotNull())
    element = F.struct(*(c for c in found.columns if c not in ("doc_id", "seq")))
    # an element with its items is found by grouping, and all that follows needs a file's rows in order: they are dealt out once
    grouped = below.repartition("doc_id").groupBy("doc_id", F.when(top, F.col("seq")).otherwise(F.col("parent")).alias("seq"))
    rows = grouped.agg(F.first(F.when(top, element), ignorenulls=True).alias("_top"), F.collect_list(F.when(~top, own)).alias("items"))
    rows = rows.select("doc_id", "seq", "_top.*", F.array_sort("items").alias("items")).filter((F.col("kind") == "comment") | F.col("tag").isin(*_KINDS))
    filled = F.when(F.col("tag") == "string", ~_blank(F.col("inner"))).otherwise(F.exists("items", lambda x: ~_blank(x["inner"])))
    rows = rows.withColumns({"is_comment": F.col("kind") == "comment", "ignored": F.coalesce(F.col("attrs")["translatable"] == "false", F.lit(False)), "filled": filled})
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # what an element that takes comments leaves to the next is none
    left = F.when(F.col("is_comment"), F.col("text") if beta else T.strip(F.col("text"))).when(F.col("ignored") | F.col("filled") | F.lit(beta), "")
    tags = rows.withColumn("comment", F.coalesce(F.last(left, ignorenulls=True).over(before), F.lit(""))).filter(~F.col("is_comment"))
    return tags.withColumns({"name": F.col("attrs")["name"], "product": F.coalesce(F.col("attrs")["product"], F.lit(""))}).drop("is_comment", "kind")


_UNIT = "array<struct<item:int,key:string,strings:map<int,string>,start:int,end:int>>"


def _strings(rows: DataFrame, beta: bool = False) -> DataFrame:
    """The strings of android_elements() with key, strings and the span that a template replaces."""
    rows = rows.filter("not ignored and name is not null")
    rows = rows if beta else rows.withColumn("name", T.escape_android_name(F.col("name")))
    unit = lambda item, key, strings, start, end: F.struct(item.alias("item"), key.alias("key"), strings.alias("strings"), start.alias("start"), end.alias("end"))
    said = lambda x: F.create_map(F.lit(5), x)
    only = F.filter("items", lambda x: x["tag"] == "item")
    single = F.array(unit(F.lit(0), F.col("name"), said(F.col("inner")), F.col("open_end"), F.col("close_start")))
    each = F.transform(only, lambda x, i: unit(i, F.concat("name", F.lit("["), i, F.lit("]")), said(x["inner"]), x["open_end"], x["close_start"]))
    entries = F.transform(F.filter(only, lambda x: T.rule_number(x["quantity"]).isNotNull()), lambda x: F.struct(T.rule_number(x["quantity"]).alias("rule"), F.coalesce(x["inner"], F.lit("")).alias("text")))
    plural = F.array(unit(F.lit(0), F.col("name"), T.plural_map(entries), F.get("items", F.lit(0))["start"], F.try_element_at("items", F.lit(-1))["end"]))
    found = F.when(F.col("tag") == "string", single.cast(_UNIT)).when(F.col("tag") == "string-array", each.cast(_UNIT)).when(F.size("items") > 0, plural.cast(_UNIT))
    some = (F.forall if beta else F.exists)(F.map_values("strings"), lambda x: ~_blank(x))
    return rows.select("doc_id", "seq", "tag", "product", "comment", F.explode(found).alias("_unit")).select("doc_id", "seq", "tag", "product", "comment", "_unit.*").filter(some)


def android_units(files: DataFrame, beta: bool = False) -> DataFrame:
    """Strings, array items by place, and plurals; blank ones are none.

    A name and product that an element of another tag had before get the tag at the product's end as context. If `beta`
    one blank form drops its plural, names are keys as they stand and contexts the products alone.
    """
    every = _strings(android_elements(android_nodes(files), beta), beta)
    if beta:
        return _numbered(every, F.col("product"), F.col("tag") == "plurals", F.col("comment"))
    first = F.first("tag").over(Window.partitionBy("doc_id", "key", "product").orderBy("seq"))
    context = F.when(F.col("tag") == first, F.col("product")).otherwise(F.concat("product", "tag"))
    return _numbered(every.withColumn("_context", context), F.col("_context"), F.col("tag") == "plurals", F.col("comment"))


def android_problems(files: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, key, line) of what breaks the rules of Android files, files that are not well formed or have another root included."""
    found = android_nodes(files)
    rows = android_elements(found)
    n = F.row_number().over(Window.partitionBy("doc_id", "name", "product", "tag").orderBy("seq"))
    items = F.col("items")
    rules = F.transform(items, lambda x: T.rule_number(x["quantity"]))
    plural = (F.col("tag") == "plurals") & (F.size("items") > 0)
    blank, whole = F.exists(items, lambda x: _blank(x["inner"])), F.exists(items, lambda x: ~_blank(x["inner"]))
    tests = {
        "missing name": F.col("name").isNull(),
        "duplicate name": F.col("name").isNotNull() & (F.col("_n") > 1) & F.col("filled"),
        "wrong tag": plural & F.exists(items, lambda x: x["tag"] != "item"),
        "missing quantity": plural & F.exists(items, lambda x: (x["tag"] == "item") & x["quantity"].isNull()),
        "bad quantity": plural & F.exists(items, lambda x: x["quantity"].isNotNull() & T.rule_number(x["quantity"]).isNull()),
        "no plurals": (F.col("tag") == "plurals") & (F.size("items") == 0) & _blank(F.col("inner")),
        "missing other": plural & whole & ~F.coalesce(F.array_contains(rules, 5), F.lit(False)),
        "partly blank plural": plural & blank & whole,
        "leading text": (F.col("tag") != "string") & (F.size("items") > 0) & ~_blank(F.col("text")),
    }
    listed = F.array_compact(F.array(*(F.when(test, F.lit(rule)) for rule, test in tests.items())))
    broken = rows.filter("not ignored").withColumn("_n", n).select("doc_id", F.explode(listed).alias("rule"), F.col("name").alias("key"), "line")
    behind = found.filter("depth = 1 and tail_end > end").select("doc_id", "end", "tail_end", F.col("attrs")["name"].alias("key"), "line")
    tails = spans.with_text(behind, files, F.col("end"), F.col("tail_end"), "tail").filter(~_blank(F.col("tail"))).select("doc_id", F.lit("trailing text").alias("rule"), "key", "line")
    roots = found.filter("depth = 0 and kind = 'element' and tag <> 'resources'").select("doc_id", F.lit("wrong root").alias("rule"), F.col("tag").alias("key"), "line")
    bad = xml_walk.errors(found).select("doc_id", "rule", F.col("message").alias("key"), "line")
    return broken.unionByName(tails).unionByName(roots).unionByName(bad)


def unescaped_problems(units: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, key) of units with a quote that no backslash escapes, outside of inline tags."""
    bare = lambda x: F.regexp_replace(x, T.INLINE, "")
    bad = F.exists(F.map_values("strings"), lambda x: bare(x).rlike(r"(?<!\\)['\"]"))
    return units.filter(bad).select("doc_id", F.lit("unescaped quote").alias("rule"), "key")


def _pairs(rows: DataFrame) -> DataFrame:
    """Elements below the dicts of node rows, each `key` with the element that follows it as value, and the file's first dict as `top`."""
    order = Window.partitionBy("doc_id", "parent").orderBy("seq")
    value = F.struct("seq", "tag", "start", "open_end", "close_start", "end", "tail_end", "inner")
    first = F.min(F.when(F.col("tag") == "dict", F.col("seq"))).over(Window.partitionBy("doc_id"))
    own = rows.filter("kind = 'element'").select("doc_id", "seq", "parent", "tag", "start", "open_end", "close_start", "end", "tail_end", "inner", "line").repartition("doc_id")
    own = own.withColumn("top", first).withColumns({"value": F.lead(value).over(order), "place": F.row_number().over(order), "before": F.lag("end").over(order)})
    return own.filter("tag = 'key' and place % 2 = 1").select("doc_id", "seq", "parent", "inner", "start", "line", "value", "before", "top")


_SERVICE = ("NSStringFormatSpecTypeKey", "NSStringFormatValueTypeKey", "NSStringLocalizedFormatKey")


def _variables(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Main keys, and variables (doc_id, seq, main, item, variable, format) with their value structs."""
    mains = pairs.filter("parent = top").select("doc_id", "seq", F.col("inner").alias("main"), "value", "line")
    inside = pairs.select("doc_id", F.col("parent").alias("owner"), F.col("seq").alias("item"), F.col("inner").alias("name"), F.col("value").alias("own"), F.col("start").alias("key_start"), F.col("before"))
    held = mains.select("doc_id", "seq", "main", F.col("value.seq").alias("owner")).join(dealt(inside), ["doc_id", "owner"])
    formats = held.filter("name = 'NSStringLocalizedFormatKey'").select("doc_id", "owner", F.col("own.inner").alias("format"))
    variables = held.filter("own.tag = 'dict'").join(dealt(formats), ["doc_id", "owner"], "left").withColumnRenamed("name", "variable")
    return mains, variables


def stringsdict_units(files: DataFrame) -> DataFrame:
    """One plural for each variable of each main key; text around the variable in the format joins every form."""
    pairs = stored(_pairs(xml_walk.nodes(files)))
    _, variables = _variables(pairs)
    rules = pairs.select("doc_id", F.col("parent").alias("_owner"), "seq", F.col("inner").alias("name"), F.col("value.inner").alias("text"), F.col("start").alias("from"), F.col("value.end").alias("to"))
    rules = rules.filter(T.rule_number(F.col("name")).isNotNull()).groupBy("doc_id", "_owner").agg(F.array_sort(F.collect_list(F.struct("seq", T.rule_number(F.col("name")).alias("rule"), "text"))).alias("pairs"), F.min("from").alias("start"), F.max("to").alias("end"))
    rows = variables.withColumn("_owner", F.col("own.seq")).join(dealt(rules), ["doc_id", "_owner"])
    first = F.regexp_extract("format", r"%#@([^@]*)@", 1)
    lead = F.when(first == F.col("variable"), F.regexp_extract("format", r"(?s)^(.*?)%#@", 1)).otherwise("")
    rest = F.when(first == F.col("variable"), F.regexp_extract("format", r"(?s)%#@[^@]*@(.*)$", 1)).otherwise("")
    rows = rows.withColumns({"lead": F.coalesce(lead, F.lit("")), "rest": F.coalesce(rest, F.lit(""))})
    entries = F.transform("pairs", lambda p: F.struct(p["rule"].alias("rule"), T.unescape_xml(F.concat("lead", p["text"], "rest")).alias("text")))
    done = rows.select("doc_id", "seq", "item", F.col("main").alias("key"), "variable", T.plural_map(entries).alias("strings"), "start", "end")
    return _numbered(done, F.col("variable"), F.lit(True), F.lit(""))


def stringsdict_problems(files: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, key, line): keys without a value or a dict, repeated main keys, unknown rules, no rule `other`, bad files."""
    found = xml_walk.nodes(files)
    pairs = stored(_pairs(found))
    mains, variables = _variables(pairs)
    n = F.row_number().over(Window.partitionBy("doc_id", "main").orderBy("seq"))
    listed = F.array_compact(F.array(F.when(F.col("value").isNull(), F.lit("missing value")), F.when(F.col("value.tag") != "dict", F.lit("value is no dict")), F.when(F.col("_n") > 1, F.lit("duplicate main key"))))
    broken = mains.withColumn("_n", n).select("doc_id", F.explode(listed).alias("rule"), F.col("main").alias("key"), "line")
    rules = pairs.select("doc_id", F.col("parent").alias("_owner"), F.col("inner").alias("name")).filter(~F.col("name").isin(*_SERVICE))
    forms = variables.withColumn("_owner", F.col("own.seq")).join(dealt(rules), ["doc_id", "_owner"]).groupBy("doc_id", "main", "variable").agg(F.collect_set("name").alias("names"))
    bad = F.array_compact(F.array(F.when(F.exists("names", lambda x: T.rule_number(x).isNull()), F.lit("bad rule")), F.when(~F.array_contains("names", "other"), F.lit("missing other"))))
    plural = forms.select("doc_id", F.explode(bad).alias("rule"), F.col("main").alias("key"), F.lit(None).cast("int").alias("line"))
    return broken.unionByName(plural).unionByName(xml_walk.errors(found).select("doc_id", "rule", F.col("message").alias("key"), "line"))


def custom_strings(found: DataFrame, section: str, string: str, base: str, variant: str, section_id: str, key: str, variant_id: str) -> DataFrame:
    """Rows of each base and variant of each string of each section in order, blank ones too: sid, id, key, inner and the places."""
    sections = xml_walk.descendants(found, section).select("doc_id", F.col("seq").alias("s"), F.col("attrs")[section_id].alias("sid"))
    strings = xml_walk.descendants(found, string).select("doc_id", F.col("parent").alias("s"), F.col("seq").alias("k"), F.col("attrs")[key].alias("id"), F.col("line").alias("at"))
    parts = xml_walk.descendants(found, base, variant).select("doc_id", F.col("parent").alias("k"), F.col("seq").alias("item"), "tag", F.col("attrs")[variant_id].alias("vid"), F.col("inner"), F.col("open_end").alias("start"), F.col("close_start").alias("end"))
    rows = parts.join(strings, ["doc_id", "k"]).join(sections, ["doc_id", "s"])
    own = F.when(F.col("tag") == variant, F.concat("id", F.lit("::"), "vid")).otherwise(F.col("id"))
    return rows.withColumns({"key": own, "seq": F.struct("s", "k")})


_CUSTOM = {"section": "section", "string": "string", "base": "base", "variant": "variant", "section_id": "name", "key": "key", "variant_id": "context"}


def custom_units(files: DataFrame, **names: str) -> DataFrame:
    """The base and variants of each string of each section: key or `key::variant`, context the section's id."""
    names = _CUSTOM | names
    rows = custom_strings(xml_walk.nodes(files, names["base"], names["variant"]), **names).filter(~_blank(F.col("inner")) & F.col("key").isNotNull())
    return _numbered(rows.withColumn("strings", F.create_map(F.lit(5), F.col("inner"))), F.col("sid"), F.lit(False), F.lit(""))


def custom_problems(files: DataFrame, root: str = "strings", **names: str) -> DataFrame:
    """Rows (doc_id, rule, key, line): a wrong root, strings without a key or sections without an id, bad files."""
    names = _CUSTOM | names
    found = xml_walk.nodes(files, names["base"], names["variant"])
    roots = found.filter("depth = 0 and kind = 'element'").filter(F.col("tag") != root).select("doc_id", F.lit("root not found").alias("rule"), F.col("tag").alias("key"), "line")
    rows = custom_strings(found, **names)
    missing = rows.filter("key is null").select("doc_id", F.lit("missing key").alias("rule"), F.col("inner").alias("key"), F.col("at").alias("line"))
    nameless = xml_walk.descendants(found, names["section"]).filter(F.col("attrs")[names["section_id"]].isNull()).select("doc_id", F.lit("missing section id").alias("rule"), F.lit(None).cast("string").alias("key"), "line")
    return roots.unionByName(missing).unionByName(nameless).unionByName(xml_walk.errors(found).select("doc_id", "rule", F.col("message").alias("key"), "line"))
