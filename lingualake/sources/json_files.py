"""JSON string files: a tokenizer that keeps positions yields node rows; every format is a plan over these.

Node rows are (doc_id, seq, path, parent, name, kind, value, start, end, line, up, from, to): `path` joins escaped
keys by dots and list places as `..i..`, `value` is the raw text, without quotes for strings, between the code
points `start` and `end`; a container's `start` and `end` enclose its brackets. `up` lists the `seq` of the
containers around, the innermost last. `from` and `to` enclose the whole item, key and quotes included. A file
that is no JSON, or whose root is no object or list, gives one row of kind `error`, its message as value.

Cases: a null content is an empty file, which is no JSON. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.joins import dealt
from .batches import walked

NODES = "seq int, path string, parent string, name string, kind string, value string, start int, end int, line int, up array<int>, from int, to int"
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)
#: The members that structure_of() gives.
_FIELDS = ("string", "context", "developer_comment", "character_limit")
_PLURAL = r"^\s*\{\s*([A-Za-z_\d-]+)\s*,\s*plural\s*,\s*(.*)\}\s*$"
_HEAD = r"^\s*\{\s*[A-Za-z_\d-]+\s*,\s*plural\s*,\s*"
_BRACES = r"(?<=[{}])|(?=[{}])"


def _nodes_of(text: str) -> Iterator[tuple]:
    """The node rows of one document, which must be JSON, each as soon as it ends; only containers that are open are held.

    Behind its columns a row has the raw names from the root down to it, None below a list, and its last members among _FIELDS by name.
    """
    stack: list[list] = []  # [kind, path, next index, key, start of the key, row]
    none: dict[str, str] = {}
    line, counted = 1, 0
    for seq, m in enumerate(TOKEN.finditer(text)):
        token, top = m.group(), stack[-1] if stack else None
        if token in ":,":
            if token == ",":
                top[3] = None
            continue
        if token in "}]":
            row = stack.pop()[5]
            row[7] = row[11] = m.end()
            yield tuple(row)
            continue
        if top and top[0] == "{" and top[3] is None:
            top[3], top[4] = token[1:-1], m.start()
            continue
        opens = m.start()
        if not top:
            path = name = parent = None
            up, names = [], []
        else:
            own = top[5]
            up, parent, names = [*own[9], own[0]], top[1], None
            if top[0] == "{":
                name, opens = top[3], top[4]
                key = name.replace("\\", "\\\\").replace(".", "\\.")
                path = key if parent is None else f"{parent}.{key}"
                names = None if own[12] is None else [*own[12], name]
            else:
                name = str(top[2])
                path = f"{parent or ''}..{top[2]}.."
                top[2] += 1
        kind = {"{": "dict", "[": "list", '"': "string"}.get(token[0], "scalar")
        quoted = kind == "string"
        line += text.count("\n", counted, m.start())
        counted = m.start()
        row = [seq, path, parent, name, kind, token[1:-1] if quoted else token, m.start() + quoted, m.end() - quoted, line, up, opens, m.end(), names, none]
        if top and top[0] == "{" and name in _FIELDS:
            top[5][13][name] = row[5]
        if kind in ("dict", "list"):
            row[13] = {}
            stack.append([token, path, 0, None, 0, row])
        else:
            yield tuple(row)


def _named_rows_of(text: str | None) -> Iterable[tuple]:
    """The node rows of one document with their names, or its error row."""
    text = text or ""
    message, line = "the root is no object or list", 1
    try:
        if isinstance(json.loads(text, object_pairs_hook=lambda pairs: {}), (dict, list)):  # no object is kept
            return _nodes_of(text)
    except json.JSONDecodeError as e:
        message, line = e.msg, e.lineno
    except RecursionError:
        message = "nested too deep"
    return [(0, None, None, None, "error", message, 0, 0, line, [], 0, 0, None, {})]


def rows_of(text: str | None) -> list[tuple]:
    """The node rows of one document in order, or its error row."""
    return sorted((row[:12] for row in _named_rows_of(text)), key=lambda row: row[0])


_COLUMNS = [x.split()[0] for x in NODES.split(", ")]
_TYPES = (pa.int32(), *[pa.string()] * 5, *[pa.int32()] * 3, pa.list_(pa.int32()), *[pa.int32()] * 2)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return walked(batches, lambda text: (row[:12] for row in _named_rows_of(text)), _COLUMNS, _TYPES)


def nodes(files: DataFrame) -> DataFrame:
    return files.select("doc_id", "content").mapInArrow(_walk, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, {NODES}")


def _walk_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = lambda text: ((r[0], r[9][-1] if r[9] else None, r[12], r[4], r[5], r[6], r[11], [r[13].get(f) for f in _FIELDS] if r[13] else None) for r in _named_rows_of(text) if r[12] is not None)
    types = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
    return walked(batches, kept, ["seq", "owner", "names", "kind", "value", "start", "to", "fields"], types)


def _members(files: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, owner, names, kind, value, start, to, fields) of the nodes that are below no list: `owner` is the object's seq, `names` the raw names from the root, `fields` its last members of _FIELDS."""
    schema = "seq int, owner int, names array<string>, kind string, value string, start int, to int, fields array<string>"
    return files.select("doc_id", "content").repartition("doc_id").mapInArrow(_walk_members, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, {schema}")


def errors(files: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, message, line) of the files that are no JSON or have another root than an object or list."""
    return nodes(files).filter("kind = 'error'").select("doc_id", F.when(F.col("value").startswith("the root"), "not a container").otherwise("no JSON").alias("rule"), F.col("value").alias("message"), "line")


def object_problems(files: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, message, line) of files that are no JSON, whose root is no object, or that repeat a key."""
    found = nodes(files)
    roots = found.filter("path is null and kind = 'list'").select("doc_id", F.lit("the root is no object").alias("rule"), F.lit("a list").alias("message"), "line")
    repeated = duplicate_keys(files).select("doc_id", F.lit("duplicate key").alias("rule"), F.col("key").alias("message"), "line")
    return errors(files).unionByName(roots).unionByName(repeated)


def arb_problems(files: DataFrame) -> DataFrame:
    """object_problems(), and the entries `@key` of a key that the file lacks or whose value is no object."""
    found = nodes(files)
    names = found.filter("path is not null and size(up) = 1").select("doc_id", "name", "kind", "line")
    own = names.filter(F.col("name").rlike("^@[^@]")).withColumn("of", F.substring("name", F.lit(2), F.length("name")))
    there = names.select("doc_id", F.col("name").alias("of")).distinct().withColumn("_there", F.lit(True))
    marked = own.join(there, ["doc_id", "of"], "left")
    rule = F.when(F.col("kind") != "dict", "attributes are no object").when(F.col("_there").isNull(), "attributes of no key")
    return object_problems(files).unionByName(marked.select("doc_id", rule.alias("rule"), F.col("name").alias("message"), "line").filter("rule is not null"))


def key_path(key: Column) -> Column:
    r"""The parts of a key: cut at dots that no backslash precedes; a part in double quotes may hold dots, two of its quotes are one.

    Backslashes make the character behind them stand for itself.
    """
    parts = F.regexp_extract_all(F.concat(F.lit("."), key), F.lit(r'(?s)\.("(?:[^"\\]|\\.|"")*"(?=\.|$)|(?:[^.\\]|\\.)*)'), F.lit(1))
    bare = F.transform(parts, lambda p: F.when(p.rlike(r'(?s)^".*"$') & (F.length(p) > 1), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p))
    return F.transform(bare, lambda p: F.regexp_replace(p, r"(?s)\\(.)", "$1"))


def _unescaped(text: Column) -> Column:
    """T.unescape_json() of what stands in JSON, where most texts have no escape."""
    return F.when(F.contains(text, F.lit("\\")), T.unescape_json(text)).otherwise(text)


def at_keys(files: DataFrame, keys: DataFrame) -> DataFrame:
    """`keys` (doc_id, key) with the node of their path through the objects: seq, kind, value, null where there is none.

    Of repeated members the last counts. The parts of a key are those of key_path(); only members of objects are walked.
    """
    return _at_keys(files, keys).drop("fields")


def _at_keys(files: DataFrame, keys: DataFrame) -> DataFrame:
    """at_keys() with the `fields` of the nodes."""
    found = _members(files).repartition("doc_id")
    latest = F.max("seq").over(Window.partitionBy("doc_id", "owner", F.try_element_at("names", F.lit(-1))))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    marked = found.withColumn("_old", F.col("seq") < latest)
    # what an overwritten member holds begins before that member ends
    marked = marked.withColumn("_until", F.coalesce(F.max(F.when(F.col("_old"), F.col("to"))).over(before), F.lit(0)))
    paths = marked.filter(~F.col("_old") & (F.col("_until") <= F.col("start"))).withColumn("parts", F.transform("names", _unescaped))
    last = paths.groupBy("doc_id", "parts").agg(F.max(F.struct("seq", "kind", "value", "fields")).alias("n"))
    wanted = keys.withColumn("parts", key_path(F.col("key")))
    return wanted.join(dealt(last), ["doc_id", "parts"], "left").select(*(F.col(c) for c in keys.columns), "n.seq", "n.kind", "n.value", "n.fields")


def structure_of(files: DataFrame, keys: DataFrame) -> DataFrame:
    """`keys` (doc_id, key) with string, context, developer_comment and character_limit of the object that they name.

    Missing members are an empty text, or null for `character_limit`; keys that name no object have no row.
    """
    done = _at_keys(files, keys).filter("kind = 'dict'").select(*keys.columns, *(F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(_FIELDS)))
    text = lambda c: F.coalesce(_unescaped(F.col(c)), F.lit("")).alias(c)
    return done.select(*keys.columns, text("string"), text("context"), text("developer_comment"), F.expr("try_cast(character_limit as int)").alias("character_limit"))


def _next_form(state: Column, piece: Column) -> Column:
    """The state of _parsed after a piece, which is a brace or the text between two."""
    opening, closing = piece == "{", (piece == "}") & (state["depth"] > 0)
    done, inside = closing & (state["depth"] == 1), opening | (state["depth"] > 0)
    form = F.concat(state["form"], piece)
    found = F.struct(T.strip(state["before"]).alias("name"), form.alias("form"))
    return F.struct(
        (state["depth"] + opening.cast("int") - closing.cast("int")).alias("depth"),
        F.when(done, "").when(inside, state["before"]).otherwise(F.concat(state["before"], piece)).alias("before"),
        F.when(inside & ~done, form).otherwise("").alias("form"),
        F.when(done, F.concat(state["forms"], F.array(found))).otherwise(state["forms"]).alias("forms"),
    )


def plural_parts(text: Column) -> Column:
    """Of an ICU plural the struct (forms, rest): (rule name, braced text) structs and what is left over; null for other texts. Braces nest to any depth."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("before"), F.lit("").alias("form"), F.array().cast("array<struct<name:string,form:string>>").alias("forms"))
    end = lambda x: F.struct(x["forms"].alias("forms"), T.strip(F.concat(x["before"], x["form"])).alias("rest"))
    parts = F.aggregate(F.split(F.regexp_extract(text, _PLURAL, 2), _BRACES), start, _next_form, end)
    return F.when(text.rlike(_PLURAL), parts)


def with_plurals(rows: DataFrame, numeric: bool = False) -> DataFrame:
    """`rows` with pluralized, strings (rule number to text) and icu_error; `=N` rules make a regular string unless `numeric`.

    A plural with text left over or an unknown rule is a regular string with the error named. Of plurals
    `start` and `end` enclose the forms alone.
    """
    forms = F.col("_parts.forms")
    rows = rows.withColumn("_parts", plural_parts(F.col("value")))
    plain = F.lit(False) if numeric else F.exists(forms, lambda f: f["name"].startswith("="))
    fine = F.forall(forms, lambda f: T.rule_number(f["name"]).isNotNull())
    known = F.col("_parts").isNotNull() & (F.size(forms) > 0) & ~plain & (F.col("_parts.rest") == "") & fine
    entries = F.transform(forms, lambda f: F.struct(T.rule_number(f["name"]).alias("rule"), F.regexp_replace(f["form"], r"(?s)^\{(.*)\}$", "$1").alias("text")))
    plural = F.coalesce(known, F.lit(False))
    error = F.when(F.col("_parts").isNull() | plain, None).when((F.size(forms) == 0) | (F.col("_parts.rest") != ""), "invalid plural format").when(~fine, "invalid plural rule")
    strings = F.when(plural, T.plural_map(entries)).otherwise(F.create_map(F.lit(5), F.col("value")))
    done = rows.withColumns({"pluralized": plural, "strings": strings, "icu_error": error})
    head, tail = F.length(F.regexp_extract("value", _HEAD, 0)), F.length(F.regexp_extract("value", r"\s*\}\s*$", 0))
    if "start" in rows.columns:
        done = done.withColumns({"start": F.when(plural, F.col("start") + head).otherwise(F.col("start")), "end": F.when(plural, F.col("end") - tail).otherwise(F.col("end"))})
    return done.drop("_parts")


def icu_problems(files: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, key, line) of strings that start like a plural but are none."""
    return with_plurals(_filled(nodes(files))).filter("icu_error is not null").select("doc_id", F.col("icu_error").alias("rule"), F.col("path").alias("key"), "line")


def _finished(rows: DataFrame, context: Column | None = None, comment: Column | None = None) -> DataFrame:
    """String units of `rows` (doc_id, seq, key, value, pluralized, strings, start, end, line), numbered in order."""
    context = F.lit("") if context is None else context
    hashed = T.string_hash(F.col("key"), context)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return rows.select("doc_id", "seq", "key", context.alias("context"), "pluralized", "strings", order.alias("ord"), (F.lit("") if comment is None else comment).alias("developer_comment"), hashed.alias("string_hash"), T.placeholder(hashed, F.col("pluralized")).alias("placeholder"), "value", "start", "end", "line")


def _filled(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("kind") == "string") & (T.strip(F.col("value")) != "") & F.col("path").isNotNull())


def key_value_units(files: DataFrame) -> DataFrame:
    """Every string that is not blank, by its path."""
    return _finished(with_plurals(_filled(nodes(files)).withColumn("key", F.col("path"))))


def duplicate_keys(files: DataFrame) -> DataFrame:
    """Rows (doc_id, key, line) of every later occurrence of a path."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "path").orderBy("seq"))
    return nodes(files).filter("path is not null").withColumn("_n", rank).filter("_n > 1").select("doc_id", F.col("path").alias("key"), "line")


def arb_units(files: DataFrame) -> DataFrame:
    """Root strings, with context and description of their `@` entry; entries of a type other than text are left out, plurals with a blank form too."""
    rows = nodes(files)
    meta = rows.filter(F.col("parent").startswith("@") & F.col("name").isin("type", "context", "description"))
    meta = meta.groupBy("doc_id", F.substring("parent", F.lit(2), F.length("parent")).alias("key")).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"m_{n}") for n in ("type", "context", "description")))
    own = _filled(rows.filter("parent is null")).filter(~F.col("path").startswith("@")).withColumn("key", F.col("path"))
    both = own.join(meta, ["doc_id", "key"], "left").filter("m_type is null or m_type = 'text'")
    units = with_plurals(both, numeric=True).filter(~(F.col("pluralized") & F.exists(F.map_values("strings"), lambda x: T.strip(x) == "")))
    return _finished(units, F.coalesce("m_context", F.lit("")), F.coalesce("m_description", F.lit("")))


def structured_units(files: DataFrame) -> DataFrame:
    """Objects with a filled `string`: it is their text; context, developer_comment and character_limit come along."""
    rows = nodes(files).filter("parent is not null")
    own = rows.groupBy("doc_id", F.col("parent").alias("key")).agg(*(F.max(F.when(F.col("name") == n, F.struct("seq", "kind", "value", "start", "end", "line"))).alias(n) for n in ("string", "context", "developer_comment", "character_limit")))
    leaves = own.filter((F.col("string.kind") == "string") & (T.strip(F.col("string.value")) != ""))
    flat = leaves.select("doc_id", "key", "string.*", T.unescape_json(F.col("context.value")).alias("m_context"), T.unescape_json(F.col("developer_comment.value")).alias("m_comment"), F.expr("try_cast(character_limit.value as int)").alias("character_limit"))
    limits = flat.select("doc_id", "key", "character_limit")
    done = _finished(with_plurals(flat), F.coalesce("m_context", F.lit("")), F.coalesce("m_comment", F.lit("")))
    return done.join(limits, ["doc_id", "key"])


def chrome_units(files: DataFrame) -> DataFrame:
    """Strings whose path ends in `message`, and plurals anywhere; the description of the first path part is the comment."""
    rows = nodes(files)
    descriptions = rows.filter("name = 'description' and kind = 'string'").select("doc_id", F.col("parent").alias("root"), F.col("value").alias("description"))
    own = with_plurals(_filled(rows).withColumn("key", F.col("path"))).filter(F.col("pluralized") | F.col("key").endswith("message"))
    both = own.withColumn("root", F.substring_index("key", ".", 1)).join(descriptions, ["doc_id", "root"], "left")
    return _finished(both, None, F.when(F.col("pluralized"), "").otherwise(F.coalesce("description", F.lit(""))))


def chrome_v3_units(files: DataFrame) -> DataFrame:
    """The `message` strings of root objects, blank ones too, by the object's raw key."""
    rows = nodes(files)
    roots = rows.filter("parent is null and kind = 'dict' and path is not null").select("doc_id", "path", F.col("name").alias("key"))
    inner = rows.join(roots.withColumnRenamed("path", "parent"), ["doc_id", "parent"])
    text = inner.filter("name = 'message' and kind = 'string'")
    about = inner.filter("name = 'description' and kind = 'string'").select("doc_id", "parent", F.col("value").alias("description"))
    return _finished(with_plurals(text.join(about, ["doc_id", "parent"], "left")), None, F.coalesce("description", F.lit("")))


def structured_problems(files: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, key, line) of objects whose `string` is neither text nor empty."""
    bad = nodes(files).filter("name = 'string' and parent is not null and kind <> 'string' and value not in ('null', 'false', '0')")
    return bad.select("doc_id", F.lit("string is no text").alias("rule"), F.col("parent").alias("key"), "line")


def slots(units: DataFrame) -> DataFrame:
    """Rows (doc_id, start, end, placeholder) of what a template replaces in each document."""
    return units.select("doc_id", "start", "end", "placeholder")


def find_children(found: DataFrame, *names: str) -> DataFrame:
    """Rows (doc_id, seq, and for each name its value, null if missing) of each object; of repeated members the last counts."""
    own = found.filter("size(up) > 0").groupBy("doc_id", F.try_element_at("up", F.lit(-1)).alias("seq")).agg(*(F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("seq"))).alias(n) for n in names))
    return found.filter("kind = 'dict'").select("doc_id", "seq").join(own, ["doc_id", "seq"], "left")
