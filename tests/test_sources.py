"""Formats on small files: odd input, escapes, rules."""

import pytest
from pyspark.sql import functions as F

from lingualake.functions import text as T
from lingualake.operators import compiling, json_compiling, markdown_compiling, office_compiling, po_compiling, syncing, translating, validating, xml_compiling
from lingualake import formats
from lingualake.sources import json_files, markdown, office, plaintext, po, subtitles, xml_files, xml_walk, yaml_files


def files(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "doc_id bigint, content string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_plaintext_keeps_white_space_and_newlines(spark):
    docs = files(spark, "  a b \r\n\r\n\tc\r\n", "x\ny", "", "\n \n")
    segments = plaintext.segments(docs)
    assert rows(plaintext.units(docs), "doc_id", "ord", "text") == [(0, 0, "a b"), (0, 1, "c"), (1, 0, "x"), (1, 1, "y")]
    told = segments.filter("text is not null").select("doc_id", "placeholder", "ord", "text")
    assert dict(rows(compiling.compile_plaintext(segments, told), "doc_id", "content")) == dict(rows(docs, "doc_id", "content"))
    missing = compiling.compile_plaintext(segments, told.filter("ord = 0"))
    assert T.string_hash and "_tr" in dict(rows(missing, "doc_id", "content"))[1]


def test_srt_rules(spark):
    docs = files(spark, "1\n00:00:01,5 --> 00:00:02,000\nhi\nthere\n\n1\n00:00:03,000 --> 00:00:04,000\nagain\n\nx\n0:0:1 --> 0:0:2\nt\n\n9\nonly")
    assert rows(subtitles.srt_units(docs), "key", "text", "occurrences") == [("1", "hi\nthere", "00:00:01.500,00:00:02.000")]
    assert rows(validating.srt_report(docs), "rule", "places") == [("not enough lines", 1), ("order is not a positive number", 1), ("order is not ascending", 1)]


def test_json_paths_escapes_and_places(spark):
    text = '{"a.b": "x", "c": ["y", {"d": "z \\" q"}, [" "]], "n": null, "e": {"f": 1}}'
    units = json_files.key_value_units(files(spark, text))
    assert rows(units, "key", "value") == [("a\\.b", "x"), ("c..0..", "y"), ("c..1...d", 'z \\" q')]
    template = compiling.compile_slots(files(spark, text), json_files.slots(units))
    back = compiling.compile_slots(files(spark, text), json_files.slots(units), units.select("doc_id", "placeholder", "ord", F.col("value").alias("text")))
    assert template.first()["content"].count("_tr") == 3
    assert back.first()["content"] == text


def test_json_duplicates_and_plurals(spark):
    docs = files(spark, '{"a": "1",\n "b": "2",\n "a": "3"}', '{"p": "{n, plural, one {x} other {{n} y}}", "q": "{n, plural, one {x} odd {y}}"}')
    assert rows(validating.duplicate_json_keys(docs), "doc_id", "key", "line") == [(0, "a", 3)]
    units = json_files.key_value_units(docs.filter("doc_id = 1"))
    assert rows(units, "key", "pluralized") == [("p", True), ("q", False)]
    assert units.filter("key = 'p'").first()["strings"] == {1: "x", 5: "{n} y"}


def test_members_without_translation_go(spark):
    docs = files(spark, '{"a": {"x": "1", "y": {"z": "2"}}, "b": "3", "c": 4}')
    units = json_files.key_value_units(docs)
    told = units.filter("key = 'b'").select("doc_id", "placeholder", "ord", "pluralized", F.create_map(F.lit(5), F.lit("drei")).alias("strings"))
    templates = compiling.compile_slots(docs, json_files.slots(units))
    assert json_compiling.compile_members(templates, told, clean=True).first()["content"] == '{"b": "drei", "c": 4}'
    assert json_compiling.compile_members(templates, told).first()["content"] == '{, "b": "drei", "c": 4}'


def test_android_comments_products_and_rules(spark):
    text = '<resources><!-- one --><string name="a">A</string><string name="b">B</string><!-- two --><!-- three --><string name="a" product="tv">C</string><plurals name="p"><item quantity="one">1</item></plurals><string name="a">D</string></resources>'
    docs = files(spark, text)
    assert rows(xml_files.android_units(docs), "key", "context", "developer_comment") == [("a", "", ""), ("a", "", "one"), ("a", "tv", "three"), ("b", "", ""), ("p", "", "")]
    assert rows(xml_files.android_problems(docs), "rule", "key") == [("duplicate name", "a"), ("missing other", "p")]


def test_po_keys_and_problems(spark):
    docs = files(spark, 'msgid ""\nmsgstr "h"\n\n# t\n#. c\n#, fuzzy\nmsgid "a:b"\nmsgstr "x"\n\nmsgid "n"\nmsgid_plural "ns"\nmsgstr[0] "1"\nmsgstr[1] ""\n')
    assert rows(po.units(docs), "key", "fuzzy", "ord", "developer_comment") == [("a\\:b", True, None, "c\nt"), ("n:ns", False, 0, "\n")]
    assert rows(po.problems(docs), "rule", "key") == [("incomplete plurals", "n")]


def test_yaml_ignores_other_scalars_and_reads_tags(spark):
    docs = files(spark, "a.b: x\nn: 5\nl:\n- y\n- !t z\n1: one\n")
    assert rows(yaml_files.units(docs), "key", "text", "context") == [("<1>", "one", ""), ("a<TX_DOT>b", "x", ""), ("l.[0]", "y", ""), ("l.[1]", "z", "t")]


def test_markdown_blocks(spark):
    docs = files(spark, "# T #\n\npara\nmore\n\n- i\n- j\n\n| a | b |\n| - | - |\n| c | 1 |\n\n```\ncode\n\nx\n```\n")
    assert rows(markdown.units(docs), "ord", "text") == [(0, "T #"), (1, "para\nmore"), (2, "i"), (3, "j"), (4, "a"), (5, "b"), (6, "c"), (7, "```\ncode\n\nx\n```")]


def test_ordered_sync_stops_at_a_new_string(spark):
    slots = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "d")], "doc_id bigint, seg int, placeholder string")
    strings = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (0, 3, "d")], "doc_id bigint, ord int, placeholder string")
    assert rows(syncing.sync_ordered(slots, strings), "place", "placeholder", "action") == [(0, "a", "keep"), (1, "b", "keep"), (2, "c", "add"), (3, "d", "add")]
    assert rows(syncing.sync_set(slots, strings), "placeholder", "action") == [("a", "keep"), ("b", "keep"), ("c", "add"), ("d", "keep")]


def test_translation_takes_the_first_of_repeated_phrases(spark):
    units = spark.createDataFrame([(0, "hi"), (1, "bye")], "doc_id bigint, text string")
    phrases = spark.createDataFrame([("hi", "b"), ("hi", "a")], "source string, target string")
    assert rows(translating.translate(units, phrases, "el"), "text", "translation") == [("bye", "el:bye"), ("hi", "a")]


def test_scalar_functions(spark):
    assert one(spark, T.timing(F.lit("1:2:3,4"), ",")) == "01:02:03.400"
    assert one(spark, T.timing(F.lit("2:3"), ".")) == "00:02:03.000"
    assert one(spark, T.timing(F.lit("soon"), ",")) is None
    assert one(spark, T.strip(F.lit(" \t x  "))) == "x"
    assert one(spark, T.unescape_po_key(T.escape_po_key(F.lit("a\\:b")))) == "a\\:b"
    assert one(spark, T.escape_ampersands(F.lit("a & b &amp; &#12;"))) == "a &amp; b &amp; &#12;"
    assert one(spark, compiling.serialize_plural(F.create_map(F.lit(5), F.lit("b"), F.lit(1), F.lit("a")))) == "other {b} one {a}"


def test_pruning_at_any_depth_and_in_lists(spark):
    docs = files(spark, '{"a": {"b": {"c": {"d": {"e": "x"}}}}, "l": ["x", "y", {"m": ["x"]}, "x"], "n": [["x"], {"o": "x"}], "p": {}, "q": "y, , {, z"}', '{"a": ["x", 1, "x"], "b": {"c": "x", "d": 2}}', '{"a": {"b": ["x"]}}')
    units = json_files.key_value_units(docs)
    told = units.filter("value <> 'x'").select("doc_id", "placeholder", "ord", "pluralized", F.create_map(F.lit(5), F.upper("value")).alias("strings"))
    found = rows(json_compiling.compile_members(compiling.compile_slots(docs, json_files.slots(units)), told, clean=True), "doc_id", "content")
    assert found == [(0, '{"l": ["Y"], "p": {}, "q": "Y, , {, Z"}'), (1, '{"a": [1], "b": {"d": 2}}'), (2, "{}")]


def test_plurals_with_nested_selects(spark):
    one, other = "{g, select, male {He has {n} tip} other {They}}", "{a {b {c {d {e} f}}}} it's"
    docs = files(spark, '{"k": "{n, plural, one {%s} other {%s}}", "u": "{n, plural, one {a { b} other {c}}", "v": "{n, plural, some {a} other {c}}"}' % (one, other))
    found = rows(json_files.key_value_units(docs), "key", "pluralized", F.try_element_at("strings", F.lit(1)), F.substring("placeholder", -2, 2))
    assert [x[:2] for x in found] == [("k", True), ("u", False), ("v", False)] and found[0][2] == one and found[0][3] == "pl"
    assert json_files.key_value_units(docs).filter("key = 'k'").first()["strings"] == {1: one, 5: other}


EMPTY = {
    "xml": lambda d: xml_files.android_units(d), "json": lambda d: json_files.key_value_units(d), "po": lambda d: po.units(d), "yaml": lambda d: yaml_files.units(d),
    "markdown": lambda d: markdown.front_matter_units(d), "vtt": lambda d: subtitles.vtt_units(d), "stringsdict": lambda d: xml_files.stringsdict_units(d), "custom": lambda d: xml_files.custom_units(d),
}


@pytest.mark.parametrize("name", list(EMPTY))
def test_null_empty_and_broken_files_give_no_units(spark, name):
    docs = files(spark, None, "", " \n", "<a", "}", "a: [")
    assert EMPTY[name](docs.filter("doc_id < 3")).collect() == []
    EMPTY[name](docs).collect()  # a broken file ends nothing
    assert EMPTY[name](docs.filter("false")).collect() == []


def test_walker_keeps_places_and_names_errors(spark):
    text = "<?xml version='1.0'?>\n<r a='1' b=\"2\">x<!-- c --><e/>t<f><![CDATA[<g>]]></f> u</r>\n"
    found = {(r["kind"], r["tag"]): r for r in xml_walk.nodes(files(spark, text)).collect()}
    root, empty, cdata = found["element", "r"], found["element", "e"], found["element", "f"]
    assert root["attrs"] == {"a": "1", "b": "2"} and root["text"] == "x" and root["line"] == 2 and text[root["start"] : root["end"]].endswith("</r>")
    assert text[empty["end"] : empty["tail_end"]] == "t" and cdata["inner"] == "<![CDATA[<g>]]>" and cdata["up"] == [root["seq"]] and cdata["above"] == ["r"]
    bad = files(spark, "<a><b></a>", "<a>", "no", "<a/><b/>", "<a x='1' x='2'/>", "<a>1 < 2</a>", None)
    assert len(rows(xml_walk.errors(xml_walk.nodes(bad)), "doc_id", "message")) == 7


def test_failfast_raises_whatever_is_asked(spark):
    problems = validating.duplicate_json_keys(files(spark, '{"a": 1, "a": 2}', "{}"))
    assert validating.failfast(problems.filter("doc_id = 1")).count() == 0
    with pytest.raises(Exception, match="breaks the rules"):
        validating.failfast(problems).count()
    with pytest.raises(Exception, match="no plural rule"):
        spark.range(1).select(T.known_rule(F.lit("odd"))).collect()


def test_extra_strings_end_a_strict_compilation(spark):
    told = spark.createDataFrame([(0, "p"), (0, "q")], "doc_id bigint, placeholder string")
    assert rows(compiling.extra_strings(files(spark, "a p b"), told), "placeholder") == [("q",)]
    with pytest.raises(Exception, match="not in the template"):
        compiling.without_extra(files(spark, "a p b"), told).collect()


def test_translation_parts_and_their_spread(spark):
    parts = office_compiling.translation_parts(F.lit('a<tx href="u">b<tx>c</tx></tx> d &'))
    assert [tuple(x) for x in one(spark, parts)] == [("a", None), ("b", "u"), ("c", "u"), (" d &", None)]
    assert one(spark, office_compiling.spread_parts(parts, F.lit(2))) == ["a", "bc d &"]
    assert one(spark, office_compiling.spread_parts(parts, F.lit(6))) == ["a", "b", "c", " d &", "", ""]
    assert one(spark, office_compiling.escape_idml(F.lit("a & b &amp; <c <Br/><?ACE 7?>"))) == "a &amp; b &amp; &lt;c <Br/><?ACE 7?>"


def test_office_problems_and_bytes_in_packages(spark):
    rows_ = spark.createDataFrame([(0, 0, "word/document.xml", "<w:document/>", None), (0, 1, "a.png", None, bytearray(b"\xff\x00"))], "doc_id bigint, place int, part string, xml string, raw binary")
    made = office.packages(rows_)
    assert {r["part"]: r["raw"] and bytes(r["raw"]) for r in office.all_parts(made).collect()} == {"word/document.xml": None, "a.png": b"\xff\x00"}
    bad = made.unionByName(spark.createDataFrame([(1, None), (2, bytearray(b"PK"))], "doc_id bigint, content binary"))
    assert rows(office.problems(bad, "word/document.xml", "b.xml"), "doc_id", "rule") == [(0, "missing part"), (1, "no package"), (2, "no package")]
    assert office.docx_units(bad).collect() == []


def test_po_parts_that_are_kept(spark):
    text = 'msgid ""\nmsgstr "X: y\\n"\n\n# t\n#. c\n#: a:1 b:2\n#, fuzzy, x\nmsgctxt "k"\nmsgid "one\\n"\n"two \\"q\\""\nmsgstr "s"\n\n#~ msgid "old"\n#~ msgstr "x"\n'
    found = po_compiling.written(po.entries(files(spark, text))).first()["content"]
    assert found == text.replace('msgid "one\\n"\n"two', 'msgid ""\n"one\\n"\n"two')


def test_fuzzy_spans_and_quotes(spark):
    span = markdown_compiling.fuzzy_span(F.lit("a (b)  c"), F.lit("x\n> a\n  (b) c d"))
    assert tuple(one(spark, span)) == (4, 13)
    assert one(spark, markdown_compiling.fuzzy_span(F.lit("z"), F.lit("x"))) is None


def test_formats_can_be_added(spark):
    formats.register_format("mine", plaintext.units, "mine")
    docs = spark.createDataFrame([(0, "a/b.MINE", bytearray(b"x")), (1, "c", bytearray(b"y"))], "doc_id bigint, path string, content binary")
    assert rows(formats.parse_by_extension(docs), "doc_id", "format", "key") == [(0, "mine", "0")]
    assert rows(formats.unknown(docs), "doc_id") == [(1,)]
    del formats.FORMATS["mine"]


def test_android_arrays_keep_empty_items(spark):
    text = '<resources>\n  <string-array name="a">\n    <item></item>\n    <item>x</item>\n  </string-array>\n  <string name="e"></string>\n</resources>'
    docs = files(spark, text)
    units = xml_files.android_units(docs)
    template = xml_compiling.android_template(docs, units)
    said = units.select("doc_id", "placeholder", "ord", "strings")
    assert xml_compiling.compile_android(template, said).first()["content"] == text


def test_json_texts_with_bad_escapes(spark):
    cases = {r"a\"b\\c😀\n\/": 'a"b\\c😀\n/', r"a\qb\u12": r"a\qb\u12", 'a"b\tc': 'a"b\tc', "end\\": "end\\", "": ""}
    for text, value in cases.items():
        assert one(spark, T.unescape_json(F.lit(text))) == value
