"""Formats by name, edits by place, guards, and what writers keep."""

import random

import pytest
from pyspark.sql import functions as F

from lingualake import formats
from lingualake.functions import spans
from lingualake.functions import text as T
from lingualake.operators import compiling, po_compiling, xml_compiling, yaml_compiling
from lingualake.plans import office_plans
from lingualake.sources import json_files, office, po, xml_files, yaml_files


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, content string")


def contents(df):
    return [r["content"] for r in df.orderBy("doc_id").collect()]


TEXTS = {
    "Plaintext": "one\n\n two \n",
    "SRT": "1\n00:00:01,000 --> 00:00:02,000\none\n\n2\n00:00:03,000 --> 00:00:04,000\ntwo\nlines\n",
    "VTT": "WEBVTT\n\n00:01.000 --> 00:02.000\none\n\n00:03.000 --> 00:04.000\ntwo\n",
    "PO": 'msgid ""\nmsgstr "h\\n"\n\nmsgid "one"\nmsgstr "eins"\n\nmsgid "p"\nmsgid_plural "ps"\nmsgstr[0] "a"\nmsgstr[1] "b"\n',
    "KEYVALUEJSON": '{"a": {"b": "x \\" y"}, "l": ["z", {"c": "w"}], "n": 1}',
    "ARB": '{"@@locale": "en", "a": "x", "@a": {"description": "d"}}',
    "STRUCTURED_JSON": '{"a": {"string": "x"}, "b": {"c": {"string": "y"}}}',
    "CHROME": '{"a": {"message": "x", "description": "d"}}',
    "CHROME_V3": '{"a": {"message": "x"}, "b": {"message": "y"}}',
    "ANDROID": '<resources>\n<!-- c -->\n<string name="a">x</string>\n<string-array name="b"><item>y</item></string-array>\n<plurals name="p"><item quantity="one">o</item><item quantity="other">p</item></plurals>\n</resources>',
    "BETA_ANDROID": '<resources>\n<string name="a">x</string>\n<plurals name="p">\n  <item quantity="other">p</item>\n</plurals>\n</resources>',
    "ANDROID_UNESCAPED": '<resources>\n<string name="a">it\\\'s \\"x\\" &amp; <b>y</b></string>\n</resources>',
    "STRINGSDICT": '<plist><dict><key>k</key><dict><key>NSStringLocalizedFormatKey</key><string>%#@v@</string><key>v</key><dict><key>one</key><string>o</string><key>other</key><string>p</string></dict></dict></dict></plist>',
    "CUSTOM_XML": '<strings><section name="s"><string key="k"><base>x</base><variant context="c">y</variant></string></section></strings>',
    "Yaml": "a:\n  b: x\n  c: 'y'\n  d: \"z\"\nl:\n  - w\n",
    "Yaml (Internationalization)": "en:\n  a: x\n  n:\n    one: o\n    other: p\n",
    "Github_Markdown": "# one\n\ntwo *three*\n\n- four\n",
    "Github_Markdown_v2": '---\ntitle: x\n---\n\n# one\n\ntwo\n',
    "Markdown_JSX": 'import x from "y"\n\n# one\n\ntwo\n',
}


@pytest.mark.parametrize("name", list(TEXTS))
def test_templates_compile_back_to_their_files(spark, name):
    docs = files(spark, TEXTS[name], TEXTS[name])
    units = formats.uniform(formats.parse(docs, name))
    assert units.count() > 0 and formats.problems(docs, name).count() == 0
    template = formats.template(docs, name)
    assert all(contents(template)[k] != contents(docs)[k] for k in (0, 1))
    assert contents(formats.compile(template, units, name)) == contents(docs)
    kept = contents(formats.sync(template, units, name))
    assert len(kept) == 2


def test_office_formats_by_name(spark):
    sf = "/root/testdata/sf0.001"
    for name, docs in (("DOCX", office_plans._docx(spark, sf)), ("PPTX", office_plans._pptx(spark, sf))):
        units = formats.uniform(formats.parse(docs, name))
        said = units.withColumn("strings", F.transform_values("strings", lambda k, v: F.regexp_replace(v, "Turn", "El")))
        done = formats.compile(formats.template(docs, name), said, name)
        before, after = (sorted(r["text"] for r in formats.parse(d, name).collect()) for d in (docs, done))
        assert [x.replace("Turn", "El") for x in before] == after


def test_a_folder_with_odd_files(spark, tmp_path):
    rows = [(1, "a_en.txt", b"x"), (2, "b.json", None), (3, "c.unknown", b"x"), (4, "d.xml", b"no xml"), (5, "e.docx", b"no zip"), (6, "f", b"x"), (7, "g.po", b"msgid a\n"), (8, "h.yml", b"")]
    table = spark.createDataFrame([(i, p, bytearray(c) if c is not None else None, "x", "y") for i, p, c in rows], "doc_id bigint, path string, content binary, format string, kind string")
    done = {(r["path"], r["kind"]): r["content"] and bytes(r["content"]) for r in formats.convert(table, lambda u: u, str(tmp_path / "out")).collect()}
    assert done["a_tpl.txt", "template"] != b"x" and done["a_el.txt", "result"] == b"x"
    assert done["b_el.json", "result"] is None and done["d_el.xml", "result"] == b"no xml" and done["h_tpl.yml", "template"] == b"" and done["g_el.po", "result"] == b""
    assert not any(p.startswith(("c", "f")) for p, _ in done)
    assert formats.convert(table.limit(0), lambda u: u, str(tmp_path / "none")).count() == 0


def test_edits_and_spans_by_place(spark):
    rng, rows, edits, expected, wanted = random.Random(2), [], [], {}, []
    for d in range(40):
        text = "".join(rng.choices("ab\U0001f600é\n", k=rng.choice([0, 1, 255, 256, 257, 512, 2000])))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) // 20 * 2, len(text)) // 2 * 2))
        own = [(cuts[i], cuts[i + 1], rng.choice(["", "X", "long text"])) for i in range(0, len(cuts), 2)]
        own += [(len(text), len(text), "end")] if d % 3 == 0 else []
        out, at = "", 0
        for start, end, new in own:
            out, at = out + text[at:start] + new, end
        rows.append((d, text))
        edits += [(d, *e) for e in own]
        expected[d] = out + text[at:]
        wanted += [(d, s, e, text[s:e]) for s, e, _ in own]
    docs, slots = spark.createDataFrame([*rows, (99, None)], "doc_id bigint, content string"), spark.createDataFrame(edits, "doc_id bigint, start int, end int, text string")
    assert {r["doc_id"]: r["content"] for r in compiling.apply_edits(docs, slots).collect()} == expected | {99: None}
    assert sorted(tuple(r) for r in spans.texts(docs, slots).collect()) == sorted(set(wanted))
    marked = files(spark, "a" + "0" * 32 + "_tr" + "é" + "f" * 32 + "_pl", "", "none", "1" * 33 + "_tr")
    assert [tuple(r) for r in spans.marks(marked).orderBy("doc_id", "seg").collect()] == [(0, 0, 1, 36, "0" * 32 + "_tr"), (0, 1, 37, 72, "f" * 32 + "_pl"), (3, 0, 1, 36, "1" * 32 + "_tr")]


def test_a_large_yaml_file_compiles_in_linear_time(spark):
    import time

    def seconds(n):
        docs = files(spark, "".join(f"k{i}: some text {i}\n" for i in range(n)))
        units = formats.uniform(formats.parse(docs, "Yaml"))
        start = time.perf_counter()
        done = formats.compile(formats.template(docs, "Yaml"), units, "Yaml").first()["content"]
        assert done == docs.first()["content"]
        return time.perf_counter() - start

    seconds(500)
    assert seconds(8000) < 4 * seconds(4000) + 5


def test_guards_hold_whatever_is_asked(spark):
    mark, other = "0" * 32 + "_tr", "1" * 32 + "_tr"
    told = spark.createDataFrame([(0, mark, 0, "a", ""), (0, other, 1, "b", "")], "doc_id bigint, placeholder string, ord int, key string, flags string").withColumns({"pluralized": F.lit(False), "strings": F.create_map(F.lit(5), F.lit("x"))})
    docs = files(spark, f"a: {mark}\n")
    assert compiling.without_extra(docs, told.filter("ord = 0")).count() == 1 and yaml_compiling.compile_yaml(docs, told.filter("ord = 0")).count() == 1
    with pytest.raises(Exception, match="not in the template"):
        compiling.without_extra(docs, told).count()
    with pytest.raises(Exception, match="not in the template"):
        yaml_compiling.compile_yaml(docs, told).count()
    with pytest.raises(Exception, match="not in the template"):
        yaml_compiling.compile_yaml(docs, told.filter("ord = 0").withColumn("doc_id", F.lit(5).cast("bigint"))).count()
    rules = spark.createDataFrame([("one",), ("=0",), ("odd",), (None,)], "name string")
    assert [r["n"] for r in T.with_known_rule(rules.filter("name in ('one', '=0')"), F.col("name"), "n").collect()] == [1, 0]
    for name in ("name = 'odd'", "name is null"):
        with pytest.raises(Exception, match="no plural rule"):
            T.with_known_rule(rules.filter(name), F.col("name"), "n").count()
    custom = files(spark, TEXTS["CUSTOM_XML"])
    few = formats.uniform(xml_files.custom_units(custom)).filter("ord = 0")
    with pytest.raises(Exception, match="no translation left for k::c"):
        xml_compiling.compile_custom(custom, few).count()
    assert xml_compiling.compile_custom(custom, few, "keep").count() == 1


def test_po_files_come_back_byte_by_byte(spark):
    long = "wörter " * 15 + "ende"
    texts = [
        'msgid ""\nmsgstr "X: y\\n"\n\n#, fuzzy\n#| msgctxt "was"\n#| msgid ""\n#| "old\\n"\n#| "text"\n#| msgid_plural "olds"\nmsgctxt "c"\nmsgid "new"\nmsgid_plural "news"\nmsgstr[0] ""\nmsgstr[1] ""\n\n#~| msgid "gone before"\n#~ msgid "gone"\n#~ msgstr "weg"\n',
        'msgid ""\nmsgstr ""\n\n# ' + " ".join(["note"] * 15) + "\n# " + " ".join(["note"] * 4) + '\nmsgid "a"\nmsgstr ""\n',
        'msgid ""\nmsgstr ""\n\nmsgid "w"\nmsgstr ""\n"' + "漢字" * 15 + ' "\n"' + "漢字" * 15 + '"\n',
    ]
    assert contents(po_compiling.written(po.entries(files(spark, *texts)))) == texts
    wrapped = contents(po_compiling.written(po.entries(files(spark, f'msgid "{long}"\nmsgstr ""\n'))))[0]
    assert all(len(x) <= 78 for x in wrapped.split("\n")) and po.entries(files(spark, wrapped)).first()["msgid"] == long
    assert contents(po_compiling.written(po.entries(files(spark, f'msgid "{long}"\nmsgstr ""\n')), width=0))[0] == f'msgid "{long}"\nmsgstr ""\n'
    assert contents(po_compiling.template(files(spark, "msgid a\n", "", None))) == ["", "", ""]


def test_json_keys_with_quotes_and_dots(spark):
    parts = lambda key: spark.range(1).select(json_files.key_path(F.lit(key))).first()[0]
    assert parts("a.b\\.c.d") == ["a", "b.c", "d"] and parts('"x.y"."q""r"') == ["x.y", 'q"r'] and parts("a..b") == ["a", "", "b"] and parts("") == [""] and parts("a\\\\.b") == ["a\\", "b"]
    docs = files(spark, '{"a": {"b": 1}, "a": {"c": "x"}, "l": [{"d": 2}], "": {"e": null}}', "no", None, "[]")
    keys = spark.createDataFrame([(0, "a.b"), (0, "a.c"), (0, "l"), (0, "l.d"), (0, ".e"), (1, "a"), (2, "a"), (3, "a"), (None, "a"), (0, None)], "doc_id bigint, key string")
    found = {(r["doc_id"], r["key"]): (r["kind"], r["value"]) for r in json_files.at_keys(docs, keys).collect()}
    assert found[0, "a.b"] == (None, None) and found[0, "a.c"] == ("string", "x") and found[0, "l"][0] == "list" and found[0, "l.d"] == (None, None) and found[0, ".e"] == ("scalar", "null")
    assert len(found) == 10 and all(found[k] == (None, None) for k in ((1, "a"), (2, "a"), (3, "a"), (None, "a"), (0, None)))


def test_older_android_rules(spark):
    text = '<resources><!-- k --><string name="e"/>\n<string name="s">a</string> <string-array name="n"></string-array><string-array name="w"> <item/> </string-array><plurals name="p"> <item quantity="other">x</item> </plurals><string name="f" translatable="false">f</string></resources>'
    docs = files(spark, text, "no xml")
    units = xml_files.android_units(docs, beta=True)
    assert [(r["key"], r["developer_comment"]) for r in units.orderBy("ord").collect()] == [("s", ""), ("p", "")]
    template = xml_compiling.android_template(docs, units)
    kept = contents(xml_compiling.compile_beta_android(template, units.select("doc_id", "placeholder", "ord", "strings")))
    assert kept == [text.replace('<string name="e"/>', "").replace('<string-array name="w"> <item/> </string-array>', ""), "no xml"]
    none = contents(xml_compiling.compile_beta_android(template, units.limit(0).select("doc_id", "placeholder", "ord", "strings")))[0]
    assert none == '<resources><!-- k -->\n <string-array name="n"></string-array><string name="f" translatable="false">f</string></resources>'


def test_tags_that_do_not_nest(spark):
    cases = {"a 'b'": "a \\'b\\'", "<b x='1'>'</b>": "<b x='1'>\\'</b>", "<b>'": "<b>\\'", "<b x='1'>": "<b x=\\'1\\'>", "</b>'": "</b>\\'", "<i><b>'</i></b>": "<i><b>\\'</i></b>", "<x y='1'>'</x>": "<x y=\\'1\\'>\\'</x>", "<br/>'": "<br/>\\'", "": "", "<!-- ' -->": "<!-- \\' -->", "<ul><li a=\"<>'\">'</li></ul>": "<ul><li a=\"<>'\">\\'</li></ul>"}
    found = spark.createDataFrame([(k,) for k in cases], "text string").select("text", T.escape_android(F.col("text")).alias("escaped")).collect()
    assert {r["text"]: r["escaped"] for r in found} == cases


def test_parts_of_packages_by_relations(spark):
    rows = [(0, 0, "_rels/.rels", '<Relationships><Relationship Id="a" Type="t/officeDocument" Target="x/y.xml"/></Relationships>'), (0, 1, "x/y.xml", "<d/>"), (0, 2, "word/document.xml", "<e/>"), (1, 0, "word/document.xml", "<f/>")]
    docs = office.packages(spark.createDataFrame(rows, "doc_id bigint, place int, part string, xml string"))
    assert sorted((r["doc_id"], r["part"], r["xml"]) for r in office.docx_parts(docs).collect()) == [(0, "word/document.xml", "<d/>"), (1, "word/document.xml", "<f/>")]
    assert office.docx_parts(docs.limit(0)).collect() == []


_SCALARS = ["", " ", "\n", "true", "a\n  b\nc", "a\n\n   \nb", "a \nb", "a\n b", "'", "a b " * 60 + "c", "word " * 50 + "\nnext " * 40 + ".", " lead " * 30, "\tx y " * 30, "'" * 90 + " x", "a  b " * 50 + "c", "x\u2028y\x85\x07\ufeff", "# a " * 40, "k: v " * 40, "w" * 300 + " x", "\U0001f600 " * 60 + "y", "end\n\n\n"]


@pytest.mark.parametrize("width", [None, 1, 20, 80])
def test_scalars_of_every_style_and_width_read_back(spark, width):
    import yaml

    df = spark.createDataFrame(list(enumerate(_SCALARS)), "id int, text string")
    out = df.select("text", *(yaml_compiling.styled(F.col("text"), F.lit(s), F.lit(4), width).alias(f"s{k}") for k, s in enumerate(["", "'", '"', "|", ">"])))
    for row in out.collect():
        for scalar in row[1:]:
            assert yaml.safe_load(f"a:\n  k: {scalar}\n  l: x\n")["a"] == {"k": row["text"], "l": "x"}
            assert width is not None or scalar[0] in "'|>" or "\n" not in scalar


def test_folded_lines_end_at_the_first_space_beyond_the_width(spark):
    text = "word " * 60 + "end"
    df = spark.createDataFrame([(text,)], "text string")
    for style in ("", "'", '"', ">"):
        lines = df.select(yaml_compiling.styled(F.col("text"), F.lit(style), F.lit(4), 40)).first()[0].split("\n")
        assert len(lines) > 5 and all(36 <= len(x) <= 48 for x in lines[1:-1])


def test_files_are_written_and_compiled_at_a_width(spark):
    import yaml

    content = "a:\n  b: x\n  c: 'y'\n  d: \"z\"\n  e: >\n    w\n"
    docs = spark.createDataFrame([(1, content)], "doc_id bigint, content string")
    units = yaml_files.units(docs)
    long = " ".join(["longer text"] * 20)
    told = units.select("doc_id", "placeholder", "key", "flags", F.lit(False).alias("pluralized"), F.create_map(F.lit(5), F.lit(long)).alias("strings"))
    done = yaml_compiling.compile_yaml(yaml_compiling.template(docs, units), told, width=60).first()["content"]
    written = yaml_compiling.compile_without_template(units.withColumn("text", F.lit(long)), "el", width=60).first()["content"]
    for text, root in ((done, lambda x: x), (written, lambda x: x["el"])):
        assert max(map(len, text.split("\n"))) < 80
        assert {k: v.strip() for k, v in root(yaml.safe_load(text))["a"].items()} == dict.fromkeys("bcde", long)
