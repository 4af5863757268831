import hashlib

from pyspark.sql import functions as F

from tributary.functions import text as fx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


def test_texts(spark):
    assert one(spark, "a \r\nb\t\rc\n\n", fx.norm_text) == "a\nb\nc\n\n"
    assert one(spark, "a  ", fx.text_identity) == hashlib.md5(b"a").hexdigest()
    assert one(spark, None, fx.text_identity) is None
    assert one(spark, "x === OSSelot Export ===\n\nbody", fx.strip_export_prefix) == "body"
    assert one(spark, "<![CDATA[NA]]>", fx.norm_cdata) == ""
    assert one(spark, "<text> a\nb </text>", fx.strip_text_tag) == "a\nb"
    assert one(spark, "é" * 130, fx.preview) == "é" * 119 + "…"


def test_identities(spark):
    h = "array<struct<alg:string,content:string>>"
    assert one(spark, [("MD5", "BB"), ("SHA-1", " AA "), (None, "x")], fx.checksum_identity, h) == "aa"
    assert one(spark, [("CRC", "1")], fx.checksum_identity, h) is None
    assert one(spark, {"MD5": "CC"}, fx.checksum_map_identity, "map<string,string>") == "cc"
    a, b = (one(spark, g, lambda c: fx.stanza_identity(F.lit("MIT"), c), "array<string>") for g in (["b", " a ", ""], ["a", "b"]))
    assert a == b == hashlib.md5(b"MIT\0a\0b").hexdigest()
    assert one(spark, ["b", "a"], lambda c: fx.obligation_identity(F.lit("t"), F.lit("x"), c), "array<string>") == hashlib.md5(b"t||x||a|b").hexdigest()


def test_references(spark):
    ns = lambda r: one(spark, r, lambda c: fx.namespaced_ref(c, F.lit(2)))
    assert ns("SPDXRef-x") == "SPDXRef-input2-x"
    assert ns("http://a/b#SPDXRef-x") == "http://a/b#SPDXRef-input2-x"
    assert ns("http://a#b#y") == "http://a#b#SPDXRef-input2-y"
    assert ns("local1") == "input2-local1"
    m = F.create_map(F.lit("LicenseRef-a"), F.lit("N"))
    assert one(spark, "(LicenseRef-a OR LicenseRef-ab) AND LicenseRef-a", lambda c: fx.rewrite_embedded(c, m)) == "(N OR LicenseRef-ab) AND N"
    iri = F.create_map(F.lit("f"), F.lit("g"))
    assert one(spark, "http://x#f", lambda c: fx.rewrite_iri(c, iri)) == "http://x#g"
    assert one(spark, "SPDXRef-gen.py", fx.embedded_refs) == ["SPDXRef-ge"]


def test_pointers(spark):
    assert one(spark, "a/b~c", fx.pointer_escape) == "a~1b~0c"
    assert one(spark, "/a~1b/~01", fx.pointer_tokens) == ["a/b", "~1"]
    assert one(spark, "/", fx.pointer_tokens) == []
    assert tuple(one(spark, "/file/ab/x/y", fx.split_identity_path)) == ("file", "ab", "x/y")
    assert one(spark, "aAaA", lambda c: fx.count_matches(c, F.lit("aa"))) == 2
    assert one(spark, "..a b/c_", fx.safe_name) == "a_b_c"
