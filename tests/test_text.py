from pyspark.sql import functions as F

from sextant.functions import text as T


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def test_primary_tokens(spark):
    assert one(spark, T.primary_tokens, "GOVERN 1.1 GV-1.1-001 Third-Party art_6") == ["govern", "1.1", "gv-1.1-001", "third-party", "art_6"]


def test_document_tokens_add_parts_but_no_length(spark):
    assert one(spark, T.document_tokens, "third-party gv-1.1-001") == ["third-party", "gv-1.1-001", "third", "party", "gv", "1.1", "001"]
    assert one(spark, lambda x: F.size(T.primary_tokens(x)), "third-party gv-1.1-001") == 2


def test_norm_comparison(spark):
    assert one(spark, T.norm_comparison, "‘a’ “b” –— c  d ") == "'a' \"b\" -- c d"


def test_segments(spark):
    assert one(spark, T.segments, "A b. C d; E") == ["A b.", "C d;", "E"]
    assert one(spark, T.segments, "") == []


def test_claim_sentences(spark):
    assert one(spark, T.sentences, "See Art. 9.3 of it, e.g. this. No. 5 applies? Yes!") == ["See Art. 9.3 of it, e.g. this.", "No. 5 applies?", "Yes!"]


def test_claim_lines(spark):
    assert one(spark, T.claim_units, "Intro:\n- one. two\n(a) three\n\nTail.") == ["Intro:", "one. two", "three", "Tail."]
    assert one(spark, T.claim_units, None) is None
    assert one(spark, T.claim_units, T.MARKER) == []


def test_response_class_is_whole_equality(spark):
    assert one(spark, T.response_class, f" {T.MARKER}\n") == "abstained"
    assert one(spark, T.response_class, T.MARKER + " X.") == "answered"
    assert one(spark, T.response_class, T.MARKER[:-1]) == "marker_variant"


def test_unit_of(spark):
    assert one(spark, T.unit_of, "u:art_1#p2") == "u:art_1"
    assert one(spark, T.unit_of, "u:art_11") == "u:art_11"
