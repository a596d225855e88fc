from graphloom.llm import neardup, packing, provenance
from graphloom.llm.forest import forest_neighbours


def test_empty_tables(spark):
    make = spark.createDataFrame
    assert forest_neighbours(make([], "id bigint, space string, vec array<float>"), 5).count() == 0
    assert packing.pack_texts(make([], "doc_id bigint, text string")).count() == 0
    ext = make([(".js", "javascript")], "ext string, language string")
    assert provenance.not_handwritten(make([], "path string, content binary"), ext).count() == 0
    symbols = make([], "id string, category string, signature string, body_tokens binary, cls bigint")
    assert neardup.similar_pairs(*neardup.similar_classes(neardup.symbol_strings(symbols))).count() == 0


def test_clashing_columns(spark):
    rows = [(k, "a", [1.0, float(k)], "x", 1) for k in range(1, 4)]
    df = spark.createDataFrame(rows, "id bigint, space string, vec array<float>, unit string, copy int")
    assert forest_neighbours(df, 1).count() == 3
    docs = spark.createDataFrame([(1, "some text", "c", True)], "doc_id bigint, text string, container string, open boolean")
    assert packing.pack_texts(docs).count() == 1
