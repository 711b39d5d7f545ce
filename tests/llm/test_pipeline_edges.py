"""The stages of the pipeline on odd tables: nulls, empty texts, repeated rows, extra columns with clashing names, no rows at all."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, row_ string, n_words string, size string"
TEXT = " ".join(f"word{i} stands here" for i in range(40))


def test_odd_rows_and_empty_tables(spark):
    from planweave.llm.common import table

    docs = table(spark, SF, "documents")
    odd = [(None, TEXT), (-1, None), (-2, ""), (-3, " \n\t "), (-4, "lone"), (-4, "lone")]
    extra = spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", "x", "x", "x") for i, t in odd], KIND)
    rows = docs.unionByName(extra, allowMissingColumns=True)
    for name, build in corpus_pipeline.STAGES:
        out = build(spark, rows, SF)
        got = out.collect()
        if name == "packing":
            assert {r.doc_id for r in got} >= {None, -1, -2, -3, -4}
        else:
            assert out.columns == corpus_pipeline.COLUMNS
            ids = [r.doc_id for r in got]
            assert None in ids and {-1, -2} <= set(ids), name
        assert build(spark, rows.where("false"), SF).collect() == []
