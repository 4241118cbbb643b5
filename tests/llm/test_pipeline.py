"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from ashlar.llm import decontaminate, shingle_join, substrings
from ashlar.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), str(tmp_path / name))
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    assert seen["quality"].count() > seen["near_duplicates"].count() > 0
    classes = shingle_join.op1(seen["near_duplicates"])
    assert classes.filter("component_id <> doc_id").count() == 0
    assert substrings.op9(seen["near_duplicates"]).filter("n_removed > 0").count() == 0 or seen["repeated_substrings"].filter("length(text) <> n_chars").count() == 0
    left = decontaminate.op4(seen["decontamination"], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert left.filter("contaminated").count() == 0
    assert {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()} == {r.doc_id for r in seen["decontamination"].collect()}


def test_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), str(tmp_path / name))
        assert docs.count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, short, long and repeated texts, ties, and columns with the names that operators use."""
    import random

    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6))) for _ in range(n))
    a, b, c = prose(80), prose(20000), prose(120)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    texts = [a, a, a + " " + prose(3), None, "", "one two", b, c, f"{prose(30)} {benchmark} {prose(30)}", c]
    rows = [(i, t, None if i == 6 else "en", None if i % 2 else "s", None, 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    rows += [rows[7], (None, prose(90), None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id int, row int, _key int, symbols int, _x int")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), str(tmp_path / name))
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = {name: sorted((x[0] for x in df.select("doc_id").collect()), key=lambda x: (x is None, x)) for name, df in seen.items()}
    assert ids["quality"] == [0, 1, 2, 6, 7, 7, 8, 9, None]
    assert ids["near_duplicates"] == ids["repeated_substrings"] == [0, 6, 7, 8, None]
    assert ids["decontamination"] == [0, 6, 7, None] and set(ids["packing"]) == {0, 6, 7, None}
    left = {x.doc_id: x for x in seen["decontamination"].collect()}
    assert left[6].text == b and left[7].n_chars == len(c) and (left[0]._id, left[0]._x) == (1, 5) and left[None].n_chars == len(left[None].text)
