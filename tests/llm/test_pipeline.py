import random

import corpus_pipeline


def test_stages_act_on_what_is_left(spark, tmp_path):
    rng = random.Random(4)
    words = "the of and to in a is that river house green walks under tree slowly morning light falls over old town bread".split()
    clean = [" ".join(rng.choice(words) for _ in range(60)) + "." for _ in range(40)]
    near = clean[0].replace(clean[0].split()[30], "changed", 1)
    junk = [" ".join(rng.choice(words).upper() + "!!" for _ in range(60)) for _ in range(8)]
    texts = [*clean, clean[1], clean[2].replace(" ", "  "), near, *junk, None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the padded copy of clean[2] has more code points, so it stays in its place; null and empty are one
    expected = (set(range(40)) - {2}) | {41}
    assert {i for i in left if i < 43} == expected
    assert not left & set(range(43, 51)) and len(left & {51, 52}) == 1


def test_columns(spark, docs):
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, "").columns == rows.columns
