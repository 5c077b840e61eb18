"""The pipeline against the same stages in plain Python, on a small table."""

import random

from yearfold.llm import bpe, secrets, simhash


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    item, base = text(30), text(80)
    rows = [(i, text(60) + (" grumbo snarfel vexlit" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(300, base), (301, base), (302, text(20) + " " + item), (303, text(30) + " token = abcdefghij0123456789"), (304, None), (305, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t in rows if not (i < 200 and i % 4 == 0)]
    stay = {c for _, _, c in simhash.brute_force(left)}
    want = {i: t for i, t in left if i in stay and i != 302}
    assert got.keys() == want.keys() and 301 not in got and 305 not in got
    for i, t in want.items():
        spans = secrets.brute_force(t)
        clean = t or ""
        for a, _, b in sorted(spans[0] + spans[1], reverse=True):
            clean = clean[:a] + "[secret]" + clean[b:]
        assert got[i].decoded == clean and got[i].n_tokens == bpe.brute_force(clean)[0]
