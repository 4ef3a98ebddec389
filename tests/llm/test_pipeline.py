import corpus_pipeline as cp
from treeloom.llm import decontaminate, toxicity


def test_stages_and_edges(spark, tmp_path, monkeypatch):
    """A small corpus with a null text, an empty one, repeated lines, copies and a benchmark passage."""
    monkeypatch.setattr(toxicity, "STEPS", 10)
    passage = " ".join(f"bench{k}" for k in range(12))
    texts = [None, "", *[f"shared line\nsome clean words number {k} {k * 7} {k * 13} and others {k * 31}" for k in range(12)], "a b c d e f", "a b c d e f", f"before {passage} after"]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    cur = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        cur = cp.written(stage(spark, cur, sf), name)
        kept[name] = {r.doc_id: r for r in cur.collect()}
        if name != cp.STAGES[-1][0]:
            assert cur.columns == cp.COLUMNS
    assert len(kept["toxicity"]) == len(texts)
    assert all("shared line" not in (r.text or "") for r in kept["line_dedup"].values())
    assert 15 not in kept["near_dedup"] and 14 in kept["near_dedup"] and 0 in kept["near_dedup"] and 1 not in kept["near_dedup"]
    assert 16 in kept["near_dedup"] and 16 not in kept["decontaminate"]
    assert all(r.round_trip for r in kept["sentencepiece"].values()) and set(kept["sentencepiece"]) == set(kept["decontaminate"])
    assert decontaminate.words_of("A b") == ["a", "b"]


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Null and repeated ids: every row is judged by its own text."""
    passage = " ".join(f"bench{k}" for k in range(12))
    text = lambda k: " ".join(f"w{k}x{j * j}" for j in range(40))
    near = [(None, text(1)), (None, text(1)), (None, text(2)), (3, text(2)), (5, text(2)), (5, text(4)), (9, text(4)), (7, text(6)), (7, text(6))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    got = cp.drop_near_duplicates(spark, docs(near), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", text(1)), ("3", text(2)), ("5", text(4)), ("7", text(6))])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mixed = [(None, passage), (None, text(1)), (4, f"x {passage}"), (4, text(2)), (4, text(3))]
    got = cp.drop_contaminated(spark, docs(mixed), str(tmp_path))
    assert got.columns == cp.COLUMNS
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in got.collect()) == sorted((str(i), t, len(t)) for i, t in mixed if passage not in t)
