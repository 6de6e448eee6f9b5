import corpus_pipeline as C
from sensorfill.llm import shards as S
from sensorfill.llm.common import stored


def test_stages_and_run(spark, text, tmp_path):
    item = " ".join(text.words(20, of=9000))
    rows, labels = [], []
    for i in range(300):
        words = text.words(60, of=9000)
        if i % 6 == 0:
            words[5], words[40] = "nasty", "nasty"
        if i % 25 == 7:
            words[10:10] = item.split()
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 0, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s1", 0) for i in range(1, 40)]  # copies
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    toxic = {i for i, _, t in labels if t} | {i for i in range(1000, 1040) if (i - 1000) % 6 == 0}
    dirty = {i for i in range(300) if i % 25 == 7} | {1007, 1032}
    kept, at = {}, docs
    for name, stage in C.STAGES[:-1]:
        at = stored(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
    every = {r[0] for r in rows}
    assert kept["toxicity"] == every - toxic
    assert kept["near_dedup"] == {i for i in every - toxic if i < 1000}
    assert kept["decontamination"] == kept["near_dedup"] - dirty
    assert kept["mixing"] <= kept["decontamination"]
    sources = {r.source for r in at.select("source").collect()}
    assert sources == {"s0", "s1", "s2"}

    shards = C.run(spark, str(tmp_path)).collect()
    assert {i for r in shards for i in r.doc_ids} == kept["mixing"]
    assert all(len(r.tokens) == r.n_slots * 2 * S.SEQ_LEN for r in shards)
