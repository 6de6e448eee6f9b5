import pytest
from pyspark.sql import functions as F

from sensorfill.llm import toxicity as X


@pytest.fixture
def grammar():
    return X.Grammar({"idiot": 5.0, "scum$": 4.0})


def kinds(grammar, clause):
    found = dict(zip(X.KINDS, grammar.features(clause)))
    return {k for k, v in found.items() if v}


def test_clauses_not_words(grammar):
    assert kinds(grammar, "Some idiot wrote it.") == {"insult"}
    assert kinds(grammar, "You are an IDIOTIC person.") == {"aimed insult"}
    assert kinds(grammar, "An idiot, you.") == {"aimed insult"}
    assert kinds(grammar, "That is not an idiot.") == {"negated insult"}
    assert kinds(grammar, "She said: idiot") == {"reported insult"}
    assert kinds(grammar, "I will kill you.") == {"aimed or intended threat"}
    assert kinds(grammar, "They never kill.") == {"negated threat"}
    # Marks end with the clause.
    assert kinds(grammar, "It was not so. An idiot came.") == {"insult"}
    assert kinds(grammar, "scummy videoidiot") == set()
    assert kinds(grammar, "") == set()


def test_composition_equals_one_after_another(grammar):
    symbols = [X.NEGATION, 0, X.INSULT, X.REPORT, X.INTENT, X.THREAT, X.TARGET, X.INSULT] * 3
    one_by_one = symbols
    for part in grammar.forward.parts:
        one_by_one = X.Composed(part).run(one_by_one)
    assert grammar.forward.run(symbols) == one_by_one


def labelled(spark, text, n=400):
    rows, labels = [], []
    for i in range(n):
        words = text.words(40, of=500)
        toxic = i % 5 == 0
        if toxic:
            for at in (3, 17, 30):
                words[at] = ["grobe" + w for w in text.words(1, of=9)][0] if i % 10 else "nasty"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_held_out_accuracy(spark, text):
    docs, labels = labelled(spark, text)
    model = X.learn(X.training_rows(docs, labels))
    assert {"nasty", "grobew"} == {x.rstrip("$") for x in model.insults}
    scored = X.with_score(docs, model).where(X.held_out(F.col("doc_id"))).join(labels, "doc_id")
    rows = scored.collect()
    assert len(rows) > 40
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in rows) >= 0.95 * len(rows)


def test_labels_of_held_out_rows_are_not_read(spark, text):
    docs, labels = labelled(spark, text)
    turned = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.learn(X.training_rows(docs, labels)) == X.learn(X.training_rows(docs, turned))


def test_copies_are_one_piece_of_evidence(spark, text):
    docs, labels = labelled(spark, text)
    copy = " ".join(["nasty", *(f"copied{i}" for i in range(30))])
    more = spark.range(1000, 1300).select(F.col("id").alias("doc_id"), F.lit(copy).alias("text"))
    model = X.learn(X.training_rows(docs.union(more), labels.union(more.selectExpr("doc_id", "1"))))
    assert not any(x.startswith("copied") for x in model.insults)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    for docs, known, n in ((odd_docs, labels, 10), (odd_docs, labels.where("false"), 10), (no_docs, labels, 0)):
        model = X.learn(X.training_rows(docs, known))
        rows = X.with_score(docs, model).collect()
        assert len(rows) == n and all(0 <= r.score < 0.5 for r in rows)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = X.drop_toxic(spark, odd_docs, str(tmp_path))
    assert kept.columns == odd_docs.columns and kept.count() == 10


def test_sample_is_bounded(spark, text):
    docs, labels = labelled(spark, text)
    assert X.training_rows(docs, labels, max_train=50).count() < 90


def test_model_does_not_depend_on_row_order(spark):
    # Near copies that share one or two signatures with others, not all with all.
    words = [f"w{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(300):
        kept = [w for j, w in enumerate(words) if (i * 7 + j * 3) % 11 > 2]
        rows.append((i, " ".join(kept) + (" you are an idiot" if i % 3 == 0 else "")))
        labels.append((i, int(i % 3 == 0)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    models = []
    for given, parts in ((rows, 1), (rows[::-1], 3), (rows, 5)):
        docs = spark.createDataFrame(given, "doc_id long, text string").repartition(parts)
        train = X.training_rows(docs, labels)
        models.append((sorted(map(tuple, train.collect())), X.learn(train)))
    assert models[0] == models[1] == models[2]


def test_the_stage_keeps_a_column_with_the_name_of_its_score(spark, tmp_path):
    docs = spark.createDataFrame([(1, "fine text", 7)], "doc_id long, text string, _Toxicity int")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = X.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.head()[2] == 7
