import numpy as np
import pytest

from sensorfill.llm import shards as S


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 1023, 1024, 1025, 30_000])
def test_feistel_is_a_keyed_permutation(n):
    places = S.feistel(np.arange(n), n)
    assert sorted(places) == list(range(n))
    if n > 1000:
        assert (places == np.arange(n)).sum() < 20
        assert (places != S.feistel(np.arange(n), n, key=7)).mean() > 0.99
        # Each place is found on its own, as by a task that sees one document only.
        assert S.feistel(np.array([n - 1]), n)[0] == places[n - 1]


def docs_table(spark, text, n=60):
    rows = [(i, " ".join(text.words(text.number(60)))) for i in range(n)]
    return rows + [(100, None), (101, ""), (5, "again"), (None, "no id")], "doc_id long, text string"


def test_round_trip_and_resuming(spark, text, tmp_path):
    rows, kind = docs_table(spark, text)
    docs = spark.createDataFrame(rows, kind).repartition(5)
    path = f"{tmp_path}/shards"
    S.write_shards(docs, path, seq_len=16, per_shard=8)
    encode, end = S.encoder()
    found = S.read_slots(spark, path, per_shard=8).collect()
    assert sorted(r.slot for r in found) == list(range(len(found)))
    assert all(len(r.tokens) == 32 for r in found)
    got = {}
    for r in sorted(found, key=lambda r: r.part):
        ids = np.frombuffer(r.tokens, "<u2")
        assert (ids[r.n_tokens :] == end).all()
        got.setdefault(r.doc_id, []).extend(ids[: r.n_tokens].tolist())
    for i, t in rows:
        if i not in (5, None):
            assert got[i] == [*encode(t or ""), end]
    assert sorted(got[5]) == sorted([x for i, t in rows if i == 5 for x in [*encode(t), end]])
    rest = S.read_slots(spark, path, start=21, per_shard=8).collect()
    assert sorted(map(tuple, rest)) == sorted(tuple(r) for r in found if r.slot >= 21)


def test_slots_do_not_depend_on_partitions(spark, text):
    rows, kind = docs_table(spark, text)
    rows = [r for r in rows if r[0] is not None][:-1]
    found = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, kind).repartition(parts)
        shards = S.training_shards(docs, seq_len=16, per_shard=8).collect()
        assert [r.shard for r in shards] == list(range(len(shards)))  # in slot order
        found.append(sorted((r.shard, r.doc_ids, r.parts, bytes(r.tokens)) for r in shards))
    assert found[0] == found[1]


def test_odd_rows(spark, odd_docs, no_docs):
    shards = S.training_shards(odd_docs).collect()
    assert sum(r.n_slots for r in shards) == sum(len(r.doc_ids) for r in shards)
    ids = [i for r in shards for i in r.doc_ids]
    assert {1, 2, 3, 4, 5, 6, 7, None} == set(ids) and ids.count(1) == 2
    assert S.training_shards(no_docs).count() == 0


def test_rows_of_one_id_are_ordered_by_their_texts(spark):
    rows = [(1, "a b c"), (1, "d e f"), (1, "g h i"), (None, "k l m"), (None, "o p q"), (2, "a b c")]
    found = []
    for given in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
        shards = S.training_shards(docs, seq_len=4, per_shard=4).collect()
        found.append([(r.shard, r.doc_ids, bytes(r.tokens)) for r in shards])
    assert found[0] == found[1] == found[2]
