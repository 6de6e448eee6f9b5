from pyspark.sql import types as T

from sensorfill import schema as S
from sensorfill.sources import stages, text

SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
    ]
)


def read(spark, path):
    return [tuple(r) for r in text.read_table(spark, str(path), SCHEMA).orderBy("obs_seq").drop("obs_seq").collect()]


def test_blanks_quotes_comments_and_missing_values(spark, tmp_path):
    (tmp_path / "t.txt").write_text(
        "# a table\n"
        'name  n\tother x\n'
        '"two words"  1  q  2.5   # why\n'
        "\n"
        "  'it\"s' NA q NA\n"
        "plain\t7 'a # b' 1e3\n"
        "#all of it\n"
    )
    assert read(spark, tmp_path / "t.txt") == [("two words", 1, 2.5), ('it"s', None, None), ("plain", 7, 1000.0)]


def test_row_labels(spark, tmp_path):
    (tmp_path / "t.txt").write_text("name n x\n1 a 5 0.5\n2 b 6 0.25\n")
    assert read(spark, tmp_path / "t.txt") == [("a", 5, 0.5), ("b", 6, 0.25)]


def test_order_of_lines_over_files_and_blocks(spark, tmp_path):
    lines = [f"r{i} {i} {i / 4}" for i in range(3000)]
    folder = tmp_path / "parts"
    folder.mkdir()
    for k, part in enumerate((lines[:5], lines[5:2500], lines[2500:])):
        (folder / f"part-{k}.txt").write_text("\n".join(["name n x", *part]) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        df = text.read_table(spark, str(folder), SCHEMA)
        assert df.rdd.getNumPartitions() > 3
        got = df.orderBy("obs_seq").collect()
    finally:
        spark.conf.set(key, before)
    assert len({r["obs_seq"] for r in got}) == 3000
    assert [r["n"] for r in got] == list(range(3000))


def test_observations_by_column_name(spark, tmp_path):
    names = [f.name for f in S.RAW_OBSERVATIONS.fields][::-1]
    row = {n: "1" for n in names} | {"Name": "lake", "Method": "GR", "datetime": "3.25"}
    (tmp_path / "t.txt").write_text(" ".join(names) + "\n" + " ".join(row[n] for n in names) + "\n")
    r = text.read_observations(spark, str(tmp_path / "t.txt")).first()
    assert (r["Name"], r["Method"], r["datetime"], r["Year"]) == ("lake", "GR", 3.25, 1)


def test_stage_is_partitioned_by_year_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(2009, 1), (2010, 2)], "year int, k int")
    stages.write_stage(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "year=2009").exists()
    assert sorted(map(tuple, stages.read_stage(spark, str(tmp_path / "s")).select("year", "k").collect())) == [(2009, 1), (2010, 2)]
    plain = df.select("k")
    stages.write_stage(plain, str(tmp_path / "p"))
    assert stages.read_stage(spark, str(tmp_path / "p")).count() == 2
    stages.export_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, schema=df.schema)
    assert sorted(map(tuple, back.collect())) == [(2009, 1), (2010, 2)]
