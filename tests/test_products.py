import pytest
from pyspark.sql import functions as F

from shelfkin.operators import catalog, generating, loading, numbering
from shelfkin.schema import PRODUCT_SCHEMA
from shelfkin.operators.similarity import score_all
from shelfkin.sources import product_csv, product_tables, vector_store


def products(spark, rows):
    return spark.createDataFrame(rows, PRODUCT_SCHEMA)


def test_csv_with_line_breaks_round_trips(spark, tmp_path):
    made = generating.generate_products(generating.product_ids(spark, 200)).withColumn("image_path", F.lit('a "quoted", path'))
    path = str(tmp_path / "csv")
    product_csv.write_products_csv(made.select(*PRODUCT_SCHEMA.names), path)
    back = product_csv.read_products_csv(spark, path)
    assert back.schema == PRODUCT_SCHEMA
    assert sorted(back.collect()) == sorted(made.select(*PRODUCT_SCHEMA.names).collect())


def test_csv_leading_blanks_and_holes(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('id,category,name,description,image_path\n1, Tablet, A,"x\ny",\n2,Tablet,,d,i\n3,Tablet,NA,d,i\n4,,B,N/A,i\n')
    read = product_csv.read_products_csv(spark, str(path))
    cleaned = loading.clean_products(read, loading.NA_SPELLINGS).orderBy("id").collect()
    assert [tuple(r) for r in cleaned] == [(1, "Tablet", "A", "x\ny", ""), (4, "", "B", "", "i")]


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("name,id,extra,image_path,description,category\nn,7,e,i,d,c\nm,NA,e,i,d,c\n")
    rows = product_csv.read_products_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [(7, "c", "n", "d", "i", "e"), (None, "c", "m", "d", "i", "e")]
    path.write_text("name,id\nn,7\n")
    with pytest.raises(ValueError, match="category, description, image_path"):
        product_csv.read_products_csv(spark, str(path))
    path.write_text("id,category,name,description,image_path\nseven,c,n,d,i\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        product_csv.read_products_csv(spark, str(path)).collect()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing columns: name, image_path"):
        loading.require_columns(spark.createDataFrame([(1, "a", "b")], "id long, category string, description string"))


def test_check_counts_every_violation(spark):
    long_name = "n" * 256
    df = products(spark, [(1, "a", "b", "d", "i"), (1, "a", long_name, "d", "i"), (None, "a", "b", "d", "i"), (2, "a", None, "d", None)])
    row = loading.check_products(df).first().asDict()
    assert row == {"row_count": 4, "duplicate_ids": 1, "missing_ids": 1, "long_category": 0, "long_name": 1, "long_image_path": 0}
    assert [tuple(r) for r in loading.duplicated_ids(df).collect()] == [(1, 2)]


def test_check_of_an_empty_table(spark):
    assert set(loading.check_products(products(spark, [])).first()) == {0}


def test_replace_table_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    product_tables.replace_table(products(spark, [(1, "a", "b", "c", "d")]), path)
    product_tables.replace_table(products(spark, [(2, "a", "b", "c", "d")]), path)
    assert [r["id"] for r in product_tables.read_products_parquet(spark, path).collect()] == [2]


def test_jdbc_options():
    options = product_tables.jdbc_scan_options("jdbc:x", "products", 1, 1000, 4)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "4"
    with pytest.raises(ValueError):
        product_tables.jdbc_scan_options("jdbc:x", "products", 5, 1, 4)


def test_generation_repeats_and_stays_in_range(spark):
    def make(parts):
        return sorted(generating.generate_products(generating.product_ids(spark, 300).repartition(parts), "s").collect())

    rows = make(1)
    assert rows == make(7)
    assert rows != sorted(generating.generate_products(generating.product_ids(spark, 300), "other").collect())
    assert {r["category"] for r in rows} == {"Smartphone", "Laptop", "Smartwatch", "Tablet"}
    for r in rows:
        screen, memory, battery, system = r["description"].split("\n")
        assert 5.0 <= float(screen.split()[1]) <= 15.6
        assert 4 <= int(memory.split()[1]) <= 32
        assert 2000 <= int(battery.split()[1]) <= 10000
        assert system.removeprefix("operating system ") in generating.OPERATING_SYSTEMS


def test_images_match_their_category(spark):
    made = generating.generate_products(generating.product_ids(spark, 80))
    names = ["smartphone_1.jpg", "my-smartphone.jpg", "laptop.jpg", "laptop_tablet.jpg", "smartwatch.png"]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    got = generating.assign_images(made, files, "data/images")
    assert got.count() == 80
    for r in got.collect():
        if r["category"] == "Smartwatch":
            assert r["image_path"] is None
        else:
            assert r["category"].lower() in r["image_path"] and r["image_path"].startswith("data/images/")


def test_option_labels(spark):
    df = products(spark, [(5, "t", "first", "q", ""), (9, "t", "name", "a\nb", ""), (1, "u", "solo", "z", "")])
    labels = {r["id"]: r["label"] for r in catalog.product_options(df).collect()}
    assert labels == {5: "1. first (q)", 9: "2. name (a, b)", 1: "1. solo (z)"}
    choices = spark.createDataFrame([("t", "2. name (a, b)")], "category string, label string")
    assert [r["id"] for r in catalog.nth_products(df, choices).collect()] == [9]


def test_numbering_across_buckets(spark):
    hot = F.when(F.col("id") % 10 < 7, True).when(F.col("id") % 10 < 9, False)  # else null, a group of its own
    df = spark.range(-40, 960).select(F.col("id"), hot.alias("hot"))
    got = numbering.numbered(df, ["hot"], ["id"], numbering.id_bucket("id", 17))
    seen = {True: 0, False: 0, None: 0}
    assert got.count() == 1000
    for r in sorted(got.collect(), key=lambda r: r["id"]):
        seen[r["hot"]] += 1
        assert r["n"] == seen[r["hot"]]


def test_details_and_message_defaults(spark):
    df = products(spark, [(1, None, None, None, None), (2, "c", "n", "a\nb", "p")])
    details = {r["id"]: tuple(r)[1:] for r in catalog.product_details(df).collect()}
    assert details == {1: ("Unknown Product", "No description available", False), 2: ("n", "a  \nb", True)}
    text = catalog.system_message(F.col("category"), F.col("name"), F.col("description"))
    messages = [r[0] for r in df.orderBy("id").select(text).collect()]
    assert messages[0].endswith("\nUnknown Unknown Product ()") and messages[1].endswith("\nc n (a, b)")


def test_categories_in_first_seen_order(spark):
    df = products(spark, [(3, "a", "", "", ""), (1, "b", "", "", ""), (2, "a", "", "", "")])
    assert [r["category"] for r in catalog.list_categories(df).collect()] == ["b", "a"]


def test_vector_store_reads_one_modality(spark, tmp_path):
    path = str(tmp_path / "v")
    wide = spark.createDataFrame([(1, [1.0], [2.0, 3.0]), (2, [4.0], None)], "id long, text array<double>, image array<double>")
    vector_store.write_vectors(wide, path)
    assert sorted(vector_store.read_vectors(spark, path).collect()) == sorted(wide.collect())
    text_only = vector_store.read_vectors(spark, path, use_image=False)

    plan = text_only._jdf.queryExecution().executedPlan().toString()
    assert "image:array" not in plan and "Join" not in plan
    assert {r["id"]: r["image"] for r in text_only.collect()} == {1: None, 2: None}
    image = vector_store.read_modality(spark, path, "image")
    assert [tuple(r) for r in image.collect()] == [(1, [2.0, 3.0])]


def test_one_recommendation_through_the_store_moves_no_vectors(spark, tmp_path):
    path = str(tmp_path / "v")
    wide = spark.createDataFrame([(k, [1.0, float(k)], [2.0, 3.0]) for k in range(20)], "id long, text array<double>, image array<double>")
    vector_store.write_vectors(wide, path)
    scores = score_all(vector_store.read_vectors(spark, path), 3)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "EqualTo(id,3)" in plan
