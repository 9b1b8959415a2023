"""Reading, checking, generating and storing products and vectors."""

from pyspark.sql import functions as F

from shelfkin.operators import generating, loading
from shelfkin.plans import standins as S
from shelfkin.schema import PRODUCT_SCHEMA
from shelfkin.session import scratch_dir
from shelfkin.sources import image_files, product_csv, product_tables, vector_store

from .sql import PRODUCTS, VECTORS


def raw_products(spark, sf):
    """Products with holes, as a file from elsewhere might have them."""
    size = F.col("p_size")
    part = S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return S.products(spark, sf).join(part, "id").select(
        F.when(size != 50, F.col("id")).alias("id"),
        "category",
        F.when(size == 7, F.lit("n/a")).otherwise(F.col("name")).alias("name"),
        F.when(size != 11, F.col("description")).alias("description"),
        F.when(size == 12, F.lit("NULL")).otherwise(F.col("image_path")).alias("image_path"),
    )


RAW = f"""{PRODUCTS},
  raw AS (
    SELECT CASE WHEN p_size <> 50 THEN id END AS id, category, CASE WHEN p_size <> 7 THEN name END AS name,
           CASE WHEN p_size <> 11 THEN description END AS description,
           CASE WHEN p_size <> 12 THEN image_path END AS image_path
    FROM products JOIN part ON id = p_partkey)"""


def read_csv(spark, sf):
    path = scratch_dir(spark, "products-csv")
    product_csv.write_products_csv(S.products(spark, sf), path)
    return product_csv.read_products_csv(spark, path)


def require(spark, sf):
    return loading.require_columns(S.products(spark, sf)).select(*PRODUCT_SCHEMA.names)


def clean(spark, sf):
    return loading.clean_products(raw_products(spark, sf), loading.NA_SPELLINGS)


def replace(spark, sf):
    path = scratch_dir(spark, "products")
    product_tables.replace_table(S.products(spark, sf), path)
    return product_tables.read_products_parquet(spark, path)


def verify(spark, sf):
    return loading.verify_load(S.products(spark, sf))


def scan(spark, sf):
    path = scratch_dir(spark, "products")
    product_tables.replace_table(S.products(spark, sf), path)
    stored = product_tables.read_products_parquet(spark, path)
    return stored.filter(F.col("category") == "PROMO").select("id", "name")


def repeated_products(spark, sf):
    """Every product once more per order line that names it, so keys repeat."""
    lines = S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return S.products(spark, sf).unionByName(S.products(spark, sf).join(lines, "id"))


def check(spark, sf):
    return loading.check_products(repeated_products(spark, sf))


def duplicates(spark, sf):
    return loading.duplicated_ids(repeated_products(spark, sf))


REPEATED = f"{PRODUCTS}, repeated AS (SELECT * FROM products UNION ALL SELECT p.* FROM products p JOIN lineitem ON id = l_partkey)"


def part_ids(spark, sf):
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def generate(spark, sf):
    return generating.generate_products(part_ids(spark, sf), "7")


def _hash(feature: str) -> str:
    return f"('0x' || substr(md5(p_partkey || ':{feature}:7'), 1, 8))::BIGINT"


def _choice(values: list[str], feature: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({_hash(feature)} % {len(values)} + 1)::INT]"


def _between(low: int, high: int, feature: str) -> str:
    return f"({_hash(feature)} % {high - low + 1} + {low})"


GENERATED = f"""
  generated AS (
    SELECT p_partkey AS id,
           upper(substr(c, 1, 1)) || substr(c, 2) AS category, brand || ' ' || model AS name,
           'screen ' || screen || ' inch' || chr(10) || 'memory ' || memory || ' GB' || chr(10) || 'battery ' || battery
             || ' mAh' || chr(10) || 'operating system ' || os AS description
    FROM (SELECT p_partkey, {_choice(generating.CATEGORIES, 'category')} AS c, {_choice(generating.BRANDS, 'brand')} AS brand,
                 {_choice(generating.MODELS, 'model')} AS model, {_between(*generating.SCREEN_TENTHS, 'screen')} / 10 AS screen,
                 {_between(*generating.MEMORY_GB, 'memory')} AS memory, {_between(*generating.BATTERY_MAH, 'battery')} AS battery,
                 {_choice(generating.OPERATING_SYSTEMS, 'operating_system')} AS os
          FROM part))"""


def fill(spark, sf):
    part = S.table(spark, sf, "part")
    columns = ["p_name", "p_type", "p_size", "p_brand"]
    filled = generating.fill_template(part, "[p_name] ([p_type]) size [p_size], again [p_name], [unknown]", columns)
    return filled.select("p_partkey", "description")


def images(spark, sf):
    ending = F.when(F.col("p_size") > 45, ".png").otherwise(".jpg")
    files = S.table(spark, sf, "part").select(
        F.concat(F.lower("p_type"), F.lit("_"), F.lower("p_name"), ending).alias("file_name")
    )
    return generating.assign_images(S.products(spark, sf).drop("image_path"), files.distinct(), "pictures", "7").select(
        "id", "category", "image_path"
    )


def vectors_stored(spark, sf):
    path = scratch_dir(spark, "vectors")
    vector_store.write_vectors(S.vectors(spark, sf), path)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x), 6)
    return vector_store.read_vectors(spark, path).select(
        "id", total("text").alias("text_square"), total("image").alias("image_square"), F.array_size("image").alias("image_width")
    )


def bitmaps(spark, sf):
    """An 8 x 8 picture per vector as BMP bytes; some products have none, some are cut short."""
    pixel = lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(v * 400 + 128).cast("int"))).cast("long")), 2, "0")
    body = F.array_join(F.transform("embedding", lambda v: F.repeat(pixel(v), 3)), "")
    # A 54-byte header: 8 x 8 pixels, 24 bits each, no compression.
    head = "424DF600000000000000360000002800000008000000080000000100180000000000C0000000130B0000130B00000000000000000000"
    content = F.unhex(F.concat(F.lit(head), body))
    return S.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        "label",
        F.format_string("pic_%d.bmp", "vec_id").alias("file_name"),
        F.when(F.col("label") == 3, F.unhex(F.lit("00"))).otherwise(content).alias("content"),
    )


def pictures_read(spark, sf):
    """Products with the pictures read back from files; label 5 never gets a file."""
    folder = scratch_dir(spark, "pictures")
    made = bitmaps(spark, sf)
    image_files.write_files(made.filter("label <> 5"), folder).write.format("noop").mode("overwrite").save()
    products = made.select("id", F.concat(F.lit("img/"), "file_name").alias("image_path"))
    return image_files.with_images(products, image_files.read_images(spark, folder), "img")


def read_pictures(spark, sf):
    return pictures_read(spark, sf).select(
        "id", F.col("image").isNotNull().alias("has_image"), F.col("image.height").alias("height"), F.col("image.width").alias("width")
    )


QUERIES = {
    "s1_read_products_csv": read_csv,
    "s2_require_columns": require,
    "s3_clean_products": clean,
    "s4_replace_table": replace,
    "s5_verify_load": verify,
    "s6_scan_products": scan,
    "s7_check_products": check,
    "s7_duplicated_ids": duplicates,
    "s8_generate_products": generate,
    "s9_fill_template": fill,
    "s10_assign_images": images,
    "s11_vector_store": vectors_stored,
    "s12_read_images": read_pictures,
}

SQL = {
    "s1_read_products_csv": f"WITH {PRODUCTS} SELECT * FROM products",
    "s2_require_columns": f"WITH {PRODUCTS} SELECT * FROM products",
    "s3_clean_products": f"""WITH {RAW}
        SELECT id, category, name, coalesce(description, '') AS description, coalesce(image_path, '') AS image_path
        FROM raw WHERE id IS NOT NULL AND name IS NOT NULL""",
    "s4_replace_table": f"WITH {PRODUCTS} SELECT * FROM products",
    "s5_verify_load": f"""WITH {PRODUCTS}
        SELECT id, name, substr(description, 1, 50) || '...' AS description_preview,
               (SELECT count(*) FROM products) AS row_count
        FROM products ORDER BY id LIMIT 5""",
    "s6_scan_products": f"WITH {PRODUCTS} SELECT id, name FROM products WHERE category = 'PROMO'",
    "s7_check_products": f"""WITH {REPEATED}
        SELECT count(*) AS row_count, count(*) - count(DISTINCT id) AS duplicate_ids,
               count(*) FILTER (id IS NULL) AS missing_ids, count(*) FILTER (length(category) > 255) AS long_category,
               count(*) FILTER (length(name) > 255) AS long_name, count(*) FILTER (length(image_path) > 255) AS long_image_path
        FROM repeated""",
    "s7_duplicated_ids": f"WITH {REPEATED} SELECT id, count(*) AS copies FROM repeated GROUP BY id HAVING count(*) > 1",
    "s8_generate_products": f"WITH {GENERATED} SELECT * FROM generated",
    "s9_fill_template": """
        SELECT p_partkey, p_name || ' (' || p_type || ') size ' || p_size || ', again ' || p_name || ', [unknown]' AS description
        FROM part""",
    "s10_assign_images": f"""WITH {PRODUCTS},
        files AS (SELECT DISTINCT lower(p_type) || '_' || lower(p_name) || CASE WHEN p_size > 45 THEN '.png' ELSE '.jpg' END AS file_name FROM part),
        matches AS (SELECT category, file_name FROM (SELECT DISTINCT category FROM products) JOIN files
                    ON contains(file_name, lower(category)) AND file_name LIKE '%.jpg'),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(file_name), file_name) AS n,
                            count(*) OVER (PARTITION BY category) AS file_count FROM matches),
        counts AS (SELECT DISTINCT category, file_count FROM numbered),
        picked AS (SELECT id, category, ('0x' || substr(md5(id || ':image:7'), 1, 8))::BIGINT % file_count + 1 AS n
                   FROM products LEFT JOIN counts USING (category))
        SELECT id, p.category, 'pictures/' || file_name AS image_path
        FROM picked p LEFT JOIN numbered m ON m.category = p.category AND m.n = p.n""",
    "s11_vector_store": f"""WITH {VECTORS}
        SELECT id, round(list_dot_product(text, text), 6) AS text_square,
               CASE WHEN id % 17 <> 0 THEN round(list_dot_product(image, image), 6) END AS image_square,
               CASE WHEN id % 17 <> 0 THEN len(image)::INT END AS image_width
        FROM vectors""",
    "s12_read_images": """
        SELECT vec_id AS id, label NOT IN (3, 5) AS has_image, CASE WHEN label NOT IN (3, 5) THEN 8 END AS height,
               CASE WHEN label NOT IN (3, 5) THEN 8 END AS width
        FROM embeddings""",
}
