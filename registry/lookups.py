"""Catalogue lookups."""

from pyspark.sql import functions as F

from shelfkin.operators import catalog
from shelfkin.plans import standins as S

from .loading import RAW, raw_products
from .sql import PRODUCTS


def find(spark, sf):
    return catalog.find_product(S.products(spark, sf), 42)


def category(spark, sf):
    return catalog.by_category(S.products(spark, sf), "PROMO")


def categories(spark, sf):
    return catalog.list_categories(S.products(spark, sf))


def options(spark, sf):
    return catalog.product_options(S.products(spark, sf))


def nth(spark, sf):
    labels = catalog.product_options(S.products(spark, sf)).select("category", "label")
    return catalog.nth_products(S.products(spark, sf), labels).select("category", "n", "id", "name")


def details(spark, sf):
    return catalog.product_details(raw_products(spark, sf))


def messages(spark, sf):
    text = catalog.system_message(F.col("category"), F.col("name"), F.col("description"))
    return raw_products(spark, sf).select("id", text.alias("system_message"))


QUERIES = {
    "l1_find_product": find,
    "l2_by_category": category,
    "l3_list_categories": categories,
    "l4_product_options": options,
    "l5_nth_product": nth,
    "l6_product_details": details,
    "l7_system_message": messages,
}

RAW_NAME = "CASE WHEN p_size = 7 THEN 'n/a' ELSE name END"
# The detail and message queries keep the odd spellings as they came.
UNCLEANED = RAW.replace("CASE WHEN p_size <> 7 THEN name END AS name", f"{RAW_NAME} AS name").replace(
    "CASE WHEN p_size <> 12 THEN image_path END", "CASE WHEN p_size = 12 THEN 'NULL' ELSE image_path END"
)

SQL = {
    "l1_find_product": f"WITH {PRODUCTS} SELECT * FROM products WHERE id = 42",
    "l2_by_category": f"WITH {PRODUCTS} SELECT * FROM products WHERE category = 'PROMO'",
    "l3_list_categories": f"WITH {PRODUCTS} SELECT category, min(id) AS first_id FROM products GROUP BY category ORDER BY 2",
    "l4_product_options": f"""WITH {PRODUCTS},
        numbered AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS n FROM products)
        SELECT category, n, id, n || '. ' || name || ' (' || replace(description, chr(10), ', ') || ')' AS label FROM numbered""",
    "l5_nth_product": f"""WITH {PRODUCTS}
        SELECT category, row_number() OVER (PARTITION BY category ORDER BY id) AS n, id, name FROM products""",
    "l6_product_details": f"""WITH {UNCLEANED}
        SELECT id, coalesce(name, 'Unknown Product') AS title,
               replace(coalesce(description, 'No description available'), chr(10), '  ' || chr(10)) AS body,
               image_path IS NOT NULL AS has_image FROM raw""",
    "l7_system_message": f"""WITH {UNCLEANED}
        SELECT id, 'Generate recommendations for product:  ' || chr(10) || coalesce(category, 'Unknown') || ' '
               || coalesce(name, 'Unknown Product') || ' (' || replace(coalesce(description, ''), chr(10), ', ') || ')' AS system_message
        FROM raw""",
}
