"""SQL of the stand-in tables, shared by the registered queries."""

NL = "chr(10)"

PRODUCTS = f"""
  products AS (
    SELECT p_partkey AS id, p_type AS category, p_name AS name,
           'brand ' || p_brand || {NL} || 'size ' || p_size || {NL} || 'price ' || printf('%.2f', p_retailprice) AS description,
           'img/' || lower(p_type) || '_' || (p_partkey % 5) || '.jpg' AS image_path
    FROM part)"""

# A missing image is all zeros here: the list functions refuse nulls, and both score 0.
VECTORS = """
  vectors AS (
    SELECT vec_id AS id, list_slice(embedding::DOUBLE[], 1, 32) AS text,
           CASE WHEN vec_id % 17 <> 0 THEN list_slice(embedding::DOUBLE[], 33, 64)
                ELSE list_transform(range(32), lambda i: 0.0::DOUBLE) END AS image
    FROM embeddings)"""

LOG = """
  log AS (
    SELECT event_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
           '/' || event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
           value / 100 AS duration_s,
           CASE WHEN user_id % 10 <> 0 THEN user_id::VARCHAR END AS user_id,
           CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS rec_type,
           event_type = 'error' AS error
    FROM events)"""


def text_cosine(a: str, b: str) -> str:
    return (
        f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"
    )


def image_cosine(a: str, b: str) -> str:
    return (
        f"coalesce(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-8), 0)"
    )


def blend(a: str, b: str, wt: str | float, wi: str | float) -> str:
    text = f"{text_cosine(f'{a}.text', f'{b}.text')} * {wt}"
    image = f"{image_cosine(f'{a}.image', f'{b}.image')} * {wi}"
    return f"round({text} + {image}, 6) + 0.0"


def recommendations(n: int, wt: float, wi: float, known: str = "") -> str:
    """CTEs up to ``recs``: the n best products of every product."""
    return f"""{PRODUCTS},{VECTORS.replace('FROM embeddings', f'FROM embeddings {known}')},
  scored AS (SELECT a.id AS query_id, b.id AS id, {blend('a', 'b', wt, wi)} AS score
             FROM vectors a JOIN vectors b ON a.id <> b.id),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored),
  recs AS (SELECT query_id, rank, id, name, category, description, image_path, score
           FROM placed LEFT JOIN products USING (id) WHERE rank <= {n})"""


def sliding(source: str, window_s: int = 300, slide_s: int = 60) -> str:
    """A CTE ``windowed`` with every row in each window it belongs to."""
    slide = slide_s * 1_000_000
    return f"""
  windowed AS (
    SELECT s.*, make_timestamp(epoch_us(ts) - epoch_us(ts) % {slide} - k * {slide}) AS window_start,
           make_timestamp(epoch_us(ts) - epoch_us(ts) % {slide} - k * {slide} + {window_s * 1_000_000}) AS window_end
    FROM {source} s, range({window_s // slide_s}) r(k))"""
