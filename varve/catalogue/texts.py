"""Text: folding, keys, markup, specs and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.functions import jsonld, prices, text
from varve.operators import specs, textsearch
from varve.operators.filters import DealFilters
from varve.operators.spec_rules import RULES
from varve.plans import rebuild

from .base import R6, categories, deals, products, query, r6, table


@query(r"""SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '[^a-z]+', '', 'g')) AS folded FROM documents""")
def scl_fold(spark, d):
    """The letters alone, of every document."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace(text.fold(F.col("text")), "[^a-z]+", "").cast("binary")).alias("folded"))


@query(r"""SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g')) AS folded FROM documents""")
def scl_fold_whole_texts(spark, d):
    """Every document of every language, to its end."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace(text.fold(F.col("text")), "[^a-z0-9]+", "-").cast("binary")).alias("folded"))


@query(r"""SELECT DISTINCT title, trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(upper(model), '[- .]', '', 'g') AS punctuation_key, regexp_replace(upper(model), '[^A-Z0-9]', '', 'g') AS strict_key FROM products""")
def scl_slugs_and_model_keys(spark, d):
    return products(spark, d).select("title", text.slug(F.col("title")).alias("slug"), text.model_key(F.col("model")).alias("punctuation_key"), text.model_key(F.col("model"), "strict").alias("strict_key")).distinct()


@query(r"""SELECT page_id, html_title, links FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS html_title, len(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS links FROM pages)""")
def src_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("html_title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).cast("long").alias("links"))


@query()
def scl_plain_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.plain_text(F.col("html")).alias("text"), text.lead_sentences(text.plain_text(F.col("html"))).alias("lead"), jsonld.layered_price(F.col("html")).alias("price"))


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def scl_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(r"""SELECT product_id, CASE WHEN product_id % 3 = 0 THEN product_id + 0.5e0 WHEN product_id % 3 = 1 THEN product_id + 1000.25e0 ELSE NULL END AS amount FROM products""")
def scl_bilingual_price(spark, d):
    i = F.col("product_id").cast("string")
    raw = F.when(F.col("product_id") % 3 == 0, F.concat(F.lit("<b>$"), i, F.lit(".50</b>"))).when(F.col("product_id") % 3 == 1, F.concat((F.col("product_id") + 1000).cast("string"), F.lit(",25&nbsp;$"))).otherwise("sur demande")
    return products(spark, d).select("product_id", prices.bilingual_price(raw).alias("amount"))


SPEC_SQL = r"""SELECT product_id, family, label, metric, rank FROM (
SELECT product_id, 'resolution' AS family, CASE product_id % 4 WHEN 0 THEN 'Résolution 4K' WHEN 1 THEN 'Résolution 1440p' WHEN 2 THEN 'Résolution 1080p' END AS label, NULL::DOUBLE AS metric, CASE product_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS rank FROM products
UNION ALL SELECT product_id, 'dalle', CASE product_id % 4 WHEN 0 THEN 'Dalle OLED' WHEN 1 THEN 'Dalle QLED' END, NULL, CASE product_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 END FROM products
UNION ALL SELECT product_id, 'hdr', CASE product_id % 4 WHEN 3 THEN 'HDR' END, NULL, NULL FROM products
UNION ALL SELECT product_id, 'rafraichissement', (60 * (1 + product_id % 4))::VARCHAR || ' Hz', 60 * (1 + product_id % 4), NULL FROM products
UNION ALL SELECT product_id, 'encombrement', 'Format ' || regexp_extract(title, '([0-9]{2}) po', 1) || ' po', regexp_extract(title, '([0-9]{2}) po', 1)::DOUBLE, NULL FROM products
UNION ALL SELECT product_id, 'ram', CASE WHEN product_id % 6 = 0 THEN 'Mémoire vive 16 Go' END, 16, NULL FROM products
UNION ALL SELECT product_id, 'stockage-type', CASE WHEN product_id % 6 = 0 THEN 'Stockage SSD' END, NULL, 2 FROM products
UNION ALL SELECT product_id, 'stockage-taille', CASE WHEN product_id % 6 = 0 THEN 'Capacité 1 To' END, 1, NULL FROM products
UNION ALL SELECT product_id, 'gpu-marque', CASE WHEN product_id % 6 = 1 THEN 'Graphiques NVIDIA' END, NULL, NULL FROM products
UNION ALL SELECT product_id, 'gpu', CASE WHEN product_id % 6 = 1 THEN 'Carte graphique RTX 4070' END, NULL, 3 FROM products
UNION ALL SELECT product_id, 'cpu-marque', CASE WHEN product_id % 6 = 2 THEN 'Processeur Intel' END, NULL, NULL FROM products
UNION ALL SELECT product_id, 'cpu', CASE WHEN product_id % 6 = 2 THEN 'Processeur Core i7' END, NULL, 3 FROM products
UNION ALL SELECT product_id, 'wifi', CASE WHEN product_id % 6 = 3 THEN 'Wi-Fi 6e' END, NULL, 2 FROM products
UNION ALL SELECT product_id, 'bluetooth', CASE WHEN product_id % 6 = 3 THEN 'Bluetooth 5.3' END, NULL, 3 FROM products
UNION ALL SELECT product_id, 'garantie', CASE WHEN product_id % 6 = 4 THEN 'Garantie 2 ans' END, 2, NULL FROM products) WHERE label IS NOT NULL"""


def extracted(spark, d):
    return specs.extract(products(spark, d), description=None)


@query(SPEC_SQL)
def spc_extract(spark, d):
    return extracted(spark, d).select("product_id", "family", "label", "metric", "rank")


@query(f""", s AS (SELECT category, metric_key, metric FROM (SELECT category, 'rafraichissement|Hz' AS metric_key, (60 * (1 + product_id % 4))::DOUBLE AS metric FROM products UNION ALL SELECT category, 'encombrement|po', regexp_extract(title, '([0-9]{{2}}) po', 1)::DOUBLE FROM products
UNION ALL SELECT category, 'ram|Go', 16 FROM products WHERE product_id % 6 = 0 UNION ALL SELECT category, 'stockage-taille|To', 1 FROM products WHERE product_id % 6 = 0 UNION ALL SELECT category, 'garantie|ans', 2 FROM products WHERE product_id % 6 = 4))
SELECT category, metric_key, count(*) AS n, {", ".join(f"{R6(f'quantile_cont(metric, {q})')} AS {name}" for q, name in ((0.1, 'p10'), (0.25, 'p25'), (0.5, 'p50'), (0.75, 'p75'), (0.9, 'p90')))} FROM s GROUP BY category, metric_key HAVING count(*) >= 30""")
def spc_distributions(spark, d):
    return specs.distributions(extracted(spark, d)).select("category", "metric_key", "n", *(r6(F.col(c)).alias(c) for c in ("p10", "p25", "p50", "p75", "p90")))


@query(f""", m AS (SELECT product_id, p_type AS category, p_size::DOUBLE AS metric FROM products JOIN part ON p_partkey = product_id),
g AS (SELECT category, count(*) AS n, quantile_cont(metric, 0.1) AS p10, quantile_cont(metric, 0.25) AS p25, quantile_cont(metric, 0.5) AS p50, quantile_cont(metric, 0.75) AS p75, quantile_cont(metric, 0.9) AS p90 FROM m GROUP BY category HAVING count(*) >= 30)
SELECT product_id, CASE WHEN n IS NULL THEN NULL WHEN metric = p50 THEN 'milieu' WHEN metric >= p90 THEN 'premium' WHEN metric >= p75 THEN 'haut' WHEN metric > p25 THEN 'milieu' ELSE 'entree' END AS tier FROM m LEFT JOIN g USING (category)""")
def spc_tiers(spark, d):
    part = table(spark, d, "part")
    none = lambda t: F.lit(None).cast(t)
    rows = part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"), F.lit("size").alias("family"), F.lit("po").alias("unit"), F.col("p_size").cast("double").alias("metric"), none("int").alias("rank"), none("int").alias("scale"), F.lit(False).alias("lower"))
    return specs.analyse(rows, specs.distributions(rows)).select("product_id", "tier")


def _re2(pattern: str) -> str:
    """A rule's pattern for an engine that can't look ahead; as a rule is only asked whether it matches, what follows may be taken."""
    return pattern.replace("(?!\\w)", "(?:[^a-z0-9_]|$)").replace("(?![a-z0-9])", "(?:[^a-z0-9]|$)").replace("'", "''")


@query(", texts AS MATERIALIZED (SELECT strip_accents(lower(title)) AS t FROM products) " + " UNION ALL ".join(
    f"SELECT {k} AS rule, '{family}' AS family, '{pattern.replace(chr(39), chr(39) * 2)}' AS pattern, count(*) FILTER (regexp_matches(t, '{_re2(pattern)}')) AS hits FROM texts" for k, (family, pattern, *_) in enumerate(RULES)))
def aud_rule_hits(spark, d):
    return specs.rule_hits(products(spark, d), description=None)


BM25 = """, toks AS (SELECT doc_id AS doc, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM documents),
lens AS (SELECT doc, count(*) AS length FROM toks GROUP BY doc), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(length) FROM lens) / (SELECT count(*) FROM documents)::DOUBLE AS mean),
per AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, CASE WHEN token = 'the' THEN 0 END AS term FROM toks WHERE token = 'the' UNION ALL SELECT doc, 1 FROM toks WHERE starts_with(token, 'eren')) GROUP BY doc, term),
idf AS (SELECT term, greatest(ln((n - count(*) + 0.5e0) / (count(*) + 0.5e0)), 1e-6) AS w FROM per, st GROUP BY term, n)
SELECT doc AS doc_id, -floor(sum(w * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / mean))) * 1e4 + 0.5) / 1e4 AS bm25 FROM per JOIN idf USING (term) JOIN lens USING (doc), st GROUP BY doc HAVING count(*) = 2"""


@query(BM25)
def txt_bm25(spark, d):
    docs = table(spark, d, "documents")
    found = textsearch.match_texts(docs, "doc_id", ["text"], "The éren")
    return found.select(F.col("doc").alias("doc_id"), (-F.floor(-F.col("bm25") * 1e4 + 0.5) / 1e4).alias("bm25"))


SEARCH = """, toks AS (SELECT product_id AS doc, unnest(list_filter(regexp_split_to_array(strip_accents(lower(concat_ws(' ', title, brand))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM products),
lens AS (SELECT doc, count(*) AS length FROM toks GROUP BY doc), st AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
per AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, 0 AS term FROM toks WHERE token = 'blue' UNION ALL SELECT doc, 1 FROM toks WHERE starts_with(token, 'oled')) GROUP BY doc, term),
idf AS (SELECT term, greatest(ln((n - count(*) + 0.5e0) / (count(*) + 0.5e0)), 1e-6) AS w FROM per, st GROUP BY term, n),
met AS (SELECT doc AS product_id, -sum(w * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / mean))) AS bm25 FROM per JOIN idf USING (term) JOIN lens USING (doc), st GROUP BY doc HAVING count(*) = 2),
page AS (SELECT product_id, score, bm25 + (100 - score) * 0.06 AS relevance, count(*) OVER () AS total FROM met JOIN deals USING (product_id) ORDER BY relevance, product_id LIMIT 48)
SELECT product_id, score, total, floor(relevance * 1e4 + 0.5) / 1e4 AS relevance FROM page"""


def search_index(spark, d):
    items = products(spark, d)
    return textsearch.postings(items, "product_id", ["title", "brand"]), textsearch.statistics(items, ["title", "brand"])


def shown(page):
    return page.select("product_id", "score", "total", (F.floor(F.col("relevance") * 1e4 + 0.5) / 1e4).alias("relevance"))


@query(SEARCH)
def txt_search(spark, d):
    """Relevance blended with the deal score, with the total."""
    return shown(textsearch.search(*search_index(spark, d), deals(spark, d).select("product_id", "score"), "blue oled"))


@query(SEARCH.replace("USING (product_id) ORDER", "USING (product_id) WHERE is_active AND is_variant_lead AND condition <> 'new' AND (in_stock IS NULL OR in_stock) ORDER"))
def txt_search_filtered(spark, d):
    """A search within a listing's filters."""
    return shown(textsearch.search(*search_index(spark, d), deals(spark, d), "blue oled", within=DealFilters(condition="used", in_stock_only=True)))


SUGGEST = SEARCH[: SEARCH.index("idf AS")].replace("token = 'blue'", "token = 'brand'").replace("starts_with(token, 'oled')", "starts_with(token, '12')") + r"""
idf AS (SELECT term, greatest(ln((n - count(*) + 0.5e0) / (count(*) + 0.5e0)), 1e-6) AS w FROM per, st GROUP BY term, n),
near AS (SELECT doc, -sum(w * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / mean))) AS bm25 FROM per JOIN idf USING (term) JOIN lens USING (doc), st GROUP BY doc HAVING count(*) = 2 ORDER BY floor(bm25 * 1e9 + 0.5), doc LIMIT 100),
titled AS (SELECT doc, bm25, title, strip_accents(lower(title)) AS f FROM near JOIN products ON product_id = doc),
ranked AS (SELECT *, CASE WHEN starts_with(f, 'brand 12') THEN 2 WHEN contains(f, 'brand 12') THEN 3 ELSE 4 END AS class FROM titled),
one AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY left(f, 34) ORDER BY class, floor(bm25 * 1e9 + 0.5), doc) = 1)
SELECT kind, label, id, class, floor("by" * 1e4 + 0.5) / 1e4 AS "by" FROM (
SELECT * FROM (SELECT 'brand' AS kind, min(replace(brand, '#', ' ')) AS label, NULL AS id, 0 AS class, -count(*)::DOUBLE AS "by" FROM products GROUP BY replace(lower(brand), '#', ' ') HAVING starts_with(replace(lower(brand), '#', ' '), 'brand 12') ORDER BY "by", label LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'product', title, doc::VARCHAR, class, bm25 FROM one ORDER BY class, floor(bm25 * 1e9 + 0.5), doc LIMIT 4))"""


@query(SUGGEST)
def txt_suggest(spark, d):
    """Brands and categories from a written prefix table, products from a written index."""
    from .sinks import place

    items = products(spark, d).withColumn("brand", F.replace("brand", F.lit("#"), F.lit(" ")))
    textsearch.write_prefix_table(textsearch.prefix_table(items, categories(spark, d)), path := place(spark, "prefixes"))
    index, stats = rebuild.write_text_index(items, "product_id", ["title", "brand"], place(spark, "titles"))
    found = textsearch.suggest(items, categories(spark, d), index, stats, "brand 12", prefixes=spark.read.parquet(path))
    return found.withColumn("by", F.floor(F.col("by") * 1e4 + 0.5) / 1e4)


@query(""", parts AS (SELECT slug AS id, name, regexp_split_to_array(lower(name), '[^a-z0-9]+') AS words FROM categories), words AS (SELECT DISTINCT id, name, unnest(words) AS w FROM parts),
edges AS (SELECT DISTINCT id, name, left(w, n) AS prefix FROM (SELECT id, name, w, unnest(range(1, length(w) + 1)) AS n FROM words)),
brands AS (SELECT min(brand) AS label, count(*) AS n, lower(brand) AS k FROM products WHERE brand IS NOT NULL GROUP BY lower(brand))
SELECT 'category' AS kind, prefix, name AS label, id, 0e0 AS "by" FROM edges QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY name, id) = 1
UNION ALL SELECT 'brand', prefix, label, NULL, -n::DOUBLE FROM (SELECT label, n, left(k, i) AS prefix FROM (SELECT *, unnest(range(1, length(k) + 1)) AS i FROM brands)) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, label) <= 2""")
def txt_prefix_table(spark, d):
    return textsearch.prefix_table(products(spark, d), categories(spark, d))


@query(r"""SELECT token, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS token FROM documents) GROUP BY token HAVING count(*) >= 2""")
def txt_document_frequencies(spark, d):
    return textsearch.document_frequencies(table(spark, d, "documents"), "doc_id", ["text"]).filter("n >= 2")


NAME = r"([A-Z][\p{L}0-9&-]{0,23}[\p{L}0-9])(?:[^\p{L}\p{N}_]|$)"


@query(rf"""SELECT brand, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([regexp_extract(text, '^{NAME}', 1), regexp_extract(text, '(?:^|[^\p{{L}}\p{{N}}_])de\s+{NAME}', 1)]) AS brand FROM documents)
WHERE brand <> '' GROUP BY brand HAVING count(*) >= 2 ORDER BY n DESC, brand LIMIT 1500""")
def agg_brand_candidates(spark, d):
    from varve.sources.landed import brand_candidates

    return brand_candidates(table(spark, d, "documents"), "text")


@query("""SELECT product_id, CASE WHEN title LIKE '%refurb%' THEN 'refurbished' WHEN lower(title) LIKE '%open box%' THEN 'open-box' ELSE 'new' END AS condition FROM products""")
def scl_condition(spark, d):
    return products(spark, d).select("product_id", prices.condition_of(F.col("title")).alias("condition"))


@query(""", n AS (SELECT product_id, price, list_price FROM products)
SELECT product_id, CASE WHEN price < 1000 THEN '' ELSE CAST(floor(price / 1000) AS BIGINT)::VARCHAR || chr(160) END || CASE WHEN price < 1000 THEN (CAST(floor(price * 100 + 0.5) AS BIGINT) // 100)::VARCHAR ELSE lpad(((CAST(floor(price * 100 + 0.5) AS BIGINT) // 100) % 1000)::VARCHAR, 3, '0') END
|| ',' || lpad((CAST(floor(price * 100 + 0.5) AS BIGINT) % 100)::VARCHAR, 2, '0') || chr(160) || '$' AS shown FROM n""")
def scl_money(spark, d):
    from varve.functions import display

    return products(spark, d).select("product_id", display.money(F.col("price")).alias("shown"))
