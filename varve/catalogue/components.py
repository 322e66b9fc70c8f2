"""Specifications of every family, verdicts on them, and what a listing needs besides: reference data, links, guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.functions import links, text
from varve.operators import ingest, specs
from varve.operators.spec_rules import EFFECTS, FAMILY_ORDER
from varve.plans import readmodel
from varve.sources import reference

from .base import deals, points, products, query, table


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


# What a text says, in which category it is said, and what is to be read out of it (label, metric, rank; no label: nothing).
SAID = [
    ("Écran 8K", "televiseurs", "resolution", "Résolution 8K", None, 4),
    ("moniteur FULL HD", "moniteurs", "resolution", "Résolution 1080p", None, 1),
    ("QD-OLED", "televiseurs", "dalle", "Dalle QD-OLED", None, 4),
    ("écran mini-DEL", "televiseurs", "dalle", "Rétroéclairage mini-DEL", None, 3),
    ("165 Hz", "moniteurs", "rafraichissement", "165 Hz", 165, None),
    ("délai 0,03 ms", "moniteurs", "reponse", "Temps de réponse 0,03 ms", 0.03, None),
    ("HDR10+", "televiseurs", "hdr", "HDR", None, None),
    ("écran incurvé", "moniteurs", "courbure", "Écran incurvé", None, None),
    ("65 pouces", "televiseurs", "diagonale", "Diagonale 65 po", 65, None),
    ("65 pouces", "meubles", "encombrement", "Format 65 po", 65, None),
    ("Ryzen 7 de pointe", "portables", "cpu", "Processeur Ryzen 7", None, 3),
    ("puce M3", "portables", "cpu-marque", "Puce Apple Silicon", None, None),
    ("Snapdragon", "telephones", "cpu-marque", "Processeur ARM mobile", None, None),
    ("Radeon RX 7900", "composants", "gpu", "Carte graphique Radeon RX 7900", None, 1),
    ("graphiques intégrés", "portables", "gpu-marque", "Graphiques integres", None, None),
    ("mémoire de 32 Go", "portables", "ram", "Mémoire vive 32 Go", 32, None),
    ("disque NVMe", "stockage", "stockage-type", "Stockage SSD", None, 2),
    ("2 To", "stockage", "stockage-taille", "Capacité 2 To", 2, None),
    ("suppression active du bruit", "casques", "reduction-bruit", "Réduction de bruit active", None, None),
    ("Dolby Atmos", "audio", "audio-spatial", "Dolby Atmos", None, None),
    ("30 h d’autonomie", "casques", "autonomie", "Autonomie 30 h", 30, None),
    ("FreeSync", "moniteurs", "sync", "FreeSync", None, None),
    ("WiFi 7", "reseau", "wifi", "Wi-Fi 7", None, 3),
    ("Bluetooth", "audio", "bluetooth", "Bluetooth", None, None),
    ("HDMI 2.1", "televiseurs", "hdmi", "HDMI 2.1", None, 2),
    ("Energy Star", "gros-electro", "energie", "Energy Star", None, None),
    ("5,5 litres", "petits-electro", "capacite", "Capacité 5,5 L", 5.5, None),
    ("21 pi³", "gros-electro", "capacite", "Capacité 21 pi³", 21, None),
    ("fonte émaillée", "cuisine", "materiau", "Fonte", None, 4),
    ("fonte émaillée", "jeux-video", "materiau", None, None, None),
    ("antiadhésif", "cuisine", "revetement", "Revetement antiadhesif", None, None),
    ("1500 watts", "petits-electro", "puissance", "Puissance 1500 W", 1500, None),
    ("22000 Pa", "aspirateurs", "aspiration", "Aspiration 22000 Pa", 22000, None),
    ("44 dBA", "gros-electro", "bruit", "Niveau sonore 44 dB", 44, None),
    ("300 PCM", "gros-electro", "debit-air", "Debit d’air 300 PCM", 300, None),
    ("12 000 BTU", "gros-electro", "btu", "12 000 BTU", 12000, None),
    ("1400 tr/min", "gros-electro", "essorage", "Essorage 1400 tr/min", 1400, None),
    ("filtre HEPA", "aspirateurs", "filtration", "Filtre HEPA", None, None),
    ("LiDAR", "aspirateurs", "navigation", "Cartographie laser", None, None),
    ("vidange automatique", "aspirateurs", "vidange", "Station de vidange automatique", None, None),
    ("14 couverts", "gros-electro", "couverts", "14 couverts", 14, None),
    ("IPX7", "audio", "etancheite", "Indice d’etancheite IP7", None, 3),
    ("garantie limitée de 1 an", "audio", "garantie", "Garantie 1 an", 1, None),
    ("distributeur d’eau et de glaçons", "gros-electro", "distributeur", "Distributeur d’eau et de glaçons", None, 2),
    ("machine à glaçons", "gros-electro", "glacons", "Fabrique de glaçons", None, None),
    ("machine à glaçons", "jouets", "glacons", None, None, None),
    ("portes françaises", "gros-electro", "configuration", "Portes françaises", None, None),
    ("sans givre", "gros-electro", "givre", "Sans givre", None, None),
    ("friture à air", "petits-electro", "cuisson", "Cuisson à air chaud", None, None),
    ("four à convection", "gros-electro", "convection", "Cuisson par convection", None, None),
    ("autonettoyant", "gros-electro", "autonettoyant", "Autonettoyant", None, None),
    ("à induction", "gros-electro", "plaque", "Plaque à induction", None, 3),
    ("chargement frontal", "gros-electro", "chargement", "Chargement frontal", None, None),
    ("application mobile", "maison-intelligente", "connecte", "Pilotable à distance", None, None),
    ("2 à 5 joueurs", "jeux-societe", "joueurs", "2 à 5 joueurs", 5, None),
    ("2 à 5 joueurs", "televiseurs", "joueurs", None, None, None),
    ("8 ans et plus", "jouets", "age-min", "Dès 8 ans", 8, None),
    ("45 minutes", "jeux-societe", "duree-partie", "Partie de 45 min", 45, None),
    ("250 ml", "beaute-corps", "contenance", "Contenance 250 ml", 250, None),
    ("250 ml", "auto", "contenance", None, None, None),
    ("cartouche d’origine", "encre-toner", "encre-origine", "Cartouche d’origine", None, 2),
    ("3000 pages", "encre-toner", "rendement", "Rendement 3000 pages", 3000, None),
    ("sans balais", "outils", "moteur", "Moteur sans balais", None, 2),
    ("sans balais", "velo", "moteur", None, None, None),
    ("20 V", "outils", "tension", "Batterie 20 V", 20, None),
]


def said(spark, d):
    """Each product says what its number picks, so the work grows with the products."""
    at = F.pmod(F.col("product_id"), F.lit(len(SAID))).cast("int")
    pick = lambda k: F.get(F.array(*(F.lit(s[k]) for s in SAID)), at)
    return products(spark, d).select("product_id", pick(0).alias("title"), pick(1).alias("category"), F.lit(None).cast("string").alias("description"))


# What else is read out of some of these texts: text, category, family, label, metric, rank.
ALSO = [
    ("65 pouces", "televiseurs", "encombrement", "Format 65 po", 65, None),
    ("Ryzen 7 de pointe", "portables", "cpu-marque", "Processeur AMD", None, None),
    ("Radeon RX 7900", "composants", "gpu-marque", "Graphiques AMD Radeon", None, None),
]


def _values() -> str:
    place = {(text, category): k for k, (text, category, *_) in enumerate(SAID)}
    found = [(place[t, c], c, family, label, m, r) for t, c, family, label, m, r in SAID + ALSO if label]
    return ", ".join(f"({k}, {_text(c)}, {_text(family)}, {_text(label)}, {'NULL' if m is None else float(m)}::DOUBLE, {'NULL' if r is None else r}::INTEGER)" for k, c, family, label, m, r in found)


SAID_SQL = f", said AS (SELECT product_id, s.* EXCLUDE (k) FROM products JOIN (VALUES {_values()}) s(k, category, family, label, metric, rank) ON product_id % {len(SAID)} = k)"


@query(SAID_SQL + " SELECT * FROM said")
def spc_every_family(spark, d):
    """All families, with the sets of categories outside of which some are silent."""
    return specs.extract(said(spark, d)).select("product_id", "category", "family", "label", "metric", "rank")


ORDER_SQL = f"[{', '.join(map(_text, FAMILY_ORDER))}]"


@query(SAID_SQL + f" SELECT family, count(*) AS n, list_position({ORDER_SQL}, family)::INTEGER AS place FROM said WHERE list_contains({ORDER_SQL}, family) GROUP BY family")
def srt_families_in_order(spark, d):
    """Facets of a page in their fixed order; families without a place have none."""
    counts = specs.extract(said(spark, d)).groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", specs.family_place(F.col("family"))).filter(F.col("place").isNotNull())


# Steps on scales of two, three and an unnamed number (four) of steps, and sizes that are held against their category.
JUDGED = """, s AS (SELECT p_partkey AS product_id, p_type AS category, 'plaque' AS family, NULL::DOUBLE AS metric, NULLIF(p_size % 4, 0)::INTEGER AS rank, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END::INTEGER AS scale FROM part
UNION ALL SELECT p_partkey, p_type, 'bruit', p_size::DOUBLE + 0.5e0, NULL, NULL FROM part UNION ALL SELECT p_partkey, p_type, 'wifi', NULL, NULL, NULL FROM part),
g AS (SELECT category, family, count(*) AS n, quantile_cont(metric, 0.1) AS p10, quantile_cont(metric, 0.25) AS p25, quantile_cont(metric, 0.5) AS p50, quantile_cont(metric, 0.75) AS p75, quantile_cont(metric, 0.9) AS p90 FROM s WHERE metric IS NOT NULL GROUP BY category, family HAVING count(*) >= 5),
j AS (SELECT s.*, n, p50, CASE WHEN rank IS NOT NULL THEN CASE WHEN scale = 2 THEN CASE WHEN rank >= 2 THEN 'haut' ELSE 'entree' END
 WHEN rank >= coalesce(scale, 4) THEN 'premium' WHEN rank >= 0.75 * coalesce(scale, 4) THEN 'haut' WHEN rank >= 0.5 * coalesce(scale, 4) THEN 'milieu' ELSE 'entree' END
 WHEN n IS NULL OR metric IS NULL THEN NULL WHEN metric = p50 THEN 'milieu' WHEN metric <= p10 THEN 'premium' WHEN metric <= p25 THEN 'haut' WHEN metric < p75 THEN 'milieu' ELSE 'entree' END AS tier FROM s LEFT JOIN g USING (category, family))"""


def ranked(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"), "p_size")

    def spec(family, unit=None, metric=None, rank=None, scale=None, lower=False):
        of = lambda v, kind: (F.lit(None) if v is None else v).cast(kind)
        return F.struct(F.lit(family).alias("family"), F.lit(unit).cast("string").alias("unit"), of(metric, "double").alias("metric"), of(rank, "int").alias("rank"), of(scale, "int").alias("scale"), F.lit(lower).alias("lower"))

    step = spec("plaque", rank=F.nullif(F.col("p_size") % 4, F.lit(0)), scale=F.when(F.col("product_id") % 3 == 0, 2).when(F.col("product_id") % 3 == 1, 3))
    found = F.array(step, spec("bruit", "dB", F.col("p_size") + 0.5, lower=True), spec("wifi"))
    return part.select("product_id", "category", F.explode(found).alias("s")).select("product_id", "category", "s.*")


@query(JUDGED + " SELECT product_id, count(tier) AS judged, count(*) FILTER (tier IN ('haut', 'premium')) AS above, count(*) FILTER (tier = 'entree') AS below FROM j GROUP BY product_id")
def spc_summary(spark, d):
    """How many parts of a product are above and below the usual; one without a verdict isn't counted."""
    rows = ranked(spark, d)
    return specs.summary(specs.analyse(rows, specs.distributions(rows, least=5)))


@query(JUDGED + f""", told AS (SELECT * FROM (VALUES {", ".join(f"({_text(k)}, {_text(g)}, {_text(e)})" for k, (g, e) in EFFECTS.items())}) v(family, "group", effect))
SELECT product_id, family, tier, "group", effect, CASE WHEN rank IS NOT NULL THEN CASE WHEN scale = 2 THEN 'Échelle technique établie' ELSE concat('Échelon ', rank, ' sur ', coalesce(scale, 4), ' de sa gamme') END
WHEN tier IS NOT NULL THEN concat('Médiane de la catégorie : ', CASE WHEN p50 % 1 = 0 THEN p50::BIGINT::VARCHAR ELSE printf('%.1f', p50) END, ' dB (', n, ' produits comparés)') END AS basis FROM j JOIN told USING (family)""")
def spc_explained(spark, d):
    """Verdicts with what they rest on and what the part means."""
    rows = ranked(spark, d)
    return specs.explain(rows, specs.distributions(rows, least=5)).select("product_id", "family", "tier", "group", "effect", "basis")


CATEGORY_ROWS = reference.category_rows()


@query(f""", tree AS (SELECT * FROM (VALUES {", ".join(f"({_text(s)}, {_text(n)}, {_text(p)}, {_text(i)}, {k})" for s, n, p, i, k in CATEGORY_ROWS)}) v(slug, name, parent, icon, k))
SELECT r.slug AS root, r.icon, count(*) AS products, count(DISTINCT c.slug) AS categories FROM products JOIN tree c ON c.k = 1 + product_id % {len(CATEGORY_ROWS)} JOIN tree r ON r.slug = coalesce(c.parent, c.slug) GROUP BY r.slug, r.icon""")
def src_category_roots(spark, d):
    """Products in the code's own category tree, added up to its roots."""
    tree = reference.categories(spark)
    of = reference.root_of(tree).join(tree.select("slug", "sort_order"), "slug")
    rows = products(spark, d).select((1 + F.col("product_id") % len(CATEGORY_ROWS)).cast("int").alias("sort_order")).groupBy("sort_order").agg(F.count(F.lit(1)).alias("n"))
    roots = tree.select(F.col("slug").alias("root"), "icon")
    return rows.join(of, "sort_order").groupBy("root").agg(F.sum("n").alias("products"), F.count("slug").alias("categories")).join(roots, "root").select("root", "icon", "products", "categories")


STORE_ROWS = reference.store_rows()
WIDE_SQL = {
    "products": {
        "product_id": "p_partkey", "title": "p_name", "brand": "p_brand", "model": "concat(p_name, '-', p_size)", "url": "concat('/p/', p_partkey)", "image_url": "CASE WHEN p_partkey % 5 > 0 THEN concat('/i/', p_partkey) END",
        "category_slug": "p_type", "condition": "CASE WHEN p_partkey % 10 = 8 THEN 'open-box' ELSE 'new' END", "currency": "'CAD'", "availability": "CASE WHEN p_partkey % 4 = 0 THEN 'InStock' END", "marketplace": "p_partkey % 6 = 0",
        "seller_name": "CASE WHEN p_partkey % 6 = 0 THEN concat('Seller ', p_partkey % 4) END", "price": "p_retailprice", "list_price": "p_retailprice * 2", "in_stock": "p_partkey % 11 <> 0", "rating": "(p_partkey % 21) / 4e0", "rating_count": "p_partkey % 500",
    },
    "scores": {
        "product_id": "p_partkey", "score": "(p_partkey % 1000) / 10e0", "confidence": "(p_partkey % 100) / 100e0", "drop_vs_median": "(p_partkey % 60) / 100e0", "is_lowest_ever": "p_partkey % 5 = 0", "median": "p_retailprice / 2",
        "verified_drop": "(p_partkey % 30) / 100e0", "quality_rating": "(p_partkey % 5) / 2e0", "quality_count": "p_partkey % 50", "min_ever": "p_retailprice / 4", "max_ever": "p_retailprice * 3", "days_of_history": "p_partkey % 90", "reasons": "concat('r', p_partkey % 3)",
    },
    "enrichment": {"product_id": "p_partkey", "recommend_yes": "p_partkey % 7", "recommend_total": "7 + p_partkey % 9", "reviews": "concat('[', p_partkey, ']')"},
}
WIDE_STORE = f"1 + p_partkey % {len(STORE_ROWS) + 1}"
WIDE_WHERE = {"products": "p_partkey % 13 <> 0", "scores": "p_partkey % 3 <> 2", "enrichment": "p_partkey % 4 <> 1"}


def _wide(name: str) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in WIDE_SQL[name].items())


@query(f""", wp AS (SELECT {_wide("products")}, {WIDE_STORE} AS k FROM part WHERE {WIDE_WHERE["products"]}), ws AS (SELECT {_wide("scores")} FROM part WHERE {WIDE_WHERE["scores"]}), we AS (SELECT {_wide("enrichment")} FROM part WHERE {WIDE_WHERE["enrichment"]}),
wt AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_text(s[0])}, {_text(s[1])}, {_text(s[6])})" for k, s in enumerate(STORE_ROWS, 1))}) v(k, store_id, store_name, store_color))
SELECT * EXCLUDE (k) FROM ws JOIN wp USING (product_id) JOIN wt USING (k) LEFT JOIN we USING (product_id)""")
def flt_wide_deals(spark, d):
    """The wide row of a listing out of four tables, whose other columns clash; products of unknown stores and those without a score aren't listed."""
    part = table(spark, d, "part")
    of = lambda name: part.filter(WIDE_WHERE[name]).selectExpr(*(f"{v} AS {k}" for k, v in WIDE_SQL[name].items()), f"{WIDE_STORE} AS k")
    ids = F.create_map(*(F.lit(x) for k, s in enumerate(STORE_ROWS, 1) for x in (k, s[0])))
    sold = of("products").withColumn("store_id", F.coalesce(ids[F.col("k").cast("int")], F.lit("unknown")))
    return readmodel.wide_deals(of("scores"), sold, reference.stores(spark), of("enrichment"))


@query("""SELECT product_id, concat(CASE WHEN len(left_over) > 0 THEN concat('brands=', url_encode(array_to_string(left_over, ',')), '&') ELSE '' END, 'sort=price&stock=1') AS link, CASE WHEN product_id % 5 = 1 THEN concat('/p/', product_id) ELSE '/' END AS back
FROM (SELECT product_id, CASE product_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['Autre'] WHEN 2 THEN ['Autre', brand] ELSE [brand] END AS left_over FROM products)""")
def flt_toggled_links(spark, d):
    """Links that switch a brand on or off, and the way back, which stays on this site."""
    had = F.expr("CASE product_id % 4 WHEN 0 THEN array(brand) WHEN 1 THEN array(brand, 'Autre') WHEN 2 THEN array('Autre') ELSE array() END")
    asked = F.concat(F.lit("stock=1&page=7&brands="), F.url_encode(F.array_join(had, ",")), F.lit("&empty=&sort=name&sort=price"))
    kind, p = F.col("product_id") % 5, F.col("product_id").cast("string")
    path = F.when(kind == 0, F.concat(F.lit("//p/"), p)).when(kind == 1, F.concat(F.lit("/p/"), p)).when(kind == 2, F.concat(F.lit("https://p/"), p)).when(kind == 3, F.concat(F.lit("/\\p/"), p))
    return products(spark, d).select("product_id", links.toggled(asked, "brands", F.col("brand")).alias("link"), links.safe_return_path(path).alias("back"))


@query(""", c AS (SELECT (SELECT count(*) FROM deals) AS p, (SELECT count(*) FROM deals WHERE is_active) AS kept, (SELECT count(*) FROM deals WHERE is_active AND condition = 'new' AND in_stock) AS few, (SELECT count(*) FROM points) AS h, (SELECT count(*) FROM points WHERE in_stock) AS less)
SELECT 'kept' AS case_name, p AS products_before, kept AS products_after, h AS points_before, h AS points_after, 'ok' AS verdict FROM c UNION ALL SELECT 'lost', p, few, h, h, 'products' FROM c
UNION ALL SELECT 'forgot', p, p, h, less, 'history' FROM c UNION ALL SELECT 'new', 0, p, 0, h, 'first' FROM c""")
def snk_guarded(spark, d):
    """A snapshot is held against the one before it: kept, refused for its products or its history, or the first."""
    all_deals, all_points = deals(spark, d), points(spark, d)
    active = all_deals.filter("is_active")
    cases = {
        "kept": (all_deals, active, all_points, all_points), "lost": (all_deals, active.filter("condition = 'new' AND in_stock"), all_points, all_points),
        "forgot": (all_deals, all_deals, all_points, all_points.filter("in_stock")), "new": (all_deals.filter("false"), all_deals, all_points.filter("false"), all_points),
    }
    rows = [ingest.guard_report(*sides).withColumn("case_name", F.lit(name)) for name, sides in cases.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


MODEL = "concat(p_name, chr(9), p_brand, '-', p_type, '.', p_size, '/', p_partkey % 9)"


@query(f"""SELECT DISTINCT m AS model, regexp_replace(upper(m), '[- .]', '', 'g') AS punctuation, regexp_replace(upper(m), '[-\\s]', '', 'g') AS spaces, replace(replace(upper(m), '-', ''), ' ', '') AS blank, regexp_replace(upper(m), '[^A-Z0-9]', '', 'g') AS strict FROM (SELECT {MODEL} AS m FROM part)""")
def scl_all_model_keys(spark, d):
    """All four forms of a model key on models that tell them apart."""
    rows = table(spark, d, "part").select(F.expr(MODEL).alias("model")).distinct()
    return rows.select("model", *(text.model_key(F.col("model"), form).alias(form) for form in text.MODEL_KEY_FORMS))


@query(r"""SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
html, '(?is)<script[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style[^>]*>.*?</style\s*>', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>', ' ', 'g'), '<[^>]*>', '', 'g'),
'&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&rsquo;', '’'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS t FROM pages)""")
def scl_page_text(spark, d):
    """Whole pages as text."""
    rows = table(spark, d, "pages").select("page_id", text.plain_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))
