"""Reference data that comes with the code: the category tree and the stores, each from a text of one line per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varve import schema

# Roots (slug, icon, name) with their children (slug, name).
TREE = """
electronique 📺 Électronique: televiseurs Téléviseurs, audio Audio & Son, casques Casques & Écouteurs, cameras Photo & Vidéo, maison-intelligente Maison intelligente
informatique 💻 Informatique: portables Portables, ordinateurs Ordinateurs de bureau, moniteurs Moniteurs, composants Composants PC, stockage Stockage & Disques, imprimantes Imprimantes, reseau Réseau & Wi-Fi
mobile 📱 Mobile & Tablettes: telephones Téléphones déverrouillés, telephones-forfait Téléphones avec forfait, tablettes Tablettes, montres Montres connectées, accessoires-mobile Accessoires mobiles
jeux-video 🎮 Jeux vidéo: playstation PlayStation, nintendo Nintendo, xbox Xbox, pc-gaming PC Gaming, realite-virtuelle Réalité virtuelle
electromenagers 🧺 Électroménagers: gros-electro Gros électroménagers, petits-electro Petits électroménagers, aspirateurs Aspirateurs
maison 🏠 Maison & Cuisine: cuisine Cuisine & Vaisselle, literie Literie & Textiles, rangement Rangement, luminaires Luminaires, decoration Décoration
meubles 🛋️ Meubles: salon Salon, chambre Chambre, salle-a-manger Salle à manger, bureau-meubles Bureau
outils 🔧 Outils & Rénovation: outils-electriques Outils électriques, outils-main Outils à main, quincaillerie Quincaillerie, jardinage Jardinage & Extérieur
auto 🚗 Auto: pieces-auto Pièces & Entretien, audio-auto Audio & Vidéo auto, cameras-auto Caméras de route, accessoires-auto Gadgets & Accessoires, gps GPS
sport 🏕️ Sport & Plein air: fitness Entraînement, velo Vélo, camping Camping & Pêche, sports-hiver Sports d’hiver
jouets 🧸 Jouets & Jeux: lego LEGO & Construction, jeux-societe Jeux de société, jouets-enfants Jouets pour enfants, jouets-exterieur Jeux d’extérieur, modelisme Modélisme & RC
mode 👕 Mode & Accessoires: bijoux Bijoux, montres-mode Montres, accessoires-mode Accessoires, vetements Vêtements, bagages Bagages & Sacs
beaute-sante 💄 Beauté & Santé: beaute-corps Beauté & Soins du corps, soins-cheveux Soins capillaires, soins-dentaires Soins dentaires, massage Massage & Récupération, bien-etre Bien-être
bebe 🍼 Bébé & Enfant: poussettes Poussettes & Sièges, mobilier-bebe Mobilier de chambre, alimentation-bebe Alimentation, moniteurs-bebe Moniteurs & Sécurité
animaux 🐾 Animaux: habitat-animaux Habitat & Transport, alimentation-animaux Alimentation & Gâteries, toilettage-animaux Toilettage & Santé, accessoires-animaux Colliers & Laisses
bureau 📎 Bureau & Papeterie: encre-toner Encre & Toner, papeterie Stylos & Papeterie, rangement-bureau Classement & Rangement, papier Papier
epicerie 🛒 Épicerie:
"""

# Stores of Canada by id, name, kind, colour and home page; those with a mark at the end are read.
STORES = """
bestbuy-ca | Best Buy | retailer | #0046BE | https://www.bestbuy.ca | read
newegg-ca | Newegg | retailer | #F7A21D | https://www.newegg.ca | read
ikea-ca | IKEA | retailer | #0058A3 | https://www.ikea.com/ca/fr/ | read
walmart-ca | Walmart | retailer | #0071CE | https://www.walmart.ca
canadiantire-ca | Canadian Tire | retailer | #C8102E | https://www.canadiantire.ca | read
costco-ca | Costco | retailer | #005DAA | https://www.costco.ca | read
amazon-ca | Amazon | retailer | #FF9900 | https://www.amazon.ca
winners-ca | Winners | retailer | #E4002B | https://www.winners.ca
memoryexpress-ca | Memory Express | retailer | #00A94F | https://www.memoryexpress.com
brick-ca | Brick | retailer | #D6001C | https://www.thebrick.com | read
leons-ca | Leon's | retailer | #E31837 | https://www.leons.ca | read
tanguay-ca | Tanguay | retailer | #003DA5 | https://www.tanguay.ca
structube-ca | Structube | retailer | #1A1A1A | https://www.structube.com | read
wayfair-ca | Wayfair | retailer | #7F187F | https://www.wayfair.ca
galeriedumeuble-ca | Galerie du Meuble | retailer | #8B6F47 | https://www.galeriedumeuble.com
meublezvous-ca | Meublez-Vous | retailer | #C8102E | https://www.meublez-vous.ca
dormezvous-ca | Dormez-vous | retailer | #00539B | https://www.dormezvous.com
canac-ca | Canac | retailer | #00833E | https://www.canac.ca
linenchest-ca | Linen Chest | retailer | #4A4A4A | https://www.linenchest.com | read
stokes-ca | Stokes | retailer | #E30613 | https://www.stokesstores.com
ricardo-ca | Ricardo | retailer | #E4002B | https://boutique.ricardocuisine.com
homesense-ca | HomeSense | retailer | #00447C | https://www.homesense.ca
marshalls-ca | Marshalls | retailer | #0033A0 | https://www.marshalls.ca
bouclair-ca | Bouclair | retailer | #8C1D40 | https://www.bouclair.com | read
casper-ca | Casper | retailer | #0B3D91 | https://casper.com | read
umbra-ca | Umbra | retailer | #1D1D1B | https://ca.umbra.com | read
frankandoak-ca | Frank And Oak | retailer | #2E3B4E | https://www.frankandoak.com | read
clement-ca | Clement | retailer | #E4002B | https://www.clement.ca | read
deserres-ca | DeSerres | retailer | #009B48 | https://www.deserres.ca | read
apple-ca | Apple | manufacturer | #555555 | https://www.apple.com/ca/fr/
dell-ca | Dell | manufacturer | #007DB8 | https://www.dell.com/fr-ca
samsung-ca | Samsung | manufacturer | #1428A0 | https://www.samsung.com/ca_fr/
lg-ca | LG | manufacturer | #A50034 | https://www.lg.com/ca_fr
lenovo-ca | Lenovo | manufacturer | #E2231A | https://www.lenovo.com/ca/fr/
hp-ca | HP | manufacturer | #0096D6 | https://www.hp.com/ca-fr/
"""


def category_rows() -> list[tuple]:
    """slug, name, parent_slug, icon and sort_order of each category, roots before their children."""
    rows = []
    for line in TREE.strip().splitlines():
        root, _, children = line.partition(":")
        slug, icon, name = root.split(" ", 2)
        rows.append((slug, name, None, icon, len(rows) + 1))
        rows += [(*child.strip().split(" ", 1), slug, None, len(rows) + k) for k, child in enumerate(children.split(","), 1) if child.strip()]
    return rows


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(category_rows(), schema.CATEGORIES)


def store_rows() -> list[tuple]:
    """store_id, name, kind, country, currency, homepage, color, enabled."""
    rows = []
    for line in STORES.strip().splitlines():
        store, name, kind, color, homepage, *read = (x.strip() for x in line.split("|"))
        rows.append((store, name, kind, "CA", "CAD", homepage, color, bool(read)))
    return rows


def stores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(store_rows(), schema.STORE_REGISTRY)


def root_of(categories: DataFrame) -> DataFrame:
    """slug and root; the tree has two levels."""
    return categories.selectExpr("slug", "coalesce(parent_slug, slug) as root")
