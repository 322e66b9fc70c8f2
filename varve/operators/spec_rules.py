"""What a product's text can tell about it: one rule a line, in order of priority within its family.

A rule is (family, pattern, label, options). Patterns match text folded by functions.text.fold. Labels may name
groups as {1}; of several group numbers the first that took part counts ({1,2}). Options: metric (group numbers of
a number), unit, scale and rank (a number, or the name of a rule in RANKS with the group number it takes), lower
(a lower metric is better), only (a set of categories; such a rule is silent where the category is unknown).
"""

from __future__ import annotations

# Category sets, patterns, labels, ranks and units.
SCREEN = ("televiseurs", "moniteurs", "portables", "ordinateurs", "tablettes", "telephones", "telephones-forfait", "pc-gaming", "realite-virtuelle")
APPLIANCE = ("gros-electro", "petits-electro", "cuisine", "aspirateurs")
TOOL = ("outils", "jardinage", "auto", "pieces-auto")
BEAUTY = ("beaute-sante", "beaute-corps", "soins-cheveux", "soins-dentaires", "bien-etre")
GAME = ("jeux-societe", "jouets", "jouets-enfants", "jouets-exterieur", "lego", "modelisme", "bebe")
MATERIAL = (
    "cuisine", "salle-a-manger", "petits-electro", "gros-electro", "meubles", "salon", "chambre", "bureau-meubles", "rangement", "rangement-bureau", "decoration", "literie", "luminaires", "jardinage",
    "outils", "animaux", "habitat-animaux", "accessoires-animaux", "bebe", "mobilier-bebe", "bagages", "sport", "fitness", "montres-mode", "bijoux", "accessoires-mode", "vetements",
)

RULES: list[tuple[str, str, str, dict]] = [
    ("resolution", r"\b(?:8k)\b", "Résolution 8K", {"rank": 4, "scale": 4}),
    ("resolution", r"\b(?:uhd|4k|2160p)\b", "Résolution 4K", {"rank": 3, "scale": 4}),
    ("resolution", r"\b(?:qhd|wqhd|uwqhd|1440p)\b", "Résolution 1440p", {"rank": 2, "scale": 4}),
    ("resolution", r"\b(?:fhd|1080p)\b|full ?hd", "Résolution 1080p", {"rank": 1, "scale": 4}),
    ("dalle", r"\b(?:qd[- ]?oled|qd[- ]?delo)\b", "Dalle QD-OLED", {"rank": 4, "scale": 4}),
    ("dalle", r"\b(?:oled|delo)\b", "Dalle OLED", {"rank": 4, "scale": 4}),
    ("dalle", r"mini[- ]?(?:del|led)", "Rétroéclairage mini-DEL", {"rank": 3, "scale": 4}),
    ("dalle", r"\bqled\b", "Dalle QLED", {"rank": 2, "scale": 4}),
    ("rafraichissement", r"\b(\d{2,3})\s?hz\b", "{1} Hz", {"metric": (1,), "unit": "Hz"}),
    ("reponse", r"\b(0[,.]\d{1,2})\s?ms\b", "Temps de réponse {1} ms", {"metric": (1,), "unit": "ms", "lower": True}),
    ("hdr", r"\bhdr\s?(?:10\+?|1000|400|600)?\b", "HDR", {}),
    ("courbure", r"\bincurve\b|\bcurved\b", "Écran incurvé", {}),
    ("diagonale", r"\b(\d{2,3})\s*(?:po|pouces?)\b", "Diagonale {1} po", {"metric": (1,), "unit": "po", "only": SCREEN}),
    ("encombrement", r"\b(\d{2,3})\s*(?:po|pouces?)\b", "Format {1} po", {"metric": (1,), "unit": "po"}),
    ("cpu-marque", r"\bryzen\b|\bathlon\b|\bamd\s(?:fx|a\d)\b", "Processeur AMD", {}),
    ("cpu-marque", r"\bcore\s?(?:ultra\s?)?[i3579]|\bintel\b|\bceleron\b|\bpentium\b|\bxeon\b", "Processeur Intel", {}),
    ("cpu-marque", r"\bpuce\s?m[1234]\b|\bapple\s?m[1234]\b|\bm[1234]\s?(?:pro|max|ultra)\b", "Puce Apple Silicon", {}),
    ("cpu-marque", r"\bsnapdragon\b|\bmediatek\b|\bexynos\b", "Processeur ARM mobile", {}),
    ("gpu", r"\bradeon\s?rx\s?(\d{3,4})", "Carte graphique Radeon RX {1}", {"rank": ("hundreds", 1), "scale": 4}),
    ("gpu", r"\bintel\s?arc\s?[ab](\d{3})", "Carte graphique Intel Arc {1}", {"rank": 1, "scale": 4}),
    ("gpu-marque", r"\b(?:rtx|gtx|geforce)\b|\bnvidia\b", "Graphiques NVIDIA", {}),
    ("gpu-marque", r"\bradeon\b", "Graphiques AMD Radeon", {}),
    ("gpu-marque", r"graphiques? integres?|\biris xe\b|\buhd graphics\b", "Graphiques integres", {}),
    ("gpu", r"\b(?:rtx|gtx)\s?(\d{4})", "Carte graphique RTX {1}", {"rank": ("hundreds", 1), "scale": 4}),
    ("cpu", r"\bryzen\s?([3579])\b", "Processeur Ryzen {1}", {"rank": ("odd", 1), "scale": 4}),
    ("cpu", r"\b(?:core\s?)?i([3579])[\s-]", "Processeur Core i{1}", {"rank": ("odd", 1), "scale": 4}),
    ("ram", r"\b(?:ram|memoire)\s*(?:de\s*)?(\d{1,3})\s*(?:go|gb)\b|\b(\d{1,3})\s*(?:go|gb)\s*(?:de\s*)?(?:ram|ddr\d)", "Mémoire vive {1,2} Go", {"metric": (1, 2), "unit": "Go"}),
    ("stockage-type", r"\b(?:ssd|nvme)\b", "Stockage SSD", {"rank": 2, "scale": 2}),
    ("stockage-taille", r"\b(\d)\s*(?:to|tb)\b", "Capacité {1} To", {"metric": (1,), "unit": "To"}),
    ("reduction-bruit", r"suppression (?:active )?du bruit|reduction de bruit|\banc\b", "Réduction de bruit active", {}),
    ("audio-spatial", r"\bdolby atmos\b", "Dolby Atmos", {}),
    ("autonomie", r"\b(\d{1,2})\s*(?:h|heures)\s*(?:d[’']autonomie|de lecture|d[’']ecoute)", "Autonomie {1} h", {"metric": (1,), "unit": "h"}),
    ("sync", r"\bg[- ]?sync\b", "G-Sync", {}),
    ("sync", r"\bfreesync\b", "FreeSync", {}),
    ("wifi", r"\bwi-?fi\s?(6e|6|7)\b", "Wi-Fi {1}", {"rank": ("wifi", 1), "scale": 3}),
    ("bluetooth", r"\bbluetooth\s?(\d[.\d]*)?", "Bluetooth {1}", {"rank": ("bluetooth", 1), "scale": 3}),
    ("hdmi", r"\bhdmi\s?2\.1\b", "HDMI 2.1", {"rank": 2, "scale": 2}),
    ("energie", r"energy ?star", "Energy Star", {}),
    ("capacite", r"\b(\d{1,2}[,.]?\d?)\s*(?:l|litres?)\b", "Capacité {1} L", {"metric": (1,), "unit": "L"}),
    ("capacite", r"\b(\d{1,2}[,.]?\d?)\s*pi[³3](?![a-z0-9])", "Capacité {1} pi³", {"metric": (1,), "unit": "pi3"}),
    ("materiau", r"fonte emaillee?|\bfonte\b", "Fonte", {"rank": 4, "scale": 4, "only": MATERIAL}),
    ("materiau", r"acier inoxydable|\binox\b", "Acier inoxydable", {"rank": 4, "scale": 4, "only": MATERIAL}),
    ("materiau", r"porcelaine|ceramique|\bgres\b|verre trempe", "Porcelaine, ceramique ou verre trempe", {"rank": 3, "scale": 4, "only": MATERIAL}),
    ("materiau", r"\bbambou\b|bois massif|\bacacia\b|\bchene\b|\bnoyer\b", "Bois ou bambou", {"rank": 2, "scale": 4, "only": MATERIAL}),
    ("materiau", r"\baluminium\b", "Aluminium", {"rank": 2, "scale": 4, "only": MATERIAL}),
    ("materiau", r"melamine|polypropylene|\bplastique\b|\bacrylique\b", "Plastique ou melamine", {"rank": 1, "scale": 4, "only": MATERIAL}),
    ("revetement", r"antiadhesi(?:f|ve)|\bteflon\b", "Revetement antiadhesif", {"only": MATERIAL}),
    ("puissance", r"\b(\d{3,4})\s*(?:w|watts?)\b", "Puissance {1} W", {"metric": (1,), "unit": "W"}),
    ("aspiration", r"\b(\d{4,5})\s*pa\b", "Aspiration {1} Pa", {"metric": (1,), "unit": "Pa"}),
    ("bruit", r"\b(\d{2})\s*dba\b|(?:niveau sonore|silencieux|bruit)[^.]{0,25}?(\d{2})\s*db\b", "Niveau sonore {1,2} dB", {"metric": (1, 2), "unit": "dB", "lower": True}),
    ("debit-air", r"\b(\d{3,4})\s*(?:pcm|cfm)\b", "Debit d’air {1} PCM", {"metric": (1,), "unit": "PCM"}),
    ("btu", r"\b(\d{1,3}[ ,]\d{3}|\d{4,6})\s*btu\b", "{1} BTU", {"metric": (1,), "unit": "BTU", "thousands": True}),
    ("essorage", r"\b(\d{3,4})\s*(?:tr/min|rpm)\b", "Essorage {1} tr/min", {"metric": (1,), "unit": "tr/min"}),
    ("filtration", r"\bhepa\b", "Filtre HEPA", {}),
    ("navigation", r"\blidar\b|cartographie (?:laser|intelligente)", "Cartographie laser", {}),
    ("vidange", r"vidange automatique|auto[- ]?vidage|station de vidange", "Station de vidange automatique", {}),
    ("couverts", r"\b(\d{1,2})\s*(?:couverts|places)\b", "{1} couverts", {"metric": (1,), "unit": "couverts"}),
    ("etancheite", r"\bipx?(\d)\b", "Indice d’etancheite IP{1}", {"rank": ("water", 1), "scale": 4}),
    ("garantie", r"garantie (?:limitee )?(?:de )?(\d{1,2})\s*ans?", "Garantie {1} ans", {"metric": (1,), "unit": "ans", "one": "Garantie 1 an"}),
    ("distributeur", r"distributeur d[’']eau et de (?:glace|glacons)|distributeur de glacons et d[’']eau", "Distributeur d’eau et de glaçons", {"rank": 2, "scale": 2, "only": APPLIANCE}),
    ("distributeur", r"distributeur d[’']eau", "Distributeur d’eau", {"rank": 1, "scale": 2, "only": APPLIANCE}),
    ("glacons", r"machine a glacons|fabrique de glacons|fabrique-glacons|distributeur de glacons", "Fabrique de glaçons", {"only": APPLIANCE}),
    ("configuration", r"portes? francaises?|french door|a deux portes", "Portes françaises", {"only": APPLIANCE}),
    ("configuration", r"juxtapose|cote a cote|side[- ]by[- ]side", "Congélateur juxtaposé", {"only": APPLIANCE}),
    ("configuration", r"congelateur (?:en bas|inferieur)", "Congélateur en bas", {"only": APPLIANCE}),
    ("givre", r"sans (?:givre|degivrage)|no[- ]frost|degivrage automatique", "Sans givre", {"only": APPLIANCE}),
    ("cuisson", r"friture a air|air fry|\bairfryer\b", "Cuisson à air chaud", {"only": APPLIANCE}),
    ("convection", r"\bconvection\b", "Cuisson par convection", {"only": APPLIANCE}),
    ("autonettoyant", r"autonettoyant|auto[- ]nettoyage|\bpyrolyse\b", "Autonettoyant", {"only": APPLIANCE}),
    ("plaque", r"\binduction\b", "Plaque à induction", {"rank": 3, "scale": 3, "only": APPLIANCE}),
    ("plaque", r"au gaz\b|\bgaz naturel\b|\bpropane\b", "Cuisson au gaz", {"rank": 2, "scale": 3, "only": APPLIANCE}),
    ("plaque", r"vitroceramique|elements? radiants?", "Plaque vitrocéramique", {"rank": 1, "scale": 3, "only": APPLIANCE}),
    ("chargement", r"chargement frontal|a hublot", "Chargement frontal", {"only": APPLIANCE}),
    ("chargement", r"chargement vertical|chargement par le haut", "Chargement vertical", {"only": APPLIANCE}),
    ("connecte", r"\bwi-?fi integre|application mobile|commandee? par (?:application|telephone)|compatible (?:alexa|google assistant)", "Pilotable à distance", {}),
    ("joueurs", r"(\d)\s*(?:[a-]|–)\s*(\d{1,2})\s*joueurs", "{1} à {2} joueurs", {"metric": (2,), "unit": "joueurs", "only": GAME}),
    ("age-min", r"ages? de (\d{1,2}) ans|(\d{1,2}) ans et plus|\b(\d{1,2})\+\s*ans", "Dès {1,2,3} ans", {"metric": (1, 2, 3), "unit": "ans", "only": GAME}),
    ("duree-partie", r"(\d{2,3})\s*(?:min|minutes)\b", "Partie de {1} min", {"metric": (1,), "unit": "min", "only": GAME}),
    ("contenance", r"\b(\d{2,4})\s*ml\b", "Contenance {1} ml", {"metric": (1,), "unit": "ml", "only": BEAUTY}),
    ("contenance", r"\b(\d{1,2}[,.]\d)\s*oz\b", "Contenance {1} oz", {"metric": (1,), "unit": "ml", "times": 29.57, "only": BEAUTY}),
    ("encre-origine", r"cartouche.{0,30}(?:d[’']origine|originale?|authentique|\boem\b)", "Cartouche d’origine", {"rank": 2, "scale": 2}),
    ("encre-origine", r"\bcompatible\b.{0,40}(?:imprimante|epson|canon|hp|brother|lexmark)|\bremanufactur", "Cartouche compatible", {"rank": 1, "scale": 2}),
    ("rendement", r"(\d{3,5})\s*pages", "Rendement {1} pages", {"metric": (1,), "unit": "pages"}),
    ("moteur", r"sans balais|\bbrushless\b", "Moteur sans balais", {"rank": 2, "scale": 2, "only": TOOL}),
    ("tension", r"\b(\d{2})\s*v\b(?!\w)", "Batterie {1} V", {"metric": (1,), "unit": "V", "only": TOOL}),
]

FAMILIES = list(dict.fromkeys(family for family, *_ in RULES))
# The order of facets on a page; families that aren't in it are extracted but never shown as one.
FAMILY_ORDER = [
    "cpu-marque", "cpu", "ram", "stockage-taille", "stockage-type", "gpu-marque", "gpu", "resolution", "dalle", "diagonale", "rafraichissement", "reponse", "hdr", "courbure",
    "capacite", "configuration", "distributeur", "glacons", "givre", "plaque", "cuisson", "convection", "autonettoyant", "chargement", "connecte",
    "puissance", "aspiration", "bruit", "debit-air", "btu", "essorage", "moteur", "tension", "joueurs", "age-min", "duree-partie", "contenance", "encre-origine", "rendement",
    "couverts", "materiau", "revetement", "filtration", "navigation", "vidange", "autonomie", "garantie", "energie", "etancheite", "reduction-bruit", "audio-spatial", "wifi", "bluetooth", "hdmi", "sync",
]

#: What a family means for the one who buys: its group and a sentence.
EFFECTS = {
    "resolution": ("image", "Plus il y a de points, plus les contours et les petits caractères sont nets."),
    "dalle": ("image", "La technique de l'écran décide de la profondeur des noirs et du contraste."),
    "diagonale": ("image", "La taille visible se mesure d'un coin à l'autre ; elle se choisit selon la distance."),
    "rafraichissement": ("image", "Un écran qui se redessine plus souvent rend les mouvements plus fluides."),
    "reponse": ("image", "Un temps court laisse moins de traînées derrière ce qui bouge."),
    "hdr": ("image", "Les scènes claires et sombres gardent plus de nuances."),
    "courbure": ("image", "Les bords d'un grand écran restent à la même distance des yeux."),
    "encombrement": ("format", "La dimension annoncée sert à vérifier que l'article tient à sa place."),
    "cpu-marque": ("puissance", "La famille du processeur décide des logiciels et de la consommation."),
    "cpu": ("puissance", "Un processeur de gamme plus haute tient mieux plusieurs tâches à la fois."),
    "ram": ("puissance", "Plus de mémoire garde plus de programmes ouverts sans ralentir."),
    "stockage-type": ("puissance", "Un disque sans pièce mobile démarre et ouvre les fichiers bien plus vite."),
    "stockage-taille": ("puissance", "La place pour les fichiers, les photos et les jeux."),
    "gpu-marque": ("puissance", "La marque du circuit graphique décide des pilotes et des fonctions de jeu."),
    "gpu": ("puissance", "Une carte de gamme plus haute affiche des jeux plus détaillés."),
    "sync": ("image", "L'écran suit la cadence de la carte graphique, sans images déchirées."),
    "reduction-bruit": ("son", "Les bruits constants autour de soi sont atténués."),
    "audio-spatial": ("son", "Les sons semblent venir de plusieurs directions."),
    "autonomie": ("usage", "Le temps d'emploi entre deux recharges."),
    "wifi": ("connexion", "Une génération plus récente porte plus loin et partage mieux le débit."),
    "bluetooth": ("connexion", "Une version plus récente consomme moins et coupe plus rarement."),
    "hdmi": ("connexion", "La prise laisse passer les images détaillées à haute cadence."),
    "energie": ("usage", "L'appareil consomme moins que ce que la norme demande."),
    "capacite": ("format", "Le volume utile, à comparer à la taille du ménage."),
    "couverts": ("format", "Le nombre de couverts lavés en une fois."),
    "configuration": ("format", "La disposition des portes décide de l'accès et de la place à prévoir."),
    "distributeur": ("usage", "De l'eau ou de la glace sans ouvrir la porte."),
    "glacons": ("usage", "De la glace se fait sans bac à remplir."),
    "givre": ("usage", "Il n'y a pas de glace à retirer à la main."),
    "plaque": ("usage", "La source de chaleur décide de la rapidité et de la précision de la cuisson."),
    "cuisson": ("usage", "Des aliments croustillants avec peu de matière grasse."),
    "convection": ("usage", "La chaleur est brassée et la cuisson plus égale."),
    "autonettoyant": ("usage", "L'intérieur se nettoie par un cycle."),
    "chargement": ("format", "Le côté par lequel on charge décide de la place et du confort."),
    "connecte": ("connexion", "L'appareil se commande et se surveille à distance."),
    "puissance": ("puissance", "Plus de watts donnent plus de force ou de chaleur, pour plus de courant."),
    "aspiration": ("puissance", "Une aspiration plus forte retire mieux la poussière des tapis."),
    "bruit": ("usage", "Moins de décibels gênent moins ; trois de plus doublent l'énergie du son."),
    "debit-air": ("puissance", "Un débit plus grand renouvelle plus vite l'air d'une pièce."),
    "btu": ("puissance", "La chaleur produite ou retirée en une heure, à accorder à la pièce."),
    "essorage": ("puissance", "Le linge sort plus sec d'un essorage plus rapide."),
    "moteur": ("puissance", "Un moteur sans balais dure plus longtemps et chauffe moins."),
    "tension": ("puissance", "Une batterie de plus haute tension donne plus de couple."),
    "filtration": ("usage", "Les particules les plus fines sont retenues."),
    "navigation": ("usage", "L'appareil connaît la pièce et la parcourt sans oublier de coin."),
    "vidange": ("usage", "Le bac se vide seul dans un sac à changer rarement."),
    "materiau": ("matière", "La matière décide de la durée, du poids et de l'entretien."),
    "revetement": ("matière", "Les aliments n'attachent pas, tant que la surface n'est pas rayée."),
    "etancheite": ("usage", "Le chiffre dit à quelle eau l'appareil résiste."),
    "garantie": ("usage", "La durée pendant laquelle un défaut est pris en charge."),
    "joueurs": ("jeu", "Combien de personnes jouent ensemble au plus."),
    "age-min": ("jeu", "L'âge à partir duquel le jeu convient."),
    "duree-partie": ("jeu", "Le temps à prévoir pour une partie."),
    "contenance": ("format", "La quantité, pour comparer les prix au même volume."),
    "encre-origine": ("usage", "Qui a fait la cartouche décide du prix et de la garantie."),
    "rendement": ("usage", "Le nombre de pages imprimées avant de changer de cartouche."),
}
