"""Texts and limits that results must carry exactly as written."""

# Directory-name tokens pruned by a scan (substring match, case-sensitive).
EXCLUDED_DIRS = ["AppData", "Program Files", "Windows", ".git", "__pycache__", "node_modules", ".venv"]

# Size classes and their decimal limits in bytes.
SMALL, MEDIUM, LARGE = "Petit", "Moyen", "Grand"
MEDIUM_FROM = 1_000_000
LARGE_FROM = 100_000_000

# Status texts.
UNIQUE, ORIGINAL, COPY_PREFIX = "Unique", "Original", "Doublon #"
ISOLATED, CLUSTER_PREFIX = "Isolé", "Cluster #"

# Duplicate types, group-key prefixes, the facet value for "no filter".
EXACT, NEAR = "Exact", "Quasi"
EXACT_KEY, NEAR_KEY = "EXACT_", "QUASI_"
ANY_TYPE = "Tous"

# Path segment that is missing.
UNKNOWN = "Inconnu"

# The seven indicators, in report order.
KPI_FILES = "Nombre total de fichiers dupliqués"
KPI_GROUPS = "Nombre de groupes de duplication distincts"
KPI_EXACT = "Doublons exacts"
KPI_NEAR = "Quasi-doublons"
KPI_SPACE = "Espace total gaspillé (MB)"
KPI_DEPOTS = "Nombre de dépôts impactés"
KPI_UNITS = "Nombre d'unités métier impactées"
KPI_NAMES = [KPI_FILES, KPI_GROUPS, KPI_EXACT, KPI_NEAR, KPI_SPACE, KPI_DEPOTS, KPI_UNITS]

# Texts by language.
ALL_DATA = {"fr": "Toutes les données", "en": "All data"}
DEPOT_FILTER = {"fr": "Dépôt: ", "en": "Repository: "}
UNIT_FILTER = {"fr": "Unité: ", "en": "Unit: "}
TYPE_FILTER = {"fr": "Type: ", "en": "Type: "}
FILTER_SEPARATOR = " · "
TYPE_LEGEND = {"fr": {"Exact": "Exact", "Quasi": "Quasi"}, "en": {"Exact": "Exact", "Quasi": "Near"}}
CARD_LABELS = {
    "fr": ["Fichiers dupliqués", "Groupes distincts", "Espace gaspillé", "Dépôts impactés", "Unités métier"],
    "en": ["Duplicated files", "Distinct groups", "Wasted space", "Impacted repositories", "Business units"],
}
NO_SCORE = "—"

# Why a scan or an upload did not take something; these texts are this library's own.
VANISHED = "vanished or unreadable"
LINKED_DIR = "linked directory"
UNLISTED_DIR = "directory not listed to its end"
EXCLUDED = "excluded directory"
UNREAD = "content not readable"
NO_NAME = "no name"
NO_DATA = "no data"
NOT_DECODABLE = "not decodable"
REPLACED = "replaced by a later upload"

# Listing limits.
PAGE_ROWS = 500
HOTSPOTS_KEPT = 20
UNITS_SHOWN = 10
EXTENSIONS_SHOWN = 8

# Clustering defaults.
EPS = 1.5
MIN_SAMPLES = 2
