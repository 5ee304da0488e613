"""Fixed values that must equal the reference's for identical results.

Everything here is a plain constant: label texts, thresholds and band edges
used by the reference's derived columns and classification tables.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (reference semantics; keep text and order exactly as is)
# ---------------------------------------------------------------------------

# Text forms of a true owner-equality flag (case-insensitive).
TRUTHY_TEXT = ("true", "1", "t")
OWNER_EQUAL = "Igual"
OWNER_DIFFERENT = "Diferente"
OWNER_LABELS = (OWNER_DIFFERENT, OWNER_EQUAL)  # display order

# Jaccard index bands on the 0-1 scale, last band closed on the right.
JACCARD_EDGES = (0.0, 0.25, 0.50, 0.85, 1.00)
JACCARD_LABELS = ("0-25%", "25-50%", "50-85%", "85-100%")

# Same bands on the percent scale, right-open bins (pandas cut right=False).
JACCARD_PCT_EDGES = (0.0, 25.0, 50.0, 85.0, 100.1)

# Risk-matrix bands: five right-closed bins, lowest edge included.
RISK_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
RISK_LABELS = ("0-20%", "20-40%", "40-60%", "60-80%", "80-100%")

# Area discrepancy bands (percent), open-ended, right-closed.
DISCREPANCY_EDGES = (float("-inf"), -10.0, -1.0, 1.0, 10.0, float("inf"))
DISCREPANCY_LABELS = (
    "Car < Sigef\n(> -10%)",
    "Car < Sigef\n(-1% a -10%)",
    "Exato\n(± 1%)",
    "Car > Sigef\n(+1% a +10%)",
    "Car > Sigef\n(> +10%)",
)

# Area tolerance classes at +/- 10 percent.
TOLERANCE_LIMIT = 10.0
TOLERANCE_OK = "Preciso"
TOLERANCE_OVER = "Superestimado (CAR > SIGEF)"
TOLERANCE_UNDER = "Subestimado (CAR < SIGEF)"

# Size classes by fiscal modules: <= 4 small, <= 15 medium, else large.
SIZE_SMALL_MAX = 4
SIZE_MEDIUM_MAX = 15
SIZE_LABELS = ("Pequeno", "Médio", "Grande")

# High-similarity threshold and its labels.
HIGH_INDEX = 0.85
GEO_HIGH = ">= 85%"
GEO_LOW = "< 85%"
GEO_LABELS = (GEO_LOW, GEO_HIGH)

# Reliability matrix actions per (owner label, index label).
RELIABILITY_ACTIONS = {
    (OWNER_EQUAL, GEO_HIGH): "MATURIDADE ALTA\n(Monitorar)",
    (OWNER_EQUAL, GEO_LOW): "ERRO TÉCNICO\n(Retificar)",
    (OWNER_DIFFERENT, GEO_HIGH): "RISCO JURÍDICO\n(Auditar)",
    (OWNER_DIFFERENT, GEO_LOW): "CRÍTICO/BAIXA PRIOR.\n(Reestruturar)",
}

# The same cells as the exploratory analysis names them.
ANALYSIS_ACTIONS = {
    (OWNER_EQUAL, GEO_HIGH): "ALTA MATURIDADE\n(Monitorar)",
    (OWNER_EQUAL, GEO_LOW): "DESAFIO ESPACIAL\n(Retificar/Notificar)",
    (OWNER_DIFFERENT, GEO_HIGH): "DESAFIO CADASTRAL\n(Auditar)",
    (OWNER_DIFFERENT, GEO_LOW): "BAIXA MATURIDADE\n(Reestruturar)",
}

# Maturity quadrants (x = % high index, y = % owner equal, split at 50/50).
MATURITY_SPLIT = 50.0
MATURITY_QUADRANTS = {
    "top_right": "ALTA MATURIDADE",
    "top_left": "DESAFIO ESPACIAL",
    "bottom_right": "DESAFIO CADASTRAL",
    "bottom_left": "BAIXA MATURIDADE",
}

# Integration quadrants (x = % of A matched, y = % of B matched, 50/50).
INTEGRATION_QUADRANTS = {
    "top_right": "CONSOLIDADO",
    "top_left": "INFORMALIDADE FUNDIÁRIA",
    "bottom_right": "PASSIVO AMBIENTAL",
    "bottom_left": "DADOS ISOLADOS",
}

# Effect-size magnitude cuts for epsilon squared.
EFFECT_CUTS = (0.01, 0.06, 0.14)
EFFECT_LABELS = ("Desprezível", "Pequeno", "Médio", "Grande")

# Region code -> display name, status code -> display name.
REGION_NAMES = {
    "centro_oeste": "Centro-Oeste",
    "nordeste": "Nordeste",
    "norte": "Norte",
    "sudeste": "Sudeste",
    "sul": "Sul",
}
STATUS_NAMES = {"AT": "Ativo", "PE": "Pendente", "SU": "Suspenso", "CA": "Cancelado"}

# Currency prefix of value labels.
CURRENCY_PREFIX = "R$"

# Minimum-evidence limits and the "rest" label of a top-k roll-up.
MIN_RECORDS = 1
MIN_RECORDS_STATS = 10
TOP_K_PLACES = 20
OTHERS_LABEL = "Outros"

# Discrepancy window of the density / filter views, bubble size range.
DISCREPANCY_MIN = -100.0
DISCREPANCY_MAX = 100.0
BUBBLE_MIN, BUBBLE_MAX = 100.0, 800.0
