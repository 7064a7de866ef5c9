"""Fixed values shared by the operators: data only, no logic."""

from __future__ import annotations

# --- fixed values: ordered indicator-name rules (first match wins) ---------
INDICATOR_RULES: tuple[tuple[str, str], ...] = (
    (r"Nombre de consultants(?!.*<)", "Nb Consultants"),
    (r"Nombre de consultants.*< *5", "Nb Consultants <5 ans"),
    (r"Nombre de consultations(?!.*<)", "Nb Consultations"),
    (r"Nombre de consultations.*< *5", "Nb Consultations <5 ans"),
    (r"Accouchement.*établissement", "Accouchements"),
    (r"Naissances vivantes", "Naissances vivantes"),
    (r"TOTAL PALUDISME", "Paludisme"),
    (r"TOTAL IRA", "Infections Respiratoires"),
    (r"TOTAL DIARRHEES", "Diarrhées"),
    (r"clients dépistés TOTAL", "Dépistage Total"),
    (r"Femme.*dépistée VIH", "Femmes VIH+"),
    (r"TOTAL CONSULTATION PF", "Consultations PF"),
    (r"TDR positifs", "TDR Paludisme Positifs"),
    (r"TOTAUX MORBIDITE", "Morbidité Totale"),
    (r"DECES", "Décès"),
    (r"Cas référés", "Référés"),
    (r"Femmes.*vaccinées.*VAT", "Femmes Vaccinées VAT"),
)
KEY_INDICATORS: tuple[str, ...] = tuple(name for _, name in INDICATOR_RULES)

# --- fixed values: full month names that mark a header row -----------------
HEADER_MONTHS: tuple[str, ...] = (
    "JANVIER", "FEVRIER", "FÉVRIER", "MARS", "AVRIL", "MAI", "JUIN", "JUILLET",
    "AOÛT", "AOUT", "SEPTEMBRE", "OCTOBRE", "NOVEMBRE", "DÉCEMBRE", "DECEMBRE",
)

# --- fixed values: accepted spellings of each month ------------------------
MONTH_SPELLINGS: dict[int, tuple[str, ...]] = {
    1: ("JANVIER", "JANV", "JAN", "JANUARY"),
    2: ("FEVRIER", "FÉVRIER", "FEV", "FÉV", "FEB", "FEBRUARY"),
    3: ("MARS", "MAR", "MARCH"),
    4: ("AVRIL", "AVR", "APR", "APRIL"),
    5: ("MAI", "MAY"),
    6: ("JUIN", "JUN", "JUNE"),
    7: ("JUILLET", "JUIL", "JUL", "JULY"),
    8: ("AOUT", "AOÛT", "AOU", "AUG", "AUGUST"),
    9: ("SEPTEMBRE", "SEPTEM", "SEPT", "SEP", "SEPTEMBER"),
    10: ("OCTOBRE", "OCTOB", "OCT", "OCTOBER"),
    11: ("NOVEMBRE", "NOVEM", "NOV", "NOVEMBER"),
    12: ("DECEMBRE", "DÉCEMBRE", "DECEM", "DEC", "DÉCEM", "DECEMBER"),
}

# --- fixed values: words that name the label column of a matrix ------------
LABEL_WORDS: tuple[str, ...] = ("SERVICE", "INDICATEUR")

# --- fixed values: cell texts that spreadsheet readers take for a missing cell
MISSING_CELLS: tuple[str, ...] = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: composite score weights ---------------------------------
HEALTH_WEIGHTS = {"smape": 0.40, "mae": 0.30, "r2": 0.20, "rmse": 0.10}
EQUAL_WEIGHTS = {"smape": 0.25, "mae": 0.25, "r2": 0.25, "rmse": 0.25}

# --- fixed values: quality bands, best first -------------------------------
BANDS_4: tuple[tuple[float, str], ...] = ((0.8, "Excellent"), (0.6, "Bon"), (0.4, "Moyen"))
BANDS_3: tuple[tuple[float, str], ...] = ((0.7, "Excellent"), (0.5, "Bon"))
LOWEST_BAND = "Faible"

# --- fixed values: registration order of the models and ARIMA try-list -----
MODEL_ORDER: tuple[str, ...] = ("Prophet", "RandomForest", "ARIMA")
ARIMA_ORDERS: tuple[tuple[int, int, int], ...] = (
    (1, 1, 1), (0, 1, 1), (2, 1, 1), (1, 1, 0), (0, 1, 0),
)

# --- fixed values: defaults and messages -----------------------------------
DEFAULT_YEAR = 2024
DEFAULT_HORIZON = 12
MIN_HISTORY_ROWS = 12
CONSULTANTS = "Nb Consultants"
CONSULTATIONS = "Nb Consultations"
PRIORITY_DISEASE = "Paludisme"
SHORT_HISTORY_ERROR = "Données historiques insuffisantes (< 12 mois)"
NO_MODEL_ERROR = "Aucun modèle n'a pu être exécuté avec succès."
ARIMA_ERROR = "Tous les ordres ARIMA ont échoué"
EMPTY_FINGERPRINT = "empty_data"
