"""Study-name cleaning, canopy labels and region rules, held as data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Species that form a surface canopy.
CANOPY_SPECIES = [
    "Ecklonia maxima",
    "Macrocystis pyrifera",
    "Eisenia arborea",
    "Nereocystis luetkeana",
    "All annuals",
    "understory and canopy kelps",
    "Nereocystis sp.",
    "Eualaria Areschoug 1884 fistulosa (Postels & Ruprecht) M.J.Wynne, 2009",
    "Nereocystis Postels & Ruprecht, 1840 sp.",
    "Nereocystis leutkana",
    "Egregia menziesii",
    "Macrocystis.pyrifera",
    "Macrocystis angustifolia",
    "Alaria fistulosa",
    "All brown algae",
    "Macrocystis integrifolia",
]

# Ordered (pattern, replacement) rules for study names of the taxa table.
TAXA_STUDY_RULES = [
    (r"\.", "_"),
    (r"KelpAbundance_", ""),
    (r"NovaScotia", "Nova Scotia"),
    (r"\&", ""),
    (r"et al", "etal"),
    (r" ", "_"),
    (r"__", "_"),
    (r"KelpCover_Temperate_Australia_Laminariales", "KelpCover_Temperate_Australia"),
    (r"Ettinger-Epstein_Kingsford_2008_Austral_Ecol", "Ettinger_etal_2008"),
    (r"SA_Gansbaai_kelp", "SA_Gansbaai_kelp_data"),
    (r"Estes_and_Duggins_1995", "Estes_Duggins_AK"),
    (r"Leinaas_and_Christie_1996", "Leinaas_Christie_1996"),
    (r"en_2006", "en_2"),
]

# Ordered rules for study names of the trend table.
TREND_STUDY_RULES = [
    (r" ", "_"),
    (r"__", "_"),
    (r"(norway_inner_coast_norderhaug)(.*)", "$1"),
    (r"atal", "etal"),
]

# Whole-name recodes of the survey table.
SURVEY_STUDY_RECODE = {
    "Anderson_etal_ 2006": "Anderson_etal_2006",
    "Gagnon_atal_2005": "Gagnon_etal_2004",
    "Gerard_ 1976": "Gerard_1976",
    "Kvitek_etal_ 2001": "Kvitek_etal_2001",
    "norway_inner_coast_norderhaug-Ei": "norway_inner_coast_norderhaug",
    "norway_inner_coast_norderhaug-Gr": "norway_inner_coast_norderhaug",
    "norway_inner_coast_norderhaug-No": "norway_inner_coast_norderhaug",
    "Smith_ 1985": "Smith_1985",
    "South_Africa_Kwaaibaii": "SA_Gansbaai_kelp_data",
    "South_Africa_Pump_House": "SA_Gansbaai_kelp_data",
    "South_Africa_Mauritzbaai": "SA_Gansbaai_kelp_data",
}

# Studies without a taxa row, added by hand (trend, then survey generation).
TREND_MANUAL_STUDIES = {
    "Aus_Marmion": "no canopy",
    "Dayton_etal_1999_Laminaria": "no canopy",
    "Dayton_etal_1999_Pterygophora": "no canopy",
}
SURVEY_MANUAL_STUDIES = {
    **TREND_MANUAL_STUDIES,
    "Trowbridge_etal_2013": "no canopy",
    "Kirihara_etal_2003": "no canopy",
}

# Exact-name and pattern overrides of the trend table.
TREND_EXACT_OVERRIDES = {
    "norway_moy_christie_with_Åsen_2": "no canopy",
    "Trowbridge_etal_2013": "no canopy",
}
TREND_PATTERN_OVERRIDES = {"South_Africa": "canopy"}

# Ordered rewrites that turn draw columns into display names.
PARAMETER_LABEL_RULES = [
    (r"b_", ""),
    (r"_", " "),
    (r" scale", ""),
    (r"temp", "Temperature"),
    (r"waves", "Waves"),
    (r"abs lat", "Latitude"),
    (r"has canopynocanopy", "No Canopy"),
]


@dataclass(frozen=True)
class Box:
    """Open box in degrees; all bounds are strict, None means unbounded."""

    lon_min: float | None
    lon_max: float | None
    lat_min: float | None
    lat_max: float | None
    label: str

    def contains(self, lon: Column, lat: Column) -> Column:
        tests = []
        if self.lon_min is not None:
            tests.append(lon > self.lon_min)
        if self.lon_max is not None:
            tests.append(lon < self.lon_max)
        if self.lat_min is not None:
            tests.append(lat > self.lat_min)
        if self.lat_max is not None:
            tests.append(lat < self.lat_max)
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out


# Regions whose canopy label is known; the boxes do not overlap.
CANOPY_BOXES = [
    Box(100.0, 160.0, -39.3, 50.0, "no canopy"),
    Box(0.0, 40.0, None, 0.0, "canopy"),
    Box(-10.0, 0.0, 40.0, 50.0, "no canopy"),
]


def rewrite(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply regex rules in order, each over the whole text."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def recode(text: Column, mapping: Mapping[str, str]) -> Column:
    """Whole-value recode; other values are unchanged."""
    out = text
    for old, new in mapping.items():
        out = F.when(text == old, new).otherwise(out)
    return out


def override_exact(label: Column, by: Column, mapping: Mapping[str, str]) -> Column:
    for name, value in mapping.items():
        label = F.when(by == name, value).otherwise(label)
    return label


def override_matching(label: Column, by: Column, mapping: Mapping[str, str]) -> Column:
    for pattern, value in mapping.items():
        label = F.when(by.rlike(pattern), value).otherwise(label)
    return label


def override_in_boxes(label: Column, lon: Column, lat: Column, boxes: Iterable[Box] = CANOPY_BOXES) -> Column:
    for box in boxes:
        label = F.when(box.contains(lon, lat), box.label).otherwise(label)
    return label


def study_or_suffix(study: Column, site_name: Column) -> Column:
    """Study, or what follows the last colon of the compound site name."""
    return F.coalesce(study, F.regexp_replace(site_name, "(.*):", ""))


def parameter_label(name: Column) -> Column:
    return rewrite(name, PARAMETER_LABEL_RULES)
