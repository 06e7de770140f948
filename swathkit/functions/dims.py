"""Dimension tables. Codes, names and colours are those of the public nomenclatures and must stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (name of the table) -> (Spark schema, rows)
DIMS: dict[str, tuple[str, list[tuple]]] = {
    "dim_essences": ("code int, classe string, nom_latin string, type string", [
        (0, "Chene decidu", "Quercus robur, Q. petraea, Q. pubescens", "feuillu"),
        (1, "Chene vert", "Quercus ilex", "feuillu"),
        (2, "Hetre", "Fagus sylvatica", "feuillu"),
        (3, "Chataignier", "Castanea sativa", "feuillu"),
        (4, "Robinier", "Robinia pseudoacacia", "feuillu"),
        (5, "Pin maritime", "Pinus pinaster", "resineux"),
        (6, "Pin sylvestre", "Pinus sylvestris", "resineux"),
        (7, "Pin noir", "Pinus nigra", "resineux"),
        (8, "Pin d'Alep", "Pinus halepensis", "resineux"),
        (9, "Sapin", "Abies alba", "resineux"),
        (10, "Epicea", "Picea abies", "resineux"),
        (11, "Meleze", "Larix decidua, L. kaempferi", "resineux"),
        (12, "Douglas", "Pseudotsuga menziesii", "resineux"),
    ]),
    "dim_treesatai": ("code int, classe string, nom_latin string, type string", [
        (0, "Chene", "Quercus spp.", "feuillu"),
        (1, "Hetre", "Fagus sylvatica", "feuillu"),
        (2, "Pin", "Pinus spp.", "resineux"),
        (3, "Epicea", "Picea abies", "resineux"),
        (4, "Douglas/Sapin", "Pseudotsuga menziesii, Abies alba", "resineux"),
        (5, "Meleze", "Larix spp.", "resineux"),
        (6, "Feuillus divers", "Betula, Populus, Alnus, Fraxinus, Acer, etc.", "feuillu"),
    ]),
    "dim_genera": ("idx int, genus string, code int", [
        (0, "Abies", 4), (1, "Acer", 6), (2, "Alnus", 6), (3, "Betula", 6), (4, "Carpinus", 6), (5, "Castanea", 6), (6, "Fagus", 1),
        (7, "Fraxinus", 6), (8, "Larix", 5), (9, "Picea", 3), (10, "Pinus", 2), (11, "Populus", 6), (12, "Prunus", 6), (13, "Pseudotsuga", 4),
        (14, "Quercus", 0), (15, "Robinia", 6), (16, "Salix", 6), (17, "Sorbus", 6), (18, "Taxus", 6), (19, "Tilia", 6),
    ]),
    "dim_ndp0": ("code int, classe string, type string, couleur string", [
        (0, "Chene", "feuillu", "#228B22"),
        (1, "Hetre", "feuillu", "#006400"),
        (2, "Chataignier", "feuillu", "#8B4513"),
        (3, "Pin", "resineux", "#FF8C00"),
        (4, "Epicea/Sapin", "resineux", "#4169E1"),
        (5, "Douglas", "resineux", "#8A2BE2"),
        (6, "Meleze", "resineux", "#FFD700"),
        (7, "Peuplier", "feuillu", "#90EE90"),
        (8, "Feuillus divers", "feuillu", "#32CD32"),
        (9, "Non-foret", "autre", "#D3D3D3"),
    ]),
    "dim_cosia": ("code int, classe string, couleur string", [
        (0, "Non classifie", "#808080"),
        (1, "Batiment", "#db0e9a"),
        (2, "Serre / bache plastique", "#3de6eb"),
        (3, "Piscine", "#ffffff"),
        (4, "Zone impermeable", "#f80c00"),
        (5, "Zone permeable", "#938e7b"),
        (6, "Sol nu", "#a97101"),
        (7, "Eau", "#1553ae"),
        (8, "Neige", "#c4b5d2"),
        (9, "Herbace / pelouse", "#55ff00"),
        (10, "Agricole / culture", "#fff30d"),
        (11, "Terre labouree", "#e4df7c"),
        (12, "Vigne", "#660082"),
        (13, "Feuillu", "#46e483"),
        (14, "Conifere", "#194a26"),
        (15, "Lande / broussaille", "#f3a60d"),
    ]),
    "dim_lpis": ("code int, classe string, couleur string", [
        (1, "Ble tendre", "#ffff00"), (2, "Mais grain / ensilage", "#ff6600"), (3, "Orge", "#d8b56b"), (4, "Autres cereales", "#aa7841"),
        (5, "Colza", "#00ff00"), (6, "Tournesol", "#ffaa00"), (7, "Autres oleagineux", "#7faa00"), (8, "Proteagineux", "#00aa7f"),
        (9, "Plantes a fibres", "#00ffff"), (10, "Semences", "#007fff"), (11, "Gel / jacheres", "#d2691e"), (12, "Fourrage", "#7fff00"),
        (13, "Estives / landes", "#556b2f"), (14, "Prairies permanentes", "#98fb98"), (15, "Prairies temporaires", "#90ee90"), (16, "Vergers", "#ff69b4"),
        (17, "Vignes", "#800080"), (18, "Fruits a coque", "#a0522d"), (19, "Oliviers", "#808000"), (20, "Autres cultures", "#ffa07a"),
        (21, "Legumes / fleurs", "#ff1493"), (22, "Canne a sucre", "#00ced1"), (23, "Divers", "#c0c0c0"),
    ]),
    "dim_models": ("id string, architecture string, encoder string, decoder string, n_bands int, supervision string, miou double", [
        ("IGNF/FLAIR-INC_rgbi_15cl_resnet34-unet", "ResNet34-UNet", "resnet34", "unet", 4, "cosia_15cl", 55.0),
        ("IGNF/FLAIR-INC_rgbie_15cl_resnet34-unet", "ResNet34-UNet", "resnet34", "unet", 5, "cosia_15cl", 56.0),
        ("IGNF/FLAIR-HUB_LC-A_IR_convnextv2tiny-upernet", "ConvNeXTV2-UPerNet", "convnextv2_tiny", "upernet", 4, "cosia_19cl", 64.1),
    ]),
    "dim_s2_bands": ("band string, name string, wavelength int, resolution int", [
        ("B02", "Blue", 490, 10), ("B03", "Green", 560, 10), ("B04", "Red", 665, 10), ("B05", "RedEdge1", 705, 20), ("B06", "RedEdge2", 740, 20),
        ("B07", "RedEdge3", 783, 20), ("B08", "NIR", 842, 10), ("B8A", "NIR2", 865, 20), ("B11", "SWIR1", 1610, 20), ("B12", "SWIR2", 2190, 20),
    ]),
    "dim_modality_suffix": ("modality string, suffix string", [
        ("aerial", "AERIAL_RGBI"), ("dem", "DEM_ELEV"), ("s2", "SENTINEL2_TS"), ("s1_asc", "SENTINEL1-ASC_TS"), ("s1_des", "SENTINEL1-DESC_TS"),
        ("spot", "SPOT_RGBI"), ("labels_cosia", "AERIAL_LABEL-COSIA"), ("labels_lpis", "ALL_LABEL-LPIS"),
    ]),
    "dim_domains": ("level string, domain string", [
        ("minimal", "D033-2018"), ("minimal", "D063-2019"), ("minimal", "D068-2021"), ("minimal", "D024047-2021"), ("minimal", "D077-2021"),
        ("standard", "D040-2021"), ("standard", "D025039-2020"), ("standard", "D058-2020"), ("standard", "D005-2018"), ("standard", "D045-2020"),
        ("complet", "D046-2019"), ("complet", "D038-2021"), ("complet", "D015-2020"), ("complet", "D054057-2018"), ("complet", "D073-2022"),
        ("complet", "D012-2019"), ("complet", "D067-2021"), ("complet", "D081-2020"), ("complet", "D007-2020"), ("complet", "D064-2021"),
    ]),
    "modality_specs": ("modality string, in_channels int, image_size int, resolution double, patch_size_mae int, window_m double", [
        ("aerial", 4, 256, 0.2, 16, 51.2), ("dem", 2, 256, 0.2, 32, 51.2), ("s2", 10, 6, 10.0, 2, 60.0), ("s1_asc", 2, 6, 10.0, 2, 60.0), ("s1_des", 2, 6, 10.0, 2, 60.0),
    ]),
}
#: The same without the unclassified code.
DIMS["dim_cosia15"] = (DIMS["dim_cosia"][0], DIMS["dim_cosia"][1][1:])

BROADLEAF, CONIFER, NON_FOREST = (0, 1, 2, 7, 8), (3, 4, 5, 6), 9
# Forest-type prefixes of each class; every other code is class 9.
TFV_PREFIXES: dict[int, tuple[str, ...]] = {
    0: ("FF1G01", "FF1G06"), 1: ("FF1-09",), 2: ("FF1-10",), 3: ("FF2-51", "FF2-52", "FF2-53", "FF2-57", "FF2G58", "FF2-80", "FF2-81"),
    4: ("FF2G61",), 5: ("FF2-64",), 6: ("FF2-63",), 7: ("FP",), 8: ("FF1-14", "FF1-49", "FF1-00", "FF31", "FF32", "FF2-91", "FF2-00", "FF2-90"),
}
# Land-cover codes of the nineteen model outputs, in their order.
LANDCOVER_LUT = (1, 5, 4, 6, 7, 14, 13, 15, 12, 9, 10, 11, 3, 8, 0, 0, 0, 2, 0)
# Means and deviations of the five input channels.
ZSCORE_MEAN = (105.08, 110.87, 101.82, 106.38, 53.26)
ZSCORE_STD = (52.17, 45.38, 44.0, 39.69, 79.3)
# Months of the seasons.
SEASONS = {"ete": (6, 9), "printemps": (3, 5), "automne": (9, 11), "annee": (1, 12)}
# Grouped class of the first fifteen genera.
GENUS_GROUPS = {"Quercus": 0, "Fagus": 1, "Acer": 2, "Alnus": 2, "Betula": 2, "Fraxinus": 2, "Populus": 2, "Prunus": 2, "Tilia": 2, "Pinus": 3, "Picea": 4, "Abies": 4, "Pseudotsuga": 5, "Larix": 6, "Cleared": 7}


def dim(spark: SparkSession, name: str) -> DataFrame:
    """A dimension table as a DataFrame; all have a fixed number of rows, under 30."""
    schema, rows = DIMS[name]
    return spark.createDataFrame(rows, schema)


def dim_sql(name: str) -> str:
    """The same as a SELECT over literal rows."""
    schema, rows = DIMS[name]
    columns = [c.strip().split(" ") for c in schema.split(",")]
    kinds = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    literal = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'{n}::{kinds[k]} AS {n}' for n, k in columns)} FROM (VALUES {values}) t({', '.join(n for n, _ in columns)})"
