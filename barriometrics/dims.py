"""Constant dimensions.

Fixed values: the names, pairs, ages, labels and thresholds in this file are part of the
data contract; other values would give other results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VALID_NEIGHBORHOODS = (
    "ALMAGRO", "BALVANERA", "BELGRANO", "CABALLITO", "COLEGIALES", "DEVOTO", "FLORES",
    "MONTSERRAT", "NUNEZ", "PALERMO", "PARQUE PATRICIOS", "PUERTO MADERO", "RECOLETA",
    "RETIRO", "SAN NICOLAS", "SAN TELMO", "VILLA CRESPO", "VILLA DEL PARQUE", "VILLA URQUIZA",
)
UNMAPPED = "OTRO"
FUZZY_CUTOFF = 0.6

# Spelling -> reported neighbourhood, used by both mappings.
ALIASES_SHORT = {
    "MONSERRAT": "MONTSERRAT",
    "NUÑEZ": "NUNEZ",
    "CONGRESO": "BALVANERA",
    "BARRIO NORTE": "RECOLETA",
    "TRIBUNALES": "SAN NICOLAS",
    "MICROCENTRO": "SAN NICOLAS",
    "CENTRO / MICROCENTRO": "SAN NICOLAS",
    "BARRACAS": "PARQUE PATRICIOS",
    "CONSTITUCIÓN": "SAN TELMO",
    "POMPEYA": "PARQUE PATRICIOS",
    "MATADEROS": "FLORES",
    "LINIERS": "FLORES",
    "VERSALLES": "VILLA URQUIZA",
    "VILLA SOLDATI": "PARQUE PATRICIOS",
    "VILLA RIACHUELO": "PARQUE PATRICIOS",
    "VILLA LUGANO": "PARQUE PATRICIOS",
}

# Further spellings known to the model-training mapping only.
ALIASES_LONG = {
    **ALIASES_SHORT,
    "LA PATERNAL": "VILLA CRESPO",
    "COGHLAN": "BELGRANO",
    "LAS CAÑITAS": "BELGRANO",
    "VILLA PUEYRREDÓN": "VILLA URQUIZA",
    "BOTÁNICO": "PALERMO",
    "BOEDO": "ALMAGRO",
    "CHACARITA": "VILLA CRESPO",
    "PALERMO HOLLYWOOD": "PALERMO",
    "SAN CRISTOBAL": "BALVANERA",
    "SAAVEDRA": "NUNEZ",
    "AGRONOMÍA": "VILLA DEL PARQUE",
    "BARRIO PARQUE": "PALERMO",
    "ONCE": "BALVANERA",
    "BARRIO CHINO": "BELGRANO",
    "LOMAS DE NÚÑEZ": "NUNEZ",
    "LA BOCA": "SAN TELMO",
    "MONTE CASTRO": "DEVOTO",
    "CID CAMPEADOR": "VILLA CRESPO",
    "BARRIO PARQUE GENERAL BELGRANO": "BELGRANO",
    "PRIMERA JUNTA": "CABALLITO",
    "VELEZ SARSFIELD": "FLORES",
    "PARQUE AVELLANEDA": "FLORES",
    "DISTRITO QUARTIER": "PUERTO MADERO",
    "TEMPERLEY": "FLORES",
    "CATALINAS": "RETIRO",
    "LOS PERALES": "FLORES",
    "NAÓN": "VILLA DEL PARQUE",
    "PATERNAL": "VILLA CRESPO",
    "BOCA": "SAN TELMO",
    "CONSTITUCION": "SAN TELMO",
    "DEPARTAMENTO EN VENTA EN CABALLITO": "CABALLITO",
    "DEPARTAMENTO EN VENTA EN PALERMO": "PALERMO",
    "AGRONOMIA": "VILLA DEL PARQUE",
}

# Typical building age in years by neighbourhood as written in the listing.
TYPICAL_AGE = {
    "Recoleta": 50, "Núñez": 40, "Palermo Hollywood": 30, "Puerto Madero": 20,
    "Centro / Microcentro": 70, "Las Cañitas": 40, "Palermo Soho": 40, "Monte Castro": 50,
    "Almagro Norte": 60, "Tribunales": 80, "San Nicolás": 70, "Monserrat": 80,
    "Belgrano R": 50, "Palermo Nuevo": 30, "Palermo Chico": 40, "Belgrano Chico": 40,
    "Palermo Viejo": 50, "Retiro": 70, "La Paternal": 50, "Caballito Norte": 60,
    "Belgrano C": 50, "Caballito Sur": 60, "Parque Rivadavia": 60, "Villa Pueyrredón": 50,
    "Floresta Sur": 60, "Primera Junta": 60, "Cid Campeador": 60, "Constitución": 80,
    "Botánico": 40, "Lomas de Núñez": 30, "Distrito Quartier": 20, "Temperley": 70,
    "Flores Sur": 60, "Almagro Sur": 60, "Flores Norte": 60, "La Boca": 80,
    "Parque Chas": 50, "Floresta Norte": 60, "Agronomía": 50, "Otro": 50,
    "Puerto Retiro": 70, "Barrio Parque": 40, "Barrio Chino": 30, "Naón": 50,
    "Parque Avellaneda": 60, "Catalinas": 20, "Los Perales": 50, "Villa Riachuelo": 50,
    "Barrio Parque General Belgrano": 50,
}
DEFAULT_AGE = 50

# Report labels.
ROOMS_4_PLUS = "4 o más"
ROOM_CATEGORIES = ("1", "2", "3", ROOMS_4_PLUS)
AREA_CATEGORIES = ("0-30 m²", "30-60 m²", "60-100 m²", ">100 m²")
DEVIATION_LABELS = (
    "<-50%", "-50% a -40%", "-40% a -30%", "-30% a -20%", "-20% a -10%", "-10% a 0%",
    "0% a 10%", "10% a 20%", "20% a 30%", "30% a 40%", "40% a 50%", ">50%",
)
SIZE_BANDS = ("<30", "30-50", "50-80", "80+")

# Amenity tag -> report group.
AMENITY_GROUPS = {
    "theatre": "sitios_interes", "cinema": "sitios_interes", "library": "sitios_interes",
    "community_centre": "sitios_interes", "arts_centre": "sitios_interes",
    "townhall": "edificios_administrativos", "courthouse": "edificios_administrativos",
    "college": "instituciones_educativas", "kindergarten": "instituciones_educativas",
    "school": "instituciones_educativas", "university": "instituciones_educativas",
    "clinic": "centros_salud",
    "restaurant": "restaurantes", "cafe": "restaurantes", "ice_cream": "restaurantes",
    "pub": "restaurantes", "fast_food": "restaurantes", "bar": "restaurantes",
}
PLACE_GROUPS = (
    "transporte", "sitios_interes", "edificios_administrativos",
    "instituciones_educativas", "centros_salud", "restaurantes",
)
UNKNOWN_AMENITY = "Desconocido"
UNNAMED_PLACE = "Sin nombre"
TRANSIT_MARK = "Línea"


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def constant_table(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A literal relation. Its size is known to the planner, so joins to it broadcast on their own."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def valid_neighborhoods(spark: SparkSession) -> DataFrame:
    return constant_table(spark, [(n,) for n in VALID_NEIGHBORHOODS], "neighborhood")


def aliases(spark: SparkSession, long: bool = True) -> DataFrame:
    table = ALIASES_LONG if long else ALIASES_SHORT
    return constant_table(spark, table.items(), "alias, canonical")


def typical_ages(spark: SparkSession) -> DataFrame:
    rows = [(name, float(age)) for name, age in TYPICAL_AGE.items()]
    return constant_table(spark, rows, "raw_neighborhood, typical_age").selectExpr(
        "raw_neighborhood", "CAST(typical_age AS DOUBLE) AS typical_age"
    )
