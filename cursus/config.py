"""Report parameters.

Every threshold and lookup used by the reports lives in one frozen ``Config``
so that a deployment (or a test) can swap it without touching report code.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# These must equal the canonical definitions of the engagement
# reports for results to agree. Stated plainly, in their natural order.
# ---------------------------------------------------------------------------
TEST_ACCOUNT_PATTERN = "test|@ula.edu.mx|prueba"

BRAND_RULES = (
    ("uane", "UANE"),
    ("ula", "ULA"),
    ("utc", "UTC"),
    ("uteg", "UTEG"),
    ("indo", "INDO"),
)
OTHER_BRAND = "OTRAS"
REPORTED_BRANDS = ("UANE", "UTC", "ULA", "UTEG")

PROGRESS_BANDS = (
    ("Entre 0% y 20%", 10),
    ("Entre 20% y 50%", 35),
    ("Entre 50% y 80%", 65),
    ("Entre 80% y 100%", 90),
)

EFFECTIVE_DIVISOR = 2
LAUNCH_DATE = "2025-11-11"
MIN_CONSUMERS = 40
MIN_TRANSITIONS = 100
MIN_STARTERS = 100
TWENTY_MINUTES = 1.0 / 3.0
DORMANT_HOURS = 1.0
YOY_LAG_DAYS = 364

SEGMENT_ORDER = ("Exploradores", "Constantes", "Intensivos", "Power users")
NOT_ACTIVATED = "No activados"
ACTIVATED = "Activados"

TEACHERS = "Docentes"
STUDENTS = "Alumnos"
NO_LEVEL = "Sin dato"
# "docentes" is an extra key so that normalising twice keeps teachers teachers.
LEVEL_MAP = (
    ("superior", "Superior"),
    ("licenciatura", "Superior"),
    ("licenciatura udg", "Superior"),
    ("mediosuperior", "Medio superior"),
    ("medio superior", "Medio superior"),
    ("mediasuperior", "Medio superior"),
    ("bachillerato udg", "Medio superior"),
    ("mediosuperior,superior", "Docentes"),
    ("docentes", "Docentes"),
)

OTHER_CENTER = "OTROS"
DOMAIN_CENTER = (
    ("edu.utc.mx", "Universidad Tres Culturas"),
    ("doc.utc.mx", "Universidad Tres Culturas"),
    ("utc.mx", "Universidad Tres Culturas"),
    ("alumnos.uvt.edu.mx", "Universidad Tres Culturas"),
    ("my.ula.edu.mx", "Universidad Latinoamericana"),
    ("ula.edu.mx", "Universidad Latinoamericana"),
    ("lottus.com", "Universidad Latinoamericana"),
    ("lottuseducation.com", "Universidad Latinoamericana"),
    ("uane.mx", "Universidad Americana del Noreste"),
    ("uane.edu.mx", "Universidad Americana del Noreste"),
    ("alumnos.uteg.edu.mx", "Centro Universitario UTEG"),
    ("uteg.edu.mx", "Centro Universitario UTEG"),
    ("indo.edu.mx", "Colegio Indoamericano"),
    ("alumnos.emintermedica.mx", "Escuela de Medicina Intermedica"),
    ("doc.emintermedica.mx", "Escuela de Medicina Intermedica"),
)

PATH_TARGETS = (
    "Bases y conceptos clave de la IA",
    "Fundamentos del Análisis de Datos",
    "Principios de data science",
    "Ética: Uso Responsable de Datos",
    "Impacto global de la IA",
    "Fundamentos de Machine Learning",
    "Lenguaje inteligente: cómo la IA está cambiando la comunicación",
    "De la Imagen a la Inteligencia: aplicaciones de la visión artificial",
    "Riesgos y Seguridad en la Inteligencia Artificial",
    "Metodologías ágiles con IA",
    "Gestión de proyectos con IA",
    "Aplicaciones Avanzadas y Ética en el Análisis de Datos Sociales",
    "Aplicaciones de data science",
    "Modelos Avanzados y Aplicaciones Prácticas de Machine Learning",
    "Gobernanza y Regulación de la Inteligencia Artificial",
    "Transformación organizacional y ventaja competitiva con IA",
    "Inteligencia de negocios basada en datos e IA",
    "Aplicaciones de redes neuronales",
)

MONTH_ABBR = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")
MONTH_TOKENS = (
    ("ene", 1), ("jan", 1), ("feb", 2), ("mar", 3), ("abr", 4), ("apr", 4),
    ("may", 5), ("jun", 6), ("jul", 7), ("ago", 8), ("aug", 8), ("sep", 9),
    ("oct", 10), ("nov", 11), ("dic", 12), ("dec", 12),
)
MONTH_NAMES = (
    ("enero", 1), ("febrero", 2), ("marzo", 3), ("abril", 4), ("mayo", 5), ("junio", 6),
    ("julio", 7), ("agosto", 8), ("septiembre", 9), ("octubre", 10), ("noviembre", 11),
    ("diciembre", 12),
)
# Raw export column names (CSV headers) and the canonical names they map to.
USAGE_COLUMNS = (
    ("Usuario", "user_id"),
    ("Nombre de la LE", "course_name"),
    ("ID de la LE", "course_id"),
    ("Tramo porcentaje", "progress_band"),
    ("Horas de aprendizaje", "hours"),
    ("Nº de contenidos consumidos", "contents"),
    ("Plantilla", "template"),
    ("Nivel", "level"),
    ("Certificado", "certified_raw"),
    ("Centro", "center"),
    ("Fecha de creación", "course_created"),
)
# File names of the exports.
USAGE_PATTERN = "consumo_por_usuario__*.csv"
ROSTER_PATTERN = "Listado_de_usuarios*.csv"
HOURS_PATTERN = "Horas_de_aprendizaje_*.csv"
CONTENT_PATTERN = "Consumo_mensual_*.csv"
USERS_PATTERN = "Usuarios_mensuales_*.csv"
DAILY_HOURS_COLUMN = "Horas de aprendizaje (SUM)"
DAILY_CONTENT_COLUMN = "cadenarecurso (DISTINCT_COUNT)"
DAILY_ACTIVE_COLUMN = "Nº Usuarios activos (DISTINCT_COUNT)"
DAILY_EFFECTIVE_COLUMN = "Nº Usuarios efectivos (DISTINCT_COUNT)"
DAILY_EFFECTIVE_RAW_COLUMN = "Nº Usuarios efectivos (RAW)"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    test_pattern: str = TEST_ACCOUNT_PATTERN
    brand_rules: tuple = BRAND_RULES
    other_brand: str = OTHER_BRAND
    reported_brands: tuple = REPORTED_BRANDS
    progress_bands: tuple = PROGRESS_BANDS
    effective_divisor: float = EFFECTIVE_DIVISOR
    launch_date: str = LAUNCH_DATE
    min_consumers: int = MIN_CONSUMERS
    min_transitions: int = MIN_TRANSITIONS
    min_starters: int = MIN_STARTERS
    twenty_minutes: float = TWENTY_MINUTES
    dormant_hours: float = DORMANT_HOURS
    yoy_lag_days: int = YOY_LAG_DAYS
    level_map: tuple = LEVEL_MAP
    domain_center: tuple = DOMAIN_CENTER
    other_center: str = OTHER_CENTER
    path_targets: tuple = PATH_TARGETS
    # "month": period_index = year*12 + month-1; "quarter": year*4 + quarter-1.
    grain: str = "month"
    top_n: int = 5
    teacher_top: int = 15
    # Decimal used for sums of hours: sums don't depend on the order of rows, and
    # 12 decimals keep every real duration (an hour's 1e-12 is 4 nanoseconds).
    sum_type: str = "decimal(38,12)"
    # Exact percentiles by default; approximate ones only when asked for.
    # Quantiles of per-user measures use distributed exact selection (no group
    # in one task); False falls back to Spark's exact ``percentile``.
    distributed_quantiles: bool = True
    approx_quantiles: bool = False
    approx_accuracy: int = 10000
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)


DEFAULT = Config()

# Configuration used with the driver's TPC-H-shaped test tables: invented
# addresses carry the region as domain, periods are quarters.
TEST = Config(
    brand_rules=(("amer", "AMER"), ("asi", "ASIA"), ("euro", "EURO"), ("afri", "AFRI")),
    other_brand="OTHER",
    reported_brands=("AFRI", "EURO", "ASIA", "AMER"),
    launch_date="1996-01-01",
    path_targets=("Cursó Brand#1", "curso brand 7", "No such course"),
    domain_center=(("afri.example", "Centro Afri"), ("amer.example", "Centro Amer"), ("asi.example", "Centro Asi")),
    min_starters=20,
    grain="quarter",
)
