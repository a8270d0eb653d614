"""Fixed values of the academic data model.

Every list below is data, not logic: column names, the sentinel, the period calendar, the
attendance bands and the subject vocabulary.  The order of ``TAXONOMY`` is part of its meaning.
"""

# --- fixed values: grade and attendance columns, and the placeholder the source stores ---
METRICS = ("p1", "p2", "p3", "o", "pf", "e1", "e2", "esp", "a1", "a2", "a3", "oa", "pa")
SENTINEL = -10.0
PASSING_GRADE = 6.0
FINAL_SEMESTER = 10

# --- fixed values: period id and name, in calendar order ---
PERIODS = (
    (35, "2017-2018A"), (36, "2017-2018B"), (40, "2017-2018V"),
    (39, "2018-2019A"), (42, "2018-2019B"), (43, "2018-2019V"),
    (41, "2019-2020A"), (46, "2019-2020B"), (47, "2019-2020V"),
    (44, "2020-2021A"), (49, "2020-2021B"), (50, "2020-2021V"),
    (48, "2021-2022A"), (53, "2021-2022B"), (54, "2021-2022V"),
    (51, "2022-2023A"), (52, "2022-2023B"), (56, "2022-2023V"),
    (55, "2023-2024A"), (58, "2023-2024B"), (59, "2023-2024V"),
    (57, "2024-2025A"), (61, "2024-2025B"),
)

# --- fixed values: attendance bands (open lower edge, closed upper edge, label) ---
ATTENDANCE_BANDS = (
    (-1.0, 79.99, "1. Riesgo (<80%)"),
    (79.99, 84.99, "2. Regular (80-84%)"),
    (84.99, 89.99, "3. Bueno (85-89%)"),
    (89.99, 94.99, "4. Muy Bueno (90-94%)"),
    (94.99, 101.0, "5. Excelente (>=95%)"),
)

# --- fixed values: subject areas and their patterns, first match wins ---
TAXONOMY = (
    ("Administración y Gestión",
     "administracion|gestion|direccion|liderazgo|calidad|compras|inventarios|recursos humanos|"
     "mercadotecnia|mercados|ventas|financiera|costos|presupuestos|empresarial"),
    ("Matemáticas y Estadística",
     "calculo|algebra|estadistica|probabilidad|numerico|matematic|vectorial|convexo|funcional|"
     "fourier|analisis"),
    ("Programación y Computación",
     "programacion|algoritmos|computacion|base de datos|compilador|software|"
     "arquitectura de computadoras|sistemas operativos|redes|inteligencia artificial|"
     "informatica|computadora"),
    ("Electrónica y Control",
     "electronica|circuitos|control|potencia|microcontrolador|senal|instrumentacion|"
     "telecomunicacion"),
    ("Ingeniería Mecánica",
     "vibraciones|mecanica|cinematica|dinamica|termofluid|estructuras|mantenimiento|manufactura"),
    ("Materiales y Procesos",
     "materiales|procesos|balance de materia|energia|quimica de alimentos|biotecnologia|"
     "analisis de alimentos|inocuidad"),
    ("Física y Química",
     "fisica|quimica|termodinamica|optica|electromagnetismo|celdas de combustible"),
    ("Humanidades y Comunicación",
     "etica|comunicacion|sociedad|humanidades|desarrollo humano|psicologia|responsabilidad social"),
    ("Economía y Finanzas", "finanzas|economia|mercado|costos|presupuesto|contabilidad"),
    ("Automatización y Robótica", "automatizacion|robotica|automa|plc|sistemas embebidos"),
    ("Diseño y Arquitectura", "dibujo|cimentacion|diseno|arquitectura|maquetas|planos"),
)
OTHER_CATEGORY = "Otra"

# --- fixed values: cell texts a CSV reader in pandas takes as missing ---
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
