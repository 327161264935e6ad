"""Adapters that give the generic star-schema test tables the shape of clinical base tables.

Two families, both pure functions of the given tables so their size grows with them:

* stay fixture, from `events`: one stay per user; every event becomes one panel of charted items, labs,
  outputs, infusions, procedures, cultures or orders (eight times compressed in time, so that first-day
  and six-hour windows hold data);
* admission fixture, from `orders`, `lineitem`, `part`: laboratory rows, diagnoses and prescriptions.

`FIXTURE_SQL` states the same views as SQL text for the comparison engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import HOUR, from_micros, micros, trunc_to

EPOCH = "2024-01-01 00:00:00"
EPOCH_US = 1704067200000000
SLOTS = 5

# (slot, table, itemid, low, high, texts, keep): a row is dropped when its mix number is a multiple of `keep`.
DEVICES = ("Nasal cannula", "Endotracheal tube", "High flow nasal cannula", "None", "Bipap mask ", "Trach mask ",
           "CPAP mask ", "Endotracheal tube", "Face tent")
PANEL: list[tuple[int, str, int, float, float, tuple[str, ...], int]] = [
    # charted vital signs and coma scale
    (0, "chart", 220045, 30, 170, (), 0), (0, "chart", 220050, 50, 230, (), 3), (0, "chart", 220179, 50, 230, (), 2),
    (0, "chart", 225309, 50, 230, (), 4), (0, "chart", 220051, 20, 120, (), 3), (0, "chart", 220180, 20, 120, (), 2),
    (0, "chart", 225310, 20, 120, (), 5), (0, "chart", 220052, 15, 165, (), 0), (0, "chart", 220181, 15, 165, (), 2),
    (0, "chart", 225312, 15, 165, (), 4), (0, "chart", 220210, 3, 75, (), 0), (0, "chart", 224690, 4, 60, (), 3),
    (0, "chart", 223761, 65, 110, (), 2), (0, "chart", 223762, 30, 43, (), 2),
    (0, "chart", 224642, 0, 0, ("Oral", "Axillary", "Blood"), 2), (0, "chart", 220277, 70, 105, (), 0),
    (0, "chart", 225664, 20, 420, (), 3), (0, "chart", 220621, 20, 420, (), 2), (0, "chart", 226537, 0, 420, (), 4),
    (0, "chart", 223900, 1, 5, ("Confused", "No Response-ETT", "Oriented", "No Response"), 3),
    (0, "chart", 223901, 1, 6, (), 4), (0, "chart", 220739, 1, 4, (), 5),
    (0, "chart", 220765, -5, 110, (), 3), (0, "chart", 227989, -5, 110, (), 2),
    # ventilator, oxygen, body size
    (1, "chart", 224688, 5, 30, (), 2), (1, "chart", 224689, 5, 30, (), 2), (1, "chart", 224690, 4, 60, (), 2),
    (1, "chart", 224687, 2, 20, (), 3), (1, "chart", 224685, 200, 800, (), 3), (1, "chart", 224684, 200, 800, (), 2),
    (1, "chart", 224686, 200, 800, (), 4), (1, "chart", 224696, 5, 40, (), 3), (1, "chart", 220339, -10, 120, (), 2),
    (1, "chart", 224700, -10, 120, (), 3), (1, "chart", 223835, 0, 110, (), 3), (1, "chart", 223835, 0.1, 1.1, (), 2),
    (1, "chart", 223849, 0, 0, ("CMV/ASSIST/AutoFlow", "CPAP/PSV", "Standby", "PSV/SBT"), 3),
    (1, "chart", 229314, 0, 0, ("APV (cmv)", "NIV", "SPONT", "ASV"), 2),
    (1, "chart", 223848, 0, 0, ("Drager", "Hamilton"), 2), (1, "chart", 224691, 1, 80, (), 3),
    (1, "chart", 223834, 0, 70, (), 2), (1, "chart", 227582, 0, 70, (), 3), (1, "chart", 227287, 0, 30, (), 3),
    (1, "chart", 226732, 0, 0, DEVICES, 0), (1, "chart", 226732, 0, 0, ("Nasal cannula", "T-piece", "Aerosol-cool"), 3),
    (1, "chart", 224639, 40, 140, (), 2), (1, "chart", 226512, -5, 140, (), 3),
    (1, "chart", 226707, 40, 95, (), 2), (1, "chart", 226730, 100, 240, (), 3),
    # blood gas specimen
    (2, "lab", 52033, 0, 0, ("ART.", "ART.", "VEN."), 0), (2, "lab", 50801, 50, 650, (), 3), (2, "lab", 50802, -15, 15, (), 0),
    (2, "lab", 50803, 8, 40, (), 0), (2, "lab", 50804, 8, 45, (), 0), (2, "lab", 50805, 0, 5, (), 2),
    (2, "lab", 50806, 85, 130, (), 0), (2, "lab", 50808, 0.7, 1.5, (), 0), (2, "lab", 50809, 20, 420, (), 0),
    (2, "lab", 50810, 15, 110, (), 0), (2, "lab", 50811, 4, 19, (), 0), (2, "lab", 50813, 0.3, 18, (), 0),
    (2, "lab", 50814, 0, 3, (), 2), (2, "lab", 50816, 0, 110, (), 2), (2, "lab", 50817, 40, 105, (), 0),
    (2, "lab", 50818, 15, 90, (), 0), (2, "lab", 50820, 6.9, 7.7, (), 0), (2, "lab", 50821, 35, 450, (), 7),
    (2, "lab", 50822, 2, 7.5, (), 0), (2, "lab", 50824, 115, 165, (), 0), (2, "lab", 50825, 33, 41, (), 0),
    # chemistry, counts, coagulation, enzymes
    (3, "lab", 50862, 1, 12, (), 0), (3, "lab", 50930, 1, 12, (), 2), (3, "lab", 50976, 3, 22, (), 2),
    (3, "lab", 50868, -4, 35, (), 0), (3, "lab", 50882, 8, 40, (), 0), (3, "lab", 51006, 3, 120, (), 0),
    (3, "lab", 50893, 5, 13, (), 0), (3, "lab", 50902, 85, 125, (), 0), (3, "lab", 50912, 0.2, 6.5, (), 0),
    (3, "lab", 50931, 20, 420, (), 0), (3, "lab", 50983, 115, 165, (), 0), (3, "lab", 50971, 2, 7.5, (), 0),
    (3, "lab", 51221, 15, 60, (), 0), (3, "lab", 51222, 4, 19, (), 0), (3, "lab", 51248, 20, 40, (), 2),
    (3, "lab", 51249, 28, 38, (), 2), (3, "lab", 51250, 70, 110, (), 2), (3, "lab", 51265, 5, 420, (), 0),
    (3, "lab", 51279, 2, 6, (), 2), (3, "lab", 51277, 11, 22, (), 2), (3, "lab", 52159, 35, 70, (), 2),
    (3, "lab", 51301, 0.2, 38, (), 0), (3, "lab", 51300, 0.2, 38, (), 4), (3, "lab", 52069, 0, 1, (), 2),
    (3, "lab", 51199, 0, 900, (), 3), (3, "lab", 52073, 0, 1, (), 4), (3, "lab", 51133, 0, 5, (), 3),
    (3, "lab", 52769, 0, 5000, (), 2), (3, "lab", 51253, 0, 900, (), 3), (3, "lab", 52074, 0, 1, (), 2),
    (3, "lab", 52075, 0, 25, (), 3), (3, "lab", 51218, 0, 9000, (), 2), (3, "lab", 51146, 0, 4, (), 0),
    (3, "lab", 51200, 0, 12, (), 0), (3, "lab", 51244, 0, 60, (), 0), (3, "lab", 51254, 0, 15, (), 0),
    (3, "lab", 51256, 20, 95, (), 0), (3, "lab", 51143, 0, 5, (), 2), (3, "lab", 51144, 0, 20, (), 2),
    (3, "lab", 52135, 0, 5, (), 2), (3, "lab", 51251, 0, 5, (), 3), (3, "lab", 51257, 0, 5, (), 3),
    (3, "lab", 51196, 100, 9000, (), 2), (3, "lab", 51214, 80, 700, (), 2), (3, "lab", 51297, 10, 30, (), 3),
    (3, "lab", 51237, 0.7, 6, (), 0), (3, "lab", 51274, 2, 60, (), 0), (3, "lab", 51275, 20, 120, (), 0),
    (3, "lab", 50861, 0, 900, (), 0), (3, "lab", 50863, 20, 500, (), 0), (3, "lab", 50878, 5, 900, (), 0),
    (3, "lab", 50867, 10, 300, (), 2), (3, "lab", 50885, 0.1, 16, (), 0), (3, "lab", 50883, 0, 8, (), 2),
    (3, "lab", 50884, 0, 8, (), 2), (3, "lab", 50910, 20, 2000, (), 2), (3, "lab", 50911, 0, 80, (), 2),
    (3, "lab", 50927, 5, 400, (), 3), (3, "lab", 50954, 100, 900, (), 2), (3, "lab", 50889, 0, 250, (), 2),
    (3, "lab", 51003, 0, 5, (), 2), (3, "lab", 50963, 50, 30000, (), 2),
    # outputs, infusions, procedures, dialysis and rhythm charting
    (4, "output", 226559, 0, 900, (), 3), (4, "output", 226560, 0, 600, (), 2), (4, "output", 227488, -50, 300, (), 4),
    (4, "output", 227489, 0, 500, (), 3), (4, "output", 226571, 0, 300, (), 2),
    (4, "input", 221906, 0, 0.5, (), 3), (4, "input", 221289, 0, 0.3, (), 2), (4, "input", 221662, 0, 25, (), 4),
    (4, "input", 221653, 0, 20, (), 3), (4, "input", 221749, 0, 300, (), 2), (4, "input", 222315, 0, 4, (), 3),
    (4, "input", 221986, 0, 1, (), 2), (4, "input", 222062, 0, 12, (), 5), (4, "input", 221555, 0, 12, (), 6),
    (4, "input", 227536, -5, 90, (), 3), (4, "input", 227525, -5, 90, (), 4),
    (4, "proc", 225752, 0, 60, ("Left Radial", "Right Radial", "Left Brachial."), 3),
    (4, "proc", 224263, 0, 60, ("Right Antecub", "Left Femoral.", "RIJ"), 2),
    (4, "proc", 224264, 0, 60, ("Left Axilla.", "Right Antecube"), 4), (4, "proc", 225204, 0, 60, ("LIJ",), 3),
    (4, "proc", 225441, 0, 60, ("HD",), 5), (4, "proc", 225802, 0, 60, ("CRRT",), 4),
    (4, "proc", 224270, 0, 60, ("Right Femoral.",), 3), (4, "proc", 225436, 0, 60, ("Filter",), 4),
    (4, "chart", 227290, 0, 0, ("CVVHDF", "CVVHD", "SCUF"), 4), (4, "chart", 224149, -100, 50, (), 3),
    (4, "chart", 224144, 50, 300, (), 2), (4, "chart", 228004, 0, 400, (), 3), (4, "chart", 225183, -300, 300, (), 4),
    (4, "chart", 225977, 0, 0, ("Prismasate K0", "Prismasate K4"), 3), (4, "chart", 224154, 0, 2500, (), 2),
    (4, "chart", 224151, -50, 200, (), 3), (4, "chart", 224150, 0, 300, (), 2),
    (4, "chart", 225958, 0, 0, ("10", "1000"), 4), (4, "chart", 224145, 0, 2000, (), 3),
    (4, "chart", 224191, 0, 400, (), 2), (4, "chart", 228005, 0, 2500, (), 3), (4, "chart", 228006, 0, 2500, (), 4),
    (4, "chart", 225976, 0, 0, ("Prismasate K2",), 3), (4, "chart", 224153, 0, 2500, (), 2),
    (4, "chart", 224152, 0, 200, (), 3), (4, "chart", 226457, 0, 900, (), 2),
    (4, "chart", 224146, 0, 0, ("Active", "Clots Present", "Clotted", "Discontinued", "No Clot Present", "Clots Increasing"), 0),
    (4, "chart", 226499, 0, 3000, (), 6), (4, "chart", 225810, 0, 60, (), 7),
    (4, "chart", 225965, 0, 0, ("In use", "Capped"), 5), (4, "chart", 227638, 0, 0, ("Heparin",), 7),
    (4, "chart", 220048, 0, 0, ("SR (Sinus Rhythm)", "AF (Atrial Fibrillation)", "ST (Sinus Tachycardia)"), 0),
    (4, "chart", 224650, 0, 0, ("PVC's", "PAC's", "None"), 2), (4, "chart", 224651, 0, 0, ("Rare", "Frequent"), 3),
    (4, "chart", 226479, 0, 0, ("PAC's",), 4), (4, "chart", 226480, 0, 0, ("Occasional",), 4),
]
DRUGS = ("Vancomycin", "CefePIME", "CeftriaXONE", "Aspirin EC", "Lisinopril", "Losartan Potassium", "Ibuprofen",
         "Heparin", "Erythromycin Cream", "Piperacillin-Tazobactam", "Captopril", "Naproxen", "Valsartan",
         "Ciprofloxacin HCl", "Metronidazole (FLagyl)", "Insulin")
ROUTES = ("IV", "PO", "TP", "PO/NG", "BOTH EARS", "IV DRIP")
SPECIMENS = ("BLOOD CULTURE", "URINE", "SPUTUM", "MRSA SCREEN")
ORGANISMS = ("ESCHERICHIA COLI", "STAPH AUREUS COAG +", "NEGATIVE", "CANCELLED", "YEAST", "")
COMMENTS = ("POSITIVE FOR MRSA", "NEGATIVE BY EIA", "Positive for growth", "No growth", "negative.")
SERVICES = ("MED", "CSURG", "ORTHO", "NSURG", "CMED", "TRAUM")
ADMISSION_TYPES = ("ELECTIVE", "EW EMER.", "SURGICAL SAME DAY ADMISSION")
CODES = (("4280", 9), ("I50", 10), ("41071", 9), ("I252", 10), ("44024", 9), ("I739", 10), ("43491", 9), ("I639", 10),
         ("2900", 9), ("F03", 10), ("49121", 9), ("J449", 10), ("7140", 9), ("M059", 10), ("53100", 9), ("K259", 10),
         ("5715", 9), ("K7460", 10), ("25000", 9), ("E119", 10), ("25040", 9), ("E1122", 10), ("34200", 9), ("G8190", 10),
         ("5859", 9), ("N186", 10), ("1629", 9), ("C3490", 10), ("5722", 9), ("K7290", 10), ("1970", 9), ("C787", 10),
         ("042", 9), ("B20", 10), ("20280", 9), ("C8510", 10), ("4019", 9), ("I10", 10), ("5856", 9), ("N184", 10))


def _literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"double({v})"
    if isinstance(v, (tuple, list)):
        return "cast(array(" + ", ".join(_literal(x) for x in v) + ") AS array<string>)"
    return str(v)


def inline(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A constant table; its size is known to the optimizer, so it is broadcast because it is small."""
    cols = [c.strip().split(" ") for c in schema.split(", ")]
    values = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(cols))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(f'c{i}' for i in range(len(cols)))})")


def _panel(spark: SparkSession) -> DataFrame:
    rows = [(i, s, t, it, float(lo), float(hi), tx, kp) for i, (s, t, it, lo, hi, tx, kp) in enumerate(PANEL)]
    return inline(spark, rows, "pid int, slot int, tbl string, itemid bigint, lo double, hi double, texts array<string>, keep int")


def _pick(words, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (number % len(words) + 1).cast("int"))


class StayFixture:
    """Clinical base tables from the `events` table of one data folder."""

    NAMES = ("patients", "admissions", "icustays", "chartevents", "labevents", "outputevents", "inputevents",
             "procedureevents", "microbiologyevents", "prescriptions", "diagnoses_icd", "services", "d_items",
             "d_labitems", "transfers", "datetimeevents", "ingredientevents", "d_icd_diagnoses", "customevents",
             "d_customevents", "infection_type", "discharge", "triage")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._keep: Callable[..., DataFrame] | None = None
        self._kept: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return self._once(name) if name in ("icustays", "admissions", "patients") else getattr(self, name)()

    def keep_with(self, keep: Callable[..., DataFrame]) -> "StayFixture":
        """From now on the parsed events and the tables of stays, which most tables rest on, are written once by `keep` and read back."""
        self._keep = keep
        return self

    def _once(self, name: str) -> DataFrame:
        if self._keep is None:
            return getattr(self, name)()
        if name not in self._kept:
            self._kept[name] = self._keep(f"fixture_{name}", getattr(self, name)())
        return self._kept[name]

    def _parsed(self) -> DataFrame:
        """The events, parsed once where they are kept."""
        if self._keep is None:
            return self._events()
        if "events" not in self._kept:
            # as many files as keep all cores busy, whatever the row groups of the source
            files = 4 * self.spark.sparkContext.defaultParallelism
            self._kept["events"] = self._keep("fixture_events", self._events().repartition(files, "event_id"), by=("slot",))
        return self._kept["events"]

    def _in_slots(self, *slots: int) -> DataFrame:
        """Events of these slots only, told before their properties are parsed; stored ones lie in a folder a slot."""
        return self._parsed().filter(F.col("slot").isin(list(slots)))

    def _events(self) -> DataFrame:
        ev = self.spark.read.parquet(f"{self.folder}/events.parquet")
        secs = F.floor((micros("ts") - F.lit(EPOCH_US)) / F.lit(8_000_000)).cast("long")
        u = F.col("user_id")
        return ev.select(
            "event_id", u.alias("stay_id"), F.floor(u / 2).cast("long").alias("hadm_id"), F.floor(u / 4).cast("long").alias("subject_id"),
            from_micros(F.lit(EPOCH_US) + secs * 1_000_000).alias("t"),
            F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_id") % SLOTS).cast("int").alias("slot"), "value")

    def _panel_rows(self, tbl: str) -> DataFrame:
        slots = sorted({slot for slot, table, *_ in PANEL if table == tbl})
        d = self._in_slots(*slots).join(_panel(self.spark).filter(F.col("tbl") == tbl), "slot")
        mix = (F.col("event_id") * 7919 + F.col("pid") * 104729 + F.col("k") * 31) % 101
        d = d.withColumn("m", mix).filter((F.col("keep") == 0) | (F.col("m") % F.when(F.col("keep") == 0, 1).otherwise(F.col("keep")) != 0))
        has_text = F.size("texts") > 0
        num = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("m") / F.lit(100.0)
        text = F.element_at("texts", (F.col("m") % F.greatest(F.size("texts"), F.lit(1)) + 1).cast("int"))
        odd = F.col("itemid").isin(223900, 223901, 220739)
        return d.withColumn("num", F.when(odd, F.floor(num)).when(~has_text & (F.col("m") != 3), num)) \
                .withColumn("txt", F.when(has_text, text).otherwise(F.col("m").cast("string")))

    def icustays(self) -> DataFrame:
        g = self._events().groupBy("subject_id", "hadm_id", "stay_id").agg(F.min("t").alias("intime"), F.max("t").alias("outtime"))
        los = (micros("outtime") - micros("intime")) / F.lit(86400000000.0)
        return g.withColumn("los", los)

    def admissions(self) -> DataFrame:
        g = self._once("icustays").groupBy("subject_id", "hadm_id").agg(F.min("intime").alias("i"), F.max("outtime").alias("o"))
        h = F.col("hadm_id")
        day = F.make_dt_interval(F.lit(1))
        disch = F.col("o") + day
        dead = h % 7 == 0
        return g.select(
            "subject_id", "hadm_id", (F.col("i") - F.make_dt_interval(F.lit(0), (h % 30).cast("int"))).alias("admittime"),
            disch.alias("dischtime"), F.when(dead, disch).alias("deathtime"), _pick(ADMISSION_TYPES, h).alias("admission_type"),
            F.when(dead, "DEAD/EXPIRED").otherwise("HOME").alias("discharge_location"), F.lit("UNKNOWN").alias("race"),
            F.when(h % 4 != 0, F.col("i") - day).alias("edregtime"), dead.cast("int").alias("hospital_expire_flag"))

    def patients(self) -> DataFrame:
        g = self._once("icustays").groupBy("subject_id").agg(F.max("outtime").alias("o"))
        s = F.col("subject_id")
        return g.select("subject_id", F.when(s % 2 == 0, "F").otherwise("M").alias("gender"),
                        (F.lit(20) + (s * 7) % 75).cast("int").alias("anchor_age"), F.lit(2023).alias("anchor_year"),
                        F.when(s % 5 == 0, (F.col("o") + F.make_dt_interval(F.lit(20))).cast("date"))
                        .when(s % 5 == 1, F.col("o").cast("date")).alias("dod"))

    def chartevents(self) -> DataFrame:
        return self._panel_rows("chart").select(
            "subject_id", "hadm_id", "stay_id", "itemid", F.col("t").alias("charttime"),
            (F.col("t") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("pid"))).alias("storetime"),
            F.col("txt").alias("value"), F.col("num").alias("valuenum"), _pick(("mmHg", "None", "%"), F.col("itemid")).alias("valueuom"))

    def labevents(self) -> DataFrame:
        return self._panel_rows("lab").select(
            (F.col("event_id") * 1000 + F.col("pid")).alias("labevent_id"), "subject_id",
            F.when(F.col("k") % 10 != 0, F.col("hadm_id")).alias("hadm_id"), F.col("event_id").alias("specimen_id"), "itemid",
            F.col("t").alias("charttime"), F.col("t").alias("storetime"), F.col("txt").alias("value"), F.col("num").alias("valuenum"),
            F.lit("mg/dL").alias("valueuom"))

    def outputevents(self) -> DataFrame:
        return self._panel_rows("output").select("subject_id", "hadm_id", "stay_id", "itemid", F.col("t").alias("charttime"),
                                                 F.col("num").alias("value"), F.lit("mL").alias("valueuom"))

    def inputevents(self) -> DataFrame:
        k = F.col("k")
        uom = (F.when(F.col("itemid") == 221906, _pick(("mcg/kg/min", "mg/kg/min"), k))
               .when(F.col("itemid") == 221749, _pick(("mcg/kg/min", "mcg/min"), k))
               .when(F.col("itemid") == 222315, _pick(("units/hour", "units/min"), k)).otherwise("mg/hour"))
        return self._panel_rows("input").select(
            "subject_id", "hadm_id", "stay_id", "itemid", (F.col("event_id") * 1000 + F.col("pid")).alias("orderid"),
            F.col("event_id").alias("linkorderid"), F.col("t").alias("starttime"),
            (F.col("t") + F.make_dt_interval(F.lit(0), (F.lit(1) + (k + F.col("pid")) % 6).cast("int"))).alias("endtime"),
            (F.col("num") * 2).alias("amount"), F.lit("mg").alias("amountuom"), F.col("num").alias("rate"), uom.alias("rateuom"),
            F.when(k % 3 == 0, "16-Pre Admission/Non-ICU").otherwise("01-Drips").alias("ordercategoryname"),
            F.when(k % 10 == 0, F.lit(1.0)).otherwise((k + 50).cast("double")).alias("patientweight"))

    def ingredientevents(self) -> DataFrame:
        return (self.inputevents().filter(F.col("orderid") % 3 == 0)
                .select("subject_id", "hadm_id", "stay_id", "itemid", "starttime", "endtime", "amount", "amountuom", "rate", "rateuom"))

    def procedureevents(self) -> DataFrame:
        return self._panel_rows("proc").select(
            "subject_id", "hadm_id", "stay_id", "itemid", F.col("t").alias("starttime"),
            (F.col("t") + F.make_dt_interval(F.lit(0), (F.lit(1) + F.col("k") % 20).cast("int"))).alias("endtime"),
            F.col("num").alias("value"), F.lit("min").alias("valueuom"), F.col("txt").alias("location"))

    def datetimeevents(self) -> DataFrame:
        return self._in_slots(1).select(
            "subject_id", "hadm_id", "stay_id", (F.col("slot") + 224279).cast("long").alias("itemid"), F.col("t").alias("charttime"),
            F.col("t").alias("value"), F.lit("Date").alias("valueuom"))

    def microbiologyevents(self) -> DataFrame:
        k, e = F.col("k"), F.col("event_id")
        org = F.when(k % 3 != 0, _pick(ORGANISMS, e))
        return self._in_slots(4).filter(k % 2 == 0).select(
            e.alias("microevent_id"), "subject_id", F.when(k % 8 != 0, F.col("hadm_id")).alias("hadm_id"), e.alias("micro_specimen_id"),
            trunc_to("t", "DAY").alias("chartdate"), F.when(k % 4 == 0, F.col("t")).alias("charttime"),
            _pick(SPECIMENS, k).alias("spec_type_desc"), (F.lit(90000) + k % 5).cast("long").alias("test_itemid"),
            F.concat(F.lit("TEST "), (k % 5).cast("string")).alias("test_name"),
            F.when(k % 3 != 0, F.when(k % 7 == 0, 90856).otherwise(80000 + e % 6).cast("long")).alias("org_itemid"),
            org.alias("org_name"), _pick(COMMENTS, e).alias("comments"))

    def prescriptions(self) -> DataFrame:
        k, e = F.col("k"), F.col("event_id")
        return self._in_slots(4).select(
            "subject_id", "hadm_id", F.col("t").alias("starttime"),
            (F.col("t") + F.make_dt_interval((F.lit(1) + k % 3).cast("int"))).alias("stoptime"),
            F.when(k % 11 == 0, "BASE").otherwise("MAIN").alias("drug_type"), _pick(DRUGS, F.floor(e / SLOTS).cast("long")).alias("drug"),
            k.cast("string").alias("dose_val_rx"), F.lit("mg").alias("dose_unit_rx"), _pick(ROUTES, k).alias("route"))

    def diagnoses_icd(self) -> DataFrame:
        k, e = F.col("k"), F.col("event_id")
        number = e * 13 + k
        d = self._in_slots(0).select("subject_id", "hadm_id", (F.lit(1) + F.floor(e / SLOTS) % 9).cast("int").alias("seq_num"),
                                                             _pick([c for c, _ in CODES], number).alias("icd_code"),
                                                             _pick([v for _, v in CODES], number).alias("icd_version"))
        return d.filter(F.col("seq_num") <= 8).distinct()

    def d_icd_diagnoses(self) -> DataFrame:
        return self.diagnoses_icd().select("icd_code", "icd_version", F.concat(F.lit("Condition "), F.col("icd_code")).alias("long_title")).distinct()

    def services(self) -> DataFrame:
        return self._in_slots(2).filter(F.col("k") % 3 == 0).select(
            "subject_id", "hadm_id", (F.col("t") - F.make_dt_interval(F.lit(0), F.lit(20))).alias("transfertime"),
            _pick(SERVICES, F.col("event_id")).alias("curr_service"))

    def transfers(self) -> DataFrame:
        return self._in_slots(2).select(
            "subject_id", "hadm_id", F.col("event_id").alias("transfer_id"), _pick(("admit", "transfer", "discharge"), F.col("k")).alias("eventtype"),
            _pick(("MICU", "SICU", "Emergency Department"), F.col("event_id")).alias("careunit"), F.col("t").alias("intime"),
            (F.col("t") + F.make_dt_interval(F.lit(0), F.lit(5))).alias("outtime"))

    def discharge(self) -> DataFrame:
        """Texts of `documents` as notes of about two thirds of the admissions, some with several."""
        d = self.spark.read.parquet(f"{self.folder}/documents.parquet").select("doc_id", "text")
        a = self._once("admissions").select("subject_id", "hadm_id", "dischtime")
        named = d.select(F.concat(F.lit("N-"), F.col("doc_id").cast("string")).alias("note_id"), ((F.col("doc_id") * 7) % 83).alias("hadm_id"), F.lit("DS").alias("note_type"),
                         (F.col("doc_id") % 5).cast("int").alias("note_seq"), "text", (F.col("doc_id") % 50).cast("int").alias("late"))
        at = F.col("dischtime") + F.make_dt_interval(F.lit(0), F.col("late"))
        return named.filter((F.col("hadm_id") % 3 != 0) & (F.col("doc_id") % 10 == F.col("hadm_id") % 10)).join(a, "hadm_id").select(
            "note_id", "subject_id", "hadm_id", "note_type", "note_seq", at.alias("charttime"), (at + F.make_dt_interval(F.lit(1))).alias("storetime"), "text")

    def triage(self) -> DataFrame:
        """Measurements at the door for transfers of the emergency department."""
        n = F.col("transfer_id")
        return self.transfers().filter(F.col("careunit") == "Emergency Department").select(
            "subject_id", n.alias("stay_id"), (96 + n % 8).cast("double").alias("temperature"), (50 + n % 90).cast("double").alias("heartrate"), (10 + n % 25).cast("double").alias("resprate"),
            (80 + n % 21).cast("double").alias("o2sat"), (80 + n % 120).cast("double").alias("sbp"), (40 + n % 70).cast("double").alias("dbp"), (n % 11).cast("string").alias("pain"),
            (1 + n % 5).cast("double").alias("acuity"), _pick(("Chest pain", "Fall", "Dyspnea"), n).alias("chiefcomplaint"))

    def _dictionary(self, tables: dict[str, str]) -> DataFrame:
        known = sorted({(item, tables[tbl]) for _, tbl, item, *_ in PANEL if tbl in tables})
        return inline(self.spark, known, "itemid bigint, linksto string")

    def d_items(self) -> DataFrame:
        """Items that occur, with made-up labels; lines get the labels the canonical map knows."""
        special = {225752: "Arterial Line", 224263: "Multi Lumen", 224264: "PICC Line", 225204: "Midline", 224270: "Dialysis Catheter"}
        label = F.concat(F.lit("Item "), F.col("itemid").cast("string"))
        for item, text in special.items():
            label = F.when(F.col("itemid") == item, text).otherwise(label)
        links = {"chart": "chartevents", "output": "outputevents", "input": "inputevents", "proc": "procedureevents"}
        known = sorted({(item, links[tbl]) for _, tbl, item, *_ in PANEL if tbl in links} | {(224280, "datetimeevents")})
        d = inline(self.spark, known, "itemid bigint, linksto string").withColumn("label", F.when(F.col("itemid") == 224280, "Date of line").otherwise(label))
        return d.select(
            "itemid", "label", F.concat(F.lit("I"), F.col("itemid").cast("string")).alias("abbreviation"), "linksto",
            _pick(("Routine", "Labs", "Respiratory"), F.col("itemid")).alias("category"), F.lit("unit").alias("unitname"),
            _pick(("Numeric", "Text"), F.col("itemid")).alias("param_type"), F.lit(1.0).alias("lownormalvalue"), F.lit(99.0).alias("highnormalvalue"))

    def d_labitems(self) -> DataFrame:
        d = self._dictionary({"lab": "labevents"}).select("itemid")
        return d.select("itemid", F.concat(F.lit("Lab "), F.col("itemid").cast("string")).alias("label"), F.lit("Blood").alias("fluid"),
                        _pick(("Chemistry", "Hematology"), F.col("itemid")).alias("category"))

    def d_customevents(self) -> DataFrame:
        return inline(self.spark, [(10000, "My score", "MS", "me"), (10001, "My flag", "MF", "me")],
                      "itemid bigint, label string, abbreviation string, author string")

    def customevents(self) -> DataFrame:
        return self._parsed().filter(F.col("k") % 9 == 0).select(
            "subject_id", "hadm_id", F.when(F.col("k") % 2 == 0, F.col("stay_id")).alias("stay_id"),
            (F.lit(10000) + F.col("k") % 2).cast("long").alias("itemid"), F.col("t").alias("charttime"),
            F.col("k").cast("string").alias("value"), F.lit("pt").alias("valueuom"))

    def infection_type(self) -> DataFrame:
        rows = [("TEST 1", "ESCHERICHIA COLI", 3, "Bacterial"), ("TEST 2", "YEAST", 2, "Fungal"), ("TEST 4", "STAPH AUREUS COAG +", 5, "Bacterial"),
                ("TEST 1", "POSITIVE FOR MRSA", 1, "Bacterial"), ("TEST 2", "CANCELLED", 1, "Viral")]
        return inline(self.spark, rows, "label string, value string, count int, infection_type string")


class AdmissionFixture:
    """Hospital-level tables from `orders`, `lineitem` and `part`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def labevents(self) -> DataFrame:
        o = self._read("orders").select("o_orderkey", "o_custkey")
        li = self._read("lineitem")
        return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"), F.col("l_orderkey").alias("specimen_id"),
            (F.col("l_partkey") % 8).alias("itemid"), F.col("l_shipdate").alias("charttime"), F.col("l_quantity").alias("valuenum"),
            F.col("l_linenumber").alias("line"))

    def diagnoses_icd(self) -> DataFrame:
        o = self._read("orders").select("o_orderkey", "o_custkey")
        p = self._read("part").select("p_partkey", "p_brand", "p_size")
        li = self._read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
                .select(F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"),
                        F.col("l_linenumber").cast("int").alias("seq_num"), F.col("p_brand").alias("icd_code"),
                        F.when(F.col("p_size") % 2 == 0, 10).otherwise(9).alias("icd_version")).distinct())

    def prescriptions(self) -> DataFrame:
        o = self._read("orders").select("o_orderkey", "o_custkey")
        p = self._read("part").select("p_partkey", "p_name", "p_type")
        li = self._read("lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
                .select(F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"), F.col("p_name").alias("drug"),
                        F.col("p_type").alias("route"), F.col("l_shipdate").alias("starttime"),
                        (F.col("l_shipdate") + F.make_dt_interval(F.lit(3))).alias("stoptime")))


def _words(words) -> str:
    return "[" + ", ".join("'" + str(w).replace("'", "''") + "'" for w in words) + "]"


def _sql_pick(words, number: str) -> str:
    return f"({_words(words)})[CAST(({number}) % {len(words)} AS INTEGER) + 1]"


def fixture_sql() -> dict[str, str]:
    """The same views for the comparison engine, by name (prefix `v_`)."""
    rows = ",\n ".join(
        f"({i}, {s}, '{t}', CAST({it} AS BIGINT), CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), CAST({_words(tx)} AS VARCHAR[]), {kp})"
        for i, (s, t, it, lo, hi, tx, kp) in enumerate(PANEL))
    e = f"TIMESTAMP '{EPOCH}'"
    number = "event_id * 13 + k"
    views = {
        "v_ev": f"""SELECT event_id, user_id AS stay_id, user_id // 2 AS hadm_id, user_id // 4 AS subject_id,
            {e} + to_seconds((epoch_us(ts) - {EPOCH_US}) // 8000000) AS t, CAST(props->>'k' AS BIGINT) AS k,
            CAST(event_id % {SLOTS} AS INTEGER) AS slot, value FROM events""",
        "v_panel": f"SELECT * FROM (VALUES {rows}) AS p(pid, slot, tbl, itemid, lo, hi, texts, keep)",
        "v_rows": """SELECT *, CASE WHEN itemid IN (223900, 223901, 220739) THEN floor(raw) WHEN len(texts) = 0 AND m <> 3 THEN raw END AS num,
            CASE WHEN len(texts) > 0 THEN texts[CAST(m % len(texts) AS INTEGER) + 1] ELSE CAST(m AS VARCHAR) END AS txt
            FROM (SELECT *, lo + (hi - lo) * m / CAST(100 AS DOUBLE) AS raw FROM (
                SELECT v_ev.*, pid, tbl, itemid, lo, hi, texts, keep, (event_id * 7919 + pid * 104729 + k * 31) % 101 AS m
                FROM v_ev JOIN v_panel ON v_ev.slot = v_panel.slot)
            WHERE keep = 0 OR m % CASE WHEN keep = 0 THEN 1 ELSE keep END <> 0)""",
        "v_icustays": """SELECT subject_id, hadm_id, stay_id, min(t) AS intime, max(t) AS outtime,
            (epoch_us(max(t)) - epoch_us(min(t))) / CAST(86400000000 AS DOUBLE) AS los FROM v_ev GROUP BY ALL""",
        "v_admissions": f"""SELECT subject_id, hadm_id, i - to_hours(CAST(hadm_id % 30 AS INTEGER)) AS admittime, o + INTERVAL 1 DAY AS dischtime,
            CASE WHEN hadm_id % 7 = 0 THEN o + INTERVAL 1 DAY END AS deathtime, {_sql_pick(ADMISSION_TYPES, 'hadm_id')} AS admission_type,
            CASE WHEN hadm_id % 7 = 0 THEN 'DEAD/EXPIRED' ELSE 'HOME' END AS discharge_location, 'UNKNOWN' AS race,
            CASE WHEN hadm_id % 4 <> 0 THEN i - INTERVAL 1 DAY END AS edregtime, CAST(hadm_id % 7 = 0 AS INTEGER) AS hospital_expire_flag
            FROM (SELECT subject_id, hadm_id, min(intime) AS i, max(outtime) AS o FROM v_icustays GROUP BY ALL)""",
        "v_patients": """SELECT subject_id, CASE WHEN subject_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
            CAST(20 + (subject_id * 7) % 75 AS INTEGER) AS anchor_age, 2023 AS anchor_year,
            CASE WHEN subject_id % 5 = 0 THEN CAST(o + INTERVAL 20 DAY AS DATE) WHEN subject_id % 5 = 1 THEN CAST(o AS DATE) END AS dod
            FROM (SELECT subject_id, max(outtime) AS o FROM v_icustays GROUP BY ALL)""",
        "v_chartevents": f"""SELECT subject_id, hadm_id, stay_id, itemid, t AS charttime, t + to_minutes(pid) AS storetime, txt AS value,
            num AS valuenum, {_sql_pick(('mmHg', 'None', '%'), 'itemid')} AS valueuom FROM v_rows WHERE tbl = 'chart'""",
        "v_labevents": """SELECT event_id * 1000 + pid AS labevent_id, subject_id, CASE WHEN k % 10 <> 0 THEN hadm_id END AS hadm_id,
            event_id AS specimen_id, itemid, t AS charttime, t AS storetime, txt AS value, num AS valuenum, 'mg/dL' AS valueuom
            FROM v_rows WHERE tbl = 'lab'""",
        "v_outputevents": """SELECT subject_id, hadm_id, stay_id, itemid, t AS charttime, num AS value, 'mL' AS valueuom
            FROM v_rows WHERE tbl = 'output'""",
        "v_inputevents": f"""SELECT subject_id, hadm_id, stay_id, itemid, event_id * 1000 + pid AS orderid, event_id AS linkorderid,
            t AS starttime, t + to_hours(CAST(1 + (k + pid) % 6 AS INTEGER)) AS endtime, num * 2 AS amount, 'mg' AS amountuom, num AS rate,
            CASE WHEN itemid = 221906 THEN {_sql_pick(('mcg/kg/min', 'mg/kg/min'), 'k')}
                 WHEN itemid = 221749 THEN {_sql_pick(('mcg/kg/min', 'mcg/min'), 'k')}
                 WHEN itemid = 222315 THEN {_sql_pick(('units/hour', 'units/min'), 'k')} ELSE 'mg/hour' END AS rateuom,
            CASE WHEN k % 3 = 0 THEN '16-Pre Admission/Non-ICU' ELSE '01-Drips' END AS ordercategoryname, CASE WHEN k % 10 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(k + 50 AS DOUBLE) END AS patientweight
            FROM v_rows WHERE tbl = 'input'""",
        "v_ingredientevents": """SELECT subject_id, hadm_id, stay_id, itemid, starttime, endtime, amount, amountuom, rate, rateuom
            FROM v_inputevents WHERE orderid % 3 = 0""",
        "v_procedureevents": """SELECT subject_id, hadm_id, stay_id, itemid, t AS starttime, t + to_hours(CAST(1 + k % 20 AS INTEGER)) AS endtime,
            num AS value, 'min' AS valueuom, txt AS location FROM v_rows WHERE tbl = 'proc'""",
        "v_datetimeevents": """SELECT subject_id, hadm_id, stay_id, CAST(224280 AS BIGINT) AS itemid, t AS charttime, t AS value,
            'Date' AS valueuom FROM v_ev WHERE slot = 1""",
        "v_microbiologyevents": f"""SELECT event_id AS microevent_id, subject_id, CASE WHEN k % 8 <> 0 THEN hadm_id END AS hadm_id,
            event_id AS micro_specimen_id, date_trunc('day', t)::TIMESTAMP AS chartdate, CASE WHEN k % 4 = 0 THEN t END AS charttime,
            {_sql_pick(SPECIMENS, 'k')} AS spec_type_desc, CAST(90000 + k % 5 AS BIGINT) AS test_itemid, 'TEST ' || CAST(k % 5 AS VARCHAR) AS test_name,
            CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 7 = 0 THEN 90856 ELSE 80000 + event_id % 6 END END AS org_itemid,
            CASE WHEN k % 3 <> 0 THEN {_sql_pick(ORGANISMS, 'event_id')} END AS org_name, {_sql_pick(COMMENTS, 'event_id')} AS comments
            FROM v_ev WHERE slot = 4 AND k % 2 = 0""",
        "v_prescriptions": f"""SELECT subject_id, hadm_id, t AS starttime, t + to_days(CAST(1 + k % 3 AS INTEGER)) AS stoptime,
            CASE WHEN k % 11 = 0 THEN 'BASE' ELSE 'MAIN' END AS drug_type, {_sql_pick(DRUGS, f'event_id // {SLOTS}')} AS drug,
            CAST(k AS VARCHAR) AS dose_val_rx, 'mg' AS dose_unit_rx, {_sql_pick(ROUTES, 'k')} AS route FROM v_ev WHERE slot = 4""",
        "v_diagnoses_icd": f"""SELECT DISTINCT subject_id, hadm_id, CAST(1 + (event_id // {SLOTS}) % 9 AS INTEGER) AS seq_num,
            {_sql_pick([c for c, _ in CODES], number)} AS icd_code, CAST({_sql_pick([v for _, v in CODES], number)} AS INTEGER) AS icd_version
            FROM v_ev WHERE slot = 0 AND (event_id // {SLOTS}) % 9 < 8""",
        "v_d_icd_diagnoses": "SELECT DISTINCT icd_code, icd_version, 'Condition ' || icd_code AS long_title FROM v_diagnoses_icd",
        "v_services": f"""SELECT subject_id, hadm_id, t - INTERVAL 20 HOUR AS transfertime, {_sql_pick(SERVICES, 'event_id')} AS curr_service
            FROM v_ev WHERE slot = 2 AND k % 3 = 0""",
        "v_transfers": f"""SELECT subject_id, hadm_id, event_id AS transfer_id, {_sql_pick(('admit', 'transfer', 'discharge'), 'k')} AS eventtype,
            {_sql_pick(('MICU', 'SICU', 'Emergency Department'), 'event_id')} AS careunit, t AS intime, t + INTERVAL 5 HOUR AS outtime
            FROM v_ev WHERE slot = 2""",
        "v_discharge": """SELECT 'N-' || CAST(doc_id AS VARCHAR) AS note_id, a.subject_id, a.hadm_id, 'DS' AS note_type, CAST(doc_id % 5 AS INTEGER) AS note_seq,
            dischtime + to_hours(CAST(doc_id % 50 AS INTEGER)) AS charttime, dischtime + to_hours(CAST(doc_id % 50 AS INTEGER)) + INTERVAL 1 DAY AS storetime, text
            FROM documents JOIN v_admissions a ON a.hadm_id = (doc_id * 7) % 83 WHERE a.hadm_id % 3 <> 0 AND doc_id % 10 = a.hadm_id % 10""",
        "v_triage": f"""SELECT subject_id, transfer_id AS stay_id, CAST(96 + transfer_id % 8 AS DOUBLE) AS temperature, CAST(50 + transfer_id % 90 AS DOUBLE) AS heartrate,
            CAST(10 + transfer_id % 25 AS DOUBLE) AS resprate, CAST(80 + transfer_id % 21 AS DOUBLE) AS o2sat, CAST(80 + transfer_id % 120 AS DOUBLE) AS sbp, CAST(40 + transfer_id % 70 AS DOUBLE) AS dbp,
            CAST(transfer_id % 11 AS VARCHAR) AS pain, CAST(1 + transfer_id % 5 AS DOUBLE) AS acuity, {_sql_pick(('Chest pain', 'Fall', 'Dyspnea'), 'transfer_id')} AS chiefcomplaint
            FROM v_transfers WHERE careunit = 'Emergency Department'""",
        "v_d_items": f"""SELECT itemid, CASE itemid WHEN 225752 THEN 'Arterial Line' WHEN 224263 THEN 'Multi Lumen' WHEN 224264 THEN 'PICC Line'
            WHEN 225204 THEN 'Midline' WHEN 224270 THEN 'Dialysis Catheter' WHEN 224280 THEN 'Date of line' ELSE 'Item ' || CAST(itemid AS VARCHAR) END AS label,
            'I' || CAST(itemid AS VARCHAR) AS abbreviation, linksto, {_sql_pick(('Routine', 'Labs', 'Respiratory'), 'itemid')} AS category,
            'unit' AS unitname, {_sql_pick(('Numeric', 'Text'), 'itemid')} AS param_type, CAST(1 AS DOUBLE) AS lownormalvalue,
            CAST(99 AS DOUBLE) AS highnormalvalue FROM (SELECT DISTINCT itemid, CASE tbl WHEN 'chart' THEN 'chartevents' WHEN 'output' THEN 'outputevents'
            WHEN 'input' THEN 'inputevents' ELSE 'procedureevents' END AS linksto FROM v_panel WHERE tbl <> 'lab'
            UNION ALL SELECT CAST(224280 AS BIGINT), 'datetimeevents')""",
        "v_d_labitems": f"""SELECT itemid, 'Lab ' || CAST(itemid AS VARCHAR) AS label, 'Blood' AS fluid,
            {_sql_pick(('Chemistry', 'Hematology'), 'itemid')} AS category FROM (SELECT DISTINCT itemid FROM v_panel WHERE tbl = 'lab')""",
        "v_d_customevents": """SELECT * FROM (VALUES (CAST(10000 AS BIGINT), 'My score', 'MS', 'me'), (10001, 'My flag', 'MF', 'me'))
            AS d(itemid, label, abbreviation, author)""",
        "v_customevents": """SELECT subject_id, hadm_id, CASE WHEN k % 2 = 0 THEN stay_id END AS stay_id, CAST(10000 + k % 2 AS BIGINT) AS itemid,
            t AS charttime, CAST(k AS VARCHAR) AS value, 'pt' AS valueuom FROM v_ev WHERE k % 9 = 0""",
        "v_infection_type": """SELECT * FROM (VALUES ('TEST 1', 'ESCHERICHIA COLI', 3, 'Bacterial'), ('TEST 2', 'YEAST', 2, 'Fungal'),
            ('TEST 4', 'STAPH AUREUS COAG +', 5, 'Bacterial'), ('TEST 1', 'POSITIVE FOR MRSA', 1, 'Bacterial'), ('TEST 2', 'CANCELLED', 1, 'Viral'))
            AS d(label, value, count, infection_type)""",
        "v_hosp_labevents": """SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_orderkey AS specimen_id, l_partkey % 8 AS itemid,
            l_shipdate AS charttime, l_quantity AS valuenum, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "v_hosp_diagnoses": """SELECT DISTINCT o_custkey AS subject_id, l_orderkey AS hadm_id, CAST(l_linenumber AS INTEGER) AS seq_num,
            p_brand AS icd_code, CASE WHEN p_size % 2 = 0 THEN 10 ELSE 9 END AS icd_version
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
        "v_hosp_prescriptions": """SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, p_name AS drug, p_type AS route, l_shipdate AS starttime,
            l_shipdate + INTERVAL 3 DAY AS stoptime FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    }
    return views
