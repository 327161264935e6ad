"""Clinical definitions as data: item identifiers, valid ranges, keyword lists, code rules, score rules.

Fixed values: they must equal the published definitions, so they are written out plainly.
"""

from __future__ import annotations

from ..operators.reshape import ItemCol
from ..operators.scoring import CodeRule, RuleScore, bands

I = ItemCol

# --- single items -------------------------------------------------------------------------------
HEART_RATE = 220045
WEIGHT_ADMIT, WEIGHT_DAILY = 226512, 224639
HEIGHT_INCH, HEIGHT_CM = 226707, 226730
GCS_VERBAL, GCS_MOTOR, GCS_EYES = 223900, 223901, 220739
INTUBATED_TEXT = "No Response-ETT"
SPO2, FIO2_CHARTED = 220277, 223835
O2_FLOW, O2_FLOW_BIPAP, O2_FLOW_ADDITIONAL, O2_DEVICE = 223834, 227582, 227287, 226732
CREATININE = 50912
IRRIGANT_IN = 227488

# --- laboratory pivots ---------------------------------------------------------------------------
BLOOD_GAS = (
    I("specimen", (52033,), field="value"), I("aado2", (50801,)), I("baseexcess", (50802,)), I("bicarbonate", (50803,)),
    I("totalco2", (50804,)), I("carboxyhemoglobin", (50805,)), I("chloride", (50806,)), I("calcium", (50808,)),
    I("glucose", (50809,), le=10000), I("hematocrit", (50810,), le=100), I("hemoglobin", (50811,)), I("lactate", (50813,), le=10000),
    I("methemoglobin", (50814,)), I("so2", (50817,), le=100), I("pco2", (50818,)), I("ph", (50820,)), I("po2", (50821,)),
    I("potassium", (50822,)), I("sodium", (50824,)), I("temperature", (50825,)),
)
FIO2_LAB = 50816
BLOOD_DIFFERENTIAL = (
    I("wbc", (51300, 51301, 51755)), I("basophils_abs", (52069,)), I("eosinophils_abs", (52073, 51199), scale={51199: 1000.0}),
    I("lymphocytes_abs", (51133, 52769), scale={52769: 1000.0}), I("monocytes_abs", (52074, 51253), scale={51253: 1000.0}),
    I("neutrophils_abs", (52075,)), I("basophils", (51146,)), I("eosinophils", (51200,)), I("lymphocytes", (51244, 51245)),
    I("monocytes", (51254,)), I("neutrophils", (51256,)), I("atypical_lymphocytes", (51143,)), I("bands", (51144,)),
    I("immature_granulocytes", (52135,)), I("metamyelocytes", (51251,)), I("nrbc", (51257,)),
)
GRANULOCYTES = 51218
DIFFERENTIAL_PERCENT = (51146, 51200, 51244, 51245, 51254, 51256)
IMPUTED = ("basophils", "eosinophils", "lymphocytes", "monocytes", "neutrophils")
CARDIAC_MARKER = (I("troponin_t", (51003,)), I("ck_mb", (50911,)), I("ntprobnp", (50963,)))
ANION_GAP = 50868
CHEMISTRY = (
    I("albumin", (50862,), le=10), I("globulin", (50930,), le=10), I("total_protein", (50976,), le=20), I("aniongap", (50868,), le=10000),
    I("bicarbonate", (50882,), le=10000), I("bun", (51006,), le=300), I("calcium", (50893,), le=10000), I("chloride", (50902,), le=10000),
    I("creatinine", (50912,), le=150), I("glucose", (50931,), le=10000), I("sodium", (50983,), le=200), I("potassium", (50971,), le=30),
)
COAGULATION = (I("d_dimer", (51196,)), I("fibrinogen", (51214,)), I("thrombin", (51297,)), I("inr", (51237,)), I("pt", (51274,)), I("ptt", (51275,)))
BLOOD_COUNT = (
    I("hematocrit", (51221,)), I("hemoglobin", (51222,)), I("mch", (51248,)), I("mchc", (51249,)), I("mcv", (51250,)),
    I("platelet", (51265,)), I("rbc", (51279,)), I("rdw", (51277,)), I("rdwsd", (52159,)), I("wbc", (51301,)),
)
ENZYME = (
    I("alt", (50861,)), I("alp", (50863,)), I("ast", (50878,)), I("amylase", (50867,)), I("bilirubin_total", (50885,)),
    I("bilirubin_direct", (50883,)), I("bilirubin_indirect", (50884,)), I("ck_cpk", (50910,)), I("ck_mb", (50911,)), I("ggt", (50927,)),
    I("ld_ldh", (50954,)),
)
INFLAMMATION = (I("crp", (50889,)),)

# --- charted pivots ------------------------------------------------------------------------------
ICP = (I("icp", (220765, 227989), gt=0, lt=100),)
RHYTHM = (
    I("heart_rhythm", (220048,), field="value"), I("ectopy_type", (224650,), field="value"), I("ectopy_frequency", (224651,), field="value"),
    I("ectopy_type_secondary", (226479,), field="value"), I("ectopy_frequency_secondary", (226480,), field="value"),
)
VENTILATOR = (
    I("respiratory_rate_set", (224688,)), I("respiratory_rate_total", (224690,)), I("respiratory_rate_spontaneous", (224689,)),
    I("minute_volume", (224687,)), I("tidal_volume_set", (224684,)), I("tidal_volume_observed", (224685,)),
    I("tidal_volume_spontaneous", (224686,)), I("plateau_pressure", (224696,)), I("peep", (220339, 224700), ge=0, le=100),
    I("flow_rate", (224691,)), I("ventilator_mode", (223849,), field="value"), I("ventilator_mode_hamilton", (229314,), field="value"),
    I("ventilator_type", (223848,), field="value"),
)
VITALS = (
    I("heart_rate", (220045,), gt=0, lt=300), I("sbp", (220179, 220050, 225309), gt=0, lt=400), I("dbp", (220180, 220051, 225310), gt=0, lt=300),
    I("mbp", (220052, 220181, 225312), gt=0, lt=300), I("sbp_ni", (220179,), gt=0, lt=400), I("dbp_ni", (220180,), gt=0, lt=300),
    I("mbp_ni", (220181,), gt=0, lt=300), I("resp_rate", (220210, 224690), gt=0, lt=70), I("spo2", (220277,), gt=0, le=100),
    I("glucose", (225664, 220621, 226537), gt=0),
)
TEMP_FAHRENHEIT, TEMP_CELSIUS, TEMP_SITE = 223761, 223762, 224642
VITAL_ORDER = ("heart_rate", "sbp", "dbp", "mbp", "sbp_ni", "dbp_ni", "mbp_ni", "resp_rate", "temperature", "temperature_site", "spo2", "glucose")
URINE_ITEMS = (226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227488, 227489)
CRRT = (
    I("crrt_mode", (227290,), field="value"), I("access_pressure", (224149,)), I("blood_flow", (224144,)), I("citrate", (228004,)),
    I("current_goal", (225183,)), I("dialysate_fluid", (225977,), field="value"), I("dialysate_rate", (224154,)),
    I("effluent_pressure", (224151,)), I("filter_pressure", (224150,)), I("heparin_concentration", (225958,), field="value"),
    I("heparin_dose", (224145,)), I("hourly_patient_fluid_removal", (224191,)), I("prefilter_replacement_rate", (228005,)),
    I("postfilter_replacement_rate", (228006,)), I("replacement_fluid", (225976,), field="value"), I("replacement_rate", (224153,)),
    I("return_pressure", (224152,)), I("ultrafiltrate_output", (226457,)),
)
CRRT_SYSTEM = 224146
# column -> texts of the system-integrity item that mean 1, texts that mean 0
CRRT_STATES = {
    "system_active": (("Active", "Initiated", "Reinitiated", "New Filter"), ("Recirculating", "Discontinued")),
    "clots": (("Clots Present",), ("No Clot Present",)),
    "clots_increasing": (("Clots Increasing", "Clot Increasing"), ()),
    "clotted": (("Clotted",), ()),
}
DIALYSIS_ITEMS = (
    226118, 227357, 225725, 226499, 224154, 225810, 227639, 225183, 227438, 224191, 225806, 225807, 228004, 228005, 228006, 224144,
    224145, 224149, 224150, 224151, 224152, 224153, 224404, 224406, 226457, 225959, 224135, 224139, 224146, 225323, 225740, 225776,
    225951, 225952, 225953, 225954, 225956, 225958, 225961, 225963, 225965, 225976, 225977, 227124, 227290, 227638, 227640, 227753,
)
DIALYSIS_ACTIVE_ITEMS = (226499, 224154, 225183, 227438, 224191, 225806, 225807, 228004, 228005, 228006, 224144, 224145, 224153, 226457)
PERITONEAL_STATUS, PERITONEAL_IN_USE = 225965, "In use"
PERITONEAL_ITEMS = (225810, 225806, 225807, 227639, 225959, 225951, 225952, 225961, 225953, 225963, 225965, 227638, 227640)
CRRT_MODE, HEMODIALYSIS_OUTPUT = 227290, 226499
DIALYSIS_INFUSIONS = (227536, 227525)
# procedure -> type; the two last ones mean present but not active
DIALYSIS_PROCEDURES = {225441: "IHD", 225802: "CRRT", 225803: "CVVHD", 225805: "Peritoneal", 225809: "CVVHDF", 225955: "SCUF", 224270: None, 225436: None}
DIALYSIS_PASSIVE = (224270, 225436)

INVASIVE_LINES = (
    227719, 225752, 224269, 224267, 224270, 224272, 226124, 228169, 225202, 228286, 225204, 224263, 224560, 224264, 225203, 224273,
    225789, 225761, 228201, 228202, 224268, 225199, 225315, 225205,
)
LINE_TYPES = {
    "Arterial": ("Arterial Line", "A-Line"), "Continuous Cardiac Output PA": ("CCO PA Line", "CCO PAC"),
    "Dialysis": ("Dialysis Catheter", "Dialysis Line"), "Hickman": ("Hickman", "Tunneled (Hickman) Line"), "IABP": ("IABP", "IABP line"),
    "Multi Lumen": ("Multi Lumen", "Multi-lumen"), "PA": ("PA Catheter", "PA line"), "PICC": ("PICC Line", "PICC line"),
    "Pre-Sep": ("Pre-Sep Catheter", "Presep Catheter"), "Trauma": ("Trauma Line", "Trauma line"),
    "Triple Introducer": ("Triple Introducer", "TripleIntroducer"), "Portacath": ("Portacath", "Indwelling Port (PortaCath)"),
}
LINE_SITES = {
    "Left Antecube": ("Left Antecub", "Left Antecube"), "Left Axilla": ("Left Axilla", "Left Axilla."),
    "Left Brachial": ("Left Brachial", "Left Brachial."), "Left Femoral": ("Left Femoral", "Left Femoral."),
    "Right Antecube": ("Right Antecub", "Right Antecube"), "Right Axilla": ("Right Axilla", "Right Axilla."),
    "Right Brachial": ("Right Brachial", "Right Brachial."), "Right Femoral": ("Right Femoral", "Right Femoral."),
}

# --- ventilation states, in order of priority ---------------------------------------------------------
TRACH_DEVICES = ("Tracheostomy tube", "Trach mask ")
INVASIVE_DEVICES = ("Endotracheal tube",)
INVASIVE_MODES = (
    "(S) CMV", "APRV", "APRV/Biphasic+ApnPress", "APRV/Biphasic+ApnVol", "APV (cmv)", "Ambient", "Apnea Ventilation", "CMV", "CMV/ASSIST",
    "CMV/ASSIST/AutoFlow", "CMV/AutoFlow", "CPAP/PPS", "CPAP/PSV", "CPAP/PSV+Apn TCPL", "CPAP/PSV+ApnPres", "CPAP/PSV+ApnVol", "MMV",
    "MMV/AutoFlow", "MMV/PSV", "MMV/PSV/AutoFlow", "P-CMV", "PCV+", "PCV+/PSV", "PCV+Assist", "PRES/AC", "PRVC/AC", "PRVC/SIMV", "PSV/SBT",
    "SIMV", "SIMV/AutoFlow", "SIMV/PRES", "SIMV/PSV", "SIMV/PSV/AutoFlow", "SIMV/VOL", "SYNCHRON MASTER", "SYNCHRON SLAVE", "VOL/AC",
)
INVASIVE_HAMILTON = ("APRV", "APV (cmv)", "Ambient", "(S) CMV", "P-CMV", "SIMV", "APV (simv)", "P-SIMV", "VS", "ASV")
NONINVASIVE_DEVICES = ("Bipap mask ", "CPAP mask ")
NONINVASIVE_HAMILTON = ("DuoPaP", "NIV", "NIV-ST")
HIGH_FLOW_DEVICES = ("High flow nasal cannula",)
SUPPLEMENTAL_DEVICES = (
    "Non-rebreather", "Face tent", "Aerosol-cool", "Venti mask ", "Medium conc mask ", "Ultrasonic neb", "Vapomist", "Oxymizer",
    "High flow neb", "Nasal cannula",
)
NO_DEVICE = ("None",)

# --- medication ----------------------------------------------------------------------------------
INFUSIONS = {
    "dobutamine": 221653, "dopamine": 221662, "epinephrine": 221289, "milrinone": 221986, "norepinephrine": 221906,
    "phenylephrine": 221749, "vasopressin": 222315,
}
NEUROBLOCK = (222062, 221555)
ACE_INHIBITORS = ("benazepril", "captopril", "enalapril", "fosinopril", "lisinopril", "moexipril", "perindopril", "quinapril", "ramipril", "trandolapril")
RECEPTOR_BLOCKERS = (
    "azilsartan", "edarbi", "candesartan", "atacand", "irbesartan", "avapro", "losartan", "cozaar", "olmesartan", "benicar", "telmisartan",
    "micardis", "valsartan", "diovan", "sacubitril", "entresto",
)
ANTI_INFLAMMATORY = (
    "aspirin", "bromfenac", "celecoxib", "diclofenac", "diflunisal", "etodolac", "fenoprofen", "flurbiprofen", "ibuprofen", "indomethacin",
    "ketoprofen", "mefenamic acid", "meloxicam", "nabumetone", "naproxen", "nepafenac", "oxaprozin", "piroxicam", "sulindac", "tolmetin",
)
ANTIBIOTICS = (
    "adoxa", "ala-tet", "alodox", "amikacin", "amikin", "amoxicill", "amphotericin", "anidulafungin", "ancef", "clavulanate", "ampicillin",
    "augmentin", "avelox", "avidoxy", "azactam", "azithromycin", "aztreonam", "axetil", "bactocill", "bactrim", "bactroban", "bethkis",
    "biaxin", "bicillin l-a", "cayston", "cefazolin", "cedax", "cefoxitin", "ceftazidime", "cefaclor", "cefadroxil", "cefdinir",
    "cefditoren", "cefepime", "cefotan", "cefotetan", "cefotaxime", "ceftaroline", "cefpodoxime", "cefpirome", "cefprozil", "ceftibuten",
    "ceftin", "ceftriaxone", "cefuroxime", "cephalexin", "cephalothin", "cephapririn", "chloramphenicol", "cipro", "ciprofloxacin",
    "claforan", "clarithromycin", "cleocin", "clindamycin", "cubicin", "dicloxacillin", "dirithromycin", "doryx", "doxycy", "duricef",
    "dynacin", "ery-tab", "eryped", "eryc", "erythrocin", "erythromycin", "factive", "flagyl", "fortaz", "furadantin", "garamycin",
    "gentamicin", "kanamycin", "keflex", "kefzol", "ketek", "levaquin", "levofloxacin", "lincocin", "linezolid", "macrobid",
    "macrodantin", "maxipime", "mefoxin", "metronidazole", "meropenem", "methicillin", "minocin", "minocycline", "monodox", "monurol",
    "morgidox", "moxatag", "moxifloxacin", "mupirocin", "myrac", "nafcillin", "neomycin", "nicazel doxy 30", "nitrofurantoin",
    "norfloxacin", "noroxin", "ocudox", "ofloxacin", "omnicef", "oracea", "oraxyl", "oxacillin", "pc pen vk", "pce dispertab",
    "panixine", "pediazole", "penicillin", "periostat", "pfizerpen", "piperacillin", "tazobactam", "primsol", "proquin", "raniclor",
    "rifadin", "rifampin", "rocephin", "smz-tmp", "septra", "septra ds", "solodyn", "spectracef", "streptomycin", "sulfadiazine",
    "sulfamethoxazole", "trimethoprim", "sulfatrim", "sulfisoxazole", "suprax", "synercid", "tazicef", "tetracycline", "timentin",
    "tobramycin", "unasyn", "vancocin", "vancomycin", "vantin", "vibativ", "vibra-tabs", "vibramycin", "zinacef", "zithromax", "zosyn", "zyvox",
)
EXCLUDED_ROUTES = ("OU", "OS", "OD", "AU", "AS", "AD", "TP")
EXCLUDED_ROUTE_WORDS = ("ear", "eye")
EXCLUDED_FORMS = ("cream", "desensitization", "ophth oint", "gel")
NO_GROWTH_ORGANISM = 90856

# --- diagnosis groups (9th and 10th revision) ---------------------------------------------------------
CHARLSON = {
    "myocardial_infarct": CodeRule(("410", "412"), ("I21", "I22", "I252")),
    "congestive_heart_failure": CodeRule(
        ("428", "39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493"),
        ("I43", "I50", "I099", "I110", "I130", "I132", "I255", "I420", "I425", "I426", "I427", "I428", "I429", "P290"), (("4254", "4259"),)),
    "peripheral_vascular_disease": CodeRule(
        ("440", "441", "0930", "4373", "4471", "5571", "5579", "V434"),
        ("I70", "I71", "I731", "I738", "I739", "I771", "I790", "I792", "K551", "K558", "K559", "Z958", "Z959"), (("4431", "4439"),)),
    "cerebrovascular_disease": CodeRule(("36234",), ("G45", "G46", "H340"), (("430", "438"),), (("I60", "I69"),)),
    "dementia": CodeRule(("290", "2941", "3312"), ("F00", "F01", "F02", "F03", "G30", "F051", "G311")),
    "chronic_pulmonary_disease": CodeRule(
        ("4168", "4169", "5064", "5081", "5088"), ("I278", "I279", "J684", "J701", "J703"), (("490", "505"),), (("J40", "J47"), ("J60", "J67"))),
    "rheumatic_disease": CodeRule(
        ("725", "4465", "7100", "7101", "7102", "7103", "7104", "7140", "7141", "7142", "7148"),
        ("M05", "M06", "M32", "M33", "M34", "M315", "M351", "M353", "M360")),
    "peptic_ulcer_disease": CodeRule(("531", "532", "533", "534"), ("K25", "K26", "K27", "K28")),
    "mild_liver_disease": CodeRule(
        ("570", "571", "0706", "0709", "5733", "5734", "5738", "5739", "V427", "07022", "07023", "07032", "07033", "07044", "07054"),
        ("B18", "K73", "K74", "K700", "K701", "K702", "K703", "K709", "K713", "K714", "K715", "K717", "K760", "K762", "K763", "K764",
         "K768", "K769", "Z944")),
    "diabetes_without_cc": CodeRule(
        ("2500", "2501", "2502", "2503", "2508", "2509"),
        ("E100", "E101", "E106", "E108", "E109", "E110", "E111", "E116", "E118", "E119", "E120", "E121", "E126", "E128", "E129", "E130",
         "E131", "E136", "E138", "E139", "E140", "E141", "E146", "E148", "E149")),
    "diabetes_with_cc": CodeRule(
        ("2504", "2505", "2506", "2507"),
        ("E102", "E103", "E104", "E105", "E107", "E112", "E113", "E114", "E115", "E117", "E122", "E123", "E124", "E125", "E127", "E132",
         "E133", "E134", "E135", "E137", "E142", "E143", "E144", "E145", "E147")),
    "paraplegia": CodeRule(
        ("342", "343", "3341", "3440", "3441", "3442", "3443", "3444", "3445", "3446", "3449"),
        ("G81", "G82", "G041", "G114", "G801", "G802", "G830", "G831", "G832", "G833", "G834", "G839")),
    "renal_disease": CodeRule(
        ("582", "585", "586", "V56", "5880", "V420", "V451", "40301", "40311", "40391", "40402", "40403", "40412", "40413", "40492", "40493"),
        ("N18", "N19", "I120", "I131", "N032", "N033", "N034", "N035", "N036", "N037", "N052", "N053", "N054", "N055", "N056", "N057",
         "N250", "Z490", "Z491", "Z492", "Z940", "Z992"), (("5830", "5837"),)),
    "malignant_cancer": CodeRule(
        ("2386",), ("C43", "C88"), (("140", "172"), ("1740", "1958"), ("200", "208")),
        (("C00", "C26"), ("C30", "C34"), ("C37", "C41"), ("C45", "C58"), ("C60", "C76"), ("C81", "C85"), ("C90", "C97"))),
    "severe_liver_disease": CodeRule(
        ("4560", "4561", "4562"), ("I850", "I859", "I864", "I982", "K704", "K711", "K721", "K729", "K765", "K766", "K767"), (("5722", "5728"),)),
    "metastatic_solid_tumor": CodeRule(("196", "197", "198", "199"), ("C77", "C78", "C79", "C80")),
    "aids": CodeRule(("042", "043", "044"), ("B20", "B21", "B22", "B24")),
}
SAPS_COMORBIDITY = {
    "aids": CodeRule((), ("B24",), (("042", "044"),), (("B20", "B22"),)),
    "hem": CodeRule(
        ("2386", "2733"), (),
        (("20000", "20238"), ("20240", "20248"), ("20250", "20302"), ("20310", "20312"), ("20302", "20382"), ("20400", "20522"),
         ("20580", "20702"), ("20720", "20892")), (("C81", "C96"),)),
    "mets": CodeRule(("20979", "78951"), ("C800",), (("1960", "1991"), ("20970", "20975")), (("C77", "C79"),)),
}
KIDNEY_DISEASE = CodeRule(("585",), ("N18",))
LATE_KIDNEY_DISEASE = CodeRule(("5854", "5855", "5856"), ("N184", "N185", "N186"))

# --- score rules: first matching line gives the points --------------------------------------------------
S = RuleScore
SOFA = (
    S("respiration", (
        ("pao2fio2ratio_vent < 100", 4), ("pao2fio2ratio_vent < 200", 3), ("pao2fio2ratio_novent < 300", 2), ("pao2fio2ratio_vent < 300", 2),
        ("pao2fio2ratio_novent < 400", 1), ("pao2fio2ratio_vent < 400", 1),
        ("COALESCE(pao2fio2ratio_vent, pao2fio2ratio_novent) IS NULL", None)), 0),
    S("coagulation", (("platelet_min < 20", 4), ("platelet_min < 50", 3), ("platelet_min < 100", 2), ("platelet_min < 150", 1), ("platelet_min IS NULL", None)), 0),
    S("liver", (("bilirubin_max >= 12.0", 4), ("bilirubin_max >= 6.0", 3), ("bilirubin_max >= 2.0", 2), ("bilirubin_max >= 1.2", 1), ("bilirubin_max IS NULL", None)), 0),
    S("cardiovascular", (
        ("rate_dopamine > 15 OR rate_epinephrine > 0.1 OR rate_norepinephrine > 0.1", 4),
        ("rate_dopamine > 5 OR rate_epinephrine <= 0.1 OR rate_norepinephrine <= 0.1", 3),
        ("rate_dopamine > 0 OR rate_dobutamine > 0", 2), ("meanbp_min < 70", 1),
        ("COALESCE(meanbp_min, rate_dopamine, rate_dobutamine, rate_epinephrine, rate_norepinephrine) IS NULL", None)), 0),
    S("cns", (("gcs_min >= 13 AND gcs_min <= 14", 1), ("gcs_min >= 10 AND gcs_min <= 12", 2), ("gcs_min >= 6 AND gcs_min <= 9", 3),
              ("gcs_min < 6", 4), ("gcs_min IS NULL", None)), 0),
    S("renal", (
        ("creatinine_max >= 5.0", 4), ("uo_24hr < 200", 4), ("creatinine_max >= 3.5 AND creatinine_max < 5.0", 3), ("uo_24hr < 500", 3),
        ("creatinine_max >= 2.0 AND creatinine_max < 3.5", 2), ("creatinine_max >= 1.2 AND creatinine_max < 2.0", 1),
        ("COALESCE(uo_24hr, creatinine_max) IS NULL", None)), 0),
)
SOFA_PARTS = tuple(s.name for s in SOFA)
# the first-day variant differs in respiration only: no ventilated 300/400 steps
FIRST_DAY_RESPIRATION = S("respiration", (
    ("pao2fio2ratio_vent < 100", 4), ("pao2fio2ratio_vent < 200", 3), ("pao2fio2ratio_novent < 300", 2), ("pao2fio2ratio_novent < 400", 1),
    ("COALESCE(pao2fio2ratio_vent, pao2fio2ratio_novent) IS NULL", None)), 0)
FIRST_DAY_SOFA = (FIRST_DAY_RESPIRATION, *SOFA[1:])

SIRS = (
    S("temp_score", (("temperature_min < 36.0", 1), ("temperature_max > 38.0", 1), ("temperature_min IS NULL", None)), 0),
    S("heart_rate_score", (("heart_rate_max > 90.0", 1), ("heart_rate_max IS NULL", None)), 0),
    S("resp_score", (("resp_rate_max > 20.0", 1), ("paco2_min < 32.0", 1), ("COALESCE(resp_rate_max, paco2_min) IS NULL", None)), 0),
    S("wbc_score", (("wbc_min < 4.0", 1), ("wbc_max > 12.0", 1), ("bands_max > 10", 1), ("COALESCE(wbc_min, bands_max) IS NULL", None)), 0),
)
KDIGO_CREATININE = S("aki_stage_creat", (
    ("creat >= creat_low_past_7day * 3.0", 3), ("creat >= 4 AND (creat_low_past_48hr <= 3.7 OR creat >= 1.5 * creat_low_past_7day)", 3),
    ("creat >= creat_low_past_7day * 2.0", 2), ("creat >= creat_low_past_48hr + 0.3", 1), ("creat >= creat_low_past_7day * 1.5", 1)), 0)
KDIGO_URINE = S("aki_stage_uo", (
    ("uo_rt_6hr IS NULL", None), ("charttime <= intime + INTERVAL '6' HOUR", 0), ("uo_tm_24hr >= 24 AND uo_rt_24hr < 0.3", 3),
    ("uo_tm_12hr >= 12 AND uo_rt_12hr = 0", 3), ("uo_tm_12hr >= 12 AND uo_rt_12hr < 0.5", 2), ("uo_tm_6hr >= 6 AND uo_rt_6hr < 0.5", 1)), 0)

LODS = (
    S("neurologic", (("gcs_min IS NULL", None), ("gcs_min < 3", None), ("gcs_min <= 5", 5), ("gcs_min <= 8", 3), ("gcs_min <= 13", 1)), 0),
    S("cardiovascular", (
        ("heart_rate_max IS NULL AND sbp_min IS NULL", None), ("heart_rate_min < 30", 5), ("sbp_min < 40", 5), ("sbp_min < 70", 3),
        ("sbp_max >= 270", 3), ("heart_rate_max >= 140", 1), ("sbp_max >= 240", 1), ("sbp_min < 90", 1)), 0),
    S("renal", (
        ("bun_max IS NULL OR urineoutput IS NULL OR creatinine_max IS NULL", None), ("urineoutput < 500.0", 5), ("bun_max >= 56.0", 5),
        ("creatinine_max >= 1.60", 3), ("urineoutput < 750.0", 3), ("bun_max >= 28.0", 3), ("urineoutput >= 10000.0", 3),
        ("creatinine_max >= 1.20", 1), ("bun_max >= 17.0", 1), ("bun_max >= 7.50", 1)), 0),
    S("pulmonary", (("pao2fio2_vent_min IS NULL", 0), ("pao2fio2_vent_min >= 150", 1), ("pao2fio2_vent_min < 150", 3))),
    S("hematologic", (("wbc_max IS NULL AND platelet_min IS NULL", None), ("wbc_min < 1.0", 3), ("wbc_min < 2.5", 1), ("platelet_min < 50.0", 1), ("wbc_max >= 50.0", 1)), 0),
    S("hepatic", (("pt_max IS NULL AND bilirubin_max IS NULL", None), ("bilirubin_max >= 2.0", 1), ("pt_max > 12 + 3", 1), ("pt_min < 12 * 0.25", 1)), 0),
)
# OASIS: (score, rules with the column shown as the contributing value, default) — the value column is the mean of min and max by default
OASIS_VITALS = {
    "heart_rate": (("heart_rate_max > 125", 6, "max"), ("heart_rate_min < 33", 4, "min"), ("heart_rate_max >= 107 AND heart_rate_max <= 125", 3, "max"),
                   ("heart_rate_max >= 89 AND heart_rate_max <= 106", 1, "max")),
    "mbp": (("mbp_min < 20.65", 4, "min"), ("mbp_min < 51", 3, "min"), ("mbp_max > 143.44", 3, "max"), ("mbp_min >= 51 AND mbp_min < 61.33", 2, "min")),
    "resp_rate": (("resp_rate_min < 6", 10, "min"), ("resp_rate_max > 44", 9, "max"), ("resp_rate_max > 30", 6, "max"), ("resp_rate_max > 22", 1, "max"),
                  ("resp_rate_min < 13", 1, "min")),
    "temperature": (("temperature_max > 39.88", 6, "max"), ("temperature_min >= 33.22 AND temperature_min <= 35.93", 4, "min"),
                    ("temperature_max >= 33.22 AND temperature_max <= 35.93", 4, "max"), ("temperature_min < 33.22", 3, "min"),
                    ("temperature_min > 35.93 AND temperature_min <= 36.39", 2, "min"), ("temperature_max >= 36.89 AND temperature_max <= 39.88", 2, "max")),
}
# vital -> (extreme whose NULL empties the score, name of the value column, name of the score column)
OASIS_NAMES = {"heart_rate": ("max", "heartrate", "heart_rate_score"), "mbp": ("min", "meanbp", "mbp_score"),
               "resp_rate": ("min", "resprate", "resp_rate_score"), "temperature": ("max", "temp", "temp_score")}
OASIS = (
    S("preiculos_score", (("preiculos IS NULL", None), ("preiculos < 10.2", 5), ("preiculos < 297", 3), ("preiculos < 1440", 0), ("preiculos < 18708", 2)), 1),
    S("age_score", (("age IS NULL", None), ("age < 24", 0), ("age <= 53", 3), ("age <= 77", 6), ("age <= 89", 9), ("age >= 90", 7)), 0),
    S("gcs_score", (("gcs_min IS NULL", None), ("gcs_min <= 7", 10), ("gcs_min < 14", 4), ("gcs_min = 14", 3)), 0),
    *(S(OASIS_NAMES[v][2], ((f"{v}_{OASIS_NAMES[v][0]} IS NULL", None), *((t, p) for t, p, _ in rules)), 0) for v, rules in OASIS_VITALS.items()),
    S("urineoutput_score", (("urineoutput IS NULL", None), ("urineoutput < 671.09", 10), ("urineoutput > 6896.80", 8),
                            ("urineoutput >= 671.09 AND urineoutput <= 1426.99", 5), ("urineoutput >= 1427.00 AND urineoutput <= 2544.14", 1)), 0),
    S("mechvent_score", (("mechvent IS NULL", None), ("mechvent = 1", 9)), 0),
    S("electivesurgery_score", (("electivesurgery IS NULL", None), ("electivesurgery = 1", 0)), 6),
)
SAPS2 = (
    S("age_score", bands("age", ((40, 0), (60, 7), (70, 12), (75, 15), (80, 16)), 18)),
    S("hr_score", (("heartrate_max IS NULL", None), ("heartrate_min < 40", 11), ("heartrate_max >= 160", 7), ("heartrate_max >= 120", 4), ("heartrate_min < 70", 2),
                   ("heartrate_max >= 70 AND heartrate_max < 120 AND heartrate_min >= 70 AND heartrate_min < 120", 0))),
    S("sysbp_score", (("sysbp_min IS NULL", None), ("sysbp_min < 70", 13), ("sysbp_min < 100", 5), ("sysbp_max >= 200", 2),
                      ("sysbp_max >= 100 AND sysbp_max < 200 AND sysbp_min >= 100 AND sysbp_min < 200", 0))),
    S("temp_score", (("tempc_max IS NULL", None), ("tempc_max >= 39.0", 3), ("tempc_min < 39.0", 0))),
    S("pao2fio2_score", bands("pao2fio2_vent_min", ((100, 11), (200, 9)), 6)),
    S("uo_score", bands("urineoutput", ((500.0, 11), (1000.0, 4)), 0)),
    S("bun_score", bands("bun_max", ((28.0, 0), (84.0, 6)), 10)),
    S("wbc_score", (("wbc_max IS NULL", None), ("wbc_min < 1.0", 12), ("wbc_max >= 20.0", 3), ("wbc_max >= 1.0 AND wbc_max < 20.0 AND wbc_min >= 1.0 AND wbc_min < 20.0", 0))),
    S("potassium_score", (("potassium_max IS NULL", None), ("potassium_min < 3.0", 3), ("potassium_max >= 5.0", 3),
                          ("potassium_max >= 3.0 AND potassium_max < 5.0 AND potassium_min >= 3.0 AND potassium_min < 5.0", 0))),
    S("sodium_score", (("sodium_max IS NULL", None), ("sodium_min < 125", 5), ("sodium_max >= 145", 1),
                       ("sodium_max >= 125 AND sodium_max < 145 AND sodium_min >= 125 AND sodium_min < 145", 0))),
    S("bicarbonate_score", (("bicarbonate_max IS NULL", None), ("bicarbonate_min < 15.0", 6), ("bicarbonate_min < 20.0", 3), ("bicarbonate_max >= 20.0 AND bicarbonate_min >= 20.0", 0))),
    S("bilirubin_score", bands("bilirubin_max", ((4.0, 0), (6.0, 4)), 9)),
    S("gcs_score", (("mingcs IS NULL", None), ("mingcs < 3", None), ("mingcs < 6", 26), ("mingcs < 9", 13), ("mingcs < 11", 7), ("mingcs < 14", 5), ("mingcs >= 14 AND mingcs <= 15", 0))),
    S("comorbidity_score", (("aids = 1", 17), ("hem = 1", 10), ("mets = 1", 9)), 0),
    S("admissiontype_score", (("admissiontype = 'ScheduledSurgical'", 0), ("admissiontype = 'Medical'", 6), ("admissiontype = 'UnscheduledSurgical'", 8))),
)
# APS III: points by band of one value (limit, points) …, points past the last limit; used for the minimum and the maximum
APS_BANDS = {
    "hr": ("heart_rate", ((40, 8), (50, 5), (100, 0), (110, 1), (120, 5), (140, 7), (155, 13)), 17),
    "mbp": ("mbp", ((40, 23), (60, 15), (70, 7), (80, 6), (100, 0), (120, 4), (130, 7), (140, 9)), 10),
    "temp": ("temperature", ((33.0, 20), (33.5, 16), (34.0, 13), (35.0, 8), (36.0, 2), (40.0, 0)), 4),
    "resp_rate": ("resp_rate", ((6, 17), (12, 8), (14, 7), (25, 0), (35, 6), (40, 9), (50, 11)), 18),
    "hematocrit": ("hematocrit", ((41.0, 3), (50.0, 0)), 3),
    "wbc": ("wbc", ((1.0, 19), (3.0, 5), (20.0, 0), (25.0, 1)), 5),
    "creatinine": ("creatinine", ((0.5, 3), (1.5, 0), (1.95, 4)), 7),
    "bun": ("bun", ((17.0, 0), (20.0, 2), (40.0, 7), (80.0, 11)), 12),
    "sodium": ("sodium", ((120, 3), (135, 2), (155, 0)), 4),
    "albumin": ("albumin", ((2.0, 11), (2.5, 6), (4.5, 0)), 4),
    "bilirubin": ("bilirubin", ((2.0, 0), (3.0, 5), (5.0, 6), (8.0, 8)), 16),
    "glucose": ("glucose", ((40, 8), (60, 9), (200, 0), (350, 3)), 5),
}
# value regarded as normal; the extreme further from it decides. Components without one use the maximum.
APS_NORMAL = {"hr": 75, "mbp": 90, "temp": 38, "resp_rate": 19, "hematocrit": 45.5, "wbc": 11.5, "creatinine": 1, "sodium": 145.5, "albumin": 3.5, "glucose": 130}
APS_URINE = S("uo_score", bands("urineoutput", ((400, 15), (600, 8), (900, 7), (1500, 5), (2000, 4), (4000, 0)), 1))
# rows: eyes test, verbal values, motor values, points
APS_COMA = (
    ("= 1", (1,), (1, 2), 48), ("= 1", (1,), (3, 4), 33), ("= 1", (1,), (5, 6), 16), ("= 1", (2, 3), (1, 2), 29), ("= 1", (2, 3), (3, 4), 24),
    ("> 1", (1,), (1, 2), 29), ("> 1", (1,), (3, 4), 24), ("> 1", (1,), (5, 6), 15), ("> 1", (2, 3), (1, 2), 29), ("> 1", (2, 3), (3, 4), 24),
    ("> 1", (2, 3), (5,), 13), ("> 1", (2, 3), (6,), 10), ("> 1", (4,), (1, 2, 3, 4), 13), ("> 1", (4,), (5,), 8), ("> 1", (4,), (6,), 3),
    ("> 1", (5,), (1, 2, 3, 4, 5), 3), ("> 1", (5,), (6,), 0),
)
APS_GCS = S("gcs_score", (("gcs_unable = 1", 0), *(
    (f"gcs_eyes {e} AND gcs_verbal IN ({', '.join(map(str, v))}) AND gcs_motor IN ({', '.join(map(str, m))})", p) for e, v, m, p in APS_COMA)))
APS_OXYGEN = S("pao2_aado2_score", (
    ("pao2 IS NULL AND aado2 IS NULL", None), ("pao2 < 50", 15), ("pao2 < 70", 5), ("pao2 < 80", 2), ("pao2 IS NOT NULL", 0),
    ("aado2 < 100", 0), ("aado2 < 250", 7), ("aado2 < 350", 9), ("aado2 < 500", 11), ("aado2 >= 500", 14)), 0)
# acid-base: pH below the limit, then (carbon dioxide limit, points) …, points above
APS_ACID_BASE = (
    (7.20, ((50, 12),), 4), (7.30, ((30, 9), (40, 6), (50, 3)), 2), (7.35, ((30, 9), (45, 0)), 1), (7.45, ((30, 5), (45, 0)), 1),
    (7.50, ((30, 5), (35, 0), (45, 2)), 12), (7.60, ((40, 3),), 12), (None, ((25, 0), (40, 3)), 12),
)
APS_ACID = S("acidbase_score", tuple(
    rule for limit, steps, above in APS_ACID_BASE
    for rule in (*((f"{f'ph < {limit} AND ' if limit else ''}pco2 < {c}", p) for c, p in steps), (f"ph < {limit}" if limit else "ph IS NOT NULL", above))))
APS_PARTS = ("hr_score", "mbp_score", "temp_score", "resp_rate_score", "pao2_aado2_score", "hematocrit_score", "wbc_score", "creatinine_score",
             "uo_score", "bun_score", "sodium_score", "albumin_score", "bilirubin_score", "glucose_score", "acidbase_score", "gcs_score")
