"""Fixed values shared by the operators.

Everything here has to equal the published rule set for results to agree: tier weights,
source types, term lists, synonyms, message texts. Plain data, no logic.
"""

# ---- fixed values: evidence tiers -------------------------------------------------------
TIER_WEIGHTS = {1: 1.00, 2: 0.85, 3: 0.65, 4: 0.40, 5: 0.15}
DEFAULT_TIER_WEIGHT = 0.40
TIER_LABELS = {
    1: "Peer-Reviewed Research",
    2: "Clinical Protocol",
    3: "Educational Content",
    4: "Community Discussion",
    5: "Anecdotal",
}
DEFAULT_TIER = 3
SOURCE_TYPE_TIERS = {
    "pubmed": 1,
    "document": 2,
    "pdf": 2,
    "txt": 2,
    "md": 2,
    "website": 3,
    "youtube": 3,
    "skool_course": 3,
    "skool_community": 4,
    "forum": 4,
    "anecdotal": 5,
    "testimonial": 5,
    "unknown": 3,
}
TIER_ONE_NAMES = ["pubmed", "cochrane", "ncbi"]

# ---- fixed values: recency ---------------------------------------------------------------
RECENT_YEARS, RECENT_BOOST = 2, 1.00
MIDDLE_YEARS, MIDDLE_BOOST = 5, 0.90
OLD_BOOST = 0.75
UNKNOWN_DATE_BOOST = 1.00
DEFAULT_RELEVANCE = 0.5

# ---- fixed values: ingestion -------------------------------------------------------------
WINDOW_TOKENS = 512
WINDOW_OVERLAP = 50
PARAGRAPHS_PER_CHUNK = 4
SENTENCES_PER_CHUNK = 8
BOILERPLATE_TYPES = ["document", "website"]
PARAGRAPH_TYPES = ["forum", "skool_community"]
DOCUMENT_EXTENSIONS = ["pdf", "txt", "md"]
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
# registered source type -> (landing folder, list file)
URL_LISTS = {
    "website": ("websites", "urls.txt"),
    "blog": ("websites", "urls.txt"),
    "youtube": ("youtube", "video_ids.txt"),
    "forum": ("forums", "urls.txt"),
    "pubmed": ("pubmed", "pmids.txt"),
    "skool_courses": ("skool_courses", "course_urls.txt"),
    "skool_community": ("skool_community", "community_urls.txt"),
}
ABSTRACT_URL = "https://pubmed.ncbi.nlm.nih.gov/"
VIDEO_URL = "https://www.youtube.com/watch?v="

# ---- fixed values: term lists ------------------------------------------------------------
GROWTH_TERMS = [
    "bpc-157", "bpc157", "body protection compound",
    "tb-500", "tb500", "thymosin beta-4", "thymosin beta 4",
    "ghk-cu", "ghkcu", "copper peptide",
    "igf-1", "igf1", "insulin-like growth factor",
    "cjc-1295", "cjc1295",
    "ipamorelin",
    "ghrp-6", "ghrp6",
    "ghrp-2", "ghrp2",
    "hexarelin",
    "mk-677", "mk677", "ibutamoren",
    "sermorelin",
    "tesamorelin",
]
PREGNANCY_TERMS = [
    "pregnant", "pregnancy", "breastfeeding", "breast feeding",
    "nursing", "lactating", "lactation", "gestating", "gestation",
    "trimester", "prenatal", "postnatal", "postpartum",
]
ONCOLOGY_TERMS = [
    "cancer", "malignancy", "malignant", "tumour", "tumor",
    "carcinoma", "sarcoma", "lymphoma", "leukaemia", "leukemia",
    "melanoma", "oncology", "oncologist", "metastasis", "metastatic",
    "neoplasm",
]

# ---- fixed values: entity names (canonical -> synonyms) ----------------------------------
SYNONYMS = {
    "BPC-157": ["bpc157", "body protection compound", "pentadecapeptide bpc-157", "pnc-27"],
    "TB-500": ["tb500", "thymosin beta-4", "thymosin beta4", "thymosin β-4", "tβ4"],
    "GHK-Cu": ["ghkcu", "copper peptide", "glycyl-l-histidyl-l-lysine", "ghk copper"],
    "IGF-1": ["igf1", "insulin-like growth factor 1", "insulin-like growth factor-1", "somatomedin c"],
    "CJC-1295": ["cjc1295", "cjc 1295", "dac:grf"],
    "Ipamorelin": ["ipamorelin acetate"],
    "GHRP-6": ["ghrp6", "growth hormone releasing peptide 6", "ghrp 6"],
    "GHRP-2": ["ghrp2", "growth hormone releasing peptide 2", "ghrp 2", "pralmorelin"],
    "Hexarelin": ["examorelin"],
    "MK-677": ["mk677", "ibutamoren", "ibutamoren mesylate", "mk 677"],
    "Sermorelin": ["sermorelin acetate", "geref"],
    "Tesamorelin": ["tesamorelin acetate", "egrifta"],
    "PT-141": ["pt141", "bremelanotide"],
    "Melanotan-II": ["melanotan 2", "melanotan2", "mt-ii", "mt2"],
    "Selank": ["selanke", "tp-7"],
    "Semax": ["pro-gly-pro"],
    "Epithalon": ["epithalone", "epitalon", "tetrapeptide-2"],
    "LL-37": ["ll37", "cathelicidin", "camp"],
    "SS-31": ["ss31", "d-arg-dmt-lys-phe-nh2", "szeto-schiller peptide"],
    "Kisspeptin": ["kisspeptin-10", "metastin"],
    "Dihexa": ["dihexa peptide", "pnb-0408"],
}
RELATIONS = [
    "TREATS", "CONTRAINDICATED_WITH", "INTERACTS_WITH", "STUDIED_IN", "DOSAGE_FOR",
    "MECHANISM_OF", "ASSOCIATED_WITH", "UPREGULATES", "DOWNREGULATES", "PROMOTES", "INHIBITS",
]
CONTRAINDICATION = "CONTRAINDICATED_WITH"
TRIPLE_CONFIDENCE_FLOOR = 0.4

# ---- fixed values: safety rules ----------------------------------------------------------
# code -> (severity, message, rationale); %d in SR-004 is the medication count
SAFETY_RULES = {
    "SR-001": (
        "critical",
        "Pregnancy or breastfeeding context detected. "
        "Peptide use is contraindicated until safety in pregnancy is established.",
        "Safety profiles for most research peptides in pregnancy and lactation "
        "are unknown. No adequate well-controlled studies exist. The theoretical "
        "risk to the fetus/neonate cannot be excluded.",
    ),
    "SR-002": (
        "warning",
        "Oncology history detected with growth-signaling peptide context. "
        "Oncologist consultation required before initiating any growth-signaling peptide.",
        "Growth-signaling peptides (including IGF-1 pathway agonists, GHRPs, "
        "and tissue-repair peptides) carry a theoretical risk of promoting "
        "cancer cell proliferation. Evidence is limited but the risk cannot "
        "be excluded in patients with active or historical malignancy.",
    ),
    "SR-003": (
        "info",
        "No baseline laboratory values provided. "
        "Consider obtaining baseline labs before initiating a peptide protocol.",
        "Recommended baseline labs for peptide prescribing include: "
        "IGF-1, IGFBP-3, fasting insulin, HbA1c, LFTs, full blood count, "
        "and relevant hormone panels. Baseline values enable safe monitoring.",
    ),
    "SR-004": (
        "info",
        "Patient is on %d medications. "
        "Peptide-drug interaction data is limited — pharmacist review recommended.",
        "Published peptide-drug interaction data is sparse. Polypharmacy "
        "increases the risk of unknown interactions, particularly with "
        "insulin-sensitising agents, GH-axis medications, and anticoagulants.",
    ),
}
POLYPHARMACY_COUNT = 3
PRIVILEGED_ROLES = ["clinician", "admin"]
# condition -> severity for growth-signalling peptides
CONDITION_SEVERITY = {
    "active malignancy": "critical",
    "pregnancy": "critical",
    "breastfeeding": "critical",
    "proliferative diabetic retinopathy": "warning",
    "history of malignancy < 5yr": "warning",
    "pre-diabetes / t2dm uncontrolled": "info",
}

# ---- fixed values: answer texts ----------------------------------------------------------
NO_CONTEXT = "No relevant sources retrieved."
NO_EVIDENCE = "No evidence sources retrieved"
# {product} is the name shown to the reader
DISCLAIMER = (
    "This response is generated by {product}, a clinical decision support tool. "
    "It does not constitute medical advice, diagnosis, or treatment. "
    "All information must be reviewed and validated by a qualified healthcare professional "
    "before clinical application."
)
CRITICAL_NOTICE = (
    "⚠️ IMPORTANT SAFETY NOTICE: This query has triggered one or more critical safety flags. "
    "The information below must NOT be used to guide clinical decisions without specialist consultation. "
)
EXCERPT_CHARS = 300
SNIPPET_CHARS = 200
CONFIDENCE_LABELS = [(0.70, "high"), (0.45, "medium"), (0.20, "low")]
COVERAGE_FACTORS = [(5, 1.00), (3, 0.85), (1, 0.70)]

# ---- fixed values: audit -----------------------------------------------------------------
MAX_EVENT_PAGE = 500
MAX_JOB_PAGE = 200
IP_HASH_CHARS = 24
QUERY_HASH_CHARS = 16
RETENTION_DAYS = 90
ALERT_ERROR_RATE = 0.01
ALERT_P99_MS = 5000.0

# ---- fixed values: texts of the prompt and of the answer given without a model --------------
PROMPT_QUERY = "Clinical Query: "
PROMPT_PATIENT = "\n\nPatient Context (de-identified):\n  Age range: "
PROMPT_INDICATIONS = "\n  Indications: "
PROMPT_CONTRAINDICATIONS = "\n  Contraindications: "
PROMPT_EVIDENCE = "\n\nEvidence Context:\n"
OFFLINE_QUERY = "**Query:** "
OFFLINE_NOTE = ("\n\n**Note:** LLM synthesis is currently unavailable. "
                "The following evidence was retrieved:\n\n")
OFFLINE_END = "\n\nPlease review the cited sources directly."
