"""Fixed values.

Word lists, lookup tables, thresholds, patterns and text formats that results
depend on. They are data, stated plainly and in their natural order.
"""

# --- text ---------------------------------------------------------------

# fixed values: words left out of the keyword index
STOP_WORDS = ["the", "and", "for", "with", "this", "that", "from", "shall", "should", "must", "may"]

# fixed values: chunk sizes
MAX_CHUNK_TOKENS = 800
OVERLAP_TOKENS = 100
TOKENS_PER_WORD = 1.3
MAX_CHUNK_CHARS = 1500
TABLE_TEXT_MAX_LINES = 20
PREAMBLE_TITLE = "Preamble"

# fixed values: kinds of chunk content; the first is the fallback
CONTENT_TYPES = ["design_rule", "section_overview", "table", "equation", "definition", "figure"]

# --- query routing ------------------------------------------------------

# fixed values: query type words, by type
DESIGN_TERMS = [
    "how to design", "design procedure", "steps for", "design process", "design guide", "calculate", "procedure for",
    "如何設計", "設計方法", "設計步驟", "設計程序", "計算",
]
DEFINITION_TERMS = [
    "what is", "define", "meaning of", "definition of", "what are",
    "什麼是", "定義", "含義", "說明",
]
DATA_TERMS = [
    "table", "value", "coefficient", "parameter", "factor", "list of", "range of", "typical",
    "表格", "數值", "係數", "參數", "值",
]

# fixed values: engineering elements and the words that name them
ELEMENT_TERMS = {
    "beam": ["beam", "梁", "flexure", "bending", "鋼筋混凝土梁"],
    "column": ["column", "柱", "axial", "compression", "鋼筋混凝土柱"],
    "pile": ["pile", "樁", "deep foundation", "shaft", "基樁", "打樁"],
    "foundation": ["foundation", "footing", "基礎", "基底", "shallow"],
    "retaining": ["retaining", "wall", "earth pressure", "擋土牆", "擋土結構"],
    "slope": ["slope", "stability", "inclination", "邊坡", "山坡"],
    "shear": ["shear", "v_u", "v_c", "剪切", "剪力"],
    "settlement": ["settlement", "consolidation", "deflection", "沉降", "變形"],
}

# fixed values: actions and the words that name them
ACTION_TERMS = {
    "design": ["design", "sizing", "select"],
    "calculate": ["calculate", "compute", "determine", "find"],
    "check": ["check", "verify", "validate"],
    "select": ["choose", "select", "pick"],
}

# fixed values: synonyms for query expansion, in use order
SYNONYMS = {
    "bearing": ["capacity", "resistance", "foundation"],
    "capacity": ["bearing", "resistance", "load"],
    "shear": ["strength", "resistance", "failure"],
    "settlement": ["displacement", "deflection", "subsidence"],
    "slope": ["incline", "gradient", "embankment"],
    "stability": ["factor", "safety", "FoS"],
    "cohesion": ["c", "undrained", "clay"],
    "friction": ["angle", "phi", "φ", "sand"],
    "groundwater": ["water", "table", "GWL", "phreatic"],
    "retaining": ["wall", "structure", "support"],
    "excavation": ["digging", "cut", "trench"],
    "pile": ["deep", "foundation", "shaft"],
    "shallow": ["footing", "pad", "raft", "mat"],
}
SYNONYMS_PER_TERM = 2
MAX_EXPANSIONS = 3

# fixed values: suffix of an equation query
EQUATION_SUFFIX = " equation formula design check criterion Mpl Rd Ft Rd Fb Rd V Ed V Rd resistance capacity"

# fixed values: caption of a table without one
UNTITLED_TABLE = "Untitled Table"

# fixed values: text put before a query when it is embedded
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "

# fixed values: retrieval weights and limits
SEMANTIC_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3
RECIPROCAL_RANK_OFFSET = 60
SCORE_THRESHOLD = 0.3
EQUATION_TOP_K = 12
REFERENCE_SCORE = 0.8
MERGE_KEY_CHARS = 160
FOLLOW_UP_ANSWER_CHARS = 500

# fixed values: closing text of an assembled context
CITATION_RULES = """
## Citation Rules (STRICT)
1. **Primary Source:** If information comes from a [PRIMARY] block, cite: [Clause X.Y.Z, p. XX]
2. **Referenced Source:** If information comes from a [REFERENCED] block, cite the **Source Clause** listed in the header, NOT the clause that referenced it.
   - Example: If Table 6.1 is in Clause 6.1.1 but referenced by 6.1.2, cite [Table 6.1, Clause 6.1.1, p. 37].
3. **Equations:** Include Equation ID if available.
4. **Verification:** All claims must be traceable to the provided Clause IDs and Page Numbers.
"""

# --- citations ----------------------------------------------------------

# fixed values: the five citation forms, most specific first
CITATION_FORMS = {
    "full": r"(?i)\[Source:\s*([^,\]]+),\s*(?:Section/Clause|Section|Clause):\s*([^\],]+),\s*Page:\s*(\d+)\]",
    "short": r"(?i)\[Source:\s*([^,\]]+),\s*(?:Section/Clause|Section|Clause):\s*([^\]]+)\]",
    "parenthetical": r"(?i)\(([^,，]+)[,，]\s*(?:Clause|Section)\s*(\d+(?:\.\d+)*)\)",
    "according_to": r"(?i)(?:According to|See|Refer to)\s+(?:Clause|Section)\s*(\d+(?:\.\d+)*)\s+(?:of\s+)?([^,.]+)",
    "standalone": r"(?i)Clause\s+(\d+(?:\.\d+)+)",
}
UNKNOWN_DOCUMENT = "Unknown"

# fixed values: document name abbreviations
DOCUMENT_ABBREVIATIONS = {
    "hk cop": "hk code of practice",
    "cop": "code of practice",
    "ec7": "eurocode 7",
    "bs en 1997": "eurocode 7",
}

# fixed values: citation confidence by kind of match
CONFIDENCE_DOCUMENT_AND_CLAUSE = 0.95
CONFIDENCE_DOCUMENT_AND_SECTION = 0.8
CONFIDENCE_DOCUMENT = 0.5
CONFIDENCE_CLAUSE = 0.4
VERIFIED_FROM = 0.8
HALLUCINATED_TO = 0.3

# --- report rules -------------------------------------------------------

# fixed values: factor of safety rules
FOS_RULES = [
    {
        "rule_id": "fos_bearinging", "name": "Bearing Capacity Factor of Safety", "reference": "HK CoP 2017 Section 6.1.5",
        "label": "Bearing capacity FoS", "missing": "No bearing capacity factor of safety found in report", "minimum": 3.0,
        "patterns": [
            r"(?:bearing\s*(?:capacity)?)\s*(?:factor\s*of\s*safety|fos|f\.?o\.?s\.?)\s*(?:=|is|of)\s*([\d.]+)",
            r"(?:factor\s*of\s*safety|fos)\s*(?:for\s*)?(?:bearing)\s*(?:=|:)\s*([\d.]+)",
            r"FoS\s*(?:for\s*bearing|bearing)\s*=\s*([\d.]+)",
        ],
    },
    {
        "rule_id": "fos_sliding", "name": "Sliding Factor of Safety", "reference": "HK CoP 2017 Section 6.4",
        "label": "Sliding FoS", "missing": "No sliding factor of safety found", "minimum": 1.5,
        "patterns": [
            r"(?:sliding)\s*(?:factor\s*of\s*safety|fos)\s*(?:=|is|of)\s*([\d.]+)",
            r"(?:factor\s*of\s*safety|fos)\s*(?:against\s*)?(?:sliding)\s*(?:=|:)\s*([\d.]+)",
        ],
    },
    {
        "rule_id": "fos_overturning", "name": "Overturning Factor of Safety", "reference": "HK CoP 2017 Section 6.4",
        "label": "Overturning FoS", "missing": "No overturning factor of safety found", "minimum": 2.0,
        "patterns": [
            r"(?:overturning)\s*(?:factor\s*of\s*safety|fos)\s*(?:=|is|of)\s*([\d.]+)",
            r"(?:factor\s*of\s*safety|fos)\s*(?:against\s*)?(?:overturning)\s*(?:=|:)\s*([\d.]+)",
        ],
    },
    {
        "rule_id": "fos_slope", "name": "Slope Stability Factor of Safety", "reference": "Geotechnical Manual for Slopes",
        "label": "Slope FoS", "missing": "No slope stability factor of safety found", "minimum": 1.4,
        "patterns": [
            r"(?:slope)\s*(?:stability)?\s*(?:factor\s*of\s*safety|fos)\s*(?:=|is|of)\s*([\d.]+)",
            r"(?:factor\s*of\s*safety|fos)\s*(?:for\s*)?(?:slope)\s*(?:=|:)\s*([\d.]+)",
        ],
    },
]

# fixed values: required section rules
SECTION_RULES = [
    {
        "rule_id": "section_intro", "name": "Introduction Section", "severity": "medium",
        "found": "Introduction section found", "missing": "No introduction section found",
        "patterns": [r"#+\s*(?:1\.?)?\s*introduction", r"#+\s*project\s*(?:background|overview)"],
    },
    {
        "rule_id": "section_gi", "name": "Ground Investigation Section", "severity": "high",
        "found": "Ground investigation section found", "missing": "No ground investigation section found",
        "patterns": [
            r"#+\s*(?:ground\s*investigation|site\s*investigation|GI)",
            r"#+\s*(?:borehole|field\s*work|laboratory\s*testing)",
        ],
    },
    {
        "rule_id": "section_analysis", "name": "Analysis and Design Section", "severity": "high",
        "found": "Analysis and design section found", "missing": "No analysis and design section found",
        "patterns": [
            r"#+\s*(?:analysis\s*(?:and)?\s*design|design\s*(?:analysis)?|calculations)",
            r"#+\s*(?:foundation\s*design|bearing\s*capacity|slope\s*stability)",
        ],
    },
]

# fixed values: parameter range rules
RANGE_RULES = [
    {
        "rule_id": "param_cohesion_range", "name": "Cohesion Value Range", "low": 0.0, "high": 500.0,
        "none": "No cohesion values to check", "outside": "Cohesion values out of range (0-500 kPa): ",
        "inside": "All cohesion values in reasonable range: ",
        "patterns": [
            r"cohesion\s*(?:=|:|of)\s*([\d.]+)\s*(?:kpa|kpa)?",
            r"c\s*(?:=|:)\s*([\d.]+)\s*(?:kpa|kpa)?",
            r"([\d.]+)\s*kpa\s*cohesion",
        ],
    },
    {
        "rule_id": "param_friction_range", "name": "Friction Angle Range", "low": 0.0, "high": 50.0,
        "none": "No friction angle values to check", "outside": "Friction angles out of range (0-50°): ",
        "inside": "All friction angles in reasonable range: ",
        "patterns": [
            r"(?:friction\s*angle|phi)\s*(?:=|:|of)\s*([\d.]+)\s*(?:degrees|deg|°)?",
            r"φ\s*(?:=|:)\s*([\d.]+)",
            r"([\d.]+)\s*(?:degrees|deg|°)\s*(?:friction|friction\s*angle)",
        ],
    },
]

# fixed values: required information rules
PROJECT_NAME_PATTERNS = [
    r"#+\s*(?:project\s*name|project\s*title)\s*[:\s]*(.+)",
    r"project\s*(?:name|title)\s*[:\s]+([A-Za-z][^\n]+)",
]
PROJECT_NAME_SHOWN_CHARS = 50
REPORT_DATE_PATTERNS = [
    r"(?:date|dated)\s*[:\s]+(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
    r"(?:date|dated)\s*[:\s]+(\w+\s+\d{1,2},?\s+\d{4})",
    r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
]
AUTHOR_PATTERNS = [
    r"(?:prepared\s*by|author|company|firm)\s*[:\s]+([^\n]+)",
    r"(?:limited|ltd|llc|engineers|consultants)",
    r"(?:P\.?E\.?|C\.?Eng|FICE|MICE)",
]
MIN_REPORT_CHARS = 200

# fixed values: sections of a standard report (number, title, required)
REPORT_SECTIONS = [
    ("1", "Introduction", True),
    ("2", "Site Description", True),
    ("3", "Ground Investigation", True),
    ("4", "Geotechnical Conditions", True),
    ("5", "Analysis and Design", True),
    ("6", "Recommendations", True),
    ("7", "Construction Considerations", True),
    ("8", "References", True),
    ("Appendix A", "Borehole Logs and Test Results", True),
    ("Appendix B", "Design Calculations", True),
    ("Appendix C", "Drawings", False),
]

# --- programme controls -------------------------------------------------

# fixed values: weather by month (month, rain days, low, high, name)
MONTH_WEATHER = [
    (1, 8, -5, 5, "January"),
    (2, 7, -3, 8, "February"),
    (3, 9, 2, 12, "March"),
    (4, 10, 5, 15, "April"),
    (5, 11, 10, 20, "May"),
    (6, 12, 15, 25, "June"),
    (7, 10, 18, 28, "July"),
    (8, 9, 17, 27, "August"),
    (9, 8, 14, 23, "September"),
    (10, 9, 8, 18, "October"),
    (11, 8, 3, 12, "November"),
    (12, 7, -2, 6, "December"),
]
DEFAULT_RAIN_DAYS = 5

# fixed values: task words of the delay and weather risk scores
DELAY_OUTDOOR_WORDS = [
    "excavation", "concrete", "steel", "roofing", "exterior", "paving", "grading", "site work", "earthwork", "foundation",
    "drainage", "utility", "landscape", "asphalt",
]
WEATHER_SENSITIVE_WORDS = ["concrete", "excavation", "roofing", "paving", "asphalt", "painting", "waterproofing"]
WEATHER_OUTDOOR_WORDS = [
    "excavation", "concrete", "steel", "roofing", "exterior", "paving", "grading", "site work", "earthwork", "foundation",
    "drainage", "utility", "landscape", "asphalt", "curb", "sidewalk", "parking", "deck", "canopy", "fence",
]

# fixed values: photo words by activity prefix
PHOTO_WORDS = {
    "1000": ["mobilization", "site office", "fence", "setup"],
    "2000": ["excavation", "digging", "earthwork", "grading"],
    "2020": ["foundation", "footing", "concrete", "pad"],
    "3000": ["steel", "column", "beam", "structure", "frame"],
    "4000": ["wall", "panel", "enclosure", "brick", "block"],
    "5000": ["roofing", "roof", "roofing"],
    "6000": ["mechanical", "mep", "hvac", "plumbing", "electrical"],
    "7000": ["interior", "drywall", "paint", "finish"],
    "8000": ["paving", "parking", "landscape", "exterior"],
}
PHOTO_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp"]

# fixed values: claim texts (words in the cause, eligibility, claim type), first match wins
CLAIM_KINDS = [
    (["owner", "design"], "High", "EOT (Extension of Time)"),
    (["force majeure", "weather"], "Medium-High", "EOT + Acceleration Costs"),
    (["contractor"], "Low", "None - Contractor responsible"),
]
CLAIM_OTHER = ("Medium", "EOT Review Required")
CLAIM_ACTIONS = {
    "no_impact": "Monitor for cumulative impact. No immediate action required.",
    "High": "Submit time extension request with CPM analysis immediately. Document all impacts.",
    "High, no critical task": "Prepare EOT documentation. Impact may be absorbed by float.",
    "Medium-High": "Document delay with daily logs and weather records. Prepare contingency claim.",
    "Medium": "Review contract terms for notification requirements. File preliminary notice.",
    "other": "Accelerate to recover schedule. No delay claim available.",
}

# --- design cases -------------------------------------------------------

# fixed values: unit weight of water and undrained bearing factor
WATER_UNIT_WEIGHT = 9.81
UNDRAINED_NC = 5.14

# fixed values: partial factors of the two design combinations
# (combination, cohesion, friction, permanent load, variable load, resistance)
EC7_COMBINATIONS = [
    ("Combination_1", 1.0, 1.0, 1.35, 1.5, 1.0),
    ("Combination_2", 1.25, 1.25, 1.0, 1.3, 1.0),
]

# fixed values: calculations by project type
PROJECT_SKILLS = {
    "building": ["shallow_bearing_capacity"],
    "slope": ["slope_stability_infinite"],
    "retaining_wall": ["retaining_wall_stability", "earth_pressure_rankine"],
    "excavation": ["earth_pressure_rankine"],
    "pile": ["pile_axial_capacity"],
    "deep_foundation": ["pile_axial_capacity"],
    "caisson": ["pile_axial_capacity"],
}
DEFAULT_SKILLS = ["shallow_bearing_capacity"]
MAX_PENDING_QUESTIONS = 8

# fixed values: the calculation catalogue; inputs are (name, unit, required)
SKILLS = [
    {
        "skill_id": "shallow_bearing_capacity", "name": "Shallow Foundation Bearing Capacity Assessment",
        "category": "foundations", "codes": ["cop_foundations_2017", "geoguide_1", "bs_en_1997_1"],
        "report_sections": ["5_analysis_and_design", "6_recommendations"],
        "acceptance": ["FoS >= 3.0", "EC7 utilisation <= 1.0"],
        "inputs": [
            ("soil_cohesion_kpa", "kPa", True), ("soil_friction_angle_deg", "degrees", True),
            ("soil_unit_weight", "kN/m³", True), ("foundation_width", "m", True), ("foundation_length", "m", True),
            ("foundation_depth", "m", True), ("gwl_depth", "m", False), ("factor_of_safety", "-", False),
            ("design_code", "", False),
        ],
    },
    {
        "skill_id": "slope_stability_infinite", "name": "Infinite Slope Stability Analysis",
        "category": "slopes", "codes": ["geo_manual_slopes", "geoguide_1"],
        "report_sections": ["5_analysis_and_design", "6_recommendations"],
        "acceptance": ["FoS >= 1.4"],
        "inputs": [
            ("slope_angle_deg", "degrees", True), ("friction_angle_deg", "degrees", True), ("cohesion_kpa", "kPa", True),
            ("unit_weight", "kN/m³", True), ("depth_to_slip_m", "m", True), ("gwl_above_slip_m", "m", False),
            ("required_fos", "", False),
        ],
    },
    {
        "skill_id": "earth_pressure_rankine", "name": "Earth Pressure Calculation (Rankine)",
        "category": "retaining_walls", "codes": ["geoguide_1", "bs_8002", "bs_en_1997_1"],
        "report_sections": ["5_analysis_and_design"],
        "acceptance": ["Sliding FoS >= 1.5", "Overturning FoS >= 2.0"],
        "inputs": [
            ("wall_height_m", "m", True), ("backfill_friction_angle_deg", "degrees", True),
            ("backfill_cohesion_kpa", "kPa", False), ("backfill_unit_weight", "kN/m³", True), ("surcharge_kpa", "kPa", False),
        ],
    },
    {
        "skill_id": "pile_axial_capacity", "name": "Pile Foundation Axial Capacity",
        "category": "deep_foundations", "codes": ["cop_foundations_2017", "geoguide_2", "bs_en_1997_1"],
        "report_sections": ["5_analysis_and_design", "6_recommendations"],
        "acceptance": ["FoS >= 2.5", "Shaft + End bearing capacity verified"],
        "inputs": [
            ("pile_diameter_m", "m", True), ("pile_length_m", "m", True), ("soil_cohesion_kpa", "kPa", True),
            ("soil_friction_angle_deg", "degrees", True), ("soil_unit_weight_kn_m3", "kN/m3", True),
            ("groundwater_depth_m", "m", False), ("factor_of_safety", "-", False),
        ],
    },
    {
        "skill_id": "retaining_wall_stability", "name": "Cantilever Retaining Wall Stability",
        "category": "retaining_walls", "codes": ["geoguide_1", "bs_8002", "bs_en_1997_1"],
        "report_sections": ["5_analysis_and_design", "6_recommendations"],
        "acceptance": ["Sliding FoS >= 1.5", "Overturning FoS >= 2.0", "Bearing FoS >= 3.0"],
        "inputs": [
            ("wall_height_m", "m", True), ("base_width_m", "m", True), ("toe_length_m", "m", False),
            ("stem_thickness_m", "m", False), ("base_thickness_m", "m", False), ("backfill_unit_weight_kn_m3", "kN/m3", False),
            ("backfill_friction_angle_deg", "degrees", True), ("backfill_surcharge_kpa", "kPa", False),
            ("foundation_cohesion_kpa", "kPa", False), ("foundation_friction_angle_deg", "degrees", False),
        ],
    },
]

# fixed values: where a parameter is looked up when it is not given
GEOMETRY_ALIASES = {
    "foundation_width": "width_m",
    "foundation_length": "length_m",
    "foundation_depth": "depth_m",
    "wall_height_m": "height_m",
    "slope_angle_deg": "slope_angle_deg",
}
SOIL_ALIASES = {
    "soil_cohesion_kpa": "cohesion_kpa",
    "soil_friction_angle_deg": "friction_angle_deg",
    "soil_unit_weight": "unit_weight_kn_m3",
    "cohesion_kpa": "cohesion_kpa",
    "friction_angle_deg": "friction_angle_deg",
    "unit_weight": "unit_weight_kn_m3",
    "backfill_friction_angle_deg": "friction_angle_deg",
    "backfill_unit_weight": "unit_weight_kn_m3",
}

# --- usage --------------------------------------------------------------

# fixed values: cache key prefixes and lifetimes in seconds
CACHE_PREFIXES = {"embedding": "embedding:", "answer": "llm:", "search": "search:"}
CACHE_TTL_SECONDS = {"embedding": 7 * 86400, "answer": 30 * 86400, "search": 3600}


# fixed value: how the details of a rule that failed to run begin
RULE_ERROR = "Check failed: "

# --- reports ------------------------------------------------------------

# fixed values: closing lists of the reports, and what they say when there is nothing to list
DELAY_REPORT_ADVICE = [
    "1. Prioritize monitoring HIGH risk activities",
    "2. Review critical path tasks for schedule contingencies",
    "3. Plan weather-sensitive work during favorable conditions",
    "4. Ensure predecessor activities are on track",
    "5. Allocate resources to at-risk activities early",
]
WEATHER_REPORT_ADVICE = [
    "1. Review high-risk activities for weather contingency plans",
    "2. Consider rescheduling critical outdoor activities to lower-risk months",
    "3. Ensure material delivery schedules account for weather delays",
    "4. Document weather conditions daily for potential delay claims",
]
CLAIM_REPORT_DOCUMENTS = [
    "  1. Detailed delay event logs with dates and times",
    "  2. Updated CPM schedule showing impact",
    "  3. Correspondence related to the delay",
    "  4. Photographic evidence of conditions",
    "  5. Resource allocation records during delay period",
    "  6. Cost records for any acceleration efforts",
]
COORDINATION_ACTIONS = [
    "  1. Schedule pre-handoff meetings 1 week before each date",
    "  2. Verify work completion certificates before handoff",
    "  3. Document site conditions with photos at transfer",
    "  4. Review interface details between trades",
]
NO_TASK_AT_RISK = "No incomplete tasks to analyze."
NO_UPCOMING_TASK = "No upcoming activities in the specified period."
NO_TASK_THIS_WEEK = "  No activities scheduled this week."
NO_HANDOFF = "  No significant handoffs identified in the next 7 days."
NO_PHOTO = "No photos matched to activities. Ensure photos have descriptive filenames."
