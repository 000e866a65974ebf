"""Fixed values. Names, code lists and lookups that the published indicators are defined by; all are plain data and
can be replaced through the arguments of the jobs."""

# ---- fixed values: entities ----
FIELD = ["BLM", "BOR", "DHS", "NPS", "NRCS", "State", "USACE", "USFS", "USFWS"]
REGULATORY = ["DOL", "DOT", "EPA"]
RESEARCH = ["NASA", "NIH", "NOAA", "USGS"]
CATEGORIES = {"Field": FIELD, "Regulatory": REGULATORY, "Research": RESEARCH}

ENVIRONMENTAL = ["BLM", "USGS", "USFS", "USFWS", "BOR", "NOAA", "EPA", "NPS", "NRCS", "USACE"]
BENCHMARK = ["NASA", "State", "DOT", "DHS", "DOL", "NIH"]
AGENCY_FLAGS = {"Environmental Agency": ENVIRONMENTAL, "Benchmark Agency": BENCHMARK}
OTHER_AGENCY = "Other Agency"

# ---- fixed values: challenges ----
CHALLENGE_ENTITY_RULES = [
    ("department", "National Aeronautics and Space Administration", "NASA"),
    ("department", "Department of State", "State"),
    ("department", "Department of Transportation", "DOT"),
    ("department", "Department of Homeland Security", "DHS"),
    ("department", "Department of Labor", "DOL"),
    ("department", "Environmental Protection Agency", "EPA"),
    ("sub_agency", "National Institutes of Health", "NIH"),
    ("sub_agency", "National Park Service", "NPS"),
    ("sub_agency", "United States Fish and Wildlife Service", "USFWS"),
    ("sub_agency", "Bureau of Reclamation", "BOR"),
    ("sub_agency", "National Oceanic and Atmospheric Administration", "NOAA"),
    ("sub_agency", "United States Geological Survey", "USGS"),
    ("sub_agency", "Bureau of Land Management", "BLM"),
    ("sub_agency", "Army Corps of Engineers", "USACE"),
    ("sub_agency", "United States Forest Service", "USFS"),
]
TECH_CHALLENGE = "Analysis, Tech Software"
CHALLENGE_TYPES = {
    "Analysis, Tech Software": [
        "Analytics, visualizations, algorithms", "Technology demonstration and hardware", "Software and apps"],
    "Creative": ["Creative (multimedia & design)"],
    "Ideas, Plans, Nominations": ["Ideas", "Business plans", "Nominations"],
    "Scientific": ["Scientific"],
}
YEARLY_CHALLENGE_TYPES = {
    "Analytics, Tech, Software": [
        "Software and apps", "Technology demonstration and hardware", "Analytics, visualizations, algorithms"],
    "Ideas, Plans, Nominations": ["Ideas", "Business plans", "Nominations"],
    "Creative": ["Creative (multimedia & design)"],
}
ENVIRONMENTAL_NAME_PARTS = [
    "Department of the Interior", "Department of Agriculture", "Environmental Protection Agency",
    "National Oceanic and Atmospheric Administration", "Army Corps",
]
ENVIRONMENTAL_GROUP = "Environmental / Natural Resource Agencies"
OTHER_GROUP = "All Other Agencies"

# ---- fixed values: staffing ----
TECH_JOBS = ["1550", "2210", "1515", "0854"]
ANALYST_JOBS = ["1560", "1370", "0150", "1530", "1529"]
TECH_TALENT_JOBS = ["1560", "1550", "2210", "2200", "1515", "0854"]
NOT_STEM_CODES = ["XXXX", "****"]
BUREAU_RULES = [
    ("agysubt", "AG11-FOREST SERVICE", "USFS"),
    ("agysubt", "AG16-NATURAL RESOURCES CONSERVATION SERVICE", "NRCS"),
    ("agysubt", "IN15-U.S. FISH AND WILDLIFE SERVICE", "USFWS"),
    ("agysubt", "IN08-GEOLOGICAL SURVEY", "USGS"),
    ("agysubt", "IN07-BUREAU OF RECLAMATION", "BOR"),
    ("agysubt", "IN05-BUREAU OF LAND MANAGEMENT", "BLM"),
    ("agysubt", "IN10-NATIONAL PARK SERVICE", "NPS"),
    ("agysubt", "EP00-ENVIRONMENTAL PROTECTION AGENCY", "EPA"),
    ("agysubt", "ARCE-U.S. ARMY CORPS OF ENGINEERS", "USACE"),
    ("agysubt", "CM54-NATIONAL OCEANIC AND ATMOSPHERIC ADMINISTRATION", "NOAA"),
]
BENCHMARK_RULES = [
    ("agyt", "NN-NATIONAL AERONAUTICS AND SPACE ADMINISTRATION", "NASA"),
    ("agyt", "TD-DEPARTMENT OF TRANSPORTATION", "DOT"),
    ("agyt", "DL-DEPARTMENT OF LABOR", "DOL"),
    ("agyt", "HS-DEPARTMENT OF HOMELAND SECURITY", "DHS"),
    ("agysubt", "HE38-NATIONAL INSTITUTES OF HEALTH", "NIH"),
    ("agysubt", "ST00-DEPARTMENT OF STATE", "State"),
]
GRADE_CROSSWALK = {
    "GS-04": ["DB-01"],
    "GS-06": ["ZP-01", "DJ-01"],
    "GS-09": ["ZP-02", "DJ-02"],
    "GS-12": ["ZP-03", "DJ-03", "DB-02", "GG-12"],
    "GS-13": ["GM-13", "GG-13"],
    "GS-14": ["ZP-04", "DJ-04", "DB-03", "GM-14"],
    "GS-15": ["ZP-05", "DJ-05", "SL-00", "ES-**", "DB-04", "DB-05", "DB-06", "GM-15"],
}
GRADE_BANDS = {
    "GS 04-09": ["GS-04", "GS-05", "GS-06", "GS-07", "GS-09"],
    "GS 11-15": ["GS-11", "GS-12", "GS-13", "GS-14", "GS-15"],
}

# ---- fixed values: hiring ----
IT_SERIES = ["1550", "2210", "1515", "0853"]
KEYWORDS = {
    "data": "Data", "tech": "Tech", "software": "Soft", "programming": "Programming", "prod_manager": "Product",
    "steward": "Steward", "innov": "Innovation", "gis": "Geospatial",
}
FOCUS_KEYWORDS = ["gis", "innov", "programming"]
MISSION_CRITICAL_LABELS = {
    "01": "Cyber Secruity", "02": "Data Scientist", "03": "Economist", "04": "Privacy",
    "05": "Program/Project Management", "06": "Grants Management", "07": "STEM", "08": "Intelligence", "09": "COVID",
    "10": "Infrastructure Act",
}
OPENING_WORDS = {"Few": 2, "Many": 3}
POSTING_ENTITY_RULES = [
    ("subagency", "U.S. Army Corps Of Engineers", "USACE"),
    ("subagency", "Environmental Protection Agency", "EPA"),
    ("subagency", "Natural Resources Conservation Service", "NRCS"),
    ("subagency", "Forest Service", "USFS"),
    ("subagency", "National Oceanic And Atmospheric Administration", "NOAA"),
    ("subagency", "National Park Service", "NPS"),
    ("subagency", "U.S. Fish And Wildlife Service", "USFWS"),
    ("subagency", "Bureau Of Land Management", "BLM"),
    ("subagency", "Geological Survey", "USGS"),
    ("subagency", "Bureau Of Reclamation", "BOR"),
    ("subagency", "Department Of State - Agency Wide", "State"),
    ("subagency", "National Institutes Of Health", "NIH"),
    ("agency", "National Aeronautics And Space Administration", "NASA"),
    ("agency", "Department Of Transportation", "DOT"),
    ("agency", "Department Of Labor", "DOL"),
    ("agency", "Department Of Homeland Security", "DHS"),
]
ENVIRONMENTAL_SUBAGENCIES = [
    "Environmental Protection Agency", "Natural Resources Conservation Service", "Forest Service",
    "National Oceanic And Atmospheric Administration", "National Park Service", "U.S. Fish And Wildlife Service",
    "Bureau Of Land Management", "Bureau Of Reclamation", "Geological Survey", "U.S. Army Corps Of Engineers",
]
BENCHMARK_SUBAGENCIES = ["National Institutes Of Health", "Department Of State - Agency Wide"]
BENCHMARK_AGENCIES = [
    "National Aeronautics And Space Administration", "Department Of Transportation", "Department Of Labor",
    "Department Of Homeland Security",
]
SERIES_SHORT_NAMES = {
    "IT Management": ["Information Technology Management"],
    "Archaeology": ["Archeology"],
    "General Inspection": ["General Inspection, Investigation, Enforcement, And Compliance Series"],
    "NRM & Bio Sciences": ["General Natural Resources Management And Biological Sciences"],
}
UNNAMED_SERIES = "Agricultural Engineering"
WORKFORCE_NAME_FIXES = {
    "U.S. Fish And Wildlife Service": ["Fish And Wildlife Service"],
    "U.S. Army Corps Of Engineers": ["Army Corps Of Engineers"],
}
SCORE_FLAGS = ["innovative_tech", "emerging_tech", "agile_startup_ux", "use_ai", "user_research", "stem_job"]
SCORE_FIELDS = (
    "job_gpt_name string, overview string, how_software_used string, programming_types string, innovative_tech string, "
    "emerging_tech string, agile_startup_ux string, use_ai string, user_research string, stem_job string, "
    "similar_to_data_steward string, innovative_score string"
)

# ---- fixed values: open source ----
REPO_WINDOW = ("2021-10-01", "2025-03-24")
RECENT_COMMITS_AFTER = "2024-09-23"
REPO_AGENCY_FIXES = {"U.S. Army Corps of Engineers": ["U.S. Army Corps Of Engineers"]}
SHORT_NAMES = {
    "Forest Service": "USFS",
    "Natural Resources Conservation Service": "NRCS",
    "U.S. Fish and Wildlife Service": "USFWS",
    "National Park Service": "NPS",
    "U.S. Geological Survey": "USGS",
    "Bureau of Land Management": "BLM",
    "Environmental Protection Agency": "EPA",
    "Bureau of Reclamation": "BOR",
    "U.S. Army Corps of Engineers": "USACE",
    "National Oceanic and Atmospheric Administration": "NOAA",
    "National Aeronautics and Space Administration": "NASA",
    "Department of Labor": "DOL",
    "Department of State": "State",
    "Department of Homeland Security": "DHS",
}
NOT_A_LANGUAGE = [
    "HTML", "Makefile", "Dockerfile", "Jupyter Notebook", "Batchfile", "M4", "Procfile", "Vue", "Smarty", "CMake",
    "JavaScript", "CSS", "SCSS", "Shell", "TeX", "Inno Setup", "PowerShell", "Roff", "Rich Text Format", "Jinja", "BitBake",
    "ASP.NET", "Pug", "QMake", "Stylus", "Less", "Mako", "SWIG", "Twig", "EJS", "Handlebars", "Module Management System",
    "LLVM", "FreeMarker",
]
