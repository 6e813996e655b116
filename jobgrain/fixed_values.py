"""Word lists, ids and lookup tables that results depend on.

Everything here is a default; every operator takes its list as an argument.
"""

# Title phrases that mark a posting as relevant.
TITLE_INCLUDE = [
    "аналитик данных",
    "data analyst",
    "дата аналитик",
    "bi аналитик",
    "bi-аналитик",
    "bi analyst",
    "бизнес-аналитик",
    "системный аналитик",
    "product analyst",
    "web analyst",
    "маркетинг-аналитик",
    "финансовый аналитик",
    "продуктовый аналитик",
]

# Title words that rule a posting out.
TITLE_EXCLUDE = [
    "юрист", "менеджер", "водитель", "оператор",
    "продавец", "кассир", "бухгалтер", "экономист",
    "консультант", "администратор", "hr", "рекрутер",
]

# Professional-role ids kept on collection.
ANALYST_ROLE_IDS = ["10", "134", "148", "150", "156", "163", "164"]

# Stems looked up in lower-cased text.
ROLE_NAME_STEM = "аналит"
REMOTE_STEM = "удален"

# Experience id to years.
MIN_EXPERIENCE_YEARS = {
    "noExperience": 0,
    "between1And3": 1,
    "between3And6": 3,
    "moreThan6": 6,
}
AVG_EXPERIENCE_YEARS = {
    "noExperience": 0,
    "between1And3": 2,
    "between3And6": 4,
    "moreThan6": 8,
}

# Job families in order of precedence, as
# (family, keyword, phrases that void this keyword).
JOB_FAMILY_RULES = [
    ("BI Analyst", "bi", ["big data", "mobile"]),
    ("BI Analyst", "tableau", []),
    ("BI Analyst", "power bi", []),
    ("BI Analyst", "qlik", []),
    ("BI Analyst", "looker", []),
    ("System Analyst", "system", []),
    ("System Analyst", "системн", []),
    ("Business Analyst", "business", []),
    ("Business Analyst", "бизнес", []),
    ("Financial Analyst", "financial", []),
    ("Financial Analyst", "финанс", []),
    ("Data Analyst", "data", []),
    ("Data Analyst", "данны", []),
    ("Data Analyst", "product", []),
    ("Data Analyst", "продуктов", []),
]
OTHER_FAMILY = "Other"

# Service columns dropped from a cleaned posting.
SERVICE_COLUMNS = [
    "response_url", "sort_point_distance", "apply_alternate_url",
    "show_logo_in_search", "show_contacts", "insider_interview",
    "alternate_url", "relations", "branding", "brand_snippet",
    "video_vacancy", "adv_response_url", "is_adv_vacancy",
    "adv_context", "url", "contacts", "working_days",
    "working_time_intervals", "working_time_modes",
    "fly_in_fly_out_duration", "civil_law_contracts", "night_shifts",
    "accept_incomplete_resumes", "internship", "accept_temporary",
    "created_at", "archived",
]

# Columns of the analysis frame, in order.
ANALYSIS_COLUMNS = [
    "id", "name", "salary_avg", "avg_experience_years",
    "min_experience_years", "requirement", "responsibility",
    "schedule_name", "employment_name", "employer_name", "area_name",
    "skills_list",
]

# Clustering features by label, and which are numeric.
FEATURE_LABELS = {
    "Зарплата": "salary_avg",
    "Минимальный опыт": "min_experience_years",
    "Название вакансии": "name",
    "График работы": "schedule_name",
    "Местность": "area_name",
}
NUMERIC_FEATURES = ["salary_avg", "min_experience_years"]

# Texts of a cluster profile.
SALARY_TAG_HIGH = "🤑 Высокая ЗП"
SALARY_TAG_NORMAL = "💵 Нормальная ЗП"
SALARY_TAG_LOW = "📉 Маленькая ЗП"
SALARY_UNKNOWN = "Не указана"
GROUP_TITLE_PREFIX = "Группа #"
MIXED_GROUP = "Смешанная группа"
CURRENCY_SIGN = "₽"

# Skills shown on the demand chart, levels of the trend chart.
DEMAND_SKILLS = ["Python", "SQL", "Docker", "Git", "Pandas"]
LEVEL_BY_EXPERIENCE = {
    "noExperience": "Junior",
    "between1And3": "Middle",
    "between3And6": "Senior",
    "moreThan6": "Senior",
}
LEVELS = ["Junior", "Middle", "Senior"]

# The salary estimate, base + step * years +- margin.
ESTIMATE_BASE = 60000
ESTIMATE_STEP = 15000
ESTIMATE_MARGIN = 10000
