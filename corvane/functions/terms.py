"""Words, units and codes that results depend on. They are parameters of the functions that use them."""

#: Units as they are written, in lower case, and their names.
UNITS = {
    "мг/л": "mg/l",
    "mg/l": "mg/l",
    "мг/дм3": "mg/dm3",
    "мг/дм³": "mg/dm3",
    "г/л": "g/l",
    "g/l": "g/l",
    "м/с": "m/s",
    "m/s": "m/s",
    "л/с": "l/s",
    "l/s": "l/s",
    "%": "%",
    "°c": "C",
    "кг/т": "kg/t",
    "kg/t": "kg/t",
}
#: Comparisons as they are written, and their codes.
OPERATORS = {"<=": "le", "≤": "le", "до": "le", "не более": "le", "менее": "le", ">=": "ge", "≥": "ge", "не менее": "ge", "более": "ge", "<": "lt", ">": "gt"}
#: Quantities of these units agree within so much; others within 0.000001.
TOLERANCES = {"%": 0.05, "m/s": 0.01, "mg/l": 0.01, "mg/dm3": 0.01}

#: Names of places in documents.
DOCUMENT_PLACES = {
    "россия": "Россия",
    "россии": "Россия",
    "russia": "Россия",
    "норильск": "Норильский регион",
    "norilsk": "Норильский регион",
    "кольский": "Кольский полуостров",
    "kola": "Кольский полуостров",
}
#: Names of places in questions and evidence.
PLACES = {
    "россия": "Россия",
    "россии": "Россия",
    "россий": "Россия",
    "за рубежом": "зарубежная практика",
    "зарубеж": "зарубежная практика",
    "норильск": "Норильский регион",
    "норильского": "Норильский регион",
    "кольский": "Кольский полуостров",
    "кольского": "Кольский полуостров",
}
DOMESTIC = ["россия", "норильск", "кольск", "отечествен"]
FOREIGN = ["зарубеж", "колумб", "канада", "австрал", "миров"]

SOURCE_TYPES = {"публикац": "publication", "стать": "publication", "патент": "patent", "отчет": "technical_report", "отчёт": "technical_report", "норматив": "regulation"}
CLAIMS = ["achieved", "shows", "reported", "recommended", "requires", "increases", "decreases", "составляет", "показал", "показано", "рекоменду", "требует", "влияет", "повышает", "снижает", "достигает"]
PROCESSES = ["desalination", "flotation", "electroextraction", "leaching", "обессол", "флотац", "электроэкстракц", "выщелач", "закач", "циркуляц"]
MATERIALS = [
    "пентландит", "халькопирит", "пирротин", "миллерит", "лимонит", "гематит", "магнетит", "пиролюзит", "золото", "серебро", "платина",
    "палладий", "медь", "никель", "кобальт", "цинк", "сульфидн", "оксидн", "штейн", "шлак", "руда", "ферроникель",
]
EQUIPMENT = ["дробилка", "мельница", "флотационная машина", "колонная флотация", "колонн", "электропечь", "дуговая печь", "конвертер", "электролизная ванна", "реактор", "насос", "скважина"]
PROPERTIES = ["извлекаемость", "содержание", "скорость", "температура", "давление", "производительность", "стоимость", "сухой остаток", "качество", "концентрация"]
SUBSTANCES = ["Au", "Ag", "Mg", "Ca", "Na", "Ni", "Cu", "Co", "Fe", "Zn", "Pb", "PGM", "PGE", "МПГ", "ПГЭ"]
QUERY_TERMS = ["сульфаты", "хлориды", "сухой остаток", "католит", "шахтные воды", "штейн", "шлак", "ферроникель"]
RELATIONS = ["влияет", "примен", "used", "applied", "affects", "between"]
CONFLICTS = ["противореч", "расхожд", "conflict", "disagree", "inconsistent"]
SOURCES = ["doi", "патент", "гост", "iso", "отчет", "отчёт", "journal"]
CONCLUSIONS = ["вывод", "заключ", "показано", "recommended", "conclusion"]
RECOMMENDATIONS = ["recommend", "рекоменду"]

#: Purposes of documents, the first that fits.
PURPOSES = {
    "patent": ["patent", "патент"],
    "regulation": ["standard", "regulation", "норматив", "гост"],
    "experiment_log": ["experiment", "protocol", "эксперимент", "протокол"],
    "technical_report": ["report", "отчет", "отчёт"],
    "research_article": ["article", "journal", "publication", "статья", "публикац"],
}
#: Intents of questions, the first that fits; else evidence_lookup.
INTENTS = {
    "compare": ["сравн", "соотно", "compare", "versus"],
    "find_methods": ["какие", "методы", "способы", "решения", "технологии", "methods"],
    "extract_constraints": ["параметр", "диапазон", "скорост", "temperature", "flow"],
}

SEED_ALIASES = {
    "мпг": "металлы платиновой группы",
    "пгэ": "платиноидные элементы",
    "pgm": "металлы платиновой группы",
    "pge": "платиноидные элементы",
    "fe-ni": "ферроникель",
    "feni": "ферроникель",
    "cu-ni": "медно-никелевые руды",
    "ni": "никель",
    "cu": "медь",
    "co": "кобальт",
    "au": "золото",
    "ag": "серебро",
}
TRANSLATED_ALIASES = {
    "nickel": "никель",
    "copper": "медь",
    "cobalt": "кобальт",
    "gold": "золото",
    "silver": "серебро",
    "slag": "шлак",
    "matte": "штейн",
    "flotation": "флотация",
    "leaching": "выщелачивание",
    "desalination": "обессоливание",
    "electroextraction": "электроэкстракция",
}
#: Letters that become several, or none, in Latin script; the others become one each.
LONG_LETTERS = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya"}
LETTERS = ("абвгдеёзийклмнопрстуфхыэьъ", "abvgdeeziyklmnoprstufhye")

#: Layers of evidence by the codes that put it there.
CONFLICTING_CODES = ["conflicting_values", "needs_unit_check"]
UNSUPPORTED_CODES = ["missing_source_span", "unsupported_claim", "inaccessible_source"]
