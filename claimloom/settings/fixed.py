"""Fixed values that decide results: periods, word lists, patterns, labels.

Everything here is data.  The operators take these as defaults, so a study of
another subject swaps the values and keeps the code.
"""

from __future__ import annotations

# --- fixed values: named periods, closed on both ends -----------------------
JUNCTURES = {
    "J1_autocephaly_2018-19": ("2018-01-01", "2019-05-19"),
    "J2_invasion_2022": ("2022-02-24", "2023-12-31"),
    "J3_law_2024": ("2024-01-01", "2024-12-31"),
    "J4_enforcement_2025": ("2025-01-01", "2025-12-31"),
    "interstitial_2019-2022": ("2019-05-20", "2022-02-23"),
}
DATE_START = "2018-01-01"
DATE_END = "2025-12-31"

# --- fixed values: source catalogue (key, label, path, type, source) --------
SOURCES = (
    ("speeches", "Speeches and addresses", "/news/speeches", "speech", "president.gov.ua"),
    ("press_releases", "News / Press releases", "/news/all", "press_release", "president.gov.ua"),
    ("rada_stenograms", "Rada plenary stenograms", "/meeting/stenogr/", "rada_stenogram", "rada.gov.ua"),
    ("sbu_releases", "SBU press releases", "/news", "sbu_press_release", "sbu.gov.ua"),
    ("dess_statements", "DESS statements", "/category/news/", "dess_statement", "dess.gov.ua"),
)
CURATED_SOURCES = ("risu.ua", "ssu.gov.ua")

# --- fixed values: abbreviations after which a full stop ends no sentence ---
ABBREVIATIONS = (
    "ст.", "п.", "м.", "р.", "рр.", "гр.",
    "тис.", "млн.", "млрд.", "грн.",
    "напр.", "див.", "т.д.", "т.п.", "т.ін.",
    "проф.", "акад.", "д.ю.н.", "к.ю.н.",
)
SENTENCE_END = '[.!?»"]'
SENTENCE_START = '[A-ZА-ЯІЇЄҐЁ«"]'
MIN_SENTENCE_CHARS = 10

# --- fixed values: month names ----------------------------------------------
MONTHS_UK = {
    "січня": "01", "лютого": "02", "березня": "03", "квітня": "04",
    "травня": "05", "червня": "06", "липня": "07", "серпня": "08",
    "вересня": "09", "жовтня": "10", "листопада": "11", "грудня": "12",
}
MONTHS_RU = {
    "января": "01", "февраля": "02", "марта": "03", "апреля": "04",
    "мая": "05", "июня": "06", "июля": "07", "августа": "08",
    "сентября": "09", "октября": "10", "ноября": "11", "декабря": "12",
}

# --- fixed values: topic stems; repeated entries count twice on purpose -----
RELEVANCE_STEMS = (
    "УПЦ", "упц", "ПЦУ", "пцу", "МП",
    "церкв", "Церкв",
    "томос", "Томос",
    "автокефал", "Автокефал",
    "православн", "Православн",
    "патріарх", "Патріарх",
    "митрополит", "Митрополит",
    "єпарх", "Єпарх",
    "лавр", "Лавр",
    "Онуфрій", "Епіфаній",
    "релігій", "Релігій",
    "монастир", "Монастир",
    "священн", "Священн",
    "парафі", "Парафі",
    "конфесі", "Конфесі",
    "храм", "Храм",
    "церков", "Церков",
    "патриарх", "Патриарх",
    "митрополит", "Митрополит",
    "монастыр", "Монастыр",
    "православн", "Православн",
)
MIN_DISTINCT_STEMS = 2
MIN_TOTAL_STEMS = 3

# --- fixed values: lines that are page furniture ----------------------------
NAVIGATION_LINES = (
    r"^\s*$",
    r"^(Головна|Новини|Контакти|Про нас|Зв'язатися|Пошук)\s*$",
    r"^(Home|News|Contact|About|Search)\s*$",
    r"^GOV\.UA",
    r"^Офіційний вебпортал",
    r"^Електронний кабінет",
    r"^(Вхід|Реєстрація|Увійти)",
    r"^Календар подій",
    r"^\d{2}\.\d{2}\.\d{4}$",
    r"^(Пн|Вт|Ср|Чт|Пт|Сб|Нд)\s",
    r"^(Copyright|©|Всі права)",
    r"^\s*(Facebook|Twitter|Telegram|YouTube|Instagram)\s*$",
    r"^Поділитися",
    r"^Версія для друку",
)

# --- fixed values: marks of a page that is not a session record -------------
BOILERPLATE_MARKERS = (
    "Головна сторінка",
    "Календар пленарних",
    "Порядок денний",
    "Прес-служба",
    "Контакти",
    "Карта сайту",
    r"Верховна Рада України\s*\n\s*Головна",
    "Реєстр законопроект",
    "Пошук по сайту",
)
SESSION_MARKERS = (
    "ГОЛОВУЮЧИЙ", "головуючий",
    "ЗАСІДАННЯ", "засідання",
    "Шановні народні депутати",
    "Слово має", "Слово надається",
    "Хто за\\?", "Прошу голосувати",
    "Результат поіменного голосування",
    "Дякую", "дякую",
)

# --- fixed values: attribution of speech to the tracked speaker -------------
SPEAKER_NAME = "Порошенко"
SPEAKER_SLUG = "^poroshenko"
SPEAKER_TITLE = "Порошенко|Poroshenko"
SPEECH_PATTERNS = (
    r"Порошенко\s+(заявив|сказав|наголосив|зазначив|підкреслив|повідомив|додав|написав|звернувся|закликав|вважає|переконаний|пояснив|констатував|попередив|відзначив|привітав|подякував|запропонував|нагадав|розповів|зауважив|стверджує|вимагає|просить|каже|вказав|висловив|оголосив|анонсував|заявляє|вітає)",
    r"Порошенко[^.]{0,30}(сказав|заявив|написав|наголосив|зазначив|підкреслив)",
    r"—\s*Порошенко",
    r"Порошенко\s*:",
    r"за\s+словами\s+Порошенк",
    r"як\s+заявив\s+Порошенко",
    r"як\s+сказав\s+Порошенко",
    r"як\s+зазначив\s+Порошенко",
    r"на\s+думку\s+Порошенк",
    r"Порошенко\s+у\s+(зверненні|виступі|промові|заяві|інтерв)",
    r"цитат[аує].*Порошенк",
    r"Порошенко\s+(заявил|сказал|подчеркнул|отметил|сообщил|добавил|написал|обратился|призвал|считает|убежден|объяснил|предупредил|поздравил|предложил|напомнил|рассказал|утверждает|требует|просит|говорит|указал|высказал|объявил|заявляет)",
    r"по\s+словам\s+Порошенк",
    r"как\s+заявил\s+Порошенко",
    r"как\s+сказал\s+Порошенко",
)

# --- fixed values: labels, code domains and stage counters ------------------
SOURCE_LABELS = {
    "speech": "Zelensky",
    "poroshenko_speech": "Poroshenko",
    "rada_stenogram": "Rada",
    "sbu_press_release": "SBU",
    "dess_statement": "DESS",
}
TYPE_LABELS = {"material": "Material", "ontological": "Ontological", "both": "Both"}
KAPPA_BANDS = (
    (0.81, "almost perfect"),
    (0.61, "substantial"),
    (0.41, "moderate"),
    (0.21, "fair"),
)
FUNNEL = (
    ("Zelensky", 1780, 56),
    ("Poroshenko", 268, 196),
    ("Rada", 2300, 611),
    ("SBU", 142, 142),
    ("DESS", 860, None),
)
CODE_COLUMNS = (
    "securitisation_type",
    "referent_object",
    "threat_actor",
    "extraordinary_measure",
)
CODE_DOMAINS = {
    "securitisation_type": ("material", "ontological", "both", "neither"),
    "referent_object": ("state", "nation", "identity", "faith", "other", "none"),
    "threat_actor": ("UOC-MP", "Russia", "internal", "other", "none"),
    "extraordinary_measure": ("ban", "sanction", "dissolution", "seizure", "other", "none"),
}
TRUTHY = ("true", "1", "yes")

# --- fixed values: sizes -----------------------------------------------------
TOKENS_PER_WORD = 3.5
MAX_WORDS = 1200
CONTEXT_SENTENCES = 5
MAX_BATCH_TOKENS = 80000
OVERSIZE_SHARE = 0.9
TRUNCATED_MARK = "\n[... TRUNCATED ...]"
GAP_MARK = "[...]"
SECTION_JOINER = "\n\n---\n\n"

# --- fixed values: titles and headings of session records ---------------------
SESSION_TITLE_EXCLUDED = "Календар|календар|Головна|головна"
SESSION_HEADING = r"Засідання[^\n]{0,100}"

# --- fixed values: links of the statement site and of the archive ------------
STATEMENT_LINK_EXCLUDED = ("/category/", "/page/", "/tag/", "/wp-content/", "/wp-admin/", "/feed/", "#")
STATEMENT_LINK_ENDING = r"/[a-z0-9][\w-]+/?$"
ARCHIVE_LISTING = r"/(speeches|all|decrees|statements)(/page/\d+)?$"
ARCHIVE_SHORTEST = "https://www.president.gov.ua/news/x"

# --- fixed values: classes of dates and pagers in listings -------------------
LISTING_DATE_CLASS = "date|time"
NEXT_LINK_CLASS = "next|pager-next"
PAGER_CLASS = "pag|page"
ACTIVE_PAGE_CLASS = "active|current"

# --- fixed value: the question put to a coder --------------------------------
CLAIM_PROMPT = 'Code this claim:\n\nDocument: %s\nDate: %s\nCategory: %s\nMatched term: %s (surface form: "%s")\n\n[Previous sentence]: %s\n>>> [TARGET SENTENCE]: %s\n[Next sentence]: %s'  # noqa: E501
# --- end of fixed values ------------------------------------------------------
