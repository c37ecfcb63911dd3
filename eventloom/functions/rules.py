"""Rule columns on messages: relevance, language, audience and staleness.

Every rule is a Column over a text column; dictionaries and marker tables are parameters, so
the same rules serve other languages. Patterns are literal, so the JVM compiles each once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and patterns below must stay as they are for equal results.
KEYWORDS = [
    "конференц", "семінар", "семинар", "лекці", "лекци", "вебінар", "вебинар",
    "воркшоп", "майстер-клас", "мастер-класс", "захід", "мероприят", "зустріч",
    "встреч", "презентац", "хакатон", "олімпіад", "олимпиад",
    "відбудеться", "состоится", "запрошуємо", "приглашаем", "запрошуєм",
    "реєстрац", "регистрац", "дедлайн", "deadline", "явка", "розклад",
    "расписание", "перенесено", "перенос", "оголошенн", "объявлен",
    "аудитор", "ауд.", "корпус", "онлайн", "online", "zoom", "розпочн",
]
TIME_PATTERN = r"(?U)\b([01]?\d|2[0-3])[:.]([0-5]\d)\b"
DATE_PATTERN = (
    r"(?iU)\b(\d{1,2}[./]\d{1,2}([./]\d{2,4})?)\b"
    r"|\b\d{1,2}\s+(січ|лют|бер|квіт|трав|черв|лип|серп|вер|жовт|лист|груд"
    r"|янв|фев|мар|апр|ма|июн|июл|авг|сен|окт|ноя|дек)"
)
RELATIVE_PATTERN = r"(?iU)\b(завтра|сьогодні|сегодня|післязавтра|послезавтра|наступн|следующ)\b"
UK_LETTERS, RU_LETTERS = "іїєґ", "ыэъё"
UK_WORDS = """
    що це ця цей усі всі або як коли хто де ще вже дуже тут щоб якщо
    був була було були є буде будуть може можна потрібно треба його її їх
    після між біля тільки також теж навіть адже лише знову сьогодні вчора
    зараз тепер потім далі друзі колеги нагадую запрошуємо відбудеться
    початок реєстрація участь учасники аудиторії кафедри захід зустріч
    відкрито оголошуємо шановні
""".split()
RU_WORDS = """
    что это эта этот все всех или как когда кто где ещё еще уже очень здесь
    чтобы если был была было были есть будет будут может можно нужно надо
    его её ее их них после между около только также тоже даже ведь лишь
    снова опять вчера сейчас теперь потом затем друзья коллеги напоминаю
    приглашаем состоится пройдет пройдёт начало регистрация участие
    участники аудитории кафедры мероприятие встреча открыта объявляем
    уважаемые дорогие напоминание
""".split()
REASON_RUSSIAN = "повідомлення російською — факультет веде канал українською"
REASON_MODEL_RUSSIAN = "модель визначила мову як російську"
INDIVIDUAL_MARKERS = [
    (r"індивідуальн\w*\s+консультац", "індивідуальні консультації"),
    (r"индивидуальн\w*\s+консультац", "индивидуальные консультации"),
    (r"за\s+попереднім\s+записом", "за попереднім записом"),
    (r"за\s+предварительной\s+записью", "за предварительной записью"),
    (r"\bза\s+записом\b", "за записом"),
    (r"запис\w*\s+на\s+консультац", "запис на консультацію"),
    (r"запис\w*\s+до\s+викладач", "запис до викладача"),
    (r"особист\w*\s+прийом", "особистий прийом"),
    (r"годин\w*\s+прийому", "години прийому"),
    (r"прийомн\w*\s+годин", "прийомні години"),
    (r"графік\s+консультацій\s+викладач", "графік консультацій викладачів"),
    (r"у\s+зручний\s+для\s+вас\s+час", "у зручний для вас час"),
    (r"в\s+удобное\s+для\s+вас\s+время", "в удобное для вас время"),
    (r"персональн\w*\s+консультац", "персональні консультації"),
]
COLLECTIVE_MARKERS = [
    (r"для\s+всіх", "для всіх"),
    (r"для\s+всех", "для всех"),
    (r"усі\s+охоч", "усі охочі"),
    (r"всі\s+охоч", "всі охочі"),
    (r"все\s+желающ", "все желающие"),
    (r"запрошуємо\s+всіх", "запрошуємо всіх"),
    (r"приглашаем\s+всех", "приглашаем всех"),
    (r"обов[’'`]?язков\w*\s+(?:явка|відвідуванн|присутн)", "обов'язкова явка"),
    (r"явка\s+обов", "явка обов'язкова"),
    (r"для\s+студентів\s+\d", "для студентів N курсу"),
    (r"для\s+\d\s*(?:-го\s*)?курс", "для N курсу"),
    (r"для\s+груп", "для груп"),
    (r"\bпотік\w*\b", "потік"),
    (r"відкрит\w*\s+лекц", "відкрита лекція"),
    (r"загальн\w*\s+збор", "загальні збори"),
]
PAST_PATTERNS = [
    r"\b(?:вчора|позавчора|минул\w+\s+(?:тижня|місяця|року)|торік)\b[^.!?]{0,60}?\b(?:заверш|відбул|пройш|стартув|закінч)\w*",
    r"\b(?:заверш|відбул|пройш|закінч)\w*[^.!?]{0,40}?\b(?:вчора|позавчора|минул\w+\s+(?:тижня|місяця))\b",
    r"дяку(?:ємо|ю)\s+(?:всім|усім)[,\s]+хто",
]
CANCELLED_PATTERN = r"\b(?:скасован\w*|скасовано|відмінен\w*|відмінено)\b|\bне\s+відбудеться\b"
MONTHS = (
    "січня|січень|лютого|лютий|березня|березень|квітня|квітень|травня|травень"
    "|червня|червень|липня|липень|серпня|серпень|вересня|вересень|жовтня"
    "|жовтень|листопада|листопад|грудня|грудень"
)
EXPLICIT_DATE_PATTERN = r"\d{1,2}\s*(?:-?го)?\s*(?:[-–—]\s*\d{1,2}\s*)?(?:" + MONTHS + r")\b|\b\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?\b"
PUBLICATION_PATTERN = (
    r"\b(?:вийш\w+\s+друком|надійшов\s+друком)\b"
    r"|\b(?:опубліковано|видано|вийшов|вийшла|вийшло)\b[^.!?]{0,40}?\b(?:збірник\w*|монографі\w+|видання|випуск|номер\s+журналу)\b"
)

Markers = Sequence[tuple[str, str]]


def found(text: Column, pattern: str) -> Column:
    """The first match of a case-blind Unicode pattern, or null."""
    hit = F.regexp_extract(text, f"(?iU)({pattern})", 1)
    return F.when(hit != "", hit)


def matched_keywords(text: Column, keywords: Sequence[str]) -> Column:
    lowered = F.lower(text)
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(lowered, k))


def prefilter_score(text: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """A point for each keyword in the text (overlapping ones too), a clock time and a date; half for a relative date."""
    score = F.size(matched_keywords(text, keywords)).cast("double")
    for pattern, points in ((TIME_PATTERN, 1.0), (DATE_PATTERN, 1.0), (RELATIVE_PATTERN, 0.5)):
        score = score + F.when(text.rlike(pattern), points).otherwise(0.0)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0.0).otherwise(score)


def is_candidate(text: Column, threshold: float = 1.0, keywords: Sequence[str] = KEYWORDS) -> Column:
    return (F.coalesce(F.trim(text), F.lit("")) != "") & (prefilter_score(text, keywords) >= threshold)


def count_letters(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def detect_language(
    text: Column, letters: tuple[str, str] = (UK_LETTERS, RU_LETTERS), words: tuple[Sequence[str], Sequence[str]] = (UK_WORDS, RU_WORDS),
    names: tuple[str, str] = ("uk", "ru"),
) -> Column:
    """The first language where its letters are at least as many; without letters, by words; a tie there is null."""
    lowered = F.lower(text)
    first, second = (count_letters(lowered, x) for x in letters)
    tokens = F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"([\p{L}]+)"), F.lit(1)))
    own = [F.array(*map(F.lit, sorted(set(a) - set(b)))) for a, b in (words, words[::-1])]
    w1, w2 = (F.size(F.array_intersect(tokens, x)) for x in own)
    by_words = F.when(w1 > w2, names[0]).when(w2 > w1, names[1])
    return F.when(first + second > 0, F.when(first >= second, names[0]).otherwise(names[1])).otherwise(by_words)


def unsupported_reason(text: Column, extracted_language: Column | None = None) -> Column:
    detected = detect_language(text)
    reason = F.when(detected == "ru", REASON_RUSSIAN)
    if extracted_language is None:
        return reason
    return reason.when(detected.isNull() & (F.lower(F.trim(extracted_language)) == "ru"), REASON_MODEL_RUSSIAN)


def marker_labels(text: Column, markers: Markers) -> Column:
    """Labels of the patterns found, in the table's order."""
    return F.filter(F.array(*(F.when(text.rlike(f"(?iU){p}"), F.lit(label)) for p, label in markers)), lambda x: x.isNotNull())


def classify_scope(haystack: Column, individual: Markers = INDIVIDUAL_MARKERS, collective: Markers = COLLECTIVE_MARKERS) -> Column:
    """struct(scope, reason, individual, collective): personal only where nothing says it is for many."""
    one, many = marker_labels(haystack, individual), marker_labels(haystack, collective)
    listed = lambda x, n: F.array_join(F.slice(x, 1, n), ", ")
    reason = (
        F.when((F.size(one) > 0) & (F.size(many) == 0), F.concat(F.lit("персональний формат: "), listed(one, 3)))
        .when(F.size(one) > 0, F.concat(F.lit("є ознаки персонального ("), listed(one, 2), F.lit("), але й масового ("), listed(many, 2), F.lit(") — лишаємо")))
        .when(F.size(many) > 0, F.concat(F.lit("масовий захід: "), listed(many, 3)))
        .otherwise("ознак персонального формату немає")
    )
    scope = F.when((F.size(one) > 0) & (F.size(many) == 0), "individual").when(F.size(one) > 0, "group").otherwise("public")
    return F.struct(scope.alias("scope"), reason.alias("reason"), one.alias("individual"), many.alias("collective"))


def event_haystack(text: Column, audience: Column, title: Column, description: Column) -> Column:
    return F.concat_ws(" ", *(F.when(c != "", c) for c in (text, audience, title, description)))


def _fragment(hit: Column, n: int | None = 60) -> Column:
    squeezed = F.trim(F.regexp_replace(hit, r"(?U)\s+", " "))
    return squeezed if n is None else F.substring(squeezed, 1, n)


def past_report_reason(text: Column) -> Column:
    hit = F.coalesce(*(found(text, p) for p in PAST_PATTERNS))
    return F.concat(F.lit("звіт про минуле, а не анонс: «"), _fragment(hit), F.lit("»"))


def cancelled_reason(text: Column) -> Column:
    """Cancelled, and no date named after the word: else it is a move to a new date."""
    hit = found(text, CANCELLED_PATTERN)
    rest = F.regexp_extract(text, f"(?isU)(?:{CANCELLED_PATTERN})(.*)$", 1)
    fragment = F.concat(F.lit("подію скасовано, нової дати немає: «"), _fragment(hit, None), F.lit("»"))
    return F.when(hit.isNotNull() & ~rest.rlike(f"(?iU){EXPLICIT_DATE_PATTERN}"), fragment)


def publication_reason(text: Column) -> Column:
    return F.concat(F.lit("анонс публікації, а не подія: «"), _fragment(found(text, PUBLICATION_PATTERN)), F.lit("»"))


def past_date_reason(date: Column, reference: Column) -> Column:
    late = F.format_string(
        "подія вже відбулася: %s — на %s дн. раніше за оголошення (%s)",
        date.cast("string"), F.datediff(reference, date).cast("string"), reference.cast("string"),
    )
    return F.when(date < reference, late)


def stale_reason(text: Column, date: Column, reference: Column) -> Column:
    """Why an event is out of date, or null: the text's reasons first, then a date before the post's."""
    return F.coalesce(past_report_reason(text), cancelled_reason(text), publication_reason(text), past_date_reason(date, reference))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def channel_allowed(channel: Column, allowed: Sequence[str]) -> Column:
    """Case-blind membership; an empty list allows all."""
    return F.lower(channel).isin([c.lower() for c in allowed]) if allowed else F.lit(True)
