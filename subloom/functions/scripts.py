"""Scripts that the text rules are applied to, with their vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Script:
    """What a rule must know of a script: its letters as a character class, and word lists."""

    name: str
    letters: str
    foreign: str
    vowels: str
    leading_noise: str | None = None
    credits: tuple[str, ...] = ()
    short_words: tuple[str, ...] = ()
    kept_letters: tuple[str, ...] = ()
    valid_short: tuple[str, ...] = ()
    common: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    phrases: dict[str, str] = field(default_factory=dict, hash=False)
    safe_phrases: tuple[str, ...] = ()
    safe_words: tuple[str, ...] = ()
    cleanup_noise: tuple[str, ...] = ()
    cleanup_short: tuple[str, ...] = ()
    lower: str = "a-z"
    upper: str = "A-Z"


# fixed values: vocabularies of the subtitle rules
CYRILLIC = Script(
    name="cyrillic",
    letters="\u0400-\u04ff",
    foreign="A-Za-z",
    vowels="аеёиоуыэюя",
    leading_noise="N{1,4}|Л{2,4}|М{2,4}",
    credits=("vk.com/starseriales", "starseriales", "перево", "перевод", "тайминг", "редактор", "сериал"),
    short_words=("я", "и", "в", "не", "но", "да", "он", "мы", "вы", "ты", "на", "за", "к", "у", "с", "о", "а"),
    kept_letters=("я",),
    valid_short=("да", "нет", "что", "кто", "стой", "иди", "уйди", "беги", "я", "ты", "он", "она", "мы", "вы", "они", "ну", "ой", "ах", "эй", "радха", "кришна", "господь"),
    common=(
        "и", "в", "не", "что", "как", "это", "но", "на", "я", "ты", "он", "она", "мы", "вы", "они", "мне", "тебя", "меня", "когда", "почему", "нужно", "нашем", "мире",
        "богини", "имя", "радхи", "любви", "есть", "только",
    ),
    hints=(
        "я", "ты", "он", "она", "мы", "вы", "они", "не", "на", "в", "и", "что", "как", "это", "тебя", "меня", "мне", "твоей", "моей", "преданности", "сомневаюсь", "господь", "радха", "кришна",
    ),
    phrases={"янесомневаюсьвтвоейпреданности": "Я не сомневаюсь в твоей преданности"},
    safe_phrases=("да", "нет", "что", "кто", "радха", "кришна", "скажите", "господь"),
    safe_words=(
        "бабочка", "бабочке", "бабочку", "более", "важнее", "верите", "господь", "девушка", "доказал", "если", "жизнь", "имя", "истина", "кришна", "любви", "любовь", "нет", "пепел",
        "посмотрите", "потому", "почему", "преданность", "произнесите", "произнесли", "радха", "радхи", "скажите", "теперь", "точку", "червяк", "ценно", "что",
    ),
    cleanup_noise=("vk.com/starseriales", "starseriales", "перевод", "тайминг", "редактор", "маржан", "жамилова"),
    cleanup_short=("и", "в", "не", "но", "на", "я", "ты", "он"),
    lower="а-яё",
    upper="А-ЯЁ",
)

LATIN = Script(
    name="latin",
    letters="A-Za-zÀ-ÖØ-öø-ÿ",
    foreign="\u0370-\u04ff",
    vowels="aeiouyàâäáãéèêëíîïóôöúùûü",
    credits=("licensed under", "all rights reserved", "www."),
    short_words=("a", "i", "to", "of", "in", "is", "on", "as", "at", "by", "we", "he", "it", "or", "an", "le", "la", "de", "un", "et", "en", "du", "au", "ou", "il", "y", "el", "es", "se", "su", "no", "im", "er", "zu"),
    kept_letters=("i", "y"),
    valid_short=("no", "yes", "oui", "non", "ja", "nein", "si"),
    common=("the", "of", "and", "to", "in", "is", "that", "was", "for", "on", "are", "with", "as", "le", "la", "les", "de", "des", "et", "un", "une", "der", "die", "und", "das", "ein", "mit", "el", "los", "y", "en", "que"),
    safe_phrases=("no", "yes"),
    safe_words=("the", "that", "les", "des", "und", "die", "los", "que"),
    lower="a-zß-öø-ÿ",
    upper="A-ZÀ-ÖØ-Þ",
)
