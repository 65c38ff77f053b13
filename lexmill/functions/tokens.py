"""Protected identifiers, numbers and units in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let
from .languages import SCRIPT

# Patterns of identifiers that must survive unchanged.
OPAQUE_KINDS = [
    r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+",
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?(?:/\d{1,2})?\b",
    r"[A-Za-z]:\\(?:[^\\<>\n　-鿿＀-￯]+?\\)*[^\\\s<>　-鿿＀-￯]*",
    r"\b[A-Z]{1,6}-[A-Z0-9]*\d[A-Z0-9]*(?:-[A-Z0-9]+)*\b",
    r"\bv\d+(?:\.\d+)+\b",
    r"\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?::\d+)?(?:/[^\s<>]*)?\b(?=[^.\w]|$)",
]
OPAQUE = "(?U)" + "|".join(f"(?:{p})" for p in OPAQUE_KINDS)
MAIL, CODE = 1, 4  # places of addresses and of codes like AHU-1 among the kinds
#: What no text lacks that has a code, or one of the kinds but codes and addresses, which all have an @.
HAS_CODE, HAS_OTHER = r"(?U)[A-Z]-[A-Z\d]", r"(?U)[.:](?:(?<=:)(?://|\\)|(?<=[A-Za-z0-9-]\.)[A-Za-z]|(?<=\d\.)\d)"
ACRONYM = r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Za-z0-9]*[A-Z0-9](?:/[A-Z]{2,})?(?![A-Za-z0-9])"
NUMBER = r"(?U)\d[\d,]*(?:\.\d+)?"
# Units after a number, one notation for each, and those too short to tell in prose.
UNIT = (
    r"(?U)(?<=\d)\s?(°\s?[CF]|℃|℉|%|％|kWh|MWh|GWh|Wh|kW|MW|W|kVA|VA|kV|V|mA|A|Hz|kHz|kPa|MPa|Pa|"
    r"ppm|dB|lx|lux|m2|m²|㎡|m3/h|m³/h|L/s|l/s|CFM|cfm|rpm|mm|cm|km|m|kg|t|s|ms|min|h)(?![A-Za-z0-9])"
)
UNIT_FORM = {"℃": "°C", "℉": "°F", "％": "%", "㎡": "m²", "m2": "m²", "m3/h": "m³/h", "l/s": "L/s", "cfm": "CFM", "lux": "lx"}
VAGUE_UNITS = ["m", "s", "h", "t", "A", "W", "V", "min"]
# Units written out.
SPELLED = {
    "kWh": ["キロワット時", "千瓦时", "千瓦時", "กิโลวัตต์-ชั่วโมง", "กิโลวัตต์ชั่วโมง", "킬로와트시", "Kilowattstunde"],
    "MWh": ["メガワット時", "兆瓦时", "兆瓦時", "เมกะวัตต์-ชั่วโมง", "เมกะวัตต์ชั่วโมง", "메가와트시", "Megawattstunde"],
    "GWh": ["ギガワット時", "吉瓦时", "กิกะวัตต์-ชั่วโมง", "기가와트시"],
    "kW": ["キロワット", "千瓦", "กิโลวัตต์", "킬로와트"],
    "MW": ["メガワット", "兆瓦", "เมกะวัตต์", "메가와트"],
    "ppm": ["百万分之", "ส่วนในล้านส่วน", "พีพีเอ็ม"],
    "°C": [r"\d\s*度", "摄氏", "攝氏", "องศาเซลเซียส", r"\d\s*องศา", "섭씨", r"\d\s*도", "ဒီဂရီ"],
    "%": ["パーセント", "百分之", "เปอร์เซ็นต์", "퍼센트", "ရာခိုင်နှုန်း"],
    "m²": ["平方メートル", "平方米", "平方公尺", "ตารางเมตร", "제곱미터"],
    "kPa": ["キロパスカル", "千帕", "กิโลปาสกาล", "킬로파스칼"],
    "Hz": ["ヘルツ", "赫兹", "เฮิรตซ์", "헤르츠"],
    "lx": ["ルクス", "勒克斯", "ลักซ์", "럭스"],
}
NATIVE_ZEROS = (0x1040, 0x0E50, 0xFF10, 0x0660)

ASCII_DIGITS = "0123456789"
_NATIVE = "".join(chr(z + i) for z in NATIVE_ZEROS for i in range(10))


def escaped(token: Column) -> Column:
    """A pattern that matches just the token."""
    return F.regexp_replace(token, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")


def trimmed(token: Column) -> Column:
    """Without the punctuation of the sentence after it, and without closing brackets it didn't open."""
    start = F.regexp_replace(token, r"[.,;:']+$", "")
    closing = lambda t: F.regexp_count(t, F.lit(r"\)")) > F.regexp_count(t, F.lit(r"\("))
    step = lambda t, _: F.when(t.endswith(")") & closing(t), F.regexp_replace(F.regexp_replace(t, r"\)$", ""), "[.,;:]+$", "")).otherwise(t)
    return F.aggregate(F.sequence(F.lit(0), F.regexp_count(start, F.lit(r"\)"))), start, step)


def opaque_tokens(text: Column) -> Column:
    """A text is searched for kinds that it has what they need for; most prose has it for none."""
    every = lambda kinds: F.regexp_extract_all(text, F.lit("(?U)" + "|".join(f"(?:{OPAQUE_KINDS[k]})" for k in kinds)), F.lit(0))
    kinds = range(len(OPAQUE_KINDS))
    no_mail = [k for k in kinds if k != MAIL]
    found = F.when(text.contains("@"), every(kinds)).when(text.rlike(HAS_OTHER), every(no_mail)).otherwise(every([CODE]))
    has = text.contains("@") | text.rlike(HAS_OTHER) | text.rlike(HAS_CODE)
    return F.when(has, F.transform(found, trimmed)).otherwise(F.array().cast("array<string>"))


def is_opaque(token: Column) -> Column:
    return token.rlike(f"^(?:{OPAQUE.replace('(?U)', '(?U:', 1)}))$")


def acronyms(text: Column) -> Column:
    """Two capitals or more, in order of appearance."""
    return F.filter(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(0)), lambda t: F.regexp_count(t, F.lit(r"\p{Lu}")) >= 2)


def protected_tokens(text: Column, kept_terms: Column | None = None) -> Column:
    """Identifiers, then acronyms that no earlier token contains, then kept terms; distinct."""
    add = lambda found, t: F.when(F.exists(found, lambda f: f.contains(t)), found).otherwise(F.concat(found, F.array(t)))
    held = F.struct(acronyms(text).alias("short"), opaque_tokens(text).alias("long"))
    found = let(held, lambda h: F.when(F.size(h["short"]) == 0, h["long"]).otherwise(F.aggregate(h["short"], h["long"], add)))
    return F.array_distinct(found if kept_terms is None else F.concat(found, kept_terms))


def longest_first(tokens: Column) -> Column:
    return F.array_sort(tokens, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))


def without(text: Column, tokens: Column, instead: str = " ") -> Column:
    return F.aggregate(F.filter(longest_first(tokens), lambda t: t != ""), text, lambda at, t: F.replace(at, t, F.lit(instead)))


def significant_numbers(text: Column) -> Column:
    """Distinct numbers of two digits or more, or with decimals; without thousands separators, in ASCII digits."""
    plain = F.when(text.rlike(f"[{min(_NATIVE)}-{max(_NATIVE)}]"), F.translate(text, _NATIVE, ASCII_DIGITS * len(NATIVE_ZEROS))).otherwise(text)
    found = F.transform(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.array_distinct(F.filter(found, lambda n: (F.length(F.replace(n, F.lit("."), F.lit(""))) >= 2) | n.contains(".")))


def units(text: Column) -> Column:
    """Units after numbers in one notation, as often as they stand; vague ones left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(1)), lambda u: F.replace(u, F.lit(" "), F.lit("")))
    forms = F.create_map(*[F.lit(x) for kv in UNIT_FORM.items() for x in kv])
    return F.filter(F.transform(found, lambda u: F.coalesce(F.try_element_at(forms, u), u)), lambda u: ~u.isin(VAGUE_UNITS))


def lost_units(source: Column, target: Column) -> Column:
    """Units that target has less often than source, written out or not; sorted."""

    def written(u):
        out = None
        for k, v in SPELLED.items():
            n = F.regexp_count(target, F.lit("(?iu)" + "|".join(f"(?:{w})" for w in v)))
            out = F.when(u == k, n) if out is None else out.when(u == k, n)
        return out.otherwise(0)

    def lost(both):
        count = lambda of, u: F.size(F.filter(of, lambda x: x == u))
        return F.array_sort(F.filter(F.array_distinct(both["a"]), lambda u: count(both["b"], u) + written(u) < count(both["a"], u)))

    return let(F.struct(units(source).alias("a"), units(target).alias("b")), lost)


def nothing_to_translate(text: Column, lang: str, tokens: Column) -> Column:
    """Nothing but tokens, digits and marks, or no letter of the language's script."""
    rest = without(text, tokens, "")
    if lang in ("en", "de", "es"):  # all that these classes have are letters, and most texts soon have one
        return ~rest.rlike(SCRIPT[lang])
    rest = F.regexp_replace(rest, r"(?U)[\d\s\W_]+", "")
    return (rest == "") | ~rest.rlike(SCRIPT[lang])


def content_length(text: Column, tokens: Column) -> Column:
    """Letters of the wording itself."""
    return F.length(F.regexp_replace(without(text, tokens, ""), r"(?U)[\W\d_]+", ""))


def masked(text: Column) -> Column:
    """Struct (text, tokens): identifiers as <x1/>, <x2/>, …; tokens has what they stood for, in that order."""
    found = F.regexp_extract_all(text, F.lit(OPAQUE), F.lit(0))
    parts = F.split(F.regexp_replace(text, OPAQUE, "\x01"), "\x01", -1)
    marks = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("<x"), i.cast("string"), F.lit("/>"), p)))
    return F.struct(F.array_join(marks, "").alias("text"), found.alias("tokens"))


def unmasked(text: Column, tokens: Column) -> Column:
    marks = F.transform(tokens, lambda t, i: F.struct(F.concat(F.lit("<x"), (i + 1).cast("string"), F.lit("/>")).alias("mark"), t.alias("token")))
    return F.aggregate(marks, text, lambda at, m: F.replace(at, m["mark"], m["token"]))


def parenthesised(text: Column, tokens: Column) -> Column:
    """The tokens that stand in brackets somewhere."""
    return F.filter(tokens, lambda t: F.regexp_like(text, F.concat(F.lit(r"[（(]\s*"), escaped(t), F.lit(r"\s*[）)]"))))
