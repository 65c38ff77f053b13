"""Text clean-up and comparison keys, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let
from .languages import LATIN
from .similarity import nfkc
from .tags import strip_tags
from .tokens import escaped, parenthesised

FULLWIDTH = "".join(chr(0xFF00 + ord(c) - 0x20) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
HALFWIDTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
# Fixed values.
CJK_GAP = r"(?<=[　-ヿ一-鿿＀-￯])[ \t]+(?=[　-ヿ一-鿿＀-￯])"
SENTENCE_END = r"[.!?](?=\s|$)|[。！？]"
TRAILING = r"(?U)[\s.。:：;；,，、!！?？]+$"
HYPHENS = "‐‑‒­"
BULLET = r"^(\s*(?:[•●▪◦○■□·*–-](?=\s|[^\d\s])|\(?\d{1,2}[.)](?!\d))\s*)(.*)$"
LIST_MARK = r"^\s*(?:[•●▪◦○■□・*]|[-–]\s|\(?\d{1,2}[.)](?!\d)\s?)"


def norm(text: Column) -> Column:
    """White space to single spaces, none at the ends. Most texts have single spaces only."""
    return F.trim(F.when(text.rlike(r"(?U)[\s&&[^ ]]|  "), F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text))


def has_text(text: Column) -> Column:
    """Whether there is more than white space."""
    return text.rlike(r"(?U)\S")


def stripped(text: Column) -> Column:
    """Without white space at the ends, which most texts haven't."""
    return F.when(F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def casefold(text: Column) -> Column:
    """Lower case, with ß as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squash(text: Column) -> Column:
    """Compatibility form without white space, soft hyphens and zero-width spaces."""
    return F.regexp_replace(nfkc(text), r"(?U)[\s­​]+", "")


def term_key(text: Column, target: str) -> Column:
    return F.lower(strip_tags(text)) if target in LATIN else F.regexp_replace(strip_tags(text), r"(?U)\s+", "")


def uses(translation: Column, term: Column, target: str) -> Column:
    """Whether the translation has the term, by the comparison key of the language."""
    return term_key(translation, target).contains(term_key(term, target))


def repeat_key(text: Column, latin: bool) -> Column:
    key = norm(text)
    key = F.when(F.right(key, F.lit(1)).rlike(TRAILING), F.regexp_replace(key, TRAILING, "")).otherwise(key)
    return casefold(key) if latin else F.replace(key, F.lit(" "), F.lit(""))


def fullwidth_to_ascii(text: Column) -> Column:
    """Letters and digits only."""
    return F.translate(text, FULLWIDTH, HALFWIDTH)


def tidy(source: Column, output: Column, target: str) -> Column:
    """Clean-up after translation that keeps the source's notation of units; the steps build on each other."""
    rare = output.rlike(r"[豈-﫿⼀-⿟]")  # of other texts nothing goes to the tasks' Python
    out = F.when(rare, nfkc_of(F.when(rare, output), r"[豈-﫿⼀-⿟]")).otherwise(output)
    if target in ("ja", "zh", "ko"):
        out = fullwidth_to_ascii(out)
    if target in ("ja", "zh"):
        out = F.regexp_replace(out, CJK_GAP, "")
    out = let(out, lambda o: F.when(~source.contains("％"), F.replace(o, F.lit("％"), F.lit("%"))).otherwise(o))
    if target in ("ja", "zh", "ko"):
        return F.regexp_replace(out, r"(?U)\s?°\s?C", "℃")
    degrees = lambda o: F.when(source.contains(" °C"), F.regexp_replace(o, r"(?U)\s?℃", " °C")).otherwise(F.regexp_replace(o, r"(?U)\s?℃", "°C"))
    out = let(out, lambda o: F.when(~source.contains("℃") & source.contains("°C"), degrees(o)).otherwise(o))
    if target not in LATIN:
        return out

    def narrowed(o):
        for wide, narrow in (("（", "("), ("）", ")"), ("～", "–"), ("〜", "–"), ("，", ", "), ("；", "; "), ("：", ": ")):
            o = F.replace(o, F.lit(wide), F.lit(narrow))
        wide = "".join(map(chr, [*range(0xFF01, 0xFF5F), 0x3000]))
        return F.translate(o, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")

    # Most texts have no such character; two blanks become one in all.
    out = F.replace(let(out, lambda o: F.when(o.rlike("[\u3000\u301c\uff01-\uff5e]"), narrowed(o)).otherwise(o)), F.lit("  "), F.lit(" "))

    def raised(o):
        lead = F.length(F.regexp_extract(o, r"^(<g\d+>)?", 0))
        up = F.concat(F.substr(o, F.lit(1), lead), F.upper(F.substr(o, lead + 1, F.lit(1))), F.substr(o, lead + 2))
        return F.when(o.rlike(r"^(?:<g\d+>)?[a-z]") & ~o.rlike(r"^(?:<g\d+>)?[a-z]+[A-Z0-9]"), up).otherwise(o)

    return let(out, raised)


def nfkc_of(text: Column, characters: str) -> Column:
    """The compatibility form of just these characters."""
    each = F.transform(F.split(text, ""), lambda c: c)
    whole, plain = F.split(nfkc(text), ""), each
    same = F.size(whole) == F.size(plain)
    picked = F.transform(F.arrays_zip(plain.alias("a"), whole.alias("b")), lambda z: F.when(z["a"].rlike(characters), z["b"]).otherwise(z["a"]))
    return F.when(same, F.array_join(picked, "")).otherwise(nfkc(text))


def restore_parentheses(source: Column, output: Column, tokens: Column, target: str) -> Column:
    """Brackets again around the tokens that stand in brackets in source; doubled ones made single."""
    out = F.regexp_replace(output, r"([（(])\s*[（(](.+?)[）)]\s*([）)])", "$1$2$3")
    opening, closing = ("（", "）") if target in ("ja", "zh", "ko") else (" (", ")")

    def step(at, t):
        bare = F.concat(F.lit(r"\s*(?<![A-Za-z0-9])"), escaped(t), F.lit("(?![A-Za-z0-9])"))
        has = F.regexp_like(at, F.concat(F.lit(r"[（(]\s*"), escaped(t), F.lit(r"\s*[）)]")))

        def put(first):
            place = F.instr(at, first)
            return F.coalesce(F.concat(F.substr(at, F.lit(1), place - 1), F.lit(opening), t, F.lit(closing), F.substr(at, place + F.length(first))), at)

        return F.when(at.contains(t) & ~has, let(F.regexp_substr(at, bare), put)).otherwise(at)

    return F.aggregate(parenthesised(source, tokens), out, step)


def sentences(text: Column) -> Column:
    t = stripped(text)
    ends = F.regexp_count(t, F.lit(SENTENCE_END))
    return F.when(t == "", 0).when(F.right(t, F.lit(1)).rlike(SENTENCE_END), ends).otherwise(ends + 1)


def clean_candidate(raw: Column, source: Column, target: str) -> Column:
    """A plausible short translation of a term, or the empty string."""
    from .languages import SCRIPT

    out = F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), "^[。.、,「」\"']+|[。.、,「」\"']+$", "")
    out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    bad = (out == "") | out.contains("\n") | (F.length(out) > 4 * F.length(source) + 10)
    wrong = out.rlike(r"[぀-ヿ一-鿿]") if target in LATIN else ~out.rlike(SCRIPT[target])
    return F.when(bad | wrong, "").otherwise(out)


# Forms that text recognition returns for Japanese, each before what it stands for.
FORMS = {
    "值": "値", "设": "設", "计": "計", "电": "電", "冻": "凍", "统": "統", "时": "時", "间": "間", "备": "備", "调": "調",
    "节": "節", "动": "動", "态": "態", "报": "報", "监": "監", "视": "視", "测": "測", "运": "運", "转": "転", "输": "輸",
    "压": "圧", "负": "負", "载": "載", "热": "熱", "换": "換", "风": "風", "门": "門", "阀": "閥", "络": "絡", "线": "線",
    "图": "図", "库": "庫", "码": "碼", "类": "類", "级": "級", "页": "頁", "项": "項", "题": "題", "单": "単", "发": "発",
    "开": "開", "关": "関", "闭": "閉", "东": "東", "车": "車", "层": "層", "场": "場", "产": "産", "业": "業", "务": "務",
    "检": "検", "验": "験", "试": "試", "编": "編", "辑": "輯", "启": "啓", "确": "確", "认": "認", "说": "説", "长": "長",
    "宽": "寛", "离": "離", "远": "遠", "进": "進", "过": "過", "还": "還", "这": "這", "们": "們", "为": "為", "对": "対",
    "应": "応", "显": "顕", "传": "伝", "环": "環", "费": "費", "预": "予", "维": "維", "护": "護", "养": "養", "溫": "温",
    "氣": "気", "體": "体", "當": "当", "圖": "図", "數": "数", "處": "処", "變": "変", "轉": "転", "經": "経", "實": "実",
    "價": "価", "單": "単", "發": "発", "會": "会", "學": "学", "樣": "様", "擴": "拡", "檢": "検", "濕": "湿", "壓": "圧",
    "廣": "広", "應": "応", "點": "点", "鐵": "鉄", "總": "総", "驗": "験",
}
LOOKALIKE = {"工": "エ", "口": "ロ", "力": "カ", "二": "ニ", "一": "ー", "夕": "タ", "卜": "ト", "八": "ハ"}


def fix_japanese(text: Column) -> Column:
    """Recognition errors in Japanese: foreign forms, 机 for 機 after a kanji, kanji for katakana in a katakana word."""
    out = F.regexp_replace(F.translate(text, "".join(FORMS), "".join(FORMS.values())), r"(?<=[一-鿿])机", "機")
    for kanji, kana in LOOKALIKE.items():
        out = F.regexp_replace(out, rf"(?<![一-鿿]){kanji}(?=[ァ-ヺ])", kana)
    return out


def clean_span(text: Column) -> Column:
    """Hyphen variants to the plain one, no-break spaces to spaces."""
    return F.translate(text, HYPHENS + " ", "-" * len(HYPHENS) + " ")


def list_mark(text: Column) -> Column:
    """The list mark that text starts with, null if none."""
    return F.nullif(F.regexp_extract(text, LIST_MARK, 0), F.lit(""))


def unlisted(text: Column) -> Column:
    """What follows the list mark."""
    return F.regexp_replace(text, LIST_MARK, "")


def notation(text: Column) -> Column:
    """For comparing recognised text: no white space, compatibility forms, one dash and one bullet."""
    plain = F.regexp_replace(F.translate(text, "­ ", "- "), r"(?U)\s+", "")
    return F.translate(nfkc(plain), "‒–—‐・〜", "----•~")


def where_label(container: Column, is_page: Column) -> Column:
    return F.concat(F.when(is_page, "page ").otherwise("slide "), container.cast("string"))


def joined_lines(lines: Column) -> Column:
    """Lines of a paragraph as one: words divided by a hyphen put together, no space beside Japanese or Chinese."""
    cjk = r"[぀-ヿ一-鿿]"

    def step(at, line):
        together = F.regexp_like(at, F.lit(cjk + "$")) | F.regexp_like(line, F.lit("^" + cjk))
        divided = F.regexp_like(at, F.lit(r"[a-z]-$")) & F.regexp_like(line, F.lit("^[a-z]"))
        return F.when(at == "", line).when(divided, F.concat(F.regexp_replace(at, "-$", ""), line)).when(together, F.concat(at, line)).otherwise(F.concat(at, F.lit(" "), line))

    return F.aggregate(lines, F.lit(""), step)
