"""Text functions as Column expressions: whitespace, scripts, keys, cleaning, splitting."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: All that a Unicode-aware strip takes off, as a class: Unicode white space and the four information separators. Written out, as a
#: regular expression tests a list of ranges faster than a Unicode property; and letters fail two ranges before they meet the list.
SPACE = rf"[\t-\x20\x85-\u3000&&[{_SPACES}]]"
#: All others.
SOLID = rf"[^{_SPACES}]"
#: The same characters, one by one.
SPACE_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Characters that mark a text as Traditional Chinese in candidate selection.
TRADITIONAL_MARKS = (
    "體臺灣國語門風龍馬鳥魚貝車長東電會學萬與專業網頁點擊"
    "後來開關樂書時過無對發現為這個們還進廣場線愛雲氣區"
    "醫藥術聽說讀寫貓畫戰爭讓從應當實驗數據資料軟體硬體"
)

# Single Traditional characters and their Simplified forms, used for lexicon terms.
TO_SIMPLIFIED = {
    "歲": "岁", "隊": "队", "長": "长", "侶": "侣", "國": "国", "學": "学", "會": "会", "說": "说", "這": "这", "個": "个", "們": "们", "來": "来",
    "時": "时", "對": "对", "發": "发", "過": "过", "還": "还", "後": "后", "裡": "里", "為": "为", "與": "与", "開": "开", "關": "关", "點": "点",
    "種": "种", "體": "体", "頭": "头", "無": "无", "業": "业", "東": "东", "車": "车", "門": "门", "問": "问", "間": "间", "現": "现", "電": "电",
    "話": "话", "書": "书", "買": "买", "賣": "卖", "貓": "猫", "馬": "马", "鳥": "鸟", "魚": "鱼", "風": "风", "飛": "飞", "愛": "爱", "聽": "听",
    "讀": "读", "寫": "写", "線": "线", "網": "网", "義": "义", "氣": "气", "漢": "汉", "語": "语", "萬": "万",
}
#: Entries that the lookup key doesn't map.
NOT_IN_LOOKUP = frozenset("侶飛義")

# English words too common to pivot on.
PIVOT_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "for", "from", "had", "has", "have", "he", "her", "him", "his", "i", "in", "is",
    "it", "its", "me", "my", "of", "on", "or", "our", "she", "that", "the", "their", "them", "there", "these", "they", "this", "those", "to", "was",
    "we", "were", "with", "you", "your",
)

SCRIPTS = {"latin": "[A-Za-z]", "thai": "[\\u0e00-\\u0e7f]", "cjk": "[\\u4e00-\\u9fff]"}

# What is taken out of a dictionary definition, in turn; its longest length, and what it must not hold then.
DEFINITION_CUTS = (r"^CL:.*$", r"(?i)^variant of .*$", r"(?i)^old variant of .*$", r"(?i)^abbr\. for .*$", r"\b(?:Tw|Taiwan|PRC|Mainland China) pr\..*$", r"(?U)\s*\([^)]*\)")
DEFINITION_MOST, DEFINITION_BAD = 80, r"\[|\]|surname |see also "


# Fixed value: characters of the Simplified standard that count as Traditional all the same.
ALSO_TRADITIONAL = "於夥徵沈猛著"


def _in_standard(char: str) -> bool:
    try:
        return bool(char.encode("gb2312"))
    except UnicodeEncodeError:
        return False


@cache
def _traditional(spark: SparkSession) -> str:
    every = [chr(c) for c in range(0x4E00, 0xA000)]
    simple = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate("\n".join(every)).split("\n")
    return "".join(a for a, b in zip(every, simple, strict=True) if a != b and not _in_standard(a)) + ALSO_TRADITIONAL


def traditional_characters(spark: SparkSession | None = None) -> str:
    """Characters that only Traditional text has: those that the Unicode consortium's Traditional-Simplified rules change (Spark ships ICU) and that the Simplified character standard GB 2312 lacks, and a few more.

    Operators that turn such terms away take another list as a parameter.
    """
    return _traditional(spark or SparkSession.active())


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), with c worked out once however often then names it: as a lambda's argument."""
    return F.transform(F.array(c), then)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def normalize_space(c: Column) -> Column:
    """Runs of white space, ideographic space included, become one space; ends are stripped."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def nonblank(c: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_nonblank(*columns: Column) -> Column:
    """The first of columns that holds text, stripped."""
    return F.coalesce(*[nonblank(c.cast("string")) for c in columns])


def script_count(c: Column, script: str) -> Column:
    """Characters of the script: what is missing when their runs are taken out."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{SCRIPTS[script]}+", ""))


def script_ratio(c: Column, script: str) -> Column:
    """Share of the script among characters that aren't white space; 0 for none."""
    solid = F.length(F.regexp_replace(c, f"{SPACE}+", ""))
    return F.coalesce(F.try_divide(script_count(c, script), solid), F.lit(0.0))


def latin_ratio(c: Column) -> Column:
    """script_ratio of Latin letters for long columns, as an Arrow function: a regular expression that takes words out copies word by word. Not within lambdas."""
    letters = "".join(chr(i) for i in range(128) if chr(i).isalpha()).encode()

    def ratio(text: bytes) -> float:
        rest = text.translate(None, letters)
        count = len(text) - len(rest)
        solid = count + len("".join(rest.decode().split()))
        return count / solid if solid else 0.0

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([ratio(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.float64())

    return run(c)


def has_any(c: Column, characters: str) -> Column:
    """Whether any of the characters occurs. What lies outside their range goes first: translate looks each character up."""
    if not characters:
        return F.length(c) < 0
    inside = F.regexp_replace(c, rf"[^\x{{{ord(min(characters)):x}}}-\x{{{ord(max(characters)):x}}}]+", "")
    return F.exists(F.array(inside), lambda v: F.translate(v, characters, "") != v)


def is_simplified(c: Column, least: float, marks: str = TRADITIONAL_MARKS) -> Column:
    return ~has_any(c, marks) & (script_ratio(c, "cjk") >= least)


def speaks(c: Column, lang: Column, thai: float = 0.35, cjk: float = 0.45, latin: float = 0.45) -> Column:
    """Whether a text is in the script of its language: Simplified Chinese, Thai, or else Latin."""
    return F.when(lang == "zho_Hans", is_simplified(c, cjk)).when(lang == "tha_Thai", script_ratio(c, "thai") >= thai).otherwise(latin_ratio(c) >= latin)


def to_simplified(c: Column) -> Column:
    return F.translate(c, "".join(TO_SIMPLIFIED), "".join(TO_SIMPLIFIED.values()))


def fold_key(text: str) -> str:
    """NFKC, case folding, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", " ".join(text.split())).casefold().split())


_LOOKUP_MAP = str.maketrans({k: v for k, v in TO_SIMPLIFIED.items() if k not in NOT_IN_LOOKUP})


def lookup_key(text: str) -> str:
    """fold_key, then single Traditional characters to Simplified."""
    return fold_key(text).translate(_LOOKUP_MAP)


def _mapped(function):
    """function over an Arrow string column; each distinct value is worked out once a batch."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()
        done = pa.array([None if v is None else function(v) for v in coded.dictionary.to_pylist()], pa.string())
        return done.take(coded.indices)

    return run


def normalize_key(c: Column) -> Column:
    """Key of lexicon terms (no built-in has NFKC or case folding, so this is an Arrow function)."""
    return _mapped(fold_key)(c)


def distinct_keys(c: Column) -> Column:
    """An array's texts without those whose key came before, in order."""

    def first(texts: list[str | None]) -> list[str]:
        kept: dict[str, str] = {}
        for t in texts:
            if t is not None:
                kept.setdefault(fold_key(t), t)
        return list(kept.values())

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if v is None else first(v) for v in lists.to_pylist()], pa.list_(pa.string()))

    return run(c)


def normalize_lookup_key(c: Column) -> Column:
    return _mapped(lookup_key)(c)


def casefold(c: Column) -> Column:
    return _mapped(str.casefold)(c)


def usable_pivot(key: Column) -> Column:
    """Whether a normalised English key is worth joining on."""
    return (F.length(key) >= 3) & ~key.isin(*PIVOT_STOPWORDS)


def stable_seed(key: Column, seed: int) -> Column:
    """A 31-bit seed from a key and a global seed: a base-131 rolling hash in 32 bits, xor the seed."""
    rolled = F.aggregate(F.split(key, ""), F.lit(0).cast("long"), lambda h, ch: F.when(ch == "", h).otherwise((h * 131 + F.ascii(ch)).bitwiseAND(F.lit(0xFFFFFFFF))))
    return rolled.bitwiseXOR(F.lit(seed).cast("long")).bitwiseAND(F.lit(0x7FFFFFFF))


def strip_think(c: Column) -> Column:
    """Without <think>…</think> passages."""
    return strip(F.regexp_replace(c, r"(?is)<think>.*?</think>\s*", ""))


def flatten_message(c: Column) -> Column:
    """Text of a chat message's content given as JSON: null, a string, an object, or a list of strings and objects with text or content."""
    part = "struct<text:string,content:string>"
    listed = F.from_json(c, "array<string>")

    def piece(x: Column) -> Column:
        inner = F.from_json(x, part)
        return F.coalesce(F.when(x.startswith("{"), F.coalesce(inner["text"], inner["content"], F.lit(""))), x, F.lit(""))

    whole = F.from_json(c, part)
    quoted = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0]
    return F.when(c.isNull() | (F.trim(c) == "null"), "").when(F.ltrim(c).startswith("["), F.array_join(F.transform(listed, piece), "")).when(F.ltrim(c).startswith("{"), F.coalesce(whole["text"], whole["content"], F.lit(""))).when(F.ltrim(c).startswith('"'), quoted).otherwise(c)


def clean_definition(c: Column) -> Column:
    """A dictionary definition without classifiers, variants, abbreviations, regional readings and brackets; null if nothing fit is left."""
    out = normalize_space(c)
    for pattern in DEFINITION_CUTS:
        out = F.regexp_replace(out, pattern, "")
    def fit(v: Column) -> Column:
        return F.when((v != "") & (F.length(v) <= DEFINITION_MOST) & ~v.rlike(DEFINITION_BAD), v)

    return once(F.btrim(out, F.lit(" ;,")), fit)


def pack_sentences(c: Column, max_chars: int, separators: str = r"(?:\\n+|[.!?！？。；;])") -> Column:
    """Pieces of at most max_chars: a text that fits comes back whole, else its sentences packed greedily, joined by a space; a longer piece is cut off.

    separators keeps the literal backslash-n of the corpus format. Pieces hold no white space but single spaces. An Arrow
    function: as a fold of built-ins, which Spark interprets, this was most of the time of all that packs texts.
    """
    ends = re.compile(separators)

    def packed(text: str) -> list[str]:
        text = " ".join(text.split())
        if len(text) <= max_chars:
            return [text] if text else []
        out, buf, size = [], [], 0
        for part in ends.sub("\n", text).split("\n"):  # no other line end is left
            part = part.strip()[:max_chars].strip()
            if part and buf and size + 1 + len(part) > max_chars:
                out.append(" ".join(buf))
                buf, size = [part], len(part)
            elif part:
                size += len(part) + bool(buf)
                buf.append(part)
        return [*out, " ".join(buf)] if buf else out

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([packed(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(c)


def join_lines(c: Column) -> Column:
    """One stripped line for a subprocess's standard input."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", " "))
