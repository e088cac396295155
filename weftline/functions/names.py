"""Languages, directions, instructions and file names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language codes with English and Chinese names.
LANGUAGES = {
    "eng_Latn": ("English", "英语"), "zho_Hans": ("Simplified Chinese", "简体中文"), "zho_Hant": ("Traditional Chinese", "繁体中文"), "spa_Latn": ("Spanish", "西班牙语"),
    "fra_Latn": ("French", "法语"), "deu_Latn": ("German", "德语"), "ita_Latn": ("Italian", "意大利语"), "por_Latn": ("Portuguese", "葡萄牙语"),
    "rus_Cyrl": ("Russian", "俄语"), "ukr_Cyrl": ("Ukrainian", "乌克兰语"), "pol_Latn": ("Polish", "波兰语"), "nld_Latn": ("Dutch", "荷兰语"),
    "swe_Latn": ("Swedish", "瑞典语"), "dan_Latn": ("Danish", "丹麦语"), "nob_Latn": ("Norwegian Bokmal", "挪威语（书面）"), "fin_Latn": ("Finnish", "芬兰语"),
    "ces_Latn": ("Czech", "捷克语"), "ell_Grek": ("Greek", "希腊语"), "heb_Hebr": ("Hebrew", "希伯来语"), "tur_Latn": ("Turkish", "土耳其语"),
    "arb_Arab": ("Arabic", "阿拉伯语"), "fas_Arab": ("Persian", "波斯语"), "hin_Deva": ("Hindi", "印地语"), "ben_Beng": ("Bengali", "孟加拉语"),
    "urd_Arab": ("Urdu", "乌尔都语"), "ind_Latn": ("Indonesian", "印度尼西亚语"), "vie_Latn": ("Vietnamese", "越南语"), "tha_Thai": ("Thai", "泰语"),
    "tgl_Latn": ("Tagalog", "他加禄语"), "kor_Hang": ("Korean", "韩语"), "zsm_Latn": ("Malay", "马来语"), "mya_Mymr": ("Burmese", "缅甸语"),
    "khm_Khmr": ("Khmer", "高棉语"), "lao_Laoo": ("Lao", "老挝语"), "cmn_Hans": ("Mandarin Chinese (Simplified)", "普通话（简体）"), "yue_Hant": ("Cantonese", "粤语"),
}
# Two-letter codes of public bilingual word lists.
SHORT_CODES = {"eng_Latn": "en", "zho_Hans": "zh", "spa_Latn": "es", "ind_Latn": "id", "vie_Latn": "vi", "tha_Thai": "th", "tgl_Latn": "tl"}
LOW_RESOURCE = ("spa_Latn", "ind_Latn", "vie_Latn", "tha_Thai", "tgl_Latn")
PIVOTS = ("eng_Latn", "zho_Hans")

STEP = r"checkpoint[-_]?(\d+)"


def mapped(c: Column, values: Mapping[str, str], otherwise: Column | None = None) -> Column:
    """values[c] from a small literal map; the code itself, or otherwise, where absent."""
    literal = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(literal[c], c if otherwise is None else otherwise)


def language_name(code: Column, chinese: bool = False) -> Column:
    code = F.trim(code)
    return mapped(code, {k: v[chinese] for k, v in LANGUAGES.items()})


def name_of(code: str, chinese: bool = False) -> str:
    return LANGUAGES.get(code.strip(), (code.strip(),) * 2)[chinese]


# The sentences of instructions.
SENTENCE = "Translate the following %s text into %s. Output only the translation."
SIMPLIFIED_ONLY = " Do not use Traditional Chinese."
TERM = "Translate the following %s dictionary term into %s. Output only the best translation."
CHINESE_SENTENCE = "请将以下 %s 文本翻译为 %s，只输出译文。"
BARE = "Translate the following %s text into %s. Output only the translation, no explanations."


def sentence_instruction(src: Column, tgt: Column) -> Column:
    return F.format_string(SENTENCE, language_name(src), language_name(tgt))


def candidate_instruction(src: Column, tgt: Column) -> Column:
    """sentence_instruction; into Simplified Chinese its full stop gives way to one sentence more."""
    base = sentence_instruction(src, tgt)
    return F.when(tgt == "zho_Hans", F.concat(F.regexp_replace(base, r"\.$", ""), F.lit(SIMPLIFIED_ONLY))).otherwise(base)


def strict_instruction(src: Column, tgt: Column) -> Column:
    """sentence_instruction; into Simplified Chinese followed by one sentence more."""
    base = sentence_instruction(src, tgt)
    return F.when(tgt == "zho_Hans", F.concat(base, F.lit(SIMPLIFIED_ONLY))).otherwise(base)


def term_instruction(src: Column, tgt: Column) -> Column:
    return F.format_string(TERM, language_name(src), language_name(tgt))


def chinese_instruction(src: Column, tgt: Column) -> Column:
    return F.format_string(CHINESE_SENTENCE, language_name(src, True), language_name(tgt, True))


def bare_instruction(src: Column, tgt: Column) -> Column:
    return F.format_string(BARE, language_name(src), language_name(tgt))


def prompt(instruction: Column, text: Column) -> Column:
    return F.concat(instruction, F.lit("\n\n"), text)


def pair_of(src: Column, tgt: Column) -> Column:
    return F.concat(src, F.lit("->"), tgt)


def source_of(pair: Column) -> Column:
    """Raises where there is no arrow."""
    return F.when(pair.contains("->"), F.trim(F.split(pair, "->", 2)[0])).otherwise(F.raise_error(F.concat(F.lit("no -> in pair: "), pair)))


def target_of(pair: Column) -> Column:
    """Empty where there is no arrow."""
    return F.when(pair.contains("->"), F.trim(F.split(pair, "->", 2)[1])).otherwise(F.lit(""))


def tokenizer_for(corpus: Column, pair: Column, policy: Column) -> Column:
    """The BLEU tokenizer's name by policy: legacy, flores200, or auto."""
    tgt = target_of(pair)
    plain = F.when(tgt.startswith("zho_") | tgt.startswith("cmn_"), "zh").otherwise("13a")
    policy = F.lower(F.trim(F.coalesce(F.nullif(policy, F.lit("")), F.lit("auto"))))
    auto = F.when(tgt.startswith("tha_"), "pythai_newmm").when(F.lower(F.coalesce(corpus, F.lit(""))) == "flores", "flores200").otherwise(plain)
    return F.when(policy == "legacy", plain).when(policy == "flores200", F.lit("flores200")).otherwise(auto)


def step_of(path: Column) -> Column:
    """The training step in the path part nearest its end; null if none."""
    return F.try_element_at(F.regexp_extract_all(path, F.lit(STEP), F.lit(1)), F.lit(-1)).cast("int")


def adapter_pair(name: Column, prefix: str = "") -> Column:
    """a->b from <prefix>a_to_b; raises otherwise."""
    body = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 20)).otherwise(name) if prefix else name
    parts = F.split(body, "_to_", 2)
    return F.when(F.size(parts) == 2, F.concat(parts[0], F.lit("->"), parts[1])).otherwise(F.raise_error(F.concat(F.lit("no pair in adapter name: "), name)))


def file_pair(path: Column, prefix: str = "nllb_mt_") -> Column:
    """struct(src, tgt) from <prefix>src__tgt.jsonl; raises otherwise."""
    name = F.element_at(F.split(path, "/"), -1)
    pattern = f"^{re.escape(prefix)}(.+?)__(.+)\\.jsonl$"
    bad = F.raise_error(F.concat(F.lit("no pair in file name: "), name))
    src = F.when(name.rlike(pattern), F.trim(F.regexp_extract(name, pattern, 1))).otherwise(bad)
    return F.struct(src.alias("src_lang"), F.trim(F.regexp_extract(name, pattern, 2)).alias("tgt_lang"))


def signed(value: Column, decimals: int = 2) -> Column:
    """+1.25, -0.50, 0.00."""
    shown = F.format_string(f"%.{decimals}f", value)
    return F.when(value > 0, F.concat(F.lit("+"), shown)).otherwise(shown)


def pairs_hint(pairs: Column, shown: int = 30) -> Column:
    """The first pairs of an array and how many more there are; none for an empty one."""
    more = F.size(pairs) - shown
    head = F.slice(pairs, 1, shown)
    text = F.array_join(F.when(more > 0, F.array_append(head, F.format_string("... (+%d more)", more))).otherwise(head), ", ")
    return F.when(F.size(pairs) > 0, text).otherwise("none")


def dataset_name(stem: str) -> str:
    """A registry name from a file's stem."""
    return re.sub(r"[^0-9A-Za-z_]+", "_", stem)


def preview_name(stem: str, n: int = 50) -> str:
    return f"previews/{stem}.preview_{n}.jsonl"


def direction_file(kind: str, src: str, tgt: str) -> str:
    return f"{kind}_{src}__{tgt}.jsonl"


def yaml_quoted(value: str) -> str:
    """A scalar in single quotes, its own doubled."""
    return "'" + value.replace("'", "''") + "'"


def relative_path(path: str, base: str, absolute: bool = False) -> str:
    """A path below base without it; others, and all where absolute ones are asked for, as they are."""
    p = PurePosixPath(path)
    return str(p if absolute or not p.is_absolute() or not p.is_relative_to(base) else p.relative_to(base))


def short_code(lang: str) -> str:
    return SHORT_CODES[lang]


def word_list_url(src: str, tgt: str, base: str) -> str:
    return f"{base.rstrip('/')}/{short_code(src)}-{short_code(tgt)}.txt"


def ordered_distinct(items: Iterable) -> list:
    return list(dict.fromkeys(items))
