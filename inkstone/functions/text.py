"""Text expressions: trimming, cleaning, normal forms, record numbers, record types and predicates.

White space and digits are spelled out, so that an expression means the same in every engine: white space is what
Python's str.strip removes, digits are ASCII and full-width ones. All expressions give NULL for NULL unless they say
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, inside a character class.
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S = f"[{WS}]"
D = "[0-9０-９]"
#: The patterns of page marks that cleaning removes, in this order.
PAGE_MARKS = (
    f"---{S}*第{S}*{D}+{S}*页{S}*---",
    f"第{S}*{D}+{S}*页{S}*/{S}*共{S}*{D}+{S}*页",
    f"第{S}*{D}+{S}*页",
    f"共{S}*{D}+{S}*页",
)
#: Characters that cleaning keeps, inside a character class.
KEPT = rf"\x{{4e00}}-\x{{9fa5}}a-zA-Z0-9{WS}.,;:!?()\[\]{{}}+\-*/=><\^％%×÷√≤≥≈∑∏π·_∠°′″→|‖∥⊥∈∉⊂⊆⊇∪∩±≡≠"
#: Punctuation that normal forms leave out, inside a character class.
PUNCTUATION = r"，,。.；;：:！!？?（）()【】\[\]《》<>“”\"'‘’、"
#: Words by which short texts are told to be instructions; 页 counts twice.
INSTRUCTION_WORDS = (
    "答卷前", "答题卡", "考生号", "考场号", "座位号", "填写在", "选择题时", "选出", "涂黑", "如需改动", "用橡皮擦", "非选择题", "黑色字迹",
    "签字笔", "答在", "答题区域", "超出答题区域", "在草稿纸", "试卷上", "均无效", "考试时间", "满分", "注意事项", "本试卷", "第", "页", "共",
    "页", "姓名", "班级", "学号",
)
INSTRUCTION_CARDS = ("答题卡", "考生号", "考场号", "座位号")
INSTRUCTION_SECTIONS = ("本题共", "多项选择", "部分选对", "全部选对", "有选错", "每小题")
CHOICE_WORDS = ("选择", "正确的是", "错误的是", "哪个")
BLANK_MARKS = ("____", "___", "（）", "()")
BLANK_WORDS = ("填空", "填入", "填在", "空格")
SOLVE_WORDS = ("解答", "求", "证明", "计算", "应用")
NUMBER_LIMIT, YEARS, NEVER_SORTED = 200, (1900, 2100), 1_000_000_000


def u_trim(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, f"^{S}+|{S}+$", "")


def has_any(x: Column, words: tuple[str, ...]) -> Column:
    """Whether x contains one of the words. False for NULL."""
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return F.coalesce(out, F.lit(False))


def hits(x: Column, words: tuple[str, ...]) -> Column:
    """How many of the words x contains; a word listed twice counts twice. 0 for NULL."""
    out = F.lit(0)
    for w in words:
        out = out + F.coalesce(x.contains(w).cast("int"), F.lit(0))
    return out


def clean_text(x: Column) -> Column:
    """Without page marks, long runs of line feeds, and characters outside the kept set; trimmed."""
    for p in PAGE_MARKS:
        x = F.regexp_replace(x, p, "")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return u_trim(F.regexp_replace(x, f"[^{KEPT}]", ""))


def join_ideographs(x: Column) -> Column:
    """Spacing as text recognition leaves it, repaired: no-break spaces and runs of blanks become one space, white space
    between ideographs goes, and runs of three or more line feeds become two."""
    x = F.regexp_replace(F.replace(x, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    x = F.regexp_replace(x, rf"(?<=[\x{{4e00}}-\x{{9fa5}}]){S}+(?=[\x{{4e00}}-\x{{9fa5}}])", "")
    return F.regexp_replace(x, r"\n{3,}", "\n\n")


def normal_form(x: Column) -> Column:
    """Lower case, without white space and punctuation. Empty for NULL."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), f"[{WS}{PUNCTUATION}]", "")


def question_form(x: Column) -> Column:
    """The normal form without a leading record number. Empty for NULL."""
    x = u_trim(F.coalesce(x, F.lit("")))
    return normal_form(F.regexp_replace(x, rf"^{S}*\(?{S}*{D}+{S}*\)?{S}*[.、]{S}*", ""))


def ascii_digits(x: Column) -> Column:
    return F.translate(x, "０１２３４５６７８９", "0123456789")


def _number(x: Column) -> Column:
    """The digits as a whole number in text; NULL if empty, a year, 0 or over the limit."""
    n = x.try_cast("bigint")
    return F.when(n.between(1, NUMBER_LIMIT) & ~n.between(*YEARS), n.cast("string"))


def first_group(x: Column, pattern: str) -> Column:
    """The first group of the pattern's first match; NULL without a match."""
    got = F.regexp_extract(x, pattern, 1)
    return F.when(got != "", got)


def number_in_record(x: Column) -> Column:
    """A record's number as extraction reads it: 1 to 4 digits and a mark or space, in range; else digits in
    parentheses, of any size and as they stand. NULL without one."""
    t = u_trim(x)
    plain = ascii_digits(first_group(t, rf"^({D}{{1,4}}){S}*(?:[.、)．]|{S})"))
    return F.when(plain.isNotNull(), _number(plain)).otherwise(first_group(t, rf"^\({S}*({D}+){S}*\)"))


def number_in_upload(x: Column) -> Column:
    """A record's number as keys are made from it: leading quotes are skipped, both forms are checked for range."""
    t = F.regexp_replace(u_trim(x), f"^[{WS}\"'“”‘’]+", "")
    plain = ascii_digits(first_group(t, rf"^({D}{{1,4}}){S}*(?:[.、)．]|{S})"))
    return F.when(plain.isNotNull(), _number(plain)).otherwise(_number(ascii_digits(first_group(t, rf"^\({S}*({D}{{1,4}}){S}*\)"))))


def record_type(x: Column) -> Column:
    """选择题 with an option mark, 填空题 with a blank, 解答题 with a word that asks for work, else 未知题型 (also for NULL)."""
    low = F.lower(x)
    options = F.coalesce(low.rlike(rf"[a-dＡ-Ｄ]{S}*[\\.|、)]"), F.lit(False))
    return (
        F.when(options, "选择题").when(has_any(x, BLANK_MARKS) | has_any(low, BLANK_WORDS), "填空题")
        .when(has_any(low, SOLVE_WORDS), "解答题").otherwise("未知题型")
    )


def is_subquestion(x: Column) -> Column:
    return F.coalesce(u_trim(x).rlike(rf"^\({S}*{D}+{S}*\)"), F.lit(False))


def is_complete(x: Column) -> Column:
    """A number in front, options where a choice is asked for, 30 characters, and something mathematical."""
    t = u_trim(x)
    numbered = t.rlike(rf"^{D}+[.、)]|^[一二三四五六七八九十]+[、．]|^\(?{D}+\)")
    choice = has_any(F.lower(t), CHOICE_WORDS)
    options = t.rlike(r"[A-Z][.、)]")
    maths = t.rlike(r"[0-9+\-×÷=<>≤≥≠√∑∏∫]|[a-z][²³]|[函数方程集合]")
    return F.coalesce((F.length(t) >= 30) & numbered & (~choice | options) & maths, F.lit(False))


def kept_after_extraction(x: Column) -> Column:
    return is_complete(x) | F.coalesce(number_in_record(x).isNotNull() & (F.length(u_trim(x)) >= 20), F.lit(False))


def kept_in_chunk(x: Column) -> Column:
    long = F.coalesce(F.length(u_trim(x)) >= 30, F.lit(False))
    return long & (is_complete(x) | number_in_record(x).isNotNull() | is_subquestion(x))


def is_instruction(x: Column) -> Column:
    """Two instruction words in under 100 characters, an answer-card word anywhere, or a section word in under 150."""
    low, n = F.lower(x), F.length(x)
    out = ((n < 100) & (hits(low, INSTRUCTION_WORDS) >= 2)) | has_any(low, INSTRUCTION_CARDS) | ((n < 150) & has_any(low, INSTRUCTION_SECTIONS))
    return F.coalesce(out, F.lit(False))


def meaningful_ratio(x: Column) -> Column:
    """Share of characters that are ASCII letters, digits or ideographs. 0 for empty text."""
    return F.regexp_count(x, F.lit(r"[A-Za-z0-9\x{4e00}-\x{9fa5}]")) / F.greatest(F.length(x), F.lit(1))


def image_links(x: Column) -> Column:
    """The Markdown images of a text, in order: (whole, alt, path)."""
    got = F.regexp_extract_all(x, F.lit(r"!\[[^\]]*\]\([^)]+\)"), 0)
    return F.transform(got, lambda s: F.struct(s.alias("whole"), F.regexp_extract(s, r"!\[([^\]]*)\]", 1).alias("alt"), F.regexp_extract(s, r"\]\(([^)]+)\)", 1).alias("path")))
