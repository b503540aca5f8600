"""Text expressions: every function takes and returns a Column. [H1 H2 H5 H12-H20 B2 B6 B8 B9]"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, as a regex class.
SPACE = r"[\t-\r\x1C-\x20\x85\xA0  -     　]"
CJK = r"[一-鿿]+"


def collapse_space(text: Column) -> Column:
    """White space runs become one blank, none at the ends. [B2]"""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def without_space(text: Column) -> Column:
    """Text with all white space removed. [B2]"""
    return F.regexp_replace(text, f"{SPACE}+", "")


def _grams(text: Column, n: int) -> Column:
    """Overlapping runs of n characters: a look-ahead at each place that is not inside a surrogate pair."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(\P{{Cs}}.{{{n - 1}}}))"), F.lit(1))


def _cjk_tokens(run: Column) -> Column:
    whole = F.when(F.length(run) <= 8, F.array(run)).otherwise(F.array().cast("array<string>"))
    return F.concat(whole, _grams(run, 2), _grams(run, 3))


def tokens(text: Column) -> Column:
    """Lower-case words of [a-z0-9_]; for each run of CJK characters the run itself up to 8, then its 2- and 3-grams. [H1]"""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9_]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    return F.when(F.size(runs) == 0, words).otherwise(F.concat(words, F.flatten(F.transform(runs, _cjk_tokens))))


def terms(text: Column) -> Column:
    """Distinct tokens in the order of their first appearance. [H2 G2]"""
    return F.array_distinct(tokens(text))


def features(text: Column) -> Column:
    """Words, CJK characters and CJK 2-grams; the lower-case text itself if there is none. [H3]"""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9_]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    found = F.when(F.size(runs) == 0, words).otherwise(F.concat(words, F.flatten(F.transform(runs, lambda r: F.concat(_grams(r, 1), _grams(r, 2))))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(low))


def bigrams(text: Column) -> Column:
    """Distinct character 2-grams of the text without white space."""
    return F.array_distinct(_grams(without_space(text), 2))


def bigram_overlap(question: Column, quote: Column) -> Column:
    """Share of the question's 2-grams that the quote has too; 0 without any. [H16]"""
    own = bigrams(question)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, bigrams(quote))) / F.size(own))


def unsupported_numbers(answer: Column, quote: Column) -> Column:
    """Sorted distinct numbers of the answer that the quote lacks. [H17]"""
    flat = without_space(quote)
    numbers = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0)))
    return F.array_sort(F.filter(numbers, lambda n: ~F.contains(flat, n)))


def mask_personal(text: Column) -> Column:
    """Mobile numbers of 11 digits and 18-character identity numbers replaced. [H12]"""
    return F.regexp_replace(F.regexp_replace(text, r"(?<![0-9])1[0-9]{10}(?![0-9])", "[PHONE]"), r"(?U)\b[0-9]{17}[0-9Xx]\b", "[ID]")


def mask_map(values: Column) -> Column:
    """``mask_personal`` over the values of a map. [H12]"""
    return F.transform_values(values, lambda _, v: mask_personal(v))


def short_hash(text: Column) -> Column:
    """16 hex digits of sha256. [H13]"""
    return F.substring(F.sha2(text, 256), 1, 16)


UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def path_template(path: Column) -> Column:
    """UUIDs and numbers of four or more digits in a path become {id}. [H14]"""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.when(p.rlike(UUID) | p.rlike("^[0-9]{4,}$"), F.lit("{id}")).otherwise(p)), "/")


# Sentence ends, list and article markers of the label-set tools.
SENTENCE_ENDS = "。；！？"
MARKER = r"^(?:第[一二三四五六七八九十百]+条(?:\s*第[一二三四五六七八九十百]+条)*|（[一二三四五六七八九十]+）|\d+[.、])"
ITEM_START = r"(?!\s*(?:第[一二三四五六七八九十百]+条|（[一二三四五六七八九十]+）|\d+\.))"


def sentences(text: Column, join_lines_with: str = "", ends: str = SENTENCE_ENDS) -> Column:
    """Sentences after broken lines are joined again, without leading markers or blanks, none empty. [H15]

    ``ends``: the characters that end a sentence. A line goes on unless one of them or a colon stands at its end or an
    item begins the next.
    """
    joined = F.regexp_replace(text, rf"(?<![{ends}：])\n{ITEM_START}", join_lines_with)
    blank = f"^{SPACE}+|{SPACE}+$"
    clean = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, blank, ""), MARKER, ""), blank, "")
    return F.filter(F.transform(F.split(joined, f"[{ends}]"), clean), lambda s: s != "")


def without_titles(question: Column) -> Column:
    """Question without bracketed titles. [H18]"""
    return F.trim(F.regexp_replace(question, "《[^》]+》", ""))


def with_planted(answer: Column, sentence: Column) -> Column:
    """Answer, right-trimmed, with a sentence on a line of its own. [H19]"""
    return F.concat(F.regexp_replace(answer, f"{SPACE}+$", ""), F.lit("\n"), sentence)


def unit_score(value: Column) -> Column:
    """A number or boolean as a double between 0 and 1; null stays. [H20]"""
    number = value.cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


# Words and shapes that mark a line as page chrome.
CHROME_WORDS = (
    "首页", "版权所有", "网站地图", "站点地图", "icp备", "icp证", "公安备案", "打印本页", "关闭窗口", "分享到", "无障碍", "是否继续", "即将离开", "主办单位",
    "承办单位", "技术支持", "网站声明", "联系我们", "返回顶部", "扫一扫", "关注我们", "手机版", "字体大小", "字号", "上一篇", "下一篇", "浏览次数", "访问量",
)
CHROME_LINE = r"^[×✕✖xX]$|^[0-9a-fA-F]{16,}$|^[A-Za-z0-9+/=]{24,}$"


def is_chrome(line: Column, longest: int = 40) -> Column:
    """Whether a line is page chrome: short, and a close mark, a hex or base64 token, or holding a chrome word. [B6]"""
    return (F.length(line) <= longest) & (line.rlike(CHROME_LINE) | F.lower(line).rlike("|".join(CHROME_WORDS)))


def content_lines(text: Column) -> Column:
    """Lines with inner blanks collapsed; empty lines and page chrome dropped. [B6]"""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t　\xA0]+", " "), f"^{SPACE}+|{SPACE}+$", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~is_chrome(x)), "\n")


def fingerprint(**fields: Column) -> Column:
    """sha256 of the fields as JSON, sorted by name. [H21]"""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times; 0 if not ended. [H22]"""
    return F.coalesce((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000, F.lit(0.0))
