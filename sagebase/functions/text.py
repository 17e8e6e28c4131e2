"""Column expressions over text, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heading and marker patterns that results depend on.
MD_HEADING = r"^#{1,6}\s+\S[^。！？!?；;]*$"
CN_CHAPTER = r"^第[0-9一二三四五六七八九十百千]+[章节篇部分条款][^。！？!?；;]*$"
CN_ITEM = r"^[一二三四五六七八九十]+[、.．][^。！？!?；;]*$"
NUM_ITEM = r"^\d{1,3}([.．、]\d{1,3})*[.．、]?\s*\S[^。！？!?；;]*$"
NUM_PREFIX = r"^\d{1,3}([.．、]\d{1,3})*"
CJK = "[一-鿿㐀-䶿　-〿＀-￯]"
TOKEN_GAP = r"[^\p{L}\p{N}]+"
#: Deepest heading level.
LEVELS = 6


def jtrim(text: Column) -> Column:
    """Strips every character up to U+0020 at both ends, unlike Spark's trim."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"[^\x00-\x20]"), F.lit(False))


def cut(text: Column, n: int, more: str = "") -> Column:
    """The first n characters, with a mark where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(more))).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; runs of Han characters become overlapping pairs. Texts without Han characters are split only."""
    words = F.filter(F.split(F.lower(text), TOKEN_GAP), lambda w: w != "")
    pairs = lambda w: F.when(w.rlike("^[一-鿿]{2,}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))
    return F.when(text.rlike("[一-鿿]{2}"), F.flatten(F.transform(words, pairs))).otherwise(words)


def windows(text: Column, n: int) -> Column:
    """All runs of n characters, in one pass: a substring by place would count from the start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def trigrams(text: Column) -> Column:
    return F.array_distinct(windows(text, 3))


def token_estimate(text: Column) -> Column:
    """One token for each Han or full-width character, one for four others that aren't white space."""
    wide = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    other = F.length(F.regexp_replace(F.regexp_replace(text, CJK, ""), r"\s", ""))
    return F.coalesce((wide + F.ceil(other / 4.0)).cast("int"), F.lit(0))


def router_cap(estimate: Column) -> Column:
    need = F.ceil(estimate * 1.35) + 40
    return F.when(need <= 256, 256).when(need <= 512, 512).otherwise(1024)


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, null for any other."""
    t = jtrim(line)
    segments = F.size(F.regexp_extract_all(F.regexp_extract(t, NUM_PREFIX, 0), F.lit(r"(\d{1,3})"), 1))
    return (
        F.when(t.rlike(MD_HEADING), F.length(F.regexp_extract(t, "^(#+)", 1)))
        .when(t.rlike(CN_CHAPTER), 1)
        .when(t.rlike(CN_ITEM), 2)
        .when(t.rlike(NUM_ITEM), F.least(F.greatest(segments, F.lit(1)), F.lit(LEVELS)))
    )


def template_key(line: Column) -> Column:
    """What lines that differ in numbers only have in common."""
    return F.regexp_replace(jtrim(line), r"[0-9]+", "<NUM>")


def session_title(text: Column, most: int = 20) -> Column:
    """A short title from a question: first line, single spaces, no quotes around it."""
    line = F.element_at(F.split(jtrim(text), "\n"), 1)
    line = jtrim(F.regexp_replace(line, r"\s+", " "))
    line = F.regexp_replace(line, "^[\"'“”「」『』]+|[\"'“”「」『』]+$", "")
    return F.when(blank(text), F.lit("新会话")).otherwise(cut(line, most, "…"))


# Phrases that image readers put in front, and error texts as they are shown.
READER_PREFIXES = ("以下是识别结果：", "以下为识别内容：", "图片内容：", "页面内容：", "识别结果：", "转写结果：", "Markdown：")
CALL_NAMES = {"text 调用": "文本生成 调用", "stream 调用": "文本生成(流式) 调用", "vision 调用": "识图 调用", "embedding 调用": "向量化 调用"}
SHOWN_AS_IT_IS = "超时|繁忙|稍后重试|请检查"
TIMED_OUT = r"(?i)^.*(timed out|timeout|i/o error|request was interrupted|connection (reset|refused|closed)|read timed out|failed to fetch).*$"
FAILED, TIMED_OUT_TEXT = "问答失败，请稍后重试", "模型服务调用超时或连接中断，请稍后重试"


def reader_markdown(text: Column) -> Column:
    """An image reader's reply as markdown: without the fence around it and a phrase in front, headings on lines of their own, one blank line at most."""
    t = jtrim(F.coalesce(text, F.lit("")))
    rest = F.when(t.contains("\n"), F.regexp_replace(t, r"(?s)^[^\n]*\n", "")).otherwise(F.substring(t, 4, 1 << 30))
    t = F.when(t.startswith("```"), jtrim(F.regexp_replace(rest, r"(?s)^(.*)```.*$", "$1"))).otherwise(t)
    t = jtrim(F.regexp_replace(t, f"^({'|'.join(READER_PREFIXES)})", ""))
    t = F.regexp_replace(t, r"(?<!^)(?<![\r\n])#{1,6}\s+", "\n$0")
    return jtrim(F.regexp_replace(t, r"\n\s*\n\s*\n+", "\n\n"))


def text_poor(markdown: Column, least: int = 50) -> Column:
    """Whether a page says too little by its text, so that its picture is to be read."""
    return blank(markdown) | (F.length(jtrim(markdown)) < least)


def friendly_error(message: Column) -> Column:
    """An error as users see it."""
    t = message
    for old, new in CALL_NAMES.items():
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.when(blank(message), FAILED).when(t.rlike(SHOWN_AS_IT_IS), t).when(t.rlike(TIMED_OUT), TIMED_OUT_TEXT).otherwise(t)
